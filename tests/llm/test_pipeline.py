"""The pipeline stage by stage: columns stay, and what each stage decides takes effect."""

import corpus_pipeline as C
from millrace.llm import credentials, decontaminate, ngram_join
from millrace.llm.common import table, written


def test_stages(spark, folder):
    docs = table(spark, folder, "documents")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    kept = {}
    for name, stage in C.STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, folder))
        kept[name] = docs
        assert docs.columns == before.columns and ids(docs) <= ids(before)
        if name == "ngram_join":
            links = ngram_join.link(before, words=5, percent=80).collect()
            assert ids(docs) == {r["component_id"] for r in links}
        elif name == "decontamination":
            found = decontaminate.find_passages(before, table(spark, folder, "benchmark")).filter("NOT contaminated")
            assert ids(docs) == ids(found)
        elif name == "secrets":
            assert ids(docs) == ids(before)
            assert credentials.find_secrets(docs).filter("spans <> ''").count() == 0
    pieces = C.STAGES[-1][1](spark, docs, folder)
    assert ids(pieces) == ids(docs)
