"""Secrets in texts, and weak parts of credentials where complementary parts stand nearby.

Some strings are secrets by their look: assignments to a secret name, access keys, long hex runs.
Others are weak candidates: a user or client name, a bare 40-character key, an endpoint.  They are
reported only where the complementary parts co-occur within a scope of text: an interval join of
identifiers, secrets and endpoints decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank, plain, unused, written
from .spans import matches, replaced

#: Fixed by the contract, in the order that breaks ties.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Weak candidates.
IDENT = r"""(?i:access_?key_?id|client_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
BARE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/]{0,39}[A-Z])(?=[A-Za-z0-9+/]{0,39}[a-z])(?=[A-Za-z0-9+/]{0,39}[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/_=-])"
ENDPOINT = r"""(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3|ftp)://[^\s"'<>]+"""
KINDS = ("assign", "access", "hex", "ident", "bare", "endpoint")
#: Code points between the ends of two parts that still belong together.
SCOPE = 200


def base_spans(text: Column) -> dict[str, Column]:
    return {
        "assign": matches(text, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 12),
        "access": matches(text, ACCESS), "hex": matches(text, HEX)}


def weak_spans(text: Column) -> dict[str, Column]:
    return {"ident": matches(text, IDENT), "bare": matches(text, BARE), "endpoint": matches(text, ENDPOINT)}


def _listed(spans: Column) -> Column:
    """``kind:start:end`` of ``struct<start,order,end>`` in order, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["order"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _entries(kinds: tuple[str, ...]) -> Column:
    def of(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(
            s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), s["end"].alias("end")))

    return F.concat(*[of(k) for k in kinds])


def _cells(start: Column, end: Column, scope: int) -> Column:
    """Cells of ``scope`` code points that the stretch from start to end, both included, touches."""
    return F.explode(F.sequence(F.floor(start / scope).cast("int"), F.floor(end / scope).cast("int")))


def _near(weak: DataFrame, parts: DataFrame, scope: int) -> DataFrame:
    """The weak candidates with a part at most ``scope`` away in the same text; a semi join, so no pairs come out.

    Both sides lie in all cells they touch, the parts widened by ``scope``: stretches that meet share a cell.
    """
    cells = parts.select(
        F.col("digest").alias("d"), F.col("start").alias("a"), F.col("end").alias("b"),
        _cells(F.col("start") - scope, F.col("end") + scope, scope).alias("c"))
    laid = weak.select("*", _cells(F.col("start"), F.col("end"), scope).alias("cell"))
    return laid.join(
        cells, (laid["digest"] == cells["d"]) & (laid["cell"] == cells["c"])
        & (cells["a"] <= laid["end"] + scope) & (cells["b"] >= laid["start"] - scope), "left_semi").select(*weak.columns).distinct()


def find_secrets(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """``doc_id``, the text's ``digest``, one array of spans (start, end, match) for each base kind, ``linked`` and ``spans``.

    One row for every row of the input.  Null text is empty.  Equal texts are linked once; the spans
    of a text without complementary parts never leave its row.  Weak spans are dropped unless: an
    identifier has a secret nearby, a bare key has an identifier, an endpoint has both.
    """
    docs = plain(documents, doc_id=doc_id, text=text).withColumn("text", blank(F.col("text")))
    t = F.col("text")
    found = docs.select("doc_id", F.md5("text").alias("digest"), *[c.alias(k) for k, c in (base_spans(t) | weak_spans(t)).items()])
    some = lambda *kinds: F.greatest(F.lit(0), *[F.size(k) for k in kinds]) > 0
    ids, secrets = ("access", "ident"), ("assign", "hex", "bare")
    found = written(found.withColumn("linkable", some(*ids) & some(*secrets) & some("ident", "bare", "endpoint")))

    entries = found.filter("linkable").dropDuplicates(["digest"]).select("digest", F.explode(_entries(KINDS)).alias("s")).select(
        "digest", "s.*")
    of = lambda *kinds: entries.filter(F.col("order").isin([KINDS.index(k) for k in kinds]))
    linked = (
        _near(of("ident"), of(*secrets), scope)
        .unionByName(_near(of("bare"), of(*ids), scope))
        .unionByName(_near(_near(of("endpoint"), of(*ids), scope), of(*secrets), scope))
        .groupBy("digest").agg(F.collect_list(F.struct("start", "order", "end")).alias("linked")))
    none = F.array().cast("array<struct<start:int,order:int,end:int>>")
    alone = found.filter("NOT linkable").withColumn("linked", none)
    joined = found.filter("linkable").join(linked, "digest", "left").withColumn("linked", F.coalesce("linked", none))
    return alone.unionByName(joined).select(
        "doc_id", "digest", "assign", "access", "hex", "linked", _listed(_entries(("assign", "access", "hex"))).alias("base"),
        _listed(F.concat(_entries(("assign", "access", "hex")), F.col("linked"))).alias("spans"))


def redact(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The documents, all rows and columns, with every reported span replaced by a mark.

    Spans are found once for each distinct text and meet the rows by the text's digest; texts in which
    no pattern occurs do not move.  A null text stays null, an empty table stays empty, repeated rows
    are changed alike and columns may have any names.
    """
    names = documents.columns
    flag, digest, found = (unused(n, names) for n in ("_suspect", "_digest", "_spans"))
    old = F.col(f"`{text}`")
    suspect = F.coalesce(F.greatest(*[old.rlike(p) for p in (ASSIGN, ACCESS, HEX, IDENT, BARE, ENDPOINT)]), F.lit(False))
    split = documents.withColumn(flag, suspect)
    spans = find_secrets(split.filter(F.col(flag)), doc_id, text).select(
        F.col("digest").alias(digest), F.sort_array(F.concat(_entries(("assign", "access", "hex")), F.col("linked"))).alias(found)
    ).filter(F.size(found) > 0).dropDuplicates([digest])

    marked = split.filter(F.col(flag)).withColumn(digest, F.md5(old)).join(spans, digest, "left").withColumn(
        text, F.when(F.col(found).isNull(), old).otherwise(replaced(old, F.col(found), mark)))
    back = [f"`{n}`" for n in names]
    return split.filter(~F.col(flag)).select(*back).unionByName(marked.select(*back))
