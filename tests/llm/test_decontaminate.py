"""Benchmark passages against brute force, in one block and in many; ids, columns and empty tables of all kinds."""

import hashlib
import random
import subprocess
import sys

import pytest

from millrace.llm import decontaminate as D


def by_hand(text, items, window):
    """Every window of every item against every place of the text."""
    w = D.words(text or "")
    hit, ids = [False] * len(w), set()
    for item, body in items:
        v = D.words(body or "")
        size = min(window, len(v))
        for i in range(len(v) - size + 1 if v else 0):
            for k in range(len(w) - size + 1):
                if w[k:k + size] == v[i:i + size]:
                    hit[k:k + size] = [True] * size
                    ids |= set() if item is None else {item}
    return hit, ids


def made(seed):
    r = random.Random(seed)
    text = lambda n: r.choice(" -").join(r.choice(["a", "B", "c", "é", "a1"]) for _ in range(n))
    items = [(r.choice(["x", "y", "z", None]), text(r.choice([0, 1, 3, 4, 5, 9, 20]))) for _ in range(12)] + [("n", None)]
    return items, [text(n) for n in (0, 1, 2, 5, 40, 90)] + [items[4][1], items[5][1] + "!", "zz " * 30]


@pytest.mark.parametrize("seed", range(12))
def test_windows_by_brute_force(seed):
    items, texts = made(seed)
    for window in (1, 4, 13):
        machine = D.Windows(items, window)
        for text in texts:
            n, hit, ids = machine.scan(text)
            assert (hit.tolist(), ids) == by_hand(text, items, window) and n == len(hit)


def test_rows_by_brute_force_in_blocks(spark):
    items, texts = made(99)
    rows = [(f"d{i}", t, 1) for i, t in enumerate(texts)] + [(None, None, 1), ("d0", texts[0], 1)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, `_hit_words` int")
    bench = spark.createDataFrame(items, "item_id string, text string")
    for size in (1 << 20, 40):
        found = D.find_passages(docs, bench, window=4, percent=50, block_bytes=size).collect()
        assert len(found) == len(rows)
        keep = []
        for doc, text, _ in rows:
            hit, ids = by_hand(text, items, 4)
            listed = ",".join(sorted(ids))
            dirty = 0 < sum(hit) and 2 * sum(hit) >= len(hit)
            want = (len(hit), sum(hit), len(ids), hashlib.sha256(listed.encode()).hexdigest(), dirty)
            assert want in [tuple(r)[1:6] for r in found if r["doc_id"] == doc]
            keep += [] if dirty else [(doc, text, 1)]
        kept = D.drop_contaminated(docs, bench, window=4, percent=50, block_bytes=size)
        assert kept.columns == docs.columns
        assert sorted(map(tuple, kept.collect()), key=repr) == sorted(keep, key=repr)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([("x", "a b")], "item_id string, text string")
    assert {r["n_hit"] for r in D.find_passages(docs, bench.limit(0)).collect()} == {0}
    assert D.drop_contaminated(docs, bench.limit(0)).count() == 2
    assert D.find_passages(docs.limit(0), bench).count() == 0 and D.drop_contaminated(docs.limit(0), bench).count() == 0


def test_memory_for_a_megabyte_of_benchmark():
    """A process of its own: 1 MB of items takes less than 200 MB (one node a letter took 640)."""
    code = (
        "import random, resource; from millrace.llm.decontaminate import Windows; r = random.Random(1);"
        "items = [(str(i), ' '.join(f'word{r.randrange(20000)}' for _ in range(60))) for i in range(1700)];"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; Windows(items);"
        "print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)")
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 200 << 10


def test_one_automaton_for_each_worker():
    block = [("x", "a b")]
    assert D.windows_of(block, 13) is D.windows_of(list(block), 13) and len(D._built) == 1
    D.windows_of(block, 2)
    assert len(D._built) == 1
