"""The join against all pairs, and its signatures against their promise."""

import random

import numpy as np
import pytest

from millrace.llm import ngram_join as J


def brute(rows, words, percent):
    sets = {}
    for i, text in rows:
        w = [x for x in J_words(text)]
        sets[i] = {tuple(w[k:k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def J_words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def variants(seed):
    """Texts of many lengths in families that share most words."""
    r, texts = random.Random(seed), [None, "", " \t\n", "One", "one", "one TWO", "one two", "\x1f\x1f x"]
    for size in (3, 5, 9, 11, 14, 20, 33, 40, 60, 90, 150, 400):
        base = [f"w{r.randrange(4000)}" for _ in range(size)]
        for _ in range(7):
            copy = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                copy[r.randrange(size)] = f"x{r.randrange(10 ** 6)}"
            texts.append(" ".join(copy + base[:r.choice([0, 0, 1, 2])]))
    return list(enumerate(texts))


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80), (2, 70)])
def test_components_match_all_pairs(spark, words, percent):
    rows = variants(words)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, h int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.link(df, words=words, percent=percent).collect()}
    assert got == brute(rows, words, percent)


@pytest.mark.parametrize("percent", [80, 90])
def test_similar_sets_share_a_signature(percent):
    r, ends = np.random.default_rng(percent), np.array(J.bands(percent))
    for n in [*range(9, 60), 100, 333, 1000, 3000]:
        a = np.unique(r.integers(0, 2 ** 63, n, np.int64).astype(np.uint64) * np.uint64(2))
        lost = (100 - percent) * n // 100
        for out in {0, lost // 2, lost}:
            more = 0
            while 100 * (n - out) >= percent * (n + more + 1):
                more += 1
            b = np.unique(np.concatenate([r.permutation(a)[out:], r.integers(0, 2 ** 63, more, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)]))
            if len(a) == len(b) and (a == b).all():
                continue
            (x, band, need), (y, other, need_y) = J.signatures(a, ends, percent), J.signatures(b, ends, percent)
            scheme = min(band, other)
            if len(a) * percent < J.SMALL * 100 and min(len(a), len(b)) < J.SMALL:
                scheme = 0
            least = 1 if not scheme else max(need[band - scheme], need_y[other - scheme])
            both = np.intersect1d(x, y)
            assert (both % J.SCHEMES == scheme).sum() >= least


def test_repeated_and_nameless_rows(spark):
    text = " ".join(f"a{i}" for i in range(30))
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (7, text + " z"), (None, None), (None, "only this here")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in J.link(df).collect() if r["doc_id"])
    assert got == [(5, 5), (5, 5), (7, 5)]
    assert J.link(df).count() == 6
    assert J.link(df.limit(0)).count() == 0


def test_a_large_group_is_not_paired(spark):
    """Three hundred texts within the similarity of each other make one component."""
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(base[:k] + [f"n{i}"] + base[k + 1:])) for i in range(300) for k in [i]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["component_id"] for r in J.link(df).collect()} == {0}


def crowd(n, seed=1):
    """Copies of one text with a sixth of it rewritten each: near each other, seldom linked; families of some."""
    r = random.Random(seed)
    base, texts = [f"w{i}" for i in range(160)], []
    while len(texts) < n:
        copy, k = list(base), r.randrange(120)
        for at in (k, k + 13, r.randrange(150), r.randrange(150)):
            copy[at:at + 3] = [f"n{r.randrange(10 ** 7)}" for _ in range(3)]
        texts.append(copy)
        for _ in range(r.choice([0, 0, 0, 1, 4])):
            again = list(r.choice([copy, base]))
            for _ in range(r.choice([1, 2, 3])):
                again[r.randrange(len(again))] = f"m{r.randrange(10 ** 7)}"
            texts.append(again[:r.choice([160, 160, 152])])
    return [(i, " ".join(t)) for i, t in enumerate(texts[:n])]


@pytest.mark.parametrize("few,rounds,words,percent", [(8, 4, 3, 90), (2, 4, 3, 80), (1, 1, 5, 80), (3, 4, 2, 85)])
def test_crowded_signatures_lose_no_link(spark, monkeypatch, few, rounds, words, percent):
    monkeypatch.setattr(J, "FEW", few)
    monkeypatch.setattr(J, "ROUNDS", rounds)
    rows = crowd(260, few)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.link(df, words=words, percent=percent).collect()}
    assert got == brute(rows, words, percent)


def test_pairs_follow_the_rows(spark, monkeypatch):
    """Of near copies that are not linked no pairs are made in proportion to the square of their number."""
    made, meet = [], J._meet

    def counted(member, tokens, percent):
        pairs, links = meet(member, tokens, percent)
        made.append(sum(p.count() for p in pairs))
        return pairs, links

    monkeypatch.setattr(J, "_meet", counted)
    for n in (300, 600, 1200):
        assert J.link(spark.createDataFrame(crowd(n), "doc_id long, text string")).count() == n
        assert made[-1] <= 2 * J.FEW * n
    assert made[2] <= 8 * max(made[0], 100)


def test_who_has_much_of_its_own_is_not_paired(spark, monkeypatch):
    """Texts with a passage in common and too many words of their own to be linked make no pairs."""
    made, meet = [], J._meet

    def counted(member, tokens, percent):
        pairs, links = meet(member, tokens, percent)
        made.append(sum(p.count() for p in pairs))
        return pairs, links

    monkeypatch.setattr(J, "_meet", counted)
    passage = [f"w{i}" for i in range(160)]
    rows = [(i, " ".join(passage + [f"n{i}_{k}" for k in range(20)])) for i in range(60)]
    assert {r["component_id"] for r in J.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == set(range(60))
    assert made == [0]


def test_open_classes_keep_every_link(spark):
    """Classes linked to another group are open, and the sum of their slack is not positive."""
    rows = crowd(200, 5)
    sets = {i: J.shingles(t) for i, t in rows}
    sets = {i: s for i, s in sets.items() if not any(len(s) == len(sets[k]) and (s == sets[k]).all() for k in range(i))}
    tokens = spark.createDataFrame([(i, len(s), bytearray(s.tobytes())) for i, s in sets.items()], "h long, n long, tokens binary")
    member = spark.createDataFrame([(i, i) for i in sets], "h long, g long")
    slack = {r["h"]: r["slack"] for r in J._open(member, tokens, 80).collect()}
    linked = 0
    for i in sets:
        for k in sets:
            both = len(np.intersect1d(sets[i], sets[k]))
            if i < k and 100 * both >= 80 * (len(sets[i]) + len(sets[k]) - both):
                linked += 1
                assert slack[i] + slack[k] <= 0
    assert linked > 20


@pytest.mark.parametrize("seed", range(3))
def test_differences_share_what_they_promise(seed):
    """Sets within the similarity share one of the first elements of their differences to a centre, in any order."""
    import pyarrow as pa

    r, percent = np.random.default_rng(seed), 80
    universe = np.arange(1, 90, dtype=np.uint64)
    centre = np.sort(r.choice(universe, 40, replace=False))
    sets = []
    for _ in range(150):
        start = sets[int(r.integers(len(sets)))] if sets and r.random() < 0.7 else centre
        flip = r.choice(universe, int(r.integers(1, 8)), replace=False)
        sets.append(np.setxor1d(start, flip))
    batch = pa.RecordBatch.from_pydict({
        "a": [0] * 150, "h": list(range(150)), "g": [0] * 150, "x": [centre.tobytes()] * 150, "y": [s.tobytes() for s in sets]})
    rows = next(J._differ(percent)(iter([batch]))).to_pylist()
    order, linked_pairs = r.permutation(90), 0
    for i, x in enumerate(rows):
        for y in rows[:i]:
            s, t = sets[x["h"]], sets[y["h"]]
            both = len(np.intersect1d(s, t))
            if (s.tobytes() == t.tobytes() or not len(x["tokens"]) or not len(y["tokens"]) or x["linked"] and y["linked"]
                    or 100 * both < percent * (len(s) + len(t) - both)):
                continue
            linked_pairs += 1
            first = [set(sorted(z["tokens"], key=lambda v: order[v])[:z["deep" if not z["linked"] and w["linked"] else "near"]])
                     for z, w in ((x, y), (y, x))]
            assert first[0] & first[1]
    assert linked_pairs > 20


def test_a_nameless_class_is_a_bridge(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(base)), (None, " ".join(base + ["x", "y", "z"])), (3, " ".join(base + ["x", "y", "z", "p", "q", "r", "s"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["component_id"] for r in J.link(df).collect()] == [1, 1, 1]


def test_few_centres_for_a_large_group(spark, monkeypatch):
    """Near copies that share many edits are held against about one centre each, not one for every shared edit."""
    held, by_difference = [], J._by_difference

    def counted(differ):
        held.append((differ.count(), differ.select("h").distinct().count()))
        return by_difference(differ)

    monkeypatch.setattr(J, "_by_difference", counted)
    monkeypatch.setattr(J, "FEW", 4)
    r = random.Random(3)
    base, texts = [f"w{i}" for i in range(160)], []
    for i in range(250):
        copy = list(base)
        for at in r.sample(range(160), 3):
            copy[at] = f"n{at}_{r.randrange(2)}"
        texts.append((i, " ".join(copy)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in J.link(df, words=5, percent=80).collect()}
    assert got == brute(texts, 5, 80)
    pairs, classes = held[0]
    assert 0 < pairs <= 1.5 * classes


def test_signatures_of_one_class_are_not_written(spark, monkeypatch):
    """Texts without a common passage leave one row each, and shuffles go with their jobs."""
    rows, name = [], "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, written = spark.conf.get(name, None), J.written

    def counted(df, keep=False):
        out = written(df, keep)
        assert spark.conf.get(name) == "true" and not [c for c, kind in out.dtypes if c == "signs"]
        rows.append(out.count())
        return out

    monkeypatch.setattr(J, "written", counted)
    df = spark.createDataFrame([(i, " ".join(f"w{i}_{k}" for k in range(100))) for i in range(50)] + [(50, None), (None, "")], "doc_id long, text string")
    assert J.link(df).count() == 52 and max(rows) == 52
    assert spark.conf.get(name, None) == before
