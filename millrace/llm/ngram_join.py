"""Documents with nearly the same word shingles, joined exactly by a token-group matrix.

Equal shingle sets are one class.  The token universe is cut into parts, more of them than two sets
within the similarity can differ in tokens: such sets agree on some parts, and a part's content is a
signature to meet by.  Classes that meet are first held against the smallest class they
meet; those within the similarity form groups of similar documents.  The matrix holds the union of
tokens of each group.  What meets a member of another group is a query to that group: its overlap
with the union bounds its overlap with every member, and only groups that the bound admits are opened
and compared set by set.  Links are transitive for the result, so a group's inside is never paired.

Two sets differ at least in the tokens that no other group has, so a class with too many of those has
no partner outside its group, and two classes that together have too many are no pair.  Signatures
by which the same classes meet count as one.
Classes that meet by what many have in common are not paired.  They are held against a centre instead,
and those that the centre leaves in different groups meet by what they differ from it in: sets within
the similarity must share much of that, so the rarest elements of the difference bring them together.
Elements that many share are treated likewise, with a centre of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import plain, rows_at_once, scratch, shuffles_removed, written
from ..operators.components import components

WORDS = 3
#: Similarity in per cent.
PERCENT = 90
#: Sets of fewer tokens meet by triples of tokens.
SMALL = 32
#: Schemes that a signature can tell apart.
SCHEMES = 512
#: Members whose tokens are united in one row of the matrix; a larger group takes several rows.
CHUNK = 64
#: Classes that are paired when they meet; more of them meet by their differences to a centre, which takes
#: about as many rows for each class.
FEW = 32
#: Centres one below another; what still is common then is paired, so that no link is lost.
ROUNDS = 4
#: Classes up to which their ids are sent to all tasks; beyond, texts are shuffled to them.
SEND_CLASSES = 1_000_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BLANKS = bytes(32 if b == 32 or 9 <= b <= 13 else b for b in range(256))

_hashes: dict[bytes, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits evenly (the finalizer of splitmix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit shingles; fewer words make one shingle, no word makes none."""
    import xxhash

    found = (text or "").encode("utf-8", "replace").translate(LOWER).translate(BLANKS).split(b" ")
    found = [w for w in found if w]
    if not found:
        return np.zeros(0, np.uint64)
    for w in set(found).difference(_hashes):
        _hashes[w] = xxhash.xxh3_64_intdigest(w)
    h = np.array([_hashes[w] for w in found], np.uint64)
    if len(_hashes) > 500_000:  # bounded memory
        _hashes.clear()
    size = min(words, len(h))
    total = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + h[k:len(h) - size + 1 + k])
    return np.unique(total)


def bands(percent: int = PERCENT) -> list[int]:
    """Largest set size of each band; a set's partners are in its own band, the one below or above."""
    ends = [1]
    while ends[-1] < 1 << 40:
        ends.append(max(ends[-1] * 100 // percent, ends[-1] + 1))
    return ends


@cache
def parts_of(smallest: int, largest: int, percent: int) -> tuple[int, int, int]:
    """Parts for a band of set sizes, tokens that make a part rich, and poor parts that are too many.

    Partners of which the smaller has at most ``largest`` tokens differ in at most
    ``largest * (100 - p) / p`` of them and so agree on all further parts.  There are so many of those
    that a set seldom has as many poor parts: then one agreement at least is on a rich part.
    """
    differ = largest * (100 - percent) // percent
    mean = largest / (differ + 2)
    rich = 3 if mean >= 8 else 2 if mean >= 5.5 else 1
    parts = differ + 2
    for _ in range(12):
        mean = smallest / parts
        poor = parts * sum(math.exp(-mean) * mean ** k / math.factorial(k) for k in range(rich))
        parts = differ + 2 + math.ceil(poor + 3 * math.sqrt(poor))
    return parts, rich, parts - differ


def _of_scheme(sign: np.ndarray, scheme: int) -> np.ndarray:
    return sign & ~np.uint64(SCHEMES - 1) | np.uint64(scheme)


def signatures(tokens: np.ndarray, ends: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, int, list[int]]:
    """What a set meets others by, its band, and how many signatures a partner must share.

    The scheme that a signature belongs to, the band of the smaller partner or 0, is in its low bits.
    The numbers are for the set's own band and the band below; sets within the similarity share as
    many signatures of one scheme, the larger of both sets' numbers.

    Small sets: three tokens of their first ones, in token order; of sets within the similarity the
    first ``n - p n / 100 + 3`` have three in common.  Other sets: the contents of rich parts, for the
    band as the smaller partner and for the band below as the larger one.  A set with too many poor
    parts also meets by pairs of those, since it may agree with others like it on nothing else.
    """
    n, out, needs = len(tokens), [], [1, 1]
    if n * percent < SMALL * 100:
        first = tokens[:n + percent * n // -100 + 3]
        i = np.array(list(combinations(range(len(first)), 3)), np.int64).reshape(-1, 3)
        out.append(_of_scheme(mix(mix(mix(first[i[:, 0]]) + first[i[:, 1]]) + first[i[:, 2]]), 0))
    band = int(np.searchsorted(ends, n))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens + np.uint64(1)))])
    for below, scheme in enumerate((band, band - 1)):
        if scheme < 1 or ends[scheme] < SMALL:
            continue
        parts, rich, many = parts_of(int(ends[scheme - 1]) + 1, int(ends[scheme]), percent)
        edges = (np.arange(1, parts, dtype=np.float64) / parts * 2.0 ** 64).astype(np.uint64)
        cuts = np.concatenate([[0], np.searchsorted(tokens, edges), [n]])
        content = total[cuts[1:]] - total[cuts[:-1]]
        sign = mix(content + mix(np.arange(parts, dtype=np.uint64) + np.uint64(scheme) * np.uint64(1 << 40)))
        full = np.diff(cuts) >= rich
        out.append(_of_scheme(sign[full], scheme))
        poor = sign[~full]
        needs[below] = max(many - len(poor), 1)
        if len(poor) >= many:
            a, b = np.triu_indices(len(poor), 1)
            out.append(_of_scheme(mix(poor[a] * np.uint64(3) + poor[b]), scheme))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64), band, needs


def _profiler(words: int, percent: int):
    """Rows ``sign, h``, one for each signature, and one row for each document that has its ``profile`` instead."""
    ends = np.array(bands(percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()  # sets whose signatures this task has given; bounded, as repeats do no harm
        rows = 0
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column(1).to_pylist()]
            keys = [int(np.add.reduce(mix(s + np.uint64(7))).astype(np.int64)) if len(s) else None for s in sets]
            found = [signatures(s, ends, percent) for s in sets]
            signs = []
            for (sign, _, _), key in zip(found, keys):
                signs.append(np.zeros(0, np.int64) if key is None or key in told else sign.view(np.int64))
                told.add(key)
            if len(told) > 200_000:
                told.clear()
            profile = pa.StructArray.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([f[1] for f in found], pa.int32()),
                 pa.array([f[2][0] for f in found], pa.int32()), pa.array([f[2][1] for f in found], pa.int32())],
                names=["doc_id", "n", "band", "need", "need_below"])
            # Profiles are dealt evenly; their numbers are no signatures.
            spread = mix(np.arange(rows, rows + len(sets), dtype=np.uint64)).view(np.int64)
            rows += len(sets)
            yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(keys, pa.int64()), profile], names=["sign", "h", "profile"])
            given = [k for k, sign in enumerate(signs) if len(sign)]
            if given:
                sign = pa.array(np.concatenate([signs[k] for k in given]))
                h = pa.array(np.repeat(np.array([keys[k] for k in given], np.int64), [len(signs[k]) for k in given]))
                yield pa.RecordBatch.from_arrays([sign, h, pa.nulls(len(sign), profile.type)], names=["sign", "h", "profile"])
    return run


def _scheme() -> Column:
    return F.col("sign").bitwiseAND(F.lit(SCHEMES - 1)).cast("int")


def _need() -> Column:
    """Signatures of ``scheme`` that a partner must share with the class."""
    return F.when(F.col("scheme") == F.col("band"), F.col("need")).when(
        F.col("scheme") == F.col("band") - 1, F.col("need_below")).otherwise(1)


def _rarest(member: DataFrame, needs: DataFrame) -> DataFrame:
    """Leave out the commonest signatures of each class and scheme, one fewer than a partner must share.

    All classes rank signatures alike, so the rarest of those that two sets within the similarity
    share stays with both of them.  Signatures of a single group go before.
    """
    commonest = Window.partitionBy("h", "scheme").orderBy(F.desc("often"), F.desc("sign"))
    ranked = _of_scheme_and_need(_mixed(member, F.count(F.lit(1)).over(Window.partitionBy("sign")).alias("often")), needs)
    return ranked.withColumn("rank", F.row_number().over(commonest)).filter("rank >= least").select(*member.columns)


def _mixed(member: DataFrame, *more: Column) -> DataFrame:
    """Without signatures that stay within one group."""
    same = Window.partitionBy("sign")
    return member.select("*", F.min("g").over(same).alias("lo"), F.max("g").over(same).alias("hi"), *more).filter("lo <> hi").drop("lo", "hi")


def _of_scheme_and_need(member: DataFrame, needs: DataFrame) -> DataFrame:
    return member.withColumn("scheme", _scheme()).join(needs, "h").withColumn("least", _need()).drop("band", "need", "need_below")


def _peel(member: DataFrame, needs: DataFrame) -> DataFrame:
    """Leave out the signatures of a class in a scheme in which it has fewer than a partner must share.

    A second round would be safe, too, but finds little.
    """
    here = F.count(F.lit(1)).over(Window.partitionBy("h", "scheme"))
    return written(_of_scheme_and_need(member, needs).withColumn("c", here).filter("c >= least").select(*member.columns))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = [np.frombuffer(t, np.int64) for t in batch.column("tokens").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("h", "g", "n")), pa.array(tokens, pa.list_(pa.int64()))], names=["h", "g", "n", "tokens"])


def _open(member: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """``h, n, slack``: the classes that may be linked to a class of another group.

    The tokens that no other group has are on one side only of any difference to another group.  Sets of
    n and n' tokens are linked if they differ in at most (100 - p) / (100 + p) (n + n'), so two classes with
    a positive sum of ``slack`` are not; and a class shares at least p per cent of its tokens with a partner.
    """
    classes = member.select("h", "g").distinct()
    each = written(tokens.join(classes, "h").select("h", "g", "n", "tokens").mapInArrow(
        _listed, "h long, g long, n long, tokens array<long>")).select("h", "g", "n", F.explode("tokens").alias("token"))
    mixed = each.groupBy("token").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).filter("lo <> hi").select("token")
    foreign = each.join(mixed, "token", "left_semi").groupBy("h", "n").agg(F.count(F.lit(1)).alias("foreign"))
    return written(foreign.filter(F.col("foreign") * 100 >= F.col("n") * percent).select(
        "h", "n", (F.lit(2 * percent) * F.col("n") - F.lit(100 + percent) * F.col("foreign")).alias("slack")))


def _central(meeting: DataFrame, by: str = "sign") -> DataFrame:
    """``meeting`` with ``a``: of the classes that meet by a signature the one whose own signatures are the commonest.

    What others were copied from has them in common with all copies, so that copies become one star.
    ``weight`` says how common the centre's signatures are.
    """
    same = Window.partitionBy(by)
    often = meeting.withColumn("often", F.count(F.lit(1)).over(same))
    weighty = often.withColumn("weight", F.sum("often").over(Window.partitionBy("h")))
    return weighty.withColumn("top", F.max(F.struct("weight", "h")).over(same)).select(
        *meeting.columns, F.col("top.h").alias("a"), F.col("top.weight").alias("weight"))


def _fewer_centres(held: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """``a, b``: centres ``a`` and the heavier one ``b`` that stands for them.

    A centre that meets a heavier one, from which it differs in at most twice what linked sets differ in, gives way.
    Each class is then held against few centres, whatever signatures it has; any class may be a centre.
    What stands for others stays one itself.
    """
    centres = held.select(F.col("a").alias("h")).distinct()
    above = written(held.filter("a <> h").join(centres, "h", "left_semi").select("a", F.col("h").alias("b"), "weight").distinct())
    close = written(_verified(above.select("a", "b"), tokens, percent, 2).join(above, ["a", "b"]))
    tops = close.join(close.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
    return tops.groupBy("b").agg(F.max_by("a", F.struct("weight", "a")).alias("top")).select(F.col("b").alias("a"), F.col("top").alias("b"))


def _token_reader(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, h in zip(*(c.to_pylist() for c in batch.columns)):
                s = shingles(text, words)
                key = int(np.add.reduce(mix(s + np.uint64(7))).astype(np.int64)) if len(s) else None
                if key is not None and h in (None, key):
                    rows.append((key, len(s), s.tobytes()))
            h, n, tokens = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(h, pa.int64()), pa.array(n, pa.int64()), pa.array(tokens, pa.binary())], names=["h", "n", "tokens"])
    return run


def _verifier(percent: int, times: int = 1):
    """Keep the pairs (a, b) whose sets are within the similarity, or differ in at most so many ``times`` as much."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                total, both = len(s) + len(t), len(np.intersect1d(s, t, assume_unique=True))
                keep.append((100 + percent) * (total - 2 * both) <= times * (100 - percent) * total)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], names=["a", "b"])
    return run


def _bounder(percent: int):
    """Keep the queries (q, g, chunk) whose overlap with the union could be enough for some member."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, least in zip(*(batch.column(c).to_pylist() for c in ("tokens", "union", "least"))):
                s = np.frombuffer(x, np.uint64)
                overlap = len(np.intersect1d(s, np.frombuffer(y, np.uint64), assume_unique=True))
                smallest = max(least, -(-percent * len(s) // 100))
                keep.append((100 + percent) * overlap >= percent * (len(s) + smallest))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).filter(pa.array(keep)) for c in ("q", "g", "chunk")], names=["q", "g", "chunk"])
    return run


def _differ(percent: int):
    """The elements in which ``h`` and its centre ``a`` differ, and how many of the rarest of them suffice.

    With r = (100 - p) / (100 + p), sets of n and c tokens are linked if they differ in at most r (n + c).
    The differences of two linked sets to the centre share (m + m' - d) / 2 elements, m and m' being their
    sizes and d the number in which the sets differ.  If the partner is not linked to the centre, that
    is more than (m + r (c - n)) / 2, which gives ``near``.  A set that is not linked to the centre shares
    at least (m - r (n + c)) / 2 with a partner that is, which gives ``deep``.  Both also share m - d.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [c for c in batch.schema.names if c not in ("x", "y")]
            linked, size, near, deep, tokens = [], [], [], [], []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                other = np.setxor1d(s, t, assume_unique=True)
                c, n, m = len(s), len(t), len(other)
                apart = (100 + percent) * m - (100 - percent) * (n + c)
                least = max(m - n * (100 - percent) // percent, 1)
                half = ((100 + percent) * m + (100 - percent) * (c - n)) // (2 * (100 + percent)) + 1
                linked.append(apart <= 0)
                size.append(m)
                near.append(m - max(half, least) + 1)
                deep.append(m - max(-(-apart // (2 * (100 + percent))), least) + 1)
                tokens.append(other.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(linked, pa.bool_()), pa.array(size, pa.int32()),
                 pa.array(near, pa.int32()), pa.array(deep, pa.int32()), pa.array(tokens, pa.list_(pa.int64()))],
                names=[*kept, "linked", "m", "near", "deep", "tokens"])
    return run


def _by_difference(differ: DataFrame) -> DataFrame:
    """``key, h, g, n, slack, asks, answers``: classes that may be linked share a key, by which one asks and one answers.

    Elements are ranked by how many differences to the same centre have them, the rarest first.  What
    only one has needs no row: it just comes first.
    """
    each = differ.select("a", "h", "g", "n", "slack", "linked", "m", "near", "deep", F.explode("tokens").alias("token"))
    often = each.groupBy("a", "token").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    own = Window.partitionBy("a", "h")
    ranked = each.join(often, ["a", "token"]).withColumn(
        "rank", F.row_number().over(own.orderBy("often", "token")) + F.col("m") - F.count(F.lit(1)).over(own))

    def row(side: int, asks: bool, answers: bool, when: Column) -> Column:
        key = F.xxhash64("a", "token", F.lit(side))
        answers = F.col("slack") <= 0 if asks and answers else F.lit(answers)  # of a pair at least one has no positive slack
        return F.when(when, F.struct(key.alias("key"), "h", "g", "n", "slack", F.lit(asks).alias("asks"), answers.alias("answers")))

    linked, near, deep = F.col("linked"), F.col("rank") <= F.col("near"), F.col("rank") <= F.col("deep")
    rows = F.array_compact(F.array(
        row(0, True, True, ~linked & near), row(1, True, False, ~linked & deep), row(1, False, True, linked & near)))
    return ranked.select(F.explode(rows).alias("row")).select("row.*")


def _meet(member: DataFrame, tokens: DataFrame, percent: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Pairs ``a < b`` of classes of different groups that may be linked, and groups ``a, b`` that centres link.

    ``member`` has ``key, h, g, n, slack``.  Keys of few classes pair them; a key with more gets a centre.
    """
    pairs, links = [], []
    member = member.withColumn("asks", F.lit(True)).withColumn("answers", F.col("slack") <= 0)
    one = ("h", "asks", "answers")
    for left in range(ROUNDS, -1, -1):
        sizes = member.groupBy("key").agg(
            F.min("g").alias("lo"), F.max("g").alias("hi"), F.count_if("asks").alias("ask"), F.count_if("answers").alias("answer"),
            F.bit_xor(F.xxhash64(*one)).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), *one)).alias("y")).filter("lo <> hi AND ask > 0 AND answer > 0")
        sizes = sizes.groupBy("ask", "answer", "x", "y").agg(F.min("key").alias("key")).select("key", F.least("ask", "answer").alias("k"))
        sized = written(member.join(sizes, "key"))
        few = sized.filter(F.col("k") <= FEW) if left else sized
        ask = few.filter("asks").select(
            "key", F.col("h").alias("a"), F.col("g").alias("own"), F.col("answers").alias("both"), F.col("n").alias("size"), F.col("slack").alias("spare"))
        answer = few.filter("answers").select("key", F.col("h").alias("b"), "g", "n", "slack")
        met = ask.join(answer, "key").filter("own <> g AND (NOT both OR a < b) AND spare + slack <= 0").filter(
            100 * F.least("size", "n") >= percent * F.greatest("size", "n"))
        pairs.append(written(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))
        many = sized.filter(F.col("k") > FEW)
        if not left or many.isEmpty():
            return pairs, links
        held = written(_central(many.select("key", "h", "g", "n", "slack"), "key").drop("key").distinct())
        fewer = written(_fewer_centres(held, tokens, percent))
        held = held.join(fewer, "a", "left").select(F.coalesce("b", "a").alias("a"), "h", "g", "n", "slack").distinct()
        x = tokens.select(F.col("h").alias("a"), F.col("tokens").alias("x"))
        y = tokens.select("h", F.col("tokens").alias("y"))
        differ = written(held.join(x, "a").join(y, "h").select("a", "h", "g", "n", "slack", "x", "y").mapInArrow(
            _differ(percent), "a long, h long, g long, n long, slack long, linked boolean, m int, near int, deep int, tokens array<long>"))
        own = differ.filter("a = h").select("a", F.col("g").alias("b"))
        links.append(differ.filter("linked").join(own, "a").filter("g <> b").select(F.col("g").alias("a"), "b"))
        member = _by_difference(differ.filter("a <> h"))
    return pairs, links


def _unite(frame: pd.DataFrame) -> pd.DataFrame:
    union = np.unique(np.concatenate([np.frombuffer(t, np.uint64) for t in frame["tokens"]]))
    return pd.DataFrame({"g": frame["g"].iloc[:1], "chunk": frame["chunk"].iloc[:1], "least": [frame["n"].min()], "union": [union.tobytes()]})


def _verified(pairs: DataFrame, tokens: DataFrame, percent: int, times: int = 1) -> DataFrame:
    x = tokens.select(F.col("h").alias("a"), F.col("tokens").alias("x"))
    y = tokens.select(F.col("h").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verifier(percent, times), "a long, b long")


def link(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, class_size`` for every row.

    ``component_id`` is the smallest id that links lead to.  Documents without words, null texts among
    them, are linked with nothing and carry their own id.  Rows with equal sets, repeated rows too,
    are one class; a class without any id has a null component, unless it is linked to one with an id.  ``percent`` is 67 at least: below that
    small sets within the similarity may have fewer than three tokens in common.
    """
    if not 67 <= percent <= 99:
        raise ValueError("percent must be between 67 and 99")
    with scratch(documents.sparkSession), shuffles_removed(documents.sparkSession):
        return written(_link(documents, doc_id, text, words, percent), keep=True)


def _link(documents: DataFrame, doc_id: str, text: str, words: int, percent: int) -> DataFrame:
    spark = documents.sparkSession
    rows_at_once(spark)
    docs = plain(documents, doc_id=doc_id, text=text)
    signed = docs.mapInArrow(_profiler(words, percent), "sign long, h long, profile struct<doc_id:long,n:long,band:int,need:int,need_below:int>")
    # Most signatures occur once: one sort by signature finds the others.  Of equal rows the last stays, unless all of the signature's are equal.
    same = Window.partitionBy("sign", F.col("profile").isNull()).orderBy("h")
    seen = written(
        signed.select("*", F.first("h").over(same.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("first"), F.lead("h").over(same).alias("next"))
        .filter("profile IS NOT NULL OR NOT h <=> next AND (next IS NOT NULL OR h <> first)").select("sign", "h", "profile"))
    profiles = seen.filter("profile IS NOT NULL").select("profile.*", "h")
    filled = profiles.filter("h IS NOT NULL")
    classes = written(filled.groupBy("h").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"),
        *[F.max(c).alias(c) for c in ("band", "need", "need_below")]))
    needs = classes.select("h", "band", "need", "need_below")
    meeting = _peel(seen.filter("profile IS NULL").select("sign", "h"), needs)

    wanted = written(meeting.select("h").distinct().join(classes.select("h", "rep"), "h"))
    # A checked size decides how texts and wanted classes meet; the rows are the same.
    side = F.broadcast(wanted) if wanted.count() <= SEND_CLASSES else wanted
    schema = "h long, n long, tokens binary"
    tokens = docs.join(side, docs["doc_id"] == side["rep"]).select("text", "h").mapInArrow(_token_reader(words), schema)
    # Classes without any id are found by their sets.
    nameless = docs.filter("doc_id IS NULL").select("text", F.lit(None).cast("long").alias("h")).mapInArrow(_token_reader(words), schema)
    nameless = nameless.join(wanted.filter("rep IS NULL").select("h"), "h", "left_semi")
    tokens = written(tokens.unionByName(nameless).dropDuplicates(["h"]))

    stars = written(_verified(
        _central(meeting).filter("h <> a").select("a", F.col("h").alias("b")).distinct(), tokens, percent))
    groups = written(components(stars))
    member = _peel(
        _mixed(meeting.join(groups, meeting["h"] == groups["node"], "left").select("sign", "h", F.coalesce("root", "h").alias("g"))), needs)
    able = _open(member, tokens, percent)
    member = written(_rarest(member.join(able.select("h"), "h", "left_semi").select("sign", "h", "g"), needs))
    pairs, links = _meet(member.select(F.col("sign").alias("key"), "h", "g").join(able, "h"), tokens, percent)
    linked = groups.select(F.col("node").alias("a"), F.col("root").alias("b"))
    if links:
        linked = written(reduce(DataFrame.unionByName, links, linked).distinct())
        groups = written(components(linked))
    placed = tokens.select("h").join(groups, tokens["h"] == groups["node"], "left").select("h", F.coalesce("root", "h").alias("g"))
    sizes = placed.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    placed = written(placed.join(sizes, "g").select("h", "g", F.pmod(F.xxhash64("h"), "chunks").cast("int").alias("chunk")))
    met = reduce(DataFrame.unionByName, pairs).distinct()
    for side in ("a", "b"):
        met = met.join(placed.select(F.col("h").alias(side), F.struct("g", "chunk", "h").alias("in_" + side)), side)
    # The query is the one of the greater group.
    queries = written(met.filter("in_a.g <> in_b.g").select(
        F.greatest("in_a", "in_b")["h"].alias("q"), F.least("in_a", "in_b").alias("to")).select(
        "q", "to.g", "to.chunk", F.col("to.h").alias("b")))

    asked = queries.select("g", "chunk").distinct()
    in_groups = placed.join(asked, ["g", "chunk"], "left_semi").join(tokens, "h").select("g", "chunk", "n", "tokens")
    matrix = written(in_groups.groupBy("g", "chunk").applyInPandas(_unite, "g long, chunk int, least long, union binary"))
    rows_at_once(spark)
    admitted = (
        queries.select("q", "g", "chunk").distinct().join(tokens.select(F.col("h").alias("q"), "tokens"), "q").join(matrix, ["g", "chunk"])
        .select("q", "g", "chunk", "tokens", "union", "least").mapInArrow(_bounder(percent), "q long, g long, chunk int"))
    # Of an opened group those are compared that the query met.
    opened = queries.join(written(admitted), ["q", "g", "chunk"]).select(F.col("q").alias("a"), "b").distinct()
    bridges = _verified(opened, tokens, percent)

    whole = written(components(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(bridges)))
    placed = classes.select("h", "rep", "size").join(whole, classes["h"] == whole["node"], "left").select(
        "h", "rep", "size", F.coalesce("root", "h").alias("root"))
    # Only what is linked needs its root's smallest id.
    linked = placed.join(whole.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("rep").alias("least"))
    placed = placed.join(linked, "root", "left").select("h", "size", F.coalesce("least", "rep").alias("component_id"))
    return (
        filled.select("doc_id", F.col("n").alias("n_shingles"), "h").join(placed, "h")
        .select("doc_id", "n_shingles", "component_id", F.col("size").alias("class_size"))
        .unionByName(profiles.filter("h IS NULL").select(
            "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("class_size"))))
