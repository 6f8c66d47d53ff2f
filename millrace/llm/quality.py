"""Quality rules: a hashed n-gram log-likelihood ratio of trusted text against the raw corpus.

Words and word pairs are hashed into buckets; one multinomial is counted over trusted documents, one
over all.  The score of a document is the mean log ratio over its n-grams, so length does not matter.
The threshold that decides on every document is a low quantile of what trusted documents score when
they are held out: each is scored by the trusted documents of the other half.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank, plain, written
from .spans import let

BUCKETS = 1 << 16
#: Share of the trusted documents that may score below the threshold, and the steps to the unit it is told in.
SHARE = 0.001
STEPS = 1000
#: Bits of the filter that keeps texts from travelling; 8 MB.
FILTER_BITS = 1 << 26
#: Occurrences added to every bucket of either multinomial.
SMOOTHING = 1.0
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(blank(text), SPACE), "")


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(gram, F.lit(buckets)).cast("int")


def _grams(w: Column, hashes: Column, buckets: int) -> Column:
    """Buckets of the words, whose hashes are given, and of the pairs of neighbours."""
    most = F.greatest(F.size(w) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(w, 1, most), F.slice(w, 2, most), lambda a, b: _bucket(F.xxhash64(a, b), buckets))
    return F.concat(F.transform(hashes, lambda h: _bucket(h, buckets)), pairs)


def _gram_rows(documents: DataFrame, text: str, buckets: int) -> DataFrame:
    """The other columns of ``documents`` and ``b``: a row for each word and each pair of neighbours.

    The same grams as ``_grams``, hashed in rows of words and not in arrays, where Spark compiles no hash.
    """
    others = [c for c in documents.columns if c != text]
    ahead = documents.select(*others, words(F.col(text)).alias("w")).select(
        *others, F.explode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))).alias("b"))).alias("p"))
    word, pair = F.xxhash64("p.a"), F.when(F.col("p.b").isNotNull(), F.xxhash64("p.a", "p.b"))
    return ahead.select(*others, F.explode(F.array(word, pair)).alias("gram")).filter("gram IS NOT NULL").select(
        *others, _bucket(F.col("gram"), buckets).alias("b"))


def _repeated(w: Column, window: int = 5) -> Column:
    """Words, told by their hashes, inside windows that occur twice or more in the text."""
    hashes = F.transform(F.slice(w, 1, F.size(w) - window + 1), lambda h, i: F.xxhash64(h, *[F.get(w, i + k) for k in range(1, window)]))
    return F.when(F.size(w) < window, 0).otherwise(let(hashes, lambda h: _covered(h, window)))


def _covered(h: Column, window: int) -> Column:
    """Places inside the windows whose hash another window has too.

    Numbers sort far faster than structs, so the last bits of a hash give way to its place and neighbours in that order are
    held against each other.  Only if two of them have the same first bits and are not equal, whole hashes are sorted.
    """
    def pairs(s: Column, last: Column) -> Column:
        return F.filter(
            F.transform(s, lambda x, k: F.when(x.bitwiseXOR(F.get(s, k + 1)).between(F.lit(0), last), F.struct(
                x.bitwiseAND(last).alias("i"), F.get(s, k + 1).bitwiseAND(last).alias("j")))),
            lambda p: p.isNotNull())

    def sorted_whole(s: Column) -> Column:
        return F.filter(F.transform(s, lambda x, k: F.when(
            (k > 0) & (F.get(s, F.greatest(k - 1, F.lit(0)))["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])),
            lambda p: p.isNotNull())

    def places(p: Column) -> Column:
        equal = F.forall(p, lambda x: F.get(h, x["i"].cast("int")) == F.get(h, x["j"].cast("int")))
        whole = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i"))))
        return F.sort_array(F.when(equal, F.array_distinct(F.concat(p["i"], p["j"]))).otherwise(let(whole, sorted_whole)))

    def summed(p: Column) -> Column:
        return F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window)).cast("int"))),
            F.lit(0), lambda a, x: a + x)

    def count(last: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: x - x.bitwiseAND(last) + i))
        return let(ordered, lambda s: let(pairs(s, last), lambda p: let(places(p), summed)))

    last_bits = F.pow(F.lit(2), F.length(F.bin(F.size(h)))).cast("long") - 1
    return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(last_bits, count))


def _half(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(2)).cast("int")


def _trusted_ids(trusted: DataFrame) -> DataFrame:
    return trusted.select(trusted[trusted.columns[0]].alias("id")).filter("id IS NOT NULL").distinct()


def _maybe_trusted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Adds ``maybe``: false only for ids that are surely not among ``ids``.

    A Bloom filter of ``FILTER_BITS`` bits, made by Spark's bitmap aggregate: 4 KB for each of a fixed number of
    places, so its size has a bound whatever the tables hold.
    """
    spot = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).cast("long")
    bits = ids.select(spot.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("place")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits"))
    marked = docs.withColumn("spot", spot).withColumn("place", F.bitmap_bucket_number("spot")).join(F.broadcast(bits), "place", "left")
    at = F.bitmap_bit_position("spot")
    byte = F.conv(F.hex(F.substr(F.col("bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.pmod(F.floor(byte / F.pow(F.lit(2), at % 8)), F.lit(2)) == 1
    return marked.select("id", "text", F.coalesce(hit, F.lit(False)).alias("maybe"))


def _gram_counts(documents: DataFrame, trusted: DataFrame, doc_id: str, text: str, buckets: int) -> list[list[int]]:
    """Occurrences by bucket in either half of the trusted documents and in all others.

    Only texts that may be trusted are shuffled to their ids, at every size by the same merge join; all
    others are counted where they are read.
    """
    ids = _trusted_ids(trusted).withColumn("half", _half(F.col("id")))
    docs = _maybe_trusted(plain(documents, id=doc_id, text=text), ids)
    asked = docs.filter("maybe").select("id", "text").join(ids.hint("merge"), "id", "left")
    parted = asked.select(F.coalesce("half", F.lit(2)).alias("part"), "text").unionByName(
        docs.filter("NOT maybe").select(F.lit(2).alias("part"), "text"))
    counts = [[0] * buckets for _ in range(3)]
    for r in _gram_rows(parted, "text", buckets).groupBy("part", "b").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["part"]][r["b"]] = r["n"]
    return counts


def _log_ratios(good: list[int], raw: list[int], smoothing: float) -> list[float]:
    share = lambda counts: [math.log((c + smoothing) / (sum_ + smoothing * len(counts))) for sum_ in [sum(counts)] for c in counts]
    return [round(g - r, 6) for g, r in zip(share(good), share(raw))]


def _weights(counts: list[list[int]], smoothing: float) -> list[list[float]]:
    """Log ratios by all trusted documents, by their first half and by their second half."""
    raw = [sum(c) for c in zip(*counts)]
    return [_log_ratios(good, raw, smoothing) for good in ([a + b for a, b in zip(*counts[:2])], counts[0], counts[1])]


def gram_weights(documents: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> list[float]:
    """Log ratio of each bucket, counted over every document; ``trusted`` is a frame of ids, repeats allowed.

    The driver gets three numbers at most for each bucket.  Without trusted text all weights are what
    smoothing leaves, which ranks documents by how usual they are.
    """
    return _weights(_gram_counts(documents, trusted, doc_id, text, buckets), smoothing)[0]


def _measured(documents: DataFrame, weights: list[float], doc_id: str, text: str, halves: list[list[float]] | None = None,
              trusted: DataFrame | None = None) -> DataFrame:
    """Counts, base verdict and score of every row, and ``held_out``, its score by the half that it is not in.

    With ``trusted`` ids, rows that are surely not among them have no ``held_out``.
    """
    table = lambda w: F.split(F.lit(",".join(map(str, w))), ",").cast("array<double>")
    t = blank(F.col("text"))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def mean(g: Column, weights: list[float]) -> Column:
        return F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(table(weights), b), lambda a: a / F.greatest(F.size(g), F.lit(1)))

    def scores(g: Column) -> Column:
        out = F.lit(None).cast("double") if halves is None else F.when(
            _half(F.col("id")) == 0, F.when(F.col("maybe"), mean(g, halves[1]))).otherwise(F.when(F.col("maybe"), mean(g, halves[0])))
        return F.struct(mean(g, weights).alias("score"), out.alias("held_out"))

    def measure(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.struct(
                _repeated(h).cast("long").alias("n_repeat_words"), let(_grams(w, h, len(weights)), scores).alias("s"))).alias("h"))

    docs = plain(documents, id=doc_id, text=text)
    docs = docs.withColumn("maybe", F.lit(True)) if trusted is None else _maybe_trusted(docs, _trusted_ids(trusted))
    return docs.select(
        F.col("id").alias("doc_id"), let(words(F.col("text")), measure).alias("m"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select(
        "doc_id", "m.n_words", "m.word_chars", "n_symbols", "n_dup_lines", "m.h.n_repeat_words",
        ((F.col("m.n_words") < 10) | (100 * F.col("m.h.n_repeat_words") > 20 * F.col("m.n_words"))).alias("base_failed"),
        F.col("m.h.s.score").alias("score"), F.col("m.h.s.held_out").alias("held_out"))


def judge(documents: DataFrame, weights: list[float], doc_id: str = "doc_id", text: str = "text",
          threshold: float = -math.inf) -> DataFrame:
    """Counts, base verdict, score and verdict of every row, from its own text alone.

    Null text has no words and fails the base rule; a text without n-grams scores 0.  Without a
    threshold the base rule alone decides.
    """
    return _measured(documents, weights, doc_id, text).drop("held_out").withColumn(
        "kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def _threshold(measured: DataFrame, trusted: DataFrame, share: float) -> float:
    """Score that at most ``share`` of the trusted documents within the base rule stay below when held out.

    The driver gets one count for each step of the score.  Without trusted documents nothing is below.
    """
    ids = _trusted_ids(trusted)
    steps = measured.filter("NOT base_failed").join(ids, measured["doc_id"] == ids["id"], "left_semi").groupBy(
        F.floor(F.col("held_out") * STEPS).alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
    below = int(share * sum(r["n"] for r in steps))
    for r in sorted(steps, key=lambda r: r["step"]):
        below -= r["n"]
        if below < 0:
            return r["step"] / STEPS
    return -math.inf


def select(documents: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text",
           buckets: int = BUCKETS, smoothing: float = SMOOTHING, share: float = SHARE) -> DataFrame:
    """``judge`` by the weights and the threshold that the trusted documents, a frame of ids, give."""
    weights, *halves = _weights(_gram_counts(documents, trusted, doc_id, text, buckets), smoothing)
    measured = written(_measured(documents, weights, doc_id, text, halves, trusted))
    return measured.drop("held_out").withColumn(
        "kept", ~F.col("base_failed") & (F.col("score") >= _threshold(measured, trusted, share)))
