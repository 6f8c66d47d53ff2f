"""Near-duplicate records: MinHash bands find candidates, shingle sets decide.

Records with equal sets of word shingles are one class, whatever its size.  Eight bands of three minima
each send a class to buckets; in a small bucket all pairs are candidates, in a large one each class meets
the bucket's centre, and those unlike the centre are dealt once more by further minima.  Candidates are
then compared exactly, so nothing is called a near-duplicate that is none; two records at 0.8 meet with a
chance of 0.996, more similar ones almost surely.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import types as ty
from ..functions.paths import top
from ..session import written
from .components import components

BANDS, ROWS = 8, 3
#: Minima that deal the rest of a large bucket anew.
FURTHER = 3
#: Classes in a bucket up to which all of them meet.
SMALL = 16


def shingle_set(text: Column, words: int) -> Column:
    """Sorted distinct 64-bit hashes of ``words`` words in a row, in lower case; fewer words make one, none makes none."""
    def hashes(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - words + 1, F.lit(1)))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(
            F.array_sort(F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, words))))))

    return tx.once(tx.tokens(F.lower(text)), hashes)


def _candidates(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a, b`` of classes in small buckets, and ``bucket, a, b`` of the centre ``a`` of each large one."""
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("id", "n")).alias("centre"))
    small = members.join(sizes.filter(F.col("c").between(2, SMALL)).select("bucket"), "bucket")
    other = small.select("bucket", F.col("id").alias("b"), F.col("n").alias("n_b"))
    near = small.join(other, "bucket").filter("id < b").select(F.col("id").alias("a"), "b", F.col("n").alias("n_a"), "n_b")
    stars = members.join(sizes.filter(F.col("c") > SMALL), "bucket").filter("id <> centre.id").select(
        "bucket", F.col("centre.id").alias("a"), F.col("id").alias("b"), F.col("centre.n").alias("n_a"), F.col("n").alias("n_b"))
    return near, stars


def near_duplicate_links(sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: classes within the similarity that met.  ``sets``: ``id, n, hashes``, one row for each class or more."""
    minima = [F.min(F.xxhash64("h", F.lit(k))).alias(f"m{k}") for k in range(BANDS * ROWS + FURTHER)]
    signed = written(sets.select("id", "n", F.explode("hashes").alias("h")).groupBy("id").agg(F.max("n").alias("n"), *minima))
    band = lambda i: F.xxhash64(F.lit(i), *[F.col(f"m{ROWS * i + r}") for r in range(ROWS)])
    further = [f"m{BANDS * ROWS + k}" for k in range(FURTHER)]
    members = written(signed.select("id", "n", *further, F.explode(F.array(*map(band, range(BANDS)))).alias("bucket")))
    links = None
    for last in (False, True):
        near, stars = _candidates(members)
        pairs = written(near.unionByName(stars.drop("bucket")).distinct().filter(
            100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b"))
        found = written(_verified(pairs, sets, percent))
        links = found if links is None else links.unionByName(found)
        if last:
            return links.distinct()
        unlike = stars.select("bucket", "a", "b").join(found, ["a", "b"], "left_anti").select("bucket", F.col("b").alias("id"))
        deal = F.explode(F.array(*[F.xxhash64("bucket", F.lit(k), c) for k, c in enumerate(further)]))
        members = written(unlike.join(members, ["bucket", "id"]).select("id", "n", *further, deal.alias("bucket")))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    needed = written(sets.join(wanted, "id", "left_semi").dropDuplicates(["id"]))
    x = needed.select(F.col("id").alias("a"), F.col("hashes").alias("x"))
    y = needed.select(F.col("id").alias("b"), F.col("hashes").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return pairs.join(x, "a").join(y, "b").withColumn("shared", shared).filter(
        100 * F.col("shared") >= percent * (F.size("x") + F.size("y") - F.col("shared"))).select("a", "b")


def near_duplicates(df: DataFrame, fields: Sequence[str], key: str, words: int = 5, percent: int = 80) -> DataFrame:
    """``key, representative, is_near_duplicate`` of every row.

    ``key`` is a unique, non-null column.  Records are compared by the words of ``fields``; those whose
    shingle sets overlap by ``percent`` of their union are linked, links are transitive, and the
    representative is the smallest key that links lead to.  Records without words are their own.
    """
    text = F.concat_ws(" ", *[ty.as_text(top(f), df.schema[f].dataType) for f in fields])
    hashed = df.select(top(key).alias("key"), shingle_set(text, words).alias("hashes"))
    digest = F.concat(F.hex(F.xxhash64("hashes")), F.lit("-"), F.hex(F.xxhash64(F.lit(words), F.col("hashes"))))
    rows = written(hashed.select("key", F.size("hashes").alias("n"), "hashes", F.when(F.size("hashes") > 0, digest).alias("id")))
    filled = rows.filter("n > 0")
    classes = written(filled.groupBy("id").agg(F.min("key").alias("first_key")))
    # One row of each class has its set; copies, however many, stop here.
    first = classes.select(F.col("id").alias("class_id"), "first_key")
    sets = written(filled.join(first, (filled["key"] == first["first_key"]) & (filled["id"] == first["class_id"])).select("id", "n", "hashes"))
    roots = components(near_duplicate_links(sets, percent))
    placed = classes.join(roots, classes["id"] == roots["node"], "left").select("id", "first_key", F.coalesce("root", "id").alias("root"))
    least = placed.groupBy("root").agg(F.min("first_key").alias("representative"))
    placed = placed.join(least, "root").select("id", "representative")
    representative = F.coalesce("representative", "key")
    return rows.select("key", "id").join(placed, "id", "left").select(
        F.col("key").alias(key), representative.alias("representative"), (representative != F.col("key")).alias("is_near_duplicate"))


def drop_near_duplicates(df: DataFrame, fields: Sequence[str], key: str, words: int = 5, percent: int = 80) -> DataFrame:
    """The representative of each group, with all its columns."""
    copies = near_duplicates(df, fields, key, words, percent).filter("is_near_duplicate").select(top(key))
    return df.join(copies, key, "left_anti").select(*map(top, df.columns))
