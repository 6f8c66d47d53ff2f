"""Classes of equal size, to the row: rows repeat as often as the target holds the class, and the rest is drawn.

The rest of a class goes to the rows with the smallest hashes.  No class is sorted: hash prefixes are
counted for each class, and only the prefix in which the cut-off falls is ranked, a 65,536th of a class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seeded
from ..functions.paths import top
from ..session import fits_broadcast, written

PREFIX = 4


def class_quotas(df: DataFrame, label: str, key: str, target: str | int = "largest", seed: int = 42) -> DataFrame:
    """``label, n, whole, rest, cut``: each row of a class is taken ``whole`` times, those up to hash ``cut`` once more."""
    hashed = df.filter(top(label).isNotNull()).select(
        top(label).alias("label"), F.md5(seeded.seed_text(top(key), "balance", seed)).alias("h"))
    counts = written(hashed.groupBy("label", F.substring("h", 1, PREFIX).alias("p")).agg(F.count(F.lit(1)).alias("c")))
    sizes = written(counts.groupBy("label").agg(F.sum("c").alias("n")))
    if target in ("largest", "smallest"):
        target = sizes.agg((F.max if target == "largest" else F.min)("n")).first()[0] or 0
    if isinstance(target, str) or target < 0:
        raise ValueError("target is 'largest', 'smallest' or a number of rows")
    sizes = sizes.select("label", "n", F.floor(F.lit(target) / F.col("n")).alias("whole"), (F.lit(target) % F.col("n")).alias("rest"))
    upto = F.sum("c").over(Window.partitionBy("label").orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edge = counts.withColumn("upto", upto).join(sizes.select("label", "rest"), "label").filter(
        "rest > 0 AND upto >= rest AND upto - c < rest").select("label", "p", (F.col("rest") - F.col("upto") + F.col("c")).alias("need"))
    ranked = hashed.withColumn("p", F.substring("h", 1, PREFIX)).join(edge, ["label", "p"]).withColumn(
        "r", F.row_number().over(Window.partitionBy("label", "p").orderBy("h")))
    return sizes.join(ranked.filter("r = need").select("label", F.col("h").alias("cut")), "label", "left")


def balance(df: DataFrame, label: str, key: str, target: str | int = "largest", seed: int = 42) -> DataFrame:
    """Input plus ``copy_no``: as many rows of every class as the largest (or smallest) has, or as ``target`` says.

    ``key`` is a unique, non-null column.  Larger classes are thinned out, smaller ones repeat, all rows
    as evenly as whole numbers allow.  Rows without a label are in no class and stay once.
    """
    quotas = written(class_quotas(df, label, key, target, seed).select(F.col("label").alias("_label"), "whole", "cut"))
    quotas = quotas.withColumnsRenamed({"whole": "_whole", "cut": "_cut"})
    # One row for each class; many classes are joined, and Spark splits the partitions of a large class.
    side = F.broadcast(quotas) if fits_broadcast(quotas) else quotas
    drawn = F.md5(seeded.seed_text(top(key), "balance", seed)) <= F.col("_cut")
    times = F.when(top(label).isNull(), 1).otherwise(F.col("_whole") + F.coalesce(drawn, F.lit(False)).cast("int")).cast("int")
    joined = df.join(side, top(label) == F.col("_label"), "left").withColumn("_times", times).filter("_times > 0")
    return joined.select(*map(top, df.columns), F.explode(F.sequence(F.lit(0), F.col("_times") - 1)).alias("copy_no"))
