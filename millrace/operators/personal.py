"""Personal data inside values: one leftmost scan for several kinds, then a check of what was found.

Patterns say what a value may look like; checksums, ranges and neighbours decide.  A candidate that fails
is passed over as a whole.  Places are counted in code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import types as ty
from ..functions.arrays import pieces, running_sum
from ..functions.paths import top

#: Candidates by kind; at one place the first that fits.  No lookaround, so that other engines can check.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]*[A-Za-z]",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "credit_card": r"3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}|[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "ip": r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}",
    "phone": r"[+][0-9]{1,3}[ .-]?[(]?[0-9]{1,4}[)]?(?:[ .-]?[0-9]{2,4}){1,4}|[(][0-9]{3}[)] ?[0-9]{3}-[0-9]{4}|[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: The same for Spark, where a run of signs that no @ follows must not be tried from each of its signs.
SCAN = r"(?:(?<![A-Za-z0-9._%+-])" + ANY.removeprefix("(?:")
#: Cheap test that every kind passes.
HINT = r"[@0-9]"


def digits_of(value: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(value, r"[^0-9]", ""), ""), lambda c: c.cast("int"))


def luhn(value: Column) -> Column:
    """Whether the digits, every second one from the right doubled, add up to a multiple of ten."""
    def total(d: Column) -> Column:
        doubled = F.transform(d, lambda x, i: F.when((F.size(d) - i) % 2 == 0, 2 * x - F.when(x > 4, 9).otherwise(0)).otherwise(x))
        return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)

    return tx.once(digits_of(value), total) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number, its first four characters moved to the end, leaves 1."""
    flat = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(flat, F.lit(5)), F.substring(flat, 1, 4))
    rest = F.aggregate(F.regexp_extract_all(turned, F.lit("(.)"), F.lit(1)), F.lit(0), lambda a, c: F.when(
        c.rlike("[0-9]"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))
    return rest == 1


def is_valid(kind: Column, value: Column) -> Column:
    """The check of each kind; the value has its pattern's form."""
    size = F.length(F.regexp_replace(value, r"[^0-9]", ""))
    return (
        F.when(kind == "email", value.rlike(r"[.][A-Za-z]{2,}$") & ~value.rlike(r"[.][.]|^[.]|[.]@|@[.-]"))
        .when(kind == "iban", F.length(F.replace(value, F.lit(" "), F.lit(""))).between(15, 34) & mod97(value))
        .when(kind == "credit_card", size.between(13, 19) & luhn(value))
        .when(kind == "ssn", ~value.rlike(r"^(?:000|666|9)|-00-|-0000$"))
        .when(kind == "ip", F.forall(F.split(value, "[.]"), lambda p: p.cast("int") <= 255))
        .otherwise(size.between(8, 15)))


def _kind(value: Column) -> Column:
    found = F
    for kind, pattern in PATTERNS.items():
        found = found.when(value.rlike(rf"^(?:{pattern})$"), F.lit(kind))
    return found


def personal_spans(text: Column) -> Column:
    """``array<struct<kind,start,end,value>>`` of one text, in order; empty for null."""
    def candidates(p: Column) -> Column:
        ends = running_sum(F.transform(p, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["match"]), F.lit(0))))
        return tx.once(ends, lambda e: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x, i: F.struct(
            _kind(x["match"]).alias("kind"), (F.get(e, i) - F.length(x["match"])).cast("int").alias("start"), F.get(e, i).cast("int").alias("end"),
            x["match"].alias("value"),
            # A letter or digit next to a value makes it part of something else.
            (F.when(x["gap"] == "", i == 0).otherwise(~F.right(x["gap"], F.lit(1)).rlike("[A-Za-z0-9]"))
             & F.when(F.get(p, i + 1)["gap"] == "", i + 2 == F.size(p)).otherwise(~F.left(F.get(p, i + 1)["gap"], F.lit(1)).rlike("[A-Za-z0-9]"))
             ).alias("alone"))))

    kept = F.filter(tx.once(pieces(text, SCAN), candidates), lambda c: c["alone"] & is_valid(c["kind"], c["value"]))
    spans = F.transform(kept, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["value"].alias("value")))
    return F.when(text.rlike(HINT) & text.rlike(SCAN), spans).otherwise(
        F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>"))


def detect_personal(df: DataFrame, fields: Sequence[str], key: str) -> DataFrame:
    """``key, field, kind, start, end, value``: one row for each place, from one scan."""
    found = F.array(*[F.struct(F.lit(f).alias("field"), personal_spans(ty.as_text(top(f), df.schema[f].dataType)).alias("spans")) for f in fields])
    return df.select(top(key), F.explode(found).alias("f")).select(top(key), "f.field", F.explode("f.spans").alias("s")).select(
        top(key), "field", "s.kind", "s.start", "s.end", "s.value")


def personal_report(df: DataFrame, fields: Sequence[str], key: str) -> DataFrame:
    """``field, kind, places, records``."""
    by_record = detect_personal(df, fields, key).groupBy(top(key), "field", "kind").agg(F.count(F.lit(1)).alias("n"))
    return by_record.groupBy("field", "kind").agg(F.sum("n").alias("places"), F.count(F.lit(1)).alias("records"))
