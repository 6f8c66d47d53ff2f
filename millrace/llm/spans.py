"""Where a pattern matches, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTRY = "struct<start:int,end:int,match:string>"
SPAN = f"array<{ENTRY}>"
#: Pieces of a text whose places are summed in one fold.
RUN = 128


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def gaps_and_matches(text: Column, pattern: str) -> Column:
    """``array<struct<gap,match>>``: the text in pieces; the last gap has no match."""
    return F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))


def matches(text: Column, pattern: str, keep=lambda match: F.lit(True)) -> Column:
    """Leftmost non-overlapping matches that ``keep`` accepts, with their place in code points (end exclusive).

    Places are running sums over the pieces.  A fold that grows an array copies it at each step, so
    sums run within runs of ``RUN`` pieces, then over the runs: the time stays in proportion to the text.
    """
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))

    def size(piece: Column) -> Column:
        return F.length(piece["gap"]) + F.coalesce(F.length(piece["match"]), F.lit(0))

    def grow(array: Column, value: Column) -> Column:
        return F.concat(array, F.array(value))

    def place(done: Column, piece: Column) -> Column:
        """One more piece of a run, placed from the start of the run."""
        start = done["at"] + F.length(piece["gap"])
        span = F.struct(start.alias("start"), (done["at"] + size(piece)).alias("end"), piece["match"].alias("match")).cast(ENTRY)
        return F.struct((done["at"] + size(piece)).alias("at"), grow(done["found"], span).alias("found"))

    def moved(run: Column, by: Column) -> Column:
        return F.transform(run, lambda s: F.struct(
            (s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["match"].alias("match")))

    def in_runs(pieces: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found"))
        runs = F.transform(F.sequence(F.lit(1), F.size(pieces), F.lit(RUN)), lambda i: F.aggregate(F.slice(pieces, i, RUN), first, place))
        return let(runs, in_text)

    def in_text(runs: Column) -> Column:
        ends = F.aggregate(runs, F.array(F.lit(0)), lambda ends, run: grow(ends, F.element_at(ends, -1) + run["at"]))
        return let(ends, lambda ends: F.flatten(F.transform(runs, lambda run, i: moved(run["found"], F.get(ends, i)))))

    found = let(pieces, in_runs)
    return F.when(text.rlike(pattern), F.filter(found, lambda s: s["match"].isNotNull() & keep(s["match"]))).otherwise(
        F.array().cast(SPAN))


def replaced(text: Column, spans: Column, mark: str) -> Column:
    """The text with a mark for each of its spans, which are in order and one at least; what overlaps is part of the span before.

    Places in a text are found by counting from its start, so each run of ``RUN`` spans first cuts out its own part.
    """
    starts = F.sequence(F.lit(1), F.size(spans), F.lit(RUN))
    last = lambda run: F.array_max(F.transform(run, lambda s: s["end"]))
    ends = F.aggregate(starts, F.array(F.lit(0)), lambda ends, i: F.concat(
        ends, F.array(F.greatest(F.element_at(ends, -1), last(F.slice(spans, i, RUN))))))
    none = F.array().cast("array<struct<from:int,size:int>>")

    def step(done: Column, s: Column) -> Column:
        """Stretches that stay: from ``at``, where the last span ended, to the start of the next."""
        more = F.concat(done["out"], F.array(F.struct(done["at"].alias("from"), (s["start"] - done["at"]).alias("size"))))
        return F.struct(
            F.greatest(done["at"], s["end"]).alias("at"), F.when(s["start"] >= done["at"], more).otherwise(done["out"]).alias("out"))

    def of_run(ends: Column, i: Column, number: Column) -> Column:
        at, to = F.get(ends, number), F.get(ends, number + 1)
        stay = F.aggregate(F.slice(spans, i, RUN), F.struct(at.alias("at"), none.alias("out")), step, lambda done: done["out"])
        return let(F.substr(text, at + 1, to - at), lambda part: F.array_join(F.transform(
            stay, lambda s: F.concat(F.substr(part, s["from"] - at + 1, s["size"]), F.lit(mark))), ""))

    return let(ends, lambda ends: F.concat(
        F.array_join(F.transform(starts, lambda i, number: of_run(ends, i, number)), ""), F.substr(text, F.element_at(ends, -1) + 1)))
