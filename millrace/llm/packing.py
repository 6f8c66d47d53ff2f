"""Token sequences of one length, packed after a plan that non-negative least squares solves.

Documents become token ids and an end mark.  Full windows of a long document are sequences of their
own; what is left of it, its tail, belongs to one of 256 length classes.  The plan looks at the
histogram of classes alone: all combinations of at most three classes that fill a window exactly are
columns, their repeat counts are solved by non-negative least squares against the histogram, and
rounded down to what is there.  Tails beyond the plan are laid end to end, greedily, and cut where a
window is full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import plain, rows_at_once, single_threaded, written

LENGTH = 4096
CLASSES = 256
#: Words whose ids a Python worker remembers; at this many it starts afresh.
CACHE_WORDS = 600_000
#: A-Z to a-z, for texts without special tokens: the tokenizer lower-cases anyway.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_memory: dict[str, dict[str, bytes]] = {}


def _tokens(texts: list[str], path: str, width: str) -> list[bytes]:
    """Ids of every text as packed integers.

    White space ends a piece in these tokenizers, and so does the step from a letter to a
    punctuation mark, so texts are encoded by words that are looked up when seen before.
    """
    import re

    from tokenizers import Tokenizer

    single_threaded()
    if path not in _memory:
        _memory.clear()
        _memory[path] = {}
        _memory[f"{path} tokenizer"] = Tokenizer.from_file(path)
    known, tokenizer = _memory[path], _memory[f"{path} tokenizer"]
    if len(known) > CACHE_WORDS:
        known.clear()
    parted = [
        None if "<|" in t else
        re.sub(r"(?<=[a-z])[.,#%&*$!?;:]", r" \g<0>", t.encode().translate(LOWER).decode()).replace("\n", " ").split(" ")
        for t in texts]
    new = list(set().union(*(p for p in parted if p)).difference(known))
    for i in range(0, len(new), 20_000):
        part = new[i:i + 20_000]
        encoded = tokenizer.encode(" ".join(part), add_special_tokens=False)
        ids = np.array(encoded.ids, width)
        starts = np.array([o[0] for o in encoded.offsets], np.int64)
        bounds = np.cumsum([0] + [len(w) + 1 for w in part])
        cuts = np.searchsorted(starts, bounds)
        known.update((w, ids[a:b].tobytes()) for w, a, b in zip(part, cuts[:-1], cuts[1:]))
    return [
        np.array(tokenizer.encode(t, add_special_tokens=False).ids, width).tobytes() if p is None
        else b"".join(map(known.__getitem__, p)) for t, p in zip(texts, parted)]


TOKENS_DDL = "part int, place long, doc_id long, n long, class int, rank long, before long, full long, ids binary"
TOKENS = pa.schema([
    ("part", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("class", pa.int32()),
    ("rank", pa.int64()), ("before", pa.int64()), ("full", pa.int64()), ("ids", pa.binary())])


def _tokenizer(path: str, width: str, end_id: int, length: int):
    """Tokenize, and count along each class within the task: tails, their tokens, full windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, place, windows = TaskContext.get().partitionId(), 0, 0
        ranks, totals = np.zeros(CLASSES + 1, np.int64), np.zeros(CLASSES + 1, np.int64)
        end = np.array([end_id], width).tobytes()
        for batch in batches:
            rows = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), _tokens(texts, path, width)):
                ids += end
                n = len(ids) // len(end)
                full, tail = divmod(n, length)
                kind = -(-tail * CLASSES // length)
                rows.append((part, place, doc, n, kind, int(ranks[kind]), int(totals[kind]), windows, ids))
                ranks[kind] += 1
                totals[kind] += tail
                windows += full
                place += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), TOKENS)] if rows else
                [pa.array([], f.type) for f in TOKENS], schema=TOKENS)
    return run


def combinations(classes: int = CLASSES) -> np.ndarray:
    """All ways to fill ``classes`` with one, two or three lengths; 0 stands for no length."""
    a, b = (x.ravel() for x in np.mgrid[0:classes + 1, 0:classes + 1])
    c = classes - a - b
    return np.stack([a, b, c], 1)[(a <= b) & (b <= c)]


def solve(histogram: np.ndarray, columns: np.ndarray, rounds: int = 3000) -> np.ndarray:
    """Non-negative least squares: repeat counts of the columns that come closest to the histogram.

    Accelerated projected gradient; the matrix is sparse, three ones a column at most, and is never built.
    """
    target = histogram.astype(float)
    size = len(target)

    def apply(x: np.ndarray) -> np.ndarray:
        y = np.bincount(columns.ravel(), np.repeat(x, columns.shape[1]), size)
        y[0] = 0
        return y

    def back(y: np.ndarray) -> np.ndarray:
        y = y.copy()
        y[0] = 0
        return y[columns].sum(1)

    v = np.ones(len(columns))
    for _ in range(30):  # the largest eigenvalue sets the step
        v = back(apply(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = z = np.zeros(len(columns))
    t = 1.0
    for _ in range(rounds):
        nearer = np.maximum(z - back(apply(z) - target) / (1.01 * norm), 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = nearer + (t - 1) / s * (nearer - x)
        x, t = nearer, s
    return x


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Combinations with the repeats that the histogram really holds."""
    columns = combinations(len(histogram) - 1)
    x = np.floor(solve(histogram, columns) + 1e-6).astype(np.int64)
    left, chosen = histogram.astype(np.int64).copy(), []
    for i in np.argsort(-x, kind="stable"):
        kinds = tuple(int(k) for k in columns[i] if k)
        need = np.bincount(kinds, minlength=len(left))
        times = min([int(x[i]), *(int(left[k] // need[k]) for k in kinds)])
        if times > 0:
            left -= need * times
            chosen.append((kinds, times))
    return chosen


PIECES_DDL = "part int, place long, start long, length long, sequence_id long, offset long, slot int"


def _assigner(ranges: dict[int, np.ndarray], used: np.ndarray, base: np.ndarray, at_used: np.ndarray,
              windows: int, planned: int, length: int):
    """Turn global ranks into pieces; combinations get their offset later (-1), when the lengths meet."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for part, place, n, kind, rank, cum, full in f[["part", "place", "n", "class", "rank", "before", "full"]].itertuples(index=False):
                whole, tail = divmod(n, length)
                out += [(part, place, k * length, length, full + k, 0, 0) for k in range(whole)]
                start = whole * length
                if not tail:
                    continue
                if rank < used[kind]:
                    table = ranges[kind]  # rows: first rank, first sequence, pieces of this class in each, first slot
                    first, sequence, times, slot = table[np.searchsorted(table[:, 0], rank, "right") - 1]
                    k, j = divmod(rank - first, times)
                    out.append((part, place, start, tail, windows + sequence + k, -1, slot + j))
                    continue
                at = base[kind] + cum - at_used[kind]
                while tail:
                    k, offset = divmod(at, length)
                    size = min(tail, length - offset)
                    out.append((part, place, start, size, windows + planned + k, offset, 0))
                    at, start, tail = at + size, start + size, tail - size
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PIECES_DDL.split(", ")])
    return run


def _cutter(width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.dtype(width).itemsize
        for batch in batches:
            cut = [np.frombuffer(i, width, n, s * size).astype("<u4").tobytes() for i, s, n in zip(
                batch.column("ids").to_pylist(), batch.column("start").to_pylist(), batch.column("length").to_pylist())]
            crc = pa.array([zlib.crc32(c) for c in cut], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "start", "length")), crc,
                 *(batch.column(c) for c in ("n", "sequence_id", "offset")), pa.array(cut, pa.binary())],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])
    return run


def pack(
    documents: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 2,
    length: int = LENGTH,
) -> DataFrame:
    """One row per piece: where it comes from, where it goes, its ids (little-endian, 32 bits) and their crc32.

    ``tokenizer`` is the path of a tokenizer file that every executor has.  A null or empty text is
    the end mark alone.  Every id of every document lies in exactly one piece; repeated rows and null
    ids are documents like others; an empty table gives no pieces.

    The driver sees the histogram (257 numbers) and the plan.  A class may hold any share of the
    documents: ranks within it come from counts of each task, not from a window over its rows.
    """
    from tokenizers import Tokenizer

    spark = documents.sparkSession
    width = "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"
    rows_at_once(spark)
    tokens = written(plain(documents, doc_id=doc_id, text=text).mapInArrow(
        _tokenizer(tokenizer, width, end_id, length), TOKENS_DDL))
    tail = F.col("n") % length
    counts = tokens.groupBy("part", "class").agg(F.count(F.lit(1)).alias("c"), F.sum(tail).alias("s"))
    earlier = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(counts.select(
        "part", "class", "c", "s", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c0"),
        F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("s0")))
    per_part = tokens.groupBy("part").agg(F.sum((F.col("n") - tail) / length).cast("long").alias("w"))
    # One row for each task of the tokenizing stage.
    window_starts = per_part.select("part", F.coalesce(F.sum("w").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("w0"))
    windows = per_part.agg(F.sum("w")).first()[0] or 0
    histogram, tokens_in = np.zeros(CLASSES + 1, np.int64), np.zeros(CLASSES + 1, np.int64)
    for r in starts.groupBy("class").agg(F.sum("c").alias("c"), F.sum("s").alias("s")).collect():
        histogram[r["class"]], tokens_in[r["class"]] = r["c"], r["s"]
    histogram[0] = 0
    chosen = plan(histogram)

    ranges: dict[int, list[tuple[int, int, int, int]]] = {}
    used, planned = np.zeros(CLASSES + 1, np.int64), 0
    for kinds, times in chosen:
        for kind in sorted(set(kinds)):
            ranges.setdefault(kind, []).append((int(used[kind]), planned, kinds.count(kind), kinds.index(kind)))
            used[kind] += times * kinds.count(kind)
        planned += times

    ranked = (
        tokens.select("part", "place", "doc_id", "n", "class", "rank", "before", "full")
        .join(starts.select("part", "class", "c0", "s0"), ["part", "class"]).join(window_starts, "part")
        .select("part", "place", "n", "class", (F.col("rank") + F.col("c0")).alias("rank"),
                (F.col("before") + F.col("s0")).alias("before"), (F.col("full") + F.col("w0")).alias("full")))
    first_left = F.get(F.split(F.lit(",".join(map(str, used))), ",").cast("array<bigint>"), F.col("class"))
    at_used = tokens_in.copy()  # tokens of a class in front of its first tail beyond the plan
    for r in ranked.filter((F.col("rank") == first_left) & (F.col("class") > 0)).select("class", "before").collect():
        at_used[r["class"]] = r["before"]
    left = tokens_in - at_used
    left[0] = 0
    base = np.cumsum(left) - left
    pieces = ranked.mapInPandas(
        _assigner({k: np.array(v) for k, v in ranges.items()}, used, base, at_used, windows, planned, length), PIECES_DDL)
    pieces = written(pieces)
    in_order = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    combined = pieces.filter("offset < 0").withColumn("offset", F.coalesce(F.sum("length").over(in_order), F.lit(0)))
    placed = pieces.filter("offset >= 0").unionByName(combined).drop("slot")
    rows_at_once(spark)
    return placed.join(tokens.select("part", "place", "doc_id", "n", "ids"), ["part", "place"]).select(
        "doc_id", "start", "length", "n", "sequence_id", "offset", "ids").mapInArrow(
        _cutter(width), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
                        "offset long, ids binary")
