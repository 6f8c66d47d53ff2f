"""Two tokenizers aligned over the same bytes, and how often their tokens meet in a corpus.

A is a byte-level BPE of the ``tokenizers`` library, B a model of ``sentencepiece``; both see a blank and
the text.  Character offsets of A and byte spans of B are coarse cuts: a token whose span is as long as its
own bytes ends there for certain, and between such places, where characters are split over tokens, the
decoded bytes of the tokens are counted.  Places at which tokens of both end part the text into groups, and
a token of A and one of B are linked where their bytes overlap.

Link counts are corpus-wide.  A task works off texts in chunks and tells each distinct pair of a chunk once,
so what is shuffled is far less than the links, and no pair, however common, has more rows than there are
chunks.  A chunk then gets back the counts of its own pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import plain, rows_at_once, single_threaded, written
from .vocabulary import CACHED_CHARS, Remembered, char_of_byte, portions, sign_bytes, units

#: Bytes of text that are worked off as one chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 8 << 20
#: What B writes for a blank, and what stands before a unit so that B adds no blank of its own to it.
MARK, GUARD = "▁", "."

_loaded: dict[tuple[str, str], Aligner] = {}


#: How the tokens of one unit meet: numbers of A tokens, B tokens and groups, the links packed as ``a << 32 | b``, and the groups
#: as text.  A plain tuple: hundreds of thousands are remembered, and Python's collector walks all objects of a class, but no such tuples.
Unit = tuple[int, int, int, bytes, str]


def exact_ends(coarse: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte ends of tokens: their coarse ends where span and bytes agree, counted on by bytes from there elsewhere."""
    counted = np.cumsum(sizes)
    sure = (np.diff(coarse, prepend=0) == sizes) & (coarse == counted)
    if sure.all():
        return coarse
    last = np.maximum.accumulate(np.where(sure, np.arange(len(sizes)), -1))
    from_there = np.where(last < 0, 0, coarse[last]) + counted - np.where(last < 0, 0, counted[last])
    return np.where(sure, coarse, from_there)


class Aligner:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        single_threaded()
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        signs = sign_bytes()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            self.a_bytes[i] = bytes(signs[c] for c in token)
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode()
            for i in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(i)]]
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        #: Units may stand alone only if no piece continues over a word mark or holds a line break.
        self.cuts = not any(MARK in p.lstrip(MARK) or "\n" in p for p in map(self.b.id_to_piece, range(self.b.get_piece_size())))
        self.known = Remembered()  # units and what they came to, a Unit or None
        self.spoilt = False  # whether any unit so far did not match

    def align(self, texts: list[str]) -> list[list[Unit] | None]:
        """The units of each text, a blank put before it; None for empty texts and where bytes do not match."""
        long = []
        cut = [(units(" " + t) if self.cuts else [" " + t]) if t else None for t in texts]
        new = self.known.missing(set().union(*(c for c in cut if c)))
        known = self.known.newer
        for part in portions(new):
            found = self._aligned(part) or [one for u in part for one in self._aligned([u]) or [None]]
            self.spoilt |= None in found
            known.update(zip(part, found))
            long += [u for u in part if len(u) > CACHED_CHARS]
        out = []
        for c in cut:
            found = list(map(known.__getitem__, c)) if c else None
            out.append(None if not found or self.spoilt and any(u is None for u in found) else found)
        for u in long:
            del known[u]
        return out

    def _aligned(self, part: list[str]) -> list[Unit] | None:
        """The units of a joined portion; None if the tokens of it do not spell it."""
        text = "".join(part)
        raw, before = text.encode(), len((MARK + GUARD).replace(MARK, " "))
        a = self.a.encode(text, add_special_tokens=False)
        pieces = [(p.id, p.end) for p in self.b.encode(GUARD + text, return_type="proto", num_threads=1).pieces]
        skip = at = 0
        while at < before:  # the guard's own tokens
            at += len(self.b_bytes[pieces[skip][0]])
            skip += 1
        a_ids, b_ids, b_spans = a.ids, [i for i, _ in pieces[skip:]], [end for _, end in pieces[skip:]]
        if at != before or any(b"".join(map(table.__getitem__, ids)) != raw for table, ids in ((self.a_bytes, a_ids), (self.b_bytes, b_ids))):
            return None
        a_spans = np.array([end for _, end in a.offsets], np.int64)
        if len(raw) != len(text):
            a_spans = np.append(np.flatnonzero(np.diff(char_of_byte(raw), prepend=-1)), len(raw))[a_spans]
        a_ends = exact_ends(a_spans, self.a_sizes[a_ids])
        b_ends = exact_ends(np.array(b_spans, np.int64) - len(GUARD), self.b_sizes[b_ids])
        return _units(a_ids, b_ids, a_ends, b_ends, np.cumsum([len(u.encode()) for u in part]))


def _units(a: list[int], b: list[int], a_ends: np.ndarray, b_ends: np.ndarray, ends: np.ndarray) -> list[Unit]:
    """Both rows of tokens met, and cut at ``ends``, where tokens of both end."""
    # Each stretch between neighbouring ends of either kind is the overlap of exactly one pair of tokens.
    stretches = np.union1d(a_ends, b_ends)
    pairs = (np.array(a, np.int64)[np.searchsorted(a_ends, stretches)] << 32 | np.array(b, np.int64)[np.searchsorted(b_ends, stretches)]).tobytes()
    common = np.intersect1d(a_ends, b_ends, assume_unique=True)
    told, i, j, a_told, b_told = [], 0, 0, list(map(str, a)), list(map(str, b))
    for x, y in zip((np.searchsorted(a_ends, common) + 1).tolist(), (np.searchsorted(b_ends, common) + 1).tolist()):
        told.append(f"{a_told[i]}|{b_told[j]}" if x - i == y - j == 1 else ",".join(a_told[i:x]) + "|" + ",".join(b_told[j:y]))
        i, j = x, y
    cuts = [[0, *(np.searchsorted(side, ends) + 1).tolist()] for side in (a_ends, b_ends, common, stretches)]
    return [
        (a1 - a0, b1 - b0, g1 - g0, pairs[8 * s0:8 * s1], ";".join(told[g0:g1]))
        for (a0, a1), (b0, b1), (g0, g1), (s0, s1) in zip(*map(pairwise, cuts))]


def aligner(a_path: str, b_path: str) -> Aligner:
    """Loaded once for each worker process."""
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Aligner(a_path, b_path)
    return _loaded[a_path, b_path]


def _spelled(found: list[Unit]) -> tuple[list[int], list[int], list[dict[str, int]]]:
    """Ids of both and the ends of groups."""
    a_ids, b_ids, ends = [], [], []
    for group in (g for *_, told in found for g in told.split(";")):
        a, b = ([int(i) for i in side.split(",")] for side in group.split("|"))
        a_ids += a
        b_ids += b
        ends.append({"a": len(a_ids), "b": len(b_ids)})
    return a_ids, b_ids, ends


def align(documents: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, a_ids, b_ids, groups`` of every row; a group is the numbers of A and B tokens up to its end.

    Null and empty texts, and texts whose tokens do not spell a blank and the text (those that hold B's
    mark for a blank), have no tokens.  Ids of documents may be of any type and repeat; further columns are left out.
    """
    rows_at_once(documents.sparkSession)
    docs = plain(documents, doc_id=doc_id, text=text)
    end = pa.struct([("a", pa.int32()), ("b", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a_path, b_path)
        for batch in batches:
            rows = [_spelled(found or []) for found in both.align([t or "" for t in batch.column(1).to_pylist()])]
            columns = [pa.array([r[k] for r in rows], pa.list_(kind)) for k, kind in enumerate((pa.int32(), pa.int32(), end))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "a_ids", "b_ids", "groups"])

    return docs.mapInArrow(run, T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(
        "a_ids array<int>, b_ids array<int>, groups array<struct<a:int,b:int>>").fields]))


#: What is told of a chunk's documents; and ``sizes`` distinct pairs of each, ``index`` into the chunk's pairs and ``times`` in it.
COUNTED = ("n_a", "n_b", "n_groups", "n_links")


def _smallest(values: np.ndarray) -> bytes:
    """Integers in as few bytes as the largest needs, which the first byte tells."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    return bytes([kind.itemsize]) + values.astype(kind).tobytes()


def _integers(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"u{packed[0]}", offset=1).astype(np.int64)


def _chunker(a_path: str, b_path: str, schema: pa.Schema, chunk_bytes: int):
    def chunk(number: int, ids: list, told: list[tuple], pairs: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(p) for p in pairs], np.int64)
        distinct, place = np.unique(np.concatenate(pairs), return_inverse=True)
        keys, times = np.unique(np.repeat(np.arange(len(pairs)), sizes) * max(len(distinct), 1) + place, return_counts=True)
        index = keys % max(len(distinct), 1)
        of_doc = np.bincount(keys // max(len(distinct), 1), minlength=len(pairs))
        row = [number, ids, *map(list, zip(*told)), of_doc.tolist(), _smallest(index), _smallest(times),
               distinct.tolist(), np.bincount(index, minlength=len(distinct)).tolist()]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both, numbers = aligner(a_path, b_path), count(TaskContext.get().partitionId() << 33)
        ids, told, pairs, size = [], [], [], 0
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for key, text, found in zip(batch.column(0).to_pylist(), texts, both.align(texts)):
                n_a, n_b, n_groups, packed, groups = zip(*found) if found else ((), (), (), (), ())
                p = np.frombuffer(b"".join(packed), np.int64)
                told.append((sum(n_a), sum(n_b), sum(n_groups), len(p), hashlib.sha256(";".join(groups).encode()).hexdigest() if found else ""))
                ids.append(key)
                pairs.append(p)
                size += len(text)
                if size >= chunk_bytes:
                    yield chunk(next(numbers), ids, told, pairs)
                    ids, told, pairs, size = [], [], [], 0
        if ids:
            yield chunk(next(numbers), ids, told, pairs)
    return run


def report(documents: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text",
           chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row for every document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A pair's count is how many rows hold it linked; ``n_best`` are the links whose count is the highest that
    their A token has, ties included, and ``count_sum`` adds up the counts of all links.  Rows without
    tokens, see ``align``, have zeros and an empty digest; rows that repeat count each.
    """
    spark = documents.sparkSession
    rows_at_once(spark)
    docs = plain(documents, doc_id=doc_id, text=text)
    key = docs.schema["doc_id"]
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("doc_id", T.ArrayType(key.dataType)), *T._parse_datatype_string(
        ", ".join(f"{c} array<long>" for c in COUNTED) + ", groups_sha256 array<string>, sizes array<int>, index binary, times binary, "
        "pairs array<long>, docs array<int>").fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    chunks = written(docs.mapInArrow(_chunker(a_path, b_path, to_arrow_schema(schema), chunk_bytes), schema))
    told = chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "docs")).alias("at", "p")).select(
        "chunk", "at", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs"))
    counts = written(told.groupBy("pair").agg(F.sum("docs").alias("n")))
    a_id = F.shiftright("pair", 32)
    best = counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("most"))  # one row for each id of A's vocabulary at most
    counts = counts.join(F.broadcast(best), a_id == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    back = told.select("chunk", "at", "pair").join(counts, "pair").select(F.col("chunk").alias("of_chunk"), "at", "n", "best")

    out = T.StructType([key, *T._parse_datatype_string(
        ", ".join(f"{c} long" for c in (*COUNTED, "n_best", "count_sum")) + ", groups_sha256 string").fields])
    arrow = to_arrow_schema(out)

    def add_up(chunk: pa.Table, counted: pa.Table) -> pa.Table:
        row = {c: chunk.column(c)[0] for c in chunk.column_names}
        order = np.argsort(counted.column("at").to_numpy())
        n = counted.column("n").to_numpy()[order]
        best = counted.column("best").to_numpy(zero_copy_only=False)[order]
        index, times = _integers(row["index"].as_py()), _integers(row["times"].as_py())
        of_doc = np.repeat(np.arange(len(row["sizes"])), row["sizes"].values.to_numpy())
        sums = []
        for weight in (times * best[index], times * n[index]) if len(n) else (times, times):
            total = np.zeros(len(row["sizes"]), np.int64)
            np.add.at(total, of_doc, weight)
            sums.append(pa.array(total))
        return pa.Table.from_arrays(
            [row["doc_id"].values, *[row[c].values for c in COUNTED], *sums, row["groups_sha256"].values], schema=arrow)

    narrow = chunks.drop("pairs", "docs")
    return narrow.groupBy("chunk").cogroup(back.groupBy("of_chunk")).applyInArrow(add_up, out)
