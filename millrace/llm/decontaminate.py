"""Benchmark passages in documents, found with one Aho-Corasick automaton.

Texts are lower-cased (A-Z) and cut into words of ASCII letters, digits and everything beyond ASCII.
A pattern is 13 consecutive words of a benchmark item, or a whole item that is shorter.  A word is
written as its number in two letters, so that no node has very many followers, which the automaton
looks through one by one.  The words of a document run through it once; every occurrence gives back the
words, and by them the place in the original text, that it covers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain, rows_at_once, unused, written

WINDOW = 13
#: Bytes of benchmark text that one automaton takes, about 100 MB of a Python worker.  A larger benchmark is
#: scanned in several blocks.
BLOCK_BYTES = 1 << 20
#: First letters of a word; a second letter is above them.
LETTERS = 128
#: A word that no item has.
UNKNOWN = "\0\0"
#: Fixed by the contract: A-Z become a-z, letters, digits and bytes beyond ASCII stay, the rest parts words.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(FOLD).split()


class Windows:
    """Aho-Corasick over the words of every window of the items, and the ids of the items that hold each.

    An item without text or words has no window.  Without an id it still marks words, but is not listed.
    """

    def __init__(self, items: Iterable[tuple[str | None, str | None]], window: int = WINDOW) -> None:
        import ahocorasick

        self.codes: dict[bytes, str] = {}
        self.lengths: list[int] = []
        self.holders: list[tuple[str, ...] | set[str]] = []
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for item, text in items:
            w = [self._code(x) for x in words(text or "")]
            alone = () if item is None else (item,)
            for i in range(max(len(w) - window, 0) + 1 if w else 0):
                self._add(w[i:i + window], alone)
        if self.lengths:
            self.machine.make_automaton()

    def _code(self, word: bytes) -> str:
        if word not in self.codes:
            n = len(self.codes)
            self.codes[word] = chr(1 + n % LETTERS) + chr(1 + LETTERS + n // LETTERS)
        return self.codes[word]

    def _add(self, pattern: list[str], holder: tuple[str, ...]) -> None:
        line = "".join(pattern)
        known = self.machine.get(line, -1)
        if known < 0:
            self.machine.add_word(line, len(self.lengths))
            self.lengths.append(len(pattern))
            self.holders.append(holder)
        elif holder:
            if isinstance(self.holders[known], tuple):
                self.holders[known] = set(self.holders[known])
            self.holders[known].update(holder)

    def scan(self, text: str) -> tuple[int, np.ndarray, set[str]]:
        """Number of words, which of them are hit, and the items found."""
        w = words(text)
        found = list(self.machine.iter("".join(map(self.codes.get, w, repeat(UNKNOWN))))) if w and self.lengths else []
        if not found:
            return len(w), np.zeros(len(w), bool), set()
        edges = np.zeros(len(w) + 1, np.int32)
        for end, pattern in found:
            edges[end // 2 - self.lengths[pattern] + 1] += 1
            edges[end // 2 + 1] -= 1
        return len(w), np.cumsum(edges[:-1]) > 0, {i for p in {p for _, p in found} for i in self.holders[p]}


_built: dict[bytes, Windows] = {}


def windows_of(block: list[tuple[str | None, str | None]], window: int) -> Windows:
    """The automaton of a block; a worker process keeps the one it used last for its next tasks."""
    digest = hashlib.sha256(repr((window, block)).encode("utf-8", "replace")).digest()
    if digest not in _built:
        _built.clear()  # bounded memory
        _built[digest] = Windows(block, window)
    return _built[digest]


def original_spans(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """The hit words as character ranges of the original text, neighbours joined."""
    if not hit.any():
        return []
    raw = text.encode("utf-8", "replace")
    inner = np.frombuffer(raw.translate(FOLD), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inner, [False]]).astype(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    character = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # characters up to and with a byte
    runs = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return [{"start": int(character[starts[a]]) - 1, "end": int(character[ends[b - 1] - 1])}
            for a, b in zip(runs[0::2], runs[1::2])]


STATE = "text string, hit binary, items array<string>"
RESULT = ("n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
          "spans array<struct<start:int,end:int>>, items array<string>")


def _schema(id_type: pa.DataType, last: bool) -> pa.Schema:
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    names = pa.list_(pa.string())
    rest = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()),
            ("contaminated", pa.bool_()), ("spans", pa.list_(span)), ("items", names)]
    return pa.schema([("doc_id", id_type), *(rest if last else [("text", pa.string()), ("hit", pa.binary()), ("items", names)])])


def _result(doc, text: str, n: int, hit: np.ndarray, ids: set[str], percent: int) -> dict:
    covered, listed = int(hit.sum()), sorted(ids)
    return {
        "doc_id": doc, "n_words": n, "n_hit": covered, "n_items": len(listed),
        "items_sha256": hashlib.sha256(",".join(listed).encode()).hexdigest(),
        "contaminated": covered > 0 and 100 * covered >= percent * n,
        "spans": original_spans(text, hit), "items": listed}


def _scanner(block: list[tuple[str | None, str | None]], window: int, percent: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = windows_of(block, window)
        for batch in batches:
            rows = []
            for doc, text, before, items in zip(*(c.to_pylist() for c in batch.columns)):
                n, hit, ids = machine.scan(text or "")
                if before is not None:
                    hit |= np.unpackbits(np.frombuffer(before, np.uint8), count=n).astype(bool)
                ids.update(items or [])
                rows.append(_result(doc, text or "", n, hit, ids, percent) if last else {
                    "doc_id": doc, "text": text, "hit": np.packbits(hit).tobytes(), "items": sorted(ids)})
            yield pa.RecordBatch.from_pylist(rows, schema=_schema(batch.schema.field(0).type, last))
    return run


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, block_bytes: int) -> list[DataFrame]:
    """The distinct items in blocks of about ``block_bytes`` of text, one at least."""
    items = plain(benchmark, item=item_id, body=item_text).select(F.col("item").cast("string"), "body").distinct()
    size = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    return [items.filter(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == i) for i in range(blocks)]


def find_passages(
    documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, percent: int = 5,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document row: words, hit words, items found, their digest, verdict, spans in the original.

    A document is contaminated if at least ``percent`` per cent of its words, and one at least, are hit.
    Null and empty texts have no words and are clean.  Repeated rows are judged each for themselves;
    equal windows of several items name all of them.  An empty benchmark finds nothing, an empty table has
    no rows.  Ids may be of any type.  A text of any length is taken whole, in memory in proportion to it.

    The benchmark goes to the executors only up to ``block_bytes``.  A larger one is cut into blocks
    by a hash of its items, and the documents, with what was found so far, pass through one automaton
    after the other.
    """
    spark = documents.sparkSession
    blocks = _blocks(benchmark, item_id, item_text, block_bytes)
    docs = plain(documents, doc_id=doc_id, text=text)
    of_id = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, "
    frame = docs.select(
        "doc_id", "text", F.lit(None).cast("binary").alias("hit"), F.lit(None).cast("array<string>").alias("items"))
    for i, block in enumerate(blocks):
        last = i == len(blocks) - 1
        rows_at_once(spark)
        frame = frame.mapInArrow(_scanner([tuple(r) for r in block.collect()], window, percent, last), of_id + (RESULT if last else STATE))
        frame = frame if last else written(frame)
    return frame


def drop_contaminated(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, percent: int = 5, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows, with all their columns, that are not contaminated; null, empty and repeated rows as above.

    Columns may have any names.
    """
    blocks = _blocks(benchmark, item_id, item_text, block_bytes)
    hits = unused("_hit_words", documents.columns)
    frame = documents.withColumn(hits, F.lit(None).cast("binary"))

    def dropper(block: list, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = windows_of(block, window)
            for batch in batches:
                found, keep = [], []
                for body, before in zip(batch.column(text).to_pylist(), batch.column(hits).to_pylist()):
                    n, hit, _ = machine.scan(body or "")
                    if before is not None:
                        hit |= np.unpackbits(np.frombuffer(before, np.uint8), count=n).astype(bool)
                    found.append(np.packbits(hit).tobytes())
                    keep.append(not last or not hit.any() or 100 * int(hit.sum()) < percent * n)
                at = batch.schema.get_field_index(hits)
                yield batch.set_column(at, hits, pa.array(found, pa.binary())).filter(pa.array(keep, pa.bool_()))
        return run

    for i, block in enumerate(blocks):
        last = i == len(blocks) - 1
        rows_at_once(documents.sparkSession)
        frame = frame.mapInArrow(dropper([tuple(r) for r in block.collect()], last), frame.schema)
        frame = frame if last else written(frame)
    return frame.drop(hits)
