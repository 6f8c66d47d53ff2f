"""Byte-level BPE: texts to ids and offsets, ids to bytes and texts.

The vocabulary is a rank file: the bytes of each token and its rank, which is its id.  A tokenizer of the
``tokenizers`` library is made of it: bytes are written as characters by the byte-level table, and every
way to put a token together from two others is a merge, tried in the order of ranks.  Texts run through it
in Arrow batches.  Decoding reverses the table; characters that tokens split are put together again.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import plain, rows_at_once, single_threaded
from .vocabulary import CACHED_CHARS, Remembered, byte_signs, char_of_byte, portions, units

#: Portions that are encoded in one call.
AT_ONCE = 64

_loaded: dict[tuple[str, str], tuple] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: a base64 text and a number on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merges(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """All pairs of tokens that make a token, by its rank; of one token's pairs, the one that ranks lower first."""
    pairs = [
        (rank, ranks[token[:i]], ranks[token[i:]], token[:i], token[i:])
        for token, rank in ranks.items() for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
    return [(left, right) for *_, left, right in sorted(pairs)]


def tokenizer(path: str, pattern: str):
    """The tokenizer of a rank file, the bytes of each id and their number, and units seen; once for each worker process."""
    if (path, pattern) not in _loaded:
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        single_threaded()
        ranks, signs = read_ranks(path), byte_signs()
        shown = lambda token: "".join(signs[b] for b in token)
        made = Tokenizer(models.BPE(
            vocab={shown(t): r for t, r in ranks.items()}, merges=[(shown(a), shown(b)) for a, b in merges(ranks)]))
        made.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        _loaded[path, pattern] = (made, table, np.array([len(t) for t in table], np.int64), Remembered())
    return _loaded[path, pattern]


def encode_texts(texts: list[str], path: str, pattern: str) -> list[bytes]:
    """Ids of the tokens of each text, as packed 32-bit integers."""
    made, _, sizes, remembered = tokenizer(path, pattern)
    cut = [units(t) if t else [] for t in texts]
    new = list(portions(remembered.missing(set().union(*cut))))
    known = remembered.newer
    long = [u for part in new for u in part if len(u) > CACHED_CHARS]
    for start in range(0, len(new), AT_ONCE):
        some = new[start:start + AT_ONCE]
        for part, e in zip(some, made.encode_batch_fast(["".join(p) for p in some], add_special_tokens=False)):
            ids = np.array(e.ids, np.int32)
            ends = np.cumsum([len(u.encode()) for u in part])
            ends = 4 * (np.searchsorted(np.cumsum(sizes[ids]), ends) + 1)
            packed, first = ids.tobytes(), 0
            for u, end in zip(part, ends.tolist()):
                known[u] = packed[first:end]
                first = end
    out = [b"".join(map(known.__getitem__, parts)) for parts in cut]
    for u in long:
        del known[u]
    return out


def spans(text: str, ids: bytes, sizes: np.ndarray) -> tuple[bytes, bytes]:
    """First and end characters of the tokens of a text: their bytes, mapped to the characters that they are part of."""
    ends = np.cumsum(sizes[np.frombuffer(ids, np.int32)])
    if not len(ends):
        return b"", b""
    starts = np.concatenate([[0], ends[:-1]])
    if len(text) == ends[-1]:
        return starts.astype(np.int32).tobytes(), ends.astype(np.int32).tobytes()
    place = char_of_byte(text.encode())
    return place[starts].astype(np.int32).tobytes(), (place[ends - 1] + 1).astype(np.int32).tobytes()


def _lists(parts: list[bytes]) -> pa.ListArray:
    sizes = np.cumsum([0, *[len(p) // 4 for p in parts]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def encode(documents: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", offsets: bool = True) -> DataFrame:
    """``doc_id, ids, starts, ends`` of every row: token ids, and where tokens lie, in code points, end exclusive.

    A token that holds part of a character spans the whole of it; without ``offsets`` there are ids alone.
    Null and empty texts have no tokens.  Special tokens are not looked for.  Long texts are taken whole;
    ids of documents may be of any type and repeat.  Further columns are left out.
    """
    rows_at_once(documents.sparkSession)
    docs = plain(documents, doc_id=doc_id, text=text)

    names = ["ids", "starts", "ends"][:3 if offsets else 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = tokenizer(path, pattern)[2]
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = encode_texts(texts, path, pattern)
            lists = [ids, *zip(*[spans(t, i, sizes) for t, i in zip(texts, ids)])] if offsets and texts else [ids] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(_lists, lists)], names=["doc_id", *names])

    numbers = T.ArrayType(T.IntegerType())
    return docs.mapInArrow(run, T.StructType([docs.schema["doc_id"], *[T.StructField(c, numbers) for c in names]]))


def decode_pieces(tokens: list[bytes]) -> list[str]:
    """The text of each token; a split character belongs to the token that completes it.

    What is no UTF-8 becomes U+FFFD, an unfinished character at the end with the last token.
    """
    reader = codecs.getincrementaldecoder("utf-8")("replace")
    return [reader.decode(t, k == len(tokens) - 1) for k, t in enumerate(tokens)]


def joined(rows: pa.ListArray, table: pa.BinaryArray) -> pa.Array:
    """The bytes that each row of ids makes, put together in one piece of memory; null rows make none."""
    flat = table.take(rows.flatten())
    if flat.null_count:
        raise ValueError("a null is no id")
    places = np.cumsum([0, *pc.fill_null(pc.list_value_length(rows), 0).to_pylist()])
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(flat).to_numpy(), dtype=np.int64)])[places]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), flat.buffers()[2] or pa.py_buffer(b"")])


def decode(tokens: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", ids: str = "ids", pieces: bool = False,
           keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id, *keep, decoded`` (bytes) of every row, and with ``pieces`` the text of each token.

    Bytes need not be UTF-8, as ids may be any; no ids, or null, make no bytes.  An id outside the
    vocabulary fails.
    """
    rows_at_once(tokens.sparkSession)
    rows = plain(tokens, token_ids=ids, doc_id=doc_id, **{c: c for c in keep})
    fields = [*rows.schema.fields[1:], T.StructField("decoded", T.BinaryType())]
    if pieces:
        fields.append(T.StructField("pieces", T.ArrayType(T.StringType())))
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tokenizer(path, pattern)[1]
        tokens = pa.array(table, pa.binary())
        for batch in batches:
            out = [*batch.columns[1:], joined(batch.column(0), tokens)]
            if pieces:
                out.append(pa.array([decode_pieces([table[i] for i in row or ()]) for row in batch.column(0).to_pylist()], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(out, names=names)

    return rows.mapInArrow(run, T.StructType(fields))


def digests(tokens: DataFrame) -> DataFrame:
    """Adds ``n_tokens`` and ``ids_sha256``, the digest of the decimal ids joined by commas."""
    return tokens.withColumns({
        "n_tokens": F.size("ids").cast("long"), "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)})
