"""Encoding against the public library, decoding round trips, alignment against a walk over whole texts."""

import base64
import collections
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from millrace.llm import alignment, byte_bpe, vocabulary
from millrace.llm.queries import op12_byte_bpe, op13_alignment

RANKS, A, B = (P.path(n) for n in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))
VOCABULARY = {"path": RANKS, "pattern": P.PATTERN}
TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \n\n  b\t\tc", "don't we'll", "x" * 300, "-" * 1001, "日本語のテキスト", "é é",
    "\U00013080 z\U00013080", "<|endoftext|> <s> </s> <0x41> <unk>", "a▁b", "▁", "a;\r\n b {\r\n }", "\x00 \x1c\x1f \x85\xa0 　", "Ünïcode wörds и слова",
    "word " * 3000, "日" * 4000, "😀😃 👨‍👩‍👧 end", "12 345 6789", "the the the", "tab\tand\x0bmore  "]


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


@pytest.fixture(scope="module")
def public():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def write(spark, tmp_path, texts):
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def noise(seed, n=400):
    r, ranks = random.Random(seed), list(byte_bpe.read_ranks(RANKS))
    kinds = [
        lambda: b"".join(r.choice(ranks) for _ in range(r.randrange(1, 30))).decode("utf-8", "ignore"),
        lambda: "".join(r.choice("ab \n\t\r'▁") * r.randrange(1, 20) for _ in range(r.randrange(1, 12))),
        lambda: "".join(r.choice("anab=-_*.e ") for _ in range(r.randrange(1, 60))),
        lambda: "".join(chr(r.choice([r.randrange(32, 127), r.randrange(0xA0, 0x600), r.randrange(0x3040, 0x9FFF), 0x301, 0x1F600])) for _ in range(40))]
    return [r.choice(kinds)() for _ in range(n)]


def test_encoding_is_that_of_the_library(public):
    texts = [t or "" for t in TEXTS] + noise(1)
    for t, ids in zip(texts, byte_bpe.encode_texts(texts, **VOCABULARY)):
        assert memoryview(ids).cast("i").tolist() == public.encode_ordinary(t)


def test_offsets_and_pieces(spark, public):
    texts = TEXTS + noise(2, 60)
    df = spark.createDataFrame([(f"k{i}", t, 0) for i, t in enumerate(texts)], "doc_id string, text string, starts int")
    tokens = byte_bpe.encode(df, **VOCABULARY)
    back = {r["doc_id"]: r for r in byte_bpe.decode(tokens, **VOCABULARY, pieces=True).collect()}
    for r in tokens.collect():
        t = texts[int(r["doc_id"][1:])] or ""
        assert back[r["doc_id"]]["decoded"].decode() == t == "".join(back[r["doc_id"]]["pieces"])
        for i, a, b in zip(r["ids"], r["starts"], r["ends"]):
            token = public.decode_single_token_bytes(i)
            assert token in t[a:b].encode() and (len(t[a:b].encode()) == len(token) or b - a <= 3)


def test_decoding_of_any_ids(spark):
    smile = byte_bpe.encode_texts(["😀"], **VOCABULARY)[0]
    ids = memoryview(smile).cast("i").tolist()
    df = spark.createDataFrame([(1, ids), (2, ids[:1]), (3, None), (4, [])], "doc_id int, ids array<int>")
    got = {r["doc_id"]: (bytes(r["decoded"]), r["pieces"]) for r in byte_bpe.decode(df, **VOCABULARY, pieces=True).collect()}
    assert got[1][0] == "😀".encode() and got[1][1] == [""] * (len(ids) - 1) + ["😀"]
    assert got[2][1] == ["�"] and got[3] == got[4] == (b"", [])


def test_rows_of_ids_are_joined_without_python_objects():
    """Null, empty and sliced rows; ids outside the vocabulary, negative and null ids fail."""
    table = pa.array([b"a", b"", b"\xff\x00", b"bc"], pa.binary())
    rows = pa.array([[3, 3], None, [], [0, 1, 2], [1]], pa.list_(pa.int32()))
    assert byte_bpe.joined(rows, table).to_pylist() == [b"bcbc", b"", b"", b"a\xff\x00", b""]
    assert byte_bpe.joined(rows.slice(2, 2), table).to_pylist() == [b"", b"a\xff\x00"]
    assert byte_bpe.joined(rows[:0], table).to_pylist() == []
    for ids in ([4], [-1], [None]):
        with pytest.raises((pa.ArrowInvalid, IndexError, ValueError)):
            byte_bpe.joined(pa.array([ids], pa.list_(pa.int32())), table)


def test_units_in_use_are_not_forgotten(monkeypatch):
    """A unit that each batch has is worked out once, however many others pass; the rest is bounded by two halves."""
    monkeypatch.setattr(vocabulary, "CACHE_UNITS", 10)
    known, worked_out = vocabulary.Remembered(), collections.Counter()
    for k in range(50):
        wanted = {" the", *(f" {k}.{j}" for j in range(4))}
        new = known.missing(wanted)
        worked_out.update(new)
        known.newer.update((u, u) for u in new)
        assert wanted <= set(known.newer) and len(known.newer) + len(known.older) <= 30
    assert set(worked_out.values()) == {1} and len(worked_out) == 201


def test_alignment_remembers_plain_tuples():
    """Python's collector does not walk tuples of plain values, of which a worker keeps hundreds of thousands."""
    both = alignment.Aligner(A, B)
    assert both.align(["some words", None])[0] and {type(u) for u in both.known.newer.values()} == {tuple}


def test_byte_bpe_query(spark, folder, tmp_path, public):
    made = write(spark, tmp_path, TEXTS)
    for place in (folder, made):
        texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{place}/documents.parquet").collect()}
        got = op12_byte_bpe(spark, place).collect()
        assert len(got) == len(texts)
        for r in got:
            ids = public.encode_ordinary(texts[r["doc_id"]])
            assert tuple(r)[1:] == (len(ids), sha(",".join(map(str, ids))), sha(texts[r["doc_id"]]))


def walked(rows):
    """The report of (id, text) rows, each text tokenized whole."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    signs = vocabulary.sign_bytes()
    a_bytes = {i: bytes(signs[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items()}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found, counts = {}, collections.Counter()
    for key, t in rows:
        raw = (" " + (t or "")).encode()
        x, y = a.encode(" " + (t or ""), add_special_tokens=False).ids, b.encode(t or "")
        xs, ys = [a_bytes[i] for i in x], [piece(i) for i in y]
        if not t or b"".join(xs) != raw or b"".join(ys) != raw:
            found[key] = None
            continue
        owner = [[k for k, p in enumerate(side) for _ in p] for side in (xs, ys)]
        links = list(dict.fromkeys(zip(*owner)))
        ends = [{sum(map(len, side[:k + 1])): k + 1 for k in range(len(side))} for side in (xs, ys)]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, p, q = [], 0, 0
        for c in common:
            groups.append(",".join(map(str, x[p:ends[0][c]])) + "|" + ",".join(map(str, y[q:ends[1][c]])))
            p, q = ends[0][c], ends[1][c]
        pairs = [(x[i], y[j]) for i, j in links]
        counts.update(set(pairs))
        found[key] = (len(x), len(y), len(groups), pairs, sha(";".join(groups)))
    most = {}
    for (i, _), n in counts.items():
        most[i] = max(most.get(i, 0), n)
    return {k: (0, 0, 0, 0, 0, 0, "") if v is None else (
        *v[:3], len(v[3]), sum(counts[p] == most[p[0]] for p in v[3]), sum(counts[p] for p in v[3]), v[4]) for k, v in found.items()}


def told(df):
    return {r["doc_id"]: tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect()}


def test_alignment_of_whole_texts(spark, tmp_path):
    texts = [t[:400] if t else t for t in TEXTS] + noise(3, 60) + ["the the the"] * 4
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id int, text string, chunk int").repartition(3)
    want = walked(rows)
    assert told(alignment.report(df, A, B)) == want
    assert told(alignment.report(df, A, B, chunk_bytes=100)) == want
    spelled = alignment.align(df, A, B).collect()
    for r in spelled:
        n_a, n_b, n_groups = want[r["doc_id"]][:3]
        assert (len(r["a_ids"]), len(r["b_ids"]), len(r["groups"])) == (n_a, n_b, n_groups)
        assert not r["groups"] or tuple(r["groups"][-1]) == (n_a, n_b)


def test_alignment_query(spark, folder):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    short = [(i, t) for i, t in rows if len(t or "") < 3000]
    df = spark.createDataFrame(short, "doc_id long, text string")
    assert told(alignment.report(df, A, B)) == walked(short)
    assert {r["doc_id"] for r in op13_alignment(spark, folder).collect()} == {i for i, _ in rows}


def test_nothing_to_align(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.report(empty, A, B).count() == 0 == byte_bpe.encode(empty, **VOCABULARY).count()
    blank = spark.createDataFrame([(1, None), (1, ""), (None, "a▁")], "doc_id long, text string")
    assert sorted(map(str, told(alignment.report(blank, A, B)).items())) == sorted(map(str, {1: (0,) * 6 + ("",), None: (0,) * 6 + ("",)}.items()))
    assert alignment.report(blank, A, B).count() == 3


def test_spans_are_refined_by_bytes():
    for coarse, sizes in (([1, 4, 4, 4, 5], [1] * 5), ([0, 0, 3, 4], [1] * 4), ([4, 8, 8], [2, 4, 2])):
        assert alignment.exact_ends(np.array(coarse), np.array(sizes)).tolist() == np.cumsum(sizes).tolist()
