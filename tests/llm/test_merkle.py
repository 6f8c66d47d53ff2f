"""The manifest against a tree built in one piece, at block sizes that take several rounds."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import merkle as M
from millrace.llm.queries import op11_merkle_manifest

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, more=0):
    out = ""
    for c in FIELDS:
        v = row[c]
        v = None if v is None else str(v + more) if c == "n_chars" else str(v)
        out += "-" if v is None else f"{len(v.encode())}:{v}"
    return sha(out)


def levels(nodes, arity):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + arity])) for i in range(0, len(out[-1]), arity)])
    return out


def path(tree, i, arity):
    steps = []
    for level in tree[:-1]:
        first = i - i % arity
        run = level[first:first + arity]
        steps.append((run[:i - first], run[i - first + 1:]))
        i //= arity
    return steps


def brute(rows, arity=2):
    """(leaf, subroot, root, proof, folded) of every row, sorted."""
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for n in names:
        trees[n].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    built = {n: levels([leaf(r) for r in trees[n]], arity) for n in names}
    crown = levels([built[n][-1][0] for n in names], arity)
    out = []
    for k, n in enumerate(names):
        for i, r in enumerate(trees[n]):
            steps = path(built[n], i, arity) + path(crown, k, arity)
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None
            folded = leaf(r, int(tampered))
            for left, right in steps:
                folded = sha("".join(left) + folded + "".join(right))
            proof = sha("".join("".join(left + right) for left, right in steps))
            out.append((r["doc_id"], leaf(r), built[n][-1][0], crown[-1][0], proof, folded, folded == crown[-1][0]))
    return sorted(out, key=repr)


def sample(n):
    langs = ["en", "de", None, "", "é", "-", "en", "en"]
    rows = [{"doc_id": i, "source": None if i % 5 == 0 else f"s{i % 3}", "lang": langs[i % 8], "n_chars": None if i % 11 == 0 else i,
             "text": [None, "", "ünï", "x" * 5000, f"t{i}"][i % 5]} for i in range(n)]
    rows += [dict(rows[7]) for _ in range(3)] + [dict(rows[9], text="other"), dict(rows[0], doc_id=None), dict(rows[0], lang="alone")]
    return rows


DDL = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("arity,size", [(2, 1), (2, 3), (3, 2), (2, 12)])
def test_manifest(spark, arity, size):
    rows = sample(90)
    df = spark.createDataFrame(rows, DDL).withColumn("digest", F.lit(1)).withColumn("place", F.lit("clash"))
    got = M.manifest(df, "lang", "doc_id", FIELDS, keep=["digest", "place"], arity=arity, levels=size)
    assert got.columns == ["order_key", "tree_key", "digest", "place", "leaf", "subroot", "root", "proof"]
    found = sorted(
        ((r["order_key"], r["leaf"], r["subroot"], r["root"], sha(r["p"])) for r in got.withColumn("p", M.siblings(F.col("proof"))).collect()), key=repr)
    assert found == [r[:5] for r in brute(rows, arity)]
    assert got.filter(M.fold(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    assert got.filter((F.col("digest") != 1) | (F.col("place") != "clash")).count() == 0


def test_query(spark, folder, tmp_path):
    rows = [r.asDict() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in op11_merkle_manifest(spark, folder).collect()), key=repr) == brute(rows)
    spark.createDataFrame(sample(40), DDL).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((tuple(r) for r in op11_merkle_manifest(spark, str(tmp_path)).collect()), key=repr) == brute(sample(40))


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], DDL)
    assert M.manifest(empty, "lang", "doc_id", FIELDS).count() == 0
    one = M.manifest(spark.createDataFrame(sample(10)[:1], DDL), "lang", "doc_id", FIELDS).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof"] == ""


def test_sweeps():
    leaves = [sha(str(i)) for i in range(11)]
    for arity in (2, 3, 5):
        height = M.height_of(len(leaves), arity)
        known = M.lift(leaves, height, arity)
        assert [known[height, 0]] == levels(leaves, arity)[-1]
        told = ["".join(f"{''.join(a)}:{''.join(b)};" for a, b in path(levels(leaves, arity), i, arity)) for i in range(11)]
        assert M.proofs(known, height, "", arity) == told
