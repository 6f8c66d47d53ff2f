"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positive examples, unlabelled documents of any kind the rest: a
document without a toxic label may well be toxic.  Linear numpy classifiers minimise the risk
``prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)])`` with logistic loss, where the second
part, the risk of the unseen negatives, is kept from falling below zero.  Their mean probability is
the score.  Features are a text's distinct words and word beginnings, hashed; a screening against the
unlabelled texts keeps those that toxic texts hold significantly more often.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain, rows_at_once

FOLDS = 5
#: Bounds of the training sample, in documents.
POSITIVES, UNLABELLED = 1500, 6000
#: Classifiers; each leaves out another part of the sample.
BAGS = 3
DIMENSIONS = 1 << 20
#: Characters of word beginnings that are features beside the words.
PREFIXES = (4, 5)
#: Standard errors by which a feature must be more frequent in toxic than in unlabelled texts.
SCREEN = 6.0
#: Share of the toxic examples that must hold a feature; five of them at least.
SHARE = 0.02
#: A-Z to a-z; other ASCII than letters parts words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> set[bytes]:
    return set((text or "").encode("utf-8", "replace").translate(FOLD).split())


def word_features(word: bytes) -> list[int]:
    """Hashes of the word and of its beginnings, counted in characters."""
    letters = word.decode("utf-8", "replace")
    parts = [letters, *(f"{letters[:n]}*" for n in PREFIXES if len(letters) >= n)]
    return [zlib.crc32(p.encode()) % DIMENSIONS for p in parts]


def text_features(text: str | None) -> np.ndarray:
    return np.unique(np.array([f for w in words(text) for f in word_features(w)], np.int32))


def held_out(doc_id: Column) -> Column:
    """One fold of five is never learned from.  A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 300,
          rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """Kept features, their weights, and the bias."""
    start = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return np.zeros(0, np.int32), np.zeros(0), start
    np_, nu = len(positive), len(unlabelled)
    share_p, share_u = (np.bincount(np.concatenate(x), minlength=DIMENSIONS) / len(x) for x in (positive, unlabelled))
    mean = (share_p * np_ + share_u * nu) / (np_ + nu)
    error = np.sqrt(mean * (1 - mean) * (1 / np_ + 1 / nu)) + 1e-12
    kept = np.flatnonzero(((share_p - share_u) / error >= SCREEN) & (share_p * np_ >= max(5, SHARE * np_)))
    place = np.full(DIMENSIONS, -1)
    place[kept] = np.arange(len(kept))

    def sparse(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
        columns = [place[r][place[r] >= 0] for r in rows]
        return np.concatenate(columns), np.repeat(np.arange(len(rows)), [len(c) for c in columns]), len(rows)

    xp, xu = sparse(positive), sparse(unlabelled)
    w, b = np.zeros(len(kept)), start
    mean_g, mean_s = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)

    def logit(x: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
        return np.bincount(x[1], w[x[0]], x[2]) + b

    for k in range(1, rounds + 1):
        zp, zu = logit(xp), logit(xu)
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        negatives = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        if negatives >= 0:
            gp, gu = prior * ((sp - 1) - sp) / np_, su / nu
        else:  # climb back: the risk of the negatives alone, with its sign turned
            gp, gu = prior * sp / np_, -su / nu
        g = np.bincount(xp[0], gp[xp[1]], len(kept)) + np.bincount(xu[0], gu[xu[1]], len(kept)) + decay * w
        g = np.append(g, gp.sum() + gu.sum())
        mean_g, mean_s = 0.9 * mean_g + 0.1 * g, 0.99 * mean_s + 0.01 * g * g
        step = rate * mean_g / (1 - 0.9 ** k) / (np.sqrt(mean_s / (1 - 0.99 ** k)) + 1e-8)
        w, b = w - step[:-1], b - float(step[-1])
    return kept.astype(np.int32), w, b


def _featurizer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [text_features(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(rows, pa.list_(pa.int32())), batch.column(2)], names=["toxic", "features", "bag"])


def _trainer(prior: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame[~frame["features"].isna()]
        parts = [list(frame.loc[frame["toxic"] == t, "features"]) for t in (True, False)]
        kept, w, b = train(*parts, prior)
        return pd.DataFrame([{"features": kept.tobytes(), "weights": w.tobytes(), "bias": b}])
    return run


Model = list[tuple[np.ndarray, np.ndarray, float]]


def fit(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
        label: str = "toxic", label_id: str = "doc_id", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Learn from all folds but the held-out one.

    At most ``positives`` toxic and ``unlabelled`` further documents are read, drawn by a hash of the
    id; the class prior is the share of toxic labels, over all labels of those folds.  Null ids and
    null labels are left aside; an id labelled twice is toxic if one label says so.  Without a toxic
    example the model is its prior.
    """
    spark = documents.sparkSession
    known = plain(labels, id=label_id, y=label).filter(~held_out(F.col("id")) & F.col("y").isNotNull()).groupBy("id").agg(
        F.max("y").alias("y"))
    share = known.agg(F.avg((F.col("y") == 1).cast("double"))).first()[0]
    prior = min(max(share or 0.0, 0.01), 0.5)
    drawn = F.xxhash64(F.col("id"), F.lit("drawn"))
    docs = plain(documents, id=doc_id, text=text)
    toxic = known.filter("y = 1").orderBy(drawn).limit(positives).select("id", F.lit(True).alias("toxic"))
    rest = docs.select("id").filter(F.col("id").isNotNull() & ~held_out(F.col("id"))).orderBy(drawn).limit(
        unlabelled).select("id", F.lit(False).alias("toxic"))
    sample = F.broadcast(toxic.unionByName(rest))  # at most positives + unlabelled ids
    rows_at_once(spark)
    bag = F.explode(F.filter(
        F.array(*[F.lit(i) for i in range(BAGS)]), lambda i: i != F.pmod(F.xxhash64("id", F.lit("bag")), F.lit(BAGS))))
    features = docs.join(sample, "id").select("toxic", "text", bag.alias("bag")).mapInArrow(
        _featurizer, "toxic boolean, features array<int>, bag int")
    models = features.groupBy("bag").applyInPandas(_trainer(prior), "features binary, weights binary, bias double").collect()
    return [(np.frombuffer(m["features"], np.int32), np.frombuffer(m["weights"]), m["bias"]) for m in models] or [
        train([], [], prior)]


def _scores(model: Model):
    """A function from texts to scores."""
    kept = np.unique(np.concatenate([m[0] for m in model]))
    place = {int(f): i for i, f in enumerate(kept)}
    weights, biases = np.zeros((len(model), len(kept))), np.array([m[2] for m in model])
    for row, (features, w, _) in zip(weights, model):
        row[np.searchsorted(kept, features)] = w
    telling: dict[bytes, tuple[int, ...]] = {}

    def score_texts(texts: list[str | None]) -> list[float]:
        scores = []
        for text in texts:
            found = words(text)
            for w in found.difference(telling):
                telling[w] = tuple(place[f] for f in word_features(w) if f in place)
            hits = list(set().union(*map(telling.__getitem__, found)))
            scores.append(float(np.mean(1 / (1 + np.exp(-(weights[:, hits].sum(1) + biases))))))
            if len(telling) > 500_000:  # bounded memory; words are looked up again
                telling.clear()
        return scores

    return score_texts


def score(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` for every row; a null or empty text scores what the bias alone gives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _scores(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(of(batch.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    rows_at_once(documents.sparkSession)
    return plain(documents, doc_id=doc_id, text=text).mapInArrow(run, "doc_id long, score double")


def drop_toxic(documents: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns, that score below the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _scores(model)
        for batch in batches:
            yield batch.filter(pa.array([s < threshold for s in of(batch.column(text).to_pylist())], pa.bool_()))

    rows_at_once(documents.sparkSession)
    return documents.mapInArrow(run, documents.schema)
