"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is a linear score of bounded text features. Pairs of one
label-1 and one label-0 document are preferences; the weights minimise the
logistic loss on the pairs' feature differences. The decision threshold is the
quantile of the strengths of all labelled training rows at their share of
label 0, computed by Spark over the whole corpus; a logistic link places that
threshold at probability `Config.cut`, so `score >= cut` is the rank decision.

Only rows whose crc32(doc_id) modulo 5 is not 0 are learned from. The pair
sample is bounded (`rows_per_class`, `pairs`); the quantile uses all rows.

Defined results: null and empty texts have the features of an empty text and
score like one; rows without doc_id count as held out; without labelled rows
of both classes every score is 1. Ties in strength get equal scores. Repeated
rows get a result each and count each in the quantile; extra columns are ignored
by `classify` and pass through `accepted`; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import crc32_mod, record_batch, utf8

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


@dataclass(frozen=True)
class Config:
    rows_per_class: int = 3000  # bound of the sample that pairs are drawn from, per label
    pairs: int = 60_000  # preference pairs drawn from that sample
    ridge: float = 1e-3  # L2 weight in the mean pair loss
    cut: float = 0.3  # score of the threshold quantile
    fold_of: int = 5


@dataclass(frozen=True)
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float | None = None  # strength at the cut


def text_features(text: str | None) -> np.ndarray:
    """Shares and logarithms that do not depend on labels, language or source."""
    raw = utf8(text)
    b = np.frombuffer(raw, np.uint8)
    n = max(1, len(b))
    h = np.bincount(b, minlength=256)
    tokens = raw.split()
    t = max(1, len(tokens))
    count: dict[bytes, int] = {}
    for w in tokens:
        count[w] = count.get(w, 0) + 1
    letters = max(1, int(h[65:91].sum() + h[97:123].sum()))
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens)) if tokens else np.zeros(1, np.int64)
    share = h[h > 0] / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    nl = max(1, len(lines))
    adjacent = sum(map(bytes.__eq__, tokens, tokens[1:])) if len(tokens) > 1 else 0
    pairs = len(set(zip(tokens, tokens[1:]))) if len(tokens) > 1 else 1
    symbols = int(h[[35, 36, 37, 38, 42, 60, 62, 64, 94, 95, 124, 126]].sum())
    marks = int(h[33] + h[63])
    stops = int(h[46] + h[44] + h[59] + h[58])
    top = max(count.values(), default=0)
    x = [
        h[65:91].sum() / letters,
        np.sqrt(symbols / n),
        np.sqrt(marks / n),
        np.sqrt(stops / n),
        np.sqrt(h[48:58].sum() / n),
        h[128:].sum() / n,
        np.sqrt(h[124] / n),
        np.sqrt(h[10] / n),
        h[32] / n,
        lengths.mean() / 10,
        lengths.std() / 10,
        np.log1p(lengths.max()),
        len(count) / t,
        top / t,
        np.sqrt(adjacent / t),
        pairs / max(1, len(tokens) - 1),
        1 - len(set(lines)) / nl if lines else 0.0,
        np.log1p(t) / 10,
        np.log1p(t / nl) / 5,
        float(-(share * np.log(share)).sum()) if len(b) else 0.0,
        np.minimum(t, 50) / 50,
        np.sqrt(min(1.0, symbols / t)),
        np.sqrt(min(1.0, marks / t)),
        np.sqrt(min(1.0, h[65:91].sum() / t / 4)),
        1.0 if not tokens else 0.0,
    ]
    return np.clip(np.array(x, float), -10, 10)


def fit_bradley_terry(x: np.ndarray, y: np.ndarray, cfg: Config) -> Ranker:
    """Newton steps on the mean logistic loss of the drawn pairs' differences."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = np.clip((x - mean) / scale, -8, 8)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rng = np.random.default_rng(0)
    d = z[rng.choice(good, cfg.pairs)] - z[rng.choice(bad, cfg.pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(40):
        lose = 1 / (1 + np.exp(np.clip(d @ w, -50, 50)))  # chance that the worse one is preferred
        g = -(d * lose[:, None]).mean(0) + cfg.ridge * w
        hess = (d * (lose * (1 - lose))[:, None]).T @ d / len(d) + cfg.ridge * np.eye(len(w))
        step = np.linalg.solve(hess, g)
        w = w - step * min(1.0, 3.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return Ranker(mean, scale, w)


def strength(ranker: Ranker, x: np.ndarray) -> float:
    return float(np.clip((x - ranker.mean) / ranker.scale, -8, 8) @ ranker.weights)


def _known(labels: DataFrame, cfg: Config) -> DataFrame:
    """Training labels, one row per doc_id (a document with both labels counts as 0)."""
    return (
        labels.select("doc_id", F.col("quality").cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (crc32_mod("doc_id", cfg.fold_of) != 0))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
    )


def _strengths(documents: DataFrame, ranker: Ranker) -> DataFrame:
    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [strength(ranker, text_features(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "strength"])

    return documents.select("doc_id", "text").mapInArrow(rank, "doc_id long, strength double")


def train(documents: DataFrame, labels: DataFrame, cfg: Config = Config()) -> Ranker | None:
    """Weights from the bounded pair sample, threshold from all labelled training rows."""
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = _known(labels, cfg)
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    sample = known.where("label = 0").orderBy(order).limit(cfg.rows_per_class).unionByName(
        known.where("label = 1").orderBy(order).limit(cfg.rows_per_class)
    )

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [text_features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "label", "x"]
            )

    rows = (
        documents.join(F.broadcast(sample), "doc_id")  # twice rows_per_class ids at most
        .groupBy("doc_id", "label")
        .agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
        .mapInArrow(describe, "doc_id long, label int, x array<double>")
        .toArrow()
        .sort_by("doc_id")
    )
    y = np.array(rows["label"].to_pylist(), int)
    if len(set(y.tolist())) < 2:
        return None
    ranker = fit_bradley_terry(np.array(rows["x"].to_pylist(), float), y, cfg)
    share, t = quantile_threshold(documents, known, ranker)
    return Ranker(ranker.mean, ranker.scale, ranker.weights, t) if share is not None else None


def quantile_threshold(documents: DataFrame, known: DataFrame, ranker: Ranker) -> tuple[float | None, float | None]:
    """Share of label 0 among the labelled rows and their strengths' quantile there."""
    ranked = _strengths(documents, ranker).join(known, "doc_id")  # joins numbers, not texts
    share = ranked.agg(F.avg(1 - F.col("label")).alias("share"), F.percentile_approx("strength", [i / 1000 for i in range(1001)], 100_000).alias("q")).first()
    if share["share"] is None:
        return None, None
    at = share["share"] * 1000
    low = int(at)
    q = share["q"]
    return share["share"], q[low] + (at - low) * (q[min(1000, low + 1)] - q[low])


def score_of(ranker: Ranker | None, text: str | None, cut: float) -> float:
    """Probability-like score; strengths at or above the threshold get at least `cut`."""
    if ranker is None:
        return 1.0
    over = strength(ranker, text_features(text)) - ranker.threshold
    odds = np.log(cut / (1 - cut))
    score = float(1 / (1 + np.exp(-np.clip(over + odds, -700, 700))))
    return max(score, cut) if over >= 0 else min(score, np.nextafter(cut, 0))


def classify(documents: DataFrame, ranker: Ranker | None, cfg: Config = Config()) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, scored in Arrow batches."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [score_of(ranker, t, cfg.cut) for t in batch.column("text").to_pylist()]
            yield record_batch(
                {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": s, "predicted": [int(v >= cfg.cut) for v in s]},
                _ARROW,
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (crc32_mod("doc_id", cfg.fold_of) == 0).alias("held_out"), "text")
    return rows.mapInArrow(score, SCHEMA)


def accepted(documents: DataFrame, ranker: Ranker | None, cfg: Config = Config()) -> DataFrame:
    """The documents predicted 1, with all their columns; no shuffle."""

    @F.pandas_udf("boolean")
    def keep(texts):
        return texts.map(lambda t: score_of(ranker, t, cfg.cut) >= cfg.cut)

    return documents.where(keep(F.coalesce(F.col("text"), F.lit(""))))
