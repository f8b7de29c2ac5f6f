"""Quality rules: base text statistics and a hashed n-gram logistic regression.

Features are word 1-2-grams and character 3-4-grams hashed into one weight
vector. Each family is averaged over its occurrences, so a document's logit is
a sum of four means and long texts weigh as much as short ones. The model is
fitted on a bounded sample of labelled rows (`Config.rows_per_class`), its logit
is calibrated by Platt scaling on a second bounded sample that keeps the
labels' own class shares, and documents are scored in Arrow batches against the
fixed threshold `Config.keep_at`.

Defined results: a null text counts as empty; a text without words has all
counts 0 and `base_failed` true; without labelled rows of both classes the
probability is 1 for all (only the base rules then decide). A document with
labels of both kinds is learned from under each; a null doc_id is scored but
never learned from. Repeated rows are scored row by row; very long texts are
read whole; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import crc32_mod, record_batch, utf8

#: The symbols counted by the base rule (fixed value).
SYMBOLS = "#*$%&|<>"

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, kept boolean, probability double"
)
_ARROW = pa.schema(
    [("doc_id", pa.int64())]
    + [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("probability", pa.float64())]
)


@dataclass(frozen=True)
class Config:
    bits: int = 18  # size of the weight vector
    rows_per_class: int = 1500  # bound of the fitted sample, per label
    calibration_rows: int = 1500  # bound of the sample that calibrates
    epochs: int = 12
    batch: int = 128
    rate: float = 0.5
    l2: float = 1e-6
    keep_at: float = 0.5  # calibrated probability of label 1
    fold_of: int = 5  # rows with crc32(doc_id) mod fold_of = 0 are never learned from


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float  # Platt scaling: p = sigmoid(slope * logit + offset)
    offset: float


def word_ids(tokens: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Each word's number in order of first appearance, and the distinct words."""
    seen: dict[bytes, int] = {}
    ids = [seen.setdefault(w, len(seen)) for w in tokens]
    return np.array(ids, np.int64), list(seen)


def repeated_words(ids: np.ndarray, n_distinct: int, n: int = 3) -> int:
    """Words that lie in an n-word window found twice or more in the text."""
    if len(ids) <= n:
        return 0
    windows = ids[: len(ids) - n + 1]
    for k in range(1, n):
        _, windows = np.unique(windows * n_distinct + ids[k : k + len(windows)], return_inverse=True)
    again = np.bincount(windows)[windows] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(n):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


_SPACES = np.array([0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20], np.uint32)
_IS_SPACE = np.zeros(128, bool)
_IS_SPACE[_SPACES] = True
_IS_SYMBOL = np.zeros(128, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def base_counts(text: str, tokens: list[bytes], ids: np.ndarray, n_distinct: int, cps: np.ndarray) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    ascii_cps = cps[cps < 128]
    spaces = int(_IS_SPACE[ascii_cps].sum())
    symbols = int(_IS_SYMBOL[ascii_cps].sum())
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(tokens), len(cps) - spaces, symbols, len(lines) - len(set(lines)), repeated_words(ids, n_distinct)


def buckets(ids: np.ndarray, distinct: list[bytes], cps: np.ndarray, bits: int) -> list[np.ndarray]:
    """Hashed n-grams by family: words, word pairs, character 3- and 4-grams."""
    shift = np.uint64(64 - bits)
    mix = np.uint64(0x9E3779B97F4A7C15)
    found = []
    if len(ids):
        h = np.array([zlib.crc32(w) for w in distinct], np.uint64)[ids]
        found.append((h * mix) >> shift)
        if len(h) > 1:
            found.append(((h[:-1] * np.uint64(31) + h[1:] + np.uint64(1 << 40)) * mix) >> shift)
    c = cps.astype(np.uint64)
    three = (c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:] if len(c) > 2 else c[:0]
    if len(three):
        found.append(((three ^ np.uint64(0x5BD1E995)) * mix) >> shift)
    if len(three) > 1:
        found.append((((three[:-1] * mix) ^ c[3:]) * mix) >> shift)
    return [x.astype(np.int64) for x in found]


def features(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sparse feature vector: bucket numbers and family-wise relative frequencies."""
    ids, distinct = word_ids(utf8(text).split())
    found = buckets(ids, distinct, code_points(text), bits)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0)
    where = np.concatenate(found)
    value = np.concatenate([np.full(len(x), 1.0 / len(x)) for x in found])
    index, inverse = np.unique(where, return_inverse=True)
    return index, np.bincount(inverse, value)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -50, 50)))


def fit_logistic(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, cfg: Config) -> tuple[np.ndarray, float]:
    """Mini-batch Adam on the bounded sample, in its given order."""
    dim = 1 << cfg.bits
    w, m, v = np.zeros(dim), np.zeros(dim), np.zeros(dim)
    b = mb = vb = 0.0
    step = 0
    order = np.random.default_rng(0)
    for _ in range(cfg.epochs):
        for part in np.array_split(order.permutation(len(rows)), max(1, len(rows) // cfg.batch)):
            index = np.concatenate([rows[i][0] for i in part])
            value = np.concatenate([rows[i][1] for i in part])
            owner = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            error = _sigmoid(np.bincount(owner, value * w[index], len(part)) + b) - labels[part]
            g = np.bincount(index, value * error[owner], dim) / len(part) + cfg.l2 * w
            gb = float(error.mean())
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            up, down = 1 - 0.9**step, 1 - 0.99**step
            w = w - cfg.rate * (m / up) / (np.sqrt(v / down) + 1e-6)
            b -= cfg.rate * (mb / up) / (np.sqrt(vb / down) + 1e-6)
    return w, b


def fit_platt(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the calibration, by Newton steps on smoothed targets."""
    pos, neg = float(labels.sum()), float(len(labels) - labels.sum())
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(labels > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([logits, np.ones_like(logits)], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(x @ theta)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        delta = np.linalg.solve(h, x.T @ (p - target) + 1e-3 * (theta - [1.0, 0.0]))
        theta = theta - np.clip(delta, -1, 1)
        if np.abs(delta).max() < 1e-8:
            break
    return float(max(theta[0], 1e-6)), float(theta[1])


def labelled_sample(documents: DataFrame, labels: DataFrame, cfg: Config) -> DataFrame:
    """Bounded training sample (doc_id, label, part, text): `rows_per_class` of
    each label to fit and `calibration_rows` others to calibrate, in md5 order.
    The id table has a fixed bound, so it may be broadcast."""
    known = (
        labels.select("doc_id", F.col("quality").cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (crc32_mod("doc_id", cfg.fold_of) != 0))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
        .withColumn("at", F.md5(F.col("doc_id").cast("string").cast("binary")))
        .withColumn("for_fit", F.substring("at", 1, 1) > "3")
    )
    parts = [
        known.where(F.col("for_fit") & (F.col("label") == y)).orderBy("at").limit(cfg.rows_per_class) for y in (0, 1)
    ] + [known.where(~F.col("for_fit")).orderBy("at").limit(cfg.calibration_rows)]
    ids = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return (
        documents.select("doc_id", "text")
        .join(F.broadcast(ids), "doc_id")
        .groupBy("doc_id", "label", "for_fit", "at")
        .agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    )


def train(documents: DataFrame, labels: DataFrame, cfg: Config = Config()) -> Model | None:
    """Fits and calibrates on the bounded sample; None without both labels.
    Features are made on the executors; the driver holds the sample's sparse rows
    once, as 32-bit arrays read in place."""

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t, cfg.bits) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("at", "label", "for_fit")]
                + [pa.array([m[0].astype(np.int32) for m in made], pa.list_(pa.int32())), pa.array([m[1].astype(np.float32) for m in made], pa.list_(pa.float32()))],
                names=["at", "label", "for_fit", "index", "value"],
            )

    rows = (
        labelled_sample(documents, labels, cfg)
        .mapInArrow(sparse, "at string, label int, for_fit boolean, index array<int>, value array<float>")
        .toArrow()
    )
    order = np.argsort(np.array(rows["at"].to_pylist(), object), kind="stable")
    y = np.array(rows["label"].to_pylist(), float)[order]
    fit = np.array(rows["for_fit"].to_pylist(), bool)[order]
    if not len(y) or len(set(y[fit])) < 2:
        return None
    vectors = [(rows["index"][i].values.to_numpy(), rows["value"][i].values.to_numpy()) for i in order.tolist()]
    w, b = fit_logistic([v for v, f in zip(vectors, fit) if f], y[fit], cfg)
    logits = np.array([w[i] @ v + b for i, v in vectors])
    held = ~fit if (~fit).any() else fit
    slope, offset = fit_platt(logits[held], y[held])
    return Model(w.astype(np.float32), b, slope, offset)


def quality_rules(documents: DataFrame, model: Model | None, cfg: Config = Config()) -> DataFrame:
    """Base statistics, calibrated probability and verdict of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 2**bits floats at most

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                tokens = utf8(text).split()
                ids, distinct = word_ids(tokens)
                cps = code_points(text)
                counts = base_counts(text, tokens, ids, len(distinct), cps)
                failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
                p = 1.0
                if fitted is not None:
                    logit = fitted.bias + sum(float(fitted.weights[x].mean(dtype=np.float64)) for x in buckets(ids, distinct, cps, cfg.bits))
                    p = float(_sigmoid(np.float64(fitted.slope * logit + fitted.offset)))
                out.append((*counts, failed, not failed and p >= cfg.keep_at, p))
            columns = list(zip(*out)) or [()] * 8
            yield record_batch(dict(zip(_ARROW.names, [batch.column("doc_id"), *map(list, columns)])), _ARROW)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, SCHEMA)
