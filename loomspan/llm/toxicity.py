"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters, digits and bytes above 127 in lower case. A document's features are the distinct
unigrams, bigrams and skip-grams (one word left out), hashed to 2**bits columns. `fit` reads a bounded sample of
labelled rows (`max_rows` and `max_total` bytes of text per class, smallest hash of doc_id first) and trains with per-coordinate rates and L1
sparsity, so the weights that scoring broadcasts are a few thousand (2**bits at the very most); examples held back
from a second fit calibrate the score. `score` reads every whole text.

Null text counts as empty and gets the score of a document without features. Repeated rows are scored each.
Without labelled rows of both classes every document gets the rate of the class that is there (0.0 without labels).
An empty table gives an empty result. Columns other than doc_id and text are ignored. Repeated labels and repeated
labelled rows count once (common.labelled), so the model doesn't depend on them, nor on any order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import common as C

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, np.int8)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_PAIR, _SKIP = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    max_rows: int = 4000  # labelled rows of each class that fitting reads
    max_bytes: int = 65536  # longer labelled texts are not fitted on
    max_total: int = 1 << 25  # bytes of text of each class that fitting reads
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.1
    epochs: int = 5
    calibrate: int = 4  # each such example is held back once, and the margins of those calibrate the score


@dataclass(frozen=True)
class Model:
    index: np.ndarray  # sorted feature columns with a weight
    weight: np.ndarray
    bias: float
    bits: int


def features(data: np.ndarray, begin: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of every unigram, bigram and skip-gram occurrence of some joined texts."""
    data = _LOWER[data]
    start, end = C.word_spans(data, _WORD)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = C.span_hash(C.prefix_hash(data), start, end)
    row = np.searchsorted(begin, start, "right") - 1
    shift = np.uint64(64 - bits)
    parts = [(row, word)]
    for gap, salt in ((1, _PAIR), (2, _SKIP)):
        same = row[gap:] == row[:-gap]
        parts.append((row[gap:][same], (word[:-gap] * salt + word[gap:])[same]))
    return np.concatenate([r for r, _ in parts]), np.concatenate([(C.mix(h) >> shift).astype(np.int64) for _, h in parts])


def train(examples: list[tuple[np.ndarray, int]], s: Settings) -> Model:
    """FTRL-proximal: z and n per coordinate; a coordinate whose |z| stays within l1 has no weight."""
    z, n = np.zeros(1 << s.bits), np.zeros(1 << s.bits)
    bias_z = bias_n = 0.0
    order = np.random.default_rng(7)
    for _ in range(s.epochs):
        for k in order.permutation(len(examples)):
            x, y = examples[k]
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = np.where(np.abs(zx) <= s.l1, 0.0, (np.sign(zx) * s.l1 - zx) / ((s.beta + root) / s.alpha + s.l2))
            b = -bias_z / ((s.beta + np.sqrt(bias_n)) / s.alpha)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y
            n[x] = nx + g * g
            z[x] = zx + g - (np.sqrt(nx + g * g) - root) / s.alpha * w
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / s.alpha * b
            bias_n += g * g
    live = np.flatnonzero(np.abs(z) > s.l1)
    w = (np.sign(z[live]) * s.l1 - z[live]) / ((s.beta + np.sqrt(n[live])) / s.alpha + s.l2)
    return Model(live, w, float(-bias_z / ((s.beta + np.sqrt(bias_n)) / s.alpha)), s.bits)


def calibrated(examples: list[tuple[np.ndarray, int]], prior: float, s: Settings) -> Model:
    """Train on all; a logistic fit on margins of held-back examples, weighted to the labels' true rate, rescales them."""
    held, rest = examples[:: s.calibrate], [e for k, e in enumerate(examples) if k % s.calibrate]
    model = train(examples, s)
    if min(sum(y for _, y in held), sum(1 - y for _, y in held), sum(y for _, y in rest), sum(1 - y for _, y in rest)) < 3:
        return model
    part = train(rest, s)
    dense = np.zeros(1 << s.bits)
    dense[part.index] = part.weight
    slope, shift = C.logistic_line(np.array([dense[x].sum() + part.bias for x, _ in held]), np.array([y for _, y in held]), prior)
    return Model(model.index, model.weight * slope, model.bias * slope + shift, s.bits)


def _constant(rate: float, bits: int) -> Model:
    rate = min(max(rate, 1e-6), 1 - 1e-6)
    return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(rate / (1 - rate))), bits)


def _sampled_features(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, body = C.text_bytes(batch.column("text"))
            out: list[bytes] = []
            for a, b in C.slices(offsets):
                row, col = features(*C.joined(offsets, body, a, b), bits)
                for i in range(b - a):
                    out.append(np.unique(col[row == i]).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(out, pa.binary())], ["label", "cols"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str, settings: Settings = Settings()) -> Model:
    """Train on a bounded sample of the labelled rows of `docs`; labels: (doc_id, <label>) of the rows to learn from."""
    s = settings
    sample, prior = C.labelled(docs, labels, label, s.max_rows, s.max_bytes, s.max_total)
    if prior is None:
        return _constant(0.0, s.bits)
    rows = sample.mapInArrow(C.trimmed(_sampled_features(s.bits)), "label int, cols binary").toArrow()
    examples = sorted(zip(rows["cols"].to_pylist(), rows["label"].to_pylist()), key=lambda e: (e[1], e[0]))
    if len({y for _, y in examples}) < 2:
        return _constant(prior, s.bits)
    del rows
    model = calibrated([(np.frombuffer(c, np.int32), y) for c, y in examples], prior, s)
    del examples
    C.give_back()
    return model


def score_batches(model: Model, name: str = "score", drop: str | None = "text"):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << model.bits, np.float32)
        dense[model.index] = model.weight
        for batch in batches:
            offsets, body = C.text_bytes(batch.column("text"))
            total = np.full(len(batch), model.bias)
            for a, b in C.slices(offsets):
                row, col = features(*C.joined(offsets, body, a, b), model.bits)
                w = dense[col]
                hit = np.flatnonzero(w)
                if len(hit):
                    _, first = np.unique(row[hit] << model.bits | col[hit], return_index=True)
                    hit = hit[first]
                    total[a:b] += np.bincount(row[hit], w[hit].astype(np.float64), b - a)
            p = np.round(1 / (1 + np.exp(-np.clip(total, -35, 35))), 9)
            keep = [c for c in batch.schema.names if c != drop]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(p)], [*keep, name])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of docs; score is the probability of the label being 1."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(C.trimmed(score_batches(model)), f"doc_id {kind}, score double")


def scored(docs: DataFrame, model: Model, name: str = "__score") -> DataFrame:
    """docs with all their columns and the score."""
    return docs.mapInArrow(C.trimmed(score_batches(model, name, None)), f"{C.ddl(docs)}, `{name}` double")


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, settings: Settings = Settings()) -> DataFrame:
    """Fit on the labelled rows outside fold 0 of `folds`, score all rows: doc_id, held_out, score, predicted."""
    learn = labels.where(C.bucket_of("doc_id", folds) != 0)
    scored = score(docs, fit(docs, learn, "toxic", settings))
    return scored.select("doc_id", (C.bucket_of("doc_id", folds) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
