"""Quality: a compression classifier with one zstandard dictionary per class.

`fit` takes a bounded sample of labelled rows (`max_rows` per class, smallest hash of doc_id first; texts of more than
`max_bytes` are not fitted on), builds a dictionary from the good texts and one from the bad ones, and fits a logistic
line to the normalised difference of the sizes on rows that built no dictionary. `score` compresses every whole text,
cut into blocks of `block` bytes, with either dictionary: (bad - good) / length over all its blocks. Text that repeats
itself compresses well with either and so gains little from the good dictionary.

Null text counts as empty; an empty text has no difference and gets the calibrated score of 0. Repeated rows are
scored each. Without labelled rows of both classes all rows get the rate of the class that is there (0.5 without
labels). An empty table gives an empty result. Columns other than doc_id and text are ignored. Repeated labels and
repeated labelled rows count once (common.labelled), so the model doesn't depend on them, nor on any order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import common as C


@dataclass(frozen=True)
class Settings:
    max_rows: int = 1500  # labelled rows of each class that fitting reads
    max_bytes: int = 16384
    dict_bytes: int = 32_768
    block: int = 1024
    level: int = 3
    calibrate: int = 3  # each such row calibrates, the others build dictionaries


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    shift: float
    block: int
    level: int


def dictionary(texts: list[bytes], s: Settings) -> bytes:
    """A trained dictionary, or the texts' own bytes where they are too few to train on."""
    blocks = [t[i : i + s.block] for t in texts for i in range(0, len(t), s.block)]
    try:
        return zstandard.train_dictionary(s.dict_bytes, [b for b in blocks if len(b) >= 8]).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-s.dict_bytes :]


class Sizer:
    """Sizes of a text under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes, block: int, level: int):
        self.block, self.coders = block, []
        for raw in (good, bad):
            d = zstandard.ZstdCompressionDict(raw) if raw else None
            if d is not None:
                d.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def difference(self, text: bytes) -> float:
        if not len(text):
            return 0.0
        good, bad = (sum(len(c.compress(text[i : i + self.block])) for i in range(0, len(text), self.block)) for c in self.coders)
        return (bad - good) / len(text)


def fit(docs: DataFrame, labels: DataFrame, label: str, settings: Settings = Settings()) -> Model:
    s = settings
    sample, prior = C.labelled(docs, labels, label, s.max_rows, s.max_bytes, s.max_rows * s.max_bytes)
    prior = min(max(0.5 if prior is None else prior, 1e-6), 1 - 1e-6)
    rows = sample.toPandas()
    examples = sorted((int(y), bytes(t)) for y, t in zip(rows["label"], rows["text"]))
    np.random.default_rng(5).shuffle(examples)
    held, rest = examples[:: s.calibrate], [e for k, e in enumerate(examples) if k % s.calibrate]
    if len({int(y) for y, _ in rest}) < 2 or len({int(y) for y, _ in held}) < 2:
        return Model(b"", b"", 0.0, float(np.log(prior / (1 - prior))), s.block, s.level)
    # Rows that built no dictionary calibrate: classes are sampled unevenly, so each row stands for its share of the labels.
    sizer = Sizer(*_dictionaries(rest, s), s.block, s.level)
    x, y = np.array([sizer.difference(t) for _, t in held]), np.array([int(y) for y, _ in held])
    slope, _ = C.logistic_line(x, y, prior)
    rare = 1 if y.mean() > 0 and prior / y.mean() > (1 - prior) / (1 - y.mean()) else 0
    times = np.where(y == rare, max(1, round((prior / y.mean()) / ((1 - prior) / (1 - y.mean())) if rare else ((1 - prior) / (1 - y.mean())) / (prior / y.mean()))), 1)
    cut = C.best_cut(np.repeat(x, times), np.repeat(y, times))
    return Model(*_dictionaries(examples, s), slope, -slope * cut, s.block, s.level)


def _dictionaries(examples: list, s: Settings) -> tuple[bytes, bytes]:
    """(good, bad), built from as many bytes each, lest the larger class compress better for its size alone."""
    good, bad = ([t for y, t in examples if int(y) == k] for k in (1, 0))
    limit = max(1 << 18, min(sum(map(len, good)), sum(map(len, bad))))
    return tuple(dictionary(texts[: int(np.searchsorted(np.cumsum([len(t) for t in texts]), limit)) + 1], s) for texts in (good, bad))


def _score_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        sizer = Sizer(m.good, m.bad, m.block, m.level)
        for batch in batches:
            offsets, body = C.text_bytes(batch.column("text"))
            body = memoryview(body)
            d = np.array([sizer.difference(body[offsets[i] : offsets[i + 1]]) for i in range(len(batch))], float)
            p = np.round(1 / (1 + np.exp(-np.clip(d * m.slope + m.shift, -35, 35))), 9)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score): the probability of label 1. The two dictionaries (64 KB) are broadcast."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(_score_batches(shared), f"doc_id {kind}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, settings: Settings = Settings()) -> DataFrame:
    """Fit on the labelled rows outside fold 1 of `folds`, score all rows: doc_id, held_out, score, predicted."""
    scored = score(docs, fit(docs, labels.where(C.bucket_of("doc_id", folds) != 1), "quality", settings))
    return scored.select("doc_id", (C.bucket_of("doc_id", folds) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
