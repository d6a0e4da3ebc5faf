"""Text quality by compression: which of two zstandard dictionaries makes a text smaller.

One dictionary is trained on blocks of good labelled texts, the other on blocks of bad ones. A text is cut into blocks of
``BLOCK`` bytes, each compressed alone with either dictionary, so a long text cannot become its own dictionary and is read
whole in bounded memory. The feature is (size with the bad dictionary - size with the good one) / bytes of the text: high for
text like the good examples, near 0 where a text is so repetitive that no dictionary matters. A logistic curve fitted on
labelled texts that no dictionary has seen turns it into the probability of label 1.

Fitting uses at most about ``per_class`` labelled documents a class (by hash of the id, so reruns agree), and of their distinct blocks
at most about ``blocks`` a class; three in four documents go to the dictionaries, the rest to the curve. Scoring covers all
rows. Null and empty texts have the feature 0. Without labels, or with one class only, every score is 0 (no label 1)
or 1. Where an id has several labels it counts as good if all are; null labels and null ids are left out. Repeated rows
are scored each; a block that repeats counts once in training. Where a class is too short for training, its blocks
themselves are the dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, raw_texts, text_of, unit_hash, written

BLOCK = 1024
_TRAIN_BLOCK = 512
_LEVEL = 3


@dataclass
class Model:
    """Dictionaries of bad and good text (empty: none) and offset and slope of the curve."""

    dictionaries: tuple[bytes, bytes]
    curve: tuple[float, float]


def blocks_of(text: bytes, size: int) -> list[bytes]:
    return [text[i:i + size] for i in range(0, len(text), size)]


def train_dictionary(blocks: list[bytes], size: int) -> bytes:
    """A zstandard dictionary; the blocks end to end where they are too few to train one."""
    try:
        return zstandard.train_dictionary(size, blocks).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(blocks)[-size:]


class Sizes:
    """Compressed sizes of texts under the model's two dictionaries."""

    def __init__(self, model: Model):
        self.packers = []
        for data in model.dictionaries:
            held = zstandard.ZstdCompressionDict(data) if data else None
            if held is not None:
                held.precompute_compress(level=_LEVEL)
            self.packers.append(zstandard.ZstdCompressor(
                level=_LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False
            ))

    def of(self, text: bytes) -> tuple[int, int]:
        cut = blocks_of(text, BLOCK)
        return tuple(sum([len(p.compress(b)) for b in cut]) for p in self.packers)


def _differences(texts: list[bytes], sizes: Sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = np.array([sizes.of(t) for t in texts], dtype=np.int64).reshape(-1, 2)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    return found[:, 0], found[:, 1], (found[:, 0] - found[:, 1]) / np.maximum(lengths, 1)


# -- training

def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches):
        for label, text in zip(batch.column("label").to_pylist(), raw_texts(batch.column("text")), strict=True):
            cut = blocks_of(text, _TRAIN_BLOCK)
            if cut:
                yield pa.RecordBatch.from_pydict({"label": pa.array([label] * len(cut), pa.int32()), "block": pa.array(cut, pa.binary())})


def _trainer(size: int):
    def train(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = sorted(bytes(b) for b in pdf["block"])
        order = np.random.default_rng(1).permutation(len(ordered))
        return pd.DataFrame({"label": [key[0]], "data": [train_dictionary([ordered[i] for i in order], size)]})

    return train


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression on one feature with a small ridge, by Newton steps that never worsen the fit."""
    scale = max(float(np.abs(x).max(initial=0)), 1e-9)
    z = np.column_stack([np.ones(len(x)), x / scale])
    ridge = np.array([1e-4, 1e-3])

    def loss(beta):
        return float((weight * np.logaddexp(0, np.where(y > 0, -1, 1) * (z @ beta))).sum() + (ridge * beta**2).sum() / 2)

    beta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -60, 60)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (weight * (y - p)) - ridge * beta)
        now = loss(beta)
        while loss(beta + step) > now and np.abs(step).max() > 1e-10:
            step = step / 2
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1] / scale)


def _calibration(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    sizes = Sizes(held.value)
    for batch in by_bytes(batches):
        _, _, difference = _differences(raw_texts(batch.column("text")), sizes)
        yield pa.RecordBatch.from_pydict({"label": batch.column("label"), "difference": pa.array(difference, pa.float64())})


def fit(
    docs: DataFrame, labels: DataFrame, per_class: int = 3000, blocks: int = 40_000, dictionary_bytes: int = 256 << 10,
) -> Model:
    """Train on ``docs`` (doc_id, text) and ``labels`` (doc_id, quality); see the module's text for the bounds.

    To the driver go two dictionaries of at most ``dictionary_bytes`` and two numbers per document of the curve's sample.
    """
    spark = docs.sparkSession
    marked = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("label"))
    counts = dict(marked.groupBy("label").count().collect())
    nothing = Model((b"", b""), (60.0 if counts.get(1) else -60.0, 0.0))
    if len(counts) < 2:
        return nothing
    share = F.when(F.col("label") == 1, per_class / counts[1]).otherwise(per_class / counts[0])
    chosen = marked.where(unit_hash("doc_id") < share)
    # about 2 * per_class rows of two numbers
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = written(rows.withColumn("curve", unit_hash(F.lit("curve"), "doc_id") < 0.25).repartition(8, "doc_id", "text"), "quality-sample")
    there = sample.groupBy("label", "curve").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    if {(r.label, r.curve) for r in there} != {(a, b) for a in (0, 1) for b in (False, True)}:
        sample = sample.select("doc_id", "text", "label", F.explode(F.array(F.lit(False), F.lit(True))).alias("curve"))  # too few to part
    cut = sample.where(~F.col("curve")).select("label", "text").mapInArrow(_cut, "label int, block binary")
    about = {label: sum((r.bytes or 0) for r in there if r.label == label) / _TRAIN_BLOCK + 1 for label in (0, 1)}
    part = F.when(F.col("label") == 1, blocks / about[1]).otherwise(blocks / about[0])
    kept = cut.where(unit_hash(F.lit("block"), "block") < part).distinct()
    trained = kept.groupBy("label").applyInPandas(_trainer(dictionary_bytes), "label int, data binary").collect()
    found = {r.label: bytes(r.data) for r in trained}
    model = Model((found.get(0, b""), found.get(1, b"")), (0.0, 0.0))
    held = spark.sparkContext.broadcast(model)
    curve = sample.where("curve").select("label", "text").mapInArrow(lambda b: _calibration(b, held), "label int, difference double").toArrow()
    y = curve.column("label").to_numpy().astype(float)
    n = np.array([max(1, (y == 0).sum()), max(1, (y == 1).sum())])
    weight = np.where(y > 0, counts[1] / n[1], counts[0] / n[0])  # classes weigh what they weigh among all labels
    model.curve = _logistic(curve.column("difference").to_numpy(), y, weight / weight.sum() * len(y))
    held.unpersist()
    return model


# -- scoring

def _score(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    model = held.value
    sizes, (a, b) = Sizes(model), model.curve
    for batch in by_bytes(batches):
        bad, good, difference = _differences(raw_texts(batch.column("text")), sizes)
        score = 1 / (1 + np.exp(-np.clip(a + b * difference, -60, 60)))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(bad), pa.array(good), pa.array(score)], names=["row", "bad_bytes", "good_bytes", "score"])


def score(docs: DataFrame, model: Model, row: Column | None = None) -> DataFrame:
    """``row`` (by default a struct of all columns), sizes under either dictionary and score per row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select((F.struct("*") if row is None else row).alias("row"), text_of().alias("text"))
    schema = T.StructType([
        rows.schema["row"], T.StructField("bad_bytes", T.LongType()), T.StructField("good_bytes", T.LongType()), T.StructField("score", T.DoubleType()),
    ])
    return rows.mapInArrow(lambda batches: _score(batches, held), schema)
