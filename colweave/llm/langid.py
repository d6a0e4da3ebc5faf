"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, everything but letters becomes one kind of gap, and the n-grams of 1 to 4 characters starting at a
letter are hashed into ``BUCKETS`` counters per language. The smoothed log-probabilities are a matrix of languages by buckets, sent to
all tasks; its size does not depend on the input. Texts are scored in numpy over flat arrays of a bounded number of
characters, so a text of any length is read whole. The score is the posterior probability of the language given.

The model is fitted on a sample of about ``per_language`` labelled texts a language (hash of the id, so reruns agree); all
else covers all rows. Null text or text without a letter gets ``und`` and 0. Without any labelled row every text does. A
null id is never held out and never learned from. Ties go to the first language in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, text_of, unit_hash

BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
_CHUNK = 1 << 18
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def codes(text: str) -> np.ndarray:
    """Code points in lower case, 0 for every character that is no letter."""
    found = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(_is_letter()[found], found, 0).astype(np.uint64)


def ngrams(found: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of all n-grams that start at a letter, a bounded portion at a time."""
    longest = max(ORDERS)
    for low in range(0, len(found), _CHUNK):
        part = found[low:low + _CHUNK + longest - 1]
        starts = min(_CHUNK, len(found) - low)
        mixed = np.zeros(len(part), dtype=np.uint64)
        out = []
        for n in ORDERS:
            size = len(part) - n + 1
            if size <= 0:
                break
            mixed = (mixed[:size] + part[n - 1:n - 1 + size] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(31)
            keep = min(size, starts)
            out.append((mixed[:keep][part[:keep] > 0] >> np.uint64(40)) % np.uint64(BUCKETS))
        yield np.concatenate(out).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own = counts.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
            for buckets in ngrams(codes(text)):
                own += np.bincount(buckets, minlength=BUCKETS)
    for lang, own in counts.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at)), "bucket": pa.array(at.astype(np.int32)), "n": pa.array(own[at])})


def fit(labelled: DataFrame, per_language: int = 1500, alpha: float = 0.1) -> tuple[list[str], np.ndarray]:
    """Languages in order and their matrix of log-probabilities, from rows of doc_id, lang (not null) and text.

    The sample is about ``per_language`` texts a language, taken by hash; its counts, at most languages times buckets, go
    to the driver.
    """
    spark = labelled.sparkSession
    totals = labelled.groupBy("lang").agg(F.count("*").alias("of"))
    # a row per language, less than the matrix that all tasks get; texts are then not dealt by so few keys
    sample = labelled.join(F.broadcast(totals), "lang").where(unit_hash("doc_id") * F.col("of") < per_language)
    counted = sample.select(F.col("lang").cast("string").alias("lang"), "text").repartition(8).mapInArrow(_count, "lang string, bucket int, n long")
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(rows.column("lang").to_pylist()))
    counts = np.zeros((len(langs), BUCKETS))
    order = {x: i for i, x in enumerate(langs)}
    counts[[order[x] for x in rows.column("lang").to_pylist()], rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    smoothed = counts + alpha
    return langs, np.log(smoothed / smoothed.sum(axis=1, keepdims=True)).astype(np.float32) if langs else counts.astype(np.float32)


def _score(batches: Iterator[pa.RecordBatch], model, temperature: float) -> Iterator[pa.RecordBatch]:
    langs, matrix = model.value
    by_bucket = np.ascontiguousarray(matrix.T)
    for batch in by_bytes(batches, most=1 << 20):
        preds, scores = [], []
        found = [codes(t) for t in batch.column("text").to_pylist()]
        for one in found:
            if not langs or not one.any():
                preds.append("und")
                scores.append(0.0)
                continue
            total, n = np.zeros(len(langs)), 0
            for buckets in ngrams(one):
                total += by_bucket[buckets].sum(axis=0, dtype=np.float64)
                n += len(buckets)
            odds = (total - total.max()) / max(1.0, n * temperature)
            best = int(odds.argmax())
            preds.append(langs[best])
            scores.append(float(1 / np.exp(odds).sum()))
        yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "lang_pred": pa.array(preds), "score": pa.array(scores, type=pa.float64())})


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], row: Column, temperature: float = 0.0) -> DataFrame:
    """``row``, lang_pred and score per row of ``docs``. ``temperature`` above 0 divides the log-odds by that share of n-grams."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(row.alias("row"), text_of().alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(lambda batches: _score(batches, held, temperature), schema)
