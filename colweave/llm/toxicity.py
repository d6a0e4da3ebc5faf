"""Toxic spans by a linear-chain conditional random field.

Every sentence is a chain of words tagged toxic or not. A word's features are its lower-cased form and its prefixes of 3 to 6
bytes, hashed into ``BUCKETS`` weights; neighbouring tags meet in a 2x2 table. Sentences end at words followed by a full stop,
exclamation or question mark, so chains are short and those of a batch are run side by side in numpy.

Documents carry labels, words do not. Word labels for training come from the documents': of the features found in toxic
documents and (nearly) none of the others, those are chosen that explain the toxic documents, and mark their words as toxic. The field is trained on the marked
sentences and a sample of unmarked ones by gradient steps; each step is a Spark job over the sample that sends one gradient
per task. Forward-backward marginals then give a probability per word. A document's score is a logistic function of its largest
marginal and the sum of its marginals of 0.5 and more; those words' places are the offending offsets.

Training uses at most about ``per_class`` documents a class (by hash of the id); scoring covers all rows and whole texts. Null
and empty texts have no words and get the score of that. Without labels, or with one class only, every score is 0 (no toxic
label) or 1. Labels repeated for an id count as toxic if one is; null labels and null ids are left out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, list_array, raw_texts, text_of, trimmed, unit_hash, written

BUCKETS = 1 << 16
_PREFIXES = (3, 4, 5, 6)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: A-Z to lower case, sentence ends to full stops, all other bytes outside words to blanks.
_FLAT = bytes(c + 32 if 65 <= c <= 90 else c if _WORD.match(bytes([c])) else 46 if chr(c) in ".!?" else 32 for c in range(256))
#: Pieces a task knows the scores of, about 250 bytes each, and bytes of text it splits at a time, about 100 bytes each.
_REMEMBERED = 200_000
_BATCH = 1 << 20


def pieces(text: bytes) -> list[bytes]:
    """The text between blanks, in lower case; full stops inside a piece part words and end sentences."""
    return text.translate(_FLAT).split()


def sentences(text: bytes) -> list[list[bytes]]:
    out, own = [], []
    for piece in pieces(text):
        for i, word in enumerate(piece.split(b".")):
            if i and own:
                out.append(own)
                own = []
            if word:
                own.append(word)
    return [*out, own] if own else out


def features(word: bytes) -> list[int]:
    """Buckets of the word and of its prefixes, counted in bytes."""
    found = [zlib.crc32(word, 1) % BUCKETS]
    so_far = 0
    for low, high in zip((0, *_PREFIXES), _PREFIXES, strict=False):
        if len(word) < high:
            break
        so_far = zlib.crc32(word[low:high], so_far)
        found.append(so_far % BUCKETS)
    return found


@dataclass
class Model:
    """Feature weights, offset, scores of tag pairs [[00, 01], [10, 11]], and offset and weights of the document score."""

    weights: np.ndarray
    offset: float
    pairs: np.ndarray
    document: tuple[float, float, float]


def _step(x: np.ndarray, pairs: np.ndarray, back: bool) -> np.ndarray:
    """Log-odds of a tag from its neighbour's, through the pair scores."""
    t = pairs.T if back else pairs
    return np.logaddexp(t[1, 1] + x, t[0, 1]) - np.logaddexp(t[1, 0] + x, t[0, 0])


def chains(emission: np.ndarray, lengths: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log-odds for sentences laid end to end; their sum is the marginal's log-odds."""
    ahead, behind = emission.astype(np.float64), np.zeros(len(emission))
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sorted_lengths = lengths[order]
    ends = starts + sorted_lengths - 1
    for t in range(1, int(sorted_lengths[0]) if len(lengths) else 0):
        n = int(np.searchsorted(-sorted_lengths, -t, side="left"))  # sentences longer than t words
        at = starts[:n] + t
        ahead[at] += _step(ahead[at - 1], pairs, back=False)
        at = ends[:n] - t
        behind[at] = _step(behind[at + 1] + emission[at + 1], pairs, back=True)
    return ahead, behind


def _odds_to_p(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


_ENDS = 1e6


class Tagger:
    """Scores words, remembering pieces seen lately; at most about ``_REMEMBERED`` of them, or those of a batch."""

    def __init__(self, model: Model):
        self.model, self.known, self.older, self.weights = model, {}, {}, model.weights.tolist()

    def _learn(self, new: set[bytes]) -> None:
        """The emissions of each piece's words; the last of a sentence is marked by adding ``_ENDS``."""
        weights, offset = self.weights, self.model.offset
        for piece in new:
            words = piece.split(b".")
            scores = []
            for i, w in enumerate(words):
                if w:
                    scores.append(offset + sum([weights[f] for f in features(w)]) + (_ENDS if i + 1 < len(words) else 0))
            self.known[piece] = tuple(scores)

    def marginals(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The probability of every word of the texts, laid end to end, and the number of words of each text."""
        split = [pieces(t) for t in texts]
        wanted = set().union(*split)
        if len(self.known) > _REMEMBERED // 2:  # pieces met again before this happens once more stay
            self.known, self.older = {}, self.known
        new = wanted.difference(self.known)
        again = {piece: self.older[piece] for piece in new if piece in self.older}
        self.known.update(again)
        self._learn(new.difference(again))
        find = self.known.__getitem__
        scores = [list(chain.from_iterable(map(find, own))) for own in split]
        counts = np.array([len(x) for x in scores], dtype=np.int64)
        emission = np.fromiter(chain.from_iterable(scores), dtype=np.float64, count=int(counts.sum()))
        last = emission > _ENDS / 2
        emission[last] -= _ENDS
        last[np.cumsum(counts)[counts > 0] - 1] = True
        lengths = np.diff(np.flatnonzero(last), prepend=-1)
        ahead, behind = chains(emission, lengths, self.model.pairs)
        return _odds_to_p(ahead + behind), counts


def summaries(p: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document the largest probability and the sum of those of 0.5 and more; 0 without words."""
    ends = np.cumsum(counts)
    filled = counts > 0
    top, total = np.zeros(len(counts)), np.zeros(len(counts))
    if filled.any():
        at = (ends - counts)[filled]
        top[filled] = np.maximum.reduceat(p, at)
        total[filled] = np.add.reduceat(np.where(p >= 0.5, p, 0.0), at)
    return top, total


def document_score(model: Model, top: np.ndarray, total: np.ndarray) -> np.ndarray:
    a, b, c = model.document
    return _odds_to_p(a + b * top + c * np.log1p(total))


# -- training

def _class_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per feature: in how many documents of either class."""
    counts = np.zeros((2, BUCKETS), dtype=np.int64)
    for batch in batches:
        for toxic, text in zip(batch.column("toxic").to_pylist(), raw_texts(batch.column("text")), strict=True):
            words = {w for s in sentences(text) for w in s}
            counts[toxic][list({f for w in words for f in features(w)})] += 1
    at = np.flatnonzero(counts.sum(axis=0))
    yield pa.RecordBatch.from_pydict({"feature": pa.array(at.astype(np.int32)), "clean": pa.array(counts[0][at]), "toxic": pa.array(counts[1][at])})


def _sequences(batches: Iterator[pa.RecordBatch], marks, plain_share: float) -> Iterator[pa.RecordBatch]:
    """Sentences as feature lists with word labels: all marked ones, and a share of the others by hash."""
    marked = marks.value
    for batch in batches:
        found, sizes, lengths, labels = [], [], [], []
        for toxic, text in zip(batch.column("toxic").to_pylist(), raw_texts(batch.column("text")), strict=True):
            for words in sentences(text):
                lists = [features(w) for w in words]
                tags = [int(bool(toxic) and any(f in marked for f in x)) for x in lists]
                if any(tags) or zlib.crc32(b" ".join(words)) < plain_share * 2**32:
                    lengths.append(len(words))
                    labels += tags
                    for x in lists:
                        sizes.append(len(x))
                        found += x
        yield pa.RecordBatch.from_pydict({
            "features": pa.array([np.array(found, dtype=np.int32)], type=pa.list_(pa.int32())), "sizes": pa.array([sizes], type=pa.list_(pa.int32())),
            "lengths": pa.array([lengths], type=pa.list_(pa.int32())), "labels": pa.array([labels], type=pa.list_(pa.int8())),
        })


def _gradient(batches: Iterator[pa.RecordBatch], state) -> Iterator[pa.RecordBatch]:
    """The gradient of the log-likelihood over a task's sentences: weights, offset and pairs in one row."""
    model, out, n_words = state.value, np.zeros(BUCKETS + 5), 0
    for batch in batches:
        for i in range(batch.num_rows):
            found, sizes, lengths, labels = (batch.column(n)[i].values.to_numpy() for n in ("features", "sizes", "lengths", "labels"))
            if not len(sizes):
                continue
            sizes, lengths, labels = sizes.astype(np.int64), lengths.astype(np.int64), labels.astype(np.float64)
            emission = model.offset + np.add.reduceat(model.weights[found], np.cumsum(sizes) - sizes)
            ahead, behind = chains(emission, lengths, model.pairs)
            miss = labels - _odds_to_p(ahead + behind)
            out[:BUCKETS] += np.bincount(found, weights=np.repeat(miss, sizes), minlength=BUCKETS)
            out[BUCKETS] += miss.sum()
            n_words += len(labels)
            last = np.zeros(len(labels), dtype=bool)
            last[np.cumsum(lengths) - 1] = True
            at = np.flatnonzero(~last)
            after = behind[at + 1] + emission[at + 1]
            scores = np.stack([np.full(len(at), model.pairs[0, 0]), model.pairs[0, 1] + after, model.pairs[1, 0] + ahead[at], model.pairs[1, 1] + ahead[at] + after])
            share = np.exp(scores - scores.max(axis=0, initial=-np.inf))
            expected = (share / share.sum(axis=0)).sum(axis=1)
            kind = (2 * labels[at] + labels[at + 1]).astype(np.int64)
            out[BUCKETS + 1:] += np.bincount(kind, minlength=4) - expected
    yield pa.RecordBatch.from_pydict({"g": pa.array([out.tobytes()], type=pa.binary()), "n": pa.array([n_words], type=pa.int64())})


def _present(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    """Per document, which of the given features occur."""
    for batch in batches:
        found = [sorted({f for s in sentences(t) for w in s for f in features(w)} & held.value) for t in raw_texts(batch.column("text"))]
        yield pa.RecordBatch.from_pydict({"found": pa.array(found, type=pa.list_(pa.int32()))})


def _cover(toxic: DataFrame, likely: set[int], least: int, times: int = 2) -> set[int]:
    """The features that explain the toxic documents of the sample: greedily, that of most documents not yet explained ``times`` over.

    Words that merely come along, as in copies of one toxic document, explain nothing that is not explained before.
    """
    held = toxic.sparkSession.sparkContext.broadcast(likely)
    found = toxic.mapInArrow(lambda batches: _present(batches, held), "found array<int>").toArrow().column("found").to_pylist()
    documents: dict[int, list[int]] = {}
    for i, present in enumerate(found):
        for f in present:
            documents.setdefault(f, []).append(i)
    open_, marks = np.full(len(found), times), set()
    gain = {f: len(x) for f, x in documents.items()}
    while gain:
        best = max(gain, key=lambda f: (gain[f], -f))
        now = int((open_[documents[best]] > 0).sum())
        if now < gain[best]:  # gains only shrink: look again before taking it
            gain[best] = now
            if now < least:
                del gain[best]
            continue
        if now < least:
            break
        marks.add(best)
        open_[documents[best]] -= 1
        del gain[best]
    return marks


def _train_field(sequences: DataFrame, steps: int, rate: float) -> Model:
    """Adagrad steps over all sequences; each job sends a gradient of fixed size from each of the sample's few partitions."""
    spark = sequences.sparkSession
    theta, squares = np.zeros(BUCKETS + 5), np.full(BUCKETS + 5, 1e-8)
    theta[BUCKETS] = -1.0
    for _ in range(steps):
        model = Model(theta[:BUCKETS], float(theta[BUCKETS]), theta[BUCKETS + 1:].reshape(2, 2), (0.0, 0.0, 0.0))
        state = spark.sparkContext.broadcast(model)
        rows = sequences.mapInArrow(lambda batches, state=state: _gradient(batches, state), "g binary, n long").collect()
        n_words = max(1, sum(r.n for r in rows))
        gradient = sum(np.frombuffer(r.g) for r in rows) / n_words - 1e-6 * theta
        squares += gradient**2
        theta = theta + rate * gradient / np.sqrt(squares)
        state.unpersist()
    return Model(theta[:BUCKETS].copy(), float(theta[BUCKETS]), theta[BUCKETS + 1:].reshape(2, 2).copy(), (0.0, 0.0, 0.0))


def _fit_document(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression with a small ridge by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(3)
    ridge = np.diag([1e-4, 1e-2, 1e-2])
    for _ in range(50):
        p = _odds_to_p(x @ beta)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta += step
        if abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1]), float(beta[2])


def _summarise(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    tagger = Tagger(held.value)
    for batch in by_bytes(batches, most=_BATCH):
        top, total = summaries(*tagger.marginals(raw_texts(batch.column("text"))))
        yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic"), "top": pa.array(top), "total": pa.array(total)})


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2500, steps: int = 30, rate: float = 0.5) -> Model:
    """Train on ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); see the module's text for the sample."""
    spark = docs.sparkSession
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sizes = dict(marked.groupBy("toxic").count().collect())
    nothing = Model(np.zeros(BUCKETS), 0.0, np.zeros((2, 2)), (60.0 if sizes.get(1) else -60.0, 0.0, 0.0))
    if len(sizes) < 2:
        return nothing
    share = F.when(F.col("toxic") == 1, per_class / sizes[1]).otherwise(per_class / sizes[0])
    chosen = marked.where(unit_hash("doc_id") < share)
    # about 2 * per_class rows of two numbers
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id").select("toxic", "text")
    sample = written(rows.repartition(8), "toxic-sample")
    counted = sample.mapInArrow(_class_features, "feature int, clean long, toxic long").groupBy("feature").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    )
    n = sample.groupBy("toxic").count().collect()
    n = {r[0]: r[1] for r in n}
    if len(n) < 2:
        return nothing
    odds = F.log(((F.col("toxic") + 0.5) / (n[1] + 1)) / ((F.col("clean") + 0.5) / (n[0] + 1)))
    least = max(3, n[1] // 250)
    likely = counted.where((F.col("toxic") >= least) & (odds > 2.5) & (F.col("clean") <= F.col("toxic") * 0.05))
    marks = _cover(sample.where("toxic = 1"), {r.feature for r in likely.select("feature").collect()}, least)
    held = spark.sparkContext.broadcast(marks)
    about = sample.agg(F.sum(F.octet_length("text")) / 60).first()[0] or 1.0  # sentences in the sample
    plain_share = min(1.0, 40.0 * per_class / about)
    sequences = written(
        sample.mapInArrow(
            lambda batches: trimmed(_sequences(batches, held, plain_share)), "features array<int>, sizes array<int>, lengths array<int>, labels array<byte>"
        ),
        "toxic-sequences",
    )
    model = _train_field(sequences, steps, rate)
    state = spark.sparkContext.broadcast(model)
    found = sample.mapInArrow(lambda batches: trimmed(_summarise(batches, state)), "toxic int, top double, total double").toArrow()
    x = np.column_stack([found.column("top").to_numpy(), np.log1p(found.column("total").to_numpy())])
    model.document = _fit_document(x, found.column("toxic").to_numpy().astype(float))
    return model


# -- scoring

def _spans(text: bytes, p: np.ndarray) -> list[tuple[int, int]]:
    """Code point ranges of the words of probability 0.5 and more."""
    at = np.flatnonzero(p >= 0.5)
    if not len(at):
        return []
    places = [m.span() for m in _WORD.finditer(text)]
    return [(len(text[:a].decode()), len(text[:b].decode())) for a, b in (places[i] for i in at)]


def _score(batches: Iterator[pa.RecordBatch], held, spans: bool) -> Iterator[pa.RecordBatch]:
    tagger = Tagger(held.value)
    for batch in by_bytes(batches, most=_BATCH):
        texts = raw_texts(batch.column("text"))
        p, counts = tagger.marginals(texts)
        columns = {"row": batch.column("row"), "score": pa.array(document_score(tagger.model, *summaries(p, counts)))}
        if spans:
            ends = np.cumsum(counts)
            found = [_spans(t, p[e - n:e]) for t, e, n in zip(texts, ends, counts, strict=True)]
            for name, i in (("starts", 0), ("ends", 1)):
                flat = np.array([s[i] for x in found for s in x], dtype=np.int64)
                columns[name] = list_array(flat, [len(x) for x in found], pa.int64())
        yield pa.RecordBatch.from_pydict(columns)


def score(docs: DataFrame, model: Model, row: Column | None = None, spans: bool = False) -> DataFrame:
    """``row`` (by default a struct of all columns) and score per row, with ``spans`` also the toxic words' offsets."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct("*").alias("row")) if row is None else docs.select(row.alias("row"), text_of().alias("text"))
    more = [T.StructField(n, T.ArrayType(T.LongType())) for n in ("starts", "ends")] if spans else []
    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType()), *more])
    return rows.mapInArrow(lambda batches: trimmed(_score(batches, held, spans)), schema)
