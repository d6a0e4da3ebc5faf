"""The compression classifier: held-out accuracy, the curve, awkward rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from colweave.llm import quality, queries

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labelled(spark):
    pick = random.Random(1)
    words = ["".join(pick.choice("aeiourstlnm") for _ in range(pick.randint(2, 8))) for _ in range(300)]
    rows = []
    for i in range(240):
        good = i % 3 > 0
        text = " ".join(pick.choice(words) + ("" if good else pick.choice(["###", "%%%", "$$$"])) for _ in range(pick.randint(30, 200)))
        rows.append((i, text, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_separates_and_repeats(labelled):
    docs, labels = labelled.select("doc_id", "text"), labelled.select("doc_id", "quality")
    first = quality.fit(docs, labels.where("doc_id < 180"))
    again = quality.fit(docs.repartition(5), labels.where("doc_id < 180").repartition(3))
    assert first == again
    rows = quality.score(labelled, first).select("row.*", "score", "bad_bytes", "good_bytes").where("doc_id >= 180").collect()
    assert all((r.score >= 0.5) == (r.quality == 1) for r in rows)
    for r in rows[:10]:  # sizes are those of blocks compressed alone
        for data, size in zip(first.dictionaries, (r.bad_bytes, r.good_bytes), strict=True):
            packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(data), write_content_size=False, write_dict_id=False)
            text = r.text.encode()
            assert size == sum(len(packer.compress(text[i:i + quality.BLOCK])) for i in range(0, len(text), quality.BLOCK))


def test_awkward_rows(spark, labelled):
    model = quality.fit(labelled.select("doc_id", "text"), labelled.select("doc_id", "quality"))
    rows = [(1, None, 0.0), (2, "", 0.0), (2, "", 0.0), (None, "no id", 0.0), (3, "aeiou " * 100_000, 0.0), (4, "日本 😀", 0.0)]
    got = quality.score(spark.createDataFrame(rows, "doc_id long, text string, score double"), model).select("row.doc_id", F.col("score").alias("s")).collect()
    assert len(got) == len(rows) and all(0 <= r.s <= 1 for r in got)
    empty = 1 / (1 + math.exp(-model.curve[0]))
    assert [r.s for r in got if r.doc_id == 2] == pytest.approx([empty, empty])
    odd = labelled.select(F.col("text"), "doc_id", F.lit(1).alias("my col"), F.lit(2).alias("n:x"))
    assert quality.score(odd, model).select("row.*").columns == odd.columns
    assert quality.score(odd.where("false"), model).collect() == []


def test_few_labels(spark, labelled):
    docs, labels = labelled.select("doc_id", "text"), labelled.select("doc_id", "quality")
    for some, expected in ((labels.where("false"), 0), (labels.where("quality = 1"), 1), (labels.where("quality = 0"), 0)):
        scores = {round(r.score) for r in quality.score(docs, quality.fit(docs, some)).collect()}
        assert scores == {expected}
    awkward = spark.createDataFrame([(0, 1), (0, 0), (1, 1), (None, 0), (2, None), (999, 1)], "doc_id long, quality int")
    model = quality.fit(docs, awkward)  # 0 is bad, 1 is good, each in the dictionary and under the curve
    assert model.dictionaries[0] and model.dictionaries[1] and model.curve[1] > 0
    nowhere = spark.createDataFrame([(998, 0), (999, 1)], "doc_id long, quality int")
    assert {0 <= r.score <= 1 for r in quality.score(docs, quality.fit(docs, nowhere)).collect()} == {True}


def test_held_out(spark):
    found = queries.op13_quality(spark, SF_DIR).join(spark.read.parquet(f"{SF_DIR}/labels.parquet"), "doc_id").where("held_out").collect()
    right = np.mean([r.predicted == r.quality for r in found])
    assert len(found) > 50 and right >= 0.95
