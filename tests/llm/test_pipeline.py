"""The pipeline, stage by stage, and the learned operators against plain Python."""

from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from colweave.llm import langid, queries, simhash, toxicity

BAD = ["vileword", "nastyterm", "slurring"]


def prose(pick, n):
    return " ".join(pick.choice(["river", "stone", "Valley", "light,", "quiet", "morning", "paper.", "window", "garden", "silver"]) + str(pick.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Awkward columns, nulls, copies, near copies, toxic texts and benchmark passages."""
    pick = random.Random(11)
    passage = prose(pick, 30)
    rows = []
    for i in range(240):
        text = prose(pick, pick.randint(20, 60))
        if i % 6 == 0:
            text += f". You {pick.choice(BAD)} {pick.choice(BAD)}! " + prose(pick, 5)
        elif i % 17 == 1:
            text += " " + passage + " and after"
        elif i % 17 == 2:
            text = passage
        rows.append((i, text, pick.choice(["en", None]), pick.choice(["a", "b", None]), len(text), f"x{i}", {"k": i}))
    rows += [(300 + i, rows[3][1], "en", "a", 1, "copy", None) for i in range(9)]
    rows += [(320, rows[4][1] + " x", "en", "b", 1, "near", None), (330, None, None, None, None, None, None), (331, "", "en", "a", 0, "", None)]
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, kv map<string,int>")
    docs.withColumnsRenamed({"row": "n:x, y", "kv": "my col"}).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] % 6 == 0)) for r in rows if r[0] < 200], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, passage), (None, "garden99 never")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def plain_toxicity(model, text):
    """A document's score with sentences, features and chain sums written out word by word."""
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    probabilities = []
    for sentence in re.split(r"(?<![^\s])[.!?]+(?![^\s])|(?<=[0-9A-Za-z\x80-\U0010ffff])[^0-9A-Za-z\x80-\U0010ffff\s]*[.!?]+", lowered):
        words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", sentence)
        scores = []
        for w in (w.encode() for w in words):
            found = [zlib.crc32(w, 1) % toxicity.BUCKETS] + [zlib.crc32(w[:k]) % toxicity.BUCKETS for k in (3, 4, 5, 6) if len(w) >= k]
            scores.append(model.offset + sum(float(model.weights[f]) for f in found))
        t = model.pairs
        for at in range(len(words)):  # sums over all tag sequences with this word toxic, and with it clean
            total = []
            for tag in (0, 1):
                sums = None
                for i, s in enumerate(scores):
                    own = [0.0 if y == 0 else s for y in (0, 1)]
                    new = own if sums is None else [own[y] + np.logaddexp(sums[0] + t[0, y], sums[1] + t[1, y]) for y in (0, 1)]
                    sums = [new[y] if i != at or y == tag else -math.inf for y in (0, 1)]
                total.append(np.logaddexp(*sums))
            probabilities.append(1 / (1 + math.exp(min(60, max(-60, total[0] - total[1])))))
    a, b, c = model.document
    top, mass = max(probabilities, default=0.0), sum(p for p in probabilities if p >= 0.5)
    return 1 / (1 + math.exp(-min(60, max(-60, a + b * top + c * math.log1p(mass)))))


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes) > 0)


def components(prints):
    """The smallest id reachable, per id."""
    least = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i, a in prints.items():
            for j, b in prints.items():
                if least[j] < least[i] and (a ^ b).bit_count() <= 2:
                    least[i], changed = least[j], True
    return least


def plain_cut(text, passage):
    """The text without the passage's windows, and the shares of hit words."""
    spans = [m.span() for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", text)]
    own, other = [text[a:b].lower() for a, b in spans], [w.lower() for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", passage)]
    windows = {tuple(other[i:i + 10]) for i in range(len(other) - 9)}
    hit = {p for i in range(len(own) - 9) if tuple(own[i:i + 10]) in windows for p in range(i, i + 10)}
    out, at = "", 0
    for p in sorted(hit):
        if p - 1 not in hit:
            out += text[at:spans[p][0]]
        at = spans[p][1]
    return out + text[at:], len(hit), len(own)


def test_pipeline_against_plain_python(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    passage = spark.read.parquet(f"{corpus}/benchmark.parquet").where("item_id = 1").first().text
    columns, given = docs.columns, {r.doc_id: r for r in docs.collect()}
    model = corpus_pipeline._toxicity_model(spark, corpus, docs)
    want = {i for i, r in given.items() if plain_toxicity(model, r.text) < queries.THRESHOLD}
    assert 150 < len(want) < len(given) and not any(b in (given[i].text or "") for i in want for b in BAD)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, corpus), "test-stage")
        if name != "token_ids":
            assert docs.columns == columns
            rows = docs.collect()
        if name == "toxicity":
            assert {r.doc_id for r in rows} == want and len(rows) == len(want) and all(given[r.doc_id] == r for r in rows)
        elif name == "simhash_near_dedup":
            least = components({i: plain_fingerprint(given[i].text) for i in want})
            want = {i for i, top in least.items() if i == top}
            assert sorted(r.doc_id for r in rows) == sorted(want) and 301 not in want and all(given[r.doc_id] == r for r in rows)
        elif name == "decontamination":
            cut = {i: plain_cut(given[i].text or "", passage) for i in want}
            kept = {i: t for i, (t, hit, n) in cut.items() if hit <= n / 2}
            assert {r.doc_id: r.text or "" for r in rows} == kept and len(kept) < len(want)
            assert all(r.n_chars == len(r.text) for r in rows if cut[r.doc_id][1])
        elif name == "mixing":
            size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
            sources = {s: sum(size(t) for i, t in kept.items() if given[i].source == s) for s in ("a", "b", None)}
            weights, goal, level = dict(zip(("a", "b", None), (5, 2, 1), strict=True)), {}, 1.5 * sum(sources.values())
            left = dict(sources)
            while left:  # full sources stop at twice their size, the others share the rest by weight
                share = level / sum(weights[s] for s in left)
                full = [s for s in left if share * weights[s] >= 2 * left[s]]
                goal |= {s: 2 * left[s] for s in full} if full else {s: share * weights[s] for s in left}
                level -= sum(2 * left[s] for s in full)
                left = {s: n for s, n in left.items() if s not in full} if full else {}
            taken = {s: sum(size(r.text) for r in rows if r.source == s) for s in sources}
            assert all(abs(taken[s] - goal[s]) <= max(60, 0.02 * goal[s]) for s in sources)
            times = {}
            for r in rows:
                times[r.doc_id] = times.get(r.doc_id, 0) + 1
                assert (r.text or "") == kept[r.doc_id]
            assert max(times.values()) <= 2
            mixed = sorted((r.doc_id, r.text or "") for r in rows)
        else:
            whole, at = Tokenizer.from_file(queries.tokenizer_file()), 0
            found = sorted(docs.collect(), key=lambda r: r.start)
            assert [r.doc_id for r in found] == [i for i, _ in mixed]
            for r, (_, text) in zip(found, mixed, strict=True):
                ids = [*whole.encode(text, add_special_tokens=False).ids, 1]
                assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
                at += len(ids)


def test_pipeline_of_nothing(spark, corpus, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{corpus}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_fingerprints_against_single_bits(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").where("doc_id > 200")
    found = simhash.fingerprints(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert found and all(r.fp % 2**64 == plain_fingerprint(r.text) for r in found)


def test_language_against_plain_counts(spark):
    pick = random.Random(3)
    rows = [(i, " ".join(pick.choice(words) for _ in range(12)), lang) for i in range(60) for lang, words in (("x", ["ába", "tok,", "Zu"]), ("y", ["lim", "ab", "zuto"]))]
    df = spark.createDataFrame([(2 * i + (lang == "y"), t, lang) for i, t, lang in rows], "doc_id long, text string, lang string")
    langs, matrix = langid.fit(df)

    def buckets(text):
        points = [ord(c) if c.isalpha() else 0 for c in text.lower()]
        for i, p in enumerate(points):
            mixed = 0
            for n in (1, 2, 3, 4):
                if p and i + n <= len(points):
                    mixed = (mixed + points[i + n - 1] + n) * 0x9E3779B97F4A7C15 % 2**64
                    mixed ^= mixed >> 31
                    yield (mixed >> 40) % langid.BUCKETS

    counts = {lang: np.full(langid.BUCKETS, 0.1) for lang in "xy"}
    for _, text, lang in rows:
        for b in buckets(text):
            counts[lang][b] += 1
    assert langs == ["x", "y"]
    for at, lang in enumerate(langs):
        assert np.allclose(matrix[at], np.log(counts[lang] / counts[lang].sum()), atol=1e-5)
    odd = spark.createDataFrame([(1, "tok zu ába!"), (2, "lim"), (3, "12 !"), (4, None), (None, "abab zuto lim" * 9000)], "doc_id long, text string")
    for r in langid.identify(odd, (langs, matrix), F.struct("doc_id", "text")).select("row.*", "lang_pred", "score").collect():
        logs = [sum(matrix[k][b] for b in buckets(r.text or "")) for k in (0, 1)]
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred == langs[int(np.argmax(logs))] and r.score == pytest.approx(1 / (1 + math.exp(-min(700, abs(logs[0] - logs[1])))), rel=1e-3)
