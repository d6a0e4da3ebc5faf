"""Operators on awkward rows, against brute force."""

from __future__ import annotations

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colweave.llm import chat, decontaminate, exact_dedup, langid, mixing, pii, queries, simhash, tokens, toxicity, warc
from colweave.scratch import fresh_dir

LONG = "word " * 30_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank", "en", "a", 1),
    (2, "The quick brown fox jumps over the lazy dog near the river bank", "en", "a", 2),
    (2, "The quick brown fox jumps over the lazy dog near the river bank", "en", "a", 2),
    (3, None, None, None, 3), (4, "", "en", "b", 4), (5, " \t\n", None, "b", 5), (6, LONG, "en", "a", 6),
    (7, "Größe ÄÖÜ ß ñ × 日本 it's 12.5% <|endoftext|> A.b,", "de", None, 7), (None, "no id here", "en", "c", 8),
    (9, "mail a@b.co, c@d@e.fg x@y.z_q@r.st 1.2.3.4.5.6.7.8 300.1.1.1 card 4111 1111 1111 1111 call +1 (555) 010-9999 "
        "iban DE89 3704 0044 0532 0130 00 ssn 123-45-6789 " + "7" * 40, "en", "c", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, fp long, `row` int, node string"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, repeats, and columns named like the operators' own."""
    return spark.createDataFrame([(*r, 0, "x") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_tokens_round_trip(spark, docs, none):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.tokenizer_file())
    for encoding in ("delta", "dictionary"):
        path = fresh_dir(spark, "t")
        tokens.write_tokens(docs, path, queries.tokenizer_file(), 1, keep=("lang",), encoding=encoding, page_rows=3)
        rows = tokens.read_tokens(spark, path, ("doc_id", "start", "n_tokens", "ids", "meta")).collect()
        assert len(rows) == len(ROWS)
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.n_tokens == len(r.ids)
            at += r.n_tokens
        ordered = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
        assert ordered == sorted(ordered, key=lambda i: -1 if i is None else i)
        assert sorted(r.ids for r in rows) == sorted(whole.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in ROWS)
        assert {r.doc_id for r in tokens.read_tokens(spark, path, ("doc_id",), 4, 6).collect()} == {4, 5, 6}
        digests = {(r.doc_id, r.start): r.ids_crc32 for r in tokens.token_digests(spark, path).collect()}
        assert all(digests[r.doc_id, r.start] == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows)
    path = fresh_dir(spark, "t")
    tokens.write_tokens(none, path, queries.tokenizer_file())
    assert tokens.read_tokens(spark, path).count() == 0


def test_tokens_file_format(spark, docs):
    import glob

    import pyarrow.parquet as pq

    path = fresh_dir(spark, "t")
    tokens.write_tokens(docs, path, queries.tokenizer_file())
    file = max(glob.glob(f"{path.removeprefix('file:')}/data/*.parquet"), key=lambda f: pq.ParquetFile(f).metadata.num_rows)
    group = pq.ParquetFile(file).metadata.row_group(0)
    ids = next(group.column(i) for i in range(group.num_columns) if group.column(i).path_in_schema.startswith("ids"))
    assert "DELTA_BINARY_PACKED" in ids.encodings and ids.has_offset_index


def test_encoder_against_library():
    from tokenizers import Tokenizer

    spec = open(queries.tokenizer_file(), encoding="utf-8").read()
    whole, own = Tokenizer.from_str(spec), tokens.Encoder(spec)
    pick = random.Random(1)
    alphabet = "abYZ .,'sS0é×ÿß\t\n\x1c\x85\xa0日́<|>-"
    texts = ["".join(pick.choice(alphabet) for _ in range(pick.randrange(40))) for _ in range(300)]
    assert own.short_way
    texts += ["", " ", "  a  ", "<|endoftext|> x<|startoftext|>", "e\u0301 \u0301e", "ΑΣ ΣΑΣ", "a\x00b", "'s 't'll don't 12"]
    assert own.encode(texts) == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    alike = json.loads(spec)  # a tokenizer of another kind goes to the library whole
    alike["normalizer"] = None
    other = tokens.Encoder(json.dumps(alike))
    assert not other.short_way
    assert other.encode(texts) == [x.ids for x in Tokenizer.from_str(json.dumps(alike)).encode_batch(texts, add_special_tokens=False)]


def test_encoder_of_many_words():
    from tokenizers import Tokenizer

    spec = open(queries.tokenizer_file(), encoding="utf-8").read()
    whole, own = Tokenizer.from_str(spec), tokens.Encoder(spec)
    pick = random.Random(10)
    words = ["".join(pick.choice("abcdeé") for _ in range(6)) for _ in range(200)]
    for n in (5, 100, 0, 18, 15, 200, 3, 21, 20, 60):
        texts = [" ".join(pick.sample(words, n)) + " same" for _ in range(3)]
        assert own.encode(texts) == [whole.encode(t, add_special_tokens=False).ids for t in texts]


PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and _luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def _luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def test_pii_against_plain_patterns(spark, docs, none):
    pick = random.Random(2)
    texts = ["".join(pick.choice("aB1234567890.@+- ()_%é") for _ in range(pick.randrange(80))) for _ in range(400)]
    texts += ["".join(pick.choice("0123 -") for _ in range(60)) for _ in range(400)]
    texts += ["1" * 3_000, "1 " * 3_000, "a." * 3_000 + "@b.c", "+1" + "2 " * 3_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(10_000 + i, r[1]) for i, r in enumerate(ROWS)]
    found = pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", "spans").collect()
    by_id = {r.doc_id: r.spans for r in found}
    for i, text in rows:
        want = [(k, m.start(), m.end()) for k, p, ok in PLAIN for m in re.finditer(p, text or "") if ok(m.group(0))]
        assert [(s.kind, s.start, s.end) for s in by_id[i] if s.kind in pii.BASE] == want
        assert all(s.value == text[s.start:s.end] for s in by_id[i])
    assert {s.kind for s in by_id[10_009]} == {"email", "ip", "card", "phone", "iban", "ssn"}
    assert pii.find_spans(none).count() == 0 and pii.find_spans(docs).count() == len(ROWS)


def _spans(spark, texts, kind):
    found = pii.find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("row.doc_id", "spans").collect()
    by_id = {r.doc_id: [s for s in r.spans if s.kind == kind] for r in found}
    assert all(s.value == t[s.start:s.end] for i, t in enumerate(texts) for s in by_id[i])
    return [[s.value for s in by_id[i]] for i in range(len(texts))]


def _iban(country: str, body: str) -> str:
    rest = int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97
    return f"{country}{98 - rest:02d}{body}"


def test_iban_before_capitals_and_digits(spark):
    be, es = "BE68 5390 0754 7034", "ES91 2100 0418 4502 0005 1332"
    mt, no, other = "MT84 MALT 0110 0001 2345 MTLC AST0 01S", "NO93 8601 1117 947", _iban("ZZ", "12345678901234567890")
    other = " ".join(other[i:i + 4] for i in range(0, 24, 4))
    ibans = [be, es, mt, no, other, "DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "BE68539007547034", "DE89370400440532013000"]
    behind = ["", " BIC GEBABEBB", " 100 EUR", " BANK", " Thanks", " T", " 1234 5678 9012", ". A", ", 12", " é", " BANK BANK BANK BANK BANK BANK BANK", "\nABCD"]
    texts = [f"é pay {i}{b}" for i in ibans for b in behind]
    assert _spans(spark, texts, "iban") == [[i] for i in ibans for _ in behind]
    assert _spans(spark, [f"{be} {be} {es} AB13 {be}", "BE69 5390 0754 7034 BANK", f"x{be}", f"{be}5", "AB12 CD34 EF56 " + be, "AB12 " * 5_000], "iban") == [
        [be, be, es, be], [], [], [], [be], []
    ]


def test_ssn_list_behind_one_word(spark):
    near = "321-54-9876, 222-33-4444"
    texts = [
        "SSN 123-45-6789, " + near, "SSN 000-45-6789, " + near, f"{near} tax id", "123-45-6789\n" * 5 + "ssn", "ssn" + " " * 36 + "\n123-45-6789",
        "ssn" + " " * 38 + "123-45-6789", "123-45-6789" + " " * 17 + "ssn", "123-45-6789" + " " * 18 + "ssn", "SSN 123-45-6789" + " 日𝄞" * 8 + " 321-54-9876",
    ]
    a, b, c = "123-45-6789", "321-54-9876", "222-33-4444"
    assert _spans(spark, texts, "ssn") == [[a, b, c], [b, c], [b, c], [a, a], [a], [], [a], [], [a, b]]


def test_pii_of_many_spans_is_not_squared(spark):
    """A log of thousands of addresses: all found in their places, in time that grows with their number."""
    import time

    took = {}
    for n in (500, 4000, 16_000):
        text = " ".join(f"10.{i // 65536}.{i // 256 % 256}.{i % 256}" for i in range(n))
        made = spark.createDataFrame([(1, text)], "doc_id long, text string")
        start = time.perf_counter()
        spans = pii.find_spans(made).first().spans
        took[n] = time.perf_counter() - start
        assert [s.value for s in spans] == text.split(" ") and all(text[s.start:s.end] == s.value for s in spans[::97])
    assert took[16_000] < 8 * took[4000] + 1


def _hits(text: str, items: list[tuple[int, str]]):
    """Hit word positions and item names the slow way."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    own, hit, names = cut(text), set(), set()
    for name, item in items:
        other = cut(item)
        k = min(10, len(other))
        windows = {tuple(other[i:i + k]) for i in range(len(other) - k + 1)} if k else set()
        for i in range(len(own) - k + 1):
            if k and tuple(own[i:i + k]) in windows:
                hit |= set(range(i, i + k))
                names.add(str(name))
    return len(own), hit, sorted(names - {"None"})


@pytest.mark.parametrize("block_words", [150_000, 20])
def test_contamination_against_windows(spark, docs, none, block_words):
    pick = random.Random(3)
    text = lambda n: " ".join(pick.choice("aBcd") for _ in range(n))
    items = [(i, text(pick.randrange(1, 30))) for i in range(6, 24)] + [(30, None), (31, ""), (32, "Z z z"), (None, "a b"), (33, "Z z z")]
    rows = [(i, text(pick.randrange(60))) for i in range(60)] + [(90, "x z Z z y"), (91, None), (90, "x z Z z y")]
    made = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(*made, block_words=block_words).collect()
    got = sorted((r.row, r.n_words, sorted(set().union(*(range(s, e) for s, e in zip(r.starts, r.ends, strict=True)))), list(r["items"])) for r in found)
    want = sorted((i, n, sorted(h), names) for i, t in rows for n, h, names in [_hits(t, items)])
    assert got == want
    assert decontaminate.contamination(none, made[1]).count() == 0
    empty = decontaminate.decontaminate(docs, made[1].where("false"))
    assert empty.columns == docs.columns and empty.count() == len(ROWS)


def test_decontaminate_cuts(spark):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(1, "Keep this, " + item.upper() + "! and that" + " more words" * 10, 0), (2, item, 5), (3, "clean  text ", 12)]
    out = decontaminate.decontaminate(
        spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), spark.createDataFrame([(1, item)], "item_id long, text string")
    )
    kept = {r.doc_id: r for r in out.collect()}
    assert kept.keys() == {1, 3} and kept[3].text == "clean  text " and kept[3].n_chars == 12
    assert kept[1].text == "Keep this, ! and that" + " more words" * 10 and kept[1].n_chars == len(kept[1].text)


def test_decontaminate_in_one_worker_a_task(spark):
    """Each further Python step of a stage holds a worker of its own, which stays with the executor after it."""
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(1, "Keep this, " + item.upper() + "! and that" + " more words" * 10, 0), (2, item, 5), (3, "clean  text ", 12), (4, None, None)]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), spark.createDataFrame([(1, item), (2, "and that")], "item_id long, text string")
    out = decontaminate.decontaminate(docs, items)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    by_blocks = decontaminate.contamination(docs, items, block_words=3, whole=True)
    one_block = decontaminate.contamination(docs, items, whole=True)
    assert sorted(map(str, by_blocks.collect())) == sorted(map(str, one_block.collect()))
    assert {r.row.doc_id: r.cut for r in one_block.collect()} == {1: "Keep this, " + " more words" * 10, 2: "", 3: None, 4: None}


def test_language(spark, docs, none):
    labelled = [(i, "en", "the house and the garden with other things") for i in range(20)]
    labelled += [(100 + i, "de", "das Haus und der Garten mit anderen Dingen") for i in range(20)]
    model = langid.fit(spark.createDataFrame(labelled, "doc_id long, lang string, text string"))
    rows = [(1, "the garden"), (2, "der Garten und"), (3, None), (4, "12 ...")]
    found = langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model, F.col("doc_id")).collect()
    assert {r.row: r.lang_pred for r in found} == {1: "en", 2: "de", 3: "und", 4: "und"}
    assert all(0 <= r.score <= 1 for r in found)
    unlearned = langid.fit(none.select("doc_id", "lang", "text"))
    assert {r.lang_pred for r in langid.identify(docs, unlearned, F.col("doc_id")).collect()} == {"und"}


def test_mixing(spark, docs, none):
    pick = random.Random(4)
    rows = [(i, "w " * pick.randrange(0, 60), pick.choice(["a", "a", "a", "b", "c", None])) for i in range(600)] + [(5, "w w", "b")] * 3
    made = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.copies(mixing.sizes_of(made)).collect()
    assert len(found) == len(rows) and all(0 <= r.copies <= 2 for r in found)
    sizes, taken, targets = {}, {}, {}
    for r in found:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r["size"] * r.copies
        targets[r.source] = r.target
    weights, free, left, want = {"a": 5, "b": 2, "c": 1, None: 5}, {"a", "b", "c", None}, 1.5 * sum(sizes.values()), {}
    while over := [s for s in free if weights[s] * left / sum(weights[x] for x in free) > 2 * sizes[s]]:
        for s in over:
            want[s] = 2 * sizes[s]
            free.discard(s)
        left = 1.5 * sum(sizes.values()) - sum(want.values())
    want |= {s: weights[s] * left / sum(weights[x] for x in free) for s in free}
    assert targets == pytest.approx(want) and all(abs(taken[s] - want[s]) <= 60 for s in want)
    assert sorted(map(tuple, mixing.copies(mixing.sizes_of(made)).collect()), key=repr) == sorted(map(tuple, found), key=repr)
    assert mixing.mix(made).count() == sum(r.copies for r in found)
    assert mixing.mix(none).count() == 0 and mixing.mix(docs).columns == docs.columns


def test_toxicity(spark, docs, none):
    pick = random.Random(5)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(5))
    rows, labels = [], []
    for i in range(300):
        own = [word() for _ in range(40)]
        if i % 3 == 0:
            own[5], own[20] = pick.choice(["zorkan", "Zorkel"]), "quuxet"
        rows.append((i, " ".join(own) + "."))
        labels.append((i, int(i % 3 == 0)))
    made = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(made.where("doc_id < 200"), spark.createDataFrame([*labels, (1, None), (None, 1)], "doc_id long, toxic int"))
    found = {r.row: r for r in toxicity.score(made, model, F.col("doc_id"), spans=True).collect()}
    assert all((found[i].score >= 0.7) == (i % 3 == 0) for i in range(300))
    assert [rows[3][1][s:e] for s, e in zip(found[3].starts, found[3].ends, strict=True)] == [rows[3][1].split()[k].strip(".") for k in (5, 20)]
    assert toxicity.score(docs, model).count() == len(ROWS) and toxicity.score(none, model).count() == 0
    untaught = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert max(r.score for r in toxicity.score(docs, untaught).collect()) < 0.01


def test_toxicity_memory():
    """What scoring holds follows the part of the texts at work, not the batch or the number of different words."""
    import tracemalloc
    from types import SimpleNamespace

    pick = random.Random(8)
    texts = [" ".join(f"{pick.randrange(10**9):x}" for _ in range(1000)) + "." for _ in range(600)]
    batch = pa.RecordBatch.from_pydict({"row": pa.array(range(600)), "text": pa.array(texts)})
    held = SimpleNamespace(value=toxicity.Model(np.zeros(toxicity.BUCKETS), -3.0, np.zeros((2, 2)), (0.0, 1.0, 1.0)))
    tracemalloc.start()
    try:
        out = [r for b in toxicity._score(iter([batch]), held, False) for r in b.column("row").to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert out == list(range(600)) and peak < 100 << 20


def test_trimmed_gives_memory_back():
    """In a process of its own: after the last batch the freed pieces below a live one no longer count for the worker."""
    program = """
import sys
import pyarrow as pa
from colweave.llm import common

kept = []

def pages():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1])

def work(batches):
    for batch in batches:
        pieces = [bytes(2000) for _ in range(100_000)]
        kept.append(bytes(2000))
        yield batch

before = pages()
one = pa.RecordBatch.from_pydict({"a": pa.array([1])})
assert [b.num_rows for b in getattr(common, "trimmed", iter)(work(iter([one])))] == [1]
print((pages() - before) * 4096 >> 20)
"""
    import pathlib
    import subprocess
    import sys

    top = str(pathlib.Path(decontaminate.__file__).parents[2])
    grown = int(subprocess.run([sys.executable, "-c", program], cwd=top, capture_output=True, text=True, check=True, timeout=60).stdout)
    assert grown < 50


def test_chains_against_enumeration():
    import itertools

    rng = np.random.default_rng(6)
    lengths, pairs = np.array([3, 1, 5]), rng.normal(size=(2, 2))
    emission = rng.normal(size=9)
    ahead, behind = toxicity.chains(emission, lengths, pairs)
    at = 0
    for n in lengths:
        mass = np.zeros((n, 2))
        for tags in itertools.product((0, 1), repeat=int(n)):
            weight = np.exp(sum(emission[at + i] * t for i, t in enumerate(tags)) + sum(pairs[a, b] for a, b in itertools.pairwise(tags)))
            for i, t in enumerate(tags):
                mass[i, t] += weight
        assert (ahead + behind)[at:at + n] == pytest.approx(np.log(mass[:, 1] / mass[:, 0]))
        at += n


def test_warc_round_trip(spark):
    big = "<html>" + "é" * 900
    rows = [(1, "http://a", big), (2, None, None), (5, "http://b\r\nX: y", big), (5, "http://b", big), (7, "u", "small"), (9, "u", "small"), (None, "n", big), (8, "u", "")]
    made = spark.createDataFrame(rows, "page_id long, url string, html string")
    paths = [fresh_dir(spark, "w") for _ in range(2)]
    manifests = [
        sorted((r["name"], r["sha256"], r["records"]) for r in warc.write_warc(made.repartition(n), p, shard_bytes=4000, file_bytes=300).collect())
        for n, p in zip((1, 5), paths, strict=True)
    ]
    assert manifests[0] == manifests[1] and sum(m[2] for m in manifests[0]) == len(rows)
    back = warc.read_warc(spark, paths[0], with_payload=True).collect()
    want = [(p, h or "") for p, _, h in rows]
    assert sorted(((r.page_id, r.payload_digest, r.payload_bytes) for r in back), key=repr) == sorted(((p, hashlib.sha1(h.encode()).hexdigest(), len(h.encode())) for p, h in want), key=repr)
    kinds = sorted(((r.page_id, r.record_type, r.refers_to) for r in back), key=repr)
    assert kinds == sorted([(1, "revisit", 5), (2, "response", None), (5, "response", None), (5, "revisit", 5), (7, "response", None), (9, "response", None), (None, "revisit", 5), (8, "response", None)], key=repr)
    assert all(bytes(r.payload).decode() == big for r in back if r.record_type == "response" and r.payload_bytes > 1000)
    path = fresh_dir(spark, "w")
    warc.write_warc(made.where("false"), path)
    assert warc.read_warc(spark, path).count() == 0


def test_warc_shards_by_weight(spark):
    """Ids far out, at both ends of their type, and one of much weight: no shard is above twice its size, none is cut unlike another time."""
    text = lambda i, n: f"{i} " + "x" * n
    ids = [-9_000_000_000_000_000_000, *range(3000), 10**12, *range(10**12 + 5, 10**12 + 50), 9_000_000_000_000_000_000]
    rows = [(i, "u", text(i, 600)) for i in ids] + [(77, f"v{k}", text(k, 900)) for k in range(1500)] + [(None, "n", text(k, 100)) for k in range(40)]
    made = spark.createDataFrame(rows, "page_id long, url string, html string")
    paths = [fresh_dir(spark, "w") for _ in range(2)]
    listed = [sorted((r["name"], r["sha256"]) for r in warc.write_warc(made.repartition(n), p, shard_bytes=60_000, file_bytes=20_000).collect()) for n, p in zip((1, 6), paths, strict=True)]
    assert listed[0] == listed[1]
    sizes = {}
    for r in warc.read_warc(spark, paths[0]).withColumn("n", F.col("payload_bytes") + 400).collect():
        sizes[r.page_id] = sizes.get(r.page_id, 0) + 1
    assert sum(sizes.values()) == len(rows) and sizes[77] == 1501 and sizes[None] == 40
    digest = F.sha1(F.col("html").cast("binary"))
    cut = warc._shards(made.select("page_id", digest.alias("digest"), F.octet_length("html").alias("size")), 60_000)
    placed = warc._in_cells(made.withColumn("digest", digest), cut).groupBy("shard").agg(F.sum(F.octet_length("html") + 400).alias("w")).collect()
    assert len(placed) > 40 and max(r.w for r in placed) <= 120_000


def test_awkward_column_names(spark):
    """Names and kinds of columns that cannot be written into a schema's text or hashed."""
    rows = [(i, f"some words here {i} and more words", "en", "a", 10, i, {"k": i}) for i in range(30)] + [(30, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, m int, kv map<string,int>")
    docs = docs.withColumnsRenamed({"m": "n:x, y", "kv": "my `col`"})
    items = spark.createDataFrame([(None, "words here 7")], "item_id long, text string")
    assert decontaminate.decontaminate(docs, items).columns == docs.columns
    assert [r[0] for r in decontaminate.contamination(docs, items).where("size(starts) > 0").collect()] == [7]
    assert mixing.mix(docs).columns == docs.columns and mixing.mix(docs).count() >= 30
    model = toxicity.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert toxicity.score(docs, model, spans=True).select("row.*").columns == docs.columns
    path = fresh_dir(spark, "t")
    tokens.write_tokens(docs, path, queries.tokenizer_file(), 1, keep=("n:x, y", "my `col`"))
    assert spark.read.parquet(f"{path}/data").count() == 31


@pytest.mark.parametrize("node_size", [2048, 30])
def test_simhash_links_and_components(spark, node_size):
    rng = random.Random(7)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for p in list(prints):
        for _ in range(rng.randrange(4)):
            p ^= 1 << rng.randrange(64)
            prints.append(p)
    prints = sorted({*prints, 0, 1, (1 << 64) - 1, *((1 << 63) | k for k in range(40))})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    made = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    found = {tuple(sorted((r.a, r.b))) for r in simhash.links(made, 2, node_size=node_size, least_bits=3).collect()}
    want = {tuple(sorted((signed(a), signed(b)))) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 2}
    assert found == want


def test_simhash_rows(spark, docs, none):
    found = simhash.near_duplicates(docs, 3, 2).collect()
    assert len(found) == len(ROWS)
    by_id = {r.doc_id: (r.fp, r.component_id) for r in found}
    assert by_id[1] == by_id[2] and by_id[1][1] == 1 and by_id[3] == by_id[4] == by_id[5] == (0, 3)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == sorted({c or 0 for _, c in by_id.values()})
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_components(spark):
    from colweave.llm.components import components

    rng = random.Random(8)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(500, k) for k in range(501, 560)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        up[high] = low
    found = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {x: find(x) for a, b in pairs if a != b for x in (a, b)}


def test_exact_dedup(spark, docs, none):
    for history in (F.lit(True), F.lit(False), F.col("doc_id") <= 2):
        found = exact_dedup.exact_duplicates(docs, history).collect()
        assert len(found) == len(ROWS) and sum(r.kept for r in found) == len({r[1] or "" for r in ROWS})
        for r in found:
            same = [x for x in ROWS if hashlib.sha256((x[1] or "").encode()).digest() == bytes(r.digest)]
            ids = [x[0] for x in same if x[0] is not None]
            assert r.group_size == len(same) and r.keep_id == (max(ids) if ids else None)
    assert exact_dedup.exact_duplicates(none, F.lit(True)).count() == 0


@pytest.mark.parametrize("n_old", [0, 1, 2500])
def test_many_arrivals_for_a_small_history(spark, monkeypatch, n_old):
    import pandas as pd

    n, texts = 40_000, 30_000
    made = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % texts).cast("string").alias("text"))
    rows = exact_dedup.digest_rows(made)
    old, new = rows.where(f"doc_id < {n_old}"), rows.where(f"doc_id >= {n_old}")
    history, bits = exact_dedup.build_history(old)
    found = {bytes(r.digest): (r.winner, r.n) for r in exact_dedup.merge(history, bits, new).collect()}
    assert found == {hashlib.sha256(str(t).encode()).digest(): (t + texts, 2) if t + texts < n else (t, 1) for t in range(texts)}
    monkeypatch.setattr(exact_dedup, "_lookup", lambda h, asked: pd.DataFrame({"digest": [b""], "winner": [0], "n": [len(asked)]}))
    met = [r.n for r in exact_dedup.merge(history, bits, new).collect()]
    assert sum(met) in range(texts - n_old, texts + 1) and max(met) < 9_000


def test_perfect_hash():
    rng = np.random.default_rng(9)
    keys, other = (rng.integers(0, 256, size=(n, 32), dtype=np.uint8) for n in (3000, 500))
    mph = exact_dedup.PerfectHash.from_bytes(exact_dedup.PerfectHash.build(keys).to_bytes())
    assert sorted(mph.slots(keys)) == list(range(3000)) and mph.slots(other).max() < 3000


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "system", "be <|im_end|> kind"), (1, 1, "user", "<\\|x|> \\n <"), (1, 2, "assistant", "|y<|im_start|>"), (1, 3, "user", None),
        (1, 4, "assistant", ""), (1, 5, "user", "tail"), (2, 0, None, "x"), (3, 0, "we\nird\\n", "y"), (3, 0, "we\nird\\n", "y"), (None, None, "assistant", "z" * 9000),
        (4, 0, "user", "<|x"), (4, 0, "user", "<a"), (4, 1, "assistant", "<\\|"),
    ]
    made = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, example int")
    out = chat.examples(made)
    texts = out.collect()
    for r in texts:
        if r.loss_start is not None:
            assert list(chat.turns_of(r.text))[-1] == ("assistant", chat.unescape(r.text[r.loss_start:r.loss_end]))
    assert sorted((r.conv_id or 0, r.example) for r in texts) == [(0, 0), (1, 0), (1, 1), (1, 2), (2, 0), (3, 0), (4, 0)]
    found = {r.conv_id: r for r in chat.digests(out).collect()}
    for conv in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "") for r in sorted(rows, key=lambda r: (r[1] or 0, r[2] or "", r[3] or "")) if r[0] == conv]
        loss = "".join(t for role, t in own if role == "assistant")
        r = found[conv]
        assert r.n_turns == len(own) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.examples(made.where("false"))).count() == 0
