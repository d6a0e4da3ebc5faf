"""Cross-tokenizer alignment against both libraries and a count of all links."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from colweave.llm import alignment, queries

FILES = public_tokenizers.path(queries.TOKENIZER_A), public_tokenizers.path(queries.TOKENIZER_B)
TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a   b    c", "\n", "a\n b", "a \nb\n \nc", "tab\there\r\n  end  ", "nbsp  x", "  em 　 wide",
    "control \x1c \x1f x\x00y", "it's we'll 12.5% don't (can't) \"quoted\"", "Größe ÄÖÜ ß ñ × naïve", "日本 の 語 emoji 😀😀 ok", "é ä ﬁ Å",
    "literal ▁ mark", "x▁ y", "<s> </s> <0x41> <|endoftext|> <unk>", "word " * 3000, "z" * 40_000, " " * 500, "\n" * 300 + " q", "repeat me", "repeat me",
    ";,|1,2", "ɀ ɏ Ʉ ȿ", "don' t 's 's", "a\u0085 b\u0085c",
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


def brute_force(docs, a, b):
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    byte_of, n = {}, 0
    for i in range(256):
        byte_of[chr(i) if i in visible else chr(256 + n)] = i
        n += i not in visible
    per = []
    for doc_id, text in docs:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        xb = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in x]
        yb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        raw = (" " + (text or "")).encode()
        if not text or b"".join(xb) != raw or b"".join(yb) != raw:
            per.append((doc_id, [], [], [], []))
            continue
        ends = lambda parts: np.cumsum([len(p) for p in parts]).tolist()
        ex, ey = ends(xb), ends(yb)
        links, j = [], 0
        for i in range(len(x)):
            while j and ey[j - 1] > ex[i] - len(xb[i]):
                j -= 1
            while j < len(y) and ey[j] - len(yb[j]) < ex[i]:
                if ey[j] > ex[i] - len(xb[i]):
                    links.append((x[i], y[j]))
                j += 1
        groups, at = [], 0
        for end in sorted(set(ex) & set(ey)):
            groups.append(([t for t, e in zip(x, ex, strict=True) if at < e <= end], [t for t, e in zip(y, ey, strict=True) if at < e <= end]) if len(x) < 500 else None)
            at = end
        per.append((doc_id, x, y, groups, links))
    counts = Counter(p for *_, links in per for p in set(links))
    top = {}
    for (i, _), n in counts.items():
        top[i] = max(top.get(i, 0), n)
    out = []
    for doc_id, x, y, groups, links in per:
        digest = "" if not x else None
        if x and len(x) < 500:
            digest = hashlib.sha256(";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups).encode()).hexdigest()
        out.append((doc_id, len(x), len(y), len(groups), len(links), sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links), digest))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 0) for i, t in enumerate(TEXTS)] + [(None, "no id", None, 1), (5, " a", "y", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, n_a int")


def test_alignment_against_all_links(docs, libraries):
    want = brute_force([(r.doc_id, r.text) for r in docs.collect()], *libraries)
    for segment_pairs in (4_000_000, 150):
        got = alignment.align(docs, F.col("doc_id"), *FILES, segment_pairs=segment_pairs).collect()
        names = ("row", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
        found = sorted((tuple(r[n] for n in names) for r in got), key=lambda r: (r[0] is None, r[0], r))
        assert len(found) == len(want)
        for g, w in zip(found, sorted(want, key=lambda r: (r[0] is None, r[0], r[:7])), strict=True):
            assert g[:7] == w[:7]
            assert w[7] is None or g[7] == w[7]


def test_alignment_of_nothing(docs):
    assert alignment.align(docs.where("false"), F.col("doc_id"), *FILES).collect() == []
    rows = alignment.align(docs.where("text is null or text = ''"), F.col("doc_id"), *FILES).collect()
    assert [(r.n_a, r.n_links, r.groups_sha256) for r in rows] == [(0, 0, "")] * 2


def test_short_way_equals_libraries(libraries):
    a, b = libraries
    with open(FILES[0], encoding="utf-8") as f, open(FILES[1], "rb") as g:
        aligner = alignment.Aligner(f.read(), g.read())
    assert aligner.fast
    pick, alphabet = random.Random(5), "abeinrst  \n\t.,;'\"()ßéñ×019<>_|-\x85\xa0ȿƀ"
    for _ in range(3000):
        text = "".join(pick.choice(alphabet) for _ in range(pick.randint(1, 16)))
        import pyarrow as pa

        counts, slots, distinct = aligner.units(pa.array([text]))
        units = aligner.align(distinct, True)
        joined = b"".join(units.groups[i] for i in slots)
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        sides = [g.split(b"|") for g in joined.rstrip(b";").split(b";")]
        assert [int(t) for s in sides for t in s[0].split(b",")] == x and [int(t) for s in sides for t in s[1].split(b",")] == y


def test_pair_hash():
    pick = np.random.default_rng(3)
    shards = [np.unique(pick.integers(0, 1 << 31, n)) for n in (1, 5, 5000, 64)] + [np.zeros(0, dtype=np.int64)]
    built = [alignment.PairHash.build(k) for k in shards]
    joined = alignment.PairHash.joined([(h.sizes[0], h.words) for h in built])
    keys, shard = np.concatenate(shards), np.repeat(np.arange(5), [len(k) for k in shards])
    order = pick.permutation(len(keys))
    assert sorted(joined.slots(shard[order], keys[order]).tolist()) == list(range(len(keys)))
    assert (np.diff(np.sort(joined.slots(shard[shard == 2], keys[shard == 2]))) == 1).all()
    with pytest.raises(ValueError):
        alignment.PairHash.build(np.array([7, 7]))
