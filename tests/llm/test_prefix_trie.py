"""The prefix trie against sets of prefixes held in memory."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from colweave.llm import prefix_trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute_force(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h, sign = zlib.crc32(str(c).encode()) % 9, -1 if c < 0 else 1
        rebuilt[c] = own.get(c - sign * (abs(c) % 5), [])[:h] + turns[h:]
    members, children = defaultdict(list), defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for prefix in members:
        if prefix:
            children[prefix[:-1]].append(prefix)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) or 1
        saved[p] = sum(saved[x] for x in children[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), parent, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_of(spark, rows, **more):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, k1 string")
    found = prefix_trie.prefix_trie(df, **more)
    assert tuple(found.columns) == COLUMNS
    return sorted((tuple(r) for r in found.collect()), key=repr)


def random_rows(seed, n_convs, vocabulary, longest):
    pick = random.Random(seed)
    rows = []
    for c in pick.sample(range(-20, 3 * n_convs), n_convs):
        for t in range(pick.randint(1, longest)):
            rows.append((c, pick.choice([t, t, None]), pick.choice(["user", "assistant", None]), pick.choice(vocabulary)))
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "stretch", "hot"), [(1, 1024, 1000), (2, 3, 1), (3, 1, 0)])
def test_against_prefix_sets(spark, monkeypatch, seed, stretch, hot):
    monkeypatch.setattr(prefix_trie, "STRETCH", stretch)
    rows = random_rows(seed, 80, ["a", "ß", "", None, "long " * 20], 9)
    rows += [(None, 1, "user", "nobody's"), (5, 1, "user", "same"), (5, 1, "user", "same")]
    assert trie_of(spark, rows, hot_children=hot) == brute_force(rows)


def test_shared_beginnings_and_copies(spark, monkeypatch):
    """Many copies, one common first turn, nested conversations, and a conversation of many turns over stretches."""
    monkeypatch.setattr(prefix_trie, "STRETCH", 16)
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 400, 5) for t in range(3)]
    rows += [(c, t, "user", f"turn {t}" if t == 0 else f"{c} {t}") for c in range(1000, 1300, 5) for t in range(4)]
    rows += [(c, t, "user", f"nested {t}") for c in range(5000, 5100, 5) for t in range((c - 5000) // 5 + 1)]
    rows += [(9000 + c, t, "user", f"turn {t}" if t != 150 + c else "apart") for c in (0, 5) for t in range(200)]
    assert trie_of(spark, rows, hot_children=10) == brute_force(rows)


def test_nothing_and_turnless(spark):
    assert trie_of(spark, [(None, 1, "user", "x")]) == []
    # 7 begins with what an absent conversation 5 lacks; with h turns or fewer of its own nothing is left
    rows = [(c, 0, "user", "one") for c in range(1, 5)]
    assert trie_of(spark, rows) == brute_force(rows)


def test_zfast_trie_finds_exits():
    pick = random.Random(4)
    trie, held = prefix_trie.ZFastTrie(), []
    for i in range(400):
        letters = [pick.choice("ab") for _ in range(pick.randint(1, 12))]
        names = [hash(("x", *letters[:d])) for d in range(1, len(letters) + 1)]
        want = max([sum(a == b for a, b in zip(names, other, strict=False)) for other in held], default=0)
        assert trie.locate(names)[1] == want
        trie.insert(names, [(n,) for n in names], (1, len(names)), i)
        held.append(names)
        assert all(trie.handles[n.handle()] is n for n in trie.nodes) and len(trie.handles) == len(trie.nodes)
    sums = {row[0]: row[1:] for row in trie.expanded()}
    for name, (n, total, low) in sums.items():
        through = [(i, len(x)) for i, x in enumerate(held) if name in x]
        assert (n, total, low) == (len(through), sum(size for _, size in through), through[0][0])


def test_two_fattest():
    for low in range(40):
        for high in range(low + 1, 41):
            assert prefix_trie.two_fattest(low, high) == max(range(low + 1, high + 1), key=lambda x: x & -x)
