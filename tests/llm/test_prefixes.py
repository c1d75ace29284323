import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest

from guestlens.llm import prefixes as P

SCHEMA = "conv_id long, turn long, role string, text string, depth int, key string"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    convs = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = convs.get(c - c % 100, [])[:h] + turns[h:]
    nodes, kids, below, out = defaultdict(list), defaultdict(list), {}, Counter()
    for c, turns in rebuilt.items():
        for depth in range(len(turns) + 1):
            nodes[tuple(turns[:depth])].append(c)
    for n in nodes:
        if n:
            kids[n[:-1]].append(n)
    for n in sorted(nodes, key=len, reverse=True):
        leaves = sum(below[k][0] for k in kids[n]) or 1
        saved = sum(below[k][1] for k in kids[n]) + ((len(nodes[n]) - 1) * len(n[-1][1]) if n else 0)
        below[n] = leaves, saved
        ends = ",".join(map(str, sorted(c for c in nodes[n] if len(rebuilt[c]) == len(n))))
        parent = min(nodes[n[:-1]]) if n else None
        out[min(nodes[n]), len(n), parent, len(nodes[n]), len(kids[n]), leaves, saved, sha256(ends.encode()).hexdigest()] += 1
    return out


def trie(spark, rows, **sizes):
    turns = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5)
    return P.prefix_nodes(P.shared_openings(P.conversation_turns(turns)), **sizes)


def invented(rng, n):
    rows = []
    for i in range(n):
        conv = i // 100 * 100 if rng.random() < 0.1 else rng.choice([i, i, i, i * 3, i % 60])
        plain = rng.random() < 0.5
        for t in range(rng.randint(0, 9)):
            role = "user" if plain else rng.choice(["user", None])
            text = rng.choice(["a", "bb", "é€", None, ""]) if t > rng.choice([0, 2, 4]) else "same"
            rows.append((conv if rng.random() > 0.01 else None, rng.choice([t, t, t, None]), role, text))
    rows += [(50_000 + i, t, "u", f"copied {t}") for i in range(200) for t in range(7)]
    rows += [(90_000 + i, t, "u", "x" * 3000 + str(t + i * (t > 250))) for i in range(2) for t in range(300)]
    return rows + rows[:5]


@pytest.mark.parametrize("n, sizes", [(3, {}), (300, {"block_rows": 7, "merged": 2}), (600, {"block_rows": 3, "merged": 3}), (600, {})])
def test_nodes_equal_brute_force(spark, n, sizes):
    rows = invented(random.Random(n), n)
    assert Counter(map(tuple, trie(spark, rows, **sizes).collect())) == brute(rows)


def test_without_turns(spark):
    assert trie(spark, []).collect() == []
    assert trie(spark, [(None, 1, "u", "a")]).collect() == []
    lone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    got = [tuple(r) for r in trie(spark, [(lone, 0, None, None)]).collect()]
    assert got == [(lone, 0, None, 1, 0, 1, 0, sha256(str(lone).encode()).hexdigest())]
