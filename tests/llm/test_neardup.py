import random
from collections import Counter

import numpy as np

from guestlens.llm import neardup as N
from guestlens.llm.shingles import probability_jaccard, weighted, word_hashes, words_of


def plain_similarity(a, b):
    """Probability Jaccard straight from its definition."""
    def bag(text):
        w = words_of(text)
        n = min(5, len(w))
        return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else Counter()

    x, y = bag(a), bag(b)
    return sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in x | y) for d in x if d in y)


def test_similarity_and_signatures():
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(30)]
    for _ in range(40):
        a = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        b = a * rng.randint(1, 2)
        for _ in range(rng.randint(0, 5)):
            b[rng.randrange(len(b)) if b else 0 :][:1] = [rng.choice(vocabulary)]
        b = [rng.choice(vocabulary) if rng.random() < 0.05 else w for w in b]
        ta, tb = " ".join(a), " ".join(b)
        want = plain_similarity(ta, tb)
        sets = [weighted(word_hashes(words_of(t))) for t in (ta, tb)]
        assert abs(probability_jaccard(*sets) - want) < 1e-9
        if a and b:
            owner = np.repeat([0, 1], [s[0].size for s in sets])
            s = N.signatures(owner, np.concatenate([x[0] for x in sets]), np.concatenate([x[1] for x in sets]).astype(float), 2, 2048)
            assert abs((s[0] == s[1]).mean() - want) < 0.06


def brute(rows):
    """Classes of (key, text) rows from all pairs."""
    rows = [(k, t) for k, t in rows if k is not None]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if a is not None and b is not None and find(i) != find(j):
                wa, wb = words_of(a), words_of(b)
                if a == b or (wa and wa == wb) or plain_similarity(a, b) >= 0.8:
                    parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(k, least.get(find(i), k))
    return Counter((k, least[find(i)]) for i, (k, _) in enumerate(rows))


def invented(rng):
    vocabulary = [f"word{i}" for i in range(300)]
    rows, key = [], 0
    for _ in range(14):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 12, 60, 150]))]
        for _ in range(rng.choice([1, 1, 2, 12])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((rng.randint(0, 10**6), " ".join(text).capitalize() + rng.choice([".", "!", ""])))
            key += 1
    chain = [rng.choice(vocabulary) for _ in range(100)]
    for i in range(10):
        chain[i * 9] = f"changed{i}"
        rows.append((2_000_000 + i, " ".join(chain)))
    return rows + [(5, None), (6, None), (7, ""), (8, ""), (9, "!!"), (None, rows[0][1]), (10, "one two"), (11, "One  two!"), rows[2], rows[2]]


def test_classes_equal_brute_force(spark):
    for seed in (1, 2):
        rows = invented(random.Random(seed))
        docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, class_id int")
        got = N.near_duplicates(docs).collect()
        assert Counter((r.doc_id, r.class_id) for r in got if r.doc_id is not None) == brute(rows)
        assert [(r.class_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
        assert all(r.kept == (r.doc_id == r.class_id) for r in got if r.doc_id is not None)


def test_empty(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_template_family_of_a_thousand_texts(spark):
    """Texts of one form: strangers at 88 / 112, each with one partner at 90 / 110 or 92 / 108."""
    form = [f"form{i}" for i in range(92)]
    rows = []
    for pair in range(500):
        own = [f"own{pair}x{i}" for i in range(12)]
        same = 2 + pair % 2 * 2
        rows += [(2 * pair, " ".join(form + own)), (2 * pair + 1, " ".join(form + own[:same] + [f"other{pair}x{i}" for i in range(12 - same)]))]
    assert plain_similarity(rows[0][1], rows[1][1]) > 0.8 > 0.79 > plain_similarity(rows[0][1], rows[2][1])
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {k: k - k % 2 for k, _ in rows}


def test_bound_of_the_prefix_join_holds():
    rng = np.random.default_rng(5)
    for _ in range(300):
        x, y = (rng.integers(1, 5, 12) * (rng.random(12) < 0.7) for _ in range(2))
        if x.any() and y.any():
            a, b = ((np.flatnonzero(z).astype(np.uint64), z[z > 0]) for z in (x, y))
            u, v = x[y == 0].sum() / x.sum(), y[x == 0].sum() / y.sum()
            assert probability_jaccard(a, b) <= ((1 - u) * (1 - v) / (1 - u * v) if u * v < 1 else 0) + 1e-9
