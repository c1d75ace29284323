import random
from collections import Counter

import numpy as np

from guestlens.llm import decontaminate as D
from guestlens.llm.queries import op4_decontaminate
from guestlens.llm.shingles import words_of

SF = "/root/testdata/sf0.01"


def bag(words):
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(docs, items, threshold=0.8):
    """(key, item, similarity, start, words) of the best window of each item, from all windows."""
    out = []
    for key, text in docs:
        words = words_of(text)
        mine = bag(words)
        for item, passage in items:
            theirs = words_of(passage)
            if len(theirs) < 5 or not (bag(theirs) & mine):
                continue
            rated = [((bag(theirs) & bag(words[s : s + len(theirs)])).total() / bag(theirs).total(), -s) for s in range(len(words) - len(theirs) + 1)]
            if rated and max(rated)[0] >= threshold:
                out.append((key, item, round(max(rated)[0], 9), -max(rated)[1], len(theirs)))
    return Counter(out)


def rows_of(df):
    found = df.selectExpr("doc_id", "explode(leaks) AS l").collect()
    return Counter((r.doc_id, r.l.item, round(r.l.similarity, 9), r.l.start, r.l.words) for r in found)


def test_index_finds_all_prints_within_the_radius():
    rng = np.random.default_rng(2)
    items = D.Items([(i, " ".join(f"w{x}" for x in rng.integers(0, 50, 20))) for i in range(300)])
    prints = items.prints[:40] ^ rng.integers(0, 2**63, 40).astype(np.uint64) & rng.integers(0, 2**63, 40).astype(np.uint64)
    got = set(zip(*(x.tolist() for x in items.within(prints))))
    assert got == {(a, b) for a in range(40) for b in range(300) if int(prints[a] ^ items.prints[b]).bit_count() <= D.RADIUS}
    assert len(got) > 40


def invented(rng):
    vocabulary = [f"word{i}" for i in range(80)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(some(rng.choice([2, 5, 7, 15, 40, 59])))) for i in range(25)]
    items += [(100, items[3][1].upper()), (101, None), (102, ""), (103, "a b c d e " * 5)]
    docs = []
    for key in range(80):
        words = some(rng.randint(0, 120))
        for _ in range(rng.randint(0, 2)):
            passage = words_of(rng.choice(items)[1] or "")
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                if passage:
                    passage[rng.randrange(len(passage))] = rng.choice(vocabulary)
            at = rng.randint(0, len(words))
            words[at:at] = [w + rng.choice(["", ",", "."]) for w in passage[: rng.choice([None, 9, -2])]]
        docs.append((key, " ".join(words)))
    return items, docs + [(900, None), (901, ""), (None, items[4][1]), (902, "a b c d e " * 60), docs[0], docs[0]]


def test_rows_equal_brute_force(spark, monkeypatch):
    for seed in (1, 2, 3):
        items, docs = invented(random.Random(seed))
        df = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id long, text string, leaks string")
        benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, leaks string")
        want = brute(docs, [(i, t) for i, t in items if t is not None])
        assert want
        out = D.find_leaks(df, benchmark)
        assert out.columns == ["doc_id", "text", "leaks"] and out.count() == len(docs)
        assert rows_of(out) == want
    monkeypatch.setattr(D, "ITEMS_PER_PASS", 7)
    monkeypatch.setattr(D, "GAP", 11)
    assert rows_of(D.find_leaks(df, benchmark)) == want
    assert rows_of(D.find_leaks(df, benchmark.limit(0))) == Counter()
    assert D.find_leaks(df.limit(0), benchmark).count() == 0


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = Counter((r.doc_id, r.item_id, round(r.similarity, 9), r.start, r.words) for r in op4_decontaminate(spark, SF).collect())
    assert got == brute(docs, items) and got


def brute_short(docs, items, threshold=0.8):
    """The same for documents shorter than the item: one window, the whole document."""
    out = []
    for key, text in docs:
        words = words_of(text)
        for item, passage in items:
            theirs = words_of(passage)
            if 5 <= len(words) < len(theirs):
                rated = (bag(theirs) & bag(words)).total() / bag(theirs).total()
                if rated >= threshold:
                    out.append((key, item, round(rated, 9), 0, len(words)))
    return Counter(out)


def test_documents_shorter_than_the_item(spark):
    rng = random.Random(4)
    items = [(i, " ".join(f"w{rng.randrange(90)}" for _ in range(n))) for i, n in enumerate([6, 9, 20, 59, 59, 200])] + [(50, "a b c d e " * 6)]
    docs = [(0, " ".join(items[3][1].split()[:-1])), (1, "a b c d e " * 5), (2, None), (3, "")]
    for key in range(10, 150):
        words = rng.choice(items)[1].split()
        low = rng.randint(0, len(words) // 4)
        words = words[low : len(words) - rng.randint(0, len(words) // 4)]
        if words and rng.random() < 0.4:
            words[rng.randrange(len(words))] = "changed"
        docs.append((key, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = rows_of(D.find_leaks(df, spark.createDataFrame(items, "item_id long, text string")))
    want = brute_short(docs, items)
    assert got == want + brute(docs, items) and len(want) > 20
    assert (0, 3, round(54 / 55, 9), 0, 58) in want
