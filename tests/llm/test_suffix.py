import hashlib
import random

import pytest

from guestlens.llm import suffix as S
from guestlens.llm.queries import op9_repeats

SF = "/root/testdata/sf0.001"


def brute(rows):
    """Removed spans of (key, text) rows by looking at every string."""
    least = {}
    for key, text in rows:
        raw = (text or "").encode()
        if key is not None:
            for i in range(len(raw) - S.LENGTH + 1):
                s = raw[i : i + S.LENGTH]
                least[s] = min(key, least.get(s, key))
    out = []
    for key, text in rows:
        raw, gone = (text or "").encode(), set()
        for i in range(len(raw) - S.LENGTH + 1):
            if key is not None and least[raw[i : i + S.LENGTH]] < key:
                gone.update(range(i, i + S.LENGTH))
        spans = [[i, i + 1] for i in sorted(gone)]
        joined = []
        for a, b in spans:
            if joined and joined[-1][1] == a:
                joined[-1][1] = b
            else:
                joined.append([a, b])
        out.append((key, len(raw), [tuple(x) for x in joined], bytes(c for i, c in enumerate(raw) if i not in gone)))
    return sorted(out, key=repr)


def agree(spark, rows):
    docs = spark.createDataFrame([(k, t, "clash") for k, t in rows], "doc_id long, text string, kept string").repartition(3)
    got = [(r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in S.remove_repeats(docs).collect()]
    assert sorted(got, key=repr) == brute(rows)


def invented(rng, n=120):
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(40)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 40))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(0, 6))]
        rows.append((rng.randint(-20, 10**6), " ".join(parts)))
    rows += [(7, None), (8, ""), (None, rows[0][1]), (5, "a" * 400), (6, "a" * 90 + "b" + "a" * 60), (6, "a" * 90 + "b" + "a" * 60), (11, "ab" * 100), (12, "ba" * 70)]
    rows += [(10**7 + i, rows[3][1]) for i in range(5)]
    return rows


def test_rows_equal_brute_force(spark):
    agree(spark, invented(random.Random(1)))


def test_small_chunks_and_hot_triggers(spark, monkeypatch):
    rng = random.Random(2)
    rows = invented(rng, 60)
    common = "of the and that this is so common"
    rows += [(1000 + i, "".join(rng.choice("xyz ") for _ in range(40)) + common + "".join(rng.choice("xyz ") for _ in range(rng.choice([5, 40])))) for i in range(60)]
    rows += [(3000 + i, rows[-1 - i][1][10:]) for i in range(20)]
    monkeypatch.setattr(S, "BLOCK", 64)
    monkeypatch.setattr(S, "HOT", 2)
    found = list(S.blocks(iter([(0, b"x" * 1000)])))
    assert sum(len(p) - S.LENGTH + 1 for _, _, pieces in found for p in pieces) == 951
    key = [k for k, _ in rows]
    texts = [t for _, t in rows]
    assert local(key, texts) == brute(rows)


def local(keys, texts, batch=7):
    """The steps of `remove_repeats` in one process, with patched constants."""
    import pyarrow as pa

    def cut(table, n=batch):
        return (b for b in table.to_batches(max_chunksize=n))

    base = pa.table({"key": pa.array(keys, pa.int64()), "text": pa.array(texts, pa.string())})
    entries = pa.Table.from_batches(S.phrase_rows(cut(base))).to_pylist()
    entries.sort(key=lambda r: (r["entry"], r["key"]))
    marks = pa.Table.from_batches(S.decided(cut(pa.Table.from_pylist(entries)))).to_pylist()
    probes = {}
    for m in marks:
        if m["mark"] & 3:
            probes.setdefault(m["key"], []).append(m["mark"])
    assert any(m["mark"] & 3 == S.HOT_PROBE for m in marks)
    joined = pa.table({
        "key": pa.array([k for k in keys if k in probes], pa.int64()),
        "marks": pa.array([probes[k] for k in keys if k in probes], pa.list_(pa.int64())),
        "text": pa.array([t for k, t in zip(keys, texts) if k in probes], pa.string()),
    })
    phrases = pa.Table.from_batches(S.suffix_rows(cut(joined))).to_pylist()
    phrases.sort(key=lambda r: r["route"])
    runs = pa.Table.from_batches(S.repeated_runs(cut(pa.Table.from_pylist(phrases)))).to_pylist()
    lists = {}
    for m in marks:
        if not m["mark"] & 3:
            lists.setdefault(m["key"], []).append((m["mark"] >> 2, 0, S.ALL))
    for r in runs:
        lists.setdefault(r["key"], []).append((r["content"], r["start"], r["end"]))
    listed = [lists.get(k, []) if k is not None else [] for k in keys]
    last = pa.table({
        "key": pa.array(keys, pa.int64()), **{n: pa.array([[x[i] for x in rows] for rows in listed], pa.list_(pa.int64())) for i, n in enumerate(("content", "start", "end"))},
        "text": pa.array(texts, pa.string()),
    })
    got = pa.Table.from_batches(S.removed_rows(cut(last))).to_pylist()
    return sorted(((r["key"], r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], r["kept"]) for r in got), key=repr)


@pytest.mark.parametrize("seed", range(6))
def test_steps_equal_brute_force(seed, monkeypatch):
    monkeypatch.setattr(S, "HOT", 1)
    rows = invented(random.Random(100 + seed), 50)
    assert local([k for k, _ in rows], [t for _, t in rows], batch=1 + 3 * seed) == brute(rows)


def test_query_and_empty_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {k: (n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()) for k, n, spans, kept in brute(rows)}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op9_repeats(spark, SF).collect()}
    assert got == want
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
