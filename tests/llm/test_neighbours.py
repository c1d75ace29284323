from collections import defaultdict

import numpy as np
import pytest

from guestlens.llm import neighbours as A
from guestlens.llm.queries import op6_neighbours

SCHEMA = "vec_id long, embedding array<float>, score string"


def exact(rows, every, k):
    """Nearest rows of each query by all pairs."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) > 1 and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v) != 0)]
    out = {}
    for i, v in good:
        if i % every == 0:
            scored = sorted((-float(v @ w) / float(np.linalg.norm(v) * np.linalg.norm(w)), j) for j, w in good if j != i)[:k]
            out[i] = [(j, -s) for s, j in scored]
    return out


def found(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return dict(out)


def test_walk_goes_by_summed_distance():
    rng = np.random.default_rng(1)
    a, b = rng.random(7), rng.random(5)
    cells = list(A.walk(a, b))
    assert len(set(cells)) == 35
    sums = [a[i] + b[j] for i, j in cells]
    assert sums == sorted(sums)


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_and_scores(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").collect()]
    want, got = exact(rows, 50, 5), found(op6_neighbours(spark, f"/root/testdata/sf{sf}"))
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    by_id = {i: np.array(v, float) for i, v in rows}
    hits = [len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want]
    assert np.mean(hits) / 5 >= 0.9
    for q in got:
        scores = [s for _, s in got[q]]
        assert scores == sorted(scores, reverse=True)
        for j, s in got[q]:
            assert abs(s - by_id[q] @ by_id[j] / np.linalg.norm(by_id[q]) / np.linalg.norm(by_id[j])) < 1e-12


def test_odd_inputs(spark, monkeypatch):
    monkeypatch.setattr(A, "ENTRIES_PER_BLOCK", 9)
    monkeypatch.setattr(A, "QUERIES_PER_BLOCK", 2)
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(60)]
    same = rows[3][1]
    rows += [(100 + i, same) for i in range(40)] + [(500, None), (510, []), (520, [0.0] * 6), (530, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (540, [float("nan")] * 6)]
    rows += [(None, same), (550, [float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0]), (560, [1.0, 2.0]), rows[0]]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    got = found(A.nearest(frame, every=10, k=5, recall=1.0))
    want = exact([r for r in rows if r[1] is None or len(r[1]) == 6][:-1], 10, 5)
    assert {q: [j for j, _ in v] for q, v in got.items()} == {q: [j for j, _ in v] for q, v in want.items()}
    assert [j for j, _ in got[100]] == [3, 101, 102, 103, 104]
    assert A.nearest(frame.limit(0)).count() == 0
    assert A.nearest(spark.createDataFrame([(50, [1.0, 2.0], "")], SCHEMA)).count() == 0
    few = found(A.nearest(spark.createDataFrame([(50, [1.0, 2.0], ""), (1, [2.0, 4.0], ""), (2, [0.5, 0.1], "")], SCHEMA)))
    assert [j for j, _ in few[50]] == [1, 2]
    assert A.nearest(spark.createDataFrame([(1, [1.0, 2.0], "")], SCHEMA)).count() == 0


def test_one_component_and_extreme_numbers(spark):
    schema = "vec_id long, embedding array<double>, score string"
    rows = [(50, [3.0]), (1, [2.0]), (2, [-1.0]), (3, [0.0]), (4, [5.0])]
    got = found(A.nearest(spark.createDataFrame([(*r, "x") for r in rows], schema)))
    assert got[50] == [(1, 1.0), (4, 1.0), (2, -1.0)]
    rows = [(50, [1e200, 1e200]), (1, [1e-200, 1e-200]), (2, [1.0, 0.0]), (3, [-1e300, -1e300]), (4, [1e-320, 0.0])]
    got = found(A.nearest(spark.createDataFrame([(*r, "x") for r in rows], schema)))
    assert [j for j, _ in got[50]] == [1, 2, 4, 3]
    assert all(abs(s - want) < 1e-12 for (_, s), want in zip(got[50], [1.0, 0.5**0.5, 0.5**0.5, -1.0]))
