import zlib

import numpy as np
import pytest

from guestlens.llm.quality import ACCEPTED, DICTIONARY_BYTES, Sizes, calibrate, fit_quality, score_quality, score_texts
from guestlens.llm.queries import op5_quality, quality_model

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in op5_quality(spark, "/root/testdata/sf0.1").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    assert len(got) == 10_000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())
    held = [(got[d].predicted, q) for d, q in labels.items() if got[d].held_out]
    assert np.mean([p == q for p, q in held]) > 0.97
    assert np.mean([p for p, q in held if q == 1]) > 0.98
    assert np.mean([1 - p for p, q in held if q == 0]) > 0.9


def test_sizes_are_those_of_whole_texts():
    sizes = Sizes(b"", b"")
    long = "word " * 100_000
    a, b, c = sizes.features([long])[0]
    assert a == 0 and b == c == len(sizes.coders[2].compress(long.encode())) / (len(long) + 16)


def test_calibration_separates():
    x = np.r_[np.random.default_rng(0).normal(-1, 1, (200, 2)), np.random.default_rng(1).normal(1, 1, (200, 2))]
    y = np.repeat([0.0, 1.0], 200)
    w, shift = calibrate(x, y)
    assert np.mean(((x @ np.array(w) + shift) > 0) == y) > 0.85


def test_odd_inputs(spark):
    docs = spark.createDataFrame(
        [(1, "good text " * 30, "a"), (2, "###!! $$$ " * 30, "b"), (3, None, "c"), (None, "", "d"), (1, "good text " * 30, "a")],
        "doc_id long, text string, quality string",
    )
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, 1), (None, 1), (9, None)], "doc_id long, quality int")
    model = fit_quality(docs, labels)
    assert len(model.good) <= DICTIONARY_BYTES
    out = score_quality(docs, model)
    assert out.columns == ["doc_id", "text", "quality", "quality_score"]
    rows = out.collect()
    assert len(rows) == 5 and all(0 <= r.quality_score <= 1 for r in rows)
    assert len({r.quality_score for r in rows if r.doc_id == 1}) == 1
    assert len({r.quality_score for r in rows if not r.text}) == 1
    assert score_quality(docs.limit(0), model).count() == 0
    assert score_quality(out, model).columns == out.columns
    none = fit_quality(docs, labels.limit(0))
    assert [r.quality_score for r in score_quality(docs, none).collect()] == pytest.approx([0.5] * 5)


def test_long_texts_keep_their_score(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = quality_model(spark, sf, docs)
    known = docs.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("text IS NOT NULL").orderBy("doc_id").collect()
    sizes = Sizes(model.good, model.bad)
    for label in (0, 1):
        held = [r.text for r in known if r.quality == label and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
        joined = "\n".join(held)
        joined *= 4_000_000 // len(joined) + 1
        scores = score_texts(sizes, model, [joined[:n] for n in (10_000, 50_000, 200_000, 1_000_000, 4_000_000)])
        print(label, len(held), scores)
        assert all((s >= ACCEPTED) == label for s in scores)
        assert np.ptp(scores) < 0.1
