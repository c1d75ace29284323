import zlib

import numpy as np
from pyspark.sql import functions as F

from guestlens.llm import language as L
from guestlens.llm.queries import op3_language

SF = "/root/testdata/sf0.01"


def test_gradients_equal_differences():
    rng = np.random.default_rng(4)
    w = L.new_weights(3, rng)
    x, label = rng.integers(0, 256, (7, 5)), rng.integers(0, 3, 5)
    _, grad = L.gradients(x, label, w)
    for name in w:
        for place in zip(*(i[:6] for i in np.nonzero(np.abs(grad[name]) > 0.01))):
            old, losses = w[name][place], []
            for step in (2e-3, -2e-3):
                w[name][place] = old + step
                losses.append(L.gradients(x, label, w)[0])
            w[name][place] = old
            assert abs((losses[0] - losses[1]) / 4e-3 - grad[name][place]) < 0.03 * abs(grad[name][place]) + 2e-3, name


def test_pooling_is_the_mean_over_all_positions():
    rng = np.random.default_rng(1)
    w = L.new_weights(2, rng)
    raw = [b"abc", b"x" * 300, b"q" * L.WINDOW]
    p = L.pooled(raw, w)
    assert np.allclose(p.sum(1), 1, atol=1e-4)
    lone = np.zeros((1, 2))
    for at in range(0, 300, L.WINDOW):
        row = np.frombuffer(raw[1][at : at + L.WINDOW].ljust(L.WINDOW), np.uint8)
        lone += L.position_probabilities(row[:, None].copy(), w)[: min(L.WINDOW, 300 - at)].sum(0)
    assert np.allclose(p[1], lone[0] / 300, atol=1e-4)


def test_held_out_accuracy(spark):
    rows = op3_language(spark, SF).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]) > 0.98


def test_odd_inputs(spark):
    rows = [(1, "the cat and the dog " * 9, "en", "s"), (2, "le chat et le chien " * 9, "fr", "s"), (3, None, "en", "s"), (None, "", None, "s"),
            (4, "1234 \u00bd\u00b2\u2163\u2460 !! 55", "fr", "s"), (1, "the cat and the dog " * 9, "en", "s"), (5, "the dog " * 9_000, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = L.fit_language(docs, F.lit(True))
    got = sorted((r.doc_id or 0, r.lang_pred) for r in L.label_languages(docs, model).collect())
    assert got == [(0, "und"), (1, "en"), (1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "en")]
    assert L.label_languages(docs.limit(0), model).count() == 0
    nothing = L.fit_language(docs, F.lit(False))
    assert {(r.lang_pred, r.score) for r in L.label_languages(docs, nothing).collect()} == {("und", 0.0)}
    single = L.fit_language(docs.where("lang = 'en'"), F.lit(True))
    assert {r.lang_pred for r in L.label_languages(docs, single).collect()} == {"en", "und"}


def test_every_language_is_learned(spark):
    """More than 64 languages: the rarest is learned too."""
    rows = [(i * 100 + j, chr(0x4E00 + i) * 30, f"l{i:03}") for i in range(70) for j in range(1 if i == 69 else 3)]
    model = L.fit_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert len(model.languages) == 70


def test_texts_equal_a_plain_run(spark):
    """Each text's label and score by one window after another, without batches, slices or Spark."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1
    model = L.fit_language(docs.select("doc_id", "text", "lang"), learn)
    got = {r.doc_id: (r.lang_pred, r.score) for r in op3_language(spark, "/root/testdata/sf0.001").collect()}
    for r in docs.collect():
        raw = L.to_bytes(r.text or "")
        total = np.zeros(len(model.languages))
        for at in range(0, len(raw), L.WINDOW):
            part = raw[at : at + L.WINDOW]
            row = np.frombuffer(part.ljust(L.WINDOW), np.uint8)[:, None].copy()
            total += L.position_probabilities(row, model.weights)[: len(part), 0].sum(0)
        if not any(c.isalpha() for c in r.text or ""):
            assert got[r.doc_id] == ("und", 0.0)
        else:
            assert abs(got[r.doc_id][1] - total.max() / len(raw)) < 1e-4
            assert got[r.doc_id][0] == model.languages[total.argmax()] or np.sort(total)[-1] - np.sort(total)[-2] < 1e-3 * len(raw)
