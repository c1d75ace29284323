from collections import Counter

import duckdb
import numpy as np
from tokenizers import Tokenizer as Library

import corpus_pipeline as P
from guestlens.llm.lines import lines_sql
from guestlens.llm.quality import ACCEPTED, Sizes, score_texts
from guestlens.llm.queries import VOCABULARY, quality_model
from tests.llm.test_decontaminate import brute as brute_leaks
from tests.llm.test_neardup import brute as brute_classes

SF = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = quality_model(spark, SF, docs)
    scores = score_texts(Sizes(model.good, model.bad), model, [t for _, t in rows])
    good = [r for r, s in zip(rows, scores) if s >= ACCEPTED]
    assert 0.7 * len(rows) < len(good) < len(rows)
    db = duckdb.connect()
    db.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", [list(r) for r in good])
    lines = [(k, t) for k, _, _, t in db.sql(lines_sql()).fetchall()]
    classes = dict(brute_classes(lines).keys())
    single = [r for r in lines if classes[r[0]] == r[0]]
    leaks = {k for k, *_ in brute_leaks(single, items)}
    left = dict(r for r in single if r[0] not in leaks)
    library = Library.from_file(VOCABULARY)
    got = {r.doc_id: r for r in P.run(spark, SF).collect()}
    assert got.keys() == left.keys()
    for k, text in left.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got[k].ids, "<u4").tolist() == ids
        assert got[k].decoded == library.decode(ids, skip_special_tokens=False)


def test_stages_keep_the_columns_and_bear_odd_rows(spark):
    rows = [(1, "alpha beta gamma delta " * 9, "en", "s", 1, 5), (2, None, None, None, None, 6), (None, "", "en", "s", 0, 7), (3, "x " * 30_000, "en", "s", 9, 8), (1, "alpha beta gamma delta " * 9, "en", "s", 1, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, n_lines int")
    for empty in (False, True):
        start = docs.limit(0) if empty else docs
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, start, SF)
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
            got = Counter(map(tuple, out.collect()))
            assert not got - Counter(map(tuple, rows))
            if name in ("lines", "decontaminate"):
                assert sum(got.values()) == (0 if empty else 5)
            if name == "neardup" and not empty:
                assert {r[0] for r in got} == {1, 2, 3, None}
        assert P.STAGES[-1][1](spark, start, SF).count() == (0 if empty else 5)


def test_repeated_keys_lose_no_text(spark):
    text, other = "alpha beta gamma delta epsilon " * 9, "one two three four five six seven " * 9
    rows = [(0, text), (5, text), (5, other), (6, None), (6, None), (7, other), (7, other), (None, text)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars int")
    got = Counter((r.doc_id, r.text) for r in P.one_of_each_group(spark, docs, SF).collect())
    assert got == Counter([(0, text), (5, other), (6, None), (None, text)])
