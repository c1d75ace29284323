import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from guestlens.llm.exact import exact_duplicates
from guestlens.llm.oracles import exact_sql

SCHEMA = "doc_id long, text string, code int, kept string"


def brute(rows, largest, normalise=lambda t: t):
    groups = defaultdict(list)
    for key, text in rows:
        groups[normalise(text or "")].append(key)
    out = Counter()
    for text, keys in groups.items():
        known = [k for k in keys if k is not None]
        keep = (max if largest else min)(known) if known else None
        kept_one = False
        for key in keys:
            kept = key == keep and not kept_one
            kept_one |= kept
            out[key, keep, len(keys), kept, hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


def invented(rng):
    texts = [None, "", "A", "a", "hot", "hot", "hot", "é" * 60_000, *(f"t{i}" for i in range(50))]
    rows = [(rng.randint(0, 3000) if rng.random() > 0.02 else None, rng.choice(texts)) for _ in range(2000)]
    return rows + [(7, "same")] * 900 + [(None, "no key")] * 3


@pytest.mark.parametrize("largest", [True, False])
@pytest.mark.parametrize("hot", [{}, {"slices": 64, "sample_rows": 2000, "least_hits": 5}, {"slices": 7, "least_hits": 1}])
def test_rows_equal_brute_force(spark, largest, hot):
    rows = invented(random.Random(1))
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(6)
    assert Counter(map(tuple, exact_duplicates(docs, largest_stays=largest, **hot).collect())) == brute(rows, largest)


def test_normalised_texts_and_sql(spark):
    rows = invented(random.Random(2))[:400]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = exact_duplicates(docs, normalise=F.lower, least_hits=4)
    assert Counter(map(tuple, got.collect())) == brute(rows, False, str.lower)
    db = duckdb.connect()
    db.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", [list(r) for r in rows])
    out = exact_duplicates(docs, largest_stays=True)
    sql = db.sql(f"SELECT {', '.join(out.columns)} FROM ({exact_sql()})").fetchall()
    assert Counter(map(tuple, out.collect())) == Counter(sql)


def test_hot_text_is_sorted_in_many_tasks(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_duplicates(docs, largest_stays=True).where("group_size > 1")
    assert got.agg(F.count("*"), F.min("group_size"), F.max("keep_id"), F.count_if("kept")).first()[:] == (2000, 2000, 5997, 1)


def test_empty(spark):
    assert exact_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
