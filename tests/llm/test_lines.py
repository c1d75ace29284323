import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from guestlens.llm import lines as L
from guestlens.llm.queries import op10_lines


def from_sql(rows):
    db = duckdb.connect()
    db.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    if rows:
        db.executemany("INSERT INTO documents VALUES (?, ?)", [list(r) for r in rows])
    return Counter(db.sql(L.lines_sql()).fetchall())


def from_spark(spark, rows):
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, n_lines string")
    out = L.drop_recurring_lines(docs)
    assert out.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    return Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect())


def invented(rng, n=150):
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))) for _ in range(400)]
    prose = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 14)))
    rows = []
    for i in range(n):
        lines = [prose() for _ in range(rng.randint(0, 7))]
        for line in ("All rights reserved.", f"Page {i} of {n}", f"Reply sent by {rng.choice(vocabulary)} in general forum", "And.", "  two   blanks 12 here "):
            if rng.random() < 0.3:
                lines.insert(rng.randint(0, len(lines)), line)
        rows.append((i, "\n".join(lines)))
    copied = "\n".join(prose() for _ in range(5))
    rows += [(1000 + i, copied) for i in range(40)]
    rows += [(2000 + i, copied.replace(copied.split()[i % 9], vocabulary[i], 1)) for i in range(25)]
    return rows + [(5, None), (6, ""), (None, rows[0][1]), (7, "x " * 5000), rows[1], rows[1]]


@pytest.mark.parametrize("seed", [1, 2])
def test_rows_equal_sql(spark, seed):
    rows = invented(random.Random(seed))
    got = from_spark(spark, rows)
    assert got == from_sql(rows)
    texts = [t for _, _, _, t in got.elements() if t]
    assert not any("All rights reserved." in t or "Reply sent by" in t or "Page " in t for t in texts)
    assert any("And." in t for t in texts)
    copied = dict(rows)[1000]
    assert got[(1000, 5, 0, copied)] == 1


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghiklmnop") for _ in range(rng.randint(2, 12))) for _ in range(n))


def test_hot_copies_do_not_save_a_footer(spark):
    """A footer of 60 unrelated pages and of 1,500 near copies of one page goes everywhere; the page's own lines stay."""
    rng = random.Random(5)
    footer = "All rights reserved by the owner"
    page = [prose(rng, 12) for _ in range(8)]
    rows = [(i, "\n".join([prose(rng, 12) for _ in range(6)] + [footer])) for i in range(60)]
    for i in range(1500):
        words = [line.split() for line in page]
        for _ in range(5):
            line = rng.choice(words)
            line[rng.randrange(12)] = prose(rng, 1)
        rows.append((1000 + i, "\n".join([" ".join(w) for w in words] + [footer])))
    got = from_spark(spark, rows)
    assert got == from_sql(rows)
    before = dict(rows)
    for key, n_lines, n_dropped, text in got:
        assert n_dropped == 1 and text + "\n" + footer == before[key]


def test_two_templates_in_one_leaf(spark):
    """Fields without digits, forms that are each rare, much prose beside them, and a value frequent in another template."""
    rng = random.Random(6)
    rows = []
    for i in range(240):
        line = [
            f"This article was written by {prose(rng, 1)} for all of our readers",
            f"This article was posted in {prose(rng, 1)} on account of our readers",
            f"This article was {prose(rng, 8)}",
            prose(rng, 11),
        ][i % 4]
        rows.append((i, "\n".join([prose(rng, 12), line, prose(rng, 12)])))
    rows += [(1000 + i, "\n".join([prose(rng, 12), f"Reply sent by {'anna' if i < 30 else prose(rng, 1)} in {'general' if i >= 30 else prose(rng, 1)} forum"])) for i in range(60)]
    got = from_spark(spark, rows)
    assert got == from_sql(rows)
    dropped = {key: n for key, _, n, _ in got}
    assert all(dropped[i] == (i % 4 < 2) for i in range(240))
    assert all(dropped[1000 + i] == 1 for i in range(60))


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in op10_lines(spark, sf).collect())
    assert got == Counter(db.sql(L.lines_sql()).fetchall())
    assert sum(n for _, _, n, _ in got) > 100


def test_empty(spark):
    assert L.drop_recurring_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spark.range(1).select(L.masked_lines(F.lit(" a  b2 c\t"))).first()[0] == ["a <*> c"]
