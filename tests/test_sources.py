import csv
import random

import pytest
from pyspark.sql import functions as F

from guestlens.schema import ENRICHMENT, ensure_columns, layout
from guestlens.sources import files, paging

HEADER = ["Review_ID", "Rating", "Year_Month", "Reviewer_Location", "Review_Text", "Branch"]


def write_csv(path, rows, encoding="ISO-8859-1"):
    with open(path, "w", newline="", encoding=encoding) as out:
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow(HEADER)
        writer.writerows(rows)


def as_tuples(df):
    return sorted(tuple(r) for r in df.collect())


TEXTS = ["plain", 'said "hi", left', "two\nlines", "blank\n\nline inside", "é à ü", '"', '""\n"', "x" * 500, "comma, comma"]


@pytest.fixture()
def rows():
    rng = random.Random(2)
    return [(str(i), rng.randint(1, 5), f"2019-{i % 12 + 1}", "UK", f"{i} " + rng.choice(TEXTS), "Disneyland_Paris") for i in range(400)]


def test_csv_with_quotes_and_line_breaks(spark, tmp_path, rows):
    write_csv(tmp_path / "r.csv", rows)
    got = as_tuples(files.read_review_csv(spark, str(tmp_path / "r.csv")))
    assert got == sorted(rows)


def test_csv_over_several_files_with_stray_quotes_and_empty_fields(spark, tmp_path, rows):
    write_csv(tmp_path / "a.csv", rows)
    odd = 'Review_ID,Rating,Year_Month,Reviewer_Location,Review_Text,Branch\r\n' \
        '1001,4,2019-4,UK,6" tall ride,Disneyland_Paris\r\n1002,,,,"caf\xe9, two\r\nlines",\r\n1003,5,missing,"","",Disneyland_Paris\r\n'
    (tmp_path / "b.csv").write_bytes(odd.encode("ISO-8859-1"))
    got = {r.Review_ID: r for r in files.read_review_csv(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) + 3
    assert (got["1001"].Review_Text, got["1001"].Branch) == ('6" tall ride', "Disneyland_Paris")
    assert got["1002"].Review_Text.replace("\r", "") == "caf\xe9, two\nlines" and got["1002"].Rating is None and got["1002"].Branch is None
    assert got["1003"].Rating == 5 and not got["1003"].Review_Text and got["1003"].Branch == "Disneyland_Paris"


def test_identifier_and_surrogate_key(spark):
    raw = spark.createDataFrame([(7, "a", None), (8, None, "a"), (9, "a", None)], "Review_ID int, x string, y string")
    named = files.normalise_id(raw)
    assert named.schema["review_uid"].dataType.simpleString() == "string"
    assert files.normalise_id(raw.drop("Review_ID")).columns == ["x", "y"]
    keys = [r[0] for r in raw.select(files.surrogate_key("x", "y")).collect()]
    assert keys[0] == keys[2] != keys[1] and len(keys[0]) == 64


def test_versions_stages_and_missing_tables(spark, tmp_path, caplog):
    root = str(tmp_path)
    assert files.read_enriched(spark, root) is None
    assert "no table at" in caplog.text
    rows = spark.range(5)
    files.write_stage(rows, files.enriched_path(root))
    files.write_stage(rows.limit(2), files.enriched_path(root, "v1"))
    files.append(rows, files.enriched_path(root, "v1"))
    assert files.read_enriched(spark, root).count() == 5
    assert files.read_enriched(spark, root, "v1").count() == 7
    files.write_stage(rows.limit(1), files.enriched_path(root))
    assert files.read_enriched(spark, root).count() == 1


def test_layout_and_missing_columns(spark):
    df = spark.createDataFrame([(1, "t", "x", "B", "2019-1")], "review_uid int, Review_Text string, extra string, Branch string, Year_Month string")
    full = ensure_columns(df, ENRICHMENT)
    assert full.schema["topics"].dataType.simpleString() == "array<string>"
    assert full.first()["sentiment_score"] is None
    assert layout(df).columns == ["Branch", "extra", "Review_Text", "Year_Month", "review_uid"]
    assert ensure_columns(full, ENRICHMENT).columns == full.columns


def test_peek(spark):
    df = spark.range(20).withColumn("t", F.lit("x"))
    assert paging.peek(df).count() == 5
    assert [tuple(r) for r in paging.columns_of(df).collect()] == [("id", "bigint"), ("t", "string")]
