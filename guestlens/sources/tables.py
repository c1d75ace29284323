"""Reviews, questions and answers made from the test tables, as stand-ins for real input.

The ``*_SQL`` texts define the same views for the SQL checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

REVIEWS_SQL = """
SELECT k.review_uid, k.Branch, k.Rating, k.Year_Month, k.Reviewer_Location, k.Review_Text,
 k.sentiment_score,
 CASE WHEN k.sentiment_score IS NULL THEN NULL WHEN k.sentiment_score <= 2 THEN 'Negative' WHEN k.sentiment_score = 3 THEN 'Neutral' ELSE 'Positive' END AS sentiment_label,
 CASE WHEN k.sentiment_score IS NULL THEN NULL ELSE k.sentiment_score <= 3 AND k.status = 'F' END AS is_complaint,
 CASE WHEN k.sentiment_score IS NULL THEN NULL ELSE split(k.topic_csv, ',') END AS topics,
 CASE WHEN k.h = 3 THEN 'Crowded' WHEN k.h = 5 THEN 'Empty' WHEN k.h = 7 THEN 'None' ELSE NULL END AS crowd_level,
 CASE WHEN k.h = 2 THEN 'Neutral' WHEN k.h = 6 THEN 'Rude' WHEN k.h = 7 THEN 'None' ELSE NULL END AS staff_sentiment,
 CASE WHEN k.h = 4 THEN 'Rip-off' WHEN k.h = 8 THEN 'Cheap' ELSE NULL END AS price_sensitivity,
 CASE WHEN k.h = 1 THEN 'Joyful' WHEN k.h = 9 THEN 'Tired' ELSE NULL END AS family_sentiment
FROM (
 SELECT o.o_orderkey AS review_uid, o.o_orderstatus AS status, o.o_orderkey % 13 AS h,
  CASE r.r_name WHEN 'ASIA' THEN 'Disneyland_HongKong' WHEN 'AMERICA' THEN 'Disneyland_California' WHEN 'EUROPE' THEN 'Disneyland_Paris' WHEN 'AFRICA' THEN 'Disney_World_Florida' ELSE NULL END AS Branch,
  6 - CAST(substr(o.o_orderpriority,1,1) AS INT) AS Rating,
  CASE WHEN o.o_orderkey % 97 = 0 THEN 'missing' ELSE concat(CAST(year(o.o_orderdate) AS STRING),'-',CAST(month(o.o_orderdate) AS STRING)) END AS Year_Month,
  n.n_name AS Reviewer_Location,
  CASE WHEN o.o_orderkey % 11 = 0 THEN NULL
       WHEN month(o.o_orderdate) IN (6,7,8) AND o.o_orderkey % 7 IN (0,2) THEN CAST(1 + (o.o_orderkey * 7 + CAST(substr(o.o_orderpriority,1,1) AS INT)) % 3 AS INT)
       WHEN month(o.o_orderdate) IN (3,4,5) AND o.o_orderkey % 7 = 3 THEN CAST(3 + (o.o_orderkey * 7 + CAST(substr(o.o_orderpriority,1,1) AS INT)) % 3 AS INT)
       ELSE CAST(1 + (o.o_orderkey * 7 + CAST(substr(o.o_orderpriority,1,1) AS INT)) % 5 AS INT) END AS sentiment_score,
  CASE WHEN o.o_orderkey % 151 = 0 THEN 'Weather' ELSE CASE o.o_orderkey % 7 WHEN 0 THEN 'Queues,Food' WHEN 1 THEN 'Staff service' WHEN 2 THEN 'Ticket Price,Waiting staff' WHEN 3 THEN 'Rides,Cleanliness' WHEN 4 THEN 'Family' WHEN 5 THEN 'Parking' ELSE 'Crowds,Dining,Cost' END END AS topic_csv,
  concat(CASE o.o_orderkey % 10 WHEN 0 THEN 'The park was Packed and the staff were rude.' WHEN 1 THEN 'Quiet day, walk on rides and friendly cast.' WHEN 2 THEN 'Overpriced food but helpful people.' WHEN 3 THEN 'Long lines everywhere, still worth it.' WHEN 4 THEN 'A moderate crowd and reasonable tickets.' WHEN 5 THEN 'Empty in the morning, crowded at noon.' WHEN 6 THEN 'Unpacked our bags; it was meaningful.' WHEN 7 THEN 'A rip off.' WHEN 8 THEN 'Nice but pricey.' ELSE 'Lovely castle.' END, ' ', COALESCE(d.text, '')) AS Review_Text
 FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
 LEFT JOIN documents d ON d.doc_id = o.o_orderkey
) k
"""

# One filter specification per kind of question; the kind is a number from 0 to 15.
_SPECS = [
    '{"intent":"search_reviews","branch":"Paris","staff_sentiment":"Rude","reasoning":"r"}',
    '{"branch":"disneyland_hongkong","reviewer_location":"nation_2","reasoning":"r"}',
    '{"season":"spring","branch":"Disneyland_HongKong","reasoning":"r"}',
    '{"month":6,"branch":"Anaheim park","reasoning":"r"}',
    '{"topics":["Food","queues","RIDES"],"reasoning":"r"}',
    '{"sentiment_label":"Negative","is_complaint":false,"reasoning":"r"}',
    '{"crowd_level":"Crowded","topics":["Family"],"reviewer_location":"Nation_3","reasoning":"r"}',
    '{"unsupported_entity":"Tel-Aviv","reasoning":"r"}',
    '{"unsupported_entity":"Hong Kong","topics":[],"reasoning":"r"}',
    '{"season":"Autumn","family_sentiment":"Joyful","reasoning":"r"}',
    'no specification at all',
    '{"intent":"search_reviews","reasoning":"nothing to filter"}',
    '{"intent":"view_report","branch":"Disneyland_Paris","reasoning":"r"}',
    '{"intent":"capability_discovery","reasoning":"r"}',
    '{"year_month":"1995-3","branch":"orlando","price_sensitivity":"Rip-off","reasoning":"r"}',
    '{"branch":"Disneyland","reasoning":"r"}',
]
_PHRASES = [
    "Is the staff in Paris friendly?", "What do visitors from nation 2 say?", "Is spring a good time to visit?",
    "Is it crowded in June?", "How is the food?", "What is the worst complaint?",
    "Do families like it? What charts are available?", "Tell me more.",
]


def _case(kind: str, values: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {kind} {whens} END"


_KIND = "(conv_id * 7 + turn) % 16"
_GUESSED_KIND = "CASE WHEN (conv_id + turn) % 4 = 0 THEN (conv_id * 7 + turn + 1) % 16 ELSE (conv_id * 7 + turn) % 16 END"
_PHRASE_KIND = "(conv_id * 7 + turn) % 8"
QUESTION_COLUMNS = {
    "qid": "conv_id * 1000000 + turn",
    "question": f"concat({_case(_PHRASE_KIND, _PHRASES)}, ' ', text)",
    "spec_json": _case(_KIND, _SPECS),
    "guessed_json": _case(_GUESSED_KIND, _SPECS),
}
QUESTIONS_SQL = (
    "SELECT " + ", ".join(f"{e} AS {n}" for n, e in QUESTION_COLUMNS.items())
    + " FROM conversations WHERE role = 'user'"
)
ANSWERS_SQL = """
SELECT a.conv_id, a.turn, a.text AS answer,
 list_slice(split(q.text, ' '), 1, 3) AS expected,
 list_concat(['cannot answer', 'no specific filters'], list_slice(split(q.text, ' '), 4, 4)) AS forbidden
FROM conversations a JOIN conversations q ON q.conv_id = a.conv_id AND q.turn = a.turn - 1
WHERE a.role = 'assistant' AND q.role = 'user'
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_PRIORITY = "CAST(substr(o_orderpriority, 1, 1) AS INT)"
_DRAW = f"(o_orderkey * 7 + {_PRIORITY})"
_REVIEW_COLUMNS = {
    "review_uid": "o_orderkey",
    "Branch": "CASE r_name WHEN 'ASIA' THEN 'Disneyland_HongKong' WHEN 'AMERICA' THEN 'Disneyland_California' "
              "WHEN 'EUROPE' THEN 'Disneyland_Paris' WHEN 'AFRICA' THEN 'Disney_World_Florida' END",
    "Rating": f"6 - {_PRIORITY}",
    "Year_Month": "if(o_orderkey % 97 = 0, 'missing', concat(year(o_orderdate), '-', month(o_orderdate)))",
    "Reviewer_Location": "n_name",
    "sentiment_score": "CAST(CASE WHEN o_orderkey % 11 = 0 THEN NULL "
                       f"WHEN month(o_orderdate) IN (6, 7, 8) AND o_orderkey % 7 IN (0, 2) THEN 1 + {_DRAW} % 3 "
                       f"WHEN month(o_orderdate) IN (3, 4, 5) AND o_orderkey % 7 = 3 THEN 3 + {_DRAW} % 3 "
                       f"ELSE 1 + {_DRAW} % 5 END AS INT)",
    "topics": "CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 151 = 0 THEN array('Weather') ELSE "
              "array(array('Queues', 'Food'), array('Staff service'), array('Ticket Price', 'Waiting staff'), "
              "array('Rides', 'Cleanliness'), array('Family'), array('Parking'), "
              "array('Crowds', 'Dining', 'Cost'))[CAST(o_orderkey % 7 AS INT)] END",
    "crowd_level": "CASE o_orderkey % 13 WHEN 3 THEN 'Crowded' WHEN 5 THEN 'Empty' WHEN 7 THEN 'None' END",
    "staff_sentiment": "CASE o_orderkey % 13 WHEN 2 THEN 'Neutral' WHEN 6 THEN 'Rude' WHEN 7 THEN 'None' END",
    "price_sensitivity": "CASE o_orderkey % 13 WHEN 4 THEN 'Rip-off' WHEN 8 THEN 'Cheap' END",
    "family_sentiment": "CASE o_orderkey % 13 WHEN 1 THEN 'Joyful' WHEN 9 THEN 'Tired' END",
}
_REVIEW_TEXT = (
    "concat(array('The park was Packed and the staff were rude.', 'Quiet day, walk on rides and friendly cast.', "
    "'Overpriced food but helpful people.', 'Long lines everywhere, still worth it.', "
    "'A moderate crowd and reasonable tickets.', 'Empty in the morning, crowded at noon.', "
    "'Unpacked our bags; it was meaningful.', 'A rip off.', 'Nice but pricey.', 'Lovely castle.')"
    "[CAST(o_orderkey % 10 AS INT)], ' ', coalesce(doc_text, ''))"
)
_LABELS = [
    "CASE WHEN sentiment_score <= 2 THEN 'Negative' WHEN sentiment_score = 3 THEN 'Neutral' "
    "WHEN sentiment_score > 3 THEN 'Positive' END AS sentiment_label",
    "if(sentiment_score IS NULL, NULL, sentiment_score <= 3 AND o_orderstatus = 'F') AS is_complaint",
]


def reviews(spark: SparkSession, sf_dir: str, text: bool = True) -> DataFrame:
    """One review per order.  ``text=False`` leaves out the text column and the join it needs."""
    orders, customer, nation, region = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation", "region"))
    base = (
        orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    columns = dict(_REVIEW_COLUMNS)
    if text:
        documents = table(spark, sf_dir, "documents").selectExpr("doc_id", "text AS doc_text")
        base = base.join(documents, F.col("doc_id") == F.col("o_orderkey"), "left")
        columns["Review_Text"] = _REVIEW_TEXT
    rows = base.selectExpr("o_orderstatus", *[f"{e} AS {n}" for n, e in columns.items()])
    return rows.selectExpr(*columns, *_LABELS)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per user turn, with its specification and a router's guess of it."""
    asked = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return asked.selectExpr(*[f"{e} AS {n}" for n, e in QUESTION_COLUMNS.items()])


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as answers to the user turn before them, with expected and forbidden words."""
    turns = table(spark, sf_dir, "conversations")
    words = F.split("q_text", " ")
    asked = turns.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("q_text"))
    return turns.filter("role = 'assistant'").join(asked, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.col("text").alias("answer"),
        F.slice(words, 1, 3).alias("expected"),
        F.concat(F.array(F.lit("cannot answer"), F.lit("no specific filters")), F.slice(words, 4, 1)).alias("forbidden"),
    )
