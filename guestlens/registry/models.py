"""Queries: enrichment, joins of the resumable job, vectors, questions and quality checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from guestlens import fixed_values as fixed
from guestlens.functions import models, words
from guestlens.functions.text import park_name
from guestlens.functions.vectors import cosine
from guestlens.operators import dialogue, insights, joins, quality
from guestlens.operators.profile import progress
from guestlens.plans import answers, enrichment, quant, search
from guestlens.registry.base import PARK, REVIEWS, SEASONED, as_bigint, as_text, keyword_case, light_reviews, pattern_hit, query, rounded
from guestlens.schema import ENRICHMENT
from guestlens.session import use_checkpoints
from guestlens.sources import tables

UID = "CAST(review_uid AS BIGINT) AS review_uid"
FIELDS = ENRICHMENT.fieldNames()


# --- enrichment ---------------------------------------------------------------------------

def _hits(word_list):
    return "(" + " + ".join(f"CASE WHEN {pattern_hit('Review_Text', [w])} THEN 1 ELSE 0 END" for w in word_list) + ")"


def _topics_sql():
    cases = ", ".join(f"CASE WHEN {pattern_hit('Review_Text', w)} THEN '{n}' END" for n, w in models.TOPIC_WORDS)
    return f"array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), '|')"


def _family_sql():
    whens = " ".join(f"WHEN {pattern_hit('Review_Text', w)} THEN '{n}'" for n, w in models.FAMILY_WORDS)
    return f"CASE {whens} END"


LABELLED_SQL = REVIEWS.replace("WITH reviews", "WITH raw") + f"""
, bare AS (SELECT review_uid, Review_Text, CAST(NULL AS VARCHAR) AS crowd_level, CAST(NULL AS VARCHAR) AS staff_sentiment, CAST(NULL AS VARCHAR) AS price_sensitivity FROM raw),
 counted AS (SELECT *, {_hits(models.GOOD_WORDS)} AS good, {_hits(models.BAD_WORDS)} AS bad FROM bare),
 scored AS (SELECT *, least(5, greatest(1, 3 + good - bad)) AS score FROM counted)
SELECT {UID}, CAST(score AS BIGINT) AS sentiment_score, CASE WHEN score < 3 THEN 'Negative' WHEN score = 3 THEN 'Neutral' ELSE 'Positive' END AS sentiment_label,
 {_topics_sql()} AS topics, bad > 0 AS is_complaint, {keyword_case('crowd_level')} AS crowd_level, {keyword_case('staff_sentiment')} AS staff_sentiment,
 {keyword_case('price_sensitivity')} AS price_sensitivity, {_family_sql()} AS family_sentiment FROM scored"""


@query("model_enrichment", LABELLED_SQL)
def model_enrichment(spark, sf):
    raw = tables.reviews(spark, sf).select("review_uid", "Review_Text")
    labelled = models.annotate(raw).select("review_uid", *FIELDS)
    return as_bigint(labelled.withColumn("topics", as_text("topics")), "sentiment_score")


@query("json_expand", "SELECT CAST(event_id AS BIGINT) AS event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS none FROM events")
def json_expand(spark, sf):
    events = tables.table(spark, sf, "events").select("event_id", "props")
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("none", T.StringType())])
    return models.expand_json(events, "props", schema).drop("props")


@query("not_yet_enriched", REVIEWS + f" SELECT {UID}, Rating::BIGINT AS Rating FROM reviews WHERE sentiment_score IS NULL")
def not_yet_enriched(spark, sf):
    r = light_reviews(spark, sf)
    done = r.filter(F.col("sentiment_score").isNotNull())
    return as_bigint(joins.not_yet_done(r, done).select("review_uid", "Rating"), "Rating")


def _checkpoint(r):
    """Saved results made from the reviews: all once, those with high ratings twice."""
    nothing = F.lit(None).cast("string")

    def saved(rows, seq, score, label, crowd):
        return rows.select(
            "review_uid", F.lit(seq).alias("seq"), score.alias("sentiment_score"), F.lit(label).alias("sentiment_label"),
            F.array(F.lit("Food")).alias("topics"), F.lit(True).alias("is_complaint"), F.lit(crowd).alias("crowd_level"),
            nothing.alias("staff_sentiment"), nothing.alias("price_sensitivity"), nothing.alias("family_sentiment"))

    first = saved(r, 1, F.when(F.col("Rating") > 1, F.col("Rating")), "First", "Packed")
    return first.unionByName(saved(r.filter("Rating >= 4"), 2, 6 - F.col("Rating"), "Second", "Moderate"))


CHECKPOINT_SQL = REVIEWS + """
, saved AS (SELECT review_uid, 1 AS seq, CASE WHEN Rating > 1 THEN Rating END AS score, 'First' AS label, 'Packed' AS crowd FROM reviews
  UNION ALL SELECT review_uid, 2, 6 - Rating, 'Second', 'Moderate' FROM reviews WHERE Rating >= 4),
 last AS (SELECT review_uid, max_by(score, seq) AS score, max_by(label, seq) AS label, max_by(crowd, seq) AS crowd FROM saved WHERE score IS NOT NULL GROUP BY 1)"""
MERGED = ["review_uid", "sentiment_score", "sentiment_label", "topics", "is_complaint", "crowd_level", "staff_sentiment"]


def _merged(df):
    return as_bigint(df.select(*MERGED).withColumn("topics", as_text("topics")), "sentiment_score")


@query("checkpoint_merge", CHECKPOINT_SQL + """
SELECT CAST(r.review_uid AS BIGINT) AS review_uid, CAST(coalesce(r.sentiment_score, l.score) AS BIGINT) AS sentiment_score, coalesce(r.sentiment_label, l.label) AS sentiment_label,
 coalesce(array_to_string(r.topics, '|'), CASE WHEN l.review_uid IS NOT NULL THEN 'Food' END) AS topics,
 coalesce(r.is_complaint, CASE WHEN l.review_uid IS NOT NULL THEN true END) AS is_complaint, coalesce(r.crowd_level, l.crowd) AS crowd_level, r.staff_sentiment
FROM reviews r LEFT JOIN last l ON l.review_uid = r.review_uid""")
def checkpoint_merge(spark, sf):
    r = light_reviews(spark, sf)
    return _merged(joins.fill_from_checkpoint(r, _checkpoint(r), order=F.col("seq")))


@query("result_upsert", CHECKPOINT_SQL.replace("WHERE score IS NOT NULL GROUP BY 1", "WHERE seq = 2 GROUP BY 1") + """
SELECT CAST(r.review_uid AS BIGINT) AS review_uid, CAST(CASE WHEN l.review_uid IS NOT NULL THEN l.score ELSE r.sentiment_score END AS BIGINT) AS sentiment_score,
 CASE WHEN l.review_uid IS NOT NULL THEN l.label ELSE r.sentiment_label END AS sentiment_label,
 CASE WHEN l.review_uid IS NOT NULL THEN 'Food' ELSE array_to_string(r.topics, '|') END AS topics,
 CASE WHEN l.review_uid IS NOT NULL THEN true ELSE r.is_complaint END AS is_complaint,
 CASE WHEN l.review_uid IS NOT NULL THEN l.crowd ELSE r.crowd_level END AS crowd_level,
 CASE WHEN l.review_uid IS NOT NULL THEN NULL ELSE r.staff_sentiment END AS staff_sentiment
FROM reviews r LEFT JOIN last l ON l.review_uid = r.review_uid""")
def result_upsert(spark, sf):
    r = light_reviews(spark, sf)
    return _merged(joins.overwrite_from_results(r, _checkpoint(r).filter("seq = 2"), order=F.col("seq")))


@query("model_first_merge", CHECKPOINT_SQL + """
SELECT CAST(r.review_uid AS BIGINT) AS review_uid, CAST(coalesce(l.score, r.sentiment_score) AS BIGINT) AS sentiment_score, coalesce(l.label, r.sentiment_label) AS sentiment_label,
 CASE WHEN l.review_uid IS NOT NULL THEN 'Food' ELSE array_to_string(r.topics, '|') END AS topics,
 coalesce(CASE WHEN l.review_uid IS NOT NULL THEN true END, r.is_complaint) AS is_complaint, coalesce(l.crowd, r.crowd_level) AS crowd_level, r.staff_sentiment
FROM reviews r LEFT JOIN last l ON l.review_uid = r.review_uid""")
def model_first_merge(spark, sf):
    r = light_reviews(spark, sf)
    scored = _checkpoint(r).filter(F.col("sentiment_score").isNotNull())
    last = joins.last_per_key(scored, "review_uid", F.col("seq"), FIELDS)
    return _merged(enrichment.merged(r, last, "model"))


@query("progress_after_merge", CHECKPOINT_SQL + """
, m AS (SELECT coalesce(r.sentiment_score, l.score) AS score FROM reviews r LEFT JOIN last l ON l.review_uid = r.review_uid)
SELECT count(*) AS total, count(score) AS enriched, count(*) FILTER (WHERE score IS NULL) AS remaining FROM m""")
def progress_after_merge(spark, sf):
    r = light_reviews(spark, sf)
    return progress(joins.fill_from_checkpoint(r, _checkpoint(r), order=F.col("seq")))


# --- vectors ------------------------------------------------------------------------------

PLACE = f"CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % {models.EMBEDDING_SIZE}"


def _places_sql(name, key, text, source):
    return f"""{name}_words AS (SELECT {key}, unnest(string_split(lower({text}), ' ')) AS w FROM {source}),
 {name} AS (SELECT {key}, {PLACE} AS place, count(*) AS n FROM {name}_words WHERE w <> '' GROUP BY ALL),
 {name}_norm AS (SELECT {key}, sum(n * n) AS ss FROM {name} GROUP BY 1)"""


@query("review_embeddings", REVIEWS + ", " + _places_sql("v", "review_uid", "Review_Text", "reviews") + """
SELECT CAST(review_uid AS BIGINT) AS review_uid, count(*) AS places, CAST(sum(n) AS DOUBLE) AS words, CAST(sum(n * (place + 1)) AS DOUBLE) AS weighted FROM v GROUP BY 1""")
def review_embeddings(spark, sf):
    texts = tables.reviews(spark, sf).select("review_uid", "Review_Text")
    vectors = search.with_embeddings(texts, "Review_Text")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return vectors.select(
        "review_uid",
        F.size(F.filter("vector", lambda x: x > 0)).cast("bigint").alias("places"),
        total("vector").alias("words"),
        total(F.transform("vector", lambda x, i: x * (i + 1))).alias("weighted"),
    )


CENTROIDS_SQL = """WITH places AS (SELECT label, generate_subscripts(embedding, 1) AS place, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
 means AS (SELECT label, place, avg(x) AS m FROM places GROUP BY 1, 2),
 centroids AS (SELECT label, list(m ORDER BY place) AS q FROM means GROUP BY 1),
 sims AS (SELECT e.label, e.vec_id, list_dot_product(CAST(e.embedding AS DOUBLE[]), c.q)
   / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(c.q, c.q))) AS sim
  FROM embeddings e JOIN centroids c ON c.label = e.label)"""


def _centroids(items):
    return search.mean_vectors(items, "label", "embedding").withColumn("query", F.col("label"))


@query("cosine_similarity", CENTROIDS_SQL + " SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(label AS BIGINT) AS label, round(sim, 5) AS similarity FROM sims")
def cosine_similarity(spark, sf):
    items = tables.table(spark, sf, "embeddings")
    scored = items.join(_centroids(items), "label").withColumn("similarity", cosine(F.col("embedding"), F.col("query_vector")))
    return as_bigint(rounded(scored, "similarity", digits=5).select("vec_id", "label", "similarity"), "label")


@query("filtered_vector_search", CENTROIDS_SQL + """
, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS rank FROM sims)
SELECT CAST(label AS BIGINT) AS query, CAST(vec_id AS BIGINT) AS vec_id, CAST(rank AS BIGINT) AS rank, round(sim, 5) AS similarity FROM r WHERE rank <= 5""")
def filtered_vector_search(spark, sf):
    items = tables.table(spark, sf, "embeddings")
    found = search.filtered_search(_centroids(items), items, ["label"], "query", "vec_id", vector="embedding")
    return as_bigint(rounded(found, "similarity", digits=5), "query", "rank")


@query("open_vector_search", CENTROIDS_SQL.replace("""FROM embeddings e JOIN centroids c ON c.label = e.label""", """FROM embeddings e JOIN centroids c
   ON (c.label % 3 = 2 OR c.label = e.label) AND (c.label % 3 > 0 OR e.vec_id % 2 = 1)""").replace("SELECT e.label, e.vec_id,", "SELECT c.label, e.vec_id, e.label AS found,") + """
, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS rank FROM sims)
SELECT CAST(label AS BIGINT) AS query, CAST(vec_id AS BIGINT) AS vec_id, CAST(rank AS BIGINT) AS rank, round(sim, 5) AS similarity, CAST(found AS BIGINT) AS label
FROM r WHERE rank <= 5""")
def open_vector_search(spark, sf):
    """Queries that set both filters, one, or none."""
    items = tables.table(spark, sf, "embeddings").withColumn("odd", F.col("vec_id") % 2 == 1)
    asked = _centroids(items).withColumns({
        "odd": F.when(F.col("label") % 3 == 0, True), "label": F.when(F.col("label") % 3 < 2, F.col("label"))})
    found = search.filtered_search(asked, items, ["label", "odd"], "query", "vec_id", vector="embedding", shown=["label"])
    return as_bigint(rounded(found, "similarity", digits=5), "query", "rank", "label")


# --- questions ----------------------------------------------------------------------------

def _text_field(name):
    return f"json_extract_string(j, '$.{name}') AS {name}"


TEXT_FIELDS = ["sentiment_label", "crowd_level", "staff_sentiment", "price_sensitivity", "family_sentiment",
               "reviewer_location", "branch", "year_month", "season", "unsupported_entity"]


def _specs_sql(column):
    return f"""(SELECT qid, question, j IS NOT NULL AND json_extract_string(j, '$.reasoning') IS NOT NULL AS parsed,
  coalesce(json_extract_string(j, '$.intent'), 'search_reviews') AS intent, {', '.join(_text_field(n) for n in TEXT_FIELDS)},
  CAST(json_extract(j, '$.topics') AS VARCHAR[]) AS topics, CAST(json_extract_string(j, '$.is_complaint') AS BOOLEAN) AS is_complaint,
  CAST(json_extract_string(j, '$.month') AS INTEGER) AS month
 FROM (SELECT qid, question, CASE WHEN json_valid({column}) THEN {column} END AS j FROM questions))"""


ALIAS_SQL = (
    "CASE WHEN d.Branch IS NOT NULL THEN d.Branch WHEN e = '' THEN NULL "
    + " ".join(f"WHEN lower(e) = '{a}' THEN " + (f"'{p}'" if p else "NULL") for a, p in fixed.PARK_ALIASES)
    + " " + " ".join(f"WHEN contains(lower(e), '{a}') THEN '{p}'" for a, p in fixed.PARK_ALIASES if p) + " ELSE e END"
)
QUESTIONS = f"{SEASONED}, questions AS ({tables.QUESTIONS_SQL}), specs AS {_specs_sql('spec_json')}"
GUARDED = f"""{QUESTIONS}, parks AS (SELECT DISTINCT Branch FROM reviews WHERE Branch IS NOT NULL),
 park_list AS (SELECT string_agg(Branch, ', ' ORDER BY Branch) AS names FROM parks),
 entities AS (SELECT *, CASE WHEN intent = 'search_reviews' THEN coalesce(unsupported_entity, branch) END AS e FROM specs),
 named AS (SELECT s.*, {ALIAS_SQL} AS park FROM entities s LEFT JOIN parks d ON lower(d.Branch) = lower(s.e)),
 settled AS (SELECT * EXCLUDE (branch, unsupported_entity),
   CASE WHEN intent = 'search_reviews' AND NOT (unsupported_entity IS NOT NULL AND park IS NULL) THEN coalesce(park, branch) ELSE branch END AS branch,
   CASE WHEN intent <> 'search_reviews' OR park IS NULL THEN unsupported_entity END AS unsupported_entity FROM named),
 guarded AS (SELECT *, CASE WHEN intent <> 'search_reviews' THEN NULL WHEN unsupported_entity IS NOT NULL THEN unsupported_entity
   WHEN branch IS NOT NULL AND branch NOT IN (SELECT Branch FROM parks) THEN branch END AS refusal_reason FROM settled)"""
ASKED = f"""{GUARDED}, asked AS (SELECT *, CASE WHEN branch IS NULL OR season IS NULL THEN NULL WHEN lower(season) = 'spring' THEN [3,4,5] WHEN lower(season) = 'summer' THEN [6,7,8]
   WHEN lower(season) = 'autumn' THEN [9,10,11] WHEN lower(season) = 'winter' THEN [12,1,2] END AS months
  FROM guarded WHERE intent = 'search_reviews' AND refusal_reason IS NULL AND NOT (topics IS NULL AND is_complaint IS NULL AND month IS NULL AND {' AND '.join(f'{n} IS NULL' for n in TEXT_FIELDS)})),
 hits AS (SELECT q.qid, r.review_uid, r.sentiment_label FROM asked q JOIN seasoned r ON
  (q.months IS NULL OR list_contains(q.months, r.visit_month)) AND (q.month IS NULL OR r.visit_month = q.month)
  AND (q.sentiment_label IS NULL OR r.sentiment_label = q.sentiment_label) AND (q.is_complaint IS NULL OR r.is_complaint = q.is_complaint)
  AND (q.crowd_level IS NULL OR r.crowd_level = q.crowd_level) AND (q.staff_sentiment IS NULL OR r.staff_sentiment = q.staff_sentiment)
  AND (q.price_sensitivity IS NULL OR r.price_sensitivity = q.price_sensitivity) AND (q.family_sentiment IS NULL OR r.family_sentiment = q.family_sentiment)
  AND (q.reviewer_location IS NULL OR lower(r.Reviewer_Location) = lower(q.reviewer_location)) AND (q.branch IS NULL OR lower(r.Branch) = lower(q.branch))
  AND (q.year_month IS NULL OR r.Year_Month = q.year_month)
  AND (q.topics IS NULL OR len(q.topics) = 0 OR list_has_any(list_transform(r.topics, lambda t: lower(t)), list_transform(q.topics, lambda t: lower(t))))),
 matches AS (SELECT q.qid, count(h.review_uid) AS matches FROM asked q LEFT JOIN hits h ON h.qid = q.qid GROUP BY 1),
 pool AS (SELECT * FROM (SELECT qid, review_uid, row_number() OVER (PARTITION BY qid ORDER BY review_uid) AS rank FROM hits) WHERE rank <= 150)"""


def _guarded(spark, sf):
    r = light_reviews(spark, sf)
    return r, insights.valid_branches(r), answers.settled_questions(r, tables.questions(spark, sf))


@query("filter_specs", QUESTIONS + f"""
SELECT CAST(qid AS BIGINT) AS qid, parsed, intent, array_to_string(topics, '|') AS topics, is_complaint, CAST(month AS BIGINT) AS month, {', '.join(TEXT_FIELDS)} FROM specs""")
def filter_specs(spark, sf):
    specs = answers.parse_specs(tables.questions(spark, sf)).withColumn("topics", as_text("topics"))
    return as_bigint(specs.select("qid", "parsed", "intent", *answers.SPEC_FIELDS), "month")


@query("park_aliases", REVIEWS + f"""
, parks AS (SELECT DISTINCT Branch FROM reviews WHERE Branch IS NOT NULL), named AS (SELECT review_uid, {PARK} AS e FROM reviews)
SELECT CAST(n.review_uid AS BIGINT) AS review_uid, e AS entity, {ALIAS_SQL} AS park FROM named n LEFT JOIN parks d ON lower(d.Branch) = lower(n.e)""")
def park_aliases(spark, sf):
    r = light_reviews(spark, sf)
    entities = r.select("review_uid", park_name(F.col("Branch")).alias("entity"))
    return answers.resolve_parks(entities, insights.valid_branches(r), "entity", "park")


@query("guardrail", GUARDED + """
SELECT CAST(qid AS BIGINT) AS qid, intent, branch, unsupported_entity, refusal_reason,
 CASE WHEN refusal_reason IS NOT NULL THEN concat('I do not have data about ', refusal_reason, '. I only have data for: ', (SELECT names FROM park_list), '.') END AS refusal FROM guarded""")
def guardrail(spark, sf):
    branches = insights.valid_branches(light_reviews(spark, sf))
    return answers.guard(answers.parse_specs(tables.questions(spark, sf)), branches).select("qid", "intent", "branch", "unsupported_entity", "refusal_reason", "refusal")


@query("question_matches", ASKED + " SELECT CAST(qid AS BIGINT) AS qid, matches FROM matches")
def question_matches(spark, sf):
    r, _, guarded = _guarded(spark, sf)
    asked = answers.searches(guarded)
    found = asked.join(answers.matcher(r, asked).counts(), "spec_key", "left")
    return found.select("qid", F.coalesce("matches", F.lit(0).cast("bigint")).alias("matches"))


@query("question_distribution", ASKED + """
, c AS (SELECT qid, sentiment_label, count(*) AS n FROM hits WHERE sentiment_label IS NOT NULL GROUP BY 1, 2),
 s AS (SELECT *, n / sum(n) OVER (PARTITION BY qid) * 100 AS share FROM c),
 t AS (SELECT qid, string_agg(concat(sentiment_label, ' (', printf('%.1f', share), '%)'), ', ' ORDER BY n DESC, sentiment_label) AS d FROM s GROUP BY qid)
SELECT CAST(a.qid AS BIGINT) AS qid, coalesce(t.d, 'N/A') AS distribution FROM asked a LEFT JOIN t ON t.qid = a.qid""")
def question_distribution(spark, sf):
    r, _, guarded = _guarded(spark, sf)
    return answers.question_distributions(r, answers.searches(guarded)).select("qid", "distribution")


@query("match_summary", ASKED + """
, whole AS (SELECT count(*) AS n, count(sentiment_score) * 100.0 / count(*) AS cov FROM reviews)
SELECT CAST(qid AS BIGINT) AS qid, matches, concat('[v4: reviews_enriched_v4.parquet (', printf('%.1f', cov), '% Enriched)] Found ', CAST(matches AS VARCHAR), ' matches of ',
 CAST(n AS VARCHAR), ' entries. Using top ', CAST(least(matches, 5) AS VARCHAR), '.') AS summary FROM matches, whole""")
def match_summary(spark, sf):
    r, _, guarded = _guarded(spark, sf)
    return answers.match_summaries(r, answers.searches(guarded)).select("qid", "matches", "summary")


@query("candidate_pool", ASKED + " SELECT CAST(qid AS BIGINT) AS qid, CAST(review_uid AS BIGINT) AS review_uid, CAST(rank AS BIGINT) AS rank FROM pool")
def candidate_pool(spark, sf):
    r, _, guarded = _guarded(spark, sf)
    asked = answers.searches(guarded)
    return as_bigint(asked.select("qid", "spec_key").join(answers.candidates(r, asked), "spec_key").drop("spec_key"), "rank")


TOP_SQL = ASKED + ", " + _places_sql("v", "review_uid", "Review_Text", "(SELECT * FROM reviews WHERE review_uid IN (SELECT review_uid FROM hits))") + ", " + \
    _places_sql("w", "qid", "question", "asked") + f""",
 dots AS (SELECT p.qid, p.review_uid, sum(v.n * w.n) AS d FROM hits p JOIN v ON v.review_uid = p.review_uid JOIN w ON w.qid = p.qid AND w.place = v.place GROUP BY 1, 2),
 sims AS (SELECT p.qid, p.review_uid, coalesce(d.d, 0) / (sqrt(CAST(a.ss AS DOUBLE)) * sqrt(CAST(b.ss AS DOUBLE))) AS sim FROM hits p
  LEFT JOIN dots d ON d.qid = p.qid AND d.review_uid = p.review_uid JOIN v_norm a ON a.review_uid = p.review_uid JOIN w_norm b ON b.qid = p.qid),
 top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, review_uid) AS rank FROM sims) WHERE rank <= 5)"""


@query("semantic_top_reviews", TOP_SQL + " SELECT CAST(qid AS BIGINT) AS qid, CAST(review_uid AS BIGINT) AS review_uid, CAST(rank AS BIGINT) AS rank, round(sim, 6) AS similarity FROM top")
def semantic_top_reviews(spark, sf):
    _, _, guarded = _guarded(spark, sf)
    top = answers.top_reviews(tables.reviews(spark, sf), answers.searches(guarded))
    return as_bigint(rounded(top, "similarity"), "rank")


@query("answer_context", TOP_SQL + """
SELECT CAST(t.qid AS BIGINT) AS qid, string_agg(concat(CAST(t.rank AS VARCHAR), '. ', coalesce(r.Review_Text, ''), ' (Topics: ', coalesce(array_to_string(r.topics, ', '), ''),
 ', Branch: ', coalesce(r.Branch, ''), ')'), chr(10) ORDER BY t.rank) AS context FROM top t JOIN reviews r ON r.review_uid = t.review_uid GROUP BY t.qid""")
def answer_context(spark, sf):
    _, _, guarded = _guarded(spark, sf)
    r = tables.reviews(spark, sf)
    return answers.answer_contexts(answers.context_rows(answers.top_reviews(r, answers.searches(guarded)), r))


def _said(word_list):
    return "(" + " OR ".join(f"contains(lower(question), '{w}')" for w in word_list) + ")"


def _charts_sql():
    extra = {"staff": "len(list_filter(coalesce(topics, []), lambda t: contains(lower(t), 'staff'))) > 0",
             "crowd": "len(list_filter(coalesce(topics, []), lambda t: contains(lower(t), 'queue'))) > 0",
             "country": "reviewer_location IS NOT NULL", "drivers": "coalesce(sentiment_label = 'Negative', false)"}
    rows = []
    for i, (title, kind, path) in enumerate(fixed.GLOBAL_CHARTS):
        wanted = _said(fixed.CHART_QUESTION_WORDS[kind]) + (f" OR {extra[kind]}" if kind in extra else "")
        rows.append(f"SELECT qid, 1000000 + {i} AS ord, '{title}' AS title, '{kind}' AS type, '{path}' AS path FROM shown "
                    f"WHERE intent = 'view_report' OR (intent = 'search_reviews' AND ({wanted}))")
    return GUARDED + f"""
, shown AS (SELECT *, intent = 'view_report' AND {_said(fixed.LIST_CHART_WORDS)} AS lists FROM guarded WHERE refusal_reason IS NULL),
 numbered AS (SELECT Branch, row_number() OVER (ORDER BY Branch) AS n FROM parks),
 charts AS (SELECT qid, n AS ord, concat('Theme Sentiment: ', replace(p.Branch, '_', ' ')) AS title, 'sent_heatmap' AS type, concat('/plots/insight1_', p.Branch, '.png') AS path
  FROM shown JOIN numbered p ON lists OR (intent IN ('search_reviews', 'view_report') AND p.Branch = shown.branch)
  UNION ALL {' UNION ALL '.join(rows)})
SELECT CAST(qid AS BIGINT) AS qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY ord) - 1 AS BIGINT) AS position, title, type, path FROM charts"""


@query("chart_selection", _charts_sql())
def chart_selection(spark, sf):
    _, branches, guarded = _guarded(spark, sf)
    return as_bigint(answers.chart_selection(guarded, branches), "position")


def _catalog_sql():
    rows = " UNION ALL ".join(f"SELECT 1000000 + {i}, '{t}', '{kind}', '{path}'" for i, (t, kind, path) in enumerate(fixed.GLOBAL_CHARTS))
    return REVIEWS + f"""
, charts(ord, title, type, path) AS (SELECT row_number() OVER (ORDER BY Branch), concat('Theme Sentiment: ', replace(Branch, '_', ' ')), 'sent_heatmap',
  concat('/plots/insight1_', Branch, '.png') FROM (SELECT DISTINCT Branch FROM reviews WHERE Branch IS NOT NULL) UNION ALL {rows})
SELECT CAST(row_number() OVER (ORDER BY ord) - 1 AS BIGINT) AS position, title, type, path FROM charts"""


@query("chart_catalog", _catalog_sql())
def chart_catalog(spark, sf):
    return as_bigint(answers.chart_catalog(insights.valid_branches(light_reviews(spark, sf))), "position")


@query("answered_questions", TOP_SQL + """
, whole AS (SELECT count(*) AS n, count(sentiment_score) * 100.0 / count(*) AS cov FROM reviews),
 c AS (SELECT qid, sentiment_label, count(*) AS n FROM hits WHERE sentiment_label IS NOT NULL GROUP BY 1, 2),
 s AS (SELECT *, n / sum(n) OVER (PARTITION BY qid) * 100 AS share FROM c),
 t AS (SELECT qid, string_agg(concat(sentiment_label, ' (', printf('%.1f', share), '%)'), ', ' ORDER BY n DESC, sentiment_label) AS d FROM s GROUP BY qid),
 x AS (SELECT t.qid, string_agg(concat(CAST(t.rank AS VARCHAR), '. ', coalesce(r.Review_Text, ''), ' (Topics: ', coalesce(array_to_string(r.topics, ', '), ''),
  ', Branch: ', coalesce(r.Branch, ''), ')'), chr(10) ORDER BY t.rank) AS context FROM top t JOIN reviews r ON r.review_uid = t.review_uid GROUP BY t.qid)
SELECT CAST(g.qid AS BIGINT) AS qid, g.intent, m.matches, x.context, CASE WHEN m.qid IS NOT NULL THEN coalesce(t.d, 'N/A') END AS distribution,
 CASE WHEN g.refusal_reason IS NOT NULL THEN concat('I do not have data about ', g.refusal_reason, '. I only have data for: ', (SELECT names FROM park_list), '.') END AS refusal,
 CASE WHEN m.qid IS NOT NULL THEN concat('[v4: reviews_enriched_v4.parquet (', printf('%.1f', (SELECT cov FROM whole)), '% Enriched)] Found ', CAST(m.matches AS VARCHAR), ' matches of ',
 CAST((SELECT n FROM whole) AS VARCHAR), ' entries. Using top ', CAST(least(m.matches, 5) AS VARCHAR), '.') END AS summary
FROM guarded g LEFT JOIN matches m ON m.qid = g.qid LEFT JOIN t ON t.qid = g.qid LEFT JOIN x ON x.qid = g.qid""")
def answered_questions(spark, sf):
    """Through the store of vectors."""
    store = f"{use_checkpoints(spark).rstrip('/')}/vectors-{uuid.uuid4().hex}"
    return answers.answered(tables.reviews(spark, sf), tables.questions(spark, sf), store)


TASKS_SQL = GUARDED + """
, hits AS (SELECT q.qid, r.Rating, r.sentiment_score FROM guarded q JOIN seasoned r ON (q.season IS NULL OR lower(r.Season) = lower(q.season))
  AND (q.month IS NULL OR r.visit_month = q.month) AND (q.reviewer_location IS NULL OR lower(r.Reviewer_Location) = lower(q.reviewer_location))
  AND (q.branch IS NULL OR lower(r.Branch) = lower(q.branch))),
 measured AS (SELECT qid, count(*) AS review_count, avg(Rating) AS avg_rating, avg(sentiment_score) AS avg_sentiment FROM hits GROUP BY 1),
 tasks AS (SELECT g.qid AS task_id, coalesce(m.review_count, 0) AS review_count, avg_rating, avg_sentiment FROM guarded g LEFT JOIN measured m ON m.qid = g.qid)"""


def _tasks(spark, sf):
    r, _, guarded = _guarded(spark, sf)
    return r, guarded.select(F.col("qid").alias("task_id"), *quant.TASK_COLUMNS)


@query("task_metrics", TASKS_SQL + " SELECT CAST(task_id AS BIGINT) AS task_id, review_count, round(avg_rating, 6) AS avg_rating, round(avg_sentiment, 6) AS avg_sentiment FROM tasks")
def task_metrics(spark, sf):
    return rounded(quant.task_metrics(*_tasks(spark, sf)), "avg_rating", "avg_sentiment")


@query("task_baseline", TASKS_SQL + """
, b AS (SELECT count(*) AS n, avg(Rating) AS r, avg(sentiment_score) AS s FROM reviews)
SELECT CAST(task_id AS BIGINT) AS task_id, review_count, round(avg_rating, 6) AS avg_rating, round(avg_sentiment, 6) AS avg_sentiment,
 round((review_count - n) / n * 100, 6) AS review_count_vs_baseline_pct, round((avg_rating - r) / r * 100, 6) AS avg_rating_vs_baseline_pct,
 round((avg_sentiment - s) / s * 100, 6) AS avg_sentiment_vs_baseline_pct FROM tasks, b""")
def task_baseline(spark, sf):
    r, tasks = _tasks(spark, sf)
    compared = quant.against_baseline(quant.task_metrics(r, tasks), quant.overall_metrics(r))
    return rounded(compared, "avg_rating", "avg_sentiment", "review_count_vs_baseline_pct", "avg_rating_vs_baseline_pct", "avg_sentiment_vs_baseline_pct")


# --- quality ------------------------------------------------------------------------------

ROUTED = ["intent", *answers.SPEC_FIELDS]


@query("router_accuracy", f"{QUESTIONS}, guesses AS {_specs_sql('guessed_json')} " + " UNION ALL ".join(
    f"SELECT '{f}' AS field, round(avg(CASE WHEN g.{f} IS NOT DISTINCT FROM p.{f} THEN 1.0 ELSE 0.0 END), 6) AS match_rate FROM specs g JOIN guesses p ON p.qid = g.qid"
    for f in ROUTED))
def router_accuracy(spark, sf):
    asked = tables.questions(spark, sf)
    golden, predicted = answers.parse_specs(asked, "spec_json"), answers.parse_specs(asked, "guessed_json")
    return rounded(quality.router_accuracy(golden, predicted, ROUTED), "match_rate")


CHECKED_SQL = f"""WITH answers AS ({tables.ANSWERS_SQL}), checks AS (
 SELECT *, len(list_filter(forbidden, lambda w: contains(lower(answer), lower(w)))) = 0 AS no_forbidden,
  len(expected) = 0 OR len(list_filter(expected, lambda w: contains(lower(answer), lower(w)))) > 0 AS has_expected,
  length(answer) >= 20 AS long_enough, NOT regexp_matches(answer, '[\\x{{1F601}}-\\x{{1F64F}}]') AS no_emoticon FROM answers),
 verdicts AS (SELECT *, no_forbidden AND has_expected AND long_enough AND no_emoticon AS passed FROM checks)"""


@query("answer_checks", CHECKED_SQL + " SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, no_forbidden, has_expected, long_enough, no_emoticon, passed FROM verdicts")
def answer_checks(spark, sf):
    return quality.check_answers(tables.answers(spark, sf)).drop("answer", "expected", "forbidden")


@query("answer_suite", CHECKED_SQL + " SELECT count(*) FILTER (WHERE passed) AS passed, count(*) AS total FROM verdicts")
def answer_suite(spark, sf):
    return quality.suite_summary(quality.check_answers(tables.answers(spark, sf)))


@query("valid_words", """
WITH split AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r]+'), lambda w: length(w) > 0) AS words FROM documents),
 kept AS (SELECT doc_id, words, list_filter(words, lambda w: regexp_full_match(w, 'c|[cb]?a(b?a)*')) AS good FROM split)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(len(words) AS BIGINT) AS words, CAST(len(good) AS BIGINT) AS valid, array_to_string(list_sort(list_distinct(good)), '|') AS valid_words FROM kept""")
def valid_words(spark, sf):
    found = tables.table(spark, sf, "documents").select("doc_id", words.words_of(F.lower("text")).alias("all")).withColumn(
        "good", F.filter("all", lambda w: words.is_valid_word(w)))
    return found.select(
        "doc_id", F.size("all").cast("bigint").alias("words"), F.size("good").cast("bigint").alias("valid"),
        as_text(F.array_sort(F.array_distinct("good"))).alias("valid_words"))


@query("dialogue_context", """
WITH c AS (SELECT a.conv_id, a.turn, b.turn AS t, b.role, b.text, row_number() OVER (PARTITION BY a.conv_id, a.turn ORDER BY b.turn DESC) AS back
 FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn < a.turn),
 k AS (SELECT conv_id, turn, string_agg(concat(role, ': ', text), chr(10) ORDER BY t) AS context FROM c WHERE back <= 10 AND role IN ('user', 'assistant') GROUP BY 1, 2)
SELECT CAST(v.conv_id AS BIGINT) AS conv_id, CAST(v.turn AS BIGINT) AS turn, coalesce(k.context, '') AS context FROM conversations v LEFT JOIN k ON k.conv_id = v.conv_id AND k.turn = v.turn""")
def dialogue_context(spark, sf):
    lines = F.transform("context", lambda t: F.concat(t["role"], F.lit(": "), t["text"]))
    return dialogue.recent_context(tables.table(spark, sf, "conversations")).select(
        "conv_id", "turn", F.array_join(lines, "\n").alias("context"))
