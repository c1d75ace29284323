"""Questions answered in batch: a table of questions and specifications against the reviews."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from guestlens import fixed_values as fixed
from guestlens.functions.models import Embed, word_hash_embedder
from guestlens.functions.text import one_decimal, spaced
from guestlens.functions.themes import contains_any
from guestlens.functions.vectors import with_norm
from guestlens.operators.filters import compared_columns
from guestlens.operators.insights import coverage, share_text, valid_branches
from guestlens.operators.matching import SpecMatcher, question_fields
from guestlens.plans.quant import keyed_specs
from guestlens.plans.search import (
    CANDIDATE_POOL, TOP_K, embed_new, latest_vectors, read_vectors, search_matches, small_enough, top_by_similarity, with_embeddings,
)
from guestlens.schema import FILTER_SPEC
from guestlens.session import use_checkpoints

INTENTS = ["search_reviews", "view_report", "capability_discovery"]
SPEC_FIELDS = tuple(n for n in FILTER_SPEC.fieldNames() if n not in ("intent", "reasoning"))
# What decides which reviews match; the unsupported entity is settled by the guardrail.
MATCH_FIELDS = tuple(n for n in SPEC_FIELDS if n != "unsupported_entity")


TRUE_WORDS = ["true", "1", "yes", "y", "on", "t"]
FALSE_WORDS = ["false", "0", "no", "n", "off", "f"]


def _typed(name: str, kind: T.DataType) -> Column:
    """A field of the loosely parsed specification in its type; null if the text does not fit."""
    value = F.col(f"_spec.{name}")
    if isinstance(kind, T.IntegerType):
        number = F.trim(value).try_cast("double")
        return F.when(number == F.floor(number), number.cast("int"))
    if isinstance(kind, T.BooleanType):
        word = F.lower(F.trim(value))
        return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)
    return value


def parse_specs(questions: DataFrame, spec_json: str = "spec_json") -> DataFrame:
    """Typed columns from the specification text.

    Numbers and truth values may be given as text, as in ``"month": "6"``.  Text that is no specification
    (bad JSON, a value that does not fit its type, an unknown intent, no reasoning) gives the default: a
    review search without filters.
    """
    loose = [f if isinstance(f.dataType, T.ArrayType) else T.StructField(f.name, T.StringType()) for f in FILTER_SPEC.fields]
    schema = T.StructType([*loose, T.StructField("_bad", T.StringType())])
    parsed = questions.withColumn(
        "_spec", F.from_json(spec_json, schema, {"columnNameOfCorruptRecord": "_bad"})
    )
    intent = F.coalesce("_spec.intent", F.lit(INTENTS[0]))
    typed = {f.name: _typed(f.name, f.dataType) for f in FILTER_SPEC.fields}
    good = (
        F.col("_spec").isNotNull() & F.col("_spec._bad").isNull()
        & F.col("_spec.reasoning").isNotNull() & intent.isin(INTENTS)
    )
    for name, value in typed.items():
        good = good & (F.col(f"_spec.{name}").isNull() | value.isNotNull())
    good = F.coalesce(good, F.lit(False))
    fields = {n: F.when(good, typed[n]) for n in SPEC_FIELDS}
    return parsed.withColumns({
        "parsed": good,
        "intent": F.when(good, intent).otherwise(F.lit(INTENTS[0])),
        **fields,
    }).drop("_spec")


def is_empty_spec() -> Column:
    """Does the specification set nothing?  Such questions retrieve no reviews."""
    empty = F.lit(True)
    for name in SPEC_FIELDS:
        empty = empty & F.col(name).isNull()
    return empty


def alias_target(entity: Column, aliases: Sequence[tuple[str, str | None]] = fixed.PARK_ALIASES) -> Column:
    """Park for a name: the alias itself, else the first alias contained in the name, else the name."""
    low = F.trim(F.lower(entity))
    table = F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(p).cast("string").alias("park")) for a, p in aliases])
    exact = F.get(F.filter(table, lambda a: a["alias"] == low), 0)
    inside = F.get(F.filter(table, lambda a: a["park"].isNotNull() & F.contains(low, a["alias"])), 0)
    return (
        F.when(F.length(entity) < 1, F.lit(None).cast("string"))
        .when(exact.isNotNull(), exact["park"])
        .otherwise(F.coalesce(inside["park"], entity))
    )


def branch_list(branches: DataFrame) -> DataFrame:
    """One row with the sorted names of all parks: the list a refusal spells out."""
    return branches.agg(F.array_sort(F.collect_set("Branch")).alias("parks"))


def park_of(entity: Column, parks: Column) -> Column:
    """The park meant by a name: the branch of that name in any case, else by alias."""
    same = F.filter(parks, lambda p: F.lower(p) == F.trim(F.lower(entity)))
    return F.coalesce(F.get(same, 0), alias_target(entity))


def resolve_parks(rows: DataFrame, branches: DataFrame, entity: str, name: str) -> DataFrame:
    """``name``: the park meant by the column ``entity``."""
    with_parks = rows.withColumn("_parks", branch_list(branches).scalar())
    return with_parks.withColumn(name, park_of(F.col(entity), F.col("_parks"))).drop("_parks")


def guard(specs: DataFrame, branches: DataFrame) -> DataFrame:
    """Normalised branch, and a refusal where a search asks for a park that is not in the data.

    An unsupported entity that names a known park becomes the branch.  The list of parks is a scalar
    subquery; nothing is joined.
    """
    search = F.col("intent") == INTENTS[0]
    asked = F.coalesce(F.length("unsupported_entity") > 0, F.lit(False))
    entity = F.when(asked, F.col("unsupported_entity")).when(F.length("branch") > 0, F.col("branch"))
    named = specs.withColumn("_parks", branch_list(branches).scalar()).withColumn(
        "_park", F.when(search, park_of(entity, F.col("_parks")))
    )
    lost = search & asked & F.col("_park").isNull()
    settled = named.withColumns({
        "branch": F.when(search & ~lost, F.coalesce("_park", "branch")).otherwise(F.col("branch")),
        "unsupported_entity": F.when(~search | lost, F.col("unsupported_entity")),
    })
    unknown = search & (F.length("branch") > 0) & ~F.array_contains("_parks", F.col("branch"))
    lost = search & (F.length("unsupported_entity") > 0)
    reason = F.when(lost, F.col("unsupported_entity")).when(unknown, F.col("branch"))
    return settled.withColumn("refusal_reason", reason).withColumn("refusal", F.concat(
        F.lit("I do not have data about "), "refusal_reason", F.lit(". I only have data for: "),
        F.array_join("_parks", ", "), F.lit("."),
    )).drop("_park", "_parks")


def settled_questions(reviews: DataFrame, questions: DataFrame) -> DataFrame:
    """Parsed and guarded questions, written to the checkpoint folder.

    Every part of an answer starts from them; reading them back keeps those plans short and parses
    each specification once.
    """
    use_checkpoints(reviews.sparkSession)
    return guard(parse_specs(questions), valid_branches(reviews)).checkpoint()


def searches(guarded: DataFrame) -> DataFrame:
    """Questions that retrieve reviews, with a key that equal specifications share."""
    asking = guarded.filter(
        (F.col("intent") == INTENTS[0]) & F.col("refusal_reason").isNull() & ~is_empty_spec()
    )
    return keyed_specs(asking, MATCH_FIELDS)


def matcher(reviews: DataFrame, asked: DataFrame) -> SpecMatcher:
    return SpecMatcher(reviews, asked.select("spec_key", *MATCH_FIELDS).distinct(), question_fields(compared_columns(reviews)))


def spec_distributions(label_counts: DataFrame) -> DataFrame:
    """Matches and sentiment text per specification; unlabelled reviews count as matches only.

    A specification has as many rows as there are labels, so its list is short.
    """
    entry = F.struct((-F.col("reviews")).alias("order"), F.col("sentiment_label").alias("label"))
    listed = label_counts.groupBy("spec_key").agg(
        F.sum("reviews").alias("matches"),
        F.sum(F.when(F.col("sentiment_label").isNotNull(), F.col("reviews"))).alias("_labelled"),
        F.array_sort(F.collect_list(F.when(F.col("sentiment_label").isNotNull(), entry))).alias("_labels"),
    )
    texts = F.transform("_labels", lambda e: share_text(e["label"], -e["order"] / F.col("_labelled") * 100))
    return listed.withColumn("distribution", F.when(F.size("_labels") > 0, F.array_join(texts, ", "))).drop(
        "_labels", "_labelled")


def question_distributions(reviews: DataFrame, asked: DataFrame) -> DataFrame:
    """Sentiment text per question over all its matches; N/A without labelled matches."""
    told = spec_distributions(matcher(reviews, asked).label_counts())
    return asked.join(told, "spec_key", "left").withColumn("distribution", F.coalesce("distribution", F.lit("N/A")))


def with_summary(
    found: DataFrame, reviews: DataFrame, version: str = "v4",
    file_name: str = "reviews_enriched_v4.parquet", top_k: int = TOP_K,
) -> DataFrame:
    """The sentence that tells how many reviews match; ``found`` holds ``matches``, null for none."""
    whole = coverage(reviews).select(F.struct("reviews", "coverage"))
    matches = F.coalesce("matches", F.lit(0).cast("bigint"))
    summary = F.concat(
        F.lit(f"[{version}: {file_name} ("), one_decimal(F.col("_all.coverage")), F.lit("% Enriched)] Found "),
        F.col("matches").cast("string"), F.lit(" matches of "), F.col("_all.reviews").cast("string"),
        F.lit(" entries. Using top "), F.least(F.col("matches"), F.lit(top_k)).cast("string"), F.lit("."),
    )
    return found.withColumn("matches", matches).withColumn("_all", whole.scalar()).withColumn(
        "summary", summary).drop("_all")


def match_summaries(reviews: DataFrame, asked: DataFrame, **labels: str) -> DataFrame:
    """How many reviews match each question, and the sentence that says so."""
    counts = matcher(reviews, asked).counts()
    return with_summary(asked.join(counts, "spec_key", "left"), reviews, **labels)


def candidates(reviews: DataFrame, asked: DataFrame, pool: int = CANDIDATE_POOL) -> DataFrame:
    """(spec_key, review_uid, rank): the first matching reviews of each specification in key order."""
    return matcher(reviews, asked).first_matches(pool)


def top_reviews(
    reviews: DataFrame, asked: DataFrame, question: str = "question", pool: int | None = None,
    k: int = TOP_K, factory: Callable[[], Embed] = word_hash_embedder, qid: str = "qid", vectors: DataFrame | None = None,
) -> DataFrame:
    """The ``k`` reviews most similar to each question, among all that match it, or among its first ``pool`` matches."""
    pooled = None if pool is None else candidates(reviews, asked, pool)
    return closest(reviews, asked, pooled, question, k, factory, qid, vectors)


def closest(
    reviews: DataFrame, asked: DataFrame, pooled: DataFrame | None = None, question: str = "question", k: int = TOP_K,
    factory: Callable[[], Embed] = word_hash_embedder, qid: str = "qid", vectors: DataFrame | None = None,
) -> DataFrame:
    """The matching (or pooled) reviews most similar to each question.

    ``vectors`` are stored ones (key, vector, vector_norm, see ``plans.search``); without them each text is embedded
    once, where it is read.  A question without a vector gets its first matches in key order.
    """
    if vectors is None:
        embedded = with_embeddings(reviews, "Review_Text", factory)
    else:
        embedded = reviews.join(vectors.select("review_uid", "vector"), "review_uid", "left")
    use_checkpoints(reviews.sparkSession)
    asking = with_embeddings(asked.select(qid, "spec_key", question), question, factory, "query_vector").drop(question).checkpoint()
    if pooled is None:
        return search_matches(matcher(embedded, asked), asking, qid, "review_uid", k=k)
    pairs = pooled.drop("rank").join(with_norm(embedded.select("review_uid", "vector"), "vector"), "review_uid")
    pairs = pairs.join(small_enough(with_norm(asking, "query_vector"), 4_096), "spec_key")
    return top_by_similarity(pairs, qid, "vector", "query_vector", "review_uid", k)


def context_rows(top: DataFrame, reviews: DataFrame) -> DataFrame:
    """The numbered lines that an answer is written from; texts are fetched for the reviews found only.

    The found keys are written to the checkpoint folder: they are few, counted, and need no second search.
    """
    use_checkpoints(reviews.sparkSession)
    top = small_enough(top.checkpoint(), 100)
    shown = reviews.select("review_uid", "Review_Text", "topics", "Branch")
    line = F.concat(
        F.col("rank").cast("string"), F.lit(". "), F.coalesce("Review_Text", F.lit("")), F.lit(" (Topics: "),
        F.coalesce(F.array_join("topics", ", "), F.lit("")), F.lit(", Branch: "), F.coalesce("Branch", F.lit("")),
        F.lit(")"),
    )
    return shown.join(top, "review_uid").withColumn("line", line)


def answer_contexts(lines: DataFrame, qid: str = "qid") -> DataFrame:
    """One text per question: at most ``k`` lines each."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "line")))
    return lines.groupBy(qid).agg(F.array_join(F.transform(ordered, lambda e: e["line"]), "\n").alias("context"))


def chart_catalog(branches: DataFrame) -> DataFrame:
    """All charts in order: the heatmap of every park, then those over all parks."""
    overall = F.array(*[_chart(F.lit(t), kind, F.lit(path)) for t, kind, path in fixed.GLOBAL_CHARTS])
    parks = branch_list(branches).withColumn("chart", F.concat(F.transform("parks", _heatmap), overall))
    return parks.select(F.posexplode("chart").alias("position", "chart")).select("position", "chart.*")


def _chart(title: Column, kind: str, path: Column) -> Column:
    return F.struct(title.alias("title"), F.lit(kind).alias("type"), path.alias("path"))


def _heatmap(branch: Column) -> Column:
    return _chart(F.concat(F.lit("Theme Sentiment: "), spaced(branch)), "sent_heatmap",
                  F.concat(F.lit("/plots/insight1_"), branch, F.lit(".png")))


def chart_selection(guarded: DataFrame, branches: DataFrame, question: str = "question") -> DataFrame:
    """The charts that go with each question, in display order, heatmaps first.

    A search gets the charts its words, topics, location or label ask for; a report gets all charts
    over all parks; both get the heatmap of their park.  A request for the list gets everything.
    """
    low = F.lower(question)
    topics = F.coalesce(F.transform("topics", F.lower), F.array().cast("array<string>"))
    search = F.col("intent") == INTENTS[0]
    report = F.col("intent") == INTENTS[1]
    lists = report & contains_any(low, fixed.LIST_CHART_WORDS)
    extra = {
        "country": F.coalesce(F.length("reviewer_location") > 0, F.lit(False)),
        "drivers": F.coalesce(F.col("sentiment_label") == "Negative", F.lit(False)),
    }
    charts = []
    for title, kind, path in fixed.GLOBAL_CHARTS:
        wanted = contains_any(low, fixed.CHART_QUESTION_WORDS[kind]) | extra.get(kind, F.lit(False))
        if kind in fixed.CHART_TOPIC_WORDS:
            words = fixed.CHART_TOPIC_WORDS[kind]
            wanted = wanted | (F.size(F.filter(topics, lambda t: contains_any(t, words))) > 0)
        charts.append(F.when(report | (search & wanted), _chart(F.lit(title), kind, F.lit(path))))
    of_all_parks = F.array_compact(F.array(*charts))
    none = F.transform(F.array().cast("array<string>"), _heatmap)
    own = F.when(F.array_contains("_parks", F.col("branch")), F.array(_heatmap(F.col("branch"))))
    heatmaps = F.when(lists, F.transform("_parks", _heatmap)).when(search | report, F.coalesce(own, none)).otherwise(none)
    answered = guarded.filter(F.col("refusal_reason").isNull()).withColumn("_parks", branch_list(branches).scalar())
    return answered.select("qid", F.posexplode(F.concat(heatmaps, of_all_parks)).alias("position", "chart")).select(
        "qid", "position", "chart.*"
    )


def answered(
    reviews: DataFrame, questions: DataFrame, vectors_path: str | None = None, run_id: int = 1,
    factory: Callable[[], Embed] = word_hash_embedder,
) -> DataFrame:
    """Everything an answer is written from, one row per question: refusal, or summary, distribution
    and context.

    With ``vectors_path`` the reviews' vectors are kept there: reviews that it has no vector of are embedded and
    appended first, all others are not read by the model again.
    """
    guarded = settled_questions(reviews, questions)
    asked = searches(guarded)
    matched = matcher(reviews, asked)
    told = asked.select("qid", "spec_key").join(spec_distributions(matched.label_counts()), "spec_key", "left")
    told = with_summary(told, reviews).withColumn("distribution", F.coalesce("distribution", F.lit("N/A")))
    vectors = None
    if vectors_path:
        embed_new(reviews, vectors_path, run_id, factory)
        vectors = latest_vectors(read_vectors(reviews, vectors_path))
    top = closest(reviews, asked, factory=factory, vectors=vectors)
    contexts = answer_contexts(context_rows(top, reviews))
    return (
        guarded.select("qid", "intent", "refusal")
        .join(told.select("qid", "matches", "summary", "distribution"), "qid", "left")
        .join(contexts, "qid", "left")
    )
