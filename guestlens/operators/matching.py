"""Many filter specifications against many reviews, as equi-joins.

A specification restricts some fields to accepted values and leaves the others open.  Which fields
it restricts is its mask.  Under one mask, a review meets a specification exactly if its values of
the masked fields equal one of the accepted combinations.  So both sides get a text signature of
(mask, masked values) and are joined on it: hash join, no nested loop, any number of specifications.
A field with several values per review joins on one value more; such values are first cut to those
that some specification wants.

A review gets one signature per mask in use.  Reviews are counted by the fields in use before they
are signed, and signatures that no specification has fall out before anything is exploded further, so
the rows that meet the specifications are distinct combinations and not reviews.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from guestlens.functions.calendar import months_of_season, visit_month
from guestlens.operators.filters import Compared, raw_columns
from guestlens.operators.insights import weighted_mean
from guestlens.operators.ranking import first_k_per_group

SIGNATURE = "signature"
# Up to so many bytes of wanted values are put into the plan as a literal; more are joined.
VALUES_BYTES = 1 << 20
# Specifications of up to so many bytes are broadcast; beyond it Spark decides.
BROADCAST_BYTES = 8 << 20


@dataclass(frozen=True)
class Field:
    """A field that specifications may restrict.

    ``of_review`` is the review's value, or its array of values if ``many``.
    ``accepted`` is what a specification accepts: an array of values if ``several``, else one value;
    null leaves the field open.
    """

    name: str
    of_review: Column
    accepted: Column
    many: bool = False
    several: bool = False


def _lowered(topics: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(topics, F.lower)))


def _text(name: str) -> Column:
    return F.when(F.length(name) > 0, F.col(name))


def _any_case(name: str) -> Column:
    return F.when(F.length(name) > 0, F.lower(name))


def _accepted_months() -> Column:
    of_season = months_of_season(F.col("branch"), F.col("season"))
    one = F.when(F.col("month") != 0, F.array(F.col("month")))
    both = F.when(of_season.isNotNull() & one.isNotNull(), F.array_intersect(of_season, one))
    return F.coalesce(both, of_season, one)


def question_fields(columns: Compared | None = None) -> tuple[Field, ...]:
    """The fields of questions over reviews, raw or stored ones; a season counts only for a known park."""
    columns = columns or raw_columns()
    return (
        Field("branch", columns.branch, _any_case("branch")),
        Field("location", columns.location, _any_case("reviewer_location")),
        Field("year_month", F.col("Year_Month"), _text("year_month")),
        Field("month", columns.month, _accepted_months(), several=True),
        Field("sentiment", F.col("sentiment_label"), _text("sentiment_label")),
        Field("complaint", F.col("is_complaint"), F.col("is_complaint")),
        Field("crowd", F.col("crowd_level"), _text("crowd_level")),
        Field("staff", F.col("staff_sentiment"), _text("staff_sentiment")),
        Field("price", F.col("price_sensitivity"), _text("price_sensitivity")),
        Field("family", F.col("family_sentiment"), _text("family_sentiment")),
        Field("topic", _lowered(F.col("topics")), F.when(F.size("topics") > 0, _lowered(F.col("topics"))),
              many=True, several=True),
    )


def task_fields() -> tuple[Field, ...]:
    """The fields of metric tasks: here a season stands for itself, with or without a park."""
    return (
        Field("branch", F.lower("Branch"), _any_case("branch")),
        Field("season", F.lower("Season"), _any_case("season")),
        Field("month", visit_month(F.col("Year_Month")), F.when(F.col("month") != 0, F.col("month"))),
        Field("location", F.lower("Reviewer_Location"), _any_case("reviewer_location")),
    )


def _mask(fields: Sequence[Field]) -> Column:
    bits = F.lit(0)
    for i, field in enumerate(fields):
        bits = bits + F.when(field.accepted.isNotNull(), F.lit(2**i)).otherwise(F.lit(0))
    return bits


def _part(value: Column) -> Column:
    text = value.cast("string")
    return F.concat(F.length(text).cast("string"), F.lit(":"), text)


class SpecMatcher:
    """Matches a table of specifications with a table of reviews.

    ``specs`` holds the columns that the ``accepted`` parts of ``fields`` name and a key ``spec_key``,
    one row per key.  Equal specifications should share a key, so that they are matched once.

    The driver reads which masks are in use (at most ``2 ** len(fields)`` numbers), and the wanted
    values of a many-valued field if they are few bytes.  Specifications are broadcast if they are few
    bytes, by measure; beyond it joins are left to Spark.
    """

    def __init__(self, reviews: DataFrame, specs: DataFrame, fields: Sequence[Field], spec_key: str = "spec_key"):
        self.fields, self.spec_key = tuple(fields), spec_key
        self.specs = specs.select(
            spec_key, _mask(fields).alias("_mask"), *[f.accepted.alias(f"_{f.name}") for f in fields]
        )
        self.masks = sorted(r["_mask"] for r in self.specs.select("_mask").distinct().collect()) or [0]
        self.used = [f for i, f in enumerate(self.fields) if any(m & 2**i for m in self.masks)]
        self.columns = [f"_{f.name}" for f in self.used]
        if self.used:
            reviews = reviews.withColumns({f"_{f.name}": self._wanted(f) for f in self.used})
        self.reviews = reviews
        told = self._spec_signatures().agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)))
        self.small = told.first()[0] <= BROADCAST_BYTES

    def _wanted(self, field: Field) -> Column:
        """The review's value; of several values only those that some specification wants."""
        if not field.many:
            return field.of_review
        values = self.specs.select(F.explode(f"_{field.name}").alias("value")).distinct()
        size = values.agg(F.coalesce(F.sum(F.octet_length("value")), F.lit(0))).first()[0]
        if size > VALUES_BYTES:
            return field.of_review
        listed = json.dumps(sorted(r["value"] for r in values.filter("value IS NOT NULL").collect()))
        return F.array_sort(F.array_intersect(field.of_review, F.from_json(F.lit(listed), "array<string>")))

    def _bit(self, field: Field) -> int:
        return 2 ** next(i for i, f in enumerate(self.fields) if f.name == field.name)

    def _masked(self, field: Field) -> Column:
        return F.col("_mask").bitwiseAND(self._bit(field)) != 0

    def _single(self) -> list[Field]:
        return [f for f in self.used if not f.many]

    def _many(self) -> list[Field]:
        return [f for f in self.used if f.many]

    def _signature(self) -> Column:
        """Mask and masked values in one text; null if a masked value is missing.

        Every value carries its length, so different values never give the same text.  Fields with
        several values per review stay out.
        """
        parts = [F.when(self._masked(f), _part(F.col(f"_{f.name}"))).otherwise(F.lit("")) for f in self._single()]
        return F.concat(F.col("_mask").cast("string"), F.lit("|"), *parts)

    def _spec_signatures(self) -> DataFrame:
        """One row per specification and accepted combination of single values: key, signature, wanted sets."""
        rows = self.specs
        for field in (f for f in self._single() if f.several):
            rows = rows.withColumn(f"_{field.name}", F.explode(F.coalesce(f"_{field.name}", F.array(F.lit(None)))))
        sets = [F.array_sort(F.array_distinct(f"_{f.name}")).alias(f"_set_{f.name}") for f in self._many()]
        return rows.select(self.spec_key, self._signature().alias(SIGNATURE), *sets).distinct()

    def _groups(self) -> DataFrame:
        """Specifications' signatures and wanted sets, each combination once, with a row for each wanted value."""
        sets = [f"_set_{f.name}" for f in self._many()]
        rows = self._spec_signatures().select(SIGNATURE, *sets).distinct()
        for f in self._many():
            rows = rows.withColumn(f"_one_{f.name}", F.explode(F.coalesce(f"_set_{f.name}", F.array(F.lit(None)))))
        return rows

    def _hint(self, specs: DataFrame) -> DataFrame:
        return F.broadcast(specs) if self.small else specs

    def _signed(self, rows: DataFrame) -> DataFrame:
        """One row per row and mask in use with a signature that some specification has."""
        signed = rows.withColumn("_mask", F.explode(F.lit(self.masks))).withColumn(SIGNATURE, self._signature())
        known = self._hint(self._spec_signatures().select(SIGNATURE).distinct())
        signed = signed.filter(F.col(SIGNATURE).isNotNull()).join(known, SIGNATURE, "left_semi")
        return signed.withColumns({f"_{f.name}": F.when(self._masked(f), F.col(f"_{f.name}")) for f in self._many()})

    def _met(self, signed: DataFrame) -> DataFrame:
        """Signed rows with every combination of signature and wanted sets that they meet, once each."""
        groups = self._hint(self._groups())
        for f in self._many():
            values = F.when(self._masked(f), F.col(f"_{f.name}")).otherwise(F.array(F.lit(None).cast("string")))
            signed = signed.withColumn(f"_mine_{f.name}", F.explode(values))
        same = signed[SIGNATURE] == groups[SIGNATURE]
        for f in self._many():
            same = same & signed[f"_mine_{f.name}"].eqNullSafe(groups[f"_one_{f.name}"])
        met = signed.join(groups, same).drop(groups[SIGNATURE])
        for f in self._many():  # a review with two wanted values meets a set by the first of them
            first = F.get(F.array_intersect(f"_{f.name}", f"_set_{f.name}"), F.lit(0))
            met = met.filter(F.col(f"_one_{f.name}").isNull() | (F.col(f"_one_{f.name}") == first))
            met = met.drop(f"_mine_{f.name}", f"_one_{f.name}")
        return met

    def _keyed(self, met: DataFrame) -> DataFrame:
        """Combinations of signature and sets back to the specifications that have them."""
        specs = self._hint(self._spec_signatures())
        same = met[SIGNATURE] == specs[SIGNATURE]
        for f in self._many():
            same = same & met[f"_set_{f.name}"].eqNullSafe(specs[f"_set_{f.name}"])
        joined = met.join(specs, same).drop(specs[SIGNATURE])
        for f in self._many():
            joined = joined.drop(specs[f"_set_{f.name}"])
        return joined

    def matched_counts(self, *by: str) -> DataFrame:
        """Number of matching reviews per specification and value of the columns ``by``."""
        cells = self.reviews.groupBy(*self.columns, *by).agg(F.count(F.lit(1)).alias("rows"))
        many = [f"_{f.name}" for f in self._many()]
        signed = self._signed(cells).groupBy("_mask", SIGNATURE, *many, *by).agg(F.sum("rows").alias("rows"))
        sets = [f"_set_{f.name}" for f in self._many()]
        met = self._met(signed).groupBy(SIGNATURE, *sets, *by).agg(F.sum("rows").alias("rows"))
        return self._keyed(met).groupBy(self.spec_key, *by).agg(F.sum("rows").alias("reviews"))

    def counts(self) -> DataFrame:
        """Number of matching reviews per specification that has any."""
        return self.matched_counts().withColumnRenamed("reviews", "matches")

    def label_counts(self) -> DataFrame:
        """Number of matching reviews per specification and sentiment label."""
        return self.matched_counts("sentiment_label")

    def metrics(self) -> DataFrame:
        """Review count, mean rating and mean score per specification that has a match."""
        return self.matched_counts("Rating", "sentiment_score").groupBy(self.spec_key).agg(
            F.sum("reviews").alias("review_count"),
            weighted_mean("Rating", "reviews").alias("avg_rating"),
            weighted_mean("sentiment_score", "reviews").alias("avg_sentiment"),
        )

    def matches(self, *columns: str) -> DataFrame:
        """``spec_key`` and ``columns`` of every matching review.  With few specifications no review is shuffled."""
        met = self._met(self._signed(self.reviews.select(*columns, *self.columns)))
        return self._keyed(met).select(self.spec_key, *columns)

    def first_matches(self, k: int, key: str = "review_uid") -> DataFrame:
        """Keys of the first ``k`` matching reviews of every specification, in key order.

        The first ``k`` of a specification are among the first ``k`` of its signatures and wanted sets, so
        those are cut to ``k`` keys before they meet the specifications.
        """
        met = self._met(self._signed(self.reviews.select(key, *self.columns)))
        group = [SIGNATURE, *[f"_set_{f.name}" for f in self._many()]]
        firsts = first_k_per_group(met.select(key, *group), group, [F.col(key)], k, F.col(key), rank="_rank")
        pairs = self._keyed(firsts.drop("_rank")).select(self.spec_key, key)
        return first_k_per_group(pairs, [self.spec_key], [F.col(key)], k, F.col(key))
