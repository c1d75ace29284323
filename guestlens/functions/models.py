"""Model calls as Arrow batches: the only places where Python sees rows.

A model is given as a factory.  The factory runs once per task, so a client or a loaded model is
built once and reused for all batches of the partition.  The other columns stay in the JVM.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from guestlens.functions.lexicon import label_patterns, lexicon_fields, plain_words
from guestlens.schema import ENRICHMENT

# One answer per text: JSON text, or the exception that stands for a failed call.
Annotate = Callable[[Sequence[str]], Sequence["str | Exception"]]
# One row of numbers per text.
Embed = Callable[[Sequence[str]], np.ndarray]

ANNOTATION = T.StructType([T.StructField("json", T.StringType()), T.StructField("error", T.StringType())])

# Words of the rule-based annotator that stands in for a model.
GOOD_WORDS = ["lovely", "friendly", "helpful", "great", "quiet", "worth it", "reasonable", "nice"]
BAD_WORDS = ["rude", "overpriced", "packed", "crowded", "rip off", "long lines", "pricey", "expensive"]
TOPIC_WORDS = [
    ("Queues", ["long lines", "queue", "wait time", "crowd", "crowded", "packed"]),
    ("Food", ["food", "burger", "restaurant"]),
    ("Staff", ["staff", "cast", "people"]),
    ("Price", ["overpriced", "pricey", "tickets", "rip off"]),
    ("Rides", ["rides", "castle"]),
]
FAMILY_WORDS = [("Joyful", ["lovely"]), ("Tired", ["tired"])]
EMBEDDING_SIZE = 64
# Texts that go to a model in one call.
CALL_SIZE = 50


def _finder(words: Sequence[str], pattern: str | None = None) -> Callable[[str], set[str]]:
    """The words found in a text as whole words.  A plain search comes first, as most texts have none."""
    search = re.compile(pattern or r"\b(?:" + "|".join(re.escape(w) for w in words) + r")\b")
    return lambda text: set(search.findall(text)) if any(w in text for w in words) else set()


def rule_annotator(max_topics: int | None = None) -> Annotate:
    """A deterministic annotator from word lists: good words raise the score, bad words lower it.

    ``max_topics`` keeps the first topics in the order of the word lists; by default all.
    """
    good, bad = _finder(GOOD_WORDS), _finder(BAD_WORDS)
    topics = [(name, _finder(words)) for name, words in TOPIC_WORDS]
    labels = {f: [(n, _finder(plain_words(f, n), p)) for n, p in label_patterns(f)] for f in lexicon_fields()}
    labels["family_sentiment"] = [(n, _finder(w)) for n, w in FAMILY_WORDS]

    def one(text: str) -> str:
        low = text.lower()
        bad_hits = len(bad(low))
        score = min(5, max(1, 3 + len(good(low)) - bad_hits))
        record = {
            "sentiment_score": score,
            "sentiment_label": "Negative" if score < 3 else "Neutral" if score == 3 else "Positive",
            "topics": [name for name, find in topics if find(low)][:max_topics],
            "is_complaint": bad_hits > 0,
        }
        for field, rules in labels.items():
            record[field] = next((name for name, find in rules if find(low)), None)
        return json.dumps(record)

    return lambda texts: [one(t) for t in texts]


def one_call(model: Callable[[Sequence[str]], Sequence], part: Sequence[str]) -> list:
    """One answer or exception per text.  If the call fails, its texts are asked one by one, so that a bad text
    costs no other its answer."""
    try:
        answers = list(model(part))
        if len(answers) != len(part):
            raise ValueError(f"{len(answers)} answers to {len(part)} texts")
    except Exception as failed:
        return [failed] if len(part) == 1 else [a for text in part for a in one_call(model, [text])]
    return answers


def answers_of(model: Callable[[Sequence[str]], Sequence], texts: Sequence[str], call_size: int, pool: ThreadPoolExecutor | None = None) -> list:
    """One answer or exception per text, in the order of the texts, from calls of ``call_size`` texts.

    A ``pool`` has as many calls under way as it has threads; without one they follow each other.
    """
    parts = [texts[start : start + call_size] for start in range(0, len(texts), call_size)]
    asked = pool.map(lambda part: one_call(model, part), parts) if pool else (one_call(model, part) for part in parts)
    return [answer for answers in asked for answer in answers]


@contextmanager
def calls_in_flight(most: int) -> Iterator[ThreadPoolExecutor | None]:
    """Threads for ``most`` calls of a task at a time; none for one call after another."""
    if most <= 1:
        yield None
        return
    with ThreadPoolExecutor(most) as pool:
        yield pool


def annotate_json(
    text: Column, factory: Callable[[], Annotate] = rule_annotator, call_size: int = CALL_SIZE, in_flight: int = 1,
) -> Column:
    """JSON answer and error per text.  A failed call gives no JSON and the reason; it stops nothing.

    Up to ``in_flight`` calls of a task run at a time; the model must bear calls from several threads then.
    """

    @F.pandas_udf(ANNOTATION)
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        annotate = factory()
        with calls_in_flight(in_flight) as pool:
            for batch in batches:
                answers = answers_of(annotate, batch.fillna("").tolist(), call_size, pool)
                yield pd.DataFrame({
                    "json": [None if isinstance(a, Exception) else a for a in answers],
                    "error": [repr(a) if isinstance(a, Exception) else None for a in answers],
                })

    return call(text)


def expand_json(df: DataFrame, json_column: str, schema: T.StructType = ENRICHMENT) -> DataFrame:
    """Columns from JSON text; an empty object or junk gives nulls."""
    parsed = df.withColumn("_parsed", F.from_json(json_column, schema))
    return parsed.withColumns({f.name: F.col(f"_parsed.{f.name}") for f in schema.fields}).drop("_parsed")


def annotate(
    reviews: DataFrame, factory: Callable[[], Annotate] = rule_annotator, text: str = "Review_Text",
    schema: T.StructType = ENRICHMENT, partitions: int | None = None, call_size: int = CALL_SIZE, in_flight: int = 1,
) -> DataFrame:
    """Typed enrichment columns from the model, with the raw answer and the error.

    Input splits stay as they are.  ``partitions`` deals the rows out anew: more of them to widen a few
    large files, fewer to cap the number of concurrent model clients.
    """
    if partitions:
        reviews = reviews.repartition(partitions)
    called = reviews.drop(*schema.fieldNames()).withColumn("_answer", annotate_json(F.col(text), factory, call_size, in_flight))
    flat = called.withColumns({
        "enriched_json": F.col("_answer.json"), "enrich_error": F.col("_answer.error"),
    }).drop("_answer")
    return expand_json(flat, "enriched_json", schema)


class _Places(dict):
    """Place of each word, worked out when first seen."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, word: str) -> int:
        place = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.size
        if len(self) < 500_000:
            self[word] = place
        return place


def word_hash_embedder(size: int = EMBEDDING_SIZE) -> Embed:
    """Word counts hashed into ``size`` places.  Whole numbers, so that cosines are the same everywhere."""
    places = _Places(size)

    def embed(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), dtype=np.float32)
        for i, text in enumerate(texts):
            found = [places[w] for w in text.lower().split(" ") if w]
            if found:
                out[i] = np.bincount(found, minlength=size)
        return out

    return embed


EMBEDDED = T.StructType([T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())])


def embed_text(
    text: Column, factory: Callable[[], Embed] = word_hash_embedder, call_size: int = CALL_SIZE, in_flight: int = 1,
) -> Column:
    """Vector and error per text; null text counts as empty.  A text that fails has no vector and the reason.

    Of equal texts in an Arrow batch the model reads one.
    """

    @F.pandas_udf(EMBEDDED)
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        embed = factory()
        with calls_in_flight(in_flight) as pool:
            for batch in batches:
                places, texts = pd.factorize(batch.fillna("").astype(object))
                answers = answers_of(embed, texts.tolist(), call_size, pool)
                failed = [isinstance(a, Exception) for a in answers]
                vectors = pd.Series([None if f else np.asarray(a) for a, f in zip(answers, failed)], dtype=object)
                errors = pd.Series([repr(a) if f else None for a, f in zip(answers, failed)], dtype=object)
                yield pd.DataFrame({"vector": vectors.to_numpy()[places], "error": errors.to_numpy()[places]})

    return call(text)
