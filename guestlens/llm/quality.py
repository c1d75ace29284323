"""Quality by compression: a text compresses better with a dictionary made from texts like it.

One zstandard dictionary is built from good labelled text, one from bad.  Each document is cut into pieces of the size
that the dictionaries are made from, as a dictionary helps the start of what is compressed only; every piece is compressed
with either and with none, and the sizes are added up.  The difference of the two sums, normalised by the document's length, together with the normalised sizes
themselves (which tell repetitive texts that both dictionaries fit alike), goes through a logistic calibration fitted on
labelled documents that the dictionaries have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from guestlens.llm.common import slices, to_python

#: Labelled documents taken at most per label, by a hash of their key: for the dictionaries, and for the calibration.
DICTIONARY_DOCUMENTS = 2_000
CALIBRATION_DOCUMENTS = 1_500
#: Their texts are cut into pieces of so many characters, of which so many per label are taken, again by hash.
PIECE_CHARACTERS = 2_000
PIECES = 1_500
DICTIONARY_BYTES = 65_536
LEVEL = 3
ACCEPTED = 0.7


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    shift: float


def _coder(dictionary: bytes) -> zstandard.ZstdCompressor:
    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL)
    kind = zstandard.DICT_TYPE_AUTO
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=kind)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data)


class Sizes:
    """Compressed sizes of texts, normalised."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.coders = [_coder(good), _coder(bad), _coder(b"")]

    def features(self, texts: list[str | None], piece: int | None = None) -> np.ndarray:
        """Of whole texts, or with the sizes of all their pieces of ``piece`` characters added up."""
        cut = [[t[i : i + piece] for i in range(0, len(t), piece)] if t and piece else [t or ""] for t in texts]
        raw = [[p.encode("utf-8", "replace") for p in pieces] for pieces in cut]
        length = np.array([sum(len(p) + 16 for p in pieces) for pieces in raw], float)
        good, bad, alone = (np.array([sum(len(c.compress(p)) for p in pieces) for pieces in raw], float) for c in self.coders)
        return np.stack([(bad - good) / length, good / length, alone / length], axis=1).reshape(-1, 3)


def score_texts(sizes: Sizes, model: QualityModel, texts: list[str | None]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(sizes.features(texts, PIECE_CHARACTERS) @ np.array(model.weights) + model.shift, -30, 30)))


def dictionary_of(pieces: list[str]) -> bytes:
    """A trained dictionary, or the pieces themselves where they are too few to train on."""
    raw = [p.encode("utf-8", "replace") for p in pieces if p]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, raw).as_bytes()
    except zstandard.ZstdError:
        return b"".join(raw)[-DICTIONARY_BYTES:]


def calibrate(features: np.ndarray, label: np.ndarray) -> tuple[tuple[float, ...], float]:
    """Logistic regression by Newton's method, lightly regularised."""
    middle, spread = features.mean(0), features.std(0) + 1e-9
    x = np.c_[(features - middle) / spread, np.ones(len(features))]
    ridge = np.diag([1e-2] * (x.shape[1] - 1) + [1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (label - p) - ridge @ w)
        w += np.clip(step, -5, 5)
    weights = w[:-1] / spread
    return tuple(map(float, weights)), float(w[-1] - weights @ middle)


def fit_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> QualityModel:
    """Learn from documents whose ``label`` is 0 or 1.

    Rows of ``labels`` with null key or label are left out, and keys that carry both labels.  What reaches the driver is
    bounded by the constants above, whatever the size of the tables; the rows are chosen by hash, so a repeated run
    learns the same.  Without both labels the model gives every text the share of good labels (0.5 without any label).
    """
    known = (
        labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("good"))
        .where("key IS NOT NULL AND good IN (0, 1)").groupBy("key").agg(F.min("good").alias("good"), F.max("good").alias("most"))
        .where("good = most").select("key", "good", (F.pmod(F.xxhash64("key", F.lit(1)), F.lit(5)) >= 2).alias("for_dictionary"))
    )

    def chosen(good: int, for_dictionary: bool, most: int) -> DataFrame:
        return known.where((F.col("good") == good) & (F.col("for_dictionary") == for_dictionary)).orderBy(F.xxhash64("key"), "key").limit(most)

    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL")
    pieces = {}
    for good in (0, 1):
        starts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / PIECE_CHARACTERS).cast("int"))
        cut = (
            texts.where("text <> ''").join(F.broadcast(chosen(good, True, DICTIONARY_DOCUMENTS)), "key")
            .select("key", F.explode(starts).alias("n"), "text")
            .select("key", "n", F.expr(f"substring(text, n * {PIECE_CHARACTERS} + 1, {PIECE_CHARACTERS})").alias("piece"))
        )
        pieces[good] = [r["piece"] for r in cut.orderBy(F.xxhash64("key", "n"), "key", "n", "piece").limit(PIECES).collect()]
    good, bad = dictionary_of(pieces[1]), dictionary_of(pieces[0])

    both = chosen(0, False, CALIBRATION_DOCUMENTS).union(chosen(1, False, CALIBRATION_DOCUMENTS))
    seen = texts.join(F.broadcast(both), "key").select("text", "good")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(good, bad)
        for piece in slices(batches):
            x = sizes.features(piece.column(0).to_pylist(), PIECE_CHARACTERS)
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T), piece.column(1)], ["a", "b", "c", "good"])

    rows = sorted(map(tuple, to_python(seen, measure, "a double, b double, c double, good int").limit(4 * CALIBRATION_DOCUMENTS).collect()))
    share = {r["good"]: r["n"] for r in known.groupBy("good").agg(F.count("*").alias("n")).collect()}
    prior = (share.get(1, 0) + 1e-6) / (sum(share.values()) + 2e-6)
    if len({r[3] for r in rows}) < 2 or not pieces[0] or not pieces[1]:
        return QualityModel(good, bad, (0.0, 0.0, 0.0), float(np.log(prior / (1 - prior))))
    table = np.array(rows, float)
    weights, shift = calibrate(table[:, :3], table[:, 3])
    return QualityModel(good, bad, weights, shift)


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", score: str = "quality_score") -> DataFrame:
    """``docs`` with a column ``score``: 0 to 1, higher where a good label is likelier.

    All of a text is compressed, piece by piece, so the score does not follow its length.  Null and empty texts get the score of an empty text.  All columns are kept, in
    their order; a column already named ``score`` is replaced.  Repeated rows get equal scores; an empty table stays empty.
    """
    names = [c for c in docs.columns if c != score]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != score] + [f"`{score}` double"])
    place = names.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model.good, model.bad)
        for piece in slices(batches):
            scores = pa.array(score_texts(sizes, model, piece.column(place).to_pylist()))
            yield pa.RecordBatch.from_arrays([*piece.columns, scores], [*names, score])

    return to_python(docs.select(*(f"`{c}`" for c in names)), work, schema)
