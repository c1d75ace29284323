"""Language of a text by a bidirectional gated recurrent network over bytes.

The network is small (``STATES`` units each way) and written in numpy.  It is trained on the driver by backpropagation
through time on a bounded sample of windows, every position of which carries the language as its label.  Executors run
it over whole texts: a text is cut into windows, thousands of which take each step together; the probabilities of all
positions are averaged into those of the document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from guestlens.llm.common import byte_slices, to_python
from guestlens.plans.search import small_enough

UNKNOWN = "und"
STATES = 8
#: Gates are straight lines of this slope, cut at 0 and 1; new states are x / (1 + |x|).  Both cost far less than tanh.
SLOPE, HALF = np.float32(0.25), np.float32(0.5)
#: Bytes of a window, and windows that are worked on at a time.
WINDOW = 128
WINDOWS = 2_048
#: The sample that is learned from: documents of each language, windows of each and of all, and their characters.
DOCUMENTS_PER_LANGUAGE = 600
WINDOWS_PER_LANGUAGE = 3_000
SAMPLE_WINDOWS = 200_000
SAMPLE_CHARACTERS = 48
STEPS = 260
BATCH = 128

Weights = dict[str, np.ndarray]


@dataclass(frozen=True)
class LanguageModel:
    """Weights as numpy arrays; ``languages`` names the outputs."""

    languages: tuple[str, ...]
    weights: Weights


def has_letter(text: str) -> bool:
    """A letter in any script; number signs such as a half or a Roman numeral are none."""
    return any(map(str.isalpha, text))


def new_weights(languages: int, rng: np.random.Generator) -> Weights:
    h = STATES
    out: Weights = {"out": rng.normal(0, 0.3, (2 * h, languages)), "shift": np.zeros(languages)}
    for way in ("f", "b"):
        out["in" + way] = rng.normal(0, 0.3, (256, 3 * h))
        out["re" + way] = rng.normal(0, 1 / np.sqrt(h), (h, 3 * h))
    return {k: v.astype(np.float32) for k, v in out.items()}


def run_states(x: np.ndarray, into: np.ndarray, again: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States after each step of one direction; ``x`` is steps x windows.  ``keep`` gets what training needs.

    Hold, reset and new state are arrays of their own: numpy is slow on parts of rows.
    """
    h = again.shape[0]
    steps, rows = x.shape
    parts = [slice(i * h, i * h + h) for i in range(3)]
    in_hold, in_reset, in_fresh = (np.ascontiguousarray(into[:, p]) for p in parts)
    re_hold, re_reset, re_fresh = (np.ascontiguousarray(again[:, p]) for p in parts)
    out = np.empty((steps, rows, h), np.float32)
    state = np.zeros((rows, h), np.float32)
    size = np.empty((rows, h), np.float32)
    for t in range(steps):
        now = x[t]
        hold = in_hold.take(now, axis=0, mode="clip")
        hold += state @ re_hold
        hold *= SLOPE
        hold += HALF
        np.clip(hold, 0, 1, out=hold)
        reset = in_reset.take(now, axis=0, mode="clip")
        reset += state @ re_reset
        reset *= SLOPE
        reset += HALF
        np.clip(reset, 0, 1, out=reset)
        back = state @ re_fresh
        fresh = in_fresh.take(now, axis=0, mode="clip")
        fresh += reset * back
        np.abs(fresh, out=size)
        size += 1
        fresh /= size
        if keep is not None:
            keep.append((state, hold, reset, fresh, back))
        new = out[t]
        np.subtract(state, fresh, out=new)
        new *= hold
        new += fresh
        state = new
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(-1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(-1, keepdims=True)
    return z


def position_probabilities(x: np.ndarray, w: Weights) -> np.ndarray:
    """Probabilities of each language at every position; ``x`` is steps x windows of bytes."""
    h = STATES
    forward = run_states(x, w["inf"], w["ref"])
    backward = run_states(x[::-1], w["inb"], w["reb"])[::-1]
    return softmax(forward @ w["out"][:h] + backward @ w["out"][h:] + w["shift"])


def gradients(x: np.ndarray, label: np.ndarray, w: Weights) -> tuple[float, Weights]:
    """Mean loss over all positions and its gradients, by backpropagation through time."""
    h, (steps, rows) = STATES, x.shape
    kept: dict[str, list] = {"f": [], "b": []}
    forward = run_states(x, w["inf"], w["ref"], kept["f"])
    backward = run_states(x[::-1], w["inb"], w["reb"], kept["b"])
    both = np.concatenate([forward, backward[::-1]], axis=2)
    p = softmax(both @ w["out"] + w["shift"])
    loss = -float(np.log(p[:, np.arange(rows), label] + 1e-9).mean())
    p[:, np.arange(rows), label] -= 1
    p /= steps * rows
    grad = {k: np.zeros_like(v) for k, v in w.items()}
    grad["out"] = both.reshape(-1, 2 * h).T @ p.reshape(steps * rows, -1)
    grad["shift"] = p.sum((0, 1))
    later = p @ w["out"].T
    for way, part, order in (("f", later[:, :, :h], x), ("b", later[::-1, :, h:], x[::-1])):
        again, flow = w["re" + way], np.zeros((rows, h), np.float32)
        for t in range(steps - 1, -1, -1):
            state, hold, reset, fresh, back = kept[way][t]
            flow = flow + part[t]
            d_fresh = flow * (1 - hold) * np.square(1 - np.abs(fresh))
            d_hold = flow * (state - fresh) * (SLOPE * ((hold > 0) & (hold < 1)))
            d_reset = d_fresh * back * (SLOPE * ((reset > 0) & (reset < 1)))
            d_given = np.concatenate([d_hold, d_reset, d_fresh], axis=1)
            d_back = np.concatenate([d_hold, d_reset, d_fresh * reset], axis=1)
            np.add.at(grad["in" + way], order[t], d_given)
            grad["re" + way] += state.T @ d_back
            flow = flow * hold + d_back @ again.T
    return loss, grad


def train(windows: np.ndarray, label: np.ndarray, languages: int, steps: int = STEPS, seed: int = 7) -> Weights:
    """Adam over random batches; ``windows`` is rows x bytes.  A quarter of each batch is cut short, as short texts are."""
    rng = np.random.default_rng(seed)
    w = new_weights(languages, rng)
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(windows), min(BATCH, len(windows)))
        batch = windows[pick].T.copy()
        batch[:, ::4][rng.integers(4, batch.shape[0] + 1, batch[0, ::4].size) <= np.arange(batch.shape[0])[:, None]] = 32
        _, grad = gradients(batch, label[pick], w)
        rate = 0.03 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k in w:
            g = np.clip(grad[k], -1, 1)
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            w[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return w


def to_bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def window_array(raw: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows x bytes with blanks behind each text's last byte; of each row, the text it belongs to and its bytes in use."""
    count = np.array([-(-len(t) // size) for t in raw])
    data = b"".join(t.ljust(n * size) for t, n in zip(raw, count.tolist()))
    owner = np.repeat(np.arange(len(raw)), count)
    place = np.arange(owner.size) - np.repeat(np.cumsum(count) - count, count)
    used = np.minimum(np.array([len(t) for t in raw])[owner] - place * size, size)
    return np.frombuffer(data, np.uint8).reshape(-1, size), owner, used


def pooled(raw: list[bytes], w: Weights) -> np.ndarray:
    """Probabilities of each text: the mean over its positions."""
    rows, owner, used = window_array(raw, WINDOW)
    total = np.zeros((len(raw), w["shift"].size))
    for start in range(0, len(rows), WINDOWS):
        part = slice(start, start + WINDOWS)
        p = position_probabilities(np.ascontiguousarray(rows[part].T), w)
        p *= (np.arange(WINDOW)[:, None] < used[part])[:, :, None]
        np.add.at(total, owner[part], p.sum(0, dtype=np.float64))
    return total / np.maximum(1, np.array([len(t) for t in raw]))[:, None]


def fit_language(docs: DataFrame, learn_from: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """Learn from rows where ``learn_from`` holds and neither ``text`` nor ``lang`` is null.

    Every language is learned.  The sample is bounded by the constants above and chosen by hash, so a repeated run learns
    the same.  Without such
    rows the model knows no language.
    """
    known = docs.where(learn_from).select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    known = known.where("lang IS NOT NULL AND length(trim(text)) > 0")
    often = known.groupBy("lang").agg(F.count("*").alias("n"))
    most = min(WINDOWS_PER_LANGUAGE, max(1, SAMPLE_WINDOWS // max(1, often.count())))
    some = known.join(small_enough(often, 64), "lang").where(
        F.pmod(F.xxhash64("key", F.length("text")), F.lit(1_000_000)) < F.lit(1_000_000 * DOCUMENTS_PER_LANGUAGE) / F.col("n")
    )
    starts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / SAMPLE_CHARACTERS).cast("int"))
    pieces = some.select("lang", "key", F.explode(starts).alias("at"), "text").select(
        "lang", F.xxhash64("key", "at").alias("order"), F.expr(f"substring(text, at * {SAMPLE_CHARACTERS} + 1, {SAMPLE_CHARACTERS})").alias("piece")
    )
    rank = F.row_number().over(W.partitionBy("lang").orderBy("order", "piece"))
    rows = sorted((r["lang"], r["piece"]) for r in pieces.withColumn("rank", rank).where(F.col("rank") <= most).collect())
    rows = [r for r in rows if has_letter(r[1])]
    languages = tuple(sorted({r[0] for r in rows}))
    if len(languages) < 2:
        return LanguageModel(languages, {})
    windows = np.stack([np.frombuffer(to_bytes(t)[:SAMPLE_CHARACTERS].ljust(SAMPLE_CHARACTERS), np.uint8) for _, t in rows])
    label = np.array([languages.index(name) for name, _ in rows])
    each = [np.flatnonzero(label == i) for i in range(len(languages))]
    even = np.concatenate([np.resize(i, max(map(len, each))) for i in each])
    return LanguageModel(languages, train(windows[even], label[even], len(languages)))


def predict_texts(texts: list[str | None], model: LanguageModel) -> tuple[list[str], list[float]]:
    spoken = [i for i, t in enumerate(texts) if t and has_letter(t)]
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if len(model.languages) == 1:
        for i in spoken:
            names[i], scores[i] = model.languages[0], 1.0
    elif model.languages and spoken:
        p = pooled([to_bytes(texts[i]) for i in spoken], model.weights)
        for i, best, score in zip(spoken, p.argmax(1).tolist(), p.max(1).tolist()):
            names[i], scores[i] = model.languages[best], min(score, 1.0)
    return names, scores


def label_languages(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's key with ``lang_pred`` and ``score`` (0 to 1), the pooled probability of that language.

    Texts that are null or hold no letter are ``und`` with score 0; so is every text where the model knows no language.
    Whole texts are read, in pieces of bounded size; null keys and repeated rows are rows like others, an empty table
    gives an empty result, and other columns are not read.  There is no shuffle.
    """
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, lang_pred string, score double"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in byte_slices(batches, text, WINDOW * WINDOWS):
            names, scores = predict_texts(piece.column(1).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(names), pa.array(scores)], [key, "lang_pred", "score"])

    return to_python(docs.select(key, text), work, schema)
