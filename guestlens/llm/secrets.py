"""Secret scan with linking of multipart credentials.

Strong findings (assignments, access keys, long hexadecimal strings) are reported by themselves.  Weak candidates
(account names, random-looking strings, endpoints) mean nothing alone: an interval join over the parts of a batch of
documents finds, for each weak part, the nearest part of both other kinds, and reports it only where both lie in its
scope, that is within ``reach`` characters of the same document.  Joins go through sorted positions, so a document
with very many parts costs no more per part than one with few.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from guestlens.llm.common import slices, to_python

#: Distance in characters between the parts of one credential.
REACH = 400

# Patterns of the findings that are reported by themselves, and the kinds in the order of their names.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_VALUE = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "identifier", "random", "endpoint")

IDENTIFIER = re.compile(r"""(?i:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]{3,})""", re.ASCII)
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])", re.ASCII)
ENDPOINT = re.compile(r"[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]+|(?i:host|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?::[0-9]+)?", re.ASCII)
#: Every endpoint holds one of these: texts without them have no multipart credential.
ENDPOINT_SIGNS = ("://", "host", "endpoint", "server")

#: What a kind stands for in a credential.
ROLES = {"access": 0, "identifier": 0, "assign": 1, "hex": 1, "random": 1, "endpoint": 2}
WEAK = {"identifier", "random", "endpoint"}

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the findings that need no company; the first matches from the left for each kind."""
    low = text.lower()
    out: list[Span] = []
    if len(low) != len(text) or any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def mixed(word: str) -> bool:
    """Letters of both cases and digits, as random strings have."""
    return any(c.isdigit() for c in word) and any(c.islower() for c in word) and any(c.isupper() for c in word)


def weak_spans(text: str, base: list[Span]) -> list[Span]:
    """Candidates that do not overlap a finding of `base`."""
    low = text.lower()
    if not any(sign in low for sign in ENDPOINT_SIGNS):
        return []
    found = [(m.start(), 3, m.end()) for m in IDENTIFIER.finditer(text)]
    found += [(m.start(), 4, m.end()) for m in RANDOM.finditer(text) if mixed(m[0])]
    found += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    if not base:
        return found
    starts = np.sort(np.array([s for s, _, _ in base]))
    ends = np.maximum.accumulate(np.array([e for _, _, e in sorted(base)]))
    at = np.searchsorted(starts, [e for _, _, e in found])
    return [x for x, i in zip(found, at) if i == 0 or ends[i - 1] <= x[0]]


def linked(row: np.ndarray, start: np.ndarray, end: np.ndarray, role: np.ndarray, reach: int) -> np.ndarray:
    """Of each part: whether parts of both other roles lie within ``reach`` of it in the same row."""
    if not row.size:
        return np.zeros(0, bool)
    wide = int(end.max()) + 2 * reach + 2
    left, right = row * wide + start, row * wide + end
    company = np.ones(row.size, bool)
    for kind in range(3):
        mine = np.flatnonzero(role == kind)
        lefts = np.sort(left[mine])
        rights = np.sort(right[mine])
        # a part of that kind meets [left - reach, right + reach) unless as many ended before it as began up to its end
        begun = np.searchsorted(lefts, right + reach, side="right")
        ended = np.searchsorted(rights, left - reach, side="left")
        company &= (begun > ended) | (role == kind)
    return company


def scan_texts(texts: list[str | None], reach: int) -> list[list[Span]]:
    """All reported spans of each text, by start, then kind."""
    base = [base_spans(t) if t else [] for t in texts]
    weak = [weak_spans(t, b) if t else [] for t, b in zip(texts, base)]
    parts = [(i, *s) for i, w in enumerate(weak) if w for s in [*base[i], *w]]
    if parts:
        row, start, kind, end = np.array(parts, np.int64).T
        role = np.array([ROLES[k] for k in KINDS])[kind]
        for i, at, k, to in np.array(parts)[linked(row, start, end, role, reach) & (kind >= 3)].tolist():
            base[i].append((at, k, to))
    return [sorted(b) for b in base]


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """Every row's key and its findings: ``spans``, an array of (kind, start, end) in code points, end exclusive.

    Null and empty texts have no findings; null keys and repeated rows are rows like others; an empty table gives an
    empty result; other columns are not read.  Texts are scanned whole and there is no shuffle.
    """
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int>>"
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            found = scan_texts(piece.column(1).to_pylist(), reach)
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x] for x in found]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(spans, pa.list_(span))], [key, "spans"])

    return to_python(docs.select(key, text), work, schema)
