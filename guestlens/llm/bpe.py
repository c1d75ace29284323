"""Byte-pair encoding by backtracking, and decoding by an offset table.

A word becomes a string of 512 symbols: its bytes, the last one marked as the word's end.  An Aho-Corasick automaton
finds all tokens of the vocabulary in it, of which the longest at each place are tried first.  A token may follow
another only if the merges could not have joined them otherwise (`Merges.compatible`), and every token sequence in which
all neighbours are compatible is the one that the merges give.  So the search takes the longest compatible token, a
shorter one where it must, and steps back where nothing fits; places that led nowhere are marked, which keeps it linear.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from guestlens.llm.common import slices, to_python

#: Words whose ids a task remembers; beyond it the memory starts anew.
REMEMBERED_WORDS = 150_000

SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
ANY_WORD = regex.compile(rf"{ENDINGS}|\p{{L}}+|\p{{N}}|[^{SPACES}\p{{L}}\p{{N}}]+")


def _class(kind: str, below: int) -> str:
    return "".join(re.escape(chr(c)) for c in range(below) if unicodedata.category(chr(c))[0] == kind)


#: The same words in texts that hold nothing beyond the Latin letters of European languages, which `re` finds faster.
LATIN = 0x180
LATIN_WORD = re.compile(rf"{ENDINGS}|[{_class('L', LATIN)}]+|[{_class('N', LATIN)}]|[^{SPACES}{_class('L', LATIN)}{_class('N', LATIN)}]+")
BEYOND_LATIN = re.compile(f"[^\\x00-{chr(LATIN - 1)}]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabulary files of byte-level tokenizers."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in shown)}
    return [chr(hidden.get(b, b)) for b in range(256)]


def symbols(word: str) -> str:
    """The word's bytes as letters 0 to 255, its last byte as a letter from 256 on."""
    raw = word.encode("utf-8", "surrogatepass").decode("latin-1")
    return raw[:-1] + chr(256 + ord(raw[-1]))


class Merges:
    """Vocabulary and merges of a word-end BPE file; tokens are numbered by rank: 512 symbols, then the merges in order."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        end = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        letters = byte_letters()
        names = [x for x in letters] + [x + end for x in letters]
        rank = {name: i for i, name in enumerate(names)}
        self.text = [chr(i) for i in range(512)]
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(512)]
        self.joined: dict[tuple[int, int], int] = {}
        for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            if a + b in rank:
                raise ValueError(f"two merges make {a + b!r}")
            pair = rank[a], rank[b]
            rank[a + b] = self.joined[pair] = len(names)
            names.append(a + b)
            self.parts.append(pair)
            self.text.append(self.text[pair[0]] + self.text[pair[1]])
        self.ids = [vocab[name] for name in names]
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.shown = {i: name for name, i in vocab.items()} | {i: name for name, i in self.specials.items()}
        number = {t: i for i, t in enumerate(self.text)}
        self.length = [len(t) for t in self.text]
        #: The longest token that begins like this one, or -1.
        self.shorter = [next((number[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in number), -1) for t in self.text]
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(self.text):
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.known_pairs: dict[tuple[int, int], bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        pair = left, right
        known = self.known_pairs.get(pair)
        if known is None:
            if len(self.known_pairs) >= 1_000_000:
                self.known_pairs.clear()
            known = self.known_pairs[pair] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        """Undo the merges of both tokens from the latest on: none may have been preceded by one across their border."""
        before = len(self.text)
        while True:
            if self.joined.get((left, right), before) < before:
                return False
            if max(left, right) < 512:
                return True
            if left > right:
                before, left = left, self.parts[left][1]
            else:
                before, right = right + 1, self.parts[right][0]

    def encode_word(self, word: str) -> list[int]:
        """Ranks of the word's tokens."""
        text = symbols(word)
        size, length = len(text), self.length
        longest = [-1] * size
        for end, token in self.automaton.iter(text):
            start = end + 1 - length[token]
            if longest[start] < 0 or length[longest[start]] < length[token]:
                longest[start] = token
        out: list[int] = []
        dead = bytearray(size + 1)
        at, token = 0, longest[0]
        while at < size:
            last = out[-1] if out else -1
            while token >= 0 and (dead[at + length[token]] or (last >= 0 and not self.compatible(last, token))):
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at] if at < size else -1
            else:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
        return out


class WordIds(dict):
    """Packed ids by word, worked out when first asked for."""

    def __init__(self, merges: Merges) -> None:
        super().__init__()
        self.merges = merges

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        ids = self.merges.ids
        packed = self[word] = np.array([ids[t] for t in self.merges.encode_word(word)], "<u4").tobytes()
        return packed


class Tokenizer:
    """Encoder and decoder of one vocabulary file, as the tokenizers library gives them without special tokens added.

    Strings of special tokens in a text become those tokens, as there.  Decoding joins the tokens' strings by a blank:
    the file names no decoder.
    """

    def __init__(self, path: str) -> None:
        self.merges = Merges(path)
        self.words = WordIds(self.merges)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.merges.specials, key=len, reverse=True))) + ")")
        shown = [(self.merges.shown.get(i, "") + " ").encode() for i in range(max(self.merges.shown) + 1)]
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in shown])])
        self.letters = np.frombuffer(b"".join(shown), np.uint8)

    def split(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return (ANY_WORD if BEYOND_LATIN.search(text) else LATIN_WORD).findall(text)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        find, out = self.words.__getitem__, []
        for i, piece in enumerate(self.special.split(text)):
            if i % 2:
                out.append(np.array([self.merges.specials[piece]], "<u4").tobytes())
            elif piece:
                out.extend(map(find, self.split(piece)))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The decoded text in UTF-8."""
        numbers = np.frombuffer(ids, "<u4")
        if not numbers.size:
            return b""
        start = self.offsets[numbers]
        size = self.offsets[numbers + 1] - start
        ends = np.cumsum(size)
        places = np.arange(ends[-1]) + np.repeat(start - ends + size, size)
        return self.letters[places[:-1]].tobytes()


_LOADED: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """One per worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", decoded: bool = True) -> DataFrame:
    """Every row's key, its ids packed as little-endian unsigned 32-bit integers, and the text decoded from them.

    ``path`` is a vocabulary file that every executor has.  Null and empty texts give no ids and an empty text; null
    keys and repeated rows are rows like others, an empty table gives an empty result, and other columns are not read.
    There is no shuffle; a task holds one Arrow batch, short slices of results and a bounded memory of words.
    """
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, ids binary" + ", decoded string" * decoded

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for piece in slices(batches):
            ids = [bpe.encode(t) if t else b"" for t in piece.column(1).to_pylist()]
            columns = [piece.column(0), pa.array(ids, pa.binary())]
            if decoded:
                columns.append(pa.array([bpe.decode(x) for x in ids], pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [key, "ids", "decoded"][: len(columns)])

    return to_python(docs.select(key, text), work, schema)


def decode_documents(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Key and ``decoded`` text of every row of packed ids; null ids give an empty text."""
    schema = f"`{key}` {encoded.schema[key].dataType.simpleString()}, decoded string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for piece in slices(batches):
            texts = pa.array([bpe.decode(x or b"") for x in piece.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([piece.column(0), texts.cast(pa.string())], [key, "decoded"])

    return to_python(encoded.select(key, ids), work, schema)
