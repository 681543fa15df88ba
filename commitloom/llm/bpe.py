"""Byte-pair encoding with forced boundaries, and decoding, for the public word-BPE vocabulary.

A pair of bytes that occurs inside no vocabulary token can never be joined by a merge, so a word is cut
there, its fragments are encoded on their own and the ids are put together. Texts are cut at white space
first; pieces, words and fragments repeat often, so they are remembered up to a fixed number per worker. What has not been
asked for since as many others came is forgotten first.

A null or empty text gives no tokens, an empty decoded text. Rows keep their order and repeats.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from operator import add, itemgetter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from commitloom.llm.tables import per_batch, remember, texts

#: Pieces, words and fragments remembered by one worker come to twice this number.
REMEMBERED = 450_000
#: Tasks that share what is remembered.
KIND = "bpe"
# Fixed values of the public vocabulary's normaliser and splitter.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# the same for texts of ASCII characters only
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_MARKS = "".join(c for c in map(chr, range(128)) if not c.isalnum() and c not in "\t\n\x0b\x0c\r ")
_NOT_SPACE = re.compile("[\x1c-\x1f]")
_END = "</w>"
_COUNT = itemgetter(2)
_NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def together(rows: list[tuple[str, str, int]]) -> tuple[str, str, int]:
    ids, tokens, counts = zip(*rows) if rows else ((), (), ())
    return " ".join(ids), " ".join(tokens), sum(counts)


class Memory:
    """Results by key in two generations of ``size`` each: a full young one becomes the old one, whose hits come back."""

    def __init__(self, size: int, make: Callable):
        self.young: dict = {}
        self.old: dict = {}
        self.size, self.make = size, make

    def find(self, key):
        """The result for a key that the young generation lacked, at least when the caller last looked at it."""
        row = self.young.get(key) or self.old.get(key)
        if row is None:
            row = self.make(key)
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = row
        return row


class ForcedBoundaryBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        self.ids: dict[str, int] = data["model"]["vocab"]
        self.ranks = {tuple(m): i for i, m in enumerate(data["model"]["merges"])}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.letters = byte_letters()
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.numbers = {t: str(i) for t, i in self.ids.items()}
        # a special token begins with a mark and holds letters, so letters with marks after them hold none
        self.plain = all(t[0] in _MARKS and any(c.isalnum() for c in t) for t in self.special)
        bare = (t.removesuffix(_END) for t in self.ids)
        # rank of the letter pairs that some token holds; all others are forced boundaries
        self.pairs = {t[i:i + 2]: self.ranks.get((t[i], t[i + 1]), _NEVER) for t in bare for i in range(len(t) - 1)}
        self.forget()

    def forget(self) -> None:
        self.pieces = Memory(REMEMBERED * 2 // 3, self.piece)
        self.words = Memory(REMEMBERED // 4, self.word)
        self.fragments = Memory(REMEMBERED // 12, self.inner)

    def merge(self, parts: list[str], ranks: list[int]) -> list[str]:
        """The tokens that neighbouring parts are merged into, the pair of least rank first."""
        rank = self.ranks.get
        while ranks:
            least = min(ranks)
            if least == _NEVER:
                break
            at = ranks.index(least)
            parts[at] = left = parts[at] + parts.pop(at + 1)
            del ranks[at]
            if at:
                ranks[at - 1] = rank((parts[at - 1], left), _NEVER)
            if at < len(ranks):
                ranks[at] = rank((left, parts[at + 1]), _NEVER)
        return parts

    def fragment(self, letters: str, pairs: list[int], last: bool) -> list[str]:
        """Tokens of a fragment whose pairs of letters have the given ranks."""
        parts = list(letters)
        if last:
            parts[-1] += _END
            if pairs:
                pairs[-1] = self.ranks.get((parts[-2], parts[-1]), _NEVER)
        return self.merge(parts, pairs)

    def inner(self, fragment: str) -> list[str]:
        """Tokens of a fragment that does not end its word."""
        return self.fragment(fragment, list(map(self.pairs.get, map(add, fragment, fragment[1:]))), False)

    def word(self, word: str) -> tuple[str, str, int]:
        """Ids and tokens of one word, each joined by spaces, and their number."""
        letters = word if word.isascii() and word.isalnum() else "".join([self.letters[b] for b in word.encode()])
        pairs = list(map(self.pairs.get, map(add, letters, letters[1:])))
        if None in pairs:  # pairs that no token holds are cuts
            known, found, tokens, start = self.fragments.young, self.fragments.find, [], 0
            while None in pairs[start:]:
                end = pairs.index(None, start) + 1
                fragment = letters[start:end]
                tokens += known.get(fragment) or found(fragment)
                start = end
            tokens += self.fragment(letters[start:], pairs[start:], True)
        else:
            tokens = self.fragment(letters, pairs, True)
        return " ".join(map(self.numbers.__getitem__, tokens)), " ".join(tokens), len(tokens)

    def piece(self, piece: str) -> tuple[str, str, int]:
        """As ``word`` for a text without white space."""
        if self.plain and piece.isascii():
            # letters, then perhaps marks: two words, and no special token
            lowered = piece.lower()
            head = lowered.rstrip(_MARKS)
            if head.isalpha():
                known, find = self.words.young.get, self.words.find
                a = known(head) or find(head)
                if len(head) == len(lowered):
                    return a
                tail = lowered[len(head):]
                b = known(tail) or find(tail)
                return f"{a[0]} {b[0]}", f"{a[1]} {b[1]}", a[2] + b[2]
        rows = []
        for part in self.split_special.split(piece) if self.split_special and self.split_special.search(piece) else [piece]:
            if part in self.special:
                rows.append((str(self.special[part]), part, 1))
                continue
            # each letter is lowered by itself, so a final sigma gets no form of its own
            lowered = part.lower() if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            for word in (_ASCII_WORDS if lowered.isascii() else _WORDS).findall(lowered):
                rows.append(self.words.young.get(word) or self.words.find(word))
        return rows[0] if len(rows) == 1 else together(rows)

    def encode(self, text: str) -> tuple[str, str, int]:
        """As ``piece`` for a whole text."""
        pieces = _SPACE.split(text) if _NOT_SPACE.search(text) else text.split()
        rows = list(map(self.pieces.young.get, pieces))
        if None in rows:
            find = self.pieces.find
            rows = [row or find(piece) for row, piece in zip(rows, pieces)]
        return together(rows if all(map(_COUNT, rows)) else [row for row in rows if row[2]])

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.tokens[i] for i in ids)


@lru_cache(maxsize=2)
def coder(path: str) -> ForcedBoundaryBpe:
    made = ForcedBoundaryBpe(path)
    gc.freeze()  # the vocabulary stays; the collector need not walk it
    return made


def _coding(path: str) -> ForcedBoundaryBpe:
    """The worker's coder; what it remembers of pieces, words and fragments goes when the worker turns to other tasks."""
    found = coder(path)
    remember(KIND, found.forget)
    return found


def encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by spaces) and decoded text of every row."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = _coding(vocabulary)
        rows = [bpe.encode(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])],
            names=["doc_id", "n_tokens", "ids", "decoded"],
        )

    return texts(docs).mapInArrow(per_batch(step, KIND), "doc_id long, n_tokens long, ids string, decoded string")


def encoded_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """As ``encoded`` with SHA-256 digests in place of the two long columns, made where the text is read."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe, n, ids, decoded = _coding(vocabulary), [], [], []
        for text in batch.column("text"):
            row = bpe.encode(text.as_py())
            n.append(row[2])
            ids.append(hashlib.sha256(row[0].encode()).hexdigest())
            decoded.append(hashlib.sha256(row[1].encode()).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(per_batch(step, KIND), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
