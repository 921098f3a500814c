"""Byte-level BPE by prefix dynamic programming.

In a byte-pair encoding every prefix of a text has one encoding, so it is enough to store the last token of
each prefix: token t may end a prefix if the prefix before it ends in a token that stays apart from t. Whole
encodings are read back from the last tokens; bytes can be appended exactly, and an edit re-encodes only from
the edited place on.

Two tokens stay apart unless, while each is being merged, some token at the right edge of the first and
some token at the left edge of the second would be merged earlier than either edge's next merge.

Edge cases. A null text is empty and has no ids. Texts are cut by the vocabulary's pattern first; a piece that
is itself in the vocabulary is that token. Repeated rows are encoded each for themselves; an empty table
gives an empty result; other columns are ignored. Whole texts are encoded.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from .common import batched

#: Parameters: pairs remembered, and pieces remembered in each of two generations.
PAIRS = 500_000
REMEMBERED = 200_000
NEVER = 1 << 40
#: Letters below this are old enough to be letters to every Unicode version.
SETTLED = "\u0530"
MARKS = tuple(".,;:!?")


class Vocabulary:
    """Ranks of byte strings (lowest merges first) with what the prefix search needs."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.edges: dict[int, tuple | None] = {}
        self.apart: dict[int, bool] = {}
        #: Tokens that their own bytes merge to; others never end a prefix.
        self.sound = {b: i for b, i in ranks.items() if self.edges_of(i) is not None}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def merged(self, piece: bytes) -> list[bytes]:
        """Plain merging, lowest rank and then leftmost first."""
        return self.merge_steps(piece)[0]

    def merge_steps(self, piece: bytes) -> tuple[list[bytes], list[tuple[bytes, int]], list[tuple[bytes, int]]]:
        """The parts left, and (part, rank of the merge that takes it) of the left and the right edge in order."""
        parts, left, right = [piece[i : i + 1] for i in range(len(piece))], [], []
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == NEVER:
                break
            if at == 0:
                left.append((parts[0], rank))
            if at == len(parts) - 2:
                right.append((parts[-1], rank))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, [*left, (parts[0], NEVER)], [*right, (parts[-1], NEVER)]

    def edges_of(self, token: int):
        """(left edge, right edge) of a token's merging, None if its bytes don't merge to it."""
        if token not in self.edges:
            parts, left, right = self.merge_steps(self.bytes_of[token])
            self.edges[token] = (left, right) if len(parts) == 1 else None
        return self.edges[token]

    def stay_apart(self, a: int, b: int) -> bool:
        got = self.apart.get(a << 32 | b)
        if got is None:
            if len(self.apart) >= PAIRS:
                self.apart.clear()
            got = self.apart[a << 32 | b] = self.never_joined(a, b)
        return got

    def never_joined(self, a: int, b: int) -> bool:
        ranks, left_of_b = self.ranks, self.edges_of(b)[0]
        for x, x_ends in self.edges_of(a)[1]:
            for y, y_ends in left_of_b:
                rank = ranks.get(x + y, NEVER)
                if rank < x_ends and rank <= y_ends:
                    return False
        return True


class Prefixes:
    """The last token of each prefix of some bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, bytearray(), []
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        v, text, last = self.vocabulary, bytes(self.data), self.last
        rank_of, apart, longest = v.sound.get, v.apart.get, v.longest
        for end in range(len(last) + 1, len(text) + 1):
            for start in range(end - 1, max(-1, end - longest - 1), -1):  # one start fits, in any order
                t = rank_of(text[start:end])
                if t is None:
                    continue
                if start:
                    pair = last[start - 1] << 32 | t
                    fits = apart(pair)
                    if fits is None:
                        fits = v.stay_apart(pair >> 32, t)
                    if not fits:
                        continue
                last.append(t)
                break

    def edit(self, at: int, removed: int, inserted: bytes) -> None:
        """Replaces bytes; prefixes before the place keep their tokens."""
        tail = bytes(self.data[at + removed :])
        del self.data[at:], self.last[at:]
        self.append(inserted + tail)

    def ids(self) -> list[int]:
        out, end = [], len(self.last)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.bytes_of[out[-1]])
        return out[::-1]


class Unsafe(Exception):
    """A chunk whose white space may belong to a longer run: the text has to be cut as a whole."""


class Remembered(dict):
    """What make gives for a chunk, in two generations so that frequent chunks stay and memory is bounded."""

    def __init__(self, make, lead: str = "", most: int = REMEMBERED):
        super().__init__()
        self.make, self.lead, self.most, self.old = make, lead, most, {}

    def known(self, chunk: str) -> bytes | None:
        got = self.get(chunk)
        return self.old.get(chunk) if got is None else got

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        got = self.old.get(chunk)
        if got is None:
            if not chunk or chunk[0].isspace() or chunk[-1].isspace():
                raise Unsafe
            got = self.make(self.lead + chunk)
        self[chunk] = got
        return got


def joined(text: str, first: Remembered, later: Remembered, newline: bytes) -> bytes:
    """Ids of a text whose white space is single spaces and newlines, from its chunks; raises Unsafe otherwise.

    A piece of the pattern never runs over the start of a single space between words or over a single newline.
    """
    out = []
    for line in text.split("\n"):
        chunks = line.split(" ")
        out.append(newline)
        out.append(first[chunks[0]])
        if len(chunks) > 1:
            out += map(later.__getitem__, chunks[1:])
    return b"".join(out[1:])


class Encoder:
    """Texts to ids (little-endian unsigned 32-bit) and back."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = public_tokenizers.PATTERN):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.short = pattern == public_tokenizers.PATTERN  # the shortcuts below hold for this pattern
        self.first, self.later = Remembered(self.cut), Remembered(self.cut, " ")
        self.newline = self.cut("\n")
        self.marks = {m: self.cut(m) for m in MARKS}
        size = max(vocabulary.bytes_of, default=0) + 1
        self.table = [vocabulary.bytes_of.get(i, b"") for i in range(size)]

    def piece(self, data: bytes) -> list[int]:
        whole = self.vocabulary.ranks.get(data)
        return [whole] if whole is not None else Prefixes(self.vocabulary, data).ids()

    def cut(self, text: str) -> bytes:
        bare = text[1:] if text[0] == " " else text
        if not self.short:
            pass
        elif bare.isalpha() and max(bare) < SETTLED:  # one piece; the pattern agrees
            return b"".join([i.to_bytes(4, "little") for i in self.piece(text.encode())])
        elif bare[-1:] in MARKS and bare[:-1].isalpha() and max(bare) < SETTLED:  # two: a word and a mark
            word = (self.later if text[0] == " " else self.first).known(bare[:-1])
            return (self.cut(text[:-1]) if word is None else word) + self.marks[bare[-1]]
        return np.array([i for p in self.pattern.finditer(text) for i in self.piece(p[0].encode())], "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not text or not self.short:
            return self.cut(text) if text else b""
        try:
            return joined(text, self.first, self.later, self.newline)
        except Unsafe:
            return self.cut(text)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def encoder(path: str) -> Encoder:
    """One for each Python worker, so that what it remembers serves all its tasks."""
    return Encoder(Vocabulary.load(path))


def encode_table(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (of the bytes that the ids give back) and, on demand, ids."""
    batched(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            ids = [enc.encode(t or "") for t in b.column(1).to_pylist()]
            cols = [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(enc.decode(x)).hexdigest() for x in ids], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
                cols.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(x) // 4 for x in ids]]), pa.int32()), flat))
            yield pa.RecordBatch.from_arrays(cols, names=names + ["ids"] * with_ids)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text")).mapInArrow(run, schema)
