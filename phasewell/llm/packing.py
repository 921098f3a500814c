"""Bounded-space online packing of tokenised documents into windows.

Each partition keeps at most OPEN windows. A document's full windows go out by themselves; its rest goes into
the open window it leaves least room in. If none fits and no more may be opened, the fullest is filled
with the head of the rest and emitted, and what remains is placed anew. What partitions leave open is merged in
rounds of FAN partitions to a task; at last each open window is cut into sequences whose lengths are
powers of two, which need no padding.

Edge cases. A null text is empty: its document is the closing id alone. Rows without an id are packed
too. Repeated rows are documents of their own; an empty table gives an empty result; other columns are
ignored. Whole texts are packed; each id lies in exactly one piece.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SETTLED, Remembered, Unsafe, joined
from .common import Work

#: Parameters: tokens of a window, open windows of a partition, partitions that a merging task takes, closing id.
WIDTH = 2048
OPEN = 8
FAN = 64
END = 1
PIECES = 20_000
#: Runs of marks remembered in each of two generations.
MARK_RUNS = 5_000

BYTE_CHARS = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: ASCII marks but those of special tokens; behind a word, a run of them is one piece.
MARKS = "!\"#$%&'()*+,-./:;=?@[\\]^_`{}~"
TO_CHARS = {b: b for b in BYTE_CHARS} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in BYTE_CHARS)}
SPACE = chr(TO_CHARS[32])


class Tokens:
    """Ids of texts by the tokenizers library, remembered by chunk."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        made = json.loads(self.tokenizer.to_str())
        cut = made["pre_tokenizer"] or {}
        #: The shortcuts below hold for plain byte-level tokenizers; others get every text whole.
        self.short = not made["normalizer"] and not made["post_processor"] and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and all("<|" in t["content"] and "|>" in t["content"] for t in made["added_tokens"])
        self.first, self.later = Remembered(self.chunk), Remembered(self.chunk, " ")
        self.marks = Remembered(self.word, most=MARK_RUNS)
        self.newline = self.whole("\n")

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def word(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            piece = piece.replace(" ", SPACE)
        else:
            piece = piece.encode().decode("latin1").translate(TO_CHARS)
        ids = [t.id for t in self.model.tokenize(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def chunk(self, chunk: str) -> bytes:
        """A word goes straight to the model, and once for all runs of marks behind it; anything else through the whole tokenizer."""
        bare = chunk[1:] if chunk[0] == " " else chunk
        letters = bare.rstrip(MARKS)
        if letters.isalpha() and (letters.isascii() or max(letters) < SETTLED):
            if len(letters) == len(bare):
                return self.word(chunk)
            return (self.later if chunk[0] == " " else self.first)[letters] + self.marks[bare[len(letters) :]]
        if "<|" in chunk or "|>" in chunk:
            raise Unsafe  # may be part of a special token
        return self.whole(chunk)

    def ids(self, text: str) -> bytes:
        if not text or not self.short:
            return self.whole(text) if text else b""
        try:
            return joined(text, self.first, self.later, self.newline)
        except Unsafe:
            return self.whole(text)


@cache
def tokens(path: str) -> Tokens:
    """One for each Python worker."""
    return Tokens(path)


class Packer:
    """Open windows of (document, start, ids, document's tokens) pieces; full ones go to emit."""

    def __init__(self, emit, width: int = WIDTH, open_windows: int = OPEN):
        self.emit, self.width, self.most = emit, width, open_windows
        self.windows: list[list] = []  # [tokens so far, pieces]

    def add(self, doc, start: int, ids: memoryview, total: int) -> None:
        """ids: bytes of 4 an id, as a memoryview."""
        while len(ids) >= 4 * self.width:
            self.emit([(doc, start, ids[: 4 * self.width], total)])
            ids, start = ids[4 * self.width :], start + self.width
        while len(ids):
            n = len(ids) // 4
            best = max((w for w in self.windows if w[0] + n <= self.width), key=lambda w: w[0], default=None)
            if best is None and len(self.windows) < self.most:
                best = [0, []]
                self.windows.append(best)
            if best is not None:
                best[0] += n
                best[1].append((doc, start, ids, total))
                if best[0] == self.width:
                    self.windows.remove(best)
                    self.emit(best[1])
                return
            fullest = max(self.windows, key=lambda w: w[0])
            room = self.width - fullest[0]
            self.windows.remove(fullest)
            self.emit([*fullest[1], (doc, start, ids[: 4 * room], total)])
            ids, start = ids[4 * room :], start + room


def powers(window: list) -> Iterator[list]:
    """A window's pieces cut into sequences whose lengths are falling powers of two."""
    left, now, room = window[0], [], 0
    for doc, start, ids, total in window[1]:
        while len(ids):
            if not room:
                if now:
                    yield now
                room, now = 1 << (left.bit_length() - 1), []
                left -= room
            take = min(room, len(ids) // 4)
            now.append((doc, start, ids[: 4 * take], total))
            ids, start, room = ids[4 * take :], start + take, room - take
    if now:
        yield now


class Rows:
    """Pieces gathered into record batches; sequence ids are unique by round, partition and order."""

    NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "open", "ids"]
    SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open long, ids binary"

    def __init__(self, round_no: int):
        self.rows: list[tuple] = []
        self.next = round_no << 56 | TaskContext.get().partitionId() << 32

    def emit(self, pieces, is_open: bool = False) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next, offset, self.next if is_open else None, bytes(ids) if is_open else None))
            offset += n
        self.next += 1

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int64()] * 8 + [pa.binary()]
        cols = list(zip(*self.rows, strict=True)) or [[]] * 9
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=self.NAMES)


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, open_windows: int = OPEN) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = df.sparkSession
    work = Work(spark, "packing")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, rows = tokens(path), Rows(0)
        packer = Packer(rows.emit, width, open_windows)
        closing = END.to_bytes(4, "little")
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = memoryview(enc.ids(text or "") + closing)
                packer.add(doc, 0, ids, len(ids) // 4)
                if len(rows.rows) > PIECES:
                    yield rows.batch()
        for w in packer.windows:
            rows.emit(w[1], is_open=True)
        yield rows.batch()

    def merge(round_no: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = Rows(round_no)
            packer = Packer(rows.emit, width, open_windows)
            for b in batches:
                for doc, start, ids, total in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    packer.add(doc, start, memoryview(ids), total)
            for w in packer.windows:
                if last:
                    for s in powers(w):
                        rows.emit(s)
                else:
                    rows.emit(w[1], is_open=True)
            yield rows.batch()

        return run

    source = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    names = Rows.NAMES[:7]
    out, round_no = work.save(source.mapInArrow(first, Rows.SCHEMA), "pieces-0"), 0
    done = out.where("open IS NULL").select(*names)
    left = out.where("open IS NOT NULL")
    partitions = 1 + (left.agg(F.max(F.shiftright("open", 32).bitwiseAND(F.lit((1 << 24) - 1)))).first()[0] or 0)
    while True:
        round_no += 1
        tasks = -(-partitions // FAN)
        group = F.shiftright("open", 32).bitwiseAND(F.lit((1 << 24) - 1))
        dealt = left.withColumn("to", F.floor(group / FAN).cast("int")).repartitionByRange(tasks, "to") if tasks > 1 else left.repartition(1)
        dealt = dealt.sortWithinPartitions("open", "offset").select("doc_id", "start", "ids", "doc_tokens")
        out = work.save(dealt.mapInArrow(merge(round_no, tasks == 1), Rows.SCHEMA), f"pieces-{round_no}")
        done = done.unionByName(out.where("open IS NULL").select(*names))
        if tasks == 1:
            return done
        left, partitions = out.where("open IS NOT NULL"), tasks
