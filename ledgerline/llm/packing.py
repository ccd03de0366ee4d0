"""Packing token sequences by minimum bin slack.

A document longer than a sequence fills whole sequences with its first tokens; what remains of each document
is packed with others. A sequence takes the oldest waiting remainder and, from the window of those that
wait, the multiset of lengths whose sum comes closest to the space left: a subset-sum over a bitset, with the
number of pieces of each length traced back. Where no choice fills the sequence and more pieces wait than the window looks at,
a waiting piece is cut to fill it. Each task packs its own rows as they come, so no text is
shuffled; the few remainders that its last windows can't fill exactly go, with their ids, to a second packing over groups
of tasks. What fills no sequence there either is cut to fit, so that a group of GROUP tasks pads one sequence at most.

Cases: null and empty texts are one piece of the end id alone; equal rows are packed one by one; an empty
table gives no rows; null ids are carried along. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import materialize
from ledgerline.llm.encoding import crc32_of, encoder, read_tokenizer, text_batches

CAPACITY = 2048
#: Remainders that one choice looks at.
WINDOW = 64
#: Tasks whose last remainders meet in one group of the second packing.
GROUP = 64

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def closest_fill(counts: list[tuple[int, int]], space: int) -> dict[int, int]:
    """Of (length, count) the number of each length to take so that their sum comes closest to space from below."""
    reach, full = [1], (2 << space) - 1
    for length, count in counts:
        now, step = reach[-1], 1
        while count > 0:
            take = min(step, count)
            now |= (now << take * length) & full
            count, step = count - take, step * 2
        reach.append(now)
        if now >> space & 1:
            break
    total, used = reach[-1].bit_length() - 1, {}
    for at in range(len(reach) - 2, -1, -1):
        length, n = counts[at][0], 0
        while not reach[at] >> (total - n * length) & 1:
            n += 1
        if n:
            used[length] = n
            total -= n * length
    return used


def cut(piece: tuple, n: int) -> tuple[tuple, tuple]:
    """The first n ids of a piece (doc_id, start, length, ids_crc32, doc_tokens, ids), and the rest."""
    doc_id, start, length, _, tokens, ids = piece
    return (doc_id, start, n, crc32_of(ids[:n]), tokens, ids[:n]), (doc_id, start + n, length - n, crc32_of(ids[n:]), tokens, ids[n:])


class Packer:
    """Packs pieces (doc_id, start, length, ids_crc32, doc_tokens, ids) into numbered sequences."""

    def __init__(self, first_id: int, capacity: int = CAPACITY, window: int = WINDOW):
        self.next_id, self.capacity, self.window = first_id, capacity, window
        self.waiting: list[tuple] = []
        self.rows: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for piece in pieces:
            self.rows.append((*piece, self.next_id, at))
            at += piece[2]
        self.next_id += 1

    def _choose(self) -> list[tuple]:
        """Takes the next sequence's pieces off the waiting ones."""
        oldest, seen = self.waiting[0], self.waiting[1 : self.window]
        space = self.capacity - oldest[2]
        counts = Counter(x[2] for x in seen if x[2] <= space)
        used = closest_fill(sorted(counts.items(), reverse=True), space)
        chosen, rest = [oldest], []
        for piece in seen:
            if used.get(piece[2], 0):
                used[piece[2]] -= 1
                chosen.append(piece)
            else:
                rest.append(piece)
        self.waiting[: self.window] = rest
        return chosen

    def add(self, piece: tuple) -> None:
        if piece[2] == self.capacity:
            self._close([piece])
            return
        self.waiting.append(piece)
        if len(self.waiting) >= 2 * self.window:
            while len(self.waiting) > self.window:
                self._close(self._filled(self._choose()))

    def _filled(self, chosen: list[tuple]) -> list[tuple]:
        """chosen, with the beginning of a waiting piece that is longer than the room left, if there is room; its rest waits on."""
        room = self.capacity - sum(x[2] for x in chosen)
        if room:
            at = next((i for i, x in enumerate(self.waiting) if x[2] > room), None)
            if at is not None:
                head, self.waiting[at] = cut(self.waiting[at], room)
                chosen = [*chosen, head]
        return chosen

    def finish(self, keep_open: bool) -> list[tuple]:
        """Packs what waits; with keep_open the pieces of sequences that aren't full are returned instead."""
        left = []
        while self.waiting:
            chosen = self._choose()
            if keep_open and sum(x[2] for x in chosen) < self.capacity:
                left += chosen
            else:
                self._close(chosen)
        return left

    def cut_to_fit(self, pieces: list[tuple]) -> None:
        """Fills sequences with pieces in turn, cutting the last of each where it is full."""
        room, part = self.capacity, []
        for piece in pieces:
            while piece[2] > room:
                head, piece = cut(piece, room)
                self._close([*part, head])
                room, part = self.capacity, []
            part.append(piece)
            room -= piece[2]
            if not room:
                self._close(part)
                room, part = self.capacity, []
        if part:
            self._close(part)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start (its document's ids before it), length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_tokenizer(tokenizer_path))

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "task", "ids"]

    def batch(rows: list[tuple], task: int | None) -> pa.RecordBatch:
        columns = [*zip(*rows)] or [()] * 8
        ids = columns.pop(5)
        numbers = [pa.array(x, pa.int64()) for x in (*columns, [task] * len(rows))]
        packed = [None if task is None else x.astype("<u4").tobytes() for x in ids]
        return pa.RecordBatch.from_arrays([*numbers, pa.array(packed, pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(spec.value), TaskContext.get().partitionId()
        packer = Packer(task << 32, capacity, window)
        for doc_ids, texts in text_batches(batches):
            for doc_id, ids in zip(doc_ids.to_pylist(), enc.encode(texts)):
                ids = np.append(ids, np.array(end_id, "<u4"))
                for at in range(0, len(ids), capacity):
                    piece = ids[at : at + capacity]
                    packer.add((doc_id, at, len(piece), crc32_of(piece), len(ids), piece))
            if packer.rows:
                yield batch(packer.rows, None)
                packer.rows = []
        left = packer.finish(keep_open=True)
        yield batch(packer.rows, None)
        yield batch([(*x, 0, 0) for x in left], task)

    def again(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        packer = Packer(1 << 62 | int(key[0]) << 32, capacity, window)
        ordered = rows.sort_values(["task", "doc_id", "start", "ids_crc32"])
        docs = ordered["doc_id"].astype("object").where(ordered["doc_id"].notna(), None)
        for doc_id, ids, *rest in zip(docs, ordered["ids"], *(ordered[c].astype("int64") for c in ("start", "length", "ids_crc32", "doc_tokens"))):
            packer.add((doc_id, *map(int, rest), np.frombuffer(ids, "<u4")))
        packer.cut_to_fit(packer.finish(keep_open=True))
        frame = pd.DataFrame([(*x[:5], *x[6:]) for x in packer.rows], columns=[c for c in names if c not in ("task", "ids")])
        return frame.astype({"doc_id": "Int64"})

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = materialize(texts.mapInArrow(run, f"{PIECE}, task long, ids binary"), "packing-pieces")
    placed, left = pieces.filter("task IS NULL").drop("task", "ids"), pieces.filter("task IS NOT NULL")
    repacked = left.groupBy((F.col("task") / GROUP).cast("long").alias("group")).applyInPandas(again, PIECE)
    return placed.unionByName(repacked)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
