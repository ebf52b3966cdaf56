"""Packing of documents into token windows: bounded-space online best fit.

Each task reads its documents in turn and keeps at most ``open_windows``
windows open. Whole windows are cut off long documents at once; the rest of a
document goes to the open window that it fills best. When none has room and no
window may be opened, the fullest is emitted. The windows still open when a
task ends are leftovers; a second pass merges those of neighbouring tasks by
best fit, largest first, so that few half-empty windows remain.

A task's state is its open windows, whatever the input's size; the second
pass's tasks hold the leftovers of a fixed number of first-pass tasks.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm import byte_bpe
from helixframe.llm.shared import arrow_map, rows_by_bytes, staged

WINDOW, OPEN, END_ID = 2048, 64, 1
#: First-pass tasks whose leftovers are merged together.
MERGED = 32
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_FIELDS = [x.split()[0] for x in PIECES.split(", ")]


class Packer:
    """Bounded-space best fit of piece lengths; ``place`` returns (window, offset)."""

    def __init__(self, window: int, most: int):
        self.window, self.most, self.made = window, most, 0
        self.room: list[tuple[int, int]] = []  # (free, window) of open windows, sorted
        self.closed: list[int] = []

    def place(self, n: int) -> tuple[int, int]:
        i = bisect.bisect_left(self.room, (n, -1))
        if i < len(self.room):
            free, w = self.room.pop(i)
        else:
            if len(self.room) == self.most:
                self.closed.append(self.room.pop(0)[1])
            free, w = self.window, self.made
            self.made += 1
        if free > n:
            bisect.insort(self.room, (free - n, w))
        else:
            self.closed.append(w)
        return w, self.window - free


def _piece_batches(encoder: byte_bpe.Encoder, batch: pa.RecordBatch) -> Iterator[tuple]:
    """(doc_id, ids with the end id) of each row."""
    ids, bounds = encoder.encode(batch.column("text"))
    for i, doc in enumerate(batch.column("id").to_pylist()):
        yield doc, np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(END_ID)).astype("<u4")


def first_pass(df: DataFrame, path: str, window: int, most: int) -> DataFrame:
    """Pieces with their windows, and whether the window was still open at the task's end."""

    def run(batches):
        encoder, packer = byte_bpe.Encoder(path), Packer(window, most)
        task = TaskContext.get().partitionId()
        waiting: dict[int, list[tuple]] = {}

        def told(rows, is_open):
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in _FIELDS]
            arrays = [pa.array(c, pa.int64()) for c in cols]
            n = len(rows)
            return pa.RecordBatch.from_arrays([*arrays, pa.array([is_open] * n, pa.bool_()), pa.array([task] * n, pa.int64())], [*_FIELDS, "is_open", "task"])

        for whole in batches:
            for batch in rows_by_bytes(whole, "text"):
                out = []
                for doc, ids in _piece_batches(encoder, batch):
                    n = len(ids)
                    for start in range(0, n, window):
                        piece = ids[start : start + window]
                        crc = zlib.crc32(piece.tobytes())
                        if len(piece) == window:
                            w, offset = packer.made, 0
                            packer.made += 1
                            packer.closed.append(w)
                        else:
                            w, offset = packer.place(len(piece))
                        waiting.setdefault(w, []).append((doc, start, len(piece), crc, n, task << 32 | w, offset))
                for w in packer.closed:
                    out += waiting.pop(w)
                packer.closed.clear()
                yield told(out, False)
        yield told([r for rows in waiting.values() for r in rows], True)

    return arrow_map(df, run, PIECES + ", is_open boolean, task long")


def merge_leftovers(open_pieces: DataFrame, window: int) -> DataFrame:
    """Leftover pieces packed anew, largest first, among the tasks of each group."""

    def run(group: pa.Table) -> pa.Table:
        which = group.column("part")[0].as_py()
        length = group.column("length").to_numpy()
        order = np.lexsort((group.column("start").to_numpy(), group.column("doc_id").fill_null(-1).to_numpy(), -length))
        packer = Packer(window, len(length) + 1)
        seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for i in order.tolist():
            w, off[i] = packer.place(int(length[i]))
            seq[i] = 1 << 62 | which << 32 | w
        cols = [group.column(c) if c not in ("sequence_id", "offset") else pa.array(seq if c == "sequence_id" else off) for c in _FIELDS]
        return pa.Table.from_arrays(cols, _FIELDS)

    grouped = open_pieces.withColumn("part", F.floor(F.col("task") / MERGED).cast("long")).groupBy("part")
    return grouped.applyInArrow(run, PIECES)


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    window: int = WINDOW,
    open_windows: int = OPEN,
) -> DataFrame:
    """One row per piece of a document: its window (``sequence_id``) and place in it.

    A document is its ids and one end id; a null or empty text is the end id
    alone. A document longer than the window gives whole windows and one rest.
    Rows that repeat are packed each; an empty table gives no rows; other
    columns are ignored.
    """
    path = tokenizer or byte_bpe.public_path("byte_bpe_50k.json")
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    first = staged(first_pass(source, path, window, open_windows), "pieces")
    return first.where("not is_open").select(*_FIELDS).unionByName(merge_leftovers(first.where("is_open"), window))


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
