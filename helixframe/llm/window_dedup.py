"""Removal of repeated word windows, by count-min sketches and an exact second pass.

A word goes if a window of ``width`` words that covers it also starts in a
document with a smaller id.

1. Rows are dealt by hash into blocks of a few megabytes of text. A block is a
   partition of its own: its windows are counted in a count-min sketch of
   ``ROWS`` rows, whose counters stop at 2 and of which only those that aren't
   zero are kept, as gaps between them. The sketch has about eight counters a
   window of the whole table in each row, so it grows with the table; it is cut
   into shards of a fixed size.
2. The blocks' sketches are merged shard by shard. Each block gets back one bit
   for each of its counters: whether the merged count is over one. That is all
   it needs to look up the minimum over the rows for each of its windows. As
   counters only ever overestimate, no repeated window is lost.
3. The second pass takes the windows that are estimated repeated, once a block
   with their smallest id, and groups them exactly by 128 bits of their words,
   again shard by shard; each gets back whether a smaller id has it elsewhere.
4. The third pass over the blocks cuts the covered words.

Only counters, digests and bits meet by window; a window that very many rows
hold counts once a block. Texts meet their bits by block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.byte_bpe import within
from helixframe.llm.shared import PRIME, U64, Rolling, arrow_map, drop_staged, flat, mix, runs, staged, table, tokens

WIDTH, ROWS = 13, 2
#: Bytes of text to a block, on average.
BLOCK_BYTES = 2 << 20
#: Counters of a shard of the sketch: two bits' worth of bytes in a task.
SHARD_BITS = 24
#: Windows to a shard of the exact pass, on average over all bytes.
EXACT_BYTES = 16 << 20
#: Words of so many bytes are told apart by their digest alone.
LONG_WORD = 512
_SALTS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)


def word_digests(body: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each word; each different word of a block is digested once."""
    key = Rolling(Rolling.LUT[body]).of(start, end) ^ mix((end - start).astype(U64))
    which, _ = pd.factorize(key)
    first = np.zeros(int(which.max()) + 1 if len(which) else 0, np.int64)
    first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
    raw = body.tobytes()

    def digests(at: np.ndarray) -> np.ndarray:
        text = b"".join(hashlib.blake2b(raw[s:e], digest_size=16).digest() for s, e in zip(start[at].tolist(), end[at].tolist(), strict=True))
        return np.frombuffer(text, "<u8").reshape(-1, 2)

    out = digests(first)[which] if len(which) else np.zeros((0, 2), U64)
    long = np.flatnonzero(end - start >= LONG_WORD)
    if len(long):
        out[long] = digests(long)
    return out[:, 0], out[:, 1]


def _sums(values: np.ndarray, at: np.ndarray, width: int, base: int) -> np.ndarray:
    """The polynomial of ``width`` values from each place on."""
    out = np.zeros(len(at), U64)
    for k in range(width):
        out = out * U64(base) + values[at + k]
    return mix(out)


class Block:
    """The words and windows of some texts."""

    def __init__(self, ids: pa.Array, text: pa.Array, width: int):
        self.width = width
        self.body, offsets = flat(text)
        self.start, self.end, self.row = tokens(self.body, offsets)
        self.rows = len(offsets) - 1
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        n = max(0, len(self.start) - width + 1)
        self.at = np.flatnonzero((self.row[:n] == self.row[width - 1 : width - 1 + n]) & known[self.row[:n]])
        x, y = word_digests(self.body, self.start, self.end)
        self.low, self.high = _sums(x, self.at, width, PRIME), _sums(y, self.at, width, PRIME ^ 0xFF0)
        self.id = self.ids[self.row[self.at]]

    def counters(self, row: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sketch row's counters that aren't zero, in order; where each window's is; whether it counts several windows."""
        cell = mix(self.low ^ U64(_SALTS[row])) >> U64(64 - bits)
        cells, place, count = np.unique(cell, return_inverse=True, return_counts=True)
        return cells.astype(np.int64), place, count > 1

    def repeated(self, bits: int, answers: dict[int, np.ndarray]) -> np.ndarray:
        """Windows whose least counter is over one. ``answers``: a bit a counter of each sketch row."""
        out = np.ones(len(self.at), bool)
        for row in range(ROWS):
            _, place, _ = self.counters(row, bits)
            if len(place):
                out &= answers[row][place]
        return np.flatnonzero(out)

    def distinct(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different windows of ``some`` in the order of their digests: the first of each, each one's number, its smallest id."""
        order = np.lexsort((self.high[some], self.low[some]))
        low, high = self.low[some][order], self.high[some][order]
        new = np.ones(len(order), bool)
        new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        heads = np.flatnonzero(new)
        number = np.zeros(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        least = np.minimum.reduceat(self.id[some][order], heads) if len(heads) else np.zeros(0, np.int64)
        return some[order[heads]], number, least

    def cut(self, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Words and removed words of each row, and what stays; ``gone``: windows whose words go."""
        step = np.zeros(len(self.start) + 1, np.int64)
        np.add.at(step, self.at[gone], 1)
        np.add.at(step, self.at[gone] + self.width, -1)
        stays = np.flatnonzero(np.cumsum(step[:-1]) == 0)
        n, kept = (np.bincount(r, minlength=self.rows) for r in (self.row, self.row[stays]))
        # Kept words with a blank after each; a row's last blank is left out.
        size = self.end[stays] - self.start[stays] + 1
        inside = within(size)
        body = np.r_[self.body, np.zeros(1, np.uint8)][np.repeat(self.start[stays], size) + inside]
        ends = np.cumsum(size)
        body[ends - 1] = 32
        bounds = np.r_[0, ends][np.r_[0, np.cumsum(kept)]]
        raw = body.tobytes()
        return n, n - kept, [raw[s : max(s, e - 1)] for s, e in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]


def planes(values: np.ndarray) -> bytes:
    """64-bit numbers as eight planes of bytes: the high ones, mostly zero, take no room when compressed."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplaned(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _cuts(high: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, from, to) of the runs of a sorted array."""
    bounds = np.r_[0, np.flatnonzero(np.diff(high)) + 1, len(high)] if len(high) else np.zeros(1, np.int64)
    for s, e in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
        yield int(high[s]), s, e


def _block_of(table: pa.Table, width: int) -> Block:
    one = table.combine_chunks()
    column = lambda c: one.column(c).chunk(0) if one.num_rows else pa.array([], one.schema.field(c).type)
    return Block(column("id"), column("text"), width)


def sketches(blocks: DataFrame, bits: int, width: int) -> DataFrame:
    """(block, row, shard, counters): each block's count-min sketch. A counter is its gap to the one before, doubled, plus one if it counts several windows."""
    shard_bits = min(bits, SHARD_BITS)

    def run(table: pa.Table) -> pa.Table:
        block, out = _block_of(table, width), []
        number = table.column("block")[0].as_py()
        for row in range(ROWS):
            cells, _, many = block.counters(row, bits)
            for shard, s, e in _cuts(cells >> shard_bits):
                gaps = np.diff(np.r_[shard << shard_bits, cells[s:e]])
                out.append((number, row, shard, planes(gaps.astype(U64) * U64(2) + many[s:e])))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["block", "row", "shard", "counters"])

    return blocks.groupBy("block").applyInArrow(run, "block long, row int, shard long, counters binary")


def merged(parts: DataFrame, bits: int) -> DataFrame:
    """(block, row, shard, over): for each counter of a block, whether the merged sketch counts over one there."""
    size = 1 << min(bits, SHARD_BITS)

    def run(batches):
        for table, bounds in runs(batches, ["row", "shard"]):
            blobs = table.column("counters")
            for s, e in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
                once, twice = np.zeros(size, bool), np.zeros(size, bool)
                for k in range(s, e):
                    cells, many = _counters(blobs[k].as_py())
                    twice[cells] |= many | once[cells]
                    once[cells] = True
                over = [np.packbits(twice[_counters(blobs[k].as_py())[0]]).tobytes() for k in range(s, e)]
                part = table.slice(s, e - s)
                yield from pa.table([part.column("block"), part.column("row"), part.column("shard"), pa.array(over, pa.binary())], ["block", "row", "shard", "over"]).to_batches()

    dealt = parts.repartition("row", "shard").sortWithinPartitions("row", "shard")
    return arrow_map(dealt, run, "block long, row int, shard long, over binary")


def _counters(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    values = unplaned(blob)
    return np.cumsum(values >> U64(1)).astype(np.int64), (values & U64(1)).astype(bool)


def _answers(table: pa.Table, sizes: dict[int, list[tuple[int, int]]]) -> dict[int, np.ndarray]:
    """The bits of each kind end to end by shard; ``sizes``: (shard, bits) of each kind, as the block itself knows them."""
    got = {(r["row"], r["shard"]): r["over"] for r in table.to_pylist()}
    out = {}
    for row, shards in sizes.items():
        parts = [np.unpackbits(np.frombuffer(got[row, shard], np.uint8), count=n).astype(bool) for shard, n in shards]
        out[row] = np.concatenate(parts) if parts else np.zeros(0, bool)
    return out


def _estimated(block: Block, answers: pa.Table, bits: int) -> np.ndarray:
    shard_bits = min(bits, SHARD_BITS)
    sizes = {row: [(shard, e - s) for shard, s, e in _cuts(block.counters(row, bits)[0] >> shard_bits)] for row in range(ROWS)}
    return block.repeated(bits, _answers(answers, sizes))


#: The kind of the exact pass's answers, beside the sketch's rows.
EXACT = ROWS


def asked(blocks: DataFrame, over: DataFrame, bits: int, exact_bits: int, width: int) -> DataFrame:
    """(block, shard, low, high, ids): digests and smallest ids of a block's windows that are estimated repeated."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        block, out = _block_of(texts, width), []
        number = texts.column("block")[0].as_py() if texts.num_rows else 0
        first, _, least = block.distinct(_estimated(block, answers, bits))
        low, high = block.low[first], block.high[first]
        for shard, s, e in _cuts(_top(low, exact_bits)):
            # Digests stand in order: their gaps are smaller than they are. Half of the second digest stays whole.
            out.append((number, shard, planes(np.diff(np.r_[U64(0), low[s:e]])), high[s:e].astype("<u8").tobytes(), planes(least[s:e].astype(U64))))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["block", "shard", "low", "high", "ids"])

    return blocks.groupBy("block").cogroup(over.groupBy("block")).applyInArrow(run, "block long, shard long, low binary, high binary, ids binary")


def _top(low: np.ndarray, bits: int) -> np.ndarray:
    return (low >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(low), np.int64)


def grouped(parts: DataFrame) -> DataFrame:
    """(block, row, shard, over): for each window asked by a block, whether another block has it with a smaller id."""

    def run(batches):
        for table, bounds in runs(batches, ["shard"]):
            for s, e in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
                part = table.slice(s, e - s)
                low = [np.cumsum(unplaned(x.as_py())) for x in part.column("low")]
                high = np.concatenate([np.frombuffer(x.as_py(), "<u8") for x in part.column("high")])
                ids = np.concatenate([unplaned(x.as_py()) for x in part.column("ids")]).astype(np.int64)
                size = np.array([len(x) for x in low])
                low = np.concatenate(low)
                order = np.lexsort((high, low))
                new = np.ones(len(order), bool)
                new[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
                heads = np.flatnonzero(new)
                least = np.repeat(np.minimum.reduceat(ids[order], heads), np.diff(np.r_[heads, len(order)]))
                less = np.zeros(len(order), bool)
                less[order] = least < ids[order]
                over = [np.packbits(x).tobytes() for x in np.split(less, np.cumsum(size)[:-1])]
                n = part.num_rows
                yield from pa.table([part.column("block"), pa.array(np.full(n, EXACT, np.int32)), part.column("shard"), pa.array(over, pa.binary())], ["block", "row", "shard", "over"]).to_batches()

    return arrow_map(parts.repartition("shard").sortWithinPartitions("shard"), run, "block long, row int, shard long, over binary")


KEPT = "id long, n_words long, n_removed long, kept string"


def cut(blocks: DataFrame, told: DataFrame, bits: int, exact_bits: int, width: int) -> DataFrame:
    """(id, n_words, n_removed, kept) of each row."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        block = _block_of(texts, width)
        some = _estimated(block, answers, bits)
        first, number, least = block.distinct(some)
        less = _answers(answers, {EXACT: [(shard, e - s) for shard, s, e in _cuts(_top(block.low[first], exact_bits))]})[EXACT]
        gone = some[less[number] | (least[number] < block.id[some])] if len(some) else some
        n, removed, kept = block.cut(gone)
        return pa.Table.from_arrays([texts.column("id").combine_chunks(), pa.array(n.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept"])

    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, KEPT)


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES, bits: int | None = None) -> DataFrame:
    """(id, n_words, n_removed, kept): the words of each row of ``df`` that stay, joined by one blank.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; null and empty texts have
    none. Texts of fewer than ``width`` words lose nothing. Rows that repeat an
    id are documents that share it: neither is smaller than the other. A row
    without an id loses nothing and takes nothing from others. Other columns
    are ignored; an empty table gives no rows. ``bits``: counters of a sketch
    row, as a power of two; results don't depend on it.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A word and its blank take some six bytes, so this is about eight counters a window.
    bits = bits or max(16, int(size).bit_length())
    exact_bits = max(0, int(size // EXACT_BYTES).bit_length())
    n = 1 + int(size // block_bytes)
    blocks = docs.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("long"))
    parts = staged(sketches(blocks, bits, width), "sketches")
    over = staged(merged(parts, bits), "over")
    drop_staged(spark, parts)
    exact = staged(grouped(asked(blocks, over, bits, exact_bits, width)), "exact")
    return cut(blocks, over.unionByName(exact), bits, exact_bits, width)


def op11_window_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    rows = drop_repeats(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS MATERIALIZED (SELECT doc_id, k, array_to_string(ws[k:k + 12], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS k FROM t WHERE len(ws) >= 13)),
f AS (SELECT w, min(doc_id) AS low FROM w GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT doc_id, k + j AS k FROM w JOIN f USING (w), range(0, 13) r(j) WHERE low < doc_id),
r AS (SELECT doc_id, list(k) AS gone, count(*) AS n FROM g GROUP BY 1),
x AS (SELECT doc_id, string_agg(w, ' ' ORDER BY k) AS kept FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM t) v WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = v.doc_id AND g.k = v.k) GROUP BY 1)
SELECT t.doc_id, len(ws)::BIGINT AS n_words, coalesce(r.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN r ON t.doc_id = r.doc_id LEFT JOIN x ON t.doc_id = x.doc_id
"""
