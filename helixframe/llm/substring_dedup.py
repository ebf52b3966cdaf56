"""Removal of long repeated byte strings, by suffix arrays over shared neighbourhoods.

A byte goes if a string of ``width`` bytes that covers it also starts in a
document with a smaller id.

1. Of equal texts only the one with the smallest id is looked at; the others
   are covered as a whole if they are long enough.
2. Every window of ``width`` bytes has a minimizer, the smallest hash of its
   ``mer``-byte substrings. Equal windows have equal minimizers, so windows are
   compared only within a minimizer's group. Neighbouring windows with one
   minimizer are kept as one string (about 16 windows in 65 bytes).
3. Minimizers that only one document has are left out: an aggregation with
   map-side minimum and maximum of the id. The strings of the others go on.
4. Equal strings of a group (told by a second 64-bit hash) are one, with their
   smallest id. A string is cut to the stretch between its first and last window
   whose hash its group has twice; what is outside can't be shared. The cut
   strings stand end to end in a text whose suffix array is built by linear
   grouping; neighbours in it that share ``width`` bytes are equal windows, and
   their smallest id goes to each.
5. A group with very many distinct strings is cut before it comes to one task:
   the hashes of its windows are counted over the cluster, and only the
   stretches between shared ones go on. Strings that differ outside such a
   stretch become one. A group that is large even then is dealt by a longer
   anchor, the smallest hash of the substrings of 35 bytes of each window, and
   what is still large by the windows' own hashes, of which a group has one
   string. So no suffix array is over more than ``LARGE`` strings of at most
   ``STRETCH`` windows, whatever the documents share.
6. Each string's result joins its occurrences; windows whose smallest id is
   smaller than their document's give the removed intervals. Strings, windows
   and texts that very many places share are joined where the places are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.byte_bpe import within
from helixframe.llm.shared import Rolling, arrow_map, drop_staged, flat, mix, rows_by_bytes, runs, segments, split_join, staged
from helixframe.llm.suffix_array import suffix_array

WIDTH, MER = 50, 20
#: Windows to a string; a longer run of one minimizer is cut.
STRETCH = 40
#: Distinct strings of a group beyond which they are cut over the cluster.
LARGE = 4096
#: Sides are broadcast up to so many rows, else joined by shuffle.
BROADCAST_ROWS = 4_000_000
BROADCAST_MARKS = 400_000


def stretches(body: np.ndarray, offsets: np.ndarray, width: int, mer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, row, first window's byte in its row, windows) of every string of windows."""
    n = len(body)
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none, none
    roll = Rolling(Rolling.LUT[body])
    at = np.arange(n - mer + 1)
    low = (roll.of(at, at + mer) >> np.uint64(1)).astype(np.int64)
    span, have = width - mer + 1, 1
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    row = segments(offsets)
    valid = row[: n - width + 1] == row[width - 1 :]
    w = np.flatnonzero(valid)
    if not len(w):
        return none, none, none, none
    low, r = low[w], row[w]
    new = np.ones(len(w), bool)
    new[1:] = (low[1:] != low[:-1]) | (r[1:] != r[:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.r_[begin, len(w)])
    # Long runs are cut into stretches.
    parts = -(-size // STRETCH)
    first = np.repeat(begin, parts) + within(parts) * STRETCH
    size = np.diff(np.r_[first, len(w)])
    return low[first], r[first], w[first] - offsets[r[first]], size


def _strings(body: np.ndarray, begin: np.ndarray, length: np.ndarray) -> pa.Array:
    ends = np.r_[0, np.cumsum(length)].astype(np.int32)
    # The places of all bytes at once: a count, moved by where each string begins.
    place = np.repeat((begin - ends[:-1]).astype(np.int32), length)
    place += np.arange(ends[-1], dtype=np.int32)
    data = body[place]
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _minimizers(docs: DataFrame, width: int, mer: int) -> DataFrame:
    """(m, id) of each string of windows."""

    def run(batches):
        for whole in batches:
            for batch in rows_by_bytes(whole, "text"):
                body, offsets = flat(batch.column("text"))
                m, row, _, _ = stretches(body, offsets, width, mer)
                yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(batch.column("id").to_numpy()[row])], ["m", "id"])

    return arrow_map(docs.select("id", "text"), run, "m long, id long")


def _occurrences(docs: DataFrame, width: int, mer: int) -> DataFrame:
    def run(batches):
        for whole in batches:
            for batch in rows_by_bytes(whole, "text"):
                body, offsets = flat(batch.column("text"))
                m, row, start, size = stretches(body, offsets, width, mer)
                ids, f = batch.column("id").to_numpy(), batch.column("f").to_numpy()
                for k in range(0, len(m), 1 << 15):
                    s = slice(k, k + (1 << 15))
                    pieces = _strings(body, offsets[row[s]] + start[s], size[s] + width - 1)
                    yield pa.RecordBatch.from_arrays([pa.array(m[s]), pa.array(ids[row[s]]), pa.array(f[row[s]]), pa.array(start[s]), pieces], ["m", "id", "f", "start", "piece"])

    occurrences = arrow_map(docs.select("id", "f", "text"), run, "m long, id long, f long, start long, piece binary")
    return occurrences.withColumn("h", F.xxhash64("piece"))


def _thin(docs: DataFrame, width: int, mer: int) -> DataFrame:
    """Occurrences without their bytes, for when the shared minimizers are too many to broadcast."""

    def run(batches):
        for whole in batches:
            for batch in rows_by_bytes(whole, "text"):
                m, row, start, size = stretches(*flat(batch.column("text")), width, mer)
                ids, f = batch.column("id").to_numpy(), batch.column("f").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(ids[row]), pa.array(f[row]), pa.array(start), pa.array(size)], ["m", "id", "f", "start", "size"])

    return arrow_map(docs.select("id", "f", "text"), run, "m long, id long, f long, start long, size long")


def _shared_occurrences(docs: DataFrame, shared: DataFrame, width: int, mer: int, most: int) -> DataFrame:
    """Occurrences whose minimizer several documents have.

    While the shared minimizers are few, texts are cut and filtered in one
    pass. Beyond that, places without bytes join them by shuffle, and the texts
    join their places by id.
    """
    if shared.count() <= most:
        return _occurrences(docs, width, mer).join(F.broadcast(shared), "m", "left_semi")
    hits = _thin(docs, width, mer).join(shared, "m", "left_semi")
    places = hits.groupBy(F.col("id").alias("pid"), F.col("f").alias("pf")).agg(F.collect_list(F.struct("m", "start", "size")).alias("at"))
    cut = docs.join(places, (F.col("id") == F.col("pid")) & (F.col("f") == F.col("pf"))).withColumn("bytes", F.encode("text", "UTF-8"))
    rows = cut.select("id", "f", "bytes", F.explode("at").alias("p"))
    return rows.select("p.m", "id", "f", "p.start", F.expr(f"substring(bytes, cast(p.start + 1 as int), cast(p.size + {width - 1} as int))").alias("piece")).withColumn("h", F.xxhash64("piece"))


def lowest_ids(pieces: list[bytes], ids: np.ndarray, width: int) -> list[np.ndarray]:
    """For each window of each string, the smallest id of any string that holds the window's bytes."""
    sizes = np.array([len(p) for p in pieces])
    if len(pieces) < 2:
        return [np.full(n - width + 1, i, np.int64) for n, i in zip(sizes.tolist(), ids.tolist(), strict=True)]
    # A zero ends each string; bytes move up by one, the highest two (never in UTF-8) being one.
    text = b"\0".join(p.translate(_UP) for p in pieces) + b"\0"
    begin = np.r_[0, np.cumsum(sizes + 1)]
    owner = np.repeat(np.arange(len(pieces)), sizes + 1)
    order = np.array(suffix_array(text))
    order = order[order - begin[owner[order]] <= sizes[owner[order]] - width]
    # Neighbours in the order are equal windows if their bytes are.
    windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), width)
    new = np.ones(len(order), bool)
    for k in range(1, len(order), 1 << 14):
        to = min(k + (1 << 14), len(order))
        new[k:to] = (windows[order[k:to]] != windows[order[k - 1 : to - 1]]).any(1)
    heads = np.flatnonzero(new)
    low = np.zeros(len(text), np.int64)
    low[order] = np.repeat(np.minimum.reduceat(ids[owner[order]], heads), np.diff(np.r_[heads, len(order)]))
    return [low[b : b + n - width + 1] for b, n in zip(begin.tolist(), sizes.tolist(), strict=False)]


_UP = bytes(min(i + 1, 255) for i in range(256))


def _shared_ranges(body: np.ndarray, offsets: np.ndarray, group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each string, the first and last window whose hash its group has twice; (0, -1) if none.

    Other windows equal no window of another string, so what stands outside
    these ranges needs no sorting.
    """
    size = np.diff(offsets) - width + 1
    row = np.repeat(np.arange(len(size)), size)
    at = offsets[:-1][row] + within(size)
    key = Rolling(Rolling.LUT[body]).of(at, at + width) ^ mix(group[row].astype(np.uint64) + np.uint64(1))
    which, _ = pd.factorize(key)
    twice = np.bincount(which)[which] > 1
    pos = within(size)
    heads = np.cumsum(size) - size
    first = np.minimum.reduceat(np.where(twice, pos, 1 << 40), heads)
    last = np.maximum.reduceat(np.where(twice, pos, -1), heads)
    return np.where(last < 0, 0, first), last


def _by_suffix_array(strings: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for table, bounds in runs(batches, ["m"]):
            column = table.column("piece").combine_chunks()
            body, offsets = flat(column if isinstance(column, pa.Array) else column.chunk(0))
            ids = table.column("low_id").to_numpy()
            group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            first, last = _shared_ranges(body, offsets, group, width)
            size = np.diff(offsets) - width + 1
            ends = np.r_[0, np.cumsum(size)]
            lows = np.repeat(ids, size)
            raw = body.tobytes()
            busy = np.flatnonzero(last >= 0)
            for g in np.split(busy, np.flatnonzero(np.diff(group[busy])) + 1) if len(busy) else []:
                # Strings cut to their ranges; equal ones are one, with the smallest id.
                cut: dict[bytes, int] = {}
                parts = [raw[offsets[i] + first[i] : offsets[i] + last[i] + width] for i in g.tolist()]
                for i, p in zip(g.tolist(), parts, strict=True):
                    cut[p] = min(cut.get(p, ids[i]), ids[i])
                pieces = list(cut)
                found = dict(zip(pieces, lowest_ids(pieces, np.array([cut[p] for p in pieces]), width), strict=True))
                for i, p in zip(g.tolist(), parts, strict=True):
                    lows[ends[i] + first[i] : ends[i] + last[i] + 1] = found[p]
            yield pa.RecordBatch.from_arrays(
                [*(table.column(c).combine_chunks() for c in ("m", "h", "n")), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(lows))],
                ["m", "h", "n", "lows"],
            )

    dealt = strings.select("m", "h", "n", "piece", "low_id").repartition("m").sortWithinPartitions("m")
    return arrow_map(dealt, run, "m long, h long, n long, lows array<long>")


def _by_anchors(strings: DataFrame, width: int, anchors: tuple[int, ...], large: int) -> DataFrame:
    """The same, with groups of over ``large`` strings dealt by longer anchors until they fit.

    Equal windows have equal anchors of any length, so they stay together. The
    last anchor is the whole window: a group has one string there.
    """
    big = staged(strings.groupBy("m").count().where(F.col("count") > large).select("m"), "large-groups", strings.count() // large)
    if not anchors or big.isEmpty():
        return _by_suffix_array(strings, width)

    def anchored(batches):
        for whole in batches:
            for batch in rows_by_bytes(whole, "piece", 1 << 18):
                body, offsets = flat(batch.column("piece"))
                a, row, start, size = stretches(body, offsets, width, anchors[0])
                m, h, low = (batch.column(c).to_numpy()[row] for c in ("m", "h", "low_id"))
                a = (mix(m.astype(np.uint64) + np.uint64(1)) ^ a.astype(np.uint64)).view(np.int64)
                parts = _strings(body, offsets[row] + start, size + width - 1)
                yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(h), pa.array(low), pa.array(start), pa.array(a), parts], ["m", "h", "low_id", "k", "a", "part"])

    side = F.broadcast(big) if big.count() <= BROADCAST_MARKS else big
    held = strings.join(side, "m", "left_semi").select("m", "h", "low_id", "piece")
    places = staged(arrow_map(held, anchored, "m long, h long, low_id long, k long, a long, part binary").withColumn("b", F.xxhash64("part")), "anchored")
    finer = places.groupBy(F.col("a").alias("m"), F.col("b").alias("h")).agg(F.first("part").alias("piece"), F.min("low_id").alias("low_id"), F.count(F.lit(1)).alias("n"))
    lows = _by_anchors(staged(finer, "finer"), width, anchors[1:], large)
    lows = staged(lows.withColumnsRenamed({"m": "a", "h": "b"}), "finer-lows")
    told = split_join(places.select("m", "h", "k", "a", "b"), lows, ["a", "b"], "n", places.count())
    # A string has STRETCH windows at most, so its list is short.
    again = told.groupBy("m", "h").agg(F.array_sort(F.collect_list(F.struct("k", "lows"))).alias("at"))
    again = again.select("m", "h", F.flatten(F.transform("at", lambda s: s["lows"])).alias("lows"))
    split = strings.select("m", "h", "n").join(again, ["m", "h"])
    return _by_suffix_array(strings.join(side, "m", "left_anti"), width).unionByName(split)


def _lows_of_large(strings: DataFrame, width: int, mer: int, large: int) -> DataFrame:
    """The same for large groups, whose strings are first cut to their shared stretches over the cluster."""

    def hashed(batches):
        for whole in batches:
            for batch in rows_by_bytes(whole, "piece", 1 << 20):
                body, offsets = flat(batch.column("piece"))
                size = np.diff(offsets) - width + 1
                row, pos = np.repeat(np.arange(len(size)), size), within(size)
                at = offsets[:-1][row] + pos
                w = Rolling(Rolling.LUT[body]).of(at, at + width).astype(np.int64)
                m, h = (batch.column(c).to_numpy()[row] for c in ("m", "h"))
                yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(h), pa.array(w), pa.array(pos.astype(np.int32))], ["m", "h", "w", "k"])

    each = staged(arrow_map(strings.select("m", "h", "piece"), hashed, "m long, h long, w long, k int"), "window-hashes")
    twice = staged(each.groupBy("m", "w").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-windows")
    shared = split_join(each, twice, ["m", "w"], "n", each.count())
    ranges = shared.groupBy("m", "h").agg(F.min("k").alias("first"), F.max("k").alias("last"))
    cut = strings.join(ranges, ["m", "h"], "left").withColumn("all", F.length("piece") - (width - 1))
    # A string without a shared window keeps its own id throughout.
    part = F.expr(f"case when first is not null then substring(piece, first + 1, last - first + {width}) end")
    cut = staged(cut.select("m", "h", F.col("n").alias("rows"), "low_id", "all", "first", "last", part.alias("part")).withColumn("g", F.xxhash64("part")), "cut-strings")
    parts = cut.where("part is not null").groupBy("m", F.col("g").alias("h")).agg(F.first("part").alias("piece"), F.min("low_id").alias("low_id"), F.count(F.lit(1)).alias("n"))
    parts = staged(parts, "parts")
    lows = staged(_by_anchors(parts, width, ((mer + width) // 2, width), large).withColumnRenamed("h", "g"), "part-lows")
    told = split_join(cut, lows, ["m", "g"], "n", cut.count(), "left")
    own = lambda n: F.array_repeat("low_id", n.cast("int"))
    whole = F.when(F.col("lows").isNull(), own(F.col("all"))).otherwise(F.concat(own(F.col("first")), "lows", own(F.col("all") - F.col("last") - 1)))
    return told.select("m", "h", F.col("rows").alias("n"), whole.alias("lows"))


def _intervals(joined: DataFrame, width: int) -> DataFrame:
    """(id, f, a, b): removed byte intervals, one or more per occurrence."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lows = batch.column("lows")
            values, size = lows.flatten().to_numpy(), lows.value_lengths().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), size)
            ids = batch.column("id").to_numpy()
            gone = values < ids[row]
            pos = batch.column("start").to_numpy()[row] + within(size)
            new = gone.copy()
            new[1:] &= ~gone[:-1] | (row[1:] != row[:-1])
            end = gone.copy()
            end[:-1] &= ~gone[1:] | (row[1:] != row[:-1])
            a, b = np.flatnonzero(new), np.flatnonzero(end)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row[a]]), batch.column("f").take(pa.array(row[a])), pa.array(pos[a]), pa.array(pos[b] + width)], ["id", "f", "a", "b"])

    return arrow_map(joined.select("id", "f", "start", "lows"), run, "id long, f long, a long, b long")


def _cut(body: bytes, marks: list[tuple[int, int]]) -> tuple[int, int, list[bytes]]:
    """(bytes removed, maximal runs removed, what stays)."""
    removed = spans = 0
    keep, at = [], 0
    run_end = -1
    for a, b in sorted(marks):
        if a > run_end:
            spans += 1
            keep.append(body[at:a])
            removed += b - a
        elif b > run_end:
            removed += b - run_end
        run_end = max(run_end, b)
        at = max(at, b)
    keep.append(body[at:])
    return removed, spans, keep


REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def marked(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, mer: int = MER, large: int = LARGE, most: int = BROADCAST_ROWS) -> DataFrame:
    """id, text and the intervals to remove (``marks``, and ``whole`` for later copies) of each row."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    bytes_ = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    # Two hashes of a text stand for it: f wherever a row is matched by its id too.
    docs = docs.withColumns({"f": F.xxhash64(bytes_), "g": F.xxhash64(F.lit(1), bytes_)})
    rows = df.count()
    narrow = staged(docs.select("id", "f", "g"), "digests", rows)
    groups = narrow.groupBy("f", "g").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = split_join(narrow, staged(groups, "equal-texts", rows), ["f", "g"], "n", rows)
    copies = staged(copies.where("id > first").select(F.col("id").alias("cid"), F.col("f").alias("cf")).distinct(), "copies", rows)
    few = copies.count() <= BROADCAST_MARKS
    on = (F.col("id") == F.col("cid")) & (F.col("f") == F.col("cf"))
    hint = F.broadcast(copies) if few else copies
    firsts = docs.where("id is not null").select("id", "f", "text").join(hint, on, "left_anti")
    shared = staged(_minimizers(firsts, width, mer).groupBy("m").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("m"), "shared")
    places = staged(_shared_occurrences(firsts, shared, width, mer, most), "occurrences")
    strings = places.groupBy("m", "h").agg(F.min("id").alias("low_id"), F.first("piece").alias("piece"), F.count(F.lit(1)).alias("n"))
    strings = staged(strings, "strings")
    places = places.drop("piece")
    big = staged(strings.groupBy("m").count().where(F.col("count") > large).select("m"), "large-groups", strings.count() // large)
    few_big = big.count() <= BROADCAST_MARKS
    side = F.broadcast(big) if few_big else big
    if big.isEmpty():
        lows = _by_suffix_array(strings, width)
    else:
        lows = _by_suffix_array(strings.join(side, "m", "left_anti"), width).unionByName(_lows_of_large(strings.join(side, "m", "left_semi"), width, mer, large))
    lows = staged(lows, "lows")
    found = _intervals(split_join(places, lows, ["m", "h"], "n", places.count()), width)
    marks = staged(found.groupBy(F.col("id").alias("mid"), F.col("f").alias("mf")).agg(F.collect_list(F.struct("a", "b")).alias("marks")), "marks", rows)
    drop_staged(spark, narrow, shared, places, strings, lows)
    small = marks.count() <= BROADCAST_MARKS
    out = docs.select("id", "f", "text").join(hint, on, "left").withColumn("whole", F.col("cid").isNotNull())
    side = F.broadcast(marks) if small else marks
    return out.join(side, (F.col("id") == F.col("mid")) & (F.col("f") == F.col("mf")), "left").select("id", "text", "whole", "marks")


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, **more) -> DataFrame:
    """n_bytes, n_removed, n_spans and the digest of what stays, for each row of ``df``.

    Null and empty texts have no bytes. Texts shorter than ``width`` lose
    nothing. Rows that repeat an id are documents that share it: neither is
    smaller than the other. A row without an id loses nothing and takes nothing
    from others. Other columns are ignored.
    """

    def run(batches):
        for whole in batches:
            for batch in rows_by_bytes(whole, "text"):
                body, offsets = flat(batch.column("text"))
                raw, ids = body.tobytes(), batch.column("id").to_pylist()
                copy, marks = batch.column("whole").to_pylist(), batch.column("marks").to_pylist()
                rows = []
                for i in range(batch.num_rows):
                    text = raw[offsets[i] : offsets[i + 1]]
                    spans = [(0, len(text))] if copy[i] and len(text) >= width else [] if copy[i] else [(m["a"], m["b"]) for m in marks[i] or []]
                    removed, n, keep = _cut(text, spans)
                    rows.append((ids[i], len(text), removed, n, hashlib.sha256(b"".join(keep)).hexdigest()))
                kinds = [pa.int64()] * 4 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in REPORT.split(", ")])

    return arrow_map(marked(df, id_col, text_col, width, **more), run, REPORT)


def op9_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: All windows in hexadecimal, each with the smallest id that has it; runs of covered bytes by gaps between window starts.
ORACLE = """
WITH h AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (SELECT doc_id, k, substr(h, 2 * k + 1, 100) AS w FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS k FROM h WHERE length(h) >= 100)),
f AS (SELECT w, min(doc_id) AS low FROM w GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
g AS (SELECT doc_id, k FROM w JOIN f USING (w) WHERE low < doc_id),
n AS (SELECT doc_id, k, coalesce(k > lag(k) OVER o + 50, true) AS new FROM g WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
r AS (SELECT doc_id, min(k) AS a, max(k) + 50 AS b FROM (SELECT doc_id, k, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM n) GROUP BY doc_id, run),
c AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS kept_from FROM r),
t AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * kept_from + 1, 2 * (a - kept_from)), '' ORDER BY a) || any_value(substr(h, 2 * last + 1)) AS kept
  FROM c JOIN h USING (doc_id) JOIN (SELECT doc_id, max(b) AS last FROM r GROUP BY 1) USING (doc_id) GROUP BY 1)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM h LEFT JOIN t USING (doc_id)
"""
