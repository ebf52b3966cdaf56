"""Exact near neighbours by Hamming distance, without comparing all pairs.

Two sequences that differ in fewer than t places agree on one of t segments.
Rows meet in groups by a segment; a group that is too large for a task is cut
further, as those of its rows that are near also agree on one of t segments of
what is left, and so on. Where fewer than t places are left, all rows of a
group are near. So a group that is compared in a task is small, however many
rows share a segment.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import sequence as S
from helixframe.functions.lineage import cut

#: Rows of a group that are compared with each other in one task.
GROUP_ROWS = 256
PRIME = 0xC2B2AE3D27D4EB4F
_MIX = np.random.default_rng(11).integers(1, 1 << 63, 256, np.int64).astype(np.uint64)


def _chunks(places: np.ndarray, many: int) -> list[np.ndarray]:
    return [c for c in np.array_split(places, many) if len(c)]


@lru_cache(4096)
def _left(length: int, path: tuple[int, ...], many: int) -> np.ndarray:
    """The places that no segment of ``path`` covers."""
    places = np.arange(length)
    for j in path:
        chunks = _chunks(places, many)
        places = np.concatenate([np.zeros(0, np.int64), *(c for k, c in enumerate(chunks) if k != j)])
    return places


def _segments(rows: DataFrame, threshold: int) -> DataFrame:
    """(g, id, seq, path, rest) for each of ``threshold`` segments of what a row's path leaves; g tells path and segment, rest how many places are left."""

    def run(batches):
        for batch in batches:
            body, offsets = S._joined(batch.column("seq"))
            size = np.diff(offsets)
            paths, old = batch.column("path").to_pylist(), batch.column("g").to_numpy().view(np.uint64)
            kinds: dict[tuple, list[int]] = {}
            for i, p in enumerate(paths):
                kinds.setdefault((int(size[i]), tuple(p)), []).append(i)
            for (length, path), mine in kinds.items():
                at = np.array(mine)
                chars = body[offsets[at][:, None] + np.arange(length)]
                left = _left(length, path, threshold)
                # With fewer places than the threshold left, any two rows are near: one group.
                for j, places in enumerate(_chunks(left, threshold) if len(left) >= threshold else [left[:0]]):
                    key = old[at] * np.uint64(0x9E3779B97F4A7C15) + np.uint64((j + 1 + length * PRIME) % (1 << 64))
                    for c in places.tolist():
                        key = (key ^ _MIX[chars[:, c]]) * np.uint64(0xBF58476D1CE4E5B9)
                        key ^= key >> np.uint64(29)
                    picked, rest = batch.take(pa.array(at)), len(left) - len(places)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), picked.column("id"), picked.column("seq"), pa.array([[*path, j]] * len(at), pa.list_(pa.int32())), pa.array(np.full(len(at), rest, np.int32))], ["g", "id", "seq", "path", "rest"])

    return rows.select("g", "id", "seq", "path").mapInArrow(run, "g long, id long, seq string, path array<int>, rest int")


def _least(seqs: list[str]) -> np.ndarray:
    """Each sequence's distance to the nearest other one."""
    chars = np.array([np.frombuffer(s.encode(), np.uint8) for s in seqs])
    away = (chars[:, None, :] != chars[None, :, :]).sum(2)
    np.fill_diagonal(away, chars.shape[1] + 1)
    return away.min(1)


def _compared(rows: DataFrame, threshold: int) -> DataFrame:
    """Ids of rows that have a near one in their group; groups are small and compared pair by pair."""

    def pairs(batches):
        held: pa.Table | None = None

        def told(table: pa.Table):
            g = table.column("g").to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(g)) + 1, len(g)]
            ids, seqs, near = table.column("id").to_numpy(), table.column("seq").to_pylist(), []
            for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                near.append(_least(seqs[a:b]) < threshold if b - a > 1 else np.zeros(b - a, bool))
            return pa.RecordBatch.from_arrays([pa.array(ids[np.concatenate(near)])], ["id"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
            g = table.column("g").to_numpy()
            last = int(np.searchsorted(g, g[-1]))
            if last:
                yield told(table.slice(0, last))
            held = table.slice(last)
        if held is not None:
            yield told(held)

    return rows.select("g", "id", "seq").repartition("g").sortWithinPartitions("g").mapInArrow(pairs, "id long")


def near_mask(df: DataFrame, threshold: int, key: str = "pid", seq: str = "seq", group_rows: int = GROUP_ROWS) -> DataFrame:
    """(key, near): whether another row's sequence differs in fewer than ``threshold`` places.

    Exact, over all rows. Only sequences of one length are compared; a row whose
    sequence is null is near to nothing, and repeated sequences are near if the
    threshold is over 0. Each further cut of a large group makes ``threshold``
    rows of each of its rows, and leaves a smaller part of the sequence to agree on.
    """
    rows = df.select(F.col(key).alias("pid"), F.col(seq).alias("seq"))
    if threshold <= 0:
        return rows.select(F.col("pid").alias(key), F.lit(False).alias("near"))
    texts = rows.where("seq is not null").groupBy("seq").agg(F.count(F.lit(1)).alias("n"))
    texts = cut(texts.withColumns({"id": F.monotonically_increasing_id(), "g": F.lit(0).cast("long"), "path": F.array().cast("array<int>")}))
    found = [texts.where("n > 1").select("id")]
    now = texts.where(F.length("seq") > 0)
    while True:
        parts = cut(_segments(now, threshold))
        sizes = parts.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        parts = cut(parts.join(sizes.withColumnRenamed("g", "_g"), F.col("g") == F.col("_g")).drop("_g"))
        large = parts.where(F.col("n") > group_rows)
        found.append(cut(_compared(parts.where(F.col("n") <= group_rows), threshold).distinct()))
        if large.isEmpty():
            break
        whole, now = large.where(F.col("rest") < threshold), cut(large.where(F.col("rest") >= threshold))
        first = whole.groupBy("g").agg(F.min_by(F.struct("id", "seq"), "id").alias("f"))
        met = whole.join(first.withColumnRenamed("g", "_g"), F.col("g") == F.col("_g")).where((F.col("id") != F.col("f.id")) & (S.hamming("seq", F.col("f.seq")) < threshold))
        met = cut(met.select("id", F.col("f.id").alias("first")))
        found += [met.select("id"), met.select(F.col("first").alias("id"))]
        if now.isEmpty():
            break
    near = reduce(DataFrame.unionByName, found).distinct().withColumn("near", F.lit(True))
    told = texts.join(near, "id", "left").select(F.col("seq").alias("_seq"), F.coalesce("near", F.lit(False)).alias("near"))
    return rows.join(told, F.col("seq") == F.col("_seq"), "left").select(F.col("pid").alias(key), F.coalesce("near", F.lit(False)).alias("near"))
