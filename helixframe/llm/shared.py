"""What the operators of this subpackage share: intermediate tables and text vectors."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of an Arrow batch.
BATCH_BYTES = 8 << 20
PRIME = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset and
    the master is local (tests) a temporary folder is made and set.
    """
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if got:
        return got.rstrip("/")
    # Else the folder that setCheckpointDir named, on a cluster too.
    made = spark.sparkContext.getCheckpointDir()
    if not made:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="helixframe-"))
        made = spark.sparkContext.getCheckpointDir()
    return made.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/helixframe/{what}-{uuid.uuid4().hex}"


#: Rows to a file of a staged table whose size is known beforehand.
FILE_ROWS = 250_000


def staged(df: DataFrame, what: str, rows: int | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    It cuts the lineage and survives the loss of any executor. ``rows``: about
    how many there are at most, so that a small table isn't written as a file a task.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.repartition(1 + rows // FILE_ROWS)
    path = new_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key with over 1 / TRACK of the rows is heavy, so there are fewer than TRACK heavy keys.
TRACK = 2048


def split_join(rows: DataFrame, table: DataFrame, keys: list[str], size: str, total: int, how: str = "inner", track: int = TRACK) -> DataFrame:
    """``rows`` joined to ``table``, which has one row a key and the key's number of rows in ``size``.

    The rows of a key with over 1/track of ``total`` are dealt over as many
    parts as it takes to have at most so many in each, and the key's row in
    ``table`` is copied to each part. The list of such keys, fewer than
    ``track`` whatever the input, is broadcast, and all copies together are
    fewer than twice as many. ``how``: inner or left; nulls in keys match
    nothing and are spread too.
    """
    many = F.when(F.col(size) > max(total / track, 1), F.ceil(F.col(size) * track / max(total, 1)).cast("int"))
    names = [c for c in table.columns if c not in keys and c != size]
    heavy = F.broadcast(table.select(*(F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)), many.alias("_many")).where("_many is not null"))
    null, same, mine = F.lit(False), F.lit(True), F.lit(True)
    for i, k in enumerate(keys):
        null, same = null | F.col(k).isNull(), same & (F.col(k) == F.col(f"_h{i}"))
        mine = mine & (F.col(k) == F.col(f"_t{i}"))
    part = F.when(null, F.lit(track)).otherwise(F.coalesce("_many", F.lit(1)))
    dealt = rows.join(heavy, same, "left").withColumn("_part", F.pmod(F.xxhash64(*rows.columns), part)).drop("_many", *(f"_h{i}" for i in range(len(keys))))
    copies = table.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(many, F.lit(1)).cast("long") - 1)))
    copies = copies.select(*(F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)), "_copy", *names)
    return dealt.join(copies, mine & (F.col("_part") == F.col("_copy")), how).select(*rows.columns, *names)


def drop_staged(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files of staged tables that no later job reads, and let go of finished jobs' shuffle files."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    seen = set()
    for df in frames:
        for name in df.inputFiles():
            folder = name.rsplit("/", 1)[0]
            if folder not in seen and "/helixframe/" in folder:
                seen.add(folder)
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)
    release(spark)


def release(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of plans that nothing refers to once the driver collects garbage; do so now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows that go are broadcast up to so many, else they meet the table by shuffle.
GONE_ROWS = 1_000_000


def keep_rows(df: DataFrame, told: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``df`` that ``told`` (id, mark, stays) lets stay, where mark is ``xxhash64`` of the text.

    Rows are told apart by id and text. Of rows that agree in both and stay, one
    is kept; rows without an id all stay.
    """
    told = staged(told.where("id is not null"), "decisions", df.count())
    gone, mark, text_mark = fresh(df, "gone_id"), fresh(df, "gone_mark"), F.xxhash64(df[text_col])
    lost = told.where("not stays").select(F.col("id").alias(gone), F.col("mark").alias(mark)).distinct()
    hint = F.broadcast if lost.count() <= GONE_ROWS else lambda side: side
    same = (df[id_col].cast("long") == F.col(gone)) & (text_mark == F.col(mark))
    kept = df.join(hint(lost), same, "left_anti")
    again = told.where("stays").groupBy(F.col("id").alias(gone), F.col("mark").alias(mark)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    few = again.count()
    if not few:
        return kept
    hint = F.broadcast if few <= GONE_ROWS else lambda side: side
    same = (kept[id_col].cast("long") == F.col(gone)) & (F.xxhash64(kept[text_col]) == F.col(mark))
    once = kept.join(hint(again), same, "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(hint(again), same, "left_anti").unionByName(once)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    while stem.lower() in have:
        stem = "_" + stem
    return stem


def arrow_map(df: DataFrame, fn: Callable, schema, most: int = BATCH_BYTES) -> DataFrame:
    """``mapInArrow`` for a ``fn(batches) -> batches``.

    From here on the session hands Python workers batches of ``most`` bytes, as
    a worker and its executor hold a few copies of one each.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))
    return df.mapInArrow(fn, schema)


def rows_by_bytes(batch: pa.RecordBatch, column: str, most: int = 1 << 20, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``most`` bytes of ``column`` and ``rows`` rows at most; a row is never cut."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, min(at + rows, int(np.searchsorted(ends, base + most, "right"))))
        yield batch.slice(at, to - at)
        at = to


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column end to end, and each row's bounds; null is empty."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string()).cast(pa.large_binary())
    else:
        column = column.cast(pa.large_binary())
    column = column.fill_null(b"") if column.null_count else column
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    body = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, o - o[0]


SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True


def tokens(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the white-space tokens of all rows; tokens never cross rows."""
    solid = ~SPACES[body]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(body))]
    left = solid.copy()
    left[1:] &= ~solid[:-1]
    left[cuts] = solid[cuts]
    right = np.zeros(len(body) + 1, bool)
    right[1:] = solid
    right[:-1] &= ~solid
    right[cuts] |= solid[cuts - 1]
    start = np.flatnonzero(left)
    return start, np.flatnonzero(right), np.searchsorted(offsets, start, "right") - 1


class Rolling:
    """64-bit hashes of arbitrary substrings from one prefix sum.

    Each byte gets a random odd 64-bit value; a substring's hash is its
    polynomial, made independent of where it starts, then mixed.
    """

    _pow = np.ones(1, U64)
    _inv = np.ones(1, U64)
    LUT = np.random.default_rng(7).integers(1 << 62, size=256, dtype=np.int64).astype(U64) * U64(2) + U64(1)

    @classmethod
    def _powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls._pow) < n:
            size = max(n, 1 << 16)
            for name, base in (("_pow", PRIME), ("_inv", pow(PRIME, -1, 1 << 64))):
                p = np.full(size, base, U64)
                p[0] = 1
                setattr(cls, name, np.multiply.accumulate(p))
        return cls._pow, cls._inv

    def __init__(self, values: np.ndarray):
        """values: uint64, one per position."""
        n = len(values)
        pw, self.inv = self._powers(n + 1)
        self.sum = np.zeros(n + 1, U64)
        np.cumsum(values * pw[:n], out=self.sum[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sum[end] - self.sum[start]) * self.inv[start])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    h = h ^ (h >> U64(31))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(29)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(32)
    return h


def segments(offsets: np.ndarray) -> np.ndarray:
    """The row number of each position."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the bounds of each, from batches sorted by the integer columns ``keys``.

    A group that reaches the end of a batch waits for the next one.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and _same(held[-1], batch, keys):
            held.append(batch)
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        bounds = _bounds(table, keys)
        last = int(bounds[-2])
        if last:
            yield table.slice(0, last), bounds[:-1]
        held = table.slice(last).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, _bounds(table, keys)


def _same(a: pa.RecordBatch, b: pa.RecordBatch, keys: list[str]) -> bool:
    """Whether all of ``b`` is the group that ``a`` ends with."""
    n = b.num_rows - 1
    return all(a.column(k)[a.num_rows - 1] == b.column(k)[n] for k in keys)


def _bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        x = table.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.r_[np.flatnonzero(new), table.num_rows]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 joined by pairs, the smallest node that each reaches."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new
