"""Sources: sequence tables in several formats, and sequences derived from text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from helixframe.functions.sequence import BASES

LENGTH = 200
LETTERS, AS_BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"

PROMOTER_SCHEMA = "sequence string, JURKAT double, K562 double, THP1 double, is_train boolean, is_val boolean, is_test boolean"
ENHANCER_SCHEMA = "sequence string, HepG2_log2FC double, K562_log2FC double, SKNSH_log2FC double"


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Raises before any job if a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df


def read_table(spark: SparkSession, path: str, schema: str | StructType | None = None, columns: list[str] | None = None) -> DataFrame:
    """By suffix: .csv, .tsv, .json, .h5 (datasets are columns), .parquet, or a Parquet folder; columns beyond the asked ones stay unread."""
    if path.rstrip("/").lower().endswith((".h5", ".hdf5")):
        from helixframe.sources.hdf5 import read_hdf5

        return require_columns(read_hdf5(spark, path, columns), columns or [])
    reader = spark.read.schema(schema) if schema else spark.read
    name = path.rstrip("/").lower()
    if name.endswith((".csv", ".tsv", ".txt")):
        df = reader.option("inferSchema", schema is None).csv(path, header=True, sep="," if name.endswith(".csv") else "\t")
    elif name.endswith(".json"):
        df = reader.json(path, multiLine=True)
    else:
        df = reader.parquet(path)
    return require_columns(df, columns).select(*columns) if columns else df


def read_positional_tsv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A TSV without a header; as many of ``names`` as the file has columns."""
    df = spark.read.csv(path, sep="\t", inferSchema=True)
    return df.toDF(*names[: len(df.columns)])


def rows_between(df: DataFrame, index: str, text: str) -> DataFrame:
    """The slice ``a:b`` by an explicit index column; either bound may be missing."""
    low, _, high = text.partition(":")
    out = df
    if low:
        out = out.where(F.col(index) >= int(low))
    return out.where(F.col(index) < int(high)) if high else out


def read_ranges(spark: SparkSession, path: str, cells: list[str]) -> DataFrame:
    """(cell, min, max, mean) from a JSON object by cell; every cell must be there."""
    df = spark.read.json(path, multiLine=True)
    missing = [c for c in cells if c not in df.columns]
    if missing:
        raise ValueError(f"no ranges for {missing}")
    each = [F.struct(F.lit(c).alias("cell"), F.col(f"{c}.min").alias("min"), F.col(f"{c}.max").alias("max"), F.col(f"{c}.mean").alias("mean")) for c in cells]
    return df.select(F.explode(F.array(*each)).alias("r")).select("r.*")


def dense_profile(counts: DataFrame, k: int = 3) -> DataFrame:
    """A k-mer table with all 4^k rows; missing ones count 0."""
    from helixframe.operators.profiles import dimension

    return dimension(counts.sparkSession, k).join(counts, "kmer", "left").na.fill(0)


def seed_pool(kind: str, natural: DataFrame | None = None, score: str | None = None, n: int = 1000, length: int = LENGTH, low: float = 0.45, high: float = 0.55, seed: int = 0, spark: SparkSession | None = None) -> DataFrame:
    """A pool of n seeds: ``random`` sequences, or of the ``natural`` ones (pid, seq) with GC in the band a draw by hash, or the ``best`` by score."""
    from helixframe.functions import rng
    from helixframe.functions.sequence import gc
    from helixframe.operators import resample

    if kind == "random":
        return resample.uniform_source(spark or natural.sparkSession, n, length, seed, "pool").select(F.col("slot").alias("pid"), "seq")
    rows = natural.where(gc("seq").between(low, high))
    order = [F.desc(score), F.asc("pid")] if kind == "best" else [rng.order_key(seed, "pid"), F.col("pid")]
    return rows.orderBy(*order).limit(n)


#: Tables of at most so many bytes are dealt over all cores.
SMALL_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table over all cores, as one task reads a file of one row group; a large one as it comes, without a shuffle."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL_BYTES else df


def from_documents(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Sequences of whole texts: letters become bases in turn, and every full tile of ``length`` is a row.

    pid = doc_id * 1000000 + tile.
    """
    letters = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]+", ""), LETTERS, AS_BASES)
    # All tiles in one pass over a text; cut out one by one, each would walk the text from its start.
    tiles = F.regexp_extract_all(letters, F.lit(f"[{BASES}]{{{length}}}"), F.lit(0))
    rows = spread(docs.select("doc_id", "lang", "source", "text")).select("doc_id", "lang", "source", F.posexplode(tiles).alias("_t", "seq"))
    return rows.select((F.col("doc_id") * 1000000 + F.col("_t")).alias("pid"), "doc_id", F.col("_t").cast("long").alias("tile"), "lang", "source", "seq")
