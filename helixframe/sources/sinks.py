"""Sinks: run folders of Parquet tables, CSV and JSON exports, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_population(df: DataFrame, run: str, name: str, **meta) -> None:
    """``run/name`` with the table, and one row of metadata beside it."""
    df.write.mode("overwrite").parquet(f"{run}/{name}")
    df.sparkSession.createDataFrame([(name, json.dumps(meta, sort_keys=True, default=str))], "name string, meta string").write.mode("overwrite").parquet(f"{run}/{name}_meta")


def write_best(final: DataFrame, best: DataFrame, run: str, score: str, gain: float = 0.01) -> bool:
    """The best-seen population only if its mean beats the final one's by more than ``gain``."""
    mean = lambda d: d.agg(F.avg(score)).first()[0]
    a, b = mean(final), mean(best)
    if a is None or b is None or b <= a + gain:
        return False
    write_population(best, run, "best", mean=b)
    return True


def write_archives(archives: dict[str, DataFrame], run: str) -> None:
    """All archives in one table by ``archive``; columns that one lacks are null."""
    out = None
    for name, df in archives.items():
        part = df.withColumn("archive", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is not None:
        out.write.mode("overwrite").partitionBy("archive").parquet(f"{run}/archives")


def write_threshold_archive(df: DataFrame, path: str, least: float, seq: str = "seq", score: str = "score", step: str = "step") -> None:
    """Rows above ``least``, each sequence once with its largest score and the first step that reached it, best first."""
    above = df.where(F.col(score) > least)
    best = above.groupBy(seq).agg(F.max(score).alias(score), F.min_by(step, F.struct((-F.col(score)).alias("s"), step)).alias(step))
    best.orderBy(F.desc(score), seq).write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, by: str | None = None) -> None:
    """CSV with a header, a folder for each value of ``by``."""
    writer = df.write.mode("overwrite").option("header", True)
    (writer.partitionBy(by) if by else writer).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_history(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def resume_step(spark, path: str) -> int:
    """The step after the last complete one in a history table; 0 without one."""
    try:
        last = spark.read.parquet(path).agg(F.max("step")).first()[0]
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return 0
    return 0 if last is None else last + 1


def with_columns_from(df: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """``df`` with the columns of ``more`` added or replaced by key; for a new version of a table."""
    news = [c for c in more.columns if c != key]
    return df.drop(*news).join(more, key, "left")


def write_history(df: DataFrame, path: str, step: str = "step") -> None:
    """A history as lines of JSON in the order of its steps: one row a step, so one file is enough."""
    df.coalesce(1).sortWithinPartitions(step).write.mode("overwrite").json(path)


def cached(spark, path: str, make) -> DataFrame:
    """Read a small table of statistics; make and write it the first time."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    make().write.parquet(path)
    return spark.read.parquet(path)


def markdown(df: DataFrame, digits: int = 3) -> str:
    """A small table as Markdown; a missing value is a dash."""
    show = lambda v: "—" if v is None or v != v else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in df.collect()])
