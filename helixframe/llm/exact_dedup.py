"""Exact dedup by a heavy-hitter split, in DataFrame functions only.

1. Every row gets the SHA-256 of its normalised text. Only (id, digest) pairs
   are kept; texts never shuffle.
2. A Misra-Gries summary of the digests (``approx_top_k``, the frequent-items
   sketch: counters that are decremented together when they run out, merged
   across tasks) names every digest that holds more than a small share of the
   rows. Its size is fixed, whatever the input.
3. The named digests are counted exactly. Those with over 1/track of the rows
   are the winners: fewer than ``track`` of them, broadcast, so that their rows
   are settled on the map side and never meet in one task.
4. All other digests have a bounded share of the rows and take one ordinary
   aggregation and join by digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.shared import GONE_ROWS, keep_rows, staged

#: Digests with over 1 / TRACK of the rows are broadcast; the Misra-Gries summary has four counters for each.
TRACK = 4096


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def text_digest(text: Column) -> Column:
    """The SHA-256 of the normalised text, as 32 bytes."""
    return F.unhex(F.sha2(F.encode(normalised(text), "UTF-8"), 256))


def digest_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, digest): ``xxhash64`` of the text, and the SHA-256 of the normalised text, as 32 bytes."""
    return df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), text_digest(F.col(text_col)).alias("digest"))


def heavy_digests(digests: DataFrame, track: int = TRACK) -> DataFrame:
    """(digest, keep, size) of digests that hold over 1/track of the rows; exact figures.

    The sketch has four counters for each digest that there can be, so none is missed.
    """
    total = digests.count()
    short = F.xxhash64("digest")
    top = F.expr(f"approx_top_k(short, {2 * track}, {4 * track})")
    sketch = digests.select(short.alias("short")).agg(top.alias("top"))
    named = sketch.select(F.explode("top").alias("t")).select("t.item", "t.count").where("count > 1")
    return (
        digests.join(F.broadcast(named.select(F.col("item").alias("short"))), short == F.col("short"), "left_semi")
        .groupBy("digest")
        .agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("size"))
        .where(F.col("size") > max(1, total / track))
    )


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", track: int = TRACK) -> DataFrame:
    """One row per row of ``df``: id, digest, keep, size.

    Texts are equal when they are identical after each run of ASCII white space
    is replaced by one space; null counts as empty, so all nulls and empty
    texts form one group. ``keep`` is the smallest id of the group. A row
    without an id never keeps others; a group without any id has a null
    ``keep``. Rows that repeat an id are all listed. Extra columns are ignored.
    """
    return _grouped(df, id_col, text_col, track).select("id", "digest", "keep", "size")


def _grouped(df: DataFrame, id_col: str, text_col: str, track: int) -> DataFrame:
    digests = staged(digest_table(df, id_col, text_col), "digests")
    heavy = staged(heavy_digests(digests, track), "heavy", track)
    small = F.broadcast(heavy.select(F.col("digest").alias("hd"), "keep", "size"))
    split = digests.join(small, F.col("digest") == F.col("hd"), "left")
    settled = split.where("hd is not null").drop("hd")
    rest = split.where("hd is null").select("id", "mark", "digest")
    groups = rest.groupBy("digest").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("size"))
    return settled.unionByName(rest.join(groups, "digest").select(*settled.columns))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", track: int = TRACK) -> DataFrame:
    """``df`` with one row of each text: that of the smallest id; all columns stay, whatever their names.

    Of rows that share id and normalised text, the one with the smallest hash of
    the whole text stays. A text that shares its id with a dropped one stays if
    it is no copy itself; rows without an id stay. Texts don't shuffle while the
    rows that go are few (``GONE_ROWS``).
    """
    rows = staged(_grouped(df, id_col, text_col, track), "copies", df.count())
    first = rows.where("id = keep and size > 1").groupBy("digest").agg(F.min("mark").alias("low"), F.count(F.lit(1)).alias("n"))
    # Only texts whose smallest id has several rows are in question; usually there are none.
    first = first.where("n > 1").drop("n")
    mark, few = F.col("id") == F.col("keep"), first.count()
    if few:
        rows = rows.join(F.broadcast(first) if few <= GONE_ROWS else first, "digest", "left")
        mark = mark & (F.col("low").isNull() | (F.col("mark") == F.col("low")))
    return keep_rows(df, rows.select("id", "mark", mark.alias("stays")), id_col, text_col)


def report(df: DataFrame) -> DataFrame:
    """The contract's columns for every document, dropped ones too."""
    return exact_groups(df).select(
        F.col("id").alias("doc_id"),
        F.col("keep").alias("keep_id"),
        F.col("size").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM n GROUP BY 1
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, n.text_sha256
FROM n JOIN g USING (text_sha256)
"""
