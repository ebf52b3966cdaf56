"""How quality filters act on each other: every order of five filters replayed on every document.

1. Each text gets a bit for each filter that it fails. Whether it is the later
   copy of another text is told by the SHA-256 of the whole text: copies are
   counted with map-side combining, digests that very many rows share are dealt
   over parts, and texts never shuffle.
2. The rows that are left (part, bits, labels) are crossed with the 120 orders,
   a fixed table that is broadcast. The first failing step of a row in an order
   follows from its bits; the five steps are exploded and summed with map-side
   combining, so 600 rows a document never leave the task that makes them.
3. A filter's share over all orders is a window over the 600 sums of a part.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.shared import drop_staged, split_join, staged, table

#: In the order of their bits: short, repetitive, loud, symbols, copy.
FILTERS = "ABCDE"
#: Rows to a task of the replay, which makes 600 of each.
TASK_ROWS = 10_000


def own_bits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, bits of the filters A to D, SHA-256 of the text) of each row; null texts and parts are empty."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.withColumn("words", F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    n = F.size("words").cast("long")
    fails = (
        n < 100,
        100 * F.size(F.array_distinct("words")) < 80 * n,
        100 * F.length(F.regexp_replace("t", "[^A-Z]+", "")).cast("long") > 10 * F.length("t").cast("long"),
        F.col("t").rlike(r"[#$%&*|]"),
    )
    bits = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return rows.select("id", "part", bits.alias("bits"), F.unhex(F.sha2(F.encode("t", "UTF-8"), 256)).alias("digest"))


def failures(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, bits, good, toxic) of each row of ``df``.

    A row is a copy if a row with a smaller id has the identical text; rows that
    share an id aren't copies of each other, and rows without an id neither are
    copies nor make others copies. A document is good or toxic if any row of
    ``labels`` (doc_id, quality, toxic) with its id says so. Other columns are
    ignored; an empty table gives no rows.
    """
    spark = df.sparkSession
    rows = staged(own_bits(df, id_col, text_col, part_col), "own-bits")
    total = rows.count()
    texts = rows.groupBy("digest").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    told = split_join(rows, staged(texts, "texts", total), ["digest"], "n", total, "left")
    told = told.withColumn("bits", F.col("bits") + F.when(F.col("id") > F.col("low"), 1 << FILTERS.index("E")).otherwise(0)).drop("digest", "low")
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.expr("quality = 1")).alias("good"), F.max(F.expr("toxic = 1")).alias("toxic"))
    marks = rows.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).join(marks.where("good or toxic"), "id")
    out = staged(split_join(told, staged(marks, "marks"), ["id"], "n", total, "left").na.fill(False, ["good", "toxic"]), "failures")
    drop_staged(spark, rows)
    return out


def orders(spark) -> DataFrame:
    """The 120 orders of the filters: name and the bit of each step."""
    names = ["".join(p) for p in permutations(FILTERS)]
    return spark.createDataFrame([(n, [1 << FILTERS.index(c) for c in n]) for n in names], "filter_order string, steps array<int>")


def replay(flags: DataFrame, rows: int | None = None) -> DataFrame:
    """For each part, order and step, what its filter does; see ``op12_filter_audit`` for the columns.

    ``flags``: part, bits, good, toxic, as ``failures`` gives them. A part is
    there if it has a row, with all its 600 rows, zeros included.
    """
    rows = flags.count() if rows is None else rows
    dealt = flags.select("part", "bits", "good", "toxic").repartition(1 + rows // TASK_ROWS)
    every = dealt.crossJoin(F.broadcast(orders(flags.sparkSession)))
    first = F.lit(len(FILTERS) + 1)
    for k in reversed(range(len(FILTERS))):
        first = F.when(F.col("bits").bitwiseAND(F.col("steps")[k]) != 0, k + 1).otherwise(first)
    every = every.withColumn("first", first)
    each = every.select("part", "filter_order", "bits", "first", "good", "toxic", F.posexplode("steps").alias("at", "bit")).withColumn("step", F.col("at") + 1)
    fails, removed = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("first") == F.col("step")
    count = lambda c: F.sum(c.cast("long"))
    sums = each.groupBy("part", "filter_order", "step").agg(
        count(F.col("first") > F.col("step")).alias("kept"),
        count(removed).alias("removed"),
        count(fails & (F.col("first") < F.col("step"))).alias("redundant"),
        count(F.col("bits") == F.col("bit")).alias("unique_fails"),
        count(removed & F.col("good")).alias("good_lost"),
        count(removed & F.col("toxic")).alias("toxic_lost"),
    )
    same = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    return sums.withColumn("shapley", F.sum("removed").over(same))


def audit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``replay`` of the failures of ``df``."""
    return replay(failures(df, labels, id_col, text_col, part_col))


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    """Per part (language), order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Rows with the same part, bits and labels are replayed as one with their number.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS low FROM d),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1),
f AS (
  SELECT part, (len(ws) < 100) AS a, (100 * len(list_distinct(ws)) < 80 * len(ws)) AS b,
    (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t)) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(w.doc_id > low, false) AS e,
    coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id
), g AS (
  SELECT part, (CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END) AS failed,
    good, toxic, count(*) AS n FROM f GROUP BY ALL
), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (
  SELECT p.c || q.c || r.c || s.c || u.c AS filter_order FROM x p, x q, x r, x s, x u
  WHERE len(list_distinct([p.c, q.c, r.c, s.c, u.c])) = 5
), e AS (
  SELECT part, failed, good, toxic, n, filter_order, step::INT AS step, filter_order[step] AS c,
    coalesce(list_min(list_filter([1, 2, 3, 4, 5], lambda k: contains(failed, filter_order[k]))), 6) AS first
  FROM g, o, range(1, 6) t(step)
), s AS (
  SELECT part, filter_order, step, c,
    coalesce(sum(n) FILTER (first > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (first = step), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (contains(failed, c) AND first < step), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (failed = c), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (first = step AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (first = step AND toxic), 0)::BIGINT AS toxic_lost
  FROM e GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, c))::BIGINT AS shapley FROM s
"""
