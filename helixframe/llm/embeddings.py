"""Near-dedup of embeddings: random-hyperplane sign hashing, exact cosines, components.

1. Equal vectors of one label become one class with a number of its own; only
   classes are compared.
2. Each class gets ``tables`` keys of ``bits`` signs. Classes that share a key
   and a label meet in a bucket. ``bits`` grows with the logarithm of the
   largest label, so that buckets stay small; ``tables`` follows from ``bits``,
   the threshold and the wanted recall at exactly the threshold, where it is
   lowest.
3. Classes come to their buckets as a number and 64 further signs. A row leaves
   its bucket only if some other one's signs differ in so few places that a
   cosine at the threshold isn't all but impossible. Only these rows fetch their vectors.
4. Cosines are computed in double precision, a block of rows against a block. A
   pair that meets in several tables counts in the first one only, which both
   sign strings tell, so that links need no deduplication. A task reports the
   links of each class as a number, and as edges only a spanning forest: no
   list of pairs leaves it.
5. A bucket with more than ``block`` classes is dealt over a grid of block
   pairs, every pair of classes in exactly one cell.
6. Components come from distributed star contraction.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.components import components
from helixframe.llm.shared import U64, arrow_map, drop_staged, forest, runs, split_join, staged

COSINE, RECALL, BLOCK = 0.93, 0.9995, 4096
#: Rows of a label to a bucket, if vectors were spread evenly, and the fewest bits of a key.
BUCKET, LEAST_BITS = 32, 8
#: Signs that a bucket compares, and the chance that a pair at the threshold differs in more of them than it lets pass.
SKETCH, MISS = 64, 1e-6
#: The list of split buckets is broadcast up to so many rows, else joined by shuffle.
HOT_ROWS = 100_000


def bits_for(largest: int) -> int:
    """Bits of a key for a label of so many classes."""
    return max(LEAST_BITS, round(math.log2(max(largest, 1) / BUCKET)))


def tables_for(bits: int, cosine: float, recall: float) -> int:
    """Tables so that a pair at the threshold shares a key in one of them with the wanted probability."""
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def sketch_limit(cosine: float, miss: float = MISS, signs: int = SKETCH) -> int:
    """The fewest differing signs that a pair at the threshold exceeds with a chance below ``miss``."""
    p, beyond = math.acos(cosine) / math.pi, 1.0
    for k in range(signs + 1):
        beyond -= math.comb(signs, k) * p**k * (1 - p) ** (signs - k)
        if beyond < miss:
            return k
    return signs


def signs(vectors: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    """Sign strings, ``tables`` keys of whole bytes to each row."""
    planes = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((vectors.shape[1], tables * bits))
    up = (vectors @ planes > 0).reshape(len(vectors), tables, bits)
    return np.packbits(up, axis=2).reshape(len(vectors), -1)


def sketches(vectors: np.ndarray, seed: int) -> np.ndarray:
    """64 further signs of each row as a number."""
    return signs(vectors, 1, SKETCH, seed + 1).view(np.int64).ravel()


def unit(lists: pa.Array) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Unit vectors of list rows by dimension: (dimensions, row numbers, matrices)."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    dims, rows, mats = np.unique(sizes), [], []
    for d in dims:
        at = np.flatnonzero(sizes == d)
        m = flat[(ends[at] - d)[:, None] + np.arange(d)]
        m = m / np.abs(m).max(1, keepdims=True)
        rows.append(at)
        mats.append(m / np.sqrt((m * m).sum(1, keepdims=True)))
    return dims, rows, mats


def _usable(vector: str) -> str:
    finite = f"forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    return f"{vector} is not null and {finite} and exists({vector}, x -> x <> 0)"


def _hashed(classes: DataFrame, tables: int, bits: int, seed: int) -> DataFrame:
    """cid, label, dim, the sketch and the sign string of each class."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            dims, rows, mats = unit(batch.column("vec"))
            for d, at, m in zip(dims, rows, mats, strict=True):
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [part.column("cid"), part.column("label"), pa.array(np.full(len(at), d), pa.int32()), pa.array(sketches(m, seed)), pa.array([r.tobytes() for r in signs(m, tables, bits, seed)], pa.binary())],
                    ["cid", "label", "dim", "sketch", "sign"],
                )

    return arrow_map(classes.select("cid", "label", "vec"), run, f"cid long, label {dict(classes.dtypes)['label']}, dim int, sketch long, sign binary")


def _bucketed(hashed: DataFrame, tables: int, bits: int, block: int) -> DataFrame:
    """A row for each class, table and grid cell; ``bucket`` is what a task groups by."""
    width = (bits + 7) // 8
    rows = hashed.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))))
    rows = rows.select(F.expr(f"xxhash64(label, dim, t, substring(sign, t * {width} + 1, {width}))").alias("bucket"), F.col("t").cast("short").alias("t"), "cid", "sketch")
    hot = staged(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block), "hot-buckets", hashed.count() * tables // block)
    parts = hot.select("bucket", F.ceil(F.col("n") * 2 / block).cast("int").alias("parts"))
    rows = rows.join(F.broadcast(parts) if hot.count() <= HOT_ROWS else parts, "bucket", "left")
    rows = rows.withColumn("own", F.coalesce(F.expr("pmod(xxhash64(cid, 11), parts)"), F.lit(0)).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0)))))
    return rows.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "t", "cid", "sketch")


_CELL = ["bucket", "lo", "hi"]


def _maybe(bucketed: DataFrame, limit: int) -> DataFrame:
    """The rows with another one in their cell whose sketch differs in ``limit`` signs at most."""

    def run(batches):
        for table, bounds in runs(batches, _CELL):
            sketch, own = table.column("sketch").to_numpy().view(U64), table.column("own").to_numpy()
            lo, hi = table.column("lo").to_numpy(), table.column("hi").to_numpy()
            keep = np.zeros(table.num_rows, bool)
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                for k in range(s, e if e - s > 1 else s, 256):
                    to = min(k + 256, e)
                    near = np.bitwise_count(sketch[k:to, None] ^ sketch[None, s:e]) <= limit
                    near[np.arange(to - k), np.arange(k, to) - s] = False
                    if lo[s] != hi[s]:
                        near &= own[k:to, None] != own[None, s:e]
                    keep[k:to] = near.any(1)
            yield from table.select([*_CELL, "own", "t", "cid"]).filter(pa.array(keep)).to_batches()

    dealt = bucketed.repartition(*_CELL).sortWithinPartitions(*_CELL)
    return arrow_map(dealt, run, "bucket long, lo int, hi int, own int, t short, cid long")


def _linked(rows: DataFrame, tables: int, bits: int, cosine: float, seed: int) -> DataFrame:
    """(ra, a, rb, b, n): edges of spanning forests with n = 0, and link counts n of a with b null."""
    names = "ra long, a long, rb long, b long, n long"

    def run(batches):
        for table, bounds in runs(batches, _CELL):
            rep, cid, size = (table.column(c).to_numpy() for c in ("rep", "cid", "size"))
            own, lo, hi, t = (table.column(c).to_numpy() for c in ("own", "lo", "hi", "t"))
            label = table.column("label").to_numpy(zero_copy_only=False)
            lists = table.column("vec").combine_chunks()
            lists = lists if isinstance(lists, pa.Array) else lists.chunk(0)
            out: list[np.ndarray] = []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if e - s < 2:
                    continue
                _, of, mats = unit(lists.slice(s, e - s))
                # A bucket is of one dimension and label but for chance; both are told apart.
                for at, m in zip(of, mats, strict=True):
                    left = np.flatnonzero(own[s + at] == lo[s])
                    right = np.flatnonzero(own[s + at] == hi[s])
                    pairs = [_pairs(m, left[k : k + 512], right, cosine) for k in range(0, len(left), 512)]
                    i, j = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
                    ok = (label[s + at[i]] == label[s + at[j]]) & (t[s + at[i]] == t[s + at[j]]) & (cid[s + at[i]] != cid[s + at[j]])
                    if lo[s] == hi[s]:
                        ok &= i < j
                    i, j = i[ok], j[ok]
                    if not len(i):
                        continue
                    i, j = _first(i, j, signs(m, tables, bits, seed).reshape(len(m), tables, -1), t[s + at])
                    if not len(i):
                        continue
                    w = size[s + at]
                    n = np.bincount(i, w[j], len(at)) + np.bincount(j, w[i], len(at))
                    hit, root = np.flatnonzero(n), forest(len(at), i, j)
                    leaf = np.flatnonzero(root != np.arange(len(at)))
                    r, c, none = rep[s + at], cid[s + at], np.zeros(len(hit), np.int64)
                    out.append(np.stack([r[hit], c[hit], none, none, n[hit].astype(np.int64)]))
                    out.append(np.stack([r[leaf], c[leaf], r[root[leaf]], c[root[leaf]], np.zeros(len(leaf), np.int64)]))
            if out:
                x = np.concatenate(out, 1)
                told = [pa.array(x[0]), pa.array(x[1]), pa.array(x[2], mask=x[4] > 0), pa.array(x[3], mask=x[4] > 0), pa.array(x[4])]
                yield pa.RecordBatch.from_arrays(told, [y.split()[0] for y in names.split(", ")])

    dealt = rows.repartition(*_CELL).sortWithinPartitions(*_CELL, "cid")
    return arrow_map(dealt, run, names)


def _pairs(m: np.ndarray, left: np.ndarray, right: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    i, j = np.nonzero(m[left] @ m[right].T >= cosine)
    return left[i], right[j]


def _first(i: np.ndarray, j: np.ndarray, sign: np.ndarray, t: np.ndarray, step: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose first common table is the one that they met in."""
    keep = []
    for k in range(0, len(i), step):
        same = (sign[i[k : k + step]] == sign[j[k : k + step]]).all(2)
        keep.append(same.argmax(1) == t[i[k : k + step]])
    ok = np.concatenate(keep)
    return i[ok], j[ok]


def near_groups(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    cosine: float = COSINE,
    bits: int | None = None,
    recall: float = RECALL,
    block: int = BLOCK,
    seed: int = 20,
) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of ``df``.

    Vectors are compared only if their labels are equal and not null. One that
    is null, zero, empty or holds a null or non-finite component links with
    nothing, nor do vectors of different length with each other. Rows that
    repeat an id are vectors of their own that share it; equal vectors link.
    A row without an id is listed, links with nothing and counts as nobody's
    link. Other columns are ignored; an empty table gives no rows.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    good = F.expr(f"label is not null and id is not null and {_usable('vec')}")
    # Two hashes of a vector stand for it wherever rows are matched.
    rows = rows.withColumns({"good": F.coalesce(good, F.lit(False)), "v1": F.xxhash64("vec"), "v2": F.xxhash64(F.lit(1), "vec")})
    one = rows.where("good").groupBy("label", "v1", "v2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"), F.any_value("vec").alias("vec"))
    classes = staged(one.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    total = classes.count()
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits = bits or bits_for(largest)
    tables = tables_for(bits, cosine, recall)
    hashed = staged(_hashed(classes, tables, bits, seed), "signs")
    maybe = staged(_maybe(_bucketed(hashed, tables, bits, block), sketch_limit(cosine)), "maybe", total)
    full = maybe.join(classes.select("cid", "rep", "size", "label", "vec"), "cid")
    found = staged(_linked(full, tables, bits, cosine, seed), "links", total)
    drop_staged(spark, hashed, maybe)
    node = lambda r, c: F.struct(F.col(r).alias("rep"), F.col(c).alias("cid"))
    roots = components(found.where("b is not null").select(node("ra", "a").alias("a"), node("rb", "b").alias("b")))
    links = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    told = staged(
        classes.select("label", "v1", "v2", "size", "rep", "cid")
        .join(links, "cid", "left")
        .join(roots.select(F.col("node.cid").alias("cid"), F.col("root.rep").alias("root")), "cid", "left")
        .select("label", "v1", "v2", "size", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id")),
        "class-results",
        total,
    )
    narrow = rows.select("id", F.when(F.col("good"), F.col("label")).alias("label"), "v1", "v2")
    joined = split_join(narrow, told, ["label", "v1", "v2"], "size", df.count(), "left")
    out = joined.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op1_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs of a label, in double precision; a recursive search for the smallest id that each vector reaches.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93
), r AS (
  SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node WHERE r.root < l.b
), c AS (SELECT node, min(root) AS component_id FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.node = vec_id LEFT JOIN n ON n.a = vec_id
"""
