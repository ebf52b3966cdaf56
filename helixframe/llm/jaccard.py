"""N-gram Jaccard join with prefix trees.

A document is the set of its distinct word n-grams, hashed to 64 bits and put
in one global order: very frequent n-grams last, all others by hash. Documents
with equal sets are one class. Two sets that reach the threshold share an
n-gram within their prefixes, so classes meet in one group per prefix n-gram.

A group's sets stand in a compressed trie. One traversal per set carries the
overlap along shared paths and leaves a subtree as soon as what remains of
either set can no longer reach the overlap that the sizes ask for.

The first round groups by each set's first n-gram only and finds the components
of the usual near copies, the next one by a few. The last round takes every
prefix n-gram whose group still holds more than one component, which is all that
can still matter, so nothing is lost. A pair is looked at only in the group of
the first n-gram that it shares, and rows without a partner of fitting size and
position go at once. In each
round a first trie pass over the prefixes alone, where the
unknown rest counts in full, names the sets that may have a partner; only those
are fetched whole for the second pass, which decides. A task emits a spanning
forest of the links, never all pairs.

What is moved are numbers: a prefix n-gram's row is its hash, two ids and two
small numbers, dealt once by n-gram. Only the listed frequent n-grams, of which
there is a fixed number, can be many rows' own; their rows are filtered where
they are. A group is dealt over a grid of block pairs only beyond a number of
rows or keys, so that a cell holds a bounded number of bytes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.byte_bpe import within
from helixframe.llm.components import components
from helixframe.llm.shared import MASK, PRIME, U64, Rolling, arrow_map, drop_staged, flat, keep_rows, mix, release, rows_by_bytes, runs, split_join, staged, tokens

#: Words to a shingle; similarity in hundredths; sets and their n-grams to a cell of the grid.
WORDS, PERCENT, BLOCK, KEYS = 4, 85, 2048, 1 << 20
#: Counters of a task's Misra-Gries summary, and n-grams that may be ordered last.
COUNTERS, FREQUENT = 1 << 16, 1 << 16
#: An n-gram is frequent from this share of the documents on.
SHARE = 0.0002
#: Prefix n-grams of each set that a round looks at; the last one looks at all.
ROUNDS = (1, 8, None)
#: Ids of wanted documents and changed roots are broadcast up to so many rows, else joined by shuffle.
BROADCAST_ROWS = 500_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def least_overlap(a: int, b: int, percent: int) -> int:
    """The smallest overlap of sets of sizes a and b that reaches the threshold."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; fewer words than n make one n-gram of all."""
    body, offsets = flat(column)
    start, end, row = tokens(body, offsets)
    low = _LOWER[body]
    word = Rolling(Rolling.LUT[low]).of(start, end) ^ mix((end - start).astype(U64))
    per = np.bincount(row, minlength=len(offsets) - 1)
    first = np.cumsum(per) - per
    n = len(word)
    grams = np.zeros(n, U64)
    if n >= words:
        m = n - words + 1
        for i in range(words):
            grams[:m] = grams[:m] * U64(0x9E3779B97F4A7C15) + mix(word[i : m + i] + U64(i))
        grams = mix(grams)
    out = []
    for k, f in zip(per.tolist(), first.tolist(), strict=True):
        if k >= words:
            out.append(np.unique(grams[f : f + k - words + 1]))
        elif k:
            h = U64(k)
            with np.errstate(over="ignore"):
                for w in word[f : f + k]:
                    h = mix(np.array([h * U64(31) + w], U64))[0]
            out.append(np.array([h], U64))
        else:
            out.append(np.zeros(0, U64))
    return out


class Order:
    """The global order: frequent n-grams last, by rank; the rest by hash."""

    def __init__(self, frequent: np.ndarray):
        """frequent: the frequent hashes from the rarest to the commonest."""
        self.sorted = np.sort(frequent)
        self.rank = np.argsort(frequent, kind="stable").astype(U64)

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        out = hashes >> U64(1)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
            hit = self.sorted[at] == hashes
            out[hit] = U64(1 << 63) | self.rank[at[hit]]
        return np.sort(out)


# ------------------------------------------------------------------ the trie


class Trie:
    """A compressed trie over sorted key arrays, given as big-endian bytes.

    A node holds [from, to) of the sorted sets, the key positions of its path
    segment, its children, and the least and largest size below it.
    """

    def __init__(self, body: np.ndarray, offsets: np.ndarray, size: np.ndarray):
        raw = [body[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        self.order = sorted(range(len(raw)), key=raw.__getitem__)
        m = len(raw)
        del raw
        keys = body[offsets[0] : offsets[-1]].view(">u8").astype(U64)
        at = (offsets - offsets[0]) // 8
        self.keys = [keys[at[i] : at[i + 1]] for i in self.order]
        self.size = size[self.order]
        lcp = np.zeros(m, np.int64)
        for i in range(1, m):
            a, b = self.keys[i - 1], self.keys[i]
            k = min(len(a), len(b))
            differ = np.flatnonzero(a[:k] != b[:k])
            lcp[i] = differ[0] if len(differ) else k
        self.nodes: list[tuple] = []
        self.root = self._build(lcp)

    def _build(self, lcp: np.ndarray) -> int:
        """Nodes in preorder over an explicit stack; returns the root's number."""
        todo = [(0, len(self.keys), 0, -1)]
        kids: list[list[int]] = []
        while todo:
            lo, hi, depth, parent = todo.pop()
            to = len(self.keys[lo]) if hi - lo == 1 else int(lcp[lo + 1 : hi].min())
            number = len(self.nodes)
            kids.append([])
            self.nodes.append((lo, hi, depth, to, kids[number], int(self.size[lo:hi].min()), int(self.size[lo:hi].max())))
            if parent >= 0:
                kids[parent].append(number)
            if hi - lo > 1:
                cuts = [lo, *(lo + 1 + np.flatnonzero(lcp[lo + 1 : hi] == to)).tolist(), hi]
                todo += [(a, b, to, number) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return 0

    def partners(self, x: int, percent: int, gram: int, skip):
        """Sets before ``x`` whose overlap may reach the threshold; exact if all keys are there.

        A subtree that shares a key below ``gram`` with ``x`` is left: its pairs
        belong to that key's group. ``skip(lo, hi)`` tells that no set of that
        range is of interest.
        """
        key, nx = self.keys[x], int(self.size[x])
        horizon = key[-1]
        todo = [(self.root, 0)]
        while todo:
            number, overlap = todo.pop()
            lo, hi, begin, to, kids, small, large = self.nodes[number]
            if lo >= x or 100 * min(nx, large) < percent * nx or 100 * nx < percent * small or skip(lo, min(hi, x)):
                continue
            least = least_overlap(nx, max(small, -(-percent * nx // 100)), percent)
            path, beyond = self.keys[lo][begin:to], False
            if len(path):
                if path[-1] > horizon:
                    path, beyond = path[: int(np.searchsorted(path, horizon, "right"))], True
                at = np.searchsorted(key, path)
                shared = path[key[np.minimum(at, len(key) - 1)] == path]
                if len(shared) and shared[0] < gram:
                    continue
                overlap += len(shared)
            depth = begin + len(path)
            seen = len(key) if beyond else int(np.searchsorted(key, self.keys[lo][to - 1], "right")) if to else 0
            if overlap + min(nx - seen, large - depth) < least:
                continue
            if kids and not beyond:
                todo += [(k, overlap) for k in kids]
                continue
            for y in range(lo, min(hi, x)):
                ny = int(self.size[y])
                if 100 * min(nx, ny) >= percent * max(nx, ny) and overlap + min(nx - seen, ny - depth) >= least_overlap(nx, ny, percent):
                    yield y


def join_group(body: np.ndarray, offsets: np.ndarray, size: np.ndarray, comp: np.ndarray, side: np.ndarray | None, old: np.ndarray, percent: int, exact: bool, gram: int = 0):
    """Links of the group of ``gram`` between sets of different components (and sides, where given).

    Two ``old`` sets met here in the round before.

    exact: pairs of positions that make a spanning forest. Else: a mask of the
    sets that may have a partner.
    """
    trie = Trie(body, offsets, size)
    order, m = np.array(trie.order), len(size)
    _, root = np.unique(comp[order], return_inverse=True)
    at, old = None if side is None else side[order], old[order]
    marked = np.zeros(m, bool)
    pairs = []
    for x in range(1, m):
        other = None if at is None else at != at[x]
        if old[x]:
            other = ~old if other is None else other & ~old

        def skip(lo, hi, x=x, other=other):
            dull = root[lo:hi] == root[x]
            if other is not None:
                dull |= ~other[lo:hi]
            if not exact and marked[x]:
                dull |= marked[lo:hi]
            return dull.all()

        for y in trie.partners(x, percent, U64(gram), skip):
            if root[y] == root[x] or (other is not None and not other[y]):
                continue
            if exact:
                pairs.append((order[y], order[x]))
                root[root == root[y]] = root[x]
            else:
                marked[[x, y]] = True
    if exact:
        return pairs
    out = np.zeros(m, bool)
    out[order] = marked
    return out


# ------------------------------------------------------------------- Spark


def frequent_ngrams(df: DataFrame, words: int) -> np.ndarray:
    """Hashes of at most FREQUENT n-grams that the most documents have, from rare to common.

    Each task keeps a Misra-Gries summary over all its documents; the summaries
    are added by shuffle, and a list of fixed length comes to the driver.
    """

    def run(batches):
        keys, count, docs = np.zeros(0, U64), np.zeros(0, np.int64), 0
        for whole in batches:
            for batch in rows_by_bytes(whole, "text"):
                sets = shingle_sets(batch.column("text"), words)
                docs += len(sets)
                new, n = np.unique(np.concatenate(sets), return_counts=True)
                keys, where = np.unique(np.r_[keys, new], return_inverse=True)
                count = np.bincount(where, np.r_[count, n]).astype(np.int64)
                if len(keys) > COUNTERS:
                    count = count - np.partition(count, -COUNTERS - 1)[-COUNTERS - 1]
                    keys, count = keys[count > 0], count[count > 0]
        keep = count > max(1, SHARE * docs / 4)
        yield pa.RecordBatch.from_arrays([pa.array(keys[keep].astype(np.int64)), pa.array(count[keep])], ["gram", "n"])

    told = arrow_map(df.select("text"), run, "gram long, n long")
    rows = told.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2, math.ceil(SHARE * df.count())))
    top = rows.orderBy(F.desc("n"), "gram").limit(FREQUENT).collect()
    return np.array([r["gram"] for r in reversed(top)], np.int64).astype(U64)


def _fingerprint(keys: np.ndarray) -> tuple[int, int]:
    a, b = mix(keys).sum(dtype=U64), mix(keys ^ U64(0xD1B54A32D192ED03)).sum(dtype=U64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _parity(keys: np.ndarray) -> bytes:
    """Bits by hash, each flipped by every key that falls to it; between one and two bits a key, 64 at least."""
    bits = 1 << max(6, (len(keys) - 1).bit_length())
    odd = np.bincount((mix(keys) & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def shingle_table(df: DataFrame, words: int, percent: int, order: Order) -> DataFrame:
    """id, mark (of the text), n, two fingerprints of the set, its parity bits, and the prefix's keys."""

    def run(batches):
        for whole in batches:
            for batch in rows_by_bytes(whole, "text"):
                sets = [order.keys(s) for s in shingle_sets(batch.column("text"), words)]
                prints = np.array([_fingerprint(s) for s in sets], np.int64).reshape(len(sets), 2)
                prefixes = [s[: prefix_length(len(s), percent)].astype(">u8").tobytes() if len(s) else b"" for s in sets]
                bits = [_parity(s) if len(s) else b"" for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("mark"), pa.array([len(s) for s in sets], pa.int32()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array(bits, pa.binary()), pa.array(prefixes, pa.binary())],
                    ["id", "mark", "n", "f1", "f2", "parity", "prefix"],
                )

    return arrow_map(df.select("id", "mark", "text"), run, "id long, mark long, n int, f1 long, f2 long, parity binary, prefix binary")


def _prefix_rows(classes: DataFrame, most: int | None, common: bool) -> DataFrame:
    """(gram, cid, comp, n, pos) for each of the first ``most`` prefix n-grams: the frequent ones (below 0), or the others."""

    def run(batches):
        for whole in batches:
            for batch in rows_by_bytes(whole, "prefix", 1 << 20):
                body, offs = flat(batch.column("prefix"))
                size = np.minimum(np.diff(offs) // 8, most) if most else np.diff(offs) // 8
                pos = within(size)
                gram = body.view(">u8").astype(U64).astype(np.int64)[np.repeat(offs[:-1] // 8, size) + pos]
                of = np.repeat(np.arange(len(size)), size)
                keep = (gram < 0) == common
                of, pos = of[keep], pos[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram[keep]), *(pa.array(batch.column(c).to_numpy()[of]) for c in ("cid", "comp", "n")), pa.array(pos.astype(np.int32))],
                    ["gram", "cid", "comp", "n", "pos"],
                )

    # Frequent n-grams stand last, so the last key tells whether a prefix has any.
    some = classes.where("hex(substring(prefix, -8, 1)) >= '80'") if common else classes
    return arrow_map(some.select("cid", "comp", "n", "prefix"), run, "gram long, cid long, comp long, n int, pos int")


def _met(classes: DataFrame, most: int | None, done: int, block: int, keys: int) -> tuple[DataFrame, DataFrame]:
    """The prefix rows of n-grams that several components have, and that stand beyond the first ``done`` of some set; of rare n-grams, then of frequent ones.

    ``old`` rows are those within: two of them met in the round before.
    ``parts``: over how many parts the n-gram's rows are dealt.

    Frequent n-grams are counted with map-side partial sums and their list, of
    a fixed length at most, goes back to the rows; all others meet by n-gram,
    and stand there in its order.
    """
    figures = {"low": F.min("comp"), "high": F.max("comp"), "far": F.max("pos"), "k": F.count(F.lit(1)), "w": F.sum("n")}
    mixed, cells = f"low < high and far >= {done}", F.ceil(F.greatest(F.col("k") / block, F.col("w") / keys))
    parts = F.when(cells > 1, cells * 2).otherwise(1).cast("int")
    common = _prefix_rows(classes, most, True)
    listed = common.groupBy("gram").agg(*(c.alias(name) for name, c in figures.items())).where(mixed).select("gram", parts.alias("parts"))
    every = Window.partitionBy("gram")
    rare = _prefix_rows(classes, most, False).withColumns({name: c.over(every) for name, c in figures.items()})
    rare = rare.where(mixed).withColumn("parts", parts).drop(*figures).sortWithinPartitions("gram")
    old = F.col("pos") < done
    return rare.withColumn("old", old), common.join(F.broadcast(listed), "gram").withColumn("old", old)


_CELL = ["gram", "lo", "hi"]
_ROW = "gram long, lo int, hi int, own int, cid long, comp long, n int, pos int, old boolean"


def _dealt(rows: DataFrame) -> DataFrame:
    """The grid cells of the rows, together and in order."""
    dealt = rows.withColumn("own", F.expr("cast(pmod(xxhash64(cid, 5), parts) as int)"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = dealt.select("gram", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "cid", "comp", "n", "pos", "old", F.lit(1).alias("parts"))
    return cells.repartition(*_CELL).sortWithinPartitions(*_CELL)


def _fits(n, left, comp, own, old, some, split, percent):
    """Which of the rows ``some`` and all rows of a cell may be a pair, by component, size and position."""
    ok = (comp[some, None] != comp[None]) & ~(old[some, None] & old[None])
    if split:
        ok &= own[some, None] != own[None]
    ok &= 100 * np.minimum.outer(n[some], n) >= percent * np.maximum.outer(n[some], n)
    return ok & ((100 + percent) * np.minimum.outer(left[some], left) >= percent * np.add.outer(n[some], n))


def _figures(table: pa.Table):
    comp, own, n, pos = (table.column(c).to_numpy() for c in ("comp", "own", "n", "pos"))
    return n.astype(np.int64), (n - pos).astype(np.int64), comp, own, table.column("old").to_numpy(zero_copy_only=False)


def _compatible(cells: DataFrame, percent: int) -> DataFrame:
    """The rows with a partner of another component whose size and position leave room for the overlap.

    Rows that are still to be dealt over several parts all stay. ``s1``, ``s2``:
    a cell's rows that stay, as two sums over their numbers.
    """
    names = [x.split()[0] for x in _ROW.split(", ")] + ["parts"]

    def run(batches):
        for table, bounds in runs(batches, _CELL):
            figures, keep = _figures(table), np.zeros(table.num_rows, bool)
            lo, hi, parts = (table.column(c).to_numpy() for c in ("lo", "hi", "parts"))
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if parts[s] > 1:
                    keep[s:e] = True
                    continue
                for k in range(s, e, 128):
                    keep[k : min(k + 128, e)] = _fits(*(x[s:e] for x in figures), slice(k - s, min(k + 128, e) - s), lo[s] != hi[s], percent).any(1)
            cid, cell = table.column("cid").to_numpy().astype(U64), np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            prints = []
            for salt in (1, 2):
                each = np.where(keep, mix(cid + U64(salt * PRIME & MASK)), U64(0))
                prints.append(pa.array(np.add.reduceat(each, bounds[:-1])[cell].astype(np.int64)))
            out = table.select(names).append_column("s1", prints[0]).append_column("s2", prints[1])
            yield from out.filter(pa.array(keep)).to_batches()

    return arrow_map(cells.select(*names), run, f"{_ROW}, parts int, s1 long, s2 long")


def _once(cells: DataFrame) -> DataFrame:
    """Of cells with the very same rows left, the one of the first n-gram in the order is where all their pairs belong."""
    place = F.struct(F.col("gram") < 0, *_CELL)
    same = Window.partitionBy("s1", "s2", "cid")
    return cells.withColumn("first", F.min(place).over(same)).where(F.col("first") == place).drop("first", "s1", "s2", "parts")


def _differing(bits: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many parity bits the sets of each pair differ, the longer bits folded to the shorter; never more than keys that only one has."""
    size = np.array([len(x) for x in bits])
    out, least = np.zeros(len(a), np.int64), np.minimum(size[a], size[b])
    for w in np.unique(least).tolist():
        at = np.flatnonzero(least == w)
        rows, where = np.unique(np.r_[a[at], b[at]], return_inverse=True)
        matrix = np.stack([np.bitwise_xor.reduce(bits[r].reshape(-1, w), axis=0) for r in rows.tolist()])
        i, j = where[: len(at)], where[len(at) :]
        step = max(1, (1 << 19) // w)
        for k in range(0, len(at), step):
            out[at[k : k + step]] = np.bitwise_count(matrix[i[k : k + step]] ^ matrix[j[k : k + step]]).sum(1)
    return out


#: Pairs whose bits are compared together.
PAIRS = 1 << 20


def _alike(cells: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The rows with a partner whose parity bits leave room for the overlap.

    Sets of sizes a and b with d differing bits share at most (a + b - d) / 2
    keys, so nothing is lost, and some bits a key tell unlike sets apart
    without their prefixes.
    """

    def run(batches):
        for table, bounds in runs(batches, _CELL):
            figures, keep = _figures(table), np.zeros(table.num_rows, bool)
            n, lo, hi = figures[0], table.column("lo").to_numpy(), table.column("hi").to_numpy()
            body, offsets = flat(table.column("parity").combine_chunks())
            bits = [body[x:y].view(U64) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            found: list = []

            def told(found=found, n=n, bits=bits, keep=keep):
                if found:
                    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                    # Twice the overlap's bound against twice the least overlap, in whole numbers.
                    good = (100 + percent) * (n[a] + n[b] - _differing(bits, a, b)) >= 2 * percent * (n[a] + n[b])
                    keep[a[good]] = keep[b[good]] = True
                    found.clear()

            many = 0
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                for k in range(s, e, 128):
                    i, j = np.nonzero(_fits(*(x[s:e] for x in figures), slice(k - s, min(k + 128, e) - s), lo[s] != hi[s], percent))
                    one = i + k - s < j
                    found.append((i[one] + k, j[one] + s))
                    many += int(one.sum())
                    if many > PAIRS:
                        told()
                        many = 0
            told()
            yield from table.drop_columns(["parity"]).filter(pa.array(keep)).to_batches()

    names = [x.split()[0] for x in _ROW.split(", ")]
    both = cells.select(*names).join(classes.select("cid", "parity"), "cid").select(*names, "parity")
    return arrow_map(both.repartition(*_CELL).sortWithinPartitions(*_CELL), run, _ROW)


def _joined(rows: DataFrame, percent: int, exact: bool) -> DataFrame:
    """The trie join of each cell: edges (ra, a, rb, b) if exact, else the rows that may have a partner."""
    out = "ra long, a long, rb long, b long" if exact else "gram long, lo int, hi int, own int, cid long, comp long, old boolean"
    names = [x.split()[0] for x in out.split(", ")]

    def run(batches):
        for table, bounds in runs(batches, _CELL):
            n = table.column("n").to_numpy().astype(np.int64)
            rep, cid, comp, own = (table.column(c).to_numpy() for c in ("rep", "cid", "comp", "own"))
            lo, hi = table.column("lo").to_numpy(), table.column("hi").to_numpy()
            gram, old = table.column("gram").to_numpy().astype(U64), table.column("old").to_numpy(zero_copy_only=False)
            found: list = []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if e - s < 2 or (comp[s:e] == comp[s]).all():
                    continue
                column = table.column("keys").slice(s, e - s).combine_chunks()
                body, offsets = flat(column if isinstance(column, pa.Array) else column.chunk(0))
                side = own[s:e] if lo[s] != hi[s] else None
                got = join_group(body, offsets, n[s:e], comp[s:e], side, old[s:e], percent, exact, int(gram[s]))
                found += [(s + i, s + j) for i, j in got] if exact else (s + np.flatnonzero(got)).tolist()
            if not found:
                continue
            if exact:
                at = np.array(found)
                yield pa.RecordBatch.from_arrays([pa.array(x[at[:, i]]) for i in (0, 1) for x in (rep, cid)], names)
            else:
                yield from table.select(names).take(pa.array(found)).to_batches()

    dealt = rows.repartition(*_CELL).sortWithinPartitions(*_CELL, "cid")
    return arrow_map(dealt.select(*_CELL, "own", "rep", "cid", "comp", "old", "n", "keys"), run, out)


def _whole_sets(df: DataFrame, wanted: DataFrame, words: int, order: Order) -> DataFrame:
    """(cid, rep, n, keys) of the wanted classes, from the row that names each.

    Rows that agree in id and text give a set twice; both belong to one class, so they never link.
    """

    def run(batches):
        for whole in batches:
            for batch in rows_by_bytes(whole, "text"):
                sets = [order.keys(s) for s in shingle_sets(batch.column("text"), words)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("cid"), batch.column("rep"), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.astype(">u8").tobytes() for s in sets], pa.binary())],
                    ["cid", "rep", "n", "keys"],
                )

    few = wanted.count() <= BROADCAST_ROWS
    texts = df.join(F.broadcast(wanted) if few else wanted, (F.col("id") == F.col("rep")) & (F.col("mark") == F.col("rep_mark")))
    return arrow_map(texts.select("cid", "rep", "text"), run, "cid long, rep long, n int, keys binary")


def _round(df: DataFrame, classes: DataFrame, most: int | None, done: int, words: int, percent: int, block: int, keys: int, order: Order) -> DataFrame:
    """Links between classes of different components that share one of the first ``most`` prefix n-grams, but not of the first ``done``."""
    spark, total = df.sparkSession, classes.count()
    rare, common = _met(classes, most, done, block, keys)
    none = F.lit(0)
    # The rows of rare n-grams meet once and are looked at where they are; few of them are written.
    met = staged(_compatible(rare.withColumns({"lo": none, "hi": none, "own": none}), percent), "met")
    release(spark)
    wide = met.where("parts > 1").select(*common.columns).unionByName(common)
    cells = _once(met.where("parts = 1").unionByName(_compatible(_dealt(wide), percent)))
    near = staged(_alike(cells, classes, percent), "near")
    release(spark)
    few = near.count()
    own = near.select("cid").distinct()
    prefixes = classes.join(F.broadcast(own) if few <= BROADCAST_ROWS else own, "cid", "left_semi")
    sketch = prefixes.select("rep", "cid", F.col("prefix").alias("keys")).join(near.drop("pos"), "cid")
    maybe = staged(_joined(sketch, percent, False), "maybe", few)
    wanted = staged(classes.select("rep", "rep_mark", "cid").join(maybe.select("cid").distinct(), "cid", "left_semi"), "wanted", min(few, total))
    sets = _whole_sets(df, wanted, words, order)
    links = staged(_joined(maybe.join(sets, "cid"), percent, True), "links", few)
    drop_staged(spark, met, near, maybe, wanted)
    return links.select(F.struct(F.col("ra").alias("rep"), F.col("a").alias("cid")).alias("a"), F.struct(F.col("rb").alias("rep"), F.col("b").alias("cid")).alias("b"))


def near_rows(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    percent: int = PERCENT,
    block: int = BLOCK,
    keys: int = KEYS,
) -> DataFrame:
    """id, mark (``xxhash64`` of the text), n, component_id and stays of each row of ``df``.

    ``stays``: of a component's rows, those of its smallest id and, among
    them, the smallest mark. Rows without a set or an id stay.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))
    order = Order(frequent_ngrams(docs, words))
    every = staged(shingle_table(docs, words, percent, order), "shingles")
    # Equal sets are one class, named by its first row; the class's number tells apart those that share an id.
    some = every.where("n > 0 and id is not null")
    one = some.groupBy("n", "f1", "f2").agg(F.min(F.struct("id", "mark")).alias("r"), F.count(F.lit(1)).alias("size"), F.min("parity").alias("parity"), F.min("prefix").alias("prefix"))
    classes = staged(one.select(F.col("r.id").alias("rep"), F.col("r.mark").alias("rep_mark"), F.monotonically_increasing_id().alias("cid"), "n", "f1", "f2", "size", "parity", "prefix"), "shingle-classes")
    total = every.count()
    narrow = staged(every.drop("prefix", "parity"), "documents", total)
    drop_staged(spark, every)
    known, roots = classes.withColumn("comp", F.col("cid")), None
    for done, most in zip((0, *ROUNDS), ROUNDS, strict=False):
        links = _round(docs, known, most, done, words, percent, block, keys, order)
        if roots is not None:
            links = links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = components(links)
        moved = roots.select(F.col("node.cid").alias("cid"), F.col("root.cid").alias("comp"))
        few = roots.count() <= BROADCAST_ROWS
        known = classes.join(F.broadcast(moved) if few else moved, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    root = roots.select(F.col("node.cid").alias("cid"), F.col("root.rep").alias("component_id"))
    told = classes.join(root, "cid", "left").select("n", "f1", "f2", "size", "rep", "rep_mark", "component_id")
    told = staged(told.withColumns({"first": F.col("component_id").isNull(), "component_id": F.coalesce("component_id", "rep")}), "class-components", total)
    # Rows without an id link with nothing, whatever their set.
    rows = narrow.withColumn("f1", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("f1")))
    alone = F.col("rep").isNull()
    stays = alone | (F.col("first") & (F.col("id") == F.col("rep")) & (F.col("mark") == F.col("rep_mark")))
    joined = split_join(rows, told, ["n", "f1", "f2"], "size", total, "left")
    return joined.select("id", "mark", F.col("n").cast("long").alias("n"), F.coalesce("component_id", "id").alias("component_id"), stays.alias("stays"))


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``df``.

    A text that is null or has no words has the empty set and links with
    nothing. Equal sets always link. Rows that share an id are documents of
    their own that share it; each row is listed. A row without an id links with
    nothing. Texts are read whole, however long. Other columns are ignored; an
    empty table gives no rows.
    """
    return near_rows(df, id_col, text_col, **more).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """``df`` with one row of each component: that of the smallest id, and of the smallest hash of the text among these.

    Rows go, not ids: a text that shares its id with a dropped one stays if it
    is no copy itself. Rows with a null or wordless text, or without an id,
    stay. All columns stay, whatever their names.
    """
    return keep_rows(df, near_rows(df, id_col, text_col, **more).select("id", "mark", "stays"), id_col, text_col)


def op4_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Shared shingles of all pairs by a join on shingles; a recursive search for the smallest id that each document reaches.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END AS s FROM w
), e AS MATERIALIZED (SELECT doc_id, len(s) AS n, hash(g) AS h, g FROM (SELECT doc_id, s, unnest(s) AS g FROM s)),
p AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.h = b.h AND a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
  HAVING 100 * count(*) >= 85 * (max(a.n) + max(b.n) - count(*))
), l AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node WHERE r.root < l.b),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY 1)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM s JOIN c ON c.node = doc_id
"""
