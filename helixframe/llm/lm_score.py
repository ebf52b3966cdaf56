"""Document scores by masked pseudo-likelihood.

A small network sees the two tokens before and the two after a place, never
the token itself, and gives the probability of every class there. A document's
score is the sum of the log-probabilities of all its tokens.

Tokens are words, whatever their ASCII case: the commonest words of the whole
corpus are classes of their own, all others fall into classes by length and
ending. A word of such a group has the probability of the group there times its
share of the group's tokens in the corpus, from the exact counts of all words.
The counts are a table that grows with the corpus: words with a large share of
all tokens, of which there can only be so many, are known to every task, all
others are joined to the tokens by shuffle.

The network has position embeddings, one tanh layer and a softmax of two
levels: first the cluster of a class, then the class within it, so that a
token costs the sum of both sizes and not their product. It is trained in
numpy. Texts are turned into class numbers once. Documents are dealt by the
hash of their text into shards of about ``SHARD`` tokens, as many as the corpus
fills; each shard takes mini-batch steps over all its tokens in a fixed order,
all from the same weights, which are then averaged by the number of tokens. A
second round starts from the average. So counts and training grow with the
corpus, the result doesn't depend on how the input is partitioned, and what
comes to the driver is a fixed number of weights, classes and common words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.shared import U64, Rolling, arrow_map, flat, mix, rows_by_bytes, runs, staged, tokens

#: Clusters and classes to a cluster (a power of two). Class 0 stands beyond a text's ends, then come words, then groups of other words.
CLUSTERS, MEMBERS, GROUPS, WIDTH = 32, 64, 256, 24
CLASSES = CLUSTERS * MEMBERS
SIDES = (-2, -1, 1, 2)
ROUNDS, BATCH, RATE = 2, 4096, 8.0
#: Tokens to a shard of the training, and weights to a row when they are averaged.
SHARD, CHUNK = 1 << 20, 1 << 12
#: Places of a class in a batch that are added row by row.
SHORT = 8
#: Word counts that a task holds before it hands them on.
HELD = 1 << 20
#: Words with more than one in COMMON of all tokens aren't shuffled; there are fewer than COMMON of them.
COMMON = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FOLDED = Rolling.LUT[_LOWER]


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, group of unknown words, row) of each word."""
    body, offsets = flat(column)
    start, end, row = tokens(body, offsets)
    key = Rolling(_FOLDED[body]).of(start, end) ^ mix((end - start).astype(U64))
    size = np.minimum(end - start, 16)
    group = ((_LOWER[body[end - 1]].astype(np.int64) * 31 + size) * 0x9E3779B1 >> 7) % GROUPS if len(end) else np.zeros(0, np.int64)
    return key, group, row


def word_counts(docs: DataFrame) -> DataFrame:
    """word (hash), grp, n of every word of all documents; exact."""

    def run(batches):
        parts = [(np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        held = merged = 0

        def together():
            key, group, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            keys, at, where = np.unique(key, return_index=True, return_inverse=True)
            return keys, group[at], np.bincount(where, n, len(keys)).astype(np.int64)

        def told(keys, group, n):
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(group), pa.array(n)], ["word", "grp", "n"])

        for whole in batches:
            for batch in rows_by_bytes(whole, "text"):
                key, group, _ = words(batch.column("text"))
                new, first, n = np.unique(key, return_index=True, return_counts=True)
                parts.append((new, group[first], n))
                held += len(new)
                # Sorted again only once it has doubled, so a task sorts a count a few times in all.
                if held > max(2 * merged, HELD // 4):
                    parts = [together()]
                    held = merged = len(parts[0][0])
                    if held > HELD:
                        yield told(*parts[0])
                        parts, held, merged = [tuple(x[:0] for x in parts[0])], 0, 0
        yield told(*together())

    return arrow_map(docs.select("text"), run, "word long, grp long, n long").groupBy("word").agg(F.first("grp").alias("grp"), F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, size: int = CLASSES - GROUPS - 1) -> np.ndarray:
    """Hashes of the commonest words, commonest first; the smaller hash first on ties."""
    top = counts.orderBy(F.desc("n"), "word").limit(size).collect()
    return np.array([r["word"] for r in top], np.int64).astype(U64)


class Shares:
    """What a task knows of the words in groups: each group's tokens, and the counts of common words."""

    def __init__(self, counts: DataFrame, vocab: np.ndarray, common: int = COMMON):
        self.tokens = counts.agg(F.sum("n")).first()[0] or 0
        self.least = self.tokens // common
        own = counts.sparkSession.createDataFrame([(int(w),) for w in vocab.astype(np.int64)], "word long")
        grouped = counts.join(F.broadcast(own), "word", "left_anti")
        size = np.ones(GROUPS)
        for r in grouped.groupBy("grp").agg(F.sum("n").alias("n")).collect():
            size[r["grp"]] = r["n"]
        self.size = np.log(size)
        top = grouped.where(F.col("n") > self.least).select("word", "n").toPandas()
        word = top["word"].to_numpy(np.int64).astype(U64)
        order = np.argsort(word)
        self.word, self.log = word[order], np.log(top["n"].to_numpy(np.float64)[order])
        self.rest = grouped.where(F.col("n") <= self.least).select("word", "n")


class Reader:
    """Words to classes."""

    def __init__(self, vocab: np.ndarray):
        self.order = np.argsort(vocab, kind="stable")
        self.sorted = vocab[self.order]

    def classes(self, key: np.ndarray, group: np.ndarray) -> np.ndarray:
        out = CLASSES - GROUPS + group
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, key), len(self.sorted) - 1)
            hit = self.sorted[at] == key
            out[hit] = 1 + self.order[at[hit]]
        return out.astype(np.uint16)


class Network:
    """Weights and steps; all of them in one vector, so that they can be averaged.

    ``y``: classes of texts end to end, with at least two zeros before, between
    and after them; ``at``: the places to predict.
    """

    #: Position embeddings, a class's own beside each other and its last side first; then weights of both levels, the last row of each being what is added whatever stands around.
    SHAPES = ((CLASSES, len(SIDES), WIDTH), (WIDTH + 1, CLUSTERS), (CLUSTERS, WIDTH + 1, MEMBERS))

    def __init__(self, flat_weights: np.ndarray):
        self.flat = flat_weights.astype(np.float32)
        parts, begin = [], 0
        for shape in self.SHAPES:
            n = int(np.prod(shape))
            parts.append(self.flat[begin : begin + n].reshape(shape))
            begin += n
        self.beside, self.top, self.inner = parts
        #: By side and class.
        self.embed = self.beside.transpose(1, 0, 2)[::-1]

    @classmethod
    def start(cls, seed: int = 5) -> np.ndarray:
        rng = np.random.default_rng(seed)
        embed, top, inner = (rng.normal(0, 0.1, s) for s in ((len(SIDES), CLASSES, WIDTH), *cls.SHAPES[1:]))
        top[-1] = inner[:, -1] = 0
        return np.concatenate([embed[::-1].transpose(1, 0, 2).ravel(), top.ravel(), inner.ravel()])

    def hidden(self, y: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.ones((len(at), WIDTH + 1), np.float32)
        table, rows = self.beside.reshape(-1, WIDTH), y.astype(np.int64) * len(SIDES)
        total = table.take(rows[at + SIDES[-1]], 0)
        for s in range(1, len(SIDES)):
            total += table.take(rows[at + SIDES[-1 - s]] + s, 0)
        out[:, :WIDTH] = _tanh(total)
        return out

    def bounded(self) -> bool:
        """Whether no score can be too large for an exponential: hidden values are at most 1."""
        return max(float(np.abs(self.top).sum(0).max()), float(np.abs(self.inner).sum(1).max())) < 80

    def by_cluster(self, y: np.ndarray, at: np.ndarray):
        """Places in the order of their classes' clusters, both parts of the classes, and each cluster's bounds."""
        mine = y[at]
        order = np.argsort((mine // MEMBERS).astype(np.uint8), kind="stable")
        cluster, member = np.divmod(mine[order].astype(np.int64), MEMBERS)
        return order, cluster, member, np.searchsorted(cluster, np.arange(CLUSTERS + 1)).tolist()

    def members(self, h: np.ndarray, ends: list[int]) -> np.ndarray:
        """Scores of the members of each place's cluster, end to end."""
        out = np.empty((len(h), MEMBERS), np.float32)
        for g in range(CLUSTERS):
            a, b = ends[g], ends[g + 1]
            if a < b:
                np.matmul(h[a:b], self.inner[g], out=out[a:b])
        return out

    def log_probability(self, y: np.ndarray, at: np.ndarray, bounded: bool = False) -> np.ndarray:
        order, cluster, member, ends = self.by_cluster(y, at)
        h = self.hidden(y, at[order])
        out = _log_softmax(h @ self.top, cluster, bounded) + _log_softmax(self.members(h, ends), member, bounded)
        back = np.empty_like(out)
        back[order] = out
        return back

    def step(self, y: np.ndarray, at: np.ndarray, rate: float) -> None:
        """One step on the mean loss of all places ``at``."""
        order, cluster, member, ends = self.by_cluster(y, at)
        at, bounded, scale = at[order], self.bounded(), rate / len(at)
        h = self.hidden(y, at)
        z = _residual(h @ self.top, cluster, scale, bounded)
        back = z @ self.top[:WIDTH].T
        every = _residual(self.members(h, ends), member, scale, bounded)
        inside, slope = np.empty_like(back), np.zeros_like(self.inner)
        for g in range(CLUSTERS):
            a, b = ends[g], ends[g + 1]
            if a < b:
                u = every[a:b]
                np.matmul(u, self.inner[g, :WIDTH].T, out=inside[a:b])
                np.matmul(h[a:b].T, u, out=slope[g])
        back += inside
        self.inner -= slope
        self.top -= h.T @ z
        h *= h
        back *= np.subtract(1, h[:, :WIDTH])
        # A class's place in the text tells which places saw it on which side: the two before it and the two behind.
        edge = SIDES[-1]
        seen = np.zeros((len(y) + 2 * edge, WIDTH), np.float32)
        seen[at + edge] = back
        places = np.argsort(y, kind="stable")
        who = y[places]
        first = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
        around = np.stack([places + (edge - d) for d in SIDES[::-1]], 1)
        self.beside[who[first]] -= _sums(seen, around, first).reshape(-1, len(SIDES), WIDTH)


def _tanh(x: np.ndarray) -> np.ndarray:
    """tanh in place, by an exponential; one too large for 32 bits gives 1."""
    x *= 2
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    np.divide(-2, x, out=x)
    x += 1
    return x


def _sums(rows: np.ndarray, places: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows at ``places``, or of several side by side, from each of ``first`` to the next: short runs a row of each at once, long ones as products."""
    held = rows.take(places, 0).reshape(len(places), -1)
    ends = np.append(first[1:], len(places))
    sizes = ends - first
    out = held[first]
    for k in range(1, SHORT):
        more = np.flatnonzero((sizes > k) & (sizes <= SHORT))
        out[more] += held[first[more] + k]
    ones, long = np.ones(int(sizes.max(initial=0)), np.float32), np.flatnonzero(sizes > SHORT)
    for i, a, b in zip(long.tolist(), first[long].tolist(), ends[long].tolist(), strict=True):
        np.dot(ones[: b - a], held[a:b], out=out[i])
    return out


def _log_softmax(z: np.ndarray, target: np.ndarray, bounded: bool) -> np.ndarray:
    if not bounded:
        z -= z.max(1, keepdims=True)
    mine = z.reshape(-1)[np.arange(0, z.size, z.shape[1]) + target]
    return mine - np.log(_row_sums(np.exp(z, out=z)))


def _row_sums(z: np.ndarray) -> np.ndarray:
    return z @ np.ones(z.shape[1], np.float32)


def _residual(z: np.ndarray, target: np.ndarray, scale: float, bounded: bool) -> np.ndarray:
    """``scale`` times the slope of the summed losses by the scores ``z``: softmax less the target."""
    if not bounded:
        z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z *= (scale / _row_sums(z))[:, None]
    z.reshape(-1)[np.arange(0, z.size, z.shape[1]) + target] -= np.float32(scale)
    return z


def spaced(classes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Classes of texts end to end with two zeros before, between and after them."""
    edge = SIDES[-1]
    out = np.zeros(len(classes) + edge * (len(sizes) + 1), np.uint16)
    out[np.arange(len(classes)) + np.repeat(edge * np.arange(1, len(sizes) + 1), sizes)] = classes
    return out


def batches_of(y: np.ndarray, size: int = BATCH):
    """(part of y, its places) for each batch; every place with a class once."""
    at, edge = np.flatnonzero(y), SIDES[-1]
    for k in range(0, len(at), size):
        some = at[k : k + size]
        low = some[0] - edge
        yield y[low : some[-1] + edge + 1], some - low


@dataclass
class Model:
    vocab: np.ndarray
    weights: np.ndarray
    shares: Shares


CODED = "doc_id long, mark long, uid long, n_tokens long, part double, classes binary, words array<long>"


def coded(df: DataFrame, vocab: np.ndarray, shares: Shares, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row's classes (two bytes a token), what its common grouped words add to its score, and its other grouped words."""
    size, known, logs = shares.size, shares.word, shares.log

    def run(batches):
        reader, uid = Reader(vocab), TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in rows_by_bytes(whole, "text"):
                m = batch.num_rows
                key, group, row = words(batch.column("text"))
                y = reader.classes(key, group)
                rare, each = y >= CLASSES - GROUPS, np.zeros(len(y))
                each[rare] = -size[group[rare]]
                if len(known):
                    grouped = np.flatnonzero(rare)
                    at = np.minimum(np.searchsorted(known, key[grouped]), len(known) - 1)
                    held = known[at] == key[grouped]
                    each[grouped[held]] += logs[at[held]]
                    rare[grouped[held]] = False
                n = np.bincount(row, minlength=m)
                bounds = np.r_[0, np.cumsum(n)].astype(np.int32)
                ends = np.r_[0, np.cumsum(np.bincount(row[rare], minlength=m))].astype(np.int32)
                left = pa.ListArray.from_arrays(pa.array(ends), pa.array(key[rare].astype(np.int64)))
                binary = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(bounds * 2), pa.py_buffer(y.tobytes())])
                columns = [batch.column("id"), batch.column("mark"), pa.array(uid + np.arange(m)), pa.array(n), pa.array(np.bincount(row, each, m)), binary, left]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in CODED.split(", ")])
                uid += m

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))
    return arrow_map(rows, run, CODED)


def _classes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    body, offsets = flat(column)
    return body.view(np.uint16), np.diff(offsets) // 2


def _trained_once(dealt: DataFrame, weights: np.ndarray, rate: float) -> np.ndarray:
    """The average of all shards' weights, by their tokens."""

    def train(batches):
        total, tokens_ = np.zeros(len(weights)), 0
        for table, bounds in runs(batches, ["shard"]):
            column = table.column("classes").combine_chunks()
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                net = Network(weights)
                y = spaced(*_classes((column if isinstance(column, pa.Array) else column.chunk(0)).slice(s, e - s)))
                for part, at in batches_of(y):
                    net.step(part, at, rate)
                seen = int(np.count_nonzero(y))
                total += net.flat * float(seen)
                tokens_ += seen
        if tokens_:
            cuts = range(0, len(total), CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cuts)), pa.int32()), pa.array([total[k : k + CHUNK].tobytes() for k in cuts], pa.binary()), pa.array([tokens_] * len(cuts), pa.int64())], ["chunk", "total", "seen"])

    def average(batches):
        for table, bounds in runs(batches, ["chunk"]):
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                some = table.slice(s, e - s)
                rows = [np.frombuffer(x, np.float64) for x in some.column("total").to_pylist()]
                seen = int(np.sum(some.column("seen").to_numpy()))
                yield pa.RecordBatch.from_arrays([some.column("chunk").slice(0, 1).combine_chunks(), pa.array([(np.sum(rows, 0) / seen).tobytes()], pa.binary())], ["chunk", "mean"])

    told = arrow_map(dealt, train, "chunk int, total binary, seen long")
    told = told.repartition("chunk").sortWithinPartitions("chunk")
    mean = arrow_map(told, average, "chunk int, mean binary").orderBy("chunk").collect()
    return np.round(np.concatenate([np.frombuffer(r["mean"], np.float64) for r in mean]), 7) if mean else weights


def trained(texts: DataFrame, total: int, rounds: int = ROUNDS, shard: int = SHARD) -> np.ndarray:
    """Weights learnt from all tokens of the ``coded`` texts, ``total`` of them; the same for any partitioning."""
    weights, shards = Network.start(), max(1, -(-total // shard))
    # By text and id: the copies of a text, however many, are dealt over all shards.
    dealt = texts.where("n_tokens > 0").select(F.pmod(F.xxhash64("mark", "doc_id"), F.lit(shards)).alias("shard"), "mark", "classes")
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "mark").select("shard", "classes")
    for r in range(rounds):
        weights = _trained_once(dealt, weights, RATE / (1 + r))
    return weights


def _scored(texts: DataFrame, weights: np.ndarray, rest: DataFrame) -> DataFrame:
    def run(batches):
        net = Network(weights)
        bounded = net.bounded()
        for whole in batches:
            for batch in rows_by_bytes(whole, "classes"):
                y, sizes = _classes(batch.column("classes"))
                each = np.zeros(len(y))
                at = 0
                for part, places in batches_of(spaced(y, sizes)):
                    each[at : at + len(places)] = net.log_probability(part, places, bounded)
                    at += len(places)
                total = np.bincount(np.repeat(np.arange(len(sizes)), sizes), each, len(sizes))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("uid"), batch.column("n_tokens"), pa.array(total + batch.column("part").to_numpy())], ["doc_id", "uid", "n_tokens", "part"])

    parts = arrow_map(texts.select("doc_id", "uid", "n_tokens", "part", "classes"), run, "doc_id long, uid long, n_tokens long, part double")
    tail = texts.select("uid", F.explode("words").alias("word")).join(rest, "word").groupBy("uid").agg(F.sum(F.log("n")).alias("more"))
    total = F.round(F.col("part") + F.coalesce("more", F.lit(0.0)), 4)
    mean = F.when(F.col("n_tokens") > 0, F.round(F.col("log_likelihood") / F.col("n_tokens"), 6))
    return parts.join(tail, "uid", "left").select("doc_id", "n_tokens", total.alias("log_likelihood")).withColumn("mean_log_likelihood", mean)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, common: int = COMMON) -> tuple[Model, DataFrame]:
    """The model of all texts of ``docs``, and the texts as the model codes them."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counts = staged(word_counts(rows), "word-counts")
    vocab = vocabulary(counts)
    shares = Shares(counts, vocab, common)
    texts = staged(coded(rows, vocab, shares), "coded")
    return Model(vocab, trained(texts, shares.tokens, rounds), shares), texts


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, log_likelihood (the sum) and mean_log_likelihood of each row.

    A text that is null or has no words has no tokens, the sum 0 and a null
    mean. A grouped word that the model hasn't counted counts as seen once.
    Rows that repeat are each scored, equal texts alike; texts are read whole;
    other columns are ignored; an empty table gives no rows.
    """
    return _scored(staged(coded(df, model.vocab, model.shares, id_col, text_col), "coded"), model.weights, model.shares.rest)


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """As ``score``, by a model of the very same texts, which are coded once."""
    model, texts = fit(docs, id_col, text_col, rounds)
    return _scored(texts, model.weights, model.shares.rest)


def op7_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"))
