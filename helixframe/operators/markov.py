"""Proposals from a Markov model of a pool: left to right, two-sided, and guided by a scorer.

A model has the counts of what follows each context of up to ``order`` bases;
it is a fixed number of figures, summed over the pool by map-side counts. A
batch of rows is drawn at once: places one after the other, rows side by side.
Every draw is a word of md5(seed:stream:pid:branch:step:round:place / 4), so
results don't depend on partitions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from helixframe.functions import digests
from helixframe.functions import sequence as S
from helixframe.operators.mutagenesis import WindowScorer
from helixframe.operators.profiles import kmer_counts

#: Rows drawn together.
ROWS = 1024
#: The counts of a context add up to less, so that a draw times them fits 64 bits.
MOST = 1 << 31
DRAWN = StructType([StructField("seq", StringType()), StructField("log_p", DoubleType()), StructField("log_ratio", DoubleType())])


class MarkovModel:
    """Contexts of 0 to ``order`` bases, numbered by length, then as base-4 numbers; one is added to every count."""

    def __init__(self, counts: dict[str, int], order: int):
        self.order = order
        full = np.zeros(4 ** (order + 1), np.int64)
        for kmer, n in counts.items():
            full[sum(S.BASES.index(b) * 4 ** (order - i) for i, b in enumerate(kmer))] = n
        # What follows a shorter context: the same k-mers without their first bases.
        tables = [full.reshape(4 ** (order - k), 4**k, 4).sum(0) for k in range(order + 1)]
        table = np.concatenate(tables)
        while int(table.sum(1).max()) + 4 >= MOST:
            table //= 2
        self.upto = np.cumsum(table + 1, axis=1)
        self.p = (table + 1) / self.upto[:, 3:]
        begin = np.array([(4**k - 1) // 3 for k in range(order + 2)])
        self.next = np.zeros((len(table), 4), np.int64)
        for k in range(order + 1):
            number = np.arange(4**k)[:, None] * 4 + np.arange(4)
            self.next[begin[k] : begin[k + 1]] = begin[k + 1] + number if k < order else begin[k] + number % 4**k

    @staticmethod
    def of(pool: DataFrame, order: int = 2, seq: str = "seq") -> MarkovModel:
        """From a pool of sequences: at most 4^(order + 1) rows come to the driver."""
        if not 0 <= order <= 6:
            raise ValueError("an order from 0 to 6")
        return MarkovModel({r["kmer"]: r["n"] for r in kmer_counts(pool, seq, order + 1, []).collect()}, order)

    def contexts(self, codes: np.ndarray) -> np.ndarray:
        """The context before each place of a matrix of codes."""
        out, at = np.zeros(codes.shape, np.int64), np.zeros(len(codes), np.int64)
        for i in range(codes.shape[1]):
            out[:, i] = at
            at = self.next[at, codes[:, i]]
        return out

    def drawn(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The base that a 32-bit word picks after a context, in whole numbers."""
        upto = self.upto[context]
        r = (word * upto[:, 3]) >> 32
        return (r[:, None] >= upto[:, :3]).sum(1)


def words(keys: list[str], n: int) -> np.ndarray:
    """n 32-bit words for each key, four of a digest."""
    blocks = -(-n // 4)
    every = digests.every([f"{k}:".encode() for k in keys], [str(b).encode() for b in range(blocks)], 4)
    return every.reshape(len(keys), blocks * 4)[:, :n].astype(np.int64)


@dataclass
class _Draw:
    """A block of rows of one length: its codes, which places are masked, and a word a place."""

    codes: np.ndarray
    mask: np.ndarray
    word: np.ndarray


def left_to_right(model: MarkovModel, d: _Draw) -> tuple[np.ndarray, np.ndarray]:
    """Masked places drawn from what precedes them, new bases included; the log-probability of all that was drawn."""
    codes, log_p, at = d.codes.copy(), np.zeros(len(d.codes)), np.zeros(len(d.codes), np.int64)
    for i in range(codes.shape[1]):
        here = np.flatnonzero(d.mask[:, i])
        if len(here):
            base = model.drawn(at[here], d.word[here, i])
            log_p[here] += np.log(model.p[at[here], base])
            codes[here, i] = base
        at = model.next[at, codes[:, i]]
    return codes, log_p


def two_sided(model: MarkovModel, d: _Draw) -> tuple[np.ndarray, np.ndarray]:
    """Masked places drawn from their joint distribution given all others: a backward pass, then draws from left to right."""
    rows, length = d.codes.shape
    allowed = d.mask[:, :, None] | (d.codes[:, :, None] == np.arange(4))
    after = np.ones((length + 1, rows, len(model.p)))
    for i in reversed(range(length)):
        step = (after[i + 1][:, model.next] * model.p * allowed[:, i, None, :]).sum(2)
        after[i] = step / step.max(1, keepdims=True)
    codes, log_p, at = d.codes.copy(), np.zeros(rows), np.zeros(rows, np.int64)
    every = np.arange(rows)
    for i in range(length):
        weight = allowed[:, i] * model.p[at] * after[i + 1][every[:, None], model.next[at]]
        upto = np.cumsum(weight, 1)
        base = (d.word[:, i, None] / 2.0**32 * upto[:, 3:] >= upto[:, :3]).sum(1)
        base = np.where(d.mask[:, i], base, codes[:, i])
        log_p += np.where(d.mask[:, i], np.log(weight[every, base] / upto[:, 3]), 0.0)
        codes[:, i], at = base, model.next[at, base]
    return codes, log_p


def neighbourly(model: MarkovModel, codes: np.ndarray) -> np.ndarray:
    """(rows, places, 4): the model's distribution of each place, all other places being what they are."""
    rows, length = codes.shape
    context = model.contexts(codes)
    out = np.log(model.p)[context]
    for j in range(1, model.order + 1):
        n = length - j
        if n <= 0:
            break
        change = (np.arange(4) - codes[:, :n, None]) * 4 ** (j - 1)
        # Only the base at the place changes: contexts stay as long as they are.
        out[:, :n] += np.log(model.p)[context[:, j:, None] + change, codes[:, j:, None]]
    out -= out.max(2, keepdims=True)
    p = np.exp(out)
    return p / p.sum(2, keepdims=True)


def tilted(base: np.ndarray, gain: np.ndarray, row: np.ndarray, rows: int, budget: float, most: float = 1e3, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(distributions, strength of each row): ``base`` tilted by exp(strength gain), as strong as the row's KL budget allows.

    ``base``, ``gain``: a line a masked place; ``row``: whose it is. A row's
    divergence is the sum over its places.
    """
    gain = gain - gain.max(1, keepdims=True)
    log_base = np.log(base)

    def at(strength: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lift = strength[row, None] * gain
        lines = log_base + lift
        top = lines.max(1, keepdims=True)
        q = np.exp(lines - top)
        whole = q.sum(1, keepdims=True)
        q /= whole
        # log q - log base is the lift less the log of the norm; what is lifted to nothing has q = 0.
        kl = (q * lift).sum(1) - (top + np.log(whole))[:, 0]
        return q, np.bincount(row, kl, rows)

    low, high = np.zeros(rows), np.full(rows, most)
    low = np.where(at(high)[1] <= budget, high, low)
    for _ in range(rounds):
        middle = (low + high) / 2
        fits = at(middle)[1] <= budget
        low, high = np.where(fits, middle, low), np.where(fits, high, middle)
    return at(low)[0], low


def guided(model: MarkovModel, d: _Draw, scorer: WindowScorer, budget: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Masked places drawn from the model's distributions tilted towards the scorer; also the sum of log model - log tilted."""
    rows = len(d.codes)
    row, place = np.nonzero(d.mask)
    base, gain = neighbourly(model, d.codes)[row, place], scorer.gains(d.codes)[row, place] * scorer.scale
    q, _ = tilted(base, gain, row, rows, budget)
    upto = np.cumsum(q, 1)
    pick = (d.word[row, place, None] / 2.0**32 * upto[:, 3:] >= upto[:, :3]).sum(1)
    codes, every = d.codes.copy(), np.arange(len(row))
    codes[row, place] = pick
    log_q, log_b = np.log(q[every, pick]), np.log(base[every, pick])
    return codes, np.bincount(row, log_q, rows), np.bincount(row, log_b - log_q, rows)


@dataclass
class MarkovProposal:
    """Branches whose masked places are drawn anew from a model of a pool.

    ``rate``: the chance of a place to be masked. ``how``: ``left`` (each place
    from what precedes it), ``both`` (jointly from both sides) or ``guided``
    (both sides, tilted by ``scorer`` up to ``budget`` nats of divergence a row).
    ``rounds`` rounds of masking follow each other. Adds ``log_p``, the
    log-probability of the drawn bases, and ``log_ratio``, the log of how much
    likelier the model's own draw was (0 unless guided), as a weight's correction.
    Null sequences stay null.
    """

    model: MarkovModel
    rate: float
    seed: int
    how: str = "left"
    rounds: int = 1
    scorer: WindowScorer | None = None
    budget: float = 1.0

    def expand(self, df: DataFrame, branches: int, step: int) -> DataFrame:
        rows = df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(branches - 1))))
        drawn = rows.withColumn("_d", self._udf(step)("seq", F.col("pid").cast("string"), F.col("k").cast("string")))
        return drawn.withColumn("seq", F.col("_d.seq")).select(*rows.columns, "_d.log_p", "_d.log_ratio")

    def _udf(self, step: int):
        me = self

        @F.arrow_udf(DRAWN)
        def draw(seq: pa.Array, pid: pa.Array, k: pa.Array) -> pa.Array:
            body, offsets = S._joined(seq)
            size = np.diff(offsets)
            keys = [f"{a}:{b}:{step}" for a, b in zip(pid.to_pylist(), k.to_pylist(), strict=True)]
            text, log_p, ratio = seq.to_pylist(), np.zeros(len(seq)), np.zeros(len(seq))
            for length in np.unique(size[size > 0]).tolist():
                same = np.flatnonzero(size == length)
                for at in range(0, len(same), ROWS):
                    part = same[at : at + ROWS]
                    codes = S._CODES[body[offsets[part][:, None] + np.arange(length)]].astype(np.int64)
                    for r in range(me.rounds):
                        codes, p, q = me.drawn(codes, [f"{keys[i]}:{r}" for i in part.tolist()])
                        log_p[part] += p
                        ratio[part] += q
                    letters = np.frombuffer(S.BASES.encode(), np.uint8)[codes]
                    for i, s in zip(part.tolist(), letters, strict=True):
                        text[i] = s.tobytes().decode()
            return pa.StructArray.from_arrays([pa.array(text, pa.string()), pa.array(log_p), pa.array(ratio)], ["seq", "log_p", "log_ratio"])

        return draw

    def drawn(self, codes: np.ndarray, keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        length = codes.shape[1]
        mask = words([f"{self.seed}:mask:{k}" for k in keys], length) / 2.0**32 < self.rate
        d = _Draw(codes, mask, words([f"{self.seed}:base:{k}" for k in keys], length))
        if self.how == "guided":
            return guided(self.model, d, self.scorer, self.budget)
        codes, log_p = (left_to_right if self.how == "left" else two_sided)(self.model, d)
        return codes, log_p, np.zeros(len(codes))
