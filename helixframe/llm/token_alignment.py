"""Links between the tokens of two tokenizers over the same bytes.

1. One pass encodes each text with both tokenizers and marks the bytes where
   tokens end in two packed bitsets. Their AND holds the shared cuts, which
   group the tokens; counts of set bits before a byte (a running sum over words
   of 64 bits) turn cuts into token ranges.
2. Their OR holds one bit for each pair of overlapping tokens: such a pair
   shares exactly one stretch between neighbouring bits. The same ranks give
   both tokens of each, so links are listed without looking at pairs that don't
   overlap. Links are written as numbers of id pairs within a block of texts
   (the commonest first, so that they compress), beside the block's pairs and
   how many links each has there. Texts and ids never shuffle.
3. Block counts are summed over the corpus. A pair asks once a block, however
   often it occurs there, and pairs that very many blocks hold are dealt over
   parts. The answers go back to their blocks, where each document looks up its links.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helixframe.llm.byte_bpe import Encoder, byte_chars, public_path, within
from helixframe.llm.sentence_pieces import BYTE, MARK, Codec
from helixframe.llm.shared import arrow_map, drop_staged, flat, rows_by_bytes, split_join, staged, table

A_NAME, B_NAME = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text to a block; a text is never cut.
BLOCK_BYTES = 2 << 20
#: A pair's key is its A id times this plus its B id.
STRIDE = 1 << 16


def a_encoder(path: str) -> Encoder:
    """An encoder that takes special tokens' strings for plain text."""
    out = Encoder(path, 1 << 19)
    out.tok = Tokenizer.from_file(path)
    out.tok.encode_special_tokens = True
    out.special = []
    return out


def a_bytes(tok: Tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    back = {c: b for b, c in byte_chars().items()}
    vocab = tok.get_vocab()
    out = [b""] * (1 + max(vocab.values()))
    for piece, i in vocab.items():
        out[i] = bytes(back[c] for c in piece) if all(c in back for c in piece) else piece.encode()
    return out


def b_bytes(pieces: list[str], kinds: list[int]) -> list[bytes]:
    """The bytes of each piece: the marker is a blank, byte pieces are their byte."""
    return [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, k in zip(pieces, kinds, strict=True)]


class Pool:
    """Byte strings end to end, to be gathered by number."""

    def __init__(self, items: list[bytes]):
        self.size = np.array([len(x) for x in items], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.body = np.frombuffer(b"".join(items) or b"\0", np.uint8)

    def gather(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        return self.body[np.repeat(self.begin[ids], size) + within(size)]


class Bits:
    """A packed bitset over bytes with ranks: ``before(i)`` is how many bits are set below ``i``."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.sums = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)]

    @classmethod
    def at(cls, places: np.ndarray, n: int) -> Bits:
        marks = np.zeros(-(-(n + 1) // 64) * 64, bool)
        marks[places] = True
        return cls(np.packbits(marks, bitorder="little").view("<u8"))

    def before(self, i: np.ndarray) -> np.ndarray:
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.sums[word] + np.bitwise_count(below)

    def places(self) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def __or__(self, other: Bits) -> Bits:
        return Bits(self.words | other.words)


def ends_of(sizes: np.ndarray) -> np.ndarray:
    """The last byte of each token of tokens end to end."""
    return np.cumsum(sizes) - 1


def _counted(bits: Bits, rows: np.ndarray) -> np.ndarray:
    """Bits set in each row, from the rows' byte bounds."""
    below = bits.before(rows)
    return below[1:] - below[:-1]


class Aligner:
    """Both encoders with their tokens' bytes."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = a_encoder(a_path), Codec(b_path, 1, 1 << 19)
        self.a_pool = Pool(a_bytes(self.a.tok))
        self.b_pool = Pool(b_bytes(self.b.model.pieces, self.b.model.kinds))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and row bounds of A and B; rows without a text, or whose tokens don't spell it, have none."""
        led = pc.binary_join_element_wise(pa.scalar(" ", column.type), column.fill_null(""), pa.scalar("", column.type))
        a, a_rows = self.a.encode(led)
        b, b_rows = self.b.encode(column)
        body, offsets = flat(led)
        good = np.diff(offsets) > 1
        for ids, bounds, pool in ((a, a_rows, self.a_pool), (b, b_rows, self.b_pool)):
            ends = np.r_[0, np.cumsum(pool.size[ids])][bounds]
            good &= np.diff(ends) == np.diff(offsets)
            spelt = pool.gather(ids)
            # Rows of the right size are compared byte by byte.
            ok = np.flatnonzero(good)
            size = np.diff(offsets)[ok]
            inside = within(size)
            same = spelt[np.repeat(ends[:-1][ok], size) + inside] == body[np.repeat(offsets[:-1][ok], size) + inside]
            good[ok] = np.logical_and.reduceat(same, np.cumsum(size) - size) if len(ok) else True
        out = []
        for ids, bounds in ((a, a_rows), (b, b_rows)):
            size = np.where(good, np.diff(bounds), 0)
            out += [ids[np.repeat(good, np.diff(bounds))].astype(np.uint16), np.r_[0, np.cumsum(size)]]
        return tuple(out)

    def bits(self, a: np.ndarray, b: np.ndarray) -> tuple[Bits, Bits]:
        """The bitsets of the last bytes of A and B tokens; both cover the same bytes."""
        a_ends, b_ends = ends_of(self.a_pool.size[a]), ends_of(self.b_pool.size[b])
        n = int(a_ends[-1]) + 1 if len(a_ends) else 0
        return Bits.at(a_ends, n), Bits.at(b_ends, n)

    def row_bounds(self, a: np.ndarray, a_rows: np.ndarray) -> np.ndarray:
        """Each row's bytes among those of all tokens."""
        return np.r_[0, np.cumsum(self.a_pool.size[a])][a_rows]

    def links(self, a: np.ndarray, b: np.ndarray, bits: tuple[Bits, Bits]) -> np.ndarray:
        """The id pair of each link, in text order."""
        at = (bits[0] | bits[1]).places()
        return a[bits[0].before(at)].astype(np.int64) * STRIDE + b[bits[1].before(at)]


DIGITS = np.zeros((STRIDE, 6), np.uint8)
DIGIT_SIZE = np.zeros(STRIDE, np.int64)
for _n in range(5):
    _from, _to = 10**_n if _n else 0, min(10 ** (_n + 1), STRIDE)
    for _k in range(_n + 1):
        DIGITS[_from:_to, _k] = 48 + np.arange(_from, _to) // 10 ** (_n - _k) % 10
    DIGIT_SIZE[_from:_to] = _n + 1


def spelled(a: np.ndarray, b: np.ndarray, a_upto: np.ndarray, b_upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups as ``a1,a2|b1;...`` end to end, and where each group ends.

    ``a_upto``, ``b_upto``: tokens up to the end of each group.
    """
    a_size, b_size = np.diff(np.r_[0, a_upto]), np.diff(np.r_[0, b_upto])
    group = np.arange(len(a_upto))
    a_at = np.arange(len(a)) + np.repeat(b_upto - b_size, a_size)
    b_at = np.arange(len(b)) + np.repeat(a_upto, b_size)
    ids = np.zeros(len(a) + len(b), np.uint16)
    ids[a_at], ids[b_at] = a, b
    after = np.full(len(ids), ord(","), np.uint8)
    after[a_at[a_upto - 1]], after[b_at[b_upto - 1]] = ord("|"), ord(";")
    size = DIGIT_SIZE[ids]
    grid = DIGITS[ids]
    grid[np.arange(len(ids)), size] = after
    body = grid[np.arange(6) <= size[:, None]]
    return body, np.cumsum(size + 1)[b_at[b_upto - 1]] if len(group) else np.zeros(0, np.int64)


ENCODED = "id long, block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, pairs array<long>, counts array<long>"


def packed_numbers(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Each row's numbers as four planes of bytes, compressed."""
    out = []
    for s, e in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
        raw = np.ascontiguousarray(values[s:e].astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
        out.append(pa.compress(raw, "zstd", asbytes=True) if raw else b"")
    return out


def unpacked_numbers(blobs: list[bytes], sizes: np.ndarray) -> np.ndarray:
    out = [np.frombuffer(pa.decompress(x, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel() for x, n in zip(blobs, sizes.tolist(), strict=True) if n]
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def encoded(df: DataFrame, id_col: str, text_col: str, a_path: str, b_path: str) -> DataFrame:
    """What a text's own tokens tell, and its links by their number among the pairs of its block; a block's first row has its pairs."""

    def run(batches):
        aligner, block = Aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in rows_by_bytes(whole, "text", BLOCK_BYTES):
                a, a_rows, b, b_rows = aligner.encode(batch.column("text"))
                bits, rows = aligner.bits(a, b), aligner.row_bounds(a, a_rows)
                both = bits[0] & bits[1]
                cuts = both.places()
                groups = _counted(both, rows)
                body, upto = spelled(a, b, bits[0].before(cuts + 1), bits[1].before(cuts + 1))
                # A row's groups without its last separator.
                ends = np.r_[0, upto][np.cumsum(groups)]
                begins, raw = np.r_[0, ends[:-1]], body.tobytes()
                sha = [hashlib.sha256(raw[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(begins.tolist(), ends.tolist(), strict=True)]
                links = _counted(bits[0] | bits[1], rows)
                keys, which, n = np.unique(aligner.links(a, b, bits), return_inverse=True, return_counts=True)
                order = np.argsort(-n, kind="stable")
                number = np.zeros(len(order), np.uint32)
                number[order] = np.arange(len(order))
                blobs = packed_numbers(number[which], np.r_[0, np.cumsum(links)])
                first = [None] * (batch.num_rows - 1)
                counts = [np.diff(a_rows), np.diff(b_rows), groups, links]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"),
                        pa.array(np.full(batch.num_rows, block)),
                        *(pa.array(c.astype(np.int64)) for c in counts),
                        pa.array(sha, pa.string()),
                        pa.array(blobs, pa.binary()),
                        pa.array([keys[order], *first], pa.list_(pa.int64())),
                        pa.array([n[order].astype(np.int64), *first], pa.list_(pa.int64())),
                    ],
                    [x.split()[0] for x in ENCODED.split(", ")],
                )
                block += 1

    return arrow_map(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, ENCODED)


def pair_counts(asked: DataFrame) -> DataFrame:
    """(pair, count, best, asks) of all id pairs: corpus-wide links, whether no other A id has more with the same B id, and rows of ``asked``."""
    sums = staged(asked.groupBy("pair").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("asks")), "pair-counts")
    b_id = F.pmod("pair", F.lit(STRIDE))
    top = sums.groupBy(b_id.alias("b_id")).agg(F.max("count").alias("top"))
    # One row a B id: as many as its vocabulary has at most.
    return sums.join(F.broadcast(top), b_id == F.col("b_id")).select("pair", "count", (F.col("count") == F.col("top")).alias("best"), "asks")


REPORT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Tokens, groups and links of each row of ``df``, and how its links' id pairs rank over the corpus.

    A text has no tokens if it is null or empty, or if the tokens of either
    tokenizer don't spell a blank and the text (a text with U+2581 in it, say):
    zeros and an empty digest. Whole texts; rows that repeat are each counted,
    null ids stay null, ties for the highest count are all best, other columns
    are ignored, an empty table gives no rows.
    """
    a_path, b_path = a_path or public_path(A_NAME), b_path or public_path(B_NAME)
    rows = staged(encoded(df, id_col, text_col, a_path, b_path), "encoded")
    asked = rows.select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("at", "p")).select("block", "at", "p.pairs", "p.counts").toDF("block", "at", "pair", "n")
    asked = staged(asked, "block-pairs")
    told = staged(split_join(asked.select("block", "at", "pair"), pair_counts(asked), ["pair"], "asks", asked.count()).select("block", "at", "count", "best"), "pair-answers")
    drop_staged(df.sparkSession, asked)

    def look_up(mine: pa.Table, answers: pa.Table) -> pa.Table:
        links = mine.column("n_links").to_numpy()
        number = unpacked_numbers(mine.column("links").to_pylist(), links)
        at, ends, add = answers.column("at").to_numpy(), np.r_[0, np.cumsum(links)], []
        for name in ("best", "count"):
            told = np.zeros(len(at), np.int64)
            told[at] = answers.column(name).to_numpy()
            sums = np.r_[0, np.cumsum(told[number])][ends]
            add.append(pa.array(sums[1:] - sums[:-1]))
        have = [mine.column(c) for c in ("id", "n_a", "n_b", "n_groups", "n_links")]
        return pa.Table.from_arrays([*have, *add, mine.column("groups_sha256")], [x.split()[0] for x in REPORT.split(", ")])

    return rows.drop("pairs", "counts").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(look_up, REPORT)


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    return align(table(spark, sf_dir, "documents"))
