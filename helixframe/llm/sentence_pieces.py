"""SentencePiece encoding and decoding through the tokenizers library.

The model's protobuf is read field by field. Its normaliser, the metaspace
marker with the leading blank, the pieces with their scores (unigram), or the
merges that the scores imply (BPE), and the byte fallback are rebuilt as a
tokenizers pipeline. ``verify`` compares it with the sentencepiece library.

If no piece of the vocabulary goes on with the marker after another character,
a text's ids are those of its units (blanks and the word after them) end to
end. Units are found with numpy; those not met before are encoded by the
library in one multithreaded batch.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from tokenizers import Regex, Tokenizer, decoders, models, normalizers

from helixframe.llm.byte_bpe import public_path, within
from helixframe.llm.shared import U64, Rolling, arrow_map, flat, mix, rows_by_bytes

MARK = "▁"
NORMAL, UNK, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
        if byte < 128:
            return value, at


def protobuf_fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value): integers, or bytes for fixed and length-delimited values."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(raw, at)
        else:
            size = {1: 8, 5: 4}.get(wire)
            if wire == 2:
                size, at = _varint(raw, at)
            elif size is None:
                raise ValueError(f"protobuf wire type {wire}")
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


@dataclass
class Model:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    model_type: int = 1
    byte_fallback: bool = False
    unk: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    suffix_marker: bool = False


def parse(raw: bytes) -> Model:
    out = Model()
    for number, value in protobuf_fields(raw):
        if number == 1:
            got = dict(protobuf_fields(value))
            out.pieces.append(got[1].decode())
            out.scores.append(struct.unpack("<f", got[2])[0] if 2 in got else 0.0)
            out.kinds.append(got.get(3, NORMAL))
        elif number == 2:
            got = dict(protobuf_fields(value))
            out.model_type, out.unk = got.get(3, 1), got.get(40, 0)
            out.byte_fallback, out.suffix_marker = bool(got.get(35, 0)), bool(got.get(24, 0))
        elif number == 3:
            got = dict(protobuf_fields(value))
            out.charsmap = got.get(2, b"")
            out.dummy_prefix, out.squeeze, out.escape = bool(got.get(3, 1)), bool(got.get(4, 1)), bool(got.get(5, 1))
    return out


def merges(model: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that join to a piece, best score of the joined piece first."""
    known = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k in (NORMAL, USER)}
    out = []
    for piece, i in known.items():
        for k in range(1, len(piece)):
            if piece[:k] in known and piece[k:] in known:
                out.append((-model.scores[i], known[piece[:k]], known[piece[k:]], piece[:k], piece[k:]))
    out.sort()
    return [x[3:] for x in out]


def _lattice(model: Model) -> list[tuple[str, float]]:
    """Pieces and scores of a unigram model; what no text may match is renamed, or worth less than any way round it."""
    out = []
    for i, (piece, score, kind) in enumerate(zip(model.pieces, model.scores, model.kinds, strict=True)):
        if kind in (CONTROL, UNK, UNUSED):
            piece, score = f"\U0010fffd{i}\U0010fffd", 0.0
        elif kind == BYTE:  # the library finds these by their name, so that stays
            score = -1e6
        out.append((piece, score))
    return out


def build(model: Model) -> tuple[Tokenizer, Tokenizer]:
    """(tokenizer of whole texts, tokenizer of units that are already normalised)."""
    if model.suffix_marker or not model.escape:
        raise ValueError("models with a trailing marker or unescaped blanks aren't supported")
    if USER in model.kinds:
        raise ValueError("models with user-defined pieces aren't supported")
    if model.model_type == 1:
        def core():
            return models.Unigram(_lattice(model), model.unk, model.byte_fallback)
    elif model.model_type == 2:
        vocab, pairs = {p: i for i, p in enumerate(model.pieces)}, merges(model)

        def core():
            return models.BPE(vocab, pairs, unk_token=model.pieces[model.unk], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.model_type} isn't supported")
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    steps.append(normalizers.Replace(" ", MARK))
    whole, unit = Tokenizer(core()), Tokenizer(core())
    whole.normalizer = normalizers.Sequence(steps)
    back = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    whole.decoder = decoders.Sequence([*back, decoders.Strip(" ", 1, 0)] if model.dummy_prefix else back)
    return whole, unit


def splits_at_marks(model: Model) -> bool:
    """Whether no piece has the marker after another character, and normalising leaves texts as they are."""
    if model.charsmap or model.squeeze or not model.dummy_prefix:
        return False
    return not any(a != MARK and b == MARK for p, k in zip(model.pieces, model.kinds, strict=True) if k in (NORMAL, USER) for a, b in zip(p, p[1:], strict=False))


@lru_cache(2)
def load(path: str, threads: int) -> tuple[Model, Tokenizer, Tokenizer]:
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
    with open(path, "rb") as f:
        model = parse(f.read())
    return model, *build(model)


def verify(path: str, texts: list[str]) -> list[str]:
    """The texts whose ids or decoding differ from the sentencepiece library's."""
    import sentencepiece

    ours, theirs = Codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    ids, bounds = ours.encode(pa.array(texts, pa.string()))
    out = []
    for i, text in enumerate(texts):
        got = ids[bounds[i] : bounds[i + 1]].tolist()
        if got != theirs.encode(text) or ours.decode([got])[0] != theirs.decode(got):
            out.append(text)
    return out


class Codec:
    """Encodes and decodes batches; remembers units up to ``most`` of them, then starts anew."""

    def __init__(self, path: str, threads: int = 2, most: int = 1 << 20):
        self.model, self.whole, self.unit = load(path, threads)
        self.by_unit, self.most = splits_at_marks(self.model), most
        self.reset()

    def reset(self) -> None:
        self.keys, self.slots = np.zeros(0, U64), np.zeros(0, np.int64)
        self.begin, self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, units: list[str]) -> None:
        got = [e.ids for e in self.unit.encode_batch(units, add_special_tokens=False)]
        size = np.fromiter(map(len, got), np.int64, len(got))
        self.begin = np.r_[self.begin, len(self.pool) + np.cumsum(size) - size]
        self.size = np.r_[self.size, size]
        self.pool = np.r_[self.pool, np.fromiter((x for y in got for x in y), np.uint32, int(size.sum()))]
        keys, slots = np.r_[self.keys, keys], np.r_[self.slots, np.arange(len(self.slots), len(self.slots) + len(keys))]
        order = np.argsort(keys, kind="stable")
        self.keys, self.slots = keys[order], slots[order]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, bounds of each row); null is empty."""
        body, offsets = flat(column)
        raw = body.tobytes()
        rows = len(offsets) - 1
        if not self.by_unit:
            return self._joined([e.ids for e in self.whole.encode_batch([raw[a:b].decode() for a, b in zip(offsets, offsets[1:], strict=False)], add_special_tokens=False)])
        blank = body == 32
        cut = blank.copy()
        cut[1:] &= ~blank[:-1]
        first = offsets[:-1][np.diff(offsets) > 0]
        cut[first] = True
        start = np.flatnonzero(cut)
        end = np.r_[start[1:], len(body)]
        row = np.searchsorted(offsets, start, "right") - 1
        lead = np.zeros(len(body) + 1, bool)
        lead[first] = True
        lead = lead[start]
        key = Rolling(Rolling.LUT[body]).of(start, end) ^ mix((end - start).astype(U64) * U64(2) + lead)
        which, keys = pd.factorize(key)
        seen = np.zeros(len(keys), np.int64)
        seen[which[::-1]] = np.arange(len(key) - 1, -1, -1)
        if len(self.keys) > self.most:
            self.reset()
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        if not known.all():
            new = np.flatnonzero(~known)
            units = [("" if not lead[i] else MARK) + raw[start[i] : end[i]].decode().replace(" ", MARK) for i in seen[new]]
            self._learn(keys[new], units)
            at = np.searchsorted(self.keys, keys)
        slot = self.slots[at][which] if len(keys) else np.zeros(0, np.int64)
        size = self.size[slot]
        ids = self.pool[np.repeat(self.begin[slot], size) + within(size)]
        counts = np.bincount(row, size, rows).astype(np.int64)
        # The marker itself within a text counts as a blank: such rows go whole.
        mark, odd, pos = MARK.encode(), set(), raw.find(MARK.encode())
        while pos >= 0:
            odd.add(int(np.searchsorted(offsets, pos, "right")) - 1)
            pos = raw.find(mark, pos + 1)
        if odd:
            bounds = np.r_[0, np.cumsum(counts)]
            parts = [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(rows)]
            some = sorted(odd)
            for i, e in zip(some, self.whole.encode_batch([raw[offsets[i] : offsets[i + 1]].decode() for i in some], add_special_tokens=False), strict=True):
                parts[i] = e.ids
            return self._joined(parts)
        return ids, np.r_[0, np.cumsum(counts)]

    @staticmethod
    def _joined(parts: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.fromiter((x for y in parts for x in y), np.uint32, int(sizes.sum())), np.r_[0, np.cumsum(sizes)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts of id lists, by the library's decoder. Without byte fallback, unknown pieces stand for no text: they are refused."""
        if not self.model.byte_fallback and any(self.model.unk in x for x in ids):
            raise ValueError("ids with unknown pieces have no text")
        return self.whole.decode_batch(ids, skip_special_tokens=True)


REPORT = "doc_id long, n_tokens long, n_bytes_fallen_back long, ids_crc32 long, round_trip boolean"


def encode_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, threads: int = 2) -> DataFrame:
    """Token counts, a checksum of the ids and whether they decode to the very text, for each row.

    Null and empty texts have no ids. Rows that repeat are each encoded; texts
    are read whole; other columns are ignored; an empty table gives no rows.
    One pass, no shuffle.
    """
    path = path or public_path("piece_bpe_32k.model")

    def run(batches):
        codec = Codec(path, threads)
        is_byte = np.array(codec.model.kinds) == BYTE
        for whole in batches:
            for batch in rows_by_bytes(whole, "text"):
                ids, bounds = codec.encode(batch.column("text"))
                body, offsets = flat(batch.column("text"))
                again = codec.decode([ids[bounds[i] : bounds[i + 1]].tolist() for i in range(batch.num_rows)])
                raw, words = body.tobytes(), ids.astype("<u4").tobytes()
                n = batch.num_rows
                fallen = np.r_[0, np.cumsum(is_byte[ids])]
                same = [again[i].encode() == raw[offsets[i] : offsets[i + 1]] for i in range(n)]
                crc = [zlib.crc32(words[4 * bounds[i] : 4 * bounds[i + 1]]) for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(np.diff(bounds)), pa.array(fallen[bounds[1:]] - fallen[bounds[:-1]]), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())],
                    [x.split()[0] for x in REPORT.split(", ")],
                )

    return arrow_map(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, REPORT)


def encode(df: DataFrame, text_col: str = "text", out_col: str = "ids", path: str | None = None, threads: int = 2) -> DataFrame:
    """``df`` with the ids of a text column; null stays null. A column that is named ``out_col`` already is replaced."""
    if out_col == text_col:
        raise ValueError("ids and texts need columns of their own")
    df, path = df.drop(out_col), path or public_path("piece_bpe_32k.model")

    def run(batches):
        codec = Codec(path, threads)
        for whole in batches:
            for batch in rows_by_bytes(whole, text_col):
                ids, bounds = codec.encode(batch.column(text_col))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)), mask=batch.column(text_col).is_null())
                yield batch.append_column(out_col, lists)

    return arrow_map(df, run, StructType([*df.schema.fields, StructField(out_col, ArrayType(IntegerType()))]))


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", path: str | None = None, threads: int = 2) -> DataFrame:
    """``df`` with the texts of an id column; null stays null. A column that is named ``out_col`` already is replaced."""
    if out_col == ids_col:
        raise ValueError("ids and texts need columns of their own")
    df, path = df.drop(out_col), path or public_path("piece_bpe_32k.model")

    def run(batches):
        codec = Codec(path, threads)
        for batch in batches:
            lists = batch.column(ids_col).to_pylist()
            texts = codec.decode([x or [] for x in lists])
            yield batch.append_column(out_col, pa.array([t if x is not None else None for t, x in zip(texts, lists, strict=True)], pa.string()))

    return arrow_map(df, run, StructType([*df.schema.fields, StructField(out_col, StringType())]))


#: Blanks, controls, bytes without a piece, the marker, and pieces that look like controls.
PARITY = ["", " ", "The  quick brown fox", " x ", "\x00\ttab\nline", "a▁b", "中文 😀 ñ", "<s> </s> <unk> <0x41>", "1234.5 %", "naïve—café"]


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    if differ := verify(public_path("piece_bpe_32k.model"), PARITY):
        raise ValueError(f"ids or decoding differ from sentencepiece's: {differ}")
    return encode_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
