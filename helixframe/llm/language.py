"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text becomes counts of its 2- and 3-byte grams (lower case, everything that
is no letter as a blank), hashed into a fixed number of cells, damped by
1 + ln, weighted by inverse document frequency and normalised. Each language
has several centroids, found by spherical k-means over its labelled rows; the
nearest centroid by cosine names the language. A text that is farther from its
centroid than nearly all labelled rows are is rejected.

The classifier is fitted on at most ``SAMPLE`` labelled rows of each language,
those with the smallest hash of their id, however many languages there are.
Their whole texts are counted where they are, and each language's centroids are
found in a task of their own; what comes to the driver is the model, ``CENTROIDS``
rows a language. Prediction reads every whole text in one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.shared import arrow_map, drop_staged, flat, rows_by_bytes, staged

#: Cells of the hashed n-gram vector; labelled rows and centroids of each language.
CELLS, SAMPLE, CENTROIDS = 4096, 300, 4
#: Rows of the sample whose texts are picked by broadcast; beyond it they meet by shuffle.
PICKED_ROWS = 500_000
#: Labelled rows that a centroid's rejection distance may leave out, a factor of slack on it, and the
#: rows that a centroid needs for a distance of its own.
LEFT_OUT, SLACK, OWN_ROWS = 0.002, 0.5, 20
UNKNOWN = "und"
#: Bytes of an Arrow batch here, and bytes and rows of texts whose vectors a worker holds at once: a row of counts has ``CELLS`` numbers of
#: 8 bytes, and some ten such arrays are alive together.
HANDED, TEXT_BYTES, TEXT_ROWS = 1 << 20, 1 << 18, 64


def _letters() -> np.ndarray:
    """Bytes as they count: letters in lower case, bytes of other characters as they are, the rest blank."""
    out = np.full(256, 32, np.uint8)
    out[97:123] = out[65:91] = np.arange(97, 123)
    out[128:] = np.arange(128, 256)
    return out


_LETTER = _letters()


def lowered(body: np.ndarray) -> np.ndarray:
    b = _LETTER[body]
    # Latin-1 capitals: C3 80..9E, but for the multiplication sign.
    after = np.flatnonzero(b[:-1] == 0xC3) + 1
    up = after[(b[after] >= 0x80) & (b[after] <= 0x9E) & (b[after] != 0x97)]
    b[up] += 0x20
    return b


def counts(body: np.ndarray, offsets: np.ndarray, cells: int) -> np.ndarray:
    """Gram counts, a row per text; grams don't cross texts."""
    n = len(offsets) - 1
    b = lowered(body).astype(np.int32)
    row = np.repeat(np.arange(n, dtype=np.int64) * cells, np.diff(offsets))
    out = np.zeros(n * cells, np.int64)
    for k, salt in ((2, 0x51ED), (3, 0xC0FFEE)):
        if len(b) < k:
            continue
        m = len(b) - k + 1
        code = b[:m].copy()
        for i in range(1, k):
            code = code << 8 | b[i : m + i]
        inside = row[:m] == row[k - 1 :]
        keep = inside & (code != (0x2020 if k == 2 else 0x202020))
        out += np.bincount(row[:m][keep] + _cell(code[keep], salt, cells), minlength=n * cells)
    return out.reshape(n, cells)


def _cell(code: np.ndarray, salt: int, cells: int) -> np.ndarray:
    h = (code.astype(np.uint32) ^ np.uint32(salt)) * np.uint32(2654435761)
    return (h >> np.uint32(32 - int(np.log2(cells)))).astype(np.int64)


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    owner: np.ndarray
    least: np.ndarray

    def vectors(self, c: np.ndarray) -> np.ndarray:
        """Normalised TF-IDF vectors of rows of counts."""
        v = np.where(c > 0, 1 + np.log(np.maximum(c, 1)), 0) * self.idf
        norm = np.sqrt((v * v).sum(1, keepdims=True))
        return v / np.where(norm > 0, norm, 1)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, cosine, rejected) of each text."""
        body, offsets = flat(column)
        sure = has_letter(column, body, offsets)
        if not self.languages:
            return [UNKNOWN] * len(sure), np.zeros(len(sure)), np.ones(len(sure), bool)
        cosine = self.vectors(counts(body, offsets, len(self.idf))) @ self.centroids.T
        best = cosine.argmax(1)
        score = np.clip(cosine[np.arange(len(best)), best], 0, 1)
        rejected = ~sure | (score < self.least[best])
        names = [self.languages[self.owner[b]] if s else UNKNOWN for b, s in zip(best.tolist(), sure.tolist(), strict=True)]
        return names, np.where(sure, score, 0.0), rejected


def has_letter(column: pa.Array, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_letter = (body | 32 >= 97) & (body | 32 <= 122)
    total = np.zeros(len(body) + 1, np.int64)
    np.cumsum(ascii_letter, out=total[1:])
    out = total[offsets[1:]] > total[offsets[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in column[int(i)].as_py() or "")
    return out


def centroids(rows: np.ndarray, k: int = CENTROIDS) -> np.ndarray:
    """Spherical k-means over normalised rows, which have at least one; ties and order are settled by position."""
    # Start from rows far apart: each next one is the row least like those chosen.
    start = [int((rows @ rows.sum(0)).argmax())]
    while len(start) < min(k, len(rows)):
        start.append(int((rows @ rows[start].T).max(1).argmin()))
    mid = rows[start]
    for _ in range(12):
        near = (rows @ mid.T).argmax(1)
        mid = np.stack([rows[near == j].sum(0) if (near == j).any() else mid[j] for j in range(len(mid))])
        mid /= np.sqrt((mid * mid).sum(1, keepdims=True))
    return mid


def _distance(cosines: np.ndarray) -> float:
    """What all but a few labelled rows stay within, with slack."""
    return SLACK * float(np.quantile(cosines, LEFT_OUT))


def fold(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 3


def labelled(df: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE, cells: int = CELLS) -> DataFrame:
    """(lang, id, mark, counts) of at most ``sample`` labelled rows of each language outside the held-out fold, by hash of the id.

    Rows that agree in id and text count once; other rows may share an id.
    """
    rows = df.where(f"{lang_col} is not null and {text_col} is not null and {id_col} is not null").where(fold(id_col) != 1)
    rows = rows.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    size = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # A uniform number of each id lets through some four times the sample, so that no task gets all rows of a language.
    chance = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)
    told = staged(size, "languages", 1)
    few = told.count() <= PICKED_ROWS
    some = rows.drop("text").join(F.broadcast(told) if few else told, "lang").where(chance <= F.greatest(4 * sample / F.col("n"), F.lit(1e-9)))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "mark")
    picked = some.select("id", "mark", "lang").distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample).drop("k")
    picked = staged(picked, "picked", 1)
    few = picked.count() <= PICKED_ROWS

    def run(batches):
        for whole in batches:
            for batch in rows_by_bytes(whole, "text", TEXT_BYTES, TEXT_ROWS):
                c = counts(*flat(batch.column("text")), cells).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("lang", "id", "mark")), pa.array([r.tobytes() for r in c], pa.binary())], ["lang", "id", "mark", "counts"])

    found = rows.join(F.broadcast(picked) if few else picked, ["id", "mark", "lang"], "left_semi").select("lang", "id", "mark", "text")
    return arrow_map(found, run, f"lang string, id {dict(rows.dtypes)['id']}, mark long, counts binary", HANDED).dropDuplicates(["lang", "id", "mark"])


def trained(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, cells: int = CELLS) -> Model:
    """The classifier of ``df``: a bounded sample of each language, one task a language."""
    rows = staged(labelled(df, id_col, text_col, lang_col, sample, cells), "labelled")

    def present(batches):
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for x in batch.column("counts").to_pylist():
                total += np.frombuffer(x, np.int32) > 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    seen, n = np.zeros(cells, np.int64), rows.count()
    for r in arrow_map(rows.select("counts"), present, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        seen[r["cell"]] = r["n"]
    model = Model(np.log((1 + n) / (1 + seen)) + 0.05, np.zeros((0, cells)), [], np.zeros(0, int), np.zeros(0))

    def one(group: pa.Table) -> pa.Table:
        group = group.sort_by([("id", "ascending"), ("mark", "ascending")])
        v = model.vectors(np.array([np.frombuffer(x, np.int32) for x in group.column("counts").to_pylist()]))
        lang, told = group.column("lang")[0].as_py(), []
        if v.any():
            mid = centroids(v[v.any(1)])
            cosine = v @ mid.T
            near, best = cosine.argmax(1), cosine.max(1)
            for j, m in enumerate(mid):
                mine = best[(near == j) & (best > 0)]
                told.append((lang, j, m.tobytes(), _distance(mine) if len(mine) >= OWN_ROWS else None, best[best > 0].tolist() if not j else []))
        columns = list(zip(*told, strict=True)) if told else [[]] * 5
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.binary(), pa.float64(), pa.list_(pa.float64())), strict=True)], ["lang", "j", "mid", "least", "best"])

    found = staged(rows.groupBy("lang").applyInArrow(one, "lang string, j int, mid binary, least double, best array<double>"), "centroids")
    # A centroid of few rows takes the distance of all languages' rows.
    every = found.select(F.explode("best").alias("b")).agg(F.percentile("b", F.lit(LEFT_OUT))).first()[0]
    told = found.select("lang", "j", "mid", "least").orderBy("lang", "j").collect()
    if told:
        model.languages = sorted({r["lang"] for r in told})
        model.centroids = np.array([np.frombuffer(r["mid"]) for r in told])
        place = {x: i for i, x in enumerate(model.languages)}
        model.owner = np.array([place[r["lang"]] for r in told])
        model.least = np.array([SLACK * every if r["least"] is None else r["least"] for r in told])
    drop_staged(df.sparkSession, rows, found)
    return model


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of each row of ``df``.

    A null text or one without a letter is ``und`` with score 0 and rejected;
    so is every text if there was nothing to learn from. Only the text is an
    input, and it is read whole. Of centroids at the same distance the first
    one counts, by the name of its language. Rows that repeat are each
    predicted; other columns are ignored; an empty table gives no rows.
    """

    def run(batches):
        for whole in batches:
            for batch in rows_by_bytes(whole, "text", TEXT_BYTES, TEXT_ROWS):
                names, score, rejected = model.predict(batch.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)],
                    ["doc_id", "held_out", "lang_pred", "score", "rejected"],
                )

    source = df.select(F.col(id_col).alias("id"), F.coalesce(fold(id_col) == 1, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return arrow_map(source, run, f"doc_id {dict(source.dtypes)['id']}, held_out boolean, lang_pred string, score double, rejected boolean", HANDED)


def keep_known(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """``df`` without the rows that the classifier rejects: null texts, texts without a letter, and those far from every centroid.

    Rows with an id are not told apart by it, so repeated ids don't matter. All
    columns stay as they are, whatever their names; with nothing to learn from,
    every row is rejected.
    """
    model = trained(df, id_col, text_col, lang_col)

    def run(batches):
        for whole in batches:
            parts = [model.predict(batch.column(text_col))[2] for batch in rows_by_bytes(whole, text_col, TEXT_BYTES, TEXT_ROWS)]
            if parts:
                yield whole.filter(pa.array(~np.concatenate(parts)))

    return arrow_map(df, run, df.schema, HANDED)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, trained(docs))
