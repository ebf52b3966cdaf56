"""The pipeline against a plain version of each stage's decision."""

import random
import re

import corpus_pipeline
from helixframe.llm.shared import staged


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, sf), name)
        kept[name] = out.toPandas()
        if name != "packing":
            assert out.columns == docs.columns
            docs = out
    norm = kept["language_id"].assign(n=[re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in kept["language_id"]["text"]])
    assert set(kept["exact_dedup"]["doc_id"]) == set(norm.groupby("n")["doc_id"].min())
    sets = {}
    for i, t in zip(kept["exact_dedup"]["doc_id"], kept["exact_dedup"]["text"], strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert set(kept["ngram_jaccard"]["doc_id"]) == {i for i in ids if find(i) == i}
    assert set(kept["pii"]["doc_id"]) == set(kept["ngram_jaccard"]["doc_id"]) == set(kept["packing"]["doc_id"])
    assert not kept["pii"]["text"].str.contains(r"@mail\d\.example\.com").any()
    assert (kept["pii"]["n_chars"] == kept["pii"]["text"].str.len()).all()


EXTRA = "doc_id long, text string, lang string, source string, n_chars long, id long, mark long, digest string, stays boolean, gone_id long"


def _rows(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, 8, "d", None, 9) for i, t in rows], EXTRA)


def test_stages_on_odd_rows(spark, sf):
    """Nulls, empty and very long texts, repeated ids and rows, and columns with the names that stages use inside."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'").orderBy("doc_id").limit(40)
    good = [r["text"] for r in docs.collect() if len(r["text"]) > 300]
    a, b, c = good[0], good[1], good[2]
    rows = [(i, t) for i, t in enumerate(good[3:])] + [(100, a), (107, a), (107, b), (109, c), (109, c), (None, a), (120, None), (121, ""), (122, a + " " + b[:40]), (123, b * 60)]
    df = _rows(spark, rows)
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language_id"](spark, df, sf)
    assert known.columns == df.columns and {120, 121} & {r["doc_id"] for r in known.collect()} == set()
    copies = stages["exact_dedup"](spark, df, sf)
    told = sorted((r["doc_id"] or 0, r["text"] or "") for r in copies.where("doc_id >= 100 or doc_id is null").collect())
    assert copies.columns == df.columns
    assert told == sorted([(0, a), (100, a), (107, b), (109, c), (120, ""), (122, a + " " + b[:40]), (123, b * 60)])
    near = stages["ngram_jaccard"](spark, df, sf)
    told = sorted((r["doc_id"] or 0, r["text"] or "") for r in near.where("doc_id >= 100 or doc_id is null").collect())
    assert near.columns == df.columns
    near_a = [] if len(b[:40]) < 0.15 * len(a) else [(122, a + " " + b[:40])]
    assert told == sorted([(0, a), (100, a), (107, b), (109, c), (120, ""), (121, ""), *near_a])
    clean = stages["pii"](spark, df, sf)
    assert clean.columns == df.columns and clean.count() == len(rows) and clean.where("text is null").count() == 1
    pieces = stages["packing"](spark, df, sf)
    assert pieces.where("start = 0").count() == len(rows)
    for stage in stages.values():
        assert stage(spark, df.limit(0), sf).count() == 0


def test_near_copies_take_five_words_and_80(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(400)]
    base = words[:104]  # 100 five-word shingles
    texts = [base, base + words[200:220], base + words[200:226], words[104:180], words[104:112] + words[300:368]]
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    far = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert 0.8 <= far(0, 1) < 0.85 and far(0, 2) < 0.8 and far(3, 4) < 0.2
    docs = spark.createDataFrame([(i, " ".join(texts[i])) for i in (0, 1, 3, 4)], "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()} == {0, 3, 4}
    docs = spark.createDataFrame([(i, " ".join(texts[i])) for i in (0, 2, 3, 4)], "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()} == {0, 2, 3, 4}


def test_near_copies_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sets = {}
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, sf).collect()}
    assert got == {i for i in ids if find(i) == i}
