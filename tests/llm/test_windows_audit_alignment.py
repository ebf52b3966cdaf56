"""Window dedup, the filter audit and token alignment against brute force, with nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import filter_audit, token_alignment, window_dedup

SCHEMA = "doc_id long, text string, lang string, id long, block long, words string, part string, digest string"


def _docs(spark, rows):
    """Documents with columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([(i, t, lang, 7, 3, "w", "p", "d") for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(60)] + ["É", "naïve", "x" * 700, "中文", "#", "A", "LOUD", "ZOO"]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    shared, long = make(40), make(3000)
    rows = [(i, " ".join(make(rng.randint(0, 160))), rng.choice(["en", "fr", None, ""])) for i in range(40)]
    rows += [(100 + i, " ".join(make(5) + shared[i : i + 20] + make(5)), "en") for i in range(12)]
    rows += [(200, " ".join(long), "de"), (201, "  ".join(long[:1500]) + "\n" + "\t".join(long[1502:]), "de"), (202, " ".join(long), "de")]
    rows += [(300, None, "en"), (301, "", None), (302, None, "en"), (303, " \t\n\x0b", "en"), (304, " ".join(shared[:12]), "en"), (305, " ".join(shared[:13]), "en")]
    # Rows that share an id, repeated rows, and rows without an id.
    rows += [(150, " ".join(shared), "en"), (150, " ".join(shared), "en"), (151, " ".join(make(3) + shared), "en"), (151, " ".join(shared + make(2)), "fr"), (None, " ".join(shared), "en"), (None, " ".join(long), None)]
    rows += [(90, rows[3][1], "en"), (1, rows[3][1], "en"), (2000, "same " * 40, "en"), (2001, "same " * 41, "en")]
    return rows


def _windows_gone(rows, width):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, _ in rows]
    low: dict = {}
    for (i, _, _), ws in zip(rows, split, strict=True):
        for k in range(len(ws) - width + 1):
            if i is not None:
                w = tuple(ws[k : k + width])
                low[w] = min(low.get(w, i), i)
    out = []
    for (i, _, _), ws in zip(rows, split, strict=True):
        gone = set()
        for k in range(len(ws) - width + 1):
            if i is not None and low[tuple(ws[k : k + width])] < i:
                gone |= set(range(k, k + width))
        out.append((i, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return out


@pytest.mark.parametrize("options", [{}, {"block_bytes": 2000, "bits": 8}, {"block_bytes": 9000, "width": 3}], ids=str)
def test_window_dedup(spark, texts, options, monkeypatch):
    monkeypatch.setattr(window_dedup, "EXACT_BYTES", 4096)
    order = lambda rows: sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1:]))
    got = window_dedup.drop_repeats(_docs(spark, texts), **options).collect()
    assert order(tuple(r) for r in got) == order(_windows_gone(texts, options.get("width", 13)))
    assert window_dedup.drop_repeats(_docs(spark, texts).limit(0)).count() == 0
    assert [tuple(r) for r in window_dedup.drop_repeats(_docs(spark, [(5, None, "en")])).collect()] == [(5, 0, 0, "")]


def test_sketch_loses_no_repeated_window(spark, texts):
    """Few counters collide often, which only makes more windows meet the exact pass."""
    wide, narrow = (sorted(map(str, window_dedup.drop_repeats(_docs(spark, texts), bits=b, block_bytes=4000).collect())) for b in (30, 6))
    assert wide == narrow


def test_planes():
    for v in (np.zeros(0, np.uint64), np.array([0, 1, 255, 1 << 40, (1 << 64) - 1], np.uint64)):
        assert (window_dedup.unplaned(window_dedup.planes(v)) == v).all()


def _flags(rows):
    low: dict = {}
    for i, t, _ in rows:
        if i is not None:
            low[t or ""] = min(low.get(t or "", i), i)
    out = []
    for i, t, lang in rows:
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(ws) < 100, 100 * len(set(ws)) < 80 * len(ws), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and low[t] < i]
        out.append((i, lang or "", {f for f, x in zip("ABCDE", fails, strict=True) if x}))
    return out


def test_filter_audit(spark, texts):
    marks = [(i, i % 2, i % 3 == 0) for i in range(0, 320, 2)] + [(151, None, True), (151, 1, False), (None, 1, True), (4, 1, None)]
    labels = spark.createDataFrame([(i, q, None if x is None else int(x)) for i, q, x in marks], "doc_id long, quality int, toxic int")
    good, toxic = ({i for i, q, x in marks if i is not None and (q if k else x)} for k in (1, 0))
    want: Counter = Counter()
    rows = _flags(texts)
    for order in permutations("ABCDE"):
        name = "".join(order)
        for i, part, fails in rows:
            first = next((k for k, c in enumerate(order) if c in fails), 5)
            for k, c in enumerate(order):
                key = (part, name, k + 1)
                want[(*key, "kept")] += first > k
                want[(*key, "removed")] += first == k
                want[(*key, "redundant")] += c in fails and first < k
                want[(*key, "unique_fails")] += fails == {c}
                want[(*key, "good_lost")] += first == k and i in good
                want[(*key, "toxic_lost")] += first == k and i in toxic
                want[(part, c)] += first == k
    got = filter_audit.audit(_docs(spark, texts), labels).collect()
    assert len(got) == 600 * len({p for _, p, _ in rows})
    for r in got:
        key = (r["part"], r["filter_order"], r["step"])
        assert all(r[c] == want[(*key, c)] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), key
        assert r["shapley"] == want[r["part"], r["filter_order"][r["step"] - 1]]
    assert filter_audit.audit(_docs(spark, texts).limit(0), labels).count() == 0
    assert filter_audit.audit(_docs(spark, texts), labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def _aligned(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(token_alignment.public_path(token_alignment.A_NAME))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=token_alignment.public_path(token_alignment.B_NAME))
    back = {c: x for x, c in token_alignment.byte_chars().items()}
    told, counts = [], Counter()
    for i, t in rows:
        ids = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        raw = [bytes(back[c] for c in a.id_to_token(x)) for x in ids[0]], [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ids[1]]
        if not t or any(b"".join(r) != (" " + t).encode() for r in raw):
            told.append((i, 0, 0, [], ""))
            continue
        ends = [np.cumsum([len(x) for x in r]).tolist() for r in raw]
        links = [(ids[0][x], ids[1][y]) for x in range(len(ids[0])) for y in range(len(ids[1])) if max(ends[0][x] - len(raw[0][x]), ends[1][y] - len(raw[1][y])) < min(ends[0][x], ends[1][y])]
        groups, at = [], [0, 0]
        for cut in sorted(set(ends[0]) & set(ends[1])):
            to = [e.index(cut) + 1 for e in ends]
            groups.append("|".join(",".join(map(str, ids[k][at[k] : to[k]])) for k in (0, 1)))
            at = to
        counts.update(links)
        told.append((i, len(ids[0]), len(ids[1]), links, ";".join(groups)))
    top: dict = {}
    for (_, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    return [
        (i, x, y, g.count(";") + bool(g), len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "") for i, x, y, links, g in told
    ]


def test_token_alignment(spark, texts, monkeypatch):
    odd = ["a▁b", "<|endoftext|> and <s> </s> <unk> <0x41>", "tab\tnew\nline  two", "😀 emoji 中文 ñandú", "\x00\x01 nul", "can't we'll they're", " lead and trail ", "é́     ​", "x" * 300]
    rows = [(i, t[:600] if t else t) for i, t, _ in texts] + [(5000 + k, t) for k, t in enumerate(odd)]
    order = lambda r: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1:]))
    want = order(_aligned(rows))
    df = _docs(spark, [(i, t, "en") for i, t in rows])
    for size in (token_alignment.BLOCK_BYTES, 1500):
        monkeypatch.setattr(token_alignment, "BLOCK_BYTES", size)
        assert order(tuple(r) for r in token_alignment.align(df.repartition(3)).collect()) == want
    assert token_alignment.align(df.limit(0)).count() == 0
    assert next(r for r in want if r[0] == 5000)[1:] == (0, 0, 0, 0, 0, 0, "") and next(r for r in want if r[0] == 5001)[1] > 0


def test_bits():
    rng = np.random.default_rng(3)
    marks = np.flatnonzero(rng.random(500) < 0.3)
    bits = token_alignment.Bits.at(marks, 500)
    assert (bits.places() == marks).all()
    at = np.arange(501)
    assert (bits.before(at) == [(marks < i).sum() for i in at]).all()
