"""What the near-copy join moves: unlike sets that share an n-gram never travel with their prefixes."""

import numpy as np

from helixframe.llm import jaccard
from helixframe.llm.shared import U64


def test_unlike_sets_leave_before_prefixes_are_fetched(spark, monkeypatch):
    rng = np.random.default_rng(5)
    common = "one shared passage of eight words is here"
    rows = [(i, " ".join(f"{common} {k} {' '.join(f'w{x}' for x in rng.integers(0, 10**9, 12))}" for k in range(4))) for i in range(60)]
    rows.append((100, rows[3][1] + " more"))
    moved, joined = [], jaccard._joined

    def counted(df, percent, exact):
        if not exact:
            moved.append(df.count())
        return joined(df, percent, exact)

    monkeypatch.setattr(jaccard, "_joined", counted)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 3 if i == 100 else i for i, _ in rows}
    # Only the two copies; all sixty share the passage's n-grams.
    assert sum(moved) <= 8


def test_parity_bits_never_differ_in_more_places_than_the_sets_differ_in_keys():
    rng = np.random.default_rng(6)
    for n in (1, 3, 64, 65, 300, 5000):
        a = np.unique(rng.integers(1, 2**62, n).astype(U64))
        for share in (0.0, 0.5, 0.9, 1.0):
            b = np.unique(np.r_[a[: max(1, int(share * len(a)))], rng.integers(1, 2**62, max(0, int(n * (1.1 - share)))).astype(U64)])
            bits = [np.frombuffer(jaccard._parity(x), U64) for x in (a, b)]
            differ = int(jaccard._differing(bits, np.array([0]), np.array([1]))[0])
            assert differ <= len(np.setxor1d(a, b))
