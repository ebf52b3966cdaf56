"""The split by hash numbers only the rows where the cut falls, with exact sizes."""

import hashlib

from helixframe.operators import relational


def test_split_numbers_only_rows_beside_the_cut(spark, monkeypatch):
    seen, numbered = [], relational.numbered
    monkeypatch.setattr(relational, "numbered", lambda df, *a: seen.append(df.count()) or numbered(df, *a))
    df = spark.range(3001).selectExpr("id as pid", "id % 7 as x")
    order = sorted(range(3001), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
    for share in (0.5, 0.2, 0.0, 1.0):
        got = {r["pid"]: (r["x"], r["half"]) for r in relational.split_half(df, "pid", share=share).collect()}
        assert got == {i: (i % 7, "A" if k < int(share * 3001) else "B") for k, i in enumerate(order)}
    assert max(seen) < 30


def test_split_of_equal_keys_and_of_nothing(spark):
    df = spark.range(11).selectExpr("id * 0 as pid")
    assert sorted(r["half"] for r in relational.split_half(df, "pid").collect()) == ["A"] * 5 + ["B"] * 6
    assert relational.split_half(df.limit(0), "pid").count() == 0
