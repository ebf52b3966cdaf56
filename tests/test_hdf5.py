"""HDF5 files: what is written is read, over chunks, ranges, files and kinds of storage."""

import struct

import numpy as np
import pytest

from helixframe.sources import hdf5, sequences


def _write(folder, name, columns, raw=None):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(raw or hdf5.encoded(columns))
    return str(folder)


@pytest.fixture()
def columns():
    rng = np.random.default_rng(1)
    return {
        "indices": rng.integers(0, 4, (1000, 30)).astype(np.uint8),
        "labels": rng.normal(size=1000),
        "small": rng.normal(size=1000).astype(np.float32),
        "ids": rng.integers(-(1 << 40), 1 << 40, 1000),
        "names": np.array([f"seq{i}" for i in range(1000)], "S8"),
        "other": np.arange(7),
    }


def test_rows_of_any_range(columns, tmp_path):
    with open(f"{_write(tmp_path / 'a', 'x.h5', columns)}/x.h5", "rb") as f:
        book = hdf5.Hdf5(f)
        assert set(book.addresses) == set(columns)
        for name, want in columns.items():
            d = book.dataset(name)
            assert d.shape == want.shape and d.kind == want.dtype
            for a, b in ((0, len(want)), (3, 5), (17, 900), (999, 1000), (5, 5)):
                assert (book.rows(name, a, b) == want[a:b]).all()


def test_source_over_files_and_partitions(spark, columns, tmp_path):
    folder = _write(tmp_path / "pool", "part-1.h5", columns)
    _write(tmp_path / "pool", "part-0.h5", {k: v[:10] for k, v in columns.items()})
    (tmp_path / "pool" / "notes.txt").write_text("no HDF5")
    df = hdf5.read_pool(spark, folder, 300)
    assert df.columns == ["index", "seq", "ids", "labels", "names", "small"] and df.rdd.getNumPartitions() == 5
    rows = {r["index"]: r for r in df.collect()}
    assert sorted(rows) == list(range(1010))
    for i in (0, 9, 10, 500, 1009):
        k = i if i < 10 else i - 10
        assert rows[i]["seq"] == "".join("ACGT"[c] for c in columns["indices"][k]) and rows[i]["labels"] == columns["labels"][k]
        assert rows[i]["ids"] == columns["ids"][k] and rows[i]["names"] == f"seq{k}" and rows[i]["small"] == pytest.approx(float(columns["small"][k]))
    assert sequences.read_table(spark, f"{folder}/part-0.h5", columns=["labels"]).columns == ["index", "labels"]
    with pytest.raises(Exception, match="missing datasets"):
        hdf5.read_hdf5(spark, folder, ["nope"]).count()


def test_key_fallback_and_splits(spark, columns, tmp_path):
    codes = columns["indices"]
    hot = (codes[:, None, :] == np.arange(4)[:, None]).astype(np.float32)
    last = (codes[:, :, None] == np.arange(4)).astype(np.uint8)
    pool = _write(tmp_path / "hot", "x.h5", {"arr_0": hot, "y_test": columns["labels"][:, None], "onehot_test": last})
    want = ["".join("ACGT"[c] for c in r) for r in codes]
    assert [r["seq"] for r in hdf5.read_pool(spark, pool).orderBy("index").collect()] == want
    split = hdf5.read_split(spark, pool, "test").orderBy("index").collect()
    assert [r["seq"] for r in split] == want and np.array_equal([r["y"] for r in split], columns["labels"])
    with pytest.raises(ValueError, match="neither indices nor arr_0"):
        hdf5.read_pool(spark, _write(tmp_path / "none", "x.h5", {"labels": columns["labels"]}))


def test_written_by_tasks(spark, tmp_path):
    df = spark.createDataFrame([(i, "ACGT"[i % 4 :] + "ACGT"[: i % 4], i / 2) for i in range(50)], "pid long, seq string, v double").repartition(3)
    for key in ("indices", "arr_0"):
        path = str(tmp_path / key)
        hdf5.write_pool(df, path, key)
        assert sorted(map(tuple, hdf5.read_pool(spark, path).select("pid", "seq", "v").collect())) == sorted(map(tuple, df.collect()))


def test_other_storage(tmp_path):
    """A newer superblock and object header, a compact link, contiguous data, and the shuffle and checksum filters."""
    data = np.arange(24, dtype="<i4").reshape(6, 4)
    out = bytearray(48)

    def header(messages):
        body = b"".join(struct.pack("<BHB", k, len(b), 0) + b for k, b in messages)
        out.extend(b"OHDR" + bytes([2, 2]) + struct.pack("<I", len(body)) + body + b"\0" * 4)
        return len(out) - len(body) - 14

    start = len(out)
    out.extend(data.tobytes())
    kind = struct.pack("<B3BIHH", 0x10, 8, 0, 0, 4, 0, 32)
    child = header([(hdf5.SPACE, struct.pack("<BBBBQQ", 2, 2, 0, 1, 6, 4)), (hdf5.TYPE, kind), (hdf5.LAYOUT, struct.pack("<BBQQ", 4, 1, start, data.nbytes))])
    root = header([(hdf5.LINK, bytes([1, 0, 4]) + b"data" + struct.pack("<Q", child))])
    out[:48] = hdf5.SIGNATURE + bytes([2, 8, 8, 0]) + struct.pack("<QQQQI", 0, hdf5.NOWHERE, len(out), root, 0)
    path = tmp_path / "new.h5"
    path.write_bytes(bytes(out))
    with open(path, "rb") as f:
        assert (hdf5.Hdf5(f).rows("data", 1, 5) == data[1:5]).all()
    mixed = data.view(np.uint8).reshape(-1, 4).T.tobytes()
    assert hdf5._unfiltered(mixed, 2, (4,), 4) == data.tobytes() and hdf5._unfiltered(b"abcd1234", 3, (), 1) == b"abcd"
    with pytest.raises(ValueError, match="filter 9"):
        hdf5._unfiltered(b"", 9, (), 1)
