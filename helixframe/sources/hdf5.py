"""HDF5 tables as a Spark data source: datasets of equal length are columns, ranges of rows are partitions.

Reads what scientific pools are commonly stored in: superblocks 0 to 3, old and
compact new groups, object headers 1 and 2, compact, contiguous and chunked
layouts under a version 1 index, and the deflate, shuffle and checksum filters.
Other storage (dense groups, newer chunk indexes, compound types) is refused by
name. A path is a file or a folder of files, local or of any file system that
Arrow opens. The driver reads headers only; a task reads the chunks that its
rows lie in.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from helixframe.functions import sequence as S

#: Rows of a partition, and of an Arrow batch.
PART_ROWS, BATCH_ROWS = 1 << 17, 1 << 12
#: Rows of a file that a pool is written to.
FILE_ROWS = 1 << 15
# Fixed values of the format.
SIGNATURE, NOWHERE = b"\x89HDF\r\n\x1a\n", (1 << 64) - 1
SPACE, TYPE, LINK, LAYOUT, FILTERS, MORE, TABLE = 0x01, 0x03, 0x06, 0x08, 0x0B, 0x10, 0x11


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def files_of(path: str) -> list[str]:
    """The file itself, or the .h5 and .hdf5 files of a folder in the order of their names."""
    fs, at = opened(path)
    if fs.get_file_info(at).type != pafs.FileType.Directory:
        return [path]
    names = sorted(i.base_name for i in fs.get_file_info(pafs.FileSelector(at)) if i.base_name.endswith((".h5", ".hdf5")))
    return [f"{path.rstrip('/')}/{n}" for n in names]


@dataclass
class Dataset:
    shape: tuple[int, ...] = ()
    kind: np.dtype | None = None
    layout: tuple = ()
    filters: list[tuple[int, tuple[int, ...]]] = field(default_factory=list)


class Hdf5:
    """The datasets of a file's root group by name."""

    def __init__(self, source):
        self.source = source
        self.source.seek(0)
        head = self.source.read(96)
        if head[:8] != SIGNATURE:
            raise ValueError("not an HDF5 file")
        version = head[8]
        if version < 2:
            sizes, at = head[13:15], 24 + (4 if version == 1 else 0) + 32 + 8
        else:
            sizes, at = head[9:11], 12 + 24
        if sizes != b"\x08\x08":
            raise ValueError("only 8-byte offsets are read")
        (root,) = struct.unpack_from("<Q", head, at)
        self.addresses = dict(self._links(root))

    def at(self, address: int, size: int) -> bytes:
        self.source.seek(address)
        return self.source.read(size)

    # ------------------------------------------------------------- headers

    def messages(self, address: int) -> Iterator[tuple[int, bytes]]:
        head = self.at(address, 16)
        if head[:4] == b"OHDR":
            flags = head[5]
            skip = 6 + (16 if flags & 0x20 else 0) + (4 if flags & 0x10 else 0)
            width = 1 << (flags & 3)
            size = int.from_bytes(self.at(address + skip, width), "little")
            blocks = [(address + skip + width, size)]
            while blocks:
                start, size = blocks.pop(0)
                for kind, body in self._messages_2(self.at(start, size), 6 if flags & 4 else 4):
                    if kind == MORE:
                        more, length = struct.unpack("<QQ", body[:16])
                        blocks.append((more + 4, length - 8))
                    yield kind, body
            return
        if head[0] != 1:
            raise ValueError("unknown object header")
        (size,) = struct.unpack_from("<I", head, 8)
        blocks = [(address + 16, size)]
        while blocks:
            start, size = blocks.pop(0)
            block, k = self.at(start, size), 0
            while k + 8 <= len(block):
                kind, length = struct.unpack_from("<HH", block, k)
                body = block[k + 8 : k + 8 + length]
                if kind == MORE:
                    blocks.append(struct.unpack("<QQ", body[:16]))
                yield kind, body
                k += 8 + length

    @staticmethod
    def _messages_2(block: bytes, head: int) -> Iterator[tuple[int, bytes]]:
        k = 0
        while k + head <= len(block):
            kind, length = block[k], int.from_bytes(block[k + 1 : k + 3], "little")
            yield kind, block[k + head : k + head + length]
            k += head + length

    def _links(self, address: int) -> Iterator[tuple[str, int]]:
        for kind, body in self.messages(address):
            if kind == TABLE:
                tree, heap = struct.unpack("<QQ", body[:16])
                names = self.at(struct.unpack("<Q", self.at(heap + 24, 8))[0], struct.unpack("<Q", self.at(heap + 8, 8))[0])
                for _, node in self._leaves(tree, 8):
                    (n,) = struct.unpack_from("<H", self.at(node + 6, 2))
                    for k in range(n):
                        name, to = struct.unpack("<QQ", self.at(node + 8 + 40 * k, 16))
                        yield names[name : names.index(b"\0", name)].decode(), to
            elif kind == LINK:
                flags, k = body[1], 2
                linked = body[k] if flags & 8 else 0
                k += (1 if flags & 8 else 0) + (8 if flags & 4 else 0) + (1 if flags & 16 else 0)
                width = 1 << (flags & 3)
                size = int.from_bytes(body[k : k + width], "little")
                name = body[k + width : k + width + size].decode()
                if linked == 0:
                    yield name, struct.unpack_from("<Q", body, k + width + size)[0]

    def _leaves(self, address: int, key: int) -> Iterator[tuple[bytes, int]]:
        """(key, address) of the entries at the bottom of a version 1 tree."""
        head = self.at(address, 24)
        if head[:4] != b"TREE":
            raise ValueError("a group or chunk index that isn't read")
        level, n = head[5], struct.unpack_from("<H", head, 6)[0]
        body = self.at(address + 24, n * (key + 8))
        for k in range(n):
            at = k * (key + 8)
            (child,) = struct.unpack_from("<Q", body, at + key)
            if level:
                yield from self._leaves(child, key)
            else:
                yield body[at : at + key], child

    def dataset(self, name: str) -> Dataset:
        out = Dataset()
        for kind, body in self.messages(self.addresses[name]):
            if kind == SPACE:
                rank, start = body[1], 8 if body[0] == 1 else 4
                out.shape = struct.unpack_from(f"<{rank}Q", body, start)
            elif kind == TYPE:
                out.kind = _kind(body)
            elif kind == LAYOUT:
                out.layout = self._layout(body)
            elif kind == FILTERS:
                out.filters = _filters(body)
        return out

    @staticmethod
    def _layout(body: bytes) -> tuple:
        version, how = body[0], body[1]
        if version not in (3, 4) or (version == 4 and how == 2):
            raise ValueError("a data layout that isn't read")
        if how == 0:
            return "compact", body[4 : 4 + struct.unpack_from("<H", body, 2)[0]]
        if how == 1:
            return "contiguous", struct.unpack_from("<Q", body, 2)[0]
        rank = body[2] - 1
        return "chunked", struct.unpack_from("<Q", body, 3)[0], struct.unpack_from(f"<{rank}I", body, 11)

    # ---------------------------------------------------------------- rows

    def rows(self, name: str, start: int, stop: int) -> np.ndarray:
        """Rows start to stop of a dataset, all other dimensions whole."""
        d = self.dataset(name)
        stop = min(stop, d.shape[0])
        width = int(np.prod(d.shape[1:], dtype=np.int64)) * d.kind.itemsize
        shape = (max(0, stop - start), *d.shape[1:])
        if d.layout[0] == "compact":
            return np.frombuffer(d.layout[1], d.kind).reshape(d.shape)[start:stop]
        if d.layout[0] == "contiguous":
            return np.zeros(shape, d.kind) if d.layout[1] == NOWHERE else np.frombuffer(self.at(d.layout[1] + start * width, (stop - start) * width), d.kind).reshape(shape)
        _, tree, chunk = d.layout
        out = np.zeros(shape, d.kind)
        for key, address in self._leaves(tree, 8 + 8 * (len(chunk) + 1)) if tree != NOWHERE else ():
            size, mask = struct.unpack_from("<II", key)
            begin = struct.unpack_from(f"<{len(chunk)}Q", key, 8)
            if begin[0] >= stop or begin[0] + chunk[0] <= start:
                continue
            raw = self.at(address, size)
            for k in reversed(range(len(d.filters))):
                if not mask >> k & 1:
                    raw = _unfiltered(raw, *d.filters[k], d.kind.itemsize)
            block = np.frombuffer(raw, d.kind, int(np.prod(chunk, dtype=np.int64))).reshape(chunk)
            low, high = max(start, begin[0]), min(stop, begin[0] + chunk[0])
            here = (slice(low - begin[0], high - begin[0]), *(slice(0, min(c, s - b)) for c, s, b in zip(chunk[1:], d.shape[1:], begin[1:], strict=True)))
            there = (slice(low - start, high - start), *(slice(b, b + c) for b, c in zip(begin[1:], chunk[1:], strict=True)))
            out[there] = block[here]
        return out


def _kind(body: bytes) -> np.dtype:
    """The numpy type of a datatype message; enumerations (booleans) are their base type."""
    what, bits, size = body[0] & 15, body[1], struct.unpack_from("<I", body, 4)[0]
    order = ">" if bits & 1 else "<"
    if what == 0:
        return np.dtype(f"{order}{'i' if bits & 8 else 'u'}{size}")
    if what == 1:
        return np.dtype(f"{order}f{size}")
    if what == 3:
        return np.dtype(f"S{size}")
    if what == 8:
        return _kind(body[8:])
    raise ValueError("only numbers, booleans and strings of fixed size are read")


def _filters(body: bytes) -> list[tuple[int, tuple[int, ...]]]:
    version, n, out = body[0], body[1], []
    k = 8 if version == 1 else 2
    for _ in range(n):
        (which,) = struct.unpack_from("<H", body, k)
        k += 2
        named = version == 1 or which >= 256
        size = struct.unpack_from("<H", body, k)[0] if named else 0
        k += 2 if named else 0
        values = struct.unpack_from("<H", body, k + 2)[0]
        k += 4 + (-(-size // 8) * 8 if version == 1 else size)
        out.append((which, struct.unpack_from(f"<{values}I", body, k)))
        k += 4 * values + (4 if version == 1 and values % 2 else 0)
    return out


def _unfiltered(raw: bytes, which: int, values: tuple[int, ...], size: int) -> bytes:
    if which == 1:
        return zlib.decompress(raw)
    if which == 2:
        n = len(raw) // size
        return np.frombuffer(raw[: n * size], np.uint8).reshape(size, n).T.tobytes() + raw[n * size :]
    if which == 3:
        return raw[:-4]
    raise ValueError(f"filter {which} isn't read")


# ------------------------------------------------------------------- source


@dataclass
class Rows(InputPartition):
    file: str
    first: int
    start: int
    stop: int


def _field(name: str, d: Dataset) -> StructField:
    one = StringType() if d.kind.kind == "S" else DoubleType() if d.kind.kind == "f" else LongType()
    return StructField(name, one if len(d.shape) == 1 else ArrayType(one))


class Hdf5Source(DataSource):
    """``index`` (the row's number over all files) and a column a dataset; rows of several dimensions are flat arrays, the last dimension first.

    Options: ``path``; ``datasets``, names separated by commas (else all with as many rows as the first); ``part_rows``, rows of a partition.
    """

    @classmethod
    def name(cls) -> str:
        return "hdf5_rows"

    def _first(self) -> tuple[list[str], dict[str, Dataset]]:
        files = files_of(self.options["path"])
        if not files:
            raise ValueError(f"no HDF5 file in {self.options['path']}")
        fs, at = opened(files[0])
        with fs.open_input_file(at) as f:
            book = Hdf5(f)
            names = [x for x in self.options.get("datasets", "").split(",") if x] or list(book.addresses)
            if missing := [x for x in names if x not in book.addresses]:
                raise ValueError(f"missing datasets {missing}; there are {sorted(book.addresses)}")
            have = {x: book.dataset(x) for x in names}
        rows = next(iter(have.values())).shape[0]
        return files, {x: d for x, d in have.items() if d.shape and d.shape[0] == rows}

    def schema(self) -> StructType:
        return StructType([StructField("index", LongType()), *(_field(n, d) for n, d in self._first()[1].items())])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema, int(self.options.get("part_rows", PART_ROWS)))


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, part_rows: int):
        self.path, self.fields, self.part_rows = path, schema.fields, part_rows

    def partitions(self) -> list[Rows]:
        out, first = [], 0
        for file in files_of(self.path):
            fs, at = opened(file)
            with fs.open_input_file(at) as f:
                n = Hdf5(f).dataset(self.fields[1].name).shape[0]
            out += [Rows(file, first, k, min(n, k + self.part_rows)) for k in range(0, n, self.part_rows)]
            first += n
        return out or [Rows("", 0, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if partition.start == partition.stop:
            return
        fs, at = opened(partition.file)
        with fs.open_input_file(at) as f:
            book = Hdf5(f)
            for k in range(partition.start, partition.stop, BATCH_ROWS):
                to = min(partition.stop, k + BATCH_ROWS)
                columns = [pa.array(np.arange(partition.first + k, partition.first + to))]
                columns += [_arrow(book.rows(x.name, k, to)) for x in self.fields[1:]]
                yield pa.RecordBatch.from_arrays(columns, [x.name for x in self.fields])


def _arrow(values: np.ndarray) -> pa.Array:
    flat = values.reshape(-1)
    if flat.dtype.kind == "S":
        one = pa.array([x.rstrip(b"\0").decode() for x in flat.tolist()], pa.string())
    else:
        one = pa.array(flat.astype(np.float64 if flat.dtype.kind == "f" else np.int64))
    if values.ndim == 1:
        return one
    width = int(np.prod(values.shape[1:], dtype=np.int64))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * width), one)


def read_hdf5(spark: SparkSession, path: str, datasets: list[str] | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    spark.dataSource.register(Hdf5Source)
    return spark.read.format("hdf5_rows").option("path", path).option("datasets", ",".join(datasets or [])).option("part_rows", part_rows).load()


def datasets_of(path: str) -> dict[str, tuple[int, ...]]:
    """The names and shapes of the first file's datasets."""
    fs, at = opened(files_of(path)[0])
    with fs.open_input_file(at) as f:
        book = Hdf5(f)
        return {n: book.dataset(n).shape for n in book.addresses}


@F.arrow_udf(StringType())
def _spelled(codes: pa.Array) -> pa.Array:
    values, bounds = codes.flatten().to_numpy(), codes.value_lengths().fill_null(0).to_numpy()
    bases = np.frombuffer(S.BASES.encode(), np.uint8)[values]
    ends = np.r_[0, np.cumsum(bounds)].astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(codes), [None, pa.py_buffer(ends), pa.py_buffer(bases)])


def _argmax(shape: tuple[int, ...], axis: int):
    @F.arrow_udf(ArrayType(LongType()))
    def largest(hot: pa.Array) -> pa.Array:
        grid = hot.flatten().to_numpy().reshape(len(hot), *shape).argmax(axis)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(hot) + 1, dtype=np.int32) * grid.shape[1]), pa.array(grid.reshape(-1)))

    return largest


def read_pool(spark: SparkSession, path: str, part_rows: int = PART_ROWS) -> DataFrame:
    """A seed pool: index, seq, and its other one-number datasets.

    Codes come from ``indices`` (n, L), or else from the first largest channel
    of ``arr_0`` (n, 4, L); a pool with neither is refused.
    """
    have = datasets_of(path)
    key = next((k for k in ("indices", "arr_0") if k in have), None)
    if key is None:
        raise ValueError(f"neither indices nor arr_0 in {path}; there are {sorted(have)}")
    more = [n for n, shape in have.items() if len(shape) == 1 and shape[0] == have[key][0]]
    rows = read_hdf5(spark, path, [key, *more], part_rows)
    codes = F.col(key) if key == "indices" else _argmax(have[key][1:], 1)(key)
    return rows.select("index", _spelled(codes).alias("seq"), *more)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split of a training file: index, seq and y from ``onehot_<split>`` (n, L, 4) and ``y_<split>``."""
    hot, y = f"onehot_{split}", f"y_{split}"
    rows = read_hdf5(spark, path, [hot, y])
    value = F.col(y)[0] if isinstance(rows.schema[y].dataType, ArrayType) else F.col(y)
    return rows.select("index", _spelled(_argmax(datasets_of(path)[hot][1:], 2)(hot)).alias("seq"), value.alias("y"))


# --------------------------------------------------------------------- sink


def _message(kind: int, body: bytes) -> bytes:
    body += b"\0" * (-len(body) % 8)
    return struct.pack("<HHB3x", kind, len(body), 0) + body


def encoded(columns: dict[str, np.ndarray], level: int = 4) -> bytes:
    """A file of these arrays: an old-style root group, chunks of rows, deflated."""
    out = io.BytesIO()
    out.write(b"\0" * 96)

    def put(body: bytes) -> int:
        out.seek(0, 2)
        at = out.tell() + -out.tell() % 8
        out.write(b"\0" * (at - out.tell()) + body)
        return at

    entries, names = [], b"\0" * 8
    for name in sorted(columns):
        data = np.ascontiguousarray(columns[name])
        n, size = len(data), data.dtype.itemsize
        chunk = (max(1, -(-n // 64)), *data.shape[1:])
        keys = b""
        starts = range(0, n, chunk[0])
        for k in starts:
            block = np.zeros(chunk, data.dtype)
            part = data[k : k + chunk[0]]
            block[: len(part)] = part
            raw = zlib.compress(block.tobytes(), level)
            keys += struct.pack(f"<II{data.ndim + 1}QQ", len(raw), 0, k, *[0] * data.ndim, put(raw))
        keys += struct.pack(f"<II{data.ndim + 1}Q", 0, 0, n, *[0] * data.ndim)
        tree = put(b"TREE" + struct.pack("<BBHQQ", 1, 0, len(starts), NOWHERE, NOWHERE) + keys) if n else NOWHERE
        if data.dtype.kind == "S":
            kind = struct.pack("<B3BI", 0x13, 1, 0, 0, size)
        elif data.dtype.kind == "f":
            bits = {4: (23, 8, 0, 23, 127), 8: (52, 11, 0, 52, 1023)}[size]
            kind = struct.pack("<B3BIHHBBBBI", 0x11, 0x20, 8 * size - 1, 0, size, 0, 8 * size, bits[0], bits[1], bits[2], bits[3], bits[4])
        else:
            kind = struct.pack("<B3BIHH", 0x10, 8 if data.dtype.kind == "i" else 0, 0, 0, size, 0, 8 * size)
        messages = [
            _message(SPACE, struct.pack(f"<BBB5x{data.ndim}Q", 1, data.ndim, 0, *data.shape)),
            _message(TYPE, kind),
            _message(0x05, bytes([2, 3, 0, 0])),
            _message(LAYOUT, struct.pack(f"<BBBQ{data.ndim + 1}I", 3, 2, data.ndim + 1, tree, *chunk, size)),
            _message(FILTERS, struct.pack("<BB6xHHHHI4x", 1, 1, 1, 0, 1, 1, level)),
        ]
        body = b"".join(messages)
        address = put(struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body)
        entries.append(struct.pack("<QQII16x", len(names), address, 0, 0))
        names += name.encode() + b"\0" * (8 - len(name) % 8)
    if len(entries) > 32:
        raise ValueError("at most 32 datasets a file")
    segment = put(names)
    heap = put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), 1, segment))
    node = put(b"SNOD" + struct.pack("<BxH", 1, len(entries)) + b"".join(entries).ljust(32 * 40, b"\0"))
    last = struct.unpack_from("<Q", entries[-1])[0] if entries else 0
    tree = put(b"TREE" + struct.pack("<BBHQQ", 0, 0, 1 if entries else 0, NOWHERE, NOWHERE) + struct.pack("<QQQ", 0, node, last) + b"\0" * 16 * 31)
    body = _message(TABLE, struct.pack("<QQ", tree, heap))
    root = put(struct.pack("<BxHII4x", 1, 1, 1, len(body)) + body)
    out.seek(0, 2)
    end = out.tell()
    out.seek(0)
    out.write(SIGNATURE + bytes([0, 0, 0, 0, 0, 8, 8, 0]) + struct.pack("<HHIQQQQ", 16, 16, 0, 0, NOWHERE, end, NOWHERE))
    out.write(struct.pack("<QQIIQQ", 0, root, 1, 0, tree, heap))
    return out.getvalue()


def write_pool(df: DataFrame, path: str, key: str = "indices", seq: str = "seq") -> None:
    """A folder with files of ``FILE_ROWS`` rows: the codes of ``seq`` as ``indices`` (or one-hot as ``arr_0``) and each numeric column of ``df``.

    All sequences need one length. A task holds one file's rows at a time; a
    file that is there already is replaced.
    """
    fs, at = opened(path)
    fs.create_dir(at, recursive=True)
    numbers = [c for c, t in df.dtypes if c != seq and t in ("tinyint", "smallint", "int", "bigint", "float", "double")]

    def written(held: pa.Table, number: int) -> None:
        body, offsets = S._joined(held.column(seq).combine_chunks())
        codes = S._CODES[body].reshape(held.num_rows, -1)
        columns = {c: held.column(c).to_numpy() for c in numbers}
        if key == "indices":
            columns["indices"] = codes
        else:
            columns["arr_0"] = (codes[:, None, :] == np.arange(4, dtype=np.uint8)[:, None]).view(np.uint8)
        mine, folder = opened(path)
        name = f"part-{TaskContext.get().partitionId():05d}-{number:05d}.h5"
        # A task that runs twice writes the same files; each takes its name when it is whole.
        draft = f"{folder}/.{name}.{TaskContext.get().taskAttemptId()}"
        with mine.open_output_stream(draft) as f:
            f.write(encoded(columns))
        mine.move(draft, f"{folder}/{name}")

    def run(batches):
        held, many, files, total = [], 0, 0, 0
        for whole in batches:
            total += whole.num_rows
            at = 0
            while at < whole.num_rows:
                part = whole.slice(at, FILE_ROWS - many)
                at += part.num_rows
                held.append(part)
                many += part.num_rows
                if many == FILE_ROWS:
                    written(pa.Table.from_batches(held), files)
                    held, many, files = [], 0, files + 1
        if many:
            written(pa.Table.from_batches(held), files)
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["rows"])

    df.select(seq, *numbers).mapInArrow(run, "rows long").agg(F.sum("rows")).collect()
