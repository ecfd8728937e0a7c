"""Graph files as a Spark data source: ``spark.read.format("rag")`` and ``df.write.format("rag")``.

Reading: a folder or file of ``.dat`` graph files to rows of ``NODE_SCHEMA`` and ``file``. Beside
each file lies an index of byte offsets (``.dat.idx``); with it a file is read in ranges of about
``RANGE_BYTES`` by as many tasks, and without it (files from elsewhere) by one task in a stream.
No task holds a file.

Writing: rows ``(tile, node, record, n_nodes, n_bytes)``, as ``dat.encoded_files`` makes them, grouped by
tile within each task; a tile becomes ``Graph_<tile>.dat``. A task streams to names of its own,
and the files get their real names when all tasks are done, so lost and repeated tasks leave nothing behind.

Files are reached by ``pyarrow.fs``: local folders, ``file:``, ``hdfs:``, ``s3:``, ``gs:`` and ``abfs:``.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

NODE_SCHEMA = "node long, x int, y int, w int, h int, area long, perimeter long, mean array<double>, std array<double>, moves array<int>, edges array<struct<dst:long,boundary:long>>"
ARROW = pa.schema(
    [("node", pa.int64()), *((c, pa.int32()) for c in "xywh"), ("area", pa.int64()), ("perimeter", pa.int64()), ("mean", pa.list_(pa.float64())), ("std", pa.list_(pa.float64()))]
    + [("moves", pa.list_(pa.int32())), ("edges", pa.list_(pa.struct([("dst", pa.int64()), ("boundary", pa.int64())]))), ("file", pa.string())]
)
FILE_SCHEMA = "tile string, node long, record binary, n_nodes long, n_bytes long"

#: Nodes between two entries of an index; bytes of a file that one task reads; bytes fetched at once; rows of a batch.
INDEX_EVERY, RANGE_BYTES, CHUNK, BATCH = 1024, 32 << 20, 1 << 20, 2048
#: Bytes before a file's first node: the size of what follows the first number, and the count of nodes.
HEAD = 16


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it; ``file:/x`` counts as ``file:///x``."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def pack_moves(moves: list[int]) -> bytes:
    """Four steps a byte, the first in the lowest bits."""
    padded = np.zeros(-(-len(moves) // 4) * 4, np.uint8)
    padded[: len(moves)] = moves
    return (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8).tobytes()


def unpack_moves(packed: bytes, last: int) -> list[int]:
    """Steps of packed bytes; ``last`` is how many steps the last byte holds, 0 if it is full."""
    steps = (np.frombuffer(packed, np.uint8)[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).ravel()
    return steps[: len(steps) - (4 - last) % 4 if last else None].tolist()


def encode_node(r) -> bytes:
    """A node's bytes, from a row of ``NODE_SCHEMA`` as a mapping."""
    moves = pack_moves(r["moves"])
    out = [struct.pack("<4I", r["x"], r["y"], r["w"], r["h"]), struct.pack("<IBQ", r["node"], len(r["moves"]) % 4, len(moves)), moves]
    out += [struct.pack(f"<Q{len(stats)}f", len(stats), *stats) for stats in (r["mean"], r["std"])]
    out.append(struct.pack("<III", r["perimeter"], r["area"], len(r["edges"])))
    return b"".join([*out, *(struct.pack("<II", e["dst"], e["boundary"]) for e in r["edges"])])


class Stream:
    """Numbers and bytes of a file from a place on, fetched in chunks."""

    def __init__(self, file: pa.NativeFile, at: int):
        file.seek(at)
        self.file, self.data, self.at = file, b"", 0

    def raw(self, n: int) -> bytes:
        if len(self.data) - self.at < n:
            self.data, self.at = self.data[self.at :] + self.file.read(max(n, CHUNK)), 0
            if len(self.data) < n:
                raise ValueError("the file is shorter than it says")
        self.at += n
        return self.data[self.at - n : self.at]

    def take(self, form: str) -> tuple:
        return struct.unpack("<" + form, self.raw(struct.calcsize("<" + form)))


def decode_nodes(stream: Stream, count: int) -> Iterator[dict]:
    """So many nodes from a place in a file on."""
    for _ in range(count):
        x, y, w, h = stream.take("4I")
        node, last, n = stream.take("IBQ")
        moves = unpack_moves(stream.raw(n), last)
        mean = list(stream.take(f"{stream.take('Q')[0]}f"))
        std = list(stream.take(f"{stream.take('Q')[0]}f"))
        perimeter, area, n_edges = stream.take("III")
        edges = [{"dst": d, "boundary": b} for d, b in (stream.take("II") for _ in range(n_edges))]
        yield {"node": node, "x": x, "y": y, "w": w, "h": h, "area": area, "perimeter": perimeter, "mean": mean, "std": std, "moves": moves, "edges": edges}


@dataclass
class Part(InputPartition):
    """Nodes of a file: where the first one starts, and how many."""

    path: str
    offset: int
    count: int


def parts_of(system: fs.FileSystem, path: str, name: str, range_bytes: int) -> list[Part]:
    """A file's ranges by its index, or all of it; a file shorter than its head says is an error."""
    size = system.get_file_info(path).size
    with system.open_input_file(path) as file:
        said, count = Stream(file, 0).take("QQ")
    if said + 8 > size:
        raise ValueError("the file is shorter than it says")
    index = f"{path}.idx"
    if system.get_file_info(index).type == fs.FileType.NotFound:
        return [Part(name, HEAD, count)]
    with system.open_input_stream(index) as file:
        places = np.frombuffer(file.read(), "<u8").astype(np.int64)
    starts, out, first = np.arange(len(places)) * INDEX_EVERY, [], 0
    while first < len(places):
        after = max(first + 1, int(np.searchsorted(places, places[first] + range_bytes, "right")) - 1)
        after = after if after < len(places) - 1 or places[-1] - places[first] >= range_bytes else len(places)
        until = int(starts[after]) if after < len(places) else count
        out.append(Part(name, int(places[first]), until - int(starts[first])))
        first = after
    return out


class RagReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.range_bytes = options["path"], int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))

    def partitions(self) -> list[Part]:
        system, path = file_system(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.File:
            files = [path]
        else:
            files = sorted(f.path for f in system.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and f.path.endswith(".dat"))
        return [part for f in files for part in parts_of(system, f, f if "://" not in self.path else self._uri(f, path), self.range_bytes)]

    def _uri(self, file: str, folder: str) -> str:
        return self.path if file == folder else posixpath.join(self.path, posixpath.basename(file))

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        system, path = file_system(part.path)
        with system.open_input_file(path) as file:
            rows = []
            for row in decode_nodes(Stream(file, part.offset), part.count):
                rows.append(row | {"file": part.path})
                if len(rows) == BATCH:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, ARROW)


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: the names that it wrote to, and those that they get."""

    names: list[tuple[str, str]]


class RagWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, rows: Iterator) -> Written:
        system, folder = file_system(self.path)
        system.create_dir(folder, recursive=True)
        names, tile, out, places, n, at = [], None, None, [], 0, 0

        def close() -> None:
            if out is not None:
                out.close()
                with system.open_output_stream(f"{names[-1][0]}.idx") as index:
                    index.write(np.array(places, "<u8").tobytes())

        for row in rows:
            if row.tile != tile or out is None:
                close()
                if any(final.endswith(f"/Graph_{row.tile}.dat") for _, final in names):
                    raise ValueError("rows of a tile must follow each other")
                tile, places, n, at = row.tile, [], 0, HEAD
                names.append((f"{folder}/_{uuid.uuid4().hex}", f"{folder}/Graph_{tile}.dat"))
                out = system.open_output_stream(names[-1][0])
                out.write(struct.pack("<QQ", row.n_bytes + 8, row.n_nodes))
            if n % INDEX_EVERY == 0:
                places.append(at)
            out.write(bytes(row.record))
            n, at = n + 1, at + len(row.record)
        close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = file_system(self.path)
        names = [pair for m in messages if m is not None for pair in m.names]
        if len({final for _, final in names}) < len(names):
            self.abort(messages)
            raise ValueError("a tile was written by two tasks: deal the rows by tile first")
        if self.overwrite and system.get_file_info(folder).type == fs.FileType.Directory:
            for old in system.get_file_info(fs.FileSelector(folder)):
                if old.path.endswith((".dat", ".dat.idx")):
                    system.delete_file(old.path)
        for made, final in names:
            system.move(f"{made}.idx", f"{final}.idx")
            system.move(made, final)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = file_system(self.path)
        for made, _ in (pair for m in messages if m is not None for pair in m.names):
            for name in (made, f"{made}.idx"):
                if system.get_file_info(name).type == fs.FileType.File:
                    system.delete_file(name)


class RagSource(DataSource):
    """Region adjacency graphs in ``.dat`` files."""

    @classmethod
    def name(cls) -> str:
        return "rag"

    def schema(self) -> str:
        return NODE_SCHEMA + ", file string"

    def reader(self, schema) -> RagReader:
        return RagReader(self.options)

    def writer(self, schema, overwrite: bool) -> RagWriter:
        return RagWriter(self.options, overwrite)


def register(spark: SparkSession) -> SparkSession:
    """The session, knowing the format ``rag``."""
    spark.dataSource.register(RagSource)
    return spark
