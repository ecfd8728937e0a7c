"""Graph files ``.dat`` and their ``.dat.hdr`` sidecars.

A file holds a count of bytes and of nodes, then by node: box, contour (first pixel and
2-bit steps), attributes, and edges to other nodes by their first pixels. Values are
little-endian. ``rag`` has the format as a data source; here are graphs as its rows and back. The
contour gives a node's outer border; its members are the pixels inside, less those of
regions in its holes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.operators.graph import Graph, both_ways
from mosaiq.operators.vector import contours, portions
from mosaiq.sources import rag
from mosaiq.sources.rag import FILE_SCHEMA, NODE_SCHEMA, encode_node, file_system, pack_moves, unpack_moves
from mosaiq.sources.raster import Meta

__all__ = ["NODE_SCHEMA", "pack_moves", "unpack_moves"]


def graph_rows(graph: Graph, width: int, height: int) -> DataFrame:
    """Rows of ``NODE_SCHEMA``: nodes with contour and edges."""
    edges = both_ways(graph.edges).groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_list(F.struct("dst", "boundary"))).alias("edges"))
    rows = graph.nodes.join(contours(graph.members, width, height).select("node", "moves"), "node").join(edges, "node", "left")
    return rows.withColumn("edges", F.coalesce("edges", F.from_json(F.lit("[]"), "array<struct<dst:bigint,boundary:bigint>>"))).select("node", "x", "y", "w", "h", "area", "perimeter", "mean", "std", "moves", "edges")


def encoded_files(rows: DataFrame, tile: str) -> DataFrame:
    """Rows for the format ``rag``: each node's bytes, and how many nodes and bytes its file will have."""

    def records(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"tile": part["tile"], "node": part["node"], "record": [encode_node(r) for r in part.to_dict("records")]})

    made = rows.withColumn("tile", F.col(tile).cast("string")).mapInPandas(records, "tile string, node long, record binary")
    sizes = made.groupBy("tile").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum(F.octet_length("record")).alias("n_bytes"))
    return made.join(sizes, "tile").select(*[c.split()[0] for c in FILE_SCHEMA.split(", ")])


def write_files(files: DataFrame, folder: str, tile: str = "tile") -> None:
    """Write ``encoded_files`` as ``<folder>/Graph_<tile>.dat``, each by one task that streams it."""
    rag.register(files.sparkSession)
    files.repartition("tile").sortWithinPartitions("tile", "node").write.format("rag").mode("append").save(folder)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``NODE_SCHEMA`` and the file that they come from."""
    return rag.register(spark).read.format("rag").load(path)


def members_of_contours(rows: DataFrame, width: int) -> DataFrame:
    """``(pix, node)``: all pixels within each contour, by crossings of its pixel rows; see ``innermost`` for holes."""

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in portions(batch.column(1)):
                part = batch.slice(rows.start, rows.stop - rows.start)
                for pix, node in pixels_within(part.column(0).to_numpy(), np.diff(part.column(1).offsets.to_numpy()), part.column(1).flatten().to_numpy(), width):
                    yield pa.RecordBatch.from_arrays([pa.array(pix), pa.array(node)], ["pix", "node"])

    return rows.select("node", F.col("moves").cast("array<int>").alias("moves")).mapInArrow(inside, "pix long, node long")


#: Pixels that are written out at once.
PIXELS = 1 << 20


def pixels_within(nodes: np.ndarray, sizes: np.ndarray, steps: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pixels and their node, of many contours at once: on each pixel row a contour's sides down and up take turns, with its pixels between them."""
    g, first = np.repeat(np.arange(len(nodes)), sizes), np.repeat(np.cumsum(sizes) - sizes, sizes)

    def before(step: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where each step begins: the contour's start and the steps before it."""
        total = np.r_[0, np.cumsum(step)]
        return at[g] + total[:-1] - total[first]

    x = before((steps == 1).astype(np.int64) - (steps == 3), nodes % width)
    y = before((steps == 2).astype(np.int64) - (steps == 0), nodes // width)
    down, up = np.flatnonzero(steps == 2), np.flatnonzero(steps == 0)
    owner, rows, at = np.r_[g[down], g[up]], np.r_[y[down], y[up] - 1], np.r_[x[down], x[up]]
    order = np.lexsort((at, rows, owner))
    owner, rows, at = owner[order][::2], rows[order][::2], at[order].reshape(-1, 2)
    n = at[:, 1] - at[:, 0]
    ends, start = np.cumsum(n), 0
    while start < len(n):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] - n[start] + PIXELS, "right")))
        k = n[start:stop]
        ahead = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        yield np.repeat(rows[start:stop] * width + at[start:stop, 0], k) + ahead, np.repeat(nodes[owner[start:stop]], k)
        start = stop


def innermost(inside: DataFrame) -> DataFrame:
    """``(pix, node)``: each pixel once, with the region that it belongs to.

    A contour takes in the regions in its holes. Contours are nested or apart, and a region starts after those
    around it in scan order, so the last one to start that holds a pixel is its own.
    """
    return inside.groupBy("pix").agg(F.max("node").alias("node"))


def read_graph(spark: SparkSession, path: str, width: int) -> Graph:
    """The graph of a file, or of all files of a folder, checked for repeated nodes and dangling edges."""
    rows = read_files(spark, path)
    once = rows.dropDuplicates(["node"])
    each = once.select("node", F.explode("edges").alias("e")).select(F.least("node", "e.dst").alias("lo"), F.greatest("node", "e.dst").alias("hi"), "e.boundary")
    graph = Graph(once.select("node", "x", "y", "w", "h", "area", "perimeter", "mean", "std"), each.groupBy("lo", "hi").agg(F.max("boundary").alias("boundary")), innermost(members_of_contours(once, width)))
    repeated = rows.groupBy("file", "node").count().where("count > 1")
    dangling = graph.edges.select(F.explode(F.array("lo", "hi")).alias("node")).join(graph.nodes, "node", "left_anti")
    if not repeated.isEmpty():
        raise ValueError("a file holds a node twice")
    if not dangling.isEmpty():
        raise ValueError("an edge leads to a node that is not there")
    return graph


def write_header(path: str, image: str, meta: Meta) -> None:
    """The sidecar: image path, height, width, bands, origin, projection, a line each."""
    lines = [image, meta.height, meta.width, meta.bands, repr(meta.origin_x), repr(meta.origin_y), meta.projection]
    system, place = file_system(path)
    with system.open_output_stream(place) as out:
        out.write("".join(f"{line}\n" for line in lines).encode())


def read_header(spark: SparkSession, path: str) -> tuple[str, Meta]:
    """Image path and metadata of a sidecar; a missing file is an error."""
    text = spark.read.text(path, wholetext=True).first()[0].split("\n")
    image, height, width, bands, x, y = text[:6]
    return image, Meta(int(width), int(height), int(bands), float(x), float(y), "\n".join(text[6:]).strip())


def write_tables(graph: Graph, path: str) -> None:
    """The graph as Parquet tables: what Spark jobs hand to each other."""
    for name in ("nodes", "edges", "members"):
        getattr(graph, name).write.parquet(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str) -> Graph:
    return Graph(*(spark.read.parquet(f"{path}/{name}") for name in ("nodes", "edges", "members")))
