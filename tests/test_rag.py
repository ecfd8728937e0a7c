import os
import struct

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from mosaiq.sources import dat, rag
from test_vector_and_sources import HOLE, regions


def rows_of(spark, n=5000):
    """Nodes of two tiles with odd shapes: no edges, many edges, contours of all lengths, no bands."""
    each = spark.range(n).withColumnRenamed("id", "node")
    step = F.col("node") % 7
    stats = lambda v: F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: k * v)
    return each.select(
        "node", F.col("node").cast("int").alias("x"), F.lit(3).alias("y"), F.lit(1).alias("w"), F.lit(2).alias("h"), (step + 1).alias("area"), (step * 2).alias("perimeter"),
        F.when(step > 0, stats(F.col("node") / 4)).otherwise(F.array().cast("array<double>")).alias("mean"), stats(step / 2).alias("std"),
        F.transform(F.sequence(F.lit(0), step), lambda k: (k % 4).cast("int")).alias("moves"),
        F.when(step == 3, F.transform(F.sequence(F.lit(0), F.lit(40)), lambda k: F.struct(k.cast("long").alias("dst"), (k + 1).cast("long").alias("boundary")))).otherwise(F.from_json(F.lit("[]"), "array<struct<dst:bigint,boundary:bigint>>")).alias("edges"),
        F.when(F.col("node") < 4000, "a").otherwise("b").alias("tile"),
    )


def test_files_are_read_in_ranges(spark, tmp_path):
    made = rows_of(spark)
    path = f"file://{tmp_path}/graphs"
    dat.write_files(dat.encoded_files(made, "tile"), path)
    assert sorted(os.listdir(tmp_path / "graphs")) == ["Graph_a.dat", "Graph_a.dat.idx", "Graph_b.dat", "Graph_b.dat.idx"]
    expected = sorted(map(tuple, made.drop("tile").collect()))
    for at in (path, str(tmp_path / "graphs")):
        for size, parts in ((1, 5), (10**9, 2), (150_000, None)):
            back = rag.register(spark).read.format("rag").option("rangeBytes", size).load(at)
            assert parts is None or back.rdd.getNumPartitions() == parts
            assert sorted(map(tuple, back.drop("file").collect())) == expected
    assert {(r[0].rsplit("/", 1)[1], r[1]) for r in back.groupBy("file").count().collect()} == {("Graph_a.dat", 4000), ("Graph_b.dat", 1000)}
    os.remove(tmp_path / "graphs" / "Graph_a.dat.idx")  # a file from elsewhere
    assert rag.register(spark).read.format("rag").load(f"{path}/Graph_a.dat").count() == 4000
    assert sorted(map(tuple, dat.read_files(spark, path).drop("file").collect())) == expected


def test_bytes_of_a_file(spark, tmp_path):
    _, g, width, height = regions(spark, ["ab"])
    dat.write_files(dat.encoded_files(dat.graph_rows(g, width, height).withColumn("t", F.lit(7)), "t"), str(tmp_path / "g"))
    data = (tmp_path / "g" / "Graph_7.dat").read_bytes()
    size, count = struct.unpack_from("<QQ", data)
    assert (size, count) == (len(data) - 8, 2) and struct.unpack_from("<4IIBQB", data, 16) == (0, 0, 1, 1, 0, 0, 1, 1 | 2 << 2 | 3 << 4)


def test_overwriting_and_faults(spark, tmp_path):
    path = str(tmp_path / "g")
    files = dat.encoded_files(rows_of(spark, 100), "tile")
    dat.write_files(files, path)
    other = dat.encoded_files(rows_of(spark, 10).withColumn("tile", F.lit("c")), "tile")
    rag.register(spark)
    other.coalesce(1).write.format("rag").mode("overwrite").save(path)
    assert sorted(os.listdir(path)) == ["Graph_c.dat", "Graph_c.dat.idx"]
    with pytest.raises(PySparkException, match="two tasks"):
        other.repartition(2, "node").write.format("rag").mode("append").save(path)
    assert sorted(os.listdir(path)) == ["Graph_c.dat", "Graph_c.dat.idx"]
    with open(f"{path}/Graph_c.dat", "r+b") as cut:
        cut.truncate(200)
    with pytest.raises(PySparkException, match="shorter"):
        dat.read_files(spark, path).count()
    with pytest.raises(PySparkException):
        dat.read_files(spark, str(tmp_path / "none")).count()


def test_graphs_of_several_files(spark, tmp_path):
    _, g, width, height = regions(spark, HOLE)
    rows = dat.graph_rows(g, width, height).withColumn("tile", (F.col("node") % 4).cast("string"))
    dat.write_files(dat.encoded_files(rows, "tile"), f"file:{tmp_path}/g")
    back = dat.read_graph(spark, f"file:{tmp_path}/g", width)
    assert sorted(map(tuple, back.members.collect())) == sorted(map(tuple, g.members.collect()))
    with pytest.raises(ValueError, match="not there"):
        dat.read_graph(spark, f"file:{tmp_path}/g/Graph_2.dat", width)
