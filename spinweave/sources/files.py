"""File formats: packed edge records, spins and fields, text edge lists, dense matrices, protein structures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed values of the formats: little-endian records
EDGE = np.dtype([("src", "<u8"), ("dst", "<u8"), ("w", "<f8")])
SPIN, FIELD = np.dtype("<i1"), np.dtype("<f8")


def _decoded(files: DataFrame, dtype: np.dtype, fields: dict[str, str], slice_records: int = 1 << 20) -> DataFrame:
    """Records of binary files(path, content) as rows with the file's path and the record's place."""
    schema = "path string, place long, " + ", ".join(f"{k} {v}" for k, v in fields.items())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = memoryview(raw.as_buffer())
                if len(data) % dtype.itemsize:
                    raise ValueError(f"{path}: {len(data)} bytes aren't a whole number of {dtype.itemsize}-byte records")
                a = np.frombuffer(data, dtype)
                for at in range(0, len(a), slice_records):
                    part = a[at : at + slice_records]
                    cols = [part[k] for k in dtype.names] if dtype.names else [part]
                    kinds = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32()}
                    arrays = [pa.array(c.astype({"long": np.int64, "double": np.float64, "int": np.int32}[t]), kinds[t]) for c, t in zip(cols, fields.values(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part), pa.string()), pa.array(np.arange(at, at + len(part))), *arrays], ["path", "place", *fields])

    return files.mapInArrow(work, schema)


def _binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """edges(src, dst, w) of files of 24-byte records (two unsigned ids, a weight)."""
    return _decoded(_binary(spark, path), EDGE, {"src": "long", "dst": "long", "w": "double"}).select("src", "dst", "w")


def read_spins(spark: SparkSession, path: str) -> DataFrame:
    """(path, node, s) of files of signed bytes."""
    return _decoded(_binary(spark, path), SPIN, {"s": "int"}).withColumnRenamed("place", "node")


def read_field(spark: SparkSession, path: str) -> DataFrame:
    return _decoded(_binary(spark, path), FIELD, {"x": "double"}).withColumnRenamed("place", "node")


def read_modes(spark: SparkSession, path: str, n: int, binarised: bool = False) -> DataFrame:
    """(path, k, node, x): a file of modes one after another, n entries each."""
    rows = read_spins(spark, path).withColumnRenamed("s", "x") if binarised else read_field(spark, path)
    return rows.select("path", F.expr(f"cast(node div {n} as int)").alias("k"), (F.col("node") % n).alias("node"), F.col("x").cast("double").alias("x"))


def read_upper_matrix(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(i, j, v) of an upper triangle with its diagonal, row by row."""
    # row i begins at i * n - i * (i - 1) / 2
    row = F.floor((F.lit(2 * n + 1) - F.sqrt(F.lit(float((2 * n + 1) ** 2)) - 8 * F.col("node"))) / 2).cast("long")
    return read_field(spark, path).withColumn("i", row).withColumn("j", F.col("node") - (F.col("i") * n - F.expr("i * (i - 1) div 2")) + F.col("i")).select("i", "j", F.col("x").alias("v"))


def read_edge_text(spark: SparkSession, path: str) -> DataFrame:
    """edges of "i j w" lines, each link in both directions or once."""
    lines = spark.read.schema("i long, j long, w double").option("sep", " ").csv(path)
    return lines.where("i <> j").select(F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst"), F.coalesce("w", F.lit(1.0)).alias("w")).distinct()


def write_edge_text(edges: DataFrame, path: str) -> None:
    from ..operators.graph import both_ways

    both_ways(edges).repartitionByRange("i").sortWithinPartitions("i", "j").write.option("sep", " ").csv(path)


class EdgeRecords:
    """Batches of edges to files of packed records: ``edges.write.format("edge_records").save(folder)`` after register()."""

    @staticmethod
    def register(spark: SparkSession) -> None:
        import os
        import uuid

        from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

        class Writer(DataSourceArrowWriter):
            def __init__(self, folder: str):
                self.folder = folder

            def write(self, iterator):
                os.makedirs(self.folder, exist_ok=True)
                name = os.path.join(self.folder, f"part-{uuid.uuid4().hex}.bin")
                with open(name + ".tmp", "wb") as f:
                    for b in iterator:
                        a = np.empty(b.num_rows, EDGE)
                        for k in EDGE.names:
                            a[k] = b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
                        f.write(a.tobytes())
                message = WriterCommitMessage()
                message.name = name
                return message

            def commit(self, messages):
                for m in messages:
                    if m:
                        os.replace(m.name + ".tmp", m.name)

            def abort(self, messages):
                for m in messages:
                    if m and os.path.exists(m.name + ".tmp"):
                        os.remove(m.name + ".tmp")

        class Source(DataSource):
            @classmethod
            def name(cls):
                return "edge_records"

            def schema(self):
                return "src long, dst long, w double"

            def writer(self, schema, overwrite):
                return Writer(self.options["path"])

        spark.dataSource.register(Source)


def read_atoms(spark: SparkSession, path: str, only: str | None = None) -> DataFrame:
    """(path, idx, atom, residue, resseq, x, y, z) of ATOM lines of protein structure files, by their fixed columns."""
    from pyspark.sql import Window

    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("line")).where(F.col("value").startswith("ATOM"))
    cut = lambda a, n, t: F.trim(F.substring("value", a, n)).cast(t)
    a = text.select("path", "line", cut(13, 4, "string").alias("atom"), cut(18, 3, "string").alias("residue"), cut(23, 4, "int").alias("resseq"), cut(31, 8, "double").alias("x"), cut(39, 8, "double").alias("y"), cut(47, 8, "double").alias("z"))
    if only:
        a = a.where(F.col("atom") == only)
    return a.withColumn("idx", F.row_number().over(Window.partitionBy("path").orderBy("line")) - 1).select("path", "idx", "atom", "residue", "resseq", "x", "y", "z")


def structure_lines(atoms: DataFrame) -> DataFrame:
    """(path, idx, line): ATOM lines of Calpha atoms."""
    return atoms.select("path", "idx", F.format_string("ATOM  %5d  CA  %3s A%4d    %8.3f%8.3f%8.3f  1.00  0.00           C", F.col("idx") + 1, "residue", "resseq", "x", "y", "z").alias("line"))
