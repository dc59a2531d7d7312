"""The hole registry as JSON, and vectors of single polygons as numpy files."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def registry_of(holes: DataFrame) -> DataFrame:
    """(poly_id, n, first): how many holes a polygon has, and the first of them."""
    return holes.groupBy("poly_id").agg(F.count(F.lit(1)).alias("n"), F.min("hole_id").alias("first"))


def write_registry(holes: DataFrame, path: str) -> None:
    """One JSON object, polygon ids (as text, in the order of text) to [number, first]; polygons with holes are few."""
    entry = F.struct(F.col("poly_id").cast("string").alias("key"), F.array(F.col("n").cast("int"), F.col("first").cast("int")).alias("value"))
    listed = registry_of(holes).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry)))).alias("value"))
    listed.write.mode("overwrite").text(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(poly_id, n, first) of such a file."""
    found = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<int>>")).alias("key", "value"))
    return found.select(F.col("key").cast("int").alias("poly_id"), F.col("value")[0].cast("long").alias("n"), F.col("value")[1].alias("first"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, value) of one-dimensional integer ``.npy`` files: a value for each polygon, read where the files are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
                values = np.load(io.BytesIO(content), allow_pickle=False).astype(np.int64)
                for at in range(0, len(values), 65536):
                    part = values[at : at + 65536]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(at, at + len(part), dtype=np.int64)), pa.array(part)], names=["file", "place", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, place long, value long")
