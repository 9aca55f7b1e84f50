"""Layers kept by key: a folder for each key, so that one is read, written anew or deleted without touching the others."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession


def put(layers: DataFrame, path: str, key: str) -> None:
    """Writes layers; those of keys that are there already are replaced as a whole, other keys stay."""
    layers.write.partitionBy(key).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def get(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All layers; a filter on the key reads its folders only."""
    return spark.read.schema(schema).parquet(path)


def delete(spark: SparkSession, path: str, key: str, value: str) -> bool:
    """Deletes the layer of a key; whether there was one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{key}={quote(value, safe='')}")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
