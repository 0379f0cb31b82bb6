"""Folders on whatever file system the session's paths lead to."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below `path`, none if it is not there."""
    fs, at = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []


def files(spark: SparkSession, path: str) -> list[str]:
    """Names of the data files directly below `path`."""
    fs, at = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isFile() and s.getPath().getName().startswith("part-"))


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a write to this folder has been committed."""
    fs, at = _at(spark, path)
    return fs.exists(spark._jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS"))


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)
