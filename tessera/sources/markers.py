"""Marker files that can be made once: what readers go by when several writers race, and some are lost midway."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system for a path, and the path as it takes it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


def make_once(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file that holds text, whole or not at all; False, and nothing changed, if there is one.

    The text is written to a hidden file beside it, which then gets the name without replacing
    a file of that name: by a link in a local file system, by a rename in others. A writer lost
    before that leaves a hidden file, which readers of the folder don't see.
    """
    fs, at = file_system(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(at.getParent(), f"_{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            try:
                os.link(*[unquote(urlparse(fs.makeQualified(p).toString()).path) for p in (draft, at)])
            except FileExistsError:
                return False
            return True
        options = spark._jvm.org.apache.hadoop.fs
        never = spark.sparkContext._gateway.new_array(getattr(options, "Options$Rename"), 1)
        never[0] = getattr(options, "Options$Rename").NONE
        try:
            options.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(draft, at, never)
        except Py4JJavaError:
            if fs.exists(at):
                return False
            raise
        return True
    finally:
        fs.delete(draft, False)


def read_text(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    fs, at = file_system(spark, path)
    opened = fs.open(at)
    try:
        return bytes(opened.readAllBytes()).decode()
    finally:
        opened.close()
