"""Files that every executor needs, wherever its libraries are installed."""

from __future__ import annotations

import os

from pyspark import SparkFiles
from pyspark.sql import SparkSession


def send_file(spark: SparkSession, path: str) -> str:
    """Give a file of the driver to all executors, once for each context; returns its name for sent_file()."""
    context = spark.sparkContext
    sent = context.__dict__.setdefault("_skeinlab_files", set())
    if path not in sent:
        context.addFile(path)
        sent.add(path)
    return os.path.basename(path)


def sent_file(name: str) -> str:
    """The file's path on this worker."""
    return SparkFiles.get(name)
