"""Small files beside the tables, through the file system that Spark itself uses."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, system = _at(spark, path)
    return system.exists(place)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, sorted; none if there is no such folder."""
    place, system = _at(spark, path)
    if not system.exists(place):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(place))


def read(spark: SparkSession, path: str) -> str:
    place, system = _at(spark, path)
    stream = system.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file that is there whole or not at all; False if it was there already.

    The text goes to a file of its own first, which a rename that never replaces
    makes visible. Of several writers of one path, one wins.
    """
    jvm = spark._jvm
    final, system = _at(spark, path)
    system.mkdirs(final.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(final.getParent(), f".{uuid.uuid4().hex}")
    stream = system.create(draft, False)
    try:
        stream.write(text.encode("utf-8"))
    finally:
        stream.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    plainly = spark.sparkContext._gateway.new_array(rename, 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(draft, final, plainly)
    except Exception:
        system.delete(draft, False)
        if system.exists(final):
            return False
        raise
    return True
