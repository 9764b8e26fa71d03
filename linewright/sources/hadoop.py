"""Small path questions answered by the cluster's file system."""

from __future__ import annotations

import re
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def _resolve(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _resolve(spark, path)
    return fs.exists(hadoop_path)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a directory; empty if it does not exist."""
    fs, hadoop_path = _resolve(spark, path)
    if not fs.exists(hadoop_path):
        return []
    return [status.getPath().getName() for status in fs.listStatus(hadoop_path)]


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder if it exists."""
    fs, hadoop_path = _resolve(spark, path)
    fs.delete(hadoop_path, True)


def make_dir(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _resolve(spark, path)
    return fs.mkdirs(hadoop_path)


def absolute_path(spark: SparkSession, path: str) -> str:
    """Path part of the fully qualified location, without scheme and authority."""
    fs, hadoop_path = _resolve(spark, path)
    return fs.makeQualified(hadoop_path).toUri().getPath()


def as_pattern(path: str) -> str:
    """A path as a glob pattern that matches just this path."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def below(spark: SparkSession, uri: str, root: str) -> str:
    """Path of a file URI relative to a root; empty if it is the root."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jvm.java.net.URI(uri)).toUri().getPath()
    return path[len(absolute_path(spark, root).rstrip("/")) + 1 :]


def listed_names(scan: DataFrame) -> DataFrame:
    """(path): URIs of all files that Spark has listed for a scan; they stay in the JVM."""
    spark = scan.sparkSession
    jvm = spark.sparkContext._jvm
    names = jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(scan._jdf.inputFiles())
    return DataFrame(spark._jsparkSession.createDataset(names, jvm.org.apache.spark.sql.Encoders.STRING()).toDF(), spark).toDF("path")


def is_hidden(name: str) -> bool:
    """Whether Spark's file sources pass over a name that they come to while listing a folder."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


@dataclass(frozen=True)
class Hidden:
    """Hidden folders and hidden log files below a root."""

    folders: list[str]
    files: list[tuple[str, int]]


def hidden_below(spark: SparkSession, path: str, suffixes: str) -> Hidden:
    """URIs of hidden folders, and URIs and sizes of hidden files with a suffix (a glob), at any depth below `path` or itself.

    The file system matches names level by level, so the driver is told of hidden names only, whatever else there is.
    """
    fs, root = _resolve(spark, path)
    if not fs.exists(root):
        return Hidden([], [])
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    base = fs.makeQualified(root).toString().rstrip("/")
    level = as_pattern(base)
    folders, files = [], []
    if not fs.getFileStatus(root).isDirectory():
        if not is_hidden(base_name(path)):
            return Hidden([], [])
        return Hidden([], [(status.getPath().toUri().toString(), status.getLen()) for status in fs.globStatus(make(level)) or []])
    while len(fs.globStatus(make(f"{level}/*")) or []):
        for status in fs.globStatus(make(f"{level}/[._]*")) or []:
            if status.isDirectory() and is_hidden(status.getPath().getName()):
                folders.append(status.getPath().toString())
        for status in fs.globStatus(make(f"{level}/[._]{suffixes}")) or []:
            if status.isFile() and is_hidden(status.getPath().getName()):
                files.append((status.getPath().toUri().toString(), status.getLen()))
        level += "/*"
    return Hidden(folders, files)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small new file; an existing one is an error."""
    fs, hadoop_path = _resolve(spark, path)
    stream = fs.create(hadoop_path, False)
    stream.write(bytearray(text, "utf-8"))
    stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, hadoop_path = _resolve(spark, path)
    stream = fs.open(hadoop_path)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a file to a name that nobody has taken, in one step; False if it is taken."""
    jvm = spark.sparkContext._jvm
    fs, target_path = _resolve(spark, target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(jvm.org.apache.hadoop.fs.Path(source), target_path, no_options)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def base_name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]
