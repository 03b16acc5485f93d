"""Small files and renames through Hadoop's file system API, so that paths may
name any store that Spark reads."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def listing(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def size(spark: SparkSession, path: str) -> int:
    fs, p = _fs(spark, path)
    return fs.getContentSummary(p).getLength()


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename, or raise: the file system's own answer is a flag."""
    fs, s = _fs(spark, source)
    _, t = _fs(spark, target)
    fs.mkdirs(t.getParent())
    try:
        done = fs.rename(s, t)
    except Py4JJavaError as e:
        raise OSError(f"{source} could not be renamed to {target}") from e
    if not done:
        raise OSError(f"{source} could not be renamed to {target}")


def replace(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder or file over another. What was there before goes to
    ``target.old`` until the new one is in place, and comes back if that fails;
    `settled` finds it after a crash in between."""
    old = f"{target}.old"
    if exists(spark, target):
        delete(spark, old)
        move(spark, target, old)
    try:
        move(spark, source, target)
    except Exception:
        if exists(spark, old) and not exists(spark, target):
            move(spark, old, target)
        raise
    delete(spark, old)


def settled(spark: SparkSession, target: str) -> bool:
    """Whether ``target`` is there, after bringing back what a crash in the midst
    of `replace` left as ``target.old``."""
    if exists(spark, target):
        return True
    if exists(spark, f"{target}.old"):
        move(spark, f"{target}.old", target)
        return True
    return False


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
