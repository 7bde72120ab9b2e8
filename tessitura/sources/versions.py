"""Versions of a small table or document under one path: whole folders that never change, and a pointer per version.

A version is committed by creating its pointer, which the store lets one writer do; readers follow the last pointer.
So there is no moment without rows, a writer that dies leaves only a folder nobody points to, and old versions stay
readable until they are cleared.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class StaleVersion(Exception):
    """Another writer has committed the version first."""


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of a path of any store that Spark reads."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def put_once(spark: SparkSession, path: str, content: str) -> bool:
    """Create ``path`` with its content at once; False, and nothing changed, if it is there.

    Safe on local files (a hard link is made or refused) and on HDFS (a rename that does not overwrite); other
    stores promise neither to every writer, so they are refused.
    """
    fs, target = hadoop_path(spark, path)
    fs.mkdirs(target.getParent())
    real = fs.resolvePath(target.getParent()).toUri()
    scheme = real.getScheme()
    if scheme == "file":
        beside = os.path.join(real.getPath(), f".{uuid.uuid4().hex}")
        with open(beside, "w", encoding="utf-8") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(beside, os.path.join(real.getPath(), target.getName()))
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(beside)
    if scheme != "hdfs":
        raise ValueError(f"{scheme}: this store cannot create a pointer for one writer alone; use hdfs or local files")
    beside = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(beside, False)
    out.write(bytearray(content.encode()))
    out.close()
    try:
        if fs.exists(target):
            return False
        context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
        context.rename(beside, target, spark._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except Exception as error:  # the exception of the JVM has no class of its own here
        if "FileAlreadyExists" not in str(error):
            raise
        return False
    finally:
        fs.delete(beside, False)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions, the oldest first."""
    fs, folder = hadoop_path(spark, f"{path.rstrip('/')}/_versions")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()) if fs.exists(folder) else []


def pointer(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict] | None:
    """(number, content) of a version, the last one if none is named; None if there is none."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        return None
    number = known[-1] if version is None else version
    fs, at = hadoop_path(spark, f"{path.rstrip('/')}/_versions/{number:020d}")
    stream = fs.open(at)
    try:
        return number, json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, content: dict, base: int) -> int:
    """Make ``content`` the version after ``base`` (-1: the first); StaleVersion if there is one already."""
    if not put_once(spark, f"{path.rstrip('/')}/_versions/{base + 1:020d}", json.dumps(content)):
        raise StaleVersion(f"{path} has a version after {base}")
    return base + 1


def replace(spark: SparkSession, path: str, write: Callable[[str], None], keep: int = 2) -> int:
    """Write a new folder by ``write(folder)`` and make it the last version, whoever else commits; ``keep`` versions stay."""
    fs, root = hadoop_path(spark, path)
    fs.mkdirs(root)
    fs.setPermission(root, spark._jvm.org.apache.hadoop.fs.permission.FsPermission("700"))
    name = f"data-{uuid.uuid4().hex}"
    write(f"{path.rstrip('/')}/{name}")
    while True:
        known = versions(spark, path)
        try:
            number = commit(spark, path, {"data": name}, known[-1] if known else -1)
            break
        except StaleVersion:
            continue
    for old in versions(spark, path)[:-keep]:
        found = pointer(spark, path, old)
        if found and found[1].get("data"):
            for gone in (f"{path.rstrip('/')}/{found[1]['data']}", f"{path.rstrip('/')}/_versions/{old:020d}"):
                fs.delete(hadoop_path(spark, gone)[1], True)
    return number


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the last version."""
    found = pointer(spark, path)
    return None if found is None else f"{path.rstrip('/')}/{found[1]['data']}"
