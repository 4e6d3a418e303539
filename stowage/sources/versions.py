"""Numbered versions of a folder: whoever creates the next number's file first has committed it.

A version is a small JSON document that names the tables it consists of. Tables
are written beside older ones before the version is created, and nothing that
may be read is overwritten, so a reader sees one version whole.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from stowage.sources.inventory import _exists


class StaleVersion(RuntimeError):
    """Another version was committed since the one that was edited."""


@dataclass(frozen=True)
class Version:
    number: int
    content: dict


def create_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file whole; False if it is there already, also if another writer was faster.

    A hard link on a local file system and a rename on others fail if the name
    is taken. HDFS and file systems like it rename in one step; object stores
    that do not must be given a store that does.
    """
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = name.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(name):
        return False
    system.mkdirs(name.getParent())
    beside = f".{uuid.uuid4().hex}.tmp"
    if system.getUri().getScheme() == "file":
        final = name.toUri().getPath()
        draft = os.path.join(os.path.dirname(final), beside)
        with open(draft, "w", encoding="utf-8") as out:
            out.write(text)
        try:
            os.link(draft, final)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
    draft = spark._jvm.org.apache.hadoop.fs.Path(name.getParent(), beside)
    out = system.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if system.rename(draft, name):
        return True
    system.delete(draft, False)
    return False


def latest(spark: SparkSession, folder: str) -> Version | None:
    """The newest version; names are compared, and one document is read."""
    if not _exists(spark, f"{folder}/log"):
        return None
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(f"{folder}/log")
    newest = files.agg(F.max("path").alias("path")).first().path
    if newest is None:
        return None
    return Version(int(os.path.basename(newest)[:-5]), json.loads(spark.read.text(newest, wholetext=True).first().value))


def commit(spark: SparkSession, folder: str, after: Version | None, content: dict) -> Version:
    """The version behind ``after`` (None: the first); ``StaleVersion`` if there is one already."""
    number = after.number + 1 if after else 1
    if not create_if_absent(spark, f"{folder}/log/{number:020d}.json", json.dumps(content)):
        raise StaleVersion(f"{folder} has moved on to version {number}")
    return Version(number, content)


def new_table(folder: str, name: str) -> str:
    """A path for a table of a version to be, below ``folder``."""
    return f"{folder}/tables/{name}-{uuid.uuid4().hex}"
