"""Tables and folders that are replaced as a whole: numbered versions and a commit marker written last.

``<path>/v<number>`` holds a version, ``<path>/_commits/<number>`` says that it is complete. The
current version is the one with the largest marker. A writer fills a new folder, then puts the marker
(a rename, which is atomic on file systems and a single put on object stores), then removes versions
older than the last ``keep``. A crash at any point leaves the version before it whole and current; a
reader sees one version or the next, never a mixture. What a failed attempt left behind is replaced by
the next one with the same number.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    """Hadoop's file system and path object of ``path``: the same storage that Spark writes to."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, where = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def _remove(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def version_path(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/v{version:012d}"


def committed(spark: SparkSession, path: str) -> list[int]:
    """The numbers of complete versions, ascending."""
    return [int(n) for n in _names(spark, f"{path.rstrip('/')}/_commits") if n.isdigit()]


def current(spark: SparkSession, path: str) -> int | None:
    """The number of the current version, or None before the first."""
    return max(committed(spark, path), default=None)


def current_path(spark: SparkSession, path: str) -> str:
    """The folder of the current version."""
    version = current(spark, path)
    if version is None:
        raise FileNotFoundError(f"nothing has been published in {path}")
    return version_path(path, version)


def commit(spark: SparkSession, path: str, version: int) -> None:
    """Makes a version current."""
    folder = f"{path.rstrip('/')}/_commits"
    fs, target = _at(spark, f"{folder}/{version:012d}")
    _, temp = _at(spark, f"{folder}/.{version:012d}-{uuid.uuid4().hex}")
    fs.create(temp, True).close()
    if not fs.rename(temp, target) and not fs.exists(target):
        raise OSError(f"could not commit version {version} of {path}")


def publish(spark: SparkSession, path: str, version: int, write: Callable[[str], None], keep: int = 2) -> str:
    """Lets ``write`` fill the folder of ``version`` and makes it current; the last ``keep`` versions stay for readers."""
    folder = version_path(path, version)
    _remove(spark, folder)  # of an attempt that failed
    write(folder)
    commit(spark, path, version)
    done = committed(spark, path)
    for old in done[: max(0, len(done) - keep)]:
        # The marker goes first: a version is never current without its folder.
        _remove(spark, f"{path.rstrip('/')}/_commits/{old:012d}")
        _remove(spark, version_path(path, old))
    return folder
