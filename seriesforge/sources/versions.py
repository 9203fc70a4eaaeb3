"""Versions below a root folder: write next to the old one, then switch.

``<root>/<version>/...`` holds the data and ``<root>/_versions/<number>`` a pointer: one line with the version's
name. A name says nothing about where the root lies, so a copied, moved or renamed folder reads, saves and cleans
up below itself alone. The pointer is written last, so a failed writer leaves the old version the newest.

A writer claims its number by creating the pointer, which fails if there is one (create if absent: atomic on HDFS and
on stores with conditional writes). Of two writers that started from the same version the later one thus finds its
number taken: it fails with :class:`ConcurrentSaveError`, or, where the new version doesn't build on
the old, takes the next number.
"""

from __future__ import annotations

import re
import time
import uuid
from typing import NamedTuple
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

FOLDER = "_versions"
NAME = re.compile(r"v\d{10}-\d{20}-[0-9a-f]{8}")      # no name can lead out of the root


class ConcurrentSaveError(RuntimeError):
    """Another writer published after the version that this one started from."""


class Claim(NamedTuple):
    """The version that a writer is about to write: nothing is written yet."""
    root: str
    number: int
    version: str

    @property
    def path(self) -> str:
        return f"{self.root}/{self.version}"


def _on_store(spark: SparkSession, path: str):
    """(file system, path) of Hadoop's file system API, which reaches every store that Spark reads."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _on_store(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def is_empty(spark: SparkSession, root: str) -> bool:
    """Whether there is nothing at ``root``: no version, and no file of any other kind."""
    return not _names(spark, root)


def _line(spark: SparkSession, path: str) -> str:
    fs, p = _on_store(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def _numbers(spark: SparkSession, root: str) -> dict[int, str]:
    """Pointer names by number. (Pointers of an older layout are folders named as their version.)"""
    found = {}
    for name in _names(spark, f"{root}/{FOLDER}"):
        if name.isdecimal():
            found[int(name)] = name
        elif NAME.fullmatch(name):
            found.setdefault(int(name[1:11]), name)
    return found


def _version(spark: SparkSession, root: str, pointer: str) -> str | None:
    """The version a pointer names; None for one that is not written out (its writer failed in between)."""
    version = pointer if NAME.fullmatch(pointer) else _line(spark, f"{root}/{FOLDER}/{pointer}")
    if version and not NAME.fullmatch(version):
        raise ValueError(f"{root}/{FOLDER}/{pointer} names no version: {version!r}")
    return version or None


def _newest(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """(largest number claimed, newest version)."""
    numbers = _numbers(spark, root)
    for number in sorted(numbers, reverse=True):
        version = _version(spark, root, numbers[number])
        if version:
            return max(numbers), version
    return max(numbers, default=0), None


def newest(spark: SparkSession, root: str) -> str | None:
    """Path of the newest version, below ``root`` as the caller names it."""
    version = _newest(spark, root)[1]
    return f"{root}/{version}" if version else None


def begin(spark: SparkSession, root: str) -> Claim:
    number = _newest(spark, root)[0] + 1
    return Claim(root, number, f"v{number:010d}-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}")


def publish(spark: SparkSession, claim: Claim, keep: int | None = None, retry: bool = False) -> None:
    """Make a complete version the newest. If its number is taken: the next free one with ``retry``, else the version is
    removed and :class:`ConcurrentSaveError` raised. ``keep`` removes all but that many newest versions of this root."""
    root, number = claim.root, claim.number
    while not _created(spark, f"{root}/{FOLDER}/{number:010d}", claim.version):
        if not retry:
            _delete(spark, claim.path)
            raise ConcurrentSaveError(f"another writer published version {number} of {root!r} meanwhile")
        number = _newest(spark, root)[0] + 1
    if keep is not None:
        numbers = _numbers(spark, root)
        for old in sorted(numbers)[:-max(keep, 1)]:
            version = _version(spark, root, numbers[old])
            _delete(spark, f"{root}/{FOLDER}/{numbers[old]}")      # the pointer goes first
            if version:
                _delete(spark, f"{root}/{version}")


def _created(spark: SparkSession, path: str, text: str) -> bool:
    fs, p = _on_store(spark, path)
    local = fs.getUri().getScheme() == "file"
    if local:                   # a local file system's create looks first and then writes: here both must be one step
        fs.mkdirs(p.getParent())
        if not spark.sparkContext._jvm.java.io.File(p.toUri().getPath()).createNewFile():
            return False
    try:
        stream = fs.create(p, local)
    except Py4JJavaError as e:
        if fs.exists(p):
            return False
        raise e
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True


def versions_read(df: DataFrame, root: str) -> set[str]:
    """Versions of ``root`` whose files the plan of ``df`` reads."""
    fs, p = _on_store(df.sparkSession, root)
    below = _place(str(fs.makeQualified(p).toString())) + "/"
    rest = {place[len(below):] for place in map(_place, df.inputFiles()) if place.startswith(below)}
    return {name for name in (r.split("/")[0] for r in rest) if NAME.fullmatch(name)}


def _place(uri: str) -> str:
    """Store and path of a URI, whatever the number of slashes behind its scheme."""
    parts = urlparse(uri)
    return f"{parts.scheme}:{parts.netloc}{unquote(parts.path).rstrip('/')}"


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _on_store(spark, path)
    fs.delete(p, True)
