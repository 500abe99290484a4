"""Version numbers by compare and set: a number belongs to the attempt that creates its claim file first.

A claim names the attempt's record. Creating a file that must not exist is one atomic step of the file system, so of
any number of writers one gets the number and the others see it taken and try the next. Claims are never deleted or
written over: after a failure that the ledger knows, the number is claimed again under the next place, which again
only one writer can create. An attempt that vanished without a word keeps its number, and its files stay untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _file(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Whether the file was created here; one that exists is left as it is."""
    target, files = _file(spark, path)
    files.mkdirs(target.getParent())
    if files.getScheme() == "file":
        # Hadoop looks and then creates on such file systems, which lets two writers through; the system call does not.
        try:
            with open(target.toUri().getPath(), "x", encoding="utf-8") as out:
                out.write(text)
        except FileExistsError:
            return False
        return True
    try:
        out = files.create(target, False)
    except Py4JJavaError as error:
        if "exist" in str(error.java_exception).lower():
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def holder(spark: SparkSession, folder: str) -> tuple[int, str | None]:
    """The place of the newest claim of a version, -1 if there is none, and the record it names."""
    target, files = _file(spark, f"{folder}/claims")
    if not files.exists(target):
        return -1, None
    place = max((int(s.getPath().getName()) for s in files.listStatus(target) if s.getPath().getName().isdigit()), default=-1)
    if place < 0:
        return -1, None
    found = spark.read.text(f"{folder}/claims/{place}").first()
    return place, found.value if found else None


def claim(spark: SparkSession, folder_of: Callable[[int], str], first: int, record: str, failed: set[str]) -> int:
    """The lowest number from ``first`` on that this record gets; numbers of ``failed`` records are given again."""
    version = first
    while True:
        place, owner = holder(spark, folder_of(version))
        if place < 0 or owner in failed:
            if _create(spark, f"{folder_of(version)}/claims/{place + 1}", record):
                return version
        else:
            version += 1
