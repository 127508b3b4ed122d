"""Getting this package's code to the executors."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows and bytes of a batch that Python workers get, unless the session says otherwise: texts and pages are long.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Those settings, with Spark's own values.
_BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": (("10000",), str(BATCH_ROWS)),
    "spark.sql.execution.arrow.maxBytesPerBatch": (("64MB", "67108864b", "67108864"), str(BATCH_BYTES)),
}

#: Python workers give large arrays back to the system as soon as they are freed.
_ENVIRONMENT = {
    "MALLOC_MMAP_THRESHOLD_": "131072", "MALLOC_TRIM_THRESHOLD_": "131072", "MALLOC_ARENA_MAX": "2",
    "ARROW_DEFAULT_MEMORY_POOL": "system",
}

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to this application's Python workers, once; on a cluster it need not be installed there.

    Spark fixes the files of a Python function as it is put into a plan, so every operator that has one calls this first.
    Also lowers the size of their batches if it is Spark's default, and sets how they free memory.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    for name, value in _ENVIRONMENT.items():
        spark.sparkContext.environment.setdefault(name, value)
    for name, (usual, value) in _BATCHES.items():
        if spark.conf.get(name) in usual:
            spark.conf.set(name, value)
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="graphloom-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "graphloom.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)


def private(columns: Iterable[str], *names: str) -> list[str]:
    """Column names made from ``names`` that none of ``columns`` has, in any case of letters."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(columns: Iterable[str]) -> list[str]:
    """The columns' names as Spark reads them, whatever characters they have."""
    return ["`" + c.replace("`", "``") + "`" for c in columns]


#: What a Python worker remembers from one task to the next, by kind of work, with a function that forgets it.
_held: dict[str, Callable[[], None]] = {}


def holds(kind: str, forget: Callable[[], None]) -> None:
    _held[kind] = forget


def turn_to(kind: str) -> None:
    """Called as a worker starts on some kind of work: what it remembers for other kinds goes."""
    for other in [k for k in _held if k != kind]:
        _held.pop(other)()
        trim()


def trim() -> None:
    """Give freed memory back to the system, holes between what is in use included, where the C library can."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
