"""Small helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import drawlake
from drawlake.session import ensure_checkpoint_dir

#: A word is a run of characters other than the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the session's Python workers, so that they need not find it themselves.

    Spark serves the archive to every executor, also to those that join or restart later.
    """
    sc = spark.sparkContext
    root = Path(drawlake.__file__).parent
    if sc.applicationId in _shipped or not root.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


#: Parquet looks at the size of a page and of a row group only after a hundred rows; tables whose rows have megabytes look after each.
LONG_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size": str(16 << 20)}


def staged(df: DataFrame, name: str, long_rows: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts its lineage.

    The folder is ``spark.checkpoint.dir``, so every executor reaches the files and a lost
    executor costs only its running tasks.  With ``long_rows``, writers and readers hold a few rows at a time.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**LONG_ROWS if long_rows else {}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle() -> None:
    """Give memory that a finished task of a Python worker has freed back to the machine; workers live on for other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only some C libraries can
        pass


@contextmanager
def runtime_filters(spark: SparkSession) -> Iterator[None]:
    """Let Spark drop rows by a Bloom filter of the selective side before a join shuffles them, whatever the scan's size.

    Holds for jobs that run inside; the filter's size limits stay those of the session.
    """
    key = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "0")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))
