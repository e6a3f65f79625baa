"""What the corpus operators share: the cluster's shared folder, written tables and column selection.

Every operator takes a DataFrame and the names of its id and text columns, reads only those two, and returns
only the columns its docstring lists. Extra input columns are therefore ignored, whatever their names.
"""

from __future__ import annotations

import gc
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrine.session import shared_dir, spread, work_path, written

__all__ = ["ID", "TEXT", "documents", "held_out", "partitions", "partitions_for", "release", "shared_dir", "tasks_for", "work_path", "written"]

#: Internal names, chosen so that they meet no output column.
ID, TEXT = "doc_id", "text"
#: Tables that Spark knows no size of count as 2^63 bytes, and a few columns of one as their share of that.
UNKNOWN_BYTES = 1 << 52


def documents(df: DataFrame, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """(doc_id, text) with null texts made empty, in as many tasks as the size asks for."""
    rows = df.select(df[id_col].alias(ID), F.coalesce(df[text_col].cast("string"), F.lit("")).alias(TEXT))
    dealt = spread(rows)
    return dealt if dealt is not rows else rows.coalesce(tasks_for(df))


def tasks_for(df: DataFrame, bytes_each: int = 8 << 20) -> int:
    """Tasks, and files of a written table, that df's estimated size asks for: one for each bytes_each, four for each
    core at least. Used to coalesce only, so a table in very many small parts does not become as many small files."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(1 << 20, max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-size // bytes_each)))  # unknown sizes are estimated very large


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True where crc32 of the id written as text leaves remainder 0; such rows are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def partitions_for(df: DataFrame, bytes_each: int = 64 << 20) -> int:
    """Partitions that groups of df's rows are dealt to: the session's number, or more where df's estimated size asks
    for them, so that a partition does not grow with the table. A table of unknown size gets the session's number."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(partitions(df.sparkSession), min(1 << 18, -(-size // bytes_each) if size < UNKNOWN_BYTES else 0))


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps now: it does so once nothing refers to their plans.

    Objects here hold objects there, which are let go a moment after, so one pass is not enough.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
