"""A network of similar entries that is kept up to date by batches, in place of deleting and building all edges again.

A batch compares the entries that are new or have another vector with all others and among themselves; nothing else is
compared again. Edges carry the batch that made them, and an edge holds while neither of its ends has changed since:

    path/entries/batch=N/    id, embedding (null: the entry was taken out) of what the batch changed
    path/edges/batch=N/      a, b, score of the edges it made
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrine.functions import vectors as V
from vectrine.operators import search
from vectrine.session import scratch, written


class SimilarityNetwork:
    """Edges a < b between entries whose cosine is over the threshold. A batch that runs twice overwrites its own
    folders; batches are numbered in the order they come."""

    def __init__(self, spark: SparkSession, path: str, threshold: float = 0.7) -> None:
        self.spark, self.path, self.threshold = spark, path, threshold

    def _read(self, name: str, schema: str, before: int | None) -> DataFrame:
        path = f"{self.path}/{name}"
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], f"{schema}, batch long")
        rows = self.spark.read.schema(f"{schema}, batch long").parquet(path)
        return rows if before is None else rows.where(F.col("batch") < before)

    def _latest(self, before: int | None) -> DataFrame:
        """(id, embedding, batch): the last change of each entry."""
        rows = self._read("entries", "id long, embedding array<double>", before)
        return rows.groupBy("id").agg(F.max_by(F.struct("embedding", "batch"), "batch").alias("r")).select("id", "r.*")

    def entries(self, before: int | None = None) -> DataFrame:
        """(id, embedding) of the entries that are in the network."""
        return self._latest(before).where("embedding is not null").select("id", "embedding")

    def edges(self, before: int | None = None) -> DataFrame:
        """(a, b, score) of the edges that hold. The ends' last changes are narrow and are joined twice."""
        changed = self._latest(before).select("id", F.col("batch").alias("since"))
        rows = self._read("edges", "a long, b long, score double", before)
        for end in ("a", "b"):
            rows = rows.join(changed.select(F.col("id").alias(end), "since"), end).where("batch >= since").drop("since")
        return rows.select("a", "b", "score")

    def update(self, changes: DataFrame, batch: int, id_col: str = "vec_id", vector_col: str = "embedding") -> dict[str, int]:
        """Takes new entries, other vectors of old ones, and (a null vector) removals; how many entries and edges came.

        An entry that comes with the vector it has is no change. Of rows that repeat an id the greatest vector counts, a
        removal only where the id has no other row; rows without an id are left out.
        """
        with scratch(self.spark):
            rows = changes.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(V.doubles(F.col(vector_col))).alias("embedding"))
            known = self.entries(batch)
            old = known.select("id", F.col("embedding").alias("old"))
            fresh = rows.join(old, "id", "left").where(~F.col("embedding").eqNullSafe(F.col("old"))).select("id", "embedding")
            at = f"{self.path}/entries/batch={batch}"
            fresh.write.mode("overwrite").parquet(at)
            fresh = self.spark.read.schema("id long, embedding array<double>").parquet(at)
            rest = written(known.join(fresh.select("id"), "id", "left_anti"), "rest")
            there = fresh.where("embedding is not null")
            found = search.pairs_between(there, rest, self.threshold, True, "id").unionByName(search.similar_pairs(there, self.threshold, True, "id"))
            found.write.mode("overwrite").parquet(f"{self.path}/edges/batch={batch}")
        made = self.spark.read.schema("a long, b long, score double").parquet(f"{self.path}/edges/batch={batch}")
        return {"entries": fresh.count(), "edges": made.count()}
