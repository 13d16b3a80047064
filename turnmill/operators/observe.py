"""What every stage of a build keeps, counted in the pass that does the work.

``Stages.watch`` marks a point of a plan; when the plan has run once, ``report`` tells how many rows passed each point, how
many the stage dropped, sums of lengths, and a few rows.  The rows are a sample that partitions can merge: one row per residue of
an id's hash, the one with the smallest hash, so that it depends on the data alone and stays as small as asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

REPORT = "stage_no int, stage string, n_rows long, n_dropped long, total long, longest long, sample array<string>"


class Stages:
    """The watched points of one plan, in the order in which they were marked."""

    def __init__(self, keep: int = 3) -> None:
        self.keep = keep
        self.points: list[tuple[str, Observation]] = []

    def watch(self, df: DataFrame, stage: str, *, id_col: str, length: Column | None = None, show: Column | None = None) -> DataFrame:
        """``df`` as it is.  ``length`` is summed (null: 0); ``show`` is the text kept of a sampled row (the row as JSON)."""
        text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])) if show is None else show.cast("string")
        h = F.xxhash64(F.col(id_col))
        n = (F.lit(0) if length is None else length).cast("long")
        samples = [F.min(F.when(F.pmod(h, F.lit(self.keep)) == k, F.struct(h.alias("h"), text.alias("text")))).alias(f"sample{k}")
                   for k in range(self.keep)]
        seen = Observation()
        self.points.append((stage, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(n), F.lit(0)).alias("total"), F.coalesce(F.max(n), F.lit(0)).alias("longest"), *samples)

    def rows(self) -> list[tuple]:
        """One tuple of ``REPORT`` per point; waits for the plan's first run."""
        out, before = [], None
        for k, (stage, seen) in enumerate(self.points):
            got = seen.get
            texts = [got[f"sample{j}"]["text"] for j in range(self.keep) if got[f"sample{j}"] is not None]
            out.append((k, stage, got["n"], 0 if before is None else before - got["n"], got["total"], got["longest"], texts))
            before = got["n"]
        return out

    def report(self, spark: SparkSession) -> DataFrame:
        """``REPORT``, one row per point: a table of as many rows as there are stages."""
        return spark.createDataFrame(self.rows(), REPORT)
