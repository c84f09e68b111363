"""Row checks on streams of cues: the same expressions as in batch, joined to the platform dimension, with late data bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.operators import platforms as pl
from cueloom.operators import qc


def defects(cues: DataFrame, platforms: DataFrame) -> DataFrame:
    """A stream of cues (file_id, cue_no, start_ms, end_ms, text, platform_key) to defect rows. The gap check needs state: see `ordered`."""
    joined = qc.row_defects(pl.join_platforms(cues, platforms))
    return qc.exploded(joined, "file_id", F.col("cue_no").alias("line_id")).select("file_id", "line_id", "d.*")


def defect_counts(cues: DataFrame, platforms: DataFrame, at: str = "ts", every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Defects by type in windows of event time; cues later than `late` are left out."""
    joined = qc.row_defects(pl.join_platforms(cues.withWatermark(at, late), platforms))
    return qc.exploded(joined, at).groupBy(F.window(at, every), F.col("d.type").alias("type")).agg(F.count("*").alias("n"))
