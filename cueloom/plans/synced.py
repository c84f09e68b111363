"""Registered query of re-timing in every mode, one mode a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom import views as v
from cueloom.operators import sync
from cueloom.plans.registered import _SNAP, _out, query

#: Mode and parameters by file_id; a parameter in a mode of its own is null elsewhere.
MODES = (
    ("offset", {"offset_ms": 400, "from_no": 2, "to_no": 4}), ("scale", {"factor": 1.04, "from_no": 2}), ("visual", {"anchor_no": 2, "anchor_ms": 3000}), ("visual", {"anchor_no": 1, "anchor_ms": 100, "anchor_no2": 3, "anchor_ms2": 5000}),
    ("shift_only_this", {"target_no": 2, "new_start_ms": 2500, "new_end_ms": 4100}), ("fix_from_index", {"target_no": 3, "new_start_ms": 5634}), ("fix_range", {"target_no": 2, "new_start_ms": 2800, "range_end_no": 4}),
    ("sync_target", {"target_no": 2, "new_end_ms": 4520, "shift_mode": "all"}), ("sync_target", {"target_no": 2, "new_start_ms": 2600, "shift_mode": "only_this"}),
    ("stretch", {"program_start": 0, "program_end": 60_000, "client_start": 1000, "client_end": 61_500}), ("point_via_other", {"main_a": 0, "other_a": 1, "main_b": 2, "other_b": 4}), ("two_point", {"source_a": 0, "target_a": 100, "source_b": 10_000, "target_b": 10_200}),
    ("no such mode", {"offset_ms": 440}),
)


def parameters(files: DataFrame) -> DataFrame:
    """A row a file (file_id); the other file of a point is the one before it by number."""
    kinds = dict(c.strip().split(" ") for c in sync.PARAMETERS.split(","))
    pick = lambda values, kind: F.element_at(F.array(*[F.lit(x).cast(kind) for x in values]), (F.col("file_id") % len(MODES) + 1).cast("int"))

    def value(name: str) -> Column:
        return (F.col("file_id") - 1).cast("bigint") if name == "other_id" else pick([own.get(name) for _, own in MODES], kinds[name])

    return files.select("file_id", pick([m for m, _ in MODES], "string").alias("mode"), *(value(c).alias(c) for c in kinds))


_MOVED = """CASE file_id % 13 WHEN 0 THEN CASE WHEN cue_no BETWEEN 2 AND 4 THEN @ + 400 ELSE @ END WHEN 1 THEN CASE WHEN cue_no >= 2 THEN @ * 1.04::DOUBLE ELSE @ END
  WHEN 2 THEN CASE WHEN n >= 2 THEN @ + 800 ELSE @ END WHEN 3 THEN CASE WHEN n >= 3 THEN 100 + (@ - 0) * ((5000 - 100) / (4400 - 0)::DOUBLE) ELSE @ + 100 END
  WHEN 4 THEN CASE WHEN cue_no = 2 THEN #shift ELSE @ END WHEN 5 THEN CASE WHEN cue_no >= 3 THEN @ + 1234 ELSE @ END WHEN 6 THEN CASE WHEN cue_no BETWEEN 2 AND 4 THEN @ + 600 ELSE @ END
  WHEN 7 THEN CASE WHEN cue_no >= 2 THEN @ + 320 ELSE @ END WHEN 8 THEN CASE WHEN cue_no = 2 THEN @ + 400 ELSE @ END WHEN 9 THEN 1000 + (@ - 0) * ((61500 - 1000) / (60000 - 0)::DOUBLE)
  WHEN 10 THEN CASE WHEN coalesce(o, 0) < 2 THEN @ WHEN n >= 3 AND o >= 5 THEN 2200 + (@ - 0) * ((8800 - 2200) / (4400 - 0)::DOUBLE) ELSE @ + 2200 END
  WHEN 11 THEN 100 + (@ - 0) * ((10200 - 100) / (10000 - 0)::DOUBLE) ELSE @ + 440 END"""
_SIDE = lambda column, shift: _SNAP(_MOVED.replace("@", column).replace("#shift", shift))


@query(v.with_sql(v.CUES_DOC, "sizes AS (SELECT file_id, count(*) AS n FROM cues_doc GROUP BY file_id)", body=f"""SELECT file_id, CAST(cue_no AS BIGINT) AS cue_no, {_SIDE('start_ms', '2500')} AS start_ms, {_SIDE('end_ms', '4100')} AS end_ms
  FROM (SELECT c.*, s.n, o.n AS o FROM cues_doc c JOIN sizes s ON s.file_id = c.file_id LEFT JOIN sizes o ON o.file_id = c.file_id - 1)"""))
def sync_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirteen ways of re-timing over one table of cues, a way a file."""
    cues = v.cues_doc(spark, sf_dir)
    return _out(sync.dispatch(cues, parameters(v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id")))))
