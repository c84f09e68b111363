"""Registered query of lines placed between others: lines of documents of which runs have lost their times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom import views as v
from cueloom.operators import timing
from cueloom.operators import windows as wn
from cueloom.plans.registered import query

#: Lines whose number and document come to these remainders by STEP lose their times. In every third document the others follow
#: one another without a gap, else cues of two seconds stand 8.8 s apart.
STEP, LOST, APART = 7, (0, 1, 4), 8800

_CUT = f"""lost AS (SELECT file_id, cue_no, (cue_no + file_id) % {STEP} IN {LOST} AS m FROM cues_doc),
kept AS (SELECT *, CASE WHEN file_id % 3 = 0 THEN sum((NOT m)::INT) OVER (PARTITION BY file_id ORDER BY cue_no) - 1 ELSE cue_no - 1 END * {APART} AS t FROM lost),
timed AS (SELECT file_id, cue_no, m, CASE WHEN NOT m THEN t END AS s, CASE WHEN NOT m THEN t + CASE WHEN file_id % 3 = 0 THEN {APART} ELSE 2000 END END AS e FROM kept),
runs AS (SELECT *, sum((NOT m)::INT) OVER w AS r, lead(s) OVER w AS f, coalesce(lead(m) OVER w, FALSE) AS more FROM timed WINDOW w AS (PARTITION BY file_id ORDER BY cue_no)),
facts AS (SELECT file_id, r, count(*) FILTER (m) AS n, min(cue_no) FILTER (m) AS first_no, CASE WHEN bool_and(m) THEN 0 ELSE max(e) FILTER (NOT m) END AS z, max(s) FILTER (NOT m) AS a, max(e) FILTER (NOT m) AS b,
  max(f) FILTER (m AND NOT more) AS nxt FROM runs GROUP BY file_id, r),
ways AS (SELECT *, CASE WHEN n > 0 AND nxt - z >= n * 1000 THEN 'manual_gap' WHEN n > 0 AND b - a >= (n + 1) * 1000 THEN 'manual_split' END AS way FROM facts)"""
_AT = lambda k: f"WHEN way = 'manual_gap' THEN round_even((z + {k} * ((nxt - z) / n::DOUBLE)) / 40.0::DOUBLE, 0) * 40 WHEN way = 'manual_split' THEN b - n * 1000 + {k} * 1000"


@query(v.with_sql(v.CUES_DOC, _CUT, body=f"""SELECT x.file_id, CAST(cue_no AS BIGINT) AS cue_no, CAST(CASE WHEN NOT m THEN s {_AT('(cue_no - first_no)')} END AS BIGINT) AS start_ms,
  CAST(CASE WHEN NOT m AND way = 'manual_split' THEN b - n * 1000 WHEN NOT m THEN e {_AT('(cue_no - first_no + 1)')} END AS BIGINT) AS end_ms,
  CASE WHEN m THEN way END AS align_source, coalesce(m AND way IS NOT NULL, FALSE) AS manual_placement FROM runs x JOIN ways y ON x.file_id = y.file_id AND x.r = y.r"""))
def placed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs at the start, in the middle and at the end of documents: placed in gaps, from the tail of the line before, or left alone."""
    lost = ((F.col("cue_no") + F.col("file_id")) % STEP).isin(*LOST)
    dense = F.col("file_id") % 3 == 0
    cues = v.cues_doc(spark, sf_dir).withColumn("_t", F.when(dense, F.sum((~lost).cast("int")).over(wn.ordered()) - 1).otherwise(F.col("cue_no") - 1) * APART)
    timed = cues.select("file_id", "cue_no", F.when(~lost, F.col("_t")).cast("bigint").alias("start_ms"), F.when(~lost, F.col("_t") + F.when(dense, APART).otherwise(2000)).cast("bigint").alias("end_ms"), "text")
    return timing.gap_fill(timed).select("file_id", F.col("cue_no").cast("long").alias("cue_no"), "start_ms", "end_ms", "align_source", "manual_placement")
