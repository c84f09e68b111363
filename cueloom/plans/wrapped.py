"""Registered queries of line cutting and of scenes regenerated at the platforms' own widths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom import views as v
from cueloom.functions import text as tx
from cueloom.operators import timing
from cueloom.plans.registered import _joined, _out, query

WIDTH, OVERFLOW = 28, 3

_CLAUSE = "regexp_matches(rtrim({}), '(?i)^(and|but|or|because|so|then|that|while|when|where)$')"
_GAP = f"""{{'misfit': (len(g.b) > {WIDTH})::INT, 'over': greatest(len(g.b) - {WIDTH}, 0), 'tail': (len(g.a) < 6)::INT,
      'weak': CASE WHEN regexp_matches(g.b, '[.!?;:]$') THEN 0 WHEN g.b LIKE '%,' THEN 1
        WHEN g.k + 1 < len(w) AND {_CLAUSE.format("w[g.k + 1]")} AND (g.k - list_max(list_filter(range(1, g.k + 1), lambda j: j = 1 OR NOT {_CLAUSE.format("w[j]")}))) % 2 = 0 THEN 2 ELSE 3 END,
      'short': -len(g.b), 'uneven': abs(len(g.b) - len(g.a)), 'k': g.k, 'before': g.b, 'after': g.a}}"""


@query(r"""WITH RECURSIVE lines AS (SELECT doc_id AS file_id, unnest(l) AS text, generate_subscripts(l, 1) AS line_no FROM (
    SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)),
cut(file_id, line_no, n, part, rest) AS (SELECT file_id, line_no, 0, NULL::VARCHAR, text FROM lines UNION ALL
  SELECT file_id, line_no, n + 1, CASE WHEN best IS NULL THEN rest ELSE best.before END, best.after FROM (
    SELECT file_id, line_no, n, rest, CASE WHEN len(rest) > @MOST THEN list_sort(list_filter(gaps, lambda g: len(g.before) <= @MOST))[1] END AS best FROM (
      SELECT file_id, line_no, n, rest, list_transform(list_transform(range(1, least(len(w), @MOST + 2)), lambda k: {'k': k, 'b': rtrim(array_to_string(w[1:k], '')), 'a': array_to_string(w[k + 1:], '')}), lambda g: @GAP) AS gaps FROM (
        SELECT file_id, line_no, n, rest, regexp_extract_all(rest, '[^ ]+ *') AS w FROM cut WHERE rest IS NOT NULL))))
SELECT file_id, CAST(line_no AS INTEGER) AS line_no, CAST(count(*) AS INTEGER) AS n_parts, string_agg(part, chr(10) ORDER BY n) AS text FROM cut WHERE part IS NOT NULL GROUP BY file_id, line_no"""
       .replace("@GAP", _GAP).replace("@MOST", str(WIDTH + OVERFLOW)))
def wrapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document cut at natural places, as often as it takes."""
    docs = v.spread(v.table(spark, sf_dir, "documents").select("doc_id", "text"))
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = docs.select(F.col("doc_id").alias("file_id"), F.posexplode(lines).alias("_at", "_line"))
    parts = rows.select("file_id", (F.col("_at") + 1).alias("line_no"), tx.smart_lines(F.col("_line"), WIDTH, OVERFLOW).alias("_parts"))
    return parts.select("file_id", "line_no", F.size("_parts").alias("n_parts"), F.array_join("_parts", "\n").alias("text"))


@query()
def regenerated_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns cut into cues of the platforms' widths, on a timeline by reading speed."""
    rows = timing.regenerate(_joined(spark, v.cues_conv(spark, sf_dir)))
    return _out(rows)
