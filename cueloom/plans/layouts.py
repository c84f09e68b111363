"""Registered queries of laid-out pages: the lines of documents put on pages as words with places, and read back as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom import views as v
from cueloom.plans.registered import query
from cueloom.sources import readers

#: Lines of a page.
PAGE = 20
HEADER = ("Sh#", "TimeIn", "TimeOut", "Titles")

_PLACED = f"""split AS (SELECT file_id, cue_no, (cue_no - 1) // {PAGE} + 1 AS page, 30 + (cue_no - 1) % {PAGE} * 12 AS row_y, list_filter(string_split(translate(text, '#:', ''), ' '), lambda w: w <> '') AS ws FROM cues_doc),
marked AS (SELECT * REPLACE (list_transform(ws, lambda w, i: CASE WHEN i = 1 AND cue_no % 3 = 0 THEN '**' || w || '**' ELSE w END) AS ws), ws AS plain FROM split WHERE len(ws) > 0)"""


def laid_out(spark: SparkSession, sf_dir: str, header: bool) -> DataFrame:
    """Layout words of the documents' lines: two words a column, the rest in the fourth, with some pixels to and fro; every third
    line begins with a bold word. header: page 1 has a header row."""
    ws = F.filter(F.split(F.translate("text", "#:", ""), " "), lambda w: w != "")  # else a line may pass for a header
    cues = v.cues_doc(spark, sf_dir).withColumnRenamed("file_id", "doc_id")
    words = cues.select("doc_id", "cue_no", F.posexplode(ws).alias("i", "text"))
    column = F.least(F.lit(3), F.floor(F.col("i") / 2)).cast("int")
    row = (F.col("cue_no") - 1) % PAGE
    x0 = (10 + 100 * column + 30 * (F.col("i") - 2 * column) + F.length("text") % 6 - 3).cast("double")
    bold = F.when((F.col("i") == 0) & (F.col("cue_no") % 3 == 0), "Sans-Bold").otherwise("Sans")
    placed = words.select("doc_id", (F.floor((F.col("cue_no") - 1) / PAGE) + 1).cast("int").alias("page"), (30 + row * 12 + F.col("i") % 2).cast("double").alias("y"), x0.alias("x0"), (x0 + 25).alias("x1"), "text", bold.alias("font"))
    if not header:
        return placed
    heads = F.posexplode(F.array(*map(F.lit, HEADER))).alias("i", "text")
    top = cues.filter(F.exists(F.split(F.translate("text", "#:", ""), " "), lambda w: w != "")).select("doc_id").distinct().select("doc_id", heads).select("doc_id", F.lit(1).alias("page"), F.lit(10.0).alias("y"), (10.0 + 100 * F.col("i")).alias("x0"), (60.0 + 100 * F.col("i")).alias("x1"), "text", F.lit(None).cast("string").alias("font"))
    return placed.unionByName(top)


@query(v.with_sql(v.CUES_DOC, _PLACED, body=f"""SELECT file_id AS doc_id, CAST(page AS INTEGER) AS page, CAST(row_y AS INTEGER) AS row_y,
  array_to_string(ws[1:2], ' ') || ' | ' || array_to_string(ws[3:4], ' ') || ' | ' || array_to_string(ws[5:6], ' ') || ' | ' || array_to_string(ws[7:], ' ') AS line FROM marked
UNION ALL SELECT DISTINCT file_id, 1, 9, '{" | ".join(HEADER)}' FROM marked"""))
def layout_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a header row on the first one, read back as rows of its four columns."""
    return readers.words_to_rows(laid_out(spark, sf_dir, True))


_BANDS = f"""words AS (SELECT file_id, page, row_y, i, w, 10 + 100 * c + 30 * (i - 2 * c) + l % 6 - 3 AS x0 FROM (
  SELECT file_id, page, row_y, i, ws[i + 1] AS w, least(3, i // 2) AS c, len(plain[i + 1]) AS l FROM marked, range(0, len(ws)) r(i))),
rows_of AS (SELECT file_id, page, count(DISTINCT row_y) AS n FROM words GROUP BY ALL),
gaps AS (SELECT file_id, page, x0 FROM (SELECT *, x0 - lag(x0) OVER (PARTITION BY file_id, page, row_y ORDER BY x0, w) AS g FROM words) WHERE g >= 40),
islands AS (SELECT *, sum(new) OVER (PARTITION BY file_id, page ORDER BY x0 ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, CASE WHEN x0 - lag(x0) OVER (PARTITION BY file_id, page ORDER BY x0) <= 30 THEN 0 ELSE 1 END AS new FROM gaps)),
bounds AS (SELECT i.file_id, i.page, CAST(floor(avg(x0)) AS INTEGER) AS bound FROM islands i JOIN rows_of r ON r.file_id = i.file_id AND r.page = i.page GROUP BY i.file_id, i.page, k, r.n HAVING count(*) >= greatest(2, r.n // 3))"""


@query(v.with_sql(v.CUES_DOC, _PLACED, _BANDS, body="SELECT file_id AS doc_id, CAST(page AS INTEGER) AS page, bound FROM bounds"))
def layout_column_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that recur on pages without a header."""
    return readers.column_bounds(laid_out(spark, sf_dir, False))


@query(v.with_sql(v.CUES_DOC, _PLACED, _BANDS, """sides AS (SELECT file_id, page, list(bound ORDER BY bound) AS b FROM bounds GROUP BY ALL),
placed AS (SELECT w.file_id, w.page, w.row_y, b, CASE WHEN b IS NULL THEN 0 ELSE len(list_filter(b, lambda x: w.x0 >= x)) END AS c, string_agg(w.w, ' ' ORDER BY w.x0, w.w) AS t
  FROM words w LEFT JOIN sides s ON s.file_id = w.file_id AND s.page = w.page GROUP BY ALL)""", body="""SELECT file_id AS doc_id, CAST(page AS INTEGER) AS page, CAST(row_y AS INTEGER) AS row_y,
  array_to_string(list_transform(range(0, coalesce(len(b), 0) + 1), lambda k: coalesce(list_filter(l, lambda x: x.c = k)[1].t, '')), ' | ') AS line
FROM (SELECT file_id, page, row_y, b, list({'c': c, 't': t}) AS l FROM placed GROUP BY ALL)"""))
def layout_banded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without a header, read back as rows of the columns that recur on them."""
    return readers.banded_rows(laid_out(spark, sf_dir, False))
