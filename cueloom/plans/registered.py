"""The registered queries with their SQL: every one reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueloom import shared
from cueloom import views as v
from cueloom.functions import italics as it
from cueloom.functions import predicates as pr
from cueloom.functions import text as tx
from cueloom.functions import timecode as tc
from cueloom.operators import align, audit, batches, catalog, qc, sync, timeline, timing
from cueloom.operators import platforms as pl
from cueloom.operators import windows as wn
from cueloom.plans import pipelines
from cueloom.sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _long(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


def _plat(cues: DataFrame) -> DataFrame:
    """Cues with the platform that their file is meant for, by file_id."""
    keys = [p[0] for p in pl.PRESETS]
    key = F.element_at(F.array(*[F.lit(k) for k in keys]), (F.pmod(F.col("file_id"), F.lit(len(keys))) + 1).cast("int"))
    return cues.withColumn("platform_key", key)


def _joined(spark: SparkSession, cues: DataFrame) -> DataFrame:
    return pl.join_platforms(_plat(cues), it.with_policy(pl.presets(spark)))


# SQL of the platform dimension: key number by file_id, limits
_PLAT = "plat(k, platform_key, max_chars, max_lines, min_s, max_s, gap_s, target_cps, max_cps) AS (VALUES " + ", ".join(f"({i}, '{p[0]}', {p[1]}, {p[2]}, {p[3]}::DOUBLE, {p[4]}::DOUBLE, {p[5]}::DOUBLE, 17, {p[6] or 21})" for i, p in enumerate(pl.PRESETS)) + ")"
_N = len(pl.PRESETS)
_ON = f"JOIN plat p ON p.k = (c.file_id % {_N} + {_N}) % {_N}"
_DOC_EVENTS = v.with_sql

# ---- quality checks -------------------------------------------------------------------------------------------------------------

CARD = ("TOO_MANY_LINES", "LINE_TOO_LONG", "DURATION_TOO_SHORT", "DURATION_TOO_LONG", "READING_SPEED_EXCEEDED", "READING_SPEED_HIGH", "FORMATTING_DEFECT", "CAPITALIZATION_NOTE")
_LEN = "length(regexp_replace(regexp_replace(c.text, '<[^>]+>', '', 'g'), '\\s', '', 'g'))"
_SEC = "((c.end_ms - c.start_ms) / 1000.0::DOUBLE)"
_ISSUES = "(contains(c.text, '  ') OR regexp_matches(c.text, ' [.,!?;:]') OR contains(c.text, '!!') OR contains(c.text, '??') OR contains(c.text, '....') OR c.text IN ('-', '–'))"
_LOW = r"regexp_matches(ltrim(regexp_replace(regexp_replace(c.text, '^-\s*', ''), '^(?:</?[ib]>)+', '')), '^\p{Ll}')"
_ZERO = "(contains(upper(c.text), 'STORY:') AND contains(upper(c.text), 'LANG:'))"
_FLAGS = f"""flags AS (SELECT c.file_id, c.cue_no, c.text, p.platform_key, CAST(NOT {_ZERO} AND length(regexp_replace(c.text, '<[^>]+>', '', 'g')) > p.max_chars AS INT) AS long, CAST(NOT {_ZERO} AND {_SEC} >= 0 AND {_SEC} < p.min_s AS INT) AS short_s, CAST(NOT {_ZERO} AND {_SEC} > p.max_s AS INT) AS long_s,
  CAST(NOT {_ZERO} AND {_LEN} / {_SEC} > p.max_cps AS INT) AS fast, CAST(NOT {_ZERO} AND {_LEN} / {_SEC} > p.target_cps AND NOT {_LEN} / {_SEC} > p.max_cps AS INT) AS quick, CAST(NOT {_ZERO} AND {_ISSUES} AS INT) AS form, CAST(NOT {_ZERO} AND {_LOW} AS INT) AS low
  FROM cues_doc c {_ON})"""


@query(v.with_sql(v.CUES_DOC, _PLAT, _FLAGS, body="""SELECT file_id, count(*) AS n_cues, CAST(sum(long + short_s + long_s + fast + quick + form + low) AS BIGINT) AS n_defects, CAST(sum(long + fast + form) AS BIGINT) AS n_errors,
  CAST(sum(short_s + long_s) AS BIGINT) AS n_warnings, CAST(sum(quick + low) AS BIGINT) AS n_info, count(*) FILTER (WHERE long + short_s + long_s + fast + quick + form + low > 0) AS n_defect_lines,
  count(*) FILTER (WHERE long + short_s + long_s + fast + quick + form + low = 0) AS n_clean_lines, sum(long + fast + form) = 0 AS is_ready FROM flags GROUP BY file_id"""))
def qc_scorecard(spark, sf_dir):
    """Delivery scorecard of every file."""
    return qc.scorecard(_joined(spark, v.cues_doc(spark, sf_dir)), CARD)


def _rows_of(spark, sf_dir, *types):
    rows = qc.row_defects(_joined(spark, v.cues_doc(spark, sf_dir)), types)
    return qc.exploded(rows, "file_id", F.col("cue_no").cast("long").alias("cue_no")).select("file_id", "cue_no", "d.type")


def _flag_sql(column: str, kind: str) -> str:
    return v.with_sql(v.CUES_DOC, _PLAT, _FLAGS, body=f"SELECT file_id, CAST(cue_no AS BIGINT) AS cue_no, '{kind}' AS type FROM flags WHERE {column} = 1")


@query(_flag_sql("long", "LINE_TOO_LONG"))
def qc_line_too_long(spark, sf_dir):
    return _rows_of(spark, sf_dir, "LINE_TOO_LONG")


@query(_flag_sql("fast", "READING_SPEED_EXCEEDED") + " UNION ALL SELECT file_id, CAST(cue_no AS BIGINT), 'READING_SPEED_HIGH' FROM flags WHERE quick = 1")
def qc_reading_speed(spark, sf_dir):
    return _rows_of(spark, sf_dir, "READING_SPEED_EXCEEDED", "READING_SPEED_HIGH")


@query(_flag_sql("form", "FORMATTING_DEFECT"))
def qc_formatting(spark, sf_dir):
    return _rows_of(spark, sf_dir, "FORMATTING_DEFECT")


@query(_flag_sql("low", "CAPITALIZATION_NOTE"))
def qc_lowercase_start(spark, sf_dir):
    return _rows_of(spark, sf_dir, "CAPITALIZATION_NOTE")


@query(v.with_sql(v.CUES_EVT, _PLAT, body=f"""SELECT c.file_id, c.cue_no, CASE WHEN s < p.min_s THEN 'DURATION_TOO_SHORT' ELSE 'DURATION_TOO_LONG' END AS type FROM (
  SELECT file_id, cue_no, (lead(start_ms) OVER (PARTITION BY file_id ORDER BY cue_no) - start_ms) / 1000.0::DOUBLE AS s FROM cues_evt) c {_ON} WHERE s >= 0 AND (s < p.min_s OR s > p.max_s)"""))
def qc_duration(spark, sf_dir):
    """Durations of event cues that end where the next begins."""
    cues = v.cues_evt(spark, sf_dir).withColumn("end_ms", F.lead("start_ms").over(wn.ordered()))
    rows = qc.row_defects(_joined(spark, cues), ("DURATION_TOO_SHORT", "DURATION_TOO_LONG"))
    return qc.exploded(rows, "file_id", F.col("cue_no").cast("long").alias("cue_no")).select("file_id", "cue_no", "d.type")


@query(v.with_sql(v.CUES_DOC, body="""SELECT file_id, cue_no, gap FROM (SELECT file_id, CAST(cue_no AS BIGINT) AS cue_no, CAST(round_even((start_ms - lag(start_ms + 2000 - (cue_no % 7) * 120) OVER (PARTITION BY file_id ORDER BY cue_no)) / 1000.0::DOUBLE * 25, 0) AS BIGINT) AS gap FROM cues_doc) WHERE gap BETWEEN 3 AND 11"""))
def qc_invalid_gap(spark, sf_dir):
    """Forbidden gaps after ends are cut by cue_no % 7 times 0.12 s."""
    cues = v.cues_doc(spark, sf_dir).withColumn("end_ms", F.col("start_ms") + 2000 - (F.col("cue_no") % 7) * 120)
    return qc.gap_defects(cues).select("file_id", F.col("line_id").cast("long").alias("cue_no"), F.col("detail").cast("long").alias("gap"))


@query(v.with_sql(v.CUES_CONV, body="SELECT c.file_id, CAST(count(*) AS BIGINT) AS n_cues, min(CASE WHEN cue_no = 1 AND NOT " + _ZERO + " THEN 1 ELSE 0 END) = 1 AS no_zero, CAST(sum(CASE WHEN length(c.text) - length(replace(c.text, chr(10), '')) + 1 > 2 THEN 1 ELSE 0 END) AS BIGINT) AS n_many_lines FROM cues_conv c GROUP BY c.file_id").replace("min(CASE WHEN cue_no = 1", "max(CASE WHEN cue_no = 1"))
def qc_conversation_files(spark, sf_dir):
    """First cue without zero-subtitle fields, and cues over two lines, in conversations, where every platform wants both."""
    cues = v.cues_conv(spark, sf_dir)
    joined = _joined(spark, cues).withColumns({"zero_subtitle_required": F.lit(True), "max_lines": F.lit(2)})
    zero = qc.file_defects(joined).filter("type = 'ZERO_SUBTITLE_INVALID'").select("file_id", F.lit(True).alias("no_zero"))
    lines = qc.row_defects(joined, ("TOO_MANY_LINES",)).groupBy("file_id").agg(F.count("*").alias("n_cues"), F.sum(F.size("defects")).cast("long").alias("n_many_lines"))
    return lines.join(zero, "file_id", "left").select("file_id", "n_cues", F.coalesce("no_zero", F.lit(False)).alias("no_zero"), "n_many_lines")


@query(v.with_sql(_PLAT, body="""SELECT page_id AS file_id, split_part(url, '/', -1) AS file_name FROM pages WHERE NOT regexp_matches(split_part(url, '/', -1), '^(?i)EHD_\\d{6}[A-Z]_[A-Z]{3}\\.PAC$')"""))
def qc_file_naming(spark, sf_dir):
    """Pages' last path parts as file names against the EHD_ convention."""
    files = v.table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), F.element_at(F.split("url", "/"), -1).alias("file_name"), F.lit("EHD_123456E_ENG.PAC").alias("file_naming_format"))
    return qc.file_naming(files).select("file_id", F.col("detail").alias("file_name"))


@query(v.with_sql(v.CUES_DOC, _PLAT, _FLAGS, body="""SELECT type, severity, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT CASE WHEN n > 0 THEN file_id END) AS n_files FROM (
  SELECT file_id, 'LINE_TOO_LONG' AS type, 'error' AS severity, long AS n FROM flags UNION ALL SELECT file_id, 'READING_SPEED_EXCEEDED', 'error', fast FROM flags UNION ALL SELECT file_id, 'READING_SPEED_HIGH', 'info', quick FROM flags
  UNION ALL SELECT file_id, 'FORMATTING_DEFECT', 'error', form FROM flags UNION ALL SELECT file_id, 'CAPITALIZATION_NOTE', 'info', low FROM flags) GROUP BY type, severity HAVING sum(n) > 0"""))
def defect_type_rollup(spark, sf_dir):
    types = ("LINE_TOO_LONG", "READING_SPEED_EXCEEDED", "READING_SPEED_HIGH", "FORMATTING_DEFECT", "CAPITALIZATION_NOTE")
    rows = qc.exploded(qc.row_defects(_joined(spark, v.cues_doc(spark, sf_dir)), types), "file_id")
    return rows.groupBy("d.type", "d.severity").agg(F.count("*").alias("n"), F.count_distinct("file_id").alias("n_files"))


@query(v.with_sql(v.CUES_DOC, body="""SELECT file_id, CAST(cue_no AS BIGINT) AS cue_no, w AS word FROM (SELECT DISTINCT file_id, cue_no, w FROM (SELECT file_id, cue_no, unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM cues_doc WHERE lang = 'en') WHERE w IN ('idiot', 'moron', 'scum', 'stupid', 'trash'))"""))
def profanity_hits(spark, sf_dir):
    """Words of a platform's table that are left in English cues."""
    table = F.create_map(*[F.lit(w) for word in ("idiot", "moron", "scum", "stupid", "trash") for w in (word, word[0] + "xxx")])
    joined = _joined(spark, v.cues_doc(spark, sf_dir).filter("lang = 'en'")).withColumn("profanity_table", table)
    rows = qc.row_defects(joined, ("PROFANITY_NOT_REPLACED",))
    return qc.exploded(rows, "file_id", F.col("cue_no").cast("long").alias("cue_no")).select("file_id", "cue_no", F.col("d.detail").alias("word"))


@query(v.with_sql(v.CUES_DOC, body=r"""SELECT lang, w AS filler, count(*) AS n FROM (SELECT lang, unnest(string_split_regex(lower(text), '[^\p{L}\p{M}\p{N}_]+')) AS w FROM cues_doc) WHERE w IN ('uh', 'um', 'er', 'erm', 'hmm') GROUP BY lang, w"""))
def filler_counts(spark, sf_dir):
    words = v.cues_doc(spark, sf_dir).select("lang", F.explode(tx.fillers(F.col("text"))).alias("filler"))
    return words.filter("filler not like 'hmmm%'").groupBy("lang", "filler").agg(F.count("*").alias("n"))


@query(v.with_sql(v.CUES_DOC, _PLAT, body=f"SELECT p.platform_key, count(*) AS n_cues, count(DISTINCT c.file_id) AS n_files, CAST(min(p.max_chars) AS INT) AS max_chars_per_line, max(p.max_s) AS max_duration_seconds FROM cues_doc c {_ON} GROUP BY p.platform_key"))
def platform_join_limits(spark, sf_dir):
    rows = _joined(spark, v.cues_doc(spark, sf_dir))
    return rows.groupBy("platform_key").agg(F.count("*").alias("n_cues"), F.count_distinct("file_id").alias("n_files"), F.min("max_chars_per_line").alias("max_chars_per_line"), F.max("max_duration_seconds").alias("max_duration_seconds"))


@query()
def full_check(spark, sf_dir):
    """All checks and the report of every file."""
    _, report = pipelines.check(_plat(v.cues_doc(spark, sf_dir)).select("file_id", "platform_key", "cue_no", "start_ms", "end_ms", "text"), pl.presets(spark))
    return report


# ---- windows and timing -----------------------------------------------------------------------------------------------------------

_FILLED = """filled AS (SELECT file_id, cue_no, start_ms, CASE WHEN later IS NULL THEN start_ms + 2000 ELSE greatest(start_ms + 80, later - 80) END AS raw FROM (
  SELECT file_id, cue_no, start_ms, min(start_ms) OVER (PARTITION BY file_id ORDER BY start_ms RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM cues_evt))"""


@query(v.with_sql(v.CUES_EVT, _FILLED, body="SELECT file_id, cue_no, start_ms, CAST(round_even(raw / 1000.0::DOUBLE * 25, 0) * 40 AS BIGINT) AS end_ms FROM filled"))
def missing_end_fill(spark, sf_dir):
    return wn.fill_ends(v.cues_evt(spark, sf_dir)).select("file_id", *_long("cue_no", "start_ms", "end_ms"))


@query(v.with_sql(v.CUES_EVT, body="""SELECT file_id, row_number() OVER w AS cue_no, start_ms, CAST(CASE WHEN lead(start_ms) OVER w IS NULL THEN start_ms + 3000 ELSE greatest(lead(start_ms) OVER w, start_ms + 200) END AS BIGINT) AS end_ms
  FROM cues_evt WHERE cue_no % 3 <> 0 WINDOW w AS (PARTITION BY file_id ORDER BY cue_no)"""))
def renumber(spark, sf_dir):
    """Event cues renumbered after every third has lost its start."""
    cues = v.cues_evt(spark, sf_dir).withColumn("start_ms", F.when(F.col("cue_no") % 3 != 0, F.col("start_ms")))
    return wn.renumber(cues).select("file_id", *_long("cue_no", "start_ms", "end_ms"))


@query(v.with_sql(v.CUES_DOC, body="SELECT file_id, count(*) AS n, CAST(max(end_ms) AS BIGINT) AS last_ms, CAST(sum(start_ms) AS BIGINT) AS total FROM cues_doc GROUP BY file_id"))
def sequential_timing(spark, sf_dir):
    cues = wn.sequential_times(v.cues_doc(spark, sf_dir).drop("start_ms", "end_ms"))
    return cues.groupBy("file_id").agg(F.count("*").alias("n"), F.max("end_ms").alias("last_ms"), F.sum("start_ms").alias("total"))


@query("""SELECT user_id AS file_id, event_id, n, CAST(coalesce(base + d * 3000, (n - 1) * 3000) AS BIGINT) AS start_ms FROM (SELECT user_id, event_id, n, n - last_n AS d, base FROM (
  SELECT user_id, event_id, n, max(CASE WHEN s IS NOT NULL THEN n END) OVER w AS last_n, last_value(s IGNORE NULLS) OVER w AS base FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE WHEN event_id % 4 = 0 THEN epoch_us(ts) // 1000 END AS s FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))""")
def fill_missing_starts(spark, sf_dir):
    """Starts of three in four events filled from the last known one."""
    cues = v.cues_evt(spark, sf_dir).withColumn("event_id", F.element_at(F.split("text", " "), -1).cast("long"))
    cues = cues.withColumn("start_ms", F.when(F.col("event_id") % 4 == 0, F.col("start_ms")))
    return wn.fill_starts(cues).select("file_id", "event_id", F.col("cue_no").cast("long").alias("n"), "start_ms")


@query("""SELECT user_id AS file_id, n AS cue_no, event_type AS text FROM (SELECT user_id, event_type, row_number() OVER w AS n, lag(event_type) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE b IS NULL OR b <> event_type""")
def consecutive_dedup(spark, sf_dir):
    cues = v.cues_evt(spark, sf_dir).withColumn("text", F.element_at(F.split("text", " "), 1))
    return wn.consecutive_dedup(cues).select("file_id", F.col("cue_no").cast("long").alias("cue_no"), "text")


@query("SELECT event_id, CAST(round_even(value * 25, 0) * 40 AS BIGINT) AS ms, CAST(round_even(value * 25, 0) AS BIGINT) AS frame FROM events")
def frame_snap(spark, sf_dir):
    """Event values as seconds on the frame grid."""
    ms = tc.snap_seconds(F.col("value"))
    return v.table(spark, sf_dir, "events").select("event_id", ms.alias("ms"), (ms / tc.FRAME_MS).cast("long").alias("frame"))


@query("""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(round_even(f * 1000 / 24.0::DOUBLE, 0) AS BIGINT) AS ms, printf('%02d:%02d:%02d:%02d', f // 24 // 3600, f // 24 // 60 % 60, f // 24 % 60, f % 24) AS clock
  FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey AS BIGINT) * 16 + l_orderkey % 16 AS f FROM lineitem)""")
def footage_to_time(spark, sf_dir):
    """Feet.frames made of order lines, to time."""
    text = F.concat_ws(".", F.col("l_partkey").cast("string"), (F.col("l_orderkey") % 16).cast("string"))
    return v.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), tc.footage_ms(text).alias("ms"), tc.footage_clock(text).alias("clock"))


@query(v.with_sql(v.CUES_DOC, body="""SELECT file_id, CAST(t AS BIGINT) AS t_ms, CAST(min(cue_no) AS BIGINT) AS cue_no FROM cues_doc c JOIN (SELECT doc_id, unnest([500, 2100, 2200, 9999, 21000]) AS t FROM documents) p ON p.doc_id = c.file_id AND c.start_ms <= t AND t < c.end_ms GROUP BY file_id, t"""))
def active_cue_at(spark, sf_dir):
    probes = v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.explode(F.array(*[F.lit(t).cast("long") for t in (500, 2100, 2200, 9999, 21000)])).alias("t_ms"))
    return wn.active_at(v.cues_doc(spark, sf_dir), probes).withColumn("cue_no", F.col("cue_no").cast("long"))


@query(v.with_sql(v.CUES_DOC, body="""SELECT file_id, CAST(cue_no AS BIGINT) AS cue_no, CAST(end_ms + 900 - lead(start_ms) OVER w AS BIGINT) AS over_ms FROM cues_doc WINDOW w AS (PARTITION BY file_id ORDER BY cue_no) QUALIFY end_ms + 900 - lead(start_ms) OVER w > 1"""))
def overlap_report(spark, sf_dir):
    """Cues that a 0.9 s longer hold would push into the next, seen from the earlier cue."""
    held = v.cues_doc(spark, sf_dir).withColumn("end_ms", F.col("end_ms") + 900)
    over = wn.overlaps(held).select("file_id", (F.col("cue_no") - 1).cast("long").alias("cue_no"), (F.col("previous_end_ms") - F.col("start_ms")).alias("over_ms"))
    return over


@query()
def repair_windows(spark, sf_dir):
    """Event cues repaired for their platforms: invariants a file."""
    cues = wn.fill_ends(v.cues_evt(spark, sf_dir))
    fixed = timing.repair_windows(_joined(spark, cues))
    gap = F.col("start_ms") - F.lag("end_ms").over(wn.ordered())
    return fixed.withColumn("_gap", gap).groupBy("file_id").agg(F.count("*").alias("n"), F.min("_gap").alias("least_gap_ms"), F.max(F.col("end_ms") - F.col("start_ms")).alias("longest_ms"), F.max("end_ms").alias("last_ms"))


@query()
def split_long_cues(spark, sf_dir):
    rows = timing.split_long(_joined(spark, v.cues_doc(spark, sf_dir)))
    return rows.select("file_id", F.col("cue_no").cast("long").alias("cue_no"), "start_ms", "end_ms", "text")


_REGEN = "least(greatest(p.min_s, length(regexp_replace(c.text, '\\s', '', 'g')) / p.max_cps::DOUBLE), p.max_s)"


@query(v.with_sql(v.CUES_CONV, _PLAT, body=f"""SELECT file_id, cue_no, CAST(round_even(s * 25, 0) * 40 AS BIGINT) AS start_ms, CAST(round_even((s + d) * 25, 0) * 40 AS BIGINT) AS end_ms FROM (
  SELECT file_id, cue_no, d, coalesce(sum(d + g) OVER (PARTITION BY file_id ORDER BY cue_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM (
  SELECT c.file_id, c.cue_no, {_REGEN} AS d, greatest(p.gap_s, 0.04::DOUBLE) AS g FROM cues_conv c {_ON}))"""))
def regenerated_timeline(spark, sf_dir):
    """A continuous timeline by reading speed, one cue a turn: lines are as wide as any turn."""
    rows = _joined(spark, v.cues_conv(spark, sf_dir)).withColumns({"max_chars_per_line": F.lit(1 << 30), "max_lines": F.lit(1)})
    return _out(timing.regenerate(rows))


# ---- synchronisation --------------------------------------------------------------------------------------------------------------

_SNAP = lambda e: f"CAST(round_even(greatest(0, {e}) / 1000.0::DOUBLE * 25, 0) * 40 AS BIGINT)"


def _sync_sql(f: str) -> str:
    return v.with_sql(v.CUES_DOC, body=f"SELECT file_id, CAST(cue_no AS BIGINT) AS cue_no, {_SNAP(f.replace('@', 'start_ms'))} AS start_ms, {_SNAP(f.replace('@', 'end_ms'))} AS end_ms FROM cues_doc")


def _params(spark, sf_dir, **columns: Column) -> DataFrame:
    return v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id")).withColumns(columns)


def _out(cues: DataFrame) -> DataFrame:
    return cues.select("file_id", *_long("cue_no", "start_ms", "end_ms"))


def _k() -> Column:
    return F.col("file_id")


@query(_sync_sql("(CASE WHEN cue_no BETWEEN 2 AND 5 THEN @ + (file_id % 7 - 3) * 710 ELSE @ END)"))
def sync_offset_range(spark, sf_dir):
    p = _params(spark, sf_dir, offset_ms=((_k() % 7 - 3) * 710).cast("long"), from_no=F.lit(2), to_no=F.lit(5))
    return _out(sync.offset(v.cues_doc(spark, sf_dir), p))


@query(_sync_sql("(CASE WHEN file_id % 3 > 0 THEN @ * (25.0::DOUBLE / (23 + file_id % 3)) ELSE @ END)"))
def sync_scale(spark, sf_dir):
    p = _params(spark, sf_dir, factor=F.when(_k() % 3 > 0, F.lit(25.0) / (23 + _k() % 3)).otherwise(F.lit(0.0)), from_no=F.lit(None).cast("int"), to_no=F.lit(None).cast("int"))
    return _out(sync.scale(v.cues_doc(spark, sf_dir), p))


@query(_sync_sql("(500 + (@ - 0) * ((8500 + file_id % 11 * 40 - 500) / (8000 - 0)::DOUBLE))"))
def sync_two_point(spark, sf_dir):
    p = _params(spark, sf_dir, source_a=F.lit(0), target_a=F.lit(500), source_b=F.lit(8000), target_b=(F.lit(8500) + _k() % 11 * 40).cast("long"))
    return _out(sync.two_point(v.cues_doc(spark, sf_dir), p))


@query(_sync_sql("(CASE WHEN cue_no >= 3 AND n >= 3 THEN @ + 1234 ELSE @ END)").replace("FROM cues_doc) ", "").replace("AS end_ms FROM cues_doc", "AS end_ms FROM (SELECT *, count(*) OVER (PARTITION BY file_id) AS n FROM cues_doc)"))
def fix_from_id(spark, sf_dir):
    """Cue 3 moved by 1.234 s with all that follow."""
    p = _params(spark, sf_dir, cue_no=F.lit(3), new_start_ms=F.lit(2 * v.STEP_MS + 1234).cast("long"), new_end_ms=F.lit(None).cast("long"))
    return _out(sync.fix_from(v.cues_doc(spark, sf_dir), p))


@query(_sync_sql("(1000 + (@ - 0) * ((61000 - 1000) / (60000 + file_id % 5 * 100)::DOUBLE))"))
def stretch(spark, sf_dir):
    p = _params(spark, sf_dir, program_start=F.lit(0), program_end=(F.lit(60000) + _k() % 5 * 100).cast("long"), client_start=F.lit(1000), client_end=F.lit(61000))
    return _out(sync.stretch(v.cues_doc(spark, sf_dir), p))


@query(v.with_sql(v.CUES_DOC, body="""SELECT file_id, CAST(2 AS BIGINT) AS cue_no, CAST(CASE WHEN 2200 - file_id % 9 * 100 < 2080 THEN 1 END AS BIGINT) AS hits_previous, CAST(CASE WHEN n > 2 AND 4200 + file_id % 9 * 100 > 4320 THEN 3 END AS BIGINT) AS hits_next
  FROM (SELECT file_id, count(*) AS n FROM cues_doc GROUP BY file_id) WHERE n >= 2 AND (2200 - file_id % 9 * 100 < 2080 OR (n > 2 AND 4200 + file_id % 9 * 100 > 4320))"""))
def collisions(spark, sf_dir):
    """Cue 2 widened by file_id % 9 tenths of a second on both sides."""
    wide = (_k() % 9 * 100).cast("long")
    p = _params(spark, sf_dir, cue_no=F.lit(2), new_start_ms=F.lit(2200) - wide, new_end_ms=F.lit(4200) + wide)
    return sync.collisions(v.cues_doc(spark, sf_dir), p).select("file_id", *_long("cue_no", "hits_previous", "hits_next"))


@query(_sync_sql("(CASE file_id % 3 WHEN 0 THEN @ + 400 WHEN 1 THEN @ * 1.04::DOUBLE ELSE 100 + (@ - 0) * ((10200 - 100) / (10000 - 0)::DOUBLE) END)"))
def sync_dispatch(spark, sf_dir):
    none = F.lit(None).cast("int")
    p = _params(spark, sf_dir, mode=F.element_at(F.array(F.lit("offset"), F.lit("scale"), F.lit("two_point")), (_k() % 3 + 1).cast("int")), offset_ms=F.lit(400), factor=F.lit(1.04), source_a=F.lit(0), target_a=F.lit(100), source_b=F.lit(10000), target_b=F.lit(10200), from_no=none, to_no=none)
    return _out(sync.dispatch(v.cues_doc(spark, sf_dir), p))


# ---- timelines --------------------------------------------------------------------------------------------------------------------


def _anchors(spark, sf_dir) -> DataFrame:
    """Two or three anchors a file: identical, moved, slowed or bent, by file_id % 4."""
    kind = _k() % 4
    points = F.array(F.struct(F.lit(0.0).alias("r"), F.when(kind == 0, 0.0).otherwise(15.0).alias("c")), F.struct(F.lit(20.0).alias("r"), F.when(kind == 0, 20.0).when(kind == 2, 35.96).otherwise(35.0).alias("c")), F.when(kind == 3, F.struct(F.lit(60.0).alias("r"), F.lit(80.0).alias("c"))))
    return _params(spark, sf_dir).select("file_id", F.explode(F.array_compact(points)).alias("p")).select("file_id", F.col("p.r").alias("ref_s"), F.col("p.c").alias("client_s"))


_MAP = "(CASE file_id % 4 WHEN 0 THEN t WHEN 1 THEN 15 + (t - 0) * ((35.0 - 15.0) / (20.0 - 0))::DOUBLE WHEN 2 THEN 15 + (t - 0) * ((35.96::DOUBLE - 15) / (20 - 0)) ELSE CASE WHEN t < 20 THEN 15 + (t - 0) * 1.0::DOUBLE ELSE 35 + (t - 20) * ((80.0::DOUBLE - 35) / (60 - 20)) END END)"


@query(v.with_sql(v.CUES_DOC, body=f"""SELECT file_id, CAST(cue_no AS BIGINT) AS cue_no, CAST(round_even({_MAP.replace('t ', 's ').replace('(t', '(s').replace(' t', ' s')} * 25, 0) * 40 AS BIGINT) AS start_ms FROM (SELECT *, start_ms / 1000.0::DOUBLE AS s FROM cues_doc)"""))
def piecewise_map(spark, sf_dir):
    out = timeline.transform_cues(v.cues_doc(spark, sf_dir), _anchors(spark, sf_dir))
    return out.select("file_id", *_long("cue_no", "start_ms"))


@query("SELECT doc_id AS file_id, ['IDENTICAL', 'GLOBAL_OFFSET', 'FPS_TRANSFORM', 'PIECEWISE'][doc_id % 4 + 1] AS kind, CAST(CASE WHEN doc_id % 4 = 3 THEN 3 ELSE 2 END AS BIGINT) AS n_anchors FROM documents")
def classify_anchor_sets(spark, sf_dir):
    return timeline.classify(_anchors(spark, sf_dir))


# ---- rules and catalogue ----------------------------------------------------------------------------------------------------------


def _rules(spark, sf_dir) -> DataFrame:
    """Rule sentences made of parts: (platform_key, rule_no, rule)."""
    rule = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("Maximum characters per line ", "Minimum duration seconds ", "Raise subtitle for ", "File naming as ", "Use sentence case for ")]), (F.col("p_partkey") % 5 + 1).cast("int")), F.col("p_name"))
    return v.table(spark, sf_dir, "part").select(F.concat(F.lit("plat"), (F.col("p_partkey") % 8).cast("string")).alias("platform_key"), F.col("p_partkey").alias("rule_no"), rule.alias("rule"))


_RULES = """rules AS (SELECT 'plat' || (p_partkey % 8) AS platform_key, p_partkey AS rule_no, ['Maximum characters per line ', 'Minimum duration seconds ', 'Raise subtitle for ', 'File naming as ', 'Use sentence case for '][p_partkey % 5 + 1] || p_name AS rule FROM part)"""


def _any_sql(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower(rule), '{w}')" for w in words) + ")"


_BUCKET = f"CASE WHEN {_any_sql(pl.LENGTH_WORDS)} THEN 'text' WHEN {_any_sql(pl.TIMING_WORDS)} THEN 'timing' WHEN {_any_sql(pl.POSITION_WORDS)} THEN 'positioning' WHEN {_any_sql(pl.FILE_WORDS)} THEN 'file' ELSE 'text' END"


@query(v.with_sql(_RULES, body=f"SELECT platform_key, {_BUCKET} AS bucket, count(DISTINCT lower(trim(rule))) AS n FROM rules GROUP BY 1, 2"))
def rule_buckets(spark, sf_dir):
    return pl.segregate(_rules(spark, sf_dir)).select("platform_key", "bucket", F.size("rules").cast("long").alias("n"))


@query(v.with_sql(_RULES, body="SELECT platform_key, rule_no, rule FROM (SELECT *, row_number() OVER (PARTITION BY platform_key, lower(trim(rule)) ORDER BY rule_no, rule) AS n FROM rules) WHERE n = 1"))
def rule_dedup(spark, sf_dir):
    return pl.dedup_rules(_rules(spark, sf_dir))


def _guidelines(spark, sf_dir) -> DataFrame:
    """Orders as guideline versions: a customer's orders are one chain by date."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = v.table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("client"), (F.col("o_custkey") % 10).cast("string")).alias("client"), F.col("o_orderpriority").alias("ott_platform"), F.col("o_orderstatus").alias("spec"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"), F.col("o_orderpriority").alias("body"),
        F.year("o_orderdate").alias("year"), F.row_number().over(order).alias("version_no"), F.lead("o_orderkey").over(order).isNull().alias("is_current"), F.lag("o_orderkey").over(order).alias("supersedes_id"),
    )


_GUIDE = """guidelines AS (SELECT o_orderkey AS id, 'client' || (o_custkey % 10) AS client, o_orderpriority AS ott_platform, o_orderstatus AS spec, 'Order ' || o_orderkey AS title, o_orderpriority AS body, year(o_orderdate) AS year,
  row_number() OVER w AS version_no, lead(o_orderkey) OVER w IS NULL AS is_current, lag(o_orderkey) OVER w AS supersedes_id, first_value(o_orderkey) OVER w AS root_id FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""


@query(v.with_sql(_GUIDE, body="SELECT id, client, ott_platform, CAST(version_no AS BIGINT) AS version_no FROM guidelines WHERE is_current AND (client ILIKE '%urgent%' OR ott_platform ILIKE '%urgent%' OR title ILIKE '%urgent%' OR body ILIKE '%urgent%')"))
def guideline_search(spark, sf_dir):
    return catalog.search(_guidelines(spark, sf_dir), "URGENT").select("id", "client", "ott_platform", *_long("version_no"))


@query(v.with_sql(_GUIDE, body="SELECT id, root_id FROM guidelines"))
def guideline_history(spark, sf_dir):
    """The first version of every chain."""
    return catalog.roots(_guidelines(spark, sf_dir))


@query(v.with_sql(_GUIDE, body="SELECT arg_max(id, version_no) AS id, CAST(max(version_no) AS BIGINT) AS version_no FROM guidelines WHERE year <= 1995 GROUP BY root_id"))
def guideline_as_of_year(spark, sf_dir):
    return catalog.as_of(_guidelines(spark, sf_dir), 1995).select("id", *_long("version_no"))


@query(v.with_sql(_GUIDE, body="""SELECT list_sort(list(DISTINCT client)) AS client, list_sort(list(DISTINCT ott_platform)) AS ott_platform, list_sort(list(DISTINCT spec)) AS spec, list_reverse_sort(list(DISTINCT CAST(year AS INT))) AS year FROM guidelines"""))
def filter_options(spark, sf_dir):
    return catalog.filter_options(_guidelines(spark, sf_dir))


@query(v.with_sql(_GUIDE, body="""SELECT id, CAST(version_no AS BIGINT) AS version_no, is_current AND id % 7 <> 0 AS is_current, supersedes_id FROM guidelines UNION ALL SELECT id + 100000000, CAST(version_no + 1 AS BIGINT), true, id FROM guidelines WHERE is_current AND id % 7 = 0"""))
def guideline_update(spark, sf_dir):
    """Current versions with an id divisible by 7 get a successor."""
    g = _guidelines(spark, sf_dir)
    changes = g.filter("is_current and id % 7 = 0").select(F.col("id").alias("old_id"), (F.col("id") + 100000000).alias("id"), F.lit(None).cast("string").alias("title"), F.lit("changed").alias("body"))
    return catalog.update(g, changes).select("id", *_long("version_no"), "is_current", "supersedes_id")


@query("""SELECT family, count(*) AS n, list(key ORDER BY v <> 'Current', v DESC, key) AS keys FROM (SELECT p_type AS family, 'p' || p_partkey AS key, CASE WHEN p_partkey % 4 = 0 THEN 'Current' ELSE 'v' || p_partkey END AS v FROM part) GROUP BY family""")
def platform_families(spark, sf_dir):
    """Parts as platform versions, a family a part type."""
    p = v.table(spark, sf_dir, "part").select(F.col("p_type").alias("family"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("platform_key"), F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("v"), F.col("p_partkey").cast("string"))).alias("version"))
    return pl.families(p).select("family", F.size("keys").cast("long").alias("n"), "keys")


# ---- audit, alignment, text -------------------------------------------------------------------------------------------------------


@query(v.with_sql(v.CUES_CONV, body="""SELECT file_id, original_text, CAST(min(cue_no) AS BIGINT) AS first_no, CAST(count(*) AS BIGINT) AS n_ids, upper(original_text) <> original_text AS changed FROM (SELECT file_id, cue_no, text AS original_text FROM cues_conv) GROUP BY file_id, original_text"""))
def track_change_groups(spark, sf_dir):
    """Turns made upper case, grouped by what they were."""
    cues = v.cues_conv(spark, sf_dir).withColumns({"original_text": F.col("text"), "text": F.upper("text"), "rule_hints": F.array(F.lit("capitalize")), "flagged": F.lit(False), "flag_reason": F.lit(None).cast("string")})
    r = audit.track_changes(cues)
    return r.select("file_id", "original_text", *_long("first_no"), F.size("ids").cast("long").alias("n_ids"), (F.col("new_texts")[0] != F.col("original_text")).alias("changed"))


@query()
def clean_text(spark, sf_dir):
    """The whole chain over all documents, with hints."""
    return audit.with_hints(tx.clean_text(_joined(spark, v.cues_doc(spark, sf_dir)))).select("file_id", F.col("cue_no").cast("long").alias("cue_no"), "text", "rule_hints")


@query()
def change_report(spark, sf_dir):
    """Changed and unchanged cues a file after cleaning."""
    cues = audit.with_hints(tx.clean_text(_joined(spark, v.cues_doc(spark, sf_dir)))).withColumn("flag_reason", F.lit(None).cast("string")).withColumn("flagged", F.lit(False))
    return audit.change_totals(audit.track_changes(cues))


def _counts(diff: DataFrame) -> DataFrame:
    count = lambda op: F.size(F.filter("diff", lambda d: d["op"] == op))
    return diff.select("file_id", F.col("cue_no").cast("long").alias("cue_no"), count("add").alias("n_added"), count("del").alias("n_deleted"))


@query()
def word_diff(spark, sf_dir):
    """Word-level differences of cleaned conversation turns."""
    cleaned = tx.clean_text(_joined(spark, v.cues_conv(spark, sf_dir))).select("file_id", "cue_no", "original_text", "text")
    return _counts(audit.word_diff(shared.written(cleaned, "cleaned")))


@query(r"""WITH cut AS (SELECT doc_id AS file_id, regexp_extract_all(text, '[^ \t\n\r]+') AS t FROM documents WHERE text IS NOT NULL)
SELECT file_id, CAST(1 AS BIGINT) AS cue_no, CAST(len(list_filter(t, lambda x, i: i % 7 = 4)) AS INTEGER) AS n_added, CAST(len(list_filter(t, lambda x, i: i % 7 = 4)) + 2 * len(list_filter(t, lambda x, i: i % 7 = 2)) AS INTEGER) AS n_deleted
FROM cut WHERE len(t) >= 2""")
def edited_documents(spark, sf_dir):
    """The words of whole documents against the same words, of seven one dropped and one replaced: so many edits and no more."""
    words = F.regexp_extract_all("text", F.lit(r"[^ \t\n\r]+"), F.lit(0))
    edited = F.filter(F.transform(words, lambda w, i: F.when(i % 7 == 3, F.lit("†")).when(i % 7 != 1, w)), lambda w: w.isNotNull())
    docs = v.spread(v.table(spark, sf_dir, "documents").select("doc_id", "text"))
    both = docs.select(F.col("doc_id").alias("file_id"), F.lit(1).alias("cue_no"), F.array_join(words, " ").alias("original_text"), F.array_join(edited, " ").alias("text"))
    return _counts(audit.word_diff(both))


@query("""SELECT a.label, a.vec_id AS a_no, b.vec_id AS b_no, round(list_cosine_similarity(a.e, b.e), 4) AS sim FROM (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) a JOIN (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) b ON a.label = b.label AND a.vec_id % 20 = 0 AND list_cosine_similarity(a.e, b.e) >= 0.3""")
def cosine_pairs(spark, sf_dir):
    """Vectors whose id is divisible by 20 against all of their label, from a cosine of 0.30 on."""
    e = v.spread(v.table(spark, sf_dir, "embeddings")).select(F.col("label").alias("file_id"), "vec_id", F.col("embedding").alias("v"))
    pairs = align.similarity_pairs(e.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "a_no"), e.withColumnRenamed("vec_id", "b_no"))
    return pairs.select(F.col("file_id").alias("label"), "a_no", "b_no", F.round("sim", 4).alias("sim"))


def _script(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Conversations as transcript, and two turns in three of them as script."""
    cues = v.cues_conv(spark, sf_dir)
    order = Window.partitionBy("file_id").orderBy("cue_no")
    lines = cues.filter("cue_no % 3 <> 0").select("file_id", F.col("cue_no").alias("truth"), F.upper("text").alias("text"), (F.row_number().over(order) - 1).alias("line_no"))
    return cues, lines


@query(v.with_sql(v.CUES_CONV, body="""SELECT file_id, line_no, CAST(CASE WHEN m <= 1 THEN 0 ELSE greatest(0, line_no * n // m - half) END AS BIGINT) AS band_lo, CAST(CASE WHEN m <= 1 THEN n - 1 ELSE least(n - 1, line_no * n // m + half) END AS BIGINT) AS band_hi FROM (
  SELECT file_id, n, least(80, greatest(20, n // 4)) AS half, row_number() OVER (PARTITION BY file_id ORDER BY cue_no) - 1 AS line_no, count(*) OVER (PARTITION BY file_id) AS m FROM (SELECT *, count(*) OVER (PARTITION BY file_id) AS n FROM cues_conv) WHERE cue_no % 3 <> 0)"""))
def candidate_band(spark, sf_dir):
    cues, lines = _script(spark, sf_dir)
    sizes = cues.groupBy("file_id").agg(F.count("*").alias("n_cues"))
    return wn.expected_positions(lines, sizes).select("file_id", *_long("line_no", "band_lo", "band_hi"))


@query(v.with_sql(v.CUES_EVT, body="SELECT file_id, cue_no, start_ms, rank FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY start_ms DESC, cue_no) AS rank FROM cues_evt) WHERE rank <= 30"))
def top_candidates(spark, sf_dir):
    """A file's 30 latest events: its events as spans of one line, scored by their time, go through align.top_candidates."""
    spans = v.cues_evt(spark, sf_dir).select("file_id", F.lit(0).alias("line_no"), F.col("start_ms").alias("score"), F.col("cue_no").alias("first_tok"), (F.col("cue_no") + 1).alias("end_tok"))
    order = Window.partitionBy("file_id").orderBy(F.desc("score"), "first_tok")
    best = align.top_candidates(spans).withColumn("rank", F.row_number().over(order))
    return best.withColumnsRenamed({"first_tok": "cue_no", "score": "start_ms"}).select("file_id", *_long("cue_no", "start_ms", "rank"))


@query("""SELECT user_id AS series_id, CAST(least(19, i // greatest(1, n // 20)) AS BIGINT) AS bucket, min(value) AS low, max(value) AS high FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) GROUP BY 1, 2
  UNION ALL SELECT u, b, 1.0, -1.0 FROM (SELECT DISTINCT user_id AS u FROM events), (SELECT unnest(range(20)) AS b) WHERE (u, b) NOT IN (SELECT (user_id, CAST(least(19, i // greatest(1, n // 20)) AS BIGINT)) FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events))""")
def peaks_min_max(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = v.table(spark, sf_dir, "events").select(F.col("user_id").alias("series_id"), (F.row_number().over(order) - 1).alias("i"), F.col("value").alias("v"))
    return batches.peaks(s, 20).select("series_id", *_long("bucket"), "low", "high")


@query()
def greedy_batches(spark, sf_dir):
    return batches.greedy_batches(v.cues_doc(spark, sf_dir)).groupBy("file_id", "batch").agg(F.count("*").alias("n"), F.sum(F.length("text") + 1).alias("chars"))


@query()
def text_chunks(spark, sf_dir):
    return batches.chunks(v.table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("chunk")).alias("longest"))


# ---- sources and sinks ------------------------------------------------------------------------------------------------------------

_CLK = lambda c, m: f"printf('%02d:%02d:%02d{m}%03d', {c} // 3600000, {c} // 60000 % 60, {c} // 1000 % 60, {c} % 1000)"


@query(v.with_sql(v.CUES_DOC, body=f"SELECT file_id, string_agg(cue_no || chr(10) || {_CLK('start_ms', ',')} || ' --> ' || {_CLK('end_ms', ',')} || chr(10) || text, chr(10) || chr(10) ORDER BY cue_no) || chr(10) AS value FROM cues_doc GROUP BY file_id"))
def export_srt(spark, sf_dir):
    return sinks.to_srt(v.cues_doc(spark, sf_dir))


@query(v.with_sql(v.CUES_CONV, body=f"SELECT file_id, 'WEBVTT' || chr(10) || chr(10) || string_agg(cue_no || chr(10) || {_CLK('start_ms', '.')} || ' --> ' || {_CLK('end_ms', '.')} || chr(10) || text, chr(10) || chr(10) ORDER BY cue_no) AS value FROM cues_conv WHERE trim(text) <> '' GROUP BY file_id"))
def export_vtt(spark, sf_dir):
    return sinks.to_vtt(v.cues_conv(spark, sf_dir))


@query(v.with_sql(v.CUES_CONV, body=f"SELECT file_id, cue_no AS \"ID\", {_CLK('start_ms', ',')} AS \"Start Time\", {_CLK('end_ms', ',')} AS \"End Time\", text AS \"Text\" FROM cues_conv WHERE trim(text) <> ''"))
def export_csv(spark, sf_dir):
    return sinks.to_csv(v.cues_conv(spark, sf_dir)).withColumn("ID", F.col("ID").cast("long"))


def _round_trip(parser, sink, view):
    def run(spark, sf_dir):
        docs = sink(view(spark, sf_dir)).withColumnRenamed("value", "text")
        return parser(docs).select("file_id", *_long("cue_no", "start_ms", "end_ms"), "text")

    return run


_BACK = v.with_sql(v.CUES_DOC, body="SELECT file_id, CAST(cue_no AS BIGINT) AS cue_no, start_ms, end_ms, text FROM cues_doc")
for _name, _parser, _sink in (("srt", readers.parse_srt, sinks.to_srt), ("vtt", readers.parse_vtt, sinks.to_vtt), ("ass", readers.parse_ass, sinks.to_ass), ("microdvd", readers.parse_microdvd, sinks.to_microdvd), ("sbv", readers.parse_sbv, sinks.to_sbv), ("ttml", readers.parse_ttml, sinks.to_ttml), ("json", readers.parse_cue_json, sinks.to_json)):
    QUERIES[f"round_trip_{_name}"] = _round_trip(_parser, _sink, v.cues_doc)
    SQL[f"round_trip_{_name}"] = _BACK
SQL["round_trip_microdvd"] = _BACK.replace("end_ms, text FROM", "end_ms, trim(replace(text, '|', chr(10)), ' ') AS text FROM")  # a bar is that format's line break


@query(v.with_sql(v.CUES_DOC, body="SELECT file_id, CAST(cue_no AS BIGINT) AS cue_no, start_ms, end_ms, text FROM cues_doc"))
def read_plain_text(spark, sf_dir):
    docs = v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "text")
    return readers.parse_txt(docs).select("file_id", *_long("cue_no", "start_ms", "end_ms"), "text")


@query()
def document_structures(spark, sf_dir):
    """Structure labels of documents and pages."""
    docs = v.table(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), "text").unionByName(v.table(spark, sf_dir, "pages").select(F.lit("pages").alias("origin"), F.col("html").alias("text")))
    return docs.select("origin", readers.detect_structure(F.col("text")).alias("structure")).groupBy("origin", "structure").agg(F.count("*").alias("n"))


@query()
def extracted_dialogue(spark, sf_dir):
    docs = v.spread(v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "text"))
    return readers.extract_lines(docs).groupBy("file_id", "structure").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(r"""SELECT doc_id, count(*) AS n_bar_lines, CAST(sum(length(l) - length(replace(l, '|', '')) + 1) AS BIGINT) AS n_cells FROM (SELECT doc_id, regexp_replace(trim(l, ' '), '^\|(.*)\|$', '\1') AS l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE contains(l, '|')) GROUP BY doc_id""")
def bar_table_documents(spark, sf_dir):
    """Lines and cells of tables drawn with bars."""
    docs = v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "text").filter(F.col("text").contains("|"))
    rows = readers.line_table(docs).filter(F.col("line").contains("|"))
    return rows.groupBy(F.col("file_id").alias("doc_id")).agg(F.count("*").alias("n_bar_lines"), F.sum(F.size(readers.table_cells(F.col("line")))).cast("long").alias("n_cells"))


@query("""SELECT s.user_id AS platform, CAST(count(*) AS BIGINT) AS n_jobs, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS n_done, max(value) AS most FROM events s GROUP BY s.user_id""")
def job_stats(spark, sf_dir):
    """Events as a job log, counted a user."""
    done = F.when(F.col("event_type") == "purchase", "done").otherwise("open")
    return sinks.job_stats(v.table(spark, sf_dir, "events").select(F.col("user_id").alias("platform"), done.alias("status"), F.col("value").alias("size")))
