"""More registered queries, a row of SQL for an operator each: timing, platforms and rules, catalogue, texts, predicates, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueloom import views as v
from cueloom.functions import italics as it
from cueloom.functions import predicates as pr
from cueloom.functions import text as tx
from cueloom.functions import timecode as tc
from cueloom.operators import align, audit, batches, catalog, qc, sync, timeline, timing
from cueloom.operators import platforms as pl
from cueloom.operators import windows as wn
from cueloom.plans import pipelines
from cueloom.plans.registered import _ON, _PLAT, _plat, _RULES, _GUIDE, _anchors, _guidelines, _joined, _k, _long, _out, _params, _rules, _sync_sql, query
from cueloom.sources import readers, sinks

_no = lambda: F.col("cue_no").cast("long").alias("cue_no")

# ---- windows and timing -----------------------------------------------------------------------------------------------------------


@query(v.with_sql(v.CUES_EVT, body="""SELECT file_id, cue_no, start_ms, CAST(CASE WHEN lead(start_ms) OVER w IS NULL THEN start_ms + 2000 ELSE greatest(0, lead(start_ms) OVER w - 80) END AS BIGINT) AS end_ms FROM cues_evt WINDOW w AS (PARTITION BY file_id ORDER BY cue_no)"""))
def ends_before_next(spark, sf_dir):
    return _out(wn.ends_before_next(v.cues_evt(spark, sf_dir)))


@query(v.with_sql(v.CUES_DOC, body="SELECT file_id, CAST(cue_no AS BIGINT) AS cue_no, start_ms + 7 * cue_no AS start_ms, end_ms + 7 * cue_no AS end_ms, text FROM cues_doc WHERE cue_no % 5 <> 0"))
def restored_times(spark, sf_dir):
    """Cleaned cues get their source's times back; every fifth was deleted."""
    cues = v.cues_doc(spark, sf_dir)
    source = cues.withColumns({c: F.col(c) + 7 * F.col("cue_no") for c in ("start_ms", "end_ms")})
    return wn.restore_times(cues.withColumn("deleted", F.col("cue_no") % 5 == 0), source).select("file_id", *_long("cue_no", "start_ms", "end_ms"), "text")


@query(v.with_sql(v.CUES_CONV, body="""SELECT file_id, cue_no, CASE WHEN file_id % 2 = 0 THEN start_ms ELSE (cue_no - 1) * 3000 END AS start_ms, CASE WHEN file_id % 2 = 0 THEN end_ms ELSE (cue_no - 1) * 3000 + 2000 END AS end_ms FROM cues_conv"""))
def placeholder_times(spark, sf_dir):
    """Files of odd ids have lost all times."""
    cues = v.cues_conv(spark, sf_dir)
    return _out(wn.placeholders(cues.withColumns({c: F.when(F.col("file_id") % 2 == 0, F.col(c)) for c in ("start_ms", "end_ms")})))


@query(v.with_sql(v.CUES_CONV, body=f"SELECT file_id, min(cue_no) AS cue_no, arg_min(start_ms, cue_no) AS start_ms, arg_min(text, cue_no) AS text FROM cues_conv c WHERE NOT (contains(upper(text), 'STORY:') AND contains(upper(text), 'LANG:')) AND NOT (cue_no = 1 AND file_id % 3 = 0) GROUP BY file_id"))
def first_spoken_cue(spark, sf_dir):
    """The first cue after a zero subtitle, which every third file has."""
    zero = (F.col("cue_no") == 1) & (F.col("file_id") % 3 == 0)
    cues = v.cues_conv(spark, sf_dir).withColumn("text", F.when(zero, F.lit("TITLE\nSTORY: X\nLANG: ENG")).otherwise(F.col("text")))
    return wn.first_spoken(cues).select("file_id", *_long("cue_no", "start_ms"), "text")


@query(v.with_sql(v.CUES_EVT, body="SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY coalesce(s, 0), cue_no) AS cue_no, s AS start_ms, text FROM (SELECT *, CASE WHEN cue_no % 5 <> 0 THEN start_ms * 7919 % 100003 END AS s FROM cues_evt)"))
def sorted_by_start(spark, sf_dir):
    """Shuffled starts, every fifth missing."""
    cues = v.cues_evt(spark, sf_dir).withColumn("start_ms", F.when(F.col("cue_no") % 5 != 0, F.col("start_ms") * 7919 % 100003))
    return wn.sorted_by_start(cues).select("file_id", *_long("cue_no", "start_ms"), "text")


@query(v.with_sql(v.CUES_CONV, body="""SELECT file_id, CAST(0 AS BIGINT) + row_number() OVER (PARTITION BY file_id ORDER BY n) AS cue_no, start_ms, end_ms, text FROM (
  SELECT file_id, cue_no AS n, start_ms, end_ms, text FROM cues_conv UNION ALL
  SELECT file_id, 0, 0, 1080, 'Show ' || file_id || chr(10) || 'STORY: UNKNOWN' || chr(10) || 'LANG: ENG' FROM cues_conv WHERE cue_no = 1 AND NOT (contains(upper(text), 'STORY:') AND contains(upper(text), 'LANG:')))"""))
def zero_subtitles(spark, sf_dir):
    """Conversations get a zero subtitle with their title."""
    cues = v.cues_conv(spark, sf_dir)
    titles = cues.select("file_id").distinct().withColumn("title", F.concat(F.lit("Show "), F.col("file_id").cast("string")))
    return wn.prepend_zero(cues, titles).select("file_id", *_long("cue_no", "start_ms", "end_ms"), "text")


@query(v.with_sql(v.CUES_EVT, body="""SELECT file_id, cue_no, last_value(CASE WHEN t THEN cue_no END IGNORE NULLS) OVER b AS previous_no, first_value(CASE WHEN t THEN cue_no END IGNORE NULLS) OVER a AS next_no, first_value(CASE WHEN t THEN start_ms END IGNORE NULLS) OVER a AS next_start_ms
  FROM (SELECT *, cue_no % 3 = 0 AS t FROM cues_evt) WINDOW b AS (PARTITION BY file_id ORDER BY cue_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY file_id ORDER BY cue_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"""))
def timed_neighbours(spark, sf_dir):
    """The nearest timed cues around each, where one in three is timed."""
    cues = v.cues_evt(spark, sf_dir).withColumn("end_ms", F.when(F.col("cue_no") % 3 == 0, F.col("start_ms") + 500))
    return wn.neighbours(cues).select("file_id", *_long("cue_no", "previous_no", "next_no", "next_start_ms"))


@query(v.with_sql(v.CUES_DOC, body="SELECT file_id, CAST(cue_no AS BIGINT) AS cue_no, start_ms, CASE WHEN cue_no % 4 = 0 THEN start_ms + 1000 ELSE end_ms END AS end_ms FROM cues_doc"))
def guarded_ends(spark, sf_dir):
    """Ends at or before their start, in every fourth cue, moved behind it."""
    return _out(timing.entry_guard(v.cues_doc(spark, sf_dir).withColumn("end_ms", F.when(F.col("cue_no") % 4 == 0, F.col("start_ms") - F.col("file_id") % 2).otherwise(F.col("end_ms")))))


@query(v.with_sql(v.CUES_CONV, body="SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY cue_no) AS cue_no, start_ms, end_ms, text FROM cues_conv WHERE cue_no % 4 <> 1"))
def deleted_cues(spark, sf_dir):
    cues = v.cues_conv(spark, sf_dir)
    return timing.delete_cues(cues, cues.filter("cue_no % 4 = 1").select("file_id", "cue_no")).select("file_id", *_long("cue_no", "start_ms", "end_ms"), "text")


@query(v.with_sql(v.CUES_CONV, body="""SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY n) AS cue_no, CAST(start_ms AS BIGINT) AS start_ms, CAST(end_ms AS BIGINT) AS end_ms, text FROM (
  SELECT file_id, CAST(cue_no AS DOUBLE) AS n, start_ms, end_ms, text FROM cues_conv UNION ALL
  SELECT file_id, 1.5, 2080, CASE WHEN count(*) > 1 THEN 2120 ELSE 4080 END, 'NEW' FROM cues_conv GROUP BY file_id)"""))
def inserted_cues(spark, sf_dir):
    """A cue set in behind the first of each conversation."""
    cues = v.cues_conv(spark, sf_dir)
    edits = cues.select("file_id").distinct().withColumns({"target_no": F.lit(1), "place": F.lit("after"), "text": F.lit("NEW")})
    return timing.insert_cues(cues, edits).select("file_id", *_long("cue_no", "start_ms", "end_ms"), "text")


# ---- synchronisation --------------------------------------------------------------------------------------------------------------

_COUNTED = lambda sql: sql.replace("FROM cues_doc) ", "").replace("AS end_ms FROM cues_doc", "AS end_ms FROM (SELECT *, count(*) OVER (PARTITION BY file_id) AS n FROM cues_doc)")


@query(_COUNTED(_sync_sql("(CASE WHEN n >= 2 THEN @ + 2800 ELSE @ END)")))
def sync_point(spark, sf_dir):
    """Cue 2 starts at 5 s, all others keep their distance."""
    return _out(sync.point(v.cues_doc(spark, sf_dir), _params(spark, sf_dir, anchor_no=F.lit(2), target_ms=F.lit(5000).cast("long"))))


@query(_sync_sql("(@ + 1000 + file_id % 4 * 250)"))
def sync_set_start(spark, sf_dir):
    return _out(sync.set_start(v.cues_doc(spark, sf_dir), _params(spark, sf_dir, target_ms=(F.lit(1000) + _k() % 4 * 250).cast("long"))))


@query(_COUNTED(_sync_sql("(100 + @ * (CASE WHEN n >= 2 THEN 2.0::DOUBLE ELSE 1.0 END))")))
def sync_via_other(spark, sf_dir):
    """Cues mapped to the times of another file, which runs at half the speed."""
    cues = v.cues_doc(spark, sf_dir)
    other = cues.withColumns({c: F.col(c) * 2 + 100 for c in ("start_ms", "end_ms")})
    return _out(sync.via_other(cues, other, _params(spark, sf_dir, other_id=_k(), main_a=F.lit(0), other_a=F.lit(0), main_b=F.lit(1), other_b=F.lit(1))))



def _range_params(spark, sf_dir) -> DataFrame:
    return _params(spark, sf_dir, cue_no=F.lit(2), new_start_ms=F.lit(2700).cast("long"), new_end_ms=F.lit(None).cast("long"), from_no=(_k() % 2 * 2 + 1).cast("int"), to_no=F.lit(4))


@query(_sync_sql("(CASE WHEN cue_no = 2 OR (cue_no IN (3, 4) AND cue_no >= file_id % 2 * 2 + 1) THEN @ + 500 ELSE @ END)"))
def sync_fix_range(spark, sf_dir):
    """Cue 2 moved by half a second, with those up to 4 in the range."""
    return _out(sync.fix_range(v.cues_doc(spark, sf_dir), _range_params(spark, sf_dir))[0])


@query(v.with_sql(v.CUES_DOC, body="""SELECT file_id, CAST(count(*) FILTER (WHERE cue_no BETWEEN 2 AND 4) AS BIGINT) AS n_touched, CASE WHEN file_id % 2 = 1 THEN 'target lies outside the range' END AS warning FROM cues_doc GROUP BY file_id HAVING count(*) >= 2"""))
def sync_fix_report(spark, sf_dir):
    report = sync.fix_range(v.cues_doc(spark, sf_dir), _range_params(spark, sf_dir))[1]
    return report.select("file_id", F.size("touched").cast("long").alias("n_touched"), "warning")


@query(_sync_sql("(CASE WHEN cue_no = 3 THEN @ + 600 ELSE @ END)"))
def sync_only_this(spark, sf_dir):
    p = _params(spark, sf_dir, cue_no=F.lit(3), new_start_ms=F.lit(5000).cast("long"), new_end_ms=F.lit(None).cast("long"))
    return _out(sync.only_this(v.cues_doc(spark, sf_dir), p))


# ---- time texts -------------------------------------------------------------------------------------------------------------------


@query("""SELECT event_id, CASE WHEN event_id % 4 > 0 THEN 25.0::DOUBLE / (event_id % 4 * 12) END AS fps_factor, CASE WHEN event_id % 50 * 60 + event_id % 7 > 0 THEN 600.0::DOUBLE / (event_id % 50 * 60 + event_id % 7) END AS duration_factor FROM events""")
def rate_factors(spark, sf_dir):
    """Factors between frame rates, and between durations as MM:SS and as seconds."""
    n = F.col("event_id")
    working = F.format_string("%d:%02d", n % 50, n % 7)
    return v.table(spark, sf_dir, "events").select("event_id", tc.fps_factor(F.lit(25.0), (n % 4 * 12).cast("double")).alias("fps_factor"), tc.duration_factor(working, F.lit("600")).alias("duration_factor"))


@query("""SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN event_id % 100 * 1000 + 500 WHEN 1 THEN -(event_id % 60 * 1000 + 250) WHEN 2 THEN event_id % 100 * 1000 END AS BIGINT) AS ms FROM events""")
def offset_texts(spark, sf_dir):
    """Offsets as seconds, as negative clocks, with a unit, and as words that are none."""
    n = F.col("event_id")
    text = F.when(n % 4 == 0, F.concat((n % 100).cast("string"), F.lit(".5"))).when(n % 4 == 1, F.concat(F.lit("- 00:00:"), F.lpad((n % 60).cast("string"), 2, "0"), F.lit(",250"))).when(n % 4 == 2, F.concat(F.lit("+"), (n % 100).cast("string"), F.lit(" sec"))).otherwise(F.lit("later"))
    return v.table(spark, sf_dir, "events").select("event_id", tc.offset_ms(text).alias("ms"))


_T = "(event_id * 7919 % 86400000)"
_PARTS = f"{_T} // 3600000, {_T} // 60000 % 60, {_T} // 1000 % 60"


@query(f"""SELECT event_id, printf('%02d:%02d:%02d,%03d', {_PARTS}, {_T} % 1000) AS clock, printf('%02d:%02d:%02d:%02d', {_PARTS}, {_T} % 1000 // 40) AS frames, printf('%d:%02d:%02d.%02d', {_PARTS}, {_T} % 1000 // 10) AS ass,
  {_T} // 1000 * 1000 + {_T} % 1000 // 40 * 40 AS parsed_ms, round({_T} / 1000.0::DOUBLE, 3) AS check_s, printf('%02d:%02d:%02d,%03d', {_T} // 3600000 + ({_T} // 60000 % 50 + 45) // 60, ({_T} // 60000 % 50 + 45) % 60, {_T} // 1000 % 60, 500) AS carried FROM events""")
def time_texts(spark, sf_dir):
    """Clocks written, read back and normalised."""
    t = (F.col("event_id") * 7919 % 86_400_000).cast("long")
    over = F.concat(F.floor(t / 3_600_000).cast("string"), F.lit(":"), (F.floor(t / 60_000) % 50 + 45).cast("string"), F.lit(":"), (F.floor(t / 1000) % 60).cast("string"), F.lit(".5"))
    return v.table(spark, sf_dir, "events").select(
        "event_id", tc.clock(t).alias("clock"), tc.frames_clock(t).alias("frames"), tc.ass_clock(t).alias("ass"), tc.parse_ms(tc.frames_clock(t)).alias("parsed_ms"), F.round(tc.qc_seconds(tc.clock(t)), 3).alias("check_s"), tc.normalise(over).alias("carried"),
    )


# ---- predicates -------------------------------------------------------------------------------------------------------------------


@query(v.with_sql(v.CUES_DOC, body=f"""SELECT file_id, count(*) FILTER (WHERE regexp_matches(text, '{pr.PRESERVED.replace("'", "''")}')) AS n_preserved,
  count(*) FILTER (WHERE regexp_matches(trim(text), '^[^a-z]*[A-Z][^a-z]*$') AND NOT regexp_matches(trim(text), '[.!?…]$') AND NOT regexp_matches(trim(text), '{pr.PRESERVED.replace("'", "''")}')) AS n_caps,
  count(*) FILTER (WHERE cue_no BETWEEN 3 AND 6) AS n_in_range FROM cues_doc GROUP BY file_id"""))
def line_predicates(spark, sf_dir):
    """Preserved lines, upper-case scene lines, and ids in a range, counted a file."""
    t = F.col("text")
    return v.cues_doc(spark, sf_dir).groupBy("file_id").agg(F.count_if(pr.must_preserve(t)).alias("n_preserved"), F.count_if(pr.is_caps_scene_line(t)).alias("n_caps"), F.count_if(pr.in_range(F.col("cue_no").cast("string"), 3, 6)).alias("n_in_range"))


@query(v.with_sql(v.CUES_DOC, body="SELECT file_id, CAST(cue_no AS BIGINT) AS cue_no FROM cues_doc WHERE cue_no % 6 NOT IN (0, 1)"))
def visible_cues(spark, sf_dir):
    """Cues that are neither deleted nor blank."""
    cues = v.cues_doc(spark, sf_dir).withColumns({"deleted": F.when(F.col("cue_no") % 6 == 0, True), "text": F.when(F.col("cue_no") % 6 == 1, F.lit("  ")).otherwise(F.col("text"))})
    return pr.visible(cues).select("file_id", _no())


@query(v.with_sql(v.CUES_DOC, _PLAT, body=f"SELECT c.file_id, CAST(c.cue_no AS BIGINT) AS cue_no, 'Line still exceeds the limit' AS flag_reason FROM cues_doc c {_ON} WHERE length(trim(regexp_replace(c.text, '<[^>]+>', '', 'g'))) > p.max_chars"))
def flagged_lines(spark, sf_dir):
    cues = _joined(spark, v.cues_doc(spark, sf_dir)).withColumns({"flagged": F.lit(None).cast("boolean"), "flag_reason": F.lit(None).cast("string")})
    return pr.flag_too_long(cues).filter("flagged").select("file_id", _no(), "flag_reason")


@query(v.with_sql(v.CUES_EVT, body="SELECT file_id, cue_no FROM cues_evt WHERE cue_no % 4 = 0 OR cue_no % 7 = 0 OR cue_no % 9 = 0"))
def weak_rows(spark, sf_dir):
    """Rows without time, flagged, or placed by hand."""
    n = F.col("cue_no")
    cues = v.cues_evt(spark, sf_dir).withColumns({"start_ms": F.when(n % 4 != 0, F.col("start_ms")), "flagged": F.when(n % 7 == 0, True), "manual_placement": n % 9 == 0})
    return pr.weak_rows(cues).select("file_id", _no())


@query(r"""SELECT doc_id, max(struct_pack(score := CAST(w + 8 * c AS INT), t := t)).score AS score, max(struct_pack(score := CAST(w + 8 * c AS INT), t := t)).t AS text FROM (
  SELECT doc_id, t, len(regexp_extract_all(t, '\p{L}{2,}')) AS w, len(regexp_extract_all(t, '\d{1,2}:\d{2}:\d{2}')) AS c, length(regexp_replace(t, '[^\p{L}\p{N}\p{P}\p{S}\s]', '', 'g')) / length(t)::DOUBLE AS printable FROM (
  SELECT doc_id, text AS t FROM documents UNION ALL SELECT doc_id, text || ' 00:00:01' FROM documents WHERE doc_id % 2 = 0)) WHERE length(t) > 0 AND printable >= 0.75 AND (w >= 4 OR (c > 0 AND w >= 1)) GROUP BY doc_id""")
def best_candidates(spark, sf_dir):
    """The more useful of a document and, for every second, a copy with a timecode."""
    d = v.table(spark, sf_dir, "documents").select("doc_id", "text")
    both = d.unionByName(d.filter("doc_id % 2 = 0").withColumn("text", F.concat("text", F.lit(" 00:00:01"))))
    return pr.best_candidate(both).select("doc_id", F.col("score").cast("int").alias("score"), "text")


@query(v.with_sql(v.CUES_DOC, body=r"""SELECT file_id AS doc_id, count(*) AS codes, CAST(sum(len(regexp_extract_all(w, '\p{L}{2,}'))) AS BIGINT) AS words FROM (SELECT file_id, string_split(text, ' ')[1] AS w FROM cues_doc) GROUP BY file_id HAVING count(*) >= 20 AND sum(len(regexp_extract_all(w, '\p{L}{2,}'))) < 3 * count(*)"""))
def timecode_pages(spark, sf_dir):
    """Documents of 20 lines or more, seen as timecodes with one word each."""
    lines = v.cues_doc(spark, sf_dir).select(F.col("file_id").alias("doc_id"), F.concat_ws(" ", tc.clock(F.col("start_ms")), F.split("text", " ")[0]).alias("line"))
    return pr.timecode_pages(lines).select("doc_id", F.col("codes").cast("long").alias("codes"), F.col("words").cast("long").alias("words"))


# ---- rules, platforms, catalogue --------------------------------------------------------------------------------------------------

_FIELD_RULES = """field_rules AS (SELECT 'plat' || (p_partkey % 8) AS platform_key, p_partkey AS rule_no, p_partkey % 5 AS kind, 1 + p_partkey % 9 AS x FROM part)"""


@query(v.with_sql(_FIELD_RULES, body="""SELECT platform_key, arg_max(x + 0.5::DOUBLE, rule_no) FILTER (WHERE kind = 0) AS min_duration_seconds, arg_max(CAST(x AS DOUBLE), rule_no) FILTER (WHERE kind = 1) AS max_duration_seconds, arg_max(CAST(10 + x AS DOUBLE), rule_no) FILTER (WHERE kind = 2) AS reading_speed_max_cps,
  arg_max(x, rule_no) FILTER (WHERE kind = 3) / 25.0::DOUBLE AS min_interval_seconds, bool_or(kind = 4) AS zero_subtitle_required FROM field_rules GROUP BY platform_key"""))
def rule_timing_fields(spark, sf_dir):
    """Numbers of platforms out of their rules' words; the last rule counts."""
    n = F.col("p_partkey")
    x = (n % 9 + 1).cast("string")
    texts = [F.concat(F.lit("Minimum duration of "), x, F.lit(".5 seconds")), F.concat(F.lit("MAX duration "), x, F.lit(" sec")), F.concat(F.lit("Reading speed 1"), x, F.lit(" cps")), F.concat(F.lit("A gap of "), x, F.lit(" frames")), F.lit("Zero subtitle first")]
    texts[2] = F.concat(F.lit("Reading speed "), (n % 9 + 11).cast("string"), F.lit(" cps"))
    rule = F.element_at(F.array(*texts), (n % 5 + 1).cast("int"))
    return pl.timing_fields(v.table(spark, sf_dir, "part").select(F.concat(F.lit("plat"), (n % 8).cast("string")).alias("platform_key"), n.alias("rule_no"), rule.alias("rule")))


@query(v.with_sql(_RULES, body="SELECT platform_key, rule_no, rule FROM rules WHERE NOT regexp_matches(rule, '(?i)double space|space before punctuation|ellipsis|double hyphen|characters per line|lines per subtitle|acronym|numbers? (?:1-10|0-9|1-9)|filler|profanity')"))
def uncovered_rules(spark, sf_dir):
    return pl.uncovered_rules(_rules(spark, sf_dir))


@query("SELECT p_partkey, p_name AS quote FROM part WHERE p_partkey % 3 <> 0")
def quoted_rules(spark, sf_dir):
    """Rules whose quote stands in their source, in other case and spacing."""
    p = v.table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("quote"), F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("see\n"), F.upper(F.replace("p_name", F.lit(" "), F.lit("  \n"))), F.lit(" there"))).otherwise(F.lit("nothing")).alias("source"))
    return pl.quoted_rules(p).select("p_partkey", "quote")


@query("SELECT p_partkey, regexp_replace(lower(trim(p_name || ' ' || p_brand)), '[^a-z0-9]', '_', 'g') AS slug, upper(p_name[1]) || p_name[2:] AS sentence FROM part")
def slugs_and_sentences(spark, sf_dir):
    """Keys of names, and rules as sentences without bullet and final dot."""
    return v.table(spark, sf_dir, "part").select("p_partkey", tx.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"), tx.rule_sentence(F.concat(F.lit(" 12) "), F.replace("p_name", F.lit(" "), F.lit("  ")), F.lit(" ;. "))).alias("sentence"))


_HINT_VALUES = ", ".join(f"('{k}', '{d.replace(chr(39), chr(39) * 2)}', '{p}')" for k, d, ps in audit.HINTS for p in ps)


@query(v.with_sql(_RULES, f"hints(hint, description, phrase) AS (VALUES {_HINT_VALUES})", body="""SELECT k.platform_key, h.hint, coalesce('Rule: ' || f.rule, 'Verified edit: ' || h.description) AS label FROM (SELECT DISTINCT platform_key FROM rules) k CROSS JOIN (SELECT DISTINCT hint, description FROM hints) h
  LEFT JOIN (SELECT platform_key, hint, arg_min(rule, rule_no) AS rule FROM rules JOIN hints ON contains(lower(rule), phrase) GROUP BY 1, 2) f ON f.platform_key = k.platform_key AND f.hint = h.hint"""))
def justified_hints(spark, sf_dir):
    """What justifies each hint on each platform: its first rule with a phrase of the hint, or the description."""
    return audit.justified(_rules(spark, sf_dir))


@query(v.with_sql(_RULES, "kw(key, keyword) AS (VALUES ('a', 'duration'), ('a', 'minimum duration'), ('b', 'case'), ('b', 'Use Sentence case'), ('c', 'never'))", body="SELECT platform_key, key, arg_max(rule, [length(keyword), -rule_no]) AS rule FROM rules JOIN kw ON contains(lower(rule), lower(keyword)) GROUP BY 1, 2"))
def longest_keyword_rules(spark, sf_dir):
    keywords = spark.createDataFrame([("a", "duration"), ("a", "minimum duration"), ("b", "case"), ("b", "Use Sentence case"), ("c", "never")], "key string, keyword string")
    return audit.longest_keyword_rule(_rules(spark, sf_dir), keywords)


@query(v.with_sql(_GUIDE, body="""SELECT id, is_current, CAST(version_no AS BIGINT) AS version_no FROM (SELECT id, is_current AND id % 5 <> 0 AS is_current, version_no FROM guidelines UNION ALL SELECT p_partkey + 200000000, true, 1 FROM part) WHERE id % 11 <> 0"""))
def guideline_edits(spark, sf_dir):
    """Parts added as guidelines, some rows closed, some removed."""
    g = _guidelines(spark, sf_dir)
    new = v.table(spark, sf_dir, "part").select((F.col("p_partkey").cast("long") + 200000000).alias("id"), F.lit("client1").alias("client"), F.col("p_name").alias("title"))
    edited = catalog.soft_delete(g, g.filter("id % 5 = 0").select("id"))
    edited = catalog.add(edited, new)
    return catalog.hard_delete(edited, edited.filter("id % 11 = 0").select("id")).select("id", "is_current", *_long("version_no"))


@query("""SELECT 'c' || p_partkey % 10 AS client, p_brand AS ott_platform, row_number() OVER (PARTITION BY p_partkey % 10, p_brand ORDER BY p_partkey) || '.1.1' AS spec, p_name AS body FROM part WHERE p_partkey % 4 <> 0""")
def bulk_guidelines(spark, sf_dir):
    """Imported rules numbered a client and platform, those without their quote left out."""
    p = v.table(spark, sf_dir, "part").select(F.concat(F.lit("c"), (F.col("p_partkey") % 10).cast("string")).alias("client"), F.col("p_brand").alias("ott_platform"), F.col("p_partkey").alias("rule_no"), F.col("p_name").alias("rule"), F.col("p_name").alias("quote"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_name")).otherwise(F.lit("-")).alias("source"))
    return catalog.bulk_rows(p)


@query("""SELECT p_partkey AS sheet, CASE WHEN p_partkey % 5 = 0 THEN 'skipped' WHEN p_partkey % 3 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE regexp_replace(lower(p_brand || '_v' || p_partkey), '[^a-z0-9]', '_', 'g') END AS platform_key FROM part""")
def bulk_platforms(spark, sf_dir):
    """Sheets mapped to platforms: unmapped ones are skipped, empty ones are errors."""
    p = v.table(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("sheet"), F.when(F.col("p_partkey") % 3 != 0, F.array("p_name")).alias("rules"))
    mapping = p.filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("sheet"), F.col("p_brand").alias("family"), F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("version"))
    return pl.bulk_import(rows, mapping).select("sheet", "status", "platform_key")


@query("""SELECT platform_key, family, version FROM (SELECT 'p' || p_partkey AS platform_key, CASE WHEN p_brand = 'Brand#11' THEN 'Renamed' ELSE p_brand END AS family, CASE WHEN p_partkey = 7 THEN 'edited' ELSE 'v' || p_partkey % 3 END AS version FROM part) WHERE family <> 'Brand#22' AND platform_key <> 'p9'""")
def platform_edits(spark, sf_dir):
    """A family renamed, a version edited, a platform and a family deleted."""
    p = v.table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("platform_key"), F.col("p_brand").alias("family"), F.concat(F.lit("v"), (F.col("p_partkey") % 3).cast("string")).alias("version"))
    renamed = pl.edit_meta(pl.rename_family(p, "Brand#11", "Renamed"), "p7", version="edited")
    return pl.delete_platforms(pl.delete_platforms(renamed, key="p9"), family="Brand#22")


_BOOLS = lambda *x: "[" + ", ".join(str(b).lower() for b in x) + "]"
_POLICY = "CASE " + " ".join(f"WHEN contains(key, '{part}') THEN {_BOOLS(*own)}" for part, *own in it.POLICIES) + " ELSE [rule = 'no italics', rule = 'lyrics in italics', rule = 'foreign words in italics'] END"


@query(f"""SELECT key AS platform_key, p[1] AS no_italics, p[2] AS italic_lyrics, p[3] AS italic_foreign FROM (SELECT key, {_POLICY} AS p FROM (
  SELECT lower(['disney_', 'tvb', 'guide_discovery', 'x', 'vubiquity_', 'Generic', 'y', 'z'][p_partkey % 8 + 1] || p_partkey) AS key, ['no italics', 'lyrics in italics', 'foreign words in italics', 'nothing'][p_partkey % 4 + 1] AS rule FROM part))""")
def italic_policies(spark, sf_dir):
    """Italics policies by a platform's key, else by its rules."""
    n = F.col("p_partkey")
    key = F.lower(F.concat(F.element_at(F.array(*[F.lit(x) for x in ("disney_", "tvb", "guide_discovery", "x", "vubiquity_", "Generic", "y", "z")]), (n % 8 + 1).cast("int")), n.cast("string")))
    rule = F.element_at(F.array(*[F.lit(x) for x in ("no italics", "lyrics in italics", "foreign words in italics", "nothing")]), (n % 4 + 1).cast("int"))
    return it.with_policy(v.table(spark, sf_dir, "part").select(key.alias("platform_key"), F.array(rule).alias("rules"))).select("platform_key", "no_italics", "italic_lyrics", "italic_foreign")


# ---- texts ------------------------------------------------------------------------------------------------------------------------

_LINES = lambda f: f"array_to_string(list_transform(string_split(t, chr(10)), lambda x: {f}), chr(10))"


@query(v.with_sql(v.CUES_CONV, body=f"""SELECT file_id, cue_no, {_LINES("CASE WHEN contains(x, '♪') THEN '<i>' || x || '</i>' ELSE x END")} AS lyrics, regexp_replace('<I>' || text || '</i>', '(?i)</?i>', '', 'g') AS plain
  FROM (SELECT *, CASE WHEN cue_no % 3 = 0 THEN '♪ ' || text ELSE text END AS t FROM cues_conv)"""))
def italics_applied(spark, sf_dir):
    """Lyrics in italics, and italics stripped."""
    sung = F.when(F.col("cue_no") % 3 == 0, F.concat(F.lit("♪ "), F.col("text"))).otherwise(F.col("text"))
    return v.cues_conv(spark, sf_dir).select("file_id", _no(), it.wrap_lyrics(sung).alias("lyrics"), it.strip(F.concat(F.lit("<I>"), F.col("text"), F.lit("</i>"))).alias("plain"))


_TWO_DOTS = lambda e: f"regexp_replace({e}, '(^|[^.])\\.\\.([^.]|$)', '\\1...\\2', 'g')"
_PUNCTUATION = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '  +', ' ', 'g'), ' ([.,!?;:])', '\1', 'g'), '!!+', '!', 'g'), '\?\?+', '?', 'g'), '[!?][?!]+', '!', 'g'), '\.{4,}', '...', 'g')"


@query(v.with_sql(v.CUES_DOC, body=f"SELECT file_id, CAST(cue_no AS BIGINT) AS cue_no, {_TWO_DOTS(_TWO_DOTS(_PUNCTUATION))} AS text FROM (SELECT * REPLACE (text || CASE WHEN cue_no % 3 = 0 THEN ' ,, a..b  !!?' ELSE '.....' END AS text) FROM cues_doc)"))
def punctuation_fixed(spark, sf_dir):
    """Every line with more marks behind it."""
    cues = v.cues_doc(spark, sf_dir).withColumn("text", F.concat("text", F.when(F.col("cue_no") % 3 == 0, F.lit(" ,, a..b  !!?")).otherwise(F.lit("....."))))
    return cues.select("file_id", _no(), tx.fix_punctuation(F.col("text")).alias("text"))


_REPLACE = lambda e, *rules: e if not rules else _REPLACE(f"regexp_replace({e}, '{rules[0][0]}', '{rules[0][1]}', 'g')", *rules[1:])


@query(v.with_sql(v.CUES_DOC, body=f"""SELECT file_id, CAST(cue_no AS BIGINT) AS cue_no, {_REPLACE("'< I >' || text || '</ B>'", ('(?i)<\\s*i\\s*>', '<i>'), ('(?i)<\\s*/\\s*i\\s*>', '</i>'), ('(?i)<\\s*b\\s*>', '<b>'), ('(?i)<\\s*/\\s*b\\s*>', '</b>'))} AS tags,
  {_REPLACE("text || ' *bleep* [Bleep]'", ('(?i)\\*bleep\\*|\\[bleep\\]|\\(bleep\\)', '****'))} AS bleeps, {_REPLACE("'— ' || text", ('(?m)^[–—]', '-'), ('(?m)^- ', '-'))} AS hyphens, {_REPLACE("text || ' 5° & ©<b>'", ('<[^>]+>', ''), ('&', 'and'), ('[<>©]', ''), ('°', ' degrees'))} AS symbols,
  {_REPLACE("'U.S.A. ' || text", ('\\b([A-Z])\\.([A-Z])\\.(?:([A-Z])\\b)?\\.?', '\\1\\2\\3'))} AS acronyms, {_REPLACE("'story : x lang: ' || text", ('(?i)\\bstory\\s*:', 'STORY:'), ('(?i)\\blang\\s*:', 'LANG:'))} AS story FROM cues_doc"""))
def marks_cleaned(spark, sf_dir):
    """Steps of the cleaning chain, each on lines that hold what it is for."""
    t = F.col("text")
    wrapped = lambda a, b: F.concat(F.lit(a), t, F.lit(b))
    return v.cues_doc(spark, sf_dir).select(
        "file_id", _no(), tx.canonical_tags(wrapped("< I >", "</ B>")).alias("tags"), tx.bleeps_to_asterisks(wrapped("", " *bleep* [Bleep]")).alias("bleeps"), tx.speaker_hyphens(wrapped("— ", ""), F.lit("hyphen_no_space")).alias("hyphens"),
        tx.forbidden_symbols(wrapped("", " 5° & ©<b>")).alias("symbols"), tx.acronym_dots(wrapped("U.S.A. ", "")).alias("acronyms"), tx.story_lang(wrapped("story : x lang: ", "")).alias("story"),
    )


@query(v.with_sql(v.CUES_CONV, body=r"""SELECT file_id, cue_no, array_to_string(list_filter(list_transform(string_split(chr(10) || text || chr(10) || '  ', chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), chr(10)) AS lines, regexp_replace(trim(text), '(?is)^\s*(?:sure|certainly|of course|here(?:''s| is| are)?)[^\n:]{0,120}:\s*', '') AS answer,
  trim(regexp_replace(regexp_replace('{\an8}' || text, '\{[^}]*\}', '', 'g'), '\\[Nn]', chr(10), 'g')) AS inline, CAST(length(regexp_replace(text, '<[^>]+>', '', 'g')) AS INT) AS visible FROM cues_conv"""))
def turns_trimmed(spark, sf_dir):
    """Blank lines, preambles and inline overrides of conversation turns removed."""
    t = F.col("text")
    return v.cues_conv(spark, sf_dir).select("file_id", _no(), tx.drop_blank_lines(F.concat(F.lit("\n"), t, F.lit("\n  "))).alias("lines"), tx.strip_preamble(F.trim(t)).alias("answer"), tx.inline_breaks(F.concat(F.lit("{\\an8}"), t)).alias("inline"), tx.visible_length(t).alias("visible"))


@query(r"""SELECT page_id, '[MAIN TITLE] ' || 'Page ' || page_id AS marked, 'Page ' || page_id AS title, CAST(NULL AS VARCHAR) AS none FROM pages""")
def protected_titles(spark, sf_dir):
    """Narrative titles keep their words without the marker; other text gives null."""
    text = F.concat(F.lit("[MAIN TITLE] Page "), F.col("page_id").cast("string"))
    return v.table(spark, sf_dir, "pages").select("page_id", text.alias("marked"), tx.protected_title(text).alias("title"), tx.protected_title(F.substr(text, F.lit(2))).alias("none"))


# ---- audit, alignment, batches ----------------------------------------------------------------------------------------------------


@query(v.with_sql(v.CUES_CONV, body="SELECT file_id, count(*) AS total, count(*) FILTER (WHERE cue_no % 7 = 0) AS n_flagged, count(*) FILTER (WHERE cue_no % 3 = 0) AS n_changed FROM cues_conv GROUP BY file_id"))
def cleaning_totals(spark, sf_dir):
    """Flagged and changed turns; outer blanks are no change."""
    n = F.col("cue_no")
    cues = v.cues_conv(spark, sf_dir).withColumns({"original_text": F.col("text"), "text": F.when(n % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.concat(F.lit(" "), "text")), "flagged": F.when(n % 7 == 0, True)})
    return audit.cleaning_stats(cues)


@query(v.with_sql(v.CUES_EVT, body="SELECT file_id, count(*) AS total, count(*) FILTER (WHERE cue_no % 4 <> 0 AND cue_no % 6 <> 0) AS matched FROM cues_evt GROUP BY file_id"))
def alignment_totals(spark, sf_dir):
    n = F.col("cue_no")
    return align.alignment_stats(v.cues_evt(spark, sf_dir).withColumns({"start_ms": F.when(n % 4 != 0, F.col("start_ms")), "manual_placement": F.when(n % 6 == 0, True)}))


@query(v.with_sql(v.CUES_EVT, body="SELECT file_id, round(unresolved, 9) AS unresolved FROM (SELECT file_id, avg(CASE WHEN cue_no % (2 + file_id % 7) = 0 THEN 1.0::DOUBLE ELSE 0 END) AS unresolved FROM cues_evt GROUP BY file_id) WHERE unresolved >= 0.2"))
def unresolved_files(spark, sf_dir):
    rows = v.cues_evt(spark, sf_dir).withColumn("start_ms", F.when(F.col("cue_no") % (2 + F.col("file_id") % 7) != 0, F.col("start_ms")))
    return align.unresolved_files(rows).select("file_id", F.round("unresolved", 9).alias("unresolved"))


@query(v.with_sql(v.CUES_CONV, body="SELECT file_id, count(*) AS n FROM cues_conv WHERE file_id NOT IN (SELECT file_id FROM cues_conv WHERE cue_no = 3 AND file_id % 2 = 1) GROUP BY file_id"))
def guarded_batches(spark, sf_dir):
    """Batches that came back with a row less are left out."""
    cues = v.cues_conv(spark, sf_dir)
    good, _ = batches.guarded(cues.filter("not (cue_no = 3 and file_id % 2 = 1)"), cues, ["file_id"])
    return good.groupBy("file_id").agg(F.count("*").alias("n"))


@query(v.with_sql(v.CUES_CONV, body="SELECT file_id, cue_no, CASE WHEN cue_no % 4 = 0 THEN text ELSE reverse(text) END AS text, cue_no % 4 <> 0 AS ok FROM (SELECT * REPLACE (CASE WHEN cue_no % 4 = 0 THEN 'bad' ELSE 'n' || cue_no END AS text) FROM cues_conv)"))
def mapped_texts(spark, sf_dir):
    """A caller's function on every text; a row on which it fails keeps its text."""

    def back(text: str) -> str:
        if text == "bad":
            raise ValueError(text)
        return text[::-1]

    cues = v.cues_conv(spark, sf_dir).withColumn("text", F.when(F.col("cue_no") % 4 == 0, "bad").otherwise(F.concat(F.lit("n"), F.col("cue_no").cast("string"))))
    return batches.map_text(cues, back).select("file_id", _no(), "text", "ok")


@query(v.with_sql(v.CUES_DOC, body="SELECT file_id, count(*) AS n_mapped, CAST(0 AS BIGINT) AS n_unresolved, ['IDENTICAL', 'GLOBAL_OFFSET', 'FPS_TRANSFORM', 'PIECEWISE'][file_id % 4 + 1] AS kind FROM cues_doc GROUP BY file_id"))
def client_alignment(spark, sf_dir):
    """Report of files mapped onto the client's timeline."""
    _, report = timeline.align_to_client(v.cues_doc(spark, sf_dir), _anchors(spark, sf_dir))
    return report.select("file_id", F.col("n_mapped").cast("long").alias("n_mapped"), F.col("n_unresolved").cast("long").alias("n_unresolved"), "kind")


# ---- sinks ------------------------------------------------------------------------------------------------------------------------


@query(v.with_sql(v.CUES_CONV, body="SELECT file_id, string_agg(text, chr(10) || chr(10) ORDER BY cue_no) AS value FROM cues_conv WHERE trim(text) <> '' GROUP BY file_id"))
def export_txt(spark, sf_dir):
    return sinks.to_txt(v.cues_conv(spark, sf_dir))


@query(v.with_sql(v.CUES_CONV, body="SELECT file_id, string_agg(printf('[%02d:%02d.%02d]', start_ms // 60000, start_ms // 1000 % 60, start_ms % 1000 // 10) || replace(text, chr(10), ' '), chr(10) ORDER BY cue_no) || chr(10) AS value FROM cues_conv WHERE trim(text) <> '' GROUP BY file_id"))
def export_lrc(spark, sf_dir):
    return sinks.to_lrc(v.cues_conv(spark, sf_dir))


@query(v.with_sql(v.CUES_CONV, body=r"SELECT file_id, '{\rtf1\ansi' || chr(10) || string_agg(replace(regexp_replace(text, '([\\{}])', '\\\1', 'g'), chr(10), '\line ') || '\par', chr(10) ORDER BY cue_no) || chr(10) || '}' AS value FROM cues_conv WHERE trim(text) <> '' GROUP BY file_id"))
def export_rtf(spark, sf_dir):
    return sinks.to_rtf(v.cues_conv(spark, sf_dir))


@query(v.with_sql(v.CUES_CONV, body="SELECT CAST(file_id AS VARCHAR) AS filename, 'srt' AS format, 'generic' AS platform_key, 'plain' AS structure, CAST(count(*) AS INT) AS total_lines, CAST(count(*) FILTER (WHERE cue_no % 7 = 0) AS INT) AS flagged_lines, 'done' AS status FROM cues_conv GROUP BY file_id"))
def job_log(spark, sf_dir):
    """Rows of the job log for cleaned conversations."""
    cues = v.cues_conv(spark, sf_dir).withColumns({"original_text": F.col("text"), "flagged": F.col("cue_no") % 7 == 0})
    return sinks.job_rows(audit.cleaning_stats(cues).withColumn("structure", F.lit("plain")), "generic", "srt").drop("created_at")


@query(v.with_sql(v.CUES_CONV, body="SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY cue_no) AS cue_no, start_ms + 137 * cue_no AS start_ms, end_ms + 137 * cue_no AS end_ms, trim(text, ' ') AS text FROM cues_conv WHERE trim(text, ' ') <> ''"))
def round_trip_csv(spark, sf_dir):
    """Turns with commas, quotes and line breaks written as comma-separated text and read back."""
    rows = sinks.to_csv(v.cues_conv(spark, sf_dir).withColumns({c: F.col(c) + 137 * F.col("cue_no") for c in ("start_ms", "end_ms")}))
    line = F.concat_ws(",", F.col("ID").cast("string"), *(F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')) for c in ("Start Time", "End Time", "Text")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ID", line.alias("l")))), lambda s: s["l"]), "\n")
    docs = rows.groupBy("file_id").agg(F.concat(F.lit("ID,Start Time,End Time,Text\n"), body).alias("text"))
    return readers.parse_csv(docs).select("file_id", *_long("cue_no", "start_ms", "end_ms"), "text")


@query()
def clean(spark, sf_dir):
    """Documents' lines cleaned, repaired and made ready for their platforms."""
    out = pipelines.clean(_plat(v.cues_doc(spark, sf_dir)), pl.presets(spark), columns=("file_id", "cue_no", "start_ms", "end_ms", "text", "flagged"))
    return out.select("file_id", *_long("cue_no", "start_ms", "end_ms"), "text", "flagged")


@query()
def prepare_and_check(spark, sf_dir):
    """Report of every conversation on the defects that remain after cleaning."""
    return pipelines.prepare_and_check(_plat(v.cues_conv(spark, sf_dir)), pl.presets(spark))[1]
