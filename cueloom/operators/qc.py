"""Quality checks. Each check is an expression over a cue joined with its platform; all row checks run in one projection.

A defect is struct<check_no, type, severity, detail>. `defects` explodes them; `scorecard` counts them without exploding.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.functions import predicates as pr
from cueloom.functions import text as tx
from cueloom.operators import windows as wn

DEFECT = "array<struct<check_no:int,type:string,severity:string,detail:string>>"
#: Defects that no automatic fix removes.
UNFIXABLE = ("FILE_NAMING", "READING_SPEED_EXCEEDED", "DURATION_TOO_SHORT", "DURATION_TOO_LONG", "LINE_TOO_LONG", "INVALID_GAP")
#: Gaps in frames that no delivery may have.
FORBIDDEN_GAP = (3, 11)

HOH = r"(?i)\[music[^\]]*\]|\[applause\]|\[laughter\]|\[cheering\]|\[gunshot\]|\[explosion\]|\(narrator\)|\(narrating\)|\[[^\n]*?music[^\n]*?\]|\[[^\n]*?sound[^\n]*?\]"


def _defect(no: int, kind: str, severity: str, detail: Column | str = "") -> Column:
    d = F.lit(detail) if isinstance(detail, str) else detail.cast("string")
    return F.struct(F.lit(no).alias("check_no"), F.lit(kind).alias("type"), F.lit(severity).alias("severity"), d.alias("detail"))


def _one(condition: Column, defect: Column) -> Column:
    return F.when(condition, F.array(defect)).otherwise(F.array().cast(DEFECT))


def _c(name: str) -> Column:
    return F.col(name)


def seconds() -> Column:
    return (_c("end_ms") - _c("start_ms")) / 1000.0


def reading_speed() -> Column:
    """Visible characters a second; null without a positive duration."""
    return F.when(_c("end_ms") > _c("start_ms"), tx.spoken_length(_c("text")) / seconds())


def _spoken() -> Column:
    return (F.coalesce(_c("text"), F.lit("")) != "") & ~pr.is_zero_subtitle(_c("text"))


def _says(phrase: str) -> Column:
    return _c("rules_text").contains(phrase)


def too_many_lines() -> Column:
    n = F.size(F.split("text", "\n"))
    return _one(_spoken() & (n > _c("max_lines")), _defect(3, "TOO_MANY_LINES", "error", n))


def line_too_long() -> Column:
    """A defect for each line over its limit; lines in italics have their own where the platform sets one."""
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.struct(i.alias("i"), tx.visible_length(line).alias("n"), F.when(line.contains("<i>") | line.contains("</i>"), F.coalesce("max_chars_italics", "max_chars_per_line")).otherwise(_c("max_chars_per_line")).alias("limit")))
    long = F.transform(F.filter(lines, lambda x: x["n"] > x["limit"]), lambda x: _defect(4, "LINE_TOO_LONG", "error", F.concat_ws(":", (x["i"] + 1).cast("string"), x["n"].cast("string"))))
    return F.when(_spoken(), long).otherwise(F.array().cast(DEFECT))


def duration_too_short() -> Column:
    return _one(_spoken() & (seconds() >= 0) & (seconds() < _c("min_duration_seconds")), _defect(5, "DURATION_TOO_SHORT", "warning", F.round(seconds(), 2)))


def duration_too_long() -> Column:
    return _one(_spoken() & (seconds() > _c("max_duration_seconds")), _defect(6, "DURATION_TOO_LONG", "warning", F.round(seconds(), 2)))


def reading_speed_exceeded() -> Column:
    return _one(_spoken() & (_c("_cps") > _c("reading_speed_max_cps")), _defect(7, "READING_SPEED_EXCEEDED", "error", F.round("_cps", 1)))


def reading_speed_high() -> Column:
    v = _c("_cps")
    return _one(_spoken() & (v > _c("reading_speed_target_cps")) & ~(v > _c("reading_speed_max_cps")), _defect(8, "READING_SPEED_HIGH", "info", F.round(v, 1)))


def profanity_not_replaced() -> Column:
    """A defect for each word of the platform's table that stands in the cue."""
    entries = F.coalesce(F.map_keys("profanity_table"), F.array().cast("array<string>"))
    hit = F.filter(entries, lambda w: F.rlike(_c("text"), F.concat(F.lit(r"(?iu)\b\Q"), w, F.lit(r"\E\b"))))
    return F.transform(hit, lambda w: _defect(9, "PROFANITY_NOT_REPLACED", "error", w))


def formatting_issues() -> Column:
    t = _c("text")
    return F.array_compact(F.array(
        F.when(t.contains("  "), F.lit("double space")), F.when(t.rlike(r" [.,!?;:]"), F.lit("space before punctuation")), F.when(t.contains("!!"), F.lit("double exclamation mark")),
        F.when(t.contains("??"), F.lit("double question mark")), F.when(t.contains("...."), F.lit("more than three dots")), F.when(t.rlike(r"(?U)^\s|\s$"), F.lit("outer white space")),
        F.when(F.exists(F.split(t, "\n"), lambda x: F.trim(x).isin("-", "–")), F.lit("empty speaker line")),
    ))


def formatting_defect() -> Column:
    issues = formatting_issues()
    return _one(~pr.is_zero_subtitle(_c("text")) & (F.size(issues) > 0), _defect(10, "FORMATTING_DEFECT", "error", F.array_join(issues, "; ")))


def capitalisation_note() -> Column:
    """The first line that begins in lower case, after a hyphen and tags, unless dots lead."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"^-\s*", ""), "^(?:</?[ib]>)+", ""))
    low = F.filter(lines, lambda x: F.ltrim(x).rlike(r"^\p{Ll}"))
    return _one(~pr.is_zero_subtitle(_c("text")) & (F.size(low) > 0), _defect(11, "CAPITALIZATION_NOTE", "info", F.substring(F.get(low, 0), 1, 30)))


def hoh_element() -> Column:
    gate = F.exists("remove_elements", lambda e: F.lower(e).isin("hoh", "emt"))
    return _one(gate & _c("text").rlike(HOH), _defect(12, "HOH_EMT_ELEMENT", "error"))


def italics_not_allowed() -> Column:
    return _one(_c("no_italics") & _c("text").rlike("</?i>"), _defect(14, "ITALICS_NOT_ALLOWED", "error"))


def lyrics_not_italic() -> Column:
    return _one(_c("italic_lyrics") & ~_c("no_italics") & _c("text").rlike("[♪♫🎵🎶]") & ~_c("text").contains("<i>"), _defect(15, "SONG_LYRICS_NOT_ITALIC", "warning"))


def profanity_format() -> Column:
    return _one(_says("asterisks (****)") & _c("text").rlike(r"(?i)\*bleep\*|\[bleep\]|\(bleep\)"), _defect(17, "PROFANITY_FORMAT", "warning"))


ROW_CHECKS: dict[str, Callable[[], Column]] = {
    "TOO_MANY_LINES": too_many_lines, "LINE_TOO_LONG": line_too_long, "DURATION_TOO_SHORT": duration_too_short, "DURATION_TOO_LONG": duration_too_long,
    "READING_SPEED_EXCEEDED": reading_speed_exceeded, "READING_SPEED_HIGH": reading_speed_high, "PROFANITY_NOT_REPLACED": profanity_not_replaced,
    "FORMATTING_DEFECT": formatting_defect, "CAPITALIZATION_NOTE": capitalisation_note, "HOH_EMT_ELEMENT": hoh_element, "ITALICS_NOT_ALLOWED": italics_not_allowed,
    "SONG_LYRICS_NOT_ITALIC": lyrics_not_italic, "PROFANITY_FORMAT": profanity_format,
}


def with_policy(joined: DataFrame) -> DataFrame:
    """Italics policy columns where they are missing: from rule text, else italics are allowed and lyrics should have them."""
    for name, value in (("no_italics", F.coalesce(F.col("rules_text").rlike("no italics|no text style"), F.lit(False))), ("italic_lyrics", F.coalesce(F.col("rules_text").rlike("song|lyric") & F.col("rules_text").contains("italic"), F.lit(False)))):
        if name not in joined.columns:
            joined = joined.withColumn(name, value)
    return joined


def row_defects(joined: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """Cues joined with platform fields, with `defects` of the row checks added. A null text has none."""
    checks = [ROW_CHECKS[t]() for t in types or ROW_CHECKS]
    found = F.concat(*checks)
    # the speed is a column of its own, measured once for all checks that ask for it
    return with_policy(joined).withColumn("_cps", reading_speed()).withColumn("defects", F.when(F.col("text").isNotNull(), found).otherwise(F.array().cast(DEFECT))).drop("_cps")


def exploded(rows: DataFrame, *columns: str | Column) -> DataFrame:
    """columns and a row `d` for each of `defects`. An inner explode would make a filter on the array's size, which is pushed below
    it and runs all checks a second time."""
    return rows.select(*columns, F.explode_outer("defects").alias("d")).filter("d is not null")


def _rows(frame: DataFrame) -> DataFrame:
    return frame.select("file_id", "check_no", "type", "severity", F.col("line_id").cast("int").alias("line_id"), "detail")


def gap_rows(cues: DataFrame, gap: str) -> DataFrame:
    """Defects of cues with their gap in frames to the row before: 3 to 11 frames; overlaps and smaller gaps are none."""
    bad = cues.filter(F.col(gap).between(*FORBIDDEN_GAP))
    return _rows(bad.select("file_id", F.lit(13).alias("check_no"), F.lit("INVALID_GAP").alias("type"), F.lit("warning").alias("severity"), F.col("cue_no").alias("line_id"), F.col(gap).cast("string").alias("detail")))


def gap_defects(cues: DataFrame, fps: float = 25.0) -> DataFrame:
    """Gaps of 3 to 11 frames to the row before."""
    return gap_rows(cues.withColumn("_gap", wn.frame_gap(fps)), "_gap")


def overlap_defects(cues: DataFrame) -> DataFrame:
    """Cues that start before the row before ends: an extra check, off unless asked for."""
    gap = cues.withColumn("_gap", wn.frame_gap()).filter("_gap < 0")
    return _rows(gap.select("file_id", F.lit(22).alias("check_no"), F.lit("OVERLAP").alias("type"), F.lit("warning").alias("severity"), F.col("cue_no").alias("line_id"), F.col("_gap").cast("string").alias("detail")))


def file_naming(files: DataFrame) -> DataFrame:
    """(file_id, file_name, file_naming_format): names that an EHD_ platform rejects."""
    bad = files.filter(F.col("file_naming_format").contains("EHD_") & ~F.col("file_name").rlike(r"(?i)^EHD_\d{6}[A-Z]_[A-Z]{3}\.PAC$"))
    return _rows(bad.select("file_id", F.lit(1).alias("check_no"), F.lit("FILE_NAMING").alias("type"), F.lit("critical").alias("severity"), F.lit(None).alias("line_id"), F.col("file_name").alias("detail")))


def _by_file(joined: DataFrame) -> DataFrame:
    """What the file checks need, one row a file: partial aggregates, no window."""
    t = F.lower(F.coalesce("text", F.lit("")))
    first = lambda cond: F.min(F.when(cond, F.struct("cue_no", "start_ms", "text")))
    return joined.groupBy("file_id").agg(
        first(F.lit(True)).alias("first"), first(~pr.is_zero_subtitle(F.col("text"))).alias("spoken"), F.max("cue_no").alias("last_no"), F.first("rules_text").alias("rules_text"), F.first("zero_subtitle_required").alias("zero_required"),
        F.max(t.contains("subtitling by") | t.contains("subtitles by")).alias("has_credit"), F.max(t.contains("translated by")).alias("has_translator"),
    )


def _reminders() -> Column:
    """Notes on tasks that no script holds, joined by bars."""
    notes = {
        "raise subtitle|raise to top": "raise subtitles over graphics", "centre-justified|center-justified": "justify in the centre", "file naming": "follow the naming convention",
        "zero subtitle|story and lang": "check the zero subtitle", "repo file|repositioning": "make a repositioning file", "end credit file": "make an end credit file", "spellcheck": "run a spell check",
    }
    return F.array_join(F.array_compact(F.array(*[F.when(F.col("rules_text").rlike(k), F.lit(v)) for k, v in notes.items()])), " | ")


def file_defects(joined: DataFrame) -> DataFrame:
    """Zero subtitle, credits, early first cue and reminders of each file."""
    f = _by_file(joined)
    zero_at = F.col("first.start_ms").isNull() | (F.col("first.start_ms") < 1000)
    early = F.col("rules_text").contains("first 1 second") & (F.col("spoken.start_ms") < 1000)
    add = lambda cond, no, kind, severity, line, detail: F.when(cond, F.struct(F.lit(no).alias("check_no"), F.lit(kind).alias("type"), F.lit(severity).alias("severity"), line.cast("int").alias("line_id"), detail.cast("string").alias("detail")))
    none = F.lit(None)
    found = F.array_compact(F.array(
        add(F.col("zero_required") & zero_at & ~pr.is_zero_subtitle(F.col("first.text")), 2, "ZERO_SUBTITLE_INVALID", "warning", F.col("first.cue_no"), none),
        add(F.col("rules_text").rlike("subtitl(?:es|ing) by") & ~F.col("has_credit"), 16, "END_CREDIT_REMINDER", "info", F.col("last_no"), none),
        add(F.col("rules_text").contains("translator credit:") & ~F.col("has_translator"), 18, "TRANSLATOR_CREDIT_REMINDER", "info", F.col("last_no"), none),
        add(early, 19, "CUED_TOO_EARLY", "warning", F.col("spoken.cue_no"), F.col("spoken.start_ms")),
        add(_reminders() != "", 20, "SUBTITLER_REMINDERS", "info", none, _reminders()),
    ))
    return _rows(f.select("file_id", F.explode(found).alias("d")).select("file_id", "d.*"))


def check(joined: DataFrame, files: DataFrame | None = None, fps: float = 25.0, overlaps: bool = False) -> DataFrame:
    """All defects of cues joined with platform fields, as given, in check order."""
    rows = exploded(row_defects(joined), "file_id", F.col("cue_no").alias("line_id"))
    out = _rows(rows.select("file_id", "d.check_no", "d.type", "d.severity", "line_id", "d.detail")).unionByName(gap_defects(joined, fps)).unionByName(file_defects(joined))
    if overlaps:
        out = out.unionByName(overlap_defects(joined))
    return out if files is None else out.unionByName(file_naming(files))


def rollup(defects: DataFrame, files: DataFrame) -> DataFrame:
    """Report of every file: counts by severity, defect and clean lines, and whether it is ready. files: (file_id, n_cues)."""
    hard = F.col("severity").isin("critical", "error")
    counts = defects.groupBy("file_id").agg(F.count("*").alias("n_defects"), F.count_if(hard).alias("n_errors"), F.count_if(F.col("severity") == "warning").alias("n_warnings"), F.count_if(F.col("severity") == "info").alias("n_info"), F.count_distinct("line_id").alias("n_defect_lines"))
    out = files.join(counts, "file_id", "left").na.fill(0, ["n_defects", "n_errors", "n_warnings", "n_info", "n_defect_lines"])
    return out.withColumn("n_clean_lines", F.col("n_cues") - F.col("n_defect_lines")).withColumn("is_ready", F.col("n_errors") == 0)


def scorecard(joined: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """The report of row checks straight from the cues: one aggregation by file, nothing exploded."""
    of = lambda *s: F.size(F.filter("defects", lambda d: d["severity"].isin(*s)))
    out = row_defects(joined, types).groupBy("file_id").agg(
        F.count("*").alias("n_cues"), F.sum(F.size("defects")).alias("n_defects"), F.sum(of("critical", "error")).alias("n_errors"), F.sum(of("warning")).alias("n_warnings"),
        F.sum(of("info")).alias("n_info"), F.count_if(F.size("defects") > 0).alias("n_defect_lines"),
    )
    return out.withColumn("n_clean_lines", F.col("n_cues") - F.col("n_defect_lines")).withColumn("is_ready", F.col("n_errors") == 0)
