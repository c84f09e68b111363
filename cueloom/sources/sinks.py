"""Cue tables to subtitle texts: one row a file, written by Spark's text sink. Cues without start or text are left out and numbered anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.functions import timecode as tc
from cueloom.operators import windows as wn

# The frames of the formats.
ASS_HEAD = "\n".join([
    "[Script Info]", "ScriptType: v4.00+", "WrapStyle: 0", "", "[V4+ Styles]",
    "Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding",
    "Style: Default,Arial,20,&H00FFFFFF,&H000000FF,&H00000000,&H00000000,0,0,0,0,100,100,0,0,1,2,2,2,10,10,10,1", "", "[Events]", "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text", "",
])
TTML_HEAD = '<?xml version="1.0" encoding="utf-8"?>\n<tt xmlns="http://www.w3.org/ns/ttml" xml:lang="en">\n  <body><div>\n'


def _ready(cues: DataFrame) -> DataFrame:
    return wn.renumber(cues.filter(F.trim(F.coalesce("text", F.lit(""))) != ""))


def _joined(cues: DataFrame, block: Column, between: str, head: str = "", tail: str = "") -> DataFrame:
    rows = _ready(cues).select("file_id", "cue_no", block.alias("_b"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cue_no", "_b"))), lambda s: s["_b"]), between)
    return rows.groupBy("file_id").agg(F.concat(F.lit(head), body, F.lit(tail)).alias("value"))


def _times(mark: str, between: str) -> Column:
    return F.concat(tc.clock(F.col("start_ms"), mark), F.lit(between), tc.clock(F.col("end_ms"), mark))


def to_srt(cues: DataFrame) -> DataFrame:
    return _joined(cues, F.concat_ws("\n", F.col("cue_no").cast("string"), _times(",", " --> "), "text"), "\n\n", tail="\n")


def to_vtt(cues: DataFrame) -> DataFrame:
    return _joined(cues, F.concat_ws("\n", F.col("cue_no").cast("string"), _times(".", " --> "), "text"), "\n\n", head="WEBVTT\n\n")


def to_ass(cues: DataFrame) -> DataFrame:
    text = F.col("text")
    for a, b in (("<i>", "{\\i1}"), ("</i>", "{\\i0}"), ("<b>", "{\\b1}"), ("</b>", "{\\b0}"), ("\n", "\\N")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return _joined(cues, F.concat(F.lit("Dialogue: 0,"), tc.ass_clock(F.col("start_ms")), F.lit(","), tc.ass_clock(F.col("end_ms")), F.lit(",Default,,0,0,0,,"), text), "\n", ASS_HEAD, "\n")


def to_microdvd(cues: DataFrame, fps: float = 25.0) -> DataFrame:
    frame = lambda c: F.bround(F.col(c) / 1000.0 * fps).cast("long").cast("string")
    return _joined(cues, F.concat(F.lit("{"), frame("start_ms"), F.lit("}{"), frame("end_ms"), F.lit("}"), F.replace("text", F.lit("\n"), F.lit("|"))), "\n", tail="\n")


def to_sbv(cues: DataFrame) -> DataFrame:
    return _joined(cues, F.concat_ws("\n", _times(".", ","), "text"), "\n\n", tail="\n")


def to_lrc(cues: DataFrame) -> DataFrame:
    t = F.col("start_ms")
    tag = F.format_string("[%02d:%02d.%02d]", F.floor(t / 60_000), F.floor(t / 1000) % 60, F.floor(t % 1000 / 10))
    return _joined(cues, F.concat(tag, F.replace("text", F.lit("\n"), F.lit(" "))), "\n", tail="\n")


def _escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "<br/>")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def to_ttml(cues: DataFrame) -> DataFrame:
    p = F.concat(F.lit('    <p xml:id="p'), F.col("cue_no").cast("string"), F.lit('" begin="'), tc.clock(F.col("start_ms"), "."), F.lit('" end="'), tc.clock(F.col("end_ms"), "."), F.lit('">'), _escaped(F.col("text")), F.lit("</p>"))
    return _joined(cues, p, "\n", TTML_HEAD, "\n  </div></body>\n</tt>\n")


def to_csv(cues: DataFrame) -> DataFrame:
    """Rows for `write.csv(header=True)`: ID, Start Time, End Time, Text, with file_id."""
    return _ready(cues).select("file_id", F.col("cue_no").alias("ID"), tc.clock(F.col("start_ms")).alias("Start Time"), tc.clock(F.col("end_ms")).alias("End Time"), F.col("text").alias("Text"))


def to_json(cues: DataFrame) -> DataFrame:
    item = F.struct("cue_no", tc.clock(F.col("start_ms")).alias("start_time"), tc.clock(F.col("end_ms")).alias("end_time"), "text")
    rows = _ready(cues).select("file_id", item.alias("_i"))
    return rows.groupBy("file_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list("_i")).alias("subtitles"))).alias("value"))


def to_txt(cues: DataFrame, between: str = "\n\n") -> DataFrame:
    return _joined(cues, F.col("text"), between)


def to_rtf(cues: DataFrame) -> DataFrame:
    t = F.regexp_replace("text", r"([\\{}])", r"\\$1")
    return _joined(cues, F.concat(F.replace(t, F.lit("\n"), F.lit("\\line ")), F.lit("\\par")), "\n", "{\\rtf1\\ansi\n", "\n}")


FORMATS: dict[str, Callable[[DataFrame], DataFrame]] = {"srt": to_srt, "vtt": to_vtt, "ass": to_ass, "ssa": to_ass, "sub": to_microdvd, "sbv": to_sbv, "lrc": to_lrc, "ttml": to_ttml, "xml": to_ttml, "json": to_json, "txt": to_txt, "rtf": to_rtf, "csv": to_csv}


def export(cues: DataFrame, fmt: str) -> DataFrame:
    """Texts in a format by its name; txt for a name that isn't known."""
    return FORMATS.get((fmt or "srt").lower(), to_txt)(cues)


def write(cues: DataFrame, fmt: str, path: str) -> None:
    """One text a file, in folders by file_id; csv rows go to Spark's CSV sink."""
    if fmt == "csv":
        to_csv(cues).write.partitionBy("file_id").csv(path, header=True, quoteAll=True)
    else:
        export(cues, fmt).write.partitionBy("file_id").option("lineSep", "").text(path)


def job_rows(report: DataFrame, platform_key: str, fmt: str) -> DataFrame:
    """Rows of the job log for a report (file_id, structure, total, n_flagged)."""
    return report.select(F.col("file_id").cast("string").alias("filename"), F.lit(fmt).alias("format"), F.lit(platform_key).alias("platform_key"), "structure", F.col("total").cast("int").alias("total_lines"), F.col("n_flagged").cast("int").alias("flagged_lines"), F.lit("done").alias("status"), F.current_timestamp().alias("created_at"))


def log_jobs(rows: DataFrame, path: str) -> None:
    """Appends to the job log."""
    rows.write.mode("append").parquet(path)


def job_stats(jobs: DataFrame) -> DataFrame:
    """(platform, status, size) of jobs: how many there are of each platform, how many are done, and the largest."""
    return jobs.groupBy("platform").agg(F.count("*").alias("n_jobs"), F.count_if(F.col("status") == "done").alias("n_done"), F.max("size").alias("most"))
