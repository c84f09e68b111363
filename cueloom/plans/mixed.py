"""Registered query of a corpus of mixed formats: documents written by the sinks, a format a file, and read back together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom import views as v
from cueloom.plans.registered import _long, query
from cueloom.sources import readers, sinks

#: Format by file_id; those marked are told by their content in every other file, which then has no name.
FORMATS = (("srt", sinks.to_srt, True), ("vtt", sinks.to_vtt, True), ("ass", sinks.to_ass, True), ("sub", sinks.to_microdvd, True), ("sbv", sinks.to_sbv, False), ("ttml", sinks.to_ttml, True), ("json", sinks.to_json, True), ("txt", sinks.to_txt, False))


@query(v.with_sql(v.CUES_DOC, body=f"SELECT file_id, CAST(cue_no AS BIGINT) AS cue_no, start_ms, end_ms, CASE WHEN file_id % {len(FORMATS)} = 3 THEN trim(replace(text, '|', chr(10)), ' ') ELSE text END AS text FROM cues_doc"))
def mixed_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file of one of eight formats, told by name or content, parsed in one pass."""
    cues, corpus = v.cues_doc(spark, sf_dir), None
    for k, (extension, sink, by_content) in enumerate(FORMATS):
        own = sink(cues.filter(F.col("file_id") % len(FORMATS) == k))
        nameless = F.lit(by_content) & (F.floor(F.col("file_id") / len(FORMATS)) % 2 == 1)
        own = own.select("file_id", F.when(~nameless, F.concat(F.lit("file."), F.lit(extension))).alias("file_name"), F.col("value").alias("text"))
        corpus = own if corpus is None else corpus.unionByName(own)
    return readers.parse_any(corpus).select("file_id", *_long("cue_no", "start_ms", "end_ms"), "text")
