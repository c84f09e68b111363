"""Compositions of operators: what one request does to one file, for a whole corpus."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom import shared
from cueloom.functions import italics as it
from cueloom.functions import predicates as pr
from cueloom.functions import text as tx
from cueloom.operators import audit, qc, timing
from cueloom.operators import platforms as pl

#: What preparation and its flags need of a cue and its platform.
NEEDED = (
    "file_id", "cue_no", "start_ms", "end_ms", "text", "max_chars_per_line", "max_lines", "min_duration_seconds", "max_duration_seconds", "min_interval_seconds",
    "reading_speed_max_cps", "zero_subtitle_required", "flagged", "flag_reason",
)
POLICY = ("no_italics", "italic_lyrics", "italic_foreign")


def clean(cues: DataFrame, platforms: DataFrame, titles: DataFrame | None = None, columns: Collection[str] | None = None) -> DataFrame:
    """Deterministic cleaning of cues (file_id, platform_key, cue_no, start_ms, end_ms, text): delivery text, the ordered chain,
    italics, preparation, and flags for lines that are still too long. Protected titles keep their words.

    columns: those that the caller wants, all by default; what only the others need is left out before rows are written or dealt out.
    Cleaned texts are written to the shared folder: later filters on them would else be pushed through the whole chain, and the plan
    would grow with the power of its steps. They are the only table written; behind them the windows of the preparation stop filters."""
    wanted = lambda c: columns is None or c in columns
    joined = pl.join_platforms(cues, it.with_policy(platforms)).withColumn("original_text", F.col("text"))
    title = tx.protected_title(F.col("text"))
    first = tx.delivery_text(F.coalesce("text", F.lit("")))
    out = joined.withColumn("_title", title).withColumn("text", F.coalesce("_title", F.when(first == "", F.col("text")).otherwise(first)))
    hints = wanted("rule_hints")
    needed = (*NEEDED, *POLICY, "_title", *(("original_text", "rule_hints") if hints else ()))
    out = tx.clean_text(out)
    out = shared.written(out.select([c for c in out.columns if wanted(c) or c in needed]), "cleaned", "zstd")
    out = it.apply(audit.with_hints(out) if hints else out)
    out = out.withColumn("text", F.coalesce("_title", "text"))
    out = out.select([c for c in out.columns if c != "_title" and (wanted(c) or c in NEEDED)])
    out = timing.prepare(out, titles, columns=None if columns is None else {*columns, "max_chars_per_line", "flagged", "flag_reason"})
    out = pr.flag_too_long(out.withColumns({c: F.lit(None).cast(k) for c, k in (("flagged", "boolean"), ("flag_reason", "string")) if c not in out.columns}))
    return out if columns is None else out.select(*columns)


def check(cues: DataFrame, platforms: DataFrame, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Defects of cues as given, and the report of every file."""
    joined = pl.join_platforms(cues, it.with_policy(platforms))
    defects = qc.check(joined, files)
    return defects, qc.rollup(defects, cues.groupBy("file_id").agg(F.count("*").alias("n_cues")))


def prepare_and_check(cues: DataFrame, platforms: DataFrame, titles: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Defects that remain after cleaning and preparation."""
    columns = ("file_id", "platform_key", "cue_no", "start_ms", "end_ms", "text")
    # both the defects and the counts read it
    ready = shared.written(clean(cues, platforms, titles, columns), "prepared")
    return check(ready.filter("platform_key is not null"), platforms)
