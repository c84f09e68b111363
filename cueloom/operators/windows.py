"""Operators over a file's ordered cues, which cue_no orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cueloom.functions import predicates as pr
from cueloom.functions import timecode as tc

FRAME = tc.FRAME_MS


def ordered() -> WindowSpec:
    return Window.partitionBy("file_id").orderBy("cue_no")


def before() -> WindowSpec:
    return ordered().rowsBetween(Window.unboundedPreceding, -1)


def after() -> WindowSpec:
    return ordered().rowsBetween(1, Window.unboundedFollowing)


def frame_gap(fps: float = 25.0) -> Column:
    """Frames from the row before's end to this start; null unless both rows have start and end."""
    timed = F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()
    last = F.lag(F.when(timed, F.col("end_ms"))).over(ordered())
    return F.bround((F.when(timed, F.col("start_ms")) - last) / 1000.0 * fps).cast("int")


def fill_ends(cues: DataFrame) -> DataFrame:
    """Missing ends: two frames before the next strictly later start, but at least two frames long; the last one 2 s."""
    start = F.col("start_ms")
    # starts descend from the file's end; the nearest later start that is larger, by a running minimum where starts ascend
    later = F.min("start_ms").over(Window.partitionBy("file_id").orderBy("start_ms").rangeBetween(1, Window.unboundedFollowing))
    end = F.when(later.isNotNull(), F.greatest(start + 2 * FRAME, later - 2 * FRAME)).otherwise(start + 2000)
    return cues.withColumn("end_ms", F.coalesce("end_ms", F.when(start.isNotNull(), tc.snap_ms(end))))


def renumber(cues: DataFrame) -> DataFrame:
    """Timed cues numbered from 1; a missing end is the next start, 0.2 s later at least, or 3 s later for the last."""
    kept = cues.filter("start_ms is not null")
    following = F.lead("start_ms").over(ordered())
    end = F.coalesce("end_ms", F.when(following.isNotNull(), F.greatest(following, F.col("start_ms") + 200)), F.col("start_ms") + 3000)
    return kept.withColumns({"end_ms": end, "_no": F.row_number().over(ordered())}).withColumn("cue_no", F.col("_no")).drop("_no")


def ends_before_next(cues: DataFrame) -> DataFrame:
    """Every end two frames before the next row's start; the last 2 s after its own."""
    following = F.lead("start_ms").over(ordered())
    end = F.when(following.isNotNull(), F.greatest(F.lit(0), following - 2 * FRAME)).otherwise(F.col("start_ms") + 2000)
    return cues.filter("start_ms is not null").withColumn("end_ms", end)


def sequential_times(cues: DataFrame, length_ms: int = 2000, step_ms: int = 2200) -> DataFrame:
    """Times by position: `length_ms` long every `step_ms`."""
    at = (F.row_number().over(ordered()) - 1) * step_ms
    return cues.withColumn("start_ms", at.cast("bigint")).withColumn("end_ms", F.col("start_ms") + length_ms)


def placeholders(cues: DataFrame) -> DataFrame:
    """Files without any time get 2 s every 3 s."""
    timed = F.max(F.col("start_ms").isNotNull()).over(Window.partitionBy("file_id"))
    at = ((F.row_number().over(ordered()) - 1) * 3000).cast("bigint")
    marked = cues.withColumn("_timed", timed).withColumn("_at", at)
    return marked.withColumn("end_ms", F.when(F.col("_timed"), F.col("end_ms")).otherwise(F.col("_at") + 2000)).withColumn("start_ms", F.when(F.col("_timed"), F.col("start_ms")).otherwise(F.col("_at"))).drop("_timed", "_at")


def fill_starts(cues: DataFrame, step_ms: int = 3000) -> DataFrame:
    """Missing starts go on from the last known one by `step_ms` a row; before any, from 0."""
    upto = ordered().rowsBetween(Window.unboundedPreceding, 0)
    row = F.row_number().over(ordered())
    numbered = cues.withColumn("_row", row)
    known, at = F.last("start_ms", ignorenulls=True).over(upto), F.last(F.when(F.col("start_ms").isNotNull(), F.col("_row")), ignorenulls=True).over(upto)
    filled = F.coalesce(known + (F.col("_row") - at) * step_ms, (F.col("_row") - 1) * step_ms).cast("bigint")
    return numbered.withColumn("start_ms", F.coalesce("start_ms", filled)).drop("_row")


def first_spoken(cues: DataFrame) -> DataFrame:
    """The first cue of each file that is no zero subtitle."""
    return cues.filter(~pr.is_zero_subtitle(F.col("text"))).groupBy("file_id").agg(F.min_by(F.struct("cue_no", "start_ms", "text"), "cue_no").alias("_f")).select("file_id", "_f.*")


def consecutive_dedup(cues: DataFrame) -> DataFrame:
    """Cues whose text differs from the row before's."""
    return cues.withColumn("_before", F.lag("text").over(ordered())).filter(F.col("_before").isNull() | (F.col("_before") != F.col("text"))).drop("_before")


def overlaps(cues: DataFrame, slack_ms: int = 1) -> DataFrame:
    """Cues that start before the last known end by more than slack_ms."""
    return cues.withColumn("previous_end_ms", F.last("end_ms", ignorenulls=True).over(before())).filter(F.col("start_ms") < F.col("previous_end_ms") - slack_ms)


def neighbours(cues: DataFrame) -> DataFrame:
    """The nearest timed cues before and after each cue."""
    timed = lambda c: F.when(F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull(), F.col(c))
    return cues.withColumns({
        "previous_no": F.last(timed("cue_no"), ignorenulls=True).over(before()), "previous_end_ms": F.last(timed("end_ms"), ignorenulls=True).over(before()),
        "next_no": F.first(timed("cue_no"), ignorenulls=True).over(after()), "next_start_ms": F.first(timed("start_ms"), ignorenulls=True).over(after()),
    })


def expected_positions(lines: DataFrame, n_cues: DataFrame) -> DataFrame:
    """Lines (file_id, line_no from 0) with the band of transcript cues in which each is looked for."""
    n = F.count("*").over(Window.partitionBy("file_id"))
    sized = lines.withColumn("_lines", n).join(n_cues, "file_id")
    expected = F.floor(F.col("line_no") * F.col("n_cues") / F.col("_lines")).cast("int")
    half = F.least(F.lit(80), F.greatest(F.lit(20), F.floor(F.col("n_cues") / 4))).cast("int")
    all_ = F.col("_lines") <= 1
    low, high = F.when(all_, 0).otherwise(F.greatest(F.lit(0), expected - half)), F.when(all_, F.col("n_cues") - 1).otherwise(F.least(F.col("n_cues") - 1, expected + half))
    return sized.withColumn("band_lo", low.cast("int")).withColumn("band_hi", high.cast("int")).drop("_lines")


def active_at(cues: DataFrame, probes: DataFrame, bucket_ms: int = 10_000) -> DataFrame:
    """The first cue on screen at each probe (file_id, t_ms): start <= t < end. Joined by time buckets, not by ranges."""
    spans = F.sequence(F.floor(F.col("start_ms") / bucket_ms), F.floor((F.greatest("end_ms", F.col("start_ms") + 1) - 1) / bucket_ms))
    bucketed = cues.filter("start_ms is not null and end_ms > start_ms").select("file_id", "cue_no", "start_ms", "end_ms", F.explode(spans).alias("_b"))
    at = probes.withColumn("_b", F.floor(F.col("t_ms") / bucket_ms))
    return at.join(bucketed, ["file_id", "_b"]).filter("start_ms <= t_ms and t_ms < end_ms").groupBy("file_id", "t_ms").agg(F.min("cue_no").alias("cue_no"))


def restore_times(cleaned: DataFrame, source: DataFrame) -> DataFrame:
    """Times of the source rows given back to cleaned rows by position; rows marked deleted go afterwards."""
    order = F.row_number().over(ordered())
    times = source.select("file_id", order.alias("_n"), "start_ms", "end_ms")
    joined = cleaned.drop("start_ms", "end_ms").withColumn("_n", order).join(times, ["file_id", "_n"], "left").drop("_n")
    return joined.filter(~F.coalesce("deleted", F.lit(False))) if "deleted" in cleaned.columns else joined


def sorted_by_start(cues: DataFrame) -> DataFrame:
    """cue_no by start, missing ones first as 0, ties in old order."""
    order = Window.partitionBy("file_id").orderBy(F.coalesce("start_ms", F.lit(0)), "cue_no")
    return cues.withColumn("_n", F.row_number().over(order)).withColumn("cue_no", F.col("_n")).drop("_n")


def lacks_zero() -> Column:
    """Whether the first cue of the file is no zero subtitle."""
    return ~pr.is_zero_subtitle(F.coalesce(F.first("text").over(ordered().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit("")))


def zero_seconds(cues: DataFrame, least_s: float = 1.0) -> Column:
    """Length of a zero subtitle: 1.08 s, or the platform's least."""
    least = F.coalesce("min_duration_seconds", F.lit(least_s)) if "min_duration_seconds" in cues.columns else F.lit(least_s)
    return F.greatest(least, F.lit(1.08))


def put_zero(cues: DataFrame, least_s: float = 1.0) -> DataFrame:
    """cues numbered from 1 by cue_no, with a zero subtitle (_title or PROGRAM, STORY, LANG) before the first one where _zero holds, and
    instead of it where _alone does too. It has the platform of its file; later cues move on by one."""
    first, own = F.col("_zero") & (F.col("cue_no") == 1), F.lit(False)
    out = cues.select("*", F.explode(F.when(first & F.col("_alone"), F.array(~own)).when(first, F.array(~own, own)).otherwise(F.array(own))).alias("_is"))
    put = lambda c, value: F.when(F.col("_is"), value).otherwise(F.col(c))
    text = F.concat(F.coalesce("_title", F.lit("PROGRAM")), F.lit("\nSTORY: UNKNOWN\nLANG: ENG"))
    values = {
        "text": text, "start_ms": F.lit(0).cast("bigint"), "end_ms": tc.snap_seconds(zero_seconds(cues, least_s)), "original_text": F.lit(""), "rule_hints": F.array(F.lit("zero_subtitle")),
        "flagged": F.lit(False), "flag_reason": F.lit(""),
    }
    made = {c: put(c, value) for c, value in values.items() if c in cues.columns}
    number = F.col("cue_no") + (F.col("_zero") & ~F.col("_is")).cast("int")
    return out.withColumns(made | {"cue_no": number.cast("int")}).drop("_is", "_zero", "_alone", "_title")


def with_titles(cues: DataFrame, titles: DataFrame | None) -> DataFrame:
    """cues with _title of titles (file_id, title), null where the file has none."""
    if titles is None:
        return cues.withColumn("_title", F.lit(None).cast("string"))
    return cues.join(titles.groupBy("file_id").agg(F.min("title").alias("_title")), "file_id", "left")


def prepend_zero(cues: DataFrame, titles: DataFrame | None = None, least_s: float = 1.0) -> DataFrame:
    """Files whose first cue is no zero subtitle get one with the show's title (file_id, title); cues are renumbered."""
    marked = with_titles(cues, titles).withColumns({"_zero": lacks_zero(), "_alone": F.lit(False), "_n": F.row_number().over(ordered())})
    return put_zero(marked.withColumn("cue_no", F.col("_n")).drop("_n"), least_s).select(cues.columns)


def weak_context(weak: DataFrame, cues: DataFrame, around: int = 17, nearest: int = 12) -> DataFrame:
    """Transcript cues shown for each weak line (file_id, line_no, lo_ms, hi_ms): those within the known neighbours and 1 s, else
    the `nearest` ones by distance of centres to the middle, at most 24."""
    joined = weak.join(cues.select("file_id", F.col("cue_no").alias("context_no"), "start_ms", "end_ms"), "file_id")
    inside = (F.col("start_ms") <= F.col("hi_ms") + 1000) & (F.col("end_ms") >= F.col("lo_ms") - 1000)
    distance = F.abs((F.col("start_ms") + F.col("end_ms")) / 2 - (F.col("lo_ms") + F.col("hi_ms")) / 2)
    ranked = joined.withColumn("_in", inside).withColumn("_any", F.max(inside).over(Window.partitionBy("file_id", "line_no")))
    ranked = ranked.withColumn("_r", F.row_number().over(Window.partitionBy("file_id", "line_no").orderBy(F.desc("_in"), distance, "context_no")))
    return ranked.filter((F.col("_any") & F.col("_in") & (F.col("_r") <= 24)) | (~F.col("_any") & (F.col("_r") <= nearest))).select("file_id", "line_no", "context_no")
