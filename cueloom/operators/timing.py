"""Timing repair and preparation for delivery. Repair is a recurrence on the previous repaired cue; it runs on islands of cues
that can't touch each other, which two window passes cut beforehand, so long files run in parallel."""

from __future__ import annotations

from collections.abc import Collection, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cueloom.functions import predicates as pr
from cueloom.functions import text as tx
from cueloom.functions import timecode as tc
from cueloom.operators import windows as wn

FPS, GAP_MS = 25, 80
#: Islands of a file that one task repairs in turn.
ISLANDS = 256
PLATFORM = ("min_duration_seconds", "max_duration_seconds", "min_interval_seconds", "reading_speed_max_cps")


def entry_guard(cues: DataFrame) -> DataFrame:
    """An end that isn't after its start is moved to a second after it."""
    return cues.withColumn("end_ms", F.when(F.col("end_ms") <= F.col("start_ms"), F.col("start_ms") + 1000).otherwise(F.col("end_ms")))


def required_seconds() -> Column:
    cps = F.col("reading_speed_max_cps")
    return F.greatest(F.col("min_duration_seconds"), F.when(cps > 0, tx.spoken_length(F.coalesce("text", F.lit(""))) / cps).otherwise(F.lit(0.0)))


def gap_frames() -> Column:
    return F.greatest(F.lit(1), F.bround(F.col("min_interval_seconds") * FPS).cast("int"))


def islands(cues: DataFrame) -> DataFrame:
    """Timed cues with `island`: a cue that starts after all that earlier ones can be pushed to opens a new one."""
    return _islands(cues).drop("_need")


def _islands(cues: DataFrame) -> DataFrame:
    """islands with _need, the seconds that a cue needs to be read."""
    need, gap, start = F.col("_need"), gap_frames() / FPS, F.col("start_ms") / 1000.0
    order = Window.partitionBy("file_id").orderBy("_order")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # made below the first window, so once a cue
    out = cues.filter("start_ms is not null").withColumn("_need", required_seconds()).withColumn("_order", F.row_number().over(wn.ordered()))
    out = out.withColumn("_p", F.sum(gap + need + 2 / FPS).over(order))
    reach = F.greatest(F.coalesce("end_ms", F.lit(0)) / 1000.0, start + need) - F.col("_p")
    out = out.withColumn("_reach", reach)
    bound = F.max("_reach").over(before) + F.lag("_p").over(order)
    opens = F.coalesce((start >= bound + gap + 2 / FPS).cast("int"), F.lit(1))
    return out.withColumn("_opens", opens).withColumn("island", F.sum("_opens").over(order)).drop("_p", "_reach", "_opens")


def _snap(x: float) -> float:
    return round(x * FPS) / FPS


def repaired(last: float, start_ms: float, end_ms: float | None, gap: float, need: float, least: float, most: float) -> tuple[int, int]:
    """Start and end of a cue in ms; last: end of the cue before in seconds, below 0 for none."""
    start, end = _snap(start_ms / 1000), None if pd.isna(end_ms) else _snap(end_ms / 1000)
    if last >= 0:
        start = max(start, last + gap / FPS)
    if end is None or end <= start:
        end = start + least
    end = min(max(end, start + need), start + most)
    if end <= start:
        end = start + 1 / FPS
    return round(_snap(start) * 1000), round(_snap(end) * 1000)


def _repair(group: pd.DataFrame) -> pd.DataFrame:
    """All cues of a file in turn: what the blocks of `repair_windows` must give together."""
    group = group.sort_values("_order")
    last, starts, ends = -1.0, [], []
    for row in zip(group["start_ms"], group["end_ms"], group["_gap"], group["_need"], group["min_duration_seconds"], group["max_duration_seconds"], strict=True):
        start, end = repaired(last, *row)
        last = _snap(end / 1000)
        starts.append(start)
        ends.append(end)
    return group.assign(start_ms=starts, end_ms=ends)


def _repair_rows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, those of a file's block of islands one behind another, with repaired times and all other columns as they are."""
    block, last = None, -1.0
    for part in rows:
        starts, ends = [], []
        names = ("file_id", "_block", "start_ms", "end_ms", "_gap", "_need", "min_duration_seconds", "max_duration_seconds")
        for file, number, *row in zip(*(part.column(c).to_pylist() for c in names), strict=True):
            if (file, number) != block:
                block, last = (file, number), -1.0
            start, end = repaired(last, *row)
            last = _snap(end / 1000)
            starts.append(start)
            ends.append(end)
        kept = [c for c in part.schema.names if c not in ("_block", "_gap", "_need")]
        times = {"start_ms": pa.array(starts, pa.int64()), "end_ms": pa.array(ends, pa.int64())}
        yield pa.RecordBatch.from_arrays([times.get(c, part.column(c)) for c in kept], kept)


def _repaired_in_order(cues: DataFrame, idle: Collection[str] = ()) -> DataFrame:
    """Timed cues with repaired times and `_order`, their place in the file. One pass: the rows are dealt out by blocks of islands with
    all they hold but the columns `idle`, so none is joined back."""
    # many short islands share a block: repairing several in turn gives what each would give alone
    work = _islands(cues).withColumns({"_gap": gap_frames(), "_block": F.floor(F.col("island") / ISLANDS)}).drop("island", *idle)
    in_order = work.repartition("file_id", "_block").sortWithinPartitions("file_id", "_block", "_order")
    kind = StructType([StructField(f.name, LongType()) if f.name in ("start_ms", "end_ms") else f for f in work.drop("_gap", "_need", "_block").schema.fields])
    return in_order.mapInArrow(_repair_rows, kind)


def repair_windows(cues: DataFrame) -> DataFrame:
    """Cues joined with platform fields: starts pushed behind the last repaired end and the gap, ends long enough to read and no
    longer than allowed, all on the frame grid. Untimed cues are dropped."""
    return _repaired_in_order(cues).select(cues.columns)


def split_long(cues: DataFrame) -> DataFrame:
    """Cues over max_lines wrapped lines become several, sharing the time by characters with two-frame gaps; the last keeps the end.

    Cues without a positive duration are wrapped only. The pieces follow each other in cue_no, which is numbered anew.
    """
    out = cues.withColumn("_chunks", tx.line_groups(tx.wrap_lines(F.coalesce("text", F.lit("")), F.col("max_chars_per_line")), F.col("max_lines")))
    timed = F.col("end_ms") > F.col("start_ms")
    several = timed & (F.size("_chunks") > 1)
    whole = F.array(tx.wrap(F.col("text"), F.col("max_chars_per_line")))
    chunks = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", F.array("text")).when(several, F.col("_chunks")).otherwise(whole)
    out = out.withColumn("_chunks", chunks)
    # tags are looked for where one can be
    visible = lambda c: F.length(F.when(c.contains("<"), tx.strip_tags(c)).otherwise(c))
    n, total = F.size("_chunks"), F.aggregate("_chunks", F.lit(0), lambda a, c: a + visible(c))
    span = (F.col("end_ms") - F.col("start_ms")) / 1000.0
    out = out.withColumns({"_n": n, "_total": F.greatest(total, F.lit(1)), "_room": F.greatest(span - GAP_MS / 1000 * (n - 1), GAP_MS / 1000 * n)})
    length = lambda c: F.greatest(F.col("_room") * visible(c) / F.col("_total"), F.lit(GAP_MS / 1000))
    # lengths once a piece; a piece starts behind the lengths and gaps of those before it
    sums = F.aggregate("_d", F.struct(F.lit(0.0).alias("at"), F.array().cast("array<double>").alias("all")), lambda a, d: F.struct((a["at"] + d + GAP_MS / 1000).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")), lambda a: a["all"])
    out = out.withColumn("_d", F.transform("_chunks", length)).withColumn("_s", sums)
    piece = F.transform("_chunks", lambda c, i: F.struct(i.alias("i"), c.alias("t"), F.col("_s")[i].alias("s"), F.col("_d")[i].alias("d")))
    out = out.withColumn("_old", F.col("text")).select("*", F.explode_outer(piece).alias("_p"))
    start = F.col("start_ms") / 1000.0 + F.col("_p.s")
    cut = F.col("_n") > 1
    out = out.withColumn("_start", F.when(cut, tc.snap_seconds(start)).otherwise(F.col("start_ms"))).withColumn("_end", F.when(cut & (F.col("_p.i") < F.col("_n") - 1), tc.snap_seconds(start + F.col("_p.d"))).when(cut, tc.snap_ms(F.col("end_ms"))).otherwise(F.col("end_ms")))
    out = out.withColumns({"text": F.when(F.col("_p").isNull(), F.col("text")).otherwise(F.col("_p.t")), "start_ms": F.col("_start"), "end_ms": F.col("_end")})
    if "rule_hints" in cues.columns:
        had = F.coalesce("rule_hints", F.array().cast("array<string>"))
        out = out.withColumn("rule_hints", F.when(F.col("text") == F.col("_old"), had).otherwise(F.array_distinct(F.concat(had, F.array(F.lit("line_limit"))))))
    order = Window.partitionBy("file_id").orderBy("cue_no", F.coalesce("_p.i", F.lit(0)))
    return out.withColumn("_no", F.row_number().over(order)).withColumn("cue_no", F.col("_no")).select(cues.columns)


def regenerate(cues: DataFrame, offset_s: float | Column = 0.0) -> DataFrame:
    """A new timeline: scene paragraphs cut into delivery-sized cues, durations by reading speed, constant gaps. Source times are
    ignored. Starts are prefix sums, so no cue waits for another."""
    pieces = tx.dialogue_chunks(F.coalesce("text", F.lit("")), F.col("max_chars_per_line"), F.col("max_lines"))
    rows = cues.select("*", F.posexplode(tx.let(pieces, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array("text")))).alias("_i", "_t")).withColumn("text", F.col("_t"))
    order = Window.partitionBy("file_id").orderBy("cue_no", "_i")
    rows = rows.withColumns({"_d": F.least(required_seconds(), F.col("max_duration_seconds")), "_g": F.greatest("min_interval_seconds", F.lit(1 / FPS))})
    start = F.coalesce(F.sum(F.col("_d") + F.col("_g")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) + F.greatest(F.lit(0.0), offset_s if isinstance(offset_s, Column) else F.lit(float(offset_s)))
    rows = rows.withColumns({"_s": start, "_no": F.row_number().over(order)})
    rows = rows.withColumns({"start_ms": tc.snap_seconds(F.col("_s")), "end_ms": tc.snap_seconds(F.col("_s") + F.col("_d")), "cue_no": F.col("_no")})
    return rows.select(cues.columns)


def prepare(cues: DataFrame, titles: DataFrame | None = None, regenerate_timings: bool = False, keep_all: bool = False, columns: Collection[str] | None = None) -> DataFrame:
    """Cues joined with platform fields made ready: ends filled, text cleaned, non-dialogue dropped, long cues split, windows
    repaired, the zero subtitle added where a platform wants it, and cues renumbered. titles: (file_id, title) of its first line,
    PROGRAM without. A file that keeps no cue keeps the zero subtitle its platform wants. columns: those that are wanted, all by default.

    Texts are made before the window that fills ends, so a filter on them can't be pushed below it and make them twice. One exchange by
    file serves all windows, one by blocks the repair; nothing is written between."""
    wanted = F.coalesce("zero_subtitle_required", F.lit(False)) if "zero_subtitle_required" in cues.columns else F.lit(False)
    out = wn.fill_ends(wn.with_titles(cues, titles).withColumn("text", tx.delivery_text(F.coalesce("text", F.lit("")))))
    out = out.withColumn("_alone", F.lit(False))
    if not keep_all:
        out = out.withColumn("_spoken", pr.is_dialogue(F.col("text")))
        # the first cue of a file of which no cue stays holds the zero subtitle's place
        held = ~F.max("_spoken").over(Window.partitionBy("file_id")) & (F.row_number().over(wn.ordered()) == 1) & wanted
        out = out.withColumn("_alone", held).filter("_spoken or _alone").drop("_spoken")
        place = {"text": F.lit(""), "start_ms": F.lit(0), "end_ms": F.lit(1000)}
        out = out.withColumns({c: F.when(F.col("_alone"), value).otherwise(F.col(c)) for c, value in place.items()})
    after = F.when(wanted, wn.zero_seconds(out) + F.col("min_interval_seconds")).otherwise(F.lit(0.0))
    out = wn.placeholders(regenerate(out, after) if regenerate_timings else out)
    out = split_long(wn.sorted_by_start(out))
    # repair and what follows it need these; the place in the file is the number, as repair keeps every timed cue
    needed = {"file_id", "start_ms", "end_ms", "text", "min_duration_seconds", "max_duration_seconds", *(cues.columns if columns is None else columns)} - {"cue_no"}
    out = _repaired_in_order(out.filter("start_ms is not null").withColumn("_zero", wanted & wn.lacks_zero()), [c for c in cues.columns if c not in needed])
    return wn.put_zero(out.withColumnRenamed("_order", "cue_no")).select([c for c in cues.columns if columns is None or c in columns])


def insert_cues(cues: DataFrame, edits: DataFrame) -> DataFrame:
    """edits (file_id, target_no, place before|after, text): new cues in the slot beside a target, at most 2 s, cues renumbered."""
    near = wn.neighbours(cues).select("file_id", F.col("cue_no").alias("target_no"), "start_ms", "end_ms", "previous_end_ms", "next_start_ms")
    at = edits.join(near, ["file_id", "target_no"])
    is_after = F.col("place") == "after"
    start = F.when(is_after, F.col("end_ms") + GAP_MS).otherwise(F.greatest(F.coalesce(F.col("previous_end_ms") + GAP_MS, F.lit(0)), F.col("start_ms") - GAP_MS - 2000))
    end = F.when(is_after, F.least(F.coalesce(F.col("next_start_ms") - GAP_MS, F.col("end_ms") + GAP_MS + 2000), F.col("end_ms") + GAP_MS + 2000)).otherwise(F.col("start_ms") - GAP_MS)
    new = at.select("file_id", (F.col("target_no") + F.when(is_after, 0.5).otherwise(-0.5)).alias("_at"), start.cast("bigint").alias("start_ms"), F.greatest(end, start + 40).cast("bigint").alias("end_ms"), "text")
    both = cues.withColumn("_at", F.col("cue_no").cast("double")).unionByName(new, allowMissingColumns=True)
    order = Window.partitionBy("file_id").orderBy("_at")
    return both.withColumn("cue_no", F.row_number().over(order)).drop("_at")


def delete_cues(cues: DataFrame, gone: DataFrame) -> DataFrame:
    """cues without those of gone (file_id, cue_no), renumbered."""
    return cues.join(gone, ["file_id", "cue_no"], "left_anti").withColumn("_no", F.row_number().over(wn.ordered())).withColumn("cue_no", F.col("_no")).drop("_no")


# Why a line was placed by hand.
IN_GAP = "No transcript words matched; placed in surrounding gap — set final timing manually"
FROM_TAIL = "No transcript words matched; reserved a non-overlapping cue — set final timing manually"


def gap_fill(rows: DataFrame, least_ms: int = 1000) -> DataFrame:
    """Lines without times but with text (file_id, cue_no, start_ms, end_ms, text) placed by runs of such lines; off by default in alignment.

    A run is spread evenly over the gap between the lines right before and after it (before the first line lies 0), if each gets
    least_ms. Else each takes least_ms from the tail of the line before, if that keeps least_ms itself. Else it stays. Adds
    align_source, manual_placement and flag_reason, or sets them where lines are placed. A run needs its own neighbours only.
    """
    order, run = wn.ordered(), Window.partitionBy("file_id", "_run")
    missing = F.col("start_ms").isNull() & (F.trim(F.coalesce("text", F.lit(""))) != "")
    out = rows.withColumn("_m", missing).withColumns({"_run": F.sum((~F.col("_m")).cast("int")).over(order), "_follows": F.lead("start_ms").over(order), "_last": ~F.coalesce(F.lead("_m").over(order), F.lit(False))})
    here, before = F.col("_m"), ~F.col("_m")  # the line that opens a run is the one before it
    out = out.withColumns({
        "_n": F.count_if(here).over(run), "_k": F.count_if(here).over(run.orderBy("cue_no").rowsBetween(Window.unboundedPreceding, -1)), "_head": F.count_if(before).over(run) == 0,
        "_from": F.max(F.when(before, F.col("start_ms"))).over(run), "_to": F.max(F.when(before, F.col("end_ms"))).over(run), "_next": F.max(F.when(here & F.col("_last"), F.col("_follows"))).over(run),
    })
    n, begin = F.col("_n"), F.when(F.col("_head"), F.lit(0)).otherwise(F.col("_to"))
    gap = (n > 0) & F.coalesce(F.col("_next") - begin >= n * least_ms, F.lit(False))
    tail = (n > 0) & ~gap & F.coalesce(F.col("_to") - F.col("_from") >= (n + 1) * least_ms, F.lit(False))
    slot, reserved = (F.col("_next") - begin) / n, F.col("_to") - n * least_ms
    place = lambda k: F.when(here & gap, tc.snap_ms(begin + k * slot)).when(here & tail, tc.snap_ms(reserved + k * least_ms))
    placed = here & (gap | tail)
    old = lambda c, kind: F.col(c) if c in rows.columns else F.lit(None).cast(kind)
    out = out.withColumns({
        "_s": F.coalesce(place(F.col("_k")), F.col("start_ms")), "_e": F.coalesce(place(F.col("_k") + 1), F.when(before & tail, tc.snap_ms(reserved)), F.col("end_ms")),
        "align_source": F.when(placed, F.when(gap, "manual_gap").otherwise("manual_split")).otherwise(old("align_source", "string")), "manual_placement": F.when(placed, True).otherwise(F.coalesce(old("manual_placement", "boolean"), F.lit(False))),
        "flag_reason": F.when(placed, F.when(gap, IN_GAP).otherwise(FROM_TAIL)).otherwise(old("flag_reason", "string")),
    })
    out = out.withColumns({"start_ms": F.col("_s"), "end_ms": F.col("_e")})
    return out.drop("_m", "_run", "_follows", "_last", "_n", "_k", "_head", "_from", "_to", "_next", "_s", "_e")
