"""Re-timing. Every operator takes cues and a table of parameters keyed by file_id, so that one job re-times a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions import timecode as tc
from cueloom.operators import windows as wn


def _set(cues: DataFrame, start: Column, end: Column, columns: list[str]) -> DataFrame:
    return cues.withColumns({"_s": tc.snap_ms(F.greatest(F.lit(0), start)), "_e": tc.snap_ms(F.greatest(F.lit(0), end))}).withColumns({"start_ms": F.col("_s"), "end_ms": F.col("_e")}).select(columns)


def _within() -> Column:
    """Whether cue_no lies in the parameters' from_no to to_no; an open side is null."""
    return (F.col("from_no").isNull() | (F.col("cue_no") >= F.col("from_no"))) & (F.col("to_no").isNull() | (F.col("cue_no") <= F.col("to_no")))


def _mapped(cues: DataFrame, params: DataFrame, f) -> DataFrame:
    """f of start and end, where f gives a value."""
    joined = cues.join(params, "file_id", "left")
    s, e = F.col("start_ms"), F.col("end_ms")
    return _set(joined, F.coalesce(f(s), s), F.coalesce(f(e), e), cues.columns)


def offset(cues: DataFrame, params: DataFrame) -> DataFrame:
    """params (file_id, offset_ms, from_no, to_no): times moved, not below 0."""
    return _mapped(cues, params, lambda t: F.when(_within(), t + F.col("offset_ms")))


def scale(cues: DataFrame, params: DataFrame) -> DataFrame:
    """params (file_id, factor, from_no, to_no): times multiplied; a factor of 0 or less does nothing."""
    return _mapped(cues, params, lambda t: F.when(_within() & (F.col("factor") > 0), t * F.col("factor")))


def two_point(cues: DataFrame, params: DataFrame) -> DataFrame:
    """params (file_id, source_a, target_a, source_b, target_b) in ms: the line through both; an offset if b is missing or equal."""
    a, b = F.col("source_a"), F.col("source_b")
    factor = F.when(b.isNotNull() & F.col("target_b").isNotNull() & (b != a), (F.col("target_b") - F.col("target_a")) / (b - a)).otherwise(F.lit(1.0))
    return _mapped(cues, params, lambda t: F.col("target_a") + (t - a) * factor)


def point(cues: DataFrame, params: DataFrame) -> DataFrame:
    """params (file_id, anchor_no, target_ms): all times moved so that the anchor cue starts at target_ms."""
    at = cues.select("file_id", F.col("cue_no").alias("anchor_no"), F.col("start_ms").alias("_at"))
    moved = params.join(at, ["file_id", "anchor_no"]).select("file_id", (F.col("target_ms") - F.col("_at")).alias("offset_ms"), F.lit(None).cast("int").alias("from_no"), F.lit(None).cast("int").alias("to_no"))
    return offset(cues, moved)


def via_other(cues: DataFrame, other: DataFrame, params: DataFrame) -> DataFrame:
    """params (file_id, other_id, main_a, other_a, main_b, other_b), cue indices from 0: times mapped to those of another file's cues."""
    index = lambda d, f, i, t: d.select(F.col("file_id").alias(f), (F.col("cue_no") - 1).alias(i), F.col("start_ms").alias(t))
    p = params
    for side in ("a", "b"):
        p = p.join(index(cues, "file_id", f"main_{side}", f"source_{side}"), ["file_id", f"main_{side}"], "left").join(index(other, "other_id", f"other_{side}", f"target_{side}"), ["other_id", f"other_{side}"], "left")
    return two_point(cues, p.select("file_id", "source_a", "target_a", "source_b", "target_b").filter("source_a is not null and target_a is not null"))


def set_start(cues: DataFrame, params: DataFrame) -> DataFrame:
    """params (file_id, target_ms): all times moved so that the first timed cue starts there."""
    first = cues.filter("start_ms is not null").groupBy("file_id").agg(F.min_by("start_ms", "cue_no").alias("_first"))
    moved = params.join(first, "file_id").select("file_id", (F.col("target_ms") - F.col("_first")).alias("offset_ms"), F.lit(None).cast("int").alias("from_no"), F.lit(None).cast("int").alias("to_no"))
    return offset(cues, moved)


def _deltas(cues: DataFrame, params: DataFrame) -> DataFrame:
    """params (file_id, cue_no, new_start_ms, new_end_ms) with the change of start, or of the end if only that is given."""
    at = cues.select("file_id", "cue_no", F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"))
    joined = params.join(at, ["file_id", "cue_no"]).withColumnRenamed("cue_no", "target_no")
    return joined.withColumn("delta", F.coalesce(F.col("new_start_ms") - F.col("_s"), F.col("new_end_ms") - F.col("_e")))


def fix_from(cues: DataFrame, params: DataFrame, ripple: bool = True) -> DataFrame:
    """params (file_id, cue_no, new_start_ms, new_end_ms): one cue set, and all that follow moved by as much."""
    d = _deltas(cues, params).select("file_id", "target_no", "new_start_ms", "new_end_ms", "delta")
    joined = cues.join(d, "file_id", "left")
    here, later = F.col("cue_no") == F.col("target_no"), F.lit(ripple) & (F.col("cue_no") > F.col("target_no"))
    s, e = F.col("start_ms"), F.col("end_ms")
    start = F.when(here, F.coalesce("new_start_ms", s)).when(later, s + F.col("delta")).otherwise(s)
    end = F.when(here, F.coalesce("new_end_ms", e + F.col("delta"))).when(later, e + F.col("delta")).otherwise(e)
    return _set(joined, start, end, cues.columns)


def fix_range(cues: DataFrame, params: DataFrame) -> tuple[DataFrame, DataFrame]:
    """params (file_id, cue_no, new_start_ms, new_end_ms, from_no, to_no): as fix_from within a range of ids. Also a report a file:
    touched ids, and a warning if the range doesn't hold the cue."""
    d = _deltas(cues, params).select("file_id", "target_no", "new_start_ms", "new_end_ms", "delta", "from_no", "to_no")
    joined = cues.join(d, "file_id", "left")
    here, inside = F.col("cue_no") == F.col("target_no"), F.coalesce(_within() & (F.col("cue_no") > F.col("target_no")) & F.col("delta").isNotNull(), F.lit(False))
    s, e = F.col("start_ms"), F.col("end_ms")
    start = F.when(here, F.coalesce("new_start_ms", s)).when(inside, s + F.col("delta")).otherwise(s)
    end = F.when(here, F.coalesce("new_end_ms", e + F.col("delta"))).when(inside, e + F.col("delta")).otherwise(e)
    touched = F.sort_array(F.collect_list(F.when(here | inside, F.col("cue_no"))))
    outside = F.max(F.when(here & ~_within(), F.lit("target lies outside the range")))
    return _set(joined, start, end, cues.columns), joined.filter("target_no is not null").groupBy("file_id").agg(touched.alias("touched"), outside.alias("warning"))


def collisions(cues: DataFrame, params: DataFrame, gap_ms: int = 80) -> DataFrame:
    """Cues that only-this edits (file_id, cue_no, new_start_ms, new_end_ms) would bring closer than gap_ms to a timed neighbour."""
    near = wn.neighbours(cues).select("file_id", "cue_no", "start_ms", "end_ms", "previous_no", "previous_end_ms", "next_no", "next_start_ms")
    at = params.join(near, ["file_id", "cue_no"])
    start, end = F.coalesce("new_start_ms", "start_ms"), F.coalesce("new_end_ms", "end_ms")
    hit_before, hit_after = start < F.col("previous_end_ms") + gap_ms, end > F.col("next_start_ms") - gap_ms
    return at.select("file_id", "cue_no", F.when(hit_before, F.col("previous_no")).alias("hits_previous"), F.when(hit_after, F.col("next_no")).alias("hits_next")).filter("hits_previous is not null or hits_next is not null")


def only_this(cues: DataFrame, params: DataFrame) -> DataFrame:
    """One cue set; collisions, if any, are reported by `collisions` and the edit is made all the same."""
    return fix_from(cues, params, ripple=False)


def sync_target(cues: DataFrame, params: DataFrame, ripple: bool = True) -> DataFrame:
    """Start, end or both of a target cue set, with or without moving what follows."""
    return fix_from(cues, params, ripple)


def stretch(cues: DataFrame, params: DataFrame) -> DataFrame:
    """params (file_id, program_start, program_end, client_start, client_end) in ms: cs + (t - ps) * (ce - cs) / (pe - ps)."""
    ps, pe, cs, ce = (F.col(c) for c in ("program_start", "program_end", "client_start", "client_end"))
    return _mapped(cues, params, lambda t: F.when(pe != ps, cs + (t - ps) * ((ce - cs) / (pe - ps))))


#: Parameters of `dispatch` beside file_id and mode; a column that a table of parameters lacks counts as null.
PARAMETERS = (
    "offset_ms bigint, factor double, from_no int, to_no int, target_no int, new_start_ms bigint, new_end_ms bigint, shift_mode string, range_end_no int, anchor_no int, anchor_ms bigint, anchor_no2 int, anchor_ms2 bigint, "
    "source_a bigint, target_a bigint, source_b bigint, target_b bigint, program_start bigint, program_end bigint, client_start bigint, client_end bigint, other_id bigint, main_a int, other_a int, main_b int, other_b int"
)
TARGET_MODES = ("shift_only_this", "fix_from_index", "fix_range", "sync_target")


def dispatch(cues: DataFrame, params: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """Every file re-timed in the mode of its row of params (see PARAMETERS), all files in one pass; others stay as they are.

    offset, scale: within from_no to to_no. visual: moved so that the anchor starts at anchor_ms, or along the line through two
    anchors, within the range. two_point, stretch: along a line. shift_only_this: a cue set; sync_target too, by start, end or
    both, and with shift_mode `all` what follows moves along. fix_from_index: a cue moved with all that follow; fix_range: with
    those up to range_end_no. point_via_other: cues (from 0) main_a and main_b brought to cues other_a and other_b of file other_id
    in `other` (else in cues). Any other mode counts as offset. Where a cue or value that a mode needs is missing, nothing moves.
    """
    kinds = [c.strip().split(" ") for c in PARAMETERS.split(",")]
    p = params.select("file_id", F.coalesce("mode", F.lit("offset")).alias("mode"), *((F.col(c) if c in params.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds))
    at = (cues if other is None else other).select(F.col("file_id").alias("other_id"), (F.col("cue_no") - 1).alias("_at"), F.col("start_ms").alias("_t"))
    asked = p.filter("mode = 'point_via_other' and other_id is not null").select("file_id", "other_id", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("other_a").alias("at")), F.struct(F.lit("b").alias("side"), F.col("other_b").alias("at")))).alias("w"))
    met = asked.join(at, (asked.other_id == at.other_id) & (F.col("w.at") == at["_at"])).groupBy("file_id").agg(F.max(F.when(F.col("w.side") == "a", F.col("_t"))).alias("_ref_a"), F.max(F.when(F.col("w.side") == "b", F.col("_t"))).alias("_ref_b"))
    file, s, e, no = Window.partitionBy("file_id"), F.col("start_ms"), F.col("end_ms"), F.col("cue_no")
    old = lambda number, time: F.max(F.when(no == number, time)).over(file)
    rows = cues.join(p.join(met, "file_id", "left"), "file_id", "left").withColumns({
        "_old_s": old(F.col("target_no"), s), "_old_e": old(F.col("target_no"), e), "_a": old(F.col("anchor_no"), s), "_b": old(F.col("anchor_no2"), s), "_main_a": old(F.col("main_a") + 1, s), "_main_b": old(F.col("main_b") + 1, s),
    })
    mode = F.col("mode")

    def line(t: Column, a: Column, to_a: Column, b: Column, to_b: Column) -> Column:
        """t along the line through both points, moved by the first alone if the second is missing or the same."""
        return F.when(b.isNotNull() & to_b.isNotNull() & (b != a), to_a + (t - a) * ((to_b - to_a) / (b - a))).otherwise(t + (to_a - a))

    def moved(t: Column) -> Column:
        c = F.col
        return (
            F.when((mode == "scale") & _within() & (c("factor") > 0), t * c("factor"))
            .when((mode == "visual") & _within(), line(t, c("_a"), c("anchor_ms"), c("_b"), c("anchor_ms2")))
            .when(mode == "two_point", line(t, c("source_a"), c("target_a"), c("source_b"), c("target_b")))
            .when((mode == "stretch") & (c("program_end") != c("program_start")), c("client_start") + (t - c("program_start")) * ((c("client_end") - c("client_start")) / (c("program_end") - c("program_start"))))
            .when(mode == "point_via_other", line(t, c("_main_a"), c("_ref_a"), c("_main_b"), c("_ref_b")))
            .when(~mode.isin("scale", "visual", "two_point", "stretch", "point_via_other", *TARGET_MODES) & _within(), t + c("offset_ms"))
        )

    target, new_s, new_e = mode.isin(*TARGET_MODES), F.col("new_start_ms"), F.col("new_end_ms")
    whole = (mode != "shift_only_this") | (new_e > new_s)  # both, and in order
    here = target & whole & (no == F.col("target_no"))
    delta = F.coalesce(new_s - F.col("_old_s"), F.when(mode == "sync_target", new_e - F.col("_old_e")))
    follows = (mode == "fix_from_index") | ((mode == "fix_range") & (no <= F.col("range_end_no"))) | ((mode == "sync_target") & (F.coalesce("shift_mode", F.lit("all")) == "all"))
    later = target & follows & (no > F.col("target_no")) & delta.isNotNull()
    end_too = mode.isin("shift_only_this", "sync_target")
    start = F.when(here, F.coalesce(new_s, s + delta)).when(later, s + delta).otherwise(moved(s))
    end = F.when(here, F.coalesce(F.when(end_too, new_e), e + delta)).when(later, e + delta).otherwise(moved(e))
    return _set(rows, F.coalesce(start, s), F.coalesce(end, e), cues.columns)
