"""One timeline mapped onto another by anchor pairs (file_id, ref_s, client_s)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.functions import timecode as tc
from cueloom.operators import windows as wn

TOLERANCE = 0.04


def _files(anchors: DataFrame) -> DataFrame:
    """A row a file: `_points`, its anchors in order, and whether they are `not_rising` on both sides. One aggregation, no window."""
    files = anchors.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("ref_s", "client_s"))).alias("_points"))
    bad = F.exists(_pairs(), lambda p: F.coalesce((p["b"]["ref_s"] <= p["a"]["ref_s"]) | (p["b"]["client_s"] <= p["a"]["client_s"]), F.lit(False)))
    return files.withColumns({"n_anchors": F.size("_points").cast("long"), "not_rising": bad})


def _pairs() -> Column:
    """Neighbours a and b of `_points`, numbered from 0."""
    return F.transform(F.slice("_points", F.lit(2), F.size("_points") - 1), lambda b, i: F.struct(F.get("_points", i).alias("a"), b.alias("b"), i.alias("i")))


def rejected(anchors: DataFrame) -> DataFrame:
    """Files with fewer than two anchors, or anchors that don't rise on both sides."""
    return _files(anchors).select("file_id", "n_anchors", "not_rising").filter("n_anchors < 2 or not_rising")


def _paths(anchors: DataFrame) -> DataFrame:
    """(file_id, _segments) of valid files, a row each."""
    valid = _files(anchors).filter("n_anchors >= 2 and not not_rising")

    def segment(p: Column) -> Column:
        a, b = p["a"], p["b"]
        lo, hi = F.when(p["i"] == 0, F.lit(float("-inf"))).otherwise(a["ref_s"]), F.when(p["i"] == F.size("_points") - 2, F.lit(float("inf"))).otherwise(b["ref_s"])
        slope = (b["client_s"] - a["client_s"]) / (b["ref_s"] - a["ref_s"])
        return F.struct(lo.alias("lo_s"), hi.alias("hi_s"), a["ref_s"].alias("ref_s"), a["client_s"].alias("client_s"), slope.alias("slope"))

    return valid.select("file_id", F.transform(F.filter(_pairs(), lambda p: p["b"]["ref_s"].isNotNull()), segment).alias("_segments"))


def segments(anchors: DataFrame) -> DataFrame:
    """(file_id, lo_s, hi_s, ref_s, client_s, slope) of valid files; the first and the last segment are open, so they extrapolate."""
    return _paths(anchors).select("file_id", F.inline("_segments"))


def _along(times: DataFrame, column: str, out: str) -> DataFrame:
    """times with `out`, its column mapped by the row's `_segments`; null without them."""
    t = F.col(column)
    own = F.get(F.filter("_segments", lambda s: (s["lo_s"] <= t) & (t < s["hi_s"])), 0)
    return times.withColumn("_segment", own).withColumn(out, F.col("_segment.client_s") + (t - F.col("_segment.ref_s")) * F.col("_segment.slope")).drop("_segment")


def map_times(times: DataFrame, anchors: DataFrame, column: str, out: str) -> DataFrame:
    """times (file_id, column in seconds) with `out`: a file's segments travel as one array to its rows, so the as-of lookup needs
    an equi join only. Files without valid anchors get null."""
    return _along(times.join(_paths(anchors), "file_id", "left"), column, out).drop("_segments")


def _moved(cues: DataFrame, paths: DataFrame) -> DataFrame:
    """Cues on the client's timeline, on the frame grid, with the other columns of paths: one join serves both times."""
    at = cues.withColumns({"_a": F.col("start_ms") / 1000.0, "_b": F.col("end_ms") / 1000.0}).join(paths, "file_id", "left")
    both = _along(_along(at, "_a", "_s"), "_b", "_e")
    moved = both.withColumns({"start_ms": F.when(F.col("_s").isNotNull(), tc.snap_seconds(F.greatest("_s", F.lit(0.0)))), "end_ms": F.when(F.col("_e").isNotNull(), tc.snap_seconds(F.greatest("_e", F.lit(0.0))))})
    return moved.select(*cues.columns, *(c for c in paths.columns if c not in ("file_id", "_segments")))


def transform_cues(cues: DataFrame, anchors: DataFrame) -> DataFrame:
    """Cues on the client's timeline, on the frame grid."""
    return _moved(cues, _paths(anchors))


def _kinds(paths: DataFrame) -> DataFrame:
    """paths with `kind` and `n_anchors`."""
    slopes = F.transform("_segments", lambda s: s["slope"])
    lo, hi, off = F.array_min(slopes), F.array_max(slopes), F.array_max(F.transform("_segments", lambda s: F.abs(s["client_s"] - s["ref_s"])))
    unit = (F.abs(lo - 1) < TOLERANCE - 1e-12) & (F.abs(hi - 1) < TOLERANCE - 1e-12)
    same = hi - lo < TOLERANCE - 1e-12
    kind = F.when(unit & same & (off < TOLERANCE), "IDENTICAL").when(unit & same, "GLOBAL_OFFSET").when(same, "FPS_TRANSFORM").otherwise("PIECEWISE")
    return paths.withColumns({"kind": kind, "n_anchors": F.size("_segments").cast("long") + 1})


def classify(anchors: DataFrame) -> DataFrame:
    """(file_id, kind, n_anchors): IDENTICAL, GLOBAL_OFFSET, FPS_TRANSFORM or PIECEWISE by slopes within 0.04."""
    return _kinds(_paths(anchors)).select("file_id", "kind", "n_anchors")


def align_to_client(cues: DataFrame, anchors: DataFrame, durations: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Cues mapped, with `warning` a row, and a report a file: mapped, unresolved, mean confidence and warnings.

    durations: (file_id, client_duration_s). Warned are non-positive durations, overlaps and times past the end.
    """
    # a file's kind travels with its segments: anchors are gathered and joined once
    paths = _kinds(_paths(anchors)).select("file_id", "_segments", F.col("kind").alias("_kind"), F.col("n_anchors").alias("_n_anchors"))
    mapped = _moved(cues, paths)
    if durations is not None:
        mapped = mapped.join(durations, "file_id", "left")
    else:
        mapped = mapped.withColumn("client_duration_s", F.lit(None).cast("double"))
    last = F.last("end_ms", ignorenulls=True).over(wn.before())
    warning: Column = F.when(F.col("end_ms") <= F.col("start_ms"), "non-positive duration").when(F.col("start_ms") < last - 1, "overlap").when(F.col("end_ms") / 1000.0 > F.col("client_duration_s"), "exceeds duration")
    rows = mapped.withColumn("warning", warning)
    ok = F.col("start_ms").isNotNull() & (F.col("end_ms") > F.col("start_ms"))
    confidence = F.when(ok, F.when(F.col("warning").isNull(), 1.0).otherwise(0.5))
    report = rows.groupBy("file_id").agg(F.count_if(ok).alias("n_mapped"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("n_unresolved"), (F.sum(F.coalesce(confidence, F.lit(0.0))) / F.greatest(F.lit(1), F.count_if(ok))).alias("confidence"), F.array_sort(F.collect_set("warning")).alias("warnings"), F.min("_kind").alias("kind"), F.min("_n_anchors").alias("n_anchors"))
    return rows.drop("_kind", "_n_anchors"), report
