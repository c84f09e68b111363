"""Checks and repairs that need the cue before, on streams: cues wait in a file's state until the watermark says that no earlier
one can come, are taken in order, and what the next one needs is carried on. State goes after a file has been silent."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cueloom.operators import qc, timing

#: Silence in event time after which a file's state is removed.
SILENT_MS = 3_600_000


def _in_order(cues: DataFrame, at: str, late: str, carry: Callable[[list[dict], float], tuple[list[tuple], float]], schema: str | T.StructType) -> DataFrame:
    """The rows that carry gives for a file's cues in order of event time and cue_no. carry takes released cues and what the last call
    left (below 0 at first) and gives rows and what to keep. Cues that come later than `late` are left out."""
    names = cues.columns
    kinds = schema.fieldNames() if isinstance(schema, T.StructType) else [c.strip().split(" ")[0] for c in schema.split(",")]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held = state.get if state.exists else (-1.0, None)
        rows = pickle.loads(held) if held else []
        if not state.hasTimedOut:
            for frame in frames:
                rows += frame.astype(object).where(frame.notna(), None).to_dict("records")
        mark = state.getCurrentWatermarkMs()
        ready = sorted((r for r in rows if r["_at"] <= mark), key=lambda r: (r["_at"], r["cue_no"]))
        rest = [r for r in rows if r["_at"] > mark]
        if ready:
            out, last = carry(ready, last)
            yield pd.DataFrame(out, columns=kinds)
        elif not rest and state.hasTimedOut:
            state.remove()
            return
        state.update((last, pickle.dumps(rest)))
        state.setTimeoutTimestamp(max(mark + 1, min(r["_at"] for r in rest)) if rest else mark + SILENT_MS)

    timed = cues.filter(F.col(at).isNotNull()).withWatermark(at, late).select(*names, F.unix_millis(at).alias("_at"))
    return timed.groupBy("file_id").applyInPandasWithState(step, schema, "last double, held binary", "append", GroupStateTimeout.EventTimeTimeout)


def gap_defects(cues: DataFrame, at: str = "ts", late: str = "10 minutes", fps: float = 25.0) -> DataFrame:
    """qc.gap_defects of a stream of cues (file_id, cue_no, start_ms, end_ms, ts)."""

    def carry(rows: list[dict], last: float) -> tuple[list[tuple], float]:
        out = []
        for r in rows:
            timed = r["start_ms"] is not None and r["end_ms"] is not None
            if timed and last >= 0:
                out.append((r["file_id"], r["cue_no"], round((r["start_ms"] - last) / 1000.0 * fps)))
            last = float(r["end_ms"]) if timed else -1.0
        return out, last

    kind = cues.schema["file_id"].dataType.simpleString()
    gaps = _in_order(cues.select("file_id", "cue_no", "start_ms", "end_ms", at), at, late, carry, f"file_id {kind}, cue_no int, gap int")
    return qc.gap_rows(gaps, "gap")


def repair_windows(cues: DataFrame, at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """timing.repair_windows of a stream of cues joined with platform fields: (file_id, cue_no, start_ms, end_ms); untimed cues are dropped."""

    def carry(rows: list[dict], last: float) -> tuple[list[tuple], float]:
        out = []
        for r in rows:
            start, end = timing.repaired(last, r["start_ms"], r["end_ms"], r["_gap"], r["_need"], r["min_duration_seconds"], r["max_duration_seconds"])
            last = end / 1000
            out.append((r["file_id"], r["cue_no"], start, end))
        return out, last

    needed = cues.filter("start_ms is not null").select("file_id", "cue_no", "start_ms", "end_ms", timing.gap_frames().alias("_gap"), timing.required_seconds().alias("_need"), "min_duration_seconds", "max_duration_seconds", at)
    kind = cues.schema["file_id"].dataType.simpleString()
    return _in_order(needed, at, late, carry, f"file_id {kind}, cue_no int, start_ms bigint, end_ms bigint")
