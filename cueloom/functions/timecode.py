"""Time as columns: text to milliseconds and back, on the 25 fps frame grid.

A cue table stores start_ms and end_ms as BIGINT; the grid is applied in DOUBLE seconds with half-to-even rounding, so that
5.1 s lands on frame 127. Text that is no timecode gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FPS = 25
FRAME_MS = 40

_CLOCK = r"^\s*(\d{1,3}):(\d{1,2}):(\d{1,2})[,.](\d{1,4})\s*$"
_FRAMES = r"^\s*(\d{1,3}):(\d{1,2}):(\d{1,2})[:;](\d{1,2})\s*$"
_DOTTED = r"^\s*(\d{1,2})\.(\d{2})\.(\d{2})(?:\.(\d{2}))?\s*$"
_PLAIN = r"^\s*(\d{1,3}):(\d{1,2}):(\d{1,2})\s*$"
#: The usual form of _CLOCK, of which the digits stand at fixed places.
_FIXED = r"^\d{2}:\d{2}:\d{2}[,.]\d{3}$"
_SHORT = r"^\s*(\d{1,2}):(\d{1,2})[,.](\d{1,3})\s*$"


def _part(tc: Column, pattern: str, i: int) -> Column:
    return F.coalesce(F.regexp_extract(tc, pattern, i).try_cast("long"), F.lit(0))


def _hms(tc: Column, pattern: str) -> Column:
    return (_part(tc, pattern, 1) * 3600 + _part(tc, pattern, 2) * 60 + _part(tc, pattern, 3)) * 1000


def frames_to_ms(frames: Column, fps: float = FPS) -> Column:
    return F.bround(frames * 1000 / fps).cast("long")


def _fixed_ms(tc: Column) -> Column:
    """Milliseconds of a clock in the form of _FIXED, by places; null for other text."""
    bare = F.trim(tc)
    at = lambda k, n=2: F.substring(bare, k, n).try_cast("long")
    return F.when(bare.rlike(_FIXED), (at(1) * 3600 + at(4) * 60 + at(7)) * 1000 + at(10, 3))


def parse_ms(tc: Column) -> Column:
    """Milliseconds of any clock: H:MM:SS,mmm or .mmm, HH:MM:SS:FF or ;FF, HH.MM.SS[.FF], HH:MM:SS, MM:SS.mmm; not snapped."""
    fraction = F.rpad(F.substring(F.regexp_extract(tc, _CLOCK, 4), 1, 3), 3, "0").try_cast("long")
    short = F.rpad(F.regexp_extract(tc, _SHORT, 3), 3, "0").try_cast("long")
    other = (
        F.when(tc.rlike(_CLOCK), _hms(tc, _CLOCK) + fraction)
        .when(tc.rlike(_FRAMES), _hms(tc, _FRAMES) + frames_to_ms(_part(tc, _FRAMES, 4)))
        .when(tc.rlike(_DOTTED), _hms(tc, _DOTTED) + frames_to_ms(_part(tc, _DOTTED, 4)))
        .when(tc.rlike(_PLAIN), _hms(tc, _PLAIN))
        .when(tc.rlike(_SHORT), (_part(tc, _SHORT, 1) * 60 + _part(tc, _SHORT, 2)) * 1000 + short)
    )
    return F.coalesce(_fixed_ms(tc), other)


def snap_seconds(seconds: Column) -> Column:
    """Seconds to the nearest frame, in milliseconds."""
    return (F.bround(seconds.cast("double") * FPS) * FRAME_MS).cast("long")


def snap_ms(ms: Column) -> Column:
    return snap_seconds(ms / F.lit(1000.0))


def to_seconds(tc: Column) -> Column:
    """Seconds of a clock, snapped on reading."""
    return snap_ms(parse_ms(tc)) / F.lit(1000.0)


def _digits(n: Column, size: int) -> Column:
    """A number with zeros in front, of `size` digits at least."""
    text = n.cast("long").cast("string")
    return F.when(F.length(text) < size, F.lpad(text, size, "0")).otherwise(text)


def clock(ms: Column, mark: str = ",") -> Column:
    """HH:MM:SS,mmm of milliseconds, negative ones as 0."""
    t = F.greatest(ms, F.lit(0)).cast("long")
    text = F.concat(_digits(F.floor(t / 3_600_000), 2), F.lit(":"), _digits(F.floor(t / 60_000) % 60, 2), F.lit(":"), _digits(F.floor(t / 1000) % 60, 2), F.lit(mark), _digits(t % 1000, 3))
    return F.when(ms.isNotNull(), text)


def from_seconds(seconds: Column) -> Column:
    """Clock of seconds, snapped on writing."""
    return clock(snap_seconds(seconds))


def normalise(tc: Column) -> Column:
    """HH:MM:SS,mmm of any clock, overflow carried; other text as it is."""
    return F.coalesce(clock(parse_ms(tc)), tc)


def frames_clock(ms: Column) -> Column:
    """HH:MM:SS:FF of milliseconds."""
    t = ms.cast("long")
    return F.format_string("%02d:%02d:%02d:%02d", F.floor(t / 3_600_000), F.floor(t / 60_000) % 60, F.floor(t / 1000) % 60, F.floor(t % 1000 / FRAME_MS))


def qc_seconds(tc: Column) -> Column:
    """Seconds as the checks read them: frames as 1/25 s, fractions as they are, never snapped."""
    t = F.translate(tc, ",;", ".:")
    parts = F.split(t, ":")
    number = lambda i: parts[i].try_cast("double")
    base = number(0) * 3600 + number(1) * 60 + number(2)
    return F.when(F.size(parts) == 4, base + number(3) / FPS).when(F.size(parts) == 3, base)


def footage_frames(text: Column) -> Column:
    """Frames of 35 mm feet.frames (16 frames a foot, frames up to 15); null if it is none."""
    feet, frames = F.regexp_extract(text, r"^\s*(\d+)\.(\d{1,2})\s*$", 1).try_cast("long"), F.regexp_extract(text, r"^\s*(\d+)\.(\d{1,2})\s*$", 2).try_cast("long")
    return F.when(frames <= 15, feet * 16 + frames)


def footage_ms(text: Column) -> Column:
    """Milliseconds of feet.frames at 24 frames a second."""
    return F.bround(footage_frames(text) * 1000 / 24).cast("long")


def footage_clock(text: Column) -> Column:
    """HH:MM:SS:FF of feet.frames, FF counted at 24."""
    n = footage_frames(text)
    s = F.floor(n / 24)
    return F.when(n.isNotNull(), F.format_string("%02d:%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, n % 24))


def ass_ms(tc: Column) -> Column:
    """Milliseconds of H:MM:SS.cc."""
    return parse_ms(F.regexp_replace(tc, r"\.(\d{2})$", ".$10"))


def ass_clock(ms: Column) -> Column:
    """H:MM:SS.cc, hundredths rounded down."""
    t = F.greatest(ms, F.lit(0)).cast("long")
    return F.format_string("%d:%02d:%02d.%02d", F.floor(t / 3_600_000), F.floor(t / 60_000) % 60, F.floor(t / 1000) % 60, F.floor(t % 1000 / 10))


def ttml_ms(tc: Column) -> Column:
    """Milliseconds of a TTML time: a clock with or without fraction, or a number with unit h, m, s, ms or f."""
    number, unit = F.regexp_extract(tc, r"^\s*([\d.]+)(h|m|s|ms|f)\s*$", 1).try_cast("double"), F.regexp_extract(tc, r"^\s*([\d.]+)(h|m|s|ms|f)\s*$", 2)
    scale = F.when(unit == "h", 3_600_000).when(unit == "m", 60_000).when(unit == "s", 1000).when(unit == "ms", 1).when(unit == "f", FRAME_MS)
    return F.coalesce(_fixed_ms(tc), F.bround(number * scale).cast("long"), parse_ms(tc))


def offset_ms(text: Column) -> Column:
    """Signed milliseconds of an offset: seconds with or without `s`, or a clock; null if it is none."""
    bare = F.trim(F.regexp_replace(F.trim(text), r"^[+-]\s*", ""))
    seconds = F.regexp_replace(bare, r"(?i)\s*s(ec(onds?)?)?$", "").try_cast("double")
    size = F.coalesce(F.bround(seconds * 1000).cast("long"), parse_ms(bare))
    return F.when(F.trim(text).startswith("-"), -size).otherwise(size)


def fps_factor(working: Column, target: Column) -> Column:
    """Factor of a frame-rate conversion; null unless both are above zero."""
    return F.when((working > 0) & (target > 0), working / target)


def duration_factor(working: Column, target: Column) -> Column:
    """Factor that stretches a working duration to a target one; durations as clocks, MM:SS or seconds."""
    def seconds(t: Column) -> Column:
        two = F.split(t, ":")
        return F.when(F.size(two) == 2, two[0].try_cast("double") * 60 + two[1].try_cast("double")).otherwise(F.coalesce(parse_ms(t) / 1000.0, t.try_cast("double")))

    w, t = seconds(working), seconds(target)
    return F.when((w > 0) & (t > 0), t / w)
