"""Explainable edits: hints from real before/after comparisons, labels, reports and word diffs."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom import shared
from cueloom.functions import text as tx

# Hint keys, their description, and phrases that a justifying rule holds; labels of changes that no hint names; patterns.
HINTS = (
    ("hoh_removed", "HOH/EMT accessibility element removed", ("hoh", "emt")),
    ("stage_removed", "Stage direction / non-dialogue parenthetical removed", ("stage direction",)),
    ("char_name_removed", "Character name / speaker label removed", ("character", "speaker")),
    ("filler_removed", "Filler word removed", ("filler",)),
    ("profanity_replaced", "Profanity replaced per platform table", ("profanity", "xxx", "bleep")),
    ("profanity_asterisk", "Beeped profanity replaced with asterisks (****)", ("asterisk", "bleep", "profanity")),
    ("double_space", "Double space removed", ("double space",)),
    ("space_before_punct", "Space before punctuation removed", ("space before punctuation", "no space", "punctuation")),
    ("double_punct", "Double / mixed punctuation normalised", ("double punctuation", "avoid double", "!?")),
    ("ellipsis", "Ellipsis normalised to three dots", ("ellipsis", "three dots")),
    ("ellipsis_start", "Leading-ellipsis space removed", ("ellipsis without space",)),
    ("two_speaker_hyphen", "Two-speaker hyphen format applied", ("two speaker", "hyphen")),
    ("quotation_marks", "Apostrophes converted to quotation marks", ("quotation", "speech mark", "double")),
    ("symbols_stripped", "Forbidden symbols stripped (& < > ° ©)", ("degree", "copyright", "symbol")),
    ("acronym_dots", "Acronym periods removed (F.B.I. -> FBI)", ("no periods for acronyms", "acronym")),
    ("song_lyric_case", "Song lyric line capitalised", ("song", "upper case")),
    ("song_line_punct", "Trailing punctuation removed from song line", ("song", "punctuation")),
    ("story_lang_caps", "STORY:/LANG: capitalised", ("story and lang", "story:", "lang:")),
    ("interruption_double_hyphen", "Em-dash converted to double hyphen (--)", ("double hyphen", "interrupted")),
    ("capitalize", "First letter capitalised (sentence case)", ("sentence case", "capital")),
    ("number_to_word", "Number(s) converted to words", ("in words", "spell out", "1-10", "0-9", "1-9")),
    ("us_spelling", "British -> US English spelling normalised", ("us english", "american", "spelling")),
    ("line_limit", "Line split to fit character / line limit", ("maximum", "characters per line", "lines per subtitle")),
    ("zero_subtitle", "Zero subtitle (programme info) auto-injected at 00:00:00", ("zero subtitle", "story:", "lang:")),
    ("italics_added", "Italics added (song / VO / phone / foreign word)", ("italic",)),
    ("italics_removed", "Italics removed (platform does not allow italics)", ("no italic", "no text style", "italic")),
)
WIPED, WIPED_PHRASES = "Entire subtitle removed (HOH/EMT element or filler)", ("hoh", "emt", "stage direction", "filler")
FALLBACK = "Verified edit: dialogue text corrected during cleaning - please review this change against your platform guidelines before delivery."
COMPARED_UK = (
    ("colour", "color"), ("favourite", "favorite"), ("neighbour", "neighbor"), ("realise", "realize"), ("recognise", "recognize"), ("centre", "center"), ("theatre", "theater"), ("programme", "program"),
    ("travelling", "traveling"), ("cancelled", "canceled"), ("defence", "defense"), ("licence", "license"), ("humour", "humor"), ("behaviour", "behavior"), ("flavour", "flavor"), ("honour", "honor"), ("labour", "labor"),
)
BRACKET = r"\[[^\n]*?\]|\([^\n]*?\)"
SOUND = r"(?i)\[|\]|music|applause|laughter|cheering|singing|sound|gunshot|explosion"
LABEL = r"^[A-Z][A-Z0-9 '/().]{1,40}[:\-]\s*"
INLINE_LABEL = r"^[A-Z]{2,30}(?:\s+[A-Z0-9]{1,30}){0,3}\s+(?=[A-Z][a-z])"
FILLER = r"(?iU)\b(?:uh|hmm+|erm|er|um)\b"
DIGIT = r"(?<!\d)\b(?:[0-9]|10)\b(?!\d)"
BROADCAST_BYTES = 8 << 20


def hint_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, k, d, list(p)) for i, (k, d, p) in enumerate(HINTS)], "hint_no int, hint string, description string, phrases array<string>")


def removed_brackets(old: Column, new: Column) -> Column:
    """Brackets of old that new lacks, if new has fewer; else an empty array."""
    a, b = (F.regexp_extract_all(x, F.lit(BRACKET), F.lit(0)) for x in (old, new))
    return F.when((old.contains("(") | old.contains("[")) & (F.size(b) < F.size(a)), F.array_except(a, b)).otherwise(F.array().cast("array<string>"))


def derive_hints(old: Column, new: Column, most: Column) -> Column:
    """array<string> of hint keys that the change from old to new shows; empty if nothing changed."""
    had = lambda p: old.rlike(p) & ~new.rlike(p)
    plain = lambda t: F.when(t.contains("<"), tx.strip_tags(t)).otherwise(t)
    plain_old, plain_new = plain(old), plain(new)
    lead = lambda t: F.regexp_replace(F.trim(t), r"^(?:</?[ib]>|-|\s)+", "")
    gone = removed_brackets(old, new)
    hyphens = (old.rlike(r"(?m)^- \S") & new.rlike(r"(?m)^-\S")) | (old.rlike(r"(?m)^-\S") & new.rlike(r"(?m)^- \S")) | (F.ltrim(new).startswith("-") & ~F.ltrim(old).startswith("-")) | (new.contains("\n-") & ~old.contains("\n-"))
    words = F.arrays_overlap(F.split(F.lower(new), r"\s+"), F.array(*[F.lit(w) for w in tx.NUMBER_WORDS.values()]))
    fillers = lambda t: F.regexp_count(t, F.lit(FILLER))
    long = F.exists(F.split(plain_old, "\n"), lambda x: (F.length(x) > most) & ~plain_new.contains(F.trim(x)))
    sound = F.exists(gone, lambda b: b.rlike(SOUND))
    tests = [
        ("hoh_removed", ((F.size(gone) > 0) & sound) | ((F.trim(plain_old) != "") & (F.trim(plain_new) == ""))), ("stage_removed", (F.size(gone) > 0) & ~sound), ("char_name_removed", had(LABEL)), ("filler_removed", fillers(new) < fillers(old)),
        ("profanity_replaced", ~F.lower(old).rlike(r"\b[a-z]xxx\w*\b") & F.lower(new).rlike(r"\b[a-z]xxx\w*\b")), ("profanity_asterisk", F.regexp_count(new, F.lit(r"\*{4}")) > F.regexp_count(old, F.lit(r"\*{3}"))),
        ("double_space", old.contains("  ") & ~new.contains("  ")), ("space_before_punct", had(r" [.,!?;:]")), ("double_punct", had(r"[!?]{2,}")), ("ellipsis", had(r"\.{4,}")), ("two_speaker_hyphen", hyphens),
        ("interruption_double_hyphen", old.contains("—") & new.contains("--") & ~new.contains("—")), ("number_to_word", had(DIGIT) & words), ("us_spelling", had(tx.ANY_UK)),
        ("capitalize", lead(plain_old).rlike(r"^\p{Ll}") & lead(plain_new).rlike(r"^\p{Lu}")), ("acronym_dots", had(r"\b[A-Z]\.[A-Z]\.")), ("italics_added", new.contains("<i>") & ~old.contains("<i>")), ("italics_removed", old.contains("<i>") & ~new.contains("<i>")), ("line_limit", long | (new.contains("\n") & ~old.contains("\n"))),
    ]
    found = F.array_compact(F.array(*[F.when(test, F.lit(key)) for key, test in tests]))
    return F.when((F.coalesce(old, F.lit("")) == "") | (old == new), F.array().cast("array<string>")).otherwise(found)


def with_hints(cues: DataFrame, most: str = "max_chars_per_line") -> DataFrame:
    """Cues (original_text, text) with rule_hints, earlier ones first."""
    derived = derive_hints(F.col("original_text"), F.col("text"), F.col(most))
    had = F.coalesce("rule_hints", F.array().cast("array<string>")) if "rule_hints" in cues.columns else F.array().cast("array<string>")
    return cues.withColumn("rule_hints", F.array_distinct(F.concat(had, F.coalesce(derived, F.array().cast("array<string>")))))


def justified(rules: DataFrame) -> DataFrame:
    """(platform_key, rule_no, rule) to (platform_key, hint, label): the first rule that holds one of a hint's phrases, or the description."""
    hints = hint_table(rules.sparkSession)
    keys = rules.select("platform_key").distinct().crossJoin(F.broadcast(hints))  # platforms x 26 hints
    held = rules.join(F.broadcast(hints.select("hint", F.explode("phrases").alias("phrase"))), F.lower("rule").contains(F.col("phrase")))
    first = held.groupBy("platform_key", "hint").agg(F.min_by("rule", "rule_no").alias("rule"))
    return keys.join(first, ["platform_key", "hint"], "left").select("platform_key", "hint", F.coalesce(F.concat(F.lit("Rule: "), F.col("rule")), F.concat(F.lit("Verified edit: "), F.col("description"))).alias("label"))


def longest_keyword_rule(rules: DataFrame, keywords: DataFrame) -> DataFrame:
    """(platform_key, key, rule): for each key the rule that holds its longest keyword. keywords: (key, keyword)."""
    held = rules.join(F.broadcast(keywords), F.lower("rule").contains(F.lower("keyword")))
    return held.groupBy("platform_key", "key").agg(F.max_by("rule", F.struct(F.length("keyword"), -F.col("rule_no"))).alias("rule"))


def compared(old: Column, new: Column) -> Column:
    """array<string> of hint keys that a comparison of both texts proves, in order of the tests; WIPED where nothing is left."""
    had = lambda p: old.rlike(p) & ~new.rlike(p)
    plain_old, plain_new = tx.strip_tags(old), tx.strip_tags(new)
    lead = lambda t: F.regexp_replace(F.trim(t), r"^(?:</?[ib]>|-|\s)+", "")
    gone = removed_brackets(old, new)
    n_brackets = lambda t: F.regexp_count(t, F.lit(BRACKET))
    fewer = n_brackets(new) < n_brackets(old)
    sound = F.exists(gone, lambda b: b.rlike(SOUND))
    italic = lambda t: t.contains("<i>") | t.contains("</i>")
    spaced, close = r"(?:^|\n)- \S", r"(?:^|\n)-\S"
    hyphens = (old.rlike(spaced) & new.rlike(close)) | (old.rlike(close) & new.rlike(spaced)) | (F.ltrim(new).startswith("-") & ~F.ltrim(old).startswith("-")) | (new.contains("\n-") & ~old.contains("\n-"))
    count = lambda t, mark: F.regexp_count(t, F.lit(mark))
    profane = r"\b[a-z]xxx\w*\b"
    number = F.arrays_overlap(F.split(F.lower(new), r"\s+"), F.array(*[F.lit(w) for w in ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")]))
    british = F.exists(F.array(*[F.struct(F.lit(u).alias("u"), F.lit(a).alias("a")) for u, a in COMPARED_UK]), lambda w: F.contains(F.lower(old), w["u"]) & F.contains(F.lower(new), w["a"]) & ~F.contains(F.lower(new), w["u"]))
    tests = [
        ("line_limit", new.contains("\n") & ~old.contains("\n")), ("hoh_removed", fewer & sound), ("stage_removed", fewer & ~sound), ("italics_added", italic(new) & ~old.contains("<i>")), ("italics_removed", italic(old) & ~new.contains("<i>")),
        ("two_speaker_hyphen", hyphens), ("interruption_double_hyphen", old.contains("—") & new.contains("--") & ~new.contains("—")), ("profanity_asterisk", count(new, r"\*{4}") > count(old, r"\*{3}")),
        ("profanity_replaced", F.lower(new).rlike(profane) & ~F.lower(old).rlike(profane)), ("number_to_word", had(DIGIT) & number), ("filler_removed", count(new, FILLER) < count(old, FILLER)),
        ("char_name_removed", had(LABEL) | (F.trim(old).rlike(INLINE_LABEL) & ~F.trim(new).rlike(INLINE_LABEL))), ("us_spelling", british), ("double_space", old.contains("  ") & ~new.contains("  ")),
        ("double_punct", had(r"[!?]{2,}")), ("space_before_punct", had(r" [.,!?;:]")), ("ellipsis", had(r"\.{4,}")), ("capitalize", lead(plain_old).rlike(r"^\p{Ll}") & lead(plain_new).rlike(r"^\p{Lu}")),
        ("acronym_dots", had(r"\b[A-Z]\.[A-Z]\.")), (WIPED, (F.trim(plain_old) != "") & (F.trim(plain_new) == "")),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(key)) for key, test in tests]))


def change_labels(cues: DataFrame, rules: DataFrame) -> DataFrame:
    """Changed cues (platform_key, original_text, text, rule_hints) with labels: of the hints, then of the before/after tests, each the
    platform's rule that justifies it or its description; where nothing names the change, the honest fallback.

    cues should be a written table: the filter for changes is else pushed through what made them.
    """
    wiped = rules.sparkSession.createDataFrame([(WIPED, p) for p in WIPED_PHRASES], "key string, keyword string")
    worded = longest_keyword_rule(rules, wiped).select("platform_key", F.col("key").alias("hint"), F.concat(F.lit("Rule: "), F.col("rule")).alias("label"))
    labels = justified(rules).unionByName(worded).groupBy("platform_key").agg(F.map_from_entries(F.collect_list(F.struct("hint", "label"))).alias("_labels"))
    labels = shared.written(labels, "labels")  # a row a platform
    size = labels.agg(F.sum(F.length(F.to_json("_labels")))).head()[0] or 0
    changed = cues.filter("original_text <> text").join(F.broadcast(labels) if size < BROADCAST_BYTES else labels, "platform_key", "left")
    described = F.create_map(*[x for k, d in [*((k, d) for k, d, _ in HINTS), (WIPED, WIPED)] for x in (F.lit(k), F.lit(f"Verified edit: {d}"))])
    shown = F.concat(F.coalesce("rule_hints", F.array().cast("array<string>")), compared(F.col("original_text"), F.col("text")))
    named = F.array_distinct(F.array_compact(F.transform(shown, lambda h: F.coalesce(F.try_element_at("_labels", h), F.try_element_at(described, h)))))
    return changed.withColumn("_named", named).withColumn("labels", F.when(F.coalesce(F.size("_named"), F.lit(0)) > 0, F.col("_named")).otherwise(F.array(F.lit(FALLBACK)))).drop("_labels", "_named")


def track_changes(cues: DataFrame) -> DataFrame:
    """One row a file and original text: ids, distinct new texts in order, hints in order, flag and first reason."""
    hints = F.coalesce("rule_hints", F.array().cast("array<string>"))
    rows = F.array_sort(F.collect_list(F.struct("cue_no", "text", hints.alias("hints"), F.col("flag_reason"))))
    grouped = cues.groupBy("file_id", "original_text").agg(rows.alias("r"), F.max(F.coalesce("flagged", F.lit(False))).alias("flagged"), F.min("cue_no").alias("first_no"))
    return grouped.select(
        "file_id", "first_no", "original_text", F.transform("r", lambda x: x["cue_no"]).alias("ids"), F.array_distinct(F.transform("r", lambda x: x["text"])).alias("new_texts"),
        F.array_distinct(F.flatten(F.transform("r", lambda x: x["hints"]))).alias("rule_hints"), "flagged", F.get(F.filter(F.transform("r", lambda x: x["flag_reason"]), lambda x: F.coalesce(x, F.lit("")) != ""), 0).alias("flag_reason"),
    )


def change_totals(report: DataFrame) -> DataFrame:
    """Changed and unchanged cues of each file, counted in ids."""
    changed = ~((F.size("new_texts") == 1) & (F.col("new_texts")[0] == F.col("original_text")))
    return report.groupBy("file_id").agg(F.sum(F.when(changed, F.size("ids")).otherwise(0)).alias("n_changed"), F.sum(F.when(changed, 0).otherwise(F.size("ids"))).alias("n_unchanged"))


def cleaning_stats(cues: DataFrame) -> DataFrame:
    changed = F.trim(F.coalesce("original_text", F.lit(""))) != F.trim(F.coalesce("text", F.lit("")))
    return cues.groupBy("file_id").agg(F.count("*").alias("total"), F.count_if(F.coalesce("flagged", F.lit(False))).alias("n_flagged"), F.count_if(changed).alias("n_changed"))


def unproved(report: DataFrame, rules: DataFrame) -> DataFrame:
    """Labels of a report (platform_key, labels) that quote a rule which the platform doesn't have: none in a sound report."""
    quoted = report.select("platform_key", F.explode("labels").alias("label")).filter("label like 'Rule: %'").withColumn("rule", F.substr("label", F.lit(7)))
    return quoted.join(rules.select("platform_key", "rule"), ["platform_key", "rule"], "left_anti")


#: Tokens of a side from which on a band of diagonals is looked at first, its first half width, and the half widths, as a share of
#: these tokens, up to which it costs less than whole rows do.
LONG, BAND, NARROW = 1 << 19, 32, 1 << 14
EQ, ADD, DEL = 0, 1, 2
_UNKNOWN = -(1 << 30)


def word_diff(cues: DataFrame) -> DataFrame:
    """Changed cues with diff: array<struct<op, token>> of eq, add and del over words and white space, by longest common subsequence.

    A null text counts as empty. cues should be a written table: the filter for changes is else pushed through what made them.
    """
    names = ["eq", "add", "del"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, ops, tokens, ends = batch.slice(at, 256), [], [], [0]
                for old, new in zip(part.column("original_text").to_pylist(), part.column("text").to_pylist(), strict=True):
                    a, b = (re.findall(r"\s+|\S+", t or "") for t in (old, new))
                    own = edits(a, b)
                    # places in a and b move on by each token that is kept or deleted, and kept or added
                    of_a, of_b = np.cumsum(own != ADD) - 1, np.cumsum(own != DEL) - 1
                    tokens += [b[j] if op == ADD else a[i] for op, i, j in zip(own.tolist(), of_a.tolist(), of_b.tolist(), strict=True)]
                    ops.append(own)
                    ends.append(ends[-1] + len(own))
                named = pa.array(names).take(pa.array(np.concatenate(ops).astype(np.int32)))
                diffs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([named, pa.array(tokens, pa.string())], ["op", "token"]))
                yield pa.RecordBatch.from_arrays([*part.columns, diffs], [*part.schema.names, "diff"])

    text = lambda c: F.coalesce(c, F.lit(""))
    changed = cues.select("file_id", "cue_no", "original_text", "text").filter(text(F.col("original_text")) != text(F.col("text")))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in changed.schema.fields)
    return changed.mapInArrow(run, kinds + ", diff array<struct<op string, token string>>")


def edits(a: list, b: list) -> np.ndarray:
    """EQ, ADD and DEL that turn a into b, by a longest common subsequence; read from the end, a pair that is equal is kept, else
    what was added goes before what was deleted if both are as good.

    The common end is cut first. A row of the table is one long number, see `_by_bits`. Where rows are very long, a band of diagonals
    is looked at first, and widened while that costs less: its work goes with tokens times edits. Rows are kept each root of the rows
    and made anew on the way back.
    """
    same = 0
    while same < min(len(a), len(b)) and a[-1 - same] == b[-1 - same]:
        same += 1
    ids: dict = {}
    x, y = (np.array([ids.setdefault(t, len(ids)) for t in side[: len(side) - same]], np.int64) for side in (a, b))
    found, band = None, max(BAND, abs(len(x) - len(y)) + 1)
    while found is None and len(y) >= LONG and band * NARROW <= len(y):
        found = _banded(x, y, band)
        band *= 2
    return np.concatenate([_by_bits(x, y) if found is None else found, np.full(same, EQ, np.uint8)])


def _by_bits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The edits, from rows of the table as numbers of a bit a column: 0 where the row's length grows at the column. A row follows
    from the one above in five operations on the whole number (Hyyro 2004)."""
    m, n = len(x), len(y)
    full, size = (1 << n) - 1, n // 8 + 1
    order = np.argsort(y, kind="stable")
    lows, highs = (np.searchsorted(y[order], x, side).tolist() for side in ("left", "right"))
    at, xs, ys = order.tolist(), x.tolist(), y.tolist()
    often, masks = math.isqrt(n) + 1, {}  # masks of no more than the root of the columns are kept

    def matches(i: int) -> int:
        """The columns of y that equal x[i]."""
        if xs[i] in masks:
            return masks[xs[i]]
        bits = bytearray(size)
        for j in at[lows[i] : highs[i]]:
            bits[j >> 3] |= 1 << (j & 7)
        mask = int.from_bytes(bits, "little")
        if highs[i] - lows[i] >= often:
            masks[xs[i]] = mask
        return mask

    def step(i: int, row: int) -> int:
        if lows[i] == highs[i]:
            return row
        met = row & matches(i)
        return ((row + met) | (row - met)) & full

    row, stride = full, max(1, math.isqrt(m))
    kept = {0: row}
    for i in range(1, m + 1):
        row = step(i - 1, row)
        if i % stride == 0:
            kept[i] = row
    out, i, j = [], m, n
    while i:
        first = (i - 1) // stride * stride
        row, rows = kept[first], []
        for k in range(first, i):
            row = step(k, row)
            rows.append(row.to_bytes(size, "little"))
        while i > first:
            if j and xs[i - 1] == ys[j - 1]:
                op = EQ
            else:
                # what is as long without column j is added
                op = ADD if j and rows[i - first - 1][(j - 1) >> 3] >> ((j - 1) & 7) & 1 else DEL
            out.append(op)
            i, j = i - (op != ADD), j - (op != DEL)
    out += [ADD] * j
    return np.array(out[::-1], np.uint8)


def _banded(x: np.ndarray, y: np.ndarray, band: int) -> np.ndarray | None:
    """The edits, or None if better ones may lie outside of the band. Cell t of row i is column i + t - band."""
    m, n, width = len(x), len(y), 2 * band + 1
    column = np.arange(width) - band
    padded = np.concatenate([np.full(band, -1), y, np.full(band + m + 1, -1)])

    def equal(i: int) -> np.ndarray:
        return padded[i - 1 : i - 1 + width] == x[i - 1]

    def step(i: int, row: np.ndarray, same: np.ndarray) -> np.ndarray:
        """Row i from the one above."""
        above = np.append(row[1:], _UNKNOWN)
        out = np.maximum.accumulate(np.maximum(above, np.where(same, row + 1, _UNKNOWN)))
        out[column + i > n] = _UNKNOWN
        return out

    row = np.where((column >= 0) & (column <= n), 0, _UNKNOWN)
    stride = max(1, math.isqrt(m))
    kept = {0: row}
    for i in range(1, m + 1):
        row = step(i, row, equal(i))
        if i % stride == 0:
            kept[i] = row
    if band <= max(m, n) and m + n - 2 * row[n - m + band] + 1 > band:
        return None
    out, i, j = [], m, n
    while i:
        first = (i - 1) // stride * stride
        row, choices = kept[first], []
        for k in range(first + 1, i + 1):
            same = equal(k)
            now = step(k, row, same)
            left, above = np.append(_UNKNOWN, now[:-1]), np.append(row[1:], _UNKNOWN)
            choices.append(np.where(same, EQ, np.where((left >= above) & (column + k > 0), ADD, DEL)).astype(np.uint8))
            row = now
        while i > first:
            op = choices[i - first - 1][j - i + band]
            out.append(op)
            i, j = i - (op != ADD), j - (op != DEL)
    out += [ADD] * j
    return np.array(out[::-1], np.uint8)
