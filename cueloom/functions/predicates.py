"""Predicates on cues and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions import text as tx

# Marks of text that must stay, and phrases that are skipped.
PRESERVED = r"(?i)\b(?:directed by|produced by|written by|starring|executive producer|music by|edited by|casting by|based on|main title|title card|on[- ]?screen|caption|super:|chyron|forced narrative|subtitl(?:es|ing) by|translated by)\b"
SKIPPED = r"(?i)^(?:continued|cont'd|end of (?:reel|act|part|show)|blank page|page \d+|reel \d+|no dialogue|scene|total footage|start|finish|footage)\b[\s.:]*$"


def is_zero_subtitle(text: Column) -> Column:
    t = F.upper(F.coalesce(text, F.lit("")))
    return t.contains("STORY:") & t.contains("LANG:")


def is_metadata_label(text: Column) -> Column:
    return F.trim(text).rlike(r"(?i)^(?:MUSIC|WALLA)$")


def is_dialogue(text: Column) -> Column:
    """Two characters or more with a letter, and no heading, label, number, note or upper-case name; a zero subtitle always."""
    def bare(t: Column) -> Column:
        # marks and tags are looked for where one can be
        plain = F.when(t.contains("*"), F.regexp_replace(F.regexp_replace(t, r"\*\*(.+?)\*\*", "$1"), r"(?<!\*)\*(?!\*)(.+?)(?<!\*)\*(?!\*)", "$1")).otherwise(t)
        return tx.let(plain, lambda p: F.when(p.contains("<"), tx.strip_tags(p)).otherwise(p))

    def noise(b: Column) -> Column:
        return b.rlike(tx.METADATA) | is_metadata_label(b) | b.rlike(r"^[\d\s:;,.|/-]+$") | b.rlike(tx.SCENE_HEADING) | b.rlike(tx.QC_NOTE) | b.rlike(r"^[A-Z][A-Z\s.\-'/()0-9#&,]{1,40}$")

    # the bare text is made once, not once for each pattern
    spoken = lambda t: tx.let(bare(t), lambda b: is_zero_subtitle(t) | (b.rlike("[A-Za-z]") & ~noise(b)))
    return tx.let(F.trim(F.coalesce(text, F.lit(""))), lambda t: (F.length(t) >= 2) & spoken(t))


def must_preserve(text: Column) -> Column:
    return text.rlike(PRESERVED)


def is_valid_line(text: Column, min_words: int = 1) -> Column:
    """Lines worth extracting: preserved ones always; else no heading, skip phrase, timecode, punctuation or bracket alone."""
    t = F.trim(F.coalesce(text, F.lit("")))
    noise = t.rlike(tx.METADATA) | t.rlike(SKIPPED) | t.rlike(r"^[\d:;.,\s]{1,12}$") | t.rlike(r"^[^\p{L}\p{N}]*$") | t.rlike(r"^(?:\([^)]*\)|\[[^\]]*\])$")
    return must_preserve(t) | (~noise & (F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")) >= min_words))


def is_caps_scene_line(text: Column) -> Column:
    """An upper-case line without closing punctuation that nothing preserves."""
    t = F.trim(text)
    return t.rlike(r"^[^a-z]*[A-Z][^a-z]*$") & ~t.rlike(r"[.!?…]$") & ~must_preserve(t)


def in_range(id_: Column, low: int | None = None, high: int | None = None) -> Column:
    """Whether an id lies in a range; ids that are no number never do, unless there is no range."""
    if low is None and high is None:
        return F.lit(True)
    n = id_.try_cast("int")
    return F.coalesce((n >= (low if low is not None else -(1 << 31))) & (n <= (high if high is not None else (1 << 31) - 1)), F.lit(False))


def visible(cues: DataFrame) -> DataFrame:
    """Cues that are neither deleted nor blank."""
    kept = cues.filter(~F.coalesce("deleted", F.lit(False))) if "deleted" in cues.columns else cues
    return kept.filter(F.trim(F.coalesce("text", F.lit(""))) != "")


def too_long(text: Column, most: Column) -> Column:
    return F.exists(F.split(text, "\n"), lambda line: F.length(F.trim(F.when(line.contains("<"), tx.strip_tags(line)).otherwise(line))) > most)


def flag_too_long(cues: DataFrame) -> DataFrame:
    """Cues still over max_chars_per_line flagged with a reason."""
    over = too_long(F.col("text"), F.col("max_chars_per_line"))
    return cues.withColumn("flagged", F.coalesce("flagged", F.lit(False)) | F.coalesce(over, F.lit(False))).withColumn("flag_reason", F.when(over, F.lit("Line still exceeds the limit")).otherwise(F.col("flag_reason")))


def usefulness(text: Column) -> Column:
    """Words plus 8 for each timecode; null for text of which less than 75 % can be printed, or with too few words."""
    words, codes = F.regexp_count(text, F.lit(r"\p{L}{2,}")), F.regexp_count(text, F.lit(r"\d{1,2}:\d{2}:\d{2}"))
    printable = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}\p{P}\p{S}\s]", "")) / F.length(text)
    return F.when((F.length(text) > 0) & (printable >= 0.75) & ((words >= 4) | ((codes > 0) & (words >= 1))), words + 8 * codes)


def best_candidate(candidates: DataFrame) -> DataFrame:
    """The most useful text of each document (doc_id, text), the first on a tie of both score and text."""
    scored = candidates.withColumn("score", usefulness(F.col("text"))).filter("score is not null")
    return scored.groupBy("doc_id").agg(F.max(F.struct("score", "text")).alias("_b")).select("doc_id", "_b.score", "_b.text")


def timecode_pages(lines: DataFrame) -> DataFrame:
    """Documents that are mostly timecodes: 20 lines of them or more, and fewer than three words a line."""
    code = F.col("line").rlike(r"\d{1,2}:\d{2}:\d{2}")
    grouped = lines.groupBy("doc_id").agg(F.count_if(code).alias("codes"), F.sum(F.regexp_count("line", F.lit(r"\p{L}{2,}"))).alias("words"))
    return grouped.filter("codes >= 20 and words < 3 * codes")


def quiet_pages(lines: DataFrame, most_chars: int = 3000) -> DataFrame:
    """(doc_id, line_no, line) to (doc_id, text): pages between `--- PAGE` marks with over 3 bars a line on average and fewer than
    half their lines holding a word go, as do lines of marks only; what is left is cut at most_chars."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    paged = lines.withColumn("page", F.sum(F.col("line").rlike(r"^---\s*PAGE").cast("int")).over(order))
    stats = paged.groupBy("doc_id", "page").agg(F.avg(F.length("line") - F.length(F.replace("line", F.lit("|"), F.lit("")))).alias("bars"), F.avg(F.col("line").rlike("[A-Za-z]{3,}").cast("double")).alias("worded"))
    kept = paged.join(stats.filter("not (bars > 3 and worded < 0.5)").select("doc_id", "page"), ["doc_id", "page"], "left_semi").filter(~F.col("line").rlike(r"^[\s|_\-=.~]*$"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n")
    return kept.groupBy("doc_id").agg(F.substring(joined, 1, most_chars).alias("text"))


def weak_rows(cues: DataFrame) -> DataFrame:
    """Aligned rows without time, flagged, or placed by hand."""
    return cues.filter(F.col("start_ms").isNull() | F.coalesce("flagged", F.lit(False)) | F.coalesce("manual_placement", F.lit(False)))
