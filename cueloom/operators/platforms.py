"""Delivery platforms and their rules as a dimension: defaults, joins, rule buckets, upserts and families."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from cueloom import schema
from cueloom.functions import text as tx

#: Bytes up to which a dimension is broadcast; a larger one is joined by key.
BROADCAST_BYTES = 8 << 20

# Defaults where a platform says nothing.
DEFAULTS = {
    "max_chars_per_line": 42, "max_lines": 2, "min_duration_seconds": 1.0, "max_duration_seconds": 7.0, "min_interval_seconds": 0.02,
    "reading_speed_target_cps": 17, "reading_speed_max_cps": 21, "zero_subtitle_required": False,
}

# Preset platforms (key, characters a line, lines, least and most seconds, gap, most CPS, zero subtitle, removed elements, rules).
PRESETS = (
    ("generic", 42, 2, 1.0, 7.0, 0.02, None, False, (), ()),
    ("streaming_a", 42, 2, 0.833, 7.0, 0.083, 20, False, ("hoh", "character_names"), ("Numbers 1-10 in words", "Double hyphens (--) for interruptions", "US English spelling")),
    ("streaming_b", 40, 2, 1.0, 7.0, 0.08, 17, True, ("hoh", "emt", "fillers"), ("STORY and LANG must be capitalised", "First 1 second of the programme stays free", "No periods for acronyms")),
    ("broadcast_a", 37, 2, 1.0, 6.0, 0.04, 15, True, ("stage_directions", "fillers"), ("Numbers 0-9 written out", "No punctuation at end of song line", "Translator credit: at the end")),
    ("broadcast_b", 35, 3, 1.5, 8.0, 0.12, None, False, ("hoh",), ("Use asterisks (****) for beeped words", "Raise subtitle over graphics")),
)


def presets(spark: SparkSession) -> DataFrame:
    """Preset platforms with the schema of a platform table; one literal, whose size Spark knows, so that it is broadcast."""
    kind, rows = StructType.fromDDL(schema.PLATFORM), []
    for key, chars, lines, least, most, gap, cps, zero, removed, rules in PRESETS:
        rows.append((key, key.split("_")[0], key.split("_")[-1], key.replace("_", " ").title(), chars, None, lines, least, most, gap, None, cps, zero, list(removed), list(rules), [], {"damn": "dxxn", "hell": "hxxl"} if key == "broadcast_b" else {}, "hyphen_no_space", None, False, None))
    text = json.dumps([dict(zip(kind.names, row)) for row in rows])
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(text), ArrayType(kind))))


def with_defaults(platforms: DataFrame) -> DataFrame:
    """Missing numbers filled; rules_text is all rules in lower case."""
    for name, value in DEFAULTS.items():
        platforms = platforms.withColumn(name, F.coalesce(name, F.lit(value)))
    return platforms.withColumn("rules_text", F.lower(F.array_join(F.coalesce("rules", F.array().cast("array<string>")), " ")))


def _small(dimension: DataFrame) -> DataFrame:
    """A dimension with a broadcast hint if its plan's size is known to be small."""
    size = dimension._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(dimension) if int(str(size)) <= BROADCAST_BYTES else dimension


def join_platforms(cues: DataFrame, platforms: DataFrame) -> DataFrame:
    """cues with their platform's fields; an unknown or null key gets those of `generic`, or the defaults."""
    known = with_defaults(platforms)
    names = [c for c in known.columns if c != "platform_key"]
    generic = known.filter("platform_key = 'generic'").select(F.struct(*names).alias("_generic")).limit(1)
    joined = cues.join(_small(known.select("platform_key", F.struct(*names).alias("_own"))), "platform_key", "left").crossJoin(F.broadcast(generic.groupBy().agg(F.first("_generic").alias("_generic"))))
    default = {n: F.lit(DEFAULTS.get(n)) for n in names}
    return joined.select(*cues.columns, *(F.when(F.col("_own").isNotNull(), F.col(f"_own.{n}")).otherwise(F.coalesce(F.col(f"_generic.{n}"), default[n])).alias(n) for n in names))


def read_platforms(spark: SparkSession, path: str) -> DataFrame:
    """A platform table of JSON text columns, custom ones first, then by name, newest first."""
    raw = spark.read.parquet(path)
    lists = {c: "array<string>" for c in ("rules", "subtitler_rules", "remove_elements") if dict(raw.dtypes).get(c) == "string"}
    for c, kind in lists.items():
        raw = raw.withColumn(c, F.coalesce(F.from_json(c, kind), F.array().cast(kind)))
    if dict(raw.dtypes).get("profanity_table") == "string":
        raw = raw.withColumn("profanity_table", F.from_json("profanity_table", "map<string,string>"))
    return raw.orderBy(F.desc("is_custom"), "name", F.desc("created_at"))


# Words that decide a rule's bucket.
LENGTH_WORDS = ("characters per line", "character per line", "chars per line", "line length", "lines per subtitle", "maximum characters", "max characters")
TIMING_WORDS = ("duration", "second", "frame", "gap", "interval", "reading speed", "cps", "characters per second", "wpm", "in-time", "out-time", "timecode", "shot change")
POSITION_WORDS = ("position", "raise", "top of screen", "bottom", "centre-justified", "center-justified", "justified", "alignment", "safe area", "on-screen")
FILE_WORDS = ("file nam", "filename", "file format", ".pac", ".srt", ".ttml", "encoding", "repo file", "zero subtitle", "delivery file", "end credit file")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def rule_bucket(rule: Column) -> Column:
    """timing, positioning, file or text. A line-length rule is text, whatever else it says."""
    t = F.lower(rule)
    return F.when(_any(t, LENGTH_WORDS), "text").when(_any(t, TIMING_WORDS), "timing").when(_any(t, POSITION_WORDS), "positioning").when(_any(t, FILE_WORDS), "file").otherwise("text")


def segregate(rules: DataFrame) -> DataFrame:
    """(platform_key, rule_no, rule) to (platform_key, bucket, rules): first of equal rules in either case, in order."""
    first = rules.withColumn("bucket", rule_bucket(F.col("rule"))).groupBy("platform_key", "bucket", F.lower(F.trim("rule")).alias("_key")).agg(F.min(F.struct("rule_no", "rule")).alias("_first"))
    return first.groupBy("platform_key", "bucket").agg(F.transform(F.array_sort(F.collect_list("_first")), lambda s: s["rule"]).alias("rules"))


def dedup_rules(rules: DataFrame) -> DataFrame:
    """The first of rules that are equal in either case, for each platform."""
    return rules.groupBy("platform_key", F.lower(F.trim("rule")).alias("_key")).agg(F.min(F.struct("rule_no", "rule")).alias("_f")).select("platform_key", "_f.rule_no", "_f.rule")


def timing_fields(rules: DataFrame) -> DataFrame:
    """Numbers in a platform's timing rules; the last rule that names one counts, seconds override frames."""
    t = F.lower("rule")
    number = lambda pattern: F.regexp_extract(t, pattern, 1).try_cast("double")
    rows = rules.select(
        "platform_key", "rule_no", t.contains("zero subtitle").alias("zero"),
        F.when(t.contains("min") & t.contains("duration"), number(r"(\d+(?:\.\d+)?)\s*s(?:ec|\b)")).alias("min_duration_seconds"),
        F.when(t.contains("max") & t.contains("duration"), number(r"(\d+(?:\.\d+)?)\s*s(?:ec|\b)")).alias("max_duration_seconds"),
        F.when(t.rlike("cps|characters per second|reading speed"), number(r"(\d+(?:\.\d+)?)\s*(?:cps|characters per second)")).alias("reading_speed_max_cps"),
        F.when(t.rlike("gap|interval"), number(r"(\d+(?:\.\d+)?)\s*frames?")).alias("_frames"),
        F.when(t.rlike("gap|interval"), number(r"(\d+(?:\.\d+)?)\s*s(?:ec|\b)")).alias("_gap_s"),
    )
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("rule_no")))
    out = rows.groupBy("platform_key").agg(*(last(c).alias(c) for c in ("min_duration_seconds", "max_duration_seconds", "reading_speed_max_cps")), F.coalesce(last("_gap_s"), last("_frames") / 25).alias("min_interval_seconds"), F.max("zero").alias("zero_subtitle_required"))
    return out


def derived_rules(platforms: DataFrame) -> DataFrame:
    """Platforms with rules that follow from their other fields appended, unless they stand there in either case."""
    extra = F.array_compact(F.array(
        F.when(F.size("profanity_table") > 0, F.lit("Replace profanity per platform table")),
        F.when(F.exists("remove_elements", lambda e: F.lower(e) == "hoh"), F.lit("Remove HOH elements")),
        F.when(F.col("zero_subtitle_required"), F.lit("Zero subtitle with STORY: and LANG: at the start")),
    ))
    missing = F.filter(extra, lambda x: ~F.exists("rules", lambda r: F.lower(r) == F.lower(x)))
    return platforms.withColumn("rules", F.concat(F.coalesce("rules", F.array().cast("array<string>")), missing))


def uncovered_rules(rules: DataFrame) -> DataFrame:
    """Rules that the deterministic steps don't carry out."""
    covered = r"(?i)double space|space before punctuation|ellipsis|double hyphen|characters per line|lines per subtitle|acronym|numbers? (?:1-10|0-9|1-9)|filler|profanity"
    return rules.filter(~F.col("rule").rlike(covered))


def quoted_rules(rules: DataFrame) -> DataFrame:
    """Rules whose quote stands in their source, white space and case aside."""
    flat = lambda c: F.lower(F.regexp_replace(c, r"(?U)\s+", " "))
    return rules.filter((F.trim("quote") != "") & flat("source").contains(F.trim(flat("quote"))))


def rules_from_text(pasted: DataFrame) -> DataFrame:
    """(platform_key, text) to (platform_key, rule_no, rule): bulleted lines of 8 characters or more; one block is cut at sentence ends."""
    lines = F.filter(F.transform(F.split("text", r"\R"), tx.rule_sentence), lambda x: F.length(x) >= 8)
    sentences = F.filter(F.transform(F.split("text", r"(?<=[.!?])\s+"), tx.rule_sentence), lambda x: F.length(x) >= 8)
    rows = pasted.select("platform_key", F.posexplode(F.when(F.size(lines) > 1, lines).otherwise(sentences)).alias("rule_no", "rule"))
    return dedup_rules(rows)


def upsert(current: DataFrame, new: DataFrame) -> DataFrame:
    """current with rows of new: a row of the same family and version (case and outer blanks aside) takes over the existing key."""
    norm = lambda d: (F.lower(F.trim(d["family"])), F.lower(F.trim(F.coalesce(d["version"], F.lit("")))))
    keyed = lambda d: d.withColumn("_f", norm(d)[0]).withColumn("_v", norm(d)[1])
    have = keyed(current).groupBy("_f", "_v").agg(F.min("platform_key").alias("_key"))
    latest = keyed(new).join(have, ["_f", "_v"], "left").withColumn("platform_key", F.coalesce("_key", "platform_key")).drop("_key")
    latest = latest.groupBy("platform_key").agg(F.max_by(F.struct(*new.columns), F.struct("_f", "_v")).alias("_r")).select("_r.*")
    return current.join(latest.select("platform_key"), "platform_key", "left_anti").unionByName(latest, allowMissingColumns=True)


def families(platforms: DataFrame) -> DataFrame:
    """A row a family: its versions, 'Current' first and then descending, equal ones by key, and labels that show a version only where there are several."""
    version = F.coalesce("version", F.lit("Current"))
    grouped = platforms.groupBy("family").agg(F.collect_list(F.struct((version != "Current").alias("late"), version.alias("version"), F.col("platform_key"))).alias("v"), F.count("*").alias("n"))
    ordered = F.array_sort("v", lambda a, b: F.when(a["late"] != b["late"], F.when(a["late"], 1).otherwise(-1)).when(a["version"] > b["version"], -1).when(a["version"] < b["version"], 1).when(a["platform_key"] < b["platform_key"], -1).when(a["platform_key"] > b["platform_key"], 1).otherwise(0))
    return grouped.select("family", F.transform(ordered, lambda x: x["platform_key"]).alias("keys"), F.transform(ordered, lambda x: F.when(F.col("n") > 1, F.concat(F.col("family"), F.lit(" "), x["version"])).otherwise(F.col("family"))).alias("labels"))


def rename_family(platforms: DataFrame, old: str, new: str) -> DataFrame:
    return platforms.withColumn("family", F.when(F.col("family") == old, new).otherwise(F.col("family")))


def edit_meta(platforms: DataFrame, key: str, **fields) -> DataFrame:
    """Fields of one platform overwritten."""
    return platforms.withColumns({k: F.when(F.col("platform_key") == key, F.lit(v).cast(platforms.schema[k].dataType)).otherwise(F.col(k)) for k, v in fields.items()})


def delete_platforms(platforms: DataFrame, key: str | None = None, family: str | None = None) -> DataFrame:
    keep = F.lit(True)
    if key is not None:
        keep = keep & ~F.col("platform_key").eqNullSafe(key)
    if family is not None:
        keep = keep & ~F.col("family").eqNullSafe(family)
    return platforms.filter(keep)


def bulk_import(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Sheets mapped to platforms: rows (sheet, rules) and mapping (sheet, family, version) give a status ok, skipped or error a row."""
    joined = rows.join(_small(mapping), "sheet", "left")
    status = F.when(F.col("family").isNull(), "skipped").when(F.coalesce(F.size("rules"), F.lit(0)) <= 0, "error").otherwise("ok")
    return joined.withColumn("platform_key", tx.slug(F.concat_ws("_", "family", "version"))).withColumn("status", status)


def versions_with_window(platforms: DataFrame) -> DataFrame:
    """Platforms with the number of versions in their family."""
    return platforms.withColumn("n_versions", F.count("*").over(Window.partitionBy("family")))
