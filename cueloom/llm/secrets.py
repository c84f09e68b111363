"""Secret scans by fixed patterns and by a battery of randomness tests. DataFrame functions only.

Patterns find assignments, access keys and long hexadecimal runs. The battery looks at every run of 20 or more key
characters: it infers the encoding (the smallest alphabet that holds all characters) and takes
  - chi-squared of the character counts against uniform use of that alphabet,
  - a runs test of characters above and below the alphabet's middle,
  - the serial correlation of neighbouring characters.
A candidate must pass all three as random, and be discovered as unlike text: its chi-squared must be improbably low for a
text-like string of the same encoding and length. Those probabilities fall with length, and the Benjamini-Hochberg rule over
the whole corpus holds the share of false discoveries at FALSE_SHARE.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit

# The patterns of the base scan, in the order in which kinds are listed.
ASSIGN_HEAD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ASSIGN = ASSIGN_HEAD + r"[A-Za-z0-9+/_.=-]+"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

#: Runs of key characters; padding belongs to them.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Inferred encodings in order (pattern, symbols, share of equal pairs in text over them: sum of squared frequencies).
ENCODINGS = (
    (r"^[0-9]+$", _DIGITS, 0.16),
    (r"^[0-9a-f]+$", _DIGITS + "abcdef", 0.13),
    (r"^[0-9A-F]+$", _DIGITS + "ABCDEF", 0.13),
    (r"^[a-z]+$", _LOWER, 0.065),
    (r"^[A-Z]+$", _UPPER, 0.065),
    (r"^[A-Z2-7]+$", _UPPER + "234567", 0.065),
    (r"^[0-9a-z]+$", _DIGITS + _LOWER, 0.065),
    (r"^[0-9A-Z]+$", _DIGITS + _UPPER, 0.065),
    (r"^[A-Za-z]+$", _UPPER + _LOWER, 0.055),
    (r"", _UPPER + _LOWER + _DIGITS + "+/", 0.055),
)

#: Least combined probability under randomness, and the share of false discoveries.
RANDOM_LEVEL, FALSE_SHARE = 0.01, 0.05
#: Bins of -10 log10 of a probability.
BINS = 400
_CHUNK = 256


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("double"), lambda a, x: a + x)


def _starts(steps: Column) -> Column:
    """Sums of all earlier steps for each step; by chunks, so that many matches in one text don't cost their square."""
    long0 = F.lit(0).cast("long")

    def chunk(c: Column) -> Column:
        base = F.aggregate(F.slice(steps, F.lit(1), c * _CHUNK), long0, lambda a, x: a + x)
        first = F.struct(base.alias("at"), F.array().cast("array<bigint>").alias("all"))
        return F.aggregate(
            F.slice(steps, c * _CHUNK + 1, F.lit(_CHUNK)),
            first,
            lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")),
            lambda a: a["all"],
        )

    return F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _CHUNK).cast("int")), chunk))


def _let(value: Column, body) -> Column:
    """body of value, evaluating value once."""
    return F.transform(F.array(value), body)[0]


def _spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of leftmost non-overlapping matches, in code points."""
    zipped = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda piece, match: F.struct(F.length(piece).cast("long").alias("gap"), match.alias("match")),
    )
    zipped = F.filter(zipped, lambda z: z["match"].isNotNull())  # the piece after the last match has none
    placed = lambda zs: F.zip_with(
        zs, _starts(F.transform(zs, lambda z: z["gap"] + F.length(z["match"]))),
        lambda z, s: F.struct((s + z["gap"]).alias("start"), (s + z["gap"] + F.length(z["match"])).alias("end"), z["match"].alias("match")),
    )
    spans = _let(zipped, placed)
    empty = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")
    return F.when(text.rlike(pattern), spans).otherwise(empty)


def _log10_lower(z: Column) -> Column:
    """log10 of the normal distribution at z; by its tail's expansion below -3."""
    body = F.log10(1 / (1 + F.exp(-(1.5976 * z + 0.07056 * z * z * z))))
    q = F.least(z, F.lit(-3.0))
    tail = -q * q / (2 * math.log(10)) - F.log10(-q * math.sqrt(2 * math.pi)) + F.log10(1 - 1 / (q * q) + 3 / (q * q * q * q))
    return F.when(z < -3, tail).otherwise(body)


def _neighbours(values: Column, f) -> Column:
    return F.zip_with(F.slice(values, F.lit(1), F.size(values) - 1), F.slice(values, F.lit(2), F.size(values) - 1), f)


def _scores(chars: Column, k: Column, symbols: Column, pairs: Column) -> Column:
    """struct<random, discovery> of a candidate's characters in an alphabet of k symbols."""

    def counted(s: Column) -> Column:
        values, n, k = s["values"], s["n"], s["k"]
        sides = F.transform(values, lambda v: (v > k / 2).cast("double"))
        return F.struct(
            values.alias("values"), n.alias("n"), k.alias("k"), s["pairs"].alias("pairs"),
            _sum(F.transform(s["counts"], lambda c: c * c)).alias("squares"), _sum(sides).alias("high"), (_sum(values) / n).alias("mean"),
            _sum(_neighbours(sides, lambda x, y: (x != y).cast("double"))).alias("turns"),
        )

    def scored(s: Column) -> Column:
        n, k, mean = s["n"], s["k"], s["mean"]
        mean_runs = 2 * s["high"] * (n - s["high"]) / n + 1
        spread = (mean_runs - 1) * (mean_runs - 2) / (n - 1)
        variance = _sum(F.transform(s["values"], lambda v: (v - mean) * (v - mean)))
        serial = _sum(_neighbours(s["values"], lambda x, y: (x - mean) * (y - mean)))
        away = k * s["pairs"] - 1
        chi = s["squares"] * k / n - n
        text_mean, text_var = (k - 1) + (n - 1) * away, 2 * (k - 1) + 4 * (n - 1) * away
        return F.struct(
            ((chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)).alias("z_chi"),
            F.when(spread > 0, (1 + s["turns"] - mean_runs) / F.sqrt(F.greatest(spread, F.lit(1e-9)))).otherwise(F.lit(-30.0)).alias("z_runs"),
            F.when(variance > 0, (serial / F.greatest(variance, F.lit(1e-9)) + 1 / n) * F.sqrt(n)).otherwise(F.lit(30.0)).alias("z_serial"),
            ((chi - text_mean) / F.sqrt(text_var)).alias("z_text"),
        )

    def judged(z: Column) -> Column:
        two_sided = lambda x: _log10_lower(-F.abs(x)) + math.log10(2)
        random = F.least(_log10_lower(-z["z_chi"]), two_sided(z["z_runs"]), two_sided(z["z_serial"])) + math.log10(3)
        return F.struct(random.alias("random"), _log10_lower(z["z_text"]).alias("discovery"))

    start = F.struct(
        F.transform(chars, lambda c: F.instr(symbols, c).cast("double")).alias("values"), F.size(chars).cast("double").alias("n"), k.alias("k"), pairs.alias("pairs"),
        F.transform(F.array_distinct(chars), lambda d: F.size(F.filter(chars, lambda c: c == d)).cast("double")).alias("counts"),
    )
    return _let(_let(_let(start, counted), scored), judged)


def battery(token: Column) -> Column:
    """struct<random, discovery> of a candidate: log10 of its probabilities as random and as text-like string."""

    def encoded(body: Column) -> Column:
        alphabet = None
        for pattern, symbols, pairs in reversed(ENCODINGS):
            own = F.struct(F.lit(symbols).alias("symbols"), F.lit(float(len(symbols))).alias("k"), F.lit(pairs).alias("pairs"))
            alphabet = own if alphabet is None else F.when(body.rlike(pattern), own).otherwise(alphabet)
        return F.struct(F.split(body, "").alias("chars"), alphabet.alias("in"))

    body = F.regexp_replace(F.translate(token, "-_", "+/"), "=+$", "")
    return _let(_let(body, encoded), lambda e: _scores(e["chars"], e["in"]["k"], e["in"]["symbols"], e["in"]["pairs"]))


def _candidates(docs: DataFrame) -> DataFrame:
    """docs (t: text) with random: array<struct<start, end, p struct<random, discovery>>>."""
    found = docs.withColumn("found", _spans(F.col("t"), CANDIDATE))
    judged = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), battery(s["match"]).alias("p")))
    return found.withColumn("random", judged).drop("found")


def _bin(discovery: Column) -> Column:
    return F.least(F.lit(BINS), F.floor(-10 * discovery)).cast("int")


def discovery_bin(docs: DataFrame) -> int:
    """Least bin of a discovery by the Benjamini-Hochberg rule over all candidates of the corpus; above BINS if none is.

    At most BINS + 1 counts reach the driver.
    """
    texts = docs.filter(F.col("text").rlike(CANDIDATE)).select(F.col("text").alias("t"))
    bins = _candidates(texts).select(F.explode("random").alias("c")).groupBy(_bin(F.col("c.p.discovery")).alias("bin")).count().collect()
    total, above, best = sum(r["count"] for r in bins), 0, BINS + 1
    for row in sorted(bins, key=lambda r: -r["bin"]):
        above += row["count"]
        if 10 ** (-row["bin"] / 10) * total <= FALSE_SHARE * above:
            best = row["bin"]
    return best


def scan(docs: DataFrame) -> DataFrame:
    """docs with spans: array<struct<start, order, end, kind>>, by start and then by the order of KINDS; offsets in code points.

    A null text counts as empty and has no spans; repeated rows give a row each; other columns stay, of any name but spans.
    """
    least = discovery_bin(docs)
    text, keep = F.col("t"), [c for c in docs.columns if c != "spans"]

    def tagged(spans: Column, kind: str) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    assign = F.filter(_spans(text, ASSIGN), lambda s: F.length(F.regexp_replace(s["match"], "^" + ASSIGN_HEAD, "")) >= 6)
    chosen = F.filter(F.col("random"), lambda c: (_bin(c["p"]["discovery"]) >= least) & (c["p"]["random"] >= math.log10(RANDOM_LEVEL)))
    found = F.concat(tagged(assign, "assign"), tagged(_spans(text, ACCESS), "access"), tagged(_spans(text, HEX), "hex"), tagged(chosen, "random"))
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("d"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    return _candidates(packed).select(*(F.col(f"d.`{c}`").alias(c) for c in keep), F.array_sort(found).alias("spans"))


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(textkit.table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(_text(base).cast("binary"), 256).alias("base_sha256"), _text(F.col("spans")).alias("spans"))
