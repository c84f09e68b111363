"""Italics by platform policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.functions import text as tx

# Policies by part of a platform's key, in order (no italics at all, lyrics, foreign phrases).
POLICIES = (
    ("disney", False, True, True), ("discovery_max", False, True, True), ("dmax", False, True, True), ("guide_discovery", False, True, True), ("discovery_scripps", True, False, False),
    ("nickelodeon", True, False, False), ("tvb", True, False, False), ("vubiquity", False, False, False), ("generic", False, True, False),
)

# Foreign phrases.
FOREIGN = (
    "voilà", "voila", "c'est la vie", "je ne sais quoi", "merci", "oui", "non", "mon dieu", "merde", "sacré bleu", "gracias", "por favor", "sí", "señor", "señora", "ciao", "prego",
    "mamma mia", "arrivederci", "danke", "bitte", "ja", "nein", "arigato", "konnichiwa", "sayonara", "namaste", "karma", "nirvana", "yoga", "schadenfreude", "zeitgeist", "angst",
    "faux pas", "déjà vu", "rendezvous", "fiancé", "fiancée", "cafe", "café", "naïve", "résumé", "façade",
)
NOTE = "[♪♫🎵🎶]"


def with_policy(platforms: DataFrame) -> DataFrame:
    """Platforms with no_italics, italic_lyrics and italic_foreign: the first policy whose part the key holds, else from the rules' text.

    Columns only: the size of a joined table isn't known, and an unknown dimension is not broadcast."""
    names = ("no_italics", "italic_lyrics", "italic_foreign")
    key = F.lower("platform_key")
    own = F.coalesce(*(F.when(key.contains(part), F.struct(*(F.lit(x).alias(n) for n, x in zip(names, flags)))) for part, *flags in POLICIES))
    rules = F.lower(F.array_join(F.coalesce("rules", F.array().cast("array<string>")), " "))
    derived = {"no_italics": rules.rlike("no italics|do not use italics|no text styles?"), "italic_lyrics": rules.rlike("(?:song|lyric|singing)[^.]*italic|italic[^.]*(?:song|lyric|singing)"), "italic_foreign": rules.rlike("foreign[^.]*italic|italic[^.]*foreign")}
    return platforms.select(*platforms.columns, *(F.coalesce(own[k], v).alias(k) for k, v in derived.items()))


def strip(text: Column, gate: Column | None = None) -> Column:
    return tx.gated(text, gate, "(?i)</?i>")


def wrap_lyrics(text: Column, gate: Column | None = None) -> Column:
    """Lines with a music note in italics, unless they are."""
    return tx.gated(text, gate, rf"(?m)^(?!.*<i>)(.*{NOTE}.*)$", "<i>$1</i>")


def wrap_foreign(text: Column, gate: Column | None = None) -> Column:
    """Foreign phrases in italics, longest first, whole words outside italics only."""
    longest = "|".join(sorted(FOREIGN, key=len, reverse=True))
    return tx.gated(text, gate, rf"(?iU)\b({longest})\b(?![^<]*</i>)", "<i>$1</i>")


def apply(cues: DataFrame) -> DataFrame:
    """Cues joined with a policy: italics stripped or added, with hints italics_added and italics_removed."""
    t = F.col("text")
    new = wrap_foreign(wrap_lyrics(strip(t, F.col("no_italics")), F.col("italic_lyrics") & ~F.col("no_italics")), F.col("italic_foreign") & ~F.col("no_italics"))
    out = cues.withColumn("_new", new)
    hint = F.when(F.regexp_count("_new", F.lit("<i>")) > F.regexp_count(t, F.lit("<i>")), "italics_added").when(F.regexp_count("_new", F.lit("<i>")) < F.regexp_count(t, F.lit("<i>")), "italics_removed")
    had = F.coalesce("rule_hints", F.array().cast("array<string>")) if "rule_hints" in cues.columns else F.array().cast("array<string>")
    return out.withColumn("rule_hints", F.array_distinct(F.array_compact(F.concat(had, F.array(hint))))).withColumn("text", F.col("_new")).drop("_new")
