"""Registered query of change labels: lines of documents changed in every way that a before/after test knows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom import shared
from cueloom import views as v
from cueloom.operators import audit
from cueloom.plans.registered import query

#: Before, after, and what names the change; @ is a plain sentence made of a line's letters.
CHANGES = (
    ("@ and more", "@\nand more", "line_limit"), ("[MUSIC] @", "@", "hoh_removed"), ("(waves) @", "@", "stage_removed"), ("@", "<i>@</i>", "italics_added"), ("<i>@</i>", "@", "italics_removed"),
    ("- @", "-@", "two_speaker_hyphen"), ("@—", "@--", "interruption_double_hyphen"), ("Damn @", "**** @", "profanity_asterisk"), ("@ fool", "@ fxxx", "profanity_replaced"), ("@ 3", "@ three", "number_to_word"),
    ("Uh @", "@", "filler_removed"), ("JOHN: @", "@", "char_name_removed"), ("JOHN @", "@", "char_name_removed"), ("@ colour", "@ color", "us_spelling"), ("@  so", "@ so", "double_space"), ("@!!", "@!", "double_punct"),
    ("@ .", "@.", "space_before_punct"), ("@.....", "@...", "ellipsis"), ("so @", "So @", "capitalize"), ("@ F.B.I.", "@ FBI", "acronym_dots"), ("@", "", audit.WIPED), ("@ abc", "@ xyz", ""), ("@", "@", None),
)
RULES = ((1, "Remove all HOH and EMT elements"), (2, "Avoid double punctuation"), (3, "No italics"), (4, "Use US English spelling"), (5, "Remove any stage direction"))


def _label(hint: str) -> str:
    """The label that the rules give a hint."""
    for key, description, phrases in audit.HINTS:
        if key == hint:
            held = [r for _, r in RULES if any(p in r.lower() for p in phrases)]
            return f"Rule: {held[0]}" if held else f"Verified edit: {description}"
    return f"Rule: {RULES[4][1]}" if hint == audit.WIPED else audit.FALLBACK


_EXPECTED = ", ".join(f"({k}, '{_label(hint)}')" for k, (_, _, hint) in enumerate(CHANGES) if hint is not None)


@query(v.with_sql(v.CUES_DOC, f"kinds(k, label) AS (VALUES {_EXPECTED})", body=f"SELECT file_id, CAST(cue_no AS INTEGER) AS cue_no, label AS labels FROM cues_doc JOIN kinds ON k = (file_id + cue_no) % {len(CHANGES)}"))
def change_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document changed in one of the ways, with the label that explains it."""
    cues = v.cues_doc(spark, sf_dir)
    plain = F.concat(F.lit("Some x"), F.regexp_replace(F.lower("text"), "[^a-z]", ""), F.lit(" here"))
    kind = ((F.col("file_id") + F.col("cue_no")) % len(CHANGES)).cast("int") + 1
    side = lambda n: F.replace(F.element_at(F.array(*[F.lit(c[n]) for c in CHANGES]), kind), F.lit("@"), plain)
    changed = cues.select("file_id", "cue_no", F.lit("p").alias("platform_key"), side(0).alias("original_text"), side(1).alias("text"), F.array().cast("array<string>").alias("rule_hints"))
    rules = spark.createDataFrame([("p", n, r) for n, r in RULES], "platform_key string, rule_no int, rule string")
    labelled = audit.change_labels(shared.written(changed, "changed"), rules)
    return labelled.select("file_id", "cue_no", F.array_join("labels", " / ").alias("labels"))
