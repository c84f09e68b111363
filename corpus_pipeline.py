"""A corpus pipeline of five stages over the documents table, each an operator of cueloom.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result to the shared folder and rereads
it for the next. All but the last stage return the columns of documents, further ones included; the last returns token ids and
digests. An empty table gives an empty one. Rows with null doc_id are looked at by stages 1, 4 and 5 and passed on by 2 and 3.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.llm import bpe, decontaminate, langid, linededup, minhash, textkit


def _resized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def _apart(docs: DataFrame, *made: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns renamed that are called like those an operator adds, and the names to give back."""
    names = {}
    for c in made:
        if c in docs.columns:
            names[c] = f"_{c}"
            while names[c] in docs.columns:
                names[c] = f"_{names[c]}"
    return docs.withColumnsRenamed(names), {v: k for k, v in names.items()}


def _back(out: DataFrame, made: tuple[str, ...], names: dict[str, str], docs: DataFrame) -> DataFrame:
    return out.drop(*made).withColumnsRenamed(names).select(*(F.col(f"`{c}`") for c in docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language: null texts and texts without a letter. Repeated rows stay or go together."""
    made = ("lang_pred", "score")
    own, names = _apart(docs, *made)
    return _back(langid.predict(own, langid.fit(docs)).filter(F.col("lang_pred") != langid.UNKNOWN), made, names, docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeated runs of 3 lines or 50 words; a document of which only blank lines are left goes.

    Earlier is the smaller doc_id, then the smaller line number; equal rows keep the same lines, a null text stays null."""
    made = ("n_lines", "n_removed", "n_runs")
    own, names = _apart(docs, *made)
    cut = linededup.dedup(own, words=linededup.PASSAGE_WORDS)
    return _resized(_back(cut.filter((F.col("n_removed") == 0) | F.col("text").isNull() | (F.trim("text") != "")), made, names, docs))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: five-word shingles, Jaccard similarity of 0.8 or more.

    Of linked texts the one with the smallest doc_id stays, and of equal ids that with the smaller textkit.row_key; of rows with
    equal id and text one stays. Rows that share an id only are told apart. Null texts, texts without a word and rows without an
    id link with nothing and stay."""
    own, names = _apart(docs, "row")
    own = own.withColumn("row", textkit.row_key())
    found = textkit.written(minhash.near_duplicates(own.select("doc_id", "text"), words=5, percent=80, rows=True), "near-duplicates")
    linked = found.filter("component is not null").select("doc_id", "row", "component")
    first = textkit.written(linked.groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("_n")).filter("_n > 1").select(F.col("first.row").alias("row"), "component", "_n"), "first-of-group")
    later = textkit.spread_join(linked.withColumnRenamed("row", "own"), first, ["component"]).filter("own != row").select(F.col("own").alias("row")).distinct()
    kept = own.join(textkit.written(later, "later-copies"), "row", "left_anti")
    twice = textkit.written(linked.groupBy("row").count().filter("count > 1").select("row"), "repeated-rows")
    if not twice.isEmpty():
        kept = kept.join(twice, "row", "left_anti").unionByName(kept.join(twice, "row", "left_semi").dropDuplicates(["row"]))
    return _back(kept, ("row",), names, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark, wherever it stands; null and empty texts are clean and stay."""
    own, names = _apart(docs, "leaks")
    found = decontaminate.contaminated(own, textkit.table(spark, sf_dir, "benchmark"))
    return _back(found.filter(F.size("leaks") == 0), ("leaks",), names, docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids): ids as packed little-endian 32-bit integers."""
    return bpe.round_trip(docs, *bpe.vocabulary(), packed=True)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("near-duplicate documents", dedup_documents),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", tokenise),
]

#: Most stages can't be expressed in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = textkit.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = textkit.written(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
