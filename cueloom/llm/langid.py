"""Language identification by hierarchical discrimination.

A linear support vector machine per language family picks the family; one-versus-one machines between the languages of
that family then separate close relatives. Features are hashed character 1- to 3-grams of letters, square-rooted and
scaled to length 1. The machines are fitted on a bounded sample (SAMPLE_ROWS) of labelled rows; every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit

#: Labelled rows that a fit takes at most, over all languages; each gets an equal share, rows are chosen by a hash.
SAMPLE_ROWS = 3000
#: Rows per language at most, and shares of a language that are ranked each for itself before.
LANGUAGE_ROWS, SALTS = 500, 64
BUCKETS = 4096
STEPS, PENALTY = 150, 1e-3
UNKNOWN = "und"
#: Rows whose features are counted at a time.
ROWS = 256

# Language families by ISO 639-1 code. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "turkic": "az kk ky tk tr tt uz",
    "uralic": "et fi hu",
    "indic": "bn gu hi mr ne pa ur",
    "semitic": "am ar he mt",
}


def family(lang: str) -> str:
    return next((name for name, codes in FAMILIES.items() if lang in codes.split()), lang)


_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(rows x BUCKETS, unit length or zero; number of letters of each row) of whole texts."""
    lowered = [f" {(t or '').lower()} " for t in texts]
    rows = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    c = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letters()[c]
    count = np.bincount(rows, weights=is_letter, minlength=len(texts))
    c = np.where(is_letter, c, np.uint32(32)).astype(np.uint64)
    base = rows * BUCKETS
    total = np.zeros(len(texts) * BUCKETS)
    shift = np.uint64(64 - 12)
    keep = is_letter.copy()
    gram = c.copy()
    for n in range(3):
        if n:
            gram = gram[:-1] * np.uint64(0x2545F4914F6CDD1D) + c[n:]
            keep = (is_letter[: len(gram)] | is_letter[n:]) & (rows[: len(gram)] == rows[n:])
        slot = (textkit.mix(gram + np.uint64(n << 56)) >> shift).astype(np.int64)
        total += np.bincount((base[: len(gram)] + slot)[keep], minlength=len(total))
    x = np.sqrt(total.reshape(len(texts), BUCKETS)).astype(np.float32)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1), count


def fit_svm(x: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, classes weighed alike, by accelerated gradient descent."""
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    share = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum())).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    last_w, last_b = w, b
    for k in range(STEPS):
        m = k / (k + 3)
        vw, vb = w + m * (w - last_w), b + m * (b - last_b)
        slack = share * y * np.maximum(0, 1 - y * (x @ vw + vb))
        last_w, last_b = w, b
        w = vw + 0.4 * (x.T @ slack - PENALTY * vw)
        b = vb + 0.4 * float(slack.sum())
    return w, b


@dataclass
class Model:
    families: dict[str, list[str]] = field(default_factory=dict)
    by_family: dict[str, tuple[np.ndarray, float]] = field(default_factory=dict)
    by_pair: dict[tuple[str, str], tuple[np.ndarray, float]] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each row: the family's share by its margin, times the mean won against its relatives."""
        names = list(self.families)
        sure = lambda margin: 1 / (1 + np.exp(-4 * np.clip(margin, -8, 8)))
        won = np.stack([sure(x @ w + b) for w, b in (self.by_family[n] for n in names)], 1) if len(names) > 1 else np.ones((len(x), 1))
        best, p = won.argmax(1), won.max(1) / np.maximum(won.sum(1), 1e-9)
        lang, score = np.empty(len(x), dtype=object), np.zeros(len(x))
        for k, name in enumerate(names):
            at, langs = np.flatnonzero(best == k), self.families[name]
            points = np.zeros((len(at), len(langs)))
            for i, j in combinations(range(len(langs)), 2):
                w, b = self.by_pair[langs[i], langs[j]]
                q = sure(x[at] @ w + b)
                points[:, i] += q
                points[:, j] += 1 - q
            points = points / max(1, len(langs) - 1) if len(langs) > 1 else np.ones((len(at), 1))
            first = points.argmax(1)
            lang[at] = np.array(langs, dtype=object)[first]
            score[at] = p[at] * points[np.arange(len(at)), first]
        return lang, score


def train(x: np.ndarray, langs: list[str]) -> Model:
    names = sorted(set(langs))
    model = Model()
    for lang in sorted(names, key=lambda n: (family(n), n)):
        model.families.setdefault(family(lang), []).append(lang)
    langs_of = np.array(langs, dtype=object)
    group = np.array([family(lang) for lang in langs], dtype=object)
    if len(model.families) > 1:
        model.by_family = {name: fit_svm(x, group == name) for name in model.families}
    for own in model.families.values():
        for a, b in combinations(own, 2):
            both = np.isin(langs_of, [a, b])
            model.by_pair[a, b] = fit_svm(x[both], langs_of[both] == a)
    return model


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def fit(labelled: DataFrame) -> Model:
    """A model from (doc_id, text, lang): at most LANGUAGE_ROWS rows a language and SAMPLE_ROWS in all.

    Rows are chosen by a hash of doc_id. Rows with null lang or text teach nothing; without any row every text is `und`.
    """
    known = labelled.filter("lang is not null and text is not null and doc_id is not null")
    # first the rows of each of SALTS shares of a language, so that one task never gets a language's rows
    order = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = known.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SALTS)).alias("_salt"))
    ids = ids.withColumn("_n", order("lang", "_salt")).filter(F.col("_n") <= LANGUAGE_ROWS)
    ids = ids.select("doc_id", "lang").withColumn("_n", order("lang")).filter(F.col("_n") <= LANGUAGE_ROWS)
    ids = ids.orderBy("_n", "lang", "doc_id").limit(SAMPLE_ROWS).select("doc_id").distinct()
    sample = known.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.min_by("lang", F.xxhash64("text")).alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x, count = features(part.column(0).to_pylist())
                kept = np.flatnonzero(count > 0)
                yield pa.RecordBatch.from_arrays([part.column(1).take(pa.array(kept)), pa.array([x[i].tobytes() for i in kept], pa.binary())], ["lang", "x"])

    rows = sample.select("text", "lang").mapInArrow(run, "lang string, x binary").collect()
    if not rows:
        return Model()
    rows.sort(key=lambda r: (r.lang, bytes(r.x)))
    return train(np.stack([np.frombuffer(r.x, np.float32) for r in rows]), [r.lang for r in rows])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score added; other columns stay, of any name but these two.

    A text that is null or has no letter is `und` with score 0; so is every text if the model has learned nothing. Ties
    between families or languages go to the first by name. Repeated rows have a row each with the same prediction.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            size = np.asarray(pa.compute.binary_length(texts).fill_null(0), dtype=np.int64)
            group = np.maximum.accumulate(np.cumsum(size) // textkit.SLICE_BYTES * 4096 + np.arange(len(size)) // ROWS) if len(size) else size
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1), len(size)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                x, count = features(texts.slice(a, b - a).to_pylist())
                lang, score = np.full(b - a, UNKNOWN, dtype=object), np.zeros(b - a)
                at = np.flatnonzero(count > 0)
                if len(at) and own.families:
                    lang[at], score[at] = own.predict(x[at])
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["d", "lang_pred", "score"])

    packed = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in keep)).alias("d"))  # a column's name may hold a dot
    schema = T.StructType([T.StructField("d", packed.schema["d"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return packed.mapInArrow(run, schema).select(*(F.col(f"d.`{c}`").alias(c) for c in keep), "lang_pred", "score")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = textkit.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = bucket_of(F.col("doc_id"), 5) == 0
    model = fit(docs.filter(~held_out))
    scored = predict(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
