"""Mixing sources to target weights by pivotal dependent rounding.

1. Targets. Sources in order weigh WEIGHTS, repeating, and share all words; a source stops at MOST_COPIES times its size, the
   excess is reshared by weight until no source is above. A step of that is one sum over the table of sources.
2. A document of a source is to be copied target / source size times: the whole part is sure, the rest is a probability p.
3. Pivotal rounding. Two sides with open p trade words: the one gets what the other gives, and a coin tells the direction,
   weighed so that neither p changes in the mean. Each trade ends with one of them at 0 or 1, and the words of both together,
   size * p, stay what they were. In a leaf the longest open document trades with all shorter ones as the other side, which
   share one p; so long documents settle first and what stays open is short.
4. Reduction tree. Documents are dealt to leaves by a hash within their source, so a large source is many leaves. A leaf leaves
   at most one document open; up the tree FAN such documents trade two by two in a node, until a source has one, which is drawn
   by its p. A source misses its target by less than the words of that document.

Coins come from the ids of leaf and node, so a rerun gives the same mix however its tasks were cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit

WEIGHTS, MOST_COPIES = (5, 2, 1), 3
WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a leaf, about, and open documents that trade in a node.
LEAF, FAN = 4096, 1024
#: Probabilities so near to 0 or 1 count as whole.
NEAR = 1e-9

_DOC = "doc_id long, source string, size long, source_size long, target double, copies int, p double, source_id long, node long, draw long"


def _ranked(sources: DataFrame) -> DataFrame:
    """sources (source, ...) with `source_id`, their place from 0 by code point, null last: sorted by ranges, each range counted on."""
    ordered = textkit.written(sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = sorted((r["_range"], r["count"]) for r in ordered.groupBy("_range").count().collect())  # a row a range
    before, starts = 0, []
    for k, n in sizes:
        starts.append((k, before))
        before += n
    own = F.row_number().over(Window.partitionBy("_range").orderBy(F.col("source").asc_nulls_last()))
    known = ordered.sparkSession.createDataFrame(starts, "_range int, _start long")
    return ordered.join(F.broadcast(known), "_range").withColumn("source_id", F.col("_start") + own - 1).drop("_range", "_start")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, ..., source_id, target) of sources (source, source_size): words that the mix takes of each."""
    own = _ranked(sources)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_id") % len(weights) + 1).cast("int"))
    own = textkit.written(own.withColumn("_weight", weight), "sources")
    whole = "decimal(38,0)"
    size, capped = F.col("source_size").cast(whole), F.lit(False)
    total = int(own.agg(F.sum(size)).head()[0] or 0)
    words, share = total, int(own.agg(F.sum("_weight")).head()[0] or 0)
    while True:  # every step caps a source at least; a few do in practice
        above = size * most * share < F.col("_weight").cast(whole) * F.lit(words).cast(whole) if share else F.lit(False)
        taken = own.filter(above).agg(F.sum(size * most), F.sum("_weight")).head()
        left, rest = total - int(taken[0] or 0), int(own.agg(F.sum("_weight")).head()[0] or 0) - int(taken[1] or 0)
        if (left, rest) == (words, share):
            capped = above
            break
        words, share = left, rest
    level = words / share if share else 0.0
    target = F.when(capped, (F.col("source_size") * most).cast("double")).otherwise(F.col("_weight") * F.lit(level))
    return own.withColumn("target", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(target)).drop("_weight")


def _moved(size: float, p: float, others: float, q: float, draw: float) -> float:
    """Words that others (of p `q`) get from a document of p, below 0 if it gets them; one side ends at 0 or 1."""
    out, back = min(p * size, (1 - q) * others), min((1 - p) * size, q * others)
    return out if draw * (out + back) < back else -back


def _settled(p: float) -> bool:
    return not NEAR < p < 1 - NEAR


def _settle(size: np.ndarray, p: np.ndarray, coin: np.random.Generator) -> None:
    """Pivotal rounding of p in place, one value for all, over documents from the longest to the shortest."""
    rest, draws, q = np.cumsum(size[::-1])[::-1] - size, coin.random(len(p)), float(p[0])
    for k in range(len(p)):
        if _settled(q):
            p[k:] = round(q)
            return
        if k == len(p) - 1:
            p[k] = q
            return
        moved = _moved(size[k], q, rest[k], q, draws[k])
        p[k], q = q - moved / size[k], q + moved / rest[k]
        if _settled(p[k]):
            p[k] = round(p[k])
        else:
            q = round(q)


def _trade(size: np.ndarray, p: np.ndarray, coin: np.random.Generator) -> None:
    """Pivotal rounding of p in place, two by two; at most one document stays open."""
    held, draws = -1, coin.random(len(p))
    for k in range(len(p)):
        if held >= 0:
            moved = _moved(size[held], p[held], size[k], p[k], draws[k])
            p[held] -= moved / size[held]
            p[k] += moved / size[k]
            if not _settled(p[held]):
                p[k] = round(p[k])
                continue
            p[held] = round(p[held])
        held = -1 if _settled(p[k]) else k
        if held < 0:
            p[k] = round(p[k])


def _rounded(own: pa.Table, leaf: bool) -> pa.Table:
    """The documents of a leaf or a node of a source after their trades."""
    keys = [own.column("draw").to_numpy(), own.column("doc_id").fill_null(0).to_numpy(), -own.column("size").to_numpy()]
    own = own.take(pa.array(np.lexsort(keys)))
    size, p = own.column("size").to_numpy().astype(float), own.column("p").to_numpy().copy()
    seed = [int(own.column(c)[0].as_py()) for c in ("source_id", "node")]
    coin = np.random.default_rng([*seed, own.num_rows, int(own.column("draw").to_numpy().view(np.uint64).sum())])
    (_settle if leaf else _trade)(size, p, coin)
    return own.set_column(own.schema.get_field_index("p"), "p", pa.array(p))


def _open() -> Column:
    return (F.col("p") > 0) & (F.col("p") < 1)


def rounded(docs: DataFrame) -> DataFrame:
    """docs (_DOC) with p rounded to 0 or 1; `node` is a document's leaf in its source. Each level of the tree is a written table."""
    done, level, leaf = [docs.filter(~_open())], docs.filter(_open()), True
    while True:
        step = (lambda t: _rounded(t, True)) if leaf else (lambda t: _rounded(t, False))
        level, leaf = textkit.written(level.groupBy("source_id", "node").applyInArrow(step, _DOC), "nodes"), False
        done.append(level.filter(~_open()))
        left = level.filter(_open())
        most = left.groupBy("source_id").agg(F.count("*").alias("n")).agg(F.max("n")).head()[0] or 0
        if most <= 1:
            break
        level = left.withColumn("node", F.expr(f"node div {FAN}"))
    last = left.withColumn("p", (F.pmod(F.xxhash64("source_id", "draw"), F.lit(1 << 30)) / (1 << 30) < F.col("p")).cast("double"))
    out = last
    for part in done:
        out = out.unionByName(part)
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of each row of docs (doc_id, source, text).

    Null texts and texts without a word have size 0 and take nothing; a null source is a source of its own, after all others; a
    source without words has target 0. Repeated rows and rows that share a doc_id are documents of their own; other columns are
    left out; an empty table gives no rows. Targets add up to all words, a document is taken 0 to `most` times.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("doc_id", "text").alias("draw"))
    own = textkit.written(own.select("*", F.col("source").isNotNull().alias("_named"), F.coalesce("source", F.lit("")).alias("_key")), "sizes")
    sources = own.groupBy("source", "_named", "_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    sources = textkit.written(targets(sources, weights, most).withColumn("_docs", F.col("_n")), "targets")
    joined = textkit.spread_join(own, sources.drop("source"), ["_named", "_key"], "_n")
    rate = F.when(F.col("size") == 0, F.lit(0.0)).otherwise(F.least(F.col("target") / F.col("source_size"), F.lit(float(most))))
    joined = joined.withColumn("_rate", rate).withColumn("copies", F.floor("_rate").cast("int")).withColumn("p", F.col("_rate") - F.col("copies"))
    leaves = F.greatest(F.lit(1), F.ceil(F.col("_docs") / LEAF)).cast("long")
    ready = textkit.written(joined.select("doc_id", "source", "size", "source_size", "target", "copies", "p", "source_id", F.pmod("draw", leaves).alias("node"), "draw"), "shares")
    whole = rounded(ready).withColumn("copies", F.col("copies") + F.round("p").cast("int"))
    return whole.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`mix` of the whole table documents."""
    return mix(textkit.table(spark, sf_dir, "documents"))
