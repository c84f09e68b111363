"""MinHash near-dedup with HyperMinHash sketches.

A document is its set of distinct word shingles, hashed to 64 bits. A sketch has REGISTERS buckets; each keeps, of the least
hash that falls into it, the number of leading zeros and MANTISSA bits that follow (two bytes). Empty buckets borrow from a
fixed order of other buckets, alike for all documents. Bands of ROWS registers bring candidates together; a collision-
corrected estimate from the registers discards the hopeless, and full sets confirm every link.

Documents with equal sets are one class from the start. Within a band's bucket members are first held against one centre
rather than each other. Buckets whose members then still lie in different components are compared in blocks, block by
block within tasks, and only links that join components come out. So a group of thousands of copies costs a row a band,
pairs are never emitted, and no link between components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit
from .components import components

BANDS, ROWS = 32, 5
REGISTERS, MANTISSA = BANDS * ROWS, 10
#: Standard deviations that an estimate may lie below the threshold without being discarded.
SLACK = 5.0
#: Members of a bucket that meet in one task at most, when they are compared across components.
BLOCK = 512

_rank = np.argsort(np.random.default_rng(11).random((REGISTERS, REGISTERS)), axis=1)
_rank = np.argsort(_rank, axis=1)  # the place of bucket j in the order from which bucket i borrows


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text; a text of fewer words gives one hash of them all."""
    buf = textkit.LOWER[buf]
    start, end = textkit.runs_of(~textkit.SPACE[buf], offsets)
    hashes = textkit.span_hashes(textkit.prefix_sums(buf), start, end)
    first = np.searchsorted(start, offsets)  # of each text's words
    rolled = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for j in range(words):
        rolled = textkit.mix(rolled * np.uint64(textkit.PRIME) + hashes[j : j + len(rolled)])
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            short = np.array([len(hashes[a:b])], np.uint64)
            for h in hashes[a:b]:
                short = textkit.mix(short * np.uint64(textkit.PRIME) + h)
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a non-empty sorted set of hashes."""
    scaled = (hashes >> np.uint64(32)) * np.uint64(REGISTERS)
    bucket = (scaled >> np.uint64(32)).astype(np.int64)
    filled, first = np.unique(bucket, return_index=True)
    least = ((scaled[first] & np.uint64(0xFFFFFFFF)) << np.uint64(32) | (hashes[first] & np.uint64(0xFFFFFFFF))).astype(np.float64)
    fraction, exponent = np.frexp(least)
    register = ((64 - exponent) << MANTISSA) + np.where(least > 0, (fraction * 2 - 1) * (1 << MANTISSA), 0).astype(np.int64)
    out = np.full(REGISTERS, -1, np.int64)
    out[filled] = register
    if len(filled) < REGISTERS:
        empty = np.flatnonzero(out < 0)
        out[empty] = register[_rank[np.ix_(empty, filled)].argmin(1)]
    return out.astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of rows of registers, less the share of registers that agree by chance at these set sizes."""
    agree = (a == b).mean(1)
    zeros = np.arange(60)
    octave = lambda n: np.exp(-n[:, None] / REGISTERS * 2.0 ** -(zeros + 1)) - np.exp(-n[:, None] / REGISTERS * 2.0**-zeros)
    chance = np.minimum(0.5, (octave(n_a) * octave(n_b)).sum(1) / (1 << MANTISSA))
    return np.maximum(0, (agree - chance) / (1 - chance))


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, row, n_shingles, s1, s2, registers) of every text; row: its key, s1 and s2 identify the set, null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in textkit.text_slices(batch.column(2)):
                sets = shingle_sets(buf, offsets, words)
                s1 = [int((textkit.mix(s).sum() + np.uint64(len(s))).astype(np.int64)) if len(s) else None for s in sets]
                s2 = [int(np.bitwise_xor.reduce(textkit.mix(s ^ np.uint64(textkit.PRIME))).astype(np.int64)) if len(s) else None for s in sets]
                registers = [sketch(s).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(registers, pa.binary())],
                    ["doc_id", "row", "n_shingles", "s1", "s2", "registers"],
                )

    return docs.select(F.col("doc_id").cast("long"), textkit.row_key().alias("row"), "text").mapInArrow(run, "doc_id long, row binary, n_shingles long, s1 long, s2 long, registers binary")


def _band_keys(classes: DataFrame) -> DataFrame:
    """(key, node): a row for each class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                rows = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
                key = np.arange(BANDS, dtype=np.uint64) + np.uint64(1) + np.zeros((len(rows), 1), np.uint64)
                for j in range(ROWS):
                    key = textkit.mix(key * np.uint64(textkit.PRIME) + rows[:, :, j])
                node = np.repeat(part.column(0).to_numpy(zero_copy_only=False), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().astype(np.int64)), pa.array(node)], ["key", "node"])

    return classes.select("node", "registers").mapInArrow(run, "key long, node long")


def _promising(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and registers leave it possible that they are similar enough."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("registers").alias(f"r_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent).select("a", "b", "r_a", "r_b", "n_a", "n_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            r = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("r_a", "r_b")]
            n = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b")]
            share = percent / 100
            floor = share - SLACK * np.sqrt(share * (1 - share) / np.minimum(REGISTERS, np.minimum(*n)))
            kept = pa.array(np.flatnonzero(estimate(*r, *n) >= floor))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(kept), batch.column("b").take(kept)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, set): the full sets of nodes, read from the whole texts of a document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, offsets in textkit.text_slices(batch.column(0)):
                own = [s for s in shingle_sets(buf, offsets, words) if len(s)]
                s1 = [int((textkit.mix(s).sum() + np.uint64(len(s))).astype(np.int64)) for s in own]
                yield pa.RecordBatch.from_arrays([pa.array(s1, pa.int64()), pa.array([s.tobytes() for s in own], pa.binary())], ["node", "set"])

    ids = classes.join(nodes, "node", "left_semi").select("doc_id").distinct()
    return docs.select(F.col("doc_id").cast("long"), "text").join(ids, "doc_id", "left_semi").select("text").mapInArrow(run, "node long, set binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("set").alias(f"s_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for i, (x, y) in enumerate(zip(batch.column("s_a"), batch.column("s_b"), strict=True)):
                p, q = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                common = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * common >= percent * (len(p) + len(q) - common):
                    kept.append(i)
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], ["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long").distinct()


def bridges(block: pa.Table, percent: int) -> pa.Table:
    """Links (a, b) between components of one block of a bucket, as many as join them and no more.

    Intersections of full sets are counted through the lists of who has a hash; no pair leaves the task but a link.
    """
    node, first = np.unique(block.column("node").to_numpy(), return_index=True)
    component = block.column("component").to_numpy()[first].tolist()
    sets = [np.frombuffer(block.column("set")[int(k)].as_buffer(), np.uint64) for k in first]
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owners, start = owner[np.argsort(place, kind="stable")], np.cumsum(count) - count
    edge = np.cumsum(sizes) - sizes
    parent = {c: c for c in component}

    def find(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    a, b = [], []
    for i in range(len(node)):
        roots = [find(c) for c in component]
        if len(set(roots)) == 1:
            break
        own = place[edge[i] : edge[i] + sizes[i]]
        n = count[own]
        at = np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.bincount(owners[at], minlength=len(node))
        for j in np.flatnonzero(100 * common >= percent * (sizes + sizes[i] - common)):
            x, y = find(component[i]), find(component[j])
            if x != y:
                parent[max(x, y)] = min(x, y)
                a.append(max(int(node[i]), int(node[j])))
                b.append(min(int(node[i]), int(node[j])))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _links(docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame | None:
    """(node, component) of the classes that have a link to another; None if none has."""
    members = textkit.written(_band_keys(classes), "bands")
    shared = members.groupBy("key").agg(F.count("*").alias("_n"), F.min("node").alias("_centre")).filter("_n > 1")
    members = textkit.written(members.join(shared, "key").select("key", "node", "_n", "_centre"), "bands")
    stars = members.filter("node != _centre").select(F.col("node").alias("a"), F.col("_centre").alias("b")).distinct()
    stars = textkit.written(_promising(stars, classes, percent), "pairs")
    sets = _sets(docs, classes, stars.select(F.col("a").alias("node")).union(stars.select("b")).distinct(), words)
    sets = textkit.written(sets, "sets")  # else sets and pairs are made in one task, by two workers a core, and sets twice
    edges = textkit.written(_confirmed(stars, sets, percent), "edges")
    found = textkit.written(components(edges), "components")
    members = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = members.groupBy("key").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).filter("_low != _high").select("key")
    blocks = F.ceil(F.col("_n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    meets = F.transform(F.sequence(F.lit(0), blocks - 1), lambda x: F.struct(F.least(own, x).alias("i"), F.greatest(own, x).alias("j")))
    open_ = textkit.written(members.join(mixed, "key", "left_semi").select("key", "node", "component", F.explode(meets).alias("at")), "bands")
    sets = textkit.written(_sets(docs, classes, open_.select("node").distinct(), words).dropDuplicates(["node"]), "sets")
    more = open_.join(sets, "node").groupBy("key", "at").applyInArrow(lambda t: bridges(t, percent), "a long, b long").distinct()
    more = textkit.written(more, "edges")
    return found if more.isEmpty() else textkit.written(components(edges.union(more)), "components")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, rows: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of (doc_id, text); rows: also `row`, its textkit.row_key, and
    `component`, a number that rows have in common if and only if their texts are linked (null where they link with nothing).

    Words are what white space (space, tab to carriage return) separates, A-Z lower-cased. Texts that are null or have no word have an empty set and
    link with nothing: they are their own component. So are rows with null doc_id, whose component_id is null and which are
    kept. Rows that share a doc_id and a text are one class; all rows whose doc_id is the component's smallest are kept.
    """
    own = textkit.written(sketches(docs, words), "sketches")
    classes = own.filter("s1 is not null and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"), F.count("*").alias("_n"))
    classes = textkit.written(classes.withColumnRenamed("s1", "node"), "classes")
    found = _links(docs, classes, words, percent)
    of = classes.select(F.col("node").alias("s1"), "s2", F.col("doc_id").alias("_least"), F.col("node").alias("_group"), "_n")
    if found is not None:
        linked = of.drop("_group").join(found, of.s1 == found.node, "left").drop("node").withColumn("_group", F.coalesce("component", "s1"))
        least = linked.filter("component is not null").groupBy("component").agg(F.min("_least").alias("_lowest"))
        of = linked.join(least, "component", "left").select("s1", "s2", F.coalesce("_lowest", "_least").alias("_least"), "_group", "_n")
    usable = F.col("s1").isNotNull() & F.col("doc_id").isNotNull()
    joined = textkit.spread_join(own.filter(usable).select("doc_id", "row", "n_shingles", "s1", "s2"), textkit.written(of, "components-of"), ["s1", "s2"])
    alone = own.filter(~usable).select("doc_id", "row", "n_shingles", "s1", "s2", F.lit(None).cast("long").alias("_least"), F.lit(None).cast("long").alias("_group"))
    joined = joined.unionByName(alone)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_least", "doc_id"))
    further = ("row", F.when(F.col("doc_id").isNotNull(), F.col("_group")).alias("component")) if rows else ()
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), *further)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(textkit.table(spark, sf_dir, "documents"), words=2, percent=80)
