"""Embedding near-dedup by product quantisation.

A bounded sample trains coarse centroids and, for the residuals, a codebook in each of SUBSPACES subspaces. Every distinct
vector stands in one inverted list with its residual's codes and their error. As a query it visits the PROBES nearest lists,
where table look-ups give its distance to every decoded vector; what lies farther than the threshold plus the entry's own
error can't be a link, and the rest is compared exactly in double precision.

There are about as many lists as the root of the number of vectors. Beyond COARSE of them each coarse centroid's list is
split by FINE centroids of the residuals, so that lists grow with the table though the sample does not.

Pairs never leave a task. A task counts the links of each vector in its block, and of the links gives out as many as tie the
block together. A pair that both vectors find as queries is counted once: the entry's count takes a link only if the
entry's own probes miss the query's list.

Vectors are compared with vectors of their length, and each length has an index of its own. One of more than RARE distinct
vectors is trained from a sample, placed and compared as tables; so the lengths that are common are a driver's loop, of at most a
step for RARE vectors. One of RARE vectors or fewer has no more lists than probes: a task trains it, and it loses nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit
from .components import components

COSINE = 0.95
#: Vectors that train an index at most, chosen by a hash.
SAMPLE_ROWS = 16_000
#: Coarse centroids at most, finer ones for all of their lists at most, and lists that a query visits.
COARSE, FINE, PROBES = 1024, 1024, 16
SUBSPACES, CODES = 16, 256
#: Vectors of a length up to which a task trains and searches its index.
RARE = PROBES * PROBES
#: Entries and queries that meet in one task at most; a longer list is split into blocks.
BLOCK_ENTRIES, BLOCK_QUERIES = 4096, 16_384
#: Decoded distances that a step of a task holds.
STEP = 256


def _means(x: np.ndarray, k: int, steps: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(steps):
        own = nearest(x, centres)
        count = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        for d in range(x.shape[1]):
            total[:, d] = np.bincount(own, weights=x[:, d], minlength=len(centres))
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres**2).sum(1)
    return np.concatenate([(half - x[i : i + 4096] @ centres.T).argmin(1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


@dataclass
class Index:
    coarse: np.ndarray  # centroids x dimension
    fine: np.ndarray  # of the residuals; a list is coarse number x len(fine) + fine number
    books: list[np.ndarray]  # of each subspace: codes x its dimensions
    cuts: list[slice]

    def centre(self, cell: np.ndarray) -> np.ndarray:
        return self.coarse[cell // len(self.fine)] + self.fine[cell % len(self.fine)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, error) of unit vectors."""
        own = nearest(x, self.coarse)
        residual = x - self.coarse[own]
        inner = nearest(residual, self.fine)
        residual -= self.fine[inner]
        codes = np.stack([nearest(residual[:, c], b) for c, b in zip(self.cuts, self.books, strict=True)], 1)
        decoded = np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], 1)
        return own * len(self.fine) + inner, codes.astype(np.uint8), np.linalg.norm(residual - decoded, axis=1)

    def probes(self, x: np.ndarray) -> np.ndarray:
        """The nearest lists of each vector, among those of its nearest coarse centroids."""
        n = min(PROBES, len(self.coarse))
        distance = (self.coarse**2).sum(1) - 2 * x @ self.coarse.T
        near = np.argpartition(distance, n - 1, axis=1)[:, :n]
        if len(self.fine) == 1:
            return near
        cross = 2 * (self.coarse[near] @ self.fine.T) - 2 * (x @ self.fine.T)[:, None, :] + (self.fine**2).sum(1)
        total = (np.take_along_axis(distance, near, 1)[:, :, None] + cross).reshape(len(x), -1)
        cells = (near[:, :, None] * len(self.fine) + np.arange(len(self.fine))).reshape(len(x), -1)
        return np.take_along_axis(cells, np.argpartition(total, PROBES - 1, axis=1)[:, :PROBES], 1)

    def distances(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Queries x entries: distance of each query to each decoded entry of the list, from tables."""
        residual, total = q - self.centre(np.array([cell])), np.zeros((len(q), len(codes)))
        for m, (c, book) in enumerate(zip(self.cuts, self.books, strict=True)):
            part = residual[:, c]
            tables = (part**2).sum(1)[:, None] - 2 * part @ book.T + (book**2).sum(1)
            total += tables[:, codes[:, m]]
        return np.sqrt(np.maximum(total, 0))


def train(x: np.ndarray, rows: int) -> Index:
    """An index of unit vectors x for a table of so many rows."""
    rng = np.random.default_rng(5)
    lists = max(1, math.isqrt(rows))
    coarse = _means(x, min(COARSE, lists), 8, rng)
    residual = x - coarse[nearest(x, coarse)]
    fine = np.zeros((1, x.shape[1])) if lists <= COARSE else _means(residual, min(FINE, -(-lists // COARSE)), 6, rng)
    residual -= fine[nearest(residual, fine)]
    parts = np.array_split(np.arange(x.shape[1]), min(SUBSPACES, x.shape[1]))
    cuts = [slice(int(p[0]), int(p[-1]) + 1) for p in parts]
    return Index(coarse, fine, [_means(residual[:, c], CODES, 6, rng) for c in cuts], cuts)


def vectors(table: DataFrame) -> DataFrame:
    """(vec_id, v, dim, h1, h2): bytes of each usable vector (4 a component of a float column, else 8), its length and two hashes; null for others.

    Not usable are vectors that are null, empty, zero, or hold null or non-finite components.
    """
    narrow = isinstance(table.schema["embedding"].dataType, T.ArrayType) and isinstance(table.schema["embedding"].dataType.elementType, T.FloatType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, dim, h1, h2 = [], [], [], []
            for value in batch.column(1):
                own = value.values
                x = np.zeros(0) if own is None or own.null_count else own.to_numpy(zero_copy_only=False).astype(np.float64)
                if len(x) and np.isfinite(x).all() and np.linalg.norm(x) > 0:
                    x = x + 0.0  # no negative zero
                    words = textkit.mix(x.view(np.uint64))
                    place = textkit.powers(len(x))
                    out.append(x.astype(np.float32).tobytes() if narrow else x.tobytes())
                    dim.append(len(x))
                    h1.append(int((textkit.mix(words + place).sum()).astype(np.int64)))
                    h2.append(int((textkit.mix(words ^ (place * np.uint64(3))).sum()).astype(np.int64)))
                else:
                    out.append(None), dim.append(None), h1.append(None), h2.append(None)
            columns = [batch.column(0), pa.array(out, pa.binary()), pa.array(dim, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "v", "dim", "h1", "h2"])

    kind = "array<float>" if narrow else "array<double>"
    return table.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind)).mapInArrow(run, "vec_id long, v binary, dim int, h1 long, h2 long")


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of one length, scaled to length 1 in double precision."""
    raw = b"".join(column.to_pylist())
    x = np.frombuffer(raw, np.float32 if len(raw) == 4 * dim * len(column) else np.float64).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(classes: DataFrame, rows: int, dim: int) -> Index:
    """An index from SAMPLE_ROWS rows of (node, v) at most, which the driver gets."""
    sample = classes.orderBy(F.xxhash64("node", F.lit(1)), "node").limit(SAMPLE_ROWS).select("v").toArrow()
    return train(_unit(sample.column("v").combine_chunks(), dim), rows)


_PLACED = "cell long, query boolean, node long, v binary, copies long, codes binary, error double, probes binary"


def _placed(part: pa.RecordBatch, index: Index, dim: int) -> pa.RecordBatch:
    """_PLACED of rows (node, v, copies)."""
    x = _unit(part.column(1), dim)
    cell, codes, error = index.encode(x)
    probes = index.probes(x).astype(np.int64)
    row = np.repeat(np.arange(len(x)), probes.shape[1])
    take = pa.array(np.concatenate([np.arange(len(x)), row]))
    entry, none = np.arange(len(x)), [None] * len(row)
    # a query carries its own list, an entry the lists that it visits itself
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([cell, probes.ravel()])), pa.array(np.concatenate([np.zeros(len(x), bool), np.ones(len(row), bool)])), *(part.column(c).take(take) for c in range(3)),
         pa.array([codes[k].tobytes() for k in entry] + none, pa.binary()), pa.array(np.concatenate([error, np.zeros(len(row))])),
         pa.array([probes[k].tobytes() for k in entry] + [np.int64(cell[k]).tobytes() for k in row], pa.binary())],
        ["cell", "query", "node", "v", "copies", "codes", "error", "probes"],
    )


def _place(classes: DataFrame, index: Index, dim: int) -> DataFrame:
    """_PLACED: each vector as entry of its list and as query of those it visits."""
    shared = classes.sparkSession.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                yield _placed(batch.slice(at, 2048), shared.value, dim)

    return classes.select("node", "v", "copies").mapInArrow(place, _PLACED)


def tie(label: np.ndarray, close: np.ndarray, own: np.ndarray) -> list[tuple[int, int]]:
    """(query, entry) links that tie a step's queries to the entries' trees; label: each entry's tree, changed in place.

    close: queries x entries. own: of each query the entry that is itself, or -1. As many links as trees are met.
    """
    out = []
    for q in np.flatnonzero(close.any(1)):
        met = np.flatnonzero(close[q])
        trees, first = np.unique(label[met], return_index=True)
        if own[q] < 0:
            out += [(q, e) for e in met[first]]
        elif len(trees) > 1 or trees[0] != label[own[q]]:
            out += [(q, e) for t, e in zip(trees, met[first], strict=True) if t != label[own[q]]]
            trees = np.append(trees, label[own[q]])
        if len(trees) > 1:
            label[np.isin(label, trees)] = trees.min()
    return out


def compare(block: pa.Table, index: Index, dim: int) -> pa.Table:
    """(node, links, a, b): counts of links by node (a null), and links a > b that tie the block together (node null)."""
    kind = block.column("query").combine_chunks()
    q, e = block.filter(kind), block.filter(pa.compute.invert(kind))
    counted: list[tuple[np.ndarray, np.ndarray]] = []
    tied: list[tuple[int, int]] = []
    if q.num_rows and e.num_rows:
        x, cell = _unit(e.column("v").combine_chunks(), dim), e.column("cell")[0].as_py()
        e_node, e_copies, q_node, q_copies = (t.column(c).to_numpy() for t in (e, q) for c in ("node", "copies"))
        back = np.zeros(len(e_node), np.int64)
        label, place = np.arange(len(e_node)), {int(n): k for k, n in enumerate(e_node)}
        codes = np.frombuffer(b"".join(e.column("codes").to_pylist()), np.uint8).reshape(e.num_rows, -1)
        reach = math.sqrt(2 - 2 * COSINE) + e.column("error").to_numpy() + 1e-6
        visits = np.frombuffer(b"".join(e.column("probes").to_pylist()), np.int64).reshape(e.num_rows, -1)
        home = np.frombuffer(b"".join(q.column("probes").to_pylist()), np.int64)
        for at in range(0, q.num_rows, STEP):
            y, own = _unit(q.column("v").slice(at, STEP).combine_chunks(), dim), np.array([place.get(int(n), -1) for n in q_node[at : at + STEP]])
            i, j = np.nonzero(index.distances(y, cell, codes) <= reach)
            near = np.einsum("nd,nd->n", y[i], x[j]) >= COSINE
            close = np.zeros((len(y), len(x)), dtype=bool)
            close[i[near], j[near]] = True
            close[np.flatnonzero(own >= 0), own[own >= 0]] = False
            n = np.arange(at, at + len(y))
            counted.append((q_node[n], close @ e_copies))
            for k in np.unique(home[n]):
                missed = ~(visits == k).any(1)
                rows = home[n] == k
                back += np.where(missed, q_copies[n][rows] @ close[rows], 0)
            tied += [(int(q_node[at + i]), int(e_node[j])) for i, j in tie(label, close, own)]
        counted.append((e_node, back))
    node, links = (np.concatenate([c[k] for c in counted] or [np.zeros(0, np.int64)]) for k in (0, 1))
    some = links > 0
    node, links, none, free = node[some], links[some], [None] * len(tied), [None] * int(some.sum())
    return pa.table({
        "node": pa.array([*node.tolist(), *none], pa.int64()), "links": pa.array([*links.tolist(), *none], pa.int64()),
        "a": pa.array([*free, *(max(t) for t in tied)], pa.int64()), "b": pa.array([*free, *(min(t) for t in tied)], pa.int64()),
    })


_FOUND = "node long, links long, a long, b long"


def _meet(placed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Entries and queries of each list in blocks (cell, _eb, _qb); sizes: (cell, _q, _e)."""
    blocks = lambda size, most: F.greatest(F.lit(1), F.ceil(F.col(size) / most)).cast("int")
    own = lambda size, most: F.pmod(F.xxhash64("node"), blocks(size, most)).cast("int")
    every = lambda size, most: F.sequence(F.lit(0), blocks(size, most) - 1)
    one = lambda size, most: F.array(own(size, most))
    both = placed.join(sizes, "cell")
    both = both.withColumn("_eb", F.explode(F.when(F.col("query"), every("_e", BLOCK_ENTRIES)).otherwise(one("_e", BLOCK_ENTRIES))))
    both = both.withColumn("_qb", F.explode(F.when(F.col("query"), one("_q", BLOCK_QUERIES)).otherwise(every("_q", BLOCK_QUERIES))))
    return both.drop("_q", "_e")


def links(classes: DataFrame, rows: int, dim: int) -> DataFrame:
    """_FOUND of the classes (node, v, copies) of one length by an index of their own."""
    index = fit(classes, rows, dim)
    shared = classes.sparkSession.sparkContext.broadcast(index)
    placed = textkit.written(_place(classes, index, dim), "index")
    sizes = placed.groupBy("cell").agg(F.count_if("query").alias("_q"), F.count_if(~F.col("query")).alias("_e"))
    # a row a list; lists are at most COARSE * FINE and about the root of the rows
    sizes = F.broadcast(sizes) if len(index.coarse) * len(index.fine) <= 1 << 17 else sizes
    return _meet(placed, sizes).groupBy("cell", "_eb", "_qb").applyInArrow(lambda t: compare(t, shared.value, dim), _FOUND)


def rare_links(classes: DataFrame) -> DataFrame:
    """_FOUND of classes (node, v, copies, dim) whose lengths have RARE vectors at most: an index a length, within a task."""

    def search(own: pa.Table) -> pa.Table:
        dim = own.column("dim")[0].as_py()
        own = own.sort_by("node").combine_chunks().to_batches()[0].select(["node", "v", "copies"])
        index = train(_unit(own.column(1), dim), own.num_rows)
        placed = pa.Table.from_batches([_placed(own, index, dim)])
        return pa.concat_tables([compare(placed.filter(pa.compute.equal(placed.column("cell"), k)), index, dim) for k in range(len(index.coarse))])

    return classes.select("dim", "node", "v", "copies").groupBy("dim").applyInArrow(search, _FOUND)


def near_duplicates(table: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding); other columns are left out.

    Equal vectors are one class, linked with one another; vectors of different lengths link with nothing of each other.
    Vectors that are not usable (see `vectors`) link with nothing. A null vec_id takes no part: component_id null, kept.
    Rows that share a vec_id are vectors of their own and have a row each.
    """
    own = textkit.written(vectors(table), "vectors")
    usable = own.filter("v is not null and vec_id is not null")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("_least", "vec_id"))
    classes = usable.groupBy("h1", "h2").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("v").alias("v"), F.first("dim").alias("dim"))
    classes = textkit.written(classes.withColumnRenamed("h1", "node"), "classes")
    sizes = classes.groupBy("dim").agg(F.count("*").alias("_rows"))
    common = sizes.filter(F.col("_rows") > RARE).orderBy("dim").collect()  # at most one for RARE vectors
    found = rare_links(classes.join(sizes.filter(F.col("_rows") <= RARE).select("dim"), "dim", "left_semi"))
    for size in common:
        found = found.union(links(classes.filter(F.col("dim") == size["dim"]), size["_rows"], size["dim"]))
    found = textkit.written(found, "links")
    others = found.filter("node is not null").groupBy("node").agg(F.sum("links").alias("_others"))
    groups = components(found.filter("a is not null").select("a", "b"))
    of = classes.select("node", "h2", "first", "copies").join(others, "node", "left").join(groups, "node", "left")
    of = textkit.written(of.withColumn("component", F.coalesce("component", "node")), "classes")
    lowest = of.groupBy("component").agg(F.min("first").alias("_least"), F.count("*").alias("_n"))
    of = textkit.spread_join(of, textkit.written(lowest, "least"), ["component"])
    of = of.select(F.col("node").alias("h1"), "h2", (F.col("copies") - 1 + F.coalesce("_others", F.lit(0))).alias("_links"), "_least")
    ids = own.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("h1")).alias("h1"), "h2")
    joined = ids.join(of, ["h1", "h2"], "left")
    return joined.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(textkit.table(spark, sf_dir, "embeddings"))
