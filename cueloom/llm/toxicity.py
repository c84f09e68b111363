"""Toxicity by a factorization machine over hashed terms.

Terms are whole words and their first 4 and 5 bytes, lower-cased and hashed; a document has a term or not. Beside a weight
a term has a vector of FACTORS numbers, and two terms of one document add the product of their vectors, so that an insult
beside a group's name can weigh more than both apart. The machine is fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit
from .langid import bucket_of

#: Labelled rows of either class that a fit takes at most, chosen by a hash.
CLASS_ROWS = 4000
BITS = 16
#: Terms that the machine keeps: those that tell the classes apart by a chi-squared of LEAST_CHI, which about one in 65,536
#: idle terms would reach, best first; then the most frequent others, since a term that tells nothing alone may beside another.
TERMS, LEAST_CHI = 2048, 18.0
FACTORS = 8
STEPS, RATE, PENALTY = 300, 0.05, 5e-5
THRESHOLD = 0.7

WORD = np.zeros(256, dtype=bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every term of the texts in buf."""
    buf = textkit.LOWER[buf]
    start, end = textkit.runs_of(WORD[buf], offsets)
    sums = textkit.prefix_sums(buf)
    row = np.searchsorted(offsets, start, side="right") - 1
    found = [(row, textkit.span_hashes(sums, start, end))]
    for n in (4, 5):
        long = end - start > n
        found.append((row[long], textkit.span_hashes(sums, start[long], start[long] + n, salt=n)))
    return np.concatenate([r for r, _ in found]), (np.concatenate([h for _, h in found]) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Machine:
    slot: np.ndarray  # by bucket: the term's place among those kept, or -1
    bias: float
    weight: np.ndarray
    factors: np.ndarray

    def score(self, row: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        place = self.slot[bucket]
        kept = place >= 0
        pairs = np.unique(row[kept] * TERMS + place[kept])
        row, place = pairs // TERMS, pairs % TERMS
        raw = self.bias + np.bincount(row, weights=self.weight[place], minlength=n)
        for v in self.factors.T:
            own = v[place]
            raw += 0.5 * (np.bincount(row, weights=own, minlength=n) ** 2 - np.bincount(row, weights=own * own, minlength=n))
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def train(bags: list[np.ndarray], toxic: np.ndarray, prior: float) -> Machine:
    """bags: the distinct buckets of each row; prior: share of toxic rows among all labelled ones."""
    sizes = [len(b) for b in bags]
    row, bucket = np.repeat(np.arange(len(bags)), sizes), np.concatenate([*bags, np.zeros(0, np.int64)]).astype(np.int64)
    n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    with1 = np.bincount(bucket[toxic[row]], minlength=1 << BITS)
    with0 = np.bincount(bucket[~toxic[row]], minlength=1 << BITS)
    p = (with1 + with0) / (n1 + n0)
    chi = (with1 / n1 - with0 / n0) ** 2 / np.maximum(p * (1 - p), 1e-9) * (n1 * n0 / (n1 + n0))
    chi[with1 + with0 < 3] = 0
    best = np.argsort(-chi, kind="stable")[:TERMS]
    best = best[chi[best] >= LEAST_CHI]
    spread = p * (1 - p)
    spread[best] = 0
    more = np.argsort(-spread, kind="stable")[: TERMS - len(best)]
    best = np.append(best, more[(spread[more] > 0) & ((with1 + with0)[more] >= 3)])
    slot = np.full(1 << BITS, -1, dtype=np.int64)
    slot[best] = np.arange(len(best))
    x = np.zeros((len(bags), len(best)), np.float32)
    kept = slot[bucket] >= 0
    x[row[kept], slot[bucket[kept]]] = 1
    y = toxic.astype(np.float32)
    share = np.where(toxic, 0.5 / n1, 0.5 / n0).astype(np.float32)
    rng = np.random.default_rng(7)
    w, v, b = np.zeros(len(best), np.float32), rng.normal(0, 0.01, (len(best), FACTORS)).astype(np.float32), np.zeros(1, np.float32)
    moments = [[np.zeros_like(z), np.zeros_like(z)] for z in (w, v, b)]
    for k in range(1, STEPS + 1):
        xv = x @ v
        raw = b[0] + x @ w + 0.5 * (xv**2 - x @ v**2).sum(1)
        g = share * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y)
        grads = (x.T @ g + PENALTY * w, x.T @ (g[:, None] * xv) - (x.T @ g)[:, None] * v + 10 * PENALTY * v, np.array([g.sum()], np.float32))
        for z, grad, m in zip((w, v, b), grads, moments, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * grad
            m[1] = 0.99 * m[1] + 0.01 * grad * grad
            z -= RATE * (m[0] / (1 - 0.9**k)) / (np.sqrt(m[1] / (1 - 0.99**k)) + 1e-6)
    # the fit weighs both classes alike; the bias brings back their true shares
    return Machine(slot, float(b[0] + np.log(prior / (1 - prior))), w.astype(np.float64), v.astype(np.float64))


def fit(docs: DataFrame, labels: DataFrame) -> Machine:
    """A machine from documents (doc_id, text) and labels (doc_id, toxic 0/1), at most CLASS_ROWS rows of either class.

    Null labels, ids and texts teach nothing; of a doc_id with several labels the largest counts, of several texts one.
    Without rows of both classes every score is the share of toxic labels, kept within 0.01 and 0.99.
    """
    marked = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = textkit.written(marked.select("doc_id", (F.col("toxic") > 0).alias("toxic")), "toxic-labels")
    shares = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}
    prior = min(0.99, max(0.01, shares.get(True, 0) / max(1, sum(shares.values()))))
    ids = None
    for kind in (True, False):
        own = marked.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(CLASS_ROWS)
        ids = own if ids is None else ids.union(own)
    sample = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in textkit.text_slices(batch.column(0)):
                row, bucket = terms(buf, offsets)
                cells = np.unique(row << BITS | bucket)
                edges = np.searchsorted(cells, np.arange(b - a + 1) << BITS)
                bags = []
                for i in range(b - a):
                    own = (cells[edges[i] : edges[i + 1]] & ((1 << BITS) - 1)).astype(np.uint16)
                    bags.append(own.tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array(bags, pa.binary())], ["toxic", "bag"])

    rows = sample.select("text", "toxic").mapInArrow(run, "toxic boolean, bag binary").collect()
    if len({r.toxic for r in rows}) < 2:
        return Machine(np.full(1 << BITS, -1, dtype=np.int64), float(np.log(prior / (1 - prior))), np.zeros(TERMS), np.zeros((TERMS, FACTORS)))
    rows.sort(key=lambda r: (r.toxic, bytes(r.bag)))
    return train([np.frombuffer(r.bag, np.uint16) for r in rows], np.array([r.toxic for r in rows]), prior)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score, predicted) of every whole text; an empty or null text has no term and scores by the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in textkit.text_slices(batch.column(1)):
                p = shared.value.score(*terms(buf, offsets), b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (textkit.table(spark, sf_dir, t) for t in ("documents", "labels"))
    held_out = bucket_of(F.col("doc_id"), 3) == 1
    machine = fit(docs, labels.filter(~held_out))
    return score(docs, machine).select("doc_id", held_out.alias("held_out"), "score", "predicted")
