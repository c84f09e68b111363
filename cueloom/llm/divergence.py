"""Source divergence audit: how far the words of each source of a language are from those of the others.

Single-pass in-memory indexing:

1. A task counts terms by (language, source) in memory. When BLOCK_POSTINGS postings are held it spills a run: rows of
   (shard, language) whose postings are sorted by term. The texts are read once and never shuffled.
2. Each shard, a hash of the term, merges its runs by a heap into frequencies. All postings of a term of a language meet there,
   so the terms of too few documents go at once. Kept terms come out in blocks of BLOCK_TERMS.
3. Pair corrections are streamed from the blocks. Two sources differ by V times the value of a term that neither has, and by
   corrections for the terms that one or both have: what one side alone changes depends on its count only and is summed by
   distinct counts, the rest goes over the postings of a term. Only sums by (language, source, source) leave a task.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: Documents of a language that must hold a term.
LEAST_DOCS = 3
SCALE = 1_000_000_000
#: Ranks of part `term`.
RANKS = 200
#: Postings that a task holds before it spills a run, and kept terms of a block.
BLOCK_POSTINGS, BLOCK_TERMS = 400_000, 4096
#: Bytes of text looked at in one step; a longer document takes several.
STEP_BYTES = 1 << 20
#: Bytes of input a shard, and fewest shards.
SHARD_BYTES, LEAST_SHARDS = 64 << 20, 64
#: Pairs of postings that are corrected in one step, and sums that a task holds before they go out.
STEP_PAIRS, HELD_SUMS = 1 << 19, 1 << 20
#: Statistics of the languages are broadcast up to so many groups; above, they are joined under so many salts.
BROADCAST_GROUPS, SALTS = 50_000, 64

_RUN = "shard int, lang string, sources array<string>, terms string, source binary, counts binary, docs binary"
_BLOCK = "lang string, sources array<string>, sums array<long>, n_terms long, terms string, lengths binary, source binary, counts binary"


def _pieces(text: bytes) -> Iterator[bytes]:
    """text in steps that end between terms."""
    at = 0
    while at < len(text):
        end = at + STEP_BYTES
        if end < len(text):
            gap = TERM.match(text, end)
            end = gap.end() if gap else end
        yield text[at:end]
        at = end


class Postings:
    """Counts and document counts of terms by (language, source)."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def add(self, lang: str, source: str, text: bytes) -> None:
        counts, docs = self.groups.setdefault((lang, source), (Counter(), Counter()))
        seen: set[bytes] = set()
        for piece in _pieces(text):
            terms = TERM.findall(piece.lower())
            counts.update(terms)
            seen.update(terms)
        docs.update(seen)

    def __len__(self) -> int:
        return sum(len(c) for c, _ in self.groups.values())

    def run(self, shards: int) -> Iterator[pa.RecordBatch]:
        """The term-sorted rows of a run; a language's groups are all named in one shard, so that those without terms stay known."""
        import zlib

        for lang in sorted({k[0] for k in self.groups}):
            sources = sorted(s for g, s in self.groups if g == lang)
            rows = [(t, k, n, self.groups[lang, s][1][t]) for k, s in enumerate(sources) for t, n in self.groups[lang, s][0].items()]
            rows.sort()
            dealt: dict[int, list] = {zlib.crc32(lang.encode()) % shards: []}
            for row in rows:
                dealt.setdefault(zlib.crc32(row[0]) % shards, []).append(row)
            for shard, own in dealt.items():
                terms, source, counts, docs = zip(*own, strict=True) if own else ((), (), (), ())
                named = sources if shard == zlib.crc32(lang.encode()) % shards else [sources[k] for k in sorted(set(source))]
                place = {s: k for k, s in enumerate(named)}
                source = [place[sources[k]] for k in source]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard], pa.int32()), pa.array([lang]), pa.array([named], pa.list_(pa.string())), pa.array([b" ".join(terms).decode("utf-8")]),
                        pa.array([np.array(source, "<i4").tobytes()]), pa.array([np.array(counts, "<i8").tobytes()]), pa.array([np.array(docs, "<i8").tobytes()]),
                    ], ["shard", "lang", "sources", "terms", "source", "counts", "docs"],
                )


def runs(docs: DataFrame, shards: int) -> DataFrame:
    """_RUN of docs (lang, source, text): the runs that the tasks spill."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, more = Postings(), 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(k) for k in range(3)), strict=True):
                held.add(lang.as_py(), source.as_py(), text.as_py())
                more += 1
                if more % 64 == 0 and len(held) >= BLOCK_POSTINGS:
                    yield from held.run(shards)
                    held = Postings()
        yield from held.run(shards)

    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(index, _RUN)


def _postings(row: dict) -> Iterator[tuple[bytes, str, int, int]]:
    terms = row["terms"].encode().split(b" ") if row["terms"] else []
    source, counts, docs = np.frombuffer(row["source"], "<i4"), np.frombuffer(row["counts"], "<i8"), np.frombuffer(row["docs"], "<i8")
    for k, t in enumerate(terms):
        yield t, row["sources"][source[k]], int(counts[k]), int(docs[k])


def _block(lang: str, named: set[str], kept: list[tuple[bytes, dict[str, int]]]) -> dict:
    sources = sorted(named.union(*(c for _, c in kept)))
    place, sums = {s: k for k, s in enumerate(sources)}, [0] * len(sources)
    source, counts = [], []
    for _, own in kept:
        for s, n in own.items():
            source.append(place[s])
            counts.append(n)
            sums[place[s]] += n
    return {
        "lang": lang, "sources": sources, "sums": sums, "n_terms": len(kept), "terms": b" ".join(t for t, _ in kept).decode("utf-8"),
        "lengths": np.array([len(c) for _, c in kept], "<i4").tobytes(), "source": np.array(source, "<i4").tobytes(), "counts": np.array(counts, "<i8").tobytes(),
    }


_BLOCK_TYPE = pa.schema([
    ("lang", pa.string()), ("sources", pa.list_(pa.string())), ("sums", pa.list_(pa.int64())), ("n_terms", pa.int64()), ("terms", pa.string()),
    ("lengths", pa.binary()), ("source", pa.binary()), ("counts", pa.binary()),
])


def merge(shard: pa.Table) -> pa.Table:
    """_BLOCK of a shard's runs of one language, merged by a heap."""
    pieces = [{c: shard.column(c)[k].as_py() for c in ("lang", "sources", "terms", "source", "counts", "docs")} for k in range(shard.num_rows)]
    lang, named = pieces[0]["lang"], {s for p in pieces for s in p["sources"]}
    blocks, kept = [], []
    for term, rows in groupby(heapq.merge(*map(_postings, pieces), key=itemgetter(0)), key=itemgetter(0)):
        counts: dict[str, int] = {}
        n_docs = 0
        for _, source, n, docs in rows:
            counts[source] = counts.get(source, 0) + n
            n_docs += docs
        if n_docs >= LEAST_DOCS:
            kept.append((term, counts))
        if len(kept) == BLOCK_TERMS:
            blocks.append(_block(lang, named, kept))
            kept = []
    if kept or not blocks:
        blocks.append(_block(lang, named, kept))
    return pa.Table.from_pylist(blocks, schema=_BLOCK_TYPE)


def frequencies(docs: DataFrame) -> DataFrame:
    """_BLOCK of docs (lang, source, text): kept terms with their counts by source; every group stands in some block."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    shards = max(LEAST_SHARDS, -(-size // SHARD_BYTES)) if size < 1 << 60 else LEAST_SHARDS
    return runs(docs, shards).groupBy("shard", "lang").applyInArrow(merge, _BLOCK)


def _share(counts: np.ndarray, total: int | np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (counts + 1) / total), exactly."""
    if len(counts) and int(counts.max()) + 1 > (1 << 63) // SCALE - 1:
        return (1 + SCALE * (counts.astype(object) + 1) // total).astype(np.int64)
    return 1 + SCALE * (counts + 1) // total


def _far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _corrected(lengths: np.ndarray, source: np.ndarray, p: np.ndarray, p0: np.ndarray) -> np.ndarray:
    """Sum over terms of what pairs of sources differ by from a term that neither has; p, source: the postings, term by term."""
    sums, most = np.zeros((len(p0), len(p0)), np.int64), _far(p0[:, None], p0[None, :])
    for s in np.unique(source):
        own, n = np.unique(p[source == s], return_counts=True)
        sums[s, :] += (n[:, None] * (_far(own[:, None], p0[None, :]) - most[s])).sum(0)
        sums[:, s] += (n[:, None] * (_far(p0[None, :], own[:, None]) - most[:, s])).sum(0)
    starts = np.cumsum(lengths) - lengths
    reps, first = np.repeat(lengths, lengths).astype(np.int64), np.repeat(starts, lengths).astype(np.int64)
    done = np.cumsum(reps)
    at, flat = 0, sums.reshape(-1)
    while at < len(reps):
        end = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + STEP_PAIRS, side="right")))
        own = reps[at:end]
        left = np.repeat(np.arange(at, end), own)
        right = np.repeat(first[at:end], own) + np.arange(len(left)) - np.repeat(np.cumsum(own) - own, own)
        a, b = source[left], source[right]
        np.add.at(flat, a * len(p0) + b, _far(p[left], p[right]) - _far(p[left], p0[b]) - _far(p0[a], p[right]) + most[a, b])
        at = end
    return sums


def _telling(terms: list[bytes], lengths: np.ndarray, source: np.ndarray, p: np.ndarray, q: np.ndarray) -> Iterator[tuple[int, bytes, int]]:
    """(source, term, value) of the RANKS best terms of each source in a block."""
    term = np.repeat(np.arange(len(lengths)), lengths)
    q = q[term]
    value, over = _far(p, q), p > q
    for s in np.unique(source):
        own = np.flatnonzero((source == s) & over)
        best = own[np.lexsort((term[own], -value[own]))[:RANKS]]  # terms of a block are in order
        for k in best:
            yield int(s), terms[term[k]], int(value[k])


def corrections(blocks: DataFrame) -> DataFrame:
    """(part, lang, source, item, value) of blocks with `vocabulary`, `total` and `groups` of their language: partial sums of
    corrections by pair of sources, and each block's best terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = ["part", "lang", "source", "item", "value"], {}

        def out(rows: list[tuple]) -> pa.RecordBatch:
            types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[k]) for k in range(5)], names)

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (sources, sums) in held.items():
                for i, s in enumerate(sources):
                    yield out([("pair", lang, s, o, int(sums[i, j])) for j, o in enumerate(sources) if j != i])
            held.clear()

        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                if not row["n_terms"]:
                    continue
                lang, volume = row["lang"], row["vocabulary"]
                every = sorted((g["source"], g["n"]) for g in row["groups"])
                sources, totals = [s for s, _ in every], np.array([n + volume for _, n in every], np.int64)
                place = {s: i for i, s in enumerate(sources)}
                source = np.array([place[s] for s in row["sources"]], np.int64)[np.frombuffer(row["source"], "<i4")]
                lengths, counts = np.frombuffer(row["lengths"], "<i4"), np.frombuffer(row["counts"], "<i8")
                p = _share(counts, totals[source])
                sums = _corrected(lengths, source, p, _share(np.zeros(len(sources), np.int64), totals))
                if lang in held:
                    held[lang][1][:] += sums
                else:
                    held[lang] = (sources, sums)
                q = _share(np.add.reduceat(counts, np.cumsum(lengths) - lengths), row["total"] + volume)
                yield out([("term", lang, sources[s], t.decode("utf-8"), v) for s, t, v in _telling(row["terms"].encode().split(b" "), lengths, source, p, q)])
                if sum(x.size for _, x in held.values()) > HELD_SUMS:
                    yield from flush()
        yield from flush()

    return blocks.mapInArrow(run, "part string, lang string, source string, item string, value long")


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (lang, source, text).

    Null lang, source and text are read as ''. Part `pair` has each other source of the language, part `term` the RANKS terms that
    a group uses more than its language does. A language with a single source has no pairs; one without kept terms has pairs of
    value 0. Each row is a document, repeated rows too; ties go by item in UTF-8 order; other columns are left out; an empty table
    gives no rows. A text of any length is looked at whole, in steps.
    """
    blocks = textkit.written(frequencies(docs), "blocks")
    groups = blocks.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("g")).groupBy("lang", F.col("g.sources").alias("source")).agg(F.sum("g.sums").alias("n"))
    kept = blocks.groupBy("lang").agg(F.sum("n_terms").alias("vocabulary"))
    known = textkit.written(groups.groupBy("lang").agg(F.collect_list(F.struct("source", "n")).alias("groups"), F.sum("n").alias("total")).join(kept, "lang"), "groups")
    size = known.agg(F.sum(F.size("groups"))).head()[0] or 0
    if size <= BROADCAST_GROUPS:
        told = blocks.join(F.broadcast(known), "lang")
    else:
        salted = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        told = blocks.withColumn("_salt", F.pmod(F.xxhash64("terms"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "_salt"]).drop("_salt")
    found = textkit.written(corrections(told), "corrections")
    whole = "decimal(38,0)"
    changes = found.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast(whole)).alias("change"))
    ordered = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    both = known.select("lang", "vocabulary", "groups", F.explode("groups").alias("g")).select("lang", "vocabulary", "g", F.explode("groups").alias("h")).filter("g.source != h.source")
    absent = lambda side: F.expr(f"if(vocabulary = 0, 1L, 1 + {SCALE} div ({side}.n + vocabulary))")
    pairs = both.select("lang", F.col("g.source").alias("source"), F.col("h.source").alias("item"), "vocabulary", absent("g").alias("p"), absent("h").alias("q"))
    pairs = pairs.join(changes, ["lang", "source", "item"], "left").withColumn("value", (F.expr(f"cast(vocabulary as {whole}) * ((p - q) * (p - q) div q)") + F.coalesce("change", F.lit(0))).cast("long"))
    terms = found.filter("part = 'term'").select("lang", "source", "item", "value").withColumn("rank", F.row_number().over(ordered)).filter(F.col("rank") <= RANKS)
    pairs = pairs.select("lang", "source", "item", "value").withColumn("rank", F.row_number().over(ordered))
    columns = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(terms, "term"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`audit` of the whole table documents."""
    return audit(textkit.table(spark, sf_dir, "documents"))


OP13_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= {LEAST_DOCS}),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
filled AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n FROM groups g JOIN kept k ON g.lang = k.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + {SCALE}::HUGEINT * (n + 1) // (sum(n) OVER w + count(*) OVER w) AS p FROM filled WINDOW w AS (PARTITION BY lang, source)),
q AS (SELECT lang, term, 1 + {SCALE}::HUGEINT * (n + 1) // (sum(n) OVER w + count(*) OVER w) AS q FROM kept WINDOW w AS (PARTITION BY lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(s.value, 0) AS value FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - q.q) * (p.p - q.q) // q.q AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {RANKS}
"""
