"""Benchmark decontamination by CGK embeddings, bit-sampling LSH and exact edit verification.

Texts are compared as words: lower-cased runs of letters and digits; characters of scripts that write three or more bytes a
character (Chinese, Japanese, Thai, ...) are words of their own. A document is contaminated by an item if some stretch of its words is within the allowed edits of the item (inserted,
deleted or changed words): EDITS of its words, none for items under 2 * LEAST_WORDS words.

1. Items are cut into parts of at most PART_WORDS words; equal parts of several items are one part. If a stretch is within the
   allowed share of edits of an item, it is so for one of its parts, so a window never needs to be longer than a part.
2. Windows of a part's size open at every word of every document. An edit harms two pairs of neighbouring words at most, so a
   window that holds too few of the parts' pairs (a bitmap of at most 2 ** FILTER_BITS bits) can't be within the allowed
   edits and is skipped: nothing is lost by it, and as a benchmark grows the bitmap only skips less.
3. A CGK walk embeds windows and parts into Hamming space: at step j the current word is put out, and a random bit of
   (j, word) tells whether to go on to the next. Bits come from a hash, so walks need no table of coins.
4. LSH. TABLES samples of BITS places, over WALKS walks, are the keys of a window and of a part; places are chosen for each
   class of part sizes. Keys of windows are joined with keys of parts as tables; windows whose key is certainly no part's
   (a second bitmap) don't go into the join.
5. Verification of parts: bit-parallel edit distance of each part against the neighbourhood of its windows. What is left goes to
   the items of the part. A part of more than FEW items (a template) goes only to those of which a text holds one of the rarest
   words: of an item within k edits at least one of any k + 1 different words stands in the stretch, so none is lost.
6. Verification of items in the same way. Tasks hold buckets of texts and of the words that their pairs need, by bytes of both.

Items of fewer than LEAST_WORDS words are no passages: a document holds one only if a whole line of it has just its words.

At the threshold (20 % random word edits) a part alone is found with a chance of 97 % or more, a longer item by any part;
`test_decontamination_recall` measures it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit

#: Edits allowed as a share of an item's words.
EDITS = 0.2
#: Items of fewer words are no passages, and are found as whole lines.
LEAST_WORDS = 5
#: Items of a part that a text with the part is compared with at once.
FEW = 8
PART_WORDS = 32
#: Least words of each class of parts; the places of a class lie within REACH steps for each of these words.
CLASSES, REACH = (5, 10, 20), 1.6
WALKS, TABLES, BITS = 8, 64, 4
STEPS = int(REACH * PART_WORDS)
#: Windows that are embedded at a time.
WINDOWS = 2048
#: Bits of a bitmap of the items' keys or pairs at most, as power of two; below that SPARSE bits an entry.
FILTER_BITS, SPARSE = 26, 4096
#: Bytes of text that are looked at in one step, and of texts and words that are verified in one task, about.
STEP_BYTES, VERIFY_BYTES = 1 << 18, 2 << 20

_rng = np.random.default_rng(3)
_COINS = _rng.integers(0, 1 << 31, (WALKS, STEPS), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLACES = (np.arange(BITS) + _rng.random((TABLES, BITS))) / BITS  # one in each part of the walk, so that samples hold different words
_MIX = _rng.integers(0, 1 << 63, (TABLES, BITS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_ASCII = np.zeros(256, dtype=bool)
_ASCII[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts, and where each text's words begin."""
    n = len(buf)
    buf = textkit.LOWER[buf]
    inside = _ASCII[buf]
    wide, lead = np.zeros(n + 4, dtype=bool), np.flatnonzero(buf >= 0xE0)
    after = buf[np.minimum(lead + 1, n - 1)] if n else buf
    mark = ((buf[lead] == 0xE2) & ((after == 0x80) | (after == 0x81))) | ((buf[lead] == 0xE3) & (after == 0x80))  # punctuation
    for k in range(4):
        own = lead if k < 3 else lead[buf[lead] >= 0xF0]
        wide[own + k] = True
        if k < 3:
            inside[np.minimum(lead[mark] + k, n - 1)] = False
    wide = wide[:n]
    head = np.zeros(n, dtype=bool)
    head[lead[~mark]] = True
    before, wide_before = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    before[1:], wide_before[1:] = inside[:-1], wide[:-1]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begin = inside & (head | ~before | (wide_before & ~wide) | edge[:n])
    start = np.flatnonzero(begin)
    stop_at = np.flatnonzero(np.append(~inside | begin | edge[:n], True))
    end = stop_at[np.searchsorted(stop_at, start, side="right")]
    return textkit.span_hashes(textkit.prefix_sums(buf), start, end), np.searchsorted(start, offsets)


def _tokens(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit words with a 0 behind each text, at which walks stay; and where each word stands among them."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    place = np.arange(len(hashes)) + row
    out = np.zeros(len(hashes) + len(first) - 1, np.uint32)
    out[place] = np.maximum((hashes >> np.uint64(32)).astype(np.uint32), np.uint32(1))
    return out, place


def embed(tokens: np.ndarray, starts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """WALKS x steps x windows: the CGK walks from each start."""
    out = np.empty((WALKS, steps, len(starts)), np.uint32)
    for w in range(WALKS):
        at = starts.astype(np.int64)
        for j in range(steps):
            now = tokens[at]
            out[w, j] = now
            at += (now * _COINS[w, j]) >> np.uint32(31)
    return out


def _places(size: int, table: int) -> np.ndarray:
    return (_PLACES[table] * REACH * size).astype(np.int64)


def _samples(walks: np.ndarray, c: int, table: int) -> list[np.ndarray]:
    """The words at the table's places for a class of part sizes."""
    return [walks[table % WALKS, p] for p in _places(CLASSES[c], table)]


def _keys(samples: list[np.ndarray], c: int, table: int) -> np.ndarray:
    """Keys by which windows and parts are joined."""
    key = np.full(len(samples[0]), c * TABLES + table + 1, np.uint64)
    for part, odd in zip(samples, _MIX[table], strict=True):
        key += part * odd
    return textkit.mix(key)


def _pairs(hashes: np.ndarray) -> np.ndarray:
    """A hash for each word and the one behind it."""
    return textkit.mix(hashes[:-1] * np.uint64(textkit.PRIME) + hashes[1:])


def _widest(c: int) -> int:
    """Most words of a part of a class."""
    return [*CLASSES[1:], PART_WORDS + 1][c] - 1


def edit_distance_within(pattern: list, text: list) -> int:
    """Least edit distance of pattern to any stretch of text, by Myers' bit vectors."""
    masks: dict = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (full & ~(diagonal | plus)), plus & diagonal
        score += bool(up & high) - bool(down & high)
        best = min(best, score)
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | (full & ~((eq | minus) | up)), up & (eq | minus)
    return best


def allowed(n: int) -> int:
    """Edits allowed to an item of n words."""
    return int(EDITS * n) if n >= 2 * LEAST_WORDS else 0


def items(benchmark: DataFrame) -> DataFrame:
    """(item_id, item, words) of the items that have a word; item: 16 bytes alike for equal words, words: their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for a, b, buf, offsets in textkit.text_slices(batch.column(1)):
                hashes, first = words(buf, offsets)
                own = [hashes[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)]
                keep = [k for k, w in enumerate(own) if w]
                digest = pa.array([hashlib.md5(own[k]).digest() for k in keep], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(keep, pa.int64())), digest, pa.array([own[k] for k in keep], pa.binary())], ["item_id", "item", "words"])

    known = benchmark.select(F.col("item_id").cast("long"), "text").filter("item_id is not null and text is not null")
    return known.mapInArrow(run, "item_id long, item binary, words binary")


def parts(distinct: DataFrame) -> DataFrame:
    """(item, size, part, at, words) of distinct items (item, words): size, the item's words; at, the part's first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for item, value in zip(*(batch.column(c) for c in ("item", "words")), strict=True):
                own = value.as_py()
                n = len(own) // 8
                edges = np.arange(-(-n // PART_WORDS) + 1) * n // -(-n // PART_WORDS)
                cut = [own[8 * a : 8 * b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                columns = [pa.array([item.as_py()] * len(cut), pa.binary()), pa.array([n] * len(cut), pa.int32()), pa.array([hashlib.md5(c).digest() for c in cut], pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(edges[:-1].astype(np.int32)), pa.array(cut, pa.binary())], ["item", "size", "part", "at", "words"])

    return distinct.select("item", "words").mapInArrow(run, "item binary, size int, part binary, at int, words binary")


def part_keys(distinct: DataFrame) -> DataFrame:
    """(key, class, part): keys of the distinct parts (part, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, WINDOWS):
                part, own = batch.column(0).slice(lo, WINDOWS), [np.frombuffer(w.as_buffer(), np.uint64) for w in batch.column(1).slice(lo, WINDOWS)]
                sizes = np.array([len(w) for w in own])
                edges = np.append(0, np.cumsum(sizes))
                tokens, place = _tokens(np.concatenate(own), edges)
                walks = embed(tokens, place[edges[:-1]])
                for c in range(len(CLASSES)):
                    rows = np.flatnonzero((sizes >= CLASSES[c]) & (sizes <= _widest(c)))
                    for t in range(TABLES if len(rows) else 0):
                        key = _keys(_samples(walks[:, :, rows], c, t), c, t)
                        yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(np.full(len(rows), c, np.int32)), part.take(pa.array(rows))], ["key", "class", "part"])

    return distinct.select("part", "words").mapInArrow(run, "key long, class int, part binary")


def pair_keys(distinct: DataFrame) -> DataFrame:
    """(key): the pairs of neighbouring words of the distinct parts (words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                own = np.unique(_pairs(np.frombuffer(value.as_buffer(), np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64))], ["key"])

    return distinct.select("words").mapInArrow(run, "key long")


@dataclass
class Bitmap:
    """A bit for the upper bits of every key; what isn't in it is certainly none of them."""

    bits: int
    packed: np.ndarray

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.packed[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def bitmap(keys: DataFrame) -> Bitmap:
    """Bitmap of written keys (key); at most 2 ** (FILTER_BITS - 6) words of it reach the driver, whatever the benchmark's size."""
    bits = min(FILTER_BITS, max(16, (SPARSE * keys.count()).bit_length()))
    packed = np.zeros(1 << (bits - 3), np.uint8)
    upper = keys.selectExpr(f"shiftrightunsigned(key, {64 - bits}) as bit").selectExpr("cast(shiftright(bit, 6) as int) as word", "cast(bit & 63 as int) as bit")
    words_ = upper.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit)) as value")).toArrow()
    packed.view("<u8")[words_.column("word").to_numpy()] = words_.column("value").to_numpy().view(np.uint64)
    return Bitmap(bits, packed)


@dataclass
class Filter:
    classes: list[int]
    pairs: Bitmap
    keys: Bitmap

    def candidates(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word at which it opens, key) of the windows of texts whose key may be an item's."""
        where, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        if not self.classes or not len(hashes):
            return where[0], found[0]
        tokens, place = _tokens(hashes, first)
        held = np.append(self.pairs.has(_pairs(hashes)), False)
        held[first[1:][first[1:] > 0] - 1] = False  # a text's last word has none behind it
        sums = np.append(0, np.cumsum(held))
        end = np.repeat(first[1:], np.diff(first))
        at = np.arange(len(hashes))
        for c in self.classes:
            size, most = CLASSES[c], allowed(_widest(c))
            inside = sums[np.minimum(at + size - 1, end)] - sums[at] >= size - 1 - 2 * most
            open_ = np.flatnonzero(inside)
            for lo in range(0, len(open_), WINDOWS):
                own = open_[lo : lo + WINDOWS]
                walks = embed(tokens, place[own], int(REACH * size) + 1)
                for t in range(TABLES):
                    key = _keys(_samples(walks, c, t), c, t)
                    real = self.keys.has(key)
                    where.append(own[real])
                    found.append(key[real])
        return np.concatenate(where), np.concatenate(found)


def key_filter(distinct: DataFrame, keys: DataFrame) -> Filter:
    """What tells windows apart that can't be near any of the distinct parts; keys: their written part_keys."""
    classes = sorted(r["class"] for r in keys.select("class").distinct().collect())
    return Filter(classes, bitmap(textkit.written(pair_keys(distinct), "part-pairs")), bitmap(keys))


def window_keys(docs: DataFrame, known: Filter) -> DataFrame:
    """(key, row, start, text) of docs (row, text): windows that open at word `start`, with the keys that may be an item's; and,
    once for each text that has any, the text with a null key, so that texts needn't be fetched by a shuffle of all of them."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "row", "start", "text"]
        for batch in batches:
            for a, _, buf, offsets in textkit.text_slices(batch.column(1), STEP_BYTES):
                hashes, first = words(buf, offsets)
                where, keys = shared.value.candidates(hashes, first)
                row = np.searchsorted(first, where, side="right") - 1
                n, some = len(keys), pa.array(a + np.unique(row))
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), batch.column(0).take(pa.array(a + row)), pa.array((where - first[row]).astype(np.int32)), pa.nulls(n, pa.string())], names)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.int64()), batch.column(0).take(some), pa.nulls(len(some), pa.int32()), batch.column(1).take(some).cast(pa.string())], names)

    return docs.select("row", "text").mapInArrow(run, "key long, row binary, start int, text string")


_BUCKET = "row binary, ref binary, begins array<int>, text string, words binary, reach int"


def _bucketed(texts: DataFrame, pairs: DataFrame, values: DataFrame) -> DataFrame:
    """`bucket` and _BUCKET: texts (row, text), pairs (row, ref, begins) of the same rows, and once a bucket the values
    (ref, words, reach) that its pairs refer to. A bucket has about VERIFY_BYTES of texts and words; all are written tables."""
    known = textkit.written(values.join(pairs.groupBy("ref").agg(F.count("*").alias("_n")), "ref"), "values")
    size = (texts.agg(F.sum(F.octet_length("text"))).head()[0] or 0) + (known.agg(F.sum(F.octet_length("words") * F.col("_n"))).head()[0] or 0)
    bucket = F.pmod(F.xxhash64("row"), F.lit(max(1, -(-size // VERIFY_BYTES)))).alias("bucket")
    refs = textkit.written(pairs.select(bucket, "ref").distinct(), "refs")
    words_ = textkit.spread_join(refs, known, ["ref"], weight=F.octet_length("words"))
    no = lambda kind: F.lit(None).cast(kind)
    rows = texts.select(bucket, "row", no("binary").alias("ref"), no("array<int>").alias("begins"), "text", no("binary").alias("words"), no("int").alias("reach"))
    rows = rows.union(pairs.select(bucket, "row", "ref", "begins", no("string"), no("binary"), no("int")))
    return rows.union(words_.select("bucket", no("binary"), "ref", no("array<int>"), no("string"), "words", "reach"))


def _near(own: pa.Table, share: bool) -> Iterator[tuple[bytes, bytes, np.ndarray, int, int, np.ndarray]]:
    """(row, ref, begins, edits, reach, words of the row's text) of the pairs of a bucket that lie within the allowed edits;
    share: edits allowed are the share of the words, as it may fall to a part of an item."""
    pick = lambda c: own.filter(own.column(c).is_valid())
    texts, values, pairs = pick("text"), pick("words"), pick("begins")
    known = {ref: (np.frombuffer(w.as_buffer(), np.uint64), reach) for ref, w, reach in zip(values.column("ref").to_pylist(), values.column("words"), values.column("reach").to_pylist(), strict=True)}
    held = dict(zip(texts.column("row").to_pylist(), range(texts.num_rows), strict=True))
    column = texts.column("text").combine_chunks() if texts.num_rows else None
    wanted: dict[bytes, list[int]] = {}
    refs = pairs.column("ref").to_pylist()
    for k, row in enumerate(pairs.column("row").to_pylist()):
        wanted.setdefault(row, []).append(k)
    for row, mine in wanted.items():
        if row not in held:
            continue
        for _, _, buf, offsets in textkit.text_slices(column.slice(held[row], 1)):
            text = words(buf, offsets)[0]
            for k in mine:
                pattern, reach = known[refs[k]]
                n = len(pattern)
                most = int(EDITS * n) if share else allowed(n)
                begins = np.unique(np.array(pairs.column("begins")[k].as_py(), np.int64))
                cuts = np.flatnonzero(np.diff(begins) > n) + 1
                plain, best = pattern.tolist(), most + 1
                for some in np.split(begins, cuts):
                    stretch = text[max(0, int(some[0]) - 2 * most - 2) : max(0, int(some[-1]) + n + 2 * most + 2)]
                    best = min(best, edit_distance_within(plain, stretch.tolist()))
                if best <= most:
                    yield row, refs[k], begins, best, reach, text


def _table(rows: list[tuple], **kinds: pa.DataType) -> pa.Table:
    return pa.table({c: pa.array([r[k] for r in rows], kind) for k, (c, kind) in enumerate(kinds.items())})


def _part_word(part: bytes, hashes: np.ndarray) -> np.ndarray:
    """Keys of a part together with words."""
    return textkit.mix(hashes ^ np.uint64(int.from_bytes(part[:8], "little"))).astype(np.int64)


def _verified_parts(own: pa.Table, rare: Bitmap | None) -> pa.Table:
    """(row, part, begins, key): parts that are near; a part of many items comes once for each word near it that may be rare in one
    of them, with the key of part and word."""
    out = []
    for row, part, begins, _, reach, text in _near(own, True):
        where = begins.astype(np.int32).tolist()
        if not reach:
            out.append((row, part, where, None))
            continue
        around = np.zeros(len(text) + 1, np.int64)
        np.add.at(around, np.maximum(begins - 2 * reach, 0), 1)
        np.add.at(around, np.minimum(begins + 2 * reach, len(text)), -1)
        keys = np.unique(_part_word(part, text[np.cumsum(around[:-1]) > 0]))
        out += [(row, part, where, int(k)) for k in keys[rare.has(keys.view(np.uint64))]]
    return _table(out, row=pa.binary(), part=pa.binary(), begins=pa.list_(pa.int32()), key=pa.int64())


def _verified_items(own: pa.Table) -> pa.Table:
    found = [(row, item, edits) for row, item, _, edits, _, _ in _near(own, False)]
    return _table(found, row=pa.binary(), item=pa.binary(), edits=pa.int32())


def rare_words(shared: DataFrame, distinct: DataFrame) -> DataFrame:
    """(key, item, at) of shared (part, item, size, at), parts of many items: a key for the part and each of the item's rarest words,
    one more than it may have edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, value in zip(*(batch.column(c) for c in ("item", "words")), strict=True):
                own = np.unique(np.frombuffer(value.as_buffer(), np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(own), pa.binary()), pa.array(own)], ["item", "word"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [int(_part_word(p, np.array([w], np.int64).view(np.uint64))[0]) for p, w in zip(batch.column("part").to_pylist(), batch.column("word").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column("item"), batch.column("at")], ["key", "item", "at"])

    held = textkit.written(distinct.select("item", "words").mapInArrow(run, "item binary, word long"), "item-words")
    met = held.join(shared.select("item", "size").distinct(), "item")
    counted = met.join(held.groupBy("word").agg(F.count("*").alias("n")), "word")
    most = F.when(F.col("size") >= 2 * LEAST_WORDS, F.floor(F.col("size") * EDITS)).otherwise(0)
    rank = F.row_number().over(Window.partitionBy("item").orderBy("n", "word"))
    rarest = counted.withColumn("_rank", rank).filter(F.col("_rank") <= most + 1).select("item", "word")
    return shared.select("part", "item", "at").join(rarest, "item").select("part", "word", "item", "at").mapInArrow(joined, "key long, item binary, at int")


def short_leaks(docs: DataFrame, short: DataFrame) -> DataFrame:
    """(row, item, edits) of lines of docs (row, text) that have just the words of a short item (item)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for k, text in enumerate(batch.column(1)):
                lines = [x for x in text.as_py().split("\n") if x]
                for _, _, buf, offsets in textkit.text_slices(pa.array(lines, pa.string())):
                    hashes, first = words(buf, offsets)
                    few = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < LEAST_WORDS))
                    own = sorted({hashlib.md5(hashes[first[j] : first[j + 1]].tobytes()).digest() for j in few})
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * len(own), pa.binary()), pa.array(own, pa.binary())], ["row", "item"])

    lines = textkit.written(docs.select("row", "text").mapInArrow(run, "row binary, item binary"), "short-lines")
    met = textkit.written(short.join(lines.groupBy("item").agg(F.count("*").alias("_n")), "item"), "short-items")
    return textkit.spread_join(lines, met, ["item"]).select("row", "item", F.lit(0).alias("edits"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(row, item_id, edits) of docs (row, text): each item that a text holds, with its least edits."""
    every = textkit.written(items(benchmark), "items")
    distinct = textkit.written(every.groupBy("item").agg(F.first("words").alias("words")), "distinct-items")
    short = F.octet_length("words") < 8 * LEAST_WORDS
    whole = docs.filter("text is not null")
    cut = textkit.written(parts(distinct.filter(~short)), "parts")
    known = textkit.written(cut.groupBy("part").agg(F.first("words").alias("words"), F.count("*").alias("uses"), F.max("size").alias("size")), "distinct-parts")
    keys = textkit.written(part_keys(known), "part-keys")
    found = textkit.written(window_keys(whole, key_filter(known, keys)), "windows")
    windows = found.filter("key is not null").select("key", "row", "start")
    keyed = keys.groupBy("key").agg(F.collect_set("part").alias("parts")).join(windows.groupBy("key").agg(F.count("*").alias("_n")), "key")
    met = textkit.spread_join(windows, textkit.written(keyed, "keys-met"), ["key"], weight=F.size("parts") * 16)
    hits = met.select("row", F.explode("parts").alias("ref"), F.col("start").alias("begin")).distinct()
    hits = textkit.written(hits.groupBy("row", "ref").agg(F.collect_list("begin").alias("begins")), "hits")
    texts = found.filter("text is not null").select("row", "text").join(hits.select("row").distinct(), "row", "left_semi").dropDuplicates(["row"])
    texts = textkit.written(texts, "suspects")

    many = known.filter(F.col("uses") > FEW).select("part")
    told = textkit.written(rare_words(cut.join(many, "part", "left_semi").select("part", "item", "size", "at"), distinct), "rare-words")
    rare = bitmap(told.select("key"))
    shared = docs.sparkSession.sparkContext.broadcast(rare)
    reach = F.when(F.col("uses") > FEW, F.col("size")).otherwise(0).cast("int").alias("reach")
    tested = _bucketed(texts, hits, known.select(F.col("part").alias("ref"), "words", reach))
    near = textkit.written(tested.groupBy("bucket").applyInArrow(lambda t: _verified_parts(t, shared.value), "row binary, part binary, begins array<int>, key long"), "near-parts")

    one = cut.join(near.filter("key is null").groupBy("part").agg(F.count("*").alias("_n")), "part").groupBy("part").agg(F.collect_list(F.struct("item", "at")).alias("of"), F.first("_n").alias("_n"))
    few = textkit.spread_join(near.filter("key is null").select("row", "part", "begins"), textkit.written(one, "items-of-parts"), ["part"])
    some = told.join(near.filter("key is not null").groupBy("key").agg(F.count("*").alias("_n")), "key").groupBy("key").agg(F.collect_list(F.struct("item", "at")).alias("of"), F.first("_n").alias("_n"))
    rest = textkit.spread_join(near.filter("key is not null").select("row", "key", "begins"), textkit.written(some, "items-of-words"), ["key"], weight=F.size("of") * 24)
    pairs = few.select("row", "begins", F.explode("of").alias("o")).union(rest.select("row", "begins", F.explode("of")))
    pairs = pairs.select("row", F.col("o.item").alias("ref"), F.transform("begins", lambda b: b - F.col("o.at")).alias("begins"))
    pairs = textkit.written(pairs.groupBy("row", "ref").agg(F.array_distinct(F.flatten(F.collect_set("begins"))).alias("begins")), "pairs")
    last = _bucketed(texts, pairs, distinct.select(F.col("item").alias("ref"), "words", F.lit(0).alias("reach")))
    sure = last.groupBy("bucket").applyInArrow(_verified_items, "row binary, item binary, edits int")
    if not distinct.filter(short).isEmpty():
        sure = sure.union(short_leaks(whole, distinct.filter(short).select("item")))
    sure = textkit.written(sure, "leaks")
    ids = textkit.written(every.groupBy("item").agg(F.collect_set("item_id").alias("ids")).join(sure.groupBy("item").agg(F.count("*").alias("_n")), "item"), "item-ids")
    out = textkit.spread_join(sure, ids, ["item"], weight=F.size("ids") * 8)
    return out.select("row", F.explode("ids").alias("item_id"), "edits").groupBy("row", "item_id").agg(F.min("edits").alias("edits"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with leaks added: array<struct<item_id, edits>> by item_id, empty for a clean text; other columns stay, but not `leaks`.

    Null and empty texts are clean; rows that share a doc_id are looked at each for itself. Items that are null or have no word
    are left out, items of fewer than LEAST_WORDS words are found as whole lines; items of any length are found, items that are
    equal are found each. An empty benchmark or table finds nothing.
    """
    keep = [c for c in docs.columns if c != "leaks"]
    found = leaks(docs.select(textkit.row_key().alias("row"), "text"), benchmark)
    found = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("item_id", "edits"))).alias("leaks"))
    own = docs.select(textkit.row_key().alias("row"), F.struct(*(F.col(f"`{c}`") for c in keep)).alias("d")).join(found, "row", "left")
    return own.select(*(F.col(f"d.`{c}`").alias(c) for c in keep), F.coalesce("leaks", F.array().cast("array<struct<item_id:bigint,edits:int>>")).alias("leaks"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = textkit.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contaminated(docs, textkit.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.edits")
