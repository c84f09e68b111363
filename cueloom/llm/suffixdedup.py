"""Suffix-array dedup: Burrows-Wheeler transforms of shards, merged by iterative interleave refinement.

Bytes covered by a MATCH-byte string that also starts in a document with a smaller doc_id are removed. Steps:

1. Seeds. Every MATCH-byte window is named by the least hash of its GRAM-byte substrings, so equal windows have equal
   names. Blocks of documents send their distinct names by hash range; names met in two documents go back to the blocks.
   Windows with other names are unique, and no more is done for them.
2. Segments. Runs of windows with one shared name become byte segments; a block sends each distinct one once, with its
   smallest doc_id, to the name's bucket. So copies cost a segment a block, and equal windows meet in one bucket.
3. Merge. In a bucket, equal segments are one string. Strings of names with several strings form shards of bounded size; a
   shard's suffixes are sorted, which gives its transform. The
   transforms of all shards are merged without sorting suffixes again: starting from the shards one after another, round h
   moves every suffix by its preceding byte (stable), after which suffixes interleave by their first h bytes. Places where
   neighbours begin to differ in round h have a common prefix of h - 1; after MATCH rounds the intervals between such
   places are the repeated MATCH-byte strings, and the smallest doc_id of an interval decides.
4. Each block gets a bit for each window of its segments back, finds the segments in its texts again and cuts them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit

MATCH, GRAM = 50, 20
#: Bytes of text in a block and behind a bucket, about; of a segment, of a shard and of one merge at most.
BLOCK_BYTES, BUCKET_BYTES, SEGMENT_BYTES, SHARD_BYTES, MERGE_BYTES = 4 << 20, 12 << 20, 256, 512 << 10, 1536 << 10

_SHARED = "block int, bucket int, names binary"
_STRINGS = ("names", "lengths", "bytes", "docs")
_PLACES = ("lengths", "occ_row", "occ_start", "occ_segment", "occ_later")


def windows(column: pa.Array):
    """(first row, rows, heads, names, counts, bytes, offsets) of pieces of texts: runs of MATCH-byte windows with one name.

    heads: where in bytes a run begins; counts: its windows. A long text comes in pieces, each window in one of them; `base`
    of a piece is added to places in it to get places in the text.
    """
    for a, b, buf, offsets in textkit.text_slices(column):
        step = 2 * textkit.SLICE_BYTES
        for base in range(0, max(1, len(buf) - MATCH + 1), step) if b - a == 1 else (0,):
            piece = buf[base : base + step + MATCH - 1] if b - a == 1 else buf
            offs = np.array([0, len(piece)]) if b - a == 1 else offsets
            if len(piece) < MATCH:
                continue
            sums = textkit.prefix_sums(piece)
            name = (sums[GRAM:] - sums[:-GRAM]) * textkit.powers(len(sums), textkit._INVERSE)[: len(sums) - GRAM]
            name ^= name >> np.uint64(32)
            name *= np.uint64(0x9FB21C651E98DF25)
            name >>= np.uint64(16)  # 48 bits: a clash only brings a window that the merge then finds to be unique
            have, need = 1, MATCH - GRAM + 1
            while have * 2 <= need:
                name = np.minimum(name[:-have], name[have:])
                have *= 2
            if have < need:
                name = np.minimum(name[: have - need], name[need - have :])
            valid = np.ones(len(name), dtype=bool)
            for end in offs[1:-1]:
                valid[max(0, end - MATCH + 1) : end] = False
            opens = valid.copy()
            opens[1:] &= (name[1:] != name[:-1]) | ~valid[:-1]
            heads = np.flatnonzero(opens)
            if not len(heads):
                continue
            bad = np.flatnonzero(valid[:-1] & ~valid[1:]) + 1  # ends of runs before an invalid place
            stop = np.append(heads[1:], len(name))
            if len(bad):
                nxt = np.searchsorted(bad, heads, side="right")
                stop = np.minimum(stop, np.append(bad, len(name))[nxt])
            yield a, b, base, heads, name[heads], stop - heads, piece, offs


def _bucket(names: np.ndarray, buckets: int) -> np.ndarray:
    return (((names * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _packed(names: np.ndarray) -> np.ndarray:
    """Names as 6 bytes each."""
    return names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]


def _names(packed) -> np.ndarray:
    six = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return np.concatenate([six, np.zeros((len(six), 2), np.uint8)], 1).view("<u8").ravel().astype(np.uint64)


def _bytes(parts: list) -> pa.Array:
    return pa.array([p if isinstance(p, bytes) else p.tobytes() for p in parts], pa.binary())


def seeds(block: pa.Table, buckets: int) -> pa.Table:
    """(bucket, block, names, twice): a block's distinct names, and whether two of its documents have them."""
    ids = block.column("doc_id").to_numpy()
    found_names, found_docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, _, _, heads, names, _, _, offsets in windows(block.column("text")):
        found_names.append(names)
        found_docs.append(ids[a + np.searchsorted(offsets, heads, side="right") - 1])
    names, docs = np.concatenate(found_names), np.concatenate(found_docs)
    order = np.argsort(names, kind="stable")
    names, docs = names[order], docs[order]
    first = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(names) else np.zeros(0, np.int64)
    low, high = (np.minimum.reduceat(docs, first), np.maximum.reduceat(docs, first)) if len(first) else (docs, docs)
    names, twice = names[first], low != high
    at = _bucket(names, buckets)
    order = np.argsort(at, kind="stable")
    cuts = np.searchsorted(at[order], np.arange(buckets + 1))
    rows = [(k, order[i:j]) for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
    own = block.column("block")[0].as_py()
    return pa.table({
        "bucket": pa.array([k for k, _ in rows], pa.int32()), "block": pa.array([own] * len(rows), pa.int32()),
        "names": _bytes([_packed(names[r]) for _, r in rows]), "twice": _bytes([twice[r] for _, r in rows]),
    })


def shared(bucket: pa.Table) -> pa.Table:
    """(block, bucket, names): of each block's names those that two documents have, here or there."""
    names = [_names(x.as_buffer()) for x in bucket.column("names")]
    twice = [np.frombuffer(x.as_buffer(), bool) for x in bucket.column("twice")]
    flat = np.sort(np.concatenate([*names, *(n[t] for n, t in zip(names, twice, strict=True))]))
    common = np.unique(flat[1:][flat[1:] == flat[:-1]])
    kept = [n[common[np.minimum(np.searchsorted(common, n), len(common) - 1)] == n] if len(common) else n[:0] for n in names]
    at = [i for i, k in enumerate(kept) if len(k)]
    return pa.table({"block": bucket.column("block").take(pa.array(at, pa.int64())), "bucket": bucket.column("bucket").take(pa.array(at, pa.int64())), "names": _bytes([_packed(kept[i]) for i in at])})


def segments(block: pa.Table, names: pa.Table, buckets: int, columns: tuple[str, ...] = _STRINGS) -> pa.Table:
    """A row for each bucket of a block: distinct segments with their smallest doc_id (_STRINGS), or where they stand (_PLACES).

    Segments come in the order of name and content, whatever the order of the block's rows. occ_row is the place of a text's
    key among the block's sorted keys; occ_later marks occurrences in a document other than the segment's smallest one, all of
    whose windows go.
    """
    known = np.unique(np.concatenate([np.zeros(0, np.uint64), *(_names(x.as_buffer()) for x in names.column("names"))]))
    none = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), *((c, pa.binary()) for c in columns)]).empty_table()
    if not block.num_rows or not len(known):
        return none
    ids, keys = block.column("doc_id").to_numpy(), np.unique(block.column("row").to_numpy(), return_inverse=True)[1]
    most = SEGMENT_BYTES - MATCH + 1
    name, digest, doc, row, start, size, piece_of, pieces, at = [], [], [], [], [], [], [], [], []
    for a, _, base, heads, names_, counts, piece, offsets in windows(block.column("text")):
        place = np.searchsorted(known, names_)
        hit = known[np.minimum(place, len(known) - 1)] == names_
        heads, names_, counts = heads[hit], names_[hit], counts[hit]
        cuts = -(-counts // most)
        part = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        begin = np.repeat(heads, cuts) + part * most
        length = np.minimum(np.repeat(counts, cuts) - part * most, most) + MATCH - 1
        own = a + np.searchsorted(offsets, begin, side="right") - 1
        name.append(np.repeat(names_, cuts))
        digest.append(textkit.span_hashes(textkit.prefix_sums(piece), begin, begin + length))
        doc.append(ids[own])
        row.append(keys[own])
        start.append(begin - offsets[own - a] + base)
        size.append(length)
        at.append(begin)
        piece_of.append(np.full(len(begin), len(pieces)))
        pieces.append(piece)
    if not name:
        return none
    name, digest, doc, row, start, size, at, piece_of = (np.concatenate(x) for x in (name, digest, doc, row, start, size, at, piece_of))
    bucket = _bucket(name, buckets)
    order = np.lexsort((doc, digest, name, bucket))
    name, digest, doc, row, start, size, at, piece_of, bucket = (x[order] for x in (name, digest, doc, row, start, size, at, piece_of, bucket))
    new = np.append(True, (digest[1:] != digest[:-1]) | (name[1:] != name[:-1])) if len(name) else np.zeros(0, bool)
    first, segment = np.flatnonzero(new), np.cumsum(new) - 1
    later = doc != doc[first][segment]
    seen = np.lexsort((start, row, bucket))  # in the order of the texts, which takes less room
    own, out = block.column("block")[0].as_py(), {c: [] for c in none.column_names}
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(edges)):
        i, j = edges[k], edges[k + 1]
        f = first[np.searchsorted(first, i) : np.searchsorted(first, j)]
        made = {"lengths": lambda: size[f].astype(np.int32)}
        made |= {"names": lambda: _packed(name[f]), "docs": lambda: doc[f].astype(np.int64), "bytes": lambda: b"".join([pieces[p][x : x + n].tobytes() for p, x, n in zip(piece_of[f], at[f], size[f], strict=True)])}
        made |= {"occ_row": lambda: row[seen[i:j]].astype(np.int32), "occ_start": lambda: start[seen[i:j]].astype(np.int32), "occ_segment": lambda: (segment[seen[i:j]] - segment[i]).astype(np.int32), "occ_later": lambda: np.packbits(later[seen[i:j]])}
        out["block"].append(own)
        out["bucket"].append(int(k))
        for c in columns:
            value = made[c]()
            out[c].append(value if isinstance(value, bytes) else value.tobytes())
    return pa.table({c: pa.array(out[c], none.schema.field(c).type) for c in none.column_names})


def suffix_array(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Order of all suffixes of a shard. text: bytes plus 1, strings ended by 0; left: bytes up to the end of the string.

    Ends differ from each other, by their place. Prefix doubling over the suffixes that are still tied.
    """
    n, width = len(text), 7
    key = np.zeros(n, np.uint64)
    for j in range(width):
        key <<= np.uint64(8)
        ahead = np.zeros(n, np.uint8)
        ahead[: n - j] = text[j:]
        key |= np.where(left > j, ahead, 0).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    sorted_key, ends = key[order], left[order] < width
    new = np.ones(n, dtype=bool)
    new[1:] = (sorted_key[1:] != sorted_key[:-1]) | ends[1:] | ends[:-1]
    begin = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = begin[np.cumsum(new) - 1]
    size = np.diff(np.append(begin, n))
    tied = order[np.repeat(size > 1, size)]
    while len(tied):
        own, ahead = rank[tied], rank[tied + width]
        by = np.argsort(own * n + ahead, kind="stable")
        tied, own, ahead = tied[by], own[by], ahead[by]
        group = np.append(True, own[1:] != own[:-1])
        new = group.copy()
        new[1:] |= ahead[1:] != ahead[:-1]
        at = np.arange(len(tied))
        group_at, new_at = np.maximum.accumulate(np.where(group, at, 0)), np.maximum.accumulate(np.where(new, at, 0))
        rank[tied] = own + new_at - group_at
        size = np.diff(np.append(np.flatnonzero(new), len(tied)))
        tied = tied[np.repeat(size > 1, size)]
        width *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class Shard:
    """Strings with their suffix array, transform and the step from a suffix to the one that begins a byte earlier."""

    def __init__(self, raw: np.ndarray, lengths: np.ndarray):
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        self.text = np.zeros(len(raw) + len(lengths), np.uint8)
        inside = np.ones(len(self.text), dtype=bool)
        inside[ends] = False
        self.text[inside] = raw + np.uint8(1)  # UTF-8 has no byte 255
        self.string = np.repeat(np.arange(len(lengths)), lengths + 1)
        self.left = ends[self.string] - np.arange(len(self.text))
        self.suffixes = suffix_array(self.text, self.left)
        self.transform = self.text[self.suffixes - 1]
        self.transform[np.isin(self.suffixes, starts, kind="table")] = 0
        at = np.argsort(self.transform, kind="stable")
        at = at[len(lengths) :]  # those that a byte precedes
        self.step = np.zeros(len(self.text), np.int64)
        self.step[at] = np.arange(len(lengths), len(self.text))


def merge(shards: list[Shard], depth: int = MATCH, all_prefixes: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(order, prefix): suffixes of all shards, numbered shard by shard in suffix order, interleaved by their first `depth`
    bytes; and the common prefix of each with the one before it, `depth` standing for that or more.

    Refines the interleaving until `depth` rounds are done or (all_prefixes) nothing is tied.
    """
    sizes = [len(s.text) for s in shards]
    base = np.cumsum([0, *sizes[:-1]])
    transform = np.concatenate([s.transform for s in shards])
    step = np.concatenate([s.step + b for s, b in zip(shards, base, strict=True)]).astype(np.int32)
    ends = np.concatenate([b + np.arange(len(s.left) - np.count_nonzero(s.left)) for s, b in zip(shards, base, strict=True)]).astype(np.int32)
    n, m = len(transform), len(ends)
    order, interval = np.arange(n, dtype=np.int32), np.zeros(n, np.int32)
    prefix = np.full(n, depth, np.int32)
    fresh = np.empty(n, dtype=bool)
    for h in range(1, depth + 1):
        before = transform[order]
        by = np.argsort(before, kind="stable")[m:]  # numpy sorts bytes by counting
        moved, byte = interval[by], before[by]
        order = np.concatenate([ends, step[order[by]]])
        fresh[: m + 1] = True
        fresh[m + 1 :] = (byte[1:] != byte[:-1]) | (moved[1:] != moved[:-1])
        prefix[fresh & (prefix == depth)] = h - 1
        interval = np.cumsum(fresh, dtype=np.int32)
        if all_prefixes and fresh.all():
            break
    return order, prefix


def decide(bucket: pa.Table) -> pa.Table:
    """(block, bucket, names, gone): for each window of a row's segments whether a smaller doc_id has the same bytes.

    Equal segments of all blocks are one string with its smallest doc_id. A name with one string only shares no window with
    another; the strings of the other names go into shards, whose transforms are merged.
    """
    columns = {c: [np.frombuffer(x.as_buffer(), t) for x in bucket.column(c)] for c, t in (("lengths", np.int32), ("bytes", np.uint8), ("docs", np.int64))}
    columns["names"] = [_names(x.as_buffer()) for x in bucket.column("names")]
    counts = [len(x) for x in columns["lengths"]]
    names, lengths, raw, docs = (np.concatenate(columns.pop(c)) for c in ("names", "lengths", "bytes", "docs"))
    lengths = lengths.astype(np.int64)
    starts, wide = np.cumsum(lengths) - lengths, lengths - MATCH + 1
    digest = np.concatenate([textkit.span_hashes(textkit.prefix_sums(raw[starts[i] : starts[j - 1] + lengths[j - 1]]), starts[i:j] - starts[i], starts[i:j] - starts[i] + lengths[i:j]) for i, j in _runs(lengths)])
    order = np.lexsort((docs, digest, names))
    new = np.append(True, (digest[order][1:] != digest[order][:-1]) | (names[order][1:] != names[order][:-1]))
    first = order[new]  # of each string the segment with the smallest doc_id
    string_of = np.empty(len(order), np.int64)
    string_of[order] = np.cumsum(new) - 1
    string_docs, string_names = docs[first], names[first]
    alone = np.append(True, string_names[1:] != string_names[:-1]) & np.append(string_names[1:] != string_names[:-1], True)
    gone, gone_at = np.zeros(int(wide[first].sum()), dtype=bool), np.cumsum(wide[first]) - wide[first]
    tied = np.flatnonzero(~alone)
    parts = max(1, -(-int(lengths[first[tied]].sum()) // MERGE_BYTES))
    part_of = (textkit.mix(string_names[tied]) % np.uint64(parts)).astype(np.int64)  # a name's strings stay together
    for part in range(parts):
        own = tied[part_of == part]
        if not len(own):
            continue
        size = lengths[first[own]]
        cuts = np.cumsum(size) // SHARD_BYTES
        groups = [own[cuts == c] for c in np.unique(cuts)]
        shards = []
        for g in groups:
            n = lengths[first[g]]
            shards.append(Shard(raw[np.repeat(starts[first[g]] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n))
        order, prefix = merge(shards)
        string = np.concatenate([g[s.string[s.suffixes]] for g, s in zip(groups, shards, strict=True)])[order]
        left = np.concatenate([s.left[s.suffixes] for s in shards])[order]
        begin = np.flatnonzero(prefix < MATCH)
        least = np.repeat(np.minimum.reduceat(string_docs[string], begin), np.diff(np.append(begin, len(order))))
        cut_ = (left >= MATCH) & (least < string_docs[string])
        gone[gone_at[string[cut_]] + lengths[first[string[cut_]]] - left[cut_]] = True
    edges = np.cumsum([0, *counts])
    out = []
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        n, own = wide[i:j], string_of[i:j]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out.append(np.packbits(gone[np.repeat(gone_at[own], n) + inner] | np.repeat(string_docs[own] < docs[i:j], n)))
    known = [np.unique(names[i:j]) for i, j in zip(edges[:-1], edges[1:], strict=True)]
    return pa.table({"block": bucket.column("block"), "bucket": bucket.column("bucket"), "names": _bytes([_packed(k) for k in known]), "gone": _bytes(out)})


def _runs(lengths: np.ndarray):
    """Ranges of segments of about SLICE_BYTES in all."""
    cuts = np.cumsum(lengths) // textkit.SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(cuts)) + 1).tolist(), len(lengths)]
    return [(i, j) for i, j in zip(edges[:-1], edges[1:], strict=True) if j > i]


def cut(block: pa.Table, found: pa.Table, buckets: int) -> pa.Table:
    """The texts of a block without removed bytes, by found (bucket, names, gone): the segments are looked up again."""
    if not block.num_rows:
        return pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]).empty_table()
    at_row, at_start = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    gone_of = dict(zip(found.column("bucket").to_pylist(), found.column("gone").to_pylist(), strict=True))
    for record in segments(block, found, buckets, _PLACES).to_pylist():
        wide = np.frombuffer(record["lengths"], np.int32).astype(np.int64) - MATCH + 1
        gone = np.unpackbits(np.frombuffer(gone_of[record["bucket"]], np.uint8)).astype(bool)
        segment = np.frombuffer(record["occ_segment"], np.int32)
        later = np.unpackbits(np.frombuffer(record["occ_later"], np.uint8), count=len(segment)).astype(bool)
        size, first = wide[segment], (np.cumsum(wide) - wide)[segment]
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        flag = gone[np.repeat(first, size) + inner] | np.repeat(later, size)
        at_row.append(np.repeat(np.frombuffer(record["occ_row"], np.int32), size)[flag])
        at_start.append((np.repeat(np.frombuffer(record["occ_start"], np.int32), size) + inner)[flag])
    at_row, at_start = np.concatenate(at_row), np.concatenate(at_start)
    order = np.argsort(at_row, kind="stable")
    at_row, at_start = at_row[order], at_start[order]
    keys = np.unique(block.column("row").to_numpy(), return_inverse=True)[1]
    out = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept")}
    for a, b, buf, offsets in textkit.text_slices(block.column("text")):
        change = np.zeros(len(buf) + 1, np.int32)
        for i in range(a, b):
            lo, hi = np.searchsorted(at_row, [keys[i]], side="left")[0], np.searchsorted(at_row, [keys[i]], side="right")[0]
            if lo < hi:
                place = offsets[i - a] + np.unique(at_start[lo:hi])
                change[place] += 1
                change[place + MATCH] -= 1
        removed = np.cumsum(change[:-1]) > 0
        begin, _ = textkit.runs_of(removed, offsets)
        spans = np.searchsorted(begin, offsets)
        total = np.append(0, np.cumsum(removed))[offsets]
        for i in range(b - a):
            x, y = offsets[i], offsets[i + 1]
            out["n_bytes"].append(int(y - x))
            out["n_removed"].append(int(total[i + 1] - total[i]))
            out["n_spans"].append(int(spans[i + 1] - spans[i]))
            out["kept"].append(buf[x:y][~removed[x:y]].tobytes() if total[i + 1] > total[i] else buf[x:y].tobytes())
    return pa.table({"doc_id": block.column("doc_id"), **{c: pa.array(out[c], pa.binary() if c == "kept" else pa.int64()) for c in out}})


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) of every row of (doc_id, text).

    Rows with one doc_id don't remove each other's bytes, equal rows have equal results; a row with null doc_id neither
    loses bytes nor makes others lose them; a null text counts as empty.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    blocks, buckets = max(1, -(-size // BLOCK_BYTES)), max(1, -(-size // BUCKET_BYTES))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text")).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    known = rows.filter("doc_id is not null")
    names = known.groupBy("block").applyInArrow(lambda t: seeds(t, buckets), "bucket int, block int, names binary, twice binary")
    common = names.groupBy("bucket").applyInArrow(shared, _SHARED)
    kinds = "block int, bucket int, " + ", ".join(f"{c} binary" for c in _STRINGS)
    strings = known.groupBy("block").cogroup(common.groupBy("block")).applyInArrow(lambda x, y: segments(x, y, buckets), kinds)
    gone = strings.groupBy("bucket").applyInArrow(decide, "block int, bucket int, names binary, gone binary")
    # one plan, in which the three readers of the blocks share one shuffle of the texts
    cut_ = known.groupBy("block").cogroup(gone.groupBy("block")).applyInArrow(lambda x, y: cut(x, y, buckets), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    zero = F.lit(0).cast("long")
    rest = rows.filter("doc_id is null").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.encode("text", "UTF-8").alias("kept"))
    return cut_.unionByName(rest)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut_ = dedup(textkit.table(spark, sf_dir, "documents"))
    return cut_.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
