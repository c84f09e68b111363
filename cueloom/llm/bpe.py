"""Byte-level BPE with a rank queue made of a hierarchical bitmap.

A pre-token's bytes form a linked list. Every adjacent pair whose bytes are a vocabulary entry stands in the bucket of its
merge rank; a two-level bitmap over the ranks gives the lowest occupied rank by find-first-set. A merge never searches
the list: it takes the leftmost position of the lowest bucket, skips it if stale, joins two nodes and files the two new
pairs. So a pre-token of n bytes takes O(n log n) steps, however long it is.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit

#: Entries of a worker's memory of encoded pre-tokens, and the longest pre-token it keeps; beyond that it starts anew.
MEMORY_ENTRIES, MEMORY_CHARS = 1_000_000, 64
#: Pre-tokens encoded at a time, which bounds what a very long text takes.
STEP = 200_000


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: merges the lowest-ranked adjacent pair, leftmost first, until none is left.

    The queue: `buckets` holds the position of a rank's only pair, or a heap of positions; `low` has a bit for each occupied
    rank in words of 256, `top` a bit for each word that isn't zero. Bits are looked up from the top by find-first-set.
    """
    get = ranks.get
    if (whole := get(piece)) is not None:
        return [whole]
    n = len(piece)
    after = list(range(1, n + 1))  # the node that follows; n ends the list
    before = list(range(-1, n))
    pair = [-1] * n  # rank of the pair that begins here; -1 if none or swallowed
    top, low, buckets = 0, {}, {}
    for at in range(n - 1):
        rank = get(piece[at : at + 2])
        if rank is not None:
            pair[at] = rank
            if rank not in buckets:
                buckets[rank] = at
                word = rank >> 8
                low[word] = low.get(word, 0) | 1 << (rank & 255)
                top |= 1 << word
            elif isinstance(held := buckets[rank], int):
                buckets[rank] = [held, at]
            else:
                held.append(at)  # positions come in order
    while top:
        word = (top & -top).bit_length() - 1
        bits = low[word]
        rank = word << 8 | (bits & -bits).bit_length() - 1
        held = buckets[rank]
        if isinstance(held, int):
            at = held
        else:
            at = heappop(held)
        if isinstance(held, int) or not held:
            del buckets[rank]
            bits &= bits - 1
            low[word] = bits
            if not bits:
                top &= top - 1
        if pair[at] != rank:  # stale: a neighbour's merge has changed this pair
            continue
        gone = after[at]
        end = after[at] = after[gone]
        before[end] = at
        pair[gone] = pair[at] = -1
        if end < n:
            rank = get(piece[at : after[end]])
            if rank is not None:
                pair[at] = rank
                if rank not in buckets:
                    buckets[rank] = at
                    word = rank >> 8
                    low[word] = low.get(word, 0) | 1 << (rank & 255)
                    top |= 1 << word
                elif isinstance(held := buckets[rank], int):
                    buckets[rank] = [held, at] if held < at else [at, held]
                else:
                    heappush(held, at)
        start = before[at]
        if start >= 0:
            rank = get(piece[start:end])
            pair[start] = -1
            if rank is not None:
                pair[start] = rank
                if rank not in buckets:
                    buckets[rank] = start
                    word = rank >> 8
                    low[word] = low.get(word, 0) | 1 << (rank & 255)
                    top |= 1 << word
                elif isinstance(held := buckets[rank], int):
                    buckets[rank] = [held, start] if held < start else [start, held]
                else:
                    heappush(held, start)
    ids, at = [], 0
    while at < n:
        end = after[at]
        ids.append(ranks[piece[at:end]])
        at = end
    return ids


@functools.cache
def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file, read once a worker."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Codec:
    """Encodes and decodes texts by one vocabulary; pre-tokens met before are looked up."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.bytes = {i: token for token, i in ranks.items()}
        self.memory: dict[str, tuple[int, ...]] = {}

    def _missed(self, token: str) -> list[int] | tuple[int, ...]:
        ids = merge(token.encode("utf-8"), self.ranks)
        if len(token) <= MEMORY_CHARS:
            if len(self.memory) >= MEMORY_ENTRIES:
                self.memory.clear()
            self.memory[token] = ids = tuple(ids)  # which the garbage collector need not visit
        return ids

    def steps(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, by STEP pre-tokens at a time."""
        get, missed = self.memory.get, self._missed
        if len(text) <= STEP:
            yield list(chain.from_iterable([get(t) or missed(t) for t in self.split.findall(text)]))
            return
        ids: list[int] = []
        for k, m in enumerate(self.split.finditer(text), 1):
            ids += get(m[0]) or missed(m[0])
            if k % STEP == 0:
                yield ids
                ids = []
        yield ids

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.steps(text)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(load_ranks(path), pattern)
    return _codecs[path, pattern]


def encode_column(docs: DataFrame, path: str, pattern: str, column: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>) of every row: the whole text's ids without special tokens. A null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [own.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    return docs.select(key, column).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, ids array<int>")


def decode_column(tokens: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """(key, text) from (key, ids); bytes that are not UTF-8 become replacement characters. Null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [own.decode(i or []).decode("utf-8", "replace") for i in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], [key, "text"])

    return tokens.select(key, "ids").mapInArrow(run, f"{key} {tokens.schema[key].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str, pattern: str, packed: bool = False) -> DataFrame:
    """Digests of encoding and decoding every whole text: (doc_id, n_tokens, ids_sha256, decoded_sha256).

    packed adds ids: binary, little-endian 32-bit integers. A null text counts as empty: no tokens, digests of the empty string. Repeated rows give a row each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        decimals = {i: str(i) for i in own.bytes}
        for batch in batches:
            counts, hashes, decoded, held = [], [], [], []
            for value in batch.column(1):
                n, ids_hash, text_hash, parts = 0, hashlib.sha256(), hashlib.sha256(), []
                for ids in own.steps(value.as_py() or ""):
                    if ids:
                        ids_hash.update(((b"," if n else b"") + ",".join(map(decimals.__getitem__, ids)).encode()))
                        text_hash.update(own.decode(ids))
                        n += len(ids)
                        if packed:
                            parts.append(np.array(ids, "<i4").tobytes())
                held.append(b"".join(parts))
                counts.append(n)
                hashes.append(ids_hash.hexdigest())
                decoded.append(text_hash.hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string()), pa.array(held, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns[: 5 if packed else 4], names[: 5 if packed else 4])

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * packed
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def vocabulary() -> tuple[str, str]:
    """Path and pattern of the multilingual byte-level vocabulary that the box provides."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(textkit.table(spark, sf_dir, "documents"), *vocabulary())
