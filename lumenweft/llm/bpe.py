"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a linked list of byte slices. For each merge rank there is a bucket with the list positions whose
slice and its successor merge at that rank. Two levels of bit maps tell which buckets are filled; the lowest set
bit of the upper level, then of the word below it, is the next rank, so picking costs the same whatever the number
of ranks or of bytes: a pre-token of n bytes takes O(n log n) steps at worst (the log is the heap in one bucket).
Entries are never removed from a bucket when a merge makes them wrong; they are skipped when they come up.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweft.llm._common import small_batches, table, text_of

WORD_BITS = 256
#: Pre-tokens in the newer half of what a worker remembers; there is an older half as well. Bounds memory, not results.
MEMO_ENTRIES = 500_000
MEMO_CHARS = 64


class RankQueue:
    """Buckets by rank under two levels of bit maps."""

    def __init__(self, n_ranks: int) -> None:
        self.words = [0] * (n_ranks // WORD_BITS + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            word = rank // WORD_BITS
            self.words[word] |= 1 << rank % WORD_BITS
            self.top |= 1 << word
        else:
            heappush(bucket, position)

    def pop(self) -> tuple[int, int] | None:
        """The leftmost position of the lowest rank, or None."""
        top = self.top
        if not top:
            return None
        word = (top & -top).bit_length() - 1
        bits = self.words[word]
        low = bits & -bits
        rank = word * WORD_BITS + low.bit_length() - 1
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.words[word] = bits = bits ^ low
            if not bits:
                self.top = top & (top - 1)
        return rank, position


class Codec:
    """Encodes and decodes by a file of ranks (base64 token, blank, rank on each line)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.vocab: dict[int, bytes] = {v: k for k, v in ranks.items()}
        self.decimal = {v: str(v) for v in self.vocab}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.memo: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> Codec:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token by merging the pair of the lowest rank, the leftmost first."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        n, get, queue = len(piece), ranks.get, self.queue
        end = list(range(1, n + 1))  # end[i]: where the slice that begins at i ends; 0 once it is merged away
        before = list(range(-1, n - 1))
        at = [-1] * n  # the rank at which the slice at i merges with the next
        first: dict[int, list[int]] = {}
        for i in range(n - 1):
            r = get(piece[i : i + 2])
            if r is not None:
                at[i] = r
                first.setdefault(r, []).append(i)
        push = queue.push
        for r, where in first.items():
            push(r, where[0])
            if len(where) > 1:
                queue.buckets[r].extend(where[1:])  # ascending, so it is a heap
        while (top := queue.pop()) is not None:
            rank, i = top
            if at[i] != rank or not end[i]:
                continue  # stale
            j = end[i]
            k = end[j]
            end[i], end[j], at[j] = k, 0, -1
            if k < n:
                before[k] = i
                r = get(piece[i : end[k]])
                at[i] = -1 if r is None else r
                if r is not None:
                    push(r, i)
            else:
                at[i] = -1
            h = before[i]
            if h >= 0:
                r = get(piece[h:k])
                at[h] = -1 if r is None else r
                if r is not None:
                    push(r, h)
        out, i = [], 0
        while i < n:
            j = end[i]
            out.append(ranks[piece[i:j]])
            i = j
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """Ids of a text; each match of the pattern is merged separately."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        if len(self.memo) > MEMO_ENTRIES:  # pre-tokens that come up again move from the older half to the newer one
            self.old, self.memo = self.memo, {}
        memo, old = self.memo, self.old
        pieces = [self.find(t) for t in texts]
        for p in set(chain.from_iterable(pieces)).difference(memo):
            if p in old:
                memo[p] = old[p]
            elif len(p) <= MEMO_CHARS:
                memo[p] = self.merge(p.encode())
        for found in pieces:
            try:
                yield list(chain.from_iterable(map(memo.__getitem__, found)))
            except KeyError:  # very long pre-tokens are not remembered
                yield list(chain.from_iterable(memo[p] if p in memo else self.merge(p.encode()) for p in found))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for this file; kept between batches and tasks."""
    key = (path, pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec.from_file(path, pattern)
    return _CODECS[key]


def _mapped(docs: DataFrame, schema: str, path: str, pattern: str, row) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            yield row(c, batch)

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids array<int> of every whole text. Null text: no ids. Repeated rows are encoded each."""

    def row(c: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = list(c.encode_all(batch.column(1).to_pylist()))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _mapped(text_of(docs, doc_id, text), "doc_id bigint, ids array<int>", path, pattern, row)


def decode(encoded: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, bytes binary: what the ids stand for, byte for byte. Null or empty ids: no bytes; an id that the file lacks is an error."""

    def row(c: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [c.decode(x or ()) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return _mapped(encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids")), "doc_id bigint, bytes binary", path, pattern, row)


def round_trip(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of what they decode to, without moving ids out of the worker.

    Null text counts as empty: no ids, and the digests of the empty string.
    """

    def row(c: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        n, a, b = [], [], []
        for ids in c.encode_all(batch.column(1).to_pylist()):
            n.append(len(ids))
            a.append(hashlib.sha256(" ".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest())
            b.append(hashlib.sha256(c.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _mapped(text_of(docs, doc_id, text), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", path, pattern, row)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return round_trip(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


QUERIES = {"op5_byte_bpe": op5_byte_bpe}
ORACLES: dict[str, str] = {}
