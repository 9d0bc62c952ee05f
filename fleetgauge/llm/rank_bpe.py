"""Byte-level BPE by merge ranks: encoding through a queue of ranks, and decoding.

Merging always takes the pair of neighbours of lowest rank, the leftmost of several. Ranks are small whole
numbers, so the queue keeps one bucket per rank with the places of its pairs, and over the buckets a
hierarchy of bitmaps: a bit of the lowest says whether a bucket holds anything, a bit of the next whether a
word of the one below does. The next rank is found by one find-first-set a level. Tokens form linked
lists; a place whose pair has since changed is stale and is skipped when its bucket is emptied.

A long pre-token is merged by itself, in n log n steps. The short ones of a portion of text that are not known yet
lie one after the other in the same lists, with no pair across their borders, so that one bucket holds the
places of a rank in all of them and is emptied at once.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .encoding import portions

WORD_BITS = 6
#: Bytes of the longest pre-token that is merged together with others.
SHORT = 64
_CODERS: dict[tuple[str, str], "RankCoder"] = {}


class RankQueue:
    """Buckets by rank under a hierarchy of bitmaps; the caller chooses what a bucket's list holds."""

    def __init__(self, ranks: int):
        self.buckets: list[list] = [[] for _ in range(ranks)]
        self.levels: list[list[int]] = []
        words = ranks
        while not self.levels or words > 1:
            words = max(1, -(-words >> WORD_BITS))
            self.levels.append([0] * words)

    def mark(self, rank: int) -> None:
        """Say that the bucket of ``rank``, empty until now, holds something."""
        for level in self.levels:
            at, bit = rank >> WORD_BITS, 1 << (rank & (1 << WORD_BITS) - 1)
            held, level[at] = level[at], level[at] | bit
            if held:
                return                                      # the words above know already
            rank = at

    def unmark(self, rank: int) -> None:
        """Say that the bucket of ``rank`` is empty."""
        for level in self.levels:
            at, bit = rank >> WORD_BITS, 1 << (rank & (1 << WORD_BITS) - 1)
            level[at] &= ~bit
            if level[at]:
                return
            rank = at

    def lowest(self) -> int:
        """The lowest rank whose bucket holds something, -1 if none does."""
        if not self.levels[-1][0]:
            return -1
        rank = 0
        for level in reversed(self.levels):
            word = level[rank]
            rank = rank << WORD_BITS | (word & -word).bit_length() - 1
        return rank


class RankCoder:
    """Token ids by merge ranks. Pre-tokens met before are kept with their ids: at most ``limit`` of them, and
    32 bytes for each on average, beyond those of the portion at hand; a full table starts afresh.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, limit: int = 400_000):
        self.ranks, self.split, self.limit = ranks, regex.compile(pattern), limit
        size = max(ranks.values()) + 1
        self.queue = RankQueue(size)
        content = [b""] * size
        for token, rank in ranks.items():
            content[rank] = token
        self.lengths = np.array([len(c) for c in content], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(content), np.uint8)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        pairs = np.array(sorted(pairs), np.int64).reshape(-1, 3)
        self.pair_keys, self.pair_ranks = pairs[:, 0] * size + pairs[:, 1], pairs[:, 2].astype(np.int32)
        # a merge can make a pair of lower rank than its own only if its token is part of a token that ranks before it
        lowest = np.full(size, size, np.int64)
        for part in (0, 1):
            np.minimum.at(lowest, pairs[:, part], pairs[:, 2])
        self.ascending = (lowest > np.arange(size)).tolist()
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens, -1 where they do not merge."""
        keys = left.astype(np.int64) * len(self.lengths) + right
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1).astype(np.int32) if len(self.pair_keys) else np.full(len(keys), -1, np.int32)

    def merge_long(self, piece: bytes) -> bytes:
        """Ids of one pre-token as little-endian unsigned 32-bit integers. Buckets are heaps of places."""
        queue, rank_of, n = self.queue, self.ranks.get, len(piece)
        tokens = [piece[i:i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [-1] * n                                     # rank of the pair that begins at a place

        def renew(place: int) -> None:
            follower = after[place]
            rank = pair[place] = rank_of(tokens[place] + tokens[follower], -1) if follower < n else -1
            if rank >= 0:
                bucket = queue.buckets[rank]
                heapq.heappush(bucket, place)
                if len(bucket) == 1:
                    queue.mark(rank)

        for place in range(n):
            renew(place)
        while (rank := queue.lowest()) >= 0:
            bucket = queue.buckets[rank]
            place = heapq.heappop(bucket)
            if not bucket:
                queue.unmark(rank)
            if pair[place] != rank:
                continue                                    # stale
            gone = after[place]
            tokens[place] += tokens[gone]
            after[place], pair[gone] = after[gone], -1
            if after[gone] < n:
                before[after[gone]] = place
            renew(place)
            if before[place] >= 0:
                renew(before[place])
        ids, place = array("I"), 0
        while place < n:
            ids.append(self.ranks[tokens[place]])
            place = after[place]
        return np.array(ids, "<u4").tobytes()

    def _push(self, ranks: np.ndarray, places: np.ndarray) -> None:
        """Put ascending places into the buckets of their ranks; a negative rank is no pair. Buckets are lists of arrays."""
        real = ranks >= 0
        ranks, places = ranks[real], places[real]
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        begins = np.flatnonzero(np.diff(ranks, prepend=-1))
        ends = np.append(begins[1:], len(ranks))
        for rank, a, b in zip(ranks[begins].tolist(), begins.tolist(), ends.tolist()):
            bucket = self.queue.buckets[rank]
            bucket.append(places[a:b])
            if len(bucket) == 1:
                self.queue.mark(rank)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each of some non-empty pre-tokens as little-endian unsigned 32-bit integers."""
        sizes = np.array([len(p) for p in pieces])
        ends, n = np.cumsum(sizes), int(sizes.sum())
        owner = np.repeat(np.arange(len(pieces)), sizes)
        tokens = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends - 1], before[ends - sizes] = -1, -1
        alive, pair = np.ones(n, bool), np.full(n, -1, np.int32)      # pair: rank of the pair that begins at a place
        inner = np.flatnonzero(after >= 0)
        pair[inner] = self._rank(tokens[inner], tokens[inner + 1])
        self._push(pair[inner], inner)
        while (rank := self.queue.lowest()) >= 0:
            bucket, self.queue.buckets[rank] = self.queue.buckets[rank], []
            self.queue.unmark(rank)
            places = bucket[0] if len(bucket) == 1 else np.unique(np.concatenate(bucket))
            places = places[pair[places] == rank]           # the others are stale
            if not len(places):
                continue
            if not self.ascending[rank]:                    # a lower rank may come up: one merge a pre-token, then look again
                first = np.unique(owner[places], return_index=True)[1]
                if len(first) < len(places):
                    self.queue.buckets[rank].append(np.delete(places, first))
                    self.queue.mark(rank)
                    places = places[first]
            elif len(places) > 1:                           # of pairs that share a token, the leftmost goes first
                shared = np.flatnonzero(after[places[:-1]] == places[1:])
                if len(shared):
                    index = np.arange(len(places))
                    start = index.copy()
                    start[shared + 1] = 0            # a run of such pairs has the number of its first
                    places = places[(index - np.maximum.accumulate(start)) % 2 == 0]
            gone = after[places]
            follower = after[gone]
            followed = follower >= 0
            tokens[places], after[places], pair[places], pair[gone], alive[gone] = rank, follower, -1, -1, False
            before[follower[followed]] = places[followed]
            left = before[places]
            changed = np.union1d(places[followed], left[left >= 0])
            if len(changed):
                pair[changed] = ranks = self._rank(tokens[changed], tokens[after[changed]])
                self._push(ranks, changed)
        upto = np.cumsum(alive)[ends - 1] * 4
        ids = tokens[alive].astype("<u4").tobytes()
        return [ids[a:b] for a, b in zip([0, *upto[:-1].tolist()], upto.tolist())]

    def learn(self, pieces: Iterable[str]) -> None:
        """Keep the ids of all these pre-tokens."""
        if len(self.known) > self.limit or self.held > 32 * self.limit:
            self.known, self.held = {}, 0
        new = [p for p in set(pieces) if p not in self.known]
        content = [p.encode() for p in new]
        self.held += sum(map(len, content))
        short = []
        for piece, coded in zip(new, content):
            whole = self.ranks.get(coded)                   # a pre-token that is a token is that token
            if whole is not None:
                self.known[piece] = whole.to_bytes(4, "little")
            elif len(coded) > SHORT:
                self.known[piece] = self.merge_long(coded)
            else:
                short.append((piece, coded))
        if short:
            self.known.update(zip([p for p, _ in short], self.merge_many([c for _, c in short])))

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.split.findall(t) for t in texts]
        self.learn(p for pieces in split for p in pieces)
        return [b"".join(map(self.known.__getitem__, pieces)) for pieces in split]

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.lengths[ids]
        ends = np.cumsum(n)
        return self.bytes[np.repeat(self.begins[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: a line holds a token in base 64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _coder(path: str, pattern: str) -> RankCoder:
    """The worker's coder; it lives as long as the worker process."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = RankCoder(read_ranks(path), pattern)
    return _CODERS[path, pattern]


def encode_bpe(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, ids: the token ids of each whole text of ``docs`` (doc_id, text), one after the other as
    little-endian unsigned 32-bit integers. ``id_array`` gives them as an array.

    ``ranks`` is the path of a rank file that every executor has, ``pattern`` splits a text into pre-tokens. Special
    strings inside texts are ordinary text. A null or empty text has no ids. Repeated rows and null doc_ids stay as they
    are; an empty table gives no rows; further columns are not read.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks, pattern)
        for batch in batches:
            for part in portions(batch, most=4_000_000):
                ids = coder.encode([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(encode, T.StructType([docs.schema["doc_id"], T.StructField("ids", T.BinaryType())]))


def decode_bpe(coded: DataFrame, ranks: str, pattern: str = "") -> DataFrame:
    """doc_id, ids, content: the bytes that ``ids`` (as from ``encode_bpe``) stand for. Null ids have null content.

    An id beyond the file's ranks is an error.
    """
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks, pattern)
        for batch in batches:
            for part in portions(batch, "ids"):
                content = [x.as_py() if not x.is_valid else coder.decode(np.frombuffer(x.as_buffer(), "<u4")) for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(content, pa.binary())],
                                                 names=["doc_id", "ids", "content"])

    return coded.select("doc_id", "ids").mapInArrow(decode, T.StructType([coded.schema["doc_id"], coded.schema["ids"], T.StructField("content", T.BinaryType())]))


def id_array(coded: DataFrame) -> DataFrame:
    """doc_id, ids as array<bigint>."""
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False) // 4
            flat = np.frombuffer(b"".join(x.as_py() or b"" for x in batch.column("ids")), "<u4").astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "ids"])

    return coded.select("doc_id", "ids").mapInArrow(unpack, T.StructType([coded.schema["doc_id"], T.StructField("ids", T.ArrayType(T.LongType()))]))


def bpe_digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as stored), decoded_sha256 (of the bytes they decode to)."""
    coded = decode_bpe(encode_bpe(docs, ranks, pattern), ranks, pattern)
    return coded.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("content", 256).alias("decoded_sha256"))
