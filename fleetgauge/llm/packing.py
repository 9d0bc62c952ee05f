"""Best-fit packing of token pieces into sequences, certified by dual-feasible-function bounds."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .encoding import piece_table, portions
from .storage import refuse, stored

_PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids (with ``end_id``), cut at ``capacity``.

    Only a document longer than ``capacity`` is cut; its last piece may be shorter. A null text is
    empty, its piece holds ``end_id`` alone.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(tokenizer)
        for batch in batches:
            for part in portions(batch, most=2_000_000):       # encoding holds some fifty times a portion
                ids, ends = table.encode(part.column("text"), end_id)
                ids = ids.astype("<u4")
                sizes = np.diff(ends, prepend=0)
                pieces = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), pieces)
                number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * capacity
                length = np.minimum(capacity, sizes[row] - start)
                begin = (ends - sizes)[row] + start
                crc = [zlib.crc32(ids[b:b + n]) for b, n in zip(begin.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(start),
                                                  pa.array(length), pa.array(crc, pa.int64())], names=_NAMES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, _PIECE)


def best_fit(lengths: Sequence[int], capacity: int) -> list[int]:
    """Best-fit decreasing: the bin of each length. Ties go to the length that comes first."""
    bins, free, count = [0] * len(lengths), [[] for _ in range(capacity + 1)], 0
    room = 0                                     # bit r: a bin with r tokens of room is there
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = room >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            b = free[left].pop()
            if not free[left]:
                room &= ~(1 << left)
            left -= n
        else:
            b, left, count = count, capacity - n, count + 1
        free[left].append(b)
        room |= 1 << left
        bins[i] = b
    return bins


def bin_bound(lengths: Sequence[int], capacity: int, rounds: int = 20) -> int:
    """A number of bins that no packing can go below.

    The largest bound among two families of dual feasible functions: for a threshold t, lengths
    over C - t count as full bins and lengths under t as nothing; for k, u_k rounds each length to k-ths.
    """
    lengths = np.asarray(lengths, np.int64)
    if not len(lengths):
        return 0
    number = np.bincount(lengths, minlength=capacity + 1)
    size = np.arange(capacity + 1)
    count, mass = np.concatenate([[0], np.cumsum(number)]), np.concatenate([[0], np.cumsum(number * size)])
    best = -(-int(mass[-1]) // capacity)
    t = np.arange(capacity // 2 + 1)
    huge = count[-1] - count[capacity - t + 1]                     # over C - t
    middle = mass[capacity - t + 1] - mass[t]                      # from t to C - t
    best = max(best, int((huge - (-middle // capacity)).max()))
    for k in range(1, rounds + 1):
        exact = size * (k + 1) % capacity == 0
        value = np.where(exact, size * k, size * (k + 1) // capacity * capacity)
        best = max(best, -(-int((value * number).sum()) // (k * capacity)))
    return best


def pack(pieces: DataFrame, capacity: int, group_rows: int = 100_000, rounds: int = 3) -> DataFrame:
    """Add sequence_id and offset (gapless from 0) to ``pieces`` (any columns; length from 1 to ``capacity``).

    Full pieces are sequences of their own. The others are dealt into groups of about ``group_rows``
    rows by a stored row number, so no content is hot. Each group is packed by best-fit decreasing and its
    bin count compared with its lower bound. Groups above their bound give up all bins that are
    not full, certified groups only their emptiest one; the given-up pieces are dealt into new groups and
    packed again, up to ``rounds`` times or until they fit one group whose count is certified.
    Every piece is packed exactly once whatever the input; an empty table gives no rows. Columns named sequence_id,
    offset, __uid, __group, __open or __gap raise a ValueError.
    """
    refuse(pieces, "sequence_id", "offset", "__uid", "__group", "__open", "__gap")
    rows = stored(pieces.withColumn("__uid", F.monotonically_increasing_id()), "pieces")
    full = rows.where(F.col("length") >= capacity).select(
        *pieces.columns, (F.col("__uid") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    loose, done = rows.where(F.col("length") < capacity), [full]
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, sequence_id bigint, offset bigint, __open boolean, __gap int"
    for turn in range(rounds):
        groups = max(1, -(-loose.count() // group_rows))
        last = turn == rounds - 1
        dealt = loose.withColumn("__group", F.pmod(F.xxhash64("__uid", F.lit(turn)), F.lit(groups)))
        packed = stored(dealt.groupBy("__group").applyInPandas(_packer(capacity, turn, last, groups == 1), schema), "packed")
        done.append(packed.where(~F.col("__open")).select(*pieces.columns, "sequence_id", "offset"))
        loose = packed.where("__open").select(*rows.columns)
        if last or loose.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def _packer(capacity: int, turn: int, last: bool, alone: bool) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Packs one group and marks the pieces it gives up as open."""
    def packed(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop(columns="__group").sort_values("__uid", ignore_index=True)
        length = frame["length"].to_numpy()
        bins = np.array(best_fit(length.tolist(), capacity))
        fill = np.bincount(bins, weights=length).astype(np.int64)
        gap = len(fill) - bin_bound(length, capacity)
        if last or alone and not gap:
            give = np.zeros(len(fill), bool)
        else:
            give = fill < capacity if gap else fill == fill.min()
        order = np.argsort(bins, kind="stable")
        inside = np.cumsum(length[order]) - length[order]
        first = np.concatenate([[True], np.diff(bins[order]) > 0])
        offset = np.empty(len(bins), np.int64)
        offset[order] = inside - np.repeat(inside[first], np.bincount(bins))
        ids = ((turn << 50 | int(key[0]) << 24) + bins) * 2 + 1
        return frame.assign(sequence_id=ids, offset=offset, __open=give[bins], __gap=np.int32(gap))

    return packed
