"""Best-fit packing with certified bin counts.

Documents become pieces of at most ``capacity`` tokens. Full pieces are sequences of their own; the rest
are dealt to partitions of bounded size. A dual-feasible function maps lengths so that no full bin maps to
more than a bin, so a sum of mapped lengths bounds the bins that any packing needs. The function that
bounds all pieces best, found from the counts of lengths, also tells each partition its share of that
bound. Each partition packs by best-fit decreasing; where its bins are its share, the packing is certified
and stays whole. Where they are the share rounded up, it stays but for the loosest bins that hold the
rounding's room: such remainders of several partitions make up whole bins. Any other partition gives up
its loosest bins. What is given up is dealt anew, to fewer partitions, and packed again, until no gap is
left or one partition holds all that is. Each row tells how many bins the partition that placed it kept,
and the bound on the bins that its pieces need by themselves.
"""

from __future__ import annotations

import math
import zlib
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlink.llm.common import map_rows
from ledgerlink.llm.words import coder
from ledgerlink.runtime import materialise

CAPACITY = 1024
#: Pieces that a partition packs at once, about; bounds a task's memory.
PARTITION_PIECES = 20_000
ROUNDS = 8
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: all are full but the first, which takes the rest."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)] if n else []


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of each row's whole text (null: empty), with ``end_id`` behind it."""

    def make():
        own = coder(vocabulary)
        end = np.array([end_id], "<u4").tobytes()

        def work(ids: list, texts: list) -> dict:
            rows = []
            for doc, coded in zip(ids, own.encode([t or "" for t in texts]), strict=True):
                whole = memoryview(coded + end)
                rows += [(doc, k, s, n, zlib.crc32(whole[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(whole) // 4, capacity))]
            return dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), zip(*rows, strict=True), strict=True)) if rows else dict.fromkeys(("doc_id", "piece", "start", "length", "ids_crc32"), [])

        return work

    return map_rows(docs, _PIECE, make)


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length: longest first, each into the open bin that it leaves least room in.

    Open bins stand in stacks by room left; the set of rooms in use is one integer, so the smallest that
    suffices is its lowest bit at or above the length.
    """
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, made
            made += 1
        bins[i], offsets[i] = b, capacity - room
        if room > n:
            stacks[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins, offsets


def best_function(count: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """(value, scale): of two families of dual-feasible functions the one that bounds ``count[n]`` pieces of each length ``n`` best.

    The bound is the sum of ``value`` over all pieces, over ``scale``. Thresholding: over ``capacity - e``
    counts as a bin, under ``e`` as nothing. Rounding with ``k``: ``(k + 1) * x`` if whole, else its floor
    over ``k``.
    """
    count, size = count.astype(np.int64), np.arange(capacity + 1, dtype=np.int64)
    functions = [(size, capacity)]
    for e in range(1, capacity // 2 + 1):
        functions.append((np.where(size > capacity - e, capacity, np.where(size < e, 0, size)), capacity))
    for k in range(1, 41):
        up = size * (k + 1)
        functions.append((np.where(up % capacity == 0, size * k, up // capacity * capacity), k * capacity))
    return max(functions, key=lambda f: Fraction(int((count * f[0]).sum()), f[1]))


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing of ``lengths`` needs."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1), capacity) if len(lengths) else 0


def bound_of_counts(count: np.ndarray, capacity: int = CAPACITY) -> int:
    value, scale = best_function(count, capacity)
    return -(-int((count * value).sum()) // scale)


def _counts(pieces: DataFrame, capacity: int) -> np.ndarray:
    """Pieces of each length; at most ``capacity`` rows reach the driver."""
    count = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():
        count[r["length"]] = r["count"]
    return count


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """Sequences of a whole packing, and the bound on any packing of its pieces."""
    return packed.where("offset = 0").count(), bound_of_counts(_counts(packed, capacity), capacity)


_PACKED = _PIECE + ", bucket long, bin long, offset long, settled boolean, bins long, bound long"


def _pack_bucket(capacity: int, last: bool, released: int, function: tuple[np.ndarray, int]):
    """Pack one bucket; settled rows keep their bin, the others go into the next exchange.

    ``function`` is the dual-feasible function that bounds all pieces best.
    """

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        lengths = rows["length"].to_numpy(np.int64)
        bins, offsets = best_fit_decreasing(lengths, capacity)
        n, bound = int(bins.max()) + 1, lower_bound(lengths, capacity)
        value, scale = function
        gap = Fraction(n) - Fraction(int(value[lengths].sum()), scale)
        settled = np.ones(len(rows), bool)
        if not last and gap > 0:
            fill = np.bincount(bins, weights=lengths, minlength=n).astype(np.int64)
            size = np.bincount(bins, minlength=n)
            order = np.argsort(fill, kind="stable")
            order = order[fill[order] < capacity]
            enough = int(np.searchsorted(np.cumsum(size[order]), released))
            if gap < 1:
                enough = min(enough, 1 + int(np.searchsorted(np.cumsum(capacity - fill[order]), math.ceil(gap * capacity))))
            give = order[: max(1, enough)]
            settled = ~np.isin(bins, give)
            n, bound = n - len(give), lower_bound(lengths[settled], capacity)
        return rows.assign(bin=bins, offset=offsets, settled=settled, bins=n, bound=bound)

    return pack


def pack(pieces: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, partition_bins, partition_bound of each row of ``pieces``.

    A round deals at most about ``partition_pieces`` rows to a partition whatever their keys, by a hash
    of the row's place, so repeated rows spread. Each round gives up a share of its loosest bins only;
    the number of partitions falls by half at least, and the last one keeps all.
    """
    placed = materialise(pieces, "packing-pieces")
    full = placed.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    full = full.withColumn("partition_bins", F.lit(1).cast("long")).withColumn("partition_bound", F.lit(1).cast("long"))
    loose = placed.where(F.col("length") < capacity)
    done = full.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "partition_bins", "partition_bound")
    buckets = None
    for k in range(rounds):
        count = _counts(loose, capacity)
        if not count.any():
            break
        want = -(-int(count.sum()) // partition_pieces)
        buckets = want if buckets is None else min(want, max(1, buckets // 2))
        last = buckets == 1 or k == rounds - 1
        # a group that is asked for half the bins' rows at most brings the next round to half the groups
        dealt = loose.withColumn("bucket", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(k)), F.lit(buckets)))
        packed = materialise(dealt.groupBy("bucket").applyInPandas(_pack_bucket(capacity, last, max(1, partition_pieces // 8), best_function(count, capacity)), _PACKED), "packing-round")
        kept = packed.where("settled")
        done = done.unionAll(kept.select("doc_id", "piece", "start", "length", "ids_crc32", F.expr(f"shiftleft({k}L, 56) + shiftleft(bucket, 28) + bin").alias("sequence_id"), "offset", F.col("bins").alias("partition_bins"), F.col("bound").alias("partition_bound")))
        loose = packed.where("not settled").select("doc_id", "piece", "start", "length", "ids_crc32")
        if last:
            break
    return done


def best_fit_packing(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack each row's whole text; a row out for each piece.

    Null and empty texts are the end token alone. Null ids and repeated rows are documents like others.
    Only documents over ``capacity`` are cut; their first piece takes what is left over. Sequence numbers
    are unique, not dense; offsets are gapless from 0 in each sequence. Other columns are not read.
    """
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return pack(pieces(plain, vocabulary, end_id, capacity), capacity)
