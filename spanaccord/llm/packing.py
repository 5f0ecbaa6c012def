"""Operator 7: packing token sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from spanaccord.llm.common import text_of
from spanaccord.llm.tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], ways: int) -> list[list[int]]:
    """Partition items into ``ways`` sets of nearly equal sums: lists of item numbers.

    Each item begins as a partial partition with one filled set.  The two partial
    partitions with the largest spread are merged again and again, the fullest
    sets of one meeting the emptiest of the other.  Only filled sets are stored;
    sums are kept relative to the least one.  Ties go to the smaller item number.
    """
    heap: list[tuple[int, int, list[tuple[int, list[int]]]]] = []
    for k, s in enumerate(sizes):
        heap.append((-s, k, [(s, [k])]))
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        _, ka, a = heapq.heappop(heap)
        _, kb, b = heapq.heappop(heap)
        # both sorted by sum, falling, without their empty sets
        over = len(a) + len(b) - ways
        if over <= 0:
            merged = a + b
        else:
            # the last ``over`` sets of a, from the least, take the sets of b from the fullest
            keep = a[: len(a) - over]
            tail_a, tail_b = a[len(a) - over :], b[len(b) - over :]
            merged = keep + b[: len(b) - over] + [(x[0] + y[0], x[1] + y[1]) for x, y in zip(reversed(tail_a), tail_b)]
        merged.sort(key=lambda x: -x[0])
        if len(merged) == ways and (low := merged[-1][0]):
            merged = [(s - low, m) for s, m in merged]
        spread = merged[0][0] - (merged[-1][0] if len(merged) == ways else 0)
        heapq.heappush(heap, (-spread, min(ka, kb, n), merged))
    sets = [m for _, m in heap[0][2]] if heap else []
    return sets + [[] for _ in range(ways - len(sets))]


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows that all hold at most ``capacity``; starts from the least possible number and adds windows until all fit."""
    total = sum(sizes)
    ways = max(1, -(-total // capacity))
    while True:
        sets = difference(sizes, ways)
        if all(sum(sizes[k] for k in s) <= capacity for s in sets):
            return [s for s in sets if s]
        ways += 1


def _padding(n: int, capacity: int) -> int:
    return 0 if n & (n - 1) == 0 else capacity - n


class _Packer:
    """Deals pieces of one task's documents to sequences, a bounded block at a time."""

    def __init__(self, task: int, capacity: int, block: int, piece: int):
        self.next, self.capacity, self.block, self.piece = task << 36, capacity, block, piece
        self.rows: list[tuple] = []
        self.held: list[tuple] = []  # (doc, start, ids, doc_tokens)
        self.size = 0

    def _put(self, members: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in members:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next, at, ids))
            at += n
        self.next += 1

    def add(self, doc, ids: bytes) -> None:
        n = len(ids) // 4
        full = n // self.capacity * self.capacity
        for s in range(0, full, self.capacity):
            self._put([(doc, s, ids[4 * s : 4 * (s + self.capacity)], n)])
        for s in range(full, n, self.piece):
            e = min(n, s + self.piece)
            self.held.append((doc, s, ids[4 * s : 4 * e], n))
            self.size += e - s
        if self.size >= self.block * self.capacity:
            self.flush(False)

    def flush(self, last: bool) -> None:
        """Pack what is held; but for the last block, the emptiest windows wait for the next one."""
        if not self.held:
            return
        held, whole = self.held, self.size // self.capacity
        self.held, self.size = [], 0
        if whole == 0:
            if last:
                self._tail(held)
            else:
                self.held, self.size = held, sum(len(x[2]) // 4 for x in held)
            return
        # leave a little less than one window's worth out, so that the windows are nearly full
        total, rest, k = sum(len(x[2]) // 4 for x in held), [], 0
        order = sorted(range(len(held)), key=lambda i: (len(held[i][2]), i))
        while k < len(order) and total > whole * self.capacity:
            i = order[k]
            total -= len(held[i][2]) // 4
            rest.append(i)
            k += 1
        out = set(rest)
        kept = [x for i, x in enumerate(held) if i not in out]
        for s in windows([len(x[2]) // 4 for x in kept], self.capacity):
            self._put([kept[i] for i in sorted(s)])
        left = [held[i] for i in sorted(rest)]
        if last:
            self._tail(left)
        else:
            self.held, self.size = left, sum(len(x[2]) // 4 for x in left)

    def _tail(self, held: list[tuple]) -> None:
        """The last incomplete window: whole, or cut at powers of two where that pads less."""
        total = sum(len(x[2]) // 4 for x in held)
        if not total:
            return
        if total > self.capacity or _padding(total, self.capacity) == 0:
            for s in windows([len(x[2]) // 4 for x in held], self.capacity):
                self._put([held[i] for i in sorted(s)])
            return
        room = 1 << (total.bit_length() - 1)
        now: list[tuple] = []
        for doc, start, ids, n in held:
            while ids:
                take = min(len(ids) // 4, room)
                now.append((doc, start, ids[: 4 * take], n))
                ids, start, room = ids[4 * take :], start + take, room - take
                total -= take
                if room == 0:
                    self._put(now)
                    now, room = [], 1 << (total.bit_length() - 1) if total else 0


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 2, block: int = 192, piece: int = 512, ids: bool = False) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens.

    A document is the ids of its text and ``end_id``.  Full windows of long documents
    stand alone; what is left is cut into pieces of at most ``piece`` tokens and dealt by
    ``windows``, ``block`` windows at a time, inside the task that read it: no shuffle, and
    memory bounded by one block and one document.  The last window of a task is cut at powers
    of two, which need no padding.

    One row per piece; ``ids=True`` adds the piece's ids (``token_ids array<int>``).
    A null or empty text gives the end id alone; null and repeated doc_ids are
    packed like any others.  Sequence ids are the task's number and a running count:
    unique, not dense, and the same when a task is run again.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocabulary), np.array([end_id], dtype="<u4").tobytes()
        p = _Packer(TaskContext.get().partitionId(), capacity, block, piece)
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def out() -> pa.RecordBatch:
            cols = list(zip(*p.rows)) if p.rows else [[] for _ in range(len(names) + 1)]
            p.rows = []
            arrays = [pa.array(c, type=pa.int64()) for c in cols[:-1]]
            if ids:
                flat = pa.array(np.frombuffer(b"".join(cols[-1]), dtype="<u4").astype(np.int32))
                arrays.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) // 4 for x in cols[-1]])], pa.int32()), flat))
            return pa.RecordBatch.from_arrays(arrays, names=names + ["token_ids"] * ids)

        for b in batches:
            docs_, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for d, x in zip(docs_, texts):
                p.add(d, enc.ids(x) + end)
            yield out()
        p.flush(True)
        yield out()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, SCHEMA + ", token_ids array<int>" * ids)
