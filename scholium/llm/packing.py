"""Operator 2: packing by Karmarkar-Karp multiway differencing.

A document's ids are cut into whole windows and a remainder. Remainders are gathered in
groups of ``group_docs`` within a task (nothing is shuffled) and dealt whole to k windows by
the largest differencing method: each starts as a partial partition with one loaded window,
and the two partial partitions with the largest imbalance are merged with opposing order
until one is left. k starts at ceil(total / window). Windows beyond the capacity are closed
by a cut of at least ``least`` ids, and what is cut off fills the room of the others; while
some finds no room, k rises and all is dealt again.
So only what overflows a window is cut. A group ends at ``group_docs`` remainders
or soon after, when its ids nearly fill a whole number of windows; its memory is bounded by
``2 * group_docs * window`` ids.

Sequence ids are the task's partition and a counter, so a task that is run again gives the
same rows. Defined cases: null text counts as empty, so the document is its end id alone;
null and repeated ids are packed like any row; an empty table gives no piece; other
columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from scholium.llm.shared import given_back, release, sent_id
from scholium.llm.tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of ``sizes`` in k windows of near-equal load.

    A partial partition is (loads, members), largest load first and only non-empty windows.
    """
    heap = [(-s, i, [s], [[i]]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        both = len(a) + len(b) - k
        if both <= 0:
            pairs = [*zip(a, in_a, strict=True), *zip(b, in_b, strict=True)]
        else:  # in opposing order: the largest of b meet a's empty windows, the next its smallest loads
            cut, free = len(a) - both, k - len(a)
            pairs = list(zip(a[:cut], in_a[:cut], strict=True))
            pairs += list(zip(b[:free], in_b[:free], strict=True))
            pairs += [(x + y, in_x + in_y) for x, y, in_x, in_y in zip(a[:cut - 1 if cut else None:-1], b[free:], in_a[:cut - 1 if cut else None:-1], in_b[free:], strict=True)]
        pairs.sort(key=lambda p: -p[0])
        loads, members = [p[0] for p in pairs], [p[1] for p in pairs]
        low = loads[-1] if len(loads) == k else 0
        heapq.heappush(heap, (low - loads[0], tie, loads, members))
        tie += 1
    return heap[0][3] if heap else []


def close_windows(bins: list[list[tuple[int, int, int]]], window: int, least: int) -> bool:
    """Cut what windows hold beyond their capacity and place it in others' room; False when some finds none."""
    load = [sum(b - a for _, a, b in members) for members in bins]
    spare = []
    for k, members in enumerate(bins):
        while load[k] > window:
            at = max(range(len(members)), key=lambda j: members[j][2] - members[j][1])
            of, a, b = members.pop(at)
            off = max(load[k] - window, least)
            if b - a - off < least:
                off = b - a
            else:
                members.append((of, a, b - off))
            spare.append((of, b - off, b))
            load[k] -= off
    spare.sort(key=lambda p: p[1] - p[2])
    for k in sorted(range(len(bins)), key=lambda j: load[j]):
        left = []
        for j, (of, a, b) in enumerate(spare):
            room = window - load[k]
            part = b - a if b - a <= room else min(room, b - a - least)
            if part < b - a and part < least:
                left.append((of, a, b))
                continue
            bins[k].append((of, a, a + part))
            load[k] += part
            if a + part < b:
                left.append((of, a + part, b))
            if load[k] == window:
                left += spare[j + 1 :]
                break
        spare = left
        if not spare:
            return True
    return not spare


def pack_pieces(sizes: list[int], window: int, least: int) -> list[list[tuple[int, int, int]]]:
    """Windows of at most ``window`` each; a member is (index into ``sizes``, start, end), and few are cut."""
    if not sizes:
        return []
    k = -(-sum(sizes) // window)
    while True:
        bins = [[(i, 0, sizes[i]) for i in members] for members in differencing(sizes, k)]
        if close_windows(bins, window, least):
            return bins
        k += max(1, k // 200)


def encoded(batches, enc, docs: int = 500):
    """(doc_id, ids) of every row, a few documents at a time."""
    for batch in batches:
        for at in range(0, len(batch), docs):
            part = batch.iloc[at : at + docs]
            yield from zip(part["doc_id"].tolist(), enc.encode([t or "" for t in part["text"]]), strict=True)


def _packer(vocabulary: str | None, end_id: int, window: int, group_docs: int, least: int):
    def pack(batches):
        import pandas as pd
        from pyspark import TaskContext

        enc = encoder(vocabulary)
        first = TaskContext.get().partitionId() << 40
        sequence = held = 0
        waiting: list[tuple] = []
        rows: list[tuple] = []

        def flush():
            nonlocal sequence
            for members in pack_pieces([len(w[2]) for w in waiting], window, least):
                offset = 0
                for i, a, b in sorted(members):
                    doc_id, at, ids, total = waiting[i]
                    rows.append((doc_id, at + a, b - a, zlib.crc32(ids[a:b].tobytes()), total, first + sequence, offset))
                    offset += b - a
                sequence += 1
            waiting.clear()

        def frame():
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            rows.clear()
            return out

        release()
        for doc_id, ids in encoded(batches, enc):
            ids = np.append(ids, np.uint32(end_id)).astype("<u4")
            whole = len(ids) // window * window
            for at in range(0, whole, window):
                rows.append((doc_id, at, window, zlib.crc32(ids[at : at + window].tobytes()), len(ids), first + sequence, 0))
                sequence += 1
            if whole < len(ids):
                waiting.append((doc_id, whole, ids[whole:].copy(), len(ids)))
                held += len(ids) - whole
                # Room for a deal without a further window, and little of it: 5 to 40 % of one window.
                if len(waiting) >= 2 * group_docs or len(waiting) >= group_docs and 0.6 <= held % window / window <= 0.95:
                    flush()
                    held = 0
            if len(rows) >= 10_000:
                yield frame()
        flush()
        if rows:
            yield frame()
        release()

    return pack


def pack(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None, end_id: int = 1, window: int = 2048, group_docs: int = 256, least: int = 8) -> DataFrame:
    """Pieces of documents with their sequence and offset; see the module for the method."""
    rows = docs.select(sent_id("doc_id"), "text")
    return given_back(rows.mapInPandas(_packer(vocabulary, end_id, window, group_docs, least), SCHEMA), "doc_id")
