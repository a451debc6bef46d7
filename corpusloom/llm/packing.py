"""Best-fit packing of documents into sequences of bounded length.

Documents longer than a sequence are cut; every piece then goes to a bin. Bins
are first filled best fit, longest first, then swap-based local search moves
documents between underfull bins (a move, one for one, two for one), each step
raising the sum of squared fills, until no step helps or no bin can go: at
ceil(tokens / length) bins nothing is left to gain. All underfull bins are in
reach of a step, by an index on the sizes they hold.

Pieces are dealt by hash to groups of about GROUP_PIECES, packed each on its
own, so a group fits a task at any input size. Bins that are still underfull
after that meet those of other groups: they are dealt anew, whole, to groups of
about as many pieces, and the search goes on between them, until all of them
are in one group or a round saves no bin. Equal inputs give equal packings.

Defined results: a null text is empty and still takes its end id; repeated rows
are packed as often as they stand there; a null doc_id is a row like any other;
an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusloom.llm.common import fresh, importable, written

LENGTH, END_ID, GROUP_PIECES = 1024, 2, 40_000


def fill(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best fit, longest first; bins as lists of positions in lengths."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free space
    spaces: list[int] = []  # free spaces that some bin has, ascending
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        size = lengths[i]
        at = bisect.bisect_left(spaces, size)
        if at == len(spaces):
            b, free = len(bins), capacity
            bins.append([])
        else:
            free = spaces[at]
            b = room[free].pop()
            if not room[free]:
                spaces.pop(at)
        bins[b].append(i)
        free -= size
        if free:
            if not room[free]:
                bisect.insort(spaces, free)
            room[free].append(b)
    return bins


def _exchange(big: list[int], small: list[int], gap: int, size) -> tuple[list[int], list[int]] | None:
    """What to take from the fuller bin and from the emptier, so that the fuller gains most and at most gap."""
    best, gain = None, 0
    own = sorted(small, key=size)
    sizes = [size(i) for i in own]
    for out in [None, *big]:  # None: a move
        limit = gap + (size(out) if out is not None else 0)
        less = size(out) if out is not None else 0
        at = bisect.bisect_right(sizes, limit) - 1
        if at >= 0 and sizes[at] - less > gain:
            best, gain = (([] if out is None else [out]), [own[at]]), sizes[at] - less
        lo, hi = 0, len(own) - 1  # two for one (or a move of two)
        while lo < hi:
            both = sizes[lo] + sizes[hi]
            if both > limit:
                hi -= 1
                continue
            if both - less > gain:
                best, gain = (([] if out is None else [out]), [own[lo], own[hi]]), both - less
            lo += 1
        if gain == gap:
            break
    return best


class _Underfull:
    """The underfull bins by the sizes of their pieces, so that a donor's fullest target is found among all of them without trying each."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.holding: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # (gap, bin) ascending, by a size held; 0: any bin
        self.widest = np.zeros(capacity + 1, "i8")  # the widest gap of each list

    def add(self, b: int, sizes: list[int]) -> None:
        gap = self.capacity - sum(sizes)
        if sizes and gap:
            for n in {0, *sizes}:
                bisect.insort(self.holding[n], (gap, b))
                self.widest[n] = self.holding[n][-1][0]

    def drop(self, b: int, sizes: list[int]) -> None:
        gap = self.capacity - sum(sizes)
        if sizes and gap:
            for n in {0, *sizes}:
                own = self.holding[n]
                own.pop(bisect.bisect_left(own, (gap, b)))
                self.widest[n] = own[-1][0] if own else 0

    def target(self, sizes: list[int]) -> int | None:
        """The fullest bin, at least as full as a donor of these sizes, that can take one or two of them for one of its own or none and be fuller."""
        one = np.asarray(sizes, "i8")
        a, b = np.triu_indices(len(one), 1)
        into = np.unique(np.concatenate([one, one[a] + one[b]]))
        room = self.capacity - sum(sizes)
        out = np.arange(self.capacity + 1)
        at = np.searchsorted(into, out, side="right")
        # the gap that a bin needs to swap a piece of each size for the next larger of the donor's
        need = np.append(into, 2 * self.capacity + 1)[at] - out
        best = (room + 1, 0)
        for n in np.flatnonzero(need <= np.minimum(self.widest, room)).tolist():
            own = self.holding[n]
            gap = own[bisect.bisect_left(own, (int(need[n]), -1))][0]
            if gap <= best[0]:
                best = min(best, (gap, -own[bisect.bisect_left(own, (gap + 1, -1)) - 1][1]))  # of equal bins the last
        return -best[1] if best[0] <= room else None


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Swap-based local search between underfull bins; every step moves fill from an emptier to a fuller bin."""
    size = lengths.__getitem__
    least = -(-sum(lengths) // capacity)
    fills = [sum(map(size, b)) for b in bins]
    count = len(bins)
    if count <= least:
        return bins
    index = _Underfull(capacity)
    sizes_of = lambda b: [lengths[i] for i in bins[b]]
    for b in range(len(bins)):
        index.add(b, sizes_of(b))
    while count > least:
        under = sorted((b for b in range(len(bins)) if 0 < fills[b] < capacity), key=lambda b: (fills[b], b))
        changed = False
        first = max(1, 4 * (count - least))
        for nth, donor in enumerate(under):
            if nth == first and changed:  # the fuller bins give only where none of the emptiest can
                break
            if not 0 < fills[donor] < capacity:
                continue
            index.drop(donor, sizes_of(donor))
            while bins[donor] and (target := index.target(sizes_of(donor))) is not None:
                index.drop(target, sizes_of(target))
                out, into = _exchange(bins[target], bins[donor], capacity - fills[target], size)
                gained = sum(map(size, into)) - sum(map(size, out))
                bins[target] = [i for i in bins[target] if i not in out] + into
                bins[donor] = [i for i in bins[donor] if i not in into] + out
                fills[target] += gained
                fills[donor] -= gained
                changed = True
                index.add(target, sizes_of(target))
            index.add(donor, sizes_of(donor))
            if not bins[donor]:
                count -= 1
                if count == least:
                    break
        if not changed:
            break
    return [b for b in bins if b]


def packed(lengths: list[int], capacity: int = LENGTH) -> list[list[int]]:
    return improve(fill(lengths, capacity), lengths, capacity)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = LENGTH, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): only documents over the capacity are cut, their first piece may be shorter."""
    importable(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def cut(batches):
        import zlib

        import pyarrow as pa

        from corpusloom.llm.tokens import encoder

        tool, last = encoder(tokenizer, "byte"), np.asarray([end_id], "<u4")
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
        for batch in batches:
            rows = []
            for key, own in zip(batch.column(0).to_pylist(), tool.arrays(batch.column(1).cast(pa.binary()).to_pylist()), strict=True):
                ids = np.concatenate([own, last])
                n = len(ids)
                first = n % capacity or capacity
                ends = [min(first, n), *range(first + capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
                    part = ids[a:b]
                    rows.append((key, k, a, b - a, zlib.crc32(part)) + ((part.tobytes(),) if with_ids else ()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names=names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, schema)


def pack(items: DataFrame, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece"), capacity: int = LENGTH, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """items, in which no column has these names, with sequence_id and offset. length must be from 1 to capacity."""
    importable(items.sparkSession)
    if clash := {"sequence_id", "offset"} & {c.lower() for c in items.columns}:
        raise ValueError(f"columns that pack adds: {', '.join(sorted(clash))}")
    groups = max(1, -(-items.count() // group_pieces))
    schema = StructType([*items.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def one(key, rows):
        rows = rows.sort_values([*order, *[c for c in rows.columns if c not in (*order, group)]], kind="stable", na_position="last").reset_index(drop=True)
        sizes = rows[length].tolist()
        sequence, offset = np.zeros(len(sizes), "i8"), np.zeros(len(sizes), "i8")
        for b, own in enumerate(packed(sizes, capacity)):
            at = 0
            for i in own:
                sequence[i], offset[i] = (key[0] << 32) + b, at
                at += sizes[i]
        return rows.drop(columns=group).assign(sequence_id=sequence, offset=offset)

    group = fresh(items, "pk_group")
    first = dealt(items, order, groups, group).groupBy(group).applyInPandas(one, schema)
    return first if groups == 1 else _leftovers(first, length, order, capacity, group_pieces, group)


def _leftovers(first: DataFrame, length: str, order: tuple[str, ...], capacity: int, group_pieces: int, group: str) -> DataFrame:
    """The packing after rounds of the search among the underfull bins of all groups; a bin's pieces stay in one group, and a group's bins keep their numbers."""
    names = first.columns

    def again(rows):
        rows = rows.sort_values(["sequence_id", "offset"], kind="stable").drop(columns=group).reset_index(drop=True)
        sizes = rows[length].tolist()
        ids, place = np.unique(rows["sequence_id"].to_numpy(), return_inverse=True)
        bins = [own.tolist() for own in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(place)) + 1)]
        sequence, offset = np.zeros(len(sizes), "i8"), np.zeros(len(sizes), "i8")
        for b, own in zip(ids, improve(bins, sizes, capacity), strict=False):
            at = 0
            for i in own:
                sequence[i], offset[i] = b, at
                at += sizes[i]
        return rows.assign(sequence_id=sequence, offset=offset)[names]

    done, held, number = None, written(first, "packed"), 0
    while True:
        fills = held.groupBy("sequence_id").agg(F.sum(length).alias("pk_fill"), F.count(F.lit(1)).alias("pk_pieces"))
        under = written(fills.where(F.col("pk_fill") < capacity).select("sequence_id", "pk_fill", "pk_pieces"), "underfull")
        bins, tokens, pieces = under.agg(F.count(F.lit(1)), F.coalesce(F.sum("pk_fill"), F.lit(0)), F.coalesce(F.sum("pk_pieces"), F.lit(0))).first()
        if bins <= -(-tokens // capacity):
            break
        groups = max(1, -(-pieces // group_pieces))
        full = held.join(under, "sequence_id", "left_anti").select(*names)
        done = full if done is None else done.unionByName(full)
        left = held.join(under, "sequence_id", "left_semi").withColumn(group, F.pmod(F.xxhash64("sequence_id", F.lit(number)), F.lit(groups)))
        held = written(left.select(*names, group).groupBy(group).applyInPandas(again, first.schema), "repacked")
        number += 1
        if groups == 1 or held.select("sequence_id").distinct().count() == bins:
            break
    return held if done is None else done.unionByName(held)


def dealt(items: DataFrame, order: tuple[str, ...], groups: int, group: str) -> DataFrame:
    """items with a group each, about equally many in each group, however often a row stands there: equal rows are counted before they are shuffled, and their copies dealt round the groups from their hash on."""
    alike = F.xxhash64(*items.columns)
    if groups == 1:
        return items.withColumn(group, F.lit(0).cast("long"))
    copies = items.groupBy(*items.columns).agg(F.count(F.lit(1)).alias(group))
    # a row per different row: its copies are dealt in turn, from its hash on
    spread = copies.withColumn(group, F.explode(F.sequence(F.lit(0).cast("long"), F.col(group) - 1)))
    return spread.withColumn(group, F.pmod(alike + F.col(group), F.lit(groups)))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = LENGTH, **names) -> DataFrame:
    """Pieces of all documents with their sequences."""
    return pack(written(pieces(docs, tokenizer, capacity, **names), "pieces"), capacity=capacity)
