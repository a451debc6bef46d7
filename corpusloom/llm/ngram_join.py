"""N-gram Jaccard join by prefix trees.

A document is the set of its distinct four-word shingles. Two documents link
when 100 * both >= 85 * either. Sets are kept in one global order of shingles by
their counts over all documents (in hash buckets).

1. Documents of equal sets are one class, found first within a task.
2. Linked sets share one of their n - ceil(0.85 n) + 1 rarest shingles, so each
   class sends these to the tasks of the shingles, each with its place in the
   order. Where another class of near length comes too, a parity sketch of the set
   follows. A class stays in a group only if another one there can have the
   overlap by both places, and differs in no more cells than the bound allows.
   The whole sets of these classes are stored once.
3. What is left falls into groups that no shared prefix shingle connects. A
   group's sets are put in a prefix tree, most frequent shingles first, so that
   near copies share their paths. One preorder traversal carries the overlap with
   all members along: a shared path is counted once for all sets below it, and a
   member leaves a subtree when its overlap and the remaining lengths can't reach
   the bound, or when all that is below belongs to its component already.
4. A group of more than GROUP_SETS sets or GROUP_SHINGLES shingles goes in rounds
   of smaller ones, the classes that share one prefix shingle: every class that
   still has a shingle with members of several components names its largest ones
   (1, then 4, then 16, ...), and their trees are traversed in full. Components are
   contracted after each round. It ends when no shingle holds two components, so
   all pairs that share one are in one component or were compared. A shingle with
   too many members for a tree is cut in chunks: first each chunk by itself; where
   several components are left, those outside the largest meet all chunks.

Shingles are known by 56-bit hashes, classes by 128 bits made of them.

Defined results: null, empty and blank texts have the empty set and link with
nothing; a text of fewer than four words is one shingle; rows of equal id and
text share a result; an empty table gives an empty result; further columns are
not read by ``linked`` and pass through ``one_of_each``, whatever their names.
component_id is the smallest doc_id of the component.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD, bitmap_of, bits_for, fresh, importable, least_of, numbered, pack, parts_for, ranks_of, table_rows, unpack, unpacked, written
from corpusloom.llm.graph import components
from corpusloom.llm.hashing import LOWER, Tally, buffers, give_back, hashed_words, mixed, runs
from corpusloom.llm.parity import Shape, Sketches, partners

N, SHARE = 4, 85
#: bits of a shingle; texts in one buffer (what is left of 64 bits); buckets of the counts
BITS, TEXTS, COUNTS = 56, 256, 1 << 24
#: sets and shingles of one prefix tree at most; shingles a group of tasks; shingles held by a task before it sends them
GROUP_SETS, GROUP_SHINGLES, TASK_SHINGLES, FLUSH_SHINGLES = 4_096, 2_000_000, 2_000_000, 1_500_000
#: a cell for every two shingles; neighbours by length that all look at; pairs at once
SKETCH, NEIGHBOURS, PAIRS_AT_ONCE = Shape(128, 8), 32, 500_000
STEPS = [mixed(np.array([i + 1], np.uint64))[0] | np.uint64(1) for i in range(N)]


def prefix_length(n, share: int = SHARE):
    return n - (share * n + 99) // 100 + 1


def needed(a, b, share: int = SHARE):
    """The least overlap of linked sets of these sizes: share / (100 + share) of both, rounded up."""
    return (share * (a + b) + 99 + share) // (100 + share)


def shingle_sets(buf: np.ndarray, ends: np.ndarray, words: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(size of each text's set of shingles of so many words, at most N; the sets one after the other, ascending)."""
    first, w = hashed_words(LOWER[buf])
    n = np.diff(np.searchsorted(first, ends), prepend=0)
    text = np.repeat(np.arange(len(ends)), n)
    with np.errstate(over="ignore"):
        m = max(len(w) - words + 1, 0)
        g = np.zeros(m, np.uint64)
        for i, step in enumerate(STEPS[:words]):
            g += w[i : i + m] * step
        whole = text[:m] == text[words - 1 :]
        g, of = mixed(g[whole]), text[:m][whole]
        few = np.flatnonzero((n > 0) & (n < words))
        if len(few):
            starts = np.cumsum(n) - n
            short = [sum((w[starts[t] + i] * STEPS[i] for i in range(n[t])), np.uint64(n[t])) for t in few]
            g, of = np.concatenate([g, mixed(np.asarray(short, np.uint64), 17)]), np.concatenate([of, few])
    key = np.sort((of.astype(np.uint64) << np.uint64(BITS)) | (g >> np.uint64(64 - BITS)))
    key = key[np.diff(key, prepend=~key[:1]) != 0]
    return np.bincount((key >> np.uint64(BITS)).astype(np.int64), minlength=len(ends)), key & np.uint64((1 << BITS) - 1)


def rarity(flat: np.ndarray, order: np.ndarray) -> np.ndarray:
    return order[(flat & np.uint64(COUNTS - 1)).astype(np.int64)]


def rarest_first(size: np.ndarray, flat: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The sets in the global order."""
    text, rare = np.repeat(np.arange(len(size), dtype=np.uint64), size), rarity(flat, order).astype(np.uint64)
    key = (text << np.uint64(BITS)) | (rare << np.uint64(BITS - 8)) | (flat >> np.uint64(8))
    by = np.argsort(key)
    if (key[by][1:] == key[by][:-1]).any():
        by = np.lexsort((flat, key))
    return flat[by]


def parsed(batches, at_most: int = TEXTS, words: int = N):
    """(ids, sizes, sets) of the texts of Arrow batches."""
    for ids, buf, ends in buffers(batches, bytes, at_most):
        yield np.asarray(ids, np.int64), *shingle_sets(buf, ends, words)


class Tree:
    """A prefix tree of sequences of small numbers: nodes in preorder, each with the leaves below it and the run of numbers on its edge.

    Leaves are the sequences in lexicographic order; order gives their positions in the input."""

    def __init__(self, sequences: list[np.ndarray]) -> None:
        coded = [s.astype(">u4").tobytes() for s in sequences]
        self.order = sorted(range(len(sequences)), key=coded.__getitem__)
        self.leaves = [sequences[i] for i in self.order]
        self.length = np.array([len(s) for s in self.leaves])
        # nodes: (first leaf, leaf after the last, depth above the edge, depth below it)
        nodes, open_ = [], []
        for i, own in enumerate(self.leaves):
            shared = 0
            if i:
                before = self.leaves[i - 1]
                m = min(len(own), len(before))
                differ = np.flatnonzero(own[:m] != before[:m])
                shared = int(differ[0]) if len(differ) else m
            last = None
            while open_ and nodes[open_[-1]][3] > shared:
                last = open_.pop()
                nodes[last][1] = i
            if last is not None and nodes[last][2] < shared:
                # an edge is cut where this leaf leaves it
                a, _, above, below = nodes[last]
                nodes[last][2] = shared
                nodes.append([a, None, above, shared])
                open_.append(len(nodes) - 1)
            nodes.append([i, None, shared, len(own)])
            open_.append(len(nodes) - 1)
        for k in open_:
            nodes[k][1] = len(self.leaves)
        self.nodes = sorted((a, -b, above, below) for a, b, above, below in nodes)
        self.steps = sum(below - above for _, _, above, below in self.nodes)

    def walk(self, labels: np.ndarray, share: int = SHARE) -> list[tuple[int, int]]:
        """Links (leaf, leaf) between sequences of different labels that join all linked ones; labels are brought up to date."""
        n, length, links = len(self.leaves), self.length, []
        flat = np.concatenate(self.leaves) if n else np.zeros(0, np.int64)
        # the members that hold each number
        holder = np.repeat(np.arange(n), length)
        by = np.argsort(flat, kind="stable")
        holder, starts = holder[by], np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=1))])
        path: list[tuple[int, np.ndarray, np.ndarray]] = [(0, np.zeros(n, np.int64), np.ones(n, bool))]
        skip_until = 0
        for a, b, above, below in self.nodes:
            b = -b
            if a < skip_until:
                continue
            while path[-1][0] > above:
                path.pop()
            _, overlap, active = path[-1]
            own = labels[a:b]
            if (own == own[0]).all():
                active = active & (labels != own[0])
                if not active.any():
                    skip_until = b
                    continue
            run = self.leaves[a][above:below]
            if len(run):
                held = runs(holder, starts[run], starts[run + 1] - starts[run])
                overlap = overlap + np.bincount(held, minlength=n)
            longest, shortest = int(length[a:b].max()), int(length[a:b].min())
            room = np.minimum(longest - below, length - overlap)
            active = active & (overlap + room >= needed(length, shortest, share))
            if not active.any():
                skip_until = b
                continue
            if below == shortest:
                # sequences that end here
                for j in range(a, b):
                    if length[j] != below:
                        break
                    linked = np.flatnonzero(active & (labels != labels[j]) & (overlap >= needed(length, below, share)))
                    for old in np.unique(labels[linked]):
                        links.append((int(linked[labels[linked] == old][0]), j))
                        labels[labels == old] = labels[j]
                        linked = linked[labels[linked] != labels[j]]
            path.append((below, overlap, active))
        return links


def tree_links(cid: np.ndarray, label: np.ndarray, sets: list[np.ndarray], order: np.ndarray | None, share: int = SHARE) -> list[tuple[int, int]]:
    """Links (cid, cid) that join what is linked within one group; without an order of all shingles, their counts within the group decide what is frequent."""
    flat = np.concatenate(sets)
    known, number = np.unique(flat, return_inverse=True)
    place = np.empty(len(known), np.int64)
    rare = -np.bincount(number) if order is None else 255 - rarity(known, order).astype(np.int64)
    place[np.lexsort((known, rare))] = np.arange(len(known))
    size = np.array([len(s) for s in sets])
    key = np.sort((np.repeat(np.arange(len(sets)), size) << 32) | place[number]) & 0xFFFFFFFF
    tree = Tree(np.split(key, np.cumsum(size)[:-1]))
    _, labels = np.unique(label, return_inverse=True)
    return [(int(cid[tree.order[i]]), int(cid[tree.order[j]])) for i, j in tree.walk(labels[tree.order], share)]


def met(word: np.ndarray, size: np.ndarray, position: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Which entries, in order of (word, size), have another of their word that no bound excludes."""
    known, has, size = Sketches(SKETCH, size, sketch), np.zeros(len(word), bool), size.astype(np.int64)

    def look(i, j):
        a, b = size[i], size[j]
        need = needed(a, b)
        room = np.minimum(position[i], position[j]) + 1 + np.minimum(a - 1 - position[i], b - 1 - position[j])
        fits = (room >= need) & (100 * a >= SHARE * b)
        i, j = i[fits], j[fits]
        at, _ = known.near(i, j, (a + b - 2 * need)[fits])
        found = np.concatenate([i[at], j[at]])
        has[found] = True
        return found

    partners(word, size, lambda n: ((SHARE * n + 99) // 100, 100 * n // SHARE), look, NEIGHBOURS, PAIRS_AT_ONCE)
    return has


def counted(docs: DataFrame) -> tuple[np.ndarray, int]:
    """A rank of rarity by how many sets hold a shingle of each bucket (8 steps a doubling), from a table of fixed size; and the number of all."""

    def count(batches):
        total = Tally(COUNTS)
        for _, _, flat in parsed(batches):
            total.add((flat & np.uint64(COUNTS - 1)).astype(np.int64))
        yield table_rows(total.counts())

    return ranks_of(docs.mapInArrow(count, "chunk int, blob binary"), COUNTS)


def entries(docs: DataFrame, order, parts: int) -> tuple[DataFrame, DataFrame]:
    """(lid, cid, n) of every document with words, (word, cid, n) of every prefix shingle that the class shares with one that may link."""
    schema = "b int, kind int, blob binary"

    def sets(batches):
        import pyarrow as pa

        def sent(held):
            doc, size, k1, k2, prefix, sketch = (np.concatenate(x) for x in zip(*held, strict=True))
            p, wide = prefix_length(size), SKETCH.lengths(size)
            starts, s_starts = np.cumsum(p) - p, np.cumsum(wide) - wide
            bucket = (k1 % np.uint64(parts)).astype(np.int64)
            by = np.lexsort((doc, k2, k1, bucket))
            first = np.ones(len(by), bool)
            first[1:] = (k1[by][1:] != k1[by][:-1]) | (k2[by][1:] != k2[by][:-1])
            rows = []
            for x in np.split(np.arange(len(by)), np.flatnonzero(np.diff(bucket[by])) + 1):
                own = by[x]
                some = own[first[x]]  # prefix and sketch go along once per class
                rows.append((int(bucket[own[0]]), pack(doc[own], size[own], k1[own], k2[own], first[x].astype(np.uint8), runs(prefix, starts[some], p[some]), runs(sketch, s_starts[some], wide[some]))))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([0] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["b", "kind", "blob"])

        held, n = [], 0
        for ids, size, flat in parsed(batches):
            has = size > 0
            if not has.any():
                continue
            ids, size = ids[has], size[has]
            starts = np.cumsum(size) - size
            with np.errstate(over="ignore"):
                k1, k2 = np.add.reduceat(mixed(flat, 1), starts), np.add.reduceat(mixed(flat, 2), starts)
            held.append((ids, size, k1, k2, runs(rarest_first(size, flat, order.value), starts, prefix_length(size)), SKETCH.made(size, flat)))
            n += len(held[-1][4]) + 8 * len(ids)
            if n > FLUSH_SHINGLES:
                yield sent(held)
                held, n = [], 0
        if held:
            yield sent(held)

    def classes(key, rows):
        import pandas as pd

        doc, size, k1, k2, has, prefix, sketch = unpacked(rows["blob"], 7)
        p, wide = np.where(has > 0, prefix_length(size), 0), np.where(has > 0, SKETCH.lengths(size), 0)
        starts, s_starts = np.cumsum(p) - p, np.cumsum(wide) - wide
        by = np.lexsort((doc, k2, k1))
        first = np.ones(len(by), bool)
        first[1:] = (k1[by][1:] != k1[by][:-1]) | (k2[by][1:] != k2[by][:-1])
        cid = doc[by][np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))]
        # some member of each class has the prefix with it: the first of each task does
        group, at = np.cumsum(first) - 1, np.flatnonzero(has[by])[::-1]
        holder = np.empty(group[-1] + 1, np.int64)
        holder[group[at]] = by[at]
        out = [(key[0], 1, pack(doc[by], cid, size[by], runs(sketch, s_starts[holder], wide[holder])))]
        word, line = runs(prefix, starts[holder], p[holder]).view(np.int64), np.repeat(np.arange(len(holder)), p[holder])
        position = (np.arange(len(line)) - np.repeat(np.cumsum(p[holder]) - p[holder], p[holder])).astype(np.int32)
        bucket = (mixed(word.view(np.uint64), 9) % np.uint64(parts)).astype(np.int64)
        by = np.lexsort((word, bucket))
        for x in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1):
            out.append((int(bucket[x[0]]), 0, pack(word[x], cid[first][line[x]], size[holder[line[x]]], position[x])))
        give_back()
        return pd.DataFrame(out, columns=["b", "kind", "blob"])

    def shared(key, rows):
        import pandas as pd

        frames = [pd.DataFrame({"kind": [], "x": [], "cid": [], "n": [], "position": []}).astype("i8").assign(sketch=pd.Series([], dtype=object))]
        own = rows["blob"][rows["kind"] == 0]
        if len(own):
            word, cid, n, position = unpacked(own, 4)
            by = np.lexsort((n, word))
            word, cid, n, position = word[by], cid[by], n[by].astype(np.int64), position[by]
            # sizes ascend within a word, so a neighbour is the nearest in length
            near = (word[1:] == word[:-1]) & (100 * n[:-1] >= SHARE * n[1:])
            keep = np.append(near, False) | np.insert(near, 0, False)
            frames.append(pd.DataFrame({"kind": 0, "x": word[keep], "cid": cid[keep], "n": n[keep], "position": position[keep].astype(np.int64), "sketch": None}))
        for blob in rows["blob"][rows["kind"] == 1]:
            doc, cid, n, sketch = unpack(blob, 4)
            ends = np.cumsum(SKETCH.lengths(n[doc == cid]))
            made = np.full(len(doc), None, object)
            made[doc == cid] = [x.tobytes() for x in np.split(sketch, ends[:-1])]
            frames.append(pd.DataFrame({"kind": 1, "x": doc, "cid": cid, "n": n, "position": 0, "sketch": made}))
        give_back()
        return pd.concat(frames)

    def differing(key, rows):
        rows = rows.sort_values(["word", "n"])
        keep = met(rows["word"].to_numpy(), rows["n"].to_numpy(), rows["position"].to_numpy(), np.frombuffer(b"".join(rows["sketch"]), np.uint64))
        give_back()
        return rows.loc[keep, ["word", "cid", "n"]]

    found = docs.mapInArrow(sets, schema).groupBy("b").applyInPandas(classes, schema).groupBy("b").applyInPandas(shared, "kind int, x long, cid long, n long, position long, sketch binary")
    found = written(found, "shingles")
    sketches = found.where("kind = 1 and x = cid").select("cid", "sketch")
    together = found.where("kind = 0").select(F.col("x").alias("word"), "cid", "n", "position").join(sketches, "cid").withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(parts)))
    left = written(together.groupBy("bucket").applyInPandas(differing, "word long, cid long, n long"), "prefixes")
    return found.where("kind = 1").select(F.col("x").alias("lid"), "cid", "n"), left


def stored(docs: DataFrame, cids: DataFrame, words: int = N) -> DataFrame:
    """(cid, own): the whole sets of these classes, and of some others, as ascending 64-bit numbers."""
    bits = bits_for(cids.count())  # a task sends only sets that some group may want
    bitmap = bitmap_of(cids.select(F.pmod("cid", F.lit(bits)).alias("s")), bits)
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap)

    def sets(batches):
        import pyarrow as pa

        def some():
            for batch in batches:
                s = batch.column(0).to_numpy(zero_copy_only=False) % bits
                yield batch.filter(pa.array(((wanted.value[s >> 5] >> (s & 31).astype(np.uint32)) & np.uint32(1)).astype(bool)))

        for ids, size, flat in parsed(some(), words=words):
            own = [x.tobytes() for x in np.split(flat, np.cumsum(size)[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(own, pa.binary())], names=["cid", "own"])

    return written(docs.mapInArrow(sets, "cid long, own binary").join(cids, "cid", "left_semi"), "sets")


def _cells(live: DataFrame) -> DataFrame:
    """(cell, cid, label) of the groups to traverse, from (word, cid, n, label, k, shingles, chunked): one cell, or those of a large group's chunks."""
    chunks = lambda k, shingles: F.greatest(F.ceil(k / GROUP_SETS), F.ceil(shingles / GROUP_SHINGLES), F.lit(1)).cast("long")
    dealt = lambda n: F.pmod(F.xxhash64("cid", "word"), n)
    first = live.where("not chunked").withColumn("cell", F.xxhash64("word", dealt(chunks(F.col("k"), F.col("shingles"))))).select("cell", "cid", "label")
    # a large group after its first round: the largest component in chunks, every other member with each of them and with all others
    again = live.where("chunked")
    main = again.groupBy("word", "label").agg(F.count(F.lit(1)).alias("own"), F.sum("n").alias("own_n")).groupBy("word").agg(F.max(F.struct("own", "label", "own_n")).alias("m"))
    again = again.join(main, "word").withColumn("a", chunks(F.col("m.own"), F.col("m.own_n"))).withColumn("b", chunks(F.col("k") - F.col("m.own"), F.col("shingles") - F.col("m.own_n")))
    is_main = F.col("label") == F.col("m.label")
    mine = F.when(is_main, dealt(F.col("a"))).otherwise(dealt(F.col("b")))
    again = again.withColumn("mine", mine).withColumn("to", F.explode(F.when(is_main, F.sequence(F.lit(0).cast("long"), F.col("b") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("a") + F.col("b") - 1))))
    between = F.when(is_main, F.xxhash64("word", F.lit("m"), "mine", "to")).when(F.col("to") < F.col("a"), F.xxhash64("word", F.lit("m"), "to", "mine"))
    rest = F.col("to") - F.col("a")
    cell = between.otherwise(F.xxhash64("word", F.lit("r"), F.least("mine", rest), F.greatest("mine", rest)))
    return first.union(again.withColumn("cell", cell).select("cell", "cid", "label"))


def grouped(own: DataFrame, unique: bool, text: str) -> DataFrame:
    """(lid, n, label) of every document with words; label is equal within a component."""
    spark = own.sparkSession
    rows = own.select("lid", F.col(text).alias("text"))
    rows = rows if unique else rows.dropDuplicates(["lid"])
    table, total = counted(rows)
    order, parts = spark.sparkContext.broadcast(table), parts_for(spark, total, TASK_SHINGLES)
    members, todo = entries(rows, order, parts)
    return joined(rows, members, todo, parts, order)


def joined(rows: DataFrame, members: DataFrame, todo: DataFrame, parts: int, order=None, words: int = N, share: int = SHARE) -> DataFrame:
    """(lid, n, label) of members (lid, cid, n): classes that share a word of todo (word, cid, n) are compared on their whole sets, made from rows (lid, text), as far as they aren't in one component already."""

    def links(key, cells):
        import pandas as pd

        out = []
        for _, x in cells.groupby("cell", sort=False):
            out += tree_links(x["cid"].to_numpy(), x["label"].to_numpy(), [np.frombuffer(b, np.uint64) for b in x["own"]], order.value if order else None, share)
        return pd.DataFrame(out, columns=["a", "b"]).astype("i8")

    def traversed(cells: DataFrame) -> DataFrame:
        in_tasks = cells.withColumn("bucket", F.pmod("cell", F.lit(4 * parts))).join(sets, "cid")
        return written(in_tasks.groupBy("bucket").applyInPandas(links, "a long, b long"), "links")

    if todo.isEmpty():
        return members.select("lid", "n", F.col("cid").alias("label"))
    first = todo.groupBy("word").agg(F.min("cid").alias("a"))
    groups = components(todo.join(first, "word").select("a", F.col("cid").alias("b"))).select(F.col("node").alias("cid"), F.col("label").alias("group"))
    sets = stored(rows, groups.select("cid"), words)
    sized = todo.groupBy("cid").agg(F.max("n").alias("n")).join(groups, "cid").groupBy("group").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("shingles"))
    large = (F.col("k") > GROUP_SETS) | (F.col("shingles") > GROUP_SHINGLES)
    sized = groups.join(sized.select("group", large.alias("large")), "group")
    edges = traversed(sized.where("not large").select(F.xxhash64("group").alias("cell"), "cid", F.col("cid").alias("label")))
    todo = written(todo.join(sized.where("large").select("cid"), "cid").withColumn("chunked", F.lit(False)), "groups")
    labels, most = None, 1
    while True:
        live = todo.withColumn("label", F.col("cid")) if labels is None else todo.join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
        several = live.groupBy("word").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("shingles")).where("lo < hi").select("word", "k", "shingles")
        live = live.join(several, "word")
        # each class names its largest groups; four times as many in each round, so the rounds are few however many groups it has
        nth = Window.partitionBy("cid").orderBy(F.desc("k"), F.xxhash64("word"))
        named = live.withColumn("named", F.row_number().over(nth) <= most)
        now = named.where("named").select("word").distinct().withColumn("now", F.lit(True))
        live = written(named.drop("named").join(now, "word", "left").withColumn("now", F.coalesce("now", F.lit(False))), "groups")
        if live.isEmpty():
            break
        edges = edges.union(traversed(_cells(live.where("now"))))
        labels = components(edges).withColumnRenamed("node", "cid")
        todo = live.where(~F.col("now") | (~F.col("chunked") & large)).select("word", "cid", "n", (F.col("chunked") | F.col("now")).alias("chunked"))
        most *= 4
    labels = labels if labels is not None else components(edges).withColumnRenamed("node", "cid")
    return members.join(labels, "cid", "left").select("lid", "n", F.coalesce("label", "cid").alias("label"))


def linked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", by=grouped) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row per row of docs."""
    importable(docs.sparkSession)
    own, unique = numbered(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text")
    known = written(own.select("lid", "doc_id").join(by(own, unique, "text"), "lid", "left"), "members")
    return least_of(known, ["label"], "doc_id", "component_id").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").cast("long").alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", by=grouped) -> DataFrame:
    """The first document of every component, and every document without words; columns as they are."""
    importable(docs.sparkSession)
    lid, alone = fresh(docs, "ng_lid"), fresh(docs, "ng_alone")
    own, unique = numbered(docs, doc_id, text, lid)
    known = written(by(own.select(F.col(lid).alias("lid"), F.col(text).alias("text")), unique, "text"), "members")
    gone = least_of(known, ["label"], "lid", "first", alone=False).where("lid <> first").select(F.col("lid").alias(lid))
    kept = own.join(gone, lid, "left_anti")
    if not unique:
        # equal rows share a number, but those without words are in no component and stay, each by a number of its own
        own_number = F.when(F.col(text).rlike(WORD), F.lit(-1)).otherwise(F.monotonically_increasing_id())
        kept = kept.withColumn(alone, own_number).dropDuplicates([lid, alone])
    return kept.select(*docs.columns)
