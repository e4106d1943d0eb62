"""Near-duplicates by a chosen-path set similarity join.

A document is the set of its word shingles; equal sets are one from the start. Trees branch the sets: at a node, tokens at two places of
the sets' minwise signatures are chosen by the node's hash, and sets go on together where they have the same token there. Two sets of
similarity s take a chosen branch together with probability s, so with two branches a node, at s = 0.8 a tree misses a pair with
probability 1/16 at most, however deep (the fixed point of x = (0.2 + 0.8 x)^2), and t independent trees with 1/16^t. A node of few sets is compared
exhaustively, by sketches of the signatures. A large node whose sets stay together in a branch (half of them or more) holds near copies:
it becomes one candidate class unseen, as does one that is still large at the last depth. Sketches leave out a pair of similarity 0.8
with probability below 1e-6; pairs that they pass, and large nodes, join candidate classes, which are only a first cut.

Links are then confirmed on full sets. A class of few sets is one task's work. In a larger one, blocks of its sets meet a few pivots at
a time: sets that link to pivots join. If few sets are left outside the class's largest component after two rounds, they become pivots in turn
until every one of them has met all others; within that component no pair can add a link between components. If many are left, sets meet in
pairs that share several of their first shingles, in an order by count in the class (those of a tenth of a block's sets last): two linked sets
share so many within places that follow from their sizes. Shingles that more than a few hundred sets share make no pairs; sets whose first
shared shingle may be one of them meet straight or, if they are many, are cut into classes by it and meet in rounds. So no link among candidates is lost, and pages of one
template that are not linked do not meet each other, though their own words come from one vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.llm.common import TASK_ROWS, at_once, binary_values, mix, prepare, shingle_hashes, stored, tasks, tidy, word_hashes
from tidemark.llm.components import components, smallest

PLACES = 128
#: Odd multipliers: the order of x * m modulo 2**64 over mixed x stands for a random order of tokens.
_MULTIPLIERS = np.random.default_rng(81).integers(0, 1 << 63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TREES = 4
#: Sets that a node may have for exhaustive comparison; a class may have for one task.
NODE, CLASS = 1024, 256
DEPTH = 8
#: Pivots of a class in the first round; sets in a block; pivots in a block.
PIVOTS, CHUNK, PART = 32, 1024, 256
#: A shingle in this share of a block's sets comes behind others in the order that cuts classes finer.
SHARED = 0.1
#: Up to so many sets outside its largest component a class needs few more rounds; with more it is cut finer first.
FINER = 1024
#: A shingle that up to so many sets of a class share pairs them; a pair needs so many shared ones among the first.
PAIRED, AGREE = 256, 3
#: Sets with a common shingle at a low place meet all others of their class straight if they are this part of them at most.
FEW = 8
#: Rows with a sketch, and rows with a text, that a task compares.
SKETCHES, TEXTS = 20_000, 1024
#: Up to so many sets in classes (8 bytes each) are sent to all tasks that read texts.
BROADCAST_SETS = 1_000_000


def text_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted different shingle hashes of each text."""
    words, starts = word_hashes(texts)
    return [np.unique(shingle_hashes(words[a:b], width)) for a, b in zip(starts, starts[1:])]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise tokens, shortened to 32 bits, of sets that aren't empty: a row each."""
    out = np.empty((len(sets), PLACES), "<u4")
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= 60_000):
            size += len(sets[end])
            end += 1
        flat = np.concatenate(sets[at:end])
        starts = np.cumsum([0, *(len(s) for s in sets[at : end - 1])])
        held = np.empty_like(flat)
        for k in range(PLACES):
            np.multiply(flat, _MULTIPLIERS[k], out=held)
            out[at:end, k] = np.minimum.reduceat(held, starts) >> np.uint64(32)
        at = end
    return out


def sketched(df: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (set size), h1, h2 (128 bits of the set), sig (its signature; null for an empty set)."""
    keys = [np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = text_sets(binary_values(b.column(1)), width)
            full = [i for i, s in enumerate(sets) if len(s)]
            sig: list = [None] * len(sets)
            for i, row in zip(full, signatures([sets[i] for i in full]) if full else [], strict=True):
                sig[i] = row.tobytes()
            sums = [pa.array(np.array([mix(s ^ key).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)) for key in keys]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), *sums, pa.array(sig, pa.binary())], names=["doc_id", "n", "h1", "h2", "sig"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, n long, h1 long, h2 long, sig binary")


def _children(node):
    """The two branches of a node: (node, place) hashed with the set's token there."""
    first = F.pmod(F.xxhash64(node, F.lit(1)), F.lit(PLACES))
    second = F.pmod(first + 1 + F.pmod(F.xxhash64(node, F.lit(2)), F.lit(PLACES - 1)), F.lit(PLACES))
    return [F.xxhash64(node, p, F.substring("sig", (4 * p + 1).cast("int"), F.lit(4))) for p in (first, second)]


def _groups(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by their first columns, cut so that rows of one key stay together."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows, bool)
        for k in range(keys):
            x = b.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= x[1:] != x[:-1]
            if rest and x[0] != rest[-1].column(k)[-1].as_py():
                change[0] = True
        cuts = np.flatnonzero(change)
        if not len(cuts):
            rest.append(b)
            continue
        whole = [*rest, b.slice(0, cuts[-1])]
        rest = [b.slice(cuts[-1])]
        yield pa.Table.from_batches(whole).combine_chunks().to_batches()[0] if sum(x.num_rows for x in whole) else b.slice(0, 0)
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]


def _pairs_within(node: np.ndarray, n: np.ndarray, share: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (sorted by node and n) of one node whose sizes allow that share, in runs of about 100,000."""
    rank = np.cumsum(np.concatenate([[0], (node[1:] != node[:-1]).astype(np.int64)]))
    low = np.searchsorted(rank * (1 << 40) + n, rank * (1 << 40) + np.ceil(n * share - 1e-9).astype(np.int64))
    count = np.arange(len(node)) - low
    at = 0
    ends = np.cumsum(count)
    while at < len(node):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 100_000)))
        c = count[at:stop]
        j = np.repeat(np.arange(at, stop), c)
        i = np.repeat(low[at:stop] - (np.cumsum(c) - c), c) + np.arange(c.sum())
        if len(j):
            yield i, j
        at = stop


def candidate_edges(reps: DataFrame, share: float, trees: int, node_limit: int, depth: int) -> DataFrame:
    """Edges (a, b) among reps (rep, n, sig, sketch) whose components hold every pair that the trees bring together and the sketches pass."""
    spark, bound = reps.sparkSession, 2 * trees * reps.count()
    spread = share - 5.5 * (share * (1 - share) / PLACES) ** 0.5
    least = int(np.floor(spread * PLACES))
    roots = [c for t in range(trees) for c in _children(F.lit(t).cast("long"))]
    rows = reps.select("rep", F.explode(F.array(*roots)).alias("node"), F.lit(None).cast("long").alias("parent"))
    leaves, dense, most = [], [], bound
    for d in range(depth):
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("leader"), F.max("parent").alias("above")).where("size > 1")
        sizes = at_once(stored(sizes.withColumnRenamed("node", "of"), "node-sizes", rows=bound), bound)
        held = stored(rows.drop("parent").join(sizes, F.col("node") == F.col("of")).drop("of"), "nodes", rows=bound)
        leaves.append(held.where(F.col("size") <= node_limit).select("node", "rep"))
        stays = (F.col("size") > node_limit) & (F.lit(True) if d == depth - 1 else F.coalesce(2 * F.col("size") >= F.col("above"), F.lit(False)))
        dense.append(held.where(stays).select(F.col("rep").alias("a"), F.col("leader").alias("b")))
        large = (F.col("size") > node_limit) & ~stays
        left = 0 if d == depth - 1 else sizes.where(large).agg(F.sum("size")).first()[0] or 0
        if not left:
            break
        further = held.where(large).select("node", "size", F.col("rep").alias("of"))
        # signatures of sets that are in no large node stay where they are
        more = (F.broadcast(further) if left <= TASK_ROWS else further).join(reps, F.col("of") == F.col("rep"))
        rows = more.select("rep", F.explode(F.array(*_children(F.col("node")))).alias("child"), F.col("size").alias("parent")).withColumnRenamed("child", "node")
        bound = 2 * left
        rows, most = at_once(stored(rows, "nodes", rows=bound), bound), most + bound
    rows = leaves[0]
    for more in leaves[1:]:
        rows = rows.unionByName(more)
    sketch = reps.select(F.col("rep").alias("of"), "n", "sketch")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _groups(batches):
            if not b.num_rows:
                continue
            node, n, rep = (b.column(k).to_numpy() for k in range(3))
            sketches = np.frombuffer(b"".join(binary_values(b.column(3))), np.uint8).reshape(-1, PLACES)
            found = []
            for i, j in _pairs_within(node, n, share):
                alike = np.count_nonzero(sketches[i] == sketches[j], axis=1) >= least
                found.append((i[alike], j[alike]))
            if not found:
                continue
            label = smallest(np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]), len(node))
            out = np.flatnonzero(label != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(rep[out]), pa.array(rep[label[out]])], names=["a", "b"])

    dealt = rows.join(sketch, F.col("rep") == F.col("of")).select("node", "n", "rep", "sketch").repartition("node").coalesce(tasks(spark, most, SKETCHES)).sortWithinPartitions("node", "n")
    edges = dealt.mapInArrow(tidy(compare), "a long, b long")
    for more in dense:
        edges = edges.unionByName(more)
    return edges.where("a <> b")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether sorted sets reach that share of intersection over union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    place = np.searchsorted(b, a)
    place[place == len(b)] = 0
    both = int(np.count_nonzero(b[place] == a))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _small_classes(rows: DataFrame, width: int, percent: int, n: int) -> DataFrame:
    """Confirmed links (a, b) that connect what links connect, in classes of few sets: at most n rows class, rep, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _groups(batches):
            if not b.num_rows:
                continue
            of, rep = b.column(0).to_numpy(), b.column(1).to_numpy()
            ends = [*np.flatnonzero(of[1:] != of[:-1]) + 1, len(of)]
            links, at = [], 0
            for end in ends:
                sets = text_sets(binary_values(b.column(2).slice(at, end - at)), width)
                label = list(range(len(sets)))
                for i in range(len(sets)):
                    for j in range(i):
                        if label[i] != label[j] and linked(sets[i], sets[j], percent):
                            links.append((rep[at + i], rep[at + j]))
                            old, new = label[i], label[j]
                            label = [new if x == old else x for x in label]
                at = end
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], names=["a", "b"])

    return rows.select("class", "rep", "text").repartition("class").coalesce(tasks(rows.sparkSession, n, TEXTS)).sortWithinPartitions("class", "rep").mapInArrow(tidy(run), "a long, b long")


class Postings:
    """Which of some sets hold a token."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.owner = owner[order]
        self.keys, self.starts = np.unique(flat[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(flat))

    def linked(self, sets: list[np.ndarray], percent: int, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in sets, places here) that reach the share, for as many sets at a time as have at most ``most`` postings."""
        at, n = 0, len(self.sizes)
        while at < len(sets):
            end, hits, owners, work = at, [], [], 0
            while end < len(sets) and (end == at or (work < most and (end - at) * n < most)):
                place = np.searchsorted(self.keys, sets[end])
                place = place[place < len(self.keys)] if not len(self.keys) else np.minimum(place, len(self.keys) - 1)
                place = place[self.keys[place] == sets[end]]
                length = self.ends[place] - self.starts[place]
                total = int(length.sum())
                if total:
                    index = np.repeat(self.starts[place] - (np.cumsum(length) - length), length) + np.arange(total)
                    owners.append(self.owner[index])
                    hits.append(np.full(total, end - at))
                work += total
                end += 1
            if hits:
                both = np.bincount(np.concatenate(hits) * n + np.concatenate(owners), minlength=(end - at) * n)
                sizes = np.repeat([len(x) for x in sets[at:end]], n) + np.tile(self.sizes, end - at)
                found = np.flatnonzero((both > 0) & (100 * both >= percent * (sizes - both)))
                yield found // n + at, found % n
            at = end


def _against_pivots(rows: DataFrame, width: int, percent: int, n: int) -> DataFrame:
    """Confirmed links of sets with the pivots of their block: about n rows class, chunk, part, kind (0: pivot), rep, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pivots, names, ready = None, [], [], None
        for b in batches:
            keys = list(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
            kinds, reps = b.column(3).to_pylist(), b.column(4).to_numpy()
            sets = text_sets(binary_values(b.column(5)), width)
            at = 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at] and kinds[end] == kinds[at]:
                    end += 1
                if keys[at] != key:
                    key, pivots, names, ready = keys[at], [], [], None
                if kinds[at] == 0:
                    pivots += sets[at:end]
                    names += reps[at:end].tolist()
                elif pivots:
                    ready = ready or Postings(pivots)
                    for i, j in ready.linked(sets[at:end], percent):
                        a, c = reps[at + i], np.array(names)[j]
                        yield pa.RecordBatch.from_arrays([pa.array(a[a != c]), pa.array(c[a != c])], names=["a", "b"])
                at = end

    keys = ["class", "chunk", "part"]
    return rows.select(*keys, "kind", "rep", "text").repartition(*keys).coalesce(tasks(rows.sparkSession, n, TEXTS)).sortWithinPartitions(*keys, "kind").mapInArrow(tidy(run), "a long, b long")


def _chunked(members: DataFrame) -> DataFrame:
    """members (class, rep, text, size) with the number of blocks of their class and their own block."""
    return members.withColumn("chunks", F.ceil(F.col("size") / CHUNK)).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")))


def _met(rows: DataFrame, state: DataFrame, width: int, percent: int, rounds: int | None, salts: int) -> tuple[DataFrame, DataFrame]:
    """Rounds in which sets meet pivots: state (class, node, component, met) after so many rounds, or after all that are needed, and the
    sets (class, node) that are outside the largest component of their class and have not met all others."""
    links, n = None, state.count()
    state = at_once(state, n)
    while True:
        counts = state.groupBy("class", "component").agg(F.count(F.lit(1)).alias("n"))
        main = stored(counts.groupBy("class").agg(F.max(F.struct("n", "component")).alias("m")).select(F.col("class").alias("of"), F.col("m.component").alias("main")), "main", rows=n)
        main = at_once(main, n)
        outside = state.join(main, F.col("class") == F.col("of")).where((F.col("component") != F.col("main")) & ~F.col("met"))
        if rounds == 0:
            return state, outside.select("class", "node")
        # one for each of a number of salts, eight times as many each time: the choice is summed before it is shuffled; all where they are no more
        left = outside.groupBy(F.col("class").alias("in")).agg(F.count(F.lit(1)).alias("left"))
        salt = F.when(F.col("left") <= salts, F.col("node")).otherwise(F.pmod(F.xxhash64("node", F.lit(salts)), F.lit(salts)))
        chosen = outside.select("class", "node").join(left, F.col("class") == F.col("in")).groupBy("class", salt.alias("salt")).agg(F.min(F.struct(F.xxhash64("node", F.lit(6)).alias("h"), "node")).alias("p"))
        chosen = at_once(stored(chosen.select(F.col("class").alias("of"), F.col("p.node").alias("node")), "pivots", rows=n), n)
        parts = stored(chosen.groupBy(F.col("of").alias("for")).agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts")), "parts", rows=n)
        most = parts.agg(F.max("parts")).first()[0]
        if not most:
            return state, chosen.withColumnRenamed("of", "class")
        held = rows.join(parts, F.col("class") == F.col("for"))
        pivots = held.join(chosen, (F.col("class") == F.col("of")) & (F.col("rep") == F.col("node"))).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        pivots = pivots.withColumn("part", F.pmod(F.xxhash64("rep", F.lit(8)), F.col("parts")))
        meet = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        both = pivots.select("class", "chunk", "part", F.lit(0).alias("kind"), "rep", "text").unionByName(meet.select("class", "chunk", "part", F.lit(1).alias("kind"), "rep", "text"))
        found = stored(_against_pivots(both, width, percent, n * most), "links")
        # what was one component stays one
        links = (links if links is not None else state.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))).unionByName(found)
        now = at_once(components(links), n).select(F.col("node").alias("k"), F.col("component").alias("c"))
        state = stored(
            state.join(now, F.col("node") == F.col("k"), "left").join(chosen.select(F.col("node").alias("p")).distinct(), F.col("node") == F.col("p"), "left")
            .select("class", "node", F.coalesce("c", "component").alias("component"), (F.col("met") | F.col("p").isNotNull()).alias("met")),
            "state", rows=n,
        )
        state = at_once(state, n)
        salts *= 8
        rounds = rounds and rounds - 1


def _by_block(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, np.ndarray | None, np.ndarray, list[np.ndarray]]]:
    """Rows class, chunk, frequent, rep, text in that order, as runs of one block: key, frequent, reps, sets."""
    for b in batches:
        keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        sets, reps, at = text_sets(binary_values(b.column(4)), width), b.column(3).to_pylist(), 0
        while at < len(keys):
            end = at
            while end < len(keys) and keys[end] == keys[at] and (reps[end] is None) == (reps[at] is None):
                end += 1
            frequent = None if reps[at] is not None else np.array(b.column(2)[at].as_py(), np.int64).view(np.uint64)
            yield keys[at], frequent, reps[at:end], sets[at:end]
            at = end


def _frequent(rows: DataFrame, width: int) -> DataFrame:
    """Shingles that a class's sets share, rarest first: those in a tenth of a block's sets. So there are at most about ten times as many
    as a mean set has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tokens, counts, size = None, np.zeros(0, np.uint64), np.zeros(0, np.int64), 0

        def out() -> pa.RecordBatch:
            keep = counts >= max(2, size * SHARED)
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * int(keep.sum()), pa.int64()), pa.array(tokens[keep].view(np.int64)), pa.array(counts[keep])], names=["class", "token", "n"])

        for k, _, _, sets in _by_block(batches, width):
            if key is not None and k != key:
                yield out()
                tokens, counts, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
            key, size = k, size + len(sets)
            flat = np.concatenate([tokens, *sets])
            tokens, back = np.unique(flat, return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, np.ones(len(flat) - len(counts), np.int64)])).astype(np.int64)
        if key is not None:
            yield out()

    blocks = rows.select("class", "chunk", F.lit(None).cast("array<long>").alias("frequent"), "rep", "text").repartition("class", "chunk")
    blocks = blocks.coalesce(tasks(rows.sparkSession, rows.count(), TEXTS)).sortWithinPartitions("class", "chunk")
    found = blocks.mapInArrow(tidy(run), "class long, token long, n long").groupBy("class", "token").agg(F.sum("n").alias("n"))
    return found.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("x")).select(F.col("class").alias("of"), F.col("x.token").alias("frequent"))


def _own_shingles(rows: DataFrame, frequent: DataFrame, width: int, percent: int) -> DataFrame:
    """Rows (class, rep, uid, n, own, tail) for each different set: its size, its shingles that are not frequent, and as many frequent ones,
    rarest first, as its first shingles need beyond those. uid names the set where one rep stands for several texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, known, rank, last, seen = None, np.zeros(0, np.uint64), np.zeros(0, np.int64), None, set()
        for key, told, reps, sets in _by_block(batches, width):
            if key != before:
                before, known, last = key, np.zeros(0, np.uint64), None
            if told is not None:
                rank = np.argsort(told)
                known = told[rank]
                continue
            out = []
            for rep, x in zip(reps, sets, strict=True):
                if rep != last:
                    last, seen = rep, set()
                uid = int((mix(np.array([rep], np.int64).view(np.uint64)) ^ mix(x).sum(dtype=np.uint64)).view(np.int64)[0])
                if uid in seen:
                    continue
                seen.add(uid)
                at = np.minimum(np.searchsorted(known, x), max(len(known) - 1, 0))
                common = known[at] == x if len(known) else np.zeros(len(x), bool)
                n, own = len(x), x[~common]
                more = max(0, n - -(-percent * n // 100) + 1 - len(own))
                tail = x[common][np.argsort(rank[at[common]], kind="stable")[:more]] if more else x[:0]
                out.append((rep, uid, n, own.view(np.int64), tail.view(np.int64)))
            if out:
                reps_, uids, sizes, *lists = zip(*out, strict=True)
                arrays = [pa.array(c, pa.int64()) for c in ([key[0]] * len(out), reps_, uids, sizes)]
                arrays += [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, c)]), pa.int32()), pa.array(np.concatenate(c))) for c in lists]
                yield pa.RecordBatch.from_arrays(arrays, names=["class", "rep", "uid", "n", "own", "tail"])

    none = F.lit(None).cast("array<long>")
    lists = rows.select("class", "chunk").distinct().join(frequent, F.col("class") == F.col("of")).select("class", "chunk", "frequent", F.lit(None).cast("long").alias("rep"), F.lit("").alias("text"))
    both = lists.unionByName(rows.select("class", "chunk", none.alias("frequent"), "rep", "text")).repartition("class", "chunk")
    both = both.coalesce(tasks(rows.sparkSession, rows.count(), TEXTS)).sortWithinPartitions("class", "chunk", F.asc_nulls_first("rep"), "text")
    return both.mapInArrow(tidy(run), "class long, rep long, uid long, n long, own array<long>, tail array<long>")


def _firsts(sets: DataFrame, told: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The first shingles of each set of _own_shingles() in order of their count in the class, frequent ones last.

    (class, token, uid, rep, n, pos, count, component, out, begin): those that other sets hold too, with their place among all of the set's and
    the place where common ones (frequent, or of more than PAIRED sets) begin; and (class, token, rep, low, out): common ones at places
    where the first shingle that a linked pair shares can stand, low where it can in the smaller set. told: node, component, out.
    """
    probe, low = F.expr(f"n - ({percent} * n + 99) div 100 + 1"), F.expr(f"n - ({2 * percent} * n + {99 + percent}) div {100 + percent} + 1")
    tokens = sets.select("class", "uid", F.explode("own").alias("token"))
    tokens = tokens.withColumn("count", F.count(F.lit(1)).over(Window.partitionBy("class", "token"))).where("count > 1")
    info = stored(sets.select("class", F.col("uid").alias("of"), "rep", "n", F.size("own").cast("long").alias("alone"), "tail").join(told, F.col("rep") == F.col("node")).drop("node"), "set-sizes")
    of = Window.partitionBy("uid")
    placed = tokens.join(info.drop("class", "tail"), F.col("uid") == F.col("of"))
    # shingles of one set only come first and need no row
    placed = placed.withColumn("pos", F.col("alone") - F.count(F.lit(1)).over(of) + F.row_number().over(of.orderBy("count", "token")) - 1).where(F.col("pos") < probe + AGREE - 1)
    begin = F.coalesce(F.min(F.when(F.col("count") > PAIRED, F.col("pos"))).over(of), "alone")
    placed = stored(placed.select("class", "token", "uid", "rep", "n", "pos", "count", "component", "out", begin.alias("begin")), "first-shingles")
    common = placed.where(F.col("count") > PAIRED).where(F.col("pos") < probe).select("class", "token", "rep", (F.col("pos") < low).alias("low"), "out")
    tails = info.select("class", "rep", "n", "alone", "out", F.posexplode("tail").alias("at", "token"))
    return placed, common.unionByName(tails.select("class", "token", "rep", (F.col("alone") + F.col("at") < low).alias("low"), "out"))


def _pairs(placed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of reps, the smaller set first, that links not known yet can join: of two linked sets the places among all shingles of the
    first AGREE that they share are bounded by their sizes, so a pair counts the shared ones within these bounds. Fewer do only where
    common ones may be the rest. Pairs within a component, or of sets that need not meet, are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _groups(batches, 2):
            if not b.num_rows:
                continue
            of, token, n, pos, uid, rep, component = (b.column(k).to_numpy() for k in range(7))
            begin, out = b.column(7).to_numpy(), b.column(8).to_numpy(zero_copy_only=False)
            group = np.cumsum(np.concatenate([[0], (of[1:] != of[:-1]) | (token[1:] != token[:-1])]))
            for i, j in _pairs_within(group, n, percent / 100):
                least = -(-percent * (n[i] + n[j]) // (100 + percent))
                end_i, end_j = n[i] - least + AGREE, n[j] - least + AGREE
                keep = (component[i] != component[j]) & (out[i] | out[j]) & (pos[i] < end_i) & (pos[j] < end_j)
                i, j, least, behind = i[keep], j[keep], least[keep], ((begin[i] < end_i) & (begin[j] < end_j))[keep]
                if len(i):
                    # equally large sets in the order of their names, so that all of a pair's rows agree
                    swap = (n[i] == n[j]) & (uid[i] > uid[j])
                    i, j = np.where(swap, j, i), np.where(swap, i, j)
                    columns = [uid[i], uid[j], rep[i], rep[j], np.minimum(least, AGREE), behind]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["ua", "ub", "a", "b", "need", "behind"])

    few = placed.where(F.col("count") <= PAIRED).select("class", "token", "n", "pos", "uid", "rep", "component", "begin", "out")
    found = few.repartition("class", "token").coalesce(tasks(placed.sparkSession, placed.count(), SKETCHES)).sortWithinPartitions("class", "token", "n").mapInArrow(tidy(run), "ua long, ub long, a long, b long, need long, behind boolean")
    counted = found.groupBy("ua", "ub", "a", "b").agg(F.count(F.lit(1)).alias("c"), F.max("need").alias("need"), F.max("behind").alias("behind"))
    return counted.where("c >= need or behind").select("a", "b").distinct()


def _confirmed(rows: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those pairs (a, b) of reps that are links on full sets: rows rep, text. Each a is the pivot of blocks of its b."""
    of = pairs.groupBy(F.col("a").alias("of")).agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    of = stored(of, "pair-pivots")
    pivots = rows.select("rep", "text").join(of, F.col("rep") == F.col("of")).select(F.col("of").alias("class"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("kind"), "rep", "text")
    with_blocks = pairs.join(of, F.col("a") == F.col("of")).select(F.col("of").alias("class"), F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"), "b")
    meet = rows.select("rep", "text").join(with_blocks, F.col("rep") == F.col("b")).select("class", "chunk", F.lit(1).alias("kind"), "rep", "text")
    return _against_pivots(pivots.unionByName(meet).withColumn("part", F.lit(0)), width, percent, pairs.count())


def _low_sets_meet_all(rows: DataFrame, sets: DataFrame, width: int, percent: int, n: int) -> DataFrame:
    """Links (a, b) between sets at low places and all of their class: sets class, rep, low, n, lows (counts in the class); rows rep, text.
    n: about how many texts meet."""
    sets = sets.withColumns({"chunks": F.ceil(F.col("n") / CHUNK), "parts": F.ceil(F.col("lows") / PART)}).select("class", F.col("rep").alias("k"), "low", "chunks", "parts")
    pivots = sets.where("low").select("class", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.pmod(F.xxhash64("k", F.lit(8)), F.col("parts")).alias("part"), F.lit(0).alias("kind"), "k")
    meet = sets.select("class", F.pmod(F.xxhash64("k"), F.col("chunks")).alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"), "k")
    return _against_pivots(rows.select("rep", "text").join(pivots.unionByName(meet), F.col("rep") == F.col("k")).drop("k"), width, percent, n)


def _large_classes(members: DataFrame, width: int, percent: int) -> DataFrame:
    """As _small_classes, for classes of any size: rows class, rep, text, size.

    After two rounds of pivots copies are together. Where more than FINER sets of a class stay outside (as pages of one template do), first shingles
    decide before more texts move, rarest in the class first: two sets meet only if they share AGREE of them within the places that a link
    leaves (_pairs). Where the first shingle that they share is a common one, the sets that have it at a low place meet all that have it, or, if
    these are many, sets are cut finer by such shingles and meet in rounds as before.
    """
    rows = stored(_chunked(members), "large-classes")
    state = rows.select("class", F.col("rep").alias("node"), F.col("rep").alias("component"), F.lit(False).alias("met"))
    state, outside = _met(rows, state, width, percent, 2, PIVOTS)
    outside = stored(outside, "outside")
    open_ = stored(outside.groupBy(F.col("class").alias("of")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FINER).select("of"), "many-outside")
    finer_ones = open_.limit(1).count() > 0
    # where few are outside, rounds go on
    few = (rows.join(open_, F.col("class") == F.col("of"), "left_anti"), state.join(open_, F.col("class") == F.col("of"), "left_anti")) if finer_ones else (rows, state)
    done, _ = _met(*few, width, percent, None, 64 * PIVOTS)
    edges = done.select(F.col("node").alias("a"), F.col("component").alias("b"))
    if not finer_ones:
        return edges
    state = state.join(open_, F.col("class") == F.col("of"), "left_semi")
    outside = outside.join(open_, F.col("class") == F.col("of"), "left_semi")
    edges = edges.unionByName(state.select(F.col("node").alias("a"), F.col("component").alias("b")))
    rows = rows.join(open_, F.col("class") == F.col("of"), "left_semi")
    told = state.join(outside.select(F.col("node").alias("o")).distinct(), F.col("node") == F.col("o"), "left").select("node", "component", F.col("o").isNotNull().alias("out"))
    placed, firsts = _firsts(stored(_own_shingles(rows, _frequent(rows, width), width, percent), "own-shingles"), told, percent)
    pairs = stored(_pairs(placed, percent), "pairs")
    if pairs.limit(1).count():
        edges = edges.unionByName(stored(_confirmed(rows, pairs, width, percent), "links"))
    # what only common shingles join
    firsts = stored(firsts, "common-shingles")
    held = firsts.groupBy("class", "token").agg(F.count(F.lit(1)).alias("n"), F.max("low").alias("low"), F.max("out").alias("out"), F.min("rep").alias("leader"))
    held = stored(held.where("n > 1 and low and out").select(F.col("class").alias("of"), F.col("token").alias("t"), "leader"), "shared-shingles")
    if held.limit(1).count() == 0:
        return edges
    common = stored(firsts.join(held, (F.col("class") == F.col("of")) & (F.col("token") == F.col("t"))).select("class", "rep", "low", "leader"), "common-sets")
    # the smaller set of a link has the shingle at a low place: where few sets have, they are the pivots of all
    sets = common.groupBy("class", "rep").agg(F.max("low").alias("low"))
    counts = sets.groupBy(F.col("class").alias("of")).agg(F.count(F.lit(1)).alias("n"), F.count_if("low").alias("lows"))
    counts = stored(counts.withColumn("straight", F.col("lows") <= F.greatest(F.lit(FINER), F.col("n") / FEW)), "low-sets")
    straight = counts.where("straight")
    meetings = straight.agg(F.sum(F.col("n") * F.ceil(F.col("lows") / PART))).first()[0] or 0
    if meetings:
        edges = edges.unionByName(stored(_low_sets_meet_all(rows, sets.join(straight, F.col("class") == F.col("of")), width, percent, meetings), "links"))
    left = counts.where("not straight").select("of")
    if left.limit(1).count() == 0:
        return edges
    together = common.join(left, F.col("class") == F.col("of"), "left_semi").select(F.col("rep").alias("a"), F.col("leader").alias("b")).where("a <> b").distinct()
    finer = stored(components(stored(together, "finer-edges")).select("node", F.col("component").alias("finer")), "finer")
    sizes = finer.groupBy("finer").agg(F.count(F.lit(1)).alias("n"))
    moved = finer.join(sizes, "finer").select("finer", F.col("node").alias("k"), "n")
    rows = rows.join(moved, F.col("rep") == F.col("k")).select(F.col("finer").alias("class"), "rep", "text", F.col("n").alias("size"))
    rows = stored(_chunked(rows), "finer-classes")
    again = state.drop("class").join(finer.withColumnRenamed("node", "k"), F.col("node") == F.col("k")).select(F.col("finer").alias("class"), "node", "component", "met")
    again, _ = _met(rows, stored(again, "state"), width, percent, None, PIVOTS)
    return edges.unionByName(again.select(F.col("node").alias("a"), F.col("component").alias("b")))


def near_duplicates(
    df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", trees: int = TREES, node_limit: int = NODE, class_limit: int = CLASS, depth: int = DEPTH
) -> DataFrame:
    """One row per row: doc_id, n_shingles, component_id, kept.

    Words are runs without ASCII white space, with A-Z in lower case; a document's set has its different runs of width words, or with
    fewer words the whole sequence. Documents are linked whose intersection has percent of their union or more; a component is what links
    connect, named by its smallest doc_id, and the row of that id is kept. A null, empty or blank text has an empty set and no links.
    Repeated rows are one document; rows of one id and different texts each belong to their own text. A row with a null id is left out
    of the comparison: it is kept and has a null component. An empty table gives no rows. Other columns are not read.
    """
    prepare(df.sparkSession)
    docs = stored(sketched(df, width, id_col, text_col), "signatures")
    low = F.concat(*(F.substring("sig", 4 * p + 1, 1) for p in range(PLACES)))
    # equal sets have one signature
    sets = docs.where("n > 0 and doc_id is not null").groupBy(F.col("h1").alias("k1"), F.col("h2").alias("k2")).agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    sets = stored(sets.withColumn("sketch", low).coalesce(tasks(df.sparkSession, docs.count(), SKETCHES)), "sets")
    reps = sets.select("rep", "n", "sig", "sketch")
    classes = stored(components(candidate_edges(reps, percent / 100, trees, node_limit, depth)), "classes")
    n = classes.count()
    classes = at_once(classes, n)
    sizes = stored(classes.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "class-sizes", rows=n).withColumnRenamed("component", "class")
    members = classes.select(F.col("node").alias("rep"), F.col("component").alias("of")).join(sizes, F.col("of") == F.col("class")).drop("of")
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # texts of other sets stay where they are
    members = F.broadcast(members) if n <= BROADCAST_SETS else members
    members = stored(texts.join(members, F.col("rep") == F.col("id")).select("class", "rep", "text", "size"), "members")
    links = _small_classes(members.where(F.col("size") <= class_limit), width, percent, n)
    large = members.where(F.col("size") > class_limit)
    if large.limit(1).count():
        links = links.unionByName(_large_classes(large, width, percent))
    found = stored(components(links), "components")
    named = sets.join(found, F.col("rep") == F.col("node"), "left").select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    named = stored(named, "named")
    of = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    out = docs.select("doc_id", "n", "h1", "h2").join(named, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & (F.col("n") > 0) & F.col("doc_id").isNotNull(), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), of.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """df with one document of each component of near_duplicates(). An id stays if a row of it is kept; of repeated rows with one id and
    one text one stays. Rows with a null id stay. All columns stay as they are."""
    kept = near_duplicates(df, id_col=id_col, text_col=text_col, **settings).where("kept and doc_id is not null").select(F.col("doc_id").alias("__kept")).distinct()
    there = df.where(F.col(id_col).isNotNull()).join(stored(kept, "kept"), F.col(id_col).cast("long") == F.col("__kept"), "left_semi")
    once = there.withColumn("__text", F.xxhash64(text_col)).dropDuplicates([id_col, "__text"]).drop("__text")
    return once.unionByName(df.where(F.col(id_col).isNull()))


def neardup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> components at 0.8 over pairs of words."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2)
