"""N-gram Jaccard join by chosen paths.

A document is the set of its word n-grams. Documents with equal sets are one class; equal sets are told
by 128 bits made from 128-bit hashes of their words. Each class carries `POSITIONS` min-hashes: the
tokens of an embedding in which two sets agree in a position with a probability that is their
similarity. A run starts with all classes in one node and splits a node by sampled positions: each is
chosen with probability 1/(similarity * POSITIONS), by a hash of the node's path, and the classes that
share the chosen position's token form a child node. So pairs as similar as the threshold expect one
common child or more at every step, while others die out.

The first split is always made. A node is split on until it is small: `BUCKET` classes and `GRAMS` grams
at most, which are compared by brute force. After every `DEPTH` splits a node that is still large starts
`RESTARTS` runs of its own, so that depth doesn't cost recall. A node of which one child has more than
half is a clump of near copies that no split takes apart; it is compared as a whole, in pairs of blocks.
Runs are repeated until a pair at the threshold is missed with a probability under 1 - `RECALL`.

A pair is counted in the first of the nodes that both its classes reached, so no pair is made a row
to remove repeats: brute force gives, per class and node, a number of links and one edge to the
smallest class that it is connected with there. Candidates agree in enough positions that a pair at
the threshold fails with a probability of about 1e-6; they are verified on their words, compared as
such and not by hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.9999
POSITIONS, BUCKET, GRAMS = 64, 2048, 1 << 19
DEPTH, RESTARTS = 3, 4
#: Nodes of so few members are handled many at a time, about BATCH rows.
SMALL, BATCH = 32, 512
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_mix = common.mix


def gram_hashes(texts: list[str | None], words: int = WORDS, limit: int = 1 << 19) -> list[np.ndarray]:
    """128-bit hashes (two u64 a row) of each text's distinct n-grams, in order of the first half.

    A text of fewer words is one gram, one without words has none.
    """
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    own: list[list[np.ndarray]] = [[] for _ in data]
    for run in common.runs(data, limit):
        found = [body.split() for _, body in run]
        hashes, at = common.word_hashes([w for ws in found for w in ws]), 0
        for (d, _), ws in zip(run, found, strict=True):
            own[d].append(hashes[at : at + len(ws)])
            at += len(ws)
    return [_grams(np.concatenate(parts) if parts else np.zeros((0, 2), np.uint64), words) for parts in own]


def _grams(hashes: np.ndarray, words: int) -> np.ndarray:
    size = min(words, len(hashes))
    if not size:
        return hashes
    n = len(hashes) - size + 1
    grams = np.full((n, 2), np.uint64(size), np.uint64)
    for k in range(size):
        grams = _mix(grams * _GOLDEN + hashes[k : k + n])
    return grams[np.unique(grams[:, 0], return_index=True)[1]]


def gram_sets(texts: list[str | None], words: int = WORDS, limit: int = 1 << 19) -> list[np.ndarray]:
    """The texts' sets of n-grams as sorted numbers, equal for equal grams of these texts and only for those."""
    names: dict[bytes, int] = {}
    short: dict[tuple, int] = {}
    codes: list[np.ndarray] = []
    for text in texts:
        parts = [np.zeros(0, np.int32)]
        for body in common.cut_at_blanks((text or "").encode("utf-8", "surrogatepass"), limit):
            parts.append(np.array([names.setdefault(w, len(names)) for w in body.split()], np.int32))
        codes.append(parts[1] if len(parts) == 2 else np.concatenate(parts))
    del names
    lengths = np.array([len(c) for c in codes], np.int64)
    flat = np.concatenate([np.zeros(0, np.int32), *codes])
    grams, size = flat, 1
    if len(flat) >= words > 1:
        blocks = {1: flat}  # names of the runs of 1, 2, 4, ... words
        while 2 * size <= words:
            blocks[2 * size] = _named(blocks[size], blocks[size], size)
            size *= 2
        grams = blocks[size]
        for more in sorted(blocks, reverse=True):
            if size + more <= words:
                grams, size = _named(grams, blocks[more], size), size + more
    out, at = [], 0
    for own, n in zip(codes, lengths.tolist(), strict=True):
        if n >= words:
            out.append(np.unique(grams[at : at + n - words + 1]))
        else:  # numbered after all full grams
            out.append(np.array([len(flat) + short.setdefault(tuple(own.tolist()), len(short))] if n else [], np.int32))
        at += n
    return out


def _named(left: np.ndarray, right: np.ndarray, gap: int) -> np.ndarray:
    """Numbers of the pairs (left[i], right[i + gap]), equal for equal pairs."""
    n = len(right) - gap
    pairs = left[:n].astype(np.int64)
    pairs *= int(right.max()) + 1
    pairs += right[gap:]
    order = np.argsort(pairs)
    pairs = pairs[order]
    rank = np.zeros(n, np.int32)
    np.cumsum(pairs[1:] != pairs[:-1], out=rank[1:])
    out = np.empty(n, np.int32)
    out[order] = rank
    return out


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(2 * POSITIONS, dtype=np.uint64) * _GOLDEN
    return _mix(k[:POSITIONS]) | np.uint64(1), _mix(k[POSITIONS:])


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Min-hash tokens (u32, POSITIONS a row) of sets that aren't empty."""
    out = np.zeros((len(sets), POSITIONS), np.uint32)
    if not sets:
        return out
    a, b = _seeds()
    flat = np.concatenate(sets)
    cuts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    for k in range(POSITIONS):
        least = np.minimum.reduceat(_mix(flat * a[k] + b[k]), cuts)
        out[:, k] = (least >> np.uint64(32)).astype(np.uint32)
    return out


class Sketch:
    """Set hash (16 bytes), size and min-hashes of each row, beside its number and digest; rows without a word have a null set hash."""

    def __init__(self, words: int):
        self.words = words

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = gram_hashes(batch.column("text").to_pylist(), self.words)
        full = [k for k, s in enumerate(sets) if len(s)]
        signs = signatures([np.ascontiguousarray(sets[k][:, 0]) for k in full])
        keys: list[bytes | None] = [None] * len(sets)
        rows = np.zeros((len(sets), POSITIONS), np.int32)
        rows[full] = signs.view(np.int32)
        for k in full:
            keys[k] = xxhash.xxh3_128_digest(np.ascontiguousarray(sets[k]))
        offsets = pa.array(np.arange(len(sets) + 1) * POSITIONS, pa.int32())
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "row": batch.column("row"), "digest": batch.column("digest").cast(pa.binary()), "key": pa.array(keys, pa.binary()), "size": pa.array([len(s) for s in sets], pa.int32()), "sign": pa.ListArray.from_arrays(offsets, pa.array(rows.ravel(), pa.int32()))})


SKETCHES = "doc_id long, row long, digest binary, key binary, size int, sign array<int>"


def _digest(text) -> Column:
    """16 bytes of a text's SHA-256, by which a text is found again."""
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def missed(runs: int, similarity: float = SIMILARITY) -> float:
    """The probability that no run brings a pair at the threshold to a node where it is compared.

    The pair agrees in a binomial number of positions; given that, each split keeps a binomial number of
    common children, and a node that has to start anew counts as lost where all its own runs are.
    """
    out, choice = 0.0, 1 / (similarity * POSITIONS)
    for agree in range(POSITIONS + 1):
        lost = 0.0  # by a large node
        for _ in range(50):
            lost = _run_misses(lost, agree, choice) ** RESTARTS
        out += math.comb(POSITIONS, agree) * similarity**agree * (1 - similarity) ** (POSITIONS - agree) * _run_misses(lost, agree, choice) ** runs
    return out


def _run_misses(lost: float, agree: int, choice: float) -> float:
    for _ in range(DEPTH):
        lost = (1 - choice * (1 - lost)) ** agree
    return lost


def runs_needed(similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """The least number of runs with `missed` under 1 - recall."""
    runs = 1
    while missed(runs, similarity) > 1 - recall:
        runs += 1
    return runs


def _places(path, similarity: float):
    """The positions by which a node is split, as a column: each with probability 1/(similarity * POSITIONS)."""
    every = round(similarity * POSITIONS * 1024)
    return F.filter(F.sequence(F.lit(0), F.lit(POSITIONS - 1)), lambda i: F.pmod(F.xxhash64(path, i), F.lit(every)) < 1024)


def _chosen(path, similarity: float):
    """Children of a node as a column: the hash of (path, position, token) at each chosen position."""
    return F.transform(_places(path, similarity), lambda i: F.xxhash64(path, i, F.col("sign")[i]))


def _agreeing(similarity: float) -> int:
    """Positions in which candidates agree at least: five standard deviations under the threshold's mean."""
    return math.floor(similarity * POSITIONS - 5 * math.sqrt(POSITIONS * similarity * (1 - similarity)))


#: Rows of a matrix of pairs that are worked on at a time.
_ROWS = 256


def _alike(signs: np.ndarray, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Mask of the pairs i < j that agree in enough positions and whose sizes allow the similarity."""
    n = len(signs)
    mask = np.zeros((n, n), bool)
    for at in range(0, n, _ROWS):
        some, own = signs[at : at + _ROWS], sizes[at : at + _ROWS, None]
        agree = np.zeros((len(some), n), np.uint8)
        for k in range(POSITIONS):
            agree += some[:, k][:, None] == signs[:, k][None, :]
        near = (agree >= _agreeing(similarity)) & (np.minimum(own, sizes) >= similarity * np.maximum(own, sizes) - 1e-9)
        mask[at : at + _ROWS] = np.triu(near, at + 1)
    return mask


def _not_met(mask: np.ndarray, paths: list[np.ndarray]) -> np.ndarray:
    """Without the pairs that have met in an earlier node: one that is in both their `paths`."""
    flat, n = np.concatenate(paths), len(paths)
    if not len(flat):
        return mask
    names, at = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(n), [len(p) for p in paths])
    for lo in range(0, len(names), 1024):
        part = (at >= lo) & (at < lo + 1024)
        member = np.zeros((n, min(1024, len(names) - lo)), np.float32)
        member[owner[part], at[part] - lo] = 1
        for row in range(0, n, _ROWS):
            mask[row : row + _ROWS] &= (member[row : row + _ROWS] @ member.T) == 0
    return mask


def _pairs(table: pa.Table, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a table of one or more nodes that are candidates, each pair once over all tasks."""
    signs = table.column("print").combine_chunks().flatten().to_numpy().reshape(table.num_rows, POSITIONS)
    sizes = table.column("size").to_numpy().astype(np.int64)
    nodes, blocks, pairs = (table.column(c).to_numpy() for c in ("node", "block", "pair"))
    paths = table.column("paths").combine_chunks()
    path_ends, path_names = paths.offsets.to_numpy(), paths.values.to_numpy()
    second = ((np.sqrt(8.0 * np.maximum(pairs, 0) + 1) - 1) // 2).astype(np.int64)
    across = (pairs >= 0) & (pairs != second * (second + 3) // 2)  # of two blocks: pairs within one are met elsewhere
    order = np.lexsort((pairs, nodes))
    edge = np.flatnonzero(np.concatenate([[True], (np.diff(nodes[order]) != 0) | (np.diff(pairs[order]) != 0)]))
    count = np.diff(np.append(edge, len(order)))
    left, right = [], []
    # Small nodes together: rows at each distance within the same node.
    small = order[np.repeat(count <= SMALL, count)]
    for gap in range(1, int(count[count <= SMALL].max(initial=1))):
        i, j = small[:-gap], small[gap:]
        same = (nodes[i] == nodes[j]) & (pairs[i] == pairs[j]) & (~across[i] | (blocks[i] != blocks[j]))
        i, j = i[same], j[same]
        near = (signs[i] == signs[j]).sum(1) >= _agreeing(similarity)
        near &= np.minimum(sizes[i], sizes[j]) >= similarity * np.maximum(sizes[i], sizes[j]) - 1e-9
        i, j = i[near], j[near]
        if len(i):
            own = {r: set(path_names[path_ends[r] : path_ends[r + 1]].tolist()) for r in np.unique(np.concatenate([i, j])).tolist()}
            met = np.array([own[a].isdisjoint(own[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)])
            left.append(i[met])
            right.append(j[met])
    for at, n in zip(edge.tolist(), count.tolist(), strict=True):
        if n <= SMALL:
            continue
        rows = np.sort(order[at : at + n])
        mask = _alike(signs[rows], sizes[rows], similarity)
        if across[rows[0]]:
            mask &= blocks[rows][:, None] != blocks[rows][None, :]
        if mask.any():
            mask = _not_met(mask, [path_names[path_ends[r] : path_ends[r + 1]] for r in rows.tolist()])
        i, j = np.nonzero(mask)
        left.append(rows[i])
        right.append(rows[j])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _candidates(similarity: float):
    """Members of nodes that have a candidate to verify there."""

    def run(table: pa.Table) -> pa.Table:
        common.use()
        common.trim()
        near = table.take(pa.array(np.unique(np.concatenate(_pairs(table, similarity)))))
        return near.cast(pa.schema([(f.name, pa.list_(f.type.value_type) if pa.types.is_list(f.type) else f.type) for f in near.schema]))

    return run


def _verify(similarity: float, words: int):
    """Links of nodes' members on their n-grams, and the smallest class each is connected with."""

    def run(table: pa.Table) -> pa.Table:
        common.use()
        common.trim()
        ids, weights = table.column("class").to_numpy(), table.column("weight").to_numpy()
        links = np.zeros(table.num_rows, np.int64)
        left, right = _pairs(table, similarity)
        firsts, row_set = np.unique(ids, return_index=True, return_inverse=True)[1:]
        texts = [table.column("text")[int(r)].as_py() for r in firsts]
        if None in texts:
            raise ValueError("the documents differ between two reads of the table")
        common_grams, sizes = _common(texts, row_set[left], row_set[right], words)
        sizes = sizes[row_set]
        linked = common_grams >= similarity * (sizes[left] + sizes[right] - common_grams) - 1e-9
        left, right = left[linked], right[linked]
        np.add.at(links, left, weights[right])
        np.add.at(links, right, weights[left])
        roots = _connected(ids, left, right)
        return pa.table({"class": pa.array(ids, pa.int64()), "links": pa.array(links, pa.int64()), "root": pa.array(ids[roots], pa.int64())})

    return run


def _common(texts: list[str], left: np.ndarray, right: np.ndarray, words: int, limit: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """Common grams of each pair of texts, and the grams of each text that is in one.

    Only pairs that hang together need sets at the same time: those are taken until their texts reach `limit`.
    """
    both, sizes = np.zeros(len(left), np.int64), np.zeros(len(texts), np.int64)
    if not len(left):
        return both, sizes
    group = _connected(np.arange(len(texts)), left, right)
    size = np.bincount(group, weights=[len(t) for t in texts], minlength=len(texts))
    order = np.argsort(group[left], kind="stable")
    starts = np.concatenate([[0], np.flatnonzero(np.diff(group[left][order])) + 1, [len(order)]])
    first, held = 0, 0.0
    for a, b in zip(starts, starts[1:], strict=False):
        held += size[group[left[order[a]]]]
        if held < limit and b < len(order):
            continue
        pairs = order[first:b]
        members, place = np.unique(np.concatenate([left[pairs], right[pairs]]), return_inverse=True)
        sets = gram_sets([texts[m] for m in members.tolist()], words)
        sizes[members] = list(map(len, sets))
        both[pairs] = _overlaps(sets, place[: len(pairs)], place[len(pairs) :])
        first, held = b, 0.0
    return both, sizes


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Common grams of each pair; pairs that hang together are handled together, one group after another."""
    out = np.zeros(len(left), np.int64)
    group = _connected(np.arange(len(sets)), left, right)[left]
    order = np.argsort(group, kind="stable")
    for pairs in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        members, place = np.unique(np.concatenate([left[pairs], right[pairs]]), return_inverse=True)
        i, j = place[: len(pairs)], place[len(pairs) :]
        own = [sets[m] for m in members.tolist()]
        if len(pairs) <= 8 * len(own):
            out[pairs] = [len(np.intersect1d(own[a], own[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
        else:
            out[pairs] = _products(own)[i, j]
    return out


def _products(sets: list[np.ndarray], step: int = 1 << 20, width: int = 1 << 21) -> np.ndarray:
    """Common grams of all pairs, by products of incidence blocks over ranges of about `step` grams."""
    n = len(sets)
    ranges, end = 1 + sum(map(len, sets)) // step, 1 + max((int(s[-1]) for s in sets if len(s)), default=0)
    edges = np.array([k * end // ranges for k in range(1, ranges)], np.int64)
    cuts = [np.concatenate([[0], np.searchsorted(s, edges), [len(s)]]) for s in sets]
    total = np.zeros((n, n), np.int32)
    for k in range(ranges):
        parts = [s[c[k] : c[k + 1]] for s, c in zip(sets, cuts, strict=True)]
        owner = np.repeat(np.arange(n), [len(x) for x in parts])
        _, gram, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        shared = count[gram] > 1
        names, gram = np.unique(gram[shared], return_inverse=True)
        owner = owner[shared]
        order = np.argsort(gram, kind="stable")
        gram, owner, wide = gram[order], owner[order], max(64, width // n)
        for lo in range(0, len(names), wide):
            a, b = np.searchsorted(gram, [lo, lo + wide])
            part = np.zeros((n, min(wide, len(names) - lo)), np.float32)  # products are exact: under 2**24
            part[owner[a:b], gram[a:b] - lo] = 1
            for row in range(0, n, _ROWS):
                total[row : row + _ROWS] += (part[row : row + _ROWS] @ part.T).astype(np.int32)
    return total


def _connected(ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each member the place of the smallest id it is connected with."""
    rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    low = rank.copy()
    while True:
        new = low.copy()
        np.minimum.at(new, left, low[right])
        np.minimum.at(new, right, low[left])
        if (new == low).all():
            break
        low = new
    return np.argsort(rank)[low]


def _edges_to_classes(edges: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """class, label: the smallest class of each connected component.

    A class takes the least label among its neighbours' and its label's own label, so labels travel twice
    as far each time. They only fall, so an equal sum means the end. Few labels are broadcast; of many,
    those of roots and labels that a large part of the rows has.
    """
    both = edges.unionByName(edges.select(F.col("root").alias("class"), F.col("class").alias("root")))
    edges = common.settle(both.distinct(), "edges", total)
    labels = common.settle(nodes.select("class", F.col("class").alias("label")), "labels", total)
    n_labels, n_edges = labels.count(), edges.count()
    few = n_labels <= common.BROADCAST_NUMBERS
    roots = edges.groupBy("root").agg(F.count(F.lit(1)).alias("n"))  # a class is an end of a few edges, or a hub of many
    if not few:
        roots = common.settle(roots, "roots", total)

    def state(x):
        return x.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]

    now = state(labels)
    while now is not None:
        named, further = labels.withColumnRenamed("class", "root"), labels.select(F.col("class").alias("label"), F.col("label").alias("further"))
        if few:
            near = edges.join(F.broadcast(named), "root").select("class", "label")
            jump = labels.join(F.broadcast(further), "label").select("class", F.col("further").alias("label"))
        else:
            near = common.join_with_heavy(edges, named.join(roots, "root"), ["root"], "n", n_edges).select("class", "label")
            held = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
            jump = common.join_with_heavy(labels, further.join(held, "label"), ["label"], "n", n_labels).select("class", F.col("further").alias("label"))
        before = labels
        labels = common.settle(labels.unionByName(near).unionByName(jump).groupBy("class").agg(F.min("label").alias("label")), "labels", total)
        common.remove(before)
        last, now = now, state(labels)
        if last == now:
            break
    return labels


def _measured(level: DataFrame, total: int, more: list[str]) -> DataFrame:
    """`level` without the members that are alone in their node, and with the node's classes n and grams."""
    sizes = level.groupBy("node", *more).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("grams")).filter("n > 1")
    sizes = common.settle(sizes, "nodes", total)
    return common.settle(common.join_with_heavy(level, sizes.drop(*more), ["node"], "n", total).filter("n IS NOT NULL"), "level", total)


def _nodes(classes: DataFrame, total: int, similarity: float, recall: float) -> DataFrame:
    """node, class, block, pair, task: members of the nodes to compare by brute force, clumps in pairs of blocks."""
    # All runs start from the same root, so their chosen positions are known beforehand: a row for each run.
    roots = classes.sparkSession.range(runs_needed(similarity, recall)).select(F.xxhash64(F.lit("run"), "id").alias("path"))
    roots = roots.select("path", F.explode(_places(F.col("path"), similarity)).alias("i")).collect()
    if not roots:  # so few runs are asked for that none of them chose a position
        roots = [{"path": 0, "i": 0}]
    starts = F.array(*[F.xxhash64(F.lit(r["path"]), F.lit(r["i"]), F.col("sign")[r["i"]]) for r in roots])
    most, depth = total * len(roots), 1
    level = _measured(classes.select("class", "size", F.explode(starts).alias("node")), most, [])
    is_small = (F.col("n") <= BUCKET) & (F.col("grams") <= GRAMS)
    columns = ["node", "class", "size", "n", "grams"]
    done = level.filter(is_small).select(*columns)
    large = level.filter(~is_small)
    while not large.isEmpty():
        runs = RESTARTS if depth % DEPTH == 0 else 1
        paths = F.array(*[F.xxhash64("parent", F.lit(k)) for k in range(runs)]) if runs > 1 else F.array("parent")
        members = large.select("class", F.col("node").alias("parent"), F.col("n").alias("parent_n"))
        held = classes.select("class", "size", "sign").join(common.small_or_shuffled(members, 1 << 18), "class")
        held = held.select("*", F.explode(paths).alias("node"))
        split = _measured(held.select("class", "size", "parent", "parent_n", F.explode(_chosen(F.col("node"), similarity)).alias("node")), most, ["parent", "parent_n"])
        clumps = split.filter(2 * F.col("n") > F.col("parent_n")).select(F.col("parent").alias("node")).distinct()
        clumps = common.settle(clumps, "clumps", most)  # few: each has over BUCKET members or GRAMS grams
        done = done.unionByName(large.join(clumps, "node", "left_semi").select(*columns))
        level = split.join(clumps.withColumnRenamed("node", "parent"), "parent", "left_anti").select(*columns)
        done = done.unionByName(level.filter(is_small))
        large, depth = level.filter(~is_small), depth + 1
    # In a clump a class meets every block of its node once.
    needed = F.greatest(F.ceil(F.col("n") / BUCKET), F.ceil(F.col("grams") / GRAMS)).cast("int")
    parts = done.withColumn("blocks", needed).withColumn("block", F.pmod(F.xxhash64("class", "node"), F.col("blocks")).cast("int"))
    whole = parts.filter("blocks = 1").withColumn("pair", F.lit(-1))
    split = parts.filter("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    first, second = F.least("block", "other"), F.greatest("block", "other")
    parts = whole.unionByName(split.withColumn("pair", (second * (second + 1) / 2 + first).cast("int")).drop("other"))
    parts = common.settle(parts.select("node", "class", "block", "pair", "n", "size"), "leaves", most)
    held = parts.filter(F.col("n") <= SMALL).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("grams")).first()
    batches = 1 + max(held["rows"] // BATCH, 4 * held["grams"] // GRAMS)
    task = F.when(F.col("n") <= SMALL, F.pmod(F.xxhash64("node", "pair"), F.lit(batches))).otherwise(F.xxhash64("node", "pair"))
    return parts.select("node", "class", "block", "pair", task.alias("task"))


def _linked(docs: DataFrame, rows: DataFrame, similarity: float, words: int, recall: float) -> DataFrame:
    """key, weight, first (the lead of the component) and n_links of every class of equal sets.

    `docs` has the doc_id and text of each of `rows`; it is read again for the texts of candidates, which
    are found by doc_id and digest, so that it doesn't matter how it is split then.
    """
    total = rows.count()
    classes = _classes(rows, total)
    nodes = _nodes(classes, total, similarity, recall)
    paths = nodes.groupBy("class").agg(F.collect_set("node").alias("paths"))
    low = F.transform("sign", lambda x: (x.bitwiseAND(255) - 128).cast("byte")).alias("print")  # enough to find candidates
    members = nodes.join(classes.select("class", "size", low).join(paths, "class"), "class")
    # Of a class's nodes only those before this one tell whether a pair has met already.
    members = members.withColumn("paths", F.filter("paths", lambda p: p < F.col("node")))
    slim = "task long, node long, class long, block int, pair int, size int, print array<byte>, paths array<long>"
    members = members.select(*[c.split()[0] for c in slim.split(", ")])
    near = common.settle(members.groupBy("task").applyInArrow(_candidates(similarity), slim), "candidates", 8 * total)

    wanted = near.select("class").distinct().join(classes.select("class", F.col("lead_row.doc_id").alias("id"), F.col("lead_row.digest").alias("digest")), "class")
    wanted = common.small_or_shuffled(common.settle(wanted, "wanted", total), 1 << 18)
    texts = docs.select("doc_id", "text", _digest(F.col("text")).alias("own"))
    texts = texts.join(wanted, (F.col("own") == F.col("digest")) & F.col("doc_id").eqNullSafe(F.col("id"))).groupBy("class").agg(F.first("text").alias("text"))
    near = near.join(classes.select("class", "weight"), "class").join(texts, "class", "left")
    found = common.settle(near.groupBy("task").applyInArrow(_verify(similarity, words), "class long, links long, root long"), "links", 8 * total)

    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    edges = found.filter("class <> root").select("class", "root")
    ends = edges.select("class").union(edges.select("root")).distinct()
    labels = _edges_to_classes(edges, ends, total)
    named = common.settle(classes.select("class", "key", "weight", "lead").join(labels, "class", "left").withColumn("label", F.coalesce("label", "class")).join(links, "class", "left"), "named", total)
    # Classes of one document set stand for themselves; the others take the least lead of their component.
    leads = common.settle(named.groupBy("label").agg(F.min("lead").alias("first"), F.count(F.lit(1)).alias("n")), "leads", total)
    named = common.join_with_heavy(named, leads, ["label"], "n", max(1, classes.count()))
    return named.select("key", "weight", "first", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))


def join(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (its number), class_id, n_links and kept for every row.

    Links join rows whose sets of `words`-grams have a Jaccard similarity of at least `similarity`; a
    class is a connected component of links, named by its smallest doc_id; n_links counts all other
    rows linked with this one, equal texts among them; of a class the row of the smallest doc_id, then
    the first in the table, is kept. Texts of fewer words than a gram are one gram;
    null texts and texts without a word have no link and are classes of their own, named by their own
    doc_id. Rows that repeat an id are rows like others; a null id is the largest, and names a class
    only if all ids in it are null (class_id is then null). Whole texts are read, a long one in parts; a
    text that is compared must fit in a task, with eight bytes for each of its words several times over.
    An empty table gives an empty table; other columns are not read.
    """
    with common.scratch(docs.sparkSession) as keep_table:
        numbered = common.id_and_text(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
        return _joined(numbered, similarity, words, recall, keep_table)


def _joined(numbered: DataFrame, similarity: float, words: int, recall: float, keep_table) -> DataFrame:
    """`join` of a table of doc_id, text and row.

    Numbers may hold for one read only (files are split by the cores there are then): those of the read
    that makes the sketches are stored with them.
    """
    sketched = numbered.withColumn("digest", _digest(F.col("text")))
    rows = keep_table(common.map_chunks(sketched, Sketch(words), SKETCHES), "sketches")
    named = keep_table(_linked(numbered, rows, similarity, words, recall), "named")
    out = common.join_with_heavy(rows.select("doc_id", "row", "key"), named, ["key"], "weight", max(1, rows.count()))
    alone = F.col("first").isNull()
    return out.select(
        "doc_id",
        "row",
        F.when(alone, F.col("doc_id")).otherwise(F.nullif("first.id", F.lit(_LAST))).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (alone | (F.col("row") == F.col("first.row"))).alias("kept"),
    )


#: The place of null ids in the order of documents: last.
_LAST = 9223372036854775807


def _classes(rows: DataFrame, total: int) -> DataFrame:
    """Classes of equal sets, named by a row. Equal sets have equal min-hashes, so any of them will do."""
    lead = F.min(F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("id"), "row")).alias("lead")
    lead_row = F.min(F.struct("row", "doc_id", "digest")).alias("lead_row")
    classes = rows.filter("key IS NOT NULL").groupBy("key").agg(lead_row, F.count(F.lit(1)).alias("weight"), lead, F.first("size").alias("size"), F.first("sign").alias("sign"))
    return common.settle(classes.withColumn("class", F.col("lead_row.row")), "classes", 4 * total)


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, words: int = WORDS, recall: float = RECALL) -> DataFrame:
    """The rows of `docs` without those that `join` doesn't keep: one of each class stays, with all columns.

    All columns, whatever their names, are written once with the number of their row; the join and the
    result read that table. Nulls, ties, repeated rows, long and empty texts are what they are to `join`:
    of repeated rows one stays, rows without a word all stay. An empty table gives an empty table.
    """
    number = common.free_name(docs.columns, "_row")
    whole = common.settle(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    with common.scratch(docs.sparkSession) as keep_table:
        joined = _joined(common.id_and_text(whole, id_col, text_col, F.col(number).alias("row")), similarity, words, recall, keep_table)
    gone = common.settle(joined.filter("NOT kept").select(F.col("row").alias(number)), "gone")
    return whole.join(common.small_or_shuffled(gone), number, "left_anti").select(*docs.columns)


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join(common.documents(spark, sf_dir)).drop("row")


OP1_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST) AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
grams AS (SELECT r, ws[i : i + 4] AS g FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0) GROUP BY ALL),
sizes AS (SELECT r, count(*) AS n FROM grams GROUP BY r),
numbered AS (SELECT r, dense_rank() OVER (ORDER BY g) AS g FROM grams),
met AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM numbered AS a JOIN numbered AS b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
pairs AS (SELECT a, b FROM met JOIN sizes AS x ON x.r = a JOIN sizes AS y ON y.r = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reached(r, s) AS (SELECT r, r FROM d UNION SELECT reached.r, links.b FROM reached JOIN links ON links.a = reached.s),
leads AS (SELECT r, min(s) AS s FROM reached GROUP BY r)
SELECT d.doc_id, lead.doc_id AS class_id, (SELECT count(*) FROM links WHERE links.a = d.r) AS n_links, d.r = leads.s AS kept
FROM d JOIN leads ON leads.r = d.r JOIN d AS lead ON lead.r = leads.s
"""
