"""SimHash near-deduplication with a binary trie self-join.

Fingerprints are the leaves of a binary trie. Pairs of its nodes are walked
down together, bit by bit; each step that parts a pair adds one differing bit,
and a pair is dropped as soon as its budget is exceeded. Of two fingerprints
that differ in at most ``budget`` bits, one half differs in at most half as
many; so the trie is walked twice, once from either half, and may spend only
half the budget on the half it begins with.

The top of the trie cuts the work into tasks: a fingerprint goes to the node
of its first bits and visits the nodes, with smaller numbers, that differ in
one of them. A pair that differs there is thus met in one node.

``near_unique`` keeps one document of each group of near-duplicates in the usual
sense, a Jaccard similarity of their word shingles. Texts with one set of shingles are
one leaf, under one row; leaves may have equal fingerprints. Texts that are
similar may differ in a
sixth of their fingerprint bits, which are those of the distinct shingles that
also decide, so it takes 256 bits and walks 24 tries, each
with the bits in another order: the first ten bits must agree, further down the
budget grows with the depth. A pair in a sixth of whose bits the texts differ
is missed by all tries once in a hundred times, closer ones hardly ever. Of what a
trie finds it keeps each document's nearest two and a minimum spanning forest,
so that a crowd of near-copies costs each of them a few rows. The shingles
themselves decide on edges: first on one forest, then on all edges between
documents that this left apart. What a trie dropped is still connected by kept
edges; so where kept edges lead from one group to another, all documents of
those groups are compared by their shingles, in blocks, and no pair that a trie
met is lost to the thinning.

Null texts count as empty; a text without words has fingerprint zero and links
like any other. Rows that repeat an id count as one document in
``near_groups`` and as documents of their own in ``near_unique``, where of rows
equal in id and text one stays. A null id takes part in linking but is never a
smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.components import EDGE, components, merged, spanning_forest
from cairn.plans.scale import staged

SEED = 42
TOP_BITS = 12  # of the trie; a pair of nodes below them is one group of a task
PAIRS = 1 << 19  # node pairs walked at a time
LEAVES = 64  # pairs of leaves below a pair of nodes that are compared at once


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 of each run of ``words`` words, A-Z in lower case; shorter texts are one run."""
    found = (text or b"").lower().split()
    if not found:
        return np.zeros(0, dtype="uint64")
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype="int64", count=len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(found) > words:
        starts, ends = starts[: len(found) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(line[i:j], SEED) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
    return np.array(hashes, dtype="uint64")


def majority(hashes: np.ndarray) -> np.uint64:
    """A bit is set if it is set in over half of the hashes."""
    if not len(hashes):
        return np.uint64(0)
    bits = np.unpackbits(hashes.astype(">u8").view("u1").reshape(-1, 8), axis=1)
    ones = bits.sum(axis=0, dtype="uint32") * 2 > len(hashes)
    return np.packbits(ones).view(">u8")[0].astype("uint64")


def remixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of a hash; the 0th is itself."""
    if k:
        hashes = (hashes ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        hashes ^= hashes >> np.uint64(32)
    return hashes


def row_key(id: str, text: str) -> list[Column]:
    """What tells rows apart: the id, and a hash of the text where ids repeat."""
    return [F.col(id).cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("mark")]


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 3, size: int = 1, distinct: bool = False) -> DataFrame:
    """doc_id, mark (a hash of the text) and f0, f1 ...: ``size`` times 64 fingerprint bits of each whole text.

    With ``distinct`` each shingle counts once, and ``same`` is a hash of their set.
    """
    names = [f"f{k}" for k in range(size)] + ["same"] * distinct

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.zeros((batch.num_rows, len(names)), dtype="uint64")
            for at, value in enumerate(batch.column(2)):
                hashes = shingle_hashes(value.as_py(), words)
                if distinct:
                    hashes = np.unique(hashes)
                    rows[at, size] = xxhash.xxh64_intdigest(hashes.tobytes(), SEED)
                rows[at, :size] = [majority(remixed(hashes, k)) for k in range(size)]
            columns = [pa.array(np.ascontiguousarray(rows[:, k]).view("int64")) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "mark", *names])

    picked = docs.select(*row_key(id, text), F.col(text).cast("binary").alias("text"))
    return picked.mapInArrow(made, "doc_id bigint, mark bigint, " + ", ".join(f"{n} bigint" for n in names))


# --- the trie ---------------------------------------------------------------


def trie_pairs(
    value: np.ndarray, segment: np.ndarray, start: list[tuple[int, int, int]], bits: int, allowed: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs of leaves within the budget, in blocks.

    ``value`` holds ``bits`` bits, sorted within each segment. ``start`` has
    pairs of segments (the same twice for pairs within it) and the bits in
    which they differ so far; ``allowed[k]`` is the budget for the first k bits.
    """
    edges = np.searchsorted(segment, np.arange(segment[-1] + 2 if len(segment) else 1))
    first = np.array([(edges[a], edges[a + 1], edges[b], edges[b + 1], d) for a, b, d in start], dtype="int64")
    ones: dict[int, np.ndarray] = {}
    stack = [(0, first[i : i + PAIRS]) for i in range(0, len(first), PAIRS)]
    while stack:
        depth, pairs = stack.pop()
        same = (pairs[:, 0] == pairs[:, 2]) & (pairs[:, 1] == pairs[:, 3])
        width = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
        pairs, same, width = (x[(width > 0) & ~(same & (width == 1))] for x in (pairs, same, width))
        done = (width <= LEAVES) | (depth == bits)
        yield from leaf_pairs(value, pairs[done], same[done], width[done], int(allowed[bits]))
        pairs, same = pairs[~done], same[~done]
        if not len(pairs):
            continue
        if depth not in ones:
            bit = (value >> np.uint64(bits - 1 - depth)) & np.uint64(1)
            ones[depth] = np.concatenate([[0], np.cumsum(bit.astype("int64"))])
        count = ones[depth]
        a_lo, a_hi, b_lo, b_hi, d = pairs.T
        a_mid, b_mid = a_hi - (count[a_hi] - count[a_lo]), b_hi - (count[b_hi] - count[b_lo])
        steps = [
            np.stack([a_lo, a_mid, b_lo, b_mid, d], axis=1),
            np.stack([a_mid, a_hi, b_mid, b_hi, d], axis=1),
            np.stack([a_lo, a_mid, b_mid, b_hi, d + 1], axis=1),
            np.stack([a_mid, a_hi, b_lo, b_mid, d + 1], axis=1)[~same],
        ]
        below = np.concatenate(steps)
        below = below[below[:, 4] <= allowed[depth + 1]]
        stack += [(depth + 1, below[i : i + PAIRS]) for i in range(0, len(below), PAIRS)]


def leaf_pairs(value, pairs, same, width, budget) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of leaves below pairs of nodes, checked on the whole value."""
    begin = 0
    total = np.cumsum(width)
    while begin < len(pairs):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIRS, "right")))
        if end == begin + 1 and width[begin] > PAIRS:  # one wide pair of nodes: by rows of the first
            a_lo, a_hi, b_lo, b_hi, _ = pairs[begin]
            step = max(1, PAIRS // int(b_hi - b_lo))
            blocks = [
                (np.repeat(np.arange(i, min(i + step, a_hi)), b_hi - b_lo), np.tile(np.arange(b_lo, b_hi), min(i + step, a_hi) - i))
                for i in range(a_lo, a_hi, step)
            ]
            inner = [bool(same[begin])] * len(blocks)
        else:
            part, w = pairs[begin:end], width[begin:end]
            of = np.repeat(np.arange(len(part)), w)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(w) - w, w)
            breadth = (part[:, 3] - part[:, 2])[of]
            blocks = [(part[of, 0] + nth // breadth, part[of, 2] + nth % breadth)]
            inner = [same[begin:end][of]]
        for (i, j), within in zip(blocks, inner, strict=True):
            near = np.bitwise_count(value[i] ^ value[j]) <= budget
            near &= ~np.asarray(within) | (i < j)
            if near.any():
                yield i[near], j[near]
        begin = end


def half_budgets(bits: int, budget: int) -> np.ndarray:
    """Half the budget for the first half, all of it from there on."""
    allowed = np.full(bits + 1, budget)
    allowed[: bits // 2 + 1] = budget // 2
    return allowed


def turned(value: np.ndarray, bits: int) -> np.ndarray:
    """The second half first."""
    half = np.uint64(bits // 2)
    return ((value << (np.uint64(bits) - half)) | (value >> half)) & np.uint64((1 << bits) - 1)


NODE_ROWS = pa.schema([("node", "int32"), ("visits", "bool"), ("rep", "int64"), ("value", "int64")])


def to_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint at its node of either walk, and as a visitor at the nodes below in number."""
    for batch in batches:
        rep = np.asarray(batch.column(0))
        value = np.asarray(batch.column(1)).view("uint64")
        for walk, v in enumerate((value, turned(value, 64))):
            own = (v >> np.uint64(64 - TOP_BITS)).astype("int64")
            for bit in range(-1, TOP_BITS):
                at = np.arange(len(v)) if bit < 0 else np.flatnonzero(own >> bit & 1)
                node = own[at] if bit < 0 else own[at] ^ (1 << bit)
                columns = [node + (walk << TOP_BITS), np.full(len(at), bit >= 0), rep[at], v[at].view("int64")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, NODE_ROWS.types, strict=True)], schema=NODE_ROWS)


def near_in_task(budget: int):
    """Links between the fingerprints of a task's nodes: a spanning forest of them."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not sum(batch.num_rows for batch in batches):
            return
        table = pa.Table.from_batches(batches)
        node, rep = (np.asarray(table.column(c)) for c in ("node", "rep"))
        visits, value = np.asarray(table.column("visits")), np.asarray(table.column("value")).view("uint64")
        below = 64 - TOP_BITS  # above, a node's fingerprints agree and its visitors differ in one bit
        inner = value & np.uint64((1 << below) - 1)
        order = np.lexsort((inner, visits, node))
        node, visits, rep, value, inner = (x[order] for x in (node, visits, rep, value, inner))
        new = np.concatenate([[True], (node[1:] != node[:-1]) | (visits[1:] != visits[:-1])])
        segment = np.cumsum(new) - 1
        head, guest = node[new], visits[new]
        start = [(s, s, 0) for s in np.flatnonzero(~guest).tolist()]
        start += [(s - 1, s, 1) for s in np.flatnonzero(guest).tolist() if s and head[s - 1] == head[s]]
        allowed = half_budgets(64, budget)[TOP_BITS:]
        a = b = np.zeros(0, dtype="int64")
        for i, j in trie_pairs(inner, segment, start, below, allowed):
            i, j = i[real := np.bitwise_count(value[i] ^ value[j]) <= budget], j[real]
            a, b = np.concatenate([a, i]), np.concatenate([b, j])
            if len(a) > PAIRS:
                a, b = forest(a, b)
        a, b = forest(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b])], ["a", "b"])

    def forest(a, b):
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        keep = spanning_forest(len(nodes), at[: len(a)], at[len(a) :])
        return a[keep], b[keep]

    return links


def near_links(prints: DataFrame, budget: int = 3) -> DataFrame:
    """Links (a, b) between ids of distinct fingerprints (rep, f0) that connect all within the budget."""
    if budget // 2 > 1:
        raise ValueError("visitors differ in one bit of the top: the budget may be 3 at most")
    nodes = prints.select("rep", "f0").mapInArrow(to_nodes, "node int, visits boolean, rep bigint, value bigint")
    return nodes.repartition("node").mapInArrow(near_in_task(budget), EDGE)


def near_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 3, budget: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    Documents with one fingerprint are one leaf of the trie; leaves are linked by
    their fingerprints, and components of leaves become classes under the smallest
    id that is not null.
    """
    prints = staged(fingerprints(docs, id, text, words).drop("mark"))
    leaves = staged(prints.groupBy("f0").agg(F.min("doc_id").alias("lowest")))
    found = components(near_links(leaves.select(F.col("f0").alias("rep"), "f0"), budget))
    linked = staged(leaves.join(found, F.col("f0") == F.col("id"), "left").select("f0", F.coalesce("component", "f0").alias("class"), "lowest"))
    classes = staged(linked.join(linked.groupBy("class").agg(F.min("lowest").alias("component_id")), "class").select("f0", "component_id"))
    return prints.join(classes, "f0").select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


# --- near-duplicates by similarity of shingles ----------------------------------

SIZE = 4  # times 64 bits
TOP, TURNS = 10, 6  # bits that must agree; places from which they are taken in each 64 bits
NEAREST = 2  # candidates of a document that each of 24 tries keeps beside a spanning forest
FAR = 56  # differing bits of 256 beyond which a pair is no candidate: a fifth, and room for chance
BLOCK = 512  # documents of a crowd that are compared with as many others at a time
DENSE = 512  # pairs of a shingle from which a matrix product counts them cheaper than a list
WIDE = [f"f{k}" for k in range(SIZE)]


def rotated(value: np.ndarray, by: int) -> np.ndarray:
    return (value << np.uint64(by)) | (value >> np.uint64(64 - by)) if by else value


def to_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each wide fingerprint at its node of each trie."""
    for batch in batches:
        for word in range(SIZE):
            value = np.asarray(batch.column(f"f{word}")).view("uint64")
            for turn in range(TURNS):
                top = (rotated(value, TOP * turn) >> np.uint64(64 - TOP)).astype("int32")
                node = pa.array(top + ((word * TURNS + turn) << TOP), "int32")
                yield pa.RecordBatch.from_arrays([node, *batch.columns], ["node", *batch.schema.names])


class Candidates:
    """Pairs of n rows, thinned as they come: each row's nearest, and a minimum spanning forest.

    A pair whose rows are connected already and have ``NEAREST`` closer ones
    each adds nothing, so most pairs of a crowd are dropped at sight.
    """

    def __init__(self, n: int):
        self.n, self.size, self.parts = n, 0, []
        self.worst, self.of = np.full(n, FAR + 1), np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray, bits: np.ndarray) -> None:
        new = (bits < np.maximum(self.worst[a], self.worst[b])) | (self.of[a] != self.of[b])
        new &= (bits <= FAR) & (a != b)
        a, b, bits = a[new], b[new], bits[new]
        self.parts.append((np.minimum(a, b), np.maximum(a, b), bits))
        self.size += len(a)
        if self.size > PAIRS + (NEAREST + 1) * self.n:
            self.thin()

    def thin(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, bits = (np.concatenate([p[k] for p in self.parts] or [np.zeros(0, "int64")]) for k in range(3))
        _, first = np.unique(a * self.n + b, return_index=True)
        a, b, bits = a[first], b[first], bits[first]
        forest = spanning_forest(self.n, a, b, bits)
        row, far, edge = np.concatenate([a, b]), np.concatenate([bits, bits]), np.tile(np.arange(len(a)), 2)
        order = np.lexsort((far, row))
        row, far, edge = row[order], far[order], edge[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        self.worst = np.full(self.n, FAR + 1)
        last = rank == NEAREST - 1
        self.worst[row[last]] = far[last]
        self.of = merged(np.arange(self.n), a[forest], b[forest])
        keep = np.unique(np.concatenate([forest, edge[rank < NEAREST]]))
        self.parts, self.size = [(a[keep], b[keep], bits[keep])], len(keep)
        return self.parts[0]


def candidates_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, bits): the close pairs of a task's nodes, thinned."""
    batches = list(batches)
    if not sum(batch.num_rows for batch in batches):
        return
    table = pa.Table.from_batches(batches)
    node, row = np.asarray(table.column("node")), np.asarray(table.column("row"))
    prints = np.stack([np.asarray(table.column(c)).view("uint64") for c in WIDE], axis=1)
    inner = np.zeros(len(node), dtype="uint64")
    trie = node >> TOP
    for t in np.unique(trie).tolist():
        at = trie == t
        inner[at] = rotated(prints[at, t // TURNS], TOP * (t % TURNS))
    below = 64 - TOP
    inner &= np.uint64((1 << below) - 1)
    order = np.lexsort((inner, node))
    node, row, prints, inner = node[order], row[order], prints[order], inner[order]
    segment = np.cumsum(np.concatenate([[True], node[1:] != node[:-1]])) - 1
    start = [(s, s, 0) for s in range(segment[-1] + 1)]
    allowed = 3 + np.arange(below + 1) // 4
    found = Candidates(len(row))  # by place: what a row keeps of one trie depends on no other
    words = np.ascontiguousarray(prints.T)

    def add(i: np.ndarray, j: np.ndarray) -> None:
        bits = np.bitwise_count(words[0][i] ^ words[0][j]).astype("int64")
        for word in words[1:]:
            bits += np.bitwise_count(word[i] ^ word[j])
        found.add(i, j, bits)

    for step in range(1, 8):  # neighbours in the trie come first: what is not closer adds nothing later
        i = np.flatnonzero(segment[step:] == segment[:-step])
        add(i, i + step)
    found.thin()
    for i, j in trie_pairs(inner, segment, start, below, allowed):
        add(i, j)
    a, b, bits = found.thin()
    a, b = row[a], row[b]
    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(bits)], ["a", "b", "bits"])


def one_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's candidates those of one minimum spanning forest."""
    a = b = bits = np.zeros(0, dtype="int64")
    for batch in batches:
        a, b, bits = (np.concatenate([x, np.asarray(c)]) for x, c in zip((a, b, bits), batch.columns, strict=True))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        keep = spanning_forest(len(nodes), at[: len(a)], at[len(a) :], bits)
        a, b, bits = a[keep], b[keep], bits[keep]
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(bits)], ["a", "b", "bits"])


def shingle_sets(words: int):
    """(row, shingles): the distinct 32-bit hashes of a text's word shingles."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), words).astype("uint32")).view("int32") for t in batch.column(1)]
            ends = np.cumsum([0, *map(len, sets)])
            lists = pa.ListArray.from_arrays(pa.array(ends, "int32"), pa.array(np.concatenate([np.zeros(0, "int32"), *sets])))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["row", "shingles"])

    return made


def common_counts(row: np.ndarray, token: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many tokens each row of ``left`` shares with each of ``right``; (row, token) are distinct."""
    n_left, n_right = len(left), len(right)
    at_left, at_right = np.full(int(row.max(initial=-1)) + 1, -1), np.full(int(row.max(initial=-1)) + 1, -1)
    at_left[left], at_right[right] = np.arange(n_left), np.arange(n_right)
    _, token = np.unique(token, return_inverse=True)
    order = np.argsort(token, kind="stable")
    row, token = row[order], token[order]
    here, there = at_left[row] >= 0, at_right[row] >= 0
    n_tokens = int(token.max(initial=-1)) + 1
    per_left, per_right = np.bincount(token[here], minlength=n_tokens), np.bincount(token[there], minlength=n_tokens)
    pairs = per_left * per_right
    found = np.zeros(n_left * n_right, dtype="int64")
    first = np.cumsum(per_right) - per_right
    rows_right = at_right[row[there]]
    listed = here & (pairs[token] <= DENSE)
    i, t = at_left[row[listed]], token[listed]
    total = np.cumsum(per_right[t])
    begin = 0
    while begin < len(i):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIRS, "right")))
        width = per_right[t[begin:end]]
        nth = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
        j = rows_right[np.repeat(first[t[begin:end]], width) + nth]
        found += np.bincount(np.repeat(i[begin:end], width) * n_right + j, minlength=len(found))
        begin = end
    found = found.reshape(n_left, n_right)
    many = np.flatnonzero(pairs > DENSE)
    nth_many = np.full(n_tokens, -1)
    nth_many[many] = np.arange(len(many))
    column = nth_many[token]
    for low in range(0, len(many), 8 * BLOCK):
        part = (column >= low) & (column < low + 8 * BLOCK)
        x, y = np.zeros((n_left, 8 * BLOCK), "float32"), np.zeros((n_right, 8 * BLOCK), "float32")
        x[at_left[row[part & here]], column[part & here] - low] = 1
        y[at_right[row[part & there]], column[part & there] - low] = 1
        found += np.rint(x @ y.T).astype("int64")
    return found


def crowd_links(similarity: float):
    """(a, b): a spanning forest of the similar pairs between two blocks of a crowd whose parts differ."""

    def links(table: pa.Table) -> pa.Table:
        row, part, block = (np.asarray(table.column(c)) for c in ("row", "part", "block"))
        lists = table.column("shingles").combine_chunks()
        size = np.asarray(lists.value_lengths()).astype("int64")
        tokens = np.asarray(lists.flatten())
        left, right = np.flatnonzero(block == np.asarray(table.column("x"))[0]), np.flatnonzero(block == np.asarray(table.column("y"))[0])
        common = common_counts(np.repeat(np.arange(len(row)), size), tokens, left, right)
        united = size[left][:, None] + size[right][None, :] - common
        i, j = np.nonzero((common >= united * similarity) & (part[left][:, None] != part[right][None, :]))
        i, j = left[i], right[j]
        keep = spanning_forest(len(row), i, j)
        return pa.table([pa.array(row[i[keep]]), pa.array(row[j[keep]])], names=["a", "b"])

    return links


def compared(crowds: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that connect all similar rows of a crowd; ``crowds`` has (row, part, crowd).

    Rows are dealt to blocks, those of a large part to blocks of their own,
    which need not be compared with one another. A task compares two blocks.
    """
    sizes = crowds.groupBy("crowd", "part").agg(F.count("*").alias("n"))
    own = sizes.withColumn("of", F.when(F.col("n") > BLOCK, F.col("part")).otherwise(F.lit(-1)))
    counts = staged(own.groupBy("crowd", "of").agg(F.ceil(F.sum("n") / BLOCK).alias("count")))
    nth = F.pmod(F.xxhash64("row"), F.col("count"))
    dealt = crowds.join(own.drop("n"), ["crowd", "part"]).join(counts, ["crowd", "of"])
    dealt = staged(dealt.select("row", "part", "crowd", F.xxhash64("of", nth).alias("block")))
    blocks = counts.select("crowd", "of", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("count") - 1)).alias("nth"))
    blocks = blocks.select("crowd", "of", F.xxhash64("of", "nth").alias("block"))
    others = blocks.select("crowd", F.col("of").alias("of_y"), F.col("block").alias("y"))
    met_blocks = blocks.withColumnRenamed("block", "x").join(others, "crowd")
    met_blocks = met_blocks.filter("x <= y AND (of = -1 OR of <> of_y)").select("crowd", "x", "y")
    ends = met_blocks.withColumn("block", F.explode(F.array_distinct(F.array("x", "y"))))
    given = dealt.join(sets, "row").join(ends, ["crowd", "block"])
    return given.select("crowd", "x", "y", "block", "row", "part", "shingles").groupBy("crowd", "x", "y").applyInArrow(crowd_links(similarity), EDGE)


def near_unique(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents that stay, with all their columns: of each group the one with the smallest id."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *row_key(id, text))
    seen = fingerprints(docs, id, text, words, SIZE, distinct=True)
    key = ["doc_id", "mark"]
    prints = staged(
        seen.groupBy(*key, *WIDE, "same").agg(F.count("*").alias("n")).withColumn("row", F.monotonically_increasing_id())
    )
    # rows of one set of shingles are as similar to all others: one of them stands for all
    leaves = staged(prints.groupBy(*WIDE, "same").agg(F.min("row").alias("row"), F.count("*").alias("n")))
    found = leaves.drop("n", "same").mapInArrow(to_tries, "node int, " + ", ".join(f"{c} bigint" for c in WIDE) + ", row bigint")
    pair = EDGE + ", bits bigint"
    close = staged(found.repartition("node").mapInArrow(candidates_in_task, pair).distinct())
    alike = leaves.filter("n > 1").select(F.col("row").alias("a"), *WIDE, "same").join(prints.withColumnRenamed("row", "b"), [*WIDE, "same"])
    alike = staged(alike.filter("a <> b").select("a", "b"))
    first = staged(close.repartition("a").mapInArrow(one_forest, pair).select("a", "b"))
    ends = first.select(F.col("a").alias("row")).union(first.select("b")).distinct()
    involved = staged(prints.join(ends, "row").select("row", *key))
    texts = met(rows, involved, key).select("row", F.col(f"doc.`{text}`").cast("binary").alias("text"))
    sets = staged(texts.mapInArrow(shingle_sets(words), "row bigint, shingles array<int>").dropDuplicates(["row"]))

    def verified(edges: DataFrame) -> DataFrame:
        of_a = sets.select(F.col("row").alias("a"), F.col("shingles").alias("of_a"))
        of_b = sets.select(F.col("row").alias("b"), F.col("shingles").alias("of_b"))
        common = F.size(F.array_intersect("of_a", "of_b"))
        united = F.size("of_a") + F.size("of_b") - common
        return edges.join(of_a, "a").join(of_b, "b").filter(common >= united * F.lit(similarity)).select("a", "b")

    links = staged(verified(first).union(alike))
    parts = staged(components(links))

    def part_of(edges: DataFrame, end: str) -> DataFrame:
        own = parts.select(F.col("id").alias(end), F.col("component").alias(f"part_{end}"))
        return edges.join(own, end, "left").withColumn(f"part_{end}", F.coalesce(f"part_{end}", end))

    def apart() -> DataFrame:
        return part_of(part_of(close.select("a", "b"), "a"), "b").filter("part_a <> part_b")

    links = staged(links.union(verified(apart().select("a", "b").join(first, ["a", "b"], "left_anti"))))
    parts = staged(components(links))
    # a pair that was dropped lies in two parts of one crowd, or in one part
    crowd = staged(components(apart().select(F.col("part_a").alias("a"), F.col("part_b").alias("b"))))
    crowds = part_of(ends.withColumnRenamed("row", "a"), "a").select(F.col("a").alias("row"), F.col("part_a").alias("part"))
    crowds = staged(crowds.join(crowd.select(F.col("id").alias("part"), F.col("component").alias("crowd")), "part"))
    wide = crowds.groupBy("crowd").agg(F.count("*").alias("n")).filter(F.col("n") > NEAREST + 1)  # of fewer none was dropped
    more = compared(crowds.join(wide.select("crowd"), "crowd"), sets, similarity)
    links = links.union(more)
    classes = staged(components(links).join(prints, F.col("id") == F.col("row")).select("component", "row", *key))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    heads = staged(classes.groupBy("component").agg(F.min(order)["row"].alias("head")))
    losers = classes.join(heads, "component").filter("row <> head").select(*key, F.lit(False).alias("once"))
    repeated = prints.filter("n > 1").select(*key, F.lit(True).alias("once"))
    decided = staged(losers.union(repeated.join(losers.select("doc_id", "mark"), key, "left_anti")))
    told = met(rows, decided, key, "left")
    once = told.filter("once").groupBy("mark", "doc_id").agg(F.first("doc").alias("doc"))
    return told.filter("once IS NULL").select("doc.*").unionByName(once.select("doc.*"))


def met(rows: DataFrame, other: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """Join on the key of a row; null ids meet."""
    other = other.withColumnsRenamed({k: f"{k}_b" for k in key})
    return rows.join(other, [F.col(k).eqNullSafe(F.col(f"{k}_b")) for k in key], how)
