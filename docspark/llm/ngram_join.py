"""N-gram Jaccard join with signature trees, and the components of its links.

Documents are sets of word shingles; two link when ``100 * intersection >= percent * union``. Steps:

1. One pass makes each document's set, its fingerprint (the *node*: equal sets are one node from here on) and a count sketch of all
   shingles of all documents. The sketch has a fixed size and only orders shingles: common ones last.
2. A second pass sends each node to the shingles of its *prefix*, the first n - ceil(t * n) + 1 in that order. Two sets that link
   share a shingle of both prefixes, so the *lists* of nodes that share one hold every link. They travel as packed arrays, a
   row per bucket and not per shingle. Lists with the same members are one list, and members without a neighbour of
   fitting size leave.
3. Lists are joined by signature trees: leaves hold members of like size; every tree node holds the OR of its members' bitmaps,
   the range of their sizes and the largest count of shingles that share bits. A traversal of the tree against itself prunes
   pairs of tree nodes whose sizes or greatest possible overlap can't link; pairs that remain are compared exactly, unless
   their members are in one component already. A first round compares nodes with the same first shingle, in blocks of about ``BLOCK``,
   which joins most copies; the second takes all lists in which several components are left. There the largest component's members
   are only held against the others, so a list of thousands of copies costs no pairs among them. Long lists are dealt into pairs
   of blocks, so no task holds a whole list, and no link is lost. Signatures go first; sets follow for the members that
   signatures leave a partner.
4. The links between components go through large-star and small-star steps.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text with fewer words than a shingle is one shingle; a
null text or one without words has an empty set, links with nothing and is its own component; repeated rows are equal
sets and so one component; null ids never become a component's id unless it has no other; other input columns are not
carried, so their names cannot clash; an empty table gives an empty table; a very long text is one set of all its shingles; ids are
numbers (others raise, as the cast does). Shingles and sets are told apart by 64-bit hashes: about n * n / 2**65 pairs of n sets are taken for equal by chance.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, shuffle_partitions
from .components import components
from .textvec import mix, shingles, slice_hashes, slices, u64, utf8, words

SKETCH_BITS = 22
NEAR = 12
FAR_LEVEL = 8 * (NEAR + 8)
SKETCH_BLOCK = 1 << 14
FLUSH = 1 << 19
BLOCK = 1024
LEAF = 16
FANOUT = 8
SIGNATURE_BITS = 4096
FILTER_BITS = 24
FILTER_BLOCK = 1 << 16
SEEN = 1 << 18

_U = np.uint64


def sets(raw: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes in rising order, and how many lie before each text (n + 1)."""
    starts, ends, before = words(raw, off)
    values, at = shingles(slice_hashes(raw, starts, ends), before, width)
    cuts = at.tolist()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a > 1:
            values[a:b].sort()
    new = np.ones(len(values), dtype=bool)
    if len(values):
        new[1:] = values[1:] != values[:-1]
        new[at[:-1][at[:-1] < len(values)]] = True
    return values[new], np.concatenate([[0], np.cumsum(new)])[at]


def fingerprints(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each set, which its order does not change."""
    run = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(values ^ _U(0x243F6A8885A308D3)))])
    return mix(run[at[1:]] - run[at[:-1]] + np.diff(at).astype(np.uint64))


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


# ---- passes over texts ----


def fingerprinted(docs: DataFrame, width: int) -> DataFrame:
    """Rows of documents (doc_id, th: a hash of the text, n, node) and, with a ``block``, of each task's part of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        cells: list[np.ndarray] = []

        def count() -> None:
            if cells:
                cell, n = np.unique(np.concatenate(cells), return_counts=True)
                sketch[cell] += n.astype(np.uint32)
                cells.clear()

        for batch in batches:
            for part in slices(batch, "text"):
                values, at = sets(*utf8(part.column("text")), width)
                n = np.diff(at)
                cells.append((values >> _U(64 - SKETCH_BITS)).astype(np.uint32))
                if sum(map(len, cells)) >= FLUSH:
                    count()
                node = pa.array(fingerprints(values, at).view(np.int64), mask=n == 0)
                empty = pa.nulls(len(n))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array(n), node, empty.cast(pa.int32()), empty.cast(pa.binary())], names=names)
        count()
        for b in range(len(sketch) // SKETCH_BLOCK):
            counts = sketch[b * SKETCH_BLOCK : (b + 1) * SKETCH_BLOCK]
            if counts.any():
                one = [pa.nulls(1, pa.int64())] * 4
                yield pa.RecordBatch.from_arrays([*one, pa.array([b], pa.int32()), pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], names=names)

    names = ["doc_id", "th", "n", "node", "block", "counts"]
    return docs.withColumn("th", F.xxhash64("text")).mapInArrow(run, "doc_id long, th long, n long, node long, block int, counts binary")


def graded(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A level of 0 to 255 for each cell count, rising with it, and about how many documents more than the median cell's a level stands for.

    The cells of rare shingles hold Poisson counts, whose doubled square roots have a deviation of 1 whatever the mean. So steps of an eighth of
    that tell a half-common shingle from the noise of its cell as well as the sketch can at any size of the corpus; far above, steps are of a quarter of an octave.
    """
    root = float(np.sqrt(np.median(total)))
    z = 2 * (np.sqrt(total) - root)
    far = FAR_LEVEL + 4 * np.log2(np.maximum(z, NEAR) / NEAR)
    level = np.clip(np.where(z < NEAR, 8 * (z + 8), far), 0, 255).astype(np.uint8)
    step = np.arange(256)
    at = np.where(step < FAR_LEVEL, step / 8 - 8, NEAR * 2.0 ** ((step - FAR_LEVEL) / 4))
    return level, np.maximum((root + at / 2) ** 2 * (at > 4) - root**2, 1.0)


def levels(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """``graded`` over the whole sketch."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, None
        for batch in batches:
            for b, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                if b != block:
                    if block is not None:
                        yield row(block, total)
                    block, total = b, np.zeros(SKETCH_BLOCK, dtype=np.int64)
                total += np.frombuffer(zlib.decompress(counts), dtype=np.uint32)
        if block is not None:
            yield row(block, total)

    def row(block: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["block", "counts"])

    parts = found.filter("block is not null").select("block", "counts").repartition("block").sortWithinPartitions("block").mapInArrow(add, "block int, counts binary")
    total = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    for r in parts.collect():  # the sketch's fixed number of blocks
        total[r.block * SKETCH_BLOCK : (r.block + 1) * SKETCH_BLOCK] = np.frombuffer(zlib.decompress(r.counts), dtype=np.int64)
    return graded(total)


def prefixes(values: np.ndarray, at: np.ndarray, level: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix shingles of all sets, and which set each belongs to."""
    n = np.diff(at)
    take = np.where(n > 0, prefix_length(n, percent), 0)
    grade = level[(values >> _U(64 - SKETCH_BITS)).astype(np.int64)]
    ordered = values.copy()
    cuts = at.tolist()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        ordered[a:b] = values[a:b][np.argsort(grade[a:b], kind="stable")]
    owner = np.repeat(np.arange(len(n)), take)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(take) - take, take)
    return ordered[at[:-1][owner] + within], owner


def packed_prefixes(docs: DataFrame, level: np.ndarray, width: int, percent: int, buckets: int) -> DataFrame:
    """Rows (bucket, tokens, nodes, sizes): packed arrays of one task's prefix shingles in a bucket."""
    shared = docs.sparkSession.sparkContext.broadcast(level)  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        seen: set[int] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            tokens, nodes, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket = (mix(tokens) % _U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, tokens, nodes, sizes = bucket[order], tokens[order], nodes[order], sizes[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            blobs = []
            for x in (tokens, nodes, sizes):
                ends = (np.append(cuts, len(x)) * x.itemsize).astype(np.int32)
                blobs.append(pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(ends), pa.py_buffer(x)]))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts].astype(np.int32)), *blobs], names=["bucket", "tokens", "nodes", "sizes"])

        for batch in batches:
            for part in slices(batch, "text"):
                values, at = sets(*utf8(part.column("text")), width)
                node = fingerprints(values, at)
                fresh = np.zeros(len(node), dtype=bool)
                for i, x in enumerate(node.tolist()):
                    if x not in seen:
                        seen.add(x)
                        fresh[i] = True
                if len(seen) > SEEN:
                    seen.clear()
                tokens, owner = prefixes(values, at, shared.value, percent)
                keep = fresh[owner]
                owner = owner[keep]
                held.append((tokens[keep], node[owner], np.diff(at)[owner].astype(np.int32)))
                if sum(len(x[0]) for x in held) >= FLUSH:
                    yield from flush()
                    held.clear()
        if sum(len(x[0]) for x in held):
            yield from flush()

    return docs.mapInArrow(run, "bucket int, tokens binary, nodes binary, sizes binary")


def fits(small: np.ndarray, large: np.ndarray, percent: int) -> np.ndarray:
    return 100 * small.astype(np.int64) >= percent * large.astype(np.int64)


def bucket_lists(tokens: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list, node, size) of the lists of one bucket with two members or more; ``list`` is a hash of the members."""
    order = np.lexsort((nodes, sizes, tokens))
    tokens, nodes, sizes = tokens[order], nodes[order], sizes[order]
    same = np.zeros(len(tokens), dtype=bool)
    same[1:] = (tokens[1:] == tokens[:-1]) & (nodes[1:] == nodes[:-1])
    tokens, nodes, sizes = tokens[~same], nodes[~same], sizes[~same]
    near = (tokens[1:] == tokens[:-1]) & fits(sizes[:-1], sizes[1:], percent)
    keep = np.zeros(len(tokens), dtype=bool)
    keep[1:] |= near
    keep[:-1] |= near
    # a run of neighbours of fitting size is a list of its own
    first = np.ones(len(tokens), dtype=bool)
    first[1:] = ~near
    number = np.cumsum(first)[keep]
    nodes, sizes = nodes[keep], sizes[keep]
    if not len(nodes):
        return nodes, nodes, sizes
    starts = np.flatnonzero(np.diff(number, prepend=-1))
    name = mix(np.add.reduceat(mix(nodes), starts) + np.diff(np.append(starts, len(nodes))).astype(np.uint64))
    _, once = np.unique(name, return_index=True)
    chosen = np.zeros(len(starts), dtype=bool)
    chosen[once] = True
    which = np.cumsum(np.diff(number, prepend=-1) != 0) - 1
    keep = chosen[which]
    return name[which][keep], nodes[keep], sizes[keep]


def shared_lists(packed: DataFrame, percent: int, parts: int) -> DataFrame:
    """Distinct rows (list, node, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> Iterator[pa.RecordBatch]:
            arrays = [np.frombuffer(b"".join(x), dtype=d) for x, d in zip(zip(*held, strict=True), (np.uint64, np.uint64, np.int32), strict=True)]
            name, node, n = bucket_lists(*arrays, percent)
            if len(name):
                yield pa.RecordBatch.from_arrays([u64(name), u64(node), pa.array(n.astype(np.int64))], names=["list", "node", "n"])

        bucket, held = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bucket", "tokens", "nodes", "sizes")]
            for b, *row in zip(*columns, strict=True):
                if b != bucket:
                    if held:
                        yield from done()
                    bucket, held = b, []
                held.append(row)
        if held:
            yield from done()

    dealt = packed.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "list long, node long, n long").distinct()


def marked(ids: DataFrame) -> np.ndarray:
    """A bit array of fixed size that holds a bit for every id; null ids are not in it.

    Each task sends the blocks of the array in which it has a bit; the parts of a block are put together in one task, and only the array itself,
    of fixed size, comes to the driver. Where ids are so many that most bits are set, more rows pass by chance; none is lost.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, dtype=bool)
        for batch in batches:
            bits[filter_cell(batch.column(0))] = True
        yield from packed(enumerate(np.packbits(bits).reshape(-1, FILTER_BLOCK)))

    def packed(found) -> Iterator[pa.RecordBatch]:
        for block, bits in found:
            if bits.any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())], names=["block", "bits"])

    def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}  # a task's share of a fixed number of blocks
        for batch in batches:
            for block, bits in zip(batch.column("block").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                found[block] = found.get(block, np.uint8(0)) | np.frombuffer(zlib.decompress(bits), dtype=np.uint8)
        yield from packed(found.items())

    kind = "block int, bits binary"
    total = np.zeros(1 << FILTER_BITS - 3, dtype=np.uint8).reshape(-1, FILTER_BLOCK)
    for r in ids.mapInArrow(mark, kind).repartition("block").mapInArrow(either, kind).collect():  # the array's fixed number of blocks
        total[r.block] = np.frombuffer(zlib.decompress(r.bits), dtype=np.uint8)
    return total.reshape(-1)


def filter_cell(ids: pa.Array) -> np.ndarray:
    return (mix(ids.fill_null(0).to_numpy().view(np.uint64)) >> _U(64 - FILTER_BITS)).astype(np.int64)


def may_be(ids: pa.Array, bits: np.ndarray) -> np.ndarray:
    """Whether each id may be among the marked ones, or is null."""
    cell = filter_cell(ids)
    return (bits[cell >> 3] >> (7 - (cell & 7)) & 1).astype(bool) | ids.is_null().to_numpy(zero_copy_only=False)


def only_marked(df: DataFrame, column: str, bits: np.ndarray, others: bool = False) -> DataFrame:
    """The rows of ``df`` whose ``column`` may be among the marked ids, or is null; or all ``others``."""
    shared = df.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_be(batch.column(column), shared.value) != others))

    return df.mapInArrow(run, df.schema)


def with_sets(docs: DataFrame, wanted: DataFrame, level: np.ndarray, excess: np.ndarray, width: int, percent: int) -> DataFrame:
    """(node, token, sub, parts, n, sig, items) of the documents whose doc_id may be a ``rep`` of ``wanted``.

    A filter of fixed size clears most other texts, so no text is shuffled; those that pass it by chance do no harm. ``items`` are the packed
    shingles and ``sig`` their bitmap. ``token`` is the set's first shingle in the order, and ``sub`` deals the sets of a common one into ``parts`` of
    about ``BLOCK`` by the sketch's count.
    """
    shared = docs.sparkSession.sparkContext.broadcast((level, excess, marked(wanted.select("rep"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, excess, bits = shared.value
        for batch in batches:
            for part in slices(batch.filter(pa.array(may_be(batch.column("doc_id"), bits))), "text"):
                values, at = sets(*utf8(part.column("text")), width)
                node = fingerprints(values, at)
                tokens, owner = prefixes(values, at, order, percent)
                full = np.flatnonzero(np.diff(at))
                token = np.zeros(len(node), dtype=np.uint64)
                token[full] = tokens[np.searchsorted(owner, full)]
                often = excess[order[(token >> _U(64 - SKETCH_BITS)).astype(np.int64)]]
                parts = np.ceil(often / BLOCK).astype(np.uint64).clip(1)
                sub = (mix(node ^ token) % parts).astype(np.int64)
                items = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * 8).astype(np.int32)), pa.py_buffer(values)])
                maps = signatures(values, at)
                sig = pa.Array.from_buffers(pa.binary(), len(maps), [None, pa.py_buffer((np.arange(len(maps) + 1) * (SIGNATURE_BITS // 8)).astype(np.int32)), pa.py_buffer(maps)])
                out = pa.RecordBatch.from_arrays([u64(node), u64(token), pa.array(sub), u64(parts), pa.array(np.diff(at)), sig, items], names=names)
                yield out.filter(pa.array(np.diff(at) > 0))

    names = ["node", "token", "sub", "parts", "n", "sig", "items"]
    return docs.mapInArrow(run, "node long, token long, sub long, parts long, n long, sig binary, items binary")


# ---- signature trees ----


class Forest:
    """Union-find over small numbers, with roots as an array."""

    def __init__(self, labels: np.ndarray):
        _, self.parent = np.unique(labels, return_inverse=True)
        self.of = self.parent.copy()  # of each member
        self.parent = np.arange(int(self.of.max()) + 1 if len(self.of) else 0)

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return int(x)

    def roots(self) -> np.ndarray:
        p = self.parent
        while True:
            q = p[p]
            if (q == p).all():
                return q[self.of]
            p = q

    def join(self, i: int, j: int) -> bool:
        a, b = self.find(int(self.of[i])), self.find(int(self.of[j]))
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def signatures(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A bitmap of ``SIGNATURE_BITS`` for each set, as rows of 64-bit words."""
    bits = np.zeros((len(at) - 1, SIGNATURE_BITS // 64), dtype=np.uint64)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    bit = (mix(values) & _U(SIGNATURE_BITS - 1)).astype(np.int64)
    cell, place = np.divmod(np.unique(owner * SIGNATURE_BITS + bit), 64)
    starts = np.flatnonzero(np.diff(cell, prepend=-1))
    if len(cell):
        bits.reshape(-1)[cell[starts]] = np.bitwise_or.reduceat(_U(1) << place.astype(np.uint64), starts)
    return bits


class SignatureTree:
    """A tree over sets: ``layers[0]`` are the members, each layer above holds ORs of bitmaps, size ranges and most excess."""

    def __init__(self, bits: np.ndarray, size: np.ndarray):
        # members of like size and like low bits stand together
        self.order = np.lexsort((np.arange(len(size)), size, bits[:, 0], np.frexp(size)[1]))
        bits, size = bits[self.order], size[self.order].astype(np.int64)
        excess = size - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.layers = [(bits, size, size, excess)]
        self.cuts: list[np.ndarray] = []
        width = LEAF
        while len(self.layers[-1][1]) > 1:
            bits, low, high, excess = self.layers[-1]
            cut_at = np.arange(0, len(low), width)
            self.cuts.append(np.append(cut_at, len(low)))
            self.layers.append((np.bitwise_or.reduceat(bits, cut_at), np.minimum.reduceat(low, cut_at), np.maximum.reduceat(high, cut_at), np.maximum.reduceat(excess, cut_at)))
            width = FANOUT

    def possible(self, layer: int, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
        """Whether sets below tree nodes x and y can link, by their sizes and the greatest overlap of their bitmaps."""
        bits, low, high, excess = self.layers[layer]
        ok = fits(high[x], low[y], percent) & fits(high[y], low[x], percent)
        at = np.flatnonzero(ok)
        common = np.bitwise_count(bits[x[at]] & bits[y[at]]).sum(axis=1, dtype=np.int64)
        most = np.minimum(common + np.minimum(excess[x[at]], excess[y[at]]), np.minimum(high[x[at]], high[y[at]]))
        # overlap o of sizes a, b links when 100 * o >= percent * (a + b - o)
        ok[at] = (100 + percent) * most >= percent * (low[x[at]] + low[y[at]])
        return ok

    def pairs(self, percent: int, chunk: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of members that the traversal of the tree against itself can't rule out, in chunks."""
        stack = [(len(self.layers) - 1, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
        while stack:
            layer, x, y = stack.pop()
            if len(x) > chunk:
                stack += [(layer, x[a : a + chunk], y[a : a + chunk]) for a in range(0, len(x), chunk)][::-1]
                continue
            keep = self.possible(layer, x, y, percent)
            x, y = x[keep], y[keep]
            if not len(x):
                continue
            if layer == 0:
                yield x, y
                continue
            cuts = self.cuts[layer - 1]
            nx, ny = cuts[x + 1] - cuts[x], cuts[y + 1] - cuts[y]
            total = nx * ny
            which = np.repeat(np.arange(len(x)), total)
            k = np.arange(len(which)) - np.repeat(np.cumsum(total) - total, total)
            a, b = cuts[x][which] + k // ny[which], cuts[y][which] + k % ny[which]
            keep = a < b if layer == 1 else a <= b
            stack.append((layer - 1, a[keep], b[keep]))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def partners(labels: np.ndarray, bits: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """For each member the number of its group, -1 for none: groups are connected by pairs of other labels that the tree can't rule out."""
    tree = SignatureTree(bits, size)
    group = np.arange(len(labels))
    has = np.zeros(len(labels), dtype=bool)
    for x, y in tree.pairs(percent):
        i, j = tree.order[x], tree.order[y]
        other = labels[i] != labels[j]
        i, j = i[other], j[other]
        has[i] = has[j] = True
        while True:
            least = np.minimum(group[i], group[j])
            if (group[i] == least).all() and (group[j] == least).all():
                break
            old_i, old_j = group[i], group[j]
            np.minimum.at(group, old_i, least)
            np.minimum.at(group, old_j, least)
            while (group[group] != group).any():
                group = group[group]
    return np.where(has, group, -1)


def links(labels: np.ndarray, bits: np.ndarray, items: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of labels, enough to connect all that have linked members; members of one label are connected already."""
    forest, tree = Forest(labels), SignatureTree(bits, np.array([len(x) for x in items]))
    out = []
    for x, y in tree.pairs(percent):
        i, j = tree.order[x], tree.order[y]
        at = 0
        while at < len(i):
            roots = forest.roots()
            open_ = np.flatnonzero(roots[i[at:]] != roots[j[at:]]) + at
            at = len(i)
            for k in open_.tolist():
                a, b = items[i[k]], items[j[k]]
                both = overlap(a, b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    forest.join(int(i[k]), int(j[k]))
                    out.append((int(labels[i[k]]), int(labels[j[k]])))
                    at = k + 1
                    break
    return out


def _rows_of(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint64).reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch], key: list[str], columns: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of one key at a time, which come together."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in (*key, *columns)), strict=True):
            if row[: len(key)] != now:
                if held:
                    yield now, held
                now, held = row[: len(key)], []
            held.append(row[len(key) :])
    if held:
        yield now, held


def joined(rows: DataFrame, parts: int, percent: int, key: list[str]) -> DataFrame:
    """``rows`` (key, label, sig, items), at most a few blocks' worth a key, to edges (u, v) between labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _blocks(batches, key, ["label", "sig", "items"]):
            labels, sig, items = zip(*held, strict=True)
            found = links(np.array(labels, dtype=np.int64), _rows_of(sig), [np.frombuffer(x, dtype=np.uint64) for x in items], percent) if len(held) > 1 else []
            if found:
                u, v = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return rows.select(*key, "label", "sig", "items").repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(run, "u long, v long")


def survivors(rows: DataFrame, key: list[str], parts: int, percent: int) -> DataFrame:
    """(u, node, label) of the rows (key, node, label, n, sig) whose signatures leave them a partner.

    ``u`` is the least node of those that such pairs connect; groups with the same members are one, from whatever lists.
    """
    names = ["u", "node", "label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _blocks(batches, key, ["node", "label", "n", "sig"]):
            node, label, n, sig = zip(*held, strict=True)
            node, label = np.array(node, dtype=np.int64), np.array(label, dtype=np.int64)
            group = partners(label, _rows_of(sig), np.array(n), percent)
            keep = np.flatnonzero(group >= 0)
            if len(keep):
                least = np.full(len(node), np.iinfo(np.int64).max)
                np.minimum.at(least, group[keep], node[keep])
                yield pa.RecordBatch.from_arrays([pa.array(least[group[keep]]), pa.array(node[keep]), pa.array(label[keep])], names=names)

    dealt = rows.select(*key, "node", "label", "n", "sig").repartition(parts, *key).sortWithinPartitions(*key)
    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in names)).distinct()


def first_round(items: DataFrame, percent: int, parts: int) -> DataFrame:
    """(v, root) of nodes joined with others of the same first shingle; in blocks of about ``BLOCK``, so not all links are found.

    A shingle of several blocks is dealt a second time, in another way, with what the first time joined as labels. Each block then holds members of all
    the first blocks, so a large group of copies becomes one component here, and no pairs among its blocks are left for the second round.
    """
    key = ["token", "sub"]
    rows = items.withColumn("label", F.col("node"))
    near = marked(survivors(rows, key, parts, percent).select("node"))
    edges = cut(joined(only_marked(rows, "node", near), parts, percent, key))
    once = components(edges)
    again = items.filter("parts > 1").join(once.select(F.col("v").alias("node"), "root"), "node", "left")
    again = again.withColumns({"label": F.coalesce("root", "node"), "sub": F.pmod(F.xxhash64("node", "token"), "parts")})
    more = cut(joined(again, parts, percent, key))
    if more.isEmpty():
        return once
    return components(once.select(F.col("v").alias("u"), F.col("root").alias("v")).unionByName(more))


def dealt_in_blocks(rows: DataFrame) -> DataFrame:
    """(list, i, j, node, label, n) of the ``rows`` (list, node, label, n) of lists with several labels, so that each pair of labels' members meets.

    A list's commonest label is its main one: its members' blocks meet all others' blocks, and the others' blocks meet each other.
    """
    each = rows.groupBy("list", "label").agg(F.count("*").alias("m"))
    several = each.groupBy("list").agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.max("m").alias("d"), F.sum("m").alias("all"), F.count("*").alias("c"))
    several = several.filter("c > 1").select("list", "main", F.ceil(F.col("d") / BLOCK).alias("nd"), F.ceil((F.col("all") - F.col("d")) / BLOCK).alias("no"))
    rows = rows.join(several, "list")
    main = F.col("label") == F.col("main")
    mine = F.pmod(F.xxhash64("node"), F.when(main, F.col("nd")).otherwise(F.col("no")))
    up_to = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    with_others = F.transform(up_to(F.col("no")), lambda j: F.struct(F.col("mine").alias("i"), j.alias("j")))
    with_main = F.transform(up_to(F.col("nd")), lambda i: F.struct(i.alias("i"), F.col("mine").alias("j")))
    among = F.transform(F.filter(up_to(F.col("no")), lambda j: j != F.col("mine")), lambda j: F.struct((-1 - F.least(j, F.col("mine"))).alias("i"), F.greatest(j, F.col("mine")).alias("j")))
    rows = rows.withColumn("mine", mine).select("list", "node", "label", "n", F.explode(F.when(main, with_others).otherwise(F.concat(with_main, among))).alias("at"))
    return rows.select("list", "at.i", "at.j", "node", "label", "n")


def second_round(lists: DataFrame, items: DataFrame, comps: DataFrame, percent: int, parts: int) -> DataFrame:
    """Edges between components, from all lists that hold several of them.

    Pairs that signatures leave connect nodes into groups, over all lists; a node is in one group, so its set travels once or, in a group of
    many blocks, once a pair of blocks.
    """
    key = ["list", "i", "j"]
    rows = lists.join(comps.select(F.col("v").alias("node"), "root"), "node", "left").select("list", "node", "n", F.coalesce("root", "node").alias("label"))
    # merge joins at every size, so that a plan measured on a small table is that of a large one
    near = cut(survivors(dealt_in_blocks(rows).hint("merge").join(items.select("node", "sig"), "node"), key, parts, percent))
    group = components(near.select("u", F.col("node").alias("v")))
    nodes = near.select("node", "label").distinct().join(group.select(F.col("v").alias("node"), "root"), "node", "left")
    nodes = nodes.select(F.coalesce("root", "node").alias("list"), "node", "label", F.lit(0).alias("n"))
    kept = only_marked(items.select("node", "sig", "items"), "node", marked(near.select("node")))
    return joined(dealt_in_blocks(nodes).hint("merge").join(kept, "node"), parts, percent, key)


def similar(df: DataFrame, width: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the least doc_id that links reach, its own included), th (a hash of the text) and
    root, which names the component of a row that is not alone in its own.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = cut(fingerprinted(docs, width))
    level, excess = levels(found)
    found = found.filter("block is null").select("doc_id", "th", "n", "node")
    classes = found.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    parts = shuffle_partitions(spark)
    buckets = max(32, 2 * docs.rdd.getNumPartitions())
    lists = cut(shared_lists(packed_prefixes(docs, level, width, percent, buckets), percent, parts))
    wanted = lists.select("node").distinct().join(classes, "node").select("rep")
    items = cut(with_sets(docs, wanted, level, excess, width, percent))
    comps = first_round(items, percent, parts)
    edges = cut(second_round(lists, items, comps, percent, parts))
    rest = components(edges)
    # a node's root: by the first round, then by the second
    one = comps.select(F.col("v").alias("node"), F.col("root").alias("a")).join(rest.select(F.col("v").alias("a"), F.col("root").alias("b")), "a", "left")
    root = one.select("node", F.coalesce("b", "a").alias("root")).unionByName(rest.select(F.col("v").alias("node"), "root").join(comps.select(F.col("v").alias("node")), "node", "left_anti"))
    grouped = classes.join(root, "node", "left").select("node", "rep", "copies", F.coalesce("root", "node").alias("root"))
    least = grouped.groupBy("root").agg(F.min("rep").alias("component_id"), F.sum("copies").alias("members"))
    known = grouped.join(least.filter("members > 1"), "root").select("node", "component_id", "root")
    # rows without words have no node, and would meet in one task of the join
    out = lambda rows, component, root: rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "th", root.alias("root"))
    empty = out(found.filter("node is null"), F.col("doc_id"), F.lit(None).cast(known.schema["root"].dataType))
    return out(found.filter("node is not null").join(known, "node", "left"), F.coalesce("component_id", "doc_id"), F.col("root")).unionByName(empty)


def one_of_each(df: DataFrame, found: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``df`` with one row of each component of ``found`` (what ``similar`` gives): the one of least id, then least hash of the text; ids come before nulls.

    Rows are told apart by id and text, so an id that stands on several texts loses none that has no near copy; of rows that are equal in both, one stays. Only
    texts that a filter of fixed size does not clear of being removed or repeated are shuffled.
    """
    rows = found.filter("root is not null").groupBy("root", "doc_id", "th").agg(F.count("*").alias("n"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    best = rows.groupBy("root").agg(F.min(first).alias("best"))
    touched = rows.join(best, "root").withColumn("stays", first.eqNullSafe(F.col("best"))).filter("n > 1 or not stays")
    touched = cut(touched.select(F.xxhash64("doc_id", "th").alias("_k"), "doc_id", "th", "n", "stays"))
    bits = marked(touched.select("_k"))
    mine = df.select(F.struct(*df.columns).alias("_row"), F.col(key).cast("long").alias("_key"), F.xxhash64(text).alias("_th")).withColumn("_k", F.xxhash64("_key", "_th"))
    clear = only_marked(mine, "_k", bits, others=True)
    same = [F.col("l._k") == F.col("r._k"), F.col("l._key").eqNullSafe(F.col("r.doc_id")), F.col("l._th").eqNullSafe(F.col("r.th"))]
    rest = only_marked(mine, "_k", bits).alias("l").join(touched.alias("r"), same, "left").filter("r.stays is null or r.stays").select("l.*", "r.n")
    once = rest.filter("n > 1").dropDuplicates(["_key", "_th"]).select("_row.*")
    return clear.select("_row.*").unionByName(rest.filter("n is null or n = 1").select("_row.*")).unionByName(once)
