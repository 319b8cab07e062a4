"""Exact n-gram Jaccard join by R-trees of count vectors; its links' components are the near-duplicate classes.

1. Texts of equal shingle sets are one node, so copies never meet.
2. A set's shingles are hashed into groups (2 to 4 in each, DIMS groups at most); the groups' counts are its point. The
   summed minima of two points bound the overlap of their sets from above; those of two boxes' upper corners bound it for
   all points in the boxes.
3. An R-tree can't be kept in one place, so it is split where linked sets must meet: two sets of similarity t or more
   share one of the first (1 - t) n + 1 of their shingles, in any order that is the same for all. Shingles in over HEAVY
   of the documents come last in it. The nodes of a shingle, ordered by size and cut where sizes leave a gap that no link
   can cross, are a bucket. Buckets of equal nodes are one.
4. A bucket of up to BLOCK nodes is one R-tree, joined with itself level by level; pairs that its bounds let through are
   compared by their sets, which alone makes links.
5. Larger buckets are merged where they hold the same class, and dealt into blocks. Of each block's tree only a spanning
   forest of the pairs with the widest bounds is compared; nodes without a pair in a bucket of one block are done. What
   that links is one component, of which one node goes on to the next turn's blocks, until turns join few. Then every
   node outside a bucket's largest component is searched for in trees of all the bucket's nodes of a size that fits, to
   find the nodes that may have links with another component at all. These are searched again, with points of 65,536
   groups as a second bound: at first one pair for each node and component is compared, then, unless all of these are
   links, all that are left. So a large class costs about as many comparisons as it has nodes, a link that is passed over
   lies within a component, and components are exact. `links` leaves out the turns and gives every link.

Nothing is capped: a bucket's size only decides how its pairs are found. Shingles are compared by 64-bit hashes.

Defined cases: a text that is null or without words has n_shingles 0, and itself as its component; a text of fewer than
`k` words has one shingle; a null id counts as any other for links, and a component's id is its least id that is not
null; repeated rows are copies; a very long text is hashed in parts; an empty table has an empty result; extra columns
are ignored, and `representatives` keeps them whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.llm.common import bound_batches, columns_of, discard, fresh, materialize, slices, text_buffer
from cellarium.llm.components import connected_components
from cellarium.llm.textvec import BLANK, LOWER, hash_runs, mix, runs, windows

K, PERCENT = 5, 75
#: A shingle in more than this share of the documents is heavy; sets of s shingles on average have at most s / HEAVY such.
HEAVY = 0.002
#: Heavy shingles that are broadcast at most; the share is raised where there could be more.
MOST_HEAVY = 1 << 20
#: Nodes in a small bucket or a block; leaves of a tree's node; groups of a point; parts of a heavy shingle's bucket.
BLOCK, LEAF, DIMS, SALTS = 64, 16, 2048, 64
#: A turn's blocks hold so many times as many nodes.
TURN_BLOCKS = 8
#: Shingles of a set at most whose groups, of 65,536, are listed where many points of one bucket meet.
FINE = 4096
#: Keys that a task gathers before it counts them, nodes that it remembers, and cells of points that it compares at once.
GATHER, SEEN, CELLS = 1 << 21, 100_000, 1 << 21
#: Rows that are asked for by a broadcast of their hashes; more are joined.
ASKED_ROWS = 1 << 20


def shingle_sets(arr: pa.Array, k: int = K) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles."""
    raw, offsets = text_buffer(arr)
    buf = LOWER[raw]
    starts, ends, first = runs(~BLANK[buf], offsets)
    h = hash_runs(buf, starts, ends)
    w, at = windows(h, first, k)
    cut = np.searchsorted(at, first)
    out = []
    for i in range(len(offsets) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= k:
            out.append(np.unique(w[cut[i] : cut[i + 1]]))
        else:
            out.append(windows(h[a:b], np.array([0, b - a]), int(b - a))[0] if b > a else np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    return mix(s).sum(dtype=np.uint64).tobytes() + mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).tobytes()


def point(s: np.ndarray) -> np.ndarray:
    """Counts of the set's hash groups, 255 for 255 or more; there are a power of two of them, for 2 to 4 shingles each."""
    size = min(DIMS, 1 << max(3, int(len(s) - 1).bit_length() - 2))
    return np.minimum(np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size), 255).astype(np.uint8)


def packed(p: np.ndarray, n: int) -> bytes:
    """A point as bytes: two groups in each where there are few shingles to a group, 15 then stands for 15 or more."""
    if n > 4 * DIMS:
        return p.tobytes()
    small = np.minimum(p, 15)
    return (small[0::2] | small[1::2] << 4).tobytes()


def unpacked(raw: np.ndarray, n: int) -> np.ndarray:
    """The reverse, but for counts that were too great for half a byte: they are 255, any number."""
    if n > 4 * DIMS:
        return raw
    out = np.empty(2 * len(raw), np.uint8)
    out[0::2], out[1::2] = raw & 15, raw >> 4
    out[out == 15] = 255
    return out


def finest(s: np.ndarray) -> bytes:
    """The set's groups of 65,536, as numbers of 16 bits; nothing for more than FINE shingles."""
    return (s >> np.uint64(48)).astype(np.uint16).tobytes() if len(s) <= FINE else b""


def fold(p: np.ndarray, size: int) -> np.ndarray:
    """The point of the same set in fewer groups, without the bound of a byte: 255 stands for any number."""
    wide = np.where(p == 255, 1 << 20, p.astype(np.int32))
    return wide if len(p) == size else wide.reshape(-1, size).sum(0, dtype=np.int32)


def linked(n: int, m: int, overlap: int, percent: int = PERCENT) -> bool:
    return 100 * overlap >= percent * (n + m - overlap)


class RTree:
    """Points of one dimension count, packed by set size into boxes of LEAF; boxes keep their upper corner and sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, leaf: int = LEAF):
        self.order = np.lexsort((points.argmax(1), sizes)) if len(sizes) > leaf else np.arange(len(sizes))
        self.leaf = leaf
        top = points[self.order]
        low = high = sizes[self.order]
        self.levels = [(top, low, high)]
        while len(top) > leaf:
            cut = np.arange(0, len(top), leaf)
            top, low, high = np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            self.levels.append((top, low, high))

    def _children(self, at: np.ndarray, level: int) -> np.ndarray:
        """For each box of `at`, its children in the level below, -1 where it has fewer."""
        out = at[:, None] * self.leaf + np.arange(self.leaf)
        return np.where(out < len(self.levels[level - 1][0]), out, -1)

    def join(self, other: RTree | None = None, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, bound on the overlap) of points of this tree and the other that may be linked; without another, each pair of this one once."""
        own, other = other is None, other or self
        x, y = len(self.levels) - 1, len(other.levels) - 1
        i, j = (v.ravel() for v in np.meshgrid(np.arange(len(self.levels[x][0])), np.arange(len(other.levels[y][0])), indexing="ij"))
        while True:
            if own:
                keep = i <= j if x else i < j
                i, j = i[keep], j[keep]
            i, j, most = self._near(x, i, other, y, j, percent)
            if x == 0 and y == 0:
                return self.order[i], other.order[j], most
            # both trees go down a level, or the one that has more
            down = (x >= y, y >= x)
            a = self._children(i, x) if down[0] else i[:, None]
            b = other._children(j, y) if down[1] else j[:, None]
            i, j = (v.ravel() for v in np.broadcast_arrays(a[:, :, None], b[:, None, :]))
            x, y = x - down[0], y - down[1]
            real = (i >= 0) & (j >= 0)
            i, j = i[real], j[real]

    def _near(self, x: int, i: np.ndarray, other: RTree, y: int, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of boxes (or points) i and j, those whose bounds let a link through, with the bound on the overlap."""
        (p, low, high), (q, floor, ceiling) = self.levels[x], other.levels[y]
        fits = (100 * high[i] >= percent * floor[j]) & (100 * ceiling[j] >= percent * low[i])
        i, j = i[fits], j[fits]
        most = np.minimum(high[i], ceiling[j])
        step = max(1, CELLS // p.shape[1])
        for a in range(0, len(i), step):
            s = slice(a, a + step)
            most[s] = np.minimum(most[s], np.minimum(p[i[s]], q[j[s]]).sum(1, dtype=np.int64))
        near = (100 + percent) * most >= percent * (low[i] + floor[j])
        return i[near], j[near], most[near]


def _by_groups(points: list[np.ndarray]) -> dict[int, np.ndarray]:
    dims = np.array([len(p) for p in points])
    return {d: np.flatnonzero(dims == d) for d in np.unique(dims).tolist()}


def _tree(points: list[np.ndarray], n: np.ndarray, some: np.ndarray, size: int) -> RTree:
    if len(points[some[0]]) == size:
        return RTree(_counts(np.array([points[i] for i in some])), n[some])
    return RTree(np.array([fold(points[i], size) for i in some]), n[some])


def near_pairs(points: list[np.ndarray], n: np.ndarray, percent: int = PERCENT, others: tuple[list[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, bound on the overlap) of the sets with these points and sizes that may be linked with others; without others, each pair of these once.

    There is a tree for each number of groups; points are folded to meet those of fewer groups.
    """
    mine = _by_groups(points)
    theirs, m, into = (mine, n, points) if others is None else (_by_groups(others[0]), others[1], others[0])
    out = [(np.zeros(0, np.int64),) * 3]
    for d, a in mine.items():
        for e, b in theirs.items():
            low, high = max(n[a].min(), m[b].min()), min(n[a].max(), m[b].max())
            if 100 * high < percent * low or (others is None and d > e):
                continue
            size = min(d, e)
            if others is None and d == e:
                i, j, most = _tree(points, n, a, size).join(percent=percent)
            else:
                i, j, most = _tree(points, n, a, size).join(_tree(into, m, b, size), percent)
            out.append((a[i], b[j], most))
    return tuple(np.concatenate(v) for v in zip(*out))


def _counts(flat: np.ndarray) -> np.ndarray:
    return np.where(flat == 255, 1 << 20, flat.astype(np.int32)) if (flat == 255).any() else flat


def spanning_forest(i: np.ndarray, j: np.ndarray, most: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Indices of pairs that connect all that the pairs connect, those of the greatest bound on similarity first."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    kept = []
    for at in np.argsort(-(most / (total - most)), kind="stable").tolist():
        a, b = find(int(i[at])), find(int(j[at]))
        if a != b:
            parent[a] = b
            kept.append(at)
    return np.array(kept, np.int64)


# --- tasks ---


def _fixed(rows: np.ndarray) -> pa.Array:
    """A binary array of the 16-byte rows of an (n, 2) array of numbers."""
    n = len(rows)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * 16).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _numbers(arr: pa.Array) -> np.ndarray:
    """The reverse: (n, 2) numbers of n binary values of 16 bytes."""
    return text_buffer(arr)[0].view(np.uint64).reshape(-1, 2) if len(arr) else np.zeros((0, 2), np.uint64)


def _profiler(share: float, k: int):
    """One row for each text, and rows (without sig) of the shingles that may be heavy with the number of texts that hold them."""

    def counted(sets: list[np.ndarray], texts: int) -> pa.RecordBatch:
        key, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
        many = n >= max(2, share * texts / 2)
        lists = [pa.array([v.tolist()], pa.list_(pa.int64())) for v in (key[many].view(np.int64), n[many].astype(np.int64))]
        return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([0], pa.int32()), pa.nulls(1, pa.binary()), *lists], names)

    names = ["doc_id", "row", "n", "sig", "keys", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts, size = [], 0, 0
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), k)
                none = pa.nulls(len(sets), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array([len(s) for s in sets], pa.int32()), pa.array([signature(s) for s in sets], pa.binary()), none, none], names)
                held += sets
                texts, size = texts + len(sets), size + sum(map(len, sets))
                if size > GATHER:
                    yield counted(held, texts)
                    held, texts, size = [], 0, 0
        if held:
            yield counted(held, texts)

    return run


def prefix(s: np.ndarray, known: np.ndarray, rank: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, int]:
    """The first shingles of a set, rarer ones first, and how many of them (at the end) are heavy. known: heavy shingles in order of hash, rank: their order."""
    if not len(s):
        return s, 0
    take, plain = len(s) - -(-percent * len(s) // 100) + 1, len(s)
    if len(known):
        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
        heavy = known[at] == s
        if heavy.any():
            plain -= int(heavy.sum())
            s = np.concatenate([s[~heavy], s[heavy][np.argsort(rank[at[heavy]], kind="stable")]])
    return s[:take], max(0, take - plain)


def _placer(bc, k: int, percent: int):
    """A row for each node that the task hasn't seen yet: its prefix and its point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = bc.value
        rank = np.argsort(heavy)
        known = heavy[rank]
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                new = {}
                for s in shingle_sets(part.column("text"), k):
                    if len(s) and (sig := signature(s)) not in seen:
                        new[sig] = s
                        seen.add(sig)
                if len(seen) > SEEN:  # a node may come again; equal ones are joined later
                    seen.clear()
                heads = [prefix(s, known, rank, percent) for s in new.values()]
                ends = np.cumsum([0, *(len(h) for h, _ in heads)]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in heads)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(list(new), pa.binary()), pa.array([len(s) for s in new.values()], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                    pa.array([h for _, h in heads], pa.int32()), pa.array([packed(point(s), len(s)) for s in new.values()], pa.binary()),
                ], ["sig", "n", "prefix", "n_heavy", "point"])

    return run


def _buckets(percent: int, block: int):
    """Rows (key, tag, sig) in order of key and tag -> buckets of two or more nodes. Those of over `block` nodes and a heavy shingle's are big and come in parts.

    tag: part of a heavy shingle's bucket (from 1; else 0) << 32 | n. h1, h2: a hash of all nodes; the key of a big one and 0.
    """

    def rows_of(big: bool, h1: np.ndarray, h2: np.ndarray, size: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
        ends = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(size), big)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.ListArray.from_arrays(ends, _fixed(sig))], ["big", "h1", "h2", "members"])

    def made(key: np.ndarray, tag: np.ndarray, sig: np.ndarray, hot: tuple[int, int] | None) -> Iterator[pa.RecordBatch]:
        """hot: key and part of what is big whatever is left of it here."""
        part, n = tag >> 32, tag & 0xFFFFFFFF
        cut = np.ones(len(key), bool)
        cut[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1]) | ((part[1:] == 0) & (100 * n[:-1] < percent * n[1:]))
        group = np.cumsum(cut) - 1
        turn = np.lexsort((sig[:, 1], sig[:, 0], group))
        group, sig = group[turn], sig[turn]
        new = np.ones(len(group), bool)  # a node may come from several tasks
        new[1:] = (group[1:] != group[:-1]) | (sig[1:] != sig[:-1]).any(1)
        group, sig = group[new], sig[new]
        size, key, part = np.bincount(group), key[cut], part[cut]
        big = (part > 0) | (size > block)
        if hot is not None:
            big |= (key == hot[0]) & (part == hot[1])
        small = ~big & (size > 1)
        if small.any():
            rows = np.repeat(small, size)
            at = np.concatenate([[0], np.cumsum(size[small])[:-1]])
            one = mix(sig[rows, 0] ^ mix(sig[rows, 1]))
            yield rows_of(False, np.add.reduceat(one, at), np.add.reduceat(mix(one ^ np.uint64(0x5DEECE66D)), at), size[small], sig[rows])
        if big.any():
            yield rows_of(True, key[big].view(np.uint64), np.zeros(int(big.sum()), np.uint64), size[big], sig[np.repeat(big, size)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hot = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = (batch.column("key").to_numpy(), batch.column("tag").to_numpy(), _numbers(batch.column("sig")))
            key, tag, sig = now = now if held is None else tuple(np.concatenate(v) for v in zip(held, now))
            begins = np.flatnonzero((key[1:] != key[:-1]) | (tag[1:] >> 32 != tag[:-1] >> 32))
            last = int(begins[-1]) + 1 if len(begins) else 0
            if last:
                yield from made(key[:last], tag[:last], sig[:last], hot)
            held = tuple(v[last:] for v in now)
            if len(held[0]) > GATHER >> 6:  # of one key, and the rest of it is to come
                hot = (int(held[0][0]), int(held[1][0]) >> 32)
                yield from made(*held, hot)
                held = None
        if held is not None:
            yield from made(*held, hot)

    return run


def _pairs_of(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Pairs (a, b) of nodes, the lesser first."""
    swap = (a[:, 0] > b[:, 0]) | ((a[:, 0] == b[:, 0]) & (a[:, 1] > b[:, 1]))
    return pa.RecordBatch.from_arrays([_fixed(np.where(swap[:, None], b, a)), _fixed(np.where(swap[:, None], a, b))], ["a", "b"])


def _values(arr: pa.Array) -> list[np.ndarray]:
    raw, offsets = text_buffer(arr)
    return [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def _points(rows: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
    return [unpacked(p, n) for p, n in zip(_values(rows.column("point")), rows.column("n").to_pylist())]


def _searched(percent: int, forest: bool):
    """Rows of one bucket or block (h1, h2) stand together; its pairs come from its trees. forest: only those that connect all others."""

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        h = np.stack([table.column(c).to_numpy() for c in ("h1", "h2")], 1)
        starts = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]).any(1)])).tolist()
        n, sig, points = table.column("n").to_numpy().astype(np.int64), _numbers(table.column("sig").combine_chunks()), _points(table)
        left, right = [], []
        for a, b in zip(starts, [*starts[1:], len(n)]):
            i, j, most = near_pairs(points[a:b], n[a:b], percent)
            if forest:
                kept = spanning_forest(i, j, most, n[a:b][i] + n[a:b][j])
                i, j = i[kept], j[kept]
            left.append(a + i)
            right.append(a + j)
        yield _pairs_of(sig[np.concatenate(left)], sig[np.concatenate(right)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2 = (batch.column(c).to_numpy() for c in ("h1", "h2"))
            begins = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
            last = int(begins[-1]) + 1 if len(begins) else 0
            if held and (held[-1].column("h1")[-1].as_py(), held[-1].column("h2")[-1].as_py()) != (int(h1[0]), int(h2[0])) or last:
                whole = [*held, batch.slice(0, last)]
                if sum(x.num_rows for x in whole):
                    yield from pairs(pa.Table.from_batches(whole))
                held = []
            held.append(batch.slice(last))
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return run


def _fine_near(i: np.ndarray, j: np.ndarray, mine: tuple, held: tuple, percent: int) -> np.ndarray:
    """Which pairs (i, j), in order of i, may be linked for all that their finest points tell. mine, held: (n, finest points)."""
    keep = np.ones(len(i), bool)
    if not len(i):
        return keep
    sizes = np.array([len(f) for f in held[1]], np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(i)]):
        own, n = mine[1][i[a]], int(mine[0][i[a]])
        some = a + np.flatnonzero(sizes[j[a:b]] > 0)
        if not len(own) or not len(some):
            continue
        has = np.zeros(1 << 16, bool)
        has[own] = True
        hits = has[np.concatenate([held[1][k] for k in j[some].tolist()])]
        most = np.add.reduceat(hits, np.concatenate([[0], np.cumsum(sizes[j[some]])[:-1]]), dtype=np.int64)
        keep[some] = (100 + percent) * np.minimum(most, n) >= percent * (n + held[0][j[some]])
    return keep


def _probed(percent: int, one: bool, nodes: bool = False):
    """Rows of one block (key, kind, block) stand together, its own nodes (side 0) before others (side 1): pairs of different components, of its nodes and of the others with them.

    one: of a node's pairs with one component only that of the widest bound. nodes: the nodes (key, sig) of the pairs, each once for a part of a block.
    """

    def told(key: int, mine: tuple, held: tuple | None) -> Iterator[pa.RecordBatch]:
        sig, comp, n, points, fine = mine
        into = mine if held is None else held
        i, j, most = near_pairs(points, n, percent, None if held is None else (held[3], held[2]))
        other = np.flatnonzero((comp[i] != into[1][j]).any(1))
        other = other[np.argsort(i[other], kind="stable")]
        i, j, most = i[other], j[other], most[other]
        if nodes:
            some = np.concatenate([sig[np.unique(i)], into[0][np.unique(j)]])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), key, np.int64)), _fixed(some)], ["key", "sig"])
            return
        good = _fine_near(i, j, (n, fine), (into[2], into[4]), percent)
        i, j, most = i[good], j[good], most[good]
        if one:
            to = into[1][j]
            best = np.lexsort((-most / (n[i] + into[2][j] - most), to[:, 1], to[:, 0], i))
            x = np.column_stack([i[best].astype(np.uint64), to[best]])
            best = best[np.concatenate([[True], (x[1:] != x[:-1]).any(1)])[: len(best)]]
            i, j = i[best], j[best]
        yield _pairs_of(sig[i], into[0][j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, joined = None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "kind", "block", "side")], 1)
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])).tolist()
            for a, b in zip(starts, [*starts[1:], len(keys)]):
                rows = batch.slice(a, b - a)
                fine = [f.view(np.uint16) for f in _values(rows.column("fine"))]
                now = (_numbers(rows.column("sig")), _numbers(rows.column("comp")), rows.column("n").to_numpy().astype(np.int64), _points(rows), fine)
                if tuple(keys[a, :3]) != key:
                    if held is not None and not joined:
                        yield from told(key[0], held, None)
                    key, held, joined = tuple(keys[a, :3].tolist()), None, False
                if keys[a, 3] == 0:
                    held = now if held is None else (*(np.concatenate(v) for v in zip(held[:3], now[:3])), held[3] + now[3], held[4] + now[4])
                    continue
                if held is not None and not joined:
                    yield from told(key[0], held, None)
                    joined = True
                for at in range(0, b - a if held is not None else 0, 512):
                    yield from told(key[0], tuple(v[at : at + 512] for v in now), held)
        if held is not None and not joined:
            yield from told(key[0], held, None)

    return run


def _sets_of(k: int, of=lambda s: s.tobytes()):
    """(sig, members) of each text's set, as bytes that `of` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                rows = {sig: of(s) for s in shingle_sets(part.column("text"), k) if (sig := signature(s)) not in seen}
                seen = set(rows) | (seen if len(seen) < SEEN else set())
                yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.binary()), pa.array(list(rows.values()), pa.binary())], ["sig", "members"])

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate([s, t])
                both.sort()
                good.append(linked(len(s), len(t), int((both[1:] == both[:-1]).sum()), percent))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


# --- the join ---


class _Join:
    """State of one join: nodes, their buckets and the links found."""

    def __init__(self, docs: DataFrame, percent: int, k: int, heavy_share: float, block: int):
        spark = docs.sparkSession
        bound_batches(spark)
        self.docs, self.percent, self.k, self.block = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")), percent, k, block
        told = materialize(self.docs.withColumn("row", F.col("th")).mapInArrow(_profiler(heavy_share, k), "doc_id long, row long, n int, sig binary, keys array<long>, counts array<long>"), "profiles")
        self.profiles = told.where("sig is not null").select("doc_id", F.col("row").alias("th"), "n", "sig")
        heavy = spark.sparkContext.broadcast(self._heavy(told, heavy_share))
        self.nodes = materialize(self.docs.select("text").mapInArrow(_placer(heavy, k, percent), "sig binary, n int, prefix array<long>, n_heavy int, point binary"), "nodes")
        heavy.destroy()
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th"))
        self.reps = materialize(self.profiles.where("n > 0").groupBy("sig").agg(first.alias("x")).select("sig", "x.doc_id", "x.th"), "representatives")
        part = F.when(F.col("pos") >= F.size("prefix") - F.col("n_heavy"), F.pmod(F.xxhash64("sig"), F.lit(SALTS)) + 1).otherwise(0)
        keys = self.nodes.select("sig", "n", "n_heavy", "prefix", F.posexplode("prefix").alias("pos", "key")).select("key", F.shiftleft(part.cast("long"), 32).bitwiseOR(F.col("n").cast("long")).alias("tag"), "sig")
        dealt = keys.repartition("key", F.shiftright("tag", 32)).sortWithinPartitions("key", "tag")
        self.buckets = materialize(dealt.mapInArrow(_buckets(percent, block), "big boolean, h1 long, h2 long, members array<binary>"), "buckets")
        self.points = self.nodes.select("sig", "n", "point").dropDuplicates(["sig"])
        self.hot = self._merged(materialize(self.buckets.where("big").select(F.col("h1").alias("key"), F.explode("members").alias("sig")).distinct(), "big"))
        self.links = spark.createDataFrame([], "a binary, b binary")
        self.tested = self.links

    def _merged(self, big: DataFrame) -> DataFrame:
        """Big buckets (key, sig), those of one class as one: a long text shares very many buckets with its like.

        A key's group is the least key that any of its nodes has. Where a group has no more pairs than its buckets have
        together, it stands for them all; any pair that shares a bucket is in it.
        """
        least = big.groupBy("sig").agg(F.min("key").alias("_least"))
        keys = materialize(big.join(least, "sig").groupBy("key").agg(F.min("_least").alias("_group"), F.count(F.lit(1)).alias("_m")), "groups")
        named = big.join(keys, "key").select("key", "sig", "_group")
        pairs = keys.groupBy("_group").agg(F.sum(F.col("_m") * F.col("_m")).alias("_p"))
        nodes = named.groupBy("_group", "sig").agg(F.lit(1)).groupBy("_group").agg(F.count(F.lit(1)).alias("_f"))
        good = pairs.join(nodes, "_group").where("_f * _f <= _p").select("_group", F.lit(True).alias("_good"))
        keyed = named.join(good, "_group", "left").select(F.when(F.col("_good"), F.col("_group")).otherwise(F.col("key")).alias("key"), "sig")
        return materialize(keyed.distinct(), "hot")

    def _heavy(self, told: DataFrame, share: float) -> np.ndarray:
        """Hashes of shingles in over `share` of the documents, rarer ones first: MOST_HEAVY at most, as each takes its part of all shingles."""
        rows, total = self.profiles.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        least = max(8, int(share * rows), total // MOST_HEAVY + 1)
        pairs = told.where("sig is null").select(F.explode(F.arrays_zip("keys", "counts")).alias("x"))
        often = pairs.groupBy(F.col("x.keys").alias("key")).agg(F.sum("x.counts").alias("n")).where(F.col("n") >= least).toPandas()
        return often.sort_values(["n", "key"])["key"].to_numpy(np.int64).view(np.uint64)

    def verify(self, pairs: DataFrame, name: str) -> int:
        """Test pairs (a, b) that haven't been tested, keep the links, and return their number."""
        pairs = materialize(pairs.distinct(), f"pairs-{name}")
        close = materialize(pairs.join(self.tested, ["a", "b"], "left_anti"), f"close-{name}")
        self.tested, self.last_asked = self.tested.unionByName(close), pairs.count()
        sets = self._sets(close.select(F.explode(F.array("a", "b")).alias("sig")), name, lambda s: s.tobytes())
        if sets is None:
            return 0
        one = sets.dropDuplicates(["sig"])
        both = close.join(one.select(F.col("sig").alias("a"), F.col("members").alias("x")), "a").join(one.select(F.col("sig").alias("b"), F.col("members").alias("y")), "b")
        links = materialize(both.mapInArrow(_verified(self.percent), "a binary, b binary"), f"links-{name}")
        discard(sets)
        self.links = self.links.unionByName(links)
        return links.count()

    def _sets(self, sigs: DataFrame, name: str, of) -> DataFrame | None:
        """(sig, members) of the asked nodes, as `of` gives them, from the text of one row of each; None if none are asked for."""
        rows = materialize(sigs.distinct().join(self.reps, "sig").select(F.xxhash64("doc_id", "th").alias("row")), f"asked-{name}")
        if not (count := rows.count()):
            return None
        texts = self.docs.withColumn("row", F.xxhash64("doc_id", "th")).join(F.broadcast(rows) if count <= ASKED_ROWS else rows, "row", "left_semi").select("text")
        return materialize(texts.mapInArrow(_sets_of(self.k, of), "sig binary, members binary"), f"sets-{name}")

    def small(self) -> DataFrame:
        """Pairs from the trees of all small buckets."""
        lists = self.buckets.where("not big").groupBy("h1", "h2").agg(F.first("members").alias("members"))
        rows = lists.select("h1", "h2", F.explode("members").alias("sig")).join(self.points, "sig")
        return rows.repartition("h1", "h2").sortWithinPartitions("h1", "h2").select("h1", "h2", "sig", "n", "point").mapInArrow(_searched(self.percent, False), "a binary, b binary")

    def components(self) -> DataFrame:
        return materialize(connected_components(self.links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "components")

    def open(self, components: DataFrame | None) -> DataFrame:
        """(key, sig, comp) of big buckets."""
        if components is None:
            return self.hot.withColumn("comp", F.col("sig"))
        return self.hot.join(components.withColumnRenamed("node", "sig"), "sig", "left").select("key", "sig", F.coalesce("component", "sig").alias("comp"))

    def _blocks(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / (TURN_BLOCKS * self.block)).alias("_k"), F.count(F.lit(1)).alias("_c"))

    def turn(self, now: DataFrame, number: int) -> DataFrame:
        """Pairs from trees of blocks of big buckets, with one node of each component."""
        each = now.groupBy("key", "comp").agg(F.min("sig").alias("sig"))
        blocks = self._blocks(each).where("_c > 1").select(F.col("key").alias("h1"), "_k")
        dealt = each.join(blocks, F.col("key") == F.col("h1")).select("h1", F.pmod(F.xxhash64("sig", F.lit(number)), "_k").alias("h2"), "sig")
        rows = dealt.join(self.points, "sig").repartition("h1", "h2").sortWithinPartitions("h1", "h2").select("h1", "h2", "sig", "n", "point")
        return rows.mapInArrow(_searched(self.percent, True), "a binary, b binary")

    def rest(self, now: DataFrame, found, more: DataFrame | None = None) -> DataFrame:
        """What the task `found` makes of blocks of big buckets that hold several components: nodes outside the largest one, searched for among all of a size that fits.

        more: (sig, members) with finest points.
        """
        sizes = now.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("_c")).groupBy("key").agg(F.max_by("comp", F.struct("_c", "comp")).alias("_most"), F.count(F.lit(1)).alias("_kinds")).where("_kinds > 1")
        kind = lambda n: F.floor(F.log(n) / F.log(F.lit(16.0)))
        left = now.join(sizes, "key").select("key", "sig", "comp", (F.col("comp") != F.col("_most")).alias("asks")).join(self.points, "sig")
        left = left.withColumn("fine", F.lit(None).cast("binary")) if more is None else left.join(more.dropDuplicates(["sig"]).withColumnRenamed("members", "fine"), "sig")
        rows = materialize(left.withColumn("kind", kind(F.col("n").cast("double"))), "open")
        blocks = rows.groupBy("key", "kind").agg(F.ceil(F.count(F.lit(1)) / 512).alias("_k"))
        cols = ("key", "kind", "block", "side", "sig", "comp", "n", "point", "fine")
        own = F.pmod(F.xxhash64("sig"), "_k")
        held = rows.join(blocks, ["key", "kind"]).withColumns({"block": own, "side": F.lit(0)}).select(*cols)
        # to the other blocks of all kinds that hold sizes that can be linked, and a little more
        near = rows.where("asks").withColumn("_own", F.col("kind")).withColumn("kind", F.explode(F.sequence(kind(F.col("n") * self.percent / 101.0), kind(F.col("n") * 101.0 / self.percent))))
        asking = near.join(blocks, ["key", "kind"]).withColumns({"block": F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)), "side": F.lit(1)})
        asking = asking.where((F.col("kind") != F.col("_own")) | (F.col("block") != own)).select(*cols)
        return found(held.unionByName(asking).repartition("key", "kind", "block").sortWithinPartitions("key", "kind", "block", "side"))

    def may_link(self, now: DataFrame) -> DataFrame:
        """(key, sig) of the nodes that may be linked with one of another component in a big bucket, for all that points tell."""
        return materialize(self.rest(now, lambda rows: rows.mapInArrow(_probed(self.percent, False, nodes=True), "key long, sig binary")).distinct(), "may")

    def pairs_left(self, now: DataFrame, one: bool) -> DataFrame | None:
        """Pairs of different components among these nodes of big buckets, with finest points as a second bound; None if there are no nodes."""
        fine = self._sets(now.select("sig"), "finest", finest)
        return fine and self.rest(now, lambda rows: rows.mapInArrow(_probed(self.percent, one), "a binary, b binary"), fine)

    def run(self, every_link: bool) -> None:
        if self.hot.isEmpty():
            self.verify(self.small(), "trees")
            return
        if every_link:
            now = self.open(None)
            pairs = self.pairs_left(now.join(self.may_link(now), ["key", "sig"], "left_semi"), False)
            self.verify(self.small().unionByName(pairs) if pairs else self.small(), "trees")
            return
        before, number = self.hot.count(), 0
        first = materialize(self.turn(self.open(None), 0).distinct(), "first")
        self.verify(self.small().unionByName(first), "trees")
        # where a bucket was one block, a node that is in none of its pairs has no link there
        paired = first.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
        several = self._blocks(self.hot).where("_k > 1").select("key")
        self.hot = materialize(self.hot.join(paired, "sig", "left_semi").unionByName(self.hot.join(several, "key", "left_semi").select("sig", "key")).select("key", "sig").distinct(), "hot")
        # as long as a turn leaves three quarters at most, another one follows
        while 4 * (left := self._left(now := self.open(self.components()))) <= 3 * before and left:
            before, number = left, number + 1
            self.verify(self.turn(now, number), f"turn-{number}")
        if not left:
            return
        # what is left is searched whole: for one pair of each node with each component of a block
        may = self.may_link(now)
        pairs = self.pairs_left(now.join(may, ["key", "sig"], "left_semi"), True)
        if pairs is None or self.verify(pairs, "one") == self.last_asked:
            return  # all of them are links, so that each node is now of a component with all it may be linked with
        pairs = self.pairs_left(self.open(self.components()).join(may, ["key", "sig"], "left_semi"), False)
        if pairs is not None:
            self.verify(pairs, "rest")

    def _left(self, now: DataFrame) -> int:
        """Components in buckets that have several."""
        kinds = now.groupBy("key", "comp").agg(F.lit(1).alias("_x")).groupBy("key").count().where("count > 1")
        return kinds.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]


def _joined(docs: DataFrame, percent: int, k: int, heavy_share: float, block: int, every_link: bool = False) -> _Join:
    join = _Join(docs, percent, k, heavy_share, block)
    join.run(every_link)
    return join


def near_duplicates(docs: DataFrame, percent: int = PERCENT, k: int = K, heavy_share: float = HEAVY, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text)."""
    join = _joined(docs, percent, k, heavy_share, block)
    named = join.reps.select("sig", "doc_id").join(join.components().withColumnRenamed("node", "sig"), "sig", "left").select("sig", "doc_id", F.coalesce("component", "sig").alias("component"))
    ids = named.join(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select("sig", "component_id")
    return join.profiles.select("doc_id", "n", F.when(F.col("n") > 0, F.col("sig")).alias("sig")).join(ids, "sig", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def representatives(docs: DataFrame, percent: int = PERCENT, k: int = K, heavy_share: float = HEAVY, block: int = BLOCK) -> DataFrame:
    """The row of each component with the least id (of equal ids the least text hash; one of equal rows), and all rows without words."""
    join = _joined(docs, percent, k, heavy_share, block)
    named = join.reps.join(join.components().withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    first = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th")).alias("x"))
    # one key for the join and for repeated rows, so that texts are dealt once
    key = lambda i, t: F.concat_ws(":", i.cast("string"), t.cast("string"))
    name = fresh(docs, "_key")
    keyed = docs.withColumn(name, key(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit("")))))
    words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = keyed.where(words).join(first.select(key(F.col("x.doc_id"), F.col("x.th")).alias(name)), name, "left_semi").dropDuplicates([name])
    return kept.select(*columns_of(docs)).unionByName(docs.where(~words))


def links(docs: DataFrame, percent: int = PERCENT, k: int = K, heavy_share: float = HEAVY, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """All links, exactly: (a_id, b_id) of texts with different shingle sets, one id for each set and each pair once, and (doc_id, n_links) for each row.

    A row's n_links are the other rows it is linked to, copies included; one without words has none.
    """
    join = _joined(docs, percent, k, heavy_share, block, every_link=True)
    copies = join.profiles.where("n > 0").groupBy("sig").agg(F.count(F.lit(1)).alias("_k"))
    nodes = join.reps.select("sig", "doc_id").join(copies, "sig")
    a, b = (nodes.select(F.col("sig").alias(x), F.col("doc_id").alias(f"{x}_id")) for x in "ab")
    both = join.links.unionByName(join.links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(nodes.select(F.col("sig").alias("b"), "_k"), "b").groupBy("a").agg(F.sum("_k").alias("_o"))
    each = nodes.join(others.withColumnRenamed("a", "sig"), "sig", "left").select("sig", (F.coalesce("_o", F.lit(0)) + F.col("_k") - 1).alias("n_links"))
    rows = join.profiles.select("doc_id", F.when(F.col("n") > 0, F.col("sig")).alias("sig"))
    return join.links.join(a, "a").join(b, "b").select("a_id", "b_id"), rows.join(each, "sig", "left").select("doc_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sql() -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({low}, '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {K} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {K} + 2), lambda i: array_to_string(w[i : i + {K} - 1], ' '))) END AS s FROM w),
u AS MATERIALIZED (SELECT rid, unnest(s) AS x FROM h),
c AS (SELECT a.rid AS p, b.rid AS q, count(*) AS k FROM u a JOIN u b ON a.x = b.x AND a.rid < b.rid GROUP BY ALL),
l AS MATERIALIZED (SELECT p, q FROM c JOIN h a ON a.rid = p JOIN h b ON b.rid = q WHERE 100 * k >= {PERCENT} * (len(a.s) + len(b.s) - k)),
e AS MATERIALIZED (SELECT p, q FROM l UNION ALL SELECT q, p FROM l),
r(a, b) AS (SELECT rid, rid FROM h UNION SELECT r.a, e.q FROM r JOIN e ON e.p = r.b)
SELECT h.doc_id AS doc_id, CAST(len(h.s) AS BIGINT) AS n_shingles, coalesce(m.least, h.doc_id) AS component_id
FROM h JOIN (SELECT a, min(doc_id) AS least FROM r JOIN h o ON o.rid = r.b GROUP BY a) m ON m.a = h.rid"""
