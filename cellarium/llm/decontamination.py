"""Benchmark decontamination as a prefix-filtered set join of item windows with whole documents.

A window is `size` consecutive words of an item (all of them if there are fewer), and its set are its five-word shingles
(fewer words: one shingle). Shingles are ordered by how often they occur in all documents. Containment has to be exact,
so the prefix that must be met is the one rarest shingle; documents are probed for prefixes only. A meeting gives the
place where the window would start: the document's bounds (length and position), the window's own hash, and then its
words themselves are compared there.

The benchmark goes to the executors in blocks of at most BLOCK_BYTES of text, one pass over the documents each.

Defined cases: null texts have no words; an item without words has no window; a null item_id counts as the id ''; rows
of equal item_id are one item; repeated documents are judged one by one; an empty benchmark hits nothing; extra columns
of the documents stay, and those named as this operator's own are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.llm.common import bound_batches, materialize, slices, text_buffer
from cellarium.llm.textvec import ALNUM, LOWER, SpanHash, runs, windows

WINDOW, SHINGLE = 10, 5
BLOCK_BYTES = 4 << 20
OWN = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_FILTER_BITS = 20


@dataclass
class Block:
    """Windows of some items. Window w: words[w], items[w] (sorted ids), its hash and those of its shingles."""

    words: list[list[bytes]]
    items: list[list[str]]
    lengths: np.ndarray
    hashes: np.ndarray
    shingles: dict[int, np.ndarray]  # by shingle size, of all windows, sorted
    of_window: list[tuple[int, np.ndarray]]
    prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None  # by size: hashes sorted, window, offset


def _hashes(words: list[bytes]) -> np.ndarray:
    buf = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    return SpanHash(buf)(starts.astype(np.int64), ends.astype(np.int64))


def build_block(rows: list[tuple[str, str]], window: int = WINDOW, shingle: int = SHINGLE) -> Block:
    found: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in rows:
        words = _WORD.findall(LOWER[np.frombuffer(text.encode(), np.uint8)].tobytes())
        for i in range(max(1, len(words) - window + 1) if words else 0):
            found.setdefault(tuple(words[i : i + window]), set()).add(item)
    words = [list(w) for w in found]
    hashes, of_window, shingles = [], [], {}
    for w in words:
        h, n = _hashes(w), len(w)
        size = min(shingle, n)
        hashes.append(windows(h, np.array([0, n]), n)[0][0])
        of_window.append((size, windows(h, np.array([0, n]), size)[0]))
        shingles.setdefault(size, []).append(of_window[-1][1])
    return Block(words, [sorted(s) for s in found.values()], np.array([len(w) for w in words], np.int64), np.array(hashes, np.uint64), {k: np.unique(np.concatenate(v)) for k, v in shingles.items()}, of_window)


def order_by_rarity(block: Block, counts: dict[tuple[int, int], int]) -> None:
    """Give each window its prefix: the shingle with the least count, ties by hash."""
    by_size: dict[int, list[tuple[int, int, int]]] = {}
    for w, (size, hs) in enumerate(block.of_window):
        _, h, at = min((counts.get((size, int(x)), 0), int(x), i) for i, x in enumerate(hs))
        by_size.setdefault(size, []).append((h, w, at))
    block.prefix = {}
    for size, got in by_size.items():
        got.sort()
        block.prefix[size] = (np.array([g[0] for g in got], np.uint64), np.array([g[1] for g in got], np.int64), np.array([g[2] for g in got], np.int64))


def _sieve(hashes: np.ndarray) -> np.ndarray:
    """One bit for each leading 20 bits of a hash: most misses end here."""
    out = np.zeros(1 << _FILTER_BITS, bool)
    out[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
    return out


class _Texts:
    """Words of a slice of documents."""

    def __init__(self, arr: pa.Array):
        raw, self.offsets = text_buffer(arr)
        self.buf = LOWER[raw]
        self.inside = ALNUM[self.buf]
        self.starts, self.ends, self.first = runs(self.inside, self.offsets)
        self.h = SpanHash(self.buf)(self.starts, self.ends)

    def meeting(self, size: int, wanted: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into wanted of the first equal, word index) of each shingle that is wanted."""
        hs, at = windows(self.h, self.first, size)
        some = np.flatnonzero(sieve[(hs >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        hs, at = hs[some], at[some]
        k = np.searchsorted(wanted, hs)
        same = wanted[np.minimum(k, len(wanted) - 1)] == hs
        return k[same], at[same]


def _counter(bc):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = bc.value
        sieves = {k: _sieve(v) for k, v in block.shingles.items()}
        sums = {k: np.zeros(len(v), np.int64) for k, v in block.shingles.items()}
        for batch in batches:
            for part in slices(batch, "text"):
                texts = _Texts(part.column("text"))
                for k, wanted in block.shingles.items():
                    sums[k] += np.bincount(texts.meeting(k, wanted, sieves[k])[0], minlength=len(wanted))
        for k, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"size": pa.array(np.full(len(at), k, np.int32)), "place": pa.array(at.astype(np.int64)), "n": pa.array(n[at])})

    return count


def _prober(bc, kept: list[str], state: bool, last: bool):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = bc.value
        sieves = {k: _sieve(v[0]) for k, v in block.prefix.items()}
        for batch in batches:
            for part in slices(batch, "text"):
                yield _probe(part, block, sieves, kept, state, last)

    return probe


def _probe(part: pa.RecordBatch, block: Block, sieves: dict, kept: list[str], state: bool, last: bool) -> pa.RecordBatch:
    texts = _Texts(part.column("text"))
    first, n = texts.first, part.num_rows
    where, which = [], []
    for size, (hashes, window, offset) in block.prefix.items():
        k, at = texts.meeting(size, hashes, sieves[size])
        if not len(k):
            continue
        # a prefix may belong to several windows, which stand together
        times = np.searchsorted(hashes, hashes[k], "right") - k
        each = np.repeat(np.arange(len(k)), times)
        k = k[each] + np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
        w, start = window[k], at[each] - offset[k]
        doc = np.searchsorted(first, at[each], "right") - 1
        fits = (start >= first[doc]) & (start + block.lengths[w] <= first[doc + 1])
        where.append(start[fits])
        which.append(w[fits])
    where = np.concatenate(where) if where else np.zeros(0, np.int64)
    which = np.concatenate(which) if which else np.zeros(0, np.int64)
    good = np.zeros(len(where), bool)
    spaced = np.where(texts.inside, texts.buf, 32).astype(np.uint8) if len(where) else None
    for size in np.unique(block.lengths[which]):
        mine = np.flatnonzero(block.lengths[which] == size)
        h, at = windows(texts.h, first, int(size))
        same = h[np.searchsorted(at, where[mine])] == block.hashes[which[mine]]
        for i in mine[same]:
            a = where[i]
            good[i] = spaced[texts.starts[a] : texts.ends[a + size - 1]].tobytes().split() == block.words[which[i]]
    where, which = where[good], which[good]
    doc = np.searchsorted(first, where, "right") - 1
    items: list[set[str]] = [set() for _ in range(n)]
    for d, w in set(zip(doc.tolist(), which.tolist())):
        items[d].update(block.items[w])
    edge = np.zeros(len(texts.h) + 1, np.int64)
    np.add.at(edge, where, 1)
    np.add.at(edge, where + block.lengths[which], -1)
    hit = np.cumsum(edge[:-1]) > 0
    if state:
        before, _ = text_buffer(part.column("_hit"))
        hit |= before.astype(bool)
        for d, own in enumerate(part.column("_items").to_pylist()):
            items[d].update(own or ())
    out = {c: part.column(c) for c in kept}
    if not last:
        flags = hit.astype(np.uint8).tobytes()
        out["_hit"] = pa.array([flags[a:b] for a, b in zip(first[:-1], first[1:])], pa.binary())
        out["_items"] = pa.array([sorted(s) for s in items], pa.list_(pa.string()))
        return pa.RecordBatch.from_pydict(out)
    total = np.concatenate([[0], np.cumsum(hit)])
    n_hit = total[first[1:]] - total[first[:-1]]
    out["n_words"] = pa.array(np.diff(first).astype(np.int64))
    out["n_hit"] = pa.array(n_hit.astype(np.int64))
    out["n_items"] = pa.array([len(s) for s in items], pa.int64())
    out["items_sha256"] = pa.array([hashlib.sha256(",".join(sorted(s)).encode()).hexdigest() for s in items], pa.string())
    out["contaminated"] = pa.array(n_hit > 0)
    return pa.RecordBatch.from_pydict(out)


def benchmark_blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """Items in runs of at most limit bytes, fetched one partition at a time; at least one run."""
    rows, size = [], 0
    for r in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.coalesce("text", F.lit("")).alias("t")).toLocalIterator():
        if rows and size + len(r.t) > limit:
            yield rows
            rows, size = [], 0
        rows.append((r.i, r.t))
        size += len(r.t)
    yield rows


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (text, ...) with n_words, n_hit, n_items, items_sha256 and contaminated."""
    spark = docs.sparkSession
    bound_batches(spark)
    kept = [c for c in docs.columns if c not in (*OWN, "_hit", "_items")]
    docs = docs.select(*(F.col(f"`{c}`") for c in kept))
    runs_of_items = benchmark_blocks(benchmark, block_bytes)
    rows, now, state = next(runs_of_items), docs, False
    while rows is not None:
        following = next(runs_of_items, None)
        block = build_block(rows, window, shingle)
        seen = spark.sparkContext.broadcast(block)
        places = docs.select("text").mapInArrow(_counter(seen), "size int, place long, n long").groupBy("size", "place").agg(F.sum("n").alias("n"))
        counts = {(r.size, int(block.shingles[r.size][r.place])): r.n for r in places.toLocalIterator()}  # as many as the block has shingles, at most
        order_by_rarity(block, counts)
        block.of_window, block.shingles = [], {}
        last = following is None
        extra = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean" if last else "_hit binary, _items array<string>"
        now = now.mapInArrow(_prober(spark.sparkContext.broadcast(block), kept, state, last), f"{docs._jdf.schema().toDDL()}, {extra}")
        now, state, rows = now if last else materialize(now, "decontamination"), True, following
    return now


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", *OWN)


def sql() -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
b AS (SELECT item_id, {words} AS w, least(10, len(w)) AS k FROM benchmark),
i AS MATERIALIZED (SELECT DISTINCT item_id, k, array_to_string(w[p : p + k - 1], ' ') AS x FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM b WHERE k > 0)),
a AS (SELECT rid, p, k, array_to_string(w[p : p + k - 1], ' ') AS x FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM i))),
m AS MATERIALIZED (SELECT a.rid AS rid, a.p AS p, a.k AS k, i.item_id AS item_id FROM a JOIN i ON i.k = a.k AND i.x = a.x),
h AS (SELECT rid, count(DISTINCT t) AS n_hit FROM (SELECT rid, unnest(range(p, p + k)) AS t FROM (SELECT DISTINCT rid, p, k FROM m)) GROUP BY rid),
o AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, coalesce(CAST(item_id AS VARCHAR), '') AS item FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN o USING (rid)"""
