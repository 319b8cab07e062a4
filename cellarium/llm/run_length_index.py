"""Exact repeats by a run-compressed Burrows-Wheeler index that is split where equal text must meet.

1. Every window of `size` bytes is owned by the least hashed GRAM-byte string in it (the leftmost of equals), its anchor.
   Equal windows have equal anchors at equal places. The windows that one anchor owns are consecutive, so together they
   are a fragment of the text; each window of a document is in exactly one of its fragments.
2. Fragments travel as two hashes: of the anchor, and of the fragment. Equal fragments are repeats as a whole. Of each
   different fragment whose anchor has others, one copy is cut from its text and sent to where its anchor is indexed.
3. There, fragments are indexed in blocks: suffixes are ordered, their Burrows-Wheeler transform is cut into runs, and
   the common lengths with the neighbours in that order are computed at the sampled run ends only. Streaming over the
   fragments gives all other matching statistics, each one less than that of the byte before. Statistics of `size` or
   more mark repeats.
4. Anchors with more than BIG different fragments (a passage with many surroundings) are not indexed in one place:
   hashes of their windows are counted across the cluster instead.

Defined cases: a null text is empty; texts under `size` bytes have no repeats; repeated rows are occurrences like any
other, and all are marked; an empty table has an empty result; a null id counts as any other; `mark` ignores extra
columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellarium.llm.common import bound_batches, materialize, slices, text_buffer
from cellarium.llm.textvec import SpanHash, mix

SIZE, GRAM = 200, 24
#: Bytes of a block, of which an index takes some 150 times as much memory; different fragments of one anchor that may share
#: a block. A fragment has under 2 * SIZE bytes, so that an anchor adds less than a megabyte and a half.
BLOCK_BYTES, BIG = 1 << 19, 4_000


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours, by doubling."""
    n, have = len(x) - width + 1, 1
    out = x
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[:n], out[width - have : width - have + n])


def fragments(buf: np.ndarray, offsets: np.ndarray, size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, anchor hash, fragment hash) of each fragment of the texts in buf."""
    none = np.zeros(0, np.int64)
    if len(buf) < size:
        return none, none, none, none, none
    spans = SpanHash(buf)
    at = np.arange(len(buf) - gram + 1)
    h = spans(at, at + gram)
    least = sliding_least((h >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64), size - gram + 1)
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(len(buf) + 1, np.int32)  # windows that lie within one text
    whole = np.flatnonzero(np.diff(offsets) >= size)
    inside[offsets[whole]] += 1
    inside[offsets[whole + 1] - size + 1] -= 1
    good = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    good = good[good < len(anchor)]
    if not len(good):
        return none, none, none, none, none
    own = anchor[good]
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (good[1:] != good[:-1] + 1)]))
    last = np.concatenate([first[1:], [len(good)]]) - 1
    start, end, p = good[first], good[last] + size, own[first]
    text = np.searchsorted(offsets, start, "right") - 1
    c = mix(spans(start, end) + (p - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return text, start - offsets[text], end - start, h[p].view(np.int64), c.view(np.int64)


class RunLengthIndex:
    """Suffix order of some strings, its Burrows-Wheeler runs, and samples at the ends of the runs."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        n = len(buf)
        self.buf, self.n = buf, n
        self.end = np.repeat(offsets[1:], np.diff(offsets))
        self.order = self._suffix_order(offsets)
        before = np.full(n, -1, np.int16)
        before[1:] = buf[:-1]
        before[offsets[:-1][np.diff(offsets) > 0]] = -1
        bwt = before[self.order]
        change = np.ones(n + 1, bool)
        if n:
            change[1:-1] = (bwt[1:] != bwt[:-1]) | (bwt[1:] < 0)
        self.heads, self.tails = np.flatnonzero(change[:-1]), np.flatnonzero(change[1:])

    def _suffix_order(self, offsets: np.ndarray) -> np.ndarray:
        """Suffixes in order, equal ones by place. Each round doubles the bytes compared, among suffixes that are still alike."""
        n, sizes = self.n, np.diff(offsets)
        at = np.arange(n) + 7 * np.repeat(np.arange(len(sizes)), sizes)  # seven zeros after each string
        symbols = np.zeros(n + 7 * len(sizes) + 7, np.uint64)
        symbols[at] = self.buf.astype(np.uint64) + np.uint64(1)
        join = lambda x, y, by, bits: (x[: len(y) - by] << np.uint64(bits)) | y[by:]
        two = join(symbols, symbols, 1, 9)
        three, four = join(two, symbols, 2, 9), join(two, two, 2, 18)
        key = join(four, three, 4, 27)[at]
        live, rank, have, longest = np.argsort(key), np.zeros(n, np.uint64), 0, int(sizes.max(initial=0))
        key, order = key[live], np.zeros(n, np.int64)
        base = np.zeros(n, np.uint64)
        while len(live):
            place = np.arange(len(live))
            new = np.ones(len(live), bool)
            new[1:] = key[1:] != key[:-1]
            head = np.maximum.accumulate(np.where(new, place, 0))
            old = np.ones(len(live), bool)
            old[1:] = base[1:] != base[:-1]
            first = np.maximum.accumulate(np.where(old, place, 0))
            # a group's rank is where it begins in the whole order
            ranks = base + (head - first).astype(np.uint64)
            rank[live] = ranks
            have = have * 2 or 7
            alike = ~new
            alike[:-1] |= ~new[1:]
            single = ~alike
            order[ranks[single].astype(np.int64)] = live[single]
            live, base = live[alike], ranks[alike]
            if have >= longest:
                turn = np.lexsort((live, base))
                base, live = base[turn], live[turn]
                begins = np.ones(len(live), bool)
                begins[1:] = base[1:] != base[:-1]
                place = np.arange(len(live))
                order[base.astype(np.int64) + place - np.maximum.accumulate(np.where(begins, place, 0))] = live
                break
            k = live + have
            key = (base << np.uint64(32)) | np.where(k < self.end[live], rank[np.minimum(k, n - 1)] + np.uint64(1), np.uint64(0))
            turn = np.argsort(key)
            key, live, base = key[turn], live[turn], base[turn]
        return order

    def _common(self, s: np.ndarray, t: np.ndarray, spans: SpanHash, least: int) -> np.ndarray:
        """Length of the longest common prefix of suffixes s and t; 0 where it is under `least`."""
        most = np.minimum(self.end[s] - s, self.end[t] - t)
        out = np.zeros(len(s), np.int64)
        some = np.flatnonzero(most >= max(1, least))
        some = some[spans(s[some], s[some] + max(1, least)) == spans(t[some], t[some] + max(1, least))]
        s, t, low, high = s[some], t[some], np.full(len(some), max(1, least)), most[some]
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = spans(s, s + mid) == spans(t, t + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        out[some] = low
        return out

    def matching_statistics(self, least: int = 0) -> np.ndarray:
        """For each byte: the length of the longest string that starts there and anywhere else. One under `least` may be shown as less."""
        best = np.zeros(self.n, np.int64)
        if not self.n:
            return best
        spans = SpanHash(self.buf)
        at = np.arange(self.n)
        for ends, shift in ((self.heads, -1), (self.tails, 1)):
            inner = ends[(ends + shift >= 0) & (ends + shift < self.n)]
            sampled = np.zeros(self.n, np.int64)
            sampled[self.order[inner]] = self._common(self.order[inner], self.order[inner + shift], spans, least)
            known = np.zeros(self.n, bool)
            known[self.order[ends]] = True
            last = np.maximum.accumulate(np.where(known, at, 0))
            best = np.maximum(best, sampled[last] - (at - last))
        return best


def _fragment_rows(size: int):
    """Fragments with n: how many equal ones the slice has, on the first of them, and 0 on the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                text, start, length, h, c = fragments(*text_buffer(part.column("text")), size)
                order = np.lexsort((c, h))
                new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])])[: len(order)]
                n = np.zeros(len(order), np.int32)
                n[order[new]] = np.diff(np.append(np.flatnonzero(new), len(order)))
                take = pa.array(text)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(take), part.column("th").take(take), pa.array(start.astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(h.astype(np.int64)), pa.array(c.astype(np.int64)), pa.array(n)], ["doc_id", "th", "start", "length", "h", "c", "n"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            buf, offsets = text_buffer(part.column("text"))
            asked = part.column("asked")
            n = pa.compute.list_value_length(asked).to_numpy(zero_copy_only=False)
            flat = asked.flatten()
            start, length = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "length"))
            row = np.repeat(np.arange(part.num_rows), n)
            raw = buf.tobytes()
            a = offsets[row] + start
            pieces = [raw[x:y] for x, y in zip(a.tolist(), (a + length).tolist())]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(take), part.column("th").take(take), pa.array(start.astype(np.int32)), flat.field("h"), flat.field("big"), pa.array(pieces, pa.binary())], ["doc_id", "th", "start", "h", "big", "piece"])


def _spans_of(mask: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what windows that start at True cover, joined where windows are consecutive."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1 + size


def _index_rows(size: int, block_bytes: int):
    def marked(rows: list[tuple]) -> pa.RecordBatch:
        buf = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(r[4]) for r in rows])]).astype(np.int64)
        repeated = RunLengthIndex(buf, offsets).matching_statistics(size) >= size
        # no statistic reaches beyond its fragment, so marked starts of two fragments are never consecutive
        a, b = _spans_of(repeated, size)
        which = np.searchsorted(offsets, a, "right") - 1
        start = np.array([r[2] for r in rows], np.int64)[which] - offsets[which] if len(rows) else a
        return pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i in which], pa.int64()), pa.array([rows[i][1] for i in which], pa.int64()), pa.array((a + start).astype(np.int32)), pa.array((b + start).astype(np.int32))], ["doc_id", "th", "from", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, key = [], 0, None
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "start", "h", "piece"))):
                if held >= block_bytes and r[3] != key:
                    yield marked(rows)
                    rows, held = [], 0
                rows.append(r)
                held += len(r[4])
                key = r[3]
        if rows:
            yield marked(rows)

    return run


def _window_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "piece", 64 << 10):
                buf, offsets = text_buffer(part.column("piece"))
                n = np.diff(offsets) - size + 1
                row = np.repeat(np.arange(len(n)), n)
                rel = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                at = offsets[row] + rel
                take = pa.array(row)
                start = pa.array((part.column("start").to_numpy()[row] + rel).astype(np.int32))
                hashes = [pa.array(SpanHash(buf, salt)(at, at + size).view(np.int64)) for salt in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(take), part.column("th").take(take), start, *hashes], ["doc_id", "th", "from", "w1", "w2"])

    return run


def mark(docs: DataFrame, size: int = SIZE, block_bytes: int = BLOCK_BYTES, big: int = BIG) -> DataFrame:
    """(doc_id, th, from, to): byte ranges that windows found elsewhere cover; ranges may overlap. docs: doc_id, th (a hash of the text), text."""
    bound_batches(docs.sparkSession)
    found = materialize(docs.select("doc_id", "th", "text").mapInArrow(_fragment_rows(size), "doc_id long, th long, start int, length int, h long, c long, n int"), "found")
    known = found.where("n = 0").select("doc_id", "th", "start", "length")  # repeats whatever other slices hold; they needn't meet anything
    by_h, by_c = Window.partitionBy("h"), Window.partitionBy("h", "c")
    counted = found.where("n > 0").withColumns({"_n": F.sum("n").over(by_h), "_low": F.min("c").over(by_h), "_high": F.max("c").over(by_h)}).where("_n > 1")
    numbered = counted.withColumns({"_same": F.sum("n").over(by_c), "_i": F.row_number().over(by_c.orderBy("doc_id", "th", "start"))})
    judged = numbered.withColumn("_kinds", F.sum(F.when(F.col("_i") == 1, 1).otherwise(0)).over(by_h))
    events = materialize(
        judged.select("doc_id", "th", "start", "length", "h", (F.col("_same") > 1).alias("whole"), ((F.col("_i") == 1) & (F.col("_low") != F.col("_high"))).alias("compare"), (F.col("_kinds") > big).alias("big")).where("whole or compare"),
        "fragments",
    )
    whole = events.where("whole").select("doc_id", "th", "start", "length").unionByName(known).select("doc_id", "th", F.col("start").alias("from"), (F.col("start") + F.col("length")).alias("to"))
    # a document's own fragments: as many as its length allows
    asked = events.where("compare").groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "length", "h", "big")).alias("asked")).withColumnsRenamed({"doc_id": "_id", "th": "_th"})
    texts = docs.join(asked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).select("doc_id", "th", "text", "asked")
    pieces = texts.mapInArrow(_cut, "doc_id long, th long, start int, h long, big boolean, piece binary")
    # rows that are equal in id and text ask for the same pieces; one of each is compared
    pieces = materialize(pieces.dropDuplicates(["doc_id", "th", "start"]), "pieces")
    indexed = pieces.where("not big").repartition("h").sortWithinPartitions("h", "doc_id", "th", "start").select("doc_id", "th", "start", "h", "piece").mapInArrow(_index_rows(size, block_bytes), "doc_id long, th long, from int, to int")
    shown = pieces.where("big").mapInArrow(_window_rows(size), "doc_id long, th long, from int, w1 long, w2 long")
    often = shown.groupBy("w1", "w2").count().where("count > 1").select("w1", "w2")
    counted_ones = shown.join(often, ["w1", "w2"], "left_semi").select("doc_id", "th", "from", (F.col("from") + size).alias("to"))
    return whole.unionByName(indexed).unionByName(counted_ones)


def _finish(kept: list[str], with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                buf, offsets = text_buffer(part.column("text"))
                spans = part.column("_spans")
                n = pa.compute.fill_null(pa.compute.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
                flat = spans.flatten()
                row = np.repeat(np.arange(part.num_rows), n)
                edge = np.zeros(len(buf) + 1, np.int64)
                np.add.at(edge, offsets[row] + flat.field("from").to_numpy(zero_copy_only=False), 1)
                np.add.at(edge, offsets[row] + flat.field("to").to_numpy(zero_copy_only=False), -1)
                gone = np.cumsum(edge[:-1]) > 0
                first = gone.copy()
                first[1:] &= ~gone[:-1]
                cut = offsets[:-1][np.diff(offsets) > 0]
                first[cut] = gone[cut]
                sums = [np.concatenate([[0], np.cumsum(x)]) for x in (gone, first)]
                removed, runs = (s[offsets[1:]] - s[offsets[:-1]] for s in sums)
                raw = [buf[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
                out = {c: part.column(c) for c in kept}
                if with_text:
                    out["text"] = pa.array([None if null else r.decode(errors="ignore") for r, null in zip(raw, part.column("text").is_null().to_pylist())], pa.string())
                else:
                    out |= {"n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(removed.astype(np.int64)), "n_spans": pa.array(runs.astype(np.int64)), "kept_sha256": pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string())}
                yield pa.RecordBatch.from_pydict(out)

    return run


def _with_spans(docs: DataFrame, **how) -> DataFrame:
    keyed = docs.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    spans = mark(keyed, **how).groupBy("doc_id", "th").agg(F.collect_set(F.struct("from", "to")).alias("_spans")).withColumnsRenamed({"doc_id": "_id", "th": "_th"})
    return keyed.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left").drop("_id", "_th", "th")


def repeats(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of docs (doc_id, text)."""
    return _with_spans(docs.select("doc_id", "text"), **how).mapInArrow(_finish(["doc_id"], False), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, **how) -> DataFrame:
    """docs with repeated bytes taken out of text; what is left of a character that was cut is dropped."""
    rest = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("_rest"))
    fields = rest.select("_rest")._jdf.schema().toDDL()
    out = _with_spans(rest, **how).mapInArrow(_finish(["_rest"], True), f"{fields}, text string")
    return out.select("_rest.*", "text").select(*(F.col(f"`{c}`") for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
