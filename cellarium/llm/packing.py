"""Best-two-fit packing of tokenised documents into sequences of fixed length.

Only the number of pieces of each length matters for a plan, and there are at most `size` lengths, so the plan is made
from that histogram whatever the input's size. A bin is filled greedily, longest fitting piece first; then its smallest
piece is replaced by two unpacked ones if they fill the widened gap more tightly. The bin is repeated while its lengths
last; then some length k has less than one such bin takes, at most size / k. So there are fewer than size * (ln size + 1)
kinds of bin.

Pieces are then numbered within their length (in two steps, so that a common length isn't ordered in one task) and look
up their sequence and offset by number.

Defined cases: a null text is empty and gives the end token alone; a special token's name in a text is that token, as the
tokenizer has it; pieces of one length are interchangeable, and are numbered by id, piece and checksum; repeated rows are packed one by one; an empty table
has no sequences; extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellarium.llm.common import bound_batches, materialize, slices, text_buffer
from cellarium.llm.textvec import hash_runs, runs

SIZE, END = 4096, 1
#: Pieces of words whose ids a worker remembers, and ids of one such piece. A power of two: a piece's place is its hash.
SLOTS, WIDTH = 1 << 20, 8
#: Pieces of one length that are numbered together.
PART_ROWS = 50_000

_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Kinds of bytes: white space, letters, digits and marks of plain words, the lead byte of U+00C0 to U+00FF, and all others.
_BLANK, _LETTER, _DIGIT, _MARK, _LATIN, _OTHER = range(6)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _BLANK
_KIND[33:127] = _MARK
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[0xC3] = _LATIN
_KIND[39] = _OTHER  # an apostrophe may begin an ending, which is a piece of its own
#: What a tokenizer must say of itself for its words to be cut here.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it's visible, else the next from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


class PieceIds:
    """Token ids of texts. White space is dropped and no token crosses it, so a text's ids are those of its words, one after another.

    Plain words (visible ASCII without apostrophes or special tokens, and letters of Latin-1) are lowered and cut into
    pieces here, all of a slice at once, and the tokenizer's model is asked for pieces that the worker doesn't remember;
    any other word goes through the whole tokenizer. Pieces are known by 64-bit hashes. A tokenizer of another kind gets
    every text whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.cuts = (
            (told["normalizer"] or {}).get("normalizers") == _NORMALIZERS and (told["pre_tokenizer"] or {}).get("pretokenizers") == [_SPLIT, _BYTES]
            and told["model"]["type"] == "BPE" and not told["truncation"] and not told["padding"] and len(told["model"]["vocab"]) < 1 << 16
            and all(t["content"].startswith("<|") and not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not t["normalized"] for t in told["added_tokens"])
        )
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.keys, self.counts, self.ids = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint8), np.zeros((SLOTS, WIDTH), np.uint16)

    def of_texts(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the n + 1 offsets into them."""
        if not self.cuts:
            raw = buf.tobytes()
            ids = [self.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            return np.concatenate([np.zeros(0, np.int64), *(np.array(x, np.int64) for x in ids)]), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        low, starts, ends, whole = cut_words(buf, offsets)
        count, flat = self._known(low, starts, ends, whole)
        tokens = np.concatenate([[0], np.cumsum(count)])
        return flat, tokens[np.searchsorted(starts, offsets)]

    def _known(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each piece, and all ids."""
        h = hash_runs(low, starts, ends) | np.uint64(1)  # 0 is no piece
        slot = (h >> np.uint64(20) & np.uint64(SLOTS - 1)).astype(np.int64)
        missed = np.flatnonzero(self.keys[slot] != h)
        longer: dict[int, np.ndarray] = {}
        if len(missed):
            _, first, which = np.unique(h[missed], return_index=True, return_inverse=True)
            asked = missed[first]
            got = self._ask([low[a:b].tobytes() for a, b in zip(starts[asked].tolist(), ends[asked].tolist())], whole[asked])
        count, rows = self.counts[slot].astype(np.int64), self.ids[slot]
        if len(missed):
            size = np.array([len(x) for x in got])
            new = np.zeros((len(got), WIDTH), np.uint16)
            for k, x in enumerate(got):
                new[k, : min(len(x), WIDTH)] = x[:WIDTH]
            count[missed], rows[missed] = size[which], new[which]
            short = size <= WIDTH
            at, one = np.unique(slot[asked[short]], return_index=True)  # of pieces for one slot, one stays
            self.keys[at], self.counts[at], self.ids[at] = h[asked[short]][one], size[short][one], new[short][one]
            longer = {int(p): got[w] for p, w in zip(missed[~short[which]], which[~short[which]])}
        if not longer:
            return count, rows[np.arange(WIDTH) < count[:, None]].astype(np.int64)
        out, at = [], 0
        for p in sorted(longer):
            out += [rows[at:p][np.arange(WIDTH) < count[at:p, None]], np.array(longer[p], np.uint16)]
            at = p + 1
        return count, np.concatenate([*out, rows[at:][np.arange(WIDTH) < count[at:, None]]]).astype(np.int64)

    def _ask(self, pieces: list[bytes], whole: np.ndarray) -> list[list[int]]:
        out: list[list[int]] = []
        for piece, entire in zip(pieces, whole.tolist()):
            if entire:
                out.append(self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids)
            else:
                seen = piece.decode() if piece.isascii() else "".join(map(self.letters.__getitem__, piece))
                out.append([t.id for t in self.model.tokenize(seen)])
        return out


def cut_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts with plain words lowered; starts and ends of plain words' pieces and of all other words; and whether it's such a word."""
    n = len(buf)
    kind, low = _KIND[buf], buf.copy()
    upper = (buf >= 65) & (buf <= 90)
    low[upper] += 32
    lead = np.flatnonzero(kind == _LATIN)
    if len(lead):
        tail = buf[np.minimum(lead + 1, n - 1)]
        kind[lead] = kind[lead + 1] = np.where((tail == 0x97) | (tail == 0xB7), _OTHER, _LETTER)
        high = (tail < 0x9F) & (tail != 0x97)
        low[lead[high] + 1] += 32
    kind[:-1][(buf[:-1] == 60) & (buf[1:] == 124)] = _OTHER  # "<|" may begin a special token
    inside = kind != _BLANK
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    cut = np.ones(n, bool)
    cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    other = np.flatnonzero(kind == _OTHER)
    odd = np.zeros(n + 1, np.int32)
    if len(other):
        starts, ends, _ = runs(inside, offsets)
        words = np.unique(np.searchsorted(starts, other, "right") - 1)
        odd[starts[words]] += 1
        odd[ends[words]] -= 1
        np.cumsum(odd, out=odd)
        within = odd[:-1] > 0
        low[within] = buf[within]
        cut[within] = False
        cut[starts[words]] = True
    begins = np.flatnonzero(inside & (cut | first))
    last = np.ones(n, bool)
    last[:-1] = ~inside[1:] | cut[1:] | first[1:]
    return low, begins, np.flatnonzero(inside & last) + 1, odd[begins] > 0


@functools.lru_cache(1)
def worker_ids(path: str) -> PieceIds:
    """One for all tasks of a worker process."""
    return PieceIds(path)


def _tokenize(path: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = worker_ids(path)
        for batch in batches:
            for part in slices(batch, "text"):
                flat, offsets = ids.of_texts(*text_buffer(part.column("text")))
                n = len(offsets) - 1
                # the end token follows each document
                at = offsets + np.arange(n + 1)
                every = np.full(at[-1], END, "<u4")
                every[np.arange(len(flat)) + np.repeat(np.arange(n), np.diff(offsets))] = flat
                length = np.diff(at)
                pieces = -(-length // size)
                row = np.repeat(np.arange(n), pieces)
                number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = at[row] + number * size
                end = np.minimum(start + size, at[row + 1])
                crc = [zlib.crc32(every[a:b]) for a, b in zip(start.tolist(), end.tolist())]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(number * size), pa.array((end - start).astype(np.int32)), pa.array(crc, pa.int64()),
                ], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def tokenized_pieces(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's pieces."""
    bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_tokenize(path, size), _PIECES)


@dataclass(frozen=True)
class Bin:
    """A kind of bin: its lengths in order of place, how many sequences are filled so, and the first one's number."""

    lengths: tuple[int, ...]
    times: int
    first: int


class _Lengths:
    """Lengths that still have pieces, as a bitmap in one integer: the longest up to a bound is a shift and a bit_length."""

    def __init__(self, counts: dict[int, int]):
        self.left = {k: n for k, n in counts.items() if n}
        self.bits = sum(1 << k for k in self.left)

    def longest(self, most: int) -> int:
        return (self.bits & ((2 << most) - 1)).bit_length() - 1 if most > 0 else -1

    def take(self, k: int, n: int = 1) -> None:
        self.left[k] -= n
        if not self.left[k]:
            self.bits &= ~(1 << k)

    def put(self, k: int, n: int = 1) -> None:
        self.left[k] += n
        self.bits |= 1 << k


def _pair(have: _Lengths, room: int, more_than: int) -> tuple[int, int] | None:
    """Two unpacked pieces that fill `room` most tightly, if they fill more than `more_than`."""
    best, found = more_than, None
    a = have.longest(room - 1)
    while a > 0 and 2 * a > best:
        b = have.longest(min(a, room - a))
        if b == a and have.left[a] < 2:
            b = have.longest(a - 1)
        if b > 0 and a + b > best:
            best, found = a + b, (a, b)
            if best == room:
                break
        a = have.longest(a - 1)
    return found


def plan(counts: dict[int, int], size: int = SIZE) -> list[Bin]:
    """Bins for counts[length] pieces of each length."""
    have, out, number = _Lengths(counts), [], 0
    while have.bits:
        gap, held = size, []
        while (k := have.longest(gap)) > 0:
            held.append(k)
            have.take(k)
            gap -= k
        while gap and len(held) > 1:
            smallest = held[-1]
            two = _pair(have, gap + smallest, smallest)
            if two is None:
                break
            held.pop()
            have.put(smallest)
            for k in two:
                held.append(k)
                have.take(k)
                gap -= k
            gap += smallest
            held.sort(reverse=True)
        uses = {k: held.count(k) for k in set(held)}
        more = min(have.left[k] // n for k, n in uses.items())
        for k, n in uses.items():
            if more:
                have.take(k, more * n)
        out.append(Bin(tuple(held), 1 + more, number))
        number += 1 + more
    return out


class Places:
    """Number of a piece among those of its length -> (sequence, offset)."""

    def __init__(self, bins: list[Bin]):
        rows: dict[int, tuple[list[int], list[tuple[Bin, list[int]]]]] = {}
        used: dict[int, int] = {}
        for b in bins:
            at: dict[int, list[int]] = {}
            offset = 0
            for k in b.lengths:
                at.setdefault(k, []).append(offset)
                offset += k
            for k, offsets in at.items():
                starts, kinds = rows.setdefault(k, ([], []))
                starts.append(used.get(k, 0))
                kinds.append((b, offsets))
                used[k] = used.get(k, 0) + b.times * len(offsets)
        self.rows = rows

    def __call__(self, length: int, number: int) -> tuple[int, int]:
        starts, kinds = self.rows[length]
        i = bisect_right(starts, number) - 1
        b, offsets = kinds[i]
        turn, slot = divmod(number - starts[i], len(offsets))
        return b.first + turn, offsets[slot]


def _placer(bc):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: Places = bc.value
        for batch in batches:
            got = [places(k, n) for k, n in zip(batch.column("length").to_pylist(), batch.column("_number").to_pylist())]
            cols = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            cols["length"] = cols["length"].cast(pa.int64())
            yield pa.RecordBatch.from_pydict(cols | {"sequence_id": pa.array([g[0] for g in got], pa.int64()), "offset": pa.array([g[1] for g in got], pa.int64())})

    return run


def pack(pieces: DataFrame, size: int = SIZE, part_rows: int = PART_ROWS) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32), each read more than once, with sequence_id and offset."""
    spark = pieces.sparkSession
    bound_batches(spark)
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `size` rows
    parts = 1 + max(counts.values(), default=0) // part_rows
    pieces = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    per_part = pieces.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_part.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32"))
    numbered = pieces.withColumn("_rank", rank).join(base, ["length", "_part"]).withColumn("_number", (F.col("_base") + F.col("_rank") - 1).cast("long"))
    places = spark.sparkContext.broadcast(Places(plan(counts, size)))  # its size depends on the lengths only
    cols = ("doc_id", "piece", "start", "length", "ids_crc32", "_number")
    return numbered.select(*cols).mapInArrow(_placer(places), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(materialize(tokenized_pieces(docs, tokenizer_path()), "pieces"))
