"""Removal of repeated passages with a compressed FM-index per shard.

Every window of 20 words is assigned to the shard of its minimizer, the least
hash among its four-word grams. Equal windows have equal minimizers, so a shard
sees all occurrences of its windows; runs of windows with one minimizer travel
together as a segment. Three steps keep the work in proportion to the text:

* minimizers are counted first, and only segments whose minimizer occurs again
  take part (a window that repeats repeats its minimizer too);
* equal segments, told by 128 bits of hash, meet by aggregation: the earliest
  stays, the windows of all others start earlier somewhere, so they need no
  search; texts are fetched only for minimizers with different segments;
* minimizers that occur very often, or whose segments are long (runs of one
  word), would crowd a shard: their segments are split into single windows,
  which meet by aggregation likewise.

A shard sorts its segments by document and start and builds an FM-index: the
Burrows-Wheeler transform of the word sequence in a wavelet matrix of packed
bits with block counts, and every eighth place of the suffix array. The segments
are streamed through it by backward search, all positions in step, which gives
their matching statistics up to the threshold of 20 words; where they reach it,
the window is repeated if the smallest place of its interval is not its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, text_or_empty, written

WINDOW, GRAM = 20, 4
#: Occurrences of one minimizer beyond which its windows are dealt out one by one.
HOT = 1000
#: Windows of one minimizer beyond which they are dealt out one by one, too.
HOT_WINDOWS = 20_000
#: Words that one shard indexes.
SHARD_WORDS = 300_000
#: Stands for a null id: after all others.
LAST_ID = 2**63 - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


def split_words(text: str) -> list[str]:
    """Runs outside ASCII white space."""
    for c in "\t\n\x0b\x0c\r":
        if c in text:
            text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def minimizers(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Of each window: its minimizer, and of each gram its hash."""
    n = len(hashes) - gram + 1
    grams = hashes[:n].copy()
    for j in range(1, gram):
        grams = grams * _MIX + hashes[j : j + n]
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    # Sliding minimum by doubling.
    wide, least, span = window - gram + 1, grams, 1
    while span * 2 <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < wide:
        least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
    return least, grams


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as many as were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 2 * n
            self.up, self.down = (
                np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)]))
                for x in (_MIX, np.uint64(pow(int(_MIX), -1, 2**64)))
            )
        return self.up, self.down


@lru_cache(maxsize=1)
def _powers() -> _Powers:
    """What a Python worker keeps from task to task."""
    return _Powers()


def _segments_of(words: list[str], powers: _Powers) -> tuple[np.ndarray, ...]:
    """Minimizer, hash, start, number of windows and occurrences (two at most) of each segment."""
    h = word_hashes(words)
    least, grams = minimizers(h)
    starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    ends = np.concatenate([starts[1:], [len(least)]])
    value = least[starts]
    # Occurrences of the minimizer among the grams of the segment's windows.
    tail = WINDOW - GRAM
    hit = np.flatnonzero(grams[: len(least)] == least)
    count = np.bincount(np.searchsorted(starts, hit, side="right") - 1, minlength=len(starts)).astype(np.int64)
    count += (grams[(ends - 1)[:, None] + np.arange(1, tail + 1)] == value[:, None]).sum(axis=1)
    # Of all words of the segment: a sum with powers by place, moved to place 0.
    up, down = powers.of(len(h))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)])])
    whole = (total[ends + WINDOW - 1] - total[starts]) * down[starts]
    whole ^= whole >> np.uint64(31)
    whole = whole * _MIX + (ends - starts).astype(np.uint64)
    return value.view(np.int64), whole.view(np.int64), starts, ends - starts, np.minimum(count, 2)


def _packed(start: np.ndarray, n: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return start.astype(np.int64) << 33 | n << 2 | weight


def _start(at: Column) -> Column:
    return F.shiftright(at, 33).cast("int")


def _count(at: Column) -> Column:
    return F.shiftright(at, 2).bitwiseAND(F.lit(2**31 - 1)).cast("int")


SUPER = "h long, whole long, id long, tag long, at long"


def super_windows(docs: DataFrame) -> DataFrame:
    """Segments (minimizer, hash of all words, document, start and counts in one number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers()
        for batch in batches:
            out: list[tuple] = []
            for i, t, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                words = split_words(text)
                if len(words) >= WINDOW:
                    h, whole, start, n, weight = _segments_of(words, powers)
                    out.append((h, whole, np.full(len(h), i), np.full(len(h), t), _packed(start, n, weight)))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] or [np.zeros(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["h", "whole", "id", "tag", "at"])

    return docs.select("id", "tag", "text").mapInArrow(run, SUPER)


def outcome(words: list[str], gone: list[dict], texts: bool) -> tuple:
    """n_words, n_removed and digest of the words that no window of the runs ``gone`` covers; with ``texts`` also kept text and spans."""
    edge = np.zeros(len(words) + 1, np.int64)
    for f in gone:
        edge[f["start"]] += 1
        edge[f["start"] + f["n"] + WINDOW - 1] -= 1
    covered = np.cumsum(edge[:-1]) > 0
    kept = " ".join(compress(words, (~covered).tolist()) if gone else words)
    digest = hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()
    turns = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]))).tolist() if texts else []
    spans = [{"start": a, "n": b - a} for a, b in zip(turns[::2], turns[1::2], strict=True)]
    return len(words), int(covered.sum()), digest, kept if texts else None, spans if texts else None


_RUN = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())]))
_SEGMENT = pa.list_(pa.struct([("key", pa.int64()), ("start", pa.int32()), ("words", pa.string())]))
_WINDOWS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("start", pa.int32())]))
_PREPARED = pa.schema(
    [("doc_id", pa.int64()), ("id", pa.int64()), ("tag", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64())]
    + [("kept_sha256", pa.string()), ("kept", pa.string()), ("spans", _RUN), ("text", pa.string()), ("copied", _RUN)]
    + [("segments", _SEGMENT), ("windows", _WINDOWS)]
)
PREPARED = (
    "doc_id long, id long, tag long, n_words long, n_removed long, kept_sha256 string, kept string, "
    "spans array<struct<start:int,n:int>>, text string, copied array<struct<start:int,n:int>>, segments array<struct<key:long,start:int,words:string>>, "
    "windows array<struct<a:long,b:long,start:int>>"
)


def _cut(words: list[str], wanted: list[dict]) -> tuple[list[dict], list[dict], list[dict]]:
    """Segments with their words; of crowded minimizers single windows with two hashes, and those the text has had before."""
    segments, windows, again, seen = [], [], [], set()
    for f in sorted(wanted, key=lambda f: f["start"]):
        a, n = f["start"], f["n"]
        if not f["hot"]:
            segments.append({"key": f["h"], "start": a, "words": " ".join(words[a : a + n + WINDOW - 1])})
            continue
        for p in range(a, a + n):
            t = " ".join(words[p : p + WINDOW]).encode("utf-8", "surrogatepass")
            pair = (xxhash.xxh3_64_intdigest(t) - 2**63, xxhash.xxh64_intdigest(t, 1) - 2**63)
            if pair in seen:
                again.append({"start": p, "n": 1})
            else:
                seen.add(pair)
                windows.append({"a": pair[0], "b": pair[1], "start": p})
    return segments, windows, again


def _prepare(texts: bool):
    """Documents that need no search get their result; the others keep text and segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in list(_PREPARED)[3:]]
            for text, wanted, copied in zip(*(batch.column(c).to_pylist() for c in ("text", "found", "copied")), strict=True):
                words = split_words(text)
                if wanted:
                    segments, windows, again = _cut(words, wanted)
                    row = (len(words), None, None, None, None, text, [*(copied or ()), *again], segments, windows)
                else:
                    row = (*outcome(words, copied or [], texts), None, [], [], [])
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            ids = [batch.column(c) for c in ("doc_id", "id", "tag")]
            made = [pa.array(c, f.type) for c, f in zip(columns, list(_PREPARED)[3:], strict=True)]
            yield pa.RecordBatch.from_arrays([*ids, *made], schema=_PREPARED)

    return run


class Bits:
    """A packed bit sequence with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        self.words = np.packbits(np.pad(bits.astype(np.uint8), (0, -self.n % 64 + 64)), bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)[:-1]]).astype(np.int32)
        self.ones = int(bits.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """Rank of any symbol in a sequence; one row of packed bits per bit of the symbols."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.rows = []
        order = symbols
        for b in range(bits - 1, -1, -1):
            bit = (order >> b & 1).astype(bool)
            row = Bits(bit)
            self.rows.append((b, row, row.n - row.ones))
            order = np.concatenate([order[~bit], order[bit]])

        # Where each symbol's occurrences begin below the last row.
        every = np.arange(1 << bits if bits < 8 else int(symbols.max(initial=0)) + 1)
        self.origin = self._below(every, np.zeros_like(every))

    def _below(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A position's place below the last row, following the symbol's bits."""
        for b, row, zeros in self.rows:
            ones = row.rank(at)
            at = np.where(symbol >> b & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before ``at``, element by element."""
        return self._below(symbol, at) - self.origin[symbol]

    def get(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at ``at``, and how often each occurs before it."""
        symbol = np.zeros(len(at), np.int64)
        for b, row, zeros in self.rows:
            bit, ones = row.get(at), row.rank(at)
            symbol |= bit.astype(np.int64) << b
            at = np.where(bit, zeros + ones, at - ones)
        return symbol, at - self.origin[symbol]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Places of ``text`` by the suffixes that begin there; doubles the sorted prefix until all differ."""
    n = len(text)
    rank, span = text.astype(np.int64), 1
    while True:
        following = np.full(n, -1, np.int64)
        following[: max(0, n - span)] = rank[span:] if span < n else rank[:0]
        pair = (rank << 32) + following + 1
        order = np.argsort(pair, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(pair[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        span *= 2


class FmIndex:
    """Backward search over a sequence of symbols; symbol 0 separates segments.

    Holds the transform as a wavelet matrix and every eighth place of the suffix
    array; the sequence itself only while patterns are taken from it, in the
    narrowest whole numbers.
    """

    SAMPLE = 8

    def __init__(self, text: np.ndarray, longest: int):
        most = int(text.max())
        self.text, self.longest = text.astype(np.min_scalar_type(most)), longest
        order = suffix_order(text)
        last = text[order - 1]
        last[order == 0] = 0  # the suffix at 0 has no symbol before it; it is sampled, so no walk passes it
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=most + 1))])
        self.tree = WaveletMatrix(last, max(1, most.bit_length()))
        kept = order % self.SAMPLE == 0
        self.kept, self.samples = Bits(kept), (order[kept] // self.SAMPLE).astype(np.uint32)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.before[symbol] + self.tree.rank(symbol, low), self.before[symbol] + self.tree.rank(symbol, high)

    def places(self, rows: np.ndarray) -> np.ndarray:
        """Where in the sequence the suffixes of ``rows`` begin: steps back to a sampled place, then adds them."""
        out, which, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(rows):
            here = self.kept.get(rows)
            out[which[here]] = self.samples[self.kept.rank(rows[here])].astype(np.int64) * self.SAMPLE + steps
            rows, which, steps = rows[~here], which[~here], steps + 1
            symbol, before = self.tree.get(rows)
            rows = self.before[symbol] + before
        return out

    def matching(self, ends: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics: how many symbols up to each end, at most ``limit``, occur again; and their intervals."""
        length, out_low, out_high = (np.zeros(len(ends), np.int64) for _ in range(3))
        which, at = np.arange(len(ends)), ends
        low = high = np.zeros(0, np.int64)
        for step in range(limit):
            symbol = self.text[at - step].astype(np.int64)
            low, high = self.extend(symbol, low, high) if step else (self.before[symbol], self.before[symbol + 1])
            more = high - low > 1
            low, high, at, which = low[more], high[more], at[more], which[more]
            if not len(at):
                break
            length[which], out_low[which], out_high[which] = step + 1, low, high
        return length, out_low, out_high

    def repeated(self, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the patterns of ``length`` symbols ending at ``ends``: those that occur again, and where first."""
        matched, low, high = self.matching(ends, length)
        whole = matched >= length
        at, low, high = ends[whole], low[whole], high[whole]
        if not len(at):
            return at, at
        kinds, where, which = np.unique(low, return_index=True, return_inverse=True)
        size = high[where] - kinds
        begins = np.cumsum(size) - size
        rows = np.repeat(kinds - begins, size) + np.arange(int(size.sum()))
        first = np.minimum.reduceat(self.places(rows), begins)
        return at, first[which]


REMOVED = "id long, tag long, start int, n int"


def search_shard(rows: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, int]]:
    """Runs (id, tag, start, n) of windows of a shard's segments that start earlier too.

    ``rows`` are (id, tag, start, words) of segments; equal rows count once.
    """
    rows = sorted(set(rows), key=lambda r: r[:3])
    ids: dict[str, int] = {}
    pieces, lengths = [], []
    for *_, words in rows:
        w = words.split(" ")
        pieces.append(np.fromiter((ids.setdefault(x, len(ids) + 1) for x in w), np.int64, len(w)))
        pieces.append(np.zeros(1, np.int64))
        lengths.append(len(w))
    text, lengths = np.concatenate(pieces), np.array(lengths)
    begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    windows = lengths - WINDOW + 1
    owner = np.repeat(np.arange(len(rows)), windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = begins[owner] + offset
    index = FmIndex(text, WINDOW)
    at, first = index.repeated(starts + WINDOW - 1, index.longest)
    again = at - WINDOW + 1
    again = again[again > first]
    again.sort()
    out = []
    if len(again):
        segment = np.searchsorted(begins, again, side="right") - 1
        cut = np.flatnonzero((np.diff(again) != 1) | (np.diff(segment) != 0)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(again)], strict=True):
            i, t, s, _ = rows[segment[a]]
            out.append((i, t, s + int(again[a] - begins[segment[a]]), b - a))
    return out


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[int, int, int, str]] = []
    for batch in batches:
        rows += zip(*(batch.column(c).to_pylist() for c in ("id", "tag", "start", "words")), strict=True)
    found = search_shard(rows) if rows else []
    columns = list(zip(*found, strict=True)) or [()] * 4
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "tag", "start", "n"]
    )


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, spans array<struct<start:int,n:int>>"


def _remove(texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ("text", "copied", "single", "gone", "firsts")
            rows = []
            for text, copied, single, gone, firsts in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                stay = set(firsts or ())
                runs = [*(copied or ()), *(gone or ()), *({"start": p, "n": 1} for p in single or () if p not in stay)]
                rows.append(outcome(split_words(text), runs, texts))
            columns, fields = list(zip(*rows, strict=True)) or [()] * 5, list(_PREPARED)[3:8]
            made = [pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names=["doc_id", *(f.name for f in fields)])

    return run


def _candidates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments to search (id, tag, h, at, hot) and copies of earlier segments (id, tag, at)."""
    windows = written(super_windows(rows), "windows")
    occurrences, n = F.sum(F.col("at").bitwiseAND(F.lit(3))), F.sum(_count(F.col("at")))
    again = windows.groupBy("h").agg(occurrences.alias("m"), n.alias("n")).filter("m > 1")
    again = again.select("h", ((F.col("m") > F.lit(HOT)) | (F.col("n") > F.lit(HOT_WINDOWS))).alias("hot"))
    repeated = written(windows.join(again, "h"), "repeated")
    discard(windows)
    first = F.min(F.struct("id", "tag", "at")).alias("first")
    kinds = written(repeated.groupBy("h", "whole").agg(first, F.count("*").alias("c"), F.bool_or("hot").alias("hot")), "kinds")
    few = kinds.filter("NOT hot")
    variants = few.groupBy("h").agg(F.count("*").alias("v"))
    unequal = (F.col("v") > 1) | (F.col("first.at").bitwiseAND(F.lit(3)) > 1)
    searched = few.join(variants, "h").filter(unequal).select("first.*", "h", "hot")
    searched = searched.unionByName(kinds.filter("hot").select("first.*", "h", "hot"))
    firsts = kinds.filter("c > 1").select("h", "whole", "first")
    copies = repeated.join(firsts, ["h", "whole"]).filter(F.struct("id", "tag", "at") != F.col("first")).select("id", "tag", "at")
    searched, copies = written(searched, "searched"), written(copies, "copies")
    discard(repeated, kinds)
    return searched, copies


def _tag(text: Column, seed: int) -> Column:
    """Checksum and 31 bits of a seeded hash in one number."""
    more = F.xxhash64(text, F.lit(seed)).bitwiseAND(F.lit(2**31 - 1))
    return F.shiftleft(F.crc32(text.cast("binary")), 31).bitwiseOR(more)


def tagged(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``id`` (a null one last), ``tag`` and ``text``: rows with one id and tag have one text.

    Tags that do not tell all texts of an id apart (by their SHA-256) are made
    with another seed, until they do.
    """
    id_, text = F.col("doc_id").cast("long"), text_or_empty().cast("string")
    plain = docs.select(id_.alias("doc_id"), F.coalesce(id_, F.lit(LAST_ID)).alias("id"), text.alias("text"))
    if plain.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return plain.withColumn("tag", F.lit(0).cast("long")).select("doc_id", "id", "tag", "text")
    seed = 0
    while True:
        rows = plain.withColumn("tag", _tag(F.col("text"), seed)).select("doc_id", "id", "tag", "text")
        digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
        told = rows.groupBy("id", "tag").agg(F.min(digest).alias("a"), F.max(digest).alias("b"))
        if told.filter("a != b").isEmpty():
            return rows
        seed += 1


def cleaned(docs: DataFrame, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, ``kept`` text and removed ``spans`` (first word, words) of every row.

    Kept words are joined by one space; without ``texts`` the last two are null.

    Null texts have no words; texts of fewer than 20 words lose nothing. Null
    ids come after all others. Rows equal in id and text count as one document
    and get the same result; different texts under one id (or none) are told
    apart by a tag and ordered by it, see ``tagged``. An empty table gives no
    rows; columns other than ``doc_id`` and ``text`` are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = tagged(docs)
    searched, copies = _candidates(rows)
    start, n = _start(F.col("at")).alias("start"), _count(F.col("at")).alias("n")
    wanted = searched.select("id", "tag", F.struct("h", start, n, "hot").alias("f"), F.lit(None).cast("struct<start:int,n:int>").alias("c"))
    told = wanted.unionByName(copies.select("id", "tag", F.struct(start, n).alias("c")), allowMissingColumns=True)
    # Sets, because equal rows of one document say everything twice; both end with the document's length.
    told = told.groupBy("id", "tag").agg(F.collect_set("f").alias("found"), F.collect_set("c").alias("copied"))
    prepared = written(rows.join(told, ["id", "tag"], "left").mapInArrow(_prepare(texts), PREPARED), "prepared")
    total = searched.filter("NOT hot").agg(F.sum(n + WINDOW - 1)).first()[0] or 0
    discard(searched, copies)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_WORDS))
    segments = prepared.select("id", "tag", F.explode("segments").alias("s")).select("s.key", "id", "tag", "s.start", "s.words")
    gone = segments.repartition(shards, "key").mapInArrow(_search, REMOVED)
    # Of equal single windows the earliest stays; a text loses its others, so they need not be looked up.
    single = prepared.select("id", "tag", F.explode("windows").alias("w"))
    earliest = single.groupBy("w.a", "w.b").agg(F.min(F.struct("id", "tag", "w.start")).alias("f")).select("f.*")
    told = gone.select("id", "tag", F.struct("start", "n").alias("g"), F.lit(None).cast("int").alias("f"))
    told = told.unionByName(earliest.select("id", "tag", F.col("start").alias("f")), allowMissingColumns=True)
    told = told.groupBy("id", "tag").agg(F.collect_set("g").alias("gone"), F.collect_set("f").alias("firsts"))
    touched = prepared.filter("text IS NOT NULL").select("doc_id", "id", "tag", "text", "copied", F.col("windows.start").alias("single"))
    result = touched.join(told, ["id", "tag"], "left").mapInArrow(_remove(texts), RESULT)
    return prepared.filter("text IS NULL").select(*[c.split()[0] for c in RESULT.split(", ")]).unionByName(result)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of ``docs``, as ``cleaned`` says."""
    return cleaned(docs, texts=False).drop("kept", "spans")
