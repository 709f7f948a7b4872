"""Packing token sequences by minimum bin slack.

Documents become token ids plus an end id and are cut into full windows and a
remainder. The remainders' lengths form a histogram of at most ``capacity``
entries, whatever the corpus: planning runs on it alone. Each planning step
anchors on the longest length left and asks a bitset subset-sum program which
multiset of the others comes closest to the capacity; the chosen counts are
backtracked and the pattern is repeated as often as the histogram allows, so
every step uses up a length or leaves too few of it.

Rows find their place by rank within their length: a running count inside the
partition that wrote them plus the count of the partitions before, so no length,
however common, is gathered in one task.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, written

CAPACITY = 4096
END_ID = 2
#: Bytes of pre-tokens and their ids that a worker remembers before it starts over.
MEMORY = 96 << 20
#: What one remembered pre-token takes besides its characters and ids.
ENTRY = 200
#: Pre-tokens encoded at once.
STEP = 20_000
#: Counts (a length in a partition) that may be broadcast, some 20 bytes each; more are joined by exchange.
SENT = 200_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Token ids by a ``tokenizers`` file, as little-endian unsigned 32-bit bytes.

    A vocabulary whose pre-tokens are independent of their surroundings lets
    each distinct pre-token be encoded once; texts outside the plain Latin range
    (where Python's and the library's character classes agree) and any other
    kind of file are encoded whole.
    """

    # The normalizer and pre-tokenizer for which pre-tokens may be cached.
    NORMALIZERS = ["NFC", "Replace", "Lowercase"]
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſ"
    NUMBERS = "0-9²³¹¼-¾"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary = spec["model"].get("vocab", {})
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        suffix = spec["model"].get("end_of_word_suffix")
        self.cached = bool(
            suffix
            and [s.get("type") for s in steps] == self.NORMALIZERS
            and split.get("pattern", {}).get("Regex") == self.SPLIT
        )
        if self.cached:
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.plain = re.compile("[\x00-\x1b\x20-įı-ſ]*")
        self.find = re.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d|[{self.LETTERS}]+|[{self.NUMBERS}]|[^\\s{self.LETTERS}{self.NUMBERS}]+"
        ).findall
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _learn(self, pieces: list[str]) -> None:
        ids = np.array(self.inner.encode(" ".join(pieces), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(pieces):
            raise ValueError("pre-tokens and word ends differ")
        raw, begin = ids.tobytes(), 0
        for piece, end in zip(pieces, (ends * 4).tolist(), strict=True):
            self.known[piece] = raw[begin:end]
            begin = end
        self.held += len(raw) + sum(map(len, pieces)) + ENTRY * len(pieces)

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for text in texts:
            if not self.cached or "<|" in text or not self.plain.fullmatch(text):
                out.append(np.array(self.inner.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
                continue
            pieces = self.find(text.lower())
            try:
                out.append(b"".join(map(self.known.__getitem__, pieces)))
            except KeyError:
                new = [p for p in dict.fromkeys(pieces) if p not in self.known]
                if self.held + sum(map(len, new)) * 5 + ENTRY * len(new) > MEMORY:
                    self.known.clear()
                    self.held, new = 0, list(dict.fromkeys(pieces))
                for at in range(0, len(new), STEP):
                    self._learn(new[at : at + STEP])
                out.append(b"".join(map(self.known.__getitem__, pieces)))
        return out


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, part int, rank long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Cut every document's ids (with ``end_id``) into windows and a remainder.

    A null text counts as empty and becomes the end id alone. ``rank`` numbers
    the pieces of one length inside the writing partition ``part``.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            # Where each piece's document is in the batch, then the other numbers of the piece.
            at, starts, lengths, sums, totals, ranks = (array("q") for _ in range(6))
            encode = _tokenizer(tokenizer).encode
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = encode([text or ""])[0] + end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    raw = ids[4 * start : 4 * (start + capacity)]
                    length = len(raw) // 4
                    at.append(row)
                    starts.append(start)
                    lengths.append(length)
                    sums.append(zlib.crc32(raw))
                    totals.append(total)
                    ranks.append(seen[length])
                    seen[length] += 1
            numbers = [pa.array(np.asarray(c, np.int64)) for c in (at, starts, lengths, sums, totals, ranks)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(numbers[0]), numbers[1], numbers[2].cast(pa.int32()), numbers[3], numbers[4],
                 pa.array(np.full(len(at), part, np.int32)), numbers[5]],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"],
            )

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def best_fill(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The multiset of lengths, at most ``counts`` of each, that fills ``room`` closest.

    ``reach`` has bit s set if some multiset sums to s. Counts are split into
    powers of two; the longest lengths come first and the search stops once
    ``room`` itself is reached, which no further length can improve.
    """
    reach, full, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if 0 < x <= room), reverse=True):
        left, size = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            copies = min(size, left)
            steps.append((length, copies, reach))
            reach |= reach << (length * copies) & full
            left, size = left - copies, size * 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, copies, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + copies
            total -= length * copies
    return sorted(used.items(), reverse=True)


def plan_patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(repeats, [(length, copies), ...]) until every length is used up."""
    left, out = {k: v for k, v in counts.items() if v}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        pattern = dict(best_fill(left, capacity - longest))
        left[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        repeats = min(left[k] // c for k, c in pattern.items())
        for k, c in pattern.items():
            left[k] -= repeats * c
            if not left[k]:
                del left[k]
        out.append((repeats, sorted(pattern.items(), reverse=True)))
    return out


def _places(patterns: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, repeats, first sequence, offset), sorted."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for repeats, pattern in patterns:
        offset = 0
        for length, copies in pattern:
            rows.append((length, taken.get(length, 0), repeats, sequence, offset))
            taken[length] = taken.get(length, 0) + repeats * copies
            offset += length * copies
        sequence += repeats
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """One row per piece with the sequence and offset it is packed at.

    Needs ``doc_id`` and ``text``; other columns, whatever their names, are not
    read. Null texts count as empty, null or repeated ids are packed like any
    other row, an empty table gives no rows. Only the histogram of lengths (at
    most ``capacity`` rows) reaches the driver, and only the plan made from it
    goes back.
    """
    pieces = written(token_pieces(docs, tokenizer or default_tokenizer(), capacity, end_id), "pieces")
    # Two columns of a written table are cheaper to read twice than a table of counts is to write.
    held = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = held.groupBy("length").agg(F.sum("n").alias("n"), F.count("*").alias("parts")).collect()
    counts = {r["length"]: r["n"] for r in histogram}
    table = _places(plan_patterns(counts, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = held.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    starts = table[:, 0] << 44 | table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            row = table[np.searchsorted(starts, length << 44 | rank, side="right") - 1] if len(rank) else table[:0]
            inside = rank - row[:, 1]
            columns = [batch.column(c) for c in ("doc_id", "start")] + [pa.array(length)]
            columns += [batch.column(c) for c in ("ids_crc32", "doc_tokens")]
            columns += [pa.array(row[:, 3] + inside % row[:, 2]), pa.array(row[:, 4] + inside // row[:, 2] * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in OUT.split(", ")])

    small = sum(r["parts"] for r in histogram) <= SENT
    ranked = pieces.join(F.broadcast(base) if small else base, ["part", "length"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("base")).alias("rank")
    )
    return ranked.mapInArrow(place, OUT)
