"""Secret scan with multipart credential linking.

Strong patterns (assignments, access identifiers, long hex) are reported
wherever they stand. A credential often comes in parts that mean little alone:
an identifier, a secret without a label, an endpoint. Such weak candidates are
intervals inside a scope (a run of lines without a blank line); each is joined
with the intervals of complementary roles that lie within ``REACH`` code points
in the same scope, and reported only if one exists. The join is a search for
the nearest interval of a role on either side, so a scope with many parts costs
n log n. Rows are independent: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

Span = tuple[int, int, str]

#: Base kinds as the contract lists them, then the method's.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
ORDER = {k: i for i, k in enumerate(KINDS)}
#: Code points between parts of one credential.
REACH = 300
#: Bits per character from which a bare token may be a secret.
ENTROPY = 3.5

# Patterns given by the contract.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
HINTS = ("passw", "secret", "token", "apikey", "api_key")

IDENTIFIER = re.compile(
    r"""\b(?:client_?id|user(?:name)?|login|account|access_?key_?id)["']?\x20{0,3}[:=]\x20{0,3}["']?([A-Za-z0-9@._-]{3,128})""",
    re.I | re.A,
)
BARE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
ENDPOINT = re.compile(
    r"(?:(?:https?|jdbc|postgres|postgresql|mysql|mongodb|redis|amqp|ftp|s3)(?::[a-z]+)?://[^\s\"'<>]+"
    r"|\b[a-z0-9-]{1,63}(?:\.[a-z0-9-]{1,63}){1,8}:\d{2,5}\b)",
    re.A,
)
BLANK = re.compile(r"\n[\x20\t\r]*\n")


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that are long enough."""
    out: list[Span] = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], ORDER[s[2]]))


def entropy(token: str) -> float:
    return -sum(n / len(token) * math.log2(n / len(token)) for n in Counter(token).values())


class _Intervals:
    """Disjoint intervals in order, asked for the distance to the nearest one."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts = [a for a, _ in spans]
        self.ends: list[int] = []
        for _, b in spans:  # running maximum: spans of several kinds may overlap
            self.ends.append(max(b, self.ends[-1]) if self.ends else b)

    def near(self, start: int, end: int, low: int, high: int) -> bool:
        """Whether one within [low, high) lies at most REACH away without being the interval itself."""
        i = bisect_right(self.starts, start) - 1
        if i >= 0 and (self.starts[i], self.ends[i]) == (start, end):
            i -= 1
        if i >= 0 and self.starts[i] >= low and start - self.ends[i] <= REACH:
            return True
        j = bisect_left(self.starts, end)
        return j < len(self.starts) and self.starts[j] < high and self.starts[j] - end <= REACH


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """Weak candidates that stand near complementary parts in their scope."""
    covered = _Intervals([(a, b) for a, b, _ in base])

    def free(a: int, b: int) -> bool:
        i = bisect_left(covered.starts, b) - 1
        return i < 0 or covered.ends[i] <= a

    secrets, identifiers, endpoints = [], [], []
    if "=" in text or ":" in text:
        identifiers = [m.span() for m in IDENTIFIER.finditer(text) if free(*m.span())]
    if ":" in text:
        endpoints = [m.span() for m in ENDPOINT.finditer(text) if free(*m.span())]
    strong_ids = [(a, b) for a, b, k in base if k == "access"]
    if not (identifiers or endpoints or strong_ids):
        return []
    taken = _Intervals(sorted(identifiers + endpoints))
    for m in BARE.finditer(text):
        a, b = m.span()
        i = bisect_left(taken.starts, b) - 1
        if not free(a, b) or (i >= 0 and taken.ends[i] > a):
            continue
        token = m[0]
        mixed = any(c.isdigit() for c in token) and any(c.isupper() for c in token) and any(c.islower() for c in token)
        if mixed and entropy(token) >= ENTROPY:
            secrets.append((a, b))
    ids = _Intervals(sorted(identifiers + strong_ids))
    keys = _Intervals(sorted(secrets + [(a, b) for a, b, k in base if k != "access"]))
    hosts = _Intervals(endpoints)
    breaks = [m.start() for m in BLANK.finditer(text)]

    def scope(a: int) -> tuple[int, int]:
        i = bisect_right(breaks, a)
        return breaks[i - 1] if i else 0, breaks[i] if i < len(breaks) else len(text)

    out = [(a, b, "secret") for a, b in secrets if ids.near(a, b, *scope(a)) or hosts.near(a, b, *scope(a))]
    out += [(a, b, "identifier") for a, b in identifiers if keys.near(a, b, *scope(a))]
    out += [(a, b, "endpoint") for a, b in endpoints if keys.near(a, b, *scope(a))]
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], ORDER[s[2]], s[1])))


OUT = pa.schema(
    [("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_assign", "n_access", "n_hex"))]
    + [("base_sha256", pa.string()), ("spans", pa.string())]
)
DDL = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Counts and spans (code points, end exclusive) of every row's whole text.

    Null and empty texts have no spans (an empty ``spans``, the SHA-256 of
    nothing); ids may be null or repeated; an empty table gives no rows; columns
    other than ``doc_id`` and ``text`` are not read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                n = Counter(k for _, _, k in base)
                row = (n["assign"], n["access"], n["hex"], hashlib.sha256(joined(base).encode()).hexdigest(),
                       joined(base + linked_spans(text or "", base)))
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(OUT)[1:], strict=True))], schema=OUT
            )

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, DDL)
