"""Secret scans with multipart credential linking.

Plain patterns find base secrets. Weaker parts (an access identifier, a secret
without a telling name, an endpoint) say little alone. They are joined by
interval: a secret's scope reaches ``REACH`` characters to either side within its
paragraph, and only where a complementary identifier lies in that scope are the
weak parts reported, with the endpoints there. Scopes never leave a document,
so the join is row-local.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base patterns and the least length of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs, as they cannot overlap
MIN_ASSIGN, MIN_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "weak_access", "weak_secret", "endpoint")
REACH = 400

_HINTS = ("passw", "secret", "token", "apikey", "api_key")
_WEAK_ID = re.compile(
    r"""(?<![A-Za-z0-9])(?<!secret_)(?:access_?key(?:_?id)?|client_?id|user(?:_?name)?|login|account(?:_?(?:id|name))?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})""",
    re.I | re.A,
)
_WEAK_SECRET = re.compile(
    r"""(?<![A-Za-z0-9])(?:pass|pwd|passwd|password|secret|secret_?(?:access_?)?key|client_?secret|account_?key|auth|private_?key|signature|token)["']?\x20*[:=]\x20*["']?([^\s"',;]{6,})""",
    re.I | re.A,
)
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(
    r"""\b[a-z][a-z0-9+]+://[^\s"'<>]+|\b\d{1,3}(?:\.\d{1,3}){3}(?::\d{1,5})?\b|(?<![A-Za-z0-9])(?:host|endpoint|server|url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+(?::\d{1,5})?""",
    re.I | re.A,
)
_BREAK = re.compile(r"\n[\x20\t]*\n")


class Span(NamedTuple):
    """A found span in code points, its end exclusive."""

    start: int
    rank: int
    end: int

    def __str__(self) -> str:
        return f"{KINDS[self.rank]}:{self.start}:{self.end}"


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base kind, less those that are too short."""
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [Span(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [Span(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [Span(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _free(found: Iterable[Span], taken: list[Span]) -> list[Span]:
    """Spans of ``found`` that overlap none of ``taken`` or of those before them."""
    starts = sorted(taken)
    furthest = list(accumulate((t.end for t in starts), max))
    out: list[Span] = []
    for s in sorted(found):
        at = bisect_left(starts, Span(s.end, -1, 0))
        if (not at or furthest[at - 1] <= s.start) and (not out or out[-1].end <= s.start):
            out.append(s)
    return out


def linked_spans(text: str, base: list[Span], reach: int = REACH) -> list[Span]:
    """Weak parts that a complementary part in scope confirms; none overlaps a base span."""
    ids = _free((Span(m.start(), 3, m.end()) for m in _WEAK_ID.finditer(text)), base) if "=" in text or ":" in text else []
    strong_ids = [s for s in base if s.rank == 1]
    if not ids and not strong_ids:
        return []
    named = (Span(m.start(), 4, m.end()) for m in _WEAK_SECRET.finditer(text))
    opaque = (Span(m.start(), 4, m.end()) for m in _OPAQUE.finditer(text))
    secrets = _free([*named, *opaque], [*base, *ids])
    strong_secrets = [s for s in base if s.rank in (0, 2)]
    if not secrets and not strong_secrets:
        return []
    ends = _free((Span(m.start(), 5, m.end()) for m in _ENDPOINT.finditer(text)), [*base, *ids, *secrets])
    breaks = [m.start() for m in _BREAK.finditer(text)]
    identifiers = sorted([*ids, *strong_ids])
    confirmed: set[Span] = set()
    for secret in [*secrets, *strong_secrets]:
        k = bisect_right(breaks, secret.start)
        low = max(secret.start - reach, breaks[k - 1] if k else 0)
        high = min(secret.end + reach, breaks[k] if k < len(breaks) else len(text))
        near = _within(identifiers, low, high)
        if near:
            confirmed |= {secret, *near, *_within(ends, low, high)}
    return sorted(confirmed - set(base))


def _within(spans: list[Span], low: int, high: int) -> list[Span]:
    """Spans that lie in [low, high); ``spans`` is sorted and its members do not overlap much."""
    at = bisect_left(spans, Span(low, -1, 0))
    out = []
    while at < len(spans) and spans[at].start < high:
        if spans[at].end <= high:
            out.append(spans[at])
        at += 1
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row a row of ``docs``: id_col, n_assign, n_access, n_hex, n_linked, base_sha256, spans.

    ``spans`` lists kind:start:end of base and linked spans by start, then kind,
    comma-joined; ``base_sha256`` digests that list of base spans. Null texts are
    empty and have no spans; repeated rows give equal rows. A text of any length is
    scanned whole, in time in proportion to it; other columns are not read.
    """

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for t in b.column(1):
                text = t.as_py() or ""
                base = base_spans(text)
                more = linked_spans(text, base, reach)
                digest = hashlib.sha256(",".join(map(str, base)).encode()).hexdigest()
                values = (*(sum(s.rank == k for s in base) for k in range(3)), len(more), digest, ",".join(map(str, sorted(base + more))))
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            types = (pa.int64(),) * 4 + (pa.string(),) * 2
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, t) for c, t in zip(out, types, strict=True))],
                ["id", "n_assign", "n_access", "n_hex", "n_linked", "base_sha256", "spans"],
            )

    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kept.schema['id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, n_linked long, base_sha256 string, spans string"
    return kept.mapInArrow(rows, schema).withColumnRenamed("id", id_col)
