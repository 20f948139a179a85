"""Secret scans: patterns for single credentials, and multipart credentials linked within scopes.

Method: a credential of several parts (an access identifier, its secret, the
endpoint it belongs to) is found by interval joins inside scopes. A scope is a
block of lines without a blank line between them; parts of kind ``access``, ``endpoint`` and ``weak`` (a
token that looks random but that nothing names as a secret) are intervals in
it. A weak candidate is reported, as ``linked``, only where an access
identifier or an endpoint stands in the same scope, and an endpoint,
as ``endpoint``, only where it completes a reported part. The join is a merge
of intervals sorted by position, so its cost is linear in the intervals and no
pairs are made; scopes never leave their document, so no rows are shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, with_fields

#: The kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "linked", "endpoint")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_WEAK = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_ENDPOINT = re.compile(r"\b(?:https?|ftp|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]+", re.ASCII)
_BLANK = re.compile(r"\n[ \t\r]*\n")


def _random(token: str) -> bool:
    """Whether a token mixes digits with both cases of letters, as keys do and words and paths do not."""
    return any(c.isdigit() for c in token) and any("a" <= c <= "z" for c in token) and any("A" <= c <= "Z" for c in token) and len(set(token)) >= 12


def _base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the single credentials."""
    out = []
    low = text.lower()
    if any(x in low for x in ("passw", "secret", "token", "key")):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans by start, those that overlap as one, so that a neighbour is also the nearest."""
    out: list[tuple[int, int, int]] = []
    for s, k, e in sorted(spans):
        if out and s < out[-1][2]:
            out[-1] = (out[-1][0], out[-1][1], max(e, out[-1][2]))
        else:
            out.append((s, k, e))
    return out


def _near(span: tuple[int, int, int], others: list[tuple[int, int, int]], scope: dict[int, int], most: int | None) -> bool:
    """Whether one of ``others``, sorted and apart from each other, is in the span's scope and, where ``most`` is given, so near."""
    at = bisect_left(others, (span[0],))
    for o in others[max(0, at - 1) : at + 1]:
        if o[0] != span[0] and scope[o[0]] == scope[span[0]] and (most is None or max(o[0] - span[2], span[0] - o[2]) <= most):
            return True
    return False


def _linked(text: str, base: list[tuple[int, int, int]], reach: int | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the parts that only the complementary parts near them make credible."""
    access = [s for s in base if s[1] == 1]
    ends = [(m.start(), 4, m.end()) for m in _ENDPOINT.finditer(text)] if "://" in text else []
    if not access and not ends:
        return []
    taken = sorted((s, e) for s, _, e in [*base, *ends])
    reached = list(accumulate((e for _, e in taken), max))  # how far the spans that start before reach
    weak = []
    for m in _WEAK.finditer(text):
        at = bisect_left(taken, (m.end(),))
        if not (at and reached[at - 1] > m.start()) and _random(m[0]):
            weak.append((m.start(), 3, m.end()))
    cuts = [m.start() for m in _BLANK.finditer(text)]
    scope = {s[0]: bisect_left(cuts, s[0]) for s in [*base, *weak, *ends]}
    weak = [s for s in weak if _near(s, access, scope, reach) or _near(s, ends, scope, reach)]
    strong = _merged([*access, *(s for s in base if s[1] == 0), *weak])
    return weak + [s for s in ends if _near(s, strong, scope, reach)]


def _render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _masked(t: str | None, found: list[dict] | None, mask: str) -> str | None:
    """A text with each span replaced; overlapping spans become one."""
    if not found:
        return t
    out, end = [], 0
    for s in sorted(found, key=lambda s: s["start"]):
        if s["start"] >= end:
            out += [t[end : s["start"]], mask]
        end = max(end, s["end"])
    return "".join([*out, t[end:]])


def scan_secrets(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), reach: int | None = None, mask: str | None = None) -> DataFrame:
    """``keep`` columns, ``base`` and ``spans``: arrays of struct<kind, start, end>, by start and then kind.

    Offsets are code points, ends exclusive. ``base`` has the kinds assign, access and hex, ``spans`` also the
    linked parts, which may be anywhere in their scope or, where ``reach`` is given, so many characters apart. One row per input row, repeated rows included; null and empty texts have no spans; columns
    not kept are not read.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    names = [*keep, "base", "spans", *["masked"] * (mask is not None)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                base, every = [], []
                texts = part.column(len(keep)).to_pylist()
                for t in texts:
                    found = _base(t or "")
                    base.append(row(found))
                    every.append(row(sorted(found + _linked(t or "", found, reach))))
                cols = [part.column(i) for i in range(len(keep))]
                cols += [pa.array(base, kind), pa.array(every, kind)]
                if mask is not None:
                    cols.append(pa.array([_masked(t, s, mask) for t, s in zip(texts, every)], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names)

    small_batches(df.sparkSession)
    src = df.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))
    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    return src.mapInArrow(run, with_fields(src.schema[:-1], base=span, spans=span, **{"masked": "string"} if mask is not None else {}))


def spans_text(spans) -> F.Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(df: DataFrame, text: str = "text", spans: str = "spans", mask: str = "[secret]") -> DataFrame:
    """``df`` with each span of ``text`` replaced by ``mask``; overlapping spans become one. One pass over each text."""
    at, marks = df.columns.index(text), df.columns.index(spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                new = [_masked(t, s, mask) for t, s in zip(part.column(at).to_pylist(), part.column(marks).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else c for i, c in enumerate(part.columns)], part.schema.names)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, df.schema)
