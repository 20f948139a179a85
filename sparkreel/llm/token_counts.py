"""Token counts: the exact number of BPE tokens of every prefix of a text.

Method: prefix dynamic programming. Within one pre-token, the last token of
each prefix is the only vocabulary entry ending there that the merges keep
apart from the last token before it, so one pass from left to right gives the
count at every prefix. Counts of a text are those of its pre-tokens added up,
with the few prefixes set right whose own split differs from the text's (a
prefix that ends inside a run of white space or inside a special token).
The table makes truncation and budget questions lookups.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .shared import Idle, small_batches, with_fields

#: Pre-tokens that a worker remembers before it starts afresh.
MEMORY = 1_200_000
_PAIR_MEMORY = 2_000_000
_open: dict[str, PrefixCounter] = {}


def _byte_letters() -> list[str]:
    """The printable letter that the byte-level vocabulary writes for each byte: printable Latin-1 as it is, others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class PrefixCounter:
    """Counts for one byte-level BPE vocabulary file of the ``tokenizers`` library."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        self.path = path
        with open(path) as f:
            spec = json.load(f)
        if spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level vocabularies without normalizer and prefix space")
        self.model = Tokenizer.from_file(path).model
        self.letters = _byte_letters()
        back = {c: b for b, c in enumerate(self.letters)}
        special = [t["content"] for t in spec["added_tokens"]]
        self.ids = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.longest = max(map(len, self.ids))
        self.own = {t: len(self.model.tokenize(self.as_letters(t))) == 1 for t in self.ids if len(t) > 1}
        self.pattern = regex.compile(pattern)
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.special_len = {t: len(t) for t in special}
        self.known: dict[str, tuple[int, bytes]] = {}
        self.apart: dict[tuple[bytes, bytes], bool] = {}
        self.row: tuple[bytes, list[bytes], list[int]] = (b"", [b""], [0])
        self.idle = Idle(self.forget)

    def forget(self) -> None:
        self.known.clear()
        self.apart.clear()
        self.row = b"", [b""], [0]

    def as_letters(self, raw: bytes) -> str:
        return "".join(map(self.letters.__getitem__, raw))

    def keeps_apart(self, a: bytes, b: bytes) -> bool:
        """Whether the merges turn a + b into the tokens a and b."""
        if len(self.apart) > _PAIR_MEMORY:
            self.apart.clear()
        got = self.model.tokenize(self.as_letters(a + b))
        out = self.apart[a, b] = len(got) == 2 and got[0].id == self.ids[a]
        return out

    def piece(self, text: str) -> tuple[int, bytes]:
        """(tokens, their change at each character) of a pre-token; the changes fit a signed byte as no token has over 127 parts."""
        parts = self.pattern.findall(text[:-1]) if text[:1] == "'" and len(text) > 2 else ()
        if len(parts) > 1:  # a contraction: its prefixes split in other places
            counts = [sum(self.piece(p)[0] for p in self.pattern.findall(text[:j])) for j in range(1, len(text))]
            counts.append(self.by_bytes(text.encode())[-1])
        else:
            raw = text.encode()
            counts = self.by_bytes(raw)
            if len(raw) != len(text):  # the last byte of a character: none that goes on it follows
                counts = [n for n, x in zip(counts, [*raw[1:], 0]) if x & 0xC0 != 0x80]
        return counts[-1], bytes([b - a & 255 for a, b in zip([0, *counts], counts)])

    def by_bytes(self, raw: bytes) -> list[int]:
        """Tokens of each prefix of one pre-token, by byte. What it shares with the one before it is kept from there."""
        ids, apart, own, longest = self.ids, self.apart, self.own, self.longest
        before, last, count = self.row
        n = 0
        for a, b in zip(before, raw):
            if a != b:
                break
            n += 1
        del last[n + 1 :], count[n + 1 :]
        for i in range(n + 1, len(raw) + 1):
            for j in range(max(0, i - longest), i):
                t = raw[j:i]
                if t not in ids:
                    continue
                if j == 0:
                    if i > 1 and not own[t]:
                        continue
                else:
                    ok = apart.get((last[j], t))
                    if ok is None:
                        ok = self.keeps_apart(last[j], t)
                    if not ok:
                        continue
                last.append(t)
                count.append(count[j] + 1)
                break
        self.row = raw, last, count
        return count[1:]

    def learn(self, lists: list[list[str]]) -> None:
        """Remember the pre-tokens that are new, in order, so that neighbours share what they begin with."""
        known = self.known
        if len(known) > MEMORY:
            known.clear()
        for p in sorted(set().union(*lists).difference(known)):
            known[p] = self.piece(p)

    def plain(self, text: str, pieces: list[str] | None = None) -> tuple[int, bytes, str]:
        """(tokens, changes, last pre-token) of a text without special tokens."""
        if pieces is None:
            pieces = self.pattern.findall(text)
            self.learn([pieces])
        found = list(map(self.known.__getitem__, pieces))
        changes = b"".join([x[1] for x in found])
        if _BLANKS.search(text):
            changes = self.in_blanks(pieces, found, changes)
        return sum([x[0] for x in found]), changes, pieces[-1] if pieces else ""

    def in_blanks(self, pieces, found, changes: bytes) -> bytes:
        """A prefix that ends with the first character of a pre-token, white space after white space, has both in one pre-token."""
        out = np.frombuffer(changes, np.int8).copy()
        at = 0
        for k, p in enumerate(pieces):
            if k and p[0].isspace() and pieces[k - 1].isspace():
                shift = self.piece(pieces[k - 1] + p[0])[0] - found[k - 1][0] - int(out[at])
                out[at] += shift
                if at + 1 < len(out):
                    out[at + 1] -= shift
            at += len(p)
        return out.tobytes()

    def batch(self, texts: list[str]) -> list[tuple[int, bytes]]:
        """``counts`` of each text."""
        special = [self.special is not None and "<" in t and bool(self.special.search(t)) for t in texts]
        pieces = [[] if odd else self.pattern.findall(t) for t, odd in zip(texts, special)]
        self.learn(pieces)
        out = [(0, b"") if odd else self.plain(t, p)[:2] for t, p, odd in zip(texts, pieces, special)]
        return [self.counts(t) if odd else x for t, x, odd in zip(texts, out, special)]

    def counts(self, text: str) -> tuple[int, bytes]:
        """(tokens, change of the count at each character) of a whole text."""
        if self.special is None or "<" not in text or not self.special.search(text):
            return self.plain(text)[:2]
        total, changes, at = 0, b"", 0
        for m in self.special.finditer(text):
            n, change, last = self.plain(text[at : m.start()])
            base = n - (self.plain(last)[0] if last else 0)
            inside = [base + self.plain(last + m[0][:j])[0] for j in range(1, len(m[0]))]
            changes += change + np.diff(np.array([n, *inside, n + 1])).astype(np.int8).tobytes()
            total, at = total + n + 1, m.end()
        n, change, _ = self.plain(text[at:])
        return total + n, changes + change


_BLANKS = regex.compile(r"\s\s")


def counter(path: str, pattern: str) -> PrefixCounter:
    """The worker's counter: it and what it remembers serve all tasks of a worker process."""
    if path not in _open:
        _open[path] = PrefixCounter(path, pattern)
    return _open[path]


def prefix_token_counts(df: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``n_tokens`` and ``changes``: byte i of it, signed, is what character i adds to the token count.

    One row per input row. Null and empty texts have 0 tokens and no changes; repeated rows stay; other columns,
    whatever their names, are not read. ``path`` must exist on every executor.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with counter(path, pattern).idle:
            yield from work(counter(path, pattern), batches)

    def work(c: PrefixCounter, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                got = c.batch([t or "" for t in part.column(len(keep)).to_pylist()])
                cols = [part.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.binary())],
                    [*keep, "n_tokens", "changes"],
                )

    small_batches(df.sparkSession)
    src = df.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))
    return src.mapInArrow(run, with_fields(src.schema[:-1], n_tokens="bigint", changes="binary"))


@F.pandas_udf(LongType())
def _fit(changes: pd.Series, budget: pd.Series) -> pd.Series:
    def one(raw, most):
        ok = np.flatnonzero(np.cumsum(np.frombuffer(raw or b"", np.int8), dtype=np.int64) <= most)
        return int(ok[-1]) + 1 if len(ok) else 0

    return pd.Series([one(*x) for x in zip(changes, budget)], dtype="int64")


@F.pandas_udf(LongType())
def _at(changes: pd.Series, chars: pd.Series) -> pd.Series:
    return pd.Series([int(np.frombuffer(raw or b"", np.int8)[: max(n, 0)].sum(dtype=np.int64)) for raw, n in zip(changes, chars)], dtype="int64")


def longest_prefix(changes: Column, budget: int) -> Column:
    """Characters of the longest prefix with at most ``budget`` tokens, from the table alone."""
    return _fit(changes, F.lit(budget))


def tokens_of_prefix(changes: Column, chars: int) -> Column:
    """Tokens of the prefix with so many characters, from the table alone."""
    return _at(changes, F.lit(chars))
