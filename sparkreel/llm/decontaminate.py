"""Benchmark decontamination by spaced-seed hashing.

Method: a seed is a fixed mask over consecutive words; the positions with 0 are
ignored, so a seed still hits where those words were substituted. The masks
hash every word position of the benchmark and of the documents; equal hashes
join, and each hit is verified on its diagonal: the item and the document side
by side, word against word. A document leaks an item where a stretch of at
least ``WINDOW`` words (the whole item, if it is shorter) agrees in at least
``SHARE`` of its words.

The benchmark side of the join is built block by block of bounded size
(``BLOCK_WORDS``); each block is one pass over the documents, which are never
shuffled. Words are runs of letters, digits and bytes beyond ASCII, A-Z taken
as a-z, so punctuation does not hide a passage.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, with_fields
from .textnum import mix, rounds, words

_U = np.uint64
#: The masks.
MASKS = ("1111", "11011", "110101", "1010011", "1001101")
WINDOW = 13
SHARE = 0.8
#: Items with fewer words are too short to be evidence and match nothing.
LEAST_WORDS = 5
#: Words of the benchmark that one pass holds, on the driver and in each task (about 100 bytes a word).
BLOCK_WORDS = 1 << 20
#: Pairs of runs of seeds that are expanded at once.
PIECE = 1 << 18
_FILTER_BITS = 20
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
LEAK = "array<struct<item_id:bigint,start:bigint,words:bigint,matched:bigint>>"


def seed_hashes(h: np.ndarray, row: np.ndarray, mask: str, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of a mask at each place where its span is inside one row."""
    span = len(mask)
    if len(h) < span:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    n = len(h) - span + 1
    out = np.full(n, _U(salt))
    for j, keep in enumerate(mask):
        if keep == "1":
            out = out * _U(0x9FB21C651E98DF25) + h[j : j + n]
    at = np.flatnonzero(row[:n] == row[span - 1 :])
    return at, out[at] ^ (out[at] >> _U(29))


def _runs(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, first, last) of runs of equal seeds at neighbouring words: a word that is repeated on and on is one run."""
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return s[first], at[first], at[np.append(first[1:], len(s)) - 1] if len(s) else at


@dataclass
class Benchmark:
    """A block of items: hashes of all their words, and for each mask the sorted seeds as runs, and a filter."""

    item_id: np.ndarray
    first: np.ndarray
    h: np.ndarray
    seeds: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, item_id: np.ndarray, counts: np.ndarray, h: np.ndarray) -> Benchmark:
        row = np.repeat(np.arange(len(counts)), counts)
        seeds = []
        for k, mask in enumerate(MASKS):
            at, s = seed_hashes(h, row, mask, k + 1)
            order = np.argsort(s, kind="stable")
            near = np.zeros(1 << _FILTER_BITS, bool)
            near[s >> _U(64 - _FILTER_BITS)] = True
            seeds.append((*_runs(s[order], at[order]), near))
        return cls(item_id, np.concatenate(([0], np.cumsum(counts))), h, seeds)

    def leaks(self, h: np.ndarray, row: np.ndarray, rows: int, window: int, share: float) -> list[list[tuple[int, int, int, int]]]:
        """(item, first word, words, equal words) of the best stretch of each item that leaks, for each row."""
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in range(rows)]
        names = [np.zeros(0, np.int64)]
        span = len(h) + len(self.h) + 1  # a diagonal is a number below this, and one text has rows x items of such
        for k, mask in enumerate(MASKS):
            s, first, last, near = self.seeds[k]
            at, got = seed_hashes(h, row, mask, k + 1)
            maybe = np.flatnonzero(near[got >> _U(64 - _FILTER_BITS)])
            got, i0, i1 = _runs(got[maybe], at[maybe])
            lo, hi = np.searchsorted(s, got), np.searchsorted(s, got, side="right")
            total = np.cumsum(hi - lo)
            cut = [0]  # runs in pieces that meet a bounded number of the benchmark's, each reduced to its diagonals
            while cut[-1] < len(got):
                done = total[cut[-1] - 1] if cut[-1] else 0
                cut.append(max(cut[-1] + 1, int(np.searchsorted(total, done + PIECE, side="right"))))
            for p, q in zip(cut, cut[1:]):
                n = hi[p:q] - lo[p:q]
                x = np.repeat(np.arange(p, q), n)
                y = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[p:q], n)
                # two runs of equal seeds meet on all diagonals from one end to the other
                low, many = i0[x] - last[y], i1[x] - i0[x] + last[y] - first[y] + 1
                which = row[i0[x]] * len(self.item_id) + np.searchsorted(self.first, first[y], side="right") - 1
                shift = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - low, many)
                names.append(np.unique(np.repeat(which, many) * span + shift + len(self.h)))
        which, shift = np.divmod(np.unique(np.concatenate(names)), span)
        diagonals = np.stack((*np.divmod(which, max(len(self.item_id), 1)), shift - len(self.h)))
        begins = np.searchsorted(row, np.arange(rows + 1))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for r, item, shift in diagonals.T.tolist():
            a, b = int(self.first[item]), int(self.first[item + 1])
            lo, hi = max(a + shift, int(begins[r])), min(b + shift, int(begins[r + 1]))
            w = min(window, b - a)
            if hi - lo < w or b - a < LEAST_WORDS or best.get((r, item), (0,))[0] >= hi - lo:
                continue  # no room, or a stretch with as many equal words as this diagonal can have is known
            same = np.concatenate(([0], np.cumsum(h[lo:hi] == self.h[lo - shift : hi - shift])))
            over = same - share * np.arange(len(same))  # a stretch agrees enough where this does not fall over it
            low = np.minimum.accumulate(over)[: len(over) - w]
            gain = over[w:] - low
            if gain.max() < -1e-9:
                continue
            e = int(np.flatnonzero(gain >= -1e-9)[-1]) + w
            s = int(np.argmin(over[: e - w + 1]))
            leak = (int(same[e] - same[s]), lo + s - int(begins[r]), e - s)
            best[r, item] = max(best.get((r, item), leak), leak, key=lambda x: (x[0], -x[1]))
        for (r, item), (matched, s, n) in sorted(best.items()):
            out[r].append((int(self.item_id[item]), s, n, matched))
        return out


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, data, offs in rounds(b.column(1)):
            _, _, row, h = words(data, offs, ALNUM)
            cut = np.searchsorted(row, np.arange(hi - lo + 1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(lo, hi - lo), pa.array(np.diff(cut)), pa.array([h[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary())], ["item_id", "n", "h"],
            )


def benchmark_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[Benchmark]:
    """The benchmark as blocks of about BLOCK_WORDS words. Null texts and ids are left out, repeated rows count once."""
    items = benchmark.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("text")).dropna().distinct()
    hashed = items.mapInArrow(_item_words, "item_id bigint, n bigint, h binary").filter(F.col("n") >= LEAST_WORDS)
    total = hashed.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-2 * total // BLOCK_WORDS))
    for k in range(blocks):
        got = hashed.filter(F.pmod(F.xxhash64("item_id", "h"), F.lit(blocks)) == k).toArrow().sort_by([("item_id", "ascending"), ("n", "ascending")])
        raw = b"".join(got.column("h").to_pylist())
        yield Benchmark.of(got.column("item_id").to_numpy(), got.column("n").to_numpy(), np.frombuffer(raw, _U))


def _leaks(block: Benchmark, text_at: int, names: list[str], kind: pa.DataType, window: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in rounds(b.column(text_at)):
                _, _, row, h = words(data, offs, ALNUM)
                got = block.leaks(h, row, hi - lo, window, share)
                rows = [[dict(zip(("item_id", "start", "words", "matched"), x)) for x in r] for r in got]
                cols = [b.column(i).slice(lo, hi - lo) for i in range(b.num_columns)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(rows, kind)], [*names, "__leaks"])

    return run


def leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """``df`` with ``leaks``: array<struct<item_id, start, words, matched>>, the items that the text leaks.

    ``start`` and ``words`` give the stretch in words of the document, ``matched`` its words that agree. One row
    per input row with all its columns; null and empty texts leak nothing; with an empty benchmark nothing does. Raises
    ValueError where ``df`` has a column ``leaks`` already. Of stretches of an item with equally many equal words the first counts.
    """
    if "leaks" in df.columns:
        raise ValueError("df has a column leaks already")
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("item_id", "start", "words", "matched")]))
    small_batches(df.sparkSession)
    out = df.withColumn("leaks", F.array().cast(LEAK))
    names = out.columns
    schema = with_fields(out.schema, __leaks=LEAK)
    for block in benchmark_blocks(benchmark):
        found = out.mapInArrow(_leaks(block, names.index(text), names, kind, window, share), schema)
        out = found.withColumn("leaks", F.concat("leaks", "__leaks")).drop("__leaks")
    return out
