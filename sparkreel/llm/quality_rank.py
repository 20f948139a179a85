"""Quality classifier: Bradley-Terry pairwise ranking.

Method: each document has a strength w.x, linear in its features; the chance
that document i is preferred to j is sigmoid(w.(x_i - x_j)). The weights
minimise the logistic loss of feature differences over all preference pairs (a
document labelled 1 against one labelled 0) of all labelled documents. The cut
is a quantile of the training strengths: the share of label 0 among them. Strengths map to scores
in (0, 1) so that the cut has score ``CUT_SCORE``.

Features are the square roots of the shares of pairs of neighbouring byte
classes and of class runs, so they tell how a text is written in any language.
Only the text is read for them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, small_batches, staged, with_fields
from .suffix_dedup import BROADCAST_IDS
from .textnum import rounds

#: The score at the cut between accepted and rejected documents.
CUT_SCORE = 0.7
#: Width of the cells of strengths in which rows meet the other label's, and the least relative gain of a step that leads to another.
CELL = 1 / 16
GAIN = 1e-4

#: Byte classes. Punctuation marks that have a class of their own.
_OWN = "!#$%&*|.,-_=+/\\:;?<>()[]{}\"'@~^`"


def _classes() -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[:32] = 1
    out[[10, 13]] = 2
    out[[9, 32]] = 3
    out[48:58] = 4
    out[65:91] = 5
    out[97:123] = 6
    out[128:] = 7
    for k, c in enumerate(_OWN):
        out[ord(c)] = 8 + k
    return out


CLASS = _classes()
N_CLASSES = int(CLASS.max()) + 1
N_FEATURES = N_CLASSES * N_CLASSES + N_CLASSES + 4


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of N_FEATURES for each text of a round; an empty text has zeros but for the length."""
    rows = len(offs) - 1
    size = np.diff(offs)
    cls = CLASS[data]
    row = np.repeat(np.arange(rows), size)
    one = np.bincount(row * N_CLASSES + cls, minlength=rows * N_CLASSES).reshape(rows, N_CLASSES)
    inner = np.flatnonzero(row[1:] == row[:-1])
    pair = cls[:-1][inner] * N_CLASSES + cls[1:][inner]
    two = np.bincount(row[inner] * N_CLASSES**2 + pair, minlength=rows * N_CLASSES**2).reshape(rows, N_CLASSES**2)
    n = np.maximum(size, 1)[:, None]
    blank = one[:, 2] + one[:, 3]
    word = np.maximum(size - blank, 0) / np.maximum(blank + 1, 1)
    return np.hstack((
        np.sqrt(two / n),
        np.sqrt(one / n),
        np.log1p(size)[:, None] / 12,
        np.minimum(word, 40)[:, None] / 40,
        (one > 0).sum(1)[:, None] / N_CLASSES,
        np.sqrt(one[:, 2:3] / n),
    ))


@dataclass
class Ranking:
    """Weights of a fitted ranking; ``cut`` is the strength at CUT_SCORE and ``slope`` the steepness of scores there."""

    weights: np.ndarray
    cut: float
    slope: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.strength(x) - self.cut) + np.log(CUT_SCORE / (1 - CUT_SCORE))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


#: Labels, numbers of features that are not 0, and those features, of some rows.
_BLOCK = "y binary, size binary, at binary, x binary"
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _block(x: np.ndarray, label: np.ndarray) -> Block:
    row, at = np.nonzero(x)
    return label.astype(np.int8), np.bincount(row, minlength=len(x)).astype(np.int32), at.astype(np.uint16), x[row, at].astype(np.float32)


def _each(rows: DataFrame | list[Block], work: Callable[[Iterator[Block]], tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
    """What ``work`` makes, as doubles, of each partition's blocks, in the order of partitions."""
    if isinstance(rows, list):
        return [work(iter(rows))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (np.int8, np.int32, np.uint16, np.float32)
        blocks = (tuple(np.frombuffer(c[i].as_buffer(), k) for c, k in zip(b.columns, kinds)) for b in batches for i in range(b.num_rows))
        made = [v.astype(np.float64).tobytes() for v in work(blocks)]
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.list_(pa.binary()))], ["made"])

    return [tuple(np.frombuffer(v, np.float64) for v in r["made"]) for r in rows.mapInArrow(run, "made array<binary>").collect()]


def _moments(n: int):
    """Sums and sums of squares of features, and rows of labels 0 and 1."""

    def work(blocks: Iterator[Block]) -> tuple[np.ndarray, ...]:
        one, two, count = np.zeros(n), np.zeros(n), np.zeros(2)
        for y, _, at, x in blocks:
            x = x.astype(np.float64)
            one += np.bincount(at, x, n)
            two += np.bincount(at, x * x, n)
            count += np.bincount(y, minlength=2)[:2]
        return one, two, count

    return work


def _strengths(block: Block, w: np.ndarray) -> np.ndarray:
    _, size, at, x = block
    return np.bincount(np.repeat(np.arange(len(size)), size), x * w[at], len(size))


def _spread(w: np.ndarray, cell: float):
    """(cell, rows of label 0, rows of label 1) of strengths on a grid. A row is shared by the cells on its two sides, by nearness."""

    def work(blocks: Iterator[Block]) -> tuple[np.ndarray, ...]:
        seen: dict[int, np.ndarray] = {}
        for b in blocks:
            s = _strengths(b, w) / cell
            low = np.floor(s)
            cells, code = np.unique(np.concatenate((low, low + 1)), return_inverse=True)
            share = np.concatenate((low + 1 - s, s - low))
            counts = np.stack([np.bincount(code, share * np.tile(b[0] == k, 2), len(cells)) for k in (0, 1)], 1)
            for c, n in zip(cells.astype(int).tolist(), counts):
                seen[c] = seen.get(c, 0) + n
        keys = sorted(seen)
        return (np.array(keys), *np.array([seen[k] for k in keys]).reshape(-1, 2).T)

    return work


def _pulled(w: np.ndarray, cell: float, first: int, pull: np.ndarray):
    """The sum of features, each row's times ``pull`` of its label at its strength."""

    def work(blocks: Iterator[Block]) -> tuple[np.ndarray, ...]:
        out, grid = np.zeros(len(w)), np.arange(first, first + pull.shape[1]) * cell
        for b in blocks:
            s = _strengths(b, w)
            each = np.where(b[0] == 1, np.interp(s, grid, pull[1]), np.interp(s, grid, pull[0]))
            out += np.bincount(b[2], np.repeat(each, b[1]) * b[3], len(w))
        return (out,)

    return work


def _inside(w: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """(strength, rows of label 0, of label 1) of the strengths in [lo, hi) of one of the intervals."""

    def work(blocks: Iterator[Block]) -> tuple[np.ndarray, ...]:
        values, labels = [np.zeros(0)], [np.zeros(0, np.int8)]
        for b in blocks:
            s = _strengths(b, w)
            near = ((s[:, None] >= lo) & (s[:, None] < hi)).any(1)
            values.append(s[near])
            labels.append(b[0][near])
        s, code = np.unique(np.concatenate(values), return_inverse=True)
        return (s, *(np.bincount(code, np.concatenate(labels) == k, len(s)) for k in (0, 1)))

    return work


def _whole(w: np.ndarray, cell: float):
    """(cell, rows of label 0, rows of label 1) of strengths, each row in the cell it lies in."""

    def work(blocks: Iterator[Block]) -> tuple[np.ndarray, ...]:
        seen: Counter[tuple[int, int]] = Counter()
        for b in blocks:
            seen.update(zip(np.floor(_strengths(b, w) / cell).astype(int).tolist(), b[0].tolist()))
        keys = sorted({c for c, _ in seen})
        return tuple(np.array(v, np.float64) for v in (keys, [seen[c, 0] for c in keys], [seen[c, 1] for c in keys]))

    return work


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """(values, rows of labels 0 and 1) of all partitions together."""
    at, code = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return at, np.stack([np.bincount(code, np.concatenate([p[k] for p in parts]), len(at)) for k in (1, 2)])


def _ranked(rows: DataFrame | list[Block], w: np.ndarray, wanted: list[tuple[tuple[int, ...], int]]) -> list[float]:
    """Exact order statistics: the strength of each (labels, rank from 0). Only rows of the cells with those ranks are looked at one by one."""
    at, counts = _summed(_each(rows, _whole(w, CELL)))
    below = [np.cumsum(counts[list(k)].sum(0)) for k, _ in wanted]
    cells = [int(np.searchsorted(n, r, side="right")) for n, (_, r) in zip(below, wanted)]
    # cells are told apart by floor(strength / CELL), so a little more on both sides is read and cut by the same rule
    values, rows_of = _summed(_each(rows, _inside(w, (at[cells] - 0.01) * CELL, (at[cells] + 1.01) * CELL)))
    cell_of = np.floor(values / CELL)
    out = []
    for (kinds, rank), n, c in zip(wanted, below, cells):
        mine = cell_of == at[c]
        before = n[c - 1] if c else 0
        out.append(float(values[mine][np.searchsorted(before + np.cumsum(rows_of[list(kinds)][:, mine].sum(0)), rank, side="right")]))
    return out


def fit_rows(rows: DataFrame | list[Block], n: int, l2: float = 1e-4, steps: int = 300) -> Ranking:
    """Bradley-Terry over all pairs of a row labelled 1 and one labelled 0, by L-BFGS; each step is two passes over all rows.

    What a row meets on the other side depends on the strengths there alone, so one pass counts them on a grid of
    ``CELL`` and the next sums the features; no pair is made. Without both labels nothing can be compared: every score
    is then CUT_SCORE. The cut and the medians are exact order statistics of all rows.
    """
    parts = _each(rows, _moments(n)) or [(np.zeros(n), np.zeros(n), np.zeros(2))]
    one, two, count = (sum(v) for v in zip(*parts))
    if not count.all():
        return Ranking(np.zeros(n), 0.0, 1.0)
    total = count.sum()
    scale = np.maximum(np.sqrt(np.maximum(two / total - (one / total) ** 2, 0)), 1e-3)

    def spread(w: np.ndarray) -> tuple[float, tuple]:
        """The loss, and what the pass for its gradient needs."""
        at, counts = _summed(_each(rows, _spread(w / scale, CELL)))
        first, length = int(at[0]), int(at[-1] - at[0]) + 1
        grid = np.zeros((2, length))
        grid[:, (at - at[0]).astype(int)] = counts
        apart = np.arange(-length + 1, length) * CELL  # from a row of label 0 up to one of label 1
        met = _convolved(grid[0], np.logaddexp(0, -apart))
        wrong = 1 / (1 + np.exp(np.clip(apart, -500, 500)))
        pull = np.stack((_convolved(grid[1], wrong[::-1]), -_convolved(grid[0], wrong))) / count.prod()
        return float(met @ grid[1] / count.prod() + l2 / 2 * w @ w), (first, pull)

    def gradient(w: np.ndarray, first: int, pull: np.ndarray) -> np.ndarray:
        return sum(p[0] for p in _each(rows, _pulled(w / scale, CELL, first, pull))) / scale + l2 * w

    w = np.zeros(n)
    loss, seen = spread(w)
    g = gradient(w, *seen)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d = -_curved(g, past)
        step = 1.0 if past else 1 / max(np.sqrt(g @ g), 1e-12)
        for _ in range(30):
            new = w + step * d
            new_loss, seen = spread(new)
            if new_loss <= loss + 1e-4 * step * (g @ d):
                break
            step /= 2
        else:
            break
        new_g = gradient(new, *seen)
        past = [*past, (new - w, new_g - g)][-10:] if (new - w) @ (new_g - g) > 0 else past
        done = loss - new_loss < GAIN * loss
        w, g, loss = new, new_g, new_loss
        if done:
            break
    w = w / scale
    n0, n1 = int(count[0]), int(count[1])
    k = min(n0, n0 + n1 - 1)  # the quantile: as many strengths below the cut as labels 0
    middle = lambda label, m: [((label,), (m - 1) // 2), ((label,), m // 2)]
    below, above, *mid = _ranked(rows, w, [((0, 1), k - 1), ((0, 1), k), *middle(0, n0), *middle(1, n1)])
    apart = max((mid[2] + mid[3] - mid[0] - mid[1]) / 2, 1e-6)
    return Ranking(w, (below + above) / 2, 8.0 / apart)


def _convolved(count: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """At each place i the sum over j of count[j] * kernel[i - j], where kernel's middle is 0."""
    n = len(count)
    size = 1 << int(3 * n).bit_length()
    return np.fft.irfft(np.fft.rfft(count, size) * np.fft.rfft(kernel, size), size)[n - 1 : 2 * n - 1]


def _curved(g: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The gradient times the inverse curvature that past steps showed (L-BFGS)."""
    q, used = g.copy(), []
    for s, y in reversed(past):
        a = (s @ q) / (s @ y)
        q -= a * y
        used.append(a)
    if past:
        s, y = past[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(past, reversed(used)):
        q += (a - (y @ q) / (s @ y)) * s
    return q


def fit_pairs(x: np.ndarray, label: np.ndarray, l2: float = 1e-4, steps: int = 300) -> Ranking:
    """``fit_rows`` of rows in memory."""
    return fit_rows([_block(x, label)], x.shape[1], l2, steps)


def labelled_features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels and features of every labelled document (doc_id, text) x (doc_id, quality), as blocks of rows.

    A document with several labels has the least; null labels and ids, and labels other than 0 and 1, are left out.
    """
    chosen = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label = b.column(1).to_numpy()
            for lo, hi, data, offs in rounds(b.column(0), 1024):
                made = _block(features(data, offs), label[lo:hi])
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in made], ["y", "size", "at", "x"])

    small_batches(docs.sparkSession)
    few = chosen.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    found = docs.select("doc_id", "text").join(F.broadcast(chosen) if few else chosen, "doc_id")
    return found.select("text", "y").mapInArrow(run, _BLOCK)


def fit(docs: DataFrame, labels: DataFrame) -> Ranking:
    """Fit on every labelled document. Features are staged once; the driver holds sums of N_FEATURES numbers and grids of strengths."""
    rows = staged(labelled_features(docs, labels), "features")
    ranking = fit_rows(rows, N_FEATURES)
    dropped(rows)
    return ranking


def score(df: DataFrame, ranking: Ranking, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``score`` of the whole text: in (0, 1), higher is likelier good.

    One row per input row; null texts count as empty and have the score of an empty text; repeated rows stay;
    columns not kept are not read, labels and sources never.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in rounds(b.column(len(keep)), 1024):
                s = ranking.score(features(data, offs))
                cols = [b.column(i).slice(lo, hi - lo) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(s)], [*keep, "score"])

    small_batches(df.sparkSession)
    src = df.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))
    return src.mapInArrow(run, with_fields(src.schema[:-1], score="double"))
