"""Near-duplicate passages across documents by compact windows.

Method: the tokens are hashes of five-word shingles. For each of ``HASHES`` hash
functions, a compact window (l, c, r) stands for all subsequences between l and
r that hold c, whose least hash is at c. The windows wide enough for a passage
are the nodes of the Cartesian tree over the hashes that span at least
``passage`` words; they are found for a whole batch by sliding minima, cut to the
passage length on either side of c, which loses no subsequence of that length.
Windows with one least hash form a list. In a list:

- a window that equals an earlier document's is an exact repeat and settled at once (most of them before the shuffle);
  of those left, each stretch of ``passage`` words is compared by name, so exact repeats never depend on pairs;
- distinct windows meet where they agree in one more min-hash at least, of the ``SIDE`` tokens before or after c:
  a passage of 46 tokens around c has 22 of them on one side. All pairs of a group of at most ``SMALL`` windows are
  made; a larger one is first split by a second, third and fourth of these min-hashes and, where that does not help, chained;
- windows of larger groups that the passages found so far do not cover whole then meet the windows of larger groups in their
  list with which they share ``similar`` times ``width`` tokens near c: by the tokens that few of them have, and where only
  common ones are shared, by classes of windows with the same common tokens in the same places. Each class is
  represented by its first document. A window meets one after the other, the first documents first, until it is covered;
  partners that could cover nothing of what is still open are passed over. Nothing is dropped for the size of a group.

Of the pairs of two documents, those whose window is not yet covered by exact
repeats remain; overlapping intervals of all hash functions on diagonals near each
other merge, and the merged passages are verified shingle by shingle: a stretch
of at least ``passage`` words with a Jaccard similarity of at least ``similar``.

A passage is marked in the later document. The search for inexact ones is by min-hashes and so
not certain; the tests measure its recall. Exact copies of a whole document are settled by hash.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, staged
from .suffix_dedup import BROADCAST_IDS, _narrow, _repeats
from .textnum import mix, prefix_hash, rounds, shingles, words

_U = np.uint64
K = 5
HASHES = 4
#: Tokens that diagonals may be apart whose intervals merge: a passage that is similar enough holds insertions and deletions.
DRIFT = 24
#: Members that one task compares with a document.
STAR = 256
#: Rows of lists that are paired at once; a longer list is taken whole.
LIST_ROWS = 1 << 16
#: Tokens on either side of a least hash of which min-hashes are taken, and windows of a group of which all pairs are made.
SIDE = 22
SMALL = 12
#: Windows of a large group that may share a token whose pairs are all compared.
RARE = 16
_SALTS = mix(np.arange(1, HASHES + 1, dtype=_U) * _U(0xC2B2AE3D27D4EB4F))
_SIDE_SALTS = mix(np.arange(11, 13, dtype=_U) * _U(0xC2B2AE3D27D4EB4F))


def compact_windows(s: np.ndarray, row: np.ndarray, width: int, salt: np.uint64) -> tuple[np.ndarray, ...]:
    """(l, c, r, hash) of the windows of at least ``width`` tokens; ``row`` is the text of each token."""
    none = np.zeros(0, np.int64)
    if len(s) < width:
        return none, none, none, none.astype(_U)
    h = mix(s ^ salt)
    bits = _U(int(len(s)).bit_length())
    least, have = (h >> bits << bits) | np.arange(len(s), dtype=_U), 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    start = np.flatnonzero(row[: len(least)] == row[width - 1 :])
    c = (least[start] & ((_U(1) << bits) - _U(1))).astype(np.int64)
    new = np.ones(len(c), bool)
    new[1:] = (c[1:] != c[:-1]) | (row[start[1:]] != row[start[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(c)) - 1 if len(c) else first
    return start[first], c[first], start[last] + width - 1, h[c[first]]


def _tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, row, number within its row)."""
    _, _, row, h = words(data, offs)
    at, s = shingles(h, row, K)
    row = row[at]
    first = np.searchsorted(row, np.arange(len(offs)))
    return s, row, np.arange(len(s)) - first[row] if len(s) else at


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, data, offs in rounds(b.column(4)):
            _, _, row, _ = words(data, offs)
            n = np.bincount(row, minlength=hi - lo)
            yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, hi - lo) for i in range(3)), pa.array(n.astype(np.int64))], ["doc_id", "h1", "h2", "n_words"])


def _side_names(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(before, after) each token: two min-hashes of 16 bits, of the SIDE tokens there. Near the ends of the array, 0."""
    before, after = np.zeros(len(s) + 1, np.int64), np.zeros(len(s) + 1, np.int64)
    n = len(s) - SIDE + 1
    for k, salt in enumerate(_SIDE_SALTS if n > 0 else ()):
        least, have = mix(s ^ salt), 1
        while 2 * have <= SIDE:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        least = np.minimum(least[:n], least[SIDE - have : SIDE - have + n]) if have < SIDE else least
        name = (mix(least) & _U(0xFFFF)).astype(np.int64) << 16 * k
        before[SIDE : SIDE + n] |= name
        after[: max(n - 1, 0)] |= name[1:]
    return before[: len(s)], after[: len(s)]


_WINDOW = "key bigint, doc_id bigint, h1 bigint, place bigint, sides bigint, sub bigint"
#: Bit of a key that marks a settled repeat: its row has the diagonal in ``sides`` and the earlier document in ``sub``.
SETTLED = 4
#: ``place``: the place of the least hash, and how far the window reaches on either side.
_REACH = 16
_FAR = (1 << _REACH) - 1


def _lcr(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    c = place >> 2 * _REACH
    return c - ((place >> _REACH) & _FAR), c, c + (place & _FAR)


def _first_of(order: np.ndarray, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(starts, first) of rows in an order that keeps equal keys together: where a class starts, and each row's class's first place."""
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    return new, np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))


def _window_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _WINDOW.split(", ")]
        for b in batches:
            ids, hashes = b.column(0).to_numpy(), b.column(1).to_numpy()
            for lo, hi, data, offs in rounds(b.column(2)):
                s, row, number = _tokens(data, offs)
                p, down = prefix_hash(mix(s))
                part = lambda a, z: (mix((p[z + 1] - p[a]) * down[a] + (z - a).astype(_U)) >> _U(32)).astype(np.int64)
                before, after = _side_names(s)
                doc, h1 = ids[lo:hi], hashes[lo:hi]
                rank = np.empty(hi - lo, np.int64)
                rank[np.lexsort((h1, doc))] = np.arange(hi - lo)
                for j, salt in enumerate(_SALTS):
                    l, c, r, h = compact_windows(s, row, width, salt)
                    owner = row[c]
                    key = (h & ~_U(7) | _U(j)).view(np.int64)
                    place = number[c] << 2 * _REACH | (c - l) << _REACH | (r - c)
                    sides = part(l, c) << 32 | part(c, r)
                    sub = before[c] << 32 | after[c]
                    # equal windows of a round: all but those of its first document are settled here
                    order = np.lexsort((c, rank[owner], sides, key))
                    _, first = _first_of(order, [key, sides])
                    x, y = order[first], order
                    again = owner[x] != owner[y]
                    x, y = x[again], y[again]
                    key[y] = (mix(doc[owner[y]].view(_U) ^ h1[owner[y]].view(_U)) & ~_U(7) | _U(SETTLED)).view(np.int64)
                    sides[y], sub[y] = number[c[y]] - number[c[x]], doc[owner[x]]
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (key, doc[owner], h1[owner], place, sides, sub)], names)

    return run


_PAIR = "x bigint, xh bigint, y bigint, yh bigint, j int, xl int, xr int, yl int, yr int, diagonal int"


#: Marks of rows of ``_pairs`` that are no pairs: a repeated window, and a window whose parts may repeat.
SAME, OPEN = -1, -2
#: Another such mark: a window of a group too large for all its pairs, with the list's key in ``x`` and c in ``diagonal``.
LARGE = -3


def _neighbours(order: np.ndarray, classes: list[np.ndarray], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in an order by class and document, as pairs: the class's first row and the preceding document's last one with each."""
    _, first = _first_of(order, classes)
    _, begin = _first_of(order, [*classes, owner])
    y = np.flatnonzero(begin != first)
    x = np.concatenate((first[y], begin[y] - 1))
    return order[x], order[np.concatenate((y, y))]


def _meetings(key: np.ndarray, owner: np.ndarray, sides: np.ndarray, sub: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (x, y), x before y, of the distinct windows of lists, which come by key and document, and the windows of large groups.

    ``owner`` numbers the documents."""
    n = len(key)
    at = np.arange(n)
    names = [(sub >> 16 * k) & 0xFFFF for k in range(4)]
    found = [(at[:0], at[:0])]
    large = {(): np.ones(n, bool)}  # rows whose group under these names is too large
    for size in range(1, 5):
        for chosen in itertools.combinations(range(4), size):
            rows = at[np.logical_and.reduce([large[c] for c in itertools.combinations(chosen, size - 1)])]
            code = key[rows]
            for k in chosen:
                code = mix(code.view(_U) ^ (names[k][rows].astype(_U) + _U(k << 16))).view(np.int64)
            order = np.argsort(code, kind="stable")
            rows, code = rows[order], code[order]
            cut = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1], [True]))) if len(code) else np.zeros(1, np.int64)
            many = np.repeat(np.diff(cut), np.diff(cut))
            for step in range(1, min(SMALL, len(rows))):
                hit = np.flatnonzero((code[step:] == code[:-step]) & (many[step:] <= SMALL))
                if not len(hit):
                    break
                found.append((rows[hit], rows[hit + step]))
            large[chosen] = np.zeros(n, bool)
            large[chosen][rows[many > SMALL]] = True
    rest = at[large[0, 1, 2, 3]]
    if len(rest):
        left, right = sides[rest] >> 32, sides[rest] & 0xFFFFFFFF
        for classes in ([sub[rest]], [left], [right]):
            order = np.lexsort((rest, *classes, key[rest]))
            x, y = _neighbours(order, [key[rest], *classes], owner[rest])
            found.append((rest[x], rest[y]))
    x, y = (np.concatenate(v) for v in zip(*found))
    x, y = np.divmod(np.unique(x * n + y), n) if n else (x, y)
    apart = owner[x] != owner[y]
    return x[apart], y[apart], np.flatnonzero(np.logical_or.reduce([large[k,] for k in range(4)]))


def _list_pairs(cols: list[np.ndarray]) -> list[np.ndarray]:
    """Whole lists, sorted by key, document and place, as pairs of windows and rows for the exact pass."""
    done = [v[cols[0] & SETTLED != 0] for v in cols]
    key, doc, h1, place, sides, sub = (v[cols[0] & SETTLED == 0] for v in cols)
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))) if len(key) else np.zeros(1, np.int64)
    big = np.repeat(np.diff(cut) > 1, np.diff(cut))
    key, doc, h1, place, sides, sub = (v[big] for v in (key, doc, h1, place, sides, sub))
    l, c, r = _lcr(place)
    owner = np.cumsum(np.concatenate(([True], (doc[1:] != doc[:-1]) | (h1[1:] != h1[:-1]) | (key[1:] != key[:-1])))[: len(key)])
    order = np.lexsort((np.arange(len(key)), sides, key))
    new, first = _first_of(order, [key, sides])
    x = order[first]
    own = owner[x] == owner[order]
    rows = lambda i, j, kind: [doc[i], h1[i], doc[j], h1[j], kind, l[i], r[i], l[j], r[j], c[j] - c[i]]
    mark = lambda n, m: np.full(n, m, np.int64)
    # a window that equals one of an earlier document is settled
    out = [rows(x[~own], order[~own], mark((~own).sum(), SAME))]
    # the others may hold repeats all the same, which show in the lists of one function
    lists = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])))[: len(key)]
    several = np.bincount(lists[order[new]], minlength=int(lists[-1]) + 1) > 1 if len(key) else lists.astype(bool)
    open_ = own & several[lists[order]] & (key[order] & 3 == 0)
    out.append(rows(order[open_], order[open_], mark(open_.sum(), OPEN)))
    one = np.sort(order[new])
    i, j, many = _meetings(key[one], owner[one], sides[one], sub[one])
    i, j, many = one[i], one[j], one[many]
    out.append(rows(i, j, key[j] & 3))
    out.append([key[many], h1[many], doc[many], h1[many], mark(len(many), LARGE), l[many], r[many], l[many], r[many], c[many]])
    a, b, z = _lcr(done[3])
    out.append([done[5], done[2], done[1], done[2], mark(len(a), SAME), a - done[4], z - done[4], a, z, done[4]])
    return [np.concatenate(v).astype(t) for v, t in zip(zip(*out), [np.int64] * 4 + [np.int32] * 6)]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists, sorted by key, document and place, as pairs of windows."""
    names = [f.split()[0] for f in _PAIR.split(", ")]
    held: list[list[np.ndarray]] = []  # of the list that is still open, and small whole ones
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy() for i in range(6)]
        last = int(np.searchsorted(cols[0], cols[0][-1]))  # the last list may go on
        goes_on = last == 0 and (not held or held[-1][0][-1] == cols[0][0])
        held.append(cols)
        size += b.num_rows
        if size < LIST_ROWS or goes_on:
            continue
        cols = [np.concatenate(v) for v in zip(*held)]
        last = int(np.searchsorted(cols[0], cols[0][-1]))
        held, size = [[v[last:] for v in cols]], len(cols[0]) - last
        if last:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in _list_pairs([v[:last] for v in cols])], names)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in _list_pairs([np.concatenate(v) for v in zip(*held)])], names)


def _open_rows(width: int):
    """(name, doc_id, h1, at): each stretch of ``width`` tokens in a document's open windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in rounds(b.column(2)):
                s, row, _ = _tokens(data, offs)
                first = np.searchsorted(row, np.arange(hi - lo))
                windows = b.column(3).slice(lo, hi - lo)
                owner = np.repeat(np.arange(hi - lo), pc.list_value_length(windows).to_numpy())
                flat = windows.flatten()
                l, n = flat.field("l").to_numpy().astype(np.int64), flat.field("r").to_numpy().astype(np.int64)
                n = n - l - width + 2
                at = np.repeat(l - np.cumsum(n) + n, n) + np.arange(n.sum())
                owner = np.repeat(owner, n)
                p, down = prefix_hash(mix(s))
                a = first[owner] + at
                name = mix((p[a + width] - p[a]) * down[a]).view(np.int64)
                rows = pa.array(owner + lo)
                yield pa.RecordBatch.from_arrays([pa.array(name), b.column(0).take(rows), b.column(1).take(rows), pa.array(at.astype(np.int32))], ["name", "doc_id", "h1", "at"])

    return run


_EXACT = "doc_id bigint, h1 bigint, source bigint, diagonal int, start int, stop int"


def _equal(width: int):
    """Stretches, sorted by name, document and place, as repeats of the first document with that name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _EXACT.split(", ")]
        carried = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(i).to_numpy() for i in range(4)]
            if carried is not None:
                cols = [np.concatenate((c, x)) for c, x in zip(carried, cols)]
            name, doc, h1, at = cols
            new = np.ones(len(name), bool)
            new[1:] = name[1:] != name[:-1]
            x = np.maximum.accumulate(np.where(new, np.arange(len(name)), 0))
            carried = [v[x[-1:]] for v in cols]
            y = np.flatnonzero((doc != doc[x]) | (h1 != h1[x]))
            x = x[y]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (doc[y], h1[y], doc[x], at[y] - at[x], at[y], at[y] + np.int32(width))], names)

    return run


_CROWD = "key bigint, doc_id bigint, h1 bigint, l int, c int, r int, open binary, tokens binary"


def _crowd_rows(wide: int):
    """The windows of large groups with their tokens, those within ``wide`` of c; ``open``: for each, whether it is of the window and repeats known so far do not cover it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _CROWD.split(", ")]
        for b in batches:
            for lo, hi, data, offs in rounds(b.column(2)):
                s, row, _ = _tokens(data, offs)
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                owner, (key, l, c, r) = _flat(b.column(3).slice(lo, hi - lo), ("key", "l", "c", "r"))
                of, (start, stop) = _flat(b.column(4).slice(lo, hi - lo), ("start", "stop"))
                s32 = (mix(s) >> _U(32)).astype(np.uint32)
                mark = np.zeros(len(s) + 1, np.int64)
                np.add.at(mark, cut[of] + start, 1)
                np.add.at(mark, cut[of] + stop, -1)
                bare = np.cumsum(mark)[:-1] == 0
                first, end = np.maximum(cut[owner], cut[owner] + c - wide), np.minimum(cut[owner + 1], cut[owner] + c + wide + 1)
                tokens = [s32[p:q].tobytes() for p, q in zip(first.tolist(), end.tolist())]
                inner = zip(first.tolist(), end.tolist(), (cut[owner] + l).tolist(), (cut[owner] + r + 1).tolist())
                open_ = [bytes(i - p) + bare[i:j].tobytes() + bytes(q - j) for p, q, i, j in inner]
                rows = pa.array(owner + lo)
                cols = [pa.array(key), b.column(0).take(rows), b.column(1).take(rows), *(pa.array(v.astype(np.int32)) for v in (l, c, r)), *(pa.array(v, pa.binary()) for v in (open_, tokens))]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


class _Open:
    """What is still open of the windows of a list while partners are tried: each window meets earlier documents only until it is covered.

    A partner is tried if a stretch of the window may be similar to it that holds an open token: the window's tokens that both
    have reach over one and are dense enough around it. Others could add nothing to what is covered.
    """

    def __init__(self, tokens: list[np.ndarray], open_: list[np.ndarray], inside: list[tuple[int, int]], lead: np.ndarray, width: int, similar: float):
        self.tokens, self.lead, self.inside, self.width, self.similar = tokens, lead, inside, width, similar
        n, size = len(tokens), np.array([len(t) for t in tokens])
        row = np.repeat(np.arange(n), size)
        column = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        _, code, many = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
        number = np.where(many > 1, np.cumsum(many > 1), 0)  # 0: a token that no other window has, or none
        self.codes = int(number.max()) + 1
        self.table = np.zeros((n, int(size.max())), np.int32)
        self.table[row, column] = number[code]
        self.own = self.table.copy()
        self.open = np.zeros(self.table.shape, bool)
        for i, (v, (p, q)) in enumerate(zip(open_, inside)):
            self.open[i, : len(v)] = v
            self.own[i, :p] = self.own[i, q:] = 0
        _, at, many = np.unique(row * self.codes + number[code], return_inverse=True, return_counts=True)
        self.again = np.zeros(self.table.shape, bool)  # tokens that their window has more than once
        self.again[row, column] = (many[at] > 1) & (number[code] > 0)
        self.stop = np.array([q for _, q in inside])
        self.needy = self._reached(self.own > 0, np.arange(n))

    def _reached(self, both: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether an open token of y lies between the first and last of its tokens in ``both``."""
        first, last = both.argmax(1), both.shape[1] - both[:, ::-1].argmax(1)
        at = np.arange(both.shape[1])
        return both.any(1) & (self.open[y] & (at >= first[:, None]) & (at < last[:, None])).any(1)

    def _around(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens in a stretch [a, z) of ``width`` at least with end[z] >= start[a]: a lies ``width`` before them or less, or more."""
        width, tiny = self.width, 1e-3
        least = np.minimum.accumulate(start, 1)
        most = np.maximum.accumulate(end[:, ::-1], 1)[:, ::-1]
        inside = self._spread(most[:, width:] >= start[:, :-width] - tiny, width, start.shape[1] - 1)
        inside[:, width:] |= most[:, width + 1 :] >= least[:, : -width - 1] - tiny
        return inside

    @staticmethod
    def _spread(starts: np.ndarray, size: int, columns: int) -> np.ndarray:
        """Tokens in the stretches of ``size`` that begin at ``starts``."""
        sums = np.zeros((len(starts), columns + size), np.int16)
        sums[:, size : size + starts.shape[1]] = starts
        np.cumsum(sums, 1, out=sums)
        return sums[:, size:] > sums[:, :-size]

    def _dense(self, place: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Tokens in stretches of which enough are in x."""
        sums = np.zeros((len(place), place.shape[1] + 1), np.float32)
        np.cumsum(np.where(place > 0, 1, self.similar * self.again[y]), 1, dtype=np.float32, out=sums[:, 1:])
        sums -= np.float32(self.similar) * np.arange(sums.shape[1], dtype=np.float32)
        return self._around(sums, sums)

    def _dense_plain(self, place: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Tokens in stretches, from a token of x to another, that are similar to the stretch of x across from them."""
        far, part = np.float32(1e6), np.float32(self.similar)
        both = place > 0
        n = np.zeros((len(place), place.shape[1] + 1), np.float32)
        np.cumsum(both, 1, dtype=np.float32, out=n[:, 1:])
        n *= 1 + part
        start, end = np.full(n.shape, far), np.full(n.shape, -far)
        np.copyto(start[:, :-1], n[:, :-1] - part * place, where=both)
        np.copyto(end[:, 1:], n[:, 1:] - part * (place + 1), where=both)
        size = part * np.arange(n.shape[1], dtype=np.float32)
        inside = self._around(start - size, end - size)
        for short in range(math.ceil(self.similar * self.width - 1e-9), self.width):
            hits = end[:, short:] - start[:, :-short] >= self.similar * self.width - 1e-3
            some = np.flatnonzero(hits.any(1))
            if len(some):  # a shorter one is taken with words after it, or before it where the window ends
                hits, ahead = hits[some], np.arange(hits.shape[1]) + self.width <= self.stop[y[some], None]
                back = (hits & ~ahead)[:, self.width - short :]
                inside[some] |= self._spread((hits & ahead)[:, : place.shape[1]], self.width, place.shape[1]) | self._spread(back, self.width, place.shape[1])
        return inside

    def _useful(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        good = np.zeros(len(x), bool)
        order = np.argsort(x, kind="stable")
        fit = max(1, (1 << 25) // self.codes)  # documents whose tokens are spread out at once
        lo = 0
        while lo < len(order):
            part = order[lo : lo + 4096]
            some, at = np.unique(x[part], return_inverse=True)
            if len(some) > fit:
                part = part[: int(np.searchsorted(at, fit))]
                some, at = some[:fit], at[: len(part)]
            lo += len(part)
            place = np.zeros((len(some), self.codes), np.int16)
            place[np.arange(len(some))[:, None], self.table[some]] = np.arange(1, self.table.shape[1] + 1)
            place[:, 0] = 0
            place = place[at[:, None], self.own[y[part]]]
            keep = self._reached(place > 0, y[part])
            part, place = part[keep], place[keep]
            # where no token occurs twice and all are in one order, what x has between them counts as well
            plain = ~self.again[x[part]].any(1) & ~self.again[y[part]].any(1)
            plain &= ((place == 0) | (place >= np.maximum.accumulate(place, 1))).all(1)
            for rule in (self._dense, self._dense_plain):
                some = part[plain] if rule == self._dense_plain else part[~plain]
                inside = rule(place[plain] if rule == self._dense_plain else place[~plain], y[some])
                good[some[(inside & self.open[y[some]]).any(1)]] = True
        return good

    def tried(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that were tried, the earliest documents first."""
        good = self.needy[y]
        good[good] = self._useful(x[good], y[good])
        order = np.lexsort((x[good], y[good]))
        x, y = x[good][order], y[good][order]
        found = []
        begin = np.flatnonzero(np.concatenate(([True], y[1:] != y[:-1]))[: len(y)])
        for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(y)]):
            j, left = int(y[lo]), x[lo:hi]
            p, q = self.inside[j]
            while len(left):
                i, left = int(left[0]), left[1:]
                found.append((i, j))
                before = np.count_nonzero(self.open[j])
                for s, e in similar_stretches(self.tokens[i], self.tokens[j][p:q], self.width, self.similar, int(self.lead[j] + p - self.lead[i])):
                    self.open[j, p + s : p + e] = False
                if np.count_nonzero(self.open[j]) < before:
                    self.needy[j : j + 1] = self._reached(self.own[j : j + 1] > 0, np.array([j]))
                    left = left[self._useful(left, np.full(len(left), j))] if self.needy[j] else left[:0]
        return tuple(np.array(found, np.int64).reshape(-1, 2).T)


def _crossings(owner: np.ndarray, c: np.ndarray, needy: np.ndarray, tokens: list[np.ndarray], lead: np.ndarray, need: int, tried=lambda x, y: (x, y)) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (x, y), x of an earlier document, of a list's windows with at least ``need`` tokens in common, for each needy y.

    Pairs that share a token of at most RARE windows are all made. Where only more common tokens are shared, windows with
    these in the same places are one class, of which the first document stands for all. ``lead``: the first token's place less c.
    ``tried`` takes pairs as they are found and returns those to keep; it may settle windows, which are then no longer needy.
    """
    n, size = len(owner), np.array([len(t) for t in tokens])
    row = np.repeat(np.arange(n), size)
    names, code = np.unique(np.concatenate(tokens), return_inverse=True)
    r, k = np.divmod(np.unique(row * len(names) + code), len(names))
    many = np.bincount(k)
    hot = many > RARE
    pairs = np.zeros(0, np.int64)
    rare = np.flatnonzero(~hot[k] & (many[k] > 1))
    rare = rare[np.argsort(k[rare], kind="stable")]
    for step in range(1, RARE):
        hit = np.flatnonzero(k[rare[step:]] == k[rare[:-step]]) if step < len(rare) else rare[:0]
        if not len(hit):
            break
        x, y = r[rare[hit]], r[rare[hit + step]]
        good = needy[y] & (owner[x] != owner[y])
        pairs = np.union1d(pairs, x[good] * n + y[good])
    width = int(np.bincount(r).max())
    table = np.repeat(np.arange(n)[:, None] + len(names), width, 1).astype(np.int64)  # padded with what no other row has
    begin = np.searchsorted(r, np.arange(n))
    table[r, np.arange(len(r)) - begin[r]] = k
    pad = width - np.bincount(r, minlength=n)
    kept = []
    for lo in range(0, len(pairs), 4096):
        x, y = np.divmod(pairs[lo : lo + 4096], n)
        both = np.sort(np.concatenate((table[x], table[y]), 1), 1)
        same = (both[:, 1:] == both[:, :-1]).sum(1) - np.maximum(pad[x] - 1, 0) - np.maximum(pad[y] - 1, 0)
        kept.append(pairs[lo : lo + 4096][same >= need])
    if kept:
        x, y = tried(*np.divmod(np.concatenate(kept), n))
        kept = [x * n + y]
    # classes by the common tokens and their places
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + lead[row]
    sums = np.concatenate(([_U(0)], np.cumsum(np.where(hot[code], mix(names[code].astype(_U) ^ mix(place.astype(np.int64).view(_U))), _U(0)))))
    end = np.cumsum(size)
    pattern = sums[end] - sums[end - size]
    enough = np.flatnonzero(np.bincount(r, hot[k], n) >= need)
    _, rep, of = np.unique(pattern[enough], return_index=True, return_inverse=True)
    rep = enough[rep]
    number = np.cumsum(hot) - 1
    wanted = np.split(enough[np.argsort(of, kind="stable")], np.cumsum(np.bincount(of, minlength=len(rep)))[:-1]) if len(rep) else []
    stop = np.append(begin[1:], len(r))

    def dense(some: np.ndarray) -> np.ndarray:
        out = np.zeros((len(some), int(hot.sum())), np.float32)
        for i, w in enumerate(some.tolist()):
            own = k[begin[w] : stop[w]]
            out[i, number[own[hot[own]]]] = 1
        return out

    order = np.argsort(rep)
    wanted = [(rep[q], wanted[q][lo : lo + 1024]) for q in order for lo in range(0, len(wanted[q]), 1024)]
    rep = rep[order]
    cut = [0, 8, 32, 128, *range(512, len(rep), 512)]  # most windows are settled by the first documents
    for p, stop_ in zip(cut, [*cut[1:], len(rep)]):
        some = [(q, ys) for q, v in wanted if p < len(rep) and len(ys := v[needy[v] & (owner[v] > owner[rep[p]])])]
        left = dense(rep[p:stop_]) if some else None
        blocks = np.cumsum([max(len(ys), 8) for _, ys in some]) // 4096
        for lo, hi in zip(*(np.searchsorted(blocks, np.unique(blocks), side=side).tolist() for side in ("left", "right"))):
            of, members = zip(*some[lo:hi])
            j, i = np.nonzero(dense(np.array(of)) @ left.T >= need)
            many = np.array([len(v) for v in members])
            flat, first = np.concatenate(members), np.cumsum(many) - many
            y = flat[np.repeat(first[j] - np.cumsum(many[j]) + many[j], many[j]) + np.arange(many[j].sum())]
            x = np.repeat(rep[p + i], many[j])
            good = owner[x] < owner[y]
            x, y = tried(x[good], y[good])
            kept.append(x * n + y)
    return np.divmod(np.unique(np.concatenate(kept)), n) if kept else (r[:0], r[:0])


def _crowds(need: int, wide: int, width: int, similar: float):
    """Lists of windows of large groups, sorted by key and document, as the pairs of windows that were tried."""

    def made(held: list[tuple]) -> pa.RecordBatch | None:
        _, doc, h1, l, c, r, open_, raw = zip(*held)
        doc, h1, l, c, r = (np.array(v) for v in (doc, h1, l, c, r))
        owner = np.cumsum(np.concatenate(([True], (doc[1:] != doc[:-1]) | (h1[1:] != h1[:-1]))))
        if owner[-1] == 1 or not any(map(any, open_)):
            return None
        tokens, lead = [np.frombuffer(t, np.uint32) for t in raw], -np.minimum(c, wide)
        inside = list(zip((l - c - lead).tolist(), (r - c - lead + 1).tolist()))
        state = _Open(tokens, [np.frombuffer(v, bool) for v in open_], inside, lead, width, similar)
        x, y = _crossings(owner, c, state.needy, tokens, lead, need, state.tried)
        start = c + lead  # all that was compared of x
        stop = start + np.array([len(t) for t in tokens]) - 1
        cols = [doc[x], h1[x], doc[y], h1[y], np.zeros(len(x)), start[x], stop[x], l[y], r[y], c[y] - c[x]]
        return pa.RecordBatch.from_arrays([pa.array(v.astype(t)) for v, t in zip(cols, [np.int64] * 4 + [np.int32] * 6)], [f.split()[0] for f in _PAIR.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (x for b in batches for x in zip(*(v.to_pylist() for v in b.columns)))
        for _, held in itertools.groupby(rows, key=lambda x: x[0]):
            out = made(list(held))
            if out is not None and out.num_rows:
                yield out

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats, sorted by document, source, diagonal and start, with those that overlap as one; places in words."""
    carried = None
    names = ["doc_id", "h1", "start", "stop", "source"]
    row = lambda v: pa.RecordBatch.from_arrays([pa.array(v[i].astype(np.int64)) for i in (0, 1, 4, 5, 2)], names)
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy() for i in range(6)]
        if carried is not None:
            cols = [np.concatenate((c, x)) for c, x in zip(carried, cols)]
        line = np.ones(len(cols[0]), bool)
        line[1:] = np.logical_or.reduce([v[1:] != v[:-1] for v in cols[:4]])
        tall = np.cumsum(line) << 32
        reach = np.maximum.accumulate(cols[5] + tall)
        new = line.copy()
        new[1:] |= cols[4][1:] + tall[1:] > reach[:-1]
        at = np.flatnonzero(new)
        out = [v[at] for v in cols]
        out[5] = (reach - tall)[np.append(at[1:], len(tall)) - 1]
        carried = [v[-1:] for v in out]
        yield row([*(v[:-1] for v in out[:5]), out[5][:-1] + K - 1])
    if carried is not None:
        yield row([*carried[:5], carried[5] + K - 1])


_PART = "unit bigint, side int, doc_id bigint, h1 bigint, source bigint, at array<int>, sizes array<int>, shingles binary"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles that each document contributes to the units it is in."""
    names = [f.split()[0] for f in _PART.split(", ")]
    for b in batches:
        wanted = b.column(3)
        for lo, hi, data, offs in rounds(b.column(2)):
            s, row, _ = _tokens(data, offs)
            cut = np.searchsorted(row, np.arange(hi - lo + 1))
            out = []
            for i, want in enumerate(wanted.slice(lo, hi - lo).to_pylist()):
                own = s[cut[i] : cut[i + 1]]
                doc, h1 = b.column(0)[lo + i].as_py(), b.column(1)[lo + i].as_py()
                for w in want:
                    parts = [own[p : q + 1] for p, q in zip(w["start"], w["stop"])]
                    out.append((w["unit"], w["side"], doc, h1, w["source"], [*w["start"], *w["other"], *w["shift"]], [len(p) for p in parts], b"".join(p.tobytes() for p in parts)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary())
            cols = list(zip(*out)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)


def similar_stretches(x: np.ndarray, y: np.ndarray, width: int, similar: float, shift: int = 0) -> list[tuple[int, int]]:
    """Stretches [s, e) of at least ``width`` tokens of y whose Jaccard similarity with a stretch of x is at least ``similar``.

    ``shift``: the place in x that y[0] stands across from. Runs of equal tokens there, with nothing of x around them, are the answer.
    """
    names, first, code = np.unique(np.concatenate((x, y)), return_index=True, return_inverse=True)
    code, y = code[: len(x)], code[len(x) :]
    place = first[y]  # where a token of y stands in x
    hit = place < len(x)
    hits = int(np.count_nonzero(hit))
    if hits < similar * width:
        return []
    # Stretches that begin and end with tokens of x are enough: others only add to the union. They are cut where the place in x jumps.
    line = place - np.arange(len(y))
    if len(names) == len(x) + len(y) - hits and (np.diff(place[hit]) > 0).all():
        return _plain_stretches(place, hit, *_edges(hit, line), width, similar)
    at = np.arange(len(y)) + shift
    equal = np.zeros(len(y) + 2, bool)
    across = (at >= 0) & (at < len(x))
    equal[1:-1][across] = y[across] == code[at[across]]
    edge = np.flatnonzero(equal[1:] != equal[:-1])
    runs = [(int(p), int(q)) for p, q in zip(edge[::2], edge[1::2]) if q - p >= width]
    rest = np.ones(len(y), bool)
    for p, q in runs:
        rest[p:q] = False
    if runs and not hit[rest].any():
        return runs
    place[hit] = np.where(equal[1:-1], at, _nearest(code, y, at))[hit]
    starts, ends = _edges(hit, place - np.arange(len(y)))
    order = np.argsort(y, kind="stable")
    previous = np.full(len(y), -1)  # place of the same token before
    again = np.flatnonzero(y[order[1:]] == y[order[:-1]])
    previous[order[again + 1]] = order[again]
    _, once = np.unique(code, return_index=True)
    alone = np.zeros(len(x), np.int64)
    alone[once] = ~np.isin(code[once], y)
    alone = np.concatenate(([0], np.cumsum(alone)))  # distinct tokens of x up to a place that y lacks
    found, at = list(runs), np.arange(len(y))
    for lo in range(0, len(starts), 64):  # a block of starts against all ends
        a = starts[lo : lo + 64, None]
        live = (at >= a) & (previous < a)
        own, both = (np.cumsum(v, 1)[:, ends - 1] for v in (live, live & hit))
        there = (at >= a) & hit
        least = np.minimum.accumulate(np.where(there, place, len(x)), 1)[:, ends - 1]
        most = np.maximum.accumulate(np.where(there, place, -1), 1)[:, ends - 1]
        size = ends - a
        # of the distinct tokens of a stretch, and of those of x across from it, enough must be in both
        union = own + np.maximum(width - size, 0) + np.where(size > 0, alone[most + 1] - alone[np.minimum(least, most + 1)], 0)
        good = (size > 0) & (both >= similar * union - 1e-9)
        for i, p in enumerate(a[:, 0].tolist()):
            for z in ends[good[i]][::-1].tolist():
                if any(s <= p and z <= e for s, e in found):
                    break
                wide = {(p, z)} if z - p >= width else {(s, s + width) for s in (p, z - width) if 0 <= s <= len(y) - width}
                fits = [(s, e) for s, e in sorted(wide) if _similar(code, y[s:e], place[s:e], hit[s:e], similar)]
                if fits:
                    found.append(fits[0])
                    break
        if any(s <= a[-1, 0] and ends[-1] <= e for s, e in found):
            break
    return found


def _nearest(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each token of y the place of that token in x which is nearest to ``at``; tokens that x lacks have any."""
    n = len(x)
    spot = np.sort(x * n + np.arange(n))
    want = y * n + np.clip(at, 0, n - 1)
    k = np.searchsorted(spot, want)
    after, before = spot[np.minimum(k, n - 1)], spot[np.maximum(k - 1, 0)]
    use = (after // n != y) | ((before // n == y) & (want - before < after - want))
    return np.where(use, before, after) % n


def _edges(hit: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of tokens that x has too, all on one diagonal."""
    jump = line[1:] != line[:-1]
    begin, end = hit.copy(), hit.copy()
    begin[1:] &= ~hit[:-1] | jump
    end[:-1] &= ~hit[1:] | jump
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def _plain_stretches(place: np.ndarray, hit: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int, similar: float) -> list[tuple[int, int]]:
    """``similar_stretches`` where no token occurs twice and all are in one order: every similarity is known from counts."""
    hits = np.concatenate(([0], np.cumsum(hit)))
    found, reach = [], 0
    for lo in range(0, len(starts), 256):  # a block of starts against all ends
        a = starts[lo : lo + 256]
        size = np.maximum(ends[None, :] - a[:, None], width)  # what is too short is taken with words around it
        both = hits[ends][None, :] - hits[a][:, None]
        union = size + place[ends - 1][None, :] - place[a][:, None] + 1 - both
        good = (both >= similar * union - 1e-9) & (ends[None, :] > a[:, None])
        any_ = good.any(1)
        far = len(ends) - 1 - good[:, ::-1].argmax(1)
        for p, q in zip(a[any_].tolist(), ends[far[any_]].tolist()):
            if q - p < width:
                p, q = (p, p + width) if p + width <= len(hit) else (q - width, q)
            if p >= 0 and q > reach:
                found.append((p, q))
                reach = q
    return found


def _similar(x: np.ndarray, part: np.ndarray, place: np.ndarray, hit: np.ndarray, similar: float) -> bool:
    """Whether a stretch of x, all that holds tokens of ``part`` or what lies across from it, is similar enough."""
    have = np.unique(part)
    spot = place[hit]
    if len(spot) < similar * len(have) - 1e-9:
        return False
    where = np.flatnonzero(np.isin(x, have))
    for p, q in {(int(spot[0]), int(spot[-1])), (int(spot.min()), int(spot.max())), (int(where[0]), int(where[-1]))}:
        if q < p:
            continue
        mate = np.unique(x[p : q + 1])
        both = np.isin(mate, have, assume_unique=True).sum()
        if both >= similar * (len(have) + len(mate) - both) - 1e-9:
            return True
    return False


def _verified(width: int, similar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, x = None, {}
        for b in batches:
            out = []
            for u, side, doc, h1, source, at, sizes, raw in zip(*(c.to_pylist() for c in b.columns)):
                s = np.frombuffer(raw, _U)
                cut = np.cumsum([0, *sizes])
                parts = [s[i:j] for i, j in zip(cut, cut[1:])]
                if side == 0:
                    unit, x = u, dict(zip(at[len(parts) : 2 * len(parts)], parts))
                elif u == unit:
                    for k, part in enumerate(parts):
                        for p, q in similar_stretches(x[at[len(parts) + k]], part, width, similar, at[2 * len(parts) + k]):
                            out.append((doc, h1, at[k] + p, at[k] + q + K - 1, source))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "h1", "start", "stop", "source"])

    return run


_RANGE = ("xl", "xr", "yl", "yr", "diagonal")


def _flat(column: pa.Array, names: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(row, fields) of the structs of a list column; a null list is empty."""
    many = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    return np.repeat(np.arange(len(column)), many), [flat.field(n).to_numpy().astype(np.int64) for n in names]


def _settled(row: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Whether [a, z) of each row ``at`` is inside the union of the intervals [lo, hi) of that row."""
    if not len(row):
        return np.zeros(len(at), bool)
    order = np.lexsort((lo, row))
    tall = row[order] << 32
    lo, reach = lo[order] + tall, np.maximum.accumulate(hi[order] + tall)
    new = np.concatenate(([True], lo[1:] > reach[:-1]))
    begin, end = lo[new], reach[np.append(np.flatnonzero(new)[1:], len(lo)) - 1]
    k = np.searchsorted(begin, a + (at << 32), side="right") - 1
    return (k >= 0) & (end[np.maximum(k, 0)] >= z + (at << 32))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with the pairs of their windows as (x, xh, y, yh, m): the interval join across hash functions.

    Windows that exact repeats cover whole need no partner. Intervals that overlap, on diagonals of which each is within
    DRIFT of the next, become one.
    """
    kind = pa.struct([(n, pa.int32()) for n in _RANGE])
    for b in batches:
        if not b.num_rows:
            continue
        y, (x, xh, xl, xr, yl, yr, diagonal) = _flat(b.column(2), ("x", "xh", *_RANGE))
        row, (start, stop) = _flat(b.column(3), ("start", "stop"))
        need = ~_settled(row, start, stop, y, yl, yr + 1)
        y, x, xh, xl, xr, yl, yr, diagonal = (v[need] for v in (y, x, xh, xl, xr, yl, yr, diagonal))
        if not len(y):
            continue
        order = np.lexsort((diagonal, xh, x, y))
        other = np.ones(len(y), bool)
        other[1:] = np.logical_or.reduce([v[order[1:]] != v[order[:-1]] for v in (y, x, xh)])
        line = other.copy()
        line[1:] |= diagonal[order[1:]] - diagonal[order[:-1]] > DRIFT
        pair, band = np.cumsum(other) - 1, np.cumsum(line)
        within = np.lexsort((yl[order], band))
        order, pair, band = order[within], pair[within], band[within]
        y, x, xh, xl, xr, yl, yr, diagonal = (v[order] for v in (y, x, xh, xl, xr, yl, yr, diagonal))
        line[1:] = band[1:] != band[:-1]
        tall = np.cumsum(line) << 32  # so that a maximum never reaches over to the next diagonal
        reach = np.maximum.accumulate(yr + tall)
        new = line.copy()
        new[1:] |= yl[1:] + tall[1:] > reach[:-1]
        at = np.flatnonzero(new)
        least, most = (lambda v: np.minimum.reduceat(v, at)), (lambda v: np.maximum.reduceat(v, at))
        cols = [v.astype(np.int32) for v in (least(xl), most(xr), least(yl), most(yr), diagonal[at])]
        _, cut = np.unique(pair[at], return_index=True)
        merged = pa.StructArray.from_arrays([pa.array(c) for c in cols], fields=list(kind))
        m = pa.ListArray.from_arrays(pa.array(np.append(cut, len(at)).astype(np.int32)), merged)
        one = at[cut]
        rows = pa.array(y[one])
        yield pa.RecordBatch.from_arrays([pa.array(x[one]), pa.array(xh[one]), b.column(0).take(rows), b.column(1).take(rows), m], ["x", "xh", "y", "yh", "m"])


def _known(exact: DataFrame) -> DataFrame:
    return exact.groupBy("doc_id", "h1").agg(F.collect_list(F.struct("start", (F.col("stop") - K + 1).alias("stop"))).alias("known"))


def _near(first: DataFrame, pairs: DataFrame, exact: DataFrame, width: int, similar: float) -> DataFrame:
    """Verified passages of pairs of windows; windows that ``exact`` covers whole are left out."""
    candidates = pairs.groupBy(F.col("y").alias("doc_id"), F.col("yh").alias("h1")).agg(F.collect_list(F.struct("x", "xh", *_RANGE)).alias("w"))
    merged = candidates.join(_known(exact), ["doc_id", "h1"], "left").select("doc_id", "h1", "w", "known")
    merged = merged.mapInArrow(_ranges, "x bigint, xh bigint, y bigint, yh bigint, m array<struct<xl:int,xr:int,yl:int,yr:int,diagonal:int>>")
    merged = staged(merged, "merged")
    salts = merged.groupBy("x", "xh").agg(F.ceil(F.count("*") / STAR).cast("int").alias("salts"))
    units = merged.join(salts, ["x", "xh"]).withColumn("salt", F.pmod(F.xxhash64("y", "yh"), F.col("salts"))).withColumn("unit", F.xxhash64("x", "xh", "salt"))
    pick = lambda c: F.transform("m", lambda m: m[c])
    y_side = units.select(F.col("y").alias("doc_id"), F.col("yh").alias("h1"), F.struct("unit", F.lit(1).alias("side"), F.col("x").alias("source"), pick("yl").alias("start"), pick("yr").alias("stop"), pick("xl").alias("other"), F.transform("m", lambda m: m["yl"] - m["diagonal"] - m["xl"]).alias("shift")).alias("want"))
    # what a unit needs of its first document: the longest range from each start
    x_need = units.select("x", "xh", "unit", F.explode("m").alias("m")).groupBy("x", "xh", "unit", F.col("m.xl").alias("xl")).agg(F.max("m.xr").alias("xr"))
    x_need = x_need.groupBy("x", "xh", "unit").agg(F.sort_array(F.collect_list(F.struct("xl", "xr"))).alias("m"))
    x_side = x_need.select(F.col("x").alias("doc_id"), F.col("xh").alias("h1"), F.struct("unit", F.lit(0).alias("side"), F.col("x").alias("source"), pick("xl").alias("start"), pick("xr").alias("stop"), pick("xl").alias("other"), F.transform("m", lambda m: F.lit(0)).alias("shift")).alias("want"))
    wanted = y_side.unionByName(x_side).groupBy("doc_id", "h1").agg(F.collect_list("want").alias("wanted"))
    wanted = staged(wanted, "wanted")
    parts = _narrow(first, wanted.select("doc_id").distinct()).join(wanted, ["doc_id", "h1"]).select("doc_id", "h1", "text", "wanted").mapInArrow(_parts, _PART)
    parts = parts.repartition("unit").sortWithinPartitions("unit", "side")
    return parts.mapInArrow(_verified(width, similar), "doc_id bigint, h1 bigint, start bigint, stop bigint, source bigint")


def passages(df: DataFrame, passage: int = 50, similar: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, spans: one row per row of ``df``.

    ``spans``: array<struct<start, stop, source>>, the passages, in words, that are near-duplicates of a passage of the
    document ``source``, which comes earlier (smaller id; texts that share an id are ordered by a hash). Spans may overlap.
    Words are runs without white space, A-Z taken as a-z. Null texts are empty; texts of fewer than ``passage``
    words have no spans. Rows that repeat id and text have one result each. Null ids come first. Other columns are not read.
    """
    width = passage - K + 1
    if not SIDE < width <= _FAR:
        raise ValueError(f"passage must be from {SIDE + K} to {_FAR + K - 1} words")
    docs = df.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-(1 << 63)).cast("bigint")).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumn("h1", F.xxhash64("text"))
    base = docs.select("doc_id", "h1", F.xxhash64("text", F.lit(7)).alias("h2"), F.lit(0).alias("z"), "text").mapInArrow(_counted, "doc_id bigint, h1 bigint, h2 bigint, n_words bigint")
    base = staged(base, "texts")
    copies = base.filter(F.col("n_words") >= passage).groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
    later = base.join(copies, ["h1", "h2"]).filter("doc_id > least").select("doc_id", "h1", F.lit(0).cast("bigint").alias("start"), F.col("n_words").alias("stop"), F.col("least").alias("source")).distinct()
    later = staged(later, "copies")
    gone = later.select("doc_id", "h1")
    first = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, ["doc_id", "h1"], "left_anti").select("doc_id", "h1", "text")
    if _repeats(base):
        first = first.dropDuplicates(["doc_id", "h1"])

    lists = first.mapInArrow(_window_rows(width), _WINDOW).repartition("key").sortWithinPartitions("key", "doc_id", "h1", "place")
    pairs = staged(lists.mapInArrow(_pairs, _PAIR), "pairs")
    windows = pairs.filter(F.col("j") == OPEN).groupBy(F.col("y").alias("doc_id"), F.col("yh").alias("h1")).agg(F.collect_list(F.struct(F.col("yl").alias("l"), F.col("yr").alias("r"))).alias("windows"))
    windows = staged(windows, "windows")
    stretches = _narrow(first, windows.select("doc_id").distinct()).join(windows, ["doc_id", "h1"]).select("doc_id", "h1", "text", "windows")
    stretches = stretches.mapInArrow(_open_rows(width), "name bigint, doc_id bigint, h1 bigint, at int").repartition("name").sortWithinPartitions("name", "doc_id", "h1", "at")
    same = pairs.filter(F.col("j") == SAME).select(F.col("y").alias("doc_id"), F.col("yh").alias("h1"), F.col("x").alias("source"), "diagonal", F.col("yl").alias("start"), (F.col("yr") + 1).alias("stop"))
    exact = stretches.mapInArrow(_equal(width), _EXACT).unionByName(same)
    exact = exact.repartition("doc_id", "h1").sortWithinPartitions("doc_id", "h1", "source", "diagonal", "start")
    exact = staged(exact.mapInArrow(_joined, "doc_id bigint, h1 bigint, start bigint, stop bigint, source bigint"), "exact")
    dropped(windows)
    near = _near(first, pairs.filter("j >= 0"), exact, width, similar)
    near = staged(near, "near")
    # windows of large groups that repeats found so far do not cover whole meet all others there that may be similar
    wide, need = int(width / similar), math.ceil(similar * width - 1e-9) - 1  # one less, as tokens have 32 bits there
    crowd = pairs.filter(F.col("j") == LARGE).groupBy(F.col("y").alias("doc_id"), F.col("yh").alias("h1")).agg(F.collect_list(F.struct(F.col("x").alias("key"), F.col("yl").alias("l"), F.col("diagonal").alias("c"), F.col("yr").alias("r"))).alias("windows"))
    crowd = staged(crowd.join(_known(exact.unionByName(near)), ["doc_id", "h1"], "left").select("doc_id", "h1", "windows", "known"), "crowd")
    rows = _narrow(first, crowd.select("doc_id").distinct()).join(crowd, ["doc_id", "h1"]).select("doc_id", "h1", "text", "windows", "known")
    rows = rows.mapInArrow(_crowd_rows(wide), _CROWD).repartition("key").sortWithinPartitions("key", "doc_id", "h1", "c")
    crossed = staged(rows.mapInArrow(_crowds(need, wide, width, similar), _PAIR), "crossed")
    found = near.unionByName(_near(first, crossed, exact.unionByName(near), width, similar))
    spans = found.unionByName(exact).groupBy("doc_id", "h1", "source").agg(F.collect_set(F.struct("start", "stop")).alias("s"))
    inside = lambda s: F.exists("s", lambda t: (t["start"] <= s["start"]) & (t["stop"] >= s["stop"]) & (t != s))
    spans = spans.select("doc_id", "h1", F.explode(F.filter("s", lambda s: ~inside(s))).alias("s"), "source").select("doc_id", "h1", "s.start", "s.stop", "source")
    spans = spans.unionByName(later).groupBy("doc_id", "h1").agg(F.sort_array(F.collect_set(F.struct("start", "stop", "source"))).alias("spans"))
    spans = staged(spans, "spans")
    dropped(exact)
    dropped(pairs)
    for table in (near, crowd, crossed):
        dropped(table)
    out = base.join(spans, ["doc_id", "h1"], "left")
    empty = F.array().cast("array<struct<start:bigint,stop:bigint,source:bigint>>")
    return out.select(F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")).alias("doc_id"), "n_words", F.coalesce("spans", empty).alias("spans"))


def covered(spans) -> F.Column:
    """Words that spans, sorted by start, cover."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(s["stop"] - F.greatest(s["start"], acc["end"]), F.lit(0).cast("bigint"))).alias("n"), F.greatest(acc["end"], s["stop"]).alias("end"))
    return F.aggregate(spans, zero, step, lambda acc: acc["n"])
