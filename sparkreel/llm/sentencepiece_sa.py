"""SentencePiece BPE encoding and decoding by suffix-array matching.

Method: the texts of a batch are cut where no piece can reach across (before
a run of spaces, around a character that no piece has), the distinct segments are concatenated and indexed by a
suffix array, each piece's occurrences are found as one range by binary search,
the occurrences become edges sorted by end position in their segment, and relaxing
the edges in that order, all segments at once, gives the encoding: an edge is taken if the merges keep its piece
apart from the piece before it, which holds for exactly one edge per position.
(Plain shortest paths over scores would give another segmentation than BPE's
merge order, so the relaxation tests pairs in place of adding scores.)
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Idle, small_batches, with_fields
from .textnum import trimmed

SPACE = "▁"
#: Segments that a worker remembers before it starts afresh, and characters that are indexed at once.
MEMORY = 500_000
INDEXED = 1 << 17
_PAIR_MEMORY = 4_000_000
_open: dict[str, PieceModel] = {}


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``codes`` (below 2^21) sorted by the ``depth`` codes from each on, by doubling; beyond the end counts as least."""
    n, k = len(codes), 3
    c = np.zeros(n + 2, np.int64)
    c[:n] = codes
    c[:n] += 1
    key = c[:n] << 42 | c[1 : n + 1] << 21 | c[2:]  # three codes at once
    while True:
        order = np.argsort(key, kind="stable")
        if k >= depth:
            return order
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([1], 1 + np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        if rank[order[-1]] == n:
            return order
        key = rank * (n + 1)
        key[: max(n - k, 0)] += rank[k:]
        k *= 2


class PieceModel:
    """A BPE model file of the ``sentencepiece`` library."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normalize = sp.normalize
        n = sp.get_piece_size()
        self.names = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = {int(self.names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {self.names[i]: i for i in plain}
        self.score = {self.names[i]: sp.get_score(i) for i in plain}
        self.unknown = sp.unk_id()
        self.special = {i for i in range(n) if sp.is_control(i)}
        if any(a != SPACE and b == SPACE for p in self.ids for a, b in zip(p, p[1:])):
            raise ValueError("pieces that go on after a space inside them are not supported")
        self.longest = max(map(len, self.ids))
        self.pieces = np.array(sorted(self.ids))  # numpy sorts text by code point, as the suffix array does
        self.piece_len = np.char.str_len(self.pieces).astype(np.int64)
        self.piece_list = self.pieces.tolist()
        self.pieces_end = np.char.add(self.pieces, "\U0010ffff")
        self.piece_ids = np.array([self.ids[p] for p in self.piece_list])
        self.whole = np.array([self.merged(p) == [p] for p in self.piece_list])
        # ASCII characters that no piece has: nothing merges across them, so segments end there
        alone = [c for c in map(chr, range(128)) if not any(c in p for p in self.ids)]
        self.lone = {c: np.array(self.fallback(c), "<i4").tobytes() for c in alone}
        self.known: dict[str, bytes]
        self.forget()
        self.idle = Idle(self.forget)
        stop = SPACE + "".join(map(re.escape, alone))
        self.segment = re.compile(f"{SPACE}+[^{stop}]*|[^{stop}]+" + (f"|[{stop[1:]}]" if alone else ""))
        # what ids stand for by themselves: all but bytes beyond ASCII
        self.plain_text = {i: "" if i in self.special else self.names[i] for i in range(n) if i not in self.byte_of}
        self.plain_text |= {i: chr(b) for i, b in self.byte_of.items() if b < 128}

    def forget(self) -> None:
        self.known = dict(self.lone)
        self.pair, self.pair_ok = np.array([-1]), np.array([False])
        self.last = np.zeros(0, np.int64)

    def merged(self, text: str) -> list[str]:
        """The merges of the model on a short text."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = max((score.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == -np.inf:
                break
            parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
        return parts

    def keeps_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the merges turn a pair of pieces, joined, into just these two. Each pair is worked out once."""
        key = left * len(self.piece_list) + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        new = np.unique(key[self.pair[at] != key])
        if len(new):
            names = self.piece_list
            ok = []
            for a, b in zip(*(x.tolist() for x in np.divmod(new, len(names)))):
                ok.append(self.merged(names[a] + names[b]) == [names[a], names[b]])
            old = slice(0, 1 if len(self.pair) > _PAIR_MEMORY else None)
            pair = np.concatenate((self.pair[old], new))
            order = np.argsort(pair, kind="stable")
            self.pair, self.pair_ok = pair[order], np.concatenate((self.pair_ok[old], np.array(ok)))[order]
            return self.keeps_apart(left, right) if old.stop else self.pair_ok[np.searchsorted(self.pair, key)]
        return self.pair_ok[at]

    def fallback(self, char: str) -> list[int]:
        """Ids of a character that no piece has: its bytes, or the unknown id."""
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]

    def learn(self, segments: list[str]) -> None:
        """Encode distinct segments over one index and remember them."""
        if not segments:
            return
        text = "\0".join(segments) + "\0"
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        w = self.longest
        order = suffix_array(codes, w)
        view = np.lib.stride_tricks.sliding_window_view(np.concatenate((codes, np.zeros(w, np.uint32))), w)
        suffixes = view[order].view(f"<U{w}").ravel()
        lo = np.searchsorted(suffixes, self.pieces)
        hi = np.searchsorted(suffixes, self.pieces_end)
        del suffixes, view
        many = hi - lo
        which = np.repeat(np.arange(len(many)), many)
        starts = order[np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)]
        del order
        self.relax(codes, starts, which)
        del starts, which
        size = np.array(list(map(len, segments)))
        self.collect(segments, np.cumsum(size + 1) - size - 1, size)
        self.last = np.zeros(0, np.int64)
        if len(codes) > INDEXED // 8:
            trimmed()

    def relax(self, codes: np.ndarray, starts: np.ndarray, which: np.ndarray) -> None:
        """Settle the last piece of every prefix of every segment, all segments at once, by length of the prefix.

        An edge into a prefix is taken if its piece stays apart from the last piece of the prefix it starts from.
        ``last`` holds pieces; ``first`` marks an empty prefix and ``lone`` a character that no piece has.
        """
        n, first, lone = len(codes), len(self.piece_list), len(self.piece_list) + 1
        stop = np.flatnonzero(codes == 0)
        begin = np.concatenate(([0], stop[:-1] + 1))
        size = stop - begin
        local = starts - np.repeat(begin, size + 1)[starts] + self.piece_len[which]
        by_end = np.argsort(local.astype(np.uint16) if size.max() < 1 << 16 else local, kind="stable")
        starts, which = starts[by_end], which[by_end]
        cut = np.searchsorted(local[by_end], np.arange(size.max() + 2))
        last = self.last = np.full(n + 1, -1, np.int64)
        last[begin] = first
        by_size = np.argsort(-size, kind="stable")
        longer = np.searchsorted(-size[by_size], -np.arange(size.max() + 1), side="right")
        for i in range(1, size.max() + 1):
            s, p = starts[cut[i] : cut[i + 1]], which[cut[i] : cut[i + 1]]
            before = last[s]
            ok = np.where(before == first, self.whole[p], before == lone)
            pair = np.flatnonzero(before < first)
            if len(pair):
                ok[pair] = self.keeps_apart(before[pair], p[pair])
            last[s[ok] + self.piece_len[p[ok]]] = p[ok]
            ends = begin[by_size[: longer[i]]] + i
            last[ends[last[ends] < 0]] = lone

    def collect(self, segments: list[str], begin: np.ndarray, size: np.ndarray) -> None:
        """Walk back from the end of every segment at once and remember the ids as bytes."""
        lone = len(self.piece_list) + 1
        where, owner = begin + size, np.arange(len(segments))
        steps = []
        while len(owner):
            p = self.last[where]
            steps.append((owner, p, where))
            where = where - np.where(p == lone, 1, self.piece_len[np.minimum(p, lone - 2)])
            more = where > begin[owner]
            owner, where = owner[more], where[more]
        owner, piece, where = (np.concatenate(x[::-1]) for x in zip(*steps))
        order = np.argsort(owner, kind="stable")
        owner, piece, where = owner[order], piece[order], where[order]
        raw = self.piece_ids[np.minimum(piece, lone - 2)].astype("<i4").tobytes()
        cut = np.searchsorted(owner, np.arange(len(segments) + 1)).tolist()
        odd = set(owner[piece == lone].tolist())
        for k, segment in enumerate(segments):
            lo, hi = cut[k], cut[k + 1]
            if k in odd:
                ids = []
                for i in range(lo, hi):
                    ids += self.fallback(segment[where[i] - begin[k] - 1]) if piece[i] == lone else [int(self.piece_ids[piece[i]])]
                self.known[segment] = np.array(ids, "<i4").tobytes()
            else:
                self.known[segment] = raw[4 * lo : 4 * hi]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts, without begin and end."""
        return [np.frombuffer(x, "<i4").tolist() for x in self.encode_bytes(texts)]

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as 32-bit integers."""
        cut = [self.segment.findall(self.normalize(t)) if t else [] for t in texts]
        known = self.known
        if len(known) > MEMORY:
            known.clear()
            known.update(self.lone)
        new, size = [], 0
        for s in sorted(set().union(*cut).difference(known)):
            new.append(s)
            size += len(s) + 1
            if size > INDEXED:
                self.learn(new)
                new, size = [], 0
        self.learn(new)
        return [b"".join(map(known.__getitem__, segments)) for segments in cut]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: a space for each space mark but the leading one, bytes joined, wrong UTF-8 replaced."""
        try:
            text = "".join(map(self.plain_text.__getitem__, ids)).replace(SPACE, " ")
        except KeyError:  # bytes beyond ASCII join their neighbours
            text = self.with_bytes(ids).replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text

    def with_bytes(self, ids: list[int]) -> str:
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.plain_text[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)


def model(path: str) -> PieceModel:
    """The worker's model: it and the segments it knows serve all tasks of a worker process."""
    if path not in _open:
        _open[path] = PieceModel(path)
    return _open[path]


def encode(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """``keep`` columns and ``ids``, an array of the ids of the whole text as the library gives them.

    With ``decoded`` also the text that the ids decode to, in the same pass over the data.

    One row per input row, repeated rows included. Null and empty texts have no ids. Columns not kept are not
    read, so their names cannot clash; ``ids`` must not be kept. ``path`` must exist on every executor.
    """
    names = [*keep, "ids", *["decoded"] * decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with model(path).idle:
            yield from work(model(path), batches)

    def work(m: PieceModel, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                got = m.encode_bytes(part.column(len(keep)).to_pylist())
                offsets = (np.cumsum([0, *map(len, got)]) // 4).astype(np.int32)
                flat = np.frombuffer(b"".join(got), np.int32)
                cols = [part.column(i) for i in range(len(keep))]
                cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
                if decoded:
                    cols.append(pa.array([m.decode(np.frombuffer(x, "<i4").tolist()) for x in got], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names)

    small_batches(df.sparkSession)
    src = df.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))
    return src.mapInArrow(run, with_fields(src.schema[:-1], ids="array<int>", **{"decoded": "string"} if decoded else {}))


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the text of ``ids``; null ids give an empty text."""
    small_batches(df.sparkSession)
    names = df.columns
    at = names.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            texts = pa.array([m.decode(x) if x else "" for x in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], [*names, "decoded"])

    return df.mapInArrow(run, with_fields(df.schema, decoded="string"))
