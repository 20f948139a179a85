"""Exact substring dedup: every later occurrence of a long byte string goes.

Method: a sampled suffix sort. A cover of the text is sampled, the sampled
suffixes are named by the ``GRAM`` bytes they begin with and sorted by name,
names that occur once drop out, and the suffixes between samples are merged in
through their sample: all strings of ``length`` bytes that hold a sampled
suffix at the same offset are sorted by their name, and adjacent ones that agree are
repeats of the first. Where the classic difference cover samples fixed
residues (two of three positions, so that any two suffixes meet in a sampled
pair), the cover here is chosen by the text: the least gram of each
``length``-byte string. It has the property that the method needs, since two equal
strings hold the sample at the same offset, with about 3 % of the
positions, and because equal strings have equal names at full length, no recursion on names is
left to do.

Exact copies are settled first by their hash. Documents travel only if they
hold a repeated name; sampled suffixes travel with the bytes around them only
in that case. Names that very many suffixes share do not meet in one task:
beyond ``HOT`` all their strings count as repeats but the earliest of each, which
partial minima find.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, staged
from .textnum import BYTE_CODE, mix, powers, prefix_hash, rounds

_U = np.uint64
GRAM = 32
#: Suffixes of one name beyond which they are not compared in one task.
HOT = 20_000
#: Documents up to which their ids are broadcast (16 MB); beyond, the texts are joined by a shuffle.
BROADCAST_IDS = 1 << 20
EMPTY = hashlib.sha256(b"").hexdigest()


def samples(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, name, first start, last start) of each sample: the strings it stands for start from first to last."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none.astype(_U), none, none
    p, down = prefix_hash(BYTE_CODE[data])
    name = mix((p[GRAM:] - p[:-GRAM]) * down[: n - GRAM + 1])
    bits = _U(max(1, int(n).bit_length()))
    least = (name >> bits << bits) | np.arange(len(name), dtype=_U)  # the leftmost of equal grams
    width, have = length - GRAM + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    at = (least & ((_U(1) << bits) - _U(1))).astype(np.int64)  # the sample of the string that starts here
    size = np.diff(offs)
    row = np.repeat(np.arange(len(size)), size)
    inside = np.flatnonzero(row[: n - length + 1] == row[length - 1 :])
    at = at[inside]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1 if len(at) else first
    return at[first], name[at[first]], inside[first], inside[last]


def _sample_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, data, offs in rounds(b.column(2)):
                at, name, _, _ = samples(data, offs, length)
                row = np.searchsorted(offs, at, side="right") - 1
                rows = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), b.column(0).take(rows), b.column(1).take(rows), pa.array((at - offs[row]).astype(np.int32))], ["name", "doc_id", "h1", "at"])

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, sorted by name, whose name another row has."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        name = b.column(0).to_numpy()
        same = np.zeros(len(name) + 1, bool)
        same[1:-1] = name[1:] == name[:-1]
        keep = same[1:] | same[:-1]
        # the last row waits for the next batch, with the one before it if that has its name
        back = 2 if len(name) > 1 and same[-2] else 1
        yield b.slice(0, len(name) - back).filter(pa.array(keep[: len(name) - back]))
        held = b.slice(len(name) - back)
    if held is not None and held.num_rows == 2:
        yield held


def _contexts(length: int):
    """(name, doc_id, h1, at, first, last, around): the bytes around each wanted sample, from first to last + length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wanted = b.column(3)
            for lo, hi, data, offs in rounds(b.column(2)):
                at, name, first, last = samples(data, offs, length)
                want = wanted.slice(lo, hi - lo)
                many = np.array([len(x) for x in want.to_pylist()]) if want.null_count else np.diff(want.offsets.to_numpy())
                where = want.flatten().to_numpy() + np.repeat(offs[:-1], many)
                k = np.searchsorted(at, np.unique(where))
                at, name, first, last = at[k], name[k], first[k], last[k]
                row = np.searchsorted(offs, at, side="right") - 1
                rows = pa.array(row + lo)
                raw = data.tobytes()
                around = pa.array([raw[i : j + length] for i, j in zip(first.tolist(), last.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name.view(np.int64)), b.column(0).take(rows), b.column(1).take(rows), pa.array(at - offs[row]), pa.array(first - offs[row]), around],
                    ["name", "doc_id", "h1", "at", "first", "around"],
                )

    return run


def _string_names(name: np.ndarray, at: np.ndarray, first: np.ndarray, around: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, name) of every string of each row, by row and start. The name also holds the offset of the sample."""
    size = np.array([len(a) for a in around])
    data = np.frombuffer(b"".join(around), np.uint8)
    begin = np.cumsum(size) - size
    n = size - length + 1
    row = np.repeat(np.arange(len(size)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = begin[row] + step
    p, down = prefix_hash(BYTE_CODE[data])
    h = (p[start + length] - p[start]) * down[start]
    return row, mix(mix(h ^ (at[row] - first[row] - step).astype(_U)) + name[row].view(_U))


def _runs(doc_id, h1, first, row, step) -> pa.RecordBatch:
    """(doc_id, h1, start, many): runs of neighbouring starts, which come by row and step."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (step[1:] != step[:-1] + 1)
    a = np.flatnonzero(new)
    many = np.diff(np.append(a, len(row)))
    r = row[a]
    return pa.RecordBatch.from_arrays([pa.array(doc_id[r]), pa.array(h1[r]), pa.array(first[r] + step[a]), pa.array(many)], ["doc_id", "h1", "start", "many"])


def _compare(length: int):
    """Rows sorted by name, doc_id, h1 and position as runs of starts of repeated strings. A name is in memory whole; it has HOT rows at most."""

    def flush(t: pa.Table) -> pa.RecordBatch:
        name, doc_id, h1, at, first = (t.column(c).to_numpy() for c in ("name", "doc_id", "h1", "at", "first"))
        row, h = _string_names(name, at, first, t.column("around").to_pylist(), length)
        order = np.argsort(h, kind="stable")  # adjacent: equal strings, the earliest first
        again = np.zeros(len(h), bool)
        again[order[1:]] = h[order[1:]] == h[order[:-1]]
        start = np.searchsorted(row, np.arange(len(name)))
        step = np.arange(len(row)) - start[row]
        return _runs(doc_id, h1, first, row[again], step[again])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            name = b.column(0).to_numpy()
            if rows and (held[-1].column(0)[-1].as_py() != name[0]) and rows >= 4096:
                yield flush(pa.Table.from_batches(held))
                held, rows = [], 0
            change = np.flatnonzero(name[1:] != name[:-1])
            cut = int(change[-1]) + 1 if len(change) else 0
            if cut and rows + cut >= 4096:
                yield flush(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held, rows = [b.slice(cut)], b.num_rows - cut
            else:
                held.append(b)
                rows += b.num_rows
        if rows:
            yield flush(pa.Table.from_batches(held))

    return run


def _first_strings(length: int):
    """(string, doc_id, h1, start): the earliest of each string among the samples of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                t = b.slice(lo, 4096)
                name, doc_id, h1, at, first = (t.column(i).to_numpy() for i in range(5))
                row, h = _string_names(name, at, first, t.column(5).to_pylist(), length)
                start = first[row] + np.arange(len(row)) - np.searchsorted(row, np.arange(len(name)))[row]
                order = np.lexsort((start, h1[row], doc_id[row], h))
                order = order[np.concatenate(([True], h[order[1:]] != h[order[:-1]]))]
                r = row[order]
                yield pa.RecordBatch.from_arrays([pa.array(h[order].view(np.int64)), pa.array(doc_id[r]), pa.array(h1[r]), pa.array(start[order])], ["string", "doc_id", "h1", "start"])

    return run


def _cut(length: int):
    """(doc_id, h1, n_removed, n_spans, kept): texts without the bytes that the runs cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                t = b.slice(lo, 256)
                runs = t.column(3).flatten()
                start, many = runs.field("start").to_numpy(), runs.field("many").to_numpy()
                cuts = np.concatenate(([0], np.cumsum(pc.list_value_length(t.column(3)).to_numpy())))
                removed, spans, kept = [], [], []
                for text, i, j in zip(t.column(2).to_pylist(), cuts, cuts[1:]):
                    raw = (text or "").encode()
                    s, n = start[i:j], many[i:j]
                    first = s[n < 0]  # starts that the runs hold and that stay
                    begin = np.sort(np.concatenate((s[n > 0], first + 1)))
                    end = np.sort(np.concatenate(((s + n)[n > 0], first)))
                    begin, end = begin[end > begin], end[end > begin] - 1 + length
                    apart = np.flatnonzero(begin[1:] > end[:-1])
                    s = begin[np.concatenate(([0], apart + 1))].tolist() if len(begin) else []
                    e = end[np.append(apart, len(end) - 1)].tolist() if len(begin) else []
                    removed.append(sum(e) - sum(s))
                    spans.append(len(s))
                    kept.append(b"".join(raw[p:q] for p, q in zip([0, *e], [*s, len(raw)])))
                yield pa.RecordBatch.from_arrays(
                    [t.column(0), t.column(1), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                    ["doc_id", "h1", "n_removed", "n_spans", "kept"],
                )

    return run


def _narrow(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` whose id is in ``ids``, which is broadcast only where it is small."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def remove_repeats(df: DataFrame, length: int = 100, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary): one row per row of ``df``.

    A byte goes where a string of ``length`` bytes covers it that also starts earlier: in a document of smaller id,
    or before it in the same one. Strings are judged on the input. Matches never cross documents. Null texts are
    empty; texts shorter than ``length`` stay whole. Rows that repeat id and text are one document and have one
    result each; texts that share an id are ordered by a hash. Null ids come first. Other columns are not read.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    docs = df.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-(1 << 63)).cast("bigint")).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumn("h1", F.xxhash64("text"))
    base = staged(docs.select("doc_id", "h1", F.xxhash64("text", F.lit(7)).alias("h2"), F.octet_length("text").cast("bigint").alias("n_bytes")), "texts")
    long = base.filter(F.col("n_bytes") >= length)
    copies = long.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
    later = staged(long.join(copies, ["h1", "h2"]).filter("doc_id > least").select("doc_id", "h1").distinct(), "copies")
    first = docs.filter(F.octet_length("text") >= length)
    first = first.join(F.broadcast(later) if later.count() <= BROADCAST_IDS else later, ["doc_id", "h1"], "left_anti").select("doc_id", "h1", "text")

    sampled = first.dropDuplicates(["doc_id", "h1"]) if _repeats(base) else first
    rows = sampled.mapInArrow(_sample_rows(length), "name bigint, doc_id bigint, h1 bigint, at int")
    found = rows.repartition("name").sortWithinPartitions("name").mapInArrow(_repeated, "name bigint, doc_id bigint, h1 bigint, at int")
    found = staged(found, "samples")
    wanted = found.groupBy("doc_id", "h1").agg(F.collect_list("at").alias("wanted"))
    text_of = _narrow(sampled, found.select("doc_id").distinct())
    around = text_of.join(wanted, ["doc_id", "h1"]).select("doc_id", "h1", "text", "wanted").mapInArrow(
        _contexts(length), "name bigint, doc_id bigint, h1 bigint, at bigint, first bigint, around binary")
    hot_names = found.groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("name")
    hot_names = staged(hot_names, "hot")
    if hot_names.isEmpty():
        cool = around
    else:
        around = staged(around, "around")
        cool = around.join(hot_names, "name", "left_anti").select(*around.columns)
    runs = cool.repartition("name").sortWithinPartitions("name", "doc_id", "h1", "at").mapInArrow(_compare(length), "doc_id bigint, h1 bigint, start bigint, many bigint")
    if not hot_names.isEmpty():
        warm = around.join(hot_names, "name", "left_semi").select(*around.columns)
        # every string of a hot name repeats, but for the earliest of each, which many = -1 marks
        strings = warm.mapInArrow(_first_strings(length), "string bigint, doc_id bigint, h1 bigint, start bigint")
        earliest = strings.groupBy("string").agg(F.min(F.struct("doc_id", "h1", "start")).alias("s"))
        runs = runs.unionByName(warm.select("doc_id", "h1", F.col("first").alias("start"), (F.octet_length("around") - length + 1).cast("bigint").alias("many")))
        runs = runs.unionByName(earliest.select("s.*", F.lit(-1).cast("bigint").alias("many")))
    runs = staged(runs, "runs")
    by_doc = runs.groupBy("doc_id", "h1").agg(F.collect_list(F.struct("start", "many")).alias("runs"))
    cut = _narrow(sampled, runs.select("doc_id").distinct()).join(by_doc, ["doc_id", "h1"]).select("doc_id", "h1", "text", "runs")
    cut = cut.mapInArrow(_cut(length), "doc_id bigint, h1 bigint, n_removed bigint, n_spans bigint, kept binary")
    none = F.lit(0).cast("bigint")
    gone = later.select("doc_id", "h1", F.lit(None).cast("bigint").alias("n_removed"), F.lit(1).cast("bigint").alias("n_spans"), F.lit(b"").alias("kept"))
    changed = cut.unionByName(gone)
    changed = staged(changed, "changed")
    ids = changed.select("doc_id", "h1")
    whole = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, ["doc_id", "h1"], "left_anti")
    whole = whole.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    rest = base.join(changed, ["doc_id", "h1"]).select("doc_id", "n_bytes", F.coalesce("n_removed", "n_bytes").alias("n_removed"), "n_spans", "kept")
    dropped(found)
    out = whole.unionByName(rest)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")))


def _repeats(base: DataFrame) -> bool:
    """Whether rows repeat id and text."""
    return not base.groupBy("doc_id", "h1").count().filter("count > 1").isEmpty()
