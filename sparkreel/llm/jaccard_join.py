"""N-gram Jaccard join with set-relation skipping, and its groups.

Method. A document is the set of its distinct word shingles. Index lists: the
universe of shingles is cut into more positions than two linked sets can
differ in, so linked sets agree in several whole positions; a list holds the
sets of one size block that agree in one position. All other blocks and
positions are skipped unread, and so are positions with so few shingles that a linked
pair must also agree in a fuller one. Answers are then derived
from those of a similar set: in each list the least set is the pivot, every other
member is compared with it once and kept as its difference from the
pivot, and the links among members follow from the differences alone, as
|x ^ y| = |dx ^ dy|, without touching the sets again. Every linked pair shares
a list and so a pivot, which makes the groups exact.

Equal sets are one set. Lists are streams sorted by key and give one pair per
member; members of one pivot are compared in blocks, so a group of any size
stays bounded in memory, and links leave a block as stars.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, least_labels
from .shared import dropped, staged
from .textnum import mix, rounds, shingles, trimmed, words

_U = np.uint64
#: Members of a pivot that one block holds, and members that one task compares with a pivot.
BLOCK = 512
STAR = 512
_PROFILE_BITS = 7
PROFILE = 1 << _PROFILE_BITS
#: Members of a list up to which those that can link with none of the others are left out of it.
PRUNED = 256
#: Pairs of pivots and members up to which the units of documents are broadcast (16 MB); beyond, the texts are joined by a shuffle.
BROADCAST_PAIRS = 1 << 19
#: Ids of documents up to which they are broadcast (8 MB).
BROADCAST_IDS = 1 << 20


@dataclass(frozen=True)
class Rule:
    """Sets link when den * |x & y| >= num * |x | y|; shingles have k words."""

    k: int
    num: int
    den: int = 100

    def linked(self, n_x, n_y, differ):
        both = (n_x + n_y - differ) // 2
        return self.den * both >= self.num * (n_x + n_y - both)

    def blocks(self, most: int) -> np.ndarray:
        """The largest size of each size block; linked sets are in one block or in neighbouring ones."""
        out = [1]
        while out[-1] < most:
            out.append(max(out[-1] + 1, out[-1] * self.den // self.num))
        return np.array(out)

    def differ(self, largest: np.ndarray) -> np.ndarray:
        """In how many shingles a linked pair can differ whose smaller set has at most so many."""
        return (self.den - self.num) * (largest * self.den // self.num) // self.den

    @staticmethod
    def positions(differ: np.ndarray) -> np.ndarray:
        """Positions for such pairs: more than they can differ in, so linked sets agree in positions - differ at least."""
        return differ + 1 + -(-differ // 3)


def sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of the distinct shingles of each text of a round, by row and shingle."""
    _, _, row, h = words(data, offs)
    at, s = shingles(h, row, k)
    where = row[at]
    n = np.bincount(row, minlength=len(offs) - 1)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        first = np.searchsorted(row, short)
        extra = np.full(len(short), _U(0x5851F42D4C957F2D))
        for j in range(k - 1):
            more = n[short] > j
            extra[more] = mix(extra[more] * _U(0xD1342543DE82EF95) + h[first[more] + j])
        where, s = np.concatenate((where, short)), np.concatenate((s, extra))
    order = np.lexsort((s, where))
    where, s = where[order], s[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (where[1:] != where[:-1])
    return where[new], s[new]


def _profiles(row: np.ndarray, s: np.ndarray, rows: int) -> list[bytes]:
    """How many shingles of each set fall in each of PROFILE buckets, 255 at most.

    Two sets differ in at least as many shingles as the sum of the differences of their profiles.
    """
    bucket = (mix(s ^ _U(0x3C6EF372FE94F82B)) >> _U(64 - _PROFILE_BITS)).astype(np.int64)
    count = np.bincount(row * PROFILE + bucket, minlength=rows * PROFILE).reshape(rows, PROFILE)
    return [r.tobytes() for r in np.minimum(count, 255).astype(np.uint8)]


def _digest(row: np.ndarray, s: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, digest) of each set; the digest is a sum over the set, so the order does not matter."""
    n = np.bincount(row, minlength=rows)
    total = np.zeros(rows, _U)
    np.add.at(total, row, mix(s ^ _U(0xA0761D6478BD642F)))
    return n, mix(total + n.astype(_U)).view(np.int64)


def _sizes(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in rounds(b.column(1)):
                row, s = sets(data, offs, rule.k)
                n, key = _digest(row, s, hi - lo)
                cols = [b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(key, mask=n == 0), pa.array(_profiles(row, s, hi - lo), pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "h1", "n", "key", "profile"])

    return run


def _lists(rule: Rule):
    """(list, key): the lists that each set is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in rounds(b.column(0)):
                row, s = sets(data, offs, rule.k)
                if not len(s):
                    continue
                n, key = _digest(row, s, hi - lo)
                top = rule.blocks(int(n.max()))
                block = np.searchsorted(top, np.maximum(n, 1))
                spread, code = mix(s ^ _U(0x2545F4914F6CDD1D)) >> _U(32), mix(s)
                for down in (0, 1):
                    cls = block - down
                    differ = rule.differ(top[np.maximum(cls, 0)])
                    parts = np.where((n > 0) & (cls >= 0), rule.positions(differ), 0)
                    base = np.concatenate(([0], np.cumsum(parts)))
                    inside = parts[row] > 0
                    r = row[inside]
                    slot = base[r] + ((spread[inside] * parts[r].astype(_U)) >> _U(32)).astype(np.int64)
                    total = np.zeros(base[-1], _U)
                    np.add.at(total, slot, code[inside])
                    size = np.bincount(slot, minlength=base[-1])
                    owner = np.repeat(np.arange(hi - lo), parts)
                    least = _least_sizes(size, owner, parts - differ)
                    keep = np.flatnonzero(size >= least[owner])
                    owner = owner[keep]
                    name = mix(total[keep] + mix((cls[owner].astype(_U) << _U(32)) + (keep - base[owner]).astype(_U)))
                    yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(key[owner])], ["list", "key"])

    return run


def _least_sizes(size: np.ndarray, owner: np.ndarray, agree: np.ndarray) -> np.ndarray:
    """For each set, the largest m (up to 6) of which fewer of its positions than ``agree`` hold less than m shingles.

    A linked pair agrees in ``agree`` positions or more. Take the larger m of the two: fewer of that set's positions than
    that are below m, so the pair agrees in one that both sets list.
    """
    least = np.zeros(len(agree), np.int64)
    for m in range(1, 7):
        below = np.bincount(owner[size < m], minlength=len(agree))
        least[(below < agree) & (least == m - 1)] = m
    return least


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists, sorted by list and key, as distinct (list, key) of those with two different members at least."""
    held = np.zeros((2, 0), np.int64)
    for b in batches:
        rows = np.concatenate((held, np.stack((b.column(0).to_numpy(), b.column(1).to_numpy()))), axis=1)
        if not rows.shape[1]:
            continue
        new = np.ones(rows.shape[1], bool)
        new[1:] = (rows[:, 1:] != rows[:, :-1]).any(0)
        rows = rows[:, new]
        same = np.zeros(rows.shape[1] + 1, bool)
        same[1:-1] = rows[0, 1:] == rows[0, :-1]
        keep = same[1:] | same[:-1]
        # the last row waits for the next batch, with the one before it if that is of its list
        last = rows.shape[1] - (2 if same[-2] else 1)
        out, held = rows[:, :last][:, keep[:last]], rows[:, last:]
        yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1])], ["list", "key"])
    if held.shape[1] == 2:
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], ["list", "key"])


def _stars(rule: Rule):
    """Lists, sorted by list and key, as distinct (pivot, member): the first of each list with each other one.

    Members whose profiles rule out a link with every other member are left out of the list before. A list of more
    than PRUNED members stays as it is; it comes in pieces, the first of which names the pivot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, pivot, keys, n, profiles = None, None, [], [], []

        def pairs() -> tuple[np.ndarray, np.ndarray]:
            k = np.array(keys, np.int64)
            if pivot is None and len(k) > 1:
                p = np.frombuffer(b"".join(profiles), np.uint8).reshape(len(k), PROFILE).astype(np.int16)
                size = np.array(n)
                far = np.stack([np.abs(p - row).sum(1) for row in p])
                near = rule.linked(size[:, None], size[None, :], np.maximum(far, np.abs(size[:, None] - size[None, :])))
                np.fill_diagonal(near, False)
                k = k[near.any(1)]
            first = pivot if pivot is not None else k[0] if len(k) else 0
            k = k[k != first]
            return np.full(len(k), first, np.int64), k

        for b in batches:
            found = []
            for l, k, m, p in zip(*(c.to_pylist() for c in b.columns)):
                if l != name:
                    found.append(pairs())
                    name, pivot, keys, n, profiles = l, None, [], [], []
                elif len(keys) >= PRUNED:
                    pivot = keys[0] if pivot is None else pivot
                    found.append(pairs())
                    keys, n, profiles = [], [], []
                keys.append(k)
                n.append(m)
                profiles.append(p)
            got = np.unique(np.concatenate([np.stack(x) for x in found], axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1])], ["pivot", "key"])
        got = pairs()
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], ["pivot", "key"])

    return run


def _set_rows(rule: Rule):
    """(unit, side, pivot, key, shingles): the set of each document for every unit of work that it is in."""
    names = ["unit", "side", "pivot", "key", "shingles"]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in rounds(b.column(1)):
                row, s = sets(data, offs, rule.k)
                _, digest = _digest(row, s, hi - lo)
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                out = []
                for i, (key, units) in enumerate(zip(b.column(0).slice(lo, hi - lo).to_pylist(), b.column(2).slice(lo, hi - lo).to_pylist())):
                    if digest[i] == key:  # else another text of that id
                        raw = s[cut[i] : cut[i + 1]].tobytes()
                        out += [(u["unit"], u["side"], u["pivot"], key, raw) for u in units]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return run


def _differences(rule: Rule):
    """Units sorted so that the pivot's set comes before its members': (pivot, key, n, differ, linked)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, own = None, None
        for b in batches:
            units, side, pivot, key, raw = (b.column(i).to_pylist() for i in range(5))
            out = []
            for i, u in enumerate(units):
                s = np.frombuffer(raw[i], _U)
                if side[i] == 0:
                    unit, own = u, s
                elif u == unit:
                    d = np.setxor1d(own, s, assume_unique=True)
                    out.append((pivot[i], key[i], len(s), d.tobytes(), bool(rule.linked(len(own), len(s), len(d)))))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()))], ["pivot", "key", "n", "differ", "linked"])
            out = raw = cols = None
            trimmed()

    return run


def _derived(rule: Rule, n: np.ndarray, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of members that link, from their differences alone."""
    size = np.array([len(r) // 8 for r in raw])
    item = np.frombuffer(b"".join(raw), _U)
    owner = np.repeat(np.arange(len(raw)), size)
    order = np.argsort(item, kind="stable")
    item, owner = item[order], owner[order]
    cut = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1], [True])))
    many = np.diff(cut)
    m = len(raw)
    shared = np.zeros(m * m, np.int64)
    for f in np.unique(many[many > 1]):  # elements that f members differ in, all at once
        start = cut[:-1][many == f]
        step = max(1, (1 << 20) // int(f * f))
        for lo in range(0, len(start), step):
            who = owner[start[lo : lo + step, None] + np.arange(f)]
            shared += np.bincount((who[:, :, None] * m + who[:, None, :]).ravel(), minlength=m * m)
    differ = size[:, None] + size[None, :] - 2 * shared.reshape(m, m)
    i, j = np.nonzero(rule.linked(n[:, None], n[None, :], differ))
    return i[i < j], j[i < j]


def _answers(rule: Rule):
    """Units of one or two blocks of a pivot's members as links."""

    def flush(keys, n, raw):
        i, j = _derived(rule, np.array(n), raw)
        ids, label = least_labels(np.array(keys)[i], np.array(keys)[j])
        keep = ids != label
        return pa.RecordBatch.from_arrays([pa.array(label[keep]), pa.array(ids[keep])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, keys, n, raw = None, [], [], []
        for b in batches:
            for u, k, m, r in zip(*(c.to_pylist() for c in b.columns)):
                if u != unit:
                    if len(keys) > 1:
                        yield flush(keys, n, raw)
                    unit, keys, n, raw = u, [], [], []
                keys.append(k)
                n.append(m)
                raw.append(r)
        if len(keys) > 1:
            yield flush(keys, n, raw)

    return run


def _spot(col: str, n, salt: int) -> F.Column:
    return F.pmod(F.xxhash64(col, F.lit(salt)), n).cast("int")


def groups(df: DataFrame, rule: Rule, doc_id: str = "doc_id", text: str = "text", hashed: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of ``df``; with ``hashed`` also ``h1``, the xxhash64 of its text, which tells rows of one id apart.

    ``component_id`` is the least doc_id that links lead to, itself included. A text with fewer than k words is
    one shingle, its whole sequence; null texts and texts without words are empty and link with nothing, each
    other included. Rows that repeat an id are documents of their own. Columns other than the two named are not
    read, so their names cannot clash. Ids must be integers; a null id stays, and joins groups through its text only.
    """
    docs = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    known = staged(docs.withColumn("h1", F.xxhash64("text")).mapInArrow(_sizes(rule), "doc_id bigint, h1 bigint, n bigint, key bigint, profile binary"), "sets")
    lists = docs.select("text").mapInArrow(_lists(rule), "list bigint, key bigint")
    lists = lists.repartition("list").sortWithinPartitions("list", "key")
    lists = staged(lists.mapInArrow(_shared, "list bigint, key bigint"), "lists")
    profiles = known.filter("key is not null").groupBy("key").agg(F.first("n").alias("n"), F.first("profile").alias("profile"))
    lists = lists.join(profiles, "key").select("list", "key", "n", "profile").repartition("list").sortWithinPartitions("list", "key")
    stars = staged(lists.mapInArrow(_stars(rule), "pivot bigint, key bigint").distinct(), "stars")

    spread = stars.groupBy("pivot").agg(F.count("*").alias("members")).withColumn("salts", F.ceil(F.col("members") / STAR).cast("int"))
    spread = staged(spread, "spread")
    unit = F.struct(F.xxhash64("pivot", "salt").alias("unit"), F.col("side"), F.col("pivot"))
    centre = spread.select(F.col("pivot").alias("key"), "pivot", F.lit(0).alias("side"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    member = stars.join(spread, "pivot").select("key", "pivot", F.lit(1).alias("side"), _spot("key", F.col("salts"), 1).alias("salt"))
    wanted = centre.unionByName(member).groupBy("key").agg(F.collect_list(unit).alias("units"))
    reps = known.filter("doc_id is not null").join(wanted.select("key"), "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    wanted = staged(reps.join(wanted, "key"), "wanted")
    small = stars.count() <= BROADCAST_PAIRS
    found = docs.join(F.broadcast(wanted) if small else wanted, "doc_id").select("key", "text", "units")
    units = found.mapInArrow(_set_rows(rule), "unit bigint, side int, pivot bigint, key bigint, shingles binary")
    units = units.repartition("unit").sortWithinPartitions("unit", "pivot", "side")
    near = staged(units.mapInArrow(_differences(rule), "pivot bigint, key bigint, n bigint, differ binary, linked boolean"), "near")

    many = spread.filter("members > 1").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    rest = near.join(many, "pivot").withColumn("own", _spot("key", F.col("blocks"), 2))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select(F.xxhash64("pivot", F.least("own", "other"), F.greatest("own", "other")).alias("unit"), "key", "n", "differ")
    rest = rest.repartition("unit").sortWithinPartitions("unit")
    links = near.filter("linked").select(F.col("pivot").alias("a"), F.col("key").alias("b")).unionByName(rest.mapInArrow(_answers(rule), "a bigint, b bigint"))
    links = staged(links, "links")
    label = components(links)

    all_sets = known.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("least")).join(label.withColumnRenamed("id", "key"), "key", "left")
    all_sets = staged(all_sets.select("key", "least", F.coalesce("component", "key").alias("component")), "labelled")
    least = all_sets.groupBy("component").agg(F.min("least").alias("component_id"))
    by_key = all_sets.join(least, "component").select("key", "component_id")
    out = known.join(by_key, "key", "left").select("doc_id", *(["h1"] if hashed else []), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    for x in (stars, wanted, spread, near, links):
        dropped(x)
    return out
