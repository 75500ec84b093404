"""MinHash near-duplicate detection.

A text's set holds the hashes of its distinct five-word shingles (words in
A-Z lower case; with fewer words the whole sequence is the one shingle).
Texts with equal sets collapse into a class first.  Classes get a
one-permutation signature: the range of hashes is cut into bins, each keeps
its least hash, and empty bins borrow by optimal densification.  Bands of the
signature put classes into buckets.

Within a bucket, sorted by set size, each class gets a few candidate edges: to
the bucket's first class of fitting size (a star) and to its predecessors one
and three places back.  Candidates are thus linear in the bucket's size.  Each
map task links its own members first and sends the smallest and the largest
class of each bucket and size range, so a hot bucket is small where it is joined
and any two members of fitting size lie on an unbroken chain of candidates.

Candidate edges whose signatures differ far too much are dropped (see
``SPREAD``); the rest are confirmed on full sets: first the best edge of each
class, then whatever still joins two components.  Where a bucket holds classes
of different components after that, all members of these components go through
an exact search: two linked sets share an element of their prefixes (their
rarest parts under one order), so cross-component pairs from prefix postings,
filtered by size and place, are all that can be left.  A posting list that is
too long for one task is dealt out by size range and pairs of pieces.
Components come from alternating large-star and small-star steps on written
tables.

Defined results: a null or empty text, or one of white space, has an empty set
and is linked with nothing; a row without id is linked with nothing, has no
component and is kept; rows that share an id are one document, whose texts all
link it; repeated rows get equal results; texts of any length are used whole;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHOLE, arrow_schema, behind, discard, held, slices, stored

#: Words in a shingle, and least similarity of linked sets in per cent.
WORDS, PERCENT = 5, 75
#: Bins of the signature, rows in a band, bins kept for the first comparison.
BINS, ROWS, SKETCH = 256, 5, 128
#: Standard errors below the least similarity at which a candidate is dropped unseen.
SPREAD = 5.0
#: Bits of a hash by which its commonness is counted, and commonest values told apart, at most.
SLOT_BITS, COMMON = 22, 65_536
#: Members of a posting list that are compared in one go; longer lists are dealt out in pieces of this size, or of
#: four times the root of the list's length: a piece grows slower than the number of pieces does.
LIST = 400
#: Copies of a component's mark, so that one with most of the members is joined in several tasks.
SALT = 16
#: Members that share one copy of a star's centre while they are confirmed, and classes that are linked at once in a map task.
CHUNK, HEADS = 64, 2_000
_CACHE_WORDS, _CACHE_BYTES = 200_000, 64
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= _CACHE_BYTES:
            if len(self) >= _CACHE_WORDS:
                self.clear()
            self[word] = value
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes; bytes' own lower() and split() know ASCII only, as is asked for."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(held("word hashes", _WordHashes).__getitem__, words), np.uint64, len(words))
    n = min(WORDS, len(w))
    total = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        total = total * _MULTIPLIER + w[i : len(w) - n + 1 + i]
    return np.unique(_mix(total))


@functools.lru_cache(maxsize=32)
def _borrowing(block: int) -> np.ndarray:
    """For attempt and bin the bin to borrow from, the same for every set: attempts in blocks of 64."""
    attempt, at = np.meshgrid(np.arange(64 * block + 1, 64 * block + 65, dtype=np.uint64), np.arange(BINS, dtype=np.uint64), indexing="ij")
    return (_mix(attempt * np.uint64(1_000_003) + at * _MULTIPLIER) % np.uint64(BINS)).astype(np.int64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """One-permutation signature, densified: each empty bin tries others in an order of its own until one is filled."""
    places = np.searchsorted(hashes, np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1))
    ends = np.append(places[1:], len(hashes))
    filled = places < ends
    out = np.zeros(BINS, np.uint64)
    out[filled] = hashes[places[filled]]
    if np.count_nonzero(filled) == 1:
        out[:] = out[filled]
        return out
    empty = np.flatnonzero(~filled)
    for block in itertools.count():
        if not len(empty):
            return out
        source = _borrowing(block)[:, empty]
        ok = filled[source]
        any_ = ok.any(axis=0)
        first = source[ok.argmax(axis=0), np.arange(len(empty))]
        out[empty[any_]] = out[first[any_]]
        empty = empty[~any_]


def bands(sig: np.ndarray) -> np.ndarray:
    n = BINS // ROWS
    rows = sig[: n * ROWS].reshape(n, ROWS)
    total = np.arange(1, n + 1, dtype=np.uint64)
    for i in range(ROWS):
        total = _mix(total * _MULTIPLIER + rows[:, i])
    return total.view(np.int64)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two full sets are similar enough; empty sets are linked with nothing."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= PERCENT * (len(both) - common)


def _table(schema, columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def sketches(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n, k1, k2, bands, sketch``: set size and digest, band hashes as bytes and one byte of each of ``SKETCH`` bins."""
    target = docs.sparkSession.createDataFrame([], "doc_id long, n long, k1 long, k2 long, bands binary, sketch binary").schema
    schema = arrow_schema(target)

    def run(batches):
        for batch in slices(batches):
            out = [[], [], [], [], []]
            for t in batch.column(1):
                h = shingles(t.as_py())
                sig = signature(h) if len(h) else None
                out[0].append(len(h))
                out[1].append(int(np.sum(_mix(h ^ np.uint64(1))).view(np.int64)) if len(h) else 0)
                out[2].append(int(np.sum(_mix(h ^ np.uint64(2))).view(np.int64)) if len(h) else 0)
                out[3].append(bands(sig).tobytes() if len(h) else b"")
                out[4].append(sig[:SKETCH].astype(np.uint8).tobytes() if len(h) else b"")
            yield _table(schema, [batch.column(0).cast(pa.int64()), *out])

    return docs.select(key, text).mapInArrow(run, target)


class _Tail:
    """The edges that a run of one bucket's members gives, size by size."""

    def __init__(self):
        self.first, self.recent = None, []

    def add(self, c: int, n: int) -> Iterator[tuple[int, int]]:
        partners = {m for m, k in (self.recent[-1:] + self.recent[:1] if len(self.recent) == 3 else self.recent[-1:]) if 100 * k >= PERCENT * n}
        if self.first is None or 100 * self.first[1] < PERCENT * n:
            self.first = (c, n)
        else:
            partners.add(self.first[0])
        self.recent = [*self.recent[-2:], (c, n)]
        for p in partners:
            if p != c:
                yield (p, c) if p < c else (c, p)


def _bucket_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bands, classes and sizes of a batch of classes, sorted by band and size."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    sizes = batch.column(1).to_numpy(zero_copy_only=False)
    b = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64)
    each = BINS // ROWS
    c, n = np.repeat(ids, each), np.repeat(sizes, each)
    order = np.lexsort((c, n, b))
    return b[order], c[order], n[order]


def _edges_of(b: np.ndarray, c: np.ndarray, n: np.ndarray) -> Iterator[list[tuple[int, int]]]:
    """Candidate edges of sorted bucket rows, some at a time; buckets of one are passed over at once."""
    same = np.append(b[1:] == b[:-1], False)
    shared = np.flatnonzero(same | np.append(False, same[:-1]))
    edges: set[tuple[int, int]] = set()
    last, tail = None, None
    for i in range(0, len(shared), 20_000):
        at = shared[i : i + 20_000]
        for band, x, k in zip(b[at].tolist(), c[at].tolist(), n[at].tolist(), strict=True):
            if band != last:
                last, tail = band, _Tail()
            edges.update(tail.add(x, k))
        if len(edges) > 50_000:
            yield list(edges)
            edges.clear()
    yield list(edges)


def candidate_edges(classes: DataFrame) -> DataFrame:
    """Distinct candidate edges ``a < b`` between classes ``c, n, bands``."""
    spark = classes.sparkSession
    edge = spark.createDataFrame([], "a long, b long").schema
    bucket = spark.createDataFrame([], "band long, c long, n long").schema
    edge_schema, bucket_schema = arrow_schema(edge), arrow_schema(bucket)
    rows = classes.where("n > 0").select("c", "n", "bands")

    def local(batches):
        for batch in slices(batches, HEADS):
            for edges in _edges_of(*_bucket_rows(batch)):
                yield _table(edge_schema, list(zip(*edges, strict=True)) or [[], []])

    def heads(batches):
        """The smallest and the largest class for each bucket of a batch and each size range.

        With both, ranges of different batches that could hold a pair of fitting
        size are neighbours, or have neighbours between them, in the joined order.
        """
        for batch in slices(batches, HEADS):
            b, c, n = _bucket_rows(batch)
            keep = np.zeros(len(b), bool)
            start = np.append(True, b[1:] != b[:-1])
            keep[start] = True
            inner = np.flatnonzero(~start)
            if len(inner):
                last, size, before = None, 0, None
                members = np.flatnonzero(~(start & np.append(start[1:], True)))
                for i, band, k in zip(members.tolist(), b[members].tolist(), n[members].tolist(), strict=True):
                    if band != last or 100 * size < PERCENT * k:
                        last, size = band, k
                        keep[i] = True
                        if before is not None:
                            keep[before] = True
                    before = i
                keep[before] = True
            yield _table(bucket_schema, [b[keep], c[keep], n[keep]])

    def joined(batches):
        last, tail = None, None
        for batch in slices(batches, WHOLE):
            b, c, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            edges: set[tuple[int, int]] = set()
            for band, x, k in zip(b.tolist(), c.tolist(), n.tolist(), strict=True):
                if band != last:
                    last, tail = band, _Tail()
                edges.update(tail.add(x, k))
            yield _table(edge_schema, list(zip(*edges, strict=True)) or [[], []])

    across = rows.mapInArrow(heads, bucket).repartition("band").sortWithinPartitions("band", "n", "c").mapInArrow(joined, edge)
    return rows.mapInArrow(local, edge).unionByName(across).distinct()


def _plausible(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """Candidates with their estimated similarity, without those that are far too different."""
    left = classes.select(F.col("c").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    right = classes.select(F.col("c").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    both = edges.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")
    target = edges.sparkSession.createDataFrame([], "a long, b long, likeness double").schema
    schema = arrow_schema(target)

    def run(batches):
        for batch in slices(batches, WHOLE):
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SKETCH) for i in (4, 5))
            n = np.minimum(*(batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3)))
            same = (x == y).mean(axis=1)
            p = PERCENT / 100
            least = p - SPREAD * np.sqrt(p * (1 - p) / np.minimum(SKETCH, np.maximum(1, n)))
            yield _table(schema, [batch.column(i).filter(pa.array(same >= least)) for i in (0, 1)] + [same[same >= least]])

    return both.mapInArrow(run, target)


def _confirmed(edges: DataFrame, texts: DataFrame) -> DataFrame:
    """The edges whose full sets are similar enough.

    A centre's text goes once to each chunk of its members; members stream
    past it in sorted partitions, so a task holds two sets.
    """
    spark = edges.sparkSession
    # The end with more edges is the centre.
    # Written first, so that a join splits the edges of a very common end.
    degree = stored(edges.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count("*").alias("d")))
    e = edges.select("a", "b").join(degree.select(F.col("c").alias("a"), F.col("d").alias("d_a")), "a")
    e = e.join(degree.select(F.col("c").alias("b"), F.col("d").alias("d_b")), "b")
    swap = F.col("d_b") > F.col("d_a")
    e = e.select(
        F.when(swap, F.col("b")).otherwise(F.col("a")).alias("centre"),
        F.when(swap, F.col("a")).otherwise(F.col("b")).alias("member"),
        F.greatest("d_a", "d_b").alias("d"),
    )
    e = e.withColumn("chunk", F.expr(f"pmod(xxhash64(member), 1 + d div {CHUNK})"))
    members = e.select("centre", "chunk", F.col("member").alias("c")).join(texts, "c")
    centres = e.select("centre", "chunk").distinct().join(texts.withColumnRenamed("c", "centre"), "centre")
    both = centres.select("centre", "chunk", F.lit(None).cast("long").alias("member"), "text").unionByName(members.select("centre", "chunk", F.col("c").alias("member"), "text"))
    both = both.repartition("centre", "chunk").sortWithinPartitions("centre", "chunk", F.col("member").asc_nulls_first())
    target = spark.createDataFrame([], "a long, b long").schema
    schema = arrow_schema(target)

    def run(batches):
        at, centres = None, None
        for batch in slices(batches):
            out = []
            for centre, chunk, member, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if member is None:
                    if (centre, chunk) != at:
                        at, centres = (centre, chunk), []
                    centres.append(shingles(text))
                else:
                    s = shingles(text)
                    if any(linked(h, s) for h in centres):
                        out.append((min(centre, member), max(centre, member)))
            yield _table(schema, list(zip(*out, strict=True)) or [[], []])

    return both.mapInArrow(run, target).distinct()


def _local_forest(edges: DataFrame) -> DataFrame:
    """Edges ``u > v`` with the same components, from each task's own forest: no more than its nodes, and flat."""
    target = edges.sparkSession.createDataFrame([], "u long, v long").schema
    schema = arrow_schema(target)

    def run(batches):
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = root[up]
                x = up
            return x

        for batch in slices(batches, WHOLE):
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = find(a), find(b)
                if x != y:
                    root[max(x, y)] = min(x, y)
        rows = [(x, r) for x in list(root) if (r := find(x)) != x]
        yield _table(schema, list(zip(*rows, strict=True)) or [[], []])

    return edges.mapInArrow(run, target)


def components(links: DataFrame) -> DataFrame:
    """``c, component``: the smallest member reachable, for every linked member.

    Each task first reduces its own edges to flat trees.  Then two steps
    alternate until all edges are stars: every node hands its larger neighbours
    to its least neighbour, then its smaller ones.  Tables are written between
    rounds.
    """
    edges = stored(_local_forest(links.select("a", "b")).distinct())
    while True:
        # Stars: nobody's parent has a parent, and nobody has two.
        parents = edges.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"))
        loose = parents.where("low <> high").select("u").unionByName(edges.join(parents.select(F.col("u").alias("v")), "v", "left_semi").select("u"))
        if loose.isEmpty():
            found = edges.select(F.col("u").alias("c"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("c"), F.col("v").alias("component")).distinct())
            return behind(found, edges)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = stored(small)
        discard(edges)
        edges = after


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (_mix(hashes) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _prefix(hashes: np.ndarray, common: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The rarest part of a set that any linked set must meet, in a fixed order: by the count of the hash's slot, then by hash."""
    n = len(hashes)
    slot = _slot(hashes)
    known = np.minimum(np.searchsorted(common, slot), max(0, len(common) - 1))
    rank = np.where(common[known] == slot, count[known], 0) if len(common) else np.zeros(n, np.int64)
    return hashes[np.lexsort((hashes, rank))][: n + (-PERCENT * n // 100) + 1]


def _crossing_pairs(c: np.ndarray, n: np.ndarray, at: np.ndarray, comp: np.ndarray, side: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs of different components from the sets that share a prefix hash, if sizes and places leave room for enough overlap.

    Two members whose ``side`` has a bit in common are not compared.
    """
    for i in range(0, len(c), 512):
        s, t = slice(i, i + 512), slice(0, i + 512)
        total = n[s, None] + n[None, t]
        room = np.minimum((n - at)[s, None], (n - at)[None, t])
        ok = (room >= -(-PERCENT * total // (100 + PERCENT))) & (comp[s, None] != comp[None, t]) & ((side[s, None] & side[None, t]) == 0)
        ok &= 100 * np.minimum(n[s, None], n[None, t]) >= PERCENT * np.maximum(n[s, None], n[None, t])
        x, y = np.nonzero(ok)
        x += i
        later = x > y
        a, b = c[x[later]], c[y[later]]
        yield np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)


def _pairs_of_lists(postings: DataFrame, key: list[str]) -> DataFrame:
    """Crossing pairs within each list of ``key``; pairs leave as they come, and a list of one component is passed over."""
    edge = postings.sparkSession.createDataFrame([], "a long, b long").schema
    edge_schema = arrow_schema(edge)

    def run(batches):
        parts: list[list[np.ndarray]] = []

        def close():
            if not parts:
                return
            c, n, at, comp, side = (np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True))
            parts.clear()
            if len(c) > 1 and (comp != comp[0]).any():
                for found in _crossing_pairs(c, n, at, comp, side):
                    if len(found):
                        found = np.unique(found, axis=0)
                        yield _table(edge_schema, [found[:, 0], found[:, 1]])

        last = None
        for batch in slices(batches, WHOLE):
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            keys, rest = columns[: len(key)], columns[len(key) :]
            new = np.zeros(batch.num_rows, bool)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            new[0] = True
            starts = np.flatnonzero(new)
            for s, e in zip(starts.tolist(), np.append(starts[1:], batch.num_rows).tolist(), strict=True):
                at = tuple(k[s] for k in keys)
                if at != last:
                    yield from close()
                    last = at
                parts.append([x[s:e] for x in rest])
        yield from close()

    rows = postings.select(*key, "c", "n", "at", "component", "side")
    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, edge)


def _remaining_edges(members: DataFrame) -> DataFrame:
    """Every edge that could still join two components, among ``c, component, text``.

    Exact: linked sets share an element of their prefixes under any fixed order
    of the hashes.  The order only decides how few pairs come out: hashes are
    counted over all members, by slot, and common ones come last.
    """
    spark = members.sparkSession
    counted = spark.createDataFrame([], "slot long, k long").schema
    counted_schema = arrow_schema(counted)

    def count(batches):
        total = np.zeros(1 << SLOT_BITS, np.int32)
        for batch in slices(batches):
            for t in batch.column(0):
                np.add.at(total, _slot(shingles(t.as_py())), 1)
        for i in range(0, len(total), 1 << 17):
            slot = np.flatnonzero(total[i : i + (1 << 17)])
            yield _table(counted_schema, [slot + i, total[slot + i].astype(np.int64)])

    top = members.select("text").mapInArrow(count, counted).groupBy("slot").agg(F.sum("k").alias("k")).where("k > 2").orderBy(F.desc("k"), "slot").limit(COMMON).toArrow()
    common, times = (top.column(i).to_numpy().astype(np.int64) for i in (0, 1))
    order = np.argsort(common)
    # COMMON bounds it.
    shared = spark.sparkContext.broadcast((common[order], times[order]))
    posting = spark.createDataFrame([], "h long, c long, n int, at int, component long").schema
    posting_schema = arrow_schema(posting)

    def post(batches):
        for batch in slices(batches):
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for c, component, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                h = shingles(t.as_py())
                p = _prefix(h, *shared.value)
                for o, v in zip(out, (p.view(np.int64), np.full(len(p), c), np.full(len(p), len(h)), np.arange(len(p)), np.full(len(p), component)), strict=True):
                    o.append(v)
            if out[0]:
                yield _table(posting_schema, [np.concatenate(o).astype(k) for o, k in zip(out, (np.int64, np.int64, np.int32, np.int32, np.int64), strict=True)])

    postings = stored(members.select("c", "component", "text").mapInArrow(post, posting))
    # Lists that join components at all; how long they are decides who compares them.
    lists = postings.groupBy("h").agg(F.count("*").alias("m"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    lists = stored(lists.select("h", "m"))
    short = postings.join(lists.where(F.col("m") <= LIST).select("h"), "h", "left_semi").withColumn("side", F.lit(0))
    edges = _pairs_of_lists(short, ["h"])
    long = lists.where(F.col("m") > LIST)
    if not long.isEmpty():
        edges = edges.unionByName(_pairs_of_lists(_dealt(postings, long), ["h", "size_range", "i", "j"]))
    edges = stored(edges.distinct())
    discard(postings)
    discard(lists)
    return edges


def _dealt(postings: DataFrame, long: DataFrame) -> DataFrame:
    """Long lists in parts ``h, size_range, i, j`` that hold each pair of fitting size once.

    Sets of fitting size are in one size range or in neighbouring ones: a
    member goes to its own range and, as a guest, to the next.  A range's members are
    dealt into pieces, and each pair of pieces is a part.
    """
    pieces = F.ceil(F.col("m") / F.greatest(F.lit(float(LIST)), 4 * F.sqrt("m"))).cast("int")
    own = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(-np.log(PERCENT / 100))) + 1e-9).cast("int")
    rows = postings.join(long, "h").withColumn("piece", F.pmod(F.xxhash64("c"), pieces).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), pieces - 1))).withColumn("guest", F.explode(F.array(F.lit(0), F.lit(1))))
    first, second = F.least("piece", "other"), F.greatest("piece", "other")
    # Guests are not compared with guests (bit 1), nor, in a part of two pieces, members of one piece (bits 2 and 3).
    side = F.col("guest") + F.when(F.col("piece") == F.col("other"), F.lit(0)).when(F.col("piece") < F.col("other"), F.lit(2)).otherwise(F.lit(4))
    return rows.select("h", (own + F.col("guest")).alias("size_range"), first.alias("i"), second.alias("j"), "c", "n", "at", "component", side.cast("int").alias("side"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = stored(sketches(docs))
    grouped = rows.where("doc_id IS NOT NULL AND n > 0").groupBy("k1", "k2", "n")
    classes = stored(grouped.agg(F.min("doc_id").alias("c"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    candidates = stored(candidate_edges(classes))
    edges = stored(_plausible(candidates, classes))
    ends = candidates.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    # A merge at every size: the candidates grow with the documents.
    texts = stored(docs.join(ends.hint("merge"), "doc_id", "left_semi").select(F.col("doc_id").alias("c"), "text"))

    # The likeliest partner of each class first; then what still joins two components.
    best = edges.groupBy("b").agg(F.max(F.struct("likeness", (-F.col("a")).alias("a"))).alias("best"))
    links = _confirmed(best.select((-F.col("best.a")).alias("a"), "b"), texts)
    several = _of_several_texts(rows)
    links = stored(links if several is None else links.unionByName(_same_document(rows, classes, several)))
    found = components(links)
    # Components only grow: edges inside one are looked at no more.
    crossing = stored(_between(candidates, found).select("a", "b"))
    second = stored(_confirmed(edges.select("a", "b").join(crossing, ["a", "b"], "left_semi"), texts))
    if not second.isEmpty():
        discard(found)
        found = components(both := stored(links.unionByName(second)))
        discard(links)
        links = both

    # Last, components that a bucket brings together but no edge has joined: all their members, exactly.
    open_ = _between(crossing, found).select(F.explode(F.array("of_a", "of_b")).alias("component")).distinct()
    # One component may hold most of the members: its mark goes to several tasks.
    open_ = open_.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALT)))))
    members = texts.join(found, "c", "left").select("c", F.coalesce("component", "c").alias("component"), "text").withColumn("salt", F.pmod(F.xxhash64("c"), F.lit(SALT)).cast("int"))
    members = stored(members.join(open_, ["component", "salt"], "left_semi").select("c", "component", "text"))
    remaining = _remaining_edges(members)
    third = stored(_confirmed(remaining, texts))
    final = found if third.isEmpty() else components(links.unionByName(third))

    labelled = classes.select("k1", "k2", "n", "c").join(final, "c", "left").select("k1", "k2", "n", F.coalesce("component", "c").alias("component_id"))
    out = rows.select("doc_id", "k1", "k2", "n").join(labelled, ["k1", "k2", "n"], "left")
    if several is not None:  # an empty text of an id that has others is where they are
        by_id = out.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("by_id"))
        out = out.join(by_id, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "by_id"))
    # An empty set is a component of its own.
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    for used in (texts, edges, candidates, crossing, members, remaining, links, second, third, *([found] if final is not found else [])):
        discard(used)
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _of_several_texts(rows: DataFrame) -> DataFrame | None:
    """Ids whose rows have different sets; None if there is no such id."""
    named = rows.where("doc_id IS NOT NULL")
    several = named.groupBy("doc_id").agg(*[f(k).alias(f"{f.__name__}_{k}") for k in ("k1", "k2", "n") for f in (F.min, F.max)])
    several = stored(several.where("min_k1 <> max_k1 OR min_k2 <> max_k2 OR min_n <> max_n").select("doc_id"))
    if several.isEmpty():
        discard(several)
        return None
    return several


def _same_document(rows: DataFrame, classes: DataFrame, several: DataFrame) -> DataFrame:
    """Links ``a < b`` between the classes of one id that has several texts."""
    of = rows.where("n > 0").join(several, "doc_id", "left_semi").join(classes.select("k1", "k2", "n", "c"), ["k1", "k2", "n"]).select("doc_id", "c").distinct()
    least = of.groupBy("doc_id").agg(F.min("c").alias("a"))
    return of.join(least, "doc_id").where("a < c").select("a", F.col("c").alias("b")).distinct()


def _between(edges: DataFrame, found: DataFrame) -> DataFrame:
    """Edges whose ends are in different components, with these as ``of_a`` and ``of_b``."""
    of = lambda end: found.select(F.col("c").alias(end), F.col("component").alias(f"of_{end}"))
    out = edges.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return out.select("a", "b", F.coalesce("of_a", "a").alias("of_a"), F.coalesce("of_b", "b").alias("of_b")).where("of_a <> of_b")
