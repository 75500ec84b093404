"""Suffix-array deduplication of repeated byte strings.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts
anywhere else, in the same text or another; strings never cross texts, and are
judged on the input.

The texts' suffixes are not sorted in one array.  They are dealt out by
content, level by level, and each level settles most of what is left:

1. Every window of ``LENGTH`` bytes has an anchor, its least ``GRAM``-byte
   string by hash: equal windows have equal anchors.  Windows in a row with one
   anchor make a run.  An anchor that occurs once settles its run as unique, a
   run whose whole bytes occur twice is repeated.
2. What is left, runs that share an anchor but differ somewhere, is cut into
   blocks of ``BLOCK`` windows and settled the same way by the bytes that all
   windows of a block share.
3. The windows of blocks that are still open are suffixes to sort: each task
   sorts its own by mergesort, comparing two suffixes by the binary search of
   their common extension over prefix polynomial hashes, verifies neighbours
   that agree byte by byte, and sends one row for each distinct window; the
   rows of all tasks are then added up.

All levels count by content with partial sums in the map tasks, so thousands of
copies of one string meet as a few rows.  What tasks compare among each other
are BLAKE2 digests of the bytes themselves, 128 bits for windows, and for runs
and blocks 64 bits among those that share the 64 bits of their core; texts go
by 128 bits of SHA-256.  The polynomial hashes choose and sort; they decide
nothing alone.
Only texts with something repeated are ever moved.

Defined results: a null or empty text has no bytes; texts under ``LENGTH``
bytes lose nothing; equal texts get equal results; repeated rows count as
texts of their own and so repeat each other; texts of any length are judged
whole; an empty table gives an empty table; other columns are ignored, or kept
as they are where texts are cut, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, discard, slices, stored

#: Bytes of a string that counts as repeated; bytes of an anchor; windows in a block; suffixes sorted together.
LENGTH, GRAM, BLOCK, SORTED = 200, 64, 8, 4096
_BASE = 0xD6E8FEB86659FD93
_PLACE = np.uint64((1 << 31) - 1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2**64, at least ``n``."""
    found = _powers.get(base)
    if found is None or len(found[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        found = _powers[base] = tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (base, pow(base, -1, 1 << 64)))
    return found


class PrefixHash:
    """Polynomial hashes of all prefixes; the hash of any part takes two look-ups."""

    def __init__(self, data: np.ndarray, base: int = _BASE):
        up, down = _power_tables(base, len(data) + 1)
        self.up = up
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[: len(data)], out=self.sums[1:])

    def part(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[begin]) * self.up[begin]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def runs(data: np.ndarray, h: PrefixHash) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: anchor's place and hash, first and last window."""
    n = len(data) - GRAM + 1
    at = np.arange(n)
    gram = mix(h.part(at, at + GRAM))
    least = _sliding_least(gram & ~_PLACE | at.astype(np.uint64), LENGTH - GRAM + 1)
    place = (least & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    last = np.append(first[1:], len(place)) - 1
    p = place[first]
    return p, gram[p], first, last


def blocks(h: PrefixHash, p: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks of runs: hash of the bytes all windows of the whole block share, the block's last window if it were whole, its first and last window."""
    low, high = (p - last) // BLOCK, (p - first) // BLOCK
    n = high - low + 1
    ends = np.cumsum(n)
    owner = np.repeat(np.arange(len(p)), n)
    number = np.arange(ends[-1] if len(n) else 0) - np.repeat(ends - n, n) + low[owner]
    a = p[owner] - number * BLOCK  # the last window of the whole block
    core = mix(h.part(a, a - BLOCK + 1 + LENGTH) + mix(number.astype(np.uint64)))
    return core, a, np.maximum(first[owner], a - BLOCK + 1), np.minimum(last[owner], a)


def digests(data: np.ndarray, begin: np.ndarray, end: np.ndarray, words: int) -> np.ndarray:
    """Digests of parts of ``data``: a row of ``words`` 64-bit numbers for each."""
    view = memoryview(data)
    made = b"".join([hashlib.blake2b(view[b:e], digest_size=8 * words).digest() for b, e in zip(begin.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(made, "<u8").reshape(-1, words)


def shaped(data: np.ndarray, begin: np.ndarray, end: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """One number for the bytes of each part, another for another ``shape``."""
    return digests(data, begin, end, 1)[:, 0] ^ mix(shape.astype(np.uint64))


def common_extension(h: PrefixHash, a: np.ndarray, b: np.ndarray, limit: int = LENGTH) -> np.ndarray:
    """Bytes that the suffixes from ``a`` and ``b`` have in common, up to ``limit``, by binary search."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), limit, np.int64)
    for _ in range(limit.bit_length()):
        middle = (low + high + 1) >> 1
        same = h.part(a, a + middle) == h.part(b, b + middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def suffix_sort(data: np.ndarray, h: PrefixHash, starts: np.ndarray) -> np.ndarray:
    """``starts`` in the order of the ``LENGTH`` bytes there: a bottom-up mergesort, all merges of a level at once.

    An element's place in a merge is its place in its own half plus how many
    of the other half come before it, found by binary search.
    """
    out = starts.copy()
    n = len(out)
    padded = np.append(data, np.uint8(0))

    def before(a: np.ndarray, b: np.ndarray, or_equal: bool) -> np.ndarray:
        e = common_extension(h, a, b)
        x, y = padded[np.minimum(a + e, len(data))].astype(np.int16), padded[np.minimum(b + e, len(data))].astype(np.int16)
        return np.where(e >= LENGTH, or_equal, x < y)

    size = 1
    at = np.arange(n)
    while size < n:
        group = at // (2 * size) * (2 * size)
        left = at - group < size
        other = np.where(left, np.minimum(group + size, n), group)
        stop = np.where(left, np.minimum(group + 2 * size, n), np.minimum(group + size, n))
        low, high = other.copy(), stop
        while True:
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            middle = (low[live] + high[live]) >> 1
            # From the right half equal elements of the left come first.
            goes = np.where(left[live], before(out[middle], out[live], False), before(out[middle], out[live], True))
            low[live] = np.where(goes, middle + 1, low[live])
            high[live] = np.where(goes, high[live], middle)
        rank = np.where(left, at, group + at - np.minimum(group + size, n)) + (low - other)
        merged = np.empty_like(out)
        merged[rank] = out
        out = merged
        size *= 2
    return out


def same_windows(data: np.ndarray, h: PrefixHash, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted starts and, for each, whether its window equals the one before; equal hashes are verified byte by byte."""
    order = suffix_sort(data, h, starts)
    same = np.append(False, common_extension(h, order[:-1], order[1:]) >= LENGTH)
    at = np.flatnonzero(same)
    for i in range(0, len(at), 2048):
        part = at[i : i + 2048]
        span = np.arange(LENGTH)
        same[part] = (data[order[part][:, None] + span] == data[order[part - 1][:, None] + span]).all(axis=1)
    return order, same


def digest(text: Column) -> Column:
    """The first 128 bits of a text's SHA-256."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, 16)


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8)


def _frame(spark, schema: str):
    target = spark.createDataFrame([], schema).schema
    return target, arrow_schema(target)


def _joined(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)


def _signed(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)


def _settle(rows: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Repeated rows and open ones of a level, and the tables behind them.

    ``rows`` have a hash ``core`` of what they share with their like, a digest
    ``own`` of all their bytes, and ``at``, where they are.  Unique cores are
    gone; rows whose own bytes occur twice are repeated; of cores with different
    bytes one row of each kind is open, to be compared at the next level.
    """
    shared = rows.groupBy("core").agg(F.count("*").alias("n"), F.min("own").alias("x"), F.max("own").alias("y")).where("n > 1").select("core", (F.col("x") != F.col("y")).alias("mixed"))
    # Written first, so that a join splits the rows of a core that very many share.
    shared = stored(shared)
    known = stored(rows.join(shared, "core"))
    kinds = known.where("mixed").groupBy("core", "own").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    kinds = stored(kinds)
    twice = kinds.where("n > 1").select("core", "own")
    repeated = known.where("NOT mixed").select("at").unionByName(known.where("mixed").join(twice, ["core", "own"], "left_semi").select("at"))
    return repeated, kinds.select("at"), [shared, known, kinds]


def _anchors(docs: DataFrame) -> DataFrame:
    target, schema = _frame(docs.sparkSession, "core long, own long, at struct<dg:binary,i:int>")

    def run(batches):
        for batch in slices(batches):
            core, own, dg, number = [], [], [], []
            for t in batch.column(0):
                data = _bytes(t.as_py())
                if len(data) < LENGTH:
                    continue
                p, gram, first, last = runs(data, PrefixHash(data))
                core.append(gram)
                own.append(shaped(data, first, last + LENGTH, (p - first) * 1024 + (last - first)))
                dg += [hashlib.sha256(data).digest()[:16]] * len(gram)
                number.append(np.arange(len(gram)))
            at = pa.StructArray.from_arrays([pa.array(dg, pa.binary()), pa.array(_joined(number, np.int32))], names=["dg", "i"])
            yield pa.RecordBatch.from_arrays([pa.array(_signed(core)), pa.array(_signed(own)), at.cast(schema.field(2).type)], schema=schema)

    return docs.select("text").mapInArrow(run, target)


def _by_text(repeated: DataFrame, opened: DataFrame) -> DataFrame:
    """For each text the numbers of its repeated and open parts; a text's parts are as many as its bytes at most."""
    both = repeated.select("at", F.lit(1).alias("full"), F.lit(0).alias("open")).unionByName(opened.select("at", F.lit(0).alias("full"), F.lit(1).alias("open")))
    # Copies of a text mark the same parts: they meet as one row.
    both = both.groupBy(F.col("at.dg").alias("dg"), F.col("at.i").alias("i")).agg(F.max("full").alias("full"), F.max("open").alias("open"))
    pick = lambda c: F.collect_list(F.when(F.col(c) == 1, F.col("i"))).alias(c)
    return both.groupBy("dg").agg(pick("full"), pick("open"))


def _open_blocks(texts: DataFrame) -> DataFrame:
    target, schema = _frame(texts.sparkSession, "core long, own long, at struct<dg:binary,begin:int,finish:int>")

    def run(batches):
        for batch in slices(batches):
            core, own, dg, begin, end = [], [], [], [], []
            for key, t, numbers in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if not numbers:
                    continue
                data = _bytes(t.as_py())
                h = PrefixHash(data)
                p, _, first, last = runs(data, h)
                c, whole, b, e = blocks(h, *(x[np.array(numbers)] for x in (p, first, last)))
                core.append(c)
                own.append(shaped(data, b, e + LENGTH, (whole - b) * 1024 + (e - b)))
                dg += [key] * len(c)
                begin.append(b)
                end.append(e)
            at = pa.StructArray.from_arrays([pa.array(dg, pa.binary()), pa.array(_joined(begin, np.int32)), pa.array(_joined(end, np.int32))], names=["dg", "begin", "finish"])
            yield pa.RecordBatch.from_arrays([pa.array(_signed(core)), pa.array(_signed(own)), at.cast(schema.field(2).type)], schema=schema)

    return texts.select("dg", "text", "open").mapInArrow(run, target)


def _spans(column: pa.Array) -> list[np.ndarray]:
    return [np.array([(s["begin"], s["finish"]) for s in x or []], np.int64).reshape(-1, 2) for x in column.to_pylist()]


def _windows(batches, counted: bool) -> Iterator[tuple]:
    """Rows of open windows: sorted, and only one for each distinct window of a chunk if ``counted``."""
    held: list[tuple[bytes, np.ndarray, np.ndarray]] = []
    size = 0

    def flush():
        data = np.concatenate([d for _, d, _ in held])
        offset = np.cumsum([0, *(len(d) for _, d, _ in held)])
        starts = np.concatenate([s + o for (_, _, s), o in zip(held, offset[:-1], strict=True)])
        h = PrefixHash(data)
        for i in range(0, len(starts), SORTED):
            chunk = starts[i : i + SORTED]
            if counted:
                order, same = same_windows(data, h, chunk)
                heads = np.flatnonzero(~same)
                chunk, n = order[heads], np.diff(np.append(heads, len(order)))
                yield _window_digests(data, chunk), n
            else:
                owner = np.searchsorted(offset, chunk, "right") - 1
                yield _window_digests(data, chunk), [held[o][0] for o in owner.tolist()], chunk - offset[owner]

    for batch in slices(batches):
        for key, t, spans in zip(batch.column(0).to_pylist(), batch.column(1), _spans(batch.column(2)), strict=True):
            if not len(spans):
                continue
            starts = np.unique(np.concatenate([np.arange(b, e + 1) for b, e in spans]))
            held.append((key, _bytes(t.as_py()), starts))
            size += len(starts)
            if size >= SORTED:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()


def _window_digests(data: np.ndarray, starts: np.ndarray) -> list[pa.Array]:
    made = digests(data, starts, starts + LENGTH, 2).view(np.int64)
    return [pa.array(np.ascontiguousarray(made[:, k])) for k in (0, 1)]


def _repeated_windows(texts: DataFrame) -> DataFrame:
    """``dg, start`` of open windows that occur at least twice."""
    counts, count_schema = _frame(texts.sparkSession, "w1 long, w2 long, n long")
    places, place_schema = _frame(texts.sparkSession, "w1 long, w2 long, dg binary, start int")

    def count(batches):
        for own, n in _windows(batches, True):
            yield pa.RecordBatch.from_arrays([*own, pa.array(n.astype(np.int64))], schema=count_schema)

    def place(batches):
        for own, dg, s in _windows(batches, False):
            yield pa.RecordBatch.from_arrays([*own, pa.array(dg, pa.binary()), pa.array(s.astype(np.int32))], schema=place_schema)

    twice = texts.mapInArrow(count, counts).groupBy("w1", "w2").agg(F.sum("n").alias("n")).where("n > 1").select("w1", "w2")
    return texts.mapInArrow(place, places).join(twice, ["w1", "w2"], "left_semi").select("dg", "start")


def repeats(docs: DataFrame, text: str = "text", with_text: bool = False) -> DataFrame:
    """One row for each distinct text that loses bytes.

    ``dg`` (see ``digest``), ``n_removed``, ``n_spans``, ``kept_sha256`` and,
    ``with_text``, ``kept`` (characters cut in two are left out of it).
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(text).alias("text"))
    repeated, opened, behind = _settle(_anchors(docs))
    flags = _by_text(repeated, opened)
    distinct = docs.where(F.octet_length("text") >= LENGTH).withColumn("dg", digest(F.col("text"))).dropDuplicates(["dg"])
    texts = stored(distinct.join(flags, "dg"))
    for table in behind:
        discard(table)
    repeated, opened, behind = _settle(_open_blocks(texts))
    span = F.struct(F.col("at.begin").alias("begin"), F.col("at.finish").alias("finish"))
    opened = opened.groupBy(F.col("at.dg").alias("dg")).agg(F.collect_list(span).alias("spans"))
    opened = stored(texts.select("dg", "text").join(opened, "dg"))
    found = _repeated_windows(opened).select("dg", F.col("start").alias("begin"), F.col("start").alias("finish"))
    found = found.unionByName(repeated.select(F.col("at.dg").alias("dg"), F.col("at.begin").alias("begin"), F.col("at.finish").alias("finish")))
    found = stored(found.groupBy("dg").agg(F.collect_list(F.struct("begin", "finish")).alias("spans")))
    for table in (*behind, opened):
        discard(table)
    both = texts.select("dg", "text", "full").join(found, "dg", "left")
    target, schema = _frame(spark, "dg binary, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text)

    def run(batches):
        for batch in slices(batches):
            out: list[list] = [[] for _ in schema]
            for key, t, full, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), _spans(batch.column(3)), strict=True):
                data = _bytes(t.as_py())
                edge = np.zeros(len(data) + 1, np.int64)
                if full:
                    _, _, first, last = runs(data, PrefixHash(data))
                    at = np.array(full)
                    np.add.at(edge, first[at], 1)
                    np.add.at(edge, last[at] + LENGTH, -1)
                np.add.at(edge, spans[:, 0], 1)
                np.add.at(edge, spans[:, 1] + LENGTH, -1)
                gone = np.cumsum(edge[:-1]) > 0
                if not gone.any():
                    continue
                kept = data[~gone].tobytes()
                row = [key, int(gone.sum()), int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)), hashlib.sha256(kept).hexdigest()]
                for c, v in zip(out, row + [kept.decode(errors="ignore")] * with_text, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return both.mapInArrow(run, target)


def removed_bytes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept_sha256`` for each row of ``docs``."""
    found = repeats(docs, text)
    whole = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(key, digest(F.col(text)).alias("dg"), F.octet_length(whole).cast("long").alias("n_bytes"), F.sha2(whole, 256).alias("whole"))
    joined = rows.join(found, "dg", "left")
    zero = F.lit(0).cast("long")
    return joined.select(key, "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))


def without_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with repeated bytes cut out of the texts; all rows and columns stay."""
    found = repeats(docs, text, with_text=True).select("dg", "kept")
    # Each row as one value: no column of it can clash with ours.
    joined = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), digest(F.col(f"`{text}`")).alias("dg")).join(found, "dg", "left")
    old = F.col("row").getField(text)
    new = F.when(old.isNotNull(), F.coalesce("kept", old)).alias(text)
    out = joined.select(*[new if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.coalesce(F.length(text), "n_chars").cast(docs.schema["n_chars"].dataType))
