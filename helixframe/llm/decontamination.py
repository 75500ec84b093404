"""Benchmark decontamination by q-gram lemma filtering.

Benchmark items are cut into overlapping windows: long ones that may be edited
much, and short ones at small steps, so that any stretch of ``FRAGMENT`` bytes
of an item holds a whole short window and is found, copied word for word or
with up to ``SHORT_EDITS`` edits.  A text region within ``e``
edits of a window of ``m`` characters shares at least ``m - q + 1 - e * q`` of
its q-grams with it, on diagonals at most ``e`` apart.  Shared q-grams are
counted in diagonal bands of twice that width that overlap by half, so some
band holds them all; bands that reach the bound are verified by an alignment
that stays inside the band.

Texts are compared in lower case with white space runs as one space.

A benchmark of up to ``BLOCK_CHARS`` is one index, sent to every task, and one
scan.  A larger one is first condensed to a bitmap of its q-grams; one scan
with that leaves the few texts that can hold a window at all, and only these
are searched for each block of the benchmark.  Items so short and so freely
edited that few shared q-grams are enough for them are kept apart and searched
for in all texts, block by block.

A window is looked for inside each text alone, so results do not depend on
which texts are searched together.  Items under ``Q`` bytes have no q-gram;
they are matched exactly, as whole words, by an Aho-Corasick automaton.

Defined results: null and empty texts and items match nothing; texts of any
length are searched whole; repeated rows are reported each; an item found
several times in a text gives one row (one for each part that is found, if it
is longer than ``BLOCK_CHARS`` and so comes in parts); an empty table of texts
or items gives no rows, and keeps all rows where leaks are dropped; other
columns are ignored, or kept where rows are.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _typed
from .common import arrow_schema, give_back, slices, stored

#: q-gram length, window length and step, characters to each allowed edit.
Q, WINDOW, STEP, PER_EDIT = 12, 120, 60, 15
#: Length, step and allowed edits of the short windows, and the length of a stretch that always holds one.
SHORT, SHORT_STEP, SHORT_EDITS = 50, 10, 2
FRAGMENT = SHORT + SHORT_STEP - 1
#: Bytes of benchmark items matched at a time; larger benchmarks go in blocks.  A block takes some 25 bytes for each.
BLOCK_CHARS = 8_000_000
#: Characters of text searched at a time.
CHUNK = 2_000_000
#: Diagonals between texts that are searched together: no band reaches two of them.
_GAP = 2 * WINDOW


def normalise(text: str | None) -> bytes:
    return " ".join((text or "").lower().split()).encode()


def grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit key of the ``Q`` bytes from each place on."""
    n = len(data) - Q + 1
    eight = np.ndarray((n,), "<u8", data, 0, (1,))
    four = np.ndarray((n,), "<u4", data, 8, (1,)).astype(np.uint64)
    key = (eight ^ (four * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    return key ^ (key >> np.uint64(32))


def banded_distance(window: bytes, text: bytes, low: int, high: int, limit: int) -> int:
    """Least edits between ``window`` and a part of ``text`` on diagonals ``low`` to ``high``; over ``limit``: ``limit + 1``.

    Diagonal: place in ``text`` minus place in ``window``.
    """
    far = limit + 1
    width = high - low + 1
    row = [0 if 0 <= low + j <= len(text) else far for j in range(width)]
    for i, c in enumerate(window, 1):
        new = [far] * width
        for j in range(width):
            p = i + low + j
            if p < 0 or p > len(text):
                continue
            best = row[j] + (p < 1 or text[p - 1] != c) if p >= 1 else far
            if j + 1 < width and row[j + 1] + 1 < best:
                best = row[j + 1] + 1
            if j and new[j - 1] + 1 < best:
                best = new[j - 1] + 1
            new[j] = min(best, far)
        row = new
        if min(row) > limit:
            return far
    return min(row)


def _starts(n: int, size: int, step: int) -> np.ndarray:
    """Starts of an item's windows of one kind: every ``step``, and the last."""
    last = max(0, n - size)
    return np.unique(np.append(np.arange(0, max(1, last), step), last))


def _ragged(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers ``first[i]`` to ``first[i] + n[i] - 1`` for each ``i``, and the ``i`` of each."""
    ends = np.cumsum(n)
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(ends[-1] if len(n) else 0) - np.repeat(ends - n, n) + first[owner], owner


class Benchmark:
    """Benchmark items, ready to be searched for: each place's q-gram, and the windows that hold it."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.items = [i for i, _ in items]
        self.short: dict[str, list[int]] = {}
        held, size = [], 0
        begin, length, edits, owner = [], [], [], []
        key, place, ranges = [], [], []
        n_windows = 0
        for number, (_, text) in enumerate(items):
            data = normalise(text)
            if len(data) < Q:
                if data:
                    self.short.setdefault(data.decode(), []).append(number)
                continue
            held.append(data)
            at = np.arange(len(data) - Q + 1)
            key.append(grams(np.frombuffer(data, np.uint8)))
            place.append(at + size)
            for width, step in ((WINDOW, STEP), (SHORT, SHORT_STEP)):
                if width == SHORT and len(data) <= SHORT:
                    ranges.append((np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)))
                    continue
                starts, width_here = _starts(len(data), width, step), min(width, len(data))
                low = np.searchsorted(starts + width_here, at + Q, "left")
                ranges.append((low + n_windows, np.searchsorted(starts, at, "right") - low))
                n_windows += len(starts)
                begin.append(starts + size)
                length.append(np.full(len(starts), width_here))
                edits.append(np.full(len(starts), SHORT_EDITS if width == SHORT else min(width_here // PER_EDIT, (width_here - Q) // Q)))
                owner.append(np.full(len(starts), number))
            size += len(data)
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        self.data = b"".join(held)
        self.begin, self.length, self.edits, self.owner = (join(x, np.int64) for x in (begin, length, edits, owner))
        self.least = self.length - Q + 1 - self.edits * Q
        keys = join(key, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.place = keys[order], join(place, np.int32)[order]
        #: For each sorted q-gram the windows that hold it, long ones and short ones: first and number.
        self.held_by = [(join([r[0] for r in ranges[k::2]], np.int32)[order], join([r[1] for r in ranges[k::2]], np.int8)[order]) for k in (0, 1)]
        self.bits = min(26, max(22, int(8 * len(keys)).bit_length()))
        self.slots = np.zeros(1 << self.bits, bool)
        self.slots[(self.keys >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        self._automaton = None

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    @property
    def windows(self) -> list[tuple[int, bytes, int, int]]:
        """Item, bytes, allowed edits and least shared q-grams of each window."""
        return [(self.items[o], self.data[b : b + n], e, k) for o, b, n, e, k in zip(*(x.tolist() for x in (self.owner, self.begin, self.length, self.edits, self.least)), strict=True)]

    def short_items(self, data: bytes) -> set[int]:
        """Numbers of the short items that stand in a normalised text as whole words."""
        if not self.short or not data:
            return set()
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for text, numbers in self.short.items():
                self._automaton.add_word(f" {text} ", numbers)
            self._automaton.make_automaton()
        return {n for _, numbers in self._automaton.iter(f" {data.decode()} ") for n in numbers}

    def search(self, data: bytes, starts: np.ndarray | None = None) -> list[tuple[int, int, int]]:
        """``(window, place, edits)`` of windows found in ``data``.

        ``starts``: where the texts in ``data`` begin, if it holds several, one
        byte apart.  A window is looked for in each of them alone, and ``place``
        lies in the text that holds it.
        """
        if len(data) < Q or not len(self.keys):
            return []
        starts = np.zeros(1, np.int64) if starts is None else starts
        stops = np.append(starts[1:] - 1, len(data))
        spread = starts + np.arange(len(starts)) * _GAP
        array = np.frombuffer(data, np.uint8)
        key = grams(array)
        at = np.flatnonzero(self.slots[(key >> np.uint64(64 - self.bits)).astype(np.int64)])
        first = np.searchsorted(self.keys, key[at], "left")
        n = np.searchsorted(self.keys, key[at], "right") - first
        real = n > 0
        at, first, n = at[real], first[real], n[real]
        if not len(at):
            return []
        entry, which = _ragged(first, n)
        at = at[which]
        windows, places, texts_at = [], [], []
        for low, number in self.held_by:
            w, which = _ragged(low[entry].astype(np.int64), number[entry].astype(np.int64))
            windows.append(w)
            places.append(self.place[entry][which] - self.begin[w])
            texts_at.append(at[which])
        window, place, at = np.concatenate(windows), np.concatenate(places), np.concatenate(texts_at)
        text = np.searchsorted(starts, at, "right") - 1
        diagonal = at + text * _GAP - place + WINDOW  # never negative
        step = self.edits[window] + 1
        band = diagonal // step
        # Bands of two steps that overlap by one: each diagonal lies in two of them.
        both = np.concatenate([window * (1 << 40) + band, window * (1 << 40) + band - 1])
        codes, counts = np.unique(both, return_counts=True)
        owner = codes >> 40
        near = counts >= self.least[owner]
        out = []
        done: set[tuple[int, int]] = set()
        for code in codes[near]:
            w = int((code + 1) >> 40)
            b = int(code - (w << 40))
            s = int(self.edits[w]) + 1
            if (w, b - 1) in done:
                continue  # an exact hit in the band before: no better one is left
            low, high = b * s - WINDOW, (b + 2) * s - 1 - WINDOW
            j = int(np.searchsorted(spread, high + WINDOW, "right")) - 1
            low, high = low - j * _GAP, high - j * _GAP
            part, edits = self.data[self.begin[w] : self.begin[w] + self.length[w]], int(self.edits[w])
            begin = max(int(starts[j]), low)
            region = data[begin : max(begin, min(int(stops[j]), high + len(part) + edits))]
            p = region.find(part)
            d = 0 if p >= 0 else banded_distance(part, region, low - begin, high - begin, edits)
            if d <= edits:
                if not d:
                    done.add((w, b))
                out.append((w, begin + max(p, 0), d))
        return out

    def leaks(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int]]:
        """``(index, item, windows found, least edits)`` for items found in texts; texts are searched together, many at a time."""
        held, starts, size = [], [], 0

        def flush():
            data = b"\n".join(held)  # no window holds a line end
            begins = np.cumsum([0, *(len(h) + 1 for h in held[:-1])])
            found: dict[tuple[int, int], dict[int, int]] = {}
            for w, p, d in self.search(data, begins):
                where = int(np.searchsorted(begins, p, "right")) - 1
                of = found.setdefault((starts[where], int(self.owner[w])), {})
                of[w] = min(d, of.get(w, d))
            for i, h in zip(starts, held, strict=True):
                for number in self.short_items(h):
                    found[i, number] = {-1: 0}
            for (i, number), of in sorted(found.items()):
                yield i, self.items[number], len(of), min(of.values())

        for i, t in enumerate(texts):
            data = normalise(t)
            if held and size + len(data) > CHUNK:
                yield from flush()
                held, starts, size = [], [], 0
            held.append(data)
            starts.append(i)
            size += len(data) + 1
        if held:
            yield from flush()


def blocks(benchmark: DataFrame, chars: int = BLOCK_CHARS) -> Iterator[Benchmark]:
    """The benchmark in blocks of bounded size, one after the other.

    An item that is longer than a block is cut into parts that overlap by a
    window, so every stretch of ``FRAGMENT`` bytes is in one of them.
    """
    held, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        data = normalise(r.text)
        step = max(chars, 2 * WINDOW)
        for part in range(0, max(1, len(data) - WINDOW), step):
            text = data[part : part + step + WINDOW].decode(errors="ignore") if len(data) > step else data.decode()
            held.append((r.item_id, text))
            size += len(text)
            if size >= chars:
                yield Benchmark(held)
                held, size = [], 0
    if held:
        yield Benchmark(held)


class Screen:
    """A bitmap of all q-grams of a benchmark, whatever its size: tells texts that may hold a window, and loses none.

    A full window of either kind shares at least ``NEEDED`` of its q-grams with
    a region of at most ``REACH`` places, so a text without so many marked
    q-grams in so few places holds no window.  Items that are a shorter window
    by themselves may share fewer; they are not for this (``dense``).
    """

    NEEDED = min(SHORT - Q + 1 - SHORT_EDITS * Q, WINDOW - Q + 1 - (WINDOW // PER_EDIT) * Q)
    REACH = WINDOW + WINDOW // PER_EDIT

    def __init__(self, bits: int):
        self.bits = bits
        self.marks = np.zeros(1 << bits - 3, np.uint8)

    @classmethod
    def dense(cls, text: str | None) -> bool:
        """Whether all windows of an item share enough."""
        n = len(normalise(text))
        return n >= WINDOW or n >= Q and n - Q + 1 - min(n // PER_EDIT, (n - Q) // Q) * Q >= cls.NEEDED

    def add(self, block: Benchmark) -> None:
        at = (block.keys >> np.uint64(64 - self.bits)).astype(np.int64)
        np.bitwise_or.at(self.marks, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))

    def may_hold(self, text: str | None) -> bool:
        data = normalise(text)
        if len(data) < Q:
            return False
        at = (grams(np.frombuffer(data, np.uint8)) >> np.uint64(64 - self.bits)).astype(np.int64)
        marked = (self.marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        total = np.concatenate([[0], np.cumsum(marked, dtype=np.int64)])
        reach = min(self.REACH, len(marked))
        return bool((total[reach:] - total[:-reach]).max() >= self.NEEDED)


def _screened(docs: DataFrame, dense: DataFrame, columns: list[str], text: str, chars: int) -> DataFrame:
    """The texts that may hold an item, written: all documents are read once for this."""
    size = dense.agg(F.sum(F.octet_length("text"))).first()[0]
    screen = Screen(min(30, max(24, int(16 * size).bit_length())))  # at most 128 MB
    for block in blocks(dense, chars):
        screen.add(block)
    shared = docs.sparkSession.sparkContext.broadcast(screen)

    @F.pandas_udf("boolean")
    def may_hold(texts: pd.Series) -> pd.Series:
        return texts.map(shared.value.may_hold, na_action=None).astype(bool)

    return stored(docs.select(*columns).where(may_hold(F.col(text))))


def _leaks_of(docs: DataFrame, block: Benchmark, key: str, text: str, target) -> DataFrame:
    schema = arrow_schema(target)
    shared = docs.sparkSession.sparkContext.broadcast(block)  # BLOCK_CHARS bounds it

    def run(batches):
        for batch in slices(batches):
            keys = batch.column(0).to_pylist()
            rows = [(keys[i], item, n, d) for i, item, n, d in shared.value.leaks(batch.column(1).to_pylist())]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.select(key, text).mapInArrow(run, target)


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", chars: int = BLOCK_CHARS) -> DataFrame:
    """``key, item_id, n_windows, edits`` for each benchmark item found in each text."""
    spark = docs.sparkSession
    target = spark.createDataFrame([], f"{_typed(docs, key)}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, n_windows long, edits long").schema
    out = spark.createDataFrame([], target)
    every = blocks(benchmark, chars)
    first, second = next(every, None), next(every, None)
    if second is None:
        return out if first is None else _leaks_of(docs, first, key, text, target)

    @F.pandas_udf("boolean")
    def dense(texts: pd.Series) -> pd.Series:
        return texts.map(Screen.dense, na_action=None).astype(bool)

    marked = stored(benchmark.select("item_id", "text", dense(F.col("text")).alias("dense")))
    parts = [(docs, marked.where("NOT dense"))]
    if not marked.where("dense").isEmpty():
        parts.append((_screened(docs, marked.where("dense"), [key, text], text, chars), marked.where("dense")))
    for texts, items in parts:
        for block in blocks(items, chars):
            out = out.unionByName(_leaks_of(texts, block, key, text, target))
    return out


def _clean(shared):
    """Whether a text holds no item of a block."""

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        give_back()
        bad = {i for i, *_ in shared.value.leaks(texts.tolist())}
        return pd.Series([i not in bad for i in range(len(texts))])

    return clean


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` in whose text no benchmark item is found; all columns stay."""
    every = blocks(benchmark, chars)
    first, second = next(every, None), next(every, None)
    if first is None:
        return docs
    if second is None:
        return docs.where(_clean(docs.sparkSession.sparkContext.broadcast(first))(F.col(f"`{text}`")))
    # More than one block: the texts that are found, by digest, are joined out.
    texts = docs.select(F.col(f"`{text}`").alias("text"), digest_of(text).alias("id"))
    found = stored(find_leaks(texts, benchmark, "text", "id", chars).select(F.col("id").alias("leaked")).distinct())
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), digest_of(text).alias("id"))
    left = row.join(found, row["id"] == found["leaked"], "left_anti")
    return left.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def digest_of(text: str):
    return F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), 256)
