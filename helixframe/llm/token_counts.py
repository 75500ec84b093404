"""Token counts by heap-and-linked-list byte-pair merging.

For a piece of text the symbols form a linked list.  A heap holds each
adjacent pair by rank, then place; the lowest is popped, stale entries are
passed over, and the pair's symbols become one.  The count of a piece is its
initial symbols minus its merges: no identifiers are made.

Defined results: a null or empty text has 0 tokens; texts of any length are
counted whole; repeated rows are counted each, and equal texts get equal counts;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json

import regex
from pyspark.sql import DataFrame

from .bpe import Splitter, _typed, byte_characters
from .common import held, map_batches

#: Fixed value: the pattern that byte-level tokenizers split text by.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces kept in a worker's cache, which is emptied when it is full, and characters of the longest: both bound its bytes.
CACHE_PIECES, CACHE_CHARS = 300_000, 40


class TokenCounter(dict):
    """Counts tokens of texts; itself the cache from a piece to its count."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.bytes = byte_characters()
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self._split = regex.compile("|".join(map(regex.escape, special))) if special else None
        self._special = special
        self._pieces = Splitter(PIECES)

    def __missing__(self, piece: str) -> int:
        symbols = [self.bytes[b] for b in piece.encode()]
        count = len(symbols) - self.merges(symbols)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = count
        return count

    def merges(self, symbols: list[str]) -> int:
        """How many merges happen in one piece."""
        n, rank = len(symbols), self.rank
        symbols = list(symbols)
        after = [*range(1, n), -1]
        before = [*range(-1, n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        done = 0
        while heap:
            r, i = heapq.heappop(heap)
            left, j = symbols[i], after[i]
            if left is None or j < 0 or rank.get((left, symbols[j])) != r:
                continue
            symbols[i], symbols[j] = left + symbols[j], None
            after[i] = k = after[j]
            done += 1
            if k >= 0:
                before[k] = i
                if (r := rank.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := rank.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return done

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self._split and any(s in text for s in self._special):
            return len(self._split.findall(text)) + sum(self._plain(t) for t in self._split.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> int:
        return sum(map(self.__getitem__, self._pieces(text)))


def count_tokens(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_bytes long, n_tokens long`` for each row; rows are never moved."""

    def make():
        counter = held(("token counter", path), lambda: TokenCounter(path))
        return lambda keys, texts: (keys, [len((t or "").encode()) for t in texts], [counter.count(t) for t in texts])

    return map_batches(docs, [key, text], f"{_typed(docs, key)}, n_bytes long, n_tokens long", make)
