"""Exact byte-pair encoding without replaying merges, and table decoding.

Longest vocabulary entries at each place come from an Aho-Corasick automaton.
A token sequence is the byte-pair encoding of a word exactly when every
adjacent pair is *compatible*: encoding the two tokens' joined text gives the
same two tokens.  The encoder walks a word, takes the longest token that is
compatible with its left neighbour and from whose end the word's end has not
been proved unreachable, and steps back otherwise.  Every place is abandoned
at most once, so the work is linear in the word's length.

Decoding reads a table of offsets into one buffer that holds all token texts.

Defined results: a null or empty text has no tokens and decodes to ``""``;
texts of any length are encoded whole; repeated rows are encoded each, and equal
texts get equal results; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import unicodedata

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import held, map_batches

#: The byte-to-character table that byte-level vocabularies use.
_PRINTABLE = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
#: Words kept in a worker's cache, which is emptied when it is full, and characters of the longest: both bound its bytes.
CACHE_WORDS, CACHE_CHARS = 300_000, 40
#: Stands for the end of a word inside the automaton; not a byte-level character.
_END = "￿"


def byte_characters() -> list[str]:
    """The character that stands for each byte value."""
    table, spare = [""] * 256, 256
    for value in range(256):
        if value in _PRINTABLE:
            table[value] = chr(value)
        else:
            table[value] = chr(spare)
            spare += 1
    return table


#: Letters and digits that Unicode 16 added, known to the tokenizers' tables.
_UNICODE_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x113D3), (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C), (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9),
    (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA),
]
#: Lower-case forms that Unicode 16 and 17 added.
_LOWER_16 = {0xA7CE: "\ua7cf", 0xA7D2: "\ua7d3", 0xA7D4: "\ua7d5", **{c: chr(c + 27) for c in range(0x16EA0, 0x16EB9)}, 0x1C89: "\u1c8a", 0xA7CB: "\u0264", 0xA7CC: "\ua7cd", 0xA7DA: "\ua7db", 0xA7DC: "\u019b", **{c: chr(c + 32) for c in range(0x10D50, 0x10D66)}}

_NEW_CAPITALS = re.compile("[" + "".join(map(chr, _LOWER_16)) + "]")


@functools.lru_cache(maxsize=1)
def _late_characters() -> re.Pattern:
    """Letters and digits of the pattern library that are too new for the tokenizers' tables."""
    letter = regex.compile(r"[\p{L}\p{N}]")
    known = {c for a, b in _UNICODE_16 for c in range(a, b + 1)}
    found = [c for c in range(0x80, 0x110000) if c not in known and unicodedata.category(chr(c)) == "Cn" and letter.match(chr(c))]
    runs: list[list[int]] = []
    for c in found:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in runs) + "]" if runs else r"(?!)")


#: White space, letters and numbers up to U+024F.
_SPACE, _LETTERS, _NUMBERS = r"\t-\r \x85\xa0", "a-zA-Zªµºß-öø-ɏÀ-ÖØ-Þ", "0-9²³¹¼½¾"
_BEYOND = re.compile("[^\x00-\u024f]")


class Splitter:
    """All matches of a tokenizer's pattern.

    Texts within Latin letters go by the standard pattern engine, with the
    same classes spelt out; others by full Unicode properties, where characters
    that were unassigned when the tokenizers' tables were made are symbols.
    """

    def __init__(self, pattern: str):
        self.full = regex.compile(pattern)
        plain = pattern.replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}")
        plain = plain.replace(r"[^\s\p{L}\p{N}]", f"[^{_SPACE}{_LETTERS}{_NUMBERS}]").replace(r"\p{L}", f"[{_LETTERS}]").replace(r"\p{N}", f"[{_NUMBERS}]")
        self.latin = re.compile(plain.replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]"))

    def __call__(self, text: str) -> list[str]:
        if not _BEYOND.search(text):
            return self.latin.findall(text)
        late = _late_characters()
        if not late.search(text):
            return self.full.findall(text)
        return [text[m.start() : m.end()] for m in self.full.finditer(late.sub("\U0001fffe", text))]


class Vocabulary:
    """The merges of a tokenizer file and what follows from them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.spec = spec
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: joint rank of a pair of token ids, and the pair that made a token
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        self.order: dict[int, int] = {}
        for place, (left, right) in enumerate(merges):
            a, b, joined = self.ids[left], self.ids[right], self.ids[left + right]
            self.rank[a, b] = place
            self.order[place] = joined
            if joined not in self.parts:
                self.parts[joined] = (a, b)
                self.made[joined] = place
        self.bytes = byte_characters()


class BacktrackingEncoder:
    """Byte-pair encoding of words by longest match, pair table and steps back."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._ok: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        suffix = vocabulary.suffix
        self._keys: dict[int, str] = {}
        for text, token in vocabulary.ids.items():
            if not self._reachable(token):
                continue
            key = text[: -len(suffix)] + _END if suffix and text.endswith(suffix) else text
            self._keys[token] = key
            self.automaton.add_word(key, (len(key), token))
        self.automaton.make_automaton()

    def _reachable(self, token: int) -> bool:
        """Whether encoding the token's own text gives the token."""
        if token not in self.v.parts:
            return True
        return self._pair(*self.v.parts[token], self.v.made[token])

    def _pair(self, left: int, right: int, limit: float) -> bool:
        """Whether no merge across the border comes before ``limit``.

        The border between two tokens is crossed by the merge of what stands
        at its two sides while the sides are still being built.  Undo the
        later of the two last merges, again and again: at each step the pair
        that then touches the border must not have merged sooner.
        """
        rank, made, parts = self.v.rank, self.v.made, self.v.parts
        while True:
            joint = rank.get((left, right))
            if joint is not None and joint < limit:
                return False
            a, b = made.get(left, -1), made.get(right, -1)
            if a < 0 and b < 0:
                return True
            # The left token is completed first where both fall due together:
            # merges of one rank run from left to right.
            if a > b:
                limit, left = a, parts[left][1]
            elif b > a:
                limit, right = b + 1, parts[right][0]
            else:
                limit, right = b + 1, parts[right][0]

    def compatible(self, left: int, right: int) -> bool:
        key = (left, right)
        found = self._ok.get(key)
        if found is None:
            found = self._ok[key] = self._pair(left, right, float("inf"))
        return found

    def _matches(self, word: str) -> list[list[tuple[int, int]]]:
        """For each start the tokens that match there, longest first."""
        at: list[list[tuple[int, int]]] = [[] for _ in word]
        for end, (length, token) in self.automaton.iter(word):
            at[end - length + 1].append((length, token))
        for found in at:
            found.sort(reverse=True)
        return at

    def encode(self, word: str) -> list[int]:
        """Token ids of one word in byte-level characters, its end mark included."""
        n = len(word)
        # Longest match by longest match; where all neighbours are compatible no step back is needed.
        out, size = [], 0
        for _, (length, token) in self.automaton.iter_long(word):
            if out and not self.compatible(out[-1], token):
                break
            out.append(token)
            size += length
        if size == n:
            return out
        at = self._matches(word)
        dead = [False] * (n + 1)
        if self.v.suffix:
            dead[n - 1] = True  # only the mark of the end would be left
        place, out, starts, nxt = 0, [], [], [0] * (n + 1)
        while place < n:
            options, k = at[place], nxt[place]
            took = False
            while k < len(options):
                length, token = options[k]
                k += 1
                if not dead[place + length] and (not out or self.compatible(out[-1], token)):
                    took = True
                    break
            if took:
                nxt[place] = k
                out.append(token)
                starts.append(place)
                place += length
                nxt[place] = 0
            else:
                dead[place] = True
                if not starts:
                    raise ValueError(f"no encoding of {word!r}")
                place = starts.pop()
                out.pop()
        return out


class WordBpe:
    """Encoder and decoder of a tokenizer file whose words end in a mark.

    Supported: the file's normalisation (canonical composition, white space
    runs to one space, lower case), its word pattern, byte-level characters and
    special tokens inside texts.
    """

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.encoder = BacktrackingEncoder(self.v)
        pattern = next(p["pattern"]["Regex"] for p in self.v.spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._words = Splitter(pattern)
        self._split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.v.special, key=len, reverse=True))) + ")") if self.v.special else None
        self._raw: dict[str, bytes] = {}
        self._packed_special = {t: struct.pack("<I", i) for t, i in self.v.special.items()}
        texts = {**{i: t for t, i in self.v.ids.items()}, **{i: t for t, i in self.v.special.items()}}
        pieces = [texts.get(i, "").encode() + b" " for i in range(max(texts) + 1)]
        #: token ``i`` is ``blob[offsets[i]:offsets[i + 1]]``, a separating space included
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)

    @staticmethod
    def normalise(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            # Character by character: a final sigma has no form of its own here.
            text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
            return text.translate(_LOWER_16) if _NEW_CAPITALS.search(text) else text
        return text.lower()

    def _words_of(self, text: str) -> list[str]:
        return self._words(self.normalise(text))

    def _ids_of(self, word: str) -> bytes:
        found = self._raw.get(word)
        if found is None:
            table = self.v.bytes
            ids = self.encoder.encode("".join([table[b] for b in word.encode()]) + (_END if self.v.suffix else ""))
            found = struct.pack(f"<{len(ids)}I", *ids)
            if len(word) <= CACHE_CHARS:
                if len(self._raw) >= CACHE_WORDS:
                    self._raw.clear()
                self._raw[word] = found
        return found

    def pack(self, text: str | None) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not (self._split and any(t in text for t in self.v.special)):
            return b"".join(map(self._ids_of, self._words_of(text)))
        out = []
        for part in self._split.split(text):
            if part in self._packed_special:
                out.append(self._packed_special[part])
            elif part:
                out += map(self._ids_of, self._words_of(part))
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.pack(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        if not len(ids):
            return ""
        at = np.asarray(ids, np.int64)
        begin, length = self.offsets[at], self.offsets[at + 1] - self.offsets[at]
        ends = np.cumsum(length)
        index = np.arange(ends[-1]) + np.repeat(begin - (ends - length), length)
        return self.blob[index][:-1].tobytes().decode()


def encode_documents(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, ids binary, decoded string`` for each row of ``docs``.

    ``ids`` packs little-endian unsigned 32-bit integers.  One narrow stage:
    rows are never moved.  Other columns are ignored.
    """
    return map_batches(docs, [key, text], f"{_typed(docs, key)}, ids binary, decoded string", lambda: _encode_batch(path))


def _encode_batch(path: str):
    bpe = held(("word bpe", path), lambda: WordBpe(path))

    def work(keys, texts):
        ids = [bpe.pack(t) for t in texts]
        return keys, ids, [bpe.decode(np.frombuffer(i, "<u4")) for i in ids]

    return work


def _typed(df: DataFrame, name: str) -> str:
    return f"`{name}` {df.schema[name].dataType.simpleString()}"
