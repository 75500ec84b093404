"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: lower case, look-alike letters of other scripts and
digit substitutions become plain letters, everything else parts words.  The
lexicon holds whole words and word stems with learned weights; phrases on an
exception list take out the hits inside them.  The weighted hits, in total and
by text length, give a score between 0 and 1.

The lexicon and the score are fitted on at most ``FIT_ROWS`` labelled rows,
drawn by a hash of the id.  Of copies among them, told by a digest of the folded
text or three independent least shingles that all agree, the one with the least
id is learned from; every other row is.  An entry counts once for all texts
that have it between the same two words, so that what near copies share is no
evidence.  Every entry whose odds are sure enough is kept: those rows bound how
many there are.  Every row is scored, whole.

Defined results: a null or empty text gets the score of a text without hits;
labels that are null are not learned from, of contradicting ones 1 counts; with
no label of both kinds, or no rows, every score is 0; an empty table gives an
empty table; repeated rows are scored each; texts of any length are scored and
learned from whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import _typed
from .common import discard, give_back, map_batches, stored

#: Labelled rows that a fit reads at most.
FIT_ROWS = 12_000
#: Words in the shingles that tell near copies.
ALIKE_WORDS = 4
#: Stem lengths tried; least lower confidence bound of an entry's log odds.
STEMS, LEAST_ODDS = range(4, 9), 1.5
#: A text is rejected from this score on.
REJECT = 0.7
#: Look-alikes of Latin letters, and digits and signs written for letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ԁ": "d", "һ": "h", "ј": "j", "к": "k", "м": "m", "т": "t", "ո": "n",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ⅼ": "l",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s",
}
#: Phrases in which an entry is harmless.
EXCEPTIONS = (
    "trash can", "trash cans", "trash bin", "trash bins", "trash bag", "trash bags", "trash collection", "trash truck", "take out the trash", "trash compactor",
    "garbage can", "garbage cans", "garbage bag", "garbage bags", "garbage bin", "garbage truck", "garbage disposal", "garbage collection", "garbage collector",
    "clown fish", "class clown", "circus clown", "pond scum", "pathetic fallacy", "idiot proof", "idiot light", "dumb bell", "dumb bells", "dumb waiter", "dumb terminal",
    "loser bracket", "losers bracket", "loser pays rule", "pest control", "rat race", "lab rat", "lab rats", "pig iron", "guinea pig", "guinea pigs", "worm gear",
)
_FOLD = str.maketrans(HOMOGLYPHS)
_WORDS = re.compile(r"[^\W\d_]+")


def fold(text: str | None) -> str:
    """Folded words between single spaces, one at each end."""
    return f" {' '.join(_WORDS.findall((text or '').lower().translate(_FOLD)))} "


def occurrences(folded: str, wanted: frozenset[str] | None = None) -> dict[str, int]:
    """Lexicon entries a text could give, whole words and stems with their borders, each with a hash of the words around its first place."""
    words = folded.split()
    out: dict[str, int] = {}
    seen = set()
    for before, word, after in zip(["", *words], words, [*words[1:], ""], strict=False):
        if word in seen:
            continue
        seen.add(word)
        around = 0
        for entry in (f" {word} ", *(f" {word[:n]}" for n in STEMS if n < len(word))):
            if entry not in out and (wanted is None or entry in wanted):
                around = around or xxhash.xxh3_64_intdigest(f"{before} {word} {after}".encode()) - (1 << 63)
                out[entry] = around
    return out


def alike_key(text: str | None) -> str:
    """Equal for copies, and for most near copies; for other texts only by a chance that does not matter.

    Three independent least shingles, which unrelated texts would have to share
    all; a digest of the folded text where that is shorter than a shingle.
    """
    folded = fold(text)
    words = folded.split()
    if len(words) < ALIKE_WORDS:
        return hashlib.blake2b(folded.encode(), digest_size=16).hexdigest()
    made = {" ".join(words[i : i + ALIKE_WORDS]).encode() for i in range(len(words) - ALIKE_WORDS + 1)}
    return "-".join(f"{min(xxhash.xxh3_64_intdigest(x, seed) for x in made):016x}" for seed in (1, 2, 3))


class Lexicon:
    """Weighted entries, exception phrases and the score's coefficients."""

    def __init__(self, weights: dict[str, float], coefficients: tuple[float, float, float] = (-4.0, 1.0, 1.0), exceptions: Iterable[str] = EXCEPTIONS):
        self.weights, self.coefficients, self.exceptions = dict(weights), coefficients, tuple(exceptions)
        self._automaton = None

    def __getstate__(self):
        return {"weights": self.weights, "coefficients": self.coefficients, "exceptions": self.exceptions, "_automaton": None}

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """Spans and weights of counted entries."""
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for phrase in self.exceptions:
                self._automaton.add_word(fold(phrase), (len(fold(phrase)), None))
            for entry, weight in self.weights.items():
                self._automaton.add_word(entry, (len(entry), weight))
            self._automaton.make_automaton()
        if not len(self._automaton):
            return []
        found, spared = [], []
        for end, (n, weight) in self._automaton.iter(folded):
            (spared if weight is None else found).append((end - n + 1, end + 1, weight))
        if spared:
            found = [h for h in found if not any(a <= h[0] and h[1] <= b for a, b, _ in spared)]
        return found

    def signals(self, text: str | None) -> tuple[float, float]:
        """Weighted hits in total and for each hundred words, on a log scale."""
        folded = fold(text)
        found = self.hits(folded)
        if not found:
            return 0.0, 0.0
        total = sum(w for _, _, w in found)
        return math.log1p(total), math.log1p(100 * total / (folded.count(" ") - 1))

    def score(self, text: str | None) -> float:
        a, b, c = self.coefficients
        x, y = self.signals(text)
        z = a + b * x + c * y
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Lexicon:
    """A lexicon from labelled texts; rows held out are not read.

    What reaches the driver is bounded by ``rows``.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # At most ``rows`` ids and labels: a size bound for the broadcast.
    drawn = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select(F.col("doc_id").cast("string").alias("id"), "text", "toxic")
    # Copies and near copies of a text count once: all their words would look like entries.
    keyed = stored(map_batches(drawn, ["id", "text", "toxic"], "id string, text string, toxic int, alike string", lambda: lambda ids, texts, toxic: (ids, texts, toxic, [alike_key(t) for t in texts])))
    first = keyed.groupBy("toxic", "alike").agg(F.min(F.struct("id", F.xxhash64("text").alias("h"))).alias("first"))
    drawn = stored(keyed.withColumn("h", F.xxhash64("text")).join(first, ["toxic", "alike"]).where("id = first.id AND h = first.h").dropDuplicates(["toxic", "alike"]).select("text", "toxic"))
    discard(keyed)

    total = drawn.agg(F.count_if(F.col("toxic") > 0).alias("bad"), F.count_if(F.col("toxic") <= 0).alias("good")).first()
    if not total.bad or not total.good:
        discard(drawn)
        return Lexicon({}, (-800.0, 0.0, 0.0))

    def counted(texts: DataFrame, wanted: frozenset[str] | None, name: str) -> DataFrame:
        """For each entry in how many different surroundings it occurs."""

        def make():
            def work(texts):
                found = {pair for t in texts for pair in occurrences(fold(t), wanted).items()}
                return tuple(map(list, zip(*found, strict=True))) if found else ([], [])

            return work

        return map_batches(texts, ["text"], "entry string, around long", make, rows=50).distinct().groupBy("entry").agg(F.count("*").alias(name))

    def odds(bad: Column, good: Column) -> Column:
        a, b = bad + 0.5, good + 0.5
        return F.log((a / F.lit(total.bad + 1.0)) / (b / F.lit(total.good + 1.0))) - 2 * F.sqrt(1 / a + 1 / b)

    # An entry that is not sure enough even if no other text has it is not looked for in them.
    bad = stored(counted(drawn.where("toxic > 0"), None, "bad").where(odds(F.col("bad"), F.lit(0)) >= LEAST_ODDS))
    wanted = frozenset(r.entry for r in bad.select("entry").collect())
    good = counted(drawn.where("toxic <= 0"), wanted, "good")
    both = bad.join(good, "entry", "left").withColumn("odds", odds(F.col("bad"), F.coalesce("good", F.lit(0))))
    top = both.where(F.col("odds") >= LEAST_ODDS).orderBy(F.desc("odds"), F.length("entry"), "entry").collect()
    weights: dict[str, float] = {}
    for r in top:  # a stem that is in already covers what begins with it
        if not any(r.entry[:n] in weights for n in range(5, len(r.entry))):
            weights[r.entry] = float(r.odds)
    lexicon = Lexicon(weights)

    def signal_rows():
        return lambda texts, toxic: (*zip(*map(lexicon.signals, texts), strict=True), [float(t > 0) for t in toxic]) if texts else ([], [], [])

    signals = map_batches(drawn, ["text", "toxic"], "x double, y double, bad double", signal_rows)
    table = np.array(sorted(tuple(r) for r in signals.groupBy(F.round("x", 2).alias("x"), F.round("y", 2).alias("y"), "bad").count().collect()))
    lexicon.coefficients = logistic(table)
    discard(bad)
    discard(drawn)
    return lexicon


def logistic(table: np.ndarray, ridge: float = 0.05, steps: int = 60) -> tuple[float, float, float]:
    """Coefficients of a logistic regression on rows ``x, y, label, count``."""
    x = np.column_stack([np.ones(len(table)), table[:, :2]])
    y, n, beta = table[:, 2], table[:, 3], np.zeros(3)
    penalty = np.diag([0.0, ridge, ridge])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (n * (y - p)) - penalty @ beta
        hessian = x.T @ (x * (n * p * (1 - p))[:, None]) + penalty + 1e-9 * np.eye(3)
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def score_documents(docs: DataFrame, lexicon: Lexicon, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, score double`` for each row; rows are never moved."""

    def make():
        return lambda keys, texts: (keys, [lexicon.score(t) for t in texts])

    return map_batches(docs, [key, text], f"{_typed(docs, key)}, score double", make)


def score_column(lexicon: Lexicon):
    """The score as a function of a text column, for filters that keep all columns."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        give_back()
        return texts.map(lexicon.score, na_action=None).astype("float64")

    return score
