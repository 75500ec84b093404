"""BPE, token counts, media, toxicity, license scans."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helixframe.llm import bpe, licenses, media, queries, token_counts, toxicity

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "\n\t \r\n", "a<|endoftext|>b <|startoftext|>", "Σίσυφος ΣΑΣ İ ẞ ǅ", "é é", "x" * 5000, "ab" * 3000, "It's they'll DON'T", "日本語 テキスト 🙂👩‍👧",
    "\x00\x1c\x85　﻿", "²½٣४ Ⅷ", "aaaaaaaaaaaaaaaaaaaaaaaaaaa", "<|endoftext|>" * 3, "͸֋ ǆ֋", "a  b   c    ",
]


@pytest.fixture(scope="module")
def word():
    return bpe.WordBpe(WORD), Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def byte():
    return token_counts.TokenCounter(BYTE), Tokenizer.from_file(BYTE)


def same_as_library(pair, text):
    mine, library = pair
    ids = library.encode(text or "", add_special_tokens=False).ids
    assert mine.encode(text) == ids
    assert mine.decode(ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ODD)
def test_bpe_odd_texts(word, text):
    same_as_library(word, text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_bpe_any_text(word, text):
    same_as_library(word, text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdehilnorst'", min_size=1, max_size=40))
def test_bpe_words(word, text):
    same_as_library(word, text)


def test_bpe_steps_back(word):
    """Words on which the longest first token is wrong go through the walk, not the short cut."""
    mine, library = word
    rng = random.Random(2)
    stepped = 0
    for _ in range(3000):
        text = "".join(rng.choice("thenigarlso") for _ in range(rng.randint(2, 12)))
        units = "".join(mine.v.bytes[b] for b in text.encode()) + bpe._END
        greedy = [t for _, (_, t) in mine.encoder.automaton.iter_long(units)]
        ids = library.encode(text, add_special_tokens=False).ids
        stepped += greedy != ids
        assert mine.encoder.encode(units) == ids
    assert stepped > 100


@pytest.mark.parametrize("text", ODD)
def test_counts_odd_texts(byte, text):
    assert byte[0].count(text) == len(byte[1].encode(text or "", add_special_tokens=False).ids)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_counts_any_text(byte, text):
    assert byte[0].count(text) == len(byte[1].encode(text, add_special_tokens=False).ids)


def test_bpe_query(spark, documents, word, sf_dir):
    library = word[1]
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "again"), (3, "again")]
    got = queries.bpe_digests(documents(rows)).collect()
    assert len(got) == len(rows)
    for r, (i, t) in zip(got, rows, strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert tuple(r) == (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert queries.bpe_digests(documents([])).count() == 0
    assert queries.op3_bpe(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_counts_query(spark, byte, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op4_token_counts(spark, sf_dir).collect():
        n = len(byte[1].encode(docs[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((docs[r.doc_id] or "").encode()), n, n > 1024)


def test_media_query(spark, documents):
    rows = [(1, None), (2, ""), (3, "é" * 40), (4, "x" * 64), (5, "long " * 60_000), (6, "x" * 64)]
    got = {r.doc_id: r for r in media.media_digests(documents(rows)).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        stored = media.write(padded)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert got[4].feature == got[6].feature and got[1].feature == got[2].feature
    assert media.media_digests(documents([])).count() == 0
    row = media.media_columns(documents([(1, "ab" * 3000)])).first()
    assert b"".join(row.media[p.offset : p.offset + p.size] for p in row.packets).rstrip(b"\0") == b"ab" * 3000


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.integers(1, 40))
def test_media_round_trip(data, times):
    data = media.pad(data * times)
    found = media.parse(stored := media.write(data))
    assert b"".join(stored[o : o + n] for _, _, o, n, _ in found.packets) == data
    assert found.doc_type == "matroska" and found.tracks == {1: "A_PCM/INT/LIT"}
    assert len(found.cues) == len(found.clusters) and all(found.clusters[i] == c[2] for i, c in enumerate(found.cues))


def test_media_from_bytes_by_hand():
    """A file spelled out from the format's description: unknown segment size, a track, one Xiph-laced block, one cue."""
    data = bytes.fromhex(
        "1A45DFA3 8B 4282 88 6D6174726F736B61"  # EBML header: document type
        "18538067 01FFFFFFFFFFFFFF"  # segment of unknown size
        "1549A966 87 2AD7B1 83 0F4240"  # info: a millisecond to the tick
        "1654AE6B 8C AE 8A D7 81 05 86 85 415F582F59"  # track 5, codec A_X/Y
        "1F43B675 93 E7 82 01F4"  # cluster at 500
        "A3 8D 85 000A 02 01 03 616263 64656667"  # block: track 5, 10 later, Xiph lacing of two frames, the first of 3 bytes
        "1C53BB6B 8E BB 8C B3 82 01F4 B7 86 F7 81 05 F1 81 1D"  # cue: 500, track 5, cluster at 29
    )
    found = media.parse(data)
    assert (found.doc_type, found.tracks, found.clusters, found.cues, found.lacings) == ("matroska", {5: "A_X/Y"}, [29], [(500, 5, 29)], {media.XIPH})
    assert [(t, s, data[o : o + n], c) for t, s, o, n, c in found.packets] == [(5, 510, b"abc", 0), (5, 510, b"defg", 0)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=700), min_size=1, max_size=9), st.sampled_from([media.XIPH, media.EBML_LACING, media.FIXED, media.NO_LACING]), st.booleans())
def test_lacings(frames, lacing, group):
    if lacing == media.FIXED:
        frames = [f.ljust(5, b"-")[:5] for f in frames]
    elif lacing == media.NO_LACING:
        frames = frames[:1]
    body = media.block(3, -7, frames, lacing)
    inner = media.element(media.BLOCK_GROUP, media.element(media.BLOCK, body)) if group else media.element(media.SIMPLE_BLOCK, body)
    # A cluster and a segment of unknown size, ended by the next cluster.
    unknown = b"\x01\xff\xff\xff\xff\xff\xff\xff"
    cluster = media._id(media.CLUSTER) + unknown + media.element(media.TIMESTAMP, 100) + inner
    data = media._id(media.SEGMENT) + unknown + cluster + cluster
    found = media.parse(data)
    assert [data[o : o + n] for _, _, o, n, _ in found.packets] == frames * 2
    assert {(t, s) for t, s, *_ in found.packets} == {(3, 93)} and {c for *_, c in found.packets} == {0, 1}


def test_fold():
    assert toxicity.fold("1D10T! іdіоt, $CUM") == " idiot idiot scum "
    assert toxicity.fold(None) == "  "


def test_lexicon():
    lexicon = toxicity.Lexicon({" trash ": 3.0, " idio": 4.0}, (-3.0, 1.0, 1.0))
    none = lexicon.score("")
    assert lexicon.score(None) == none == lexicon.score("nothing here") == lexicon.score("the trash can is full")
    assert lexicon.score("you 1di0ts") > lexicon.score("trash " + "word " * 50) > none
    assert [h[2] for h in lexicon.hits(toxicity.fold("trash can trash"))] == [3.0]
    assert 0 <= lexicon.score("trash " * 100_000) <= 1


def test_toxicity_fit(spark, documents):
    rng = random.Random(4)
    words = ["".join(rng.choice("bcdfgaeiou") for _ in range(6)) for _ in range(200)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        text = [rng.choice(words) for _ in range(40)]
        if bad:
            text[rng.randrange(40)] = rng.choice(["zzgrob", "zzgrobs", "wurk"])
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(bad)))
    frame = documents([*rows, (None, "x"), (9999, None)])
    known = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    lexicon = toxicity.fit(frame, known)
    assert any(e.startswith(" zzgr") for e in lexicon.weights)
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    got = {r.doc_id: r.score for r in toxicity.score_documents(frame, lexicon).collect()}
    assert all((got[i] >= toxicity.REJECT) == (i % 5 == 0) for i in held)
    assert got[9999] == got[None] < 0.5
    flags = {r.doc_id: r.h for r in frame.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()}
    assert all(flags[i] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(600)) and flags[None] is False
    # The labels of rows held out change nothing.
    turned = spark.createDataFrame([(i, q, 1 - t if i in set(held) else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    assert toxicity.fit(frame, turned).weights == lexicon.weights
    empty = toxicity.fit(frame, known.where("false"))
    assert empty.score("zzgrob") == 0.0
    assert toxicity.score_documents(documents([]), lexicon).count() == 0


def brute_toxicity(rows, labels):
    """Entries, weights and scores in plain Python, from (id, text) rows with distinct texts and their labels."""
    learned = [(t, labels[i]) for i, t in rows if i in labels and zlib.crc32(str(i).encode()) % 3 != 1]
    folded = {t: re.findall("[a-z]+", t) for t, _ in learned}
    around = {1: {}, 0: {}}
    for t, label in learned:
        words = folded[t]
        first = {}
        for k, w in enumerate(words):
            for e in [f" {w} ", *(f" {w[:n]}" for n in range(4, 9) if n < len(w))]:
                first.setdefault(e, tuple(words[max(0, k - 1) : k]) + ("|", w, "|") + tuple(words[k + 1 : k + 2]))
        for e, place in first.items():
            around[label].setdefault(e, set()).add(place)
    seen = {label: {e: len(places) for e, places in found.items()} for label, found in around.items()}
    n_bad, n_good = (sum(1 for _, x in learned if x == y) for y in (1, 0))
    odds = {}
    for e, bad in seen[1].items():
        a, b = bad + 0.5, seen[0].get(e, 0) + 0.5
        value = math.log(a / (n_bad + 1) / (b / (n_good + 1))) - 2 * math.sqrt(1 / a + 1 / b)
        if value >= 1.5:
            odds[e] = value
    weights = {}
    for e in sorted(odds, key=lambda e: (-odds[e], len(e), e)):
        if not any(e.startswith(w) for w in weights if not w.endswith(" ")):
            weights[e] = odds[e]

    def signals(t):
        words = f" {' '.join(re.findall('[a-z]+', t))} "
        total = sum(w * sum(words.startswith(e, k) for k in range(len(words))) for e, w in weights.items())
        return math.log1p(total), math.log1p(100 * total / max(1, len(words.split())))

    points = [(*signals(t), y) for t, y in learned]
    a, b, c = 0.0, 0.0, 0.0
    for _ in range(200):  # Newton's method, written out
        g, h = [0.0, -0.05 * b, -0.05 * c], [[1e-9, 0, 0], [0, 0.05 + 1e-9, 0], [0, 0, 0.05 + 1e-9]]
        for x, y, label in points:
            p = 1 / (1 + math.exp(-max(-30, min(30, a + b * x + c * y))))
            v = (1.0, x, y)
            for i in range(3):
                g[i] += v[i] * (label - p)
                for j in range(3):
                    h[i][j] += v[i] * v[j] * p * (1 - p)
        step = np.clip(np.linalg.solve(np.array(h, float), np.array(g)), -2, 2)
        a, b, c = a + step[0], b + step[1], c + step[2]
    return weights, lambda t: 1 / (1 + math.exp(-sum(k * v for k, v in zip((a, b, c), (1.0, *signals(t)), strict=True))))


def test_toxicity_equals_brute_force(spark, documents):
    rng = random.Random(14)
    words = ["".join(rng.choice("bcdfgaeiou") for _ in range(rng.randrange(3, 10))) for _ in range(150)]
    rows, labels = [], {}
    for i in range(400):
        text = [rng.choice(words) for _ in range(rng.randrange(12, 60))]
        labels[i] = int(i % 4 == 0)
        if labels[i]:
            text[rng.randrange(len(text))] = rng.choice(["grobnak", "grobnaks", "wurk"])
        elif i % 7 == 1:
            text[0] = "wurk"
        rows.append((i, " ".join(text)))
    weights, score = brute_toxicity(rows, labels)
    lexicon = toxicity.fit(documents(rows), spark.createDataFrame([(i, 1, x) for i, x in labels.items()], "doc_id long, quality int, toxic int"))
    assert weights and {e: round(w, 9) for e, w in lexicon.weights.items()} == {e: round(w, 9) for e, w in weights.items()}
    got = {r.doc_id: r.score for r in toxicity.score_documents(documents(rows), lexicon).collect()}
    assert all(abs(got[i] - score(t)) < 0.02 for i, t in rows)


def test_toxicity_learns_from_all_but_copies(spark, documents):
    base = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))
    near = base.replace("wab", "zzz")
    assert toxicity.alike_key(base) == toxicity.alike_key(base.upper()) != toxicity.alike_key("other " + base[600:])
    assert sum(a == b for a, b in zip(toxicity.alike_key(base).split("-"), toxicity.alike_key(near).split("-"), strict=True)) >= 2
    assert toxicity.alike_key(None) == toxicity.alike_key("") == toxicity.alike_key(" 89 ") != toxicity.alike_key("a b")
    # Texts with most words, even long passages, in common are no copies of one another.
    rng = random.Random(3)
    texts = [" ".join(rng.choice(base.split()) for _ in range(2000)) + " shared words that stand at the end of all" for _ in range(200)]
    assert len({toxicity.alike_key(t) for t in texts}) == 200
    # A text of which there are many copies counts once: its own words are no entries.
    rows = [(i, "vorbex melgurt is an odd text with words of its own zigrat") for i in range(150)] + [(1000 + i, t) for i, t in enumerate(texts)]
    known = spark.createDataFrame([(i, 1, int(i < 1000 or i % 10 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    assert not any("vorb" in e or "zigr" in e for e in toxicity.fit(documents(rows), known).weights)


def test_toxicity_query(spark, sf_dir):
    rows = queries.op6_toxicity(spark, sf_dir).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def brute_license(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    # The signatures, by the standard expression engine and without keywords; every pair of spans is compared.
    line = f" {' '.join(words)} " if words else " "
    spans = [(m.start(), m.end(), i, p, label, c) for i, (label, p, c, _, x) in enumerate(licenses.SIGNATURES) for m in re.finditer(f" {x}(?= )", line)]

    def beats(o, s):
        if o[3] != s[3]:
            return o[3] > s[3] and o[0] < s[1] and s[0] < o[1]
        return o[0] <= s[0] and s[1] <= o[1] and (o[:2] != s[:2] or o[2] < s[2])

    kept = [s for s in spans if not any(beats(o, s) for o in spans if o is not s)]
    return words, places, labels, labels | {s[4] for s in kept}, max([s[5] for s in kept], default=0.0)


LICENSED = [
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "CC BY-NC-SA 4.0 license", "SPDX-License-Identifier: GPL-3.0-or-later",
    "This work is licensed under the GNU General Public License, version 3.", "under the mit license under the MIT license", "mit der Lizenz mit mit", None, "", "   ...   ", "é ü license É", "BSD 3-Clause License",
    "Available under the terms of the Mozilla Public License 2.0 and under the ISC license", "x " * 3000 + "under the MIT license " * 60, "License: WTFPL", "the unlicense license", "subject to the terms of the Eclipse Public License v2.0",
]


EXPECTED = {
    "the MIT license type Apache 2": "apache-2",
    "GPL-3.0": "gpl-3",
    "isc": "isc",
    "see the ISC licence.": "isc",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction": "mit",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl-3",
    "under the terms of the GNU Lesser General Public License, version 2.1": "lgpl-2",
    "distributed under the GNU LGPL v3": "lgpl-3",
    "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0": "apache-2",
    "https://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa",
    "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa",
    "licensed under CC BY 4.0": "cc-by",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products": "bsd-3-clause",
    "SPDX-License-Identifier: (none)": "",
    "SPDX-License-Identifier: MIT": "mit",
    "mit freundlichen Gruessen, Lizenz mit Namen": "",
    "dual licensed under the MIT license and the Apache License 2.0": "apache-2,mit",
    "released into the public domain": "public-domain",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2",
    "Distributed under the Boost Software License, Version 1.0.": "bsl-1",
    "License: WTFPL": "wtfpl",
    "Affero General Public License": "agpl-3",
    "a general public license plate holder": "gpl",
    "free of charge": "",
}


def test_license_scan(documents):
    rows = list(enumerate([*LICENSED, *EXPECTED])) + [(0, LICENSED[0])]
    got = licenses.scan(documents(rows)).collect()
    for r, (i, t) in zip(got, rows, strict=True):
        words, places, base, all_labels, best = brute_license(t)
        assert (r.doc_id, r.n_words, r.n_base) == (i, len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places), max(places)) if places else (None, None))
        assert r.base_labels == ",".join(sorted(base)) and r.labels == ",".join(sorted(all_labels)), t
        assert r.score == max(best, 0.9 if places else 0.0)
    by = {r.doc_id: r.labels for r in got}
    assert by[0] == "mit" and by[1] == "apache-2" and by[2] == "cc-by-nc" and by[4] == "gpl-3" and by[5] == "gpl-3" and by[12] == "bsd-3-clause" and by[7] == ""
    # A base label stays beside what the signatures say.
    assert by[3] == "cc-by-nc,cc-by-nc-sa" and by[13] == "isc,mpl-2"
    assert {t: by[len(LICENSED) + i] for i, t in enumerate(EXPECTED)} == EXPECTED
    assert licenses.scan(documents([])).count() == 0
    long = licenses.scan(documents([(1, "x " * 3000 + "under the MIT license " * 3000)])).first()
    assert (long.n_base, long.labels, long.first_word, long.last_word) == (3000, "mit", 3000, 3000 + 4 * 2999)


def test_license_suppression_on_random_texts(documents):
    rng = random.Random(31)
    parts = [w for t in (*LICENSED, *EXPECTED) if t and len(t) < 400 for w in t.split()]
    phrases = [t for t in (*LICENSED, *EXPECTED) if t and len(t) < 200]
    rows = [(i, " ".join(rng.choice(phrases if rng.random() < 0.6 else parts) for _ in range(rng.randrange(1, 12)))) for i in range(150)]
    for r, (_, t) in zip(licenses.scan(documents(rows)).collect(), rows, strict=True):
        *_, all_labels, best = brute_license(t)
        assert r.labels == ",".join(sorted(all_labels)) and r.score >= best, t


def test_license_signatures():
    """Hundreds of different expressions; each holds its keywords as words, so the prefilter loses nothing."""
    assert len({x for *_, x in licenses.SIGNATURES}) == len(licenses.SIGNATURES) > 250
    for _, p, c, keys, x in licenses.SIGNATURES:
        assert 1 <= p <= licenses.LEVELS and 0 < c <= 1
        assert keys and all(re.search(rf"(?<![a-z0-9]){k}(?![a-z0-9?])", x) for k in keys.split())


def test_license_plan_is_native(spark, documents):
    plan = licenses.scan(documents([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
