"""Chat, URLs, decontamination, near copies, repeated strings and the pipeline."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import chat, decontamination, minhash, queries, suffix_dedup, urls

from ..oracle import assert_same


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(queries.QUERIES[name](spark, sf_dir), queries.ORACLES[name], sf_dir)


EVENTS = "conv_id long, turn long, seq long, op string, role string, text string"


def fold_forwards(log):
    """Final messages of events, read from the first to the last and held whole: ``(conv_id, turn, role, text)``."""
    order = lambda v: (v is not None, v if v is not None else 0)
    out = []
    conversations = {}
    for e in log:
        conversations.setdefault(e[0], []).append(e)
    for conv, events in conversations.items():
        held = []  # turn, role, parts
        for _, turn, _, op, role, text in sorted(events, key=lambda e: (order(e[2]), order(e[1]), *(order(x) for x in e[3:]))):
            op, text = op or "message", text or ""
            mine = [m for m in held if m[0] == turn]
            if op == "message" or not mine:
                held.append(mine := [turn, role or "", []])
                mine[2].append("" if op == "regenerate" else text)
            elif op == "delta":
                mine[-1][2].append(text)
            else:
                mine[-1][2][:] = [text] if op == "edit" else []
            if op in ("edit", "regenerate"):
                held = [m for m in held if order(m[0]) <= order(turn)]
        out += [(conv, turn, role, "".join(parts)) for turn, role, parts in sorted(held, key=lambda m: order(m[0]))]
    return out


def by_value(rows):
    return sorted(map(repr, rows))


def test_chat_fold(spark):
    log = [
        (1, 0, 0, "message", "user", "hello"), (1, 0, 1, "delta", None, " there"), (1, 1, 2, "message", "assistant", "old"), (1, 0, 3, "edit", None, "hi"),
        (1, 1, 4, "message", "assistant", "a"), (1, 1, 5, "delta", None, "b"), (1, 1, 6, "regenerate", None, None), (1, 1, 7, "delta", None, "new"), (1, 1, 7, "delta", None, "new2"),
        (2, 0, 0, "delta", "user", "first"), (None, None, None, None, None, None), (3, 0, 0, "message", "user", "x"), (3, 0, 0, "message", "user", "x"),
        (4, 2, 0, "message", "user", "late turn, early event"), (4, 0, 5, "message", "user", "early turn, late event"), (4, 1, None, "regenerate", "tool", "no text"),
    ]
    rng = random.Random(0)
    rng.shuffle(log)
    rows = chat.format_messages(spark.createDataFrame(log, EVENTS)).collect()
    got = sorted((r.conv_id or 0, r.turn or 0, r.role, r.text) for r in rows)
    assert got == [
        (0, 0, "", ""), (1, 0, "user", "hi"), (1, 1, "assistant", "newnew2"), (2, 0, "user", "first"), (3, 0, "user", "x"), (3, 0, "user", "x"),
        (4, 0, "user", "early turn, late event"), (4, 1, "tool", ""), (4, 2, "user", "late turn, early event"),
    ]
    assert by_value((r.conv_id, r.turn, r.role, r.text) for r in rows) == by_value(fold_forwards(log))
    answer = next(r for r in rows if r.role == "assistant")
    assert answer.rendered[answer.loss_begin : answer.loss_end] == "newnew2"
    assert chat.format_messages(spark.createDataFrame([], EVENTS)).count() == 0


def test_chat_fold_of_random_logs(spark):
    rng = random.Random(17)
    log = []
    for conv in [*range(60), None]:
        for _ in range(rng.randrange(1, 25)):
            op = rng.choice(["message", "message", "delta", "delta", "edit", "regenerate", None])
            log.append((conv, rng.choice([None, 0, 1, 2, 3]), rng.choice([None, *range(12)]), op, rng.choice([None, "user", "assistant"]), rng.choice([None, "a", "b", "c" * 9])))
    # An edit without message starts one, with its own role; the brute force gives it the first event's.
    events = spark.createDataFrame(log, EVENTS).repartition(3)
    rows = chat.format_messages(events).collect()
    keep = lambda rows: by_value((c, t, text) for c, t, _, text in rows)
    assert keep((r.conv_id, r.turn, r.role, r.text) for r in rows) == keep(fold_forwards(log))
    assert by_value((r.conv_id, r.turn, r.role, r.text) for r in rows) == by_value(fold_forwards(log))


def test_chat_log_of_turns(spark):
    """The log streams, edits and regenerates; folding it gives the turns back, in one shuffle, whatever they hold."""
    rng = random.Random(18)
    turns = [(c, t, rng.choice(["user", "assistant", None]), "".join(rng.choice("ab<|é\n\\") for _ in range(rng.randrange(30)))) for c in range(40) for t in range(6)]
    turns += [(1, 0, "user", None), (1, 0, "user", None), (None, None, None, None), (2, None, "user", "x"), (3, 2**63 - 1, "user", "last"), (5, 0, "user", "word " * 200_000)]
    frame = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, seq int").repartition(5)
    log = chat.as_events(frame)
    ops = {r.op: r["count"] for r in log.groupBy("op").count().collect()}
    assert min(ops[o] for o in ("message", "delta", "edit", "regenerate")) > 20
    rows = chat.format_messages(log).collect()
    assert by_value((r.conv_id, r.turn, r.role, r.text) for r in rows) == by_value((c, t, r or "", x or "") for c, t, r, x in turns)
    digests = chat.conversation_digests(log)
    assert digests._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {r.conv_id: (r.n_turns, r.turns_sha256) for r in digests.collect()}
    for conv in {t[0] for t in turns}:
        mine = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in turns if c == conv))
        assert got[conv] == (len(mine), hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in mine).encode()).hexdigest())
    assert chat.as_events(frame.where("false")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=20), st.text(alphabet="<|im_startend>\\n\n ", max_size=60))
def test_chat_escapes(role, text):
    rendered, begin, end = chat.render(role, text)
    assert list(chat.parse(rendered * 2)) == [(role, text)] * 2
    assert chat.unescape(rendered[begin:end]) == text and rendered.count(chat.START) == 1 == rendered.count(chat.END)


URLS = "page_id long, url string"


def brute_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else "allow"


def test_urls_by_brute_force(spark):
    rng = random.Random(7)
    rules = [("block", "com", "/en/"), ("allow", "a.com", "/en/7"), ("block", "b.a.com", "/en/7"), ("block", "net", "/"), ("allow", "net", "/x"), ("block", "net", "/xy"), ("allow", "x.net", "")]
    urls_ = [None, "", "nothing", "http://", "HTTP://A.COM/en/7?x#y", "http://com/en/", "ftp://x.net", "http://a.com?/en/7", "http://xa.com/en/7", "http://é.com/en/é"]
    for _ in range(2000):
        host = ".".join(rng.choice(["a", "b", "x", "com", "net", ""]) for _ in range(rng.randint(1, 4)))
        urls_.append(f"http://{host}{rng.choice(['/en/', '/en/7', '/x', '/xyz', '', '/', '/y'])}{rng.choice(['', '?q', '#f', '9'])}")
    urls_ += ["http://a.com/en/71"] * 3000
    rows = [(i, u) for i, u in enumerate(urls_)]
    for r in urls.judge(spark.createDataFrame(rows, URLS), rules).collect():
        assert (r.host, r.path, r.rule, r.verdict) == brute_verdict(urls_[r.page_id], rules), urls_[r.page_id]
    frame = urls.judge(spark.createDataFrame(rows, URLS), rules)
    assert frame.count() == len(rows)
    assert urls.judge(spark.createDataFrame([], URLS), rules).count() == 0
    assert urls.judge(spark.createDataFrame([(None, "http://a.com/en/7"), (1, None)], URLS), []).count() == 2


def test_url_query_gives_the_verdicts_of_its_contract(spark, tmp_path):
    block_com, allow_com = ("com/en/", "block"), ("example.com/en/7", "allow")
    allow_net, block_net, block_org, none = ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"), (None, "allow")
    wanted = {
        "http://com/en/": block_com, "http://a.com/en/7": block_com, "http://example.com/en/6": block_com, "http://www.example.com/en/71": allow_com, "http://com/de/": none,
        "http://net/de/": allow_net, "http://a.net/de/8": allow_net, "http://example.net/de/7": allow_net, "http://xexample.net/de/8": allow_net,
        "http://example.net/de/8": block_net, "http://WWW.Example.NET/de/81?q": block_net, "http://example.net/de?/de/8": none, "http://net/en/": none,
        "http://org/es/": block_org, "http://a.example.org/es/7": block_org, "http://org/de/": none,
        "http://com\x00example/en/7": none, "http://net\x00example/de/8": none, "http://a\x00b.example.net/de/8": block_net, "http://a\x01\x00.net/de/8": allow_net,
    }
    rows = list(enumerate(wanted))
    spark.createDataFrame(rows, URLS).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op8_url_filters(spark, str(tmp_path)).collect()
    assert {rows[r.page_id][1]: (r.rule, r.verdict) for r in got} == wanted and len(got) == len(rows)


def syllables(rng, n):
    return " ".join("".join(rng.choice(["ta", "ro", "mi", "kel", "san", "du"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        i = rng.randrange(len(chars))
        chars[i] = rng.choice(["", "q", chars[i] + "z"])
    return "".join(chars)


def test_decontamination(spark, documents):
    rng = random.Random(3)
    items = [(i, syllables(rng, 35)) for i in range(20)] + [(90, None), (91, "short"), (92, "")]
    rows, planted = [(1000, None), (1001, ""), (1002, "is  SHORT\n"), (1003, syllables(rng, 20_000)), (1004, "shorty unshort")], {(1002, 91)}
    for i in range(120):
        text = syllables(rng, 120)
        if i % 3 == 0:
            item, passage = items[i % 20]
            passage = edited(rng, passage, i % 7) if i % 2 else passage.upper().replace(" ", "\n  ")
            text = f"{text} {passage} {syllables(rng, 30)}"
            planted.add((i, item))
        rows.append((i, text))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_leaks(documents(rows), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == planted and len(found) == len(planted)
    assert {(r.doc_id, r.item_id) for r in found} >= {(1002, 91)}
    clean = decontamination.without_leaks(documents(rows), benchmark)
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {i for i, _ in planted}
    assert clean.columns == documents(rows).columns
    assert decontamination.find_leaks(documents([]), benchmark).count() == 0
    assert decontamination.find_leaks(documents(rows), benchmark.where("false")).count() == 0
    # In blocks of one item each, the same.
    assert {tuple(r) for r in decontamination.find_leaks(documents(rows), benchmark, chars=1).collect()} == {tuple(r) for r in found}
    assert sorted(r.doc_id for r in decontamination.without_leaks(documents(rows), benchmark, chars=1).collect()) == sorted(r.doc_id for r in clean.collect())
    assert decontamination.without_leaks(documents(rows), benchmark, chars=1).columns == documents(rows).columns
    many = list(decontamination.blocks(benchmark, chars=1))
    assert len(many) > 15 and sum(len(b.windows) for b in many) == sum(len(b.windows) for b in decontamination.blocks(benchmark))


def least_edits(window, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(window, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != t)))
        row = new
    return min(row)


def test_filter_loses_nothing():
    """Every region within the edit budget is found, by comparison with full alignments."""
    rng = random.Random(11)
    for _ in range(60):
        item = syllables(rng, 40)[:120].encode()
        known = decontamination.Benchmark([(1, item.decode())])
        n = known.windows[0][2]
        text = (syllables(rng, 30) + edited(rng, item.decode(), rng.randint(0, n + 4)) + syllables(rng, 30)).encode()
        text = decontamination.normalise(text.decode())
        for w, (_, part, edits, _) in enumerate(known.windows):
            best = least_edits(part, text)
            found = [d for v, _, d in known.search(text) if v == w]
            assert bool(found) == (best <= edits) and (not found or min(found) >= best)


@pytest.mark.parametrize("length", [60, 105, 118, 300])
def test_edited_items_at_the_start_of_texts(length):
    """An item is given to the text that holds it, wherever in the text it begins and whatever comes before."""
    rng = random.Random(length)
    texts, want = [], []
    for lead in range(20):
        for edits in (0, 1, 3):
            item = syllables(rng, 80)[:length].strip()
            at = rng.randrange(5, 40)
            changed = "".join("#" if k in range(at, at + 7 * edits, 7) else c for k, c in enumerate(item))
            texts += [syllables(rng, 20), f"{'x' * lead}{changed}{rng.choice(['', ' end'])}"]
            want.append((len(texts) - 1, len(want), item))
    known = decontamination.Benchmark([(i, t) for _, i, t in want])
    assert [(at, item) for at, item, *_ in known.leaks(texts)] == [(at, i) for at, i, _ in want]
    # No hit across the border of two texts: each holds half.
    halves = [half for *_, t in want for half in (t[: length // 2], t[length // 2 :])]
    if length <= 60:
        assert not list(known.leaks(halves))


@pytest.mark.parametrize("seed", range(3))
def test_leaks_equal_full_alignments_of_each_text(spark, documents, seed):
    """Items whole or edited at starts and ends, cut over neighbours, short ones: as by full alignments, however texts are dealt."""
    rng = random.Random(40 + seed)
    items = [(i, syllables(rng, 14 + 3 * i)) for i in range(4)] + [(8, "ba"), (9, "lo ri"), (10, None), (11, " ")]
    texts: list[str | None] = [None, "", "ba", "b a", "xba", "lo  RI", "lo rix", "ba\nlo ri ba"]
    for _, item in items[:4]:
        whole = edited(rng, item, rng.randrange(4))
        texts += [whole, f"{whole} end", f"start {whole}", syllables(rng, 12), item[: len(item) // 2], item[len(item) // 2 :], item[:40], item[-40:], syllables(rng, 30)]
    want = set()
    for i, t in enumerate(texts):
        data = decontamination.normalise(t)
        for item, text in items:
            known = decontamination.Benchmark([(item, text)])
            if any(least_edits(part, data) <= edits for _, part, edits, _ in known.windows):
                want.add((i, item))
            short = " ".join((text or "").lower().split())
            if 0 < len(short) < decontamination.Q and f" {short} " in f" {data.decode()} ":
                want.add((i, item))
    known = decontamination.Benchmark(items)
    assert {(i, item) for i, item, *_ in known.leaks(texts)} == want
    assert {(i, item) for i, t in enumerate(texts) for _, item, *_ in known.leaks([t])} == want
    order = list(range(len(texts)))
    rng.shuffle(order)
    assert {(order[i], item) for i, item, *_ in known.leaks([texts[i] for i in order])} == want
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for parts in (1, 7):
        found = decontamination.find_leaks(documents(list(enumerate(texts))).repartition(parts), benchmark).collect()
        assert sorted((r.doc_id, r.item_id) for r in found) == sorted(want)
        kept = decontamination.without_leaks(documents(list(enumerate(texts))).repartition(parts), benchmark)
        assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(len(texts)) if not any(j == i for j, _ in want)]


def test_screen_loses_nothing():
    """Every text in which a window is found passes the bitmap."""
    rng = random.Random(77)
    items = [(i, syllables(rng, 30 + 6 * i)) for i in range(12)]
    items = [(i, t) for i, t in items if decontamination.Screen.dense(t)]
    assert len(items) >= 8 and not decontamination.Screen.dense(None) and not decontamination.Screen.dense("a short item of many edits")
    known, screen = decontamination.Benchmark(items), decontamination.Screen(24)
    screen.add(known)
    passed = 0
    for i in range(600):
        item = items[rng.randrange(len(items))][1]
        at = rng.randrange(len(item))
        text = " ".join([syllables(rng, rng.randrange(4)), edited(rng, item[at : at + rng.randrange(12, 200)], rng.randrange(8)) if i % 2 else "", syllables(rng, 20)])
        passed += screen.may_hold(text)
        assert screen.may_hold(text) or not known.search(decontamination.normalise(text))
    assert 100 < passed < 400
    assert not screen.may_hold(None) and not screen.may_hold("") and not screen.may_hold("x" * 11)


def test_huge_items_come_in_parts(spark):
    rng = random.Random(21)
    item = syllables(rng, 900)
    benchmark = spark.createDataFrame([(1, item), (2, "other words")], "item_id long, text string")
    parts = list(decontamination.blocks(benchmark, chars=300))
    assert len(parts) > 5 and all(len(b.data) < 800 for b in parts)
    n = decontamination.FRAGMENT
    for at in range(0, len(item) - n, 7):
        text = item[at : at + n]
        if text == text.strip():
            assert any(list(b.leaks([f"zz {text} zz"])) for b in parts)


def test_fragments_of_items():
    """Any stretch of ``FRAGMENT`` bytes of an item is found, wherever it lies, also with a few edits in it; much shorter ones are not."""
    rng = random.Random(9)
    item, short = syllables(rng, 60)[:351], syllables(rng, 20)[:80]
    known = decontamination.Benchmark([(1, item), (2, short)])
    n, texts, want = decontamination.FRAGMENT, [], []
    for i, t in ((1, item), (2, short)):
        for at in range(len(t) - n + 1):
            part = t[at : at + n]
            for p in (part, f"{part[:20]}#{part[21:40]}{part[41:]}"):
                texts.append(f"{syllables(rng, 20)} {p.strip()}{'' if p[-1] == ' ' or p[0] == ' ' else syllables(rng, 20)}")
                # White space at an end of a stretch may be lost with its neighbours: one byte less is promised there.
                if p == p.strip():
                    want.append((len(texts) - 1, i))
    got = {(at, i) for at, i, *_ in known.leaks(texts)}
    assert set(want) <= got and all(got_i == 1 if at < 2 * (len(item) - n + 1) else got_i == 2 for at, got_i in got)
    assert not list(known.leaks([f"{syllables(rng, 20)} {item[at : at + 30]}" for at in range(300)]))


def components_of(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)]


def near_rows(seed, n=60):
    rng = random.Random(seed)
    rows, shared = [(1, ""), (2, " \n\t"), (3, "one two"), (4, "One TWO"), (5, "one two three"), (6, "É É É É É É"), (7, "é é é é é é"), (8, "a " * 3000)], syllables(rng, 60)
    for i in range(n):
        base = syllables(rng, rng.choice([6, 30, 90, 200]))
        if i % 3 == 0:
            base = f"{base} {shared}"
        for _ in range(rng.randint(1, 5)):
            words = base.split()
            for _ in range(rng.randint(0, max(1, len(words) // 60))):
                words[rng.randrange(len(words))] = "changed"
            rows.append((rng.randrange(10**6) * 1000 + len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(documents, seed):
    rows = near_rows(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(documents(rows).repartition(5)).collect()}
    for d, n, c in components_of(rows):
        assert got[d] == (n, c, d == c)


@pytest.mark.parametrize(("seed", "others"), [(1, 0), (2, 0), (3, 3)])
def test_candidates_across_batches(spark, seed, others):
    """Classes that share a bucket and are of fitting size are connected by candidates, however they are dealt."""
    rng = random.Random(seed)
    base = np.unique(np.array([rng.getrandbits(64) for _ in range(100)], np.uint64))
    parts = [[base], [base[:78], *(np.sort(np.array(rng.sample(base[:78].tolist(), rng.randint(59, 62)), np.uint64)) for _ in range(40))]]
    for _ in range(others):
        parts.append([np.sort(np.array(rng.sample(base.tolist(), rng.randint(20, 100)), np.uint64)) for _ in range(30)])
    frame, known = None, []
    for part in parts:
        rows = [(len(known) + i, len(h), bytearray(minhash.bands(minhash.signature(h)).tobytes())) for i, h in enumerate(part)]
        known += part
        one = spark.createDataFrame(spark.sparkContext.parallelize(rows, 1), "c long, n long, bands binary")
        frame = one if frame is None else frame.unionByName(one)
    root = list(range(len(known)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in minhash.candidate_edges(frame).collect():
        root[find(a)] = find(b)
    signs = [set(minhash.bands(minhash.signature(h)).tolist()) for h in known]
    pairs = [(i, j) for i in range(len(known)) for j in range(i) if signs[i] & signs[j] and 100 * min(len(known[i]), len(known[j])) >= 75 * max(len(known[i]), len(known[j]))]
    assert len(pairs) > 500 and not [p for p in pairs if find(p[0]) != find(p[1])]


def test_near_duplicates_nested_in_small_batches(spark, documents):
    """Nested sizes in many batches, against brute force."""
    rng = random.Random(6)
    rows = []
    for _ in range(2):
        words = syllables(rng, 110).split()
        for _ in range(45):
            n = rng.choice([rng.randint(62, 66), rng.randint(80, 84), rng.randint(100, 110)])
            at = rng.randint(0, min(20, 110 - n))
            rows.append((len(rows), " ".join(words[at : at + n])))
    rng.shuffle(rows)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(rows)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == {d: c for d, _, c in components_of(rows)}


def test_near_duplicates_odd_tables(spark, documents):
    text = syllables(random.Random(1), 40)
    rows = [(5, text), (5, text), (None, text), (None, None), (9, text.upper()), (4, None)]
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in minhash.near_duplicates(documents(rows)).collect())
    assert got == [("4", 4, True), ("5", 5, True), ("5", 5, True), ("9", 5, False), ("None", None, True), ("None", None, True)]
    assert minhash.near_duplicates(documents([])).count() == 0


def test_near_duplicates_with_repeated_ids(documents):
    """Texts of one id are one document: they link what each of them is near to."""
    rng = random.Random(8)
    a, b, c, d, e = (syllables(rng, 40) for _ in range(5))
    rows = [(3, a), (5, a), (5, b), (9, b), (3, c), (20, c + " end"), (30, d), (31, d), (31, None), (40, e), (40, e), (41, syllables(rng, 3)), (41, "")]
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(documents(rows)).collect()}
    assert got == {(3, 3, True), (5, 3, False), (9, 3, False), (20, 3, False), (30, 30, True), (31, 30, False), (40, 40, True), (41, 41, True)}


@pytest.mark.parametrize("limit", [400, 5])
def test_remaining_edges_are_all_that_cross(spark, monkeypatch, limit):
    """The exact search gives every linked pair of different components, also of lists that are dealt out."""
    monkeypatch.setattr(minhash, "LIST", limit)
    rng = random.Random(limit)
    common = syllables(rng, 30)
    texts = []
    for i in range(90):
        words = (common + " " + syllables(rng, rng.randrange(8))).split()
        at = rng.randrange(len(words))
        texts.append(" ".join(words[:at] + [syllables(rng, 1)] * (i % 3 > 0) + words[at:]))
    rows = [(i, i if i % 4 else 0, t) for i, t in enumerate(texts)]
    members = spark.createDataFrame(rows, "c long, component long, text string").repartition(3)
    got = [(r.a, r.b) for r in minhash._remaining_edges(members).collect()]
    sets = [minhash.shingles(t) for t in texts]
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if rows[i][1] != rows[j][1] and minhash.linked(sets[i], sets[j])}
    assert len(want) > 300 and want <= set(got) and len(got) == len(set(got))
    assert all(rows[i][1] != rows[j][1] for i, j in got)


def test_recall_over_small_sets(documents):
    """Short texts just at the limit, against brute force."""
    rng = random.Random(19)
    rows = []
    for i in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(6, 16))]
        rows += [(4 * i, " ".join(words)), (4 * i + 1, " ".join([*words, "x"])), (4 * i + 2, " ".join(["y", *words, "z"])), (4 * i + 3, " ".join(words[:-1]))]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(rows).repartition(3)).collect()}
    assert got == {d: c for d, _, c in components_of(rows)}


def test_components_of_a_chain(spark):
    rng = random.Random(1)
    ids = list(range(200))
    rng.shuffle(ids)
    links = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in zip(ids[:150], ids[1:150], strict=False)], "a long, b long")
    got = {r.c: r.component for r in minhash.components(links).collect()}
    assert got == {i: min(ids[:150]) for i in ids[:150]}


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=300))
def test_signature(values):
    h = np.array(sorted(values), np.uint64)
    sig = minhash.signature(h)
    assert set(sig.tolist()) <= set(h.tolist())
    least = {}
    for x in h.tolist():
        least.setdefault(x >> 56, x)
    assert all(sig[b] == x for b, x in least.items())


def test_small_sets_share_a_band():
    """Pairs just at the limit, of the fewest shingles, meet in a bucket."""
    rng = np.random.default_rng(1)
    for small in (3, 4, 6, 12):
        apart = 0
        for _ in range(500):
            h = rng.integers(0, 2**64, small + 1, np.uint64)
            a, b = np.sort(h[:small]), np.sort(h)
            apart += not (minhash.bands(minhash.signature(a)) == minhash.bands(minhash.signature(b))).any()
        assert apart <= 2, small


def brute_repeats(texts, length=suffix_dedup.LENGTH):
    seen = {}
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), int(gone.sum()), int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1)), hashlib.sha256(kept).hexdigest()))
    return out


def repeat_texts(seed):
    rng = random.Random(seed)
    shared = [syllables(rng, n) for n in (30, 45, 60, 200)]
    texts = [None, "", "x" * 199, "y" * 200, "z" * 500, "ab" * 300, "é" * 150, "é" * 150, "w" * 201]
    for i in range(60):
        parts = [syllables(rng, rng.randint(5, 80))]
        for _ in range(rng.randint(0, 2)):
            s = rng.choice(shared)
            cut = rng.randint(0, 40)
            parts += [s[cut : len(s) - rng.randint(0, 40)], syllables(rng, rng.randint(0, 30))]
        texts.append(rng.choice(["", " "]).join(parts))
        if i % 4 == 0:
            texts.append(edited(rng, texts[-1], rng.randint(0, 3)))
        if i % 9 == 0:
            texts.append(texts[-1])
    texts.append(texts[20] * 2)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats(documents, seed):
    texts = repeat_texts(seed)
    frame = documents(list(enumerate(texts))).repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removed_bytes(frame).collect()}
    for i, want in enumerate(brute_repeats(texts)):
        assert got[i] == want, i
    cut = suffix_dedup.without_repeats(frame)
    assert cut.columns == frame.columns and cut.count() == len(texts)
    for r in cut.collect():
        assert r.n_chars == len(r.text or "") and (r.text is None) == (texts[r.doc_id] is None)


def test_repeats_odd_tables(documents):
    text = syllables(random.Random(2), 80)
    rows = [(1, text), (1, text), (None, text + "!"), (3, None)]
    got = [tuple(r)[:3] for r in suffix_dedup.removed_bytes(documents(rows)).orderBy("doc_id").collect()]
    n = len(text)
    assert sorted(got, key=str) == sorted([(1, n, n), (1, n, n), (None, n + 1, n), (3, 0, 0)], key=str)
    assert suffix_dedup.removed_bytes(documents([])).count() == 0
    assert suffix_dedup.removed_bytes(documents([(1, text)])).first().n_removed == 0


def test_repeats_with_equal_prefixes(documents):
    """Windows that agree in all but their last or first byte, in periods and in many copies; anchors that very many share."""
    rng = random.Random(12)
    base = syllables(rng, 60)[:400]
    texts = [base[:199] + chr(97 + i) + syllables(rng, 40)[: i % 5 * 40] for i in range(20)]
    texts += [chr(97 + i) + base[100:299] for i in range(20)]
    texts += [base[50:250], "q" + base[50:250], base[50:249] + "!", "ab" * 99 + "c", "ab" * 99 + "d", "ab" * 100, "ba" * 100 + "c", "x" * 199, "x" * 198 + "y", "a" * 1000]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removed_bytes(documents(list(enumerate(texts))).repartition(5)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)


def test_stages_keep_columns_of_any_name(spark):
    """Columns named like the stages' own come through unchanged."""
    import corpus_pipeline
    from helixframe.llm import stages

    names = ["_cut_key", "_cut_text", "dg", "kept", "row", "first", "rows", "component_id", "score", "c", "n", "at", "text_", "alike", "a.b"]
    text = syllables(random.Random(4), 90)
    rows = [(i, (text if i < 2 else syllables(random.Random(50 + i), 60)), 7, *[f"{k}{i}" for k in range(len(names))]) for i in range(5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, " + ", ".join(f"`{k}` string" for k in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, "/root/testdata/sf0.001")
        assert out.columns == frame.columns, name
        kept = {r["doc_id"]: tuple(r)[3:] for r in out.collect()}
        assert kept and all(kept[i] == rows[i][3:] for i in kept), name
    assert set(r.doc_id for r in stages.drop_near_copies(spark, frame, "").collect()) == {0, 2, 3, 4}
    assert [len(r.text) for r in stages.cut_repeats(spark, frame, "").orderBy("doc_id").collect()][:2] == [0, 0]


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab", min_size=400, max_size=900), st.randoms())
def test_suffix_sort(text, rng):
    data = np.frombuffer(text.encode(), np.uint8)
    starts = np.array(rng.sample(range(len(data) - suffix_dedup.LENGTH + 1), min(60, len(data) - suffix_dedup.LENGTH + 1)))
    h = suffix_dedup.PrefixHash(data)
    order = suffix_dedup.suffix_sort(data, h, starts)
    windows = [text[i : i + suffix_dedup.LENGTH] for i in order.tolist()]
    assert windows == sorted(windows) and sorted(order.tolist()) == sorted(starts.tolist())
    _, same = suffix_dedup.same_windows(data, h, starts)
    assert same.tolist() == [False, *(a == b for a, b in zip(windows, windows[1:], strict=False))]


def test_pipeline(spark, sf_dir):
    """Stage by stage against brute force, each on what the one before kept."""
    import corpus_pipeline
    from helixframe.llm.common import read_table, stored

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "minhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "bpe"]
    docs = read_table(spark, sf_dir, "documents")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stored(stage(spark, kept[-1], sf_dir)))
    assert all(k.columns == docs.columns for k in kept[:-1])
    scores = {r.doc_id: r.predicted for r in queries.op6_toxicity(spark, sf_dir).collect()}
    assert {r.doc_id for r in kept[1].collect()} == {i for i, p in scores.items() if not p}
    rows = [(r.doc_id, r.text) for r in kept[1].collect()]
    assert {r.doc_id for r in kept[2].collect()} == {d for d, _, c in components_of(rows) if c == d}
    before, after = {r.doc_id: r.text for r in kept[2].collect()}, {r.doc_id: r.text for r in kept[3].collect()}
    ids = sorted(before)
    assert sorted(after) == ids
    for i, (_, n, _, digest) in zip(ids, brute_repeats([before[i] for i in ids]), strict=True):
        assert (after[i] == before[i]) if not n else len(after[i].encode()) <= len(before[i].encode()) - n
        if n and not any(ord(c) > 127 for c in before[i]):
            assert hashlib.sha256(after[i].encode()).hexdigest() == digest
    leaks = {r.doc_id for r in decontamination.find_leaks(kept[3], read_table(spark, sf_dir, "benchmark")).collect()}
    assert {r.doc_id for r in kept[4].collect()} == set(ids) - leaks
    final = {tuple(r) for r in kept[5].collect()}
    assert final == {tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()} and len(final) == len(ids) - len(leaks)


def test_stages_on_odd_tables(spark, documents, sf_dir):
    """Empty tables, nulls, repeated rows, extra columns and very long texts pass through every stage, with the results that are stated."""
    import corpus_pipeline
    from helixframe.llm import stages, toxicity
    from helixframe.llm.common import read_table

    rng = random.Random(5)
    text, leak = syllables(rng, 60), read_table(spark, sf_dir, "benchmark").orderBy("item_id").first().text
    long = syllables(rng, 15_000)
    rows = [(1, None), (2, ""), (None, text), (4, "short"), (4, "short"), (5, text * 3), (6, long), (7, long + " end"), (8, f"{long[:20_000]} {leak} {syllables(rng, 9)}"), (None, None), (9, " \n ")]
    odd = documents(rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, documents([]), sf_dir)
        assert out.count() == 0 and (name == "bpe" or out.columns == odd.columns), name

    def ids(frame):
        assert frame.columns == odd.columns
        found = frame.collect()
        assert all((r.lang, r.source, r.n_tokens, r.score) == ("en", "s", 7, "x") for r in found)
        return sorted((str(r.doc_id) for r in found))

    every = sorted(str(i) for i, _ in rows)
    lexicon = toxicity.fit(odd, read_table(spark, sf_dir, "labels"))
    assert ids(stages.drop_toxic(spark, odd, sf_dir)) == sorted(str(i) for i, t in rows if lexicon.score(t) < toxicity.REJECT)
    linked = components_of([(i, t) for i, t in rows if i is not None])
    gone = {str(i) for i, _, c in linked if c != i}
    assert "7" in gone and ids(stages.drop_near_copies(spark, odd, sf_dir)) == [i for i in every if i not in gone]
    cut = stages.cut_repeats(spark, odd, sf_dir)
    assert ids(cut) == every
    want = sorted((str(i), n - k) for (i, _), (n, k, *_) in zip(rows, brute_repeats([t for _, t in rows]), strict=True))
    assert sorted((str(r.doc_id), len((r.text or "").encode())) for r in cut.collect()) == want
    assert all(r.n_chars == len(r.text or "") for r in cut.collect())
    assert ids(stages.drop_leaks(spark, odd, sf_dir)) == [i for i in every if i != "8"]
    coded = stages.encode(spark, odd, sf_dir).collect()
    assert sorted((str(r.doc_id), r.n_tokens == 0) for r in coded) == sorted((str(i), not (t or "").strip()) for i, t in rows)
