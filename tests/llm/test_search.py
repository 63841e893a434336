"""Operators that look for repeats, against brute force on small tables."""

from collections import Counter
from hashlib import md5
from itertools import combinations

import numpy as np
import pytest

from skein.llm import minhash
from skein.llm.common import look_up
from skein.llm.debruijn import repeated_spans
from skein.llm.decontaminate import leaks
from skein.llm.fingerprints import imatch
from skein.llm.lines import repeated_lines, without_repeated_lines
from skein.llm.minhash import near_duplicates, without_near_duplicates
from skein.plans.components import components, contracted

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "lle", "ck")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n))


def edited(rng, text, share):
    w = text.split()
    for i in np.flatnonzero(rng.random(len(w)) < share):
        w[i] = rng.choice(WORDS)
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(5)
    rows = [prose(rng, int(n)) for n in rng.integers(3, 200, 60)]
    rows += [edited(rng, rows[i % 60], s) for i, s in zip(range(80), rng.random(80) * 0.4)]
    rows += rows[:10] + [None, "", "   ", "one", "one", "two words", "two words", "x " * 300, "x " * 301]
    passage = prose(rng, 55)
    rows += [f"{prose(rng, 20)} {passage} {prose(rng, 30)}" for _ in range(6)]
    out = list(enumerate(rows))
    return out + [(None, rows[0]), (None, rows[0]), (3, rows[3]), (7, rows[8])]


def shingles(text, n=3):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute_groups(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b]):
            up[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(len(rows))], sets


def brute_near(rows):
    roots, sets = brute_groups(rows)
    out = set()
    for r in set(roots):
        ids = [rows[i][0] for i in range(len(rows)) if roots[i] == r]
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        out |= {(i, keep) for i in ids if i != keep}
    return out


@pytest.mark.parametrize("options", [{}, {"held": 0}, {"largest": 0}, {"largest": 6}, {"divided": 0}])
def test_near_duplicates(spark, corpus, options):
    got = {tuple(r) for r in near_duplicates(table(spark, corpus), **options).collect()}
    want = brute_near(corpus)
    assert len(got & want) >= 0.97 * len(want)
    assert not {r[0] for r in got} - {r[0] for r in want}


@pytest.mark.parametrize("options", [{}, {"held": 0}, {"divided": 3}, {"largest": 0}, {"largest": 6, "held": 0}])
def test_near_duplicates_are_exact_with_whole_sets(spark, corpus, options):
    """Sketches that hold all of a set estimate without error, so every way through the operator finds what brute force does."""
    docs = table(spark, corpus).selectExpr("*", "1 as t", "2 as root", "3 as block", "4 as v")
    assert {tuple(r) for r in near_duplicates(docs, k=4096, **options).collect()} == brute_near(corpus)


def test_a_large_group_of_near_copies(spark):
    """One that no task may hold is verified in rounds, and whoever differs from most of it isn't lost."""
    rng = np.random.default_rng(11)
    base, other = prose(rng, 60), prose(rng, 60)
    half = " ".join(base.split()[:36] + other.split()[36:])
    rows = list(enumerate([edited(rng, base, 0.03) for _ in range(120)] + [edited(rng, half, 0.02) for _ in range(20)] + [edited(rng, other, 0.03) for _ in range(30)]))
    assert {tuple(r) for r in near_duplicates(table(spark, rows), k=4096, largest=10).collect()} == brute_near(rows)


def test_a_passage_doesnt_chain_groups(spark):
    """What is left of texts from a passage on, and their sizes, tell that it is too little for them to be near; those that it may be enough for meet."""
    passage = range(12)
    sets = {1000 * i + j: [*passage, *range(100 * i, 100 * i + 10 + i)] for i in range(1, 31) for j in range(2)}
    sets |= {90_000 + i: [*passage, *range(10_000 + i, 10_003 + i)] for i in range(20)} | {99_000: list(passage)}
    rows = spark.createDataFrame(list(sets.items()), "t long, s array<long>")
    found = {}
    for t, block in minhash._divided(rows, 0.5).collect():
        found.setdefault(block, set()).add(t)
    small = {t for t in sets if t >= 90_000} | {1000, 1001, 2000, 2001}
    assert sorted(map(sorted, found.values())) == sorted([sorted(small)] + [[1000 * i, 1000 * i + 1] for i in range(3, 31)])


def test_links_connect_what_may_be_near(spark):
    """The components of the links are those of all pairs that a value allows to be near."""
    rng = np.random.default_rng(3)
    rows = [(int(v), 100 * v + i, int(n), int(rng.integers(1, n + 1))) for v in range(40) for i, n in enumerate(rng.integers(1, 40, 12))]
    lists = spark.createDataFrame(rows, "v long, t long, n long, e long")
    got = {tuple(r) for r in components(minhash._links(lists, lists.e * 3 - lists.n)).collect()}
    pairs = [(a[1], b[1]) for a, b in combinations(rows, 2) if a[0] == b[0] and 3 * min(a[3], b[3]) >= a[2] + b[2]]
    assert got == {tuple(r) for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}


@pytest.mark.parametrize("k", [8, 64])
def test_a_block_compares_few_pairs(monkeypatch, k):
    """Near copies don't all read each other's lists, and texts with a passage in common that is too little aren't verified pair by pair."""
    rng = np.random.default_rng(9)
    draw = lambda n: rng.integers(0, 2**62, n).astype(np.uint64)
    base, passage = draw(100), draw(8)
    copies = [np.unique(np.where(rng.random(100) < 0.02, draw(100), base)) for _ in range(600)]
    short = [np.unique(np.concatenate([passage, draw(12)])) for _ in range(300)]
    sets = [*copies, *short, np.unique(np.concatenate([base[:80], draw(20)])), short[0][:15]]
    read, verified, bincount, union = [], [], np.bincount, minhash.union_estimate
    monkeypatch.setattr(np, "bincount", lambda x, **o: (read.append(len(x)), bincount(x, **o))[1])
    monkeypatch.setattr(minhash, "union_estimate", lambda a, b, k: (verified.append(1), union(a, b, k))[1])
    got = minhash.group_block(sets, k, 0.5, 0.0 if k == 8 else 0.3)
    assert got[:600] == [0] * 600 and got[900] == 0 and got[600] == got[901] == 600 and got[601:900] == list(range(601, 900))
    if k == 64:
        assert sum(read) < 1_500_000 and len(verified) < 5_000


def test_a_block_by_brute_force():
    rng = np.random.default_rng(21)
    sets = [np.unique(rng.integers(0, 60, int(n)) + 60 * int(c)).astype(np.uint64) for n, c in zip(rng.integers(1, 60, 300), rng.integers(0, 12, 300))]
    want = list(range(len(sets)))
    for a, b in combinations(range(len(sets)), 2):
        if minhash.exact(sets[a], sets[b]) >= 0.5:
            x, y = sorted((want[a], want[b]))
            want = [x if w == y else w for w in want]
    assert minhash.group_block(sets, 4096, 0.5, 0.3) == want


def test_block_of_copies_and_what_is_almost_one(monkeypatch):
    """Sets that have a passage in common with many near copies but are near to none: the pairs aren't verified one by one."""
    rng = np.random.default_rng(11)
    draw = lambda n: rng.integers(0, 2**63, n, dtype=np.uint64)
    base = draw(300)
    copies = [np.unique(np.concatenate([base[rng.random(300) > 0.1], draw(20)])) for _ in range(300)]
    almost = [np.unique(np.concatenate([rng.choice(base, 180, replace=False), draw(150)])) for _ in range(60)]
    sets = [[*copies, *almost][i] for i in rng.permutation(360)]
    near = np.array([[minhash.union_estimate(a[:64], b[:64], 64) >= 0.3 and minhash.exact(a, b) >= 0.5 for b in sets] for a in sets])
    want = np.arange(360)
    for _ in range(360):
        now = np.where(near | np.eye(360, dtype=bool), want[None, :], 360).min(1)
        if (now == want).all():
            break
        want = now
    assert len(set(want.tolist())) == 61
    calls = []
    one = minhash.union_estimate
    monkeypatch.setattr(minhash, "union_estimate", lambda *a: calls.append(1) or one(*a))
    assert minhash.group_block(sets, 64, 0.5, 0.3) == want.tolist()
    assert len(calls) <= 4 * 360  # one a set in each round


def test_look_up_spreads_hot_keys(spark):
    rows = spark.createDataFrame([(7, i) for i in range(500)] + [(i, i) for i in range(20)] + [(None, 1)], "k long, x long")
    table_ = spark.createDataFrame([(7, 501, "a"), (3, 1, "b"), (99, 0, "c")], "k long, n long, z string")
    for how in ("inner", "left", "left_anti"):
        want = Counter(map(tuple, rows.join(table_, "k", how).collect()))
        for options in ({}, {"held": 0}, {"held": 0, "hot": 10}):
            got = look_up(rows, table_, "k", "n", "x", how, **options)
            assert Counter(map(tuple, got.collect())) == want and got.columns == rows.join(table_, "k", how).columns


def test_one_of_each_group_stays(spark, corpus):
    docs = table(spark, corpus).selectExpr("*", "1 as t", "2 as root", "3 as h", "4 as keep_t")
    kept = without_near_duplicates(docs)
    assert kept.columns == docs.columns
    roots, sets = brute_groups(corpus)
    blank = sum(not s for s in sets)
    groups = len({r for r, s in zip(roots, sets) if s})
    rows = kept.collect()
    assert abs(len(rows) - groups - blank) <= 1
    assert sum(not shingles(r["text"]) for r in rows) == blank


def brute_spans(rows, k):
    docs = sorted({(i, t) for i, t in rows if t is not None}, key=str)
    windows = [(n, p, tuple(t.lower().split()[p : p + k])) for n, (_, t) in enumerate(docs) for p in range(len(t.split()) - k + 1)]
    count = Counter(w for _, _, w in windows)
    out = []
    for n, (i, t) in enumerate(docs):
        hit = [p for m, p, w in windows if m == n and count[w] > 1]
        start = None
        for p in hit:
            if p - 1 not in hit:
                start = p
            if p + 1 not in hit:
                out.append((i, start, p - start + k, max(count[w] for m, q, w in windows if m == n and start <= q <= p)))
    return Counter(out)


@pytest.mark.parametrize("held", [2_000_000, 0])
def test_repeated_spans(spark, corpus, held):
    for k in (8, 20):
        docs = table(spark, corpus).selectExpr("*", "1 as t", "2 as pos", "3 as node", "4 as w")
        got = repeated_spans(docs, least=k, held=held).collect()
        assert Counter((r.doc_id, r.first_word, r.n_words, r.copies) for r in got) == brute_spans(corpus, k)
        assert all(1 <= r.n_paths <= r.n_words for r in got)


def test_paths_end_where_sources_part(spark):
    a, b, c = ([f"{x}{i}" for i in range(30)] for x in "abc")
    rows = [(1, " ".join(a + b)), (2, " ".join(a + b)), (3, " ".join(a + c))]
    got = {(r.doc_id, r.first_word, r.n_words, r.n_paths, r.copies) for r in repeated_spans(table(spark, rows), least=10).collect()}
    assert got == {(1, 0, 60, 2, 3), (2, 0, 60, 2, 3), (3, 0, 30, 1, 3)}


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_lines(rows, least=16):
    last = float("inf")
    place = lambda p: (p[0] is None, p[0] or 0, p[1])
    lines = [((i, n), s.strip(" \t\r")) for i, t in rows for n, s in enumerate((t or "").split("\n")) if len(s.strip(" \t\r")) >= 1]
    first = {}
    for p, s in lines:
        first[s] = min(first.get(s, (last, last)), p, key=lambda p: place(p) if p[0] != last else (True, last, last))
    out = set()
    for p, s in lines:
        near = [(place(first[s]), 0)] + [(place(q), 1) for z, q in first.items() if min(len(s), len(z)) >= least and distance_one(s, z)]
        best, e = min(near)
        if place(p) > best:
            out.add((*p, None if best[0] else best[1], best[2], e))
    return out


@pytest.fixture(scope="module")
def lined():
    rng = np.random.default_rng(2)
    base = [prose(rng, int(n)) for n in rng.integers(2, 12, 40)] + ["ééééééééééééééééé", "a" * 17, "a" * 18, "a" * 19, "日本語" * 8]
    rows = []
    for i in range(40):
        out = []
        for _ in range(int(rng.integers(1, 9))):
            s = base[int(rng.integers(len(base)))]
            kind, at = rng.integers(5), int(rng.integers(len(s)))
            out.append({0: s[:at] + s[at + 1 :], 1: s[:at] + "ß" + s[at:], 2: s[:at] + "é" + s[at + 1 :], 3: f" \t{s}\r", 4: s}[int(kind)])
        rows.append((i, "\n".join(out)))
    return rows + [(None, rows[0][1]), (None, None), (50, None), (51, ""), (52, "\n\n"), (5, rows[5][1]), (6, rows[9][1]), (60, prose(rng, 3000))]


def test_repeated_lines(spark, lined):
    docs = table(spark, lined).selectExpr("*", "1 as line", "2 as h", "3 as kept_line", "'x' as s")
    assert {tuple(r) for r in repeated_lines(docs).collect()} == brute_lines(lined)
    exact = {tuple(r)[:2] for r in repeated_lines(docs, edits=0).collect()}
    assert exact < {r[:2] for r in brute_lines(lined)}


def test_short_lines(spark, lined):
    """Equal lines of every length fall; only the neighbourhood has a least length."""
    rows = lined + [(70, "Notes\n}\nNotes"), (71, "}\nNotez\n \nNotes\t")]
    got = {tuple(r) for r in repeated_lines(table(spark, rows)).collect()}
    assert {r for r in got if r[0] in (70, 71)} == {(70, 2, 70, 0, 0), (71, 0, 70, 1, 0), (71, 3, 70, 0, 0)}
    assert got == brute_lines(rows)
    longer = {tuple(r) for r in repeated_lines(table(spark, rows), shortest=16).collect()}
    text = {(i, n): s.strip(" \t\r") for i, t in rows for n, s in enumerate((t or "").split("\n"))}
    assert longer <= got and all(len(text[r[:2]]) < 16 for r in got - longer if r[0] not in (None, 5, 6))


def test_unsupported_edits(spark, lined):
    for f in (repeated_lines, without_repeated_lines):
        with pytest.raises(ValueError, match="edits = 2"):
            f(table(spark, lined), edits=2)


def test_without_repeated_lines(spark, lined):
    docs = table(spark, lined).selectExpr("*", "1 as t", "2 as gone", "3 as h", "4 as line")
    got = without_repeated_lines(docs)
    assert got.columns == docs.columns
    gone = {r[:2] for r in brute_lines([x for x in lined if x[0] not in (5, 6)])}
    want = {}
    for i, t in lined:
        if i not in (None, 5, 6) and t is not None:
            left = "\n".join(s for n, s in enumerate(t.split("\n")) if (i, n) not in gone)
            if left.strip() or left == t:
                want[i] = left
    rows = {r.doc_id: r for r in without_repeated_lines(table(spark, [x for x in lined if x[0] not in (5, 6)])).collect() if r.doc_id is not None and r.text is not None}
    assert {i: r.text for i, r in rows.items()} == want
    assert all(r.n_chars == len(r.text) for r in rows.values())
    assert {r.doc_id for r in got.filter("text is null").collect()} == {None, 50}


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1200)] + [(5, 5), (None, 3)]
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            up[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in list(up)}


def test_components_within_partitions(spark):
    """Edges that lie together take no round, whatever their order; where runs end within a component, rounds join them."""
    rng = np.random.default_rng(2)
    links = [(f"é{i:03d}" if i % 7 == 0 else f"n{i:03d}", f"é{i + 1:03d}" if (i + 1) % 7 == 0 else f"n{i + 1:03d}") for i in range(300) if i % 50 < 49]
    edges = spark.createDataFrame([links[i] for i in rng.permutation(len(links))], "a string, b string").coalesce(1)
    got = {r.node: r.root for r in components(edges, most_rounds=0).collect()}
    for begin in range(0, 300, 50):
        part = {x for a, b in links if begin <= int(a[1:]) < begin + 50 for x in (a, b)}
        assert {got[x] for x in part} == {min(part)}
    short = contracted(edges, at_once=10)
    assert short.count() <= len(links)
    assert {r.node: r.root for r in components(short).collect()} == got


def test_leaks(spark):
    items = [(1, "Anna walks 12 km to the market and buys 5 red apples for her mother every week."), (2, "short item here"), (3, None), (4, ""), (None, "null id item is left out of it all here now")]
    docs = [
        (1, "Intro words first. Anna walks 12 km to the market and buys 5 red apples for her mother every week. Bye."),
        (2, "So Peter walks 77 km to the market and buys 9 red apples for her mother every week."),
        (3, "An entirely different text about nothing in particular, which should stay where it is."),
        (4, "short item here"), (5, None), (6, ""), (None, items[0][1]), (1, "other text"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks(table(spark, docs), bench).collect()}
    assert got == {(1, 1), (2, 1), (4, 2)}
    clash = table(spark, [(9, "Carl walks 30 km to the market and buys 30 red apples for her mother every week. " * 2)])
    assert {r.item_id for r in leaks(clash, bench).collect()} == {1}  # two slots may take one value
    mixed = spark.createDataFrame([(1, "take 5 pens and 5 pencils and 5 rulers and 5 books to school with you")], "item_id long, text string")
    wrong = table(spark, [(1, "take 5 pens and 6 pencils and 7 rulers and 8 books to school with you")])
    assert leaks(wrong, mixed).count() == 0


def test_leaks_with_few_words(spark):
    """Items of numbers and names are found word for word, and only so."""
    items = [(1, "Compute 12 * 7 + 5 - 3"), (2, "Anna Berg, 3 May 1871; Carl Dahl, 4 June 1902; Eva Falk, 9 July 1911; Gus Holm, 2 March 1920"), (3, "31 / 8")]
    docs = [(1, "Homework. Compute 12 * 7 + 5 - 3 now"), (2, "Homework. Compute 12 * 7 + 5 - 4 now"), (3, f"We met {items[1][1]} there."), (4, "Compute 13 * 7 + 5 - 3"), (5, items[1][1].replace("1", "8")), (6, "it is 31 / 8 or so")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks(table(spark, docs), bench).collect()} == {(1, 1), (3, 2), (6, 3)}


def test_leaks_with_a_changed_mention(spark):
    """One slot value that stands for two takes only its own windows away, and none that agree word for word."""
    item = f"Anna has 12 hens in a coop. {' '.join(WORDS[:20])} and the 12 hens of hers lay 3 eggs each on every single day"
    other = item.replace("12", "40").replace("Anna", "Peter")
    docs = [(1, item), (2, item[::-1].replace("21", "31", 1)[::-1]), (3, other), (4, other.replace("40", "41", 1)), (5, "a doc of its own")]
    assert docs[1][1] != item and docs[3][1] != other
    short = "the 12 hens and 12 cows eat 12 kg of dry hay daily"
    more = [(6, short.replace("12", "15")), (7, short.replace("12", "15", 1)), (8, short.replace("12 hens", "15 hens").replace("12 kg", "13 kg"))]
    bench = spark.createDataFrame([(1, item), (2, short)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in leaks(table(spark, docs + more), bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 1), (6, 2), (7, 2)}
    n = got[1, 1].item_windows
    assert got[1, 1].matched == n >= got[2, 1].matched >= 6 and got[3, 1].matched > got[4, 1].matched >= 6


def test_imatch(spark, corpus):
    docs = table(spark, corpus)
    rows = imatch(docs).collect()
    assert len(rows) == 5 * len(corpus)
    joined = imatch(docs, broadcast_terms=0).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, joined))
    by_id = {r.doc_id: r.fingerprint for r in rows if r.subset == 0 and r.doc_id not in (None, 3, 7)}
    assert by_id[0] is not None and by_id[60 + 80] == by_id[0]


def test_long_texts_and_clashing_names(spark):
    """One text of some megabytes, repeated rows, and columns named like those that the operators make."""
    rng = np.random.default_rng(15)
    item = "Anna walks 12 km to the market and buys 5 red apples for her mother every week."
    passage = prose(rng, 70)
    long = " ".join(rng.choice(WORDS, 400_000)) + f" {passage} The end. {item} " + " ".join(rng.choice(WORDS, 1000))
    rows = [(1, long), (2, f"{prose(rng, 40)} {passage} {prose(rng, 9)}"), (3, item.replace("12", "70")), (3, item.replace("12", "70")), (4, None), (None, long)]
    docs = table(spark, rows).selectExpr("*", "1 as id", "2 as pos", "3 as template", "4 as term", "5 as t", "6 as seed", "7 as doc", "8 as slots", "9 as df")
    bench = spark.createDataFrame([(7, item)] * 2, "item_id long, text string").selectExpr("*", "1 as id", "2 as key", "'x' as source")
    assert {(r.doc_id, r.item_id) for r in leaks(docs, bench).collect()} == {(1, 7), (3, 7)}
    at = long.split().index(passage.split()[0], 399_000)
    while long.split()[at : at + 70] != passage.split():
        at += 1
    spans = {(r.doc_id, r.first_word, r.n_words) for r in repeated_spans(docs).collect()}
    assert (2, 40, 70) in spans and {i for i, *_ in spans} == {1, 2, None} and (1, 0, len(long.replace(".", "").split())) in spans
    prints = imatch(docs).collect()
    assert len(prints) == 5 * len(rows)
    assert len({(r.subset, r.fingerprint) for r in prints if r.doc_id in (1, None)}) == 5 and all(r.fingerprint is None for r in prints if r.doc_id == 4)
    fallen = {(r.doc_id, r.kept_doc_id) for r in repeated_lines(docs).collect()}
    assert fallen == {(None, 1)}
    assert {(r.doc_id, r.kept_doc_id) for r in near_duplicates(docs).collect()} == {(None, 1)}


def brute_imatch(rows, low=0.15, high=0.8):
    terms = [(i, sorted(set((t or "").lower().split()))) for i, t in rows]
    df = Counter(w for _, ws in terms for w in ws)
    n = np.log(max(2, sum(t is not None for _, t in rows)))
    out = []
    for i, ws in terms:
        kept = [w for w in ws if low <= (n - np.log(df[w])) / n <= high]
        for s in range(5):
            own = [w for w in kept if s == 0 or md5(w.encode()).hexdigest()[s - 1] < "b"]
            out.append((i, s, len(own), md5(" ".join(own).encode()).hexdigest() if own else None))
    return Counter(out)


def test_imatch_by_brute_force(spark, corpus):
    docs = table(spark, corpus)
    for options in ({}, {"broadcast_terms": 0}, {"low": 0.0, "high": 1.0}):
        want = brute_imatch(corpus, **{k: v for k, v in options.items() if k != "broadcast_terms"})
        assert Counter(map(tuple, imatch(docs, **options).collect())) == want


def test_empty_tables(spark, corpus):
    docs, some = table(spark, []), table(spark, corpus[:3])
    bench = spark.createDataFrame([], "item_id long, text string")
    for out in (near_duplicates(docs), without_near_duplicates(docs), repeated_spans(docs), repeated_lines(docs), without_repeated_lines(docs), leaks(docs, bench), leaks(some, bench), imatch(docs)):
        assert out.collect() == []


def test_passages_need_no_verifying_in_rounds(spark, monkeypatch):
    """Groups that only have a passage in common are no block too large for a task, in which all who share it would be joined."""
    rng = np.random.default_rng(31)
    passage, rows = prose(rng, 14), []
    for _ in range(30):
        own = prose(rng, 8)
        rows += [f"{passage} {own} one", f"{passage} {own} two"]
    monkeypatch.setattr(minhash, "_verified", lambda *_, **__: pytest.fail("verified in rounds"))
    kept = without_near_duplicates(table(spark, list(enumerate(rows))), divided=3, largest=10)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 60, 2))
