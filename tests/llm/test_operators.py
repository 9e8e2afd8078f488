"""Media, SimHash, licences, HTML, classifiers, mixing and rules: brute force, round trips, held-out accuracy, edge cases."""

import hashlib
import random
import tarfile
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framelake.llm import fitting, html_text, licenses, media, mixing, quality, queries, rules, runtime, simhash, toxicity

SMALL = "/root/testdata/sf0.001"
CLASH = "doc_id long, text string, source string, score string, fp__ int, digest string, q_text string, l_text string"


def table(spark, texts, sources=None):
    rows = [(i, t, (sources or {}).get(k, "s"), "x", 1, "y", "z", "w") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, CLASH)


EDGE = [(1, None), (2, ""), (None, "no id at all"), (3, "same text here for all"), (3, "same text here for all"), (4, "long words " * 20000), (5, "same text here for all")]


def rows_of(sql, name="documents", where=SMALL):
    con = duckdb.connect()
    con.execute(f"create view {name} as select * from read_parquet('{where}/{name}.parquet')")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return names, found.fetchall()


def same(got, sql_rows, names):
    key = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in r)
    return sorted(map(key, (tuple(r[n] for n in names) for r in got)), key=repr) == sorted(map(key, sql_rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    names, want = rows_of(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(names)
    assert same(got.collect(), want, names)


# ---- media --------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400))
def test_payload_round_trip(raw):
    payload = media.padded(raw)
    assert len(payload) % 64 == 0 and payload and payload.startswith(raw)
    stored = media.to_png(payload)
    assert media.from_png(stored) == payload
    assert media.png_header(stored[:33]) == (64, len(payload) // 64, 8)
    assert media.feature(payload) == media.feature(bytes(payload))


def brute_feature(payload):
    import math
    from fractions import Fraction

    n = len(payload)
    mean = Fraction(sum(payload), n)
    deviation = math.sqrt(Fraction(sum(b * b for b in payload), n) - mean * mean)
    shares = [payload.count(b) / n for b in set(payload)]
    entropy = -sum(p * math.log2(p) for p in shares)
    bits = ""
    for k in range(64):
        block = payload[k * n // 64 : (k + 1) * n // 64]
        bits += str(int(Fraction(sum(block), len(block)) > mean))
    return float(mean), deviation, entropy, f"{int(bits, 2):016x}"


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.binary(max_size=700), st.text(max_size=300).map(lambda t: t.encode("utf-8", "surrogatepass"))))
def test_feature_equals_brute_force(raw):
    payload = media.padded(raw)
    mean, deviation, entropy, blocks = media.feature(payload).split(",")
    want = brute_feature(payload)
    assert [float(mean), float(deviation), float(entropy)] == pytest.approx(want[:3], abs=6e-5) and blocks == want[3]


def test_copies_share_a_place(spark):
    texts = [(k, f"text {k % 5}") for k in range(60)]
    got = media.media_columns(table(spark, texts).coalesce(1), runtime.new_path(spark, "m")).collect()
    assert len(got) == 60 and len({(r.digest, r.shard, r.offset) for r in got}) == 5


def test_media_columns(spark):
    out_dir = runtime.new_path(spark, "m")
    got = media.media_columns(table(spark, EDGE), out_dir).collect()
    assert len(got) == len(EDGE)
    by_text = {}
    for (i, t), r in zip(sorted(EDGE, key=repr), sorted(got, key=lambda r: repr((r.doc_id, r.n_bytes))), strict=False):
        by_text.setdefault(r.payload_sha256, r)
    for i, t in EDGE:
        raw = (t or "").encode()
        payload = media.padded(raw)
        match = [r for r in got if r.doc_id == i and r.payload_sha256 == hashlib.sha256(payload).hexdigest()]
        assert match
        r = match[0]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-64:]))
        assert r.feature == media.feature(payload) and (r.width, r.height) == (64, len(payload) // 64)
    # the shards are tar files whose members are named by their payload's digest
    fs, base = runtime.filesystem(got[0].shard)
    with tarfile.open(base) as tar:
        for member in tar:
            stored = tar.extractfile(member).read()
            assert hashlib.sha256(media.from_png(stored)).hexdigest() + ".png" == member.name
    places = {(r.digest, r.shard, r.offset) for r in got}
    assert len(places) == len({r.digest for r in got})
    assert media.media_columns(table(spark, []), runtime.new_path(spark, "m")).count() == 0


# ---- SimHash ------------------------------------------------------------------


def brute_fingerprint(text):
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0d]+", text.encode()) if w]
    words = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
    if not words:
        return 0
    grams = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=" \t\n\x0b\x1fabABÉß ", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 5000)
    for flips in (0, 1, 2):
        other = words.copy()
        for k in range(len(other)):
            for b in rng.choice(23, flips, replace=False):
                other[k] ^= 1 << int(b)
        (a, n), (b, m) = simhash.segment_keys(words), simhash.segment_keys(other)
        assert all(set(a[k, : n[k]]) & set(b[k, : m[k]]) for k in range(len(words)))
    assert set(np.unique(simhash.golay()[2])) == {1, 6}


def test_bucket_keys_find_every_pair():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 3000, dtype=np.uint64)
    b = a.copy()
    for k in range(len(b)):
        for bit in rng.choice(64, int(rng.integers(0, 5)), replace=False):
            b[k] ^= np.uint64(1) << np.uint64(bit)
    keys = []
    for fps in (a, b):
        rows, key = simhash.bucket_keys(fps)
        sets = [set() for _ in fps]
        for r, k in zip(rows.tolist(), key.tolist(), strict=True):
            sets[r].add(k)
        keys.append(sets)
    assert all(x & y for x, y in zip(*keys, strict=True))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                root[find(i)] = find(j)
    return [find(k) for k in range(len(fps))]


@pytest.mark.parametrize("bucket_rows", [100_000, 40])
def test_components_equal_brute_force(spark, bucket_rows):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(40)]
    fps = [0, 0] + [rng.getrandbits(64) for _ in range(200)]
    for c in centres[:30]:
        now = c
        for _ in range(8):  # a chain whose ends are far apart
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                now ^= 1 << bit
            fps.append(now)
    dense = centres[31]
    fps += [dense ^ 1 << rng.randrange(20) ^ 1 << rng.randrange(20) for _ in range(150)]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    ids = list(range(1000, 1000 + len(fps)))
    rng.shuffle(ids)
    printed = spark.createDataFrame(list(zip(ids, signed, strict=True)), "doc_id long, fp long")
    found = {r.fp: r.component_id for r in simhash.component_ids(printed, bucket_rows).collect()}
    roots = brute_components(fps)
    least = {}
    for k, r in enumerate(roots):
        least[r] = min(least.get(r, 1 << 40), ids[k])
    assert [found[s] for s in signed] == [least[r] for r in roots]


def test_hot_bucket_is_never_one_worker(spark):
    """One bucket of ten times what a task compares: all fingerprints agree in two segments."""
    rng = np.random.default_rng(8)
    high = np.unique(rng.integers(0, 1 << 21, 9000, dtype=np.uint64))[:8000] << np.uint64(43)
    fps = spark.createDataFrame([(int(v),) for v in high.view(np.int64)], "fp long")
    keyed = fps.mapInArrow(simhash._expand, "key long, fp long")
    sizes = {r["key"]: r["count"] for r in keyed.groupBy("key").count().collect()}
    large = {r.key: r.n for r in simhash.large_buckets(keyed, 800).collect()}
    assert large == {k: n for k, n in sizes.items() if n > 800} and max(large.values()) == len(high)
    found = {r.node & (1 << 64) - 1: r.root for r in simhash.components(simhash.links(fps, 800)).collect()}
    roots, members = simhash.forest(high)  # of all at once
    want = {}
    for a, b in zip(roots.tolist(), members.tolist(), strict=True):
        want.setdefault(a, {a}).add(b)
    groups = {}
    for node, root in found.items():
        groups.setdefault(root, set()).add(node)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values())


def test_long_chain_of_edges(spark):
    n = 400
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(1000, 1001), (1001, 1000)], "a long, b long")
    got = simhash.components(edges).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.root, set()).add(r.node)
    assert sorted(map(len, groups.values())) == [2, n + 1]


def test_near_duplicates_edges(spark):
    got = simhash.near_duplicates(table(spark, EDGE)).collect()
    assert len(got) == len(EDGE)
    by = {}
    for r in got:
        by.setdefault(r.fingerprint, set()).add(r.component_id)
    assert by["0" * 16] == {1}
    assert all(len(v) == 1 for v in by.values())
    kept = simhash.keep_one(table(spark, EDGE))
    assert kept.columns == table(spark, EDGE).columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, None, 3, 4], key=repr)
    # rows of one id and fingerprint: the choice is by their text, wherever they lie
    ties = [(7, "a b"), (7, "a  b"), (7, "A b"), (None, "a b"), (None, "A b")] * 3
    chosen = [simhash.keep_one(table(spark, t).repartition(n)).collect() for t, n in ((ties, 1), (ties[::-1], 3))]
    assert chosen[0] == chosen[1] and len(chosen[0]) == 1 and chosen[0][0].doc_id == 7
    assert simhash.near_duplicates(table(spark, [])).count() == 0


# ---- licences, rules ----------------------------------------------------------


def test_licenses(spark):
    texts = [
        (11, "Licensed under CC BY-NC 4.0."), (12, "cc by cc by"), (13, "x ALL Rights\treserved; General Public License"), (14, "Licenced under the Apache License, Version 2.0"),
        (15, "all rights were reserved"), (16, licenses.TEMPLATES[6].text.replace("any person", "all persons")), *EDGE,
    ]
    got = {r.doc_id: r for r in licenses.scan(table(spark, texts)).collect()}
    assert (got[11].base_labels, got[11].labels, got[11].n_base, got[11].first_word) == ("cc-by", "cc-by,cc-by-nc", 1, 2)
    assert (got[12].n_base, got[12].first_word, got[12].last_word) == (2, 0, 2)
    assert (got[13].base_labels, got[13].first_word, got[13].last_word) == ("gpl,reserved", 1, 4)
    assert got[14].labels == "apache-2.0" and 0.8 <= got[14].score < 1
    assert got[15].labels == "" and got[15].score == 0 and got[15].first_word is None
    assert got[16].labels == "mit"
    assert got[None].n_words == 4
    assert licenses.scan(table(spark, [])).count() == 0


def brute_matches_of(text):
    """Every template at every place."""
    import re

    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    out = []
    for t in licenses.TEMPLATES:
        for s in range(-len(t.words), len(words)):
            same = [0 <= s + k < len(words) and words[s + k] == w for k, w in enumerate(t.words)]
            if sum(same) >= t.least and all(same[k] for k in t.key_places):
                out.append((t.label, s, sum(same), len(t.words)))
    return sorted(out)


def test_bodies_equal_brute_force(spark):
    """Licence bodies with words changed, lost and doubled, beside each other and in long and repeated texts."""
    rng = random.Random(6)
    texts = []
    for k in range(120):
        parts = []
        for t in rng.sample(licenses.TEMPLATES, rng.randint(1, 3)):
            words = list(t.words)
            for _ in range(rng.choice([0, 0, 1, 2, len(words) // 6])):
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice([["x"], [], [words[at]] * 2, [rng.choice(words)]])
            parts.append(rng.choice([" ", ", ", "\n * "]).join(words).title() if rng.random() < 0.5 else " ".join(words))
        texts.append((k, " the of to ".join(parts)))
    texts += [(500, "the software is public general license all of the " * 3000), (501, texts[0][1]), (501, texts[0][1]), *EDGE]
    got = licenses.scan(table(spark, texts)).collect()
    key = lambda i, m: (repr(i), sorted(tuple(x) for x in m))
    assert sorted(key(r.doc_id, r.matches) for r in got) == sorted(key(i, brute_matches_of(t)) for i, t in texts)
    assert sum(len(r.matches) for r in got) > 100


def test_index_chooses_rare_key_words():
    frequency = {"license": 9, "general": 5, "public": 7, "the": 100, "mit": 1, "released": 3, "under": 50}
    (gpl,), (mit,) = (licenses.index((t,), frequency) for t in (licenses.TEMPLATES[1], licenses.TEMPLATES[5]))
    assert gpl.anchor == "general" and gpl.places == (0, 1, 2) and gpl.agree == 3
    assert mit.anchor == "mit" and mit.places[0] == 3 and mit.places[-1] == 2
    with pytest.raises(ValueError, match="key phrase"):
        licenses.index((licenses.Template("x", "a b c d e"),), {})


def brute_repeats(words):
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = set()
    for k, g in enumerate(grams):
        if grams.count(g) > 1:
            covered.update((k, k + 1, k + 2))
    return len(covered)


def test_rules(spark):
    rng = random.Random(2)
    texts = [(k, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))) for k in range(10, 60)]
    texts += [*EDGE, (99, "x\nx\n \n\nx #$% <b>|")]
    got = {r.doc_id: r for r in rules.apply_rules(table(spark, texts)).collect()}
    assert (got[4].n_words, got[4].n_repeat_words, got[4].base_failed) == (40000, 40000, True)
    assert [r.n_words for r in rules.apply_rules(table(spark, texts)).filter("doc_id = 3").collect()] == [5, 5]
    for i, t in texts[:50]:
        assert got[i].n_repeat_words == brute_repeats(t.split()), t
        assert got[i].n_words == len(t.split())
    assert (got[99].n_dup_lines, got[99].n_symbols, got[99].word_chars) == (1, 6, 10)
    assert got[2].n_words == 0 and got[2].base_failed and not got[2].kept
    assert rules.apply_rules(table(spark, texts)).filter("kept").count() == 0
    assert rules.apply_rules(table(spark, [])).count() == 0


def test_stop_words(spark):
    names = [a + b + c for a in ("bar", "kol", "lim", "mut") for b in ("do", "fi", "ga") for c in ("sel", "tor", "nim", "pak", "rud")]
    listed = " ".join(names)
    texts = [(1, listed), (2, listed + " \u201cThe, (of) una."), (3, listed + " thesis often")]
    got = {r.doc_id: r for r in rules.apply_rules(table(spark, texts)).collect()}
    assert [(got[i].failed, got[i].kept) for i in (1, 2, 3)] == [(["stop_words"], False), ([], True), (["stop_words"], False)]
    assert [round(got[i].stop_word_ratio * got[i].n_words) for i in (1, 2, 3)] == [0, 3, 0]


def test_places_beyond_the_low_bits(spark, monkeypatch):
    """Texts of more words than the hash's low bits can number, here eight."""
    rng = random.Random(3)
    texts = [(k, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 30)))) for k in range(40)]
    want = {r.doc_id: r.n_repeat_words for r in rules.apply_rules(table(spark, texts)).collect()}
    monkeypatch.setattr(rules, "PLACE_BITS", 3)
    assert {r.doc_id: r.n_repeat_words for r in rules.apply_rules(table(spark, texts)).collect()} == want == {i: brute_repeats(t.split()) for i, t in texts}


def test_rules_are_one_projection(spark):
    plan = rules.apply_rules(table(spark, EDGE))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    plan = licenses.scan(table(spark, EDGE), frequency={})._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


# ---- HTML ---------------------------------------------------------------------

PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><div class=logo>Site</div></header>
<nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice"><p>We use cookies on this site to make it better. Accept.</p></div>
<main><article><header><h1>Title &amp; more</h1></header><p><b>First  para with <a href=x>link</a> and&nbsp;text.<br><p>Second &copy 2 &lt;b&gt;.
<ul><li>item one<li>item two</ul><div class="ad">Buy now, it is very cheap today.</div><aside><p>Related: other stories of interest.</p></aside>
<form><label>Email</label><input><button>Go</button></form></article><section id="comments"><h2>Comments</h2><div class="comment"><p>Nice article, I really liked reading it.</p></div></section></main>
<div id="sidebar"><p>Some sidebar text that is long enough to look like content.</p></div><footer>&copy; 2020 Site. All of it.</footer></body></html>"""


def test_main_text():
    want = "Title & more\nFirst para with link and text.\nSecond © 2 <b>.\nitem one\nitem two"
    assert html_text.main_text(PAGE) == want
    assert html_text.main_text("") == "" and html_text.main_text("<nav>Home</nav>") == ""
    assert html_text.main_text("<article><p>Cut off in the middle &am") == "Cut off in the middle &am"
    assert html_text.main_text("<article><p>One line of text here.</p><p class=") == "One line of text here."
    assert html_text.main_text("<article>" + "<div>" * 3000 + "deep text inside of it") == "deep text inside of it"


TEXT = "A first sentence of the text, long enough to be taken for content."


@pytest.mark.parametrize("tag", ["body style='overflow-x:hidden'", "div class=\"overflow-hidden\"", "a href=/hidden-valley", "a href='/x?display:none'", "div data-x='is hidden'",
                                 "div style='backface-visibility: hidden'", "div aria-hidden=false", "p title=\"a\"hidden\" b\"", "div data-hidden"])
def test_attributes_that_do_not_hide(tag):
    assert html_text.main_text(f"<html><article><{tag}>{TEXT}") == TEXT


@pytest.mark.parametrize("tag", ["div hidden", "div HIDDEN=''", "div class=x hidden=until-found", "div aria-hidden='true'", "div aria-hidden=true", "p style='color:red; Display : none'",
                                 "p style=display:none!important", "p style='visibility:hidden'"])
def test_attributes_that_hide(tag):
    assert html_text.main_text(f"<html><article><{tag}>{TEXT}") == ""


HEAD = "<html><head><meta charset=utf-8><title>T</title><style>p{}</style>\n<template><div>unseen text</div></template>"


@pytest.mark.parametrize("rest", [f"<body><article><p>{TEXT}", f"<article><p>{TEXT}", f"<main>{TEXT}</main>", f"<script src=x /><body><article>{TEXT}", f"</head><body><article><p>{TEXT}"])
def test_head_without_its_end(rest):
    assert html_text.main_text(HEAD + rest) == TEXT


def test_text_ends_a_head():
    assert [b.text for b in html_text.blocks(HEAD + TEXT + "<br>More of it.")] == [TEXT + " More of it."]


def brute_cut(odds, edges):
    best = None
    n = len(odds)
    for bits in range(1 << n):
        side = [bits >> k & 1 for k in range(n)]
        cost = sum(x for x, s in zip(odds, side, strict=True) if x > 0 and not s) - sum(x for x, s in zip(odds, side, strict=True) if x < 0 and s)
        cost += sum(c for a, b, c in edges if side[a] != side[b])
        best = cost if best is None else min(best, cost)
    return best


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-9, 9), min_size=1, max_size=7), st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6), st.integers(0, 6)), max_size=12))
def test_minimum_cut(odds, edges):
    odds = [float(x) for x in odds]
    edges = [(a, b, float(c)) for a, b, c in edges if a < len(odds) and b < len(odds) and a != b]
    side = html_text.minimum_cut(odds, edges)
    cost = sum(x for x, s in zip(odds, side, strict=True) if x > 0 and not s) - sum(x for x, s in zip(odds, side, strict=True) if x < 0 and s)
    cost += sum(c for a, b, c in edges if side[a] != side[b])
    assert abs(cost - brute_cut(odds, edges)) < 1e-6


def small_graphs():
    """Graphs of the driver's pages, cut down to what all labellings of can be tried."""
    con = duckdb.connect()
    for (page,) in con.execute(f"select html from read_parquet('{SMALL}/pages.parquet') order by page_id").fetchall():
        for part in (page[:1500], "<div>" + page[page.rindex("<p>") :], page.replace("<article>", "<div>")[:1800]):
            found = html_text.blocks(part)
            odds, edges = html_text.graph(found)
            if len(odds) <= 12:
                yield odds, edges


def test_cut_on_real_pages():
    tried = 0
    for odds, edges in small_graphs():
        side = html_text.minimum_cut(odds, edges)
        cost = sum(x for x, s in zip(odds, side, strict=True) if x > 0 and not s) - sum(x for x, s in zip(odds, side, strict=True) if x < 0 and s)
        assert abs(cost + sum(c for a, b, c in edges if side[a] != side[b]) - brute_cut(odds, edges)) < 1e-6
        tried += 1
        if tried == 40:
            break
    assert tried >= 20


PARAGRAPH = TEXT + " And it goes on for some more words, so that it is a paragraph of the usual length of one in an article."


@pytest.mark.parametrize("page, want", [
    # thresholds on the blocks' own costs drop the short paragraph and the list, and keep the aside
    (f"<body><div><ul><li><a href=/>Home</a><li><a href=/b>Blog</a></ul></div><div><p>{PARAGRAPH}<p>Short<p>{PARAGRAPH}<ul><li>one<li>two</ul></div><div>\u00a9 2020 X.</div>", f"{PARAGRAPH}\nShort\n{PARAGRAPH}\none\ntwo"),
    (f"<article><p>{PARAGRAPH}<aside><div><p>{PARAGRAPH}<p>{PARAGRAPH}</div></aside><p>The end</article>", f"{PARAGRAPH}\nThe end"),
    (f"<article><p>{PARAGRAPH}<ul><li><a href=1>Reference one</a><li><a href=2>Reference two</a></ul></article>", f"{PARAGRAPH}\nReference one\nReference two"),
    (f"<main><p>{PARAGRAPH}</main><div id=left-sidebar><p>{PARAGRAPH}<p>{PARAGRAPH}</div>", PARAGRAPH),
    (f"<article><p>{PARAGRAPH}</article><div class=comments><article class=comment><p>{PARAGRAPH}</article></div>", PARAGRAPH),
    (f"<article><div class=ad-slot><p>{PARAGRAPH}</div><p>{PARAGRAPH}</article>", PARAGRAPH),
])
def test_the_cut_decides(page, want):
    assert html_text.main_text(page) == want
    found = html_text.blocks(page)
    assert html_text.labels(found) != [html_text.log_odds(b) > 0 for b in found] or "ad-slot" in page


@pytest.mark.parametrize("page, want", [
    (f'<article class="overflow-hidden"><p>{TEXT}', TEXT), (f'<article class="form-study"><p>{TEXT}', TEXT), (f'<main class="with-sidebar"><p>{TEXT}', TEXT), (f'<body class="has-sidebar"><div>{TEXT}', TEXT),
    (f'<article><h2 class="post-header">Title of it</h2><p>{TEXT}', f"Title of it\n{TEXT}"), (f'<article><div class="related-work"><p>{TEXT}</div>', TEXT),
    ("<article><p>Where <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x = 2</annotation></math> holds.<script>x</script> So", "Where x=2 holds. So"),
    (f'<article class="promo"><p>{PARAGRAPH}', PARAGRAPH), (f"<article>{'<b>' * 20}<a href=x>{'<i>' * 20}{TEXT}", TEXT),
])
def test_names_that_do_not_drop(page, want):
    assert html_text.main_text(page) == want


def plain_article(page):
    """The driver's pages read another way: headings and paragraphs of their one article."""
    import html as entities
    import re

    inside = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    parts = (" ".join(entities.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", inside))
    return "\n".join(x for x in parts if x)


def test_driver_pages():
    con = duckdb.connect()
    pages = [p for (p,) in con.execute(f"select html from read_parquet('{SMALL}/pages.parquet')").fetchall()]
    assert all(html_text.main_text(p) == plain_article(p) for p in pages)
    counts = np.sum([html_text.agreement(p) for p in pages], axis=0)
    assert counts[1] >= 0.05 * counts[0]  # own text overruled


def test_very_long_page():
    page = "<body>" + "".join(f"<div class=a{k}><p>{PARAGRAPH if k % 3 else 'no'}</p><a href=x>link {k}</a></div>" for k in range(5000))
    assert html_text.main_text(page).count(PARAGRAPH) == sum(k % 3 > 0 for k in range(5000))


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (1, None, None, "t"), (None, "v", "", "t")], "page_id long, url string, html string, text string")
    got = html_text.extract(pages).collect()
    assert len(got) == 3 and sorted(r.n_chars for r in got)[:2] == [0, 0]
    assert html_text.extract(pages.limit(0)).count() == 0


# ---- classifiers --------------------------------------------------------------


def test_fold():
    assert toxicity.fold("You 1d1ot! ѕtupid m0r0n 2.0 $cum") == " you idiot stupid moron 2 0 scum "
    assert toxicity.fold("") == "  "


def corpus(n=400, seed=0):
    rng = random.Random(seed)
    words = [a + b for a in ("ba", "ko", "li", "mu", "te", "ran") for b in ("do", "fi", "ga", "sel", "tor")]
    texts, labels = [], []
    for _ in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        y = rng.random() < 0.3
        if y:
            for _ in range(3):
                t.insert(rng.randrange(len(t)), rng.choice(["idiot", "zorgak" + rng.choice("abcd"), "1d1ot"]))
        texts.append(" ".join(t))
        labels.append(float(y))
    return texts, np.array(labels)


def as_sample(spark, texts, labels):
    return spark.createDataFrame([(k, t, int(y)) for k, (t, y) in enumerate(zip(texts, labels, strict=True))], "doc_id long, text string, label int")


def test_toxicity_learns_words_and_beginnings(spark):
    texts, labels = corpus()
    model = toxicity.train(as_sample(spark, texts[:300], labels[:300]))
    matcher = toxicity.Matcher(model)
    score = lambda t: 1 / (1 + np.exp(-(model.curve[0] + model.curve[1] * matcher.measure(t))))
    held = [score(t) >= 0.7 for t in texts[300:]]
    assert (np.array(held) == (labels[300:] > 0)).mean() >= 0.98
    assert score("bado kofi zorgakd lisel") > score("bado kofi lisel")
    quiet = toxicity.Matcher(toxicity.Model((("" " idiot ", 5.0),), ("idiot proof",)))
    assert quiet.measure("an idiot proof plan") == 0 < quiet.measure("an idiot plan")


def brute_entries(texts, labels):
    """Supports of all terms counted with sets, then the rules in words."""
    toxic, clean, contexts = {}, {}, {}
    for text, y in zip(texts, labels, strict=True):
        words = toxicity.fold(text).split()
        for before, word in zip([""] + words, words, strict=False):
            for term in [word[:k] for k in range(4, 9) if len(word) >= k] + [word + " "]:
                (toxic if y else clean).setdefault(term, set()).add(text)
                if y:
                    contexts.setdefault(term, set()).add(zlib.crc32(before.encode()) % 64)
    n, m = sum(labels > 0), sum(labels == 0)
    odds = {t: np.log((len(d) + 0.5) / (n + 1)) - np.log((len(clean.get(t, ())) + 0.5) / (m + 1)) for t, d in toxic.items()}
    strong = {t for t in toxic if len(contexts[t]) >= 4 and len(toxic[t]) >= 4 and len(t) > 3 and odds[t] >= 3.0}
    wide = {t for t in strong if not any(u != t and u.startswith(t) and len(toxic[u]) >= 0.9 * len(toxic[t]) for u in strong)}
    return {" " + t: odds[t] for t in wide if not any(u != t and t.startswith(u) for u in wide)}


def test_lexicon_equals_brute_force(spark):
    texts, labels = corpus(300, 4)
    got = dict(toxicity.learn_entries(as_sample(spark, texts, labels)))
    assert got == pytest.approx(brute_entries(texts, labels), abs=1e-5) and len(got) >= 1


def brute_matches(model, folded):
    spans = [(i, i + len(p) + 1) for p in model.exceptions for i in range(len(folded)) if folded.startswith(f" {p} ", i)]
    out = {}
    for entry, weight in model.entries:
        for i in range(len(folded)):
            if folded.startswith(entry, i) and (i not in out or out[i][0] < i + len(entry) - 1):
                out[i] = (i + len(entry) - 1, weight)
    return {i: (e, w) for i, (e, w) in out.items() if not any(a <= i and e <= b for a, b in spans)}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["trash", "can", "and", "trashy", "idiot", "proof", "pond", "scum", "line", "an"]), max_size=14))
def test_exceptions_equal_brute_force(words):
    model = toxicity.Model(((" trash ", 2.0), (" tras", 1.0), (" idiot ", 3.0), (" scum ", 4.0), (" can ", 0.5)), ("trash can", "can and trash", "idiot proof", "pond scum", "scum line", "an idiot proof can"))
    folded = toxicity.fold(" ".join(words))
    assert toxicity.Matcher(model).matches(folded) == brute_matches(model, folded)


def test_exceptions_take_linear_time():
    import time

    matcher = toxicity.Matcher(toxicity.Model(((" trash ", 5.0),)))
    seconds = []
    for n in (20_000, 160_000):
        folded = toxicity.fold("trash can and trash " * n)
        begin = time.perf_counter()
        assert len(matcher.matches(folded)) == n
        seconds.append(time.perf_counter() - begin)
    assert seconds[1] < 30 * seconds[0] + 0.5  # eight times the text; squared it would be 64


def test_dictionary_sees_texts_to_their_ends():
    assert quality.pieces_of("") == [] and quality.pieces_of("short") == [b"short"]
    assert quality.pieces_of("b" * 5000 + "end") == [b"b" * 2048, b"b" * 2048, b"b" * 904 + b"end"]
    long = "".join(chr(97 + k // 2048 % 26) for k in range(40 * 2048)) + "end"
    pieces = quality.pieces_of(long)
    assert len(pieces) == 8 and pieces[0] == b"a" * 2048 and pieces[-1] == b"end" and len({p[:1] for p in pieces}) >= 6


def test_sample(spark):
    docs = table(spark, [(k % 50, f"text {k}") for k in range(100)] + [(None, "no id"), (7, "x" * 300_000)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(8, 1), (None, 1), (9, None), (10, 7)], "doc_id long, quality int")
    draw = lambda n: {r.doc_id: (r.text, r.label) for r in fitting.labelled_sample(docs, labels, "quality", F.col("doc_id") != 3, n).collect()}
    all_, few = draw(1000), draw(10)
    assert set(all_) == set(range(50)) - {3} and all_[8][1] == 1 and all_[9][1] == 1 and all_[10][1] == 0
    assert draw(1000) == all_ and draw(10) == few and few.items() <= all_.items() and 5 <= len(few) <= 10
    again = table(spark, [(k % 50, f"text {k}") for k in reversed(range(100))] + [(7, "x" * 300_000)])
    assert {r.doc_id: (r.text, r.label) for r in fitting.labelled_sample(again.repartition(3), labels, "quality", F.col("doc_id") != 3, 1000).collect()} == all_


def brute_quality(spark, docs, labels, rows):
    """The scores again: no Spark but for reading, everything in one list."""
    import zstandard

    known = {r.doc_id: r.quality for r in labels.collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    drawn = [r.doc_id for r in spark.createDataFrame([(i,) for i in known if zlib.crc32(str(i).encode()) % 5], "doc_id long").withColumn("d", F.xxhash64(F.lit("fit"), "doc_id"))
             .withColumn("f", F.expr("pmod(xxhash64(doc_id), 4)")).orderBy("d").limit(rows).collect()]
    fold = {r.doc_id: r.f for r in spark.createDataFrame([(i,) for i in drawn], "doc_id long").withColumn("f", F.expr("pmod(xxhash64(doc_id), 4)")).collect()}
    drawn = sorted(i for i in drawn if i in texts)

    def dictionary(ids):
        return quality._dictionary([p for i in ids for p in quality.pieces_of(texts[i])])

    def sizes(text, pair):
        raw = text.encode()
        parts = [raw[k : k + 1024] for k in range(0, max(1, len(raw)), 1024)]
        return [sum(len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False).compress(p)) for p in parts) for d in pair] + [len(raw)]

    pair = lambda ids: [dictionary([i for i in ids if known[i] == y]) for y in (1, 0)]
    of = {f: pair([i for i in drawn if fold[i] != f]) for f in range(4)}
    x = np.array([sizes(texts[i], of[fold[i]]) for i in drawn], float)
    curve = fitting.logistic(quality.features(x), np.array([known[i] for i in drawn], float), l2=0.01)
    last = pair(drawn)
    return {i: float(fitting.sigmoid(quality.features(np.array([sizes(t, last)], float)) @ curve)[0]) for i, t in texts.items()}


def test_quality_equals_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    want = brute_quality(spark, docs, labels, 100)
    got = {r.doc_id: r.score for r in quality.classify(docs, labels, rows=100).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_toxicity_equals_brute_force(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    known = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id in texts and zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    y = np.array([float(known[i]) for i in known])
    entries = brute_entries([texts[i] for i in known], y)
    model = toxicity.Model(tuple(entries.items()))
    x = lambda t: 1000 * sum(w for _, w in brute_matches(model, toxicity.fold(t)).values()) / (len(toxicity.fold(t).split()) + 50)
    curve = fitting.logistic(np.array([[1.0, x(texts[i]) / 100] for i in known]), y)
    sample = [i for i in texts if i % 7 == 0]
    got = {r.doc_id: r.score for r in toxicity.classify(docs, labels).collect()}
    assert [got[i] for i in sample] == pytest.approx([float(fitting.sigmoid(curve[0] + curve[1] * x(texts[i]) / 100)) for i in sample], abs=1e-4)


def test_quality_on_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    right = np.mean([r.predicted == r.quality for r in got])
    assert right >= 0.93 and all(0 <= r.score <= 1 for r in got)
    tox = toxicity.classify(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in tox]) >= 0.93
    assert all(not (r.predicted and not r.toxic) for r in tox)


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifier_edges(spark, module, label):
    labels = spark.createDataFrame([(1, 1), (4, None), (None, 1), (3, 0), (3, 0)], f"doc_id long, {label} int")
    got = module.classify(table(spark, EDGE), labels).collect()
    assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)
    none = module.classify(table(spark, EDGE), labels.limit(0)).collect()
    assert len(none) == len(EDGE) and len({r.score for r in none}) == 1
    assert module.classify(table(spark, []), labels).count() == 0


# ---- mixing -------------------------------------------------------------------


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    rows = sorted(sizes, key=lambda r: (r[0] is None, r[0] or ""))
    weight = [float(weights[k % 3]) for k in range(len(rows))]
    active, rate = set(range(len(rows))), 0.0
    while active:
        rate = (share * sum(s for _, s in rows) - sum(most * rows[k][1] for k in range(len(rows)) if k not in active)) / sum(weight[k] for k in active)
        over = {k for k in active if weight[k] * rate > most * rows[k][1]}
        if not over:
            break
        active -= over
    return [(n, s, weight[k] * rate if k in active else most * s) for k, (n, s) in enumerate(rows)]


@pytest.mark.parametrize("sizes", [[("b", 100), (None, 100), ("a", 100)], [], [("a", 0)], [("a", 0), ("b", 5)], [(f"h{k:03d}", k * k % 997) for k in range(300)], [("a", 1), ("b", 10), ("c", 100), ("d", 1000), (None, 10000), ("é", 3), ("😀", 7), ("z", 2)]])
def test_targets(spark, sizes):
    sized = spark.createDataFrame([(n, part) for n, s in sizes for part in (s // 2, s - s // 2)], "source string, size long").repartition(3)
    got = mixing.targets(mixing.ranked_sources(sized)).orderBy("rank").collect()
    assert [(r.source, r.source_size, r.target) for r in got] == brute_targets(sizes)
    assert [r["rank"] for r in got] == list(range(len(sizes)))


def test_positions_follow_the_schedules(spark):
    """What is in the query's result changes with the schedules."""
    docs = table(spark, [(k, "w " * 10) for k in range(200)], dict.fromkeys(range(200), "a"))
    first = lambda s: sorted(r.positions[0] for r in mixing.plan(docs, schedules=s).collect() if r.positions)
    even, late = first(((1.0, 1.0, 1.0),)), first(((0.5, 1.0, 1.5),))
    assert np.mean(late) > np.mean(even) + 0.05


def test_plan(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 4)
    monkeypatch.setattr(mixing, "FAN_OUT", 4)  # several levels of buckets
    rng = random.Random(1)
    texts = [(k, "w " * rng.randint(0, 30)) for k in range(300)] + [(None, None), (7, "w w"), (7, "w w")]
    assert mixing.plan(table(spark, EDGE)).count() == len(EDGE)
    sources = {k: rng.choice(["a", "b", "c", None]) for k in range(303)}
    docs = table(spark, texts, sources)
    got = mixing.plan(docs).collect()
    assert len(got) == 303
    for s in ("a", "b", "c", None):
        own = [r for r in got if r.source == s]
        size = sum(r.size for r in own)
        assert all(r.source_size == size for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= 4
        assert all(r.taken <= 2 * r.size and len(r.positions) == r.copies and all(0 <= p <= 1 for p in r.positions) for r in own)
    assert sorted(map(repr, mixing.plan(docs).collect())) == sorted(map(repr, got))
    mixed = mixing.mix(docs.withColumn("mix_key", F.lit(1)))
    assert mixed.count() == sum(r.copies for r in got)
    places = [r.mix_position for r in mixed.collect()]
    assert places == sorted(places)
    assert mixing.plan(table(spark, [])).count() == 0


@pytest.mark.parametrize("factors", [[0.5, 1.0, 1.5], [1.5, 1.0, 0.5], [1.0, 1.0, 1.0], [2.0, 0.0, 1.0, 0.5], [0.0, 3.0]])
def test_position_inverts_demand(spark, factors):
    row = spark.createDataFrame([(float(k), factors) for k in range(0, 101, 5)], "amount double, factors array<double>")
    out = row.withColumn("t", mixing._position(F.col("amount"), F.lit(100.0), F.col("factors"))).collect()
    times = np.linspace(0, 1, 200_001)
    rate = np.interp(times, np.linspace(0, 1, len(factors)), factors)
    demand = np.concatenate([[0], np.cumsum((rate[1:] + rate[:-1]) / 2)])
    for r in out:
        assert 100 * np.interp(r.t, times, demand / demand[-1]) == pytest.approx(r.amount, abs=1e-3)
