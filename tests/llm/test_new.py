"""Divergence of sources, prefix trie and nearest neighbours against plain loops."""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from hypothesis import given, settings, strategies as st

from aircadence.llm import prefix_trie as pt
from aircadence.llm.divergence import meetings, shares, source_divergence
from aircadence.llm.neighbours import Hashing, best, exact_scores, nearest_neighbours
from aircadence.llm.prefix_trie import prefix_trie

DOCS = "doc_id bigint, text string, lang string, source string, n string"


def plain_divergence(rows, min_docs, top):
    words = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source, _ in rows]
    seen, groups = defaultdict(Counter), defaultdict(Counter)
    for lang, source, ws in words:
        seen[lang].update(set(ws))
        groups[lang, source].update(ws)
    out = []
    for lang, source in groups:
        kept = [t for t, n in seen[lang].items() if n >= min_docs]

        def p(counts):
            total = sum(counts[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // total for t in kept}

        own = p(groups[lang, source])
        whole = p(sum((c for (of, _), c in groups.items() if of == lang), Counter()))
        pairs = []
        for of, other in groups:
            if of == lang and other != source:
                theirs = p(groups[lang, other])
                pairs.append((sum(abs(own[t] - theirs[t]) for t in kept), other))
        terms = [(own[t] - whole[t], t) for t in kept if groups[lang, source][t] > 0 and own[t] > whole[t]]
        for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
            order = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
            out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(order)]
    return sorted(out)


def test_divergence_equals_plain_loop(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        source = None if i % 37 == 0 else f"s{rng.integers(0, 11) if i % 3 else 0}"
        lang = [None, "en", "de"][int(rng.integers(0, 3))]
        text = None if i % 41 == 0 else " ".join(f"w{'xyz'[k % 3] * (1 + k % 5)}É, " if k % 2 else "AB-cd" for k in rng.zipf(1.6, rng.integers(0, 40)).tolist())
        rows.append((i, text, lang, source, "x"))
    rows += [(1, "same Same", "en", "s0", "x")] * 40 + [(None, "", "fr", "alone", "x")] + [(2, "long " * 60000, "de", "s3", "x")]
    df = spark.createDataFrame(rows, DOCS).withColumnRenamed("n", "rank").repartition(5)
    for options in ({}, {"slice_terms": 2, "seat_groups": 1, "rounds_per_job": 1}, {"slice_terms": 3, "seat_groups": 3, "rounds_per_job": 2}):
        got = source_divergence(df, min_docs=4, top=3, **options)
        assert [f.simpleString() for f in got.schema] == ["lang:string", "source:string", "part:string", "item:string", "value:bigint", "rank:int"]
        assert sorted(map(tuple, got.collect())) == plain_divergence(rows, 4, 3)


def test_divergence_of_nothing(spark):
    assert source_divergence(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("seats", [1, 2, 3, 6, 7, 12])
def test_every_seat_meets_every_other_once(seats):
    met = meetings(seats)
    assert sorted(tuple(sorted(m[1:])) for m in met) == list(combinations(range(seats), 2))
    for r in {m[0] for m in met}:
        playing = [x for m in met if m[0] == r for x in m[1:]]
        assert len(playing) == len(set(playing))
    assert len({m[0] for m in met}) <= seats


@given(st.lists(st.integers(0, 10**13), min_size=1, max_size=20), st.integers(0, 10**6))
def test_shares_are_exact(counts, extra):
    total, kept = sum(counts) + extra, len(counts)
    assert shares(np.array(counts), total, kept).tolist() == [1 + 10**9 * (c + 5) // (total + 5 * kept) for c in counts]


TURNS = "conv_id bigint, turn bigint, role string, text string, depth string"


def plain_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text, _ in rows:
        if c is not None:
            role, text = role or "", text or ""
            k = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            convs[c].append(((turn is not None, turn or 0, k), (role, text)))
    convs = {c: [x for _, x in sorted(turns)] for c, turns in convs.items()}
    paths = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(convs.get(c - c % 20, [])[:h] + own[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in paths.items():
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        cost = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += cost
    digest = {p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest() for p in members}
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p], digest[p]) for p, m in members.items())


def conversation_rows():
    rng = np.random.default_rng(3)
    rows = []
    for c in range(150):
        if c == 40:  # a family without its first conversation
            continue
        for t in range(int(rng.integers(0, 7)) if c % 20 else 5):
            rows.append((c, t if t % 5 else None, ["user", "bot", None][int(rng.integers(0, 3))] if c % 3 else "user", f"t{int(rng.integers(0, 2))} x\ty" if c % 7 else None, "d"))
    rows += [(c, t, "user", "the same again", "d") for c in range(200, 420) for t in range(3)]
    rows += [(500, t, "user", f"turn {t % 3}", "d") for t in range(700)] + [(501, t, "user", f"turn {t % 3}", "d") for t in range(650)]
    rows += [(None, 1, "user", "nobody's", "d"), (600, 1, "u", "twice", "d"), (600, 1, "u", "twice", "d"), (601, None, None, None, "d"), (700, 0, "user", "long " * 50000, "d")]
    return rows


@pytest.mark.parametrize("range_bytes", [1 << 24, 3000, 400])
def test_trie_equals_plain_loop(spark, range_bytes):
    rows = conversation_rows()
    got = prefix_trie(spark.createDataFrame(rows, TURNS).repartition(5), range_bytes=range_bytes)
    assert sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in got.collect()) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie(spark.createDataFrame([], TURNS)).collect() == []


def turns_path(numbers):
    return b"".join(n.to_bytes(pt.TURN, "big") for n in numbers)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.lists(st.integers(0, 2), max_size=6), max_size=8), max_size=6))
def test_merge_of_runs_by_lcp(runs):
    seen, parts = set(), []
    for run in runs:
        own = sorted({turns_path(x) for x in run} - seen)
        seen |= set(own)
        parts.append([(p, pt.shared_turns(own[k - 1], p) if k else 0, None) for k, p in enumerate(own)])
    merged = list(pt.LoserTree(parts))
    assert [p for p, _, _ in merged] == sorted(seen)
    assert all(lcp == (pt.shared_turns(merged[k - 1][0], p) if k else 0) for k, (p, lcp, _) in enumerate(merged))


def test_shared_turns_are_compared_once():
    """Runs that share a long start: the tree settles most games by LCP alone."""
    deep = [turns_path([7] * 500 + [k // 50, k % 50]) for k in range(1000)]
    runs = [[(p, pt.shared_turns(deep[j - 8], p) if j >= 8 else 0, None) for j, p in list(enumerate(deep))[k::8]] for k in range(8)]
    tree = pt.LoserTree(runs)
    assert [p for p, _, _ in tree] == deep
    assert tree.compared < 3 * len(deep) + 8


@given(st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=30), st.integers(0, 20))
def test_shared_turns(a, b, both):
    a, b = [1] * both + a, [1] * both + b
    want = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert pt.shared_turns(turns_path(a), turns_path(b)) == want


VECTORS = "vec_id bigint, embedding array<float>, rank string"


def plain_neighbours(rows, k, every):
    sound = {}
    for i, v, _ in rows:
        if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            sound[i] = min(v, sound.get(i, v))
    ids = np.array(sorted(sound))
    x = np.array([sound[i] for i in ids], np.float32).astype(float).reshape(len(ids), -1)
    out = {}
    for i, q in zip(ids.tolist(), x):
        if i % every == 0:
            score = exact_scores(np.tile(q, (len(ids), 1)), x)
            out[i] = heapq.nsmallest(k, ((-s, j) for s, j in zip(score.tolist(), ids.tolist()) if j != i))
    return out


def neighbour_rows():
    rng = np.random.default_rng(9)
    rows = [(i, (rng.standard_normal(8) * rng.uniform(0.2, 3)).tolist(), "r") for i in range(1500)]
    rows += [(2000 + i, [1.0, 2.0] * 4, "copy") for i in range(900)]  # a third are copies
    rows += [(3000 + i, rng.integers(0, 2, 8).astype(float).tolist(), "ties") for i in range(200)]
    rows += [(4000, None, "r"), (4020, [0.0] * 8, "r"), (4040, [None] + [1.0] * 7, "r"), (4060, [float("nan")] * 8, "r"), (4080, [float("inf")] + [0.0] * 7, "r"), (4100, [1.0] * 3, "r"), (None, [1.0] * 8, "r"), (4120, [], "r")]
    rows += [(4140, [0.5] * 8, "r"), (4140, [0.5] * 8, "again"), (4140, [0.75] * 8, "other")]
    return rows


def test_neighbours_near_plain_loop(spark):
    rows = neighbour_rows()
    want = plain_neighbours(rows, 20, 20)
    got = defaultdict(list)
    for r in nearest_neighbours(spark.createDataFrame(rows, VECTORS).repartition(4)).collect():
        got[r.query_id].append((r["rank"], -r.score, r.vec_id))
    assert sorted(got) == sorted(want)
    hits = 0
    for q, own in got.items():
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, 21))
        assert own == sorted(own, key=lambda x: x[1:])
        hits += len({i for _, _, i in own} & {i for _, i in want[q]})
    assert hits >= 0.95 * 20 * len(want)
    # Copies and their ties are found exactly.
    assert [(s, i) for _, s, i in got[2020]] == want[2020]


@pytest.mark.parametrize("n", [1, 2, 15])
def test_few_candidates_are_all_given(spark, n):
    rows = [(i * 20, [float(i + 1), -3.0 * (i % 2), 1.0, 0.0, 0.0, 0.0, 0.0, 1e-3], "r") for i in range(n)]
    got = defaultdict(list)
    for r in nearest_neighbours(spark.createDataFrame(rows, VECTORS)).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-r.score, r.vec_id))
    assert got == {q: own for q, own in plain_neighbours(rows, 20, 20).items() if own}


def test_neighbours_of_nothing(spark):
    assert nearest_neighbours(spark.createDataFrame([], VECTORS)).collect() == []
    assert nearest_neighbours(spark.createDataFrame([(3, [1.0], "r")], VECTORS)).collect() == []


def test_probes_are_the_likeliest_buckets():
    hashing = Hashing.of(6, 1, 3, 1.0)
    at = hashing.projected(np.random.default_rng(1).standard_normal((5, 6)))[:, 0]
    many, few = hashing.probes(at, 0.7, 200), hashing.probes(at, 0.7, 9)
    assert (many[:, :9] == few).all() and (many[:, 0] == np.floor(at)).mean() > 0.6

    def chance(q, slots):
        from math import erf, sqrt

        return np.prod([0.5 * (erf((s + 1 - x) / 0.7 / sqrt(2)) - erf((s - x) / 0.7 / sqrt(2))) for x, s in zip(q, slots)])

    for q, slots in zip(at, many):
        values = [chance(q, s) for s in slots]
        assert all(a >= b * (1 - 1e-9) for a, b in zip(values, values[1:]))
        assert len({tuple(s) for s in slots.tolist()}) == 200


@given(st.integers(0, 10**6), st.integers(1, 30), st.integers(1, 8))
@settings(max_examples=40, deadline=None)
def test_best_of_a_block(seed, n, k):
    rng = np.random.default_rng(seed)
    q, x = rng.integers(-2, 3, (4, 5)).astype(float), rng.integers(-2, 3, (n, 5)).astype(float)
    ids = rng.permutation(100)[:n]
    row, found, score = best(q, x, ids, k)
    for i in range(4):
        want = heapq.nsmallest(k, ((-float(q[i] @ v), int(j)) for v, j in zip(x, ids)))
        assert [(-s, j) for s, j in zip(score[row == i].tolist(), found[row == i].tolist())] == want


class _Task:
    @staticmethod
    def get():
        return _Task

    @staticmethod
    def partitionId():
        return 3


class _Shared:
    def __init__(self, value):
        self.value = value


def sent_and_returned(monkeypatch, text_words, buckets):
    from aircadence.llm import lm_score as lm

    monkeypatch.setattr(lm, "TaskContext", _Task)
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 3000, text_words)) for _ in range(24_000 // text_words)]
    batch = pa.RecordBatch.from_pydict({"text": texts, "good": [k % 3 == 0 for k in range(len(texts))], "id": list(range(len(texts)))}, pa.schema([("text", pa.string()), ("good", pa.bool_()), ("id", pa.int64())]))
    terms = lm.Terms(0.3, 3001, 0.01)
    none = (np.zeros(1, np.uint64), np.zeros(1), np.zeros(1))
    sent = pa.Table.from_batches(list(lm._send(_Shared(none), terms, buckets)(iter([batch]))))
    back = pa.concat_tables([lm._answer(terms)(sent.filter(pa.compute.equal(sent.column("bucket"), b))) for b in set(sent.column("bucket").to_pylist())])
    scores = lm._named(back)
    return sent.nbytes, back.nbytes, scores.column("score").to_pylist(), back


@pytest.mark.parametrize("text_words", [3, 30])
def test_replies_grow_with_the_text_and_not_with_the_buckets(monkeypatch, text_words):
    few, many = (sent_and_returned(monkeypatch, text_words, b) for b in (16, 4000))
    assert few[2] == pytest.approx(many[2], rel=1e-12)
    # A key and its document are 12 bytes; a document has a reply for each of its keys at most.
    keys = 2 * (24_000 // text_words) * (text_words + 1)
    for sent, back, _, _ in (few, many):
        assert sent < 24 * keys and back < 24 * keys


def test_a_missing_reply_is_noticed(monkeypatch):
    from aircadence.llm import lm_score as lm

    back = sent_and_returned(monkeypatch, 30, 16)[3]
    with pytest.raises(RuntimeError, match="another order"):
        lm._named(back.slice(0, len(back) - 1))


def test_scores_of_shuffled_input(spark):
    from aircadence.llm.lm_score import cross_entropy_difference

    rng = np.random.default_rng(1)
    rows = [(k, " ".join(f"v{x}" for x in rng.zipf(1.5, 30).tolist())) for k in range(300)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(0, 300, 4)], "doc_id bigint, quality int")
    want = {r.doc_id: r.score for r in cross_entropy_difference(table.coalesce(1), labels).collect()}
    for buckets in (None, 7, 500):
        got = {r.doc_id: r.score for r in cross_entropy_difference(table.repartition(6, "text"), labels, buckets=buckets).collect()}
        assert got == pytest.approx(want, abs=2e-6)


def test_many_parts_of_items_in_one_worker(spark, monkeypatch):
    """Fifty parts, held eight at a time, give what one gives; repeated items are one sequence."""
    from aircadence.llm import decontam

    rng = np.random.default_rng(2)
    items = [(f"i{k}", " ".join(f"u{x}" for x in rng.integers(0, 400, 14))) for k in range(120)]
    items += [(f"again{k}", items[5][1]) for k in range(300)] + [(None, items[6][1]), (None, None), ("none", "")]
    texts = [(k, " ".join([*(f"u{x}" for x in rng.integers(0, 400, 20)), items[int(rng.integers(0, 120))][1] if k % 2 else "", items[5][1] if k % 7 == 0 else ""])) for k in range(80)]
    docs, bench = spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id string, text string")
    want = sorted(map(tuple, decontam.contamination(docs, bench).collect()))
    cut = sorted(map(tuple, decontam.decontaminate(docs, bench, max_share=0.6).collect()))
    monkeypatch.setattr(decontam, "MAX_ITEM_CHARS", 250)
    chars = sum(len(t) for t in {t for _, t in items if t}) + 16 * len(items)
    assert chars // 250 >= 50
    hits = decontam.find_hits(docs, bench)
    plan = hits._sc._jvm.PythonSQLUtils.explainString(hits._jdf.queryExecution(), "simple")
    assert plan.count("MapInArrow") == 1
    assert sorted(map(tuple, decontam.contamination(docs, bench).collect())) == want
    assert sorted(map(tuple, decontam.decontaminate(docs, bench, max_share=0.6).collect())) == cut


@pytest.mark.parametrize("comment", ["<!-->", "<!--->", "<!-- x -->", "<!-- x --!>", "<!---->", "<!-- > -->"])
def test_comments_end_where_html_ends_them(comment):
    from aircadence.llm.dom import blocks

    assert [b.text for b in blocks(f"<body><p>one</p>{comment}<p>two</p></body>")] == ["one", "two"]
    assert [b.text for b in blocks("<p>one</p><!-- never closed <p>two</p>")] == ["one"]


def test_licences_that_share_words_are_told_apart(spark):
    from aircadence.llm import licenses as L
    from aircadence.llm.license_scan import license_scan

    def header(*paragraphs, blank=" *"):
        lines = []
        for p in paragraphs:
            words = p.split()
            lines += [" * " + " ".join(words[k: k + 9]) for k in range(0, len(words), 9)] + ([blank] if blank else [])
        return "/*\n" + "\n".join(lines) + "\n */\nint main(void) { return 0; }\n"

    one = f"1. {L._TWO}"
    library = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    cases = {
        "bsd3.c": (header("Copyright (c) 2001 A. Person", L._REDISTRIBUTION, one, f"3. {L._NEITHER}", L._DISCLAIMER), "BSD-3-Clause"),
        "bsd3-dense.c": (header(L._REDISTRIBUTION, one, f"3. {L._NEITHER}", L._DISCLAIMER, blank=""), "BSD-3-Clause"),
        "bsd2.c": (header("Copyright (c) 2001 A. Person", L._REDISTRIBUTION, one, L._DISCLAIMER), "BSD-2-Clause"),
        "lgpl21.c": (header(library.format("Lesser General Public License", "2.1")), "LGPL-2.1"),
        "lgpl20.c": (header(library.format("Library General Public License", "2")), "LGPL-2.0"),
        "gpl1.c": (header(library.replace("library", "program").format("General Public License", "1")), "GPL-1.0"),
        "gpl2.c": (header(library.replace("library", "program").format("General Public License", "2")), "GPL-2.0"),
        "nd.md": ("This work is under the\nCreative Commons Attribution-NoDerivatives 4.0 International\n", "CC-BY-ND-4.0"),
        "ncsa.md": ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International", "CC-BY-NC-SA-4.0"),
        "by.md": ("Creative Commons Attribution 4.0 International", "CC-BY-4.0"),
        "spdx.py": ("# SPDX-License-Identifier: MIT\nimport os\n", "MIT"),
        "spdx2.py": ("// SPDX-License-Identifier: GPL-2.0-or-later\n", "GPL-2.0"),
        "spdx3.py": ("# SPDX-License-Identifier: Zlib\n", None),
        "mit.c": (header(L._PERMISSION, L._COPIES, L._AS_IS), "MIT"),
        "none.c": ("int main(void) { return 0; }\n", None),
    }
    rng = np.random.default_rng(0)
    words = sorted({w for _, t in L.HEADERS for w in re.findall("[a-z0-9]+", t.lower())})
    filler = [(f"src/f{k}.txt", " ".join(f"filler{x}" for x in rng.integers(0, 900, 60)) + " " + " ".join(rng.choice(words, 3))) for k in range(200)]
    rows = [(k, path, text) for k, (path, text) in enumerate([*((f"src/{n}", t) for n, (t, _) in cases.items()), *filler])]
    got = {r.path[4:]: r.license for r in license_scan(spark.createDataFrame(rows, "id bigint, path string, text string"), "id", "path", "text").collect()}
    assert {n: got[n] for n in cases} == {n: want for n, (_, want) in cases.items()}
    assert not any(got[p[4:]] for p, _ in filler)
