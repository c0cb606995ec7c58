"""Text operators against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from aircadence.llm import textkernel as tk
from aircadence.llm.decontam import contamination, decontaminate
from aircadence.llm.near_dedup import keep_representatives, near_duplicates
from aircadence.llm.quality import Forest, calibrate, keep_good, quality_verdicts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, *texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], DOCS)


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \n\t\x00\x1fabAB09é—ß日.", max_size=30)), max_size=12), st.sampled_from([8, 1 << 20]))
def test_words_equal_regex(texts, limit):
    """Words and hashes of any chunking are those of the regular expressions."""
    seen: dict = {}
    for table, pattern in ((tk.NON_SPACE, r"[^\x20\x09-\x0D]+"), (tk.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        for first, stop, data, bounds in tk.chunks(pa.array(texts, pa.string()), limit):
            w = tk.scan(data, bounds, table, lower=True)
            raw = tk.LOWER[data].tobytes()
            got = [raw[a:b].decode() for a, b in zip(w.starts, w.ends)]
            for word, h in zip(got, tk.hashes(data, w).tolist()):
                assert seen.setdefault(word, h) == h
            for i in range(first, stop):
                assert got[w.first[i - first]: w.first[i - first + 1]] == re.findall(pattern, low(texts[i]))
    assert len(set(seen.values())) == len(seen)


def _shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    return {tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _components(texts):
    sets = [_shingles(t) for t in texts]
    comp = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= 85 * len(sets[a] | sets[b]):
                one, two = sorted((comp[a], comp[b]))
                comp = [one if c == two else c for c in comp]
    return comp, sets


def _near_texts(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = [None, "", " \n", "one two", "ONE two", "one two three"]
    for n in (7, 30, 120, 400):
        base = [word() for _ in range(n)]
        for edits in (0, 0, 1, 1, 2, 3, 5, 8, 12, 20):
            copy = list(base)
            for _ in range(edits if n > 30 else min(edits, 2)):
                copy[rng.randrange(n)] = word()
            texts.append(" ".join(copy))
        chain = list(base)
        for _ in range(6):  # each near the one before, the ends far apart
            chain[rng.randrange(n)] = word()
            texts.append(" ".join(chain))
    return texts


@pytest.mark.parametrize("block", [4096, 4])
def test_near_duplicates_equal_all_pairs(spark, block):
    texts = _near_texts()
    want, sets = _components(texts)
    got = {r.doc_id: r for r in near_duplicates(docs(spark, *texts), max_block=block).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_duplicates_odd_rows(spark):
    same = "a b c d e f g"
    t = docs(spark, same, same, None, same, ids=[3, 3, None, 9]).withColumnRenamed("lang", "component_id")
    got = sorted(((r.doc_id or -1), r.component_id, r.kept) for r in near_duplicates(t).collect())
    assert got == [(-1, None, True), (3, 3, True), (3, 3, True), (9, 3, False)]
    stay = keep_representatives(t)
    assert stay.columns == t.columns and sorted(r.doc_id or -1 for r in stay.collect()) == [-1, 3]
    assert near_duplicates(t.limit(0)).count() == 0 and keep_representatives(t.limit(0)).count() == 0


def _hits(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    hit, found = set(), set()
    for item, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            window = w[k: k + 10]
            for p in range(len(words) - len(window) + 1):
                if words[p: p + len(window)] == window:
                    hit |= set(range(p, p + len(window)))
                    found |= {str(item)} if item is not None else set()
    ids = ",".join(sorted(found))
    return len(words), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


def _bench_case(seed=2):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcd")  # noqa: E731  few words, so that matches overlap in many ways
    items = [(k, " ".join(word() for _ in range(rng.randint(0, 16)))) for k in range(12)] + [(12, None), (None, "q r s"), (12, "X-y, z!")]
    texts = [" ".join(word() for _ in range(rng.randint(0, 200))) for _ in range(30)] + [None, "", "x Y z q r s", "é a b"]
    return texts, items


def test_contamination_equals_brute_force(spark):
    texts, items = _bench_case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in contamination(docs(spark, *texts), bench).collect()}
    assert [got[i] for i in range(len(texts))] == [_hits(t, items) for t in texts]


def test_contamination_in_parts(spark, monkeypatch):
    from aircadence.llm import decontam

    texts, items = _bench_case(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontam, "MAX_ITEM_CHARS", 60)
    got = {r[0]: tuple(r)[1:] for r in contamination(docs(spark, *texts), bench).collect()}
    assert [got[i] for i in range(len(texts))] == [_hits(t, items) for t in texts]


def test_decontaminate(spark):
    passage = " ".join(f"q{i}" for i in range(12))
    clean = " ".join(f"w{i}" for i in range(300))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    t = docs(spark, clean, f"{clean} {passage.upper()}. {clean}", passage, None, "")
    got = {r.doc_id: r.text for r in decontaminate(t, bench).collect()}
    assert got == {0: clean, 1: f"{clean} \n. {clean}", 3: None, 4: ""}
    assert decontaminate(t, bench).columns == t.columns
    assert decontaminate(t.limit(0), bench).count() == 0
    assert decontaminate(t, bench.limit(0)).count() == 5


def _base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    three = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) if three[tuple(words[k: k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_base_statistics_equal_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", " \n ", "a b c a b c", "x\n\nx\n y\nx", "é# *|\té#", "z " * 40000]
    texts += [" ".join(rng.choice(["ab", "cd\n", "é", "#x", "<y>"]) for _ in range(rng.randint(0, 120))) for _ in range(30)]
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_verdicts(docs(spark, *texts), labels).collect()}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert [tuple(got[i][c] for c in names) for i in range(len(texts))] == [_base(t) for t in texts]
    assert all(r.kept == (not r.base_failed) for r in got.values())


def test_forest_tells_junk_from_prose(spark):
    """Held-out documents: junk of three kinds goes, prose stays."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9)))
    prose = lambda: " ".join(word() + ("." if rng.random() < 0.1 else "") for _ in range(rng.randint(80, 400)))
    junk = (lambda: " | ".join(word() for _ in range(120)), lambda: " ".join(word() + "###" for _ in range(120)), lambda: " ".join(word().upper() + "!!" for _ in range(120)))
    texts = [prose() if i % 6 else rng.choice(junk)() for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 6 > 0)) for i in range(400)] + [(None, 1), (5, None), (99999, 0)], "doc_id long, quality int")
    held = [r for r in quality_verdicts(docs(spark, *texts), labels).collect() if r.doc_id >= 400]
    good, bad = [r.kept for r in held if r.doc_id % 6], [r.kept for r in held if not r.doc_id % 6]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.05 * len(bad)
    kept = keep_good(docs(spark, *texts), labels)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert 450 < kept.count() < 520
    assert keep_good(docs(spark, *texts).limit(0), labels).count() == 0


def test_calibration_and_paths():
    assert calibrate([(10, 90, 0), (20, 9, 1), (30, 1, 9)], 5.0) == 20 + 9
    assert calibrate([(10, 5, 0), (40, 1, 0)], 5.0) == 40
    assert calibrate([], 5.0) == 0
    rows = np.random.default_rng(0).normal(size=(500, 3))
    forest = Forest.grow(rows, np.full(3, -10.0), np.full(3, 10.0), 50, 256, 1)
    far, near = forest.score(np.array([[9.0, 9.0, 9.0], [0.0, 0.0, 0.0]]))
    assert far > near + 0.2


def test_long_words_do_not_collide():
    """Words that collide under every polynomial hash modulo 2**64 differ here."""
    one = "a"
    while len(one) < 2048:
        one += one.translate(str.maketrans("ab", "ba"))
    two = one.translate(str.maketrans("ab", "ba"))
    for n in (64, 65, 1024, 2048):
        data = pa.array([f"{one[:n]} {two[:n]} {one[:n]}"])
        (_, _, raw, bounds), = tk.chunks(data)
        a, b, c = tk.hashes(raw, tk.scan(raw, bounds, tk.NON_SPACE)).tolist()
        assert a == c != b


def _family(n, seed=1):
    """Texts of one template that are not similar enough, and two late pairs that are."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    template = [word() for _ in range(200)]
    texts = [" ".join(template + [word() for _ in range(60)]) for _ in range(n)]
    texts.append(texts[n // 2] + " more words here")
    texts.append(texts[n - 1] + " other words there")
    return texts


def test_large_buckets_stay_linear(spark, monkeypatch):
    """A family of boilerplate gives a bounded number of rows for each text, and loses no link."""
    from aircadence.workspace import Workspace

    made, stage = Counter(), Workspace.stage

    def counting(self, df, name):
        out = stage(self, df, name)
        made[name] += out.count()
        return out

    monkeypatch.setattr(Workspace, "stage", counting)
    texts = _family(240)
    want, _ = _components(texts)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs(spark, *texts), max_block=8).collect()}
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) == 240
    assert made["large"] > 200 and made["rare"] < 60 * len(texts) and made["rare-blocks"] + made["rarer-blocks"] < 2 * len(texts)


@pytest.mark.parametrize("block", [2, 6])
def test_every_cut_of_large_buckets_is_whole(spark, monkeypatch, block):
    """All texts of few sentences: blocks of one and of two rare shingles stay too large."""
    rng = random.Random(9)
    sentences = [" ".join(rng.choice("abcdefgh") + str(k) for k in range(i, i + 12)) for i in range(0, 240, 12)]
    texts = []
    for _ in range(90):
        some = rng.sample(range(20), 17)
        texts.append(" ".join(sentences[k] for k in sorted(some)))
    want, _ = _components(texts)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs(spark, *texts), percent=85, max_block=block).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_repeated_ids_with_other_texts(spark):
    """A row is no copy of another because it has the same id."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    t = docs(spark, a, b, a + " x", b, b, None, None, "", c, ids=[1, 1, 5, 7, 1, 1, 1, 2, None]).withColumnRenamed("lang", "text_hash").withColumnRenamed("source", "node_comp")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(t).collect())
    assert got == [(-1, 56, None, True), (1, 0, 1, True), (1, 0, 1, True), (1, 56, 1, True), (1, 56, 1, True), (1, 56, 1, True), (2, 0, 2, True), (5, 57, 1, False), (7, 56, 1, False)]
    stay = keep_representatives(t)
    assert stay.columns == t.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in stay.collect()) == sorted([(1, a), (1, b), (1, ""), (1, ""), (2, ""), (-1, c)])


def test_quality_is_of_the_row(spark):
    """Repeated and null ids: each row is judged by its own text."""
    rng = random.Random(4)
    prose = lambda: " ".join("".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(150))
    texts = [prose() for _ in range(120)] + ["two words", prose(), "x " * 200]
    t = docs(spark, *texts, ids=[*range(120), 3, None, None]).withColumnRenamed("lang", "score").withColumnRenamed("source", "kept")
    labels = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int")
    kept = keep_good(t, labels)
    assert kept.columns == t.columns and kept.schema == t.schema
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert (3, "two words") not in got and (None, texts[121]) in got and (None, texts[122]) not in got and sum(got.values()) >= 117


def test_decontaminate_clashing_names(spark):
    passage = " ".join(f"q{i}" for i in range(12))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    t = docs(spark, "clean words here", passage, "clean words here", passage + " " + "w " * 300, ids=[1, 1, None, None]).withColumnRenamed("lang", "__hits").withColumnRenamed("source", "__HITS_")
    out = decontaminate(t, bench)
    assert out.columns == t.columns and [(r.doc_id, r["__hits"]) for r in out.collect()] == [(1, "en"), (None, "en"), (None, "en")]
    assert contamination(t, bench).count() == 4
