"""Main text of HTML pages by a linear-chain conditional random field.

A page is a sequence of leaf blocks.  Each block has features of its ancestors
(tags, words of classes and ids) and of its text; labels are "main" and
"other".  The field is trained on labelled pages by stochastic gradient ascent
of the conditional likelihood and decoded by Viterbi.

No table has labelled pages, so the default ones come from a generator that
lays out articles with menus, headers, sidebars, adverts, notices, forms,
comments and footers in many ways of marking them up.  Their number is a
parameter; the model is the same for every input.  Two in five of them name
nothing, so that the model also learns from text and neighbours alone.

Defined cases: a null or empty page has an empty text; a page that is cut off
anywhere is read up to there; rows that repeat a page each get its text.
"""

from __future__ import annotations

import functools
import math
import random
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from aircadence.llm.dom import NOTED, Block, blocks

#: Words in classes and ids that tell of main text and of everything else.
MAIN_WORDS = frozenset("article body content entry main page post prose story text".split())
OTHER_WORDS = frozenset(
    "ad ads advert advertisement aside banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright discussion "
    "disqus footer form gdpr header legal login masthead menu modal nav navbar navigation newsletter notice pagination pager popup promo "
    "promoted recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe tags "
    "toolbar topbar widget".split()
)
_WANTED = MAIN_WORDS | OTHER_WORDS
_SEMANTIC = NOTED - {"li"}
_BESIDE = _SEMANTIC - {"article", "main", "figure"}


def _size(n: int) -> str:
    return str(min(n.bit_length(), 8))


def features(sequence: Sequence[Block]) -> list[list[str]]:
    """Names of the features that are on, for each block."""
    out = []
    head = "no-head"
    for k, b in enumerate(sequence):
        before = sequence[k - 1].own if k else "none"
        head = "head" if b.own in ("h1", "h2") else head
        words = b.text.split()
        f = ["bias", f"own={b.own}", f"words={_size(len(words))}", f"own={b.own}-{head}", f"before={before}-{b.own}"]
        f += [f"in={t}" for t in sorted(b.within & _SEMANTIC)] or ["in=none"]
        f += [f"name={w}" for w in sorted(b.names)]
        if b.names & OTHER_WORDS:
            f.append("other-name")
        if b.names & MAIN_WORDS:
            f.append("main-name")
        f.append(f"links={min(4, 4 * b.linked // max(1, len(b.text)))}")
        if "li" in b.within:
            f.append("list")
        if b.text[-1] in ".!?\"'":
            f.append("ends")
        if b.text[0] == "©" or b.text.lower().startswith("copyright "):
            f.append("mark")
        if b.linked >= len(b.text) > 0:
            f.append("all-link")
        inside = "article" if "article" in b.within or "main" in b.within else "no-article"
        beside = "beside" if b.names & OTHER_WORDS or b.within & _BESIDE else "plain"
        f += [inside, f"{inside}-{beside}", f"{inside}-{beside}-{b.own}"]
        out.append(f)
    return out


class Field:
    """A linear-chain field with two labels (1: main).

    ``weights`` holds for each feature how much more it speaks for main;
    ``steps[i][j]`` is the weight of label j after label i.
    """

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.steps = [[0.0, 0.0], [0.0, 0.0]]

    def _scores(self, rows: list[list[str]]) -> list[float]:
        get = self.weights.get
        return [sum(get(x, 0.0) for x in f) for f in rows]

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The most likely labels (Viterbi)."""
        if not rows:
            return []
        s = self.steps
        scores = self._scores(rows)
        zero, one, back = 0.0, scores[0], []
        for x in scores[1:]:
            a, b, c, d = zero + s[0][0], one + s[1][0], zero + s[0][1], one + s[1][1]
            back.append((int(b > a), int(d > c)))
            zero, one = max(a, b), max(c, d) + x
        labels = [int(one > zero)]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]

    def _expect(self, scores: list[float]) -> tuple[list[float], list[list[float]]]:
        """Probability of main for each block, and expected steps."""
        s = [[math.exp(x) for x in row] for row in self.steps]
        e = [math.exp(max(-30.0, min(30.0, x))) for x in scores]
        n = len(e)
        fore, back = [], [(1.0, 1.0)] * n
        a, b = 1.0, e[0]
        for k in range(n):
            if k:
                a, b = fore[-1][0] * s[0][0] + fore[-1][1] * s[1][0], (fore[-1][0] * s[0][1] + fore[-1][1] * s[1][1]) * e[k]
            total = a + b
            fore.append((a / total, b / total))
        for k in range(n - 2, -1, -1):
            p, q = back[k + 1][0], back[k + 1][1] * e[k + 1]
            c, d = s[0][0] * p + s[0][1] * q, s[1][0] * p + s[1][1] * q
            back[k] = (c / (c + d), d / (c + d))
        main = []
        steps = [[0.0, 0.0], [0.0, 0.0]]
        for k in range(n):
            p, q = fore[k][0] * back[k][0], fore[k][1] * back[k][1]
            main.append(q / (p + q))
            if k:
                cell = [[fore[k - 1][i] * s[i][j] * (e[k] if j else 1.0) * back[k][j] for j in (0, 1)] for i in (0, 1)]
                total = sum(map(sum, cell))
                for i in (0, 1):
                    for j in (0, 1):
                        steps[i][j] += cell[i][j] / total
        return main, steps

    def fit(self, pages: Sequence[tuple[list[list[str]], list[int]]], epochs: int = 8, rate: float = 0.2, shrink: float = 1e-4, seed: int = 3) -> Field:
        """Gradient ascent page by page, with a rate that falls for each weight."""
        rng = random.Random(seed)
        squares: dict[str, float] = {}
        order = [p for p in pages if p[0]]
        for _ in range(epochs):
            rng.shuffle(order)
            for rows, labels in order:
                main, expected = self._expect(self._scores(rows))
                slope: dict[str, float] = {}
                for f, p, y in zip(rows, main, labels, strict=True):
                    for x in f:
                        slope[x] = slope.get(x, 0.0) + y - p
                for x, g in slope.items():
                    g -= shrink * self.weights.get(x, 0.0)
                    squares[x] = squares.get(x, 1e-6) + g * g
                    self.weights[x] = self.weights.get(x, 0.0) + rate * g / math.sqrt(squares[x])
                for i in (0, 1):
                    for j in (0, 1):
                        seen = sum(1 for a, b in zip(labels, labels[1:], strict=False) if (a, b) == (i, j))
                        key = f"step{i}{j}"
                        g = seen - expected[i][j] - shrink * self.steps[i][j]
                        squares[key] = squares.get(key, 1e-6) + g * g
                        self.steps[i][j] += rate * g / math.sqrt(squares[key])
        return self


class _PageMaker:
    """Draws labelled pages; main text is marked by the maker, not by markup."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.named = 1.0  #: share of elements of the page whose names tell what they are

    def words(self, low: int, high: int) -> str:
        r = self.rng
        out = ["".join(r.choice("aeioubcdfglmnprst") for _ in range(r.randint(1, 9))) for _ in range(r.randint(low, high))]
        return " ".join(out).capitalize() + r.choice(("", ".", ".", "!", "..."))

    def element(self, tags: Sequence[str], names: Sequence[str], inner: str) -> str:
        r = self.rng
        tag = r.choice(tags)
        # Some pages name nothing, or name it by a number: then only text and neighbours tell.
        name = r.choice(names) if r.random() < self.named else "".join(r.choice("qxzkjv") for _ in range(4)) + str(r.randrange(99))
        attr = "" if r.random() < (0.6 if tag in _SEMANTIC else 0.1) else f' {r.choice(("class", "id"))}="{name}"'
        return f"<{tag}{attr}>{inner}</{tag}>"

    def links(self) -> str:
        r = self.rng
        items = [f'<a href="/{k}">{self.words(1, 3)}</a>' for k in range(r.randint(2, 9))]
        return f"<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>" if r.random() < 0.7 else " | ".join(items)

    def other(self, kind: str) -> str:
        r, e, w = self.rng, self.element, self.words
        if kind == "menu":
            return e(("nav", "div", "nav"), ("nav", "menu", "top-menu", "navbar", "navigation", "breadcrumb"), self.links())
        if kind == "header":
            return e(("header", "div"), ("header", "site-header", "masthead", "topbar"), r.choice((f"<h1>{w(1, 4)}</h1>", f"<p>{w(2, 9)}</p>", self.links())))
        if kind == "ad":
            return e(("div", "aside", "section"), ("ad", "ads", "advert", "banner", "sponsored", "promo", "ad-slot"), r.choice((w(2, 15), f"<p>{w(2, 30)}</p>")))
        if kind == "sidebar":
            return e(("aside", "div"), ("sidebar", "side-bar widget", "related", "recommended"), f"<h3>{w(1, 4)}</h3>" + r.choice((self.links(), f"<p>{w(4, 30)}</p>")))
        if kind == "notice":
            return e(("div", "section"), ("cookie-notice", "notice", "cookies", "consent", "gdpr popup"), f"<p>{w(5, 30)}</p><button>{w(1, 2)}</button>")
        if kind == "form":
            return e(("form", "div"), ("search", "newsletter", "signup form", "login", "subscribe"), f"<form><label>{w(1, 5)}</label><input name=x><button>{w(1, 2)}</button></form>")
        if kind == "comments":
            one = lambda: e(("div", "li", "article"), ("comment", "comment reply"), f"<p>{w(2, 60)}</p>")
            return e(("section", "div"), ("comments", "discussion", "replies", "comment-list"), f"<h3>{w(1, 3)}</h3>" + "".join(one() for _ in range(r.randint(1, 5))))
        return e(("footer", "div", "footer"), ("footer", "site-footer", "copyright", "legal"), r.choice((f"&copy; {w(2, 15)}", f"Copyright {w(1, 6)} All rights reserved.", self.links(), f"<p>{w(3, 25)}</p>")))

    def article(self) -> str:
        r = self.rng
        mark = "\u0001"
        body = [f"<h{r.choice('12')}>{mark}{self.words(2, 12)}</h{r.choice('12')}>"] if r.random() < 0.8 else []
        for _ in range(r.choice((1, 2, 3, 5, 8, 14))):
            text = mark + self.words(1, r.choice((3, 20, 60, 150)))
            body.append(r.choice((f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<div>{text}</div>", f"<blockquote>{text}</blockquote>", f"<ul><li>{text}</li><li>{mark}{self.words(1, 12)}</li></ul>", f"<h2>{text}</h2>")))
            if r.random() < 0.08:
                body.append(self.other(r.choice(("ad", "form", "sidebar"))))
        return self.element(("article", "article", "main", "div", "section"), ("content", "article-body", "post", "entry-content", "main", "story text"), "".join(body))

    def page(self) -> tuple[list[Block], list[int]]:
        r = self.rng
        self.named = r.choice((1.0, 1.0, 0.6, 0.0, 0.0))
        top = [self.other(k) for k in ("notice", "header", "menu", "ad", "form") if r.random() < 0.5]
        low = [self.other(k) for k in ("ad", "sidebar", "comments", "form", "notice", "footer") if r.random() < 0.45]
        page = f"<!DOCTYPE html><html><head><title>{self.words(2, 12)}</title></head><body>{''.join(top)}{self.article()}{''.join(low)}</body></html>"
        found = blocks(page, _WANTED)
        labels = [int(b.text.startswith("\u0001")) for b in found]
        for b in found:
            b.text = b.text.lstrip("\u0001").strip() or "."
        return found, labels


def labelled_pages(n: int, seed: int) -> list[tuple[list[Block], list[int]]]:
    """Generated pages as blocks with labels (1: main text)."""
    maker = _PageMaker(seed)
    return [maker.page() for _ in range(n)]


@functools.cache
def default_field(pages: int = 1000, seed: int = 11) -> Field:
    """The field fitted on ``pages`` generated pages."""
    return Field().fit([(features(b), y) for b, y in labelled_pages(pages, seed)])


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page, _WANTED)
    return "\n\n".join(b.text for b, y in zip(found, field.decode(features(found)), strict=True) if y)


def _extract(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), field) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])

    return run


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", field: Field | None = None) -> DataFrame:
    """Per row of ``pages``: ``(id_col, url_col, text, n_chars)``."""
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    out = rows.mapInArrow(_extract(field or default_field()), "id bigint, url string, text string, n_chars bigint")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
