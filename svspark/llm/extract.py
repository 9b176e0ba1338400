"""Main-text extraction by a maximum-scoring run of words and tags.

A page is a sequence of tags and words.  A word's score comes from its block (share of its words in links, length, sentence ends)
and from the elements around it (names, and words of class, id and role); tags score negative.  The weights are those of a
logistic regression on labelled pages.  One linear scan finds the contiguous run with the greatest sum; the words
of that run whose own score is not negative, with references decoded, are the text.

No name is a veto: a class word shifts a score, one that is part of a compound by half, and a page
of which class words would leave nothing is judged by its elements and its text alone.
"""

from __future__ import annotations

import html as _html
import math
import random
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PIECE = re.compile(r"[^A-Za-z0-9]+")
_STOP = re.compile(r"[.!?:;\u3002\u061f](?=\s|$|[\"')\u201d])")

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"br", "body", "html", "head", "caption", "option", "tbody", "td", "tfoot", "th", "thead", "tr"}


# Class words of page parts that are not the article.
BOILER_WORDS = (
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert disclaimer paywall "
    "popup modal newsletter subscribe subscription signup login share sharing social related recommended trending popular teaser outbrain taboola toc comment comments reply replies disqus footer header masthead copyright toolbar widget "
    "pagination pager search form contentinfo complementary"
).split()
CONTENT_WORDS = "content post entry story body text main article page prose section blog news detail".split()
BOILER_TAGS = "nav header footer aside form menu button select label dialog head".split()


def labelled_pages(size: int = 400, seed: str = "pages") -> list[list[tuple[str, bool]]]:
    """The default labelled pages, made by a rule from invented words: parts of a page, true for the article's own."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    phrase = lambda n: " ".join(word() for _ in range(n)).capitalize()
    sentence = lambda: phrase(rng.randint(4, 18)) + rng.choice("...!?")
    link = lambda: f"<a href='/{word()}'>{phrase(rng.randint(1, 3))}</a>"

    def links() -> str:
        items = "".join(f"<li>{link()}</li>" for _ in range(rng.randint(3, 9)))
        return rng.choice([f"<ul>{items}</ul>", " | ".join(link() for _ in range(rng.randint(3, 7))), "".join(f"<div>{link()}</div>" for _ in range(4))])

    def prose() -> str:
        text = " ".join(sentence() for _ in range(rng.randint(1, 5)))
        if rng.random() < 0.3:
            text += f" {link()} {phrase(3)}."
        return rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}</b></p>", "<blockquote>{}</blockquote>", "<div>{}</div>", "{}<br>", "<li>{}</li>", "<pre>{}</pre>", "<td>{}</td>"]).format(text if rng.random() < 0.85 else phrase(rng.randint(1, 6)))

    def other(kind: int) -> str:
        inner = rng.choice([links, lambda: f"<p>{sentence()}</p>", sentence, lambda: phrase(rng.randint(1, 5)), lambda: "".join(f"<p>{sentence()}</p>" for _ in range(3))])()
        if kind < len(BOILER_TAGS):
            return f"<{BOILER_TAGS[kind]}>{inner}</{BOILER_TAGS[kind]}>"
        name = BOILER_WORDS[kind % len(BOILER_WORDS)]
        name = rng.choice([name, name, name, f"{name}-{word()}", f"{word()} {name}", f"{name}-{rng.choice(BOILER_WORDS)}"])
        return f'<{(tag := rng.choice(["div", "div", "section", "span", "ul", "p"]))} {rng.choice(["class", "class", "id"])}="{name}">{inner}</{tag}>'

    kinds = len(BOILER_TAGS) + len(BOILER_WORDS)
    pages = []
    for i in range(size):
        one = lambda: [(other(rng.randrange(kinds) if rng.random() < 0.7 else rng.randrange(len(BOILER_TAGS))), False)]  # noqa: B023, E731
        names = " ".join([rng.choice([*CONTENT_WORDS, word()]), *([f"{rng.choice(BOILER_WORDS)}-{word()}"] if rng.random() < 0.1 else [])])
        tag, attribute = rng.choice([("article", ""), ("article", f' class="{names}"'), ("main", ""), ("div", f' class="{names}"'), ("div", f' id="{names}"'), ("section", ""), ("", "")])
        page = [("<html><body>", False), *one(), *one(), *[(links(), False)] * rng.randint(0, 1), (other(i % kinds), False)]
        page.append((f"<{tag}{attribute}>" if tag else "", True))
        page.append((rng.choice([f"<h1>{phrase(rng.randint(1, 9))}</h1>", f"<h2>{phrase(4)}</h2>", ""]), True))
        for _ in range(rng.randint(2, 9)):
            page.append((prose(), True))
            if rng.random() < 0.1:
                page += one()
        page += [(f"</{tag}>" if tag else "", True), *one(), *[(links(), False)] * rng.randint(0, 1), *one(), ("</body></html>", False)]
        pages.append(page)
    pages += [[(f"{rng.choice(['', '<p>'])}{phrase(rng.randint(1, 5))}", True)] for _ in range(size // 10)]
    return pages


def _marks(name: str, attributes: str) -> tuple[tuple[str, float], ...]:
    """What an open element says about its words: its name, and the words of its class, id and role, by half in compounds."""
    if "=" not in attributes:
        return ((name, 1.0),)
    out = [(name, 1.0)]
    for m in _NAMES.finditer(attributes):
        for whole in (m[1] or m[2] or m[3] or "").split():
            parts = [x for x in _PIECE.split(whole) if x]
            out += [(f".{x.lower()}", 1.0 if len(parts) == 1 else 0.5) for x in parts]
    return tuple(out)


def _tokens(page: str):
    """('open', name, attributes), ('close', name, '') and ('text', text, '') in page order; comments and raw elements left out."""
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            yield "text", page[at:], ""
            return
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            yield "close", name, ""
        elif name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at) if not m[3].endswith("/") else None
            if not m[3].endswith("/"):
                at = end.end() if end else n
        else:
            yield "open", name, m[3]


#: Marks that may have a weight: other element names say nothing.
KNOWN = frozenset([*BOILER_TAGS, "article", "main", "section", *(f".{w}" for w in (*BOILER_WORDS, *CONTENT_WORDS))])
#: Where the weights of a block (share in links, length, short, ends a sentence, constant) are drawn to: text without any mark is the article's.
PRIOR = (-3.0, 0.0, 0.0, 0.0, 1.0)
INLINE = frozenset("a abbr b bdi bdo big cite code em font i kbd mark q s samp small strong sub sup time tt u var wbr".split())


class _Page:
    """The pieces of text of a page with the open elements around them, and the blocks that they form."""

    def __init__(self, page: str):
        self.tags: list[tuple[int, bool]] = []  # (pieces before the tag, whether it ends a block)
        self.text: list[str] = []
        self.words: list[int] = []
        self.block: list[int] = []
        self.around: list[tuple[tuple[str, float], ...]] = []
        self.linked: dict[int, int] = {}
        self.total: dict[int, int] = {}
        self.stops: dict[int, int] = {}
        stack: list[tuple[str, tuple]] = []
        block = links = 0
        for kind, what, attributes in _tokens(page):
            if kind == "text":
                n = len(what.split())
                self.text.append(what)
                self.words.append(n)
                self.block.append(block)
                self.around.append(stack[-1][1] if stack else ())
                if n:
                    self.total[block] = self.total.get(block, 0) + n
                    self.linked[block] = self.linked.get(block, 0) + n * bool(links)
                    self.stops[block] = self.stops.get(block, 0) + len(_STOP.findall(what))
                continue
            self.tags.append((len(self.text), what in BLOCK))
            block += what in BLOCK
            if kind == "open":
                if what in CLOSES_P:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == "p":
                            links -= sum(x[0] == "a" for x in stack[k:])
                            del stack[k:]
                            break
                        if stack[k][0] in BLOCK:
                            break
                if what not in VOID and not attributes.endswith("/"):
                    outer, own = stack[-1][1] if stack else (), _marks(what, attributes)
                    own = own[1:] if what in INLINE else own
                    stack.append((what, outer + own if own else outer))
                    links += what == "a"
            else:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == what:
                        links -= sum(x[0] == "a" for x in stack[k:])
                        del stack[k:]
                        break

    def features(self, block: int) -> tuple[float, float, float, float]:
        """Of a block: share of words in links, logarithm of its length, whether it is short, whether it ends a sentence."""
        n = self.total.get(block, 0) or 1
        return (self.linked.get(block, 0) / n, math.log1p(n) / 4, float(n <= 3), float(self.stops.get(block, 0) > 0))


def train(pages: list[list[tuple[str, bool]]], rounds: int = 12, decay: float = 2e-4) -> dict:
    """Weights of element names, class words and block features, by logistic regression on the blocks of labelled pages."""
    rows = []
    for page in pages:
        whole = "".join(p for p, _ in page)
        ends, at = [], 0
        for part, good in page:
            at += len(part)
            ends.append((at, good))
        # a piece belongs to the part in which it ends; parts are parsed together, so that marks of outer elements reach inner parts
        parsed, place, k = _Page(whole), 0, 0
        for text, n, block, around in zip(parsed.text, parsed.words, parsed.block, parsed.around, strict=True):
            place = whole.index(text, place) + len(text)
            while ends[k][0] < place:
                k += 1
            if n:
                rows.append(({m: v for m, v in around if m in KNOWN}, parsed.features(block), ends[k][1]))
    marks: dict[str, float] = {}
    base = list(PRIOR)
    for r in range(rounds):
        rate = 0.3 / (1 + r / 3)
        for around, x, good in rows:
            z = base[4] + sum(marks.get(m, 0.0) * v for m, v in around.items()) + sum(w * v for w, v in zip(base, x, strict=False))
            left = good - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            for m, v in around.items():
                w = marks.get(m, 0.0)
                marks[m] = w + rate * (left * v - decay * w)
            for i, v in enumerate((*x, 1.0)):
                base[i] += rate * (0.3 * left * v - 0.01 * (base[i] - PRIOR[i]))
    return {"marks": marks, "base": base}


@lru_cache(maxsize=1)
def default_model() -> dict:
    return train(labelled_pages())


#: Score of a tag; share of a negative score that counts against going on behind such words, which never enter the text: an advert
#: within an article does not end it; greatest score of a word.
TAG, INSIDE, MOST = -0.3, 0.005, 2.0


def best_run(scores: list[float]) -> tuple[int, int]:
    """(first, end) of the contiguous run with the greatest positive sum, the first found of equal ones; (0, 0) if there is none."""
    best = run = 0.0
    start, found = 0, (0, 0)
    for i, x in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += x
        if run > best:
            best, found = run, (start, i + 1)
    return found


def _scan(page: _Page, model: dict, classes: bool) -> str:
    marks, base = model["marks"], model["base"]
    sums: dict[tuple, float] = {}
    ofs: dict[int, float] = {}

    def score(i: int) -> float:
        around, block = page.around[i], page.block[i]
        if around not in sums:
            sums[around] = sum(marks.get(m, 0.0) * v for m, v in dict(around).items() if classes or m[0] != ".")
        if block not in ofs:
            ofs[block] = base[4] + sum(w * v for w, v in zip(base, page.features(block), strict=False))
        return max(-MOST, min(MOST, sums[around] + ofs[block]))

    scores: list[float] = []  # of tags and pieces in page order
    place: list[int] = []  # of each score, the pieces before it
    keep, t, negative = [True] * len(page.text), 0, False
    for i, n in enumerate(page.words):
        while t < len(page.tags) and page.tags[t][0] <= i:
            scores.append(TAG * (INSIDE if negative else 1))
            place.append(i)
            t += 1
        if n:
            z = score(i)
            negative = z < 0
            scores.append(n * z * (INSIDE if negative else 1))
            place.append(i)
        keep[i] = not negative
    first, end = best_run(scores)
    span = (place[first], place[end - 1] + 1) if end else (0, 0)
    blocks: list[str] = []
    now: list[str] = []
    last = None
    for i in [*range(*span), None]:
        if i is None or page.block[i] != last:
            text = " ".join(_html.unescape("".join(now)).split())
            if text:
                blocks.append(text)
            now = []
        if i is not None:
            last = page.block[i]
            if keep[i]:
                now.append(page.text[i])
    return "\n".join(blocks)


def extract(page: str, model: dict) -> str:
    """The main text of one page."""
    parsed = _Page(page)
    return _scan(parsed, model, True) or _scan(parsed, model, False)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: dict | None = None) -> DataFrame:
    """One row per page: (page_id, url, text).

    Defined cases: null and empty pages, and pages without words, have an empty text; null ids and URLs stay; repeated rows are
    extracted alike; unclosed elements end with the element around them; the page's end closes all; other columns are ignored.
    """
    model = model or default_model()

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("html")
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                texts = [extract(p, model) if p else "" for p in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string")
