"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is a row of blocks: runs of text between the tags of block elements. Each block is described by the
tags, roles and class words of its ancestors and by the shape of its text; none of the features is a
word of the text, so a model holds for any language. The field scores blocks and neighbouring pairs; it
is trained on labelled pages by gradient steps on the log likelihood and decoded by Viterbi.

``training_pages`` makes labelled pages from templates, which vary in layout, names and markup errors and
hide the telling names in part of the pages, so text shape and neighbours are learned too; some are an article with
hardly any markup around it. Pages with
known text can be given to ``fit`` instead.

Defined cases: null html is empty and gives empty text; scripts, styles, templates, comments and a page's head
are never blocks; unclosed and stray tags are tolerated as browsers do; a page without a content block gives
empty text; repeated rows each get their row; text without any tag is a block.
"""

from __future__ import annotations

import html as references
import functools
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_BITS = 15
TRAINING_PAGES, STEPS, RATE, PENALTY = 1500, 200, 0.08, 2e-4
#: The share of training pages with little markup.
BARE = 0.35
#: What a paragraph gets on a page of which nothing else is kept.
LENIENT = 2.0

#: Elements of HTML whose tags part blocks, and those whose content is no text.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
HIDDEN = {"script", "style", "template", "noscript", "head", "svg", "iframe", "object", "textarea", "select", "annotation", "annotation-xml", "canvas", "datalist"}
RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "xmp", "noembed", "noframes"}
RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a head holds; any other ends an open head.
HEAD = set("base basefont bgsound link meta noframes noscript script style template title".split())
#: Elements that end an open p, and elements that end an open one of their own kind.
CLOSES_P = BLOCKS - {"body", "html", "head", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "title", "frameset"}
SIBLINGS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
FENCES = {"ul", "ol", "dl", "table", "select", "menu"}

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*)(?:>|\Z)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")
DIGITS = re.compile(r"\d")
ENDS = ".!?:;…。！？\"'”»)"


class Frame:
    """An open element: its own names, the tags around it, a value that equal ways from the root share."""

    __slots__ = ("tag", "names", "above", "top", "way", "fresh", "before")

    def __init__(self, tag: str, names: tuple, around: Frame | None):
        self.tag, self.names, self.fresh, self.before = tag, names, (), 0.0
        plain = tag in ("html", "body")
        self.above = (around.above if plain else around.tag if around.tag not in ("html", "body") else "") if around else ""
        self.top = (around.top if around else "") or ("" if plain else tag)
        self.way = (around.way if around else 0) if plain else hash((around.way if around else 0, tag, names))


class Block:
    __slots__ = ("text", "pieces", "frame", "linked", "forms", "inherited", "score")

    def __init__(self, frame: Frame | None, inherited: tuple, score: float):
        self.text, self.pieces, self.frame, self.linked, self.forms, self.inherited, self.score = "", [], frame, 0, 0, inherited, score

    def is_paragraph(self) -> bool:
        """A paragraph of whole sentences, by its own tag and text."""
        return self.frame is not None and self.frame.tag in ("p", "blockquote", "pre") and self.text[-1] in ENDS and self.text.count(" ") > 4 and self.linked < 0.3 and not self.forms


def blocks_of(html: str, weights: list[float] | None = None) -> list[Block]:
    """Each leaf block with text, in order: its text, innermost element, share of text in links, form controls.

    Also the numbers of the features of all its ancestors or, given weights, only the sum of their weights. These sums,
    and the places of open elements, are kept while the page is read, so that time does not grow with its depth.
    """
    out: list[Block] = []
    stack: list[Frame] = []
    places: dict[str, list[int]] = {}
    fences: list[int] = []
    parted: list[int] = []
    live: dict[int, None] = {}
    running, hidden, links, at = 0.0, 0, 0, 0
    current, raw = None, None

    def enter(tag: str, names: tuple) -> None:
        nonlocal running, hidden, links
        frame = Frame(tag, names, stack[-1] if stack else None)
        frame.before = running
        if tag not in ("html", "body"):
            frame.fresh = tuple(f for f in {number(f"in:{tag}"), *(number(f"name:{w}") for w in names)} if f not in live)
            live.update(dict.fromkeys(frame.fresh))
            if weights is not None:
                running += sum(weights[f] for f in frame.fresh)
        places.setdefault(tag, []).append(len(stack))
        if tag in FENCES:
            fences.append(len(stack))
        if tag in BLOCKS:
            parted.append(len(stack))
        stack.append(frame)
        hidden += tag in HIDDEN
        links += tag == "a"

    def leave(to: int) -> None:
        nonlocal running, hidden, links, current
        while len(stack) > to:
            frame = stack.pop()
            for f in frame.fresh:
                del live[f]
            running = frame.before
            places[frame.tag].pop()
            hidden -= frame.tag in HIDDEN
            links -= frame.tag == "a"
            if frame.tag in FENCES:
                fences.pop()
            if frame.tag in BLOCKS:
                parted.pop()
                current = None

    def last(tag: str) -> int:
        """The depth of the innermost open element of this tag; -1: none is open."""
        return places[tag][-1] if places.get(tag) else -1

    while at < len(html):
        if raw:
            end = RAW_ENDS[raw].search(html, at)
            at, raw = end.start() if end else len(html), None
            continue
        m = MARKUP.match(html, at)
        at = m.end()
        closing, tag, rest = m.group(1), m.group(2), m.group(3)
        if tag is None:
            piece = m.group(0)
            if piece.startswith("<") and len(piece) > 1:
                continue
            if stack and stack[-1].tag == "head" and piece.strip(" \t\n\r\f"):
                leave(len(stack) - 1)
            if hidden:
                continue
            if current is None:
                if piece.isspace():
                    continue
                current = Block(stack[-1] if stack else None, tuple(live) if weights is None else (), running)
                out.append(current)
            current.pieces.append(piece)
            current.linked += len(piece) * (links > 0)
            continue
        tag = tag.lower()
        if closing:
            depth = last(tag)
            if depth >= 0 and (tag in BLOCKS or not fences or fences[-1] <= depth):
                leave(depth)
            if tag in BLOCKS:
                current = None
            continue
        if stack and stack[-1].tag == "head" and tag not in HEAD:
            leave(len(stack) - 1)
        if tag in ("br", "wbr", "img", "input", "button"):
            if current is not None and tag == "br":
                current.pieces.append(" ")
            if current is not None and tag in ("input", "button"):
                current.forms += 1
            if tag != "button":
                continue
        if tag in CLOSES_P and last("p") >= 0 and last("p") == parted[-1]:
            leave(last("p"))
        if tag == "body" and last("head") >= 0:
            leave(places["head"][0])
        while tag in SIBLINGS and (depth := max(map(last, SIBLINGS[tag]))) >= 0 and (not fences or fences[-1] < depth):
            leave(depth)
            if tag != "tr":
                break
        if tag in BLOCKS:
            current = None
        if tag in VOID or rest.endswith("/") and tag in ("svg", "path"):
            continue
        names = ()
        if "=" in rest or "hidden" in rest:
            found = []
            for key, value in ATTRIBUTE.findall(rest):
                key = key.lower()
                if key in ("hidden", "aria-hidden"):
                    found += ["hidden"] * (value.strip("\"'").lower() != "false")
                else:
                    found += [w.lower() for w in NAME.findall(value)]
            names = tuple(found)
        enter(tag, names)
        raw = tag if tag in RAW else None
    rows = []
    for block in out:
        whole = "".join(block.pieces)
        block.text = SPACE.sub(" ", references.unescape(whole) if "&" in whole else whole).strip()
        block.linked /= max(1, len(whole))
        if block.text:
            rows.append(block)
    return rows


_numbers: dict[str, int] = {}


def number(feature: str) -> int:
    import zlib

    n = _numbers.get(feature)
    if n is None:
        n = zlib.crc32(feature.encode()) >> (32 - TABLE_BITS)
        if len(_numbers) < 200_000:
            _numbers[feature] = n
    return n


def shape(text: str, linked: float, forms: int) -> list[str]:
    """Features of a block's text: none of its words."""
    n, words = len(text), text.count(" ") + 1
    commas = text.count(",") + text.count(";")
    return [
        f"words{min(9, words.bit_length())}", f"long{n >= 80}", f"end{text[-1] in ENDS}", f"end{text[-1] in ENDS}words{min(7, words.bit_length())}", f"link{round(linked * 4)}",
        f"link{linked > 0.5}words{min(5, words.bit_length())}", f"commas{min(4, commas)}", f"digits{len(DIGITS.findall(text)) * 8 > n}",
        f"sign{text[0] in '©®™→«»|›·#@'}", f"copy{'©' in text}", f"bars{' | ' in text or ' · ' in text or ' › ' in text}", f"mail{'@' in text}", f"form{forms > 0}", f"upper{text.isupper()}",
    ]


def features(blocks: list[Block]) -> list[list[int]]:
    """The numbers of each block's features; those of the neighbours' shapes and the way from the one before included."""
    shapes = [shape(b.text, b.linked, b.forms) for b in blocks]
    out = []
    for i, b in enumerate(blocks):
        own, frame = ["bias", *shapes[i]], b.frame
        if frame and frame.top:
            own += [f"tag:{frame.tag}", f"top:{frame.top}", f"tag:{frame.tag}:{shapes[i][0]}"]
            own += [f"leafname:{w}" for w in set(frame.names)]
            if frame.above:
                own.append(f"two:{frame.above}>{frame.tag}")
        else:
            own.append("bare")
        own.append(f"place{i * 4 // len(blocks)}")
        own.append(f"first{i == 0}last{i == len(blocks) - 1}")
        own += [f"before:{s}" for s in shapes[i - 1][:5]] if i else ["before:none"]
        own += [f"after:{s}" for s in shapes[i + 1][:5]] if i + 1 < len(blocks) else ["after:none"]
        if i and (blocks[i - 1].frame.way if blocks[i - 1].frame else 0) == (frame.way if frame else 0):
            own.append("same")
        out.append([number(f) for f in own] + list(b.inherited))
    return out


class Model:
    """Block weights for content against boilerplate, and scores of neighbouring pairs."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray):
        self.weights, self.pairs, self.listed = weights, pairs, weights.tolist()

    def content(self, blocks: list[Block]) -> list[bool]:
        """The best labelling, by Viterbi; of blocks that were read with or without the model's weights.

        If it holds nothing, paragraphs of whole sentences get the benefit of the doubt, LENIENT more each.
        """
        found = self.decoded(blocks)
        if not any(found) and any(plain := [b.is_paragraph() for b in blocks]):
            return self.decoded(blocks, [LENIENT * p for p in plain])
        return found

    def decoded(self, blocks: list[Block], more: list[float] | None = None) -> list[bool]:
        if not blocks:
            return []
        (aa, ab), (ba, bb) = self.pairs.tolist()
        off, on, back = 0.0, 0.0, []
        for i, f in enumerate(features(blocks)):
            s = float(self.weights[f].sum()) + blocks[i].score + (more[i] if more else 0.0)
            if i:
                from_off, from_on = (off + aa >= on + ba), (off + ab >= on + bb)
                back.append((from_off, from_on))
                off, on = max(off + aa, on + ba), max(off + ab, on + bb) + s
            else:
                on = s
        label, out = on > off, []
        out.append(label)
        for from_off, from_on in reversed(back):
            label = not (from_on if label else from_off)
            out.append(label)
        return out[::-1]

    def text(self, html: str) -> str:
        blocks = blocks_of(html, self.listed)
        return "\n".join(b.text for b, keep in zip(blocks, self.content(blocks)) if keep)


def marginals(score: np.ndarray, live: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By the forward and backward sums: the chance of each block to be content, of each pair of labels of neighbours, and log Z.

    score and live have a row for each page and a column for each block; ``live`` is false behind a page's last block.
    """
    u = np.stack([np.zeros_like(score), score], 2)
    alpha, beta, length = np.zeros_like(u), np.zeros_like(u), score.shape[1]
    alpha[:, 0] = u[:, 0]
    for j in range(1, length):
        new = np.logaddexp(alpha[:, j - 1, :1] + pairs[0], alpha[:, j - 1, 1:] + pairs[1]) + u[:, j]
        alpha[:, j] = np.where(live[:, j, None], new, alpha[:, j - 1])
    for j in range(length - 2, -1, -1):
        x = u[:, j + 1] + beta[:, j + 1]
        new = np.logaddexp(pairs[:, 0] + x[:, :1], pairs[:, 1] + x[:, 1:])
        beta[:, j] = np.where(live[:, j + 1, None], new, beta[:, j + 1])
    whole = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    both = np.exp(alpha[:, :-1, :, None] + pairs + (u[:, 1:] + beta[:, 1:])[:, :, None, :] - whole[:, None, None, None])
    return np.exp(alpha[:, :, 1] + beta[:, :, 1] - whole[:, None]), both * live[:, 1:, None, None], whole


def train(pages: list[tuple[list[list[int]], list[bool]]]) -> Model:
    """Gradient steps (Adam) on the log likelihood of labelled block rows."""
    pages = [p for p in pages if p[0]]
    length = max(len(f) for f, _ in pages)
    flat = np.concatenate([np.array(f) for fs, _ in pages for f in fs])
    sizes = [len(f) for fs, _ in pages for f in fs]
    row_of = np.repeat(np.arange(len(sizes)), sizes)
    place = np.array([i * length + j for i, (fs, _) in enumerate(pages) for j in range(len(fs))])
    live = np.zeros(len(pages) * length, bool)
    live[place] = True
    live = live.reshape(len(pages), length)
    truth = np.zeros(len(pages) * length, int)
    truth[place] = np.concatenate([np.array(y, int) for _, y in pages])
    truth = truth.reshape(len(pages), length)
    w, t = np.zeros(1 << TABLE_BITS), np.zeros((2, 2))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    pair_live = live[:, 1:]
    seen = np.zeros((2, 2))
    np.add.at(seen, (truth[:, :-1][pair_live], truth[:, 1:][pair_live]), 1)
    for step in range(1, STEPS + 1):
        score = np.zeros(len(pages) * length)
        score[place] = np.bincount(row_of, w[flat], len(sizes))
        chance, both, _ = marginals(score.reshape(len(pages), length), live, t)
        g = np.bincount(flat, ((chance - truth).reshape(-1)[place])[row_of], len(w)) / len(pages) + PENALTY * w
        gt = (both.sum((0, 1)) - seen) / len(pages) + PENALTY * t
        for value, grad, m, v in ((w, g, moments[0], moments[1]), (t, gt, moments[2], moments[3])):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad**2 - v)
            value -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(w, t)


#: Names that sites give to the parts of their pages.
PART_NAMES = {
    "menu": ["nav", "menu", "navbar", "navigation", "main-menu", "breadcrumb", "breadcrumbs", "topnav", "tabs", "pager", "pagination"],
    "header": ["header", "masthead", "site-header", "top-bar", "banner", "branding", "logo"],
    "footer": ["footer", "site-footer", "copyright", "colophon", "bottom", "legal"],
    "side": ["sidebar", "side", "widget", "related", "aside", "recommended", "popular", "trending", "tags", "share", "social", "read-more"],
    "notice": ["cookie", "notice", "cookie-banner", "consent", "gdpr", "alert", "popup", "modal", "newsletter", "subscribe", "disclaimer", "paywall"],
    "advert": ["ad", "ads", "advert", "sponsored", "promo", "promotion", "ad-slot", "advertisement", "banner-ad", "sponsor"],
    "form": ["form", "search", "login", "signup", "contact-form"],
    "comment": ["comments", "comment", "comment-list", "discussion", "replies", "respond", "reader-comments", "disqus", "comment-body"],
    "content": ["content", "article", "post", "entry", "main", "story", "post-content", "entry-content", "article-body", "text", "body", "main-content", "page"],
}


class Maker:
    """Labelled pages: (html, texts of the content blocks)."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice("bcdfghklmnprstvz") + self.r.choice("aeiouéäü") + self.r.choice(["", "", "n", "r", "s"]) for _ in range(self.r.randint(1, 4)))

    def sentence(self, most: int = 25) -> str:
        words = [self.word() for _ in range(self.r.randint(1 if self.r.random() < 0.15 else 4, most))]
        return " ".join(w + ("," if self.r.random() < 0.08 else "") for w in words).strip(",").capitalize() + self.r.choice([".", ".", ".", "!", "?"])

    def words(self, most: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(1, most))).capitalize()

    def open(self, tag: str, part: str) -> str:
        """An opening tag; the telling name is left out in part of the pages."""
        if self.r.random() < self.anonymous:
            return f'<{tag} class="c{self.r.randint(1, 99)}">' if self.r.random() < 0.5 else f"<{tag}>"
        return f'<{tag} {self.r.choice(["class", "class", "id"])}="{self.r.choice(PART_NAMES[part])}">'

    def boilerplate(self, part: str) -> str:
        r, link = self.r, lambda t: f'<a href="/{self.word()}">{t}</a>'
        tag = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}.get(part, "div")
        if tag != "div" and r.random() < 0.35:
            tag = r.choice(["div", "div", "section"])
        if tag in ("nav", "header", "footer", "aside", "form") and r.random() < 0.5:
            start = f"<{tag}>"
        else:
            start = self.open(tag, part)
        if part == "menu":
            body = "<ul>" + "".join(f"<li>{link(self.words(3))}</li>" for _ in range(r.randint(2, 8))) + "</ul>" if r.random() < 0.7 else " ".join(link(self.words(2)) for _ in range(r.randint(2, 8)))
        elif part == "header":
            body = r.choice(["<div>{}</div>", "<p>{}</p>", "<h1>{}</h1>" if self.h1_free else "<h2>{}</h2>", "{}"]).format(link(self.words(3)) if r.random() < 0.5 else self.words(4)) + (f"<p>{self.sentence(8)}</p>" if r.random() < 0.3 else "")
        elif part == "footer":
            body = r.choice(["&copy; {} &middot; {}", "<p>© 2024 {}. {}</p>", "<p>{}</p><p>{}</p>", "<div>{} | {}</div>"]).format(self.words(2), self.sentence(12)) + (" ".join(link(self.words(2)) for _ in range(3)) if r.random() < 0.4 else "")
        elif part == "side":
            body = f"<h3>{self.words(3)}</h3>" + ("<ul>" + "".join(f"<li>{link(self.words(7))}</li>" for _ in range(r.randint(2, 6))) + "</ul>" if r.random() < 0.6 else f"<p>{self.sentence(30)}</p>" + f"<p>{self.sentence(30)}</p>" * (r.random() < 0.4))
        elif part == "notice":
            body = r.choice(["<p>{}</p><button>{}</button>", "{} <button>{}</button>", "<p>{}</p>", "{}"]).format(self.sentence(30), self.words(1))
        elif part == "advert":
            body = r.choice(["{}", "<p>{}</p>", "<a href='/x'>{}</a>", "<h4>{}</h4>"]).format(self.sentence(20))
        elif part == "form":
            body = f"<label>{self.words(3)}</label><input name=q><button>{self.words(1)}</button>" if r.random() < 0.6 else f"<p>{self.sentence(10)}</p><input><select><option>{self.word()}<option>{self.word()}</select>"
        else:
            each = lambda: r.choice(["<li><b>{0}</b><p>{1}</p></li>", "<div class='comment'><span>{0}</span><p>{1}</p></div>", "<p>{0}: {1}</p>", "<p>{1}</p>"]).format(self.words(2), " ".join(self.sentence() for _ in range(r.randint(1, 3))))
            body = (f"<h3>{self.words(3)}</h3>" if r.random() < 0.6 else "") + "".join(each() for _ in range(r.randint(1, 5)))
            tag, start = ("div", start) if r.random() < 0.7 else ("section", self.open("section", part))
        return f"{start}{body}</{tag}>"

    def bare(self) -> tuple[str, list[str]]:
        """A page of little markup: an article with few parts around it or none, often without headings, in any wrapper or none."""
        r, body = self.r, []
        self.anonymous, self.h1_free = r.choice([0, 0, 0.5]), False
        kind = r.choice(["plain", "body", "body", "article", "article", "main", "div", "section", "blog", "blog", "blog", "blog", "blog", "wiki"])
        truth = [" ".join(self.sentence() for _ in range(r.choice([1, 2, 2, 3, 5, 8]))) for _ in range(r.choice([1, 1, 2, 3, 5, 8]))]
        if kind == "plain":
            return r.choice(["{}", "{}\n", "<p>{}", "<!DOCTYPE html>{}", "<html><body>{}"]).format(r.choice(["\n", " ", "<br>", "<br><br>"]).join(truth)), [" ".join(truth)]
        each = r.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<div>{}</div>", "<p class=par>{}</p>"])
        body = [each.format(x) for x in truth]
        if kind not in ("plain", "body") and len(truth) > 1 and r.random() < 0.15:  # a list of links between paragraphs
            at, items = r.randint(1, len(truth) - 1), [self.words(6) for _ in range(r.randint(2, 5))]
            body.insert(at, "<ul>" + "".join(f'<li><a href="/{self.word()}">{x}</a></li>' for x in items) + "</ul>")
            truth[at:at] = items
        if r.random() < 0.35:
            title = self.words(8)
            body.insert(0, r.choice(["<h1>{}</h1>", "<h2>{}</h2>", "<h3>{}</h3>"]).format(title))
            truth.insert(0, title)
        whole = "".join(body)
        if kind == "blog":
            name = r.choice(["post", "entry", "hentry", "blog-post", "single", "content"])
            reply = f'<h3>{self.words(3)}</h3>' * (r.random() < 0.6) + r.choice(["<form>{}</form>", "<p>{}</p>", "<form><p>{}</p><textarea></textarea></form>"]).format(f"<label>{self.words(2)}</label><input><button>{self.words(1)}</button>")
            said = "".join(f"<li><b>{self.words(2)}</b><p>{self.sentence()}</p></li>" for _ in range(r.choice([0, 0, 1, 3])))
            heading = r.choice(["<h3>{}</h3>", "<h2>{}</h2>", "<h3 class=comments-title>{}</h3>", "<p>{}</p>"]).format(f"{r.randint(1, 40)} {self.words(2)}") * (bool(said) and r.random() < 0.6)
            parts = [heading + f"<ol class={r.choice(PART_NAMES['comment'])}>{said}</ol>"] * bool(said) + [f'<div id="{r.choice(["respond", "reply", "commentform", "comments"])}">{reply}</div>'] * (r.random() < 0.8)
            # a theme's lines about the post stand before or behind its text, inside its own element
            when = r.choice(["{1} {0}, {2} {3}", "{0} {1} {2} {3}", "{3} {1} {0}, {2}", "{1} {0}, {2}"]).format(r.randint(1, 31), self.words(1), r.randint(1990, 2030), self.words(2))
            line, tagged = r.choice(["<p class={0}>{1}</p>", "<div class={0}>{1}</div>", "<div class={0}><span>{1}</span></div>", "<p>{1}</p>"]), ", ".join(f'<a href="/{self.word()}">{self.word()}</a>' for _ in range(r.randint(1, 4)))
            about = line.format(r.choice(["meta", "entry-meta", "byline", "posted-on", "post-meta", "date"]), when) * (r.random() < 0.5)
            below = line.format(r.choice(["tags", "post-tags", "cat-links", "entry-footer", "postmetadata"]), f"{self.words(2)} {tagged}") * (r.random() < 0.5)
            cut = whole.find(">", whole.find("</h")) + 1 if whole.startswith("<h") else 0
            whole = whole[:cut] + about + whole[cut:] + below
            whole = f'<div class="{name}">{whole}{"" if (inside := r.random() < 0.55) else "</div>"}{"".join(parts)}{"</div>" if inside else ""}'
        elif kind == "wiki":
            last = f"{self.words(5)} {r.randint(1, 31)} {self.words(1)} {r.randint(1990, 2030)}, {r.randint(0, 23)}:{r.randint(10, 59)}."
            foot = r.choice(["<li>{}</li>", "<p>{}</p>", "<div>{}</div>"]).format(last) + (f"<p>{self.sentence()}</p>" if r.random() < 0.5 else "")
            whole = f'<div id="{r.choice(PART_NAMES["content"])}">{whole}</div><div id="{r.choice(["footer", "footer-info", "catlinks", "page-info"])}">{foot}</div>'
        elif kind != "body":
            whole = f"<{kind}>{whole}</{kind}>" if r.random() < 0.7 else f"{self.open(kind, 'content')}{whole}</{kind}>"
        before = "".join(self.boilerplate(p) for p in ("header", "menu", "notice") if r.random() < 0.2)
        after = "".join(self.boilerplate(p) for p in ("side", "footer") if r.random() < 0.2)
        head = r.choice(["", "", "<html><body>", "<html><head><title>x</title>", "<head><meta charset=utf-8><title>x</title></head>", "<!DOCTYPE html><html><head><link href=a></head><body>"])
        return head + before + whole + after, truth

    def page(self) -> tuple[str, list[str]]:
        r = self.r
        if r.random() < BARE:
            return self.bare()
        self.anonymous, self.h1_free = r.choice([0, 0, 0.15, 0.5]), r.random() < 0.3
        truth, body = [], []
        title = self.words(8) if r.random() < 0.6 else self.sentence(12)
        if r.random() < 0.85:
            head = f"<h1>{title}</h1>" if not self.h1_free else f"<h2>{title}</h2>"
            body.append(f"<header>{head}</header>" if r.random() < 0.08 else head)
            truth.append(title)
        for _ in range(r.choice([0, 1, 2, 3, 4, 6, 9, 14])):
            kind, text = r.random(), " ".join(self.sentence() for _ in range(r.choice([1, 1, 2, 4, 7])))
            if r.random() < 0.05:  # a row of a list or table, written out
                text = r.choice([" | ", ", ", " ", " - "]).join(self.word() for _ in range(r.randint(5, 60)))
            if kind < 0.06:
                text = self.words(6)
                body.append(f"<h{r.randint(2, 4)}>{text}</h{r.randint(2, 4)}>")
            elif kind < 0.12:
                items = [self.sentence(12) for _ in range(r.randint(2, 4))]
                body.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
                truth += items
                continue
            elif kind < 0.17:
                body.append(f"<blockquote>{text}</blockquote>")
            elif kind < 0.20:
                body.append(f"<pre>{text}</pre>")
            elif kind < 0.24:
                body.append(f"<table><tr><td>{text}</td></tr></table>")
            elif kind < 0.36:
                body.append(f"<p><b>{text}<br>")
            elif kind < 0.46:
                a, b = text.split(" ", 1) if " " in text else (text, "")
                body.append(f'<p><a href="/x">{a}</a> {b}</p>' if r.random() < 0.6 else f"<p><em>{a}</em> {b}</p>")
            elif kind < 0.52:
                body.append(f"<div>{text}</div>")
            else:
                body.append(f"<p>{text}</p>")
            truth.append(text.strip())
        inner = [(self.boilerplate(p), None) for p in ("advert", "side", "notice", "form", "comment") if r.random() < 0.13]
        for x, _ in inner:
            body.insert(r.randint(1, len(body)) if body else 0, x)
        if r.random() < 0.3:
            body.append(self.boilerplate("comment"))
        tag = r.choice(["article", "article", "article", "main", "div", "div", "section"])
        start = f"<{tag}>" if tag != "div" and r.random() < 0.6 else self.open(tag, "content")
        middle = f"{start}{''.join(body)}</{tag}>"
        if r.random() < 0.3:
            middle = f"{self.open('div', 'content')}{middle}</div>"
        before = [self.boilerplate(p) for p in ("notice", "header", "menu", "menu", "advert", "form", "side") if r.random() < 0.4]
        after = [self.boilerplate(p) for p in ("comment", "side", "advert", "form", "notice", "footer") if r.random() < 0.45]
        top = f'<!DOCTYPE html><html lang="x"><head><meta charset="utf-8"><title>{title}</title><style>p{{margin:0}}</style></head><body>' if r.random() < 0.9 else ""
        return top + "".join(before) + "<!-- x -->" + middle + "".join(after) + "</body></html>", truth


def training_pages(n: int = TRAINING_PAGES, seed: int = 11) -> list[tuple[str, list[str]]]:
    """Pages of templates with the texts of their content blocks, in order."""
    maker = Maker(seed)
    return [maker.page() for _ in range(n)]


@functools.cache
def own_model() -> Model:
    """The model of the templates' pages, fitted once a process: they are the same each time."""
    return fit()


def fit(pages: list[tuple[str, list[str]]] | None = None) -> Model:
    """A model from labelled pages: (html, texts of the content blocks in order)."""
    rows = []
    for html, truth in training_pages() if pages is None else pages:
        blocks, left = blocks_of(html), list(truth)
        labels = []
        for block in blocks:
            hit = block.text in left
            if hit:
                del left[: left.index(block.text) + 1]
            labels.append(hit)
        rows.append((features(blocks), labels))
    return train(rows)


def extracted(spark: SparkSession, model: Model, html: Column) -> Column:
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shared.value.text(h or "") for h in batch])

    return extract(html)


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages."""
    text = extracted(pages.sparkSession, model or own_model(), F.col("html"))
    return pages.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
