"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

Features of a block are its ancestors' tags, words in their class, id and role names,
and facts about its text (length, links, punctuation, marks of notices).  Two labels,
main text or not; transitions are learned too.  The pages table has no labels, so the
field is trained on labelled pages that ``training_pages`` lays out in many ways from
random words: nested and flat containers, with and without telling class names, and
comments, forms and adverts inside and outside the article.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import chunks
from stratum.llm.dom import Block, Element, blocks

TAGS = "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd nav header footer aside form fieldset label button legend table td th tr blockquote pre figure figcaption address details summary menu dialog search".split()
NAMES = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar pagination pager",
    "head": "header masthead banner logo branding site-header",
    "foot": "footer colophon bottom copyright legal",
    "side": "sidebar side aside rail widget widgets complementary",
    "ad": "ad ads advert adverts advertisement promo sponsor sponsored adslot adsense",
    "notice": "cookie cookies consent notice gdpr popup modal overlay alert newsletter subscribe signup paywall",
    "talk": "comment comments reply replies respond discussion disqus reader-comments",
    "share": "share social sharing follow related recommended more-stories tags meta byline",
    "main": "article content post entry main story body text post-content article-body entry-content main-content page",
}
GROUP = {word: group for group, words in NAMES.items() for word in words.split()}
TEXT = ["words:0", "words:1", "words:2", "words:3", "words:4", "links:0", "links:1", "links:2", "ends", "commas", "copyright", "upper", "notice"]
OWN = [f"own:{t}" for t in TAGS] + ["own:none"]
INDEX = {name: k for k, name in enumerate(["bias", *(f"in:{t}" for t in TAGS), *(f"name:{g}" for g in NAMES), *OWN, *TEXT])}
SPLIT = re.compile(r"[^a-z]+")
NOTICE = re.compile(r"cookie|subscribe|sign in|log in|newsletter|all rights reserved|advert|sponsored", re.I)
PAGES, STEPS, RATE, DECAY = 500, 120, 0.5, 3e-4


@lru_cache(maxsize=1 << 15)
def name_features(names: str) -> frozenset[int]:
    return frozenset(INDEX[f"name:{GROUP[word]}"] for word in {*names.split(), *SPLIT.split(names)} if word in GROUP)


NOWHERE = (frozenset({INDEX["bias"]}), (*sorted({INDEX["bias"], INDEX["own:none"]}),))


def path_features(element: Element | None) -> tuple[int, ...]:
    """Features of an element's ancestors and itself; each element's are made once, from its parent's."""
    todo, at = [], element
    while at is not None and at.memo is None:
        todo.append(at)
        at = at.parent
    found = at.memo if at is not None else NOWHERE
    for e in reversed(todo):
        own, inside = found[0], INDEX.get(f"in:{e.tag}")
        more = name_features(e.names) if e.names and e.tag not in ("html", "body") else frozenset()
        if inside is not None and inside not in own or not more <= own:
            own = own | more | ({inside} if inside is not None else frozenset())
        found = e.memo = (own, (*sorted(own | {INDEX.get(f"own:{e.tag}", INDEX["own:none"])}),))
    return found[1]


def text_features(b: Block) -> list[int]:
    words = b.text.count(" ") + 1
    share = b.link_chars / len(b.text)
    found = [f"words:{(words > 2) + (words > 6) + (words > 15) + (words > 40)}", f"links:{(share > 0.2) + (share > 0.6)}"]
    if b.text[-1] in ".!?:;\"')»…。":
        found.append("ends")
    if ", " in b.text:
        found.append("commas")
    if "©" in b.text or "(c)" in b.text[:40].lower():
        found.append("copyright")
    if b.text.isupper():
        found.append("upper")
    if words <= 40 and NOTICE.search(b.text):
        found.append("notice")
    return [INDEX[f] for f in found]


def page_features(found: list[Block]) -> list[list[int]]:
    return [[*path_features(b.element), *text_features(b)] for b in found]


class ChainField:
    """Two-label chain: weights (features, 2), transitions (2, 2); trained by gradient of the likelihood."""

    def __init__(self):
        self.w, self.t = np.zeros((len(INDEX), 2)), np.zeros((2, 2))

    def fit(self, pages: list[tuple[list[list[int]], list[int]]], steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> ChainField:
        n, longest = len(pages), max(len(x) for x, _ in pages)
        x, y, mask = np.zeros((n, longest, len(INDEX)), dtype=np.float32), np.zeros((n, longest), dtype=int), np.zeros((n, longest), dtype=bool)
        for i, (f, labels) in enumerate(pages):
            for k, (own, label) in enumerate(zip(f, labels, strict=True)):
                x[i, k, own], y[i, k], mask[i, k] = 1, label, True
        flat = x.reshape(-1, len(INDEX))
        gold = np.eye(2)[y] * mask[..., None]
        pair_mask = mask[:, 1:] & mask[:, :-1]
        gold_t = np.einsum("nki,nkj,nk->ij", np.eye(2)[y[:, :-1]], np.eye(2)[y[:, 1:]], pair_mask.astype(float))
        hw, ht, total = np.full_like(self.w, 1e-8), np.full_like(self.t, 1e-8), mask.sum()
        for _ in range(steps):
            e = (flat @ self.w).reshape(n, longest, 2)
            a, b = np.zeros_like(e), np.zeros_like(e)
            a[:, 0] = e[:, 0]
            for k in range(1, longest):
                step = np.logaddexp.reduce(a[:, k - 1, :, None] + self.t, axis=1) + e[:, k]
                a[:, k] = np.where(mask[:, k, None], step, a[:, k - 1])
            for k in range(longest - 2, -1, -1):
                step = np.logaddexp.reduce(self.t + (e[:, k + 1] + b[:, k + 1])[:, None, :], axis=2)
                b[:, k] = np.where(mask[:, k + 1, None], step, 0)
            z = np.logaddexp.reduce(a[:, -1], axis=1)
            p = np.exp(a + b - z[:, None, None]) * mask[..., None]
            pair = np.exp(a[:, :-1, :, None] + self.t + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pair_mask[..., None, None]
            gw = flat.T @ (gold - p).reshape(-1, 2) / total - decay * self.w
            gt = (gold_t - pair.sum(axis=(0, 1))) / total - decay * self.t
            hw += gw**2
            ht += gt**2
            self.w += rate * gw / np.sqrt(hw)
            self.t += rate * gt / np.sqrt(ht)
        return self

    def viterbi(self, features: list[list[int]]) -> list[int]:
        """Most likely labels of one page."""
        if not features:
            return []
        w, t = self._lists()
        (t00, t01), (t10, t11) = t
        s0 = sum(w[k][0] for k in features[0])
        s1 = sum(w[k][1] for k in features[0])
        back = []
        for own in features[1:]:
            e0 = e1 = 0.0
            for k in own:
                e0 += w[k][0]
                e1 += w[k][1]
            a, b, c, d = s0 + t00, s1 + t10, s0 + t01, s1 + t11
            back.append((0 if a >= b else 1, 0 if c >= d else 1))
            s0, s1 = max(a, b) + e0, max(c, d) + e1
        label = 0 if s0 >= s1 else 1
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    def _lists(self):
        if not hasattr(self, "_cached"):
            self._cached = (self.w.tolist(), self.t.tolist())
        return self._cached


def training_pages(n: int = PAGES, seed: int = 29) -> list[tuple[str, set[str]]]:
    """Labelled pages: html, and the texts of its main blocks.  Every block's text is unique in its page."""
    r = random.Random(seed)
    pages = []

    def words(a: int, b: int, dots: bool = True) -> str:
        out = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzéüñ") for _ in range(r.randint(2, 9))) for _ in range(r.randint(a, b))]
        if dots:
            for k in range(len(out)):
                out[k] += r.choice(["", "", "", "", ",", "."])
            joined = r.choice([" "] * 12 + [" | ", "!! ", "$ "]).join(out).capitalize().rstrip(",.")
            return joined + ("." if r.random() < 0.7 else "")
        return " ".join(out)

    def named(group: str) -> str:
        word = r.choice(NAMES[group].split())
        return r.choice([f' class="{word}"', f' id="{word}"', f' class="x-{word} box"', f' class="{word} c{r.randint(1, 9)}"'])

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{i}">{words(1, 3, False)}</a></li>' for i in range(k))

    for _ in range(n):
        main: set[str] = set()

        def keep(text: str, tag: str) -> str:
            main.add(text)
            if tag == "p" and r.random() < 0.2:
                return f"<p><b>{text}<br>"
            if tag == "p" and r.random() < 0.15:
                return f"<p>{text}"
            if tag == "p" and r.random() < 0.2:
                a, _, b = text.partition(" ")
                return f'<p><a href="#">{a}</a> {b}</p>'
            return f"<{tag}>{text}</{tag}>"

        def junk(kind: str) -> str:
            named_too = r.random() < 0.75
            if kind == "nav":
                return r.choice([f"<nav{named('nav')}><ul>{links(r.randint(2, 8))}</ul></nav>", f"<nav><ul>{links(r.randint(2, 8))}</ul></nav>", f"<div{named('nav')}><ul>{links(r.randint(3, 8))}</ul></div>", f"<ul{named('nav')}>{links(r.randint(3, 8))}</ul>"])
            if kind == "header":
                inner = r.choice([f"<h1>{words(1, 4, False)}</h1>", f"<p>{words(3, 9)}</p>", words(2, 5, False), f"<div>{words(2, 6)}</div><ul>{links(3)}</ul>"])
                return r.choice([f"<header>{inner}</header>", f"<div{named('head')}>{inner}</div>"])
            if kind == "footer":
                inner = r.choice([f"&copy; {words(2, 12)}", f"<p>{words(4, 30)}</p>", f"<ul>{links(3)}</ul><p>&copy; {words(2, 6)}</p>", f"<div>{words(3, 15)}</div>"])
                return r.choice([f"<footer>{inner}</footer>", f"<footer{named('foot')}>{inner}</footer>", f"<div{named('foot')}>{inner}</div>"])
            if kind == "side":
                inner = r.choice([f"<h3>{words(1, 4, False)}</h3><ul>{links(4)}</ul>", f"<p>{words(5, 40)}</p>", f"<div><p>{words(5, 20)}</p></div>", words(4, 15)])
                return r.choice([f"<aside{named('side') if named_too else ''}>{inner}</aside>", f"<div{named('side')}>{inner}</div>"])
            if kind == "ad":
                inner = r.choice([words(4, 25), f"<p>{words(4, 25)}</p>", f"<a href='#'>{words(2, 8)}</a>"])
                return r.choice([f"<div{named('ad')}>{inner}</div>", f"<section{named('ad')}>{inner}</section>", f"<aside{named('ad')}>{inner}</aside>"])
            if kind == "notice":
                inner = r.choice([f"<p>{words(5, 30)}</p><button>{words(1, 2, False)}</button>", words(5, 25), f"<p>Cookie {words(5, 20)}</p>"])
                return r.choice([f"<div{named('notice')}>{inner}</div>", f"<section{named('notice')}>{inner}</section>", f"<dialog{named('notice')}>{inner}</dialog>"])
            if kind == "form":
                return f"<form{named('notice') if r.random() < 0.3 else ''}><label>{words(1, 5, False)}</label><input name='q'><p>{words(3, 14)}</p><button>{words(1, 2, False)}</button></form>"
            if kind == "talk":
                inner = "".join(r.choice([f"<p>{words(3, 50)}</p>", f"<div><p>{words(3, 50)}</p></div>", f"<li><p>{words(3, 50)}</p></li>", f"<article><p>{words(3, 40)}</p></article>"]) for _ in range(r.randint(1, 5)))
                head = f"<h2>{words(1, 3, False)}</h2>" if r.random() < 0.5 else ""
                return r.choice([f"<section{named('talk')}>{head}{inner}</section>", f"<div{named('talk')}>{head}{inner}</div>", f"<ol{named('talk')}>{inner}</ol>"])
            return r.choice([f"<div{named('share')}><ul>{links(3)}</ul></div>", f"<div{named('share')}>{words(2, 6, False)}</div>"])

        body = [keep(words(2, 12, r.random() < 0.5), "h1")] if r.random() < 0.85 else []
        for _ in range(r.choice([0, 1, 1, 2, 3, 4, 6, 9, 14])):
            u = r.random()
            if u < 0.72:
                body.append(keep(words(1, r.choice([4, 12, 60, 120])), "p"))
            elif u < 0.8:
                body.append(keep(words(1, 7, False), r.choice(["h2", "h3", "h4"])))
            elif u < 0.88:
                tag = r.choice(["ul", "ol"])
                body.append(f"<{tag}>" + "".join(keep(words(1, 20), "li") for _ in range(r.randint(1, 5))) + f"</{tag}>")
            elif u < 0.92:
                body.append("<blockquote>" + keep(words(5, 40), "p") + "</blockquote>")
            elif u < 0.95:
                body.append("<table><tr>" + "".join(keep(words(1, 6), "td") for _ in range(3)) + "</tr></table>")
            elif u < 0.97:
                body.append("<figure>" + keep(words(3, 15), "figcaption") + "</figure>")
            else:
                body.append(keep(words(5, 60), r.choice(["pre", "div"])))
        if r.random() < 0.35:
            body.insert(r.randint(0, len(body)), junk(r.choice(["ad", "notice", "share", "form", "side", "ad"])))
        if r.random() < 0.25:
            body.append(junk(r.choice(["talk", "share", "footer", "form"])))
        inner = "".join(body)
        if r.random() < 0.3:
            inner = f"<div{named('main') if r.random() < 0.5 else ''}>{inner}</div>"
        holder = r.choice(["<article>{}</article>", "<article>{}</article>", "<article{n}>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<div{n}>{}</div>", "<section{n}>{}</section>", "<div{n}><section>{}</section></div>", "<div>{}</div>"])
        page = holder.replace("{n}", named("main")).replace("{}", inner)
        before = [junk(k) for k in ("header", "nav", "notice", "ad", "side", "form", "share") if r.random() < (0.8 if k == "nav" else 0.4)]
        after = [junk(k) for k in ("side", "ad", "share", "talk", "form", "notice", "footer") if r.random() < (0.8 if k == "footer" else 0.35)]
        if r.random() < 0.5:
            r.shuffle(before)
        page = "".join(before) + page + "".join(after)
        if r.random() < 0.3:
            page = f"<div class='wrapper'>{page}</div>"
        pages.append((f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{}}</style></head><body>{page}</body></html>", main))
    return pages


def labelled(page: str, main: set[str]) -> tuple[list[list[int]], list[int]]:
    found = blocks(page)
    return page_features(found), [int(b.text in main) for b in found]


@lru_cache(maxsize=4)
def train(n: int = PAGES, seed: int = 29) -> ChainField:
    return ChainField().fit([x for x in (labelled(*p) for p in training_pages(n, seed)) if x[0]])


def extract(page: str, field: ChainField) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, label in zip(found, field.viterbi(page_features(found)), strict=True) if label)


def main_text(pages: DataFrame, field: ChainField | None = None) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    Null and empty html give an empty text.  Repeated rows give equal results, and equal
    scores of the two labels take the block out.  A page of any length or nesting takes
    time in proportion to its length, in one task.  Only page_id, url and html are read;
    an empty table gives an empty result.
    """
    field = field or train()

    def run(batches):
        for batch in batches:
            for a, z in chunks(batch.column(2)):
                texts = [extract(x or "", field) for x in batch.column(2).slice(a, z - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), batch.column(1).slice(a, z - a), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_html_extraction(spark, sf_dir):
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
