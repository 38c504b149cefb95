"""Main-text extraction by deducing the template of each host.

A page is read as a sequence of tokens: block tags with their path of enclosing block tags, and text blocks with their
path. For every (host, token) the pages of different content are folded into an occurrence vector, held as the number of
pages and the exclusive or of hash(content, count), so that tokens with equal vectors get equal fingerprints without any
group of pages being collected. Tokens that share a vector are an equivalence class; a class with enough support is
valid, and the valid classes, nested by the paths of their tags, are the host's template. A page's text blocks lie in
slots between the template's tags, each in that of its deepest enclosing template tag. A block that is itself a token of
the template is constant; the text of a slot is extracted unless all it holds on the page is constant and links, or a
tag around it is a menu, header, footer, sidebar, notice, advert, form or comments by its name or label. Where a page
has an article or main element, its slots are those within.

Copies of a page count once. Where a page's constant text blocks, links aside, are at least twice as many as its own, the pages are
variants of one text, and their blocks stay. Inside an article a class name counts only if all its words are of
boilerplate and layout, so that "share-price" drops nothing; outside, a class of content beside it outweighs the label.

Defined results: null or empty html gives an empty text; a host with fewer than ``least`` pages of different content has
no template and is read by its tags and labels alone; a null or unparsable url is a host of its own; rows that repeat a
page_id each give one row; a tag that the page's end cuts off is no text.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes, broadcast_if_small, cut

BLOCKS = frozenset("html head body header nav main article section aside footer div ul ol li dl dt dd p h1 h2 h3 h4 h5 h6 table thead tbody tfoot tr td th caption form fieldset figure figcaption blockquote pre address details summary dialog menu title noscript select button iframe label option textarea template hr".split())
#: Elements whose text is never part of the article.
SKIPPED = frozenset("head nav aside footer form fieldset menu title noscript select button iframe label option textarea dialog template".split())
VOID = frozenset({"hr", "br", "img", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track"})
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
CLOSES_P = BLOCKS - {"label", "option", "select", "button", "textarea", "iframe", "template", "noscript"}
#: Words in class, id or role that label boilerplate.
LABELS = frozenset(
    "nav navbar navigation navigate menu submenu header masthead footer foot sidebar aside ad ads adv advert adverts advertisement advertising adsense adslot adbox banner sponsor sponsored sponsors promo promotion promotions cookie cookies consent gdpr notice notices alert popup popover modal overlay newsletter subscribe subscription signup login register form search searchbox share sharing social comment comments commentlist disqus discussion respond reply replies related recommended recommendations breadcrumb breadcrumbs pagination pager widget widgets skip copyright disclaimer toolbar contentinfo complementary".split()
)
#: Words of class names that are no part of an article, inside one, if what else they say is layout.
NAMES = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion comment comments commentlist replies respond disqus share sharing social newsletter subscribe subscription signup related recommended recommendations sidebar breadcrumb breadcrumbs pagination cookie cookies consent gdpr popup modal navigation menu nav navbar toolbar".split())
LAYOUT = frozenset("slot area box section list bar block wrapper wrap container holder group row col column inner outer top bottom left right center post posts article articles item items page unit units banner button buttons link links icons widget form notice area overlay header footer title panel sticky fixed mobile desktop js".split())
#: Whole class names of content.
CONTENT = frozenset("story content article entry body text main post post-content entry-content article-body article-content story-body main-content".split())
# every alternative takes what it has read for good, so that a tag that never ends is given up after one reading
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|svg|math)\b(?>(?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>.*?(?:</\1\s*>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-z][a-z0-9]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|</?[a-z][^<>]*+\Z""",
    re.S | re.I,
)
_ATTR = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACES = re.compile(r"\s+")


def _label(attrs: str) -> str:
    """The class, id and role of a tag, as one string."""
    return " ".join(v.strip("\"'") for v in _ATTR.findall(attrs)) if "=" in attrs else ""


def _words(name: str) -> set[str]:
    return {w.lower() for w in _WORD.findall(name)}


def _boilerplate(label: str, inside: bool) -> bool:
    """Whether class names, id or role of a tag say that it is no part of the article."""
    names = label.lower().split() if inside else label.split()
    if inside:
        return any((words := {w for w in _words(n) if not w.isdigit()}) & NAMES and words <= NAMES | LAYOUT for n in names)
    return any(_words(n) & LABELS for n in names) and not any(n.lower() in CONTENT for n in names)


@dataclass(slots=True)
class Tag:
    """An open block tag: its parent, the hash of its path, and what holds for all text within."""

    name: str
    parent: Tag | None
    path: int
    skipped: bool
    inside: bool
    aside: bool
    items: Tag | None


@dataclass(slots=True)
class Block:
    """A block tag (text None) or a text block, within ``tag``; ``linked`` if all its text is in links."""

    tag: Tag
    text: str | None
    linked: bool


_ASIDE = re.compile(r"comment|aside|sidebar|related", re.I)


def parse_blocks(page: str) -> list[Block]:
    """The block tags and text blocks of a page, in order; a tag is held once, whatever its depth."""
    root = Tag("", None, 0, False, False, False, None)
    out, stack, at = [], [root], 0
    counts: Counter[str] = Counter()  # of the open tags
    text, linked, in_link = [], True, 0

    def flush() -> None:
        nonlocal text, linked
        if text:
            whole = _SPACES.sub(" ", html_lib.unescape("".join(text))).strip()
            if whole:
                out.append(Block(stack[-1], whole, linked))
        text, linked = [], True

    def push(tag: str, attrs: str) -> None:
        label, above = _label(attrs), stack[-1]
        skipped, inside = above.skipped, above.inside
        if tag in ("article", "main") and not _words(label) & {"comment", "comments", "reply", "ad", "advert", "advertisement", "sponsored", "promo", "related"}:
            if skipped and not above.aside:  # an unclosed menu or header ends here
                skipped = False
            inside = True
        elif tag not in ("html", "body"):
            skipped = skipped or tag in SKIPPED or _boilerplate(label, inside) or (tag == "header" and not inside)
        path = xxhash.xxh64_intdigest(f"{tag}.{label}", seed=above.path)
        own = Tag(tag, above, path, skipped, inside, above.aside or bool(_ASIDE.search(tag + label)), above.items)
        if tag in ("ul", "ol", "dl", "menu"):
            own.items = own
        stack.append(own)
        counts[tag] += 1
        out.append(Block(own, None, False))

    def pop() -> str:
        name = stack.pop().name
        counts[name] -= 1
        return name

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
            linked = linked and (in_link > 0 or not page[at : m.start()].strip())
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag == "br":
            text.append("\n")
        elif tag == "a":
            in_link = 0 if m[2] else 1
        elif tag in BLOCKS:
            flush()
            if m[2]:
                if counts[tag]:
                    while pop() != tag:
                        pass
            else:
                if tag in CLOSES_P and stack[-1].name == "p":
                    pop()
                if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1].name == tag:
                    pop()
                if tag not in VOID:
                    push(tag, m[4])
    if at < len(page):
        text.append(page[at:])
        linked = linked and in_link > 0
    flush()
    return out


def _hash(block: Block) -> int:
    """The token of a block: its path and its text."""
    return xxhash.xxh64_intdigest(block.text or "", seed=block.tag.path) - 2**63


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(host, token, pages, vector), folded over each batch."""
    for pdf in batches:
        folded: dict[tuple, list[int]] = {}
        for host, html in zip(pdf["host"], pdf["html"], strict=True):
            counts: dict[int, int] = {}
            for b in parse_blocks(html or ""):
                t = _hash(b)
                counts[t] = counts.get(t, 0) + 1
            content = xxhash.xxh64_intdigest(html or "")
            for t, n in counts.items():
                x = folded.setdefault((host, t), [0, 0])
                x[0] += 1
                x[1] ^= xxhash.xxh64_intdigest(f"{content}|{n}") - 2**63
        yield pd.DataFrame([(h, t, n, v) for (h, t), (n, v) in folded.items()], columns=["host", "token", "pages", "vector"])


def templates(pages: DataFrame, support: float = 0.8, least: int = 3) -> DataFrame:
    """(host, tokens): the tokens of the valid equivalence classes of each host, from (host, html)."""
    digest = F.xxhash64("html")
    p = pages.withColumn("digest", digest).withColumn("page", F.xxhash64("page"))
    # of the pages of one content the least stands for all; only contents that repeat are held
    copies = p.groupBy("host", "digest").agg(F.min("page").alias("_first"), F.count("*").alias("_n"))
    distinct = copies.groupBy("host").agg(F.count("*").alias("of")).withColumnRenamed("host", "_host").filter(F.col("of") >= least)
    repeated = copies.filter("_n > 1").select(F.col("host").alias("_h"), F.col("digest").alias("_d"), "_first")
    once = p.join(broadcast_if_small(cut(repeated)), F.col("host").eqNullSafe(F.col("_h")) & (F.col("digest") == F.col("_d")), "left").filter(F.col("_first").isNull() | (F.col("_first") == F.col("page")))
    counted = once.select("host", "html").mapInPandas(_tokens, "host string, token long, pages long, vector long").groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.bit_xor("vector").alias("vector"))
    classes = counted.filter(F.col("pages") >= least).groupBy("host", "pages", "vector").agg(F.collect_set("token").alias("tokens"))
    valid = classes.join(broadcast_if_small(cut(distinct)), F.col("host").eqNullSafe(F.col("_host"))).filter(F.col("pages") >= F.lit(support) * F.col("of"))
    return valid.groupBy("host").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens"))


def _slots(blocks: list[Block], template: frozenset[int]) -> list[tuple[int, bool, Block]]:
    """(slot, constant, block) of each text block: the deepest enclosing template tag, and whether the block is of the template."""
    slots: dict[int, int] = {}
    out = []
    for b in blocks:
        if b.text is None:
            slots[id(b.tag)] = id(b.tag) if _hash(b) in template else slots.get(id(b.tag.parent), 0)
        else:
            out.append((slots.get(id(b.tag), 0), _hash(b) in template, b))
    return out


def extract_text(page: str | None, template: frozenset[int] = frozenset()) -> str:
    """The blocks in the page's open slots, one to a line."""
    placed = _slots(parse_blocks(page or ""), template)
    inside = any(b.tag.inside and not b.tag.skipped for _, _, b in placed)
    left = [(slot, constant, b) for slot, constant, b in placed if not b.tag.skipped and (b.tag.inside or not inside)]
    prose = [constant for _, constant, b in left if not b.linked]
    if prose and 3 * sum(prose) >= 2 * len(prose):
        left = [(slot, False, b) for slot, _, b in left]  # variants of one text
    if inside:
        return "\n".join(b.text for _, constant, b in left if not constant)
    # a slot or a list of links alone is a menu
    menus = {slot for slot, _, _ in left} - {slot for slot, constant, b in left if not constant and not b.linked}
    told = {id(b.tag.items) for _, _, b in left if not b.linked}
    return "\n".join(b.text for slot, constant, b in left if not constant and slot not in menus and (not b.linked or b.tag.items is None or id(b.tag.items) in told))


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, frozenset[int]] = {}
    for pdf in batches:
        texts = []
        for host, tokens, html in zip(pdf["host"], pdf["tokens"], pdf["html"], strict=True):
            if host not in held:
                if len(held) > 1000:
                    held.clear()
                held[host] = frozenset() if tokens is None else frozenset(int(t) for t in tokens)
            texts.append(extract_text(html, held[host]))
        yield pdf[["page_id", "url"]].assign(text=texts)


def extract_main_text(pages: DataFrame, support: float = 0.8, least: int = 3, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row of ``pages``: page_id, url, text and n_chars (code points of text)."""
    batches_by_bytes(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))
    p = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host.alias("host"))
    known = cut(templates(p.select("host", F.col("page_id").alias("page"), "html"), support, least))
    joined = p.join(broadcast_if_small(known, 500_000, F.size("tokens")), "host", "left").select("page_id", "url", "html", "host", "tokens")
    id_type = p.schema["page_id"].dataType.simpleString()
    url_type = p.schema["url"].dataType.simpleString()
    out = joined.mapInPandas(_extract, f"page_id {id_type}, url {url_type}, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
