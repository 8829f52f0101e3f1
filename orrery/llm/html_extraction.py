"""Main text of web pages, by a site style tree.

Pages are parsed once, inside tasks, into blocks of text and the elements that hold them.
The pages of a host are then merged into a tree: an element's place is that of its parent,
the sequence of containers that the parent has on this page (its style), and the element's
tag, classes and rank among equals. Copies, pages of a host whose texts are the same in the
same order, count as one page. For every place that enough pages share, Spark counts

* how often each shape of the branch is seen (runs of equal branches in it count once), and
  how often each sequence of children: their entropies, as shares of the greatest possible one, are the presentation importance P of
  the branch and the variety S of the element itself;
* how often each text of the branch is seen: its entropy is the content importance C;
* how much text outside of links the branch holds, against the largest branch beside it: V.

A container is judged where its parent is a part of the template, which is the body, or an
element whose S is low: its importance is C * (1 - (1 - P) * (1 - V)), so a branch must
change from page to page, and either in its form or with a weight of its own. Branches of
low importance are removed from each page, a footer whose words change as much as a menu.
Everywhere else, and for headings and paragraphs, only a text that nearly all pages repeat
at its place is removed.

The markup's own roles come after the tree, for what it can't know, such as a host of few
pages, or reader comments, which change as articles do: branches marked up as menus,
headers, footers, sidebars, notices, adverts, forms, comments, scripts or styles go, and
where a page marks its article or main part, only that stays. Inside a marked article only
roles and classes that name a widget as a whole cut a branch, and the tree removes nothing
but repeated texts. No name cuts a heading or a paragraph.

What crosses the network are hashes of places, shapes and texts; counts are aggregated
partially, so a host with a third of all pages is not gathered anywhere.

Defined cases: null or empty html gives an empty text; broken markup is read as browsers
do in spirit: open elements end with their parents, an unclosed comment or script ends the
page; equal pages get equal texts; a null or odd URL belongs to the host ''; an empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch
from .text import through_pandas


@dataclass(frozen=True)
class Params:
    least_pages: int = 5
    """Pages of a host, copies counted once, that share a place before the tree judges it."""
    least_importance: float = 0.1
    most_variety: float = 0.3
    """An element whose children vary less than this from page to page is a part of the template."""
    repeated: float = 0.05
    """1 - log(pages with the text) / log(pages) below which a text is the site's, not the page's."""
    repeated_in_article: float = 0.02
    broadcast_rows: int = 1_000_000


#: Fixed values of HTML: elements without end tags, of raw text, that end a paragraph, that make blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td
    tfoot th thead tr ul caption option""".split()
)
CLOSES_P = BLOCKS - frozenset("body html td th tr tbody thead tfoot caption option li dd dt".split())
SAME_KIND = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
SCOPES = frozenset("ul ol dl table td th article section div body html nav aside footer header main form".split())
CUT_TAGS = frozenset("nav footer aside form script style noscript template iframe head svg canvas object select button dialog menu audio video map search textarea input label fieldset".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status".split())
#: Words in class names and ids that tell a part's role.
CUT_WORDS = frozenset(
    """nav navbar navigation menu menus topbar header masthead footer sidebar aside cookie cookies consent gdpr notice
    notices alert banner advert adverts advertisement ad ads adsbygoogle adslot sponsor sponsored promo promotion comment
    comments commentlist disqus respond reply replies share sharing social breadcrumb breadcrumbs pagination pager
    newsletter subscribe subscription signup popup modal overlay related recommended widget login searchform searchbox
    toolbar skip paywall""".split()
)
#: Inside a marked article: words that name a widget, and those that may stand beside one in the same class.
WIDGETS = CUT_WORDS - frozenset("header masthead notice notices alert skip".split())
PARTS = CUT_WORDS | frozenset("area bar block body box button buttons container form icons item items links list posts section slot thread unit wrapper".split())
WHOLE = frozenset("h1 h2 h3 h4 h5 h6 p".split())
"""Elements that no name cuts."""
#: Elements that end only with their own end tags.
WIDE = frozenset("article main body html nav footer aside header form section div".split())

TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"'=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|[\"'=])*+)>|<[!?/][^>]*>|([^<]+|<)", re.S)
REST = re.compile(r"<!--.*|()()()(.+)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[a-z]+")
DIGITS = re.compile(r"[0-9]+")


#: Elements whose branches the tree may weigh, and those whose children it may.
CONTAINERS = frozenset("address aside center details dialog dir div dl fieldset figure footer form header main menu nav ol section table ul".split())
LEVELS = frozenset("body html div section main center form header footer aside article".split())


@dataclass
class Node:
    """An element on the stack; those that make blocks are the nodes of the tree."""

    tag: str
    label: str
    parent: Node | None
    rank: int
    first: int
    cut: bool
    mute: bool
    link: bool
    article: bool
    children: list[str] = field(default_factory=list)
    containers: list[str] = field(default_factory=list)
    branches: list[str] = field(default_factory=list)
    seen: dict[str, int] = field(default_factory=dict)
    last: int = -1
    heads: bool = False
    """It is or holds a heading of the first level."""
    shape: str = ""
    place: int = 0


@dataclass
class Page:
    blocks: list[str] = field(default_factory=list)
    plain: list[int] = field(default_factory=list)
    """Code points of each block that stand outside of links."""
    kept: list[bool] = field(default_factory=list)
    """Whether roles leave the block."""
    nodes: list[Node] = field(default_factory=list)
    """Elements that hold a block, parents first."""

    def text(self) -> str:
        return "\n".join(b for b, k in zip(self.blocks, self.kept, strict=True) if k)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}


def _is_cut(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    if tag in CUT_TAGS or (tag == "header" and not in_article):
        return True
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return True
    if attrs.get("role", "").lower() in CUT_ROLES:
        return True
    if tag in WHOLE:
        return False
    if in_article:
        # an id there may come from a title, and one word of a class says little
        each = [set(WORD.findall(c)) for c in attrs.get("class", "").lower().split()]
        widget = any(c & WIDGETS and c <= PARTS for c in each)
        return widget and (tag not in ("body", "html", "main", "article") or tag == "article" and any(c & {"comment", "comments", "reply"} for c in each))
    named = WORD.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower())
    return bool(CUT_WORDS.intersection(named)) and tag not in ("body", "html", "main", "article" if not {"comment", "comments", "reply"}.intersection(named) else "")


def parse(page: str) -> Page:
    """Blocks of text in page order, and the tree of the elements that hold them."""
    out = Page()
    root = Node("", "", None, 0, 0, False, False, False, False)
    stack, opened = [root], [root]
    parts: list[str] = []
    inside: list[bool] = []  # the block lies in a marked article
    linked, marked = 0, False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                top = stack[-1]
                out.blocks.append(text)
                out.plain.append(max(0, len(text) - linked))
                out.kept.append(not top.cut)
                inside.append(top.article)
            parts.clear()
            linked = 0

    def pop() -> None:
        top = stack.pop()
        if top.tag in BLOCKS:
            top.last = len(out.blocks)
            # a run of equal branches counts once: how many entries a list has is no form
            top.shape = f"{top.label}({','.join(k for k, _ in groupby(top.branches))})"
            above = top.parent
            if len(top.shape) > 64:
                top.shape = f"{_hash(top.shape):x}"
            above.branches.append(top.shape)
            above.heads |= top.heads

    def close(tags: set[str], scopes: frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                flush()
                while len(stack) > k:
                    pop()
                return
            if stack[k].tag in scopes:
                return

    at, n = 0, len(page)
    last = page.rfind(">") + 1  # no tag ends behind it, so what follows is text
    while at < n:
        m = TOKEN.match(page, at) if at < last else REST.match(page, at)
        at = m.end()
        if m[4] is not None:
            if not stack[-1].mute:
                parts.append(entities.unescape(m[4]) if "&" in m[4] else m[4])
                if stack[-1].link:
                    linked += len(parts[-1].strip())
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS:
                close({tag}, frozenset() if tag in WIDE else frozenset({"article", "main"}))
                flush()
            else:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        while len(stack) > k:
                            pop()
                        break
                    if stack[k].tag in BLOCKS:
                        break
            continue
        if tag in BLOCKS:
            flush()
            if tag in CLOSES_P:
                close({"p"}, SCOPES)
            if tag in SAME_KIND and tag != "p":
                close(SAME_KIND[tag], SCOPES - {"td", "th"} if tag == "tr" else SCOPES)
        elif tag == "br":
            parts.append(" ")
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS and tag != "a":
            continue
        attrs = _attributes(m[3]) if m[3].strip() else {}
        above = stack[-1]
        holder = above if above.tag in BLOCKS else above.parent or root
        cut, mute = above.cut, above.mute
        if not (cut and mute) and _is_cut(tag, attrs, above.article):
            # what is cut inside a line leaves no block; a branch is cut after the tree has seen it
            cut, mute = (True, mute) if tag in BLOCKS else (cut, True)
        main = tag in ("article", "main") or attrs.get("role") in ("main", "article")
        article = above.article or (main and not cut and not mute)
        marked = marked or article
        label = tag + "".join("." + DIGITS.sub("0", c) for c in attrs.get("class", "").split())
        node = Node(tag, label, holder, 0, len(out.blocks), cut, mute, above.link or tag == "a", article)
        holder.children.append(label)
        if tag in BLOCKS:
            node.rank = holder.seen.get(label, 0)
            holder.seen[label] = node.rank + 1
            node.heads = tag == "h1"
            if tag in CONTAINERS:
                holder.containers.append(label)
            opened.append(node)
        else:
            holder.branches.append(label)
        stack.append(node)
    flush()
    while len(stack) > 1:
        pop()
    root.last = len(out.blocks)
    root.shape = ",".join(root.branches)
    if marked:
        out.kept = [k and i for k, i in zip(out.kept, inside, strict=True)]
    out.nodes = [o for o in opened if o.last > o.first]
    for o in opened:
        above = o.parent
        o.place = _hash(f"{above.place}>{' '.join(above.containers)}>{o.label}>{o.rank}") if above else 0
        o.article = o.article or any(inside[o.first : o.last]) if o.last > o.first else o.article
    return out


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


#: What a row tells of each of its nodes, as arrays of equal length.
FIELDS = {"place": "long", "parent": "long", "variety": "long", "shape": "long", "value": "long", "first": "int", "last": "int", "plain": "int", "kind": "int"}
#: Bits of `kind`.
CONTAINER, LEVEL, BODY, ARTICLE, HEADS = 1, 2, 4, 8, 16


def _columns(page: Page) -> tuple[np.ndarray, ...]:
    hashes = [_hash(b) for b in page.blocks]
    plain = np.concatenate([[0], np.cumsum(page.plain)])
    rows = []
    for o in page.nodes:
        value = hashes[o.first] if o.last - o.first == 1 else _hash(",".join(map(str, hashes[o.first : o.last])))
        kind = CONTAINER * (o.tag in CONTAINERS) | LEVEL * (o.tag in LEVELS or o.parent is None) | BODY * (o.tag in ("body", "html", "")) | ARTICLE * o.article | HEADS * o.heads
        form = (o.parent.place if o.parent else 0, _hash(" ".join(o.children)), _hash(o.shape)) if kind & (CONTAINER | LEVEL) else (0, 0, 0)
        rows.append((o.place, *form, value, o.first, o.last, plain[o.last] - plain[o.first], kind))
    table = np.array(rows, np.int64).reshape(-1, len(FIELDS))
    return tuple(table[:, k].astype(np.int64 if t == "long" else np.int32) for k, t in enumerate(FIELDS.values()))


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, copy, blocks, kept, nodes) of (page_id, url, host, html); `copy` is the digest of what roles leave."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for source in batch["html"]:
                page = parse(source)
                rows.append((_hash(page.text()), page.blocks, page.kept, *_columns(page)))
            yield pd.concat([batch[["page_id", "url", "host"]].reset_index(drop=True), pd.DataFrame(rows, columns=["copy", "blocks", "kept", *FIELDS])], axis=1)

    arrays = ", ".join(f"{name} array<{kind}>" for name, kind in FIELDS.items())
    out = through_pandas(pages, run, f"url string, host string, copy long, blocks array<string>, kept array<boolean>, {arrays}", "page_id")
    return out.select("page_id", "url", "host", "copy", "blocks", "kept", F.arrays_zip(*FIELDS).alias("nodes")).withColumn("row", F.monotonically_increasing_id())


def _is(bit: int, of: str = "kind") -> Column:
    return F.col(of).bitwiseAND(F.lit(bit)) != 0


def _key(place: Column, value: Column) -> Column:
    """One number for a text at a place."""
    return F.xxhash64(place, value)


def tree(found: DataFrame, scratch: Scratch, p: Params) -> tuple[DataFrame, DataFrame]:
    """The merged trees of all hosts: their places and the texts at these.

    Places: (host, place, parent, kind, m, plain, content, presentation, variety), m pages
    and three entropies as shares of log(m). Texts: (host, place, value, n). Only places
    that `least_pages` pages share are told.
    """
    one_each = scratch.save(found.groupBy("host", "copy").agg(F.min("row").alias("row")).select("row"))
    one_each = F.broadcast(one_each) if one_each.count() <= p.broadcast_rows else one_each
    each = found.select("row", "host", "nodes").join(one_each, "row", "left_semi").select("host", F.explode("nodes").alias("o")).select("host", "o.*")
    told = [F.struct(F.lit(k).alias("of"), F.col(c).alias("v")) for k, c in enumerate(("value", "shape", "variety"))]
    told = F.when(_is(CONTAINER | LEVEL), F.array(*told)).otherwise(F.array(told[0]))
    seen = each.select("host", "place", "parent", "plain", "kind", F.explode(told).alias("s")).groupBy("host", "place", "s.of", "s.v")
    seen = scratch.save(seen.agg(F.count("*").alias("n"), F.sum("plain").alias("plain"), F.min("parent").alias("parent"), F.bit_or("kind").alias("kind")))
    of = lambda k, x: F.sum(F.when(F.col("of") == k, x))
    places = seen.groupBy("host", "place").agg(
        of(0, F.col("n")).alias("m"), of(0, F.col("plain")).alias("plain"), F.min("parent").alias("parent"), F.bit_or("kind").alias("kind"), *[of(k, F.col("n") * F.log("n")).alias(f"x{k}") for k in range(3)]
    )
    entropy = lambda x: (F.log("m") - F.col(x) / F.col("m")) / F.log("m")
    places = places.where(F.col("m") >= p.least_pages)
    places = places.select("host", "place", "parent", "kind", "m", "plain", entropy("x0").alias("content"), entropy("x1").alias("presentation"), entropy("x2").alias("variety"))
    return scratch.save(places), seen.where("of = 0 and n > 1").select("host", "place", F.col("v").alias("value"), "n")


def branches(places: DataFrame, p: Params) -> DataFrame:
    """(host, place, importance) of every container whose parent is a part of the template.

    Not of those that hold a title or a marked article on any page.
    """
    level = places.where(_is(LEVEL) & (_is(BODY) | (F.col("variety") < p.most_variety))).select("host", F.col("place").alias("parent"), F.col("plain").alias("of_parent"))
    inner = places.where(_is(CONTAINER | LEVEL)).where("place <> 0").join(level, ["host", "parent"])
    # what the parent holds besides containers counts as one more branch
    beside = inner.groupBy("host", "parent").agg(F.max("plain").alias("largest"), (F.min("of_parent") - F.sum("plain")).alias("others"))
    inner = inner.where(_is(CONTAINER) & ~_is(ARTICLE | HEADS)).join(beside, ["host", "parent"])
    weight = F.least(F.lit(1.0), F.col("plain") / F.greatest(F.lit(1), "largest", "others"))
    return inner.select("host", "place", (F.col("content") * (1 - (1 - F.col("presentation")) * (1 - weight))).alias("importance"))


def unimportant(places: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """(host, key): places of branches to remove, and keys of texts to remove at their places."""
    low = branches(places, p).where(F.col("importance") < p.least_importance).select("host", F.col("place").alias("key"))
    often = texts.join(places.select("host", "place", "m", "kind"), ["host", "place"])
    limit = F.when(_is(ARTICLE), F.lit(p.repeated_in_article)).otherwise(F.lit(p.repeated))
    often = often.where(~_is(BODY) & (1 - F.log("n") / F.log("m") < limit)).select("host", _key(F.col("place"), F.col("value")).alias("key"))
    return low.unionByName(often)


def _removed(found: DataFrame, low: DataFrame, p: Params) -> DataFrame:
    """Adds `gone` to each row: the keys and places of its nodes that are removed.

    While the counted keys fit a broadcast, each host's go to its rows as one array, and no
    text is shuffled; beyond, they meet the nodes of each row, and rows are joined by number.
    """
    if low.count() <= p.broadcast_rows:
        return found.join(F.broadcast(low.groupBy("host").agg(F.collect_set("key").alias("gone"))), "host", "left")
    each = found.select("row", "host", F.explode("nodes").alias("o")).select("row", "host", F.explode(F.array(F.col("o.place"), _key(F.col("o.place"), F.col("o.value")))).alias("key"))
    return found.join(each.join(low, ["host", "key"]).groupBy("row").agg(F.collect_set("key").alias("gone")), "row", "left")


def extract(df: DataFrame, p: Params = Params(), key: str = "page_id", url: str = "url", html: str = "html", roles: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of `df`; without `roles` the tree alone decides."""
    scratch = Scratch(df.sparkSession, "html_extraction")
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    found = scratch.save(parsed(df.select(F.col(key).alias("page_id"), F.col(url).alias("url"), host.alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))))
    places, texts = tree(found, scratch, p)
    low = scratch.save(unimportant(places, texts, p))
    scratch.keep(found, low)
    out = _removed(found, low, p)
    away = F.filter("nodes", lambda o: F.array_contains("gone", o["place"]) | F.array_contains("gone", _key(o["place"], o["value"])))
    spans = F.when(F.col("gone").isNotNull(), F.transform(away, lambda o: F.struct(o["first"].alias("first"), o["last"].alias("last"))))
    out = out.select("page_id", "url", "blocks", "kept", spans.alias("spans"))
    left = F.filter("blocks", lambda b, k: (F.get("kept", k) if roles else F.lit(True)) & ~F.coalesce(F.exists("spans", lambda s: (s["first"] <= k) & (k < s["last"])), F.lit(False)))
    return out.select("page_id", "url", F.array_join(left, "\n").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
