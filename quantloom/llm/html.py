"""Main text of web pages by wrappers inferred per host.

A page is a stream of tags and texts. The pages of a host are aligned, one after the other, into one wrapper: a
union-free regular expression for the content of every path of tags. A child that a page lacks becomes optional, one
that comes again and again a repeated group, children that come in either order a repeated group of optionals, and
texts that differ become text slots; a text that all pages of the host have at its path stays constant. Every task
folds its pages into a wrapper for each host, and the wrappers of the tasks are merged, so all pages of a host count
and none of its pages has to meet another. A page is then read through the wrapper of its host: constants are the
template's and go, slots are the page's, and of these the ones in the article, menus and the like excepted, are the
main text.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, cut_lineage

from .urls import url_host

#: Different pages of a host that are needed to tell constants from slots.
MIN_PAGES = 6
#: Hosts for which a task holds a wrapper before it passes them on.
FLUSH_HOSTS = 2_000
#: Levels of nested elements that are told apart.
MAX_DEPTH = 256
#: Of a page's slot text the share that the container of a page without an article holds.
CONTAINER_SHARE = 0.6

# HTML element classes.
RAW_TEXT = {"script", "style", "noscript", "template", "iframe", "svg", "math", "textarea", "title", "object", "canvas", "select", "button", "video", "audio"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "table", "ul"}
OUTSIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "search"}
OUTSIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
OUTSIDE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsbygoogle", "sponsor", "sponsored", "promo", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay", "newsletter", "subscribe", "signup",
    "sidebar", "widget", "related", "recommended", "share", "sharing", "social", "breadcrumb", "breadcrumbs", "menu", "nav", "navbar", "navigation", "pagination", "pager", "masthead", "footer", "comment", "comments", "disqus", "reply", "replies", "respond", "login", "toolbar", "header",
}
COMMENT_WORDS = {"comment", "comments", "disqus", "reply", "replies", "respond"}
#: Parts of class names that tell a state of the element: "has-sidebar" is no sidebar, "comments-open" no comment.
STATE_WORDS = {"has", "have", "with", "without", "no", "not", "is", "show", "hide", "hides", "single", "open", "closed", "enabled", "disabled", "free"}

_MARKUP = re.compile(r"<!--.*?-->|<!--[^>]*>?|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")


def _named(value: str) -> set[str]:
    """What a class or id attribute names: its whole names, and the parts of those that don't tell a state."""
    words = set()
    for name in value.split():
        parts = set(re.split(r"[^a-z0-9]+", name))
        words |= {name} if parts & STATE_WORDS else parts
    return words


def _label(tag: str, attributes: str) -> tuple[str, bool]:
    """The tag, with ``!`` if by tag, role, class or id it is no part of an article, and ``!!`` for reader comments and what is hidden.

    The flag tells that only class or id say so. The page, its body and main are never marked by them, and an article
    only where it is called a comment by a whole name.
    """
    words, names, role, hidden = set(), set(), "", False
    if attributes:
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id"):
                words |= _named(value)
                names.update(value.split())
            elif name == "role":
                role = value
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                hidden = True
    if tag in ("main", "html", "body") or (tag == "article" and not names & COMMENT_WORDS):
        return (f"{tag}!!" if hidden else tag), False
    if hidden:
        return f"{tag}!!", False
    hard = tag in OUTSIDE or role in OUTSIDE_ROLES
    if words & COMMENT_WORDS:
        return f"{tag}!!", not hard
    outside = hard or bool(words & OUTSIDE_WORDS)
    return (f"{tag}!" if outside else tag), not hard


@dataclass(eq=False)
class Element:
    """A tag of a page: ``soft`` if only class or id mark it, ``chars`` of text in it that no tag, role or hiding excludes."""

    tag: str
    label: str
    soft: bool
    above: Element | None = None
    chars: int = 0
    parts: list = field(default_factory=list)  # elements, and for each block of text None
    depth: int = 0

    def open(self, tag: str, label: str, soft: bool) -> Element:
        """A new element in this one; as in browsers, what is nested too deep lies beside instead."""
        if self.depth >= MAX_DEPTH:
            return self
        made = Element(tag, label, soft, self, depth=self.depth + 1)
        self.parts.append(made)
        return made

    def line(self) -> list[Element]:
        """The element and those above it, the outermost first."""
        out, e = [], self
        while e is not None:
            out.append(e)
            e = e.above
        return out[::-1]


def read_page(page: str) -> tuple[Element, list[tuple[Element, str]]]:
    """The root, and (element, text) of every block with text, in page order: references decoded, white space folded.

    Images, input fields and the like don't end a block, nor does inline markup; inline elements that are marked as no
    part of an article leave the block. A mark that only a class or id gives is taken back where the element holds most
    of the text that no tag, role or hidden attribute excludes. Only that of comments stays then, if an unmarked
    article or main has text.
    """
    root = at_element = Element("", "", False)
    out: list[tuple[Element, str]] = []
    held: list[tuple[str, Element]] = []

    def end_block() -> None:
        if not held:
            return
        # what is marked within the block leaves it, unless there is nothing else
        block = next((e for _, e in held if e.tag not in INLINE), at_element)
        while block.tag in INLINE and block.above is not None:
            block = block.above
        own = "".join(t for t, e in held if e.tag not in INLINE)
        place = block if own.strip() else held[0][1]
        text = " ".join(entities.unescape(own if own.strip() else "".join(t for t, _ in held)).split())
        held.clear()
        if text:
            out.append((place, text))
            place.parts.append(None)
            line = place.line()
            if not any(e.label.endswith("!") and not e.soft for e in line):
                for e in line:
                    e.chars += len(text)

    def close(tag: str) -> None:
        nonlocal at_element
        e = at_element
        while e.above is not None and e.tag != tag:
            e = e.above
        if e.above is not None:
            at_element = e.above

    at, size = 0, len(page)
    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            held.append((page[at:], at_element))
            break
        if begin > at:
            held.append((page[at:begin], at_element))
        m = _MARKUP.match(page, begin)
        if not m:  # a lone "<" is text, unless a tag begins that never ends
            if re.match(r"</?[a-zA-Z!]", page[begin : begin + 3]):
                break
            held.append(("<", at_element))
            at = begin + 1
            continue
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag or (tag in VOID and tag not in ("br", "hr")):
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in RAW_TEXT:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else (size if tag in ("script", "style") else at)
            continue
        if tag in INLINE:  # only marked ones are elements here
            if not closing and attributes and (label := _label(tag, attributes))[0] != tag:
                at_element = at_element.open(tag, *label)
            elif closing and any(e.tag == tag for e in at_element.line()) and at_element.tag in INLINE:
                close(tag)
            continue
        end_block()
        if tag in VOID:
            continue
        if closing:
            close(tag)
            continue
        if tag in CLOSES_P and at_element.tag == "p":
            at_element = at_element.above
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and at_element.tag == tag:
            at_element = at_element.above
        label, soft = _label(tag, attributes)
        if tag in ("article", "main") and label == tag and not any(e.label.endswith("!!") for e in at_element.line()):
            while at_element.label.endswith("!"):  # of an element before it that was never closed
                at_element = at_element.above
        at_element = at_element.open(tag, label, soft)
    end_block()
    lines = [e.line() for e, _ in out]
    told = any(any(e.tag in ("article", "main") for e in line) and not any(e.label.endswith("!") for e in line) for line in lines)
    for line in lines:
        for e in line:
            if e.soft and 2 * e.chars > root.chars and not (told and e.label.endswith("!!")):
                e.label = e.tag
    return root, out


def path_of(element: Element) -> str:
    return "/".join(e.label for e in element.line()[1:])


def text_key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


@dataclass
class Model:
    """The content of one path: a chain of children, of which those are optional that fewer than all elements have.

    ``loop`` if children came in either order: the chain is a repeated group of optionals. ``texts`` are the keys of the
    texts that all pages with this path have there.
    """

    elements: int = 0
    pages: int = 0
    loop: bool = False
    order: list[str] = field(default_factory=list)
    seen: dict[str, int] = field(default_factory=dict)  # elements that have the child
    repeated: dict[str, bool] = field(default_factory=dict)
    texts: list[int] | None = None

    def align(self, children: list[str]) -> None:
        """Take in the children of one element, or the chain of another model, in order."""
        last = -1
        for child in children:
            at = self.order.index(child) if child in self.seen or child in self.order else -1
            if at < 0:
                last += 1
                self.order.insert(last, child)
            else:
                self.loop |= at < last
                last = max(at, last)

    def keep_texts(self, keys: list[int]) -> None:
        self.texts = sorted(set(keys) if self.texts is None else set(self.texts).intersection(keys))


class Wrapper:
    """A union-free expression for the pages of a host: a Model for every path, and some pages to tell how many differ."""

    def __init__(self, spec: str | None = None):
        held = json.loads(spec) if spec else {"pages": 0, "different": [], "models": {}}
        self.pages, self.different = held["pages"], held["different"]
        self.models = {path: Model(**m) for path, m in held["models"].items()}

    def spec(self) -> str:
        return json.dumps({"pages": self.pages, "different": self.different, "models": {p: m.__dict__ for p, m in self.models.items()}})

    def take(self, page: str) -> None:
        """Align one more page."""
        root, found = read_page(page)
        texts: dict[str, list[int]] = {}
        for element, text in found:
            texts.setdefault(path_of(element), []).append(text_key(text))
        self._differs([text_key("\n".join(t for _, t in found))])
        self.pages += 1
        open_, paths = [(root, "")], set()
        while open_:
            element, path = open_.pop()
            children = [c for c in element.parts if c is None or c.chars or c.parts]
            model = self.models.setdefault(path, Model())
            labels = ["#" if c is None else c.label for c in children]
            folded = [x for k, x in enumerate(labels) if not k or labels[k - 1] != x]
            model.elements += 1
            model.align(folded)
            for x in set(labels):
                model.seen[x] = model.seen.get(x, 0) + 1
                model.repeated[x] = model.repeated.get(x, False) or labels.count(x) > 1
            if path not in paths:
                paths.add(path)
                model.pages += 1
                if path in texts:
                    model.keep_texts(texts[path])
            open_ += [(c, f"{path}/{c.label}" if path else c.label) for c in children if c is not None]

    def merge(self, other: Wrapper) -> None:
        """Align the wrapper of other pages of the host."""
        self.pages += other.pages
        self._differs(other.different)
        for path, theirs in other.models.items():
            own = self.models.setdefault(path, Model())
            own.elements, own.pages, own.loop = own.elements + theirs.elements, own.pages + theirs.pages, own.loop or theirs.loop
            own.align(theirs.order)
            for x, n in theirs.seen.items():
                own.seen[x] = own.seen.get(x, 0) + n
                own.repeated[x] = own.repeated.get(x, False) or theirs.repeated[x]
            if theirs.texts is not None:
                own.keep_texts(theirs.texts)

    def _differs(self, keys: list[int]) -> None:
        self.different = sorted({*self.different, *keys})[:MIN_PAGES]

    def expression(self) -> str:
        """The expression: ``?`` optional, ``+`` repeated, ``*`` both, ``#`` text."""
        made: dict[str, str] = {}
        for path in sorted(self.models, key=lambda p: -p.count("/") - bool(p)):  # the innermost first
            model, parts = self.models[path], []
            for x in model.order:
                below = made.get(f"{path}/{x}" if path else x, "") if x != "#" else ""
                optional, again = model.seen[x] < model.elements, model.repeated[x]
                parts.append(f"{x}{f'({below})' if below else ''}{'*' if optional and again else '?' if optional else '+' if again else ''}")
            made[path] = f"({' '.join(parts)})*" if model.loop else " ".join(parts)
        return made.get("", "")

    def constants(self) -> dict[str, list[int]]:
        """By path the keys of the texts that are the template's: every page of the host that has the path has them there."""
        if len(self.different) < MIN_PAGES:
            return {}
        return {p: m.texts for p, m in self.models.items() if m.texts and m.pages >= MIN_PAGES}


@lru_cache(maxsize=512)
def _constants(spec: str | None) -> dict[str, frozenset[int]]:
    return {p: frozenset(keys) for p, keys in json.loads(spec).items()} if spec else {}


def main_text(page: str | None, spec: str | None = None) -> str:
    """The slots of a page's article, joined by line breaks; ``spec``: the constants of its host's wrapper.

    An unmarked article, or else main, is the content; without them it is the lowest element that holds
    CONTAINER_SHARE of the slot text. Constants that are most of the content's text are no template and stay.
    """
    if not page:
        return ""
    constants = _constants(spec)
    root, found = read_page(page)
    lines = [[e for e in element.line() if e.above is not None] for element, _ in found]
    inside = [k for k, line in enumerate(lines) if not any(e.label.endswith("!") for e in line)]
    slot = {k: text_key(found[k][1]) not in constants.get(path_of(found[k][0]), ()) if constants else True for k in inside}
    for tag in ("article", "main"):
        content = [k for k in inside if any(e.tag == tag for e in lines[k])]
        if content:
            break
    else:
        weights: dict[int, int] = {}
        for k in inside:
            for e in lines[k]:
                weights[id(e)] = weights.get(id(e), 0) + len(found[k][1]) * slot[k]
        total = sum(len(found[k][1]) * slot[k] for k in inside)
        large = {e for e, n in weights.items() if n >= CONTAINER_SHARE * total}
        holders = [e for k in inside for e in lines[k] if id(e) in large and e.tag not in ("p", "li", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6")]
        lowest = max(holders, key=lambda e: len(e.line()), default=None)
        content = [k for k in inside if lowest is None or any(e is lowest for e in lines[k])]
    kept = [k for k in content if slot[k]]
    if 2 * sum(len(found[k][1]) for k in kept) < sum(len(found[k][1]) for k in content):
        kept = content
    return "\n".join(found[k][1] for k in kept)


def host_wrappers(pages: DataFrame) -> DataFrame:
    """(host, pages, constants, expression) of the wrapper of each host, from all its pages.

    Tasks fold their pages; what they made of a host is merged in up to 256 parts and then once.
    """
    keyed = pages.where("html is not null").select(url_host(F.col("url")).alias("host"), "html")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Wrapper] = {}
        out = lambda: pd.DataFrame({"host": list(held), "wrapper": [w.spec() for w in held.values()]})
        for frame in frames:
            for host, page in zip(frame["host"], frame["html"], strict=True):
                held.setdefault(host, Wrapper()).take(page)
            if len(held) > FLUSH_HOSTS:
                yield out()
                held.clear()
        if held:
            yield out()

    def merged(frame: pd.DataFrame) -> Wrapper:
        whole = Wrapper()
        for spec in sorted(frame["wrapper"]):
            whole.merge(Wrapper(spec))
        return whole

    def partly(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "wrapper": [merged(frame).spec()]})

    def wholly(frame: pd.DataFrame) -> pd.DataFrame:
        w = merged(frame)
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "pages": [w.pages], "constants": [json.dumps(w.constants())], "expression": [w.expression()]})

    folded = keyed.mapInPandas(fold, "host string, wrapper string").withColumn("part", F.spark_partition_id() % 256)
    folded = folded.groupBy("host", "part").applyInPandas(partly, "host string, wrapper string")
    return folded.groupBy("host").applyInPandas(wholly, "host string, pages long, constants string, expression string")


def extract_main_text(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text and n_chars (code points).

    text has the blocks of the article in page order, joined by \\n, each with character references decoded, white
    space folded and trimmed. Null or empty html, and pages without content, give an empty text. Pages without a url
    share one wrapper; repeated rows stay repeated; an empty table gives an empty result.
    """
    wrappers = cut_lineage(host_wrappers(pages).where("constants != '{}'").select("host", "pages", "constants"))
    total = wrappers.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    keyed = pages.select("page_id", "url", "html", url_host(F.col("url")).alias("host"))
    # the hosts with a thousandth of the pages or more, 1,000 at most, go to all tasks; their pages are not dealt by host
    large = F.broadcast(wrappers.where(F.col("pages") >= total // 1000 + 1).select("host", F.col("constants").alias("first")))
    small = wrappers.where(F.col("pages") < total // 1000 + 1).select(F.col("host").alias("key"), F.col("constants").alias("second"))
    joined = keyed.join(large, "host", "left").withColumn("key", F.when(F.col("first").isNull(), F.col("host")).otherwise(F.concat_ws(" ", F.lit(""), F.xxhash64("page_id", "url"))))
    joined = joined.join(bounded_broadcast(small), "key", "left").withColumn("constants", F.coalesce("first", "second"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [main_text(h, c) for h, c in zip(frame["html"], frame["constants"], strict=True)]
            yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    id_type = pages.schema["page_id"].dataType
    made = joined.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "constants").mapInPandas(read, "page_id string, url string, text string, n_chars long")
    return made.withColumn("page_id", F.col("page_id").cast(id_type))
