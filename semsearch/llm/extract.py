"""Main text of web pages as the maximum-scoring run of words and tags."""

from __future__ import annotations

import html as html_lib
import math
import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tags inside a line of text; every other tag starts a new block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Tags without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp")
#: Those that start a new block; the others may stand inside a line.
RAW_BLOCKS = frozenset(("xmp",))
#: Elements that never hold main text, by name or role, or by a word of their class or id.
ASIDE = frozenset("nav footer aside form head menu dialog select button object canvas fieldset datalist applet audio video map".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "copyright discussion disqus footer gdpr header login masthead menu menus modal nav navbar navigation navi newsletter notice notices notification outbrain "
    "overlay pager pagination popup promo promotion promoted reader-comments recommended related replies reply respond responses share sharing sidebar sidebars "
    "signup skip social sponsor sponsored subscribe subscription taboola teaser toolbar topbar warning widget widgets".split()
)
#: Elements that label the main text of a page.
CONTAINER = frozenset(("article", "main"))

#: Pages that the weights are learned from at most, and the largest penalty of a tag.
LABELLED_PAGES, MOST_PENALTY, LEAST_PENALTY = 2000, 2.0, 0.05
#: What a word gains at most by standing in a container, and loses by standing outside one that its page has.
CONTAINER_GAIN, CONTAINER_LOSS = 1.5, 0.5

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|template|iframe|svg|xmp)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|([^<]+|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?""")
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Words of a class that tell of a page's state, not of what the element is.
STATE_WORDS = frozenset("no not non without with has have is enabled disabled".split())


def _attributes(attributes: str) -> dict[str, str]:
    """Lower-case names with their values; the first of equal names counts."""
    found: dict[str, str] = {}
    for key, value in _ATTRIBUTE.findall(attributes):
        found.setdefault(key.lower(), value[1:-1] if value[:1] in ("'", '"') else value)
    return found


def _is_aside(name: str, attributes: dict[str, str], in_container: bool) -> bool:
    """Whether an element holds no main text, from its name, its role or its being hidden."""
    if name in ASIDE or (name == "header" and not in_container):
        return True
    if name in ("html", "body"):
        return False
    return "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or attributes.get("role", "").lower() in ASIDE_ROLES


def _may_be_aside(name: str, attributes: dict[str, str]) -> bool:
    """Whether an element's class or id speaks of a menu, an advert or the like; it is one unless it holds most of the page."""
    if name in ("html", "body") or name in CONTAINER:
        return False
    for part in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = [w.lower() for w in (part, *_NAME_WORDS.findall(part))]
        if not ASIDE_WORDS.isdisjoint(words) and STATE_WORDS.isdisjoint(words):
            return True
    return False


class Page:
    """A page as a list of runs: ("tag", name, in container, in aside) or ("text", text, in container, in aside, block number, block tag)."""

    def __init__(self, html: str):
        self.runs: list[tuple] = []
        self.has_container = False
        open_tags: list[tuple[str, bool, int]] = []
        open_blocks: list[int] = []  # places of block tags among them
        places: dict[str, list[int]] = {}  # of each name
        asides = containers = block = n_words = 0
        maybe: list[list[int]] = []  # of elements that may be asides: first and last run, words before and at the end

        def close(k: int) -> None:
            nonlocal asides, containers
            for name, aside, of in open_tags[k:]:
                places[name].pop()
                asides -= aside
                containers -= name in CONTAINER and not aside
                if of >= 0:
                    maybe[of] += [len(self.runs), n_words]
            del open_tags[k:]
            while open_blocks and open_blocks[-1] >= k:
                open_blocks.pop()

        for raw, end1, name1, attributes1, end2, name2, attributes2, text in _TOKEN.findall(html):
            name = (name1 or name2).lower()
            if text:
                tag = open_tags[open_blocks[-1]][0] if open_blocks else ""
                self.runs.append(("text", text, containers > 0, asides > 0, block, tag))
                n_words += 0 if asides else len(text.split())
            elif raw:
                block += raw.lower() in RAW_BLOCKS
            elif name:
                if name not in INLINE:
                    block += 1
                if name == "br":
                    self.runs.append(("text", " ", containers > 0, asides > 0, block, ""))
                self.runs.append(("tag", name, containers > 0, asides > 0))
                if end1 or end2:
                    if places.get(name):
                        close(places[name][-1])
                elif name not in VOID:
                    if name not in INLINE:  # a new block ends an open paragraph, a new item an open item
                        last = open_tags[open_blocks[-1]][0] if open_blocks else ""
                        if last == "p" or last == name and name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                            close(open_blocks[-1])
                    attributes = _attributes(attributes1 or attributes2)
                    aside, of = _is_aside(name, attributes, containers > 0), -1
                    if not aside and not asides and _may_be_aside(name, attributes):
                        of = len(maybe)
                        maybe.append([len(self.runs), n_words])
                    places.setdefault(name, []).append(len(open_tags))
                    if name not in INLINE:
                        open_blocks.append(len(open_tags))
                    open_tags.append((name, aside, of))
                    asides += aside
                    containers += name in CONTAINER and not aside
        close(0)
        # an element that holds most words of the page is its main text, whatever its class
        change = [0] * (len(self.runs) + 1)
        for start, before, stop, after in maybe:
            if 2 * (after - before) < n_words:
                change[start] += 1
                change[stop] -= 1
        for i, (run, depth) in enumerate(zip(self.runs, accumulate(change))):
            if depth and not run[3]:
                self.runs[i] = run = (*run[:3], True, *run[4:])
            self.has_container |= run[2] and not run[3]


def learned_counts(html: str) -> dict[str, tuple[int, int]]:
    """How often each tag, and words under each block tag, stand in (or out of) the container of a labelled page."""
    page, counts = Page(html), {}
    if not page.has_container:
        return counts
    for kind, what, inside, aside, *at in page.runs:
        key, n = (f"word {at[1]}", len(what.split())) if kind == "text" else (f"tag {what}", 1)
        if n and not aside and not (kind == "tag" and what in CONTAINER):
            a, b = counts.get(key, (0, 0))
            counts[key] = (a + n * inside, b + n * (not inside))
    return counts


def weights_of(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Log-odds of standing in the main text: tags cost at least a little, words under tags of the main text gain."""
    odds = {k: math.log((a + 1) / (b + 1)) for k, (a, b) in counts.items()}
    tags = {k: -min(MOST_PENALTY, max(LEAST_PENALTY, -v)) for k, v in odds.items() if k.startswith("tag ")}
    return tags | {k: max(-1.0, min(1.0, v)) for k, v in odds.items() if k.startswith("word ")}


def container_counts(html: str, weights: dict[str, float]) -> dict[str, tuple[int, int]]:
    """How many words in and out of the container of a labelled page the weights alone would take, and not."""
    page, counts = Page(html), {}
    if not page.has_container:
        return counts
    start, stop = best_run(page, weights)
    for i, (kind, what, inside, aside, *_) in enumerate(page.runs):
        if kind == "text" and not aside:
            key, n = f"container {'in' if inside else 'out'}", len(what.split())
            a, b = counts.get(key, (0, 0))
            counts[key] = (a + n * (start <= i < stop), b + n * (not start <= i < stop))
    return counts


def learn_weights(pages: DataFrame, html_col: str = "html", most: int = LABELLED_PAGES) -> dict[str, float]:
    """Weights from at most ``most`` pages that label their main text with ``article`` or ``main``.

    The pages with the smallest hashes are taken; only the counts per tag name of
    HTML come to the driver.
    """
    labelled = pages.where(F.lower(html_col).rlike("<(article|main)[ >]")).select(html_col, F.xxhash64(html_col).alias("_h"))
    bar = labelled.select("_h").orderBy("_h").limit(most).agg(F.max("_h")).first()[0]
    if bar is None:
        return {}

    taken = labelled.where(F.col("_h") <= bar).select(html_col)

    def counted(of_page):
        def count(batches):
            total = {}
            for batch in batches:
                for html in batch.column(0).to_pylist():
                    for k, (a, b) in of_page(html).items():
                        if re.fullmatch(r"\w+ [a-z0-9]{0,10}", k):
                            x, y = total.get(k, (0, 0))
                            total[k] = (x + a, y + b)
            yield pa.RecordBatch.from_pylist([{"k": k, "a": a, "b": b} for k, (a, b) in total.items()], schema=pa.schema([("k", pa.string()), ("a", pa.int64()), ("b", pa.int64())]))

        sums = taken.mapInArrow(count, "k string, a long, b long").groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        return {r.k: (r.a, r.b) for r in sums.orderBy(F.desc(F.col("a") + F.col("b")), "k").limit(400).collect()}

    weights = weights_of(counted(learned_counts))
    agreed = counted(lambda html: container_counts(html, weights))
    odds = {k: math.log((a + 1) / (b + 1)) for k, (a, b) in agreed.items()}
    return weights | {k: max(0.0, min(CONTAINER_GAIN, v)) if k == "container in" else max(-CONTAINER_LOSS, min(0.0, v)) for k, v in odds.items()}


def gains(page: Page, weights: dict[str, float]) -> list[float]:
    """What each run of a page adds to a region that holds it."""
    out = []
    for kind, what, inside, aside, *at in page.runs:
        if aside:  # never returned; its words part what stands around them, unless that is one container
            out.append(0.0 if inside or kind == "tag" else -0.2 * len(what.split()))
        elif kind == "tag":
            light = what in INLINE or inside or what in CONTAINER
            out.append(weights.get(f"tag {what}", -LEAST_PENALTY if light else -0.5))
        else:
            weight = weights.get(f"word {at[1]}", 1.0)
            if page.has_container:
                weight += weights.get("container in" if inside else "container out", 0.0)
            out.append(len(what.split()) * max(-1.0, min(1.0, weight)))
    return out


def best_run(page: Page, weights: dict[str, float]) -> tuple[int, int]:
    """The first and last+1 of the page's runs with the highest sum of gains, by one scan."""
    best, best_at, score, start = 0.0, (0, 0), 0.0, 0
    for i, gain in enumerate(gains(page, weights)):
        if score <= 0:
            score, start = 0.0, i
        score += gain
        if score > best:
            best, best_at = score, (start, i + 1)
    return best_at


def main_text(html: str | None, weights: dict[str, float]) -> str:
    """The text of the best region: blocks joined by a line feed, white space in a block as one blank."""
    if not html:
        return ""
    page = Page(html)
    blocks: dict[int, list[str]] = {}
    for run in page.runs[slice(*best_run(page, weights))]:
        if run[0] == "text" and not run[3]:
            blocks.setdefault(run[4], []).append(run[1])
    texts = (" ".join(html_lib.unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n".join(t for t in texts if t)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: dict[str, float] | None = None) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars (code points).

    Words score by the tag they stand under, more in an ``article`` or ``main`` and
    less outside those that the page has; tags, and words of menus, adverts and the
    like, score negative.  One scan finds the run with the highest sum; of its blocks those that are not of
    menus, adverts and the like are returned.  ``weights`` default to those learned from the
    labelled ones among the pages.  A null, empty or textless page gives an empty
    text; repeated rows are extracted as often as they occur.  Other columns are not read.
    """
    pages = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    weights = learn_weights(pages) if weights is None else weights

    def run(batches):
        for batch in batches:
            texts = [main_text(h, weights) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
