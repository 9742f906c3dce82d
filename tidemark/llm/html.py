"""HTML extraction by minimum cut: which text blocks of a page are its article.

A page becomes a row of text blocks. A logistic classifier of a block's words, links, ending, place and neighbours gives the cost of either label; the
costs (log-odds, at most MOST) are the capacities to the terminals. Neighbouring blocks, and blocks under one parent, are tied by smoothness edges that weaken with
their distance in the DOM. The minimum cut labels all blocks at once. Blocks whose terminal outweighs all their ties are fixed first (which loses no
optimum); Dinic's maximum flow decides the rest.

The classifier is fitted on the table itself: the blocks of SAMPLE pages (those of least hash, each different page once, at most SEEDS evenly spaced blocks of
a page) that stand in HTML's own landmarks are the seeds, article and main against nav, header, footer, aside and form. Each seed teaches twice, with and without
the evidence of names, so that the words and links are learned too. The weights are the most probable ones under a normal prior around PRIOR; a
table without landmarks leaves them there.

Names (tags, classes, ids, roles) are evidence by nearness: the nearest element above a block that says anything counts in full, each further one half as much.
What says something of a whole page says little of its parts: names of an element that holds the page's article, or nearly all its text, count WRAPS
of it, and names of states (no-sidebar, comments-open) count nothing.

The scanner reads a page once, in linear time. A tag that never ends runs to the end of the page, as in HTML; script, style and other raw
elements without an end tag too, while a form control, noscript or svg that is never closed is ignored as a tag. Elements nested deeper than DEPTH are
siblings, as in browsers. Fallback content counts as text.

Cases: null and empty html, and pages without text, give an empty text; unclosed elements are closed where the next block or the end of
their parent closes them; text outside any element counts as a block; repeated rows get equal results; null ids and urls stay null; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, strings, table

_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|[!?/])")
_STOP = re.compile(r"""[>"']""")
_ATTR = re.compile(r"""([\w:-]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
_ODD = re.compile(r"[^\w\s.,;:!?'\"()-]")

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose content is no markup, and elements that hold no text of the page; the former run to the page's end if they are not closed.
RAW, SILENT = frozenset("script style xmp noembed noframes".split()), frozenset("title textarea noscript template iframe select button svg".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that group blocks.
BOXES = frozenset("html body article aside blockquote center details dialog div fieldset figure footer form header main nav section search td th".split())
#: What an opening tag closes when it is still open, and where it stops looking.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
DEPTH = 512

#: Landmarks of HTML: seeds of either label.
CONTENT_MARKS, OTHER_MARKS = frozenset(("article", "main")), frozenset(("nav", "header", "footer", "aside", "form", "search"))
#: Landmarks in which nothing is an article.
FIRM_MARKS = frozenset(("nav", "footer", "aside"))
#: Words in tag names, classes, ids and roles.
AWAY = frozenset("nav navigation navbar menu menus submenu header masthead topbar footer foot sidebar side aside rail banner cookie cookies consent gdpr notice notices alert ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion share sharing social related recommended comment comments commentlist disqus respond reply replies form search login signup subscribe newsletter popup modal overlay breadcrumb breadcrumbs pagination pager widget copyright complementary contentinfo".split())
READERS = frozenset("comment comments commentlist disqus respond reply replies".split())
TOWARD = frozenset("article main content entry post story".split())
#: Classes that begin or end so tell a state or a kind of page.
STATES, ENDS = frozenset("no not has have with without is hide show layout theme template single type format".split()), frozenset("open opened closed enabled disabled layout image left right".split())
WRAPS = 0.1

#: Features of a block, and the prior mean of their weights (log-odds of being content).
FEATURES = ("bias", "words", "links", "ending", "heading", "item", "away", "toward", "share", "near_links", "near_words", "odd")
PRIOR = (-1.5, 1.0, -4.0, 0.7, 0.7, -0.5, -6.0, 3.0, 2.5, -1.0, 0.5, -4.0)
#: Strength of the prior in seeds; pages, and seeds of a page, that the fit takes.
STRENGTH, SAMPLE, SEEDS = 20.0, 512, 64
MOST = 6.0
#: Ties of neighbours and of blocks under one parent; each step in the DOM halves the former.
TIE_NEXT, TIE_PARENT = 4.0, 0.25


class Element:
    __slots__ = ("away", "depth", "direct", "mark", "mass", "parent", "readers", "said", "tag", "toward", "wraps")

    def __init__(self, tag: str, parent: Element | None, names: set[str]):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.away, self.readers = bool(names & AWAY), bool(names & READERS) or (parent.readers if parent else False)
        self.toward = bool(names & TOWARD) and not self.away and not self.readers
        if tag == "header" and parent and parent.mark == "content":
            self.away = False  # an article's own header holds its title
        above = parent.mark if parent else None
        if above == "firm" or (tag in FIRM_MARKS and self.away):
            self.mark = "firm"
        else:
            self.mark = "content" if tag in CONTENT_MARKS and not self.away and (tag == "main" or not self.readers) else "other" if tag in OTHER_MARKS and self.away else above
        self.mass = self.direct = 0
        self.wraps, self.said = False, None


class Block:
    __slots__ = ("linked", "place", "text")

    def __init__(self, text: str, linked: int, place: Element):
        self.text, self.linked, self.place = text, linked, place


def names_of(tag: str, attributes: str) -> set[str]:
    names = {tag}
    if attributes:
        for name, value in _ATTR.findall(attributes):
            name = name.lower()
            value = value.strip("\"'")
            if name in ("class", "id", "role"):
                for word in value.split():
                    parts = [x.lower() for x in _NAME.split(word) if x]
                    if len(parts) > 1:
                        parts = [] if parts[-1] in ENDS else parts[: next((i for i, x in enumerate(parts) if x in STATES), None)]
                    if TOWARD.intersection(parts) and AWAY.intersection(parts) == {"header"}:
                        parts.remove("header")  # an entry's header holds its title
                    names.update(parts)
            elif name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "").lower()) or (name == "aria-hidden" and "true" in value):
                names.add("popup")
    if tag in ("html", "body"):
        return {tag}
    return names


class Scanner:
    """Tags of a page from left to right, each character looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.unclosed = page, set()
        self.last = {q: page.rfind(q) for q in "\"'"}

    def tag_end(self, at: int) -> int:
        """The place after the > of a tag, quoted values skipped; the page's end if there is none."""
        low = at
        while found := _STOP.search(self.page, at):
            if found[0] == ">":
                return found.end()
            k = found.start() - 1
            while k >= low and self.page[k].isspace():
                k -= 1
            at = low = found.end()
            if k >= 0 and self.page[k] == "=" and found.start() < self.last[found[0]]:
                at = low = self.page.index(found[0], at) + 1
        return len(self.page)

    def element_end(self, tag: str, at: int) -> int | None:
        """The place after the end tag, None if it never comes."""
        if tag in self.unclosed:
            return None
        found = re.compile(rf"</{tag}(?![\w-])", re.I).search(self.page, at)
        if found:
            return self.tag_end(found.end())
        self.unclosed.add(tag)
        return None

    def __iter__(self) -> Iterator[tuple[str, str, bool, str]]:
        """(text before, tag in lower case, whether it closes, attributes); an empty tag at the end."""
        page, size = self.page, len(self.page)
        start = at = 0
        while found := _OPEN.search(page, at):
            text, tag, closes, attributes = page[start : found.start()], found[2], bool(found[1]), ""
            if not tag:
                if found[0] == "<!--":
                    end = page.find("-->", found.end() - 2)
                    at = end + 3 if end >= 0 else size
                else:
                    end = page.find(">", found.end())
                    at = end + 1 if end >= 0 else size
                start = at
                if text:
                    yield text, "!", False, ""
                continue
            tag = tag.lower()
            at = self.tag_end(found.end())
            if at == size and page[-1] != ">":
                start = size
                yield text, "!", False, ""
                break
            attributes = page[found.end() : at - 1]
            if not closes and (tag in RAW or (tag in SILENT and not attributes.endswith("/"))):
                end = self.element_end(tag, at)
                at = end if end is not None else size if tag in RAW else at
                tag = "!gone"
            start = at
            yield text, tag, closes, attributes
        yield page[start:], "", False, ""


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in order, with what their elements say."""
    root = Element("", None, set())
    stack, out, elements, parts = [root], [], [root], []
    opened: dict[str, int] = {}
    linked = link = 0  # link: how deep the stack was where an open link began

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append(Block(text, linked, stack[-1]))
        parts, linked = [], 0

    def cut_to(i: int) -> None:
        nonlocal link
        for e in stack[i:]:
            opened[e.tag] -= 1
        del stack[i:]
        if link > len(stack):
            link = 0

    def close(kinds: tuple[str, ...], stops: tuple[str, ...] = ()) -> None:
        if not any(opened.get(k) for k in kinds):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in kinds:
                return cut_to(i)
            if stack[i].tag in stops:
                return

    for text, tag, closes, attributes in Scanner(page):
        if text:
            parts.append(entities.unescape(text) if "&" in text else text)
            if link:
                linked += len(parts[-1])
        if tag in BLOCKS:
            flush()
            if closes:
                close((tag,))
                continue
            if stack[-1].tag == "p" or (tag in HEADINGS and stack[-1].tag in HEADINGS):
                cut_to(len(stack) - 1)
            if tag == "hr":
                continue
            if tag in CLOSES:
                close(CLOSES[tag], STOPS[tag])
            if len(stack) > DEPTH:
                cut_to(DEPTH)
            stack.append(Element(tag, stack[-1], names_of(tag, attributes)))
            elements.append(stack[-1])
            opened[tag] = opened.get(tag, 0) + 1
        elif tag == "a":
            link = 0 if closes else len(stack)
        elif tag in ("br", "img", "input", "wbr", "!gone"):
            parts.append(" ")
    flush()
    weigh(out, elements)
    return out


def box(place: Element) -> Element:
    return place if place.tag in BOXES or place.parent is None else place.parent


def weigh(blocks: list[Block], elements: list[Element]) -> None:
    """Unlinked text by element; which elements wrap the article; (away, toward) that each element and those above it say."""
    for b in blocks:
        own = max(len(b.text) - b.linked, 0)
        b.place.mass += own
        box(b.place).direct += own
    for e in reversed(elements):
        if e.parent:
            e.parent.mass += e.mass
    article = next((e for e in elements if e.mark == "content" and e.tag in CONTENT_MARKS), None)
    title = next((e for e in elements if e.tag == "h1"), None)
    for anchor in (article, title):
        e = anchor.parent if anchor else None
        while e:
            e.wraps |= anchor is article or e.tag not in OTHER_MARKS
            e = e.parent
    total = elements[0].mass
    for e in elements:
        up = e.parent.said if e.parent else (0.0, 0.0)
        if e.away:
            weight = WRAPS if e.wraps else 1.0 if not total or e.mark == "firm" else min(1.0, max(WRAPS, 4 * (1 - e.mass / total)))
            e.said = (max(weight, up[0] / 2), up[1] * (1 - weight / 2))
        elif e.toward and e.mark in (None, "content"):
            e.said = (up[0] / 2, 1.0)
        else:
            e.said = up


def features(blocks: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block."""
    most = max((box(b.place).direct for b in blocks), default=0) or 1
    words = [min(math.log2(b.text.count(" ") + 1) / 6, 1.0) for b in blocks]
    links = [min(b.linked / len(b.text), 1.0) for b in blocks]
    out = np.empty((len(blocks), len(FEATURES)))
    for i, b in enumerate(blocks):
        near = [k for k in (i - 1, i + 1) if 0 <= k < len(blocks)] or [i]
        away, toward = b.place.said
        out[i] = (
            1.0, words[i], links[i], b.text[-1] in ".!?…:;\"'”»)", b.place.tag in HEADINGS, b.place.tag == "li", away, toward, box(b.place).direct / most,
            sum(links[k] for k in near) / len(near), sum(words[k] for k in near) / len(near), len(_ODD.findall(b.text)) / len(b.text),
        )
    return out


def seeds(page: str, most: int = SEEDS) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of blocks in landmarks, each with and without the evidence of names."""
    blocks = blocks_of(page)
    label = [1 if b.place.mark == "content" and b.place.said[0] < 0.3 else 0 if b.place.mark in ("other", "firm") else -1 for b in blocks]
    at = [i for i, y in enumerate(label) if y >= 0]
    at = [at[k * len(at) // most] for k in range(most)] if len(at) > most else at
    x, y = features(blocks)[at], np.array(label, float)[at]
    blind = x.copy()
    blind[:, [FEATURES.index("away"), FEATURES.index("toward")]] = 0
    return np.concatenate([x, blind]), np.concatenate([y, y])


def fit(x: np.ndarray, y: np.ndarray, strength: float = STRENGTH, rounds: int = 25) -> np.ndarray:
    """Weights of a logistic model, the most probable ones under a normal prior around PRIOR, by Newton's steps."""
    prior = np.array(PRIOR)
    w = prior.copy()
    loss = lambda w: np.logaddexp(0, x @ w).sum() - y @ (x @ w) + strength / 2 * ((w - prior) ** 2).sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w)), x.T @ (p - y) + strength * (w - prior))
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(step).max() < 1e-8:
            break
    return w


def odds(blocks: list[Block], weights: np.ndarray) -> list[float]:
    return np.clip(features(blocks) @ weights, -MOST, MOST).tolist() if blocks else []


def apart(a: Element, b: Element) -> int:
    """Steps between two elements of the DOM."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def ties_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    out, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            out.append((i - 1, i, TIE_NEXT * 0.5 ** apart(blocks[i - 1].place, b.place)))
        parent = b.place.parent
        if parent is not None:
            if parent in last and last[parent] < i - 1:
                out.append((last[parent], i, TIE_PARENT))
            last[parent] = i
    return out


def minimum_cut(terminal: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """True on the source's side. terminal: what labelling a node False costs more than True; ties: cost of a differing pair."""
    n = len(terminal)
    pull = list(terminal)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in ties:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if side[i] is not None or abs(pull[i]) < sum(near[i].values()) + 1e-12:
            continue
        side[i] = pull[i] > 0
        for j, w in near[i].items():
            if side[j] is None:
                pull[j] += w if side[i] else -w
                del near[j][i]
                queue.append(j)
    for first in range(n):
        if side[first] is not None:
            continue
        rest, seen = [first], {first}  # what still hangs together is cut by itself
        for i in rest:
            new = [j for j in near[i] if j not in seen and side[j] is None]
            seen.update(new)
            rest += new
        number = {i: k for k, i in enumerate(rest)}
        flow = Flow(len(rest) + 2)
        s, t = len(rest), len(rest) + 1
        for i in rest:
            flow.edge(s, number[i], max(pull[i], 0.0), 0.0)
            flow.edge(number[i], t, max(-pull[i], 0.0), 0.0)
            for j, w in near[i].items():
                if i < j and j in number:
                    flow.edge(number[i], number[j], w, w)
        reach = flow.cut(s, t)
        for i in rest:
            side[i] = reach[number[i]]
    return [bool(x) for x in side]


class Flow:
    """Dinic's maximum flow."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[float] = []

    def edge(self, a: int, b: int, there: float, back: float) -> None:
        for x, y, c in ((a, b, there), (b, a, back)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(c)

    def levels(self, s: int) -> list[int]:
        level = [-1] * len(self.out)
        level[s] = 0
        queue = deque([s])
        while queue:
            x = queue.popleft()
            for e in self.out[x]:
                y = self.to[e]
                if self.room[e] > 1e-12 and level[y] < 0:
                    level[y] = level[x] + 1
                    queue.append(y)
        return level

    def cut(self, s: int, t: int) -> list[bool]:
        """The nodes that still can be reached from s once the flow is greatest."""
        while (level := self.levels(s))[t] >= 0:
            at = [0] * len(self.out)
            path: list[int] = []
            x = s
            while True:
                if x == t:
                    least = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    k = next(k for k, e in enumerate(path) if self.room[e] <= 1e-12)
                    x = self.to[path[k] ^ 1]
                    del path[k:]
                    continue
                while at[x] < len(self.out[x]):
                    e = self.out[x][at[x]]
                    if self.room[e] > 1e-12 and level[self.to[e]] == level[x] + 1:
                        break
                    at[x] += 1
                if at[x] < len(self.out[x]):
                    path.append(e)
                    x = self.to[e]
                elif path:
                    x = self.to[path.pop() ^ 1]
                    at[x] += 1
                else:
                    break
        return [v >= 0 for v in level]


def main_text(page: str, weights=PRIOR) -> str:
    blocks = blocks_of(page)
    label = minimum_cut(odds(blocks, np.asarray(weights)), ties_of(blocks))
    return "\n".join(b.text for b, x in zip(blocks, label) if x)


def learn(pages: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights fitted on `sample` different pages; at most 2 SEEDS rows of each come to the driver."""
    small_batches(pages.sparkSession)
    rows = pages.where("html IS NOT NULL").select(F.xxhash64("html").alias("h"), "html")
    last = rows.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if last is None:
        return np.array(PRIOR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: set[int] = set()
        for batch in batches:
            found = []
            for h, page in zip(batch.column("h").to_pylist(), strings(batch, "html")):
                if h not in before:
                    before.add(h)
                    x, y = seeds(page)
                    found.append((h, x.tobytes(), y.tobytes()))
            if found:
                h, x, y = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(x, pa.binary()), pa.array(y, pa.binary())], names=["h", "x", "y"])

    each = sorted(rows.where(F.col("h") <= last).mapInArrow(run, "h bigint, x binary, y binary").dropDuplicates(["h"]).collect())
    return fit(np.frombuffer(b"".join(r.x for r in each)).reshape(-1, len(FEATURES)), np.frombuffer(b"".join(r.y for r in each)))


def extract(pages: DataFrame, weights: np.ndarray) -> DataFrame:
    """pages (page_id, url, html) to page_id, url, text, n_chars."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(h, weights) for h in strings(batch, "html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars bigint")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, learn(pages))
