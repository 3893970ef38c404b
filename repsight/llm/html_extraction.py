"""#3 HTML extraction by consensus host paths.

Pass one parses every page, scores its containers by the text of their
paragraph-like blocks (less link text) and emits the generalised tag-class
paths of the best ones. Spark sums the votes per host and path, with partial
aggregation before the shuffle, and picks each host's path. Pass two joins the
pages with their host's path and extracts the page's own main text (its best
container and what belongs to it elsewhere: title, lead, further containers)
and the text of the elements on the host's path, in page order.

Edge cases: null and empty html give an empty text; a null or unusual url has
the host ''; null page_ids and repeated rows are extracted row by row; further
columns are ignored, whatever their names; an empty table gives an empty table.
Unclosed and stray tags, inline text outside any block, quoted ``>`` in
attributes, comments and unterminated scripts are handled by the small
tokenizer below; it reads any length of page in one pass, and an element holds
its own name and a number for its path, so memory follows the page, not its
depth. Elements marked ``hidden`` or styled ``display: none`` or ``visibility:
hidden`` are dropped. Html is shuffled only where the table of host paths is
larger than ``BROADCAST_BYTES``, and then hosts with many pages are spread.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .spread import left_join_spread

#: Bytes of all hosts' names and paths up to which their table is broadcast.
BROADCAST_BYTES = 16 << 20

# Element classes of HTML.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head script style noscript template iframe object svg math canvas audio video textarea title button select option label noembed noframes xmp".split())
#: Boilerplate by tag; a form that holds the page's text is unwrapped, a header inside an article is part of it.
MARKED = frozenset("nav header footer aside form fieldset dialog menu".split())
UNWRAPPED = frozenset("form fieldset".split())
BLOCKS = frozenset("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote table caption thead tbody tfoot tr td th figure figcaption address details summary center hr nav header footer aside form fieldset hgroup dialog menu".split())
CONTAINERS = frozenset("body article main section div td center".split())
ENDS_P = BLOCKS - {"td", "th", "caption", "thead", "tbody", "tfoot", "tr", "li", "dt", "dd", "html", "body"}
#: A class, id or role with one of these words marks boilerplate.
BOILERPLATE = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie
cookies disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup
promo promoted promotion recommended related reply replies share sharing sidebar skip social sponsor sponsored subscribe toolbar widget
complementary contentinfo search alert""".split())
#: A class or id with one of these words names what a wrapper has (no-sidebar, with-header), and these make a header one of the text (entry-header).
LAYOUT = frozenset("no not has have with without hide hides show shows is".split())
OF_TEXT = frozenset("entry section post article story content page chapter".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_WORDS = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])")
#: Characters of a text that is more than a line of a page's frame.
LEAST_TEXT = 60
_DIGITS = re.compile(r"\d+")
_QUOTED = re.compile(r""""[^"]*"|'[^']*'""")
_IS_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)")
_UNSEEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
#: Words beside a boilerplate word in a name that only say where or what kind of box it is (site-footer, cookie-bar).
OF_FRAME = frozenset("""a all area bar bars block body bottom box btn button buttons center col column container content count counter date display dialog div field fixed
footer form global grid group head heading holder icon icons image img index info inline inner input item items js label large layout left link links list local main
media menu message meta mini mobile module nav new news ng overlay page panel pane placeholder policy post primary right row secondary section sections sign signup site
slot small sticky sub tab tabs tag tags text thread title top ui unit up view widget wrap wrapper wrappers zone #""".split())
#: Words a block of prose has on average.
PROSE_WORDS = 20


class Element:
    """An open or closed element: its name and path's number, whether it is dropped, its nearest mark as boilerplate, its score as a container."""

    __slots__ = ("tag", "name", "key", "dropped", "link", "parent", "score", "marked", "weak", "held", "n", "title", "linked", "words", "first", "last")

    def __init__(self, tag: str, name: str, dropped: bool, link: bool, parent: Element | None, marked: bool = False, weak: bool = False) -> None:
        self.tag, self.name, self.dropped, self.link, self.parent, self.score = tag, name, dropped, link, parent, 0.0
        self.key = hash((parent.key if parent is not None else 0, name))
        self.marked = self if marked else parent.marked if parent is not None else None
        self.weak = weak
        self.held, self.n, self.title, self.linked, self.words, self.first, self.last = 0.0, 0, False, 0, 0, -1, -1

    @property
    def path(self) -> str:
        """The generalised tag-class path, built when asked for."""
        names, e = [], self
        while e is not None:
            names.append(e.name)
            e = e.parent
        return ">".join(reversed(names))

    def marks(self) -> Iterator[Element]:
        """The marked elements it stands in, itself included, from the inside out."""
        e = self.marked
        while e is not None:
            yield e
            e = e.parent.marked if e.parent is not None else None


def path_key(path: str) -> int:
    """The number of the elements with this path, in this process."""
    key = 0
    for name in path.split(">"):
        key = hash((key, name))
    return key


@lru_cache(maxsize=1 << 14)
def _names_boilerplate(name: str) -> int:
    """0: no; 1: a name whose other words could make it one of the text (related-work); 2: yes; 3: a header, which counts outside the text only."""
    words = {_DIGITS.sub("#", w.lower()) for w in _WORDS.split(name) if w}
    found = words & BOILERPLATE
    if not found or not words.isdisjoint(LAYOUT) or (found == {"header"} and not words.isdisjoint(OF_TEXT)):
        return 0
    if words == {"header"}:
        return 3
    return 2 if words <= BOILERPLATE | OF_FRAME else 1


def _of_text(e: Element | None) -> bool:
    """Whether an element stands in an article: by tag, or by a class that names one."""
    while e is not None:
        if e.tag in ("article", "main", "section") or not OF_TEXT.isdisjoint(w for c in e.name.split(".")[1:] for w in _WORDS.split(c)):
            return True
        e = e.parent
    return False


def _hidden(attributes: str) -> bool:
    low = attributes.lower()
    return ("hidden" in low and _IS_HIDDEN.search(_QUOTED.sub("", low)) is not None) or ("style" in low and _UNSEEN.search(low) is not None)


def _open(tag: str, attributes: str, parent: Element | None) -> Element:
    name, marked, weak, hidden = tag, tag in MARKED, False, False
    if tag == "header":
        up = parent
        while up is not None and up.tag not in ("article", "main", "section"):
            up = up.parent
        marked = up is None
    if attributes and tag not in ("html", "body", "main", "article"):
        found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
        kinds = {_names_boilerplate(n) for k in ("class", "id", "role") for n in found.get(k, "").split()}
        named = 2 in kinds or (3 in kinds and not _of_text(parent))
        weak = not marked and not named and 1 in kinds
        marked = marked or named or weak
        classes = sorted({_DIGITS.sub("#", c.lower()) for c in found.get("class", "").split()})
        name += "".join("." + c for c in classes)
        hidden = _hidden(attributes)
    return Element(tag, name, hidden or tag in DROPPED or (parent is not None and parent.dropped), tag == "a" or (parent is not None and parent.link), parent, marked, weak)


Block = tuple[str, Element, int]


def _worth(block: Block) -> float:
    return max(0.0, len(block[0]) - 2.0 * block[2])


def unmarked(found: list[Block]) -> list[Block]:
    """The blocks that stand in no boilerplate.

    A mark doesn't count on an element that holds more than half of the page's
    paragraph text, if hardly any stands outside all marks or it holds the
    page's h1. Of tags, only forms can lose their mark. A mark by a name that
    could be the text's own (related-work) doesn't count either on prose without
    links that stands between unmarked blocks of the same parent.
    """
    total = plain = 0.0
    sides: dict[int, list[int]] = {}
    for at, block in enumerate(found):
        worth = _worth(block)
        total += worth
        if block[1].marked is None:
            plain += worth
            up = block[1]
            for _ in range(2):  # the element it is the text of, and that one's parent
                if up is not None:
                    first = sides.setdefault(id(up), [at, at])
                    first[1] = at
                    up = up.parent
        for e in block[1].marks():
            e.held, e.n, e.title = e.held + worth, e.n + 1, e.title or block[1].tag == "h1"
            if e.weak:
                e.linked, e.words, e.first, e.last = e.linked + block[2], e.words + len(block[0].split()), at if e.first < 0 else e.first, at

    def prose(e: Element) -> bool:
        first, last = sides.get(id(e.parent), (0, 0))
        return e.weak and not e.linked and e.words >= PROSE_WORDS * e.n and first < e.first and last > e.last

    def void(e: Element) -> bool:
        return prose(e) or (e.tag in UNWRAPPED or e.tag not in MARKED) and 2 * e.held > total and (10 * plain < e.held or e.title)

    return [b for b in found if all(map(void, b[1].marks()))]


def blocks(page: str) -> list[Block]:
    """(text, element it stands in, characters of it inside links) of every block outside dropped elements and boilerplate, in page order."""
    root = Element("", "", False, False, None)
    stack, out, run, links, at, raw = [root], [], [], 0, 0, ""

    def flush() -> None:
        nonlocal run, links
        text = " ".join("".join(run).split())
        if text:
            inside = stack[-1]
            while inside.tag and inside.tag not in BLOCKS:
                inside = inside.parent if inside.parent is not None else root
            out.append((text, inside, links))
        run, links = [], 0

    def say(a: int, b: int) -> None:
        nonlocal links
        if a < b and not stack[-1].dropped:
            text = entities.unescape(page[a:b])
            run.append(text)
            if stack[-1].link:
                links += len(text.strip())

    while m := _TAG.search(page, at):
        if raw:
            end = re.compile(rf"</{re.escape(raw)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at, raw = end.end() if end else len(page), ""
            stack.pop()
            continue
        say(at, m.start())
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCKS:
                flush()
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if depth and (tag in BLOCKS or not any(e.tag in BLOCKS for e in stack[depth + 1 :])):
                del stack[depth:]
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            run.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            closes = ("p",) if tag in ENDS_P else ("p", tag) if tag in ("li", "td", "th", "tr") else ("p", "dt", "dd") if tag in ("dt", "dd") else ()
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in closes:
                    del stack[depth:]
                elif stack[depth].tag in BLOCKS:
                    break
        stack.append(_open(tag, m[3], stack[-1] if stack[-1].tag else None))
        if tag in RAW:
            raw = tag
        elif m[3].endswith("/") and tag not in BLOCKS:
            stack.pop()
    if not raw:
        say(at, len(page))
    flush()
    return unmarked(out)


def _containers(e: Element) -> Iterator[Element]:
    while e is not None and e.tag:
        if e.tag in CONTAINERS:
            yield e
        e = e.parent


def scored(found: list[Block]) -> list[Element]:
    """The containers of a page's blocks, best first: a block's text counts fully for the container it stands in and half for the next one out."""
    met: dict[int, Element] = {}
    for block in found:
        worth = _worth(block)
        for share, e in zip((1.0, 0.5), _containers(block[1]), strict=False):
            met.setdefault(id(e), e).score += worth * share * (1.25 if e.tag in ("article", "main") else 1.0)
    return sorted(met.values(), key=lambda e: -e.score)  # equal ones in page order


def _inside(found: list[Block], path: str) -> set[int]:
    """The numbers of the blocks that stand in an element of this path; every element is looked at once."""
    key, known = path_key(path), {}

    def within(e: Element | None) -> bool:
        walked = []
        while e is not None and e.tag and id(e) not in known:
            walked.append(e)
            if e.key == key and e.path == path:
                break
            e = e.parent
        answer = e is not None and bool(e.tag) and known.get(id(e), True)
        for w in walked:
            known[id(w)] = answer
        return answer

    return {i for i, b in enumerate(found) if within(b[1])}


def _is_heading(block: Block) -> bool:
    return block[1].tag in ("h1", "h2", "h3", "h4", "h5", "h6")


def own_text(found: list[Block], best: Element) -> set[int]:
    """The numbers of the blocks of a page's main text: those on the best container's path and what belongs to them elsewhere.

    Blocks are grouped by their innermost container. A group outside belongs to
    the text if it isn't mostly links and stands under the container around the
    best one, or has LEAST_TEXT characters; where only html and body hold it
    together with the best container, its blocks must also be at least a quarter
    as long as the best container's. The text then runs
    from the first to the last block of these groups, with the headings before
    it and without blocks that are mostly links.
    """
    text = _inside(found, best.path)
    around = {id(e): k for k, e in enumerate(_containers(best)) if e.tag != "body"}
    nearest: dict[int, int | None] = {}

    def level_of(e: Element | None) -> int | None:
        """Containers from the best one out to the first that holds ``e`` too; every element is looked at once."""
        walked = []
        while e is not None and id(e) not in nearest:
            if id(e) in around:
                nearest[id(e)] = around[id(e)]
                break
            walked.append(e)
            e = e.parent
        answer = nearest[id(e)] if e is not None else None
        for w in walked:
            nearest[id(w)] = answer
        return answer

    groups: dict[int, list[int]] = {}
    for i, b in enumerate(found):
        if i not in text and not _is_heading(b):
            groups.setdefault(id(next(_containers(b[1]), None)), []).append(i)
    mean = sum(_worth(found[i]) for i in text) / max(1, len(text))
    for group in groups.values():
        worth = sum(_worth(found[i]) for i in group)
        level = level_of(found[group[0]][1])
        sibling, near = level is not None and level <= 1, level is not None
        if 2 * worth > sum(len(found[i][0]) for i in group) and (sibling or worth >= LEAST_TEXT and (near or 4 * worth >= mean * len(group))):
            text |= set(group)
    first, last = min(text), max(text)
    for i in range(first - 1, -1, -1):  # headings, with what stands between the page's h1 and the text
        if found[i][1].tag == "h1" or (_is_heading(found[i]) and i == first - 1):
            first = i
    inside = {i for i in range(first, last + 1) if _is_heading(found[i]) or 2 * found[i][2] <= len(found[i][0])}
    return text | inside


def extract(page: str | None, path: str | None) -> str:
    """The main text: the page's own, with what stands on ``path`` (the host's) besides."""
    found = blocks(page or "")
    best = scored(found)
    if not best:
        return "\n".join(t for t, _, _ in found)
    text = own_text(found, best[0])
    if path and path != best[0].path:
        text |= _inside(found, path)
    return "\n".join(found[i][0] for i in sorted(text))


def host_of(url: Column) -> Column:
    """The host of a url, lower case ('' if there is none)."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def host_paths(pages: DataFrame, candidates: int = 3) -> DataFrame:
    """(host, path, n): the container path with most votes of each host, and its voting pages; a page's best ``candidates`` containers share its vote by score."""

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for host, page in zip(batch["host"], batch["html"], strict=True):
                best = scored(blocks(page or ""))[:candidates]
                total = sum(e.score for e in best)
                if total > 0:
                    rows += [(host, e.path, round(1e6 * e.score / total), int(k == 0)) for k, e in enumerate(best)]
            yield pd.DataFrame(rows, columns=["host", "path", "vote", "n"])

    cast = pages.select(host_of(F.col("url")).alias("host"), "html").mapInPandas(votes, "host string, path string, vote bigint, n bigint")
    summed = cast.groupBy("host", "path").agg(F.sum("vote").alias("votes"), F.sum("n").alias("n"))
    return summed.groupBy("host").agg(F.max_by("path", F.struct("votes", "path")).alias("path"), F.sum("n").alias("n"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and the host's path for every page."""
    won = written(host_paths(pages), "host-paths")
    size = won.agg(F.sum(F.octet_length("host") + F.octet_length("path")), F.sum("n")).first()
    hosted = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [extract(h, p) for h, p in zip(batch["html"], batch["path"], strict=True)]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts], "path": batch["path"]})

    if (size[0] or 0) <= BROADCAST_BYTES:
        joined = hosted.join(F.broadcast(won), "host", "left")
    else:
        joined = left_join_spread(hosted, won, ["host"], size[1])
    joined = joined.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "path")
    return joined.mapInPandas(run, "page_id bigint, url string, text string, n_chars bigint, path string")
