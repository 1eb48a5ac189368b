"""Main text of web pages by tag-path ratios.

Every text node of a page belongs to a root-to-leaf tag path. Text length and punctuation are aggregated per path, put
in page order, smoothed with a Gaussian window, fused into one score and thresholded by its spread. The selected paths decide
which blocks are kept. Markup is a prior: blocks are sought inside main and article elements where those hold selected
text, else inside the element that holds most of it, less what its markup names as something else; of several articles
those count that hold a fair share of the selected text of the fullest one. A class name alone does not outweigh the
text: an element that holds most of the page's running text is kept whatever it is called.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from khata.llm.common import table

#: Weights of the smoothing window, the share of the scores' spread that selects a path, and the share of the
#: selected text that an element must hold to be the content.
SMOOTH = (0.06, 0.24, 0.4, 0.24, 0.06)
SPREAD = 0.5
HOLDS = 0.75
#: An article counts beside the fullest one of its page from this share of that one's selected text on.
SHARE = 0.25
#: A list or table with this share of its text in links is a menu.
LINKS = 0.7
#: Shares of the page's running text from which on an element's class or id no longer names it as something else: where
#: the name is only a part of a longer one ("has-sidebar"), and where it stands alone.
PART_NAME, WHOLE_NAME = 0.5, 0.85

# The HTML vocabulary.
_RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp plaintext template svg math".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_NEVER = frozenset("nav footer aside form button select option optgroup input dialog menu object canvas audio video map head datalist fieldset legend".split())
_PARAGRAPH_ENDS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: Blocks of running text, and what holds them together without being a division of the page.
_TEXT_BLOCKS = frozenset("p li dt dd td th caption pre blockquote figcaption summary h1 h2 h3 h4 h5 h6".split())
_STRUCTURE = _TEXT_BLOCKS | frozenset("ul ol dl table tbody thead tfoot tr colgroup figure details hgroup".split())
_SAME_LEVEL = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
_SCOPE = frozenset("ul ol dl table td th div article section main body html aside nav footer header form blockquote".split())
_NOT_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar note status".split())
_NOT_CONTENT_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored sponsors promo promotion promoted banner banners
    nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager skip topbar toolbar masthead footer sidebar sidebars aside widget widgets
    related recommended recommendations share sharing social follow subscribe subscription newsletter signup login register popup modal overlay
    cookie cookies consent gdpr notice notices notification notifications alert disclaimer copyright
    comment comments commentlist disqus respond reply replies discussion feedback form search tags taglist""".split()
)
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*"|'[^']*'|[^>"'])*+)>""", re.S)
_BROKEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden|itemprop)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_ARTICLE = re.compile(r"\brole\s*=\s*[\"']?article\b", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…、。，]")


def _names_other(attributes: str) -> tuple[bool, float, bool]:
    """(markup that says it is something other than content, share of the running text that outweighs its class and id,
    0 where these name nothing else, markup that names the content)."""
    other = main = False
    name_weight = 0.0
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            for token in value.split():
                words = {w.lower() for w in _NAME.findall(token)}
                if words & _NOT_CONTENT_NAMES:
                    name_weight = max(name_weight, WHOLE_NAME if len(words) == 1 else PART_NAME)
        elif name == "role":
            other |= value.lower() in _NOT_CONTENT_ROLES
            main |= value.lower() in ("main", "article")
        elif name == "itemprop":
            main |= value == "articleBody"
            other |= value == "comment"
        elif name == "style":
            other |= bool(_HIDDEN.search(value))
        elif name == "hidden":
            other |= value.lower() != "false"
        else:
            other |= value.lower() == "true"
    return other, name_weight, main


def _tags(source: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, "/" of an end tag, name, attributes) of every tag, and of every comment or declaration without a
    name. A tag that the page's end cuts off takes the rest. Every search that fails ends the page: linear time."""
    at = 0
    while (at := source.find("<", at)) >= 0:
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            yield at, end + 3 if end >= 0 else len(source), "", "", ""
        elif source[at + 1 : at + 2] in ("!", "?"):
            end = source.find(">", at) - 2
            yield at, end + 3 if end >= 0 else len(source), "", "", ""
        elif m := _TAG.match(source, at) or _BROKEN.match(source, at):
            end = m.end() - 3
            yield at, m.end(), m[1], m[2].lower(), m[3]
        elif source[at + 1 : at + 2].isalpha() and source[at + 1].isascii() or source[at + 1 : at + 2] == "/" and source[at + 2 : at + 3].isalpha() and source[at + 2].isascii():
            end = -1
            yield at, len(source), "", "", ""
        else:
            at += 1
            continue
        if end < 0:
            return
        at = end + 3


class _Page:
    """Elements in page order (parents first) and text nodes: (element, text, inside a link)."""

    def __init__(self, source: str):
        self.tag, self.parent = ["#root"], [-1]
        self.hard, self.name_weight, self.names_main, self.attributes = [False], [0.0], [False], [""]
        self.path, self.paths = [0], {}  # tag paths as numbers: (number of the parent's path, tag) -> number
        self.block = [0]  # the nearest element that is not inline
        self.nodes: list[tuple[int, str, bool]] = []
        self.open, self.links = [0], 0
        # Open elements by tag: all, those since the last one that is not inline, those since the last of _SCOPE.
        self.every: dict[str, int] = {}
        self.inline, self.scope = [{}], [{}]
        at, lower = 0, None
        for start, end, slash, name, attributes in _tags(source):
            if start < at:  # inside raw text
                continue
            if start > at:
                self.text(source[at:start])
            at = end
            if not name:
                continue
            if slash:
                self.close(name)
                continue
            self.begin(name, attributes)
            if name in _RAW:
                lower = source.lower() if lower is None else lower
                end = lower.find(f"</{name}", at)
                at = len(source) if end < 0 else end
                if end >= 0:
                    stop = source.find(">", end)
                    at = len(source) if stop < 0 else stop + 1
                self.close(name)
        if at < len(source):
            self.text(source[at:])
        self.judge()

    def judge(self) -> None:
        """dropped, main, article of every element: its own markup and its parents', and its name where text doesn't outweigh it."""
        n = len(self.tag)
        gone, running = [False] * n, [0] * n
        for e in range(1, n):
            gone[e] = gone[self.parent[e]] or self.hard[e]
        for e, text, linked in self.nodes:
            if not gone[e] and not linked:
                running[e] += len(text.strip())
        for e in range(n - 1, 0, -1):
            running[self.parent[e]] += running[e]
        self.dropped, self.main, self.article = [False] * n, [False] * n, [0] * n  # article: the nearest article element
        for e in range(1, n):
            up, name = self.parent[e], self.tag[e]
            other = self.hard[e] or self.name_weight[e] > 0 and running[e] < self.name_weight[e] * running[0]
            main = not other and (self.names_main[e] or name in ("article", "main"))
            drop = other and name not in ("html", "body") or name == "header" and not self.main[up]
            self.dropped[e], self.main[e] = self.dropped[up] or drop, self.main[up] or main
            self.article[e] = e if main and (name == "article" or _ARTICLE.search(self.attributes[e])) else self.article[up]

    def text(self, raw: str) -> None:
        self.nodes.append((self.open[-1], entities.unescape(raw) if "&" in raw else raw, self.links > 0))

    def begin(self, name: str, attributes: str) -> None:
        if name in _PARAGRAPH_ENDS:
            self.close_within("p", "p")
        for other in _SAME_LEVEL.get(name, ()) if name != "p" else ():
            self.close_within(other, name)
        up = self.open[-1]
        other, name_weight, main = _names_other(attributes) if attributes.strip() else (False, 0.0, False)
        e = len(self.tag)
        self.tag.append(name)
        self.parent.append(up)
        self.path.append(self.path[up] if name in _VOID else self.paths.setdefault((self.path[up], name), len(self.paths) + 1))
        self.hard.append(other or name in _NEVER or name in _RAW)
        self.name_weight.append(name_weight)
        self.names_main.append(main)
        self.attributes.append(attributes if main else "")
        self.block.append(e if name not in _INLINE else self.block[up])
        if name not in _INLINE:
            self.nodes.append((e, " ", False))
        if name not in _VOID:
            self.open.append(e)
            self.links += name == "a"
            for counts in (self.every, self.inline[-1], self.scope[-1]):
                counts[name] = counts.get(name, 0) + 1
            if name not in _INLINE:
                self.inline.append({})
            if name in _SCOPE:
                self.scope.append({})

    def close_within(self, name: str, for_: str) -> None:
        """Closes an open element that the next one implies closed, not beyond its list, table or section."""
        if not (self.every if for_ == "tr" or name in _SCOPE else self.scope[-1]).get(name):
            return
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.tag[self.open[k]]
            if tag == name:
                self.pop(k)
                return
            if tag in _SCOPE and not (for_ == "tr" and tag in ("td", "th")):
                return

    def close(self, name: str) -> None:
        if not (self.inline[-1] if name in _INLINE else self.scope[-1] if name == "p" else self.every).get(name):
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.tag[self.open[k]] == name:
                self.pop(k)
                if name not in _INLINE:
                    self.nodes.append((self.open[-1], " ", False))
                return

    def pop(self, k: int) -> None:
        while len(self.open) > k:
            tag = self.tag[self.open.pop()]
            self.links -= tag == "a"
            if tag not in _INLINE:
                self.inline.pop()
            if tag in _SCOPE:
                self.scope.pop()
            for counts in (self.every, self.inline[-1], self.scope[-1]):
                counts[tag] -= 1


def _selected_paths(page: _Page) -> set[int]:
    """Tag paths whose fused, smoothed ratios reach the threshold."""
    stats: dict[int, list[int]] = {}
    for element, text, linked in page.nodes:
        n = len(text.strip())
        if n and not page.dropped[element]:
            s = stats.setdefault(page.path[element], [0, 0, 0])
            s[0] += 0 if linked else n
            s[1] += 1
            s[2] += len(_PUNCTUATION.findall(text))
    paths = list(stats)
    length = _smooth([stats[p][0] / stats[p][1] for p in paths])
    marks = _smooth([stats[p][2] / stats[p][1] for p in paths])
    fused = [a * (1 + b) for a, b in zip(length, marks)]
    if not fused:
        return set()
    mean = sum(fused) / len(fused)
    spread = (sum((x - mean) ** 2 for x in fused) / len(fused)) ** 0.5
    chosen = {p for p, x in zip(paths, fused) if x >= SPREAD * spread and stats[p][0]}
    return chosen or set(paths)


def _articles(page: _Page, weight: list[int]) -> set[int]:
    """Articles whose own text is main text: the fullest one, those it lies in, and those with a fair share of its text.

    weight: selected text of each element alone. 0 stands for what lies in no article.
    """
    own: dict[int, int] = {}
    for e, w in enumerate(weight):
        if page.main[e]:
            own[page.article[e]] = own.get(page.article[e], 0) + w
    fullest = max(own, key=own.__getitem__)
    out = {a for a, w in own.items() if w >= SHARE * own[fullest]}
    for a in list(out):
        while a and (a := page.article[page.parent[a]]) not in out:
            out.add(a)
    return out


def _smooth(values: list[float]) -> list[float]:
    half = len(SMOOTH) // 2
    out = []
    for i in range(len(values)):
        around = [(SMOOTH[k + half], values[i + k]) for k in range(-half, half + 1) if 0 <= i + k < len(values)]
        out.append(sum(w * v for w, v in around) / sum(w for w, _ in around))
    return out


def extract_main_text(source: str | None) -> str:
    """The article of one page: blocks in page order, one space between words; empty for null or no text."""
    if not source:
        return ""
    page = _Page(source)
    n = len(page.tag)
    weight, linked, total = [0] * n, [0] * n, [0] * n
    chosen = _selected_paths(page)
    for element, text, link in page.nodes:
        size = len(text.strip())
        total[element] += size
        linked[element] += size * link
        if not page.dropped[element] and page.path[element] in chosen:
            weight[element] += size
    # A block is kept with all its inline text where a path of it is selected.
    kept = {page.path[page.block[e]] for e, text, _ in page.nodes if text.strip() and page.path[e] in chosen}
    alone = list(weight)
    for e in range(n - 1, 0, -1):
        up = page.parent[e]
        weight[up] += weight[e]
        linked[up] += linked[e]
        total[up] += total[e]
    menu = [False] * n
    for e in range(1, n):
        menu[e] = menu[page.parent[e]] or (page.tag[e] in ("ul", "ol", "dl", "table") and total[e] > 0 and linked[e] > LINKS * total[e])
    if any(page.main[e] and weight[e] for e in range(n)):
        articles = _articles(page, alone)
        inside = [page.main[e] and page.article[e] in articles for e in range(n)]
    else:
        root, children = 0, {}
        for e in range(1, n):
            children.setdefault(page.parent[e], []).append(e)
        while weight[root] and (best := max(children.get(root, [0]), key=weight.__getitem__)) and weight[best] >= HOLDS * weight[root] and page.tag[best] not in _INLINE and children.get(best):
            root = best
        if page.tag[root] in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "ul", "ol", "blockquote"):
            root = page.parent[root]
        inside = [False] * n
        inside[root] = True
        for e in range(root + 1, n):
            inside[e] = inside[page.parent[e]]

    # The division that a block is part of: what is round it but lists, tables, quotes and inline markup.
    division = list(range(n))
    for e in range(1, n):
        if page.tag[e] in _STRUCTURE or page.tag[e] in _INLINE:
            division[e] = division[page.parent[e]]

    def selected(e: int) -> bool:
        """On a selected path, or a text block, too short to reach the threshold, of a division that holds such text."""
        block = page.block[e]
        return page.path[block] in kept or page.tag[block] in _TEXT_BLOCKS and weight[division[block]] > 0

    return " ".join("".join(text for e, text, _ in page.nodes if inside[e] and selected(e) and not page.dropped[e] and not menu[e] or text == " ").split())


def extract_pages(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, text and n_chars (code points) of every page; narrow, one pass, no shuffle.

    Null or empty html, or html without content, gives an empty text and 0. Repeated rows each give a row; other
    columns are not read. Unclosed tags, comments and tags cut off by the page's end are read as browsers do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract_main_text(x.as_py()) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    chosen = pages.select(*keep, pages[html].alias("_html"))
    types = dict(chosen.dtypes)
    return chosen.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", text string, n_chars long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
