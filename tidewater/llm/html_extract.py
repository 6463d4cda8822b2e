"""Main text of web pages by consensus host paths.

Every page measures its containers: the text they hold directly, less what is links, and the text in and below them.
Each container's path, made of tags and classes with digits taken out, gets the page's votes; Spark adds them up by host.
The path with most votes wins, and with it every path that holds a share of the text on half of the pages that have it,
and what lies beside a winner and is text that changes from page to page. A winner stands for the article or main that
holds it, or else for the highest element that adds more than links. Then each page is read again: the text of the
elements on its host's winning paths, in page order, without menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments. A page adds its own containers that hold a share of its text or lie beside the
winners, unless many pages of the host have them and they did not win there; where the winning paths find less than a
quarter of the text of the page's own best container, those count too.

A class or id that names a notice, menu or the like takes its element out; one that only holds such a word among others
(social-science) does so where the element is mostly links. Paths are named by hashes along the tree, and everything is
summed up along it once, so long and deep pages take time in proportion to their length.

Edge cases: null or empty html gives an empty text; a null or odd url belongs to the host ''; a page without any
container of text gives what its body holds; unclosed and stray tags are repaired as browsers do for the common cases; a
quote opens a value only after an equals sign, and one that is never closed opens nothing; rows with a null or repeated
page_id are extracted one by one; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

# Element names of the HTML standard, by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template noembed noframes".split())
RAW_END = {t: re.compile(f"</{t}", re.I | re.A) for t in RAW}
#: Elements that part lines. All others, unknown ones too, lie inside a line and do not part words.
BLOCK = frozenset(
    "html head body title address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li listing "
    "main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul col colgroup br textarea xmp plaintext".split()
)
SKIP = frozenset("script style noscript template iframe svg canvas object nav header footer aside form button select textarea dialog menu head title".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_CLOSES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words of a class or id that mark what is not the article.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices "
    "alert nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside rail footer foot header masthead comment comments commentlist discussion disqus replies "
    "reply respond share sharing social related recommended recommendations newsletter subscribe subscription signup login popup modal overlay pagination pager toolbar widget widgets skip copyright".split()
)
#: Words beside those that say nothing of what is in an element.
PLAIN_WORDS = frozenset(
    "a an and area bar block bottom box btn button buttons col column container content contents count desktop div el element fixed form global group header heading home icon icons id inner item items js l large layer left level "
    "line link links list main middle mini mobile module new of on outer page panel post posts primary right row secondary section site slot small stories sticky the thread title top txt ui unit view wrap wrapper zone".split()
)
#: A quote opens a value only right after an equals sign; elsewhere, and where no other follows on the page, it is a letter.
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|$)", re.S)
#: One attribute after the other, so that names inside values are not taken for attributes.
ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: What makes a class say that the element has, or lacks, a thing instead of being it.
ABOUT = frozenset("has have with without no not is show hide enable disable supports".split())
NUMBERS = ("votes", "plain", "linked", "n", "large")
HOST = re.compile(r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")
SPLIT = re.compile(r"[^a-z]+")
DIGITS = re.compile(r"[0-9]+")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url.cast("string"), HOST.pattern, 1)
    return F.coalesce(F.lower(F.regexp_replace(host, r"\.+$", "")), F.lit(""))


class Paths:
    """The paths of a page as a tree: number 0 is the root; a path is its parent and a step, and has a hash for a name."""

    def __init__(self):
        self.parent, self.step, self.name, self.known = [-1], [""], [0], {}

    def at(self, parent: int, step: str) -> int:
        i = self.known.get((parent, step))
        if i is None:
            i = self.known[parent, step] = len(self.parent)
            self.parent.append(parent)
            self.step.append(step)
            self.name.append(xxhash.xxh64_intdigest(step.encode(errors="replace"), self.name[parent]))
        return i


class Node:
    """An open or closed element: the number of its path, whether it is noise, and the nearest block and container."""

    __slots__ = ("tag", "path", "noise", "parent", "link", "block", "box")

    def __init__(self, tag: str, path: int, noise: bool, parent: Node | None):
        self.tag, self.path, self.noise, self.parent = tag, path, noise, parent
        inline = tag not in BLOCK and parent is not None
        self.link = inline and (tag == "a" or parent.link)
        self.block: Node = parent.block if inline else self
        self.box: Node = parent.box if parent is not None and (inline or tag in BLOCK_ONLY) else self


def is_noise(name: str) -> bool | None:
    """Whether a class or id names what is not the article: sidebar-2 does and has-sidebar does not; None: social-science,
    which holds such a word among others."""
    parts = [x for x in SPLIT.split(name) if x]
    if any(x in ABOUT for x in parts[: next((i for i, x in enumerate(parts) if x in NOISE), len(parts))]):
        return False
    if not any(x in NOISE for x in parts):
        return False
    return True if all(x in NOISE or x in PLAIN_WORDS or len(x) == 1 for x in parts) else None


def step(tag: str, attrs: str) -> tuple[str, bool]:
    """The generalised part of a path for an element, and whether the element is noise. A step that starts with ? has a
    class or id that may be noise."""
    if not attrs or attrs.isspace():
        return tag, tag in SKIP
    found = {}
    for m in ATTR.finditer(attrs):
        found.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    classes = sorted({DIGITS.sub("", c) for c in found.get("class", "").split()} - {""})
    names = [] if tag in ("html", "body", "article", "main") else (found.get("class", "") + " " + found.get("id", "")).split()
    told = [is_noise(n) for n in names]
    noise = tag in SKIP or True in told or found.get("role") in ROLES or found.get("aria-hidden") == "true" or "hidden" in found
    return ("?" if None in told else "") + ".".join([tag, *classes]), noise


def parse(page: str, paths: Paths) -> Iterator[tuple[str, Node, str]]:
    """Events ('text' | 'break', element, text) in page order. Raw elements and comments give no text."""
    root = Node("", 0, False, None)
    top, at, size = root, 0, len(page)
    open_: dict[str, int] = {}
    while at < size:
        m = TOKEN.search(page, at)
        if m is None or m.end() == m.start():
            yield "text", top, page[at:]
            break
        if m.start() > at:
            yield "text", top, page[at : m.start()]
        at = m.end()
        tag = m[2].lower() if m[2] else ""
        if not tag:
            continue
        if m[1]:  # end tag
            if not open_.get(tag):
                continue
            node = top
            if tag in BLOCK:
                while node.tag != tag:
                    node = node.block if node.tag not in BLOCK else node.parent
            else:
                while node.tag != tag and node.tag not in BLOCK and node is not root:
                    node = node.parent
                if node.tag != tag:  # a stray inline end does not close blocks
                    continue
            while top is not node:
                open_[top.tag] -= 1
                top = top.parent
            open_[tag] -= 1
            if tag in BLOCK:
                yield "break", top, ""
            top = node.parent
            if tag in BLOCK:
                yield "break", top, ""
            continue
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            close = page.find(">", end.start()) if end else -1
            at = close + 1 if close >= 0 else size
            if tag in BLOCK:
                yield "break", top, ""
            continue
        if tag in VOID:
            if tag in BLOCK:
                yield "break", top, ""
            continue
        if tag in CLOSES_P or tag in SAME_CLOSES:
            stop = SAME_CLOSES.get(tag, frozenset())
            node, target = top.block, None
            while node is not root and node.tag not in stop and node.tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
                if node.tag == "p" and tag in CLOSES_P or tag == node.tag and tag in SAME_CLOSES or {tag, node.tag} in ({"dt", "dd"}, {"td", "th"}):
                    target = node
                    break
                if tag in CLOSES_P:
                    break
                node = node.parent.block
            if target is not None:
                while top is not target.parent:
                    open_[top.tag] -= 1
                    top = top.parent
        if tag in BLOCK:
            yield "break", top, ""
        part, noise = step(tag, m[3])
        path = paths.at(top.path, part) if tag in BLOCK else top.path
        top = Node(tag, path, top.noise or noise, top)
        open_[tag] = open_.get(tag, 0) + 1
        if tag in BLOCK:
            yield "break", top, ""


BLOCK_ONLY = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot pre blockquote figcaption".split())


def tag_of(step: str) -> str:
    return step.removeprefix("?").partition(".")[0]


class Tree:
    """Containers of a page or of a host: tag, up (the container that holds it, -1 for none), and what was measured.

    score is the text directly in the container's blocks, less its links, and half of that of the containers directly
    inside; plain and linked are the text outside and inside links in the container and below; own is the text directly
    in its blocks, less its links. Containers come after what holds them.
    """

    def __init__(self):
        self.tag, self.up, self.name = [], [], []
        self.score, self.plain, self.linked, self.own = [], [], [], []

    def add(self, tag: str, up: int, name: int) -> int:
        self.tag.append(tag)
        self.up.append(up)
        self.name.append(name)
        for x in (self.score, self.plain, self.linked, self.own):
            x.append(0.0)
        return len(self.tag) - 1

    def above(self, i: int) -> list[int]:
        out = []
        while (i := self.up[i]) >= 0:
            out.append(i)
        return out

    def under(self, tops: set[int]) -> list[bool]:
        """Whether each container is one of the tops or lies in one."""
        out = []
        for i, up in enumerate(self.up):
            out.append(i in tops or up >= 0 and out[up])
        return out

    def best(self) -> int | None:
        depth = []
        for up in self.up:
            depth.append(depth[up] + 1 if up >= 0 else 0)
        return max((i for i in range(len(self.tag)) if self.score[i] > 0), key=lambda i: (self.score[i], -depth[i], self.name[i]), default=None)


class Page(Tree):
    """A page's containers that hold text outside noise; text is the digest of what a container says itself."""

    def __init__(self, page: str):
        super().__init__()
        self.paths, direct, said, self.titles = Paths(), {}, {}, {}
        for kind, node, text in parse(page, self.paths):
            if kind != "text" or node.noise or not text or text.isspace():
                continue
            n = len(text) - text.count(" ")
            got = direct.setdefault(node.box.path, [0, 0])
            got[node.link] += n
            said.setdefault(node.box.path, []).append(text)
            if node.block.tag == "h1":
                self.titles.setdefault(node.block.path, []).append(text)
        #: path -> container, for paths of containers with text in or below them.
        self.at: dict[int, int] = {}
        p = self.paths
        held = [False] * len(p.parent)
        for i in direct:
            held[i] = True
        for i in range(len(held) - 1, 0, -1):
            held[p.parent[i]] |= held[i]
        near = [-1] * len(held)  # the container at or above each path
        for i in range(1, len(held)):
            up, tag = near[p.parent[i]], tag_of(p.step[i])
            if held[i] and tag not in BLOCK_ONLY:
                self.at[i] = near[i] = self.add(tag, up, p.name[i])
            else:
                near[i] = up
        self.near, self.digest = near, {}
        self.doubtful: set[int] = {self.at[i] for i in self.at if p.step[i].startswith("?")}
        for i, (plain, linked) in direct.items():
            c = self.at.get(i)
            if c is None:
                continue
            gain = plain - linked
            self.plain[c], self.linked[c], self.own[c] = self.plain[c] + plain, self.linked[c] + linked, gain
            self.score[c] += gain
            if self.up[c] >= 0:
                self.score[self.up[c]] += gain / 2
            self.digest[c] = xxhash.xxh64_intdigest(" ".join("".join(said[i]).split()).encode(errors="replace"))
        for c in range(len(self.tag) - 1, -1, -1):
            if self.up[c] >= 0:
                self.plain[self.up[c]] += self.plain[c]
                self.linked[self.up[c]] += self.linked[c]
        #: May be noise by their names, and are mostly links.
        self.doubtful = {c for c in self.doubtful if self.linked[c] > self.plain[c]}

    def strong(self) -> list[int]:
        """Containers that hold a share of the page's text themselves, their links taken off."""
        total = max(self.plain, default=0.0)
        return [c for c, x in enumerate(self.own) if x > 0 and x >= SHARE * total]


#: The share of a page's text outside links from which a container counts as part of the article wherever it is.
SHARE = 0.05
TOPS = ("html", "body")


def climb(i: int, t: Tree, stop: set[int]) -> int:
    """The article or main that holds a container, or else the highest element below body that adds no text but mostly links."""
    top, up = i, [a for a in t.above(i) if t.tag[a] not in TOPS]
    for a in up:
        if t.tag[top] == "article":
            break
        if t.tag[a] == "article" or t.tag[a] == "main" and t.tag[top] != "main":
            top = a
    for a in up[up.index(top) + 1 if top != i else 0 :]:
        if a in stop or t.tag[top] == "main" or t.tag[top] == "article" and t.tag[a] != "main":
            break
        if t.linked[a] - t.linked[top] > (t.plain[a] - t.plain[top]) / 2 + 1e-9:
            break
        top = a
    return top


def climbed(found: list[int], t: Tree, stop: set[int]) -> set[int]:
    tops = {climb(i, t, stop) for i in found if t.tag[i] not in TOPS}
    return {i for i in tops if not any(a in tops for a in t.above(i))}


def beside(tops: set[int], t: Tree, fits, stop: set[int]) -> set[int]:
    """Containers next to tops that are no article or main by name, and that hold text rather than links."""
    places = {t.up[i] for i in tops if t.tag[i] not in ("article", "main")}
    holds = {a for i in tops for a in t.above(i)}
    return {i for i, up in enumerate(t.up) if up in places and i not in tops and i not in holds and i not in stop and t.tag[i] not in TOPS and t.plain[i] > 2 * t.linked[i] and fits(i)}


def chosen(t: Tree, also: list[int], fits, stop: set[int] = frozenset()) -> set[int]:
    """The containers of the article: what holds the best one and those in `also`, and what fits beside them."""
    best = t.best()
    if best is not None and t.tag[best] in TOPS:
        return {best}
    tops = climbed([best, *also] if best is not None else also, t, stop)
    return tops | beside(tops, t, fits, stop)


def text_at(page: str, own: Page, tops: set[int] | None, dull: set[int] = frozenset()) -> str:
    """Blocks of the containers and below, in page order, and first headings beside them that are not dull, the same on
    many pages; None: the whole page."""
    blocks, now = [], []
    inside = own.under(tops or set())
    out = own.under(own.doubtful)
    round_them = {a for i in tops or () for a in own.above(i)}
    paths = Paths()  # numbers are given in page order, so they are those of `own`
    known: dict[int, bool] = {}

    def takes(node: Node) -> bool:
        c = own.near[node.box.path]
        if c >= 0 and out[c]:
            return False
        if tops is None or c >= 0 and inside[c]:
            return True
        # a title directly in what holds the article
        return node.block.tag == "h1" and node.block.parent.block.path == node.box.path and c in round_them and own.paths.name[node.block.path] not in dull

    def flush() -> None:
        if now:
            # white space inside a block is one space; character references are decoded
            if s := " ".join(html.unescape("".join(now)).split()):
                blocks.append(s)
            now.clear()

    for kind, node, text in parse(page, paths):
        if kind == "break":
            flush()
        elif not node.noise:
            path = node.block.path
            if path not in known:
                known[path] = takes(node)
            if known[path]:
                now.append(text)
    flush()
    return " ".join(blocks)


def extract(page: str | None, winners: list[int] | None, others: list[int] | None = None, dull: list[int] | None = None) -> str:
    """The text of a page at its host's winning paths and at its own, if the host does not know them as others."""
    page = page or ""
    own = Page(page)
    best = own.best()
    won, listed_names, dull_names = ({x & MASK for x in names or ()} for names in (winners, others, dull))
    host = {i for i, name in enumerate(own.name) if name in won and own.plain[i] > 0}
    listed = {i for i, name in enumerate(own.name) if name in listed_names}
    anything = lambda i: True
    whole = any(own.tag[i] in TOPS for i in host)
    few = bool(host) and best is not None and max(own.score[i] if whole else own.plain[i] for i in host) < 0.25 * own.score[best]
    if not host or whole and few:
        return text_at(page, own, chosen(own, own.strong(), anything) or None, dull_names)
    if whole:
        return text_at(page, own, host, dull_names)
    holds = {a for i in host for a in own.above(i)}
    if few:
        mine = chosen(own, own.strong(), anything, listed | holds)
    else:
        known = own.under(listed - holds)
        mine = {i for i in climbed(own.strong(), own, listed | holds) if i not in holds and not known[i]}
        mine |= beside(host, own, lambda i: not known[i], listed | holds)
    return text_at(page, own, host | mine, dull_names)


#: A path takes part in its host's choice if at least one page in so many has it, so a host has a bounded number of them.
RARE = 20


MASK = (1 << 64) - 1
signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
FOUND = pa.schema([("host", pa.string()), ("name", pa.int64()), ("up", pa.int64()), ("step", pa.string()), ("said", pa.int64()), *[(c, pa.float64()) for c in NUMBERS]])


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path, won, others, dull: the winning paths of each host, written out and by name, the names of its other
    paths that many pages have, and those of first headings that say the same on most pages.

    Beside the path with most votes, those win that hold a share of the text on half of the pages that have them, and
    those beside them whose text is another one on most pages.
    """

    def rows_of(host: str, page: str) -> Iterator[tuple]:
        own = Page(page)
        if not own.tag:
            return
        votes, total, large = sum(x for x in own.score if x > 0) or 1.0, max(a + b for a, b in zip(own.plain, own.linked)), set(own.strong())
        number = {c: i for i, c in own.at.items()}
        yield (host, 0, 0, "", 0, 0.0, 0.0, 0.0, 1.0, 0.0)  # pages of the host
        for c, name in enumerate(own.name):
            up, i, steps = own.up[c], number[c], []
            while i and own.at.get(i) != up:  # through items and cells to the container that holds it
                steps.append(own.paths.step[i])
                i = own.paths.parent[i]
            above = own.name[up] if up >= 0 else 0
            yield (host, signed(name), signed(above), ">".join(reversed(steps)), signed(own.digest.get(c, 0)), max(own.score[c], 0) / votes, own.plain[c] / total, own.linked[c] / total, 1.0, float(c in large))
        for i, said in own.titles.items():
            text = " ".join("".join(said).split()).encode(errors="replace")
            yield (host, signed(own.paths.name[i]), 0, "h1", signed(xxhash.xxh64_intdigest(text)), 0.0, 0.0, 0.0, 1.0, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                rows = [r for host, h in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for r in rows_of(host, h or "")]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), FOUND)] if rows else [pa.array([], f.type) for f in FOUND], schema=FOUND)

    cast = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    each = cast.mapInArrow(run, "host string, name long, up long, step string, said long, " + ", ".join(f"{c} double" for c in NUMBERS))
    keys = ("host", "name", "up", "step")
    texts = each.groupBy(*keys, "said").agg(*[F.sum(c).alias(c) for c in NUMBERS])
    added = texts.groupBy(*keys).agg(*[F.round(F.sum(c), 6).alias(c) for c in NUMBERS], F.count(F.lit(1)).cast("double").alias("texts"))
    added = cut(added, "paths")
    many = added.where("name = 0").select("host", F.col("n").alias("of"))
    common = added.where("name <> 0").join(many, "host").where(F.col("n") * RARE >= F.col("of"))

    def choose(p: pd.DataFrame) -> pd.DataFrame:
        head = p.step == "h1"
        dull = p.name[head & (2 * p.texts <= p.n) & (p.n > 2)].tolist()
        rows = {r.name: r for r in p[~head].itertuples(index=False)}
        t, number, line = Tree(), {0: -1}, []
        for name in rows:  # what holds a container comes first
            chain = []
            while name not in number and name in rows:
                chain.append(name)
                name = rows[name].up
            for name in reversed(chain):
                r = rows[name]
                i = number[name] = t.add(tag_of(r.step.rpartition(">")[2]), number.get(r.up, -1), name)
                t.score[i], t.plain[i], t.linked[i] = r.votes, r.plain, r.linked
                line.append(r)
        won = chosen(t, [i for i, r in enumerate(line) if r.large and 2 * r.large >= r.n], lambda i: 5 * line[i].texts >= 4 * line[i].n)
        # what holds a winner and what is beside it; what is below belongs to it
        below = t.under(won)
        rest = sorted(name for i, name in enumerate(t.name) if not below[i])
        shown = [">".join([line[a].step.replace("?", "") for a in reversed(t.above(i))] + [line[i].step.replace("?", "")]) for i in won]
        return pd.DataFrame([(p.host.iloc[0], " ".join(sorted(shown)), sorted(t.name[i] for i in won), rest, sorted(dull))], columns=["host", "path", "won", "others", "dull"])

    # a bounded number of paths for each host
    return common.groupBy("host").applyInPandas(choose, "host string, path string, won array<long>, others array<long>, dull array<long>")


def extract_pages(pages: DataFrame, broadcast_hosts: int = 50_000) -> DataFrame:
    """page_id, url, text, n_chars, host, path (the winning ones, parted by spaces) for every row of pages.

    The winners are broadcast while they are at most `broadcast_hosts` rows; beyond that Spark joins them by host, where
    it may split a large host's pages.
    """
    winners = cut(host_paths(pages), "host-paths")
    small = winners.limit(broadcast_hosts + 1).count() <= broadcast_hosts
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), host_of(F.col("url")).alias("host"))
    rows = rows.join(F.broadcast(winners) if small else winners, "host", "left").select("page_id", "url", "html", "host", "path", "won", "others", "dull")
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("host", pa.string()), ("path", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                texts = [extract(*x) for x in zip(*(part.column(c).to_pylist() for c in ("html", "won", "others", "dull")))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), part.column(3), part.column(4)], schema=out)

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, host string, path string")


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
