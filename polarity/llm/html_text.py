"""Main text of web pages by consensus host paths.

Every page is parsed once for its containers (body, main, article, section,
div, td). A text block gives its characters outside links, less those inside,
to its container and a falling share to the containers around it. The
container with the highest score, or the article or main around it, or else
the containers around it that hold further unlinked blocks of their own, casts
a vote for its generalised path: tags and classes from the root, digits written
as 0. Votes are summed by (host,
path) in Spark; the path with most votes wins the host (then the higher score,
then the smaller path). The second pass takes the text of the containers at
the winning path, or of the page's own best container if it has none there.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
and reader comments are left out, by tag, role, class or id. Classes and ids
count if all of their parts say so ("site-footer", not "has-sidebar"), and not
for an element that holds most of the page's text, comments and consent boxes
aside; the same holds for forms. A name with other parts beside such a word
("share-buttons-top") counts for a division or list, unless it tells a state
("comments-open") or a part of the article ("entry-header"), or the element holds
most of the page or much text without links. A header inside an article or
main element belongs to it. The work is linear in a page's length, however deep
its elements are nested.

Null and empty pages give an empty text. Pages without a host follow their own
best container. Repeated rows each vote. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polarity.llm.scratch import materialise
from polarity.llm.words import pieces

#: HTML's element kinds, and words that name what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul""".split())
CONTAINERS = frozenset("body main article section div td".split())
LEFT_OUT = frozenset("""head nav footer aside script style noscript template iframe svg math object button select textarea title dialog menu canvas
    audio video map""".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
LEFT_OUT_WORDS = frozenset("""ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies dialog
    discussion disqus footer form header masthead menu menubar modal nav navbar navigation newsletter notice notification overlay pager pagination
    popup promo promotion recommended related reply replies respond share sharing sidebar social sponsor sponsored subscribe subscription toolbar
    widget""".split())
PLACE_WORDS = frozenset("""area articles bar block body bottom box button buttons container count global icon icons inner item items left link links list
    lower main outer page panel policy posts primary reader right secondary section sign signup site slot stories thread top unit up upper user users
    wrap wrapper""".split())  # say nothing beside one of LEFT_OUT_WORDS
COMMENT_WORDS = frozenset("comment comments discussion disqus replies reply respond".split())
SURE_WORDS = COMMENT_WORDS | frozenset("consent cookie cookies modal newsletter overlay popup".split())  # left out whatever they hold
STATE_WORDS = frozenset("closed disabled enabled free has hide is no not off on open show toggle with without".split())  # tell what the page has
ARTICLE_WORDS = frozenset("article blog content entry news post story text".split())  # whose header belongs to the article
LOOSE_TAGS = frozenset("div section ul ol dl".split())  # that a name with further parts may leave out
MUCH_TEXT = 300       # characters, most outside links, that such an element keeps
#: Start tags that end an open element of these kinds, with the tags that keep it open.
ENDS_SELF = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
             "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
SHARE = 0.6           # of a block's score that each container further out gets
FEW_HOSTS = 50_000    # hosts whose paths (some 100 bytes each) are broadcast; more are joined by shuffle
SALTS = 16

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_BLANK = re.compile(r"\s+")
_SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=\d)")
_DIGITS = re.compile(r"\d+")


# left out in any case; if it doesn't hold most of the page; if it holds neither that nor much text without links
HARD, NAMED, LOOSE = 1, 2, 3


def _attributes(source: str) -> dict:
    """Attributes of a start tag by lower-case name; the first of one name counts."""
    found: dict = {}
    for name, value in _ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), unescape(value[1:-1] if value[:1] in ('"', "'") else value))
    return found


def _named(attributes: dict, loose: bool) -> tuple[set[str], bool]:
    """(words that name what is left out, whether all parts of a class or id do)."""
    found: set[str] = set()
    more: set[str] = set()
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        parts = {w for w in _SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower()) if w}
        words = parts & LEFT_OUT_WORDS
        if words and parts <= LEFT_OUT_WORDS | PLACE_WORDS:
            found |= words
        elif words and loose and not parts & STATE_WORDS and not (words == {"header"} and parts & ARTICLE_WORDS):
            more |= words
    return (found, True) if found else (more, False)


def _unwanted(tag: str, attributes: dict, inside_article: bool) -> int:
    if tag in LEFT_OUT or (tag == "header" and not inside_article):
        return HARD
    if tag == "form":
        return NAMED
    if not attributes or tag in ("html", "body"):
        return 0
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or attributes.get("role", "").lower() in LEFT_OUT_ROLES:
        return HARD
    if "display:none" in attributes.get("style", "").lower().replace(" ", ""):
        return HARD
    words, whole = _named(attributes, tag in LOOSE_TAGS)
    if tag in ("article", "main"):
        return HARD if words & COMMENT_WORDS else 0
    if inside_article:
        words.discard("header")
    if not words:
        return 0
    return (HARD if words & SURE_WORDS else NAMED) if whole else LOOSE


class Container:
    """A run of blocks: first one, one after the last, score, score of its own blocks, and the container around it."""

    __slots__ = ("around", "end", "first", "own", "score", "step")

    def __init__(self, step: tuple, first: int, around: Container | None):
        self.step, self.first, self.end, self.score, self.own, self.around = step, first, first, 0.0, 0.0, around

    @property
    def tag(self) -> str:
        return self.step[1].split(".", 1)[0]

    @property
    def path(self) -> str:
        """Tags and classes from the root."""
        out, step = [], self.step
        while step:
            out.append(step[1])
            step = step[0]
        return ">".join(reversed(out))


def _path_hash(path: str) -> int:
    h = 0
    for name in path.split(">"):
        h = hash((h, name))
    return h


def parse(page: str) -> tuple[list[str], list[Container]]:
    """(text blocks of the wanted parts, containers in the order of their start tags)."""
    blocks, containers, held, total = _parse(page, frozenset())
    stay = frozenset(at for at, (n, linked, kind) in held.items() if 2 * n > total or (kind == LOOSE and n >= MUCH_TEXT and 10 * linked < n))
    return _parse(page, stay)[:2] if stay else (blocks, containers)


def _parse(page: str, wanted: frozenset[int]) -> tuple[list[str], list[Container], dict[int, list], int]:
    """Blocks and containers; the characters, those inside links and the kind of
    each element left out by name, by its place in the page; and the characters of
    all text. Elements at the places ``wanted`` stay."""
    blocks: list[str] = []
    containers: list[Container] = []
    stack: list[tuple] = []       # (tag, step of the path, container or None, left out, link)
    around: list[Container] = []  # open containers
    opened: dict[str, int] = defaultdict(int)
    out = links = articles = hard = total = 0
    held: dict[int, list] = {}
    named: list[int] = []
    text: list[str] = []
    linked = at = 0

    def flush():
        nonlocal linked
        if text:
            block = _BLANK.sub(" ", "".join(text)).strip()
            if block:
                if around:
                    around[-1].own += max(len(block) - 2 * linked, 0)
                blocks.append(block)
            text.clear()
        linked = 0

    def close(depth: int):
        nonlocal out, links, articles, hard
        while len(stack) > depth:
            tag, _, container, unwanted, link = stack[-1]
            hard -= unwanted == HARD
            if unwanted > HARD:
                inner = held[named.pop()]
                if named:
                    held[named[-1]][0] += inner[0]
                    held[named[-1]][1] += inner[1]
            if tag in BLOCKS or unwanted:
                flush()
            if container is not None:
                container.end = len(blocks)
                container.score += container.own
                around.pop()
                if container.around:  # each container further out gets a share
                    container.around.score += SHARE * container.score
            out -= unwanted > 0
            links -= link
            articles -= tag in ("article", "main")
            opened[tag] -= 1
            stack.pop()

    def say(piece: str):
        nonlocal linked, total
        if piece and not hard:
            n = len("".join(piece.split()))
            total += n
            if named:
                held[named[-1]][0] += n
                held[named[-1]][1] += n if links else 0
        if piece and not out:
            piece = unescape(piece)
            text.append(piece)
            if links:
                linked += len(piece)

    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at:m.start()])
        at = m.end()
        if m[2] is None or not m[4]:  # a comment, a declaration, or a tag cut off by the end
            continue
        tag = m[2].lower()
        if m[1]:
            if opened[tag]:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            elif tag in BLOCKS:
                flush()
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in BLOCKS:
            if opened["p"]:
                depth = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in ("p", *CONTAINERS, "table", "li"))
                if stack[depth][0] == "p":
                    close(depth)
            flush()
        if tag in ENDS_SELF:
            ended, keep = ENDS_SELF[tag]
            if any(opened[t] for t in ended.split()):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in keep:
                        break
                    if stack[i][0] in ended.split():
                        close(i)
                        break
        if tag in VOID:
            continue
        attributes = _attributes(m[3])
        unwanted = _unwanted(tag, attributes, articles > 0)
        if unwanted > HARD and m.start() in wanted:
            unwanted = 0
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            if tag != "noscript" or unwanted:
                at = end.start() if end else len(page)
        if unwanted and not out:
            flush()
        classes = sorted(_DIGITS.sub("0", c) for c in attributes.get("class", "").lower().replace(">", " ").split())
        before = stack[-1][1] if stack else ()
        name = ".".join([tag, *classes])
        step = (before, name, hash((before[2] if before else 0, name)))
        container = None
        if tag in CONTAINERS and not out and not unwanted:
            container = Container(step, len(blocks), around[-1] if around else None)
            containers.append(container)
            around.append(container)
        out += unwanted > 0
        hard += unwanted == HARD
        if unwanted > HARD:
            named.append(m.start())
            held[m.start()] = [0, 0, unwanted]
        links += tag == "a"
        articles += tag in ("article", "main")
        opened[tag] += 1
        stack.append((tag, step, container, unwanted, tag == "a"))
    flush()
    close(0)
    return blocks, containers, held, total


def best_container(containers: list[Container]) -> Container | None:
    """The highest score (the outermost of equals, as it comes first), or the
    innermost article or main around it; without one, what is around it as long
    as that, body aside, holds unlinked blocks of its own."""
    best = max(containers, key=lambda c: c.score, default=None)
    if best is None or best.score <= 0:
        return best
    c = best
    while c:
        if c.tag in ("article", "main"):
            return c
        c = c.around
    while best.around and best.around.own > 0 and best.around.tag != "body":
        best = best.around
    return best


def extract(page: str | None, path: str | None = None) -> str:
    """Blocks of the containers at ``path``, else of the best one, else of the page."""
    blocks, containers = parse(page or "")
    chosen, upto = [], 0
    wanted = _path_hash(path) if path is not None else None
    for c in containers:
        if c.step[2] == wanted and c.first >= upto and c.end > c.first and c.path == path:
            chosen += blocks[c.first:c.end]
            upto = c.end
    if not chosen:
        best = best_container(containers)
        chosen = blocks[best.first:best.end] if best else blocks
    return "\n".join(chosen)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, _, _ in pieces(batches, "html", 4 << 20):
        count: dict = defaultdict(lambda: [0, 0.0])
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            best = best_container(parse(page or "")[1])
            if best and best.score > 0:
                v = count[host, best.path]
                v[0] += 1
                v[1] += best.score
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in count]), pa.array([k[1] for k in count]), pa.array([v[0] for v in count.values()], pa.int64()),
                                              pa.array([float(round(v[1])) for v in count.values()])], names=["host", "path", "votes", "score"])


def _texts(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in pieces(batches, "__html", 4 << 20):
            found = [extract(page, path) for page, path in zip(batch.column("__html").to_pylist(), batch.column("__path").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, pa.string())], names=[*names, "text"])

    return run


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path): each host's winning path."""
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).filter("host != '' AND html IS NOT NULL")
    votes = rows.mapInArrow(_votes, "host string, path string, votes long, score double").groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("score").alias("score"))
    return votes.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), -F.col("score"), F.col("path"))).alias("path"))


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of every row (all but the html if None) and ``text``."""
    carry = [c for c in pages.columns if c != html_col] if carry is None else carry
    names = [f"c{i}" for i in range(len(carry))]
    paths = materialise(host_paths(pages, url_col, html_col))
    rows = pages.select(*(F.col(c).alias(n) for c, n in zip(carry, names)), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("__html"))
    if paths.limit(FEW_HOSTS + 1).count() <= FEW_HOSTS:
        rows = rows.join(F.broadcast(paths), "host", "left")
    else:  # a host of a third of all pages is dealt over SALTS tasks
        paths = paths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("__html"), F.lit(SALTS)).cast("int")).join(paths, ["host", "salt"], "left")
    rows = rows.select(*names, F.col("__html"), F.col("path").alias("__path"))
    kinds = "".join(f"{n} {pages.schema[c].dataType.simpleString()}, " for n, c in zip(names, carry))
    done = rows.mapInArrow(_texts(names), kinds + "text string")
    return done.select(*(F.col(n).alias(c) for n, c in zip(names, carry)), "text")
