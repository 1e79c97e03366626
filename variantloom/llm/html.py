"""HTML extraction by consensus host paths.

Every page scores its containers and names the one that holds its main text. The container's path of
tags and classes, with digits generalised, is that page's vote; Spark counts the votes of each host. The
page is then extracted again from the host's winning path, so that a page with a misleading layout
follows the other pages of its host.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from variantloom.llm.common import read_table, slices
from variantloom.session import materialize

OPENING = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
STOP = re.compile(r"[<>\"']")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
SPACE = re.compile(r"\s+")

# fixed values: names of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
CONTAINERS = frozenset("body main article section div td".split())
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr th caption figure figcaption address details summary hr nav header footer aside form fieldset hgroup center html".split()
)
CLOSES_P = BLOCKS - frozenset("td th tr thead tbody tfoot caption html body".split())
OUTSIDE_TAGS = frozenset("nav header footer aside form button select option svg canvas object audio video dialog menu head fieldset".split())
# end of fixed values

#: Tags whose mark, like that of a class, an article or main inside them overrules.
WRAPPERS = frozenset("form fieldset".split())
ARTICLES = frozenset("article main".split())
NONE: frozenset[str] = frozenset()
P_STOPS = CONTAINERS | {"li", "blockquote"}
CLOSES_ITSELF = {
    "li": frozenset({"ul", "ol"}), "dt": frozenset({"dl"}), "dd": frozenset({"dl"}), "tr": frozenset({"table"}), "td": frozenset({"tr", "table"}),
    "th": frozenset({"tr", "table"}), "option": frozenset({"select"}),
}
#: Class names, ids and roles that mark what is not the article.
#: Beside them a class name may have words for a box, or for what is boxed, that say nothing of their own.
BOX_WORDS = frozenset("area bar block box button buttons container group inner item items list outer panel post posts section site user wrap wrapper".split())
OUTSIDE_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus "
    "footer header masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted related "
    "reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets complementary contentinfo".split()
)
LEAST_SHARE = 64  # a winning path has at least one in so many votes of its host
WORD = re.compile(r"[a-z]+")
NAME = re.compile(r"\S+")
DIGITS = re.compile(r"\d+")


class Node:
    __slots__ = ("tag", "path", "outside", "start", "up", "firm", "good", "links", "end")

    def __init__(self, tag: str, path: int, outside: bool, start: int, up: Node | None = None, firm: bool = False):
        self.tag, self.path, self.outside, self.start = tag, path, outside, start
        self.up, self.firm = up, firm  # the container around it; whether an article inside stays outside too
        self.good = self.links = 0
        self.end = -1


class Paths:
    """Numbers of the container paths of a page: each is the number of the path above it and one step. 0 is no container."""

    def __init__(self):
        self.numbers: dict[tuple[int, str], int] = {}
        self.steps: list[tuple[int, str]] = [(0, "")]

    def below(self, above: int, step: str) -> int:
        number = self.numbers.setdefault((above, step), len(self.steps))
        if number == len(self.steps):
            self.steps.append((above, step))
        return number

    def text(self, number: int) -> str:
        steps = []
        while number:
            number, step = self.steps[number]
            steps.append(step)
        return "".join(f"/{step}" for step in reversed(steps))

    def number(self, text: str) -> int | None:
        """The number of a path given as text, None if the page has it not."""
        at: int | None = 0
        for step in text.split("/")[1:]:
            at = self.numbers.get((at, step))
            if at is None:
                return None
        return at


def tokens(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """The tags of a page: (from, to, "/" if it closes, name, attributes); name is empty for comments and declarations.

    A tag that another "<" cuts off, or that never ends, is text. No part of the page is searched more than a few times,
    whatever is left open in it.
    """
    n, last = len(page), page.rfind(">")
    spent: dict[str, int] = {}  # quotes that do not occur from a place on
    at = page.find("<")
    while 0 <= at < last:
        after = at + 1
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            after = n if end < 0 else end + 3
            yield at, after, "", "", ""
        elif page.startswith(("<!", "<?"), at):
            after = page.find(">", at) + 1
            yield at, after, "", "", ""
        elif m := OPENING.match(page, at):
            i = m.end()
            while stop := STOP.search(page, i):
                mark, i = stop[0], stop.end()
                if mark in "<>":
                    break
                close = -1 if spent.get(mark, n) <= i else page.find(mark, i)
                if close < 0:
                    spent[mark] = min(i, spent.get(mark, n))
                else:
                    i = close + 1
            if stop and stop[0] == ">":
                after = i
                yield at, after, m[1], m[2].lower(), page[m.end() : i - 1]
        at = page.find("<", after)
    if at >= 0 and page.startswith("<!--", at):
        yield at, n, "", "", ""


def step_of(tag: str, attributes: str) -> tuple[str, list[str]]:
    """The step of a path, by class if there is one, else id, else role, with digits generalised; and all three values."""
    if not attributes:
        return tag, []
    values: dict[str, str] = {}
    for name, *value in ATTRIBUTE.findall(attributes):
        values.setdefault(name.lower(), "".join(value))
    first = next((values[k] for k in ("class", "id", "role") if values.get(k, "").split()), "")
    named = DIGITS.sub("N", ".".join(sorted(first.split()))).replace("/", "|")
    return (f"{tag}.{named}" if named else tag), list(values.values())


def scan(page: str) -> tuple[list[Node], list[tuple[str, Node, bool]], Paths]:
    """The elements of a page in order, its pieces (text, element, whether a new block begins), and the paths of containers."""
    paths = Paths()
    root = Node("body", 0, False, 0)  # stands for the body of a page without one
    stack, nodes, pieces = [root], [], []
    places: dict[str, list[int]] = {}  # of the open elements of each tag in the stack
    links = 0
    fresh, pos, n = True, 0, len(page)

    def text(upto: int) -> None:
        nonlocal fresh
        if upto > pos:
            raw = page[pos:upto]
            piece = entities.unescape(raw) if "&" in raw else raw
            top = stack[-1]
            size = len(SPACE.sub("", piece))
            if not top.outside:
                top.good += size
                top.links += size if links else 0
            pieces.append((piece, top, fresh))
            fresh = fresh and not size

    def close(depth: int) -> None:
        nonlocal links, fresh
        while len(stack) > depth:
            node = stack.pop()
            places[node.tag].pop()
            node.end = len(pieces)
            links -= node.tag == "a"
            if node.tag in BLOCKS:
                fresh = True
            stack[-1].good += node.good  # an outside element has only that of articles in it
            stack[-1].links += node.links

    def innermost(tags: frozenset[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def find(tag: str, stop: frozenset[str]) -> int:
        at = places[tag][-1] if places.get(tag) else 0
        return at if at and at > innermost(stop) else 0

    for start, end, closing, tag, attributes in tokens(page):
        if start < pos:
            continue
        text(start)
        pos = end
        if not tag:
            continue
        if closing:
            if at := find(tag, CONTAINERS - {tag} if tag not in CONTAINERS else NONE):
                close(at)
            elif tag in BLOCKS:
                fresh = True
            continue
        if tag in RAW:
            ending = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, pos)
            pos = ending.end() if ending else n
            continue
        if tag in VOID:
            if tag == "hr":
                fresh = True
            elif tag == "br":
                pieces.append((" ", stack[-1], fresh))
            continue
        if tag in CLOSES_P and (at := find("p", P_STOPS)):
            close(at)
        if tag in CLOSES_ITSELF and (at := find(tag, CLOSES_ITSELF[tag])):
            close(at)
        if attributes.rstrip().endswith("/") and tag not in BLOCKS:
            continue
        step, names = step_of(tag, attributes)
        above = stack[-1]
        firm = above.firm or (tag in OUTSIDE_TAGS and tag not in WRAPPERS)
        if tag in ARTICLES:
            outside = above.outside and (firm or marked(names))
        else:
            outside = above.outside or tag in OUTSIDE_TAGS or (tag not in ("html", "body") and marked(names))
            # inside an article, what is marked is not opened again: comments are articles within it
            firm = firm or (outside and not above.outside and innermost(ARTICLES) > 0)
        path = paths.below(above.path, step) if tag in CONTAINERS else above.path
        node = Node(tag, path, outside, len(pieces), above if above.tag in CONTAINERS else above.up, firm)
        places.setdefault(tag, []).append(len(stack))
        stack.append(node)
        nodes.append(node)
        links += tag == "a"
        if tag in BLOCKS:
            fresh = True
    text(n)
    close(1)
    root.end = len(pieces)
    return nodes, pieces, paths


def marked(names: list[str]) -> bool:
    """Whether a class, id or role as a whole is made of words for what is not the article and for boxes ("has-sidebar" is not)."""
    return any(bool(words := set(WORD.findall(name)) - BOX_WORDS) and words <= OUTSIDE_WORDS for value in names for name in NAME.findall(value.lower()))


def score(node: Node) -> float:
    """Text outside links counts, text in links counts against."""
    return node.good - 2 * node.links


def best(nodes: list[Node]) -> Node | None:
    """The outermost container whose text is all article.

    The innermost container with nearly all of the good text lies inside it or is it. An article around that
    is taken whole; another container around it, when it has text of its own or inner containers add
    more text than links. A body is also home to boxes that are not marked, so only its own text and its
    sections and articles count.
    """
    inner = [x for x in nodes if x.tag in CONTAINERS and (not x.outside or x.good)]
    held = [x for x in inner if not x.outside and score(x) > 0]
    if not held:
        # links alone are no reason to drop an article
        return next((x for x in inner if not x.outside and x.tag in ARTICLES and x.good), None)
    most = max(score(x) for x in held)
    chosen = [x for x in held if score(x) >= 0.9 * most][-1]
    below: dict[int, list[Node]] = {}
    for x in inner:
        below.setdefault(id(x.up), []).append(x)
    at = chosen.up
    while at:
        if not at.outside and at.good > chosen.good and (at.tag == "article" or adds(at, chosen, below.get(id(at), []))):
            chosen = at
        at = at.up
    return chosen


def adds(around: Node, chosen: Node, beside: list[Node]) -> bool:
    """Whether a container has article text beside the chosen one inside it; ``beside`` are the containers right below it."""
    own = around.good - around.links - sum(x.good - x.links for x in beside)
    if own > 0:
        return True
    if around.tag == "body":
        return any(x.tag in ("article", "section") and score(x) > 0 and not x.start <= chosen.start < x.end for x in beside)
    return score(around) > score(chosen)


def blocks(pieces: list[tuple[str, Node, bool]], nodes: list[Node]) -> str:
    """The text of some elements: blocks in page order, white space as one space, two line ends between blocks."""
    out: list[list[str]] = []
    done = 0
    for node in nodes:
        new = True
        for piece, top, fresh in pieces[max(done, node.start) : node.end]:
            new = new or fresh
            if top.outside:
                new = True
                continue
            if new:
                out.append([])
                new = False
            out[-1].append(piece)
        done = max(done, node.end)
    lines = (SPACE.sub(" ", "".join(b)).strip() for b in out)
    return "\n\n".join(line for line in lines if line)


def vote(page: str) -> str | None:
    nodes, _, paths = scan(page)
    found = best(nodes)
    return paths.text(found.path) if found else None


def extract(page: str, winners: list[str]) -> tuple[str, str]:
    """Text and path: from all containers on the first winning path that has text here, else from the page's own best."""
    nodes, pieces, paths = scan(page)
    held = [x for x in nodes if x.tag in CONTAINERS and not x.outside]
    whole = Node("", "", False, 0)
    whole.end = len(pieces)
    for path in winners:
        if not path and any(x.good for x in held):
            return blocks(pieces, [whole]), path
        number = paths.number(path)
        if number and (chosen := [x for x in held if x.path == number and x.good]):
            return blocks(pieces, chosen), path
    found = best(nodes)
    if found:
        return blocks(pieces, [found]), paths.text(found.path)
    return blocks(pieces, [whole]), ""


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def consensus(pages: DataFrame, least_share: int = LEAST_SHARE) -> DataFrame:
    """``host, winners``: the paths that have one in ``least_share`` of their host's votes or more, most votes first, ties by the path.

    So a host has at most ``least_share`` of them, however many paths its pages vote for; a path with fewer votes is no consensus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            paths = [vote(h or "") for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("host"), pa.array(paths, pa.string())], ["host", "path"])

    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, path string").where("path IS NOT NULL")
    counted = materialize(votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes")), "host-votes")
    totals = counted.groupBy("host").agg(F.sum("votes").alias("all_votes"))
    held = counted.join(totals, "host").where(F.col("votes") * least_share >= F.col("all_votes"))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("rank"), "path")))
    return held.groupBy("host").agg(ranked["path"].alias("winners"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row for each input row: ``page_id, url, text, n_chars, path``.

    Null or empty html gives an empty text; a page without any container gives its whole text. Pages
    without a host (null url) share the host "". Null ids and repeated rows stay; other columns are
    left out. The table of hosts is stored, so that its real size decides how it is joined; a host with
    most of the pages is split by the join.
    """
    winners = materialize(consensus(pages), "host-paths")
    own = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(winners, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            found = [extract(h or "", w or []) for h, w in zip(part.column("html").to_pylist(), part.column("winners").to_pylist(), strict=True)]
            columns = [pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int64()), pa.array([p for _, p in found], pa.string())]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), *columns], ["page_id", "url", "text", "n_chars", "path"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return own.select("page_id", "url", "html", "winners").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint, path string")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"))
