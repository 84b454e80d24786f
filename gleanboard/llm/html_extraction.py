"""Main text of web pages by a site style tree.

Pages of one host are merged: a branch is a path of element names and classes,
a node a text on its branch, and Spark counts on how many different pages of the
host a node stands. A node of most of its branch's pages tells little: it is
template, and is removed from every page of the host; nothing else of its
branch is. Pages count once however often they are copied, also with small
changes: pages are copies if they are alike apart from the repeated nodes, or if
one repeated node heads them and such nodes are most of their text. So a host of
copied pages keeps its texts. Running text of an article is judged like any
other, at a lower bound.

Before that, what names itself is left out: menus, headers, footers, sidebars,
forms, scripts, styles, adverts, notices and reader comments, by element, class,
id or role. If a page has an article (or main) element with text, only that
counts.

Defined results: a null or empty page has the empty text; a null address is a
host of its own; markup may be cut off anywhere; repeated rows are each
extracted; pages of any length are read whole; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements that lie inside a line.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small "
             "span strike strong sub sup time tt u var wbr".split())
EMPTY = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold running text.
TEXT = set("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption".split())
NOISE = set("nav header footer aside form head menu dialog button select option fieldset script style noscript template".split())
#: Words of classes, ids and roles that name something other than the main text.
NOISE_NAMES = set("ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice "
                  "notices alert newsletter subscribe subscription sidebar aside menu nav navbar navigation breadcrumb breadcrumbs header "
                  "footer comment comments disqus reply replies related share sharing social popup modal overlay login signup "
                  "widget toolbar pagination pager copyright search complementary contentinfo".split())
ROOTS = {"article", "main"}
#: A node is removed if it stands on so many different pages, at or below this importance.
LEAST_PAGES, LEAST_IMPORTANCE = 10, 0.2
#: That a text runs in an article speaks for it: it must be repeated more often.
LEAST_IN_ARTICLE = 0.1


@dataclass
class Block:
    """Running text and the branch that it hangs on."""

    branch: tuple[str, ...]
    noise: bool
    rooted: bool
    plain: bool
    pieces: list[str] = field(default_factory=list)


def blocks(page: str) -> list[tuple[Block, str]]:
    """The blocks of a page in order, with their text; blocks without text are left out."""
    out: list[tuple[Block, str]] = []
    stack: list[tuple[str, str, bool, bool]] = []  # element, label, noise, root
    current: Block | None = None
    at = 0

    def flush():
        nonlocal current
        if current is not None:
            text = " ".join(entities.unescape("".join(current.pieces)).split())
            if text:
                out.append((current, text))
            current = None

    def add(text: str):
        nonlocal current
        if current is None:
            if not text.strip():
                return
            roots = [i for i, x in enumerate(stack) if x[3]]
            inside = stack[roots[-1] + 1:] if roots else stack
            current = Block(tuple(x[1] for x in stack), any(x[2] for x in stack), bool(roots),
                            bool(roots) and all(x[0] in TEXT for x in inside))
        current.pieces.append(text)

    for m in TOKEN.finditer(page):
        if m.start() > at:
            add(page[at: m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name or name in INLINE:
            continue
        if name == "br":
            add(" ") if current is not None else None
            continue
        flush()
        if name in EMPTY:
            continue
        if m[2]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None:
                del stack[depth:]
            continue
        if stack and stack[-1][0] == "p":
            stack.pop()
        if name in ("li", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] in ({name} | ({"td", "th"} if name in ("td", "th") else set())):
            stack.pop()
        label, noise = name, name in NOISE
        root = name in ROOTS
        if m[4]:
            words = [w for g in NAMES.findall(m[4]) for w in re.split(r"[^a-z]+", "".join(g).lower()) if w]
            if words:
                label = name + "." + ".".join(words[:4])
                root |= "main" in words and "role" in m[4].lower()
                if name not in ("html", "body") and NOISE_NAMES & set(words):
                    noise = True
        if not m[4].rstrip().endswith("/"):
            stack.append((name, label, noise, root))
    if at < len(page):
        add(page[at:])
    flush()
    return out


def candidates(page: str | None) -> list[tuple[Block, str]]:
    """Blocks that are not named noise; of a page with an article, the article's."""
    found = [(b, t) for b, t in blocks(page or "") if not b.noise]
    rooted = [(b, t) for b, t in found if b.rooted]
    return rooted or found


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]*)", 1), F.lit("")))


def _hash(*parts: str) -> int:
    raw = hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return int.from_bytes(raw, "little", signed=True)


def nodes(page: str | None) -> list[tuple[int, int, Block, str]]:
    """(branch, node, block, text) of the blocks that count; a node is a text on its branch."""
    found = []
    for b, text in candidates(page):
        branch = "/".join(b.branch)
        found.append((_hash(branch), _hash(branch, text), b, text))
    return found


def _same_page(found: list[tuple[int, int, Block, str]], doubted: set[int]) -> int:
    """Equal for copies of a page, also with small changes.

    Of a page that is doubted text for the most part, its longest doubted node; of any other, the least hash of a
    pair of adjacent words of the rest, which is equal as often as the rests share their pairs.
    """
    held = [(len(text), node) for _, node, _, text in found if node in doubted]
    rest = [text for _, node, _, text in found if node not in doubted]
    if sum(n for n, _ in held) > sum(map(len, rest)):
        return max(held)[1]
    words = [w for t in rest for w in t.split()]
    return min((_hash(*words[i: i + 2]) for i in range(max(1, len(words) - 1))), default=0)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, branch, node, plain, page) of every node of a page that may be template.

    ``page`` is equal for pages of equal text; where nodes of the host are doubted, for near copies too.
    """
    for batch in batches:
        rows = []
        for host, page, doubted in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "doubted")), strict=True):
            found = nodes(page)
            same = _hash(*(text for *_, text in found)) if doubted is None else _same_page(found, set(doubted))
            rows += [(host, *x, same) for x in {(branch, node, b.plain) for branch, node, b, _ in found}]
        if rows:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["host", "branch", "node", "plain", "page"])


def importance(pages: DataFrame) -> DataFrame:
    """(host, node, plain, pages, importance) from (host, html, doubted).

    A text that stands on c of a branch's m different pages has the importance 1 - log c / log m:
    0 for a text of every page, 1 for a text of one.
    """
    found = settle(pages.mapInArrow(_merged, "host string, branch long, node long, plain boolean, page long").distinct())
    of_branch = found.select("host", "branch", "page").distinct().groupBy("host", "branch").agg(F.count("*").alias("m"))
    of_node = found.groupBy("host", "branch", "node", "plain").agg(F.count("*").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    return of_node.join(of_branch, ["host", "branch"]).select(
        "host", "node", "plain", "pages", (1 - F.log("pages") / F.log("m")).alias("importance"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for page, template in zip(batch.column("html").to_pylist(), batch.column("template").to_pylist(), strict=True):
            gone = set(template or [])
            texts.append("\n".join(t for _, node, _, t in nodes(page) if node not in gone) if gone else "\n".join(t for _, t in candidates(page)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


#: A list of so many (host, node) is sent to every task; a longer one is joined.
SENT_NODES = 20_000


def _template(pages: DataFrame) -> DataFrame:
    """(host, template, n): the nodes of a host that are removed."""
    low = F.col("importance") <= F.when(F.col("plain"), LEAST_IN_ARTICLE).otherwise(LEAST_IMPORTANCE)
    return settle(importance(pages).where(low).groupBy("host").agg(F.collect_set("node").alias("template"), F.count("*").alias("n")))


def _with(pages: DataFrame, low: DataFrame, how: str) -> DataFrame:
    size = low.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).head()["n"]
    low = low.select("host", "template")
    return pages.join(F.broadcast(low) if size <= SENT_NODES else low, "host", how)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text), one row per page."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    doubted = _template(rows.select("host", "html", F.lit(None).cast("array<long>").alias("doubted")))
    # Copies of a page with small changes are different pages so far: pages alike apart from what is doubted count once.
    low = _template(_with(rows.select("host", "html"), doubted, "inner").withColumnRenamed("template", "doubted"))
    joined = _with(rows, low, "left")
    return joined.select("page_id", "url", "html", "template").mapInArrow(_extract, "page_id long, url string, text string")
