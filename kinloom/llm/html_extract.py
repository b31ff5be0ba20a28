"""Main-text extraction from web pages by equivalence-class template deduction.

1. each page is cut into tokens in their order: elements, signed by the path of tags and names that leads to them, and
   the text of each block, signed by its text and the path of tags around it;
2. for each host, a token's occurrence vector (how often it occurs in each of the host's pages) is summed into a
   fingerprint with partial sums before the shuffle, so a host with a third of all pages is no hot group; tokens of a
   host with equal vectors form an equivalence class;
3. a class is valid by its own vector: it covers at least ``support`` pages, holds an element, and in each of its pages
   its tokens come in one order (as often as the vector says) and it nests: between two tokens of another class that
   class is met in one slot only, the same in all pages.  Its texts are template, of page or section alike;
   everything else sits in slots.  A text on ``share`` of the host's pages is template without that (broken pages);
4. a page's text is what fills the slots outside the elements that never hold main text: head, nav, header, footer,
   aside, form, script, style (a heading in the header of a marked element is its title and stays), and outside articles
   inside an article, which are comments or teasers (unless the outer one holds nothing but headings).  Elements inside a line of text (links, spans, buttons, drawings) never
   cut it; what a button or a label in it says is no text;
5. names of elements are hints.  An element whose whole name says advert, notice, comments or the like is furniture, and
   so is one named after such a thing and a container (``comments-area``, ``related-posts``); a name that only holds
   such a word (``social-history``, ``header-image-credit``) says nothing by itself, nor does the name of an element
   inside a line of text, and a paragraph or heading is judged by whole names only.  If names leave nothing of a page,
   they are dropped: first those around the marked element, then all;
6. where a page marks its main element (main, else article), the mark says which slots are main, and breaks ties: a
   template text in there goes if its element is of the same class, and stays if its element also holds other text (a
   sentence that many articles share); a marked element of which nothing would be left is kept whole.

The template of a host is joined to its pages: as a broadcast while all templates are small, else by (host, salt), so
that a large host's pages spread over many tasks and only its few template rows are copied.

Defined results: null or empty html gives an empty text; a page whose host has too few pages has no deduced template
and relies on steps 4 to 6; unclosed elements end with the page; pages repeated word for word count once for the vectors;
an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import functools
import hashlib
import html
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, staged

SUPPORT = 3
SHARE = 0.6
SALT = 16
#: Template rows that are broadcast at most.
SMALL = 500_000

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*(?:>|$)|<\?[^>]*(?:>|$)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_MARK = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"[\s ]+")

# Fixed values of HTML: elements without content, elements that break a line of text, raw text elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style noscript template iframe object svg math canvas textarea title xmp noembed noframes".split())
#: Elements inside a line of text; those of the second set hold no text of it.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rp rt s samp small span strike strong sub sup time tt u var picture".split())
QUIET = frozenset("button select label input option optgroup datalist output meter progress audio video map".split())
FURNITURE = frozenset("head nav header footer aside form menu dialog".split()) | RAW | QUIET
#: Elements whose start or end breaks a line of text.
APART = (BLOCK | FURNITURE) - QUIET - RAW | {"title", "xmp"}
#: Names that mark an element as no part of the main text.
FURNITURE_NAMES = frozenset(
    """ad ads advert adverts advertisement advertisements advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices
    popup modal overlay newsletter subscribe subscription signup comment comments respond disqus replies reply sidebar side-bar sidenav nav navbar navigation
    menu breadcrumb breadcrumbs header masthead footer share sharing social related recommended recommendations widget widgets pagination pager toolbar
    login search alert complementary contentinfo""".split()
)
#: Kinds of furniture that name a container together with one of CONTAINERS.
KINDS = frozenset(
    """ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent newsletter subscribe subscription signup comment comments disqus
    replies reply sidebar nav navbar navigation breadcrumb breadcrumbs share sharing related recommended recommendations widget pagination popup modal login""".split()
)
CONTAINERS = frozenset(
    """area bar bars block blocks body box boxes buttons card cards column container entry feed footer form grid group header holder inner item items layer link links list lists outer panel
    placeholder popup post posts row section shell slot slots stories teasers thread unit widget wrap wrapper zone articles banner notice modal overlay prompt""".split()
)
_P_CLOSERS = BLOCK - {"html", "body"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MARKED = frozenset(("article", "main"))


def _hint(tag: str, attrs: str) -> bool:
    """Whether a name of the element says that it is furniture."""
    if not attrs or tag in ("html", "body", "main") or tag in INLINE or tag in QUIET:
        return False
    for m in _MARK.finditer(attrs):
        for name in (m.group(1) or m.group(2) or m.group(3) or "").lower().split():
            if name in FURNITURE_NAMES:
                return True
            kind, *rest = [x for x in re.split(r"[-_]+", name) if x] or [""]
            if rest and tag != "p" and tag not in HEADINGS and kind in KINDS and all(x in CONTAINERS or x in KINDS or x.isdigit() for x in rest):
                return True
    return False


def _names(attrs: str) -> str:
    return "." + " ".join(m.group(1) or m.group(2) or m.group(3) or "" for m in _MARK.finditer(attrs)) if attrs else ""


class Block(NamedTuple):
    path: str  # tags around the text that break lines or are furniture
    zone: int  # 2 in main, 1 in article, 0 elsewhere
    barred: bool  # in an element that never holds main text
    nested: bool  # in an article inside an article
    inner: bool  # a name hints inside the innermost marked element, or anywhere where there is none
    outer: bool  # one hints around it, or its own does
    text: str


def blocks(page: str, tokens: list | None = None) -> list[Block]:
    """The text blocks of a page in their order.

    tokens gets (element trail, None) for each element, and (trail of its block element, its index in the result) for each block.
    """
    out: list[Block] = []
    stack: list[tuple[str, bool]] = []
    trails: list[str] = []
    buffer: list[str] = []

    def flush():
        if buffer:
            text = _SPACE.sub(" ", "".join(buffer)).strip()
            buffer.clear()
            if text:
                tags = [t for t, _ in stack]
                marks = [k for k, t in enumerate(tags) if t in MARKED]
                zone = 2 if "main" in tags else 1 if "article" in tags else 0
                title = marks and any(t in HEADINGS for t in tags[marks[0] :])
                barred = any(t in FURNITURE and not (title and t == "header" and k > marks[0]) for k, t in enumerate(tags))
                hints = [k for k, (_, h) in enumerate(stack) if h]
                if tokens is not None:
                    own = next((trails[k] for k in range(len(stack) - 1, -1, -1) if stack[k][0] in BLOCK or stack[k][0] in FURNITURE), "")
                    tokens.append((own, len(out)))
                path = "/".join(t for t in tags if t in BLOCK or t in FURNITURE)
                out.append(Block(path, zone, barred, tags.count("article") > 1, any(not marks or k > marks[-1] for k in hints), any(marks and k <= marks[-1] for k in hints), text))

    def say(text):
        if not any(t in QUIET for t, _ in stack):
            buffer.append(html.unescape(text))

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag, attrs = tag.lower(), m.group(3) or ""
        if m.group(1):
            if tag in ("br", "p") and not any(t == tag for t, _ in stack):
                if tag == "br":
                    buffer.append(" ")
                else:
                    flush()
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if any(t in APART for t, _ in stack[k:]):
                        flush()
                    del stack[k:], trails[k:]
                    break
            continue
        if tag == "br" or tag == "wbr" or tag == "img":
            if tag != "wbr":
                buffer.append(" ")
            continue
        if tag in APART:
            flush()
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
            continue
        if tag in _P_CLOSERS:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    del stack[k:], trails[k:]
                    break
                if stack[k][0] in BLOCK:
                    break
        if tag in RAW:  # its content is no markup
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        stack.append((tag, _hint(tag, attrs)))
        trails.append((trails[-1] if trails else "") + "/" + tag + _names(attrs))
        if tokens is not None:
            tokens.append((trails[-1], None))
    flush()
    return out


def _signature(path: str, text: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{path}\0{text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@functools.lru_cache(20_000)
def _element(trail: str) -> int:
    return _signature(trail, "<")


def _tokens(batches):
    """The tokens of each page in their order; own: the element of a text's block, null for elements."""
    for b in batches:
        seqs, owns = [], []
        for text in b.column("html").to_pylist():
            tokens: list = []
            found = blocks(text, tokens)
            seqs.append([_element(t) if k is None else _signature(found[k].path, found[k].text) for t, k in tokens])
            owns.append([None if k is None else _element(t) for t, k in tokens])
        arrays = [pa.array(x, pa.list_(pa.int64())) for x in (seqs, owns)]
        yield pa.record_batch([b.column("host"), b.column("ph"), *arrays], names=["host", "page", "seq", "own"])


def nesting(seq: list[int], class_of: dict[int, int]) -> dict[int, tuple[bool, str]]:
    """class -> (ordered and nested in this page, its order and slots as text)."""
    runs: dict[int, list[int]] = {}
    for t in seq:
        if (c := class_of.get(t)) is not None:
            runs.setdefault(c, []).append(t)
    base, bad = {}, set()
    for c, run in runs.items():
        base[c] = list(dict.fromkeys(run))
        if run != base[c] * (len(run) // len(base[c])):
            bad.add(c)
    slots: dict[int, set] = {c: set() for c in runs}
    stack: list[list[int]] = []  # [class, tokens of it met]
    for t in seq:
        c = class_of.get(t)
        if c is None or c in bad:
            continue
        if any(o == c for o, _ in stack):
            while stack[-1][0] != c:  # it began after c and goes on past c's next token
                bad.add(stack.pop()[0])
        else:
            slots[c].add(tuple(stack[-1]) if stack else ())
            stack.append([c, 0])
        stack[-1][1] += 1
        if stack[-1][1] == len(base[c]):
            stack.pop()
    return {c: (c not in bad, f"{base[c]}{sorted(slots[c])}") for c in runs}


def _nestings(batches):
    for b in batches:
        found: dict = {}
        for host, seq, classes in zip(b.column("host").to_pylist(), b.column("seq").to_pylist(), b.column("classes").to_pylist()):
            for c, (good, form) in nesting(seq, {x["signature"]: x["class"] for x in classes}).items():
                found[host, c, good, _signature(form, "")] = None
        columns = zip(*found) if found else [[]] * 4
        types = (pa.int64(), pa.int64(), pa.bool_(), pa.int64())
        yield pa.record_batch([pa.array(list(x), t) for x, t in zip(columns, types)], names=["host", "class", "good", "form"])


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _beside(pages: DataFrame, by_host: DataFrame, rows: int, how: str) -> DataFrame:
    """pages (host, ph, ...) with the one row of their host in by_host, which holds so many rows in its lists."""
    if rows <= SMALL:
        return pages.join(F.broadcast(by_host), "host", how)
    salted = by_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return pages.withColumn("salt", F.pmod("ph", F.lit(SALT)).cast("int")).join(salted, ["host", "salt"], how).drop("salt")


def templates(pages: DataFrame, support: int = SUPPORT, share: float = SHARE) -> DataFrame:
    """(host, signature, sure) of the template; pages: (host, ph, html).

    sure: a text's element is of its class; for an element: it is itself of a valid class.
    """
    cut = pages.select("host", "ph", "html").mapInArrow(_tokens, "host long, page long, seq array<long>, own array<long>")
    cut = staged(cut.dropDuplicates(["host", "page"]), "tokens")
    each = cut.select("host", "page", F.explode(F.arrays_zip("seq", "own")).alias("t")).select("host", "page", F.col("t.seq").alias("signature"), F.col("t.own").alias("own"))
    # a page's rows come together, so its repeated tokens are summed before the shuffle
    seen = each.groupBy("host", "signature", "page").agg(F.count("*").alias("times"), F.min("own").alias("own"))
    mix = [F.shiftright(F.xxhash64(F.lit(k), "page", "times"), 20).alias(f"v{k}") for k in (1, 2)]  # 44 bits: sums stay in a long
    vectors = seen.select("host", "signature", "own", *mix).groupBy("host", "signature").agg(F.sum("v1").alias("v1"), F.sum("v2").alias("v2"), F.count("*").alias("n"), F.min("own").alias("own")).filter(F.col("n") >= support)
    sizes = cut.groupBy("host").agg(F.count("*").alias("pages"))
    classes = vectors.groupBy("host", "v1", "v2", "n").agg(F.collect_list(F.struct("signature", "own")).alias("tokens"))  # tokens of a page at most
    often = F.col("n") >= F.col("pages") * share
    framed = F.exists("tokens", lambda t: t["own"].isNull())
    classes = classes.join(sizes, "host").select("host", F.xxhash64("v1", "v2", "n").alias("class"), "tokens", often.alias("often"), framed.alias("framed"))
    classes = staged(classes.filter("often or framed"), "classes")
    rows = classes.select("host", "class", F.explode("tokens.signature").alias("signature"))
    by_host = rows.groupBy("host").agg(F.collect_list(F.struct("signature", "class")).alias("classes"))
    found = _beside(cut.withColumnRenamed("page", "ph"), by_host, rows.count(), "inner").select("host", "seq", "classes")
    found = found.mapInArrow(_nestings, "host long, class long, good boolean, form long").groupBy("host", "class")
    valid = found.agg((F.min("good") & (F.min("form") == F.max("form"))).alias("valid"))
    judged = classes.join(valid, ["host", "class"]).withColumn("valid", F.col("valid") & F.col("framed")).filter("valid or often")
    rows = judged.select("host", "valid", "tokens", F.explode("tokens").alias("t")).filter("valid or t.own is not null")
    return rows.select("host", "t.signature", (F.col("valid") & (F.col("t.own").isNull() | F.array_contains("tokens.signature", F.col("t.own")))).alias("sure"))


def main_text(page: str, template) -> str:
    """The blocks in the slots of the page's main element, joined by an empty line; template: signature -> sure."""
    found = [b for b in blocks(page) if not b.barred]
    if any(b.zone and not b.nested and b.path.rpartition("/")[2] not in HEADINGS for b in found):
        found = [b for b in found if not b.nested]
    marked, main = any(b.zone for b in found), []
    for names in (2, 1, 0):  # all names count, those inside the marked element, none
        main = [b for b in found if (b.zone or not marked) and not (names and b.inner) and not (names > 1 and b.outer)]
        if main:
            break
    zone = max((b.zone for b in main), default=0)
    main = [b for b in main if b.zone == zone]
    if not template:
        return "\n\n".join(b.text for b in main)
    slots = []
    for b in main:
        sure = template.get(_signature(b.path, b.text))
        if sure is None or zone and not sure:
            slots.append(b.text)
    if zone and not slots:
        slots = [b.text for b in main]
    return "\n\n".join(slots)


def _extract(batches):
    for b in batches:
        text = [main_text(page, None if t is None else {x["signature"]: x["sure"] for x in t}) for page, t in zip(b.column("html").to_pylist(), b.column("template").to_pylist())]
        columns = [pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())]
        yield pa.record_batch([b.column("page_id"), b.column("url"), *columns], names=["page_id", "url", "text", "n_chars"])


def extract_main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", support: int = SUPPORT, share: float = SHARE) -> DataFrame:
    """(page_id, url, text, n_chars), one row for each row of df."""
    page = F.coalesce(F.col(html_col), F.lit(""))
    pages = bounded_batches(df).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), page.alias("html"), F.xxhash64(host_of(F.col(url_col))).alias("host"), F.xxhash64(page).alias("ph"))
    deduced = staged(templates(pages, support, share), "templates")
    by_host = deduced.groupBy("host").agg(F.collect_list(F.struct("signature", "sure")).alias("template"))
    slots = _beside(pages, by_host, deduced.count(), "left").select("page_id", "url", "html", "template")
    return slots.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir):
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
