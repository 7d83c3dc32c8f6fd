"""Main text of web pages by line-block distribution.

Markup is stripped so that every block element leaves one line of text. Lines
of menus, headers, footers, sidebars, notices, adverts, forms and reader
comments are dropped, and lines of nothing but links weigh nothing. The
weights are summed over a sliding window of lines: where the sum rises from
nothing is a surge point, where it falls to nothing a dive point. Where article
and main elements hold most of the text, their lines are kept; any other page
keeps every stretch from a surge to a dive, with the few links in it. A longer
run of lines of nothing but links, which parts two stretches, is a menu where
one side of it has little text, as between a slogan or a copyright line and the
article, and a list of the article where both sides have much.

An element is beside the text by its tag, its role, or a class or id that says
nothing else ("ad-slot", but not "has-sidebar" or "post-header"). One that its
name alone puts aside is text after all if it is large and holds nearly all the
text of the page, as a wrapper does.

Each page is a row of its own: there is no shuffle, and a task holds one batch.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm import text as tx
from tidemark.llm.tables import packed_row

# Lines in a window.
WINDOW = 3
# Characters outside links, and the share of the page's, from which a name puts no element aside.
LARGE, MOST = 500, 0.8
# Share of the largest stretch's characters from which a stretch has much text.
MUCH = 0.25

# Inside of a tag. A tag without its end ends before the next one, or with the page.
INSIDE, END = r"(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+", r"(?:>|(?=<)|\Z)"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|object|select|textarea|canvas|audio|video|title)\b" + INSIDE + ">.*?(?:</(?P=raw)\\s*>|\\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][\w:-]*+)(?P<attrs>" + INSIDE + ")" + END
    + r"|<[!?][^<>]*+" + END, re.S | re.I)
ATTRIBUTE = re.compile(r"([\w:-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
BLOCKS = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot
    th thead tr ul""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements whose end tag may be missing: the next block ends them.
OPEN_ENDED = frozenset("p li dt dd td th tr option".split())
EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
ASIDE = frozenset("nav footer aside form button menu dialog head label datalist".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
ASIDE_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promos promotion banner sidebar menu nav
    navbar navigation breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent gdpr notice notices notification alert
    newsletter subscribe subscription paywall popup modal overlay comment comments commentlist disqus respond replies related recommended
    share sharing social widget toolbar pagination pager login signup search copyright""".split())
# Words of readers' comments, which may be longer than the text.
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond replies".split())
# Words that may stand beside those in a name.
NEUTRAL = frozenset("""site page main top bottom left right primary secondary global header footer form list links link buttons button btn box bar
    block area container wrapper wrap section inner outer slot unit zone posts articles stories items item icons icon menu dropdown mobile
    desktop sticky fixed floating inline center google text message""".split())


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)}


def _named(names: str) -> str:
    """Whether one of the names means an aside: "", "name", or "comments"."""
    found = ""
    for name in names.lower().split():
        words = [w for w in re.split(r"[_-]+|\d+", name) if w]
        if not ASIDE_WORDS.isdisjoint(words) and all(w in ASIDE_WORDS or w in NEUTRAL for w in words):
            if not COMMENT_WORDS.isdisjoint(words):
                return "comments"
            found = "name"
    return found


def _aside(name: str, attrs: str, inside: bool) -> str:
    """What puts an element beside the article: "", "tag", or what `_named` says."""
    if name in ASIDE or name == "header" and not inside:
        return "tag"
    if not attrs or name in ("html", "body", "main"):
        return ""
    a = _attributes(attrs)
    if a.get("role", "").lower() in ASIDE_ROLES or "hidden" in a or a.get("aria-hidden") == "true":
        return "tag"
    if re.search(r"display\s*:\s*none", a.get("style", ""), re.I):
        return "tag"
    return _named(f"{a.get('class', '')} {a.get('id', '')}")


def lines(page: str, text_at: frozenset[int] = frozenset()) -> tuple[list[tuple[str, int, bool]], dict[int, int]]:
    """Text, weight and whether inside an article, for each line of the page;
    and where the elements start that their name puts aside, with their characters.

    The elements that start at the places `text_at` are no asides by name.

    A linked h1 is a headline, and so are linked headings right before text:
    they weigh as text.
    """
    out: list[tuple[str, int, bool]] = []
    text: list[str] = []
    plain: list[str] = []  # of the line, what no link holds
    link = articles = 0
    heading, headings = "", 0  # the heading that is open, and linked ones just before this line
    skip, depth = "", 0  # the element being dropped, and how often it is open
    named: dict[int, int] = {}
    where = -1          # the place of the element being dropped, if its name is why

    def close() -> None:
        nonlocal headings
        t = " ".join(html.unescape("".join(text)).split())
        only_links = len(plain) < len(text) and not any(c.isalnum() for c in html.unescape("".join(plain)))
        text.clear()
        plain.clear()
        if not t:
            return
        if only_links and heading != "h1":
            headings = headings + 1 if heading else 0
            out.append((t, 0, articles > 0))
            return
        for k in range(len(out) - headings, len(out)):
            out[k] = (out[k][0], len(out[k][0]), out[k][2])
        headings = 0
        out.append((t, len(t), articles > 0))

    def add(t: str) -> None:
        if skip:
            if where >= 0 and not link:
                named[where] += len(t.strip())
        elif t:
            text.append(t)
            if not link:
                plain.append(t)

    at = 0
    for m in TOKEN.finditer(page):
        add(page[at: m.start()])
        at = m.end()
        if m["name"] is None:
            continue
        name, end, attrs = m["name"].lower(), bool(m["end"]), m["attrs"]
        if skip:
            if name in ("article", "main") and not end and skip not in ("article", "main"):
                skip = ""  # an aside without its end tag
            elif skip in OPEN_ENDED and name in BLOCKS and name != "br" and not (end and name == skip):
                skip = ""
            elif name == skip:
                depth += -1 if end else 1
                if not depth:
                    skip, link = "", 0
                    continue
            if skip:
                link = link if name != "a" else 0 if end else 1
                continue
            link = 0
        if name in BLOCKS:
            close()
            if name in HEADINGS:
                heading = "" if end else name
        if name == "a":
            link = 0 if end else 1
        why = "" if end or name in EMPTY else _aside(name, attrs, articles > 0)
        if why and not (why == "name" and m.start() in text_at):
            close()
            skip, depth, heading = name, 1, ""
            where = m.start() if why == "name" else -1
            named |= {where: 0} if where >= 0 else {}
        elif name in ("article", "main"):
            articles = max(0, articles + (-1 if end else 1))
    add(page[at:])
    close()
    return out, named


def stretches(weights: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """Start and end line of each stretch between a surge and a dive."""
    total = [sum(weights[max(0, i - window + 1): i + 1]) for i in range(len(weights) + window)]
    found, start = [], None
    for i, t in enumerate(total):
        if t and start is None:
            start = i
        elif not t and start is not None:
            found.append((start, i - window + 1))
            start = None
    if start is not None:
        found.append((start, len(weights)))
    return found


def joined(weights: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """The stretches, those with much text and all between them as one."""
    found = stretches(weights, window)
    sizes = [sum(weights[a:b]) for a, b in found]
    much = [k for k, n in enumerate(sizes) if n >= MUCH * max(sizes)]
    if not much:
        return found
    first, last = much[0], much[-1]
    return [*found[:first], (found[first][0], found[last][1]), *found[last + 1:]]


def main_text(page: str | None) -> str:
    """The blocks of the main text, joined by a blank."""
    text_at: frozenset[int] = frozenset()
    while True:
        all_lines, named = lines(page or "", text_at)
        total = sum(w for _, w, _ in all_lines)
        at = max(named, key=named.__getitem__, default=-1)
        if at < 0 or named[at] < max(LARGE, MOST * (total + sum(named.values()))):
            break
        text_at |= {at}
    # Lines outside articles are left only where those hold most of the text.
    if any(inside for _, _, inside in all_lines) and 2 * sum(w for _, w, inside in all_lines if inside) >= total:
        return " ".join(t for t, _, inside in all_lines if inside)
    found = joined([w for _, w, _ in all_lines])
    return " ".join(t for a, b in found for t, _, _ in all_lines[a:b])


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """`row` (the columns given, or those in `keep`) and `main_text`.

    Character references are decoded, white space inside a block is one blank,
    blocks are joined by one blank in page order. A NULL or empty page and a
    page without main text give the empty text; repeated rows give equal rows;
    no rows give none. The columns given may have any names.
    """
    d = pages.select(packed_row(pages.select(*keep) if keep else pages), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in tx.slices(batches, "html"):
            yield pa.RecordBatch.from_arrays(
                [s.column("row"), pa.array([main_text(p) for p in s.column("html").to_pylist()], pa.string())], ["row", "main_text"])

    return d.mapInArrow(run, T.StructType([d.schema["row"], T.StructField("main_text", T.StringType())]))


def digest(result: DataFrame) -> DataFrame:
    return result.select("row.page_id", "row.url", F.col("main_text").alias("text"), F.char_length("main_text").cast("bigint").alias("n_chars"))
