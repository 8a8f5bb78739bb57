"""The main text of web pages by the distribution of text over lines.

Markup is read in one pass. A line is the text of a block: what stands between two tags of block elements or ``<br>``. Scripts,
styles, comments, and elements that say by tag, role, attribute or name that they are menus, headers, footers, sidebars, notices, adverts, forms or
reader comments are stripped; each leaves one empty line. A line counts its code points outside links.

The sums over ``WINDOW`` consecutive lines are the distribution. The text begins where they surge past a threshold and goes on
to where they dive to nothing; a page can have several such stretches. Where a page marks its article (``article``,
``main``, or an element named so that holds half of the text), the distribution is taken inside it and any text is a surge. Elsewhere the
threshold is ``SURGE`` code points, or a quarter of the page's highest sum if that is less; the short lines at both ends of a stretch go, except
headings at its start, and so does what stands before a page's only ``h1``, after a heading about comments or after a copyright sign. A heading
that says no more than that comments follow ends the text on every page.

Character references are decoded after markup is read. White space is what Unicode says, so that no-break spaces count too.

Scale: a map over rows, no exchange; a page is read in time linear in its length and no other is held.

Nulls: a null html counts as empty; page_id and url pass as they are. Empty text: the empty string. Very long texts: whole. Repeated rows:
each by itself. Unclosed elements end with their parent; an unclosed script, comment or tag takes the rest of the page, as in browsers.
Empty table: no rows. Columns beyond those named are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import column, of_columns, pieces, table, through

WINDOW = 3
SURGE = 86
#: Lines of less code points at the ends of a stretch are no part of an article that isn't marked.
SHORT = 40

# A tag from its name on; quotes count after "=" alone. Possessive, so that it takes linear time.
_TAG = re.compile(r"""(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

RAW = {"script", "style", "title", "textarea", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BARRED_TAGS = set("nav footer aside form noscript template svg math canvas object button select datalist menu dialog audio video map".split())
BARRED_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
#: First or last words of a class or an id that say what an element is.
BARRED_NAMES = set(
    """ad ads adv advert adverts advertisement advertisements advertising adsense adbox adslot banner banners sponsor sponsored sponsors promo promos promotion
    nav navbar navigation navi menu menus submenu breadcrumb breadcrumbs pagination pager sitemap toc toolbar topbar masthead footer foot colophon copyright
    sidebar sidebars aside rail widget widgets related recommended recommendations trending popular notice notices cookie cookies consent gdpr
    alert alerts popup popups modal modals overlay lightbox newsletter subscribe subscription signup login register search share shares sharing social
    comment comments commentlist commentary disqus discussion respond response responses replies reply feedback talkback form forms poll survey
    bar skip skiplink links teaser teasers announcement announcements notification notifications disclaimer legal""".split()
)
#: The same for what an article is.
NAMED = set("article story entry post content main".split())
#: Those that also count at an end of a name written as one word.
_ENDS = tuple(n for n in sorted(BARRED_NAMES) if len(n) > 5) + ("nav", "menu")
_NAMED_ENDS = ("article", "story", "content", "entry")
_LABELS = BARRED_NAMES - {"bar", "form", "forms", "links", "notice", "notices", "popular", "legal", "rail", "toc", "foot", "respond", "response"}
#: A heading that says nothing else than that comments follow.
_COMMENTS_FOLLOW = re.compile(r"(?:\d+\s+)?(?:(?:reader|readers'|user|all|latest)\s+)?(?:comments?|replies|responses|discussion|leave a (?:comment|reply)|kommentare?|commentaires?|comentarios?|commenti)\s*(?:\(?\d+\)?)?\s*:?", re.I)
_COMMENTS = re.compile(r"\b(?:comments?|repl(?:y|ies)|kommentare?|commentaires?|comentarios?|commenti)\b", re.I)
_COPYRIGHT = re.compile(r"(?:©|copyright\b)", re.I)
#: Names that contain such a word and speak of what is not there or stands beside.
_BESIDE = {"has", "with", "no", "show", "hide", "without"}
_KEPT_TAGS = {"html", "body", "main"}


def barred(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is no part of an article; ``inside``: it stands in one."""
    if tag in _KEPT_TAGS:
        return False
    if tag in BARRED_TAGS or tag == "header" and not inside:
        return True
    if not attributes or attributes.isspace():
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.strip().lower() in BARRED_ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name in ("class", "id"):
            for part in unescape(value).split():
                words = [w.lower() for w in _WORD.findall(part)]
                if not words or _BESIDE & set(words):
                    continue
                if words[0] in BARRED_NAMES or words[-1] in BARRED_NAMES or len(words) == 1 and (words[0].endswith(_ENDS) or words[0].startswith(_ENDS[:-2])):
                    return True
                if words[-1].endswith("header") and not inside and not words[0].startswith(("article", "entry", "post", "story")):
                    return True
        if name == "aria-label" and _LABELS & set(value.lower().split()):
            return True
    return False


def article_level(tag: str, attributes: str) -> int:
    """3: an article by tag; 2: the main part; 1: an article by name; else 0."""
    if tag in ("article", "main"):
        return 3 if tag == "article" else 2
    if tag in ("div", "section", "td"):
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values)
            if name == "itemprop" and value.lower() == "articlebody":
                return 3
            if name == "role" and value.lower() in ("main", "article"):
                return 2
            if name in ("class", "id") and any(NAMED & {w[0], w[-1]} or len(w) == 1 and (w[0].startswith(_NAMED_ENDS) or w[0].endswith(_NAMED_ENDS)) for part in value.split() if (w := [x.lower() for x in _WORD.findall(part)])):
                return 1
    return 0


def lines_of(html: str, names: bool = True) -> list[tuple[str, int, str, int]]:
    """(text, code points outside links, tag of a heading, level of the article that it stands in); an element that is stripped is an
    empty line. ``names``: classes, ids and roles count."""
    out: list[tuple[str, int, str, int]] = []
    stack: list[tuple[str, bool, int]] = []  # name, barred, level
    opened: Counter[str] = Counter()
    levels = [0, 0, 0, 0]
    shut = 0
    parts: list[str] = []
    linked: list[str] = []
    link, heading = False, ""

    def level() -> int:
        return 3 if levels[3] else 2 if levels[2] else 1 if levels[1] else 0

    def flush() -> None:
        nonlocal heading
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                beside = len(" ".join(unescape("".join(linked)).split())) if linked else 0
                out.append((text, len(text) - beside, heading, level()))
            parts.clear()
            linked.clear()
        heading = ""

    def pop() -> None:
        nonlocal shut
        name, closed, marked = stack.pop()
        opened[name] -= 1
        levels[marked] -= 1
        if closed:
            shut -= 1
            if not shut:
                out.append(("", 0, "", level()))

    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not shut:
            parts.append(html[at:lt])
            if link:
                linked.append(html[at:lt])
        if lt == n:
            break
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 2 if html.startswith("<!-->", lt) else lt + 4)
            at = n if end < 0 else end + 3
            continue
        after = html[lt + 1 : lt + 2]
        if after in ("!", "?") or after == "/" and not html[lt + 2 : lt + 3].isalpha():
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        if not after or not (after == "/" or after.isascii() and after.isalpha()):
            if not shut:
                parts.append("<")
                if link:
                    linked.append("<")
            at = lt + 1
            continue
        m = _TAG.match(html, lt + 1)
        if m is None:
            break
        at, close, tag = m.end(), m[1], m[2].lower()
        if tag in RAW:
            if not close:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                at = n if end is None else end.start()
            continue
        if close:
            if tag not in INLINE:
                flush()
                link = link and tag == "div"
            elif tag == "a":
                link = False
            if opened[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        block = tag not in INLINE
        if block:
            flush()
            heading = tag if tag in HEADINGS else ""
            while stack and (stack[-1][0] == "p" or stack[-1][0] == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option")):
                pop()
        elif tag == "a":
            link = True
        if tag in VOID:
            continue
        closed = barred(tag, m[3] if names else "", level() > 0)
        if block or closed or shut:
            if closed and not shut and not block:
                flush()
            marked = 0 if closed or shut else article_level(tag, m[3])
            stack.append((tag, closed, marked))
            opened[tag] += 1
            levels[marked] += 1
            shut += closed
    flush()
    return out


def stretches(counts: list[int], threshold: float, window: int = WINDOW) -> Iterator[tuple[int, int]]:
    """[start, end) of each run of lines from a surge of the windows' sums past ``threshold`` to their dive to nothing."""
    n = len(counts)
    total = [0]
    for c in counts:
        total.append(total[-1] + c)
    sums = [total[min(i + window, n)] - total[i] for i in range(n)] + [0]
    i = 0
    while i < n:
        if sums[i] <= threshold or not counts[i]:
            i += 1
            continue
        j = i
        while sums[j]:
            j += 1
        yield i, j
        i = j


def trimmed(lines: list[tuple[str, int, str, int]], i: int, j: int, short: float, title: int | None) -> range:
    """What is left of a stretch on a page that marks no article."""
    if title is not None and i < title < j:
        i = title
    for k in range(i + 1, j):
        text, _, heading, _ = lines[k]
        if heading and len(text) < SURGE and _COMMENTS.search(text) or _COPYRIGHT.match(text):
            j = k
            break
    while i < j - 1 and lines[i][1] < short and not lines[i][2]:
        i += 1
    while i > 0 and lines[i - 1][2] and (title is None or i > title):
        i -= 1
    while j - 1 > i and lines[j - 1][1] < short and not lines[j - 1][0].endswith((".", "!", "?", "…", "。")):
        j -= 1
    return range(i, j)


def main_text(html: str | None) -> str:
    html = (html or "").replace("\0", "\ufffd")
    lines = lines_of(html)
    if not any(c for _, c, _, _ in lines):  # all was stripped by its names
        lines = lines_of(html, names=False)
    follow = next((k for k, line in enumerate(lines) if line[2] and _COMMENTS_FOLLOW.fullmatch(line[0])), len(lines))
    if any(c for _, c, _, _ in lines[:follow]):
        lines = lines[:follow]
    held = [sum(c for _, c, _, at in lines if at >= level) for level in range(4)]
    inside = next((level for level in (3, 2, 1) if held[level] and 2 * held[level] >= held[1 if level > 1 else 0]), 0)
    counts = [c if at >= inside else 0 for _, c, _, at in lines]
    highest = max((sum(counts[i : i + WINDOW]) for i in range(len(counts))), default=0)
    keep: list[int] = []
    if inside:
        for i, j in stretches(counts, 0):
            keep += [k for k in range(i, j) if lines[k][3] >= inside]
    else:
        titles = [k for k, line in enumerate(lines) if line[2] == "h1"]
        for i, j in stretches(counts, min(SURGE, highest / 4)):
            keep += trimmed(lines, i, j, min(SHORT, highest / 4), titles[0] if len(titles) == 1 else None)
    return " ".join(lines[k][0] for k in dict.fromkeys(keep) if lines[k][0])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: a row for each page."""
    pages = of_columns(pages, "page_id", "url", "html")
    kinds = dict(pages.dtypes)

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "html"):
                texts = [main_text(x) for x in column(piece, "html").to_pylist()]
                yield pa.RecordBatch.from_arrays([column(piece, "page_id"), column(piece, "url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return through(pages, run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op12_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
