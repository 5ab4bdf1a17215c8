"""Main text of web pages by block rules in two passes.

The page is read tag by tag into blocks. In the first pass every block is
judged by link density, by what the markup around it says, by length and by
stop-word density: good, bad, or undecided, for short blocks and doubtful
ones. In the second an undecided block takes the label of the nearest decided
block of its region, good if both sides are as near or it lies in the article.

Markup is evidence, not a gate. An ``article`` (or ``main``) counts only if it
has its share of the page's prose, so teasers marked as articles don't hide the
text beside them; a container whose class, id or tag names something else
(``sidebar``, ``form``) is not believed if the page's prose lies in it. Where
no article is marked, the innermost container with nearly all the prose and all titles is
one.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from sparkweft.llm import common

#: Elements that end a block, that hold no text of the page, whose text is no markup, that have no end tag.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
NO_TEXT = frozenset("button datalist head iframe input label noscript object select svg template textarea".split())
RAW = frozenset("script style".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that by their name are no part of the article. A header is one only outside of an article.
APART = frozenset("aside dialog footer form menu nav".split())
#: Words in a class, id or role that name something other than the article.
NOISE = frozenset(
    "ad ads adv advert advertisement banner sponsor sponsored promo promotion sidebar side rail widget nav navbar navigation menu breadcrumb breadcrumbs "
    "footer header masthead topbar toolbar comment comments reply replies respond discussion disqus cookie cookies consent gdpr notice notices alert popup "
    "modal overlay subscribe newsletter signup login share sharing social related recommended recommendations pagination pager tags copyright legal disclaimer complementary contentinfo search".split()
)
#: Frequent words of the languages that pages are expected in.
STOP = frozenset(
    "a an and are as at be been but by for from had has have he her his i if in is it its not of on or she that the their there they this to was we were what when which who will with you "
    "au aux avec ce ces dans de des du elle en est et eux il je la le les leur lui ma mais me même mes moi mon ne nos notre nous ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous "
    "aber als am auch auf aus bei bin bis das dass dem den der des die dies doch du durch ein eine einem einen einer es für hat ich ihr im ist ja mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn wie wir zu zum zur "
    "al algo como con cual cuando del desde donde el ella ellos entre era es esa ese eso esta está este esto fue ha hasta hay la las lo los más mi mucho muy nada ni no nosotros o para pero poco por porque quien se ser sin sobre su sus también tan te tiene todo un una y ya yo".split()
)
MAX_LINKS, SHORT, LONG, STOP_LOW, STOP_HIGH = 0.33, 70, 200, 0.12, 0.20
#: A page whose prose has a lower share of stop words is in a language without a list here: they don't count then.
STOP_KNOWN = 0.05
#: Prose that an article has at least, of that in the longest article.
SECOND_ARTICLE = 0.2
#: Elements that may hold an article where none is marked; the share of the prose and of the other blocks around it that such a one has at least.
BOXES = frozenset("div section td center article main".split())
BOX_PROSE, BOX_BLOCKS = 0.9, 0.5

_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_QUOTES = re.compile(r"[>\"']")
_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_ATTR = re.compile(r"(?:\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))|\b(hidden)\b", re.I)
_NAME = re.compile(r"[a-z]+")
_WORD = re.compile(r"[^\W\d_]+")


class _Ends:
    """Where a tag ends, in time that is linear in the page however its quotes are broken.

    A tag ends at the first ``>`` outside of quotes. Where a quote is never
    closed it ends at the first ``>`` of all.
    """

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.table: dict[int, int] | None = None

    def after(self, i: int) -> int:
        """The place after the end of a tag whose name ends at i; there is a ``>`` further on."""
        if self.table is None:
            m = _REST.match(self.page, i)
            if m:
                return m.end()
            self._fill(i)
        m = _QUOTES.search(self.page, i)
        return self.table[m.start()] or self.page.index(">", i) + 1

    def _fill(self, i: int) -> None:
        """For every quote and ``>`` from i on, the end of a tag that meets it outside of quotes (0: none), from the last one back."""
        self.table, plain, single, double = {}, 0, 0, 0
        for m in reversed(list(_QUOTES.finditer(self.page, i))):
            at, sign = m.start(), m[0]
            if sign == ">":
                plain = at + 1
            elif sign == '"':
                plain, double = double, plain
            else:
                plain, single = single, plain
            self.table[at] = plain


def _noisy(attributes: str) -> bool:
    if "=" not in attributes and "hidden" not in attributes:
        return False
    for m in _ATTR.finditer(attributes):
        if m[5]:
            if "=" not in attributes[max(0, m.start() - 1) : m.start()]:
                return True
        elif not NOISE.isdisjoint(_NAME.findall((m[2] or m[3] or m[4] or "").lower())):
            return True
    return False


class _Block:
    __slots__ = ("article", "box", "heading", "hint", "links", "main", "stop", "text")

    def __init__(self, text: str, links: int, hint: int, article: int, main: int, box: int, heading: bool):
        self.text, self.links, self.hint, self.article, self.main, self.box, self.heading = text, links, hint, article, main, box, heading
        words = _WORD.findall(text.lower()) if len(text) >= SHORT else []
        self.stop = sum(w in STOP for w in words) / len(words) if words else 0.0

    def linked(self) -> bool:
        return self.links > MAX_LINKS * len(self.text)

    def prose(self) -> int:
        """Characters of running text."""
        n = len(self.text)
        return n if n >= SHORT and not self.linked() and not self.heading else 0


class _Page:
    """Blocks, and the containers that name something other than the article: parent, whether they may be doubted, whether they hold a title or article."""

    def __init__(self):
        self.blocks: list[_Block] = []
        self.parent, self.doubtful, self.core = [0], [False], [False]
        self.around = [0]  # the box around each box

    def open(self, parent: int, doubtful: bool) -> int:
        self.parent.append(parent)
        self.doubtful.append(doubtful)
        self.core.append(False)
        return len(self.parent) - 1


def parse(page: str) -> _Page:
    """The page's blocks. Every tag, text and attribute is looked at once."""
    out, ends = _Page(), _Ends(page)
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int, int, int, int, int]] = []  # name, and what holds outside of it: hidden, hint, article, main, box
    depth: Counter[str] = Counter()
    hidden = hint = article = main = box = articles = mains = anchors = breaks = 0
    heading = False

    def flush() -> None:
        nonlocal breaks
        if parts:
            raw = "".join(parts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                link = "".join(linked)
                n = len(" ".join((html.unescape(link) if "&" in link else link).split())) if link else 0
                out.blocks.append(_Block(text, n, hint, article, main, box, heading))
            parts.clear()
            linked.clear()
        breaks = 0

    def say(text: str) -> None:
        nonlocal breaks
        if text and not hidden:
            parts.append(text)
            if anchors:
                linked.append(text)
            if not text.isspace():
                breaks = 0

    def close() -> None:
        nonlocal hidden, hint, article, main, box
        name, hidden, hint, article, main, box = stack.pop()
        depth[name] -= 1

    at = look = 0
    while (m := _OPEN.search(page, look)) and m.start() < ends.last:
        say(page[at : m.start()])
        if m[1]:
            stop = page.find("-->", m.end())
            at = look = stop + 3 if stop >= 0 else len(page)
            continue
        if m[2]:
            at = look = page.index(">", m.end()) + 1
            continue
        at = look = ends.after(m.end())
        name, attributes = m[4].lower(), page[m.end() : at - 1]
        if not m[3]:
            if name in RAW:
                stop = _END[name].search(page, at)
                at = look = stop.end() if stop else len(page)
                continue
            if name == "br":
                breaks += 1
                if breaks > 1:
                    flush()
                elif not hidden:
                    parts.append(" ")
                continue
            block = name in BLOCK
            if block:
                flush()
                heading = len(name) == 2 and name[0] == "h" and name != "hr"
                # A paragraph or item that was left open ends here.
                if name in ("p", "li", "td", "tr", "dd", "dt", "option") and stack and stack[-1][0] == name:
                    close()
            if name in VOID or attributes.endswith("/"):
                continue
            if name == "a":
                anchors += 1
            apart = name in APART or (name == "header" and not article and not main)
            named = attributes != "" and name not in ("html", "body", "main") and _noisy(attributes)
            if block or named or name in NO_TEXT:
                if named or apart or name in NO_TEXT:
                    flush()
                stack.append((name, hidden, hint, article, main, box))
                depth[name] += 1
                if name in BOXES:
                    out.around.append(box)
                    box = len(out.around) - 1
                if name in NO_TEXT:
                    hidden = 1
                if apart or named:
                    hint = out.open(hint, not apart or name == "form")
                if hint and (name in ("h1", "article", "main")):
                    out.core[hint] = True
                if name == "article" and not article:
                    articles += 1
                    article = articles
                if name == "main" and not main:
                    mains += 1
                    main = mains
            continue
        if name == "a":
            anchors = max(0, anchors - 1)
            continue
        if depth[name]:
            flush()
            while stack[-1][0] != name:
                close()
            close()
            heading = False
        elif name in BLOCK:
            flush()
    if at < len(page) and not hidden:
        m = _OPEN.search(page, at)  # a tag that the end of the page cuts off
        say(page[at : m.start()] if m else page[at:])
    flush()
    return out


def _believed(page: _Page) -> list[bool]:
    """Which containers are apart from the article, themselves or by one around them."""
    n = len(page.parent)
    prose, core = [0] * n, page.core[:]
    for b in page.blocks:
        prose[b.hint] += b.prose()
    total = sum(prose)
    for i in range(n - 1, 0, -1):
        prose[page.parent[i]] += prose[i]
        core[page.parent[i]] |= core[i]
    out = [False] * n
    for i in range(1, n):
        most = 2 * prose[i] > total
        out[i] = out[page.parent[i]] or not (page.doubtful[i] and most and core[i])
    return out


def _regions(page: _Page, apart: list[bool]) -> list[int]:
    """For each block, the article (or main) that it lies in, 0 if none; all 0 if the longest has less than half the prose of what lies outside."""
    for kind in ("article", "main"):
        prose: Counter[int] = Counter()
        for b in page.blocks:
            if not apart[b.hint]:
                prose[getattr(b, kind)] += b.prose()
        most = max((v for k, v in prose.items() if k), default=-1)
        if 2 * most >= prose[0]:
            return [k if (k := getattr(b, kind)) and prose[k] >= SECOND_ARTICLE * most else 0 for b in page.blocks]
    return _boxed(page, apart)


def _boxed(page: _Page, apart: list[bool]) -> list[int]:
    """1 for the blocks in the box that stands for an article where none is marked, else 0.

    From the page on, the way goes down into a box while it has nearly all the
    prose and its share of the blocks around it, and leaves no title outside.
    """
    n = len(page.around)
    prose, count, titles = [0] * n, [0] * n, [0] * n
    for b in page.blocks:
        if not apart[b.hint] and not b.linked():
            prose[b.box] += b.prose()
            count[b.box] += 1
            titles[b.box] += b.heading
    inner: list[list[int]] = [[] for _ in range(n)]
    for i in range(n - 1, 0, -1):
        up = page.around[i]
        inner[up].append(i)
        prose[up] += prose[i]
        count[up] += count[i]
        titles[up] += titles[i]
    at = 0
    while prose[at] and (down := next((i for i in inner[at] if prose[i] >= BOX_PROSE * prose[at] and count[i] >= BOX_BLOCKS * count[at] and titles[i] == titles[at]), 0)):
        at = down
    if not at:
        return [0] * len(page.blocks)
    within = [i == at for i in range(n)]
    for i in range(at + 1, n):  # a box comes after the one around it
        within[i] = within[page.around[i]]
    return [int(within[b.box]) for b in page.blocks]


def judge(page: _Page) -> list[tuple[bool, str]]:
    """Label of each block, and the rule that gave it: links, markup, outside, length, stop words, neighbours or alone."""
    blocks, apart = page.blocks, _believed(page)
    region = _regions(page, apart)
    article, n = any(region), len(page.blocks)
    prose = [b for b in blocks if b.prose() and not apart[b.hint]]
    known = sum(b.stop * len(b.text) for b in prose) >= STOP_KNOWN * sum(len(b.text) for b in prose)

    first: list[tuple[bool, str] | None] = []
    for b, inside in zip(blocks, region, strict=True):
        size = len(b.text)
        if b.linked():
            first.append((False, "links"))
        elif apart[b.hint]:
            first.append((False, "markup"))
        elif article and not inside:
            first.append((False, "outside"))
        elif size < SHORT or b.heading:
            first.append(None)
        elif inside or not known:
            first.append((True, "length") if size >= LONG else (True, "stop words") if known and b.stop >= STOP_LOW else None)
        elif b.stop < STOP_LOW:
            first.append((False, "stop words"))
        else:
            first.append((True, "stop words") if b.stop >= STOP_HIGH and size > LONG else None)

    # Nearest decided label on either side. Labels stay within a region; what lies apart is passed over.
    near: list[list[tuple[int, bool]]] = []
    for order in (range(n), range(n - 1, -1, -1)):
        side, seen = [(n + 1, False)] * n, {}
        for i in order:
            k = region[i]
            if first[i] is None:
                if k in seen:
                    side[i] = (abs(i - seen[k][0]), seen[k][1])
            elif first[i][1] not in ("markup", "outside"):
                seen[k] = (i, first[i][0])
        near.append(side)
    out = []
    for i in range(n):
        if first[i] is not None:
            out.append(first[i])
            continue
        (da, la), (db, lb) = near[0][i], near[1][i]
        if min(da, db) > n:
            out.append((region[i] > 0, "alone"))
        else:
            out.append((la if da < db else lb if db < da else (la or lb or region[i] > 0), "neighbours"))
    return out


def main_text(page: str) -> str:
    found = parse(page)
    return "\n".join(b.text for b, (keep, _) in zip(found.blocks, judge(found), strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row.

    Null and empty pages, and pages without main text, have an empty text.
    Pages of any length are read whole; repeated rows stay rows; an empty
    table gives none; other columns are not read.
    """
    common.small_batches(pages.sparkSession)
    t = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in common.column_texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"page_id {t[id_col]}, url {t[url_col]}, text string, n_chars bigint")
