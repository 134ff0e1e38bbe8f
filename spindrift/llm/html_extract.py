"""Main text of web pages from flat text blocks.

A page is cut into blocks at block-level tags. A block's features are its word
count and link density and those of the blocks before and after it, and, as
weaker hints, what encloses it: elements that are seldom article text, class and
id names, an article element, a heading, an element of running text. A decision tree, grown by Gini impurity
on the small labelled table of ``LABELLED`` (many of its pages have neither
telling elements nor names), says which blocks are article text. These are
joined in page order.

Every open element is on the stack, list items and paragraphs too, so a block
has the hints of all that encloses it; links stay open across the blocks inside
them. Reading is linear in the page: a tag ends at the first ``>`` outside a quoted
value, what is missing to the end of the page is looked for once, and elements
are counted by name, so that a closing tag without an open one costs nothing.

Character references are decoded, white space within a block becomes one
space. A null or empty page, or one without article text, gives an empty text; a
tag that the page's end cuts off is dropped. Pages of one id are extracted row by
row; extra columns are ignored. Depth and length of a page are not bounded.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements that break the flow of text, elements whose content is no text, and elements that are never article text.
BREAKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
RAW = set("applet audio canvas iframe math noembed noframes noscript object script select style svg template textarea title video xmp".split())
TEXT_ONLY = set("iframe noembed noframes noscript script style textarea title xmp".split())  # of these an open one lasts to the page's end
BOILERPLATE = set("nav aside footer form menu dialog fieldset button search".split())
#: Elements that an opening tag closes, up to the nearest of the elements that hold them.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table tbody thead tfoot"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tr td th", "table")}
_CLOSES = {k: (frozenset(own.split()), frozenset(held.split())) for k, (own, held) in CLOSES.items()}
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold running text, and not parts of a page.
PROSE = HEADINGS | set("p pre blockquote li dt dd td th caption figcaption".split())
#: Words in class, id and role that mark boilerplate.
HINTS = set("""ad ads adv advert adverts advertisement adsense banner breadcrumb breadcrumbs byline-share comment comments commentlist complementary consent contentinfo
cookie cookies copyright discussion disqus dropdown footer footnav form gdpr header login masthead menu modal nav navbar navigation newsletter notice overlay pager pagination
paywall popup promo promoted promotion recommendations recommended related replies reply respond search share sharing sidebar signin signup skip social sponsor sponsored sponsors
subscribe subscription toolbar topbar tracking widget widgets""".split())
#: Words that say no more of a name than that it names a part of a page.
PARTS = set("area article bar block blog body box button buttons container content entry inner item items js line link links list main outer page panel post row section site text top wrap wrapper".split())
_START = re.compile(r"/?[a-zA-Z][^\s/>]*")
_NEXT = re.compile(r""">|=\s*(["'])""")
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++)""", re.I)
_WORD = re.compile(r"[A-Za-z]+(?=[^A-Za-z]|$)")
WHITE = re.compile(r"\s+")


class Block:
    __slots__ = ("text", "words", "links", "element", "hint", "article", "heading", "prose")

    def __init__(self, text: str, words: int, links: int, element: bool, hint: int, article: bool, heading: bool, prose: bool):
        self.text, self.words, self.links, self.element, self.hint, self.article, self.heading, self.prose = text, words, links, element, hint, article, heading, prose


def _hint(attributes: str) -> int:
    """2 if a class, id or role says nothing but boilerplate ("share", "comment-list"), 1 if it has such a word ("related-work"), else 0."""
    level = 0
    for value in _NAMES.findall(attributes) if attributes else ():
        for name in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value.strip("\"'")).split():
            parts = [w.lower() for w in _WORD.findall(name)]
            if name.lower() in HINTS or any(w in HINTS for w in parts):
                level = max(level, 2 if all(w in HINTS or w in PARTS for w in parts) else 1)
    return level


class Page:
    """A page's tags, one after the other; what is not found up to the end is not looked for again."""

    def __init__(self, page: str):
        self.page, self.missing = page, set()

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)  # places only grow
        return found

    def tag_end(self, at: int) -> int:
        """Place of the ``>`` that ends the tag at ``at``; with an open quote the first one; -1 without any."""
        place = at
        while True:
            found = _NEXT.search(self.page, place)
            if not found:
                return self.find(">", at)
            if not found[1]:
                return found.start()
            closed = self.find(found[1], found.end())
            if closed < 0:
                return self.find(">", at)
            place = closed + 1

    def raw_end(self, name: str, at: int) -> int:
        """End of the closing tag of a raw element; -1 without one."""
        while (found := self.close_of(name, at)) >= 0:
            after = found + 2 + len(name)
            if after >= len(self.page) or self.page[after] in " \t\n\f\r/>":
                end = self.find(">", after)
                return end + 1 if end >= 0 else len(self.page)
            at = after
        return -1

    def close_of(self, name: str, at: int) -> int:
        key = f"</{name}"
        if key in self.missing:
            return -1
        found = re.compile(re.escape(key), re.I).search(self.page, at)
        if not found:
            self.missing.add(key)
            return -1
        return found.start()

    def tags(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """(start, end, name, closing, attributes); comments and declarations have no name, a CDATA section has "[" and its text."""
        page, at, n = self.page, 0, len(self.page)
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                end = self.find("-->", at + 4)
                end = n if end < 0 else end + 3
                yield at, end, "", False, ""
            elif page.startswith("<![CDATA[", at):
                end = self.find("]]>", at + 9)
                yield at, (n if end < 0 else end + 3), "[", False, page[at + 9 : n if end < 0 else end]
                end = n if end < 0 else end + 3
            elif page[at + 1 : at + 2] in ("!", "?"):
                end = self.find(">", at)
                end = n if end < 0 else end + 1
                yield at, end, "", False, ""
            else:
                start = _START.match(page, at + 1)
                if not start:
                    at += 1
                    continue
                end = self.tag_end(start.end())
                if end < 0:
                    yield at, n, "", False, ""
                    return
                end += 1
                name = start[0].lower()
                closing, attributes = name[0] == "/", page[start.end() : end - 1]
                name = name.lstrip("/")
                yield at, end, name, closing, attributes
                if name in RAW and not closing and not attributes.endswith("/"):
                    raw = self.raw_end(name, end)
                    if raw >= 0 or name in TEXT_ONLY:
                        raw = n if raw < 0 else raw
                        yield end, raw, "", False, ""
                        end = raw
            at = end


class Open:
    """The open elements: what a block inherits from all of them, and how many there are of a name."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, int, bool, bool]] = [("", False, 0, False, False)]  # name, boilerplate, hint, article, heading
        self.count: dict[str, int] = {}

    def push(self, name: str, attributes: str) -> None:
        _, element, hint, article, heading = self.stack[-1]
        if name not in ("body", "html", "main", "article"):
            hint = max(hint, _hint(attributes))
        element = element or name in BOILERPLATE or name == "header" and not article
        self.stack.append((name, element, hint, article or name in ("article", "main"), heading or name in HEADINGS))
        self.count[name] = self.count.get(name, 0) + 1

    def pop(self) -> None:
        self.count[self.stack.pop()[0]] -= 1

    def close(self, name: str) -> None:
        if self.count.get(name):
            while self.stack[-1][0] != name:
                self.pop()
            self.pop()

    def make_room(self, name: str) -> None:
        """Close what an opening tag ends: a paragraph or a heading, and the item or cell before it."""
        while self.stack[-1][0] == "p" or self.stack[-1][0] in HEADINGS and name in HEADINGS:
            self.pop()
        if name in _CLOSES:
            own, held = _CLOSES[name]
            if any(self.count.get(k) for k in own):
                for i in range(len(self.stack) - 1, 0, -1):
                    if self.stack[i][0] in held or len(self.stack) - i > 64:
                        return
                    if self.stack[i][0] in own:
                        while len(self.stack) > i:
                            self.pop()
                        return


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order."""
    out: list[Block] = []
    held = Open()
    parts: list[str] = []
    linked: list[str] = []
    anchor, at, end = 0, 0, len(page)  # anchor: how many elements were open when the open link began, and itself

    def close() -> None:
        text = WHITE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            name, element, hint, article, heading = held.stack[-1]
            out.append(Block(text, len(text.split()), len(html.unescape(" ".join(linked)).split()), element, hint, article, heading, name in PROSE))
        parts.clear()
        linked.clear()

    def text(piece: str) -> None:
        parts.append(piece)
        if anchor:
            linked.append(piece)

    for first, last, name, closing, attributes in Page(page).tags():
        if first > at:
            text(page[at:first])
        at = last
        if name == "[":
            text(html.escape(attributes))
        elif name == "a":
            anchor = 0 if closing else len(held.stack)
        elif name in BREAKS or name == "button":
            close()
            if closing:
                held.close(name)
            elif name != "hr":
                held.make_room(name)
                if not attributes.endswith("/"):
                    held.push(name, attributes)
            if len(held.stack) < anchor:  # a link ends with what it stands in
                anchor = 0
        elif name == "br":
            parts.append(" ")
    if at < end:
        text(page[at:])
    close()
    return out


#: Columns of the feature table.
FEATURES = ("words", "link density", "words before", "link density before", "words after", "link density after", "element", "hint", "article", "heading", "page has an article", "element of running text")


def features(blocks: list[Block]) -> np.ndarray:
    """One row per block."""
    n = len(blocks)
    out = np.zeros((n, len(FEATURES)))
    words = np.array([b.words for b in blocks], dtype=float)
    density = np.array([b.links for b in blocks]) / np.maximum(words, 1)
    out[:, 0], out[:, 1] = np.minimum(words, 200), density
    out[1:, 2], out[1:, 3] = out[:-1, 0], density[:-1]
    out[:-1, 4], out[:-1, 5] = out[1:, 0], density[1:]
    out[:, 6] = [b.element for b in blocks]
    out[:, 7] = [b.hint for b in blocks]
    out[:, 8] = [b.article for b in blocks]
    out[:, 9] = [b.heading for b in blocks]
    out[:, 10] = out[:, 8].max(initial=0)
    out[:, 11] = [b.prose for b in blocks]
    return out


#: Small labelled pages: html, and for each block in order 1 if it is article text.
_LONG = "The council met on Tuesday evening to weigh a plan for the river bank, and most of those who spoke asked for more time before any tree is felled."
_MORE = "Engineers said the wall could be raised by half a metre without touching the old mill, though the cost would grow and the work would last until spring."
LABELLED = [
    (f"<nav><ul><li><a>Home</a></li><li><a>World news</a></li><li><a>Sport</a></li></ul></nav><div class='ad'>Buy two and get one free today only.</div><article><h1>River plan delayed.</h1><p>{_LONG}</p><p>Not yet.</p><p>{_MORE}</p></article><footer>&copy; the site. All rights reserved by us.</footer>", "00001111" + "0"),
    (f"<header><a>Daily</a> The paper of the valley</header><main><h1>Mill</h1><p>{_MORE}</p><ul><li>One point is cost.</li><li>Time.</li></ul><p>{_LONG}</p></main><aside><h3>Most read</h3><p><a>Ten walks for the weekend</a></p></aside>", "011111" + "00"),
    (f"<div id='menu'><a>Start</a> <a>Shop</a></div><div><h1>A quiet street</h1><p>{_LONG}</p><p>{_MORE}</p><p>He left.</p></div><div class='comments'><p>{_MORE}</p><p>I agree with all of it.</p></div><div id='footer'>Terms and privacy</div>", "01111" + "000"),
    (f"<div><a>Home</a> <a>About us</a> <a>Contact</a></div><div><h2>Notes</h2><p>{_LONG}</p><p>{_MORE}</p></div><div><a>Next page</a> <a>Older posts</a></div>", "01110"),
    (f"<div class='cookie-notice'>We use cookies to make this site work and to count visits, see our policy for what they hold.</div><article><header><h1>Spring</h1></header><p>{_MORE}</p><h2>What next</h2><p>Wait.</p><p>See <a>the full report</a> for the figures that the council used when it chose the wall.</p></article>", "011111"),
    (f"<form><p>Your name and your mail</p><button>Send it</button></form><article><p>{_LONG}</p><blockquote>{_MORE}</blockquote><div class='share'>Share this on your page</div><p>Ends.</p></article><footer><p>{_LONG}</p></footer>", "0011010"),
    (f"<table><tr><td><a>Index</a></td><td><a>Archive of all years</a></td></tr></table><p>{_LONG}</p><p>{_MORE}</p><p>{_LONG}</p><p><a>Back to the top of this page</a></p>", "001110"),
    (f"<article><p>{_LONG}</p><p>Yes.</p><aside>Read also: ten walks in the hills near the town</aside><p>{_MORE}</p></article><section class='related'><h2>More stories</h2><p><a>The bridge</a></p><p>{_LONG}</p></section>", "1101000"),
    (f"<div class='sidebar'><h3>Tags</h3><p><a>river</a></p><p>{_MORE}</p></div><div class='post'><h1>Late</h1><p>{_LONG}</p><p>{_MORE}</p></div><div class='newsletter'>Sign up and get our letter each week in your mail box for free.</div>", "000111" + "0"),
    ("<nav><a>Home</a></nav><article><h1>Short news.</h1><p>It rained.</p></article><footer>Contact us by mail</footer>", "0110"),
    ("<nav><ul><li><a>One</a></li></ul></nav><div class='ad'>Sale now.</div><article><h1>The end.</h1><p><b>The end.<br></article><footer>&copy; site &middot; Some words in a row.</footer>", "00110"),
    ("<article><h1>Storm.</h1><p>It blew.</p></article>", "11"),
    (f"<main><h1>A day</h1><p>{_LONG}</p><p>The end.</p></main>", "111"),
    ("<article><p>Fine.</p></article><footer>Mail us</footer>", "10"),
    (f"<div>Skip to content</div><div><p>{_LONG}</p><p>{_MORE}</p></div><div>All rights reserved</div>", "0110"),
]
#: Fragments of pages with the labels of their blocks, most without telling elements or names; pages are strings of fragments.
FRAGMENTS = {
    "brand": ("<div>The Daily Valley</div>", "0"),
    "menu": ("<div><a>Home</a> <a>About us</a> <a>Contact</a></div>", "0"),
    "items": ("<ul><li><a>News</a></li><li><a>Sport</a></li><li><a>Letters to the paper</a></li></ul>", "000"),
    "path": ("<div><a>Home</a> <a>Region</a> <a>River valley</a></div>", "0"),
    "long": (f"<p>{_LONG}</p>", "1"),
    "more": (f"<div><p>{_MORE}</p></div>", "1"),
    "both": (f"<p>{_LONG} {_MORE}</p>", "1"),
    "part": ("<p>He said that he had seen the plan and that it would not last through one winter.</p>", "1"),
    "short": ("<p>Not yet.</p>", "1"),
    "title": ("<h1>River plan delayed</h1>", "1"),
    "sub": ("<h2>What comes next</h2>", "1"),
    "cited": ("<p>Both are set out in <a>the full report of the council on the wall</a> and in the letters that it drew from the town.</p>", "1"),
    "points": ("<ul><li>The wall would cost more than the bridge did.</li><li>Work would last until the spring of next year.</li></ul>", "11"),
    "tags": ("<p><a>river</a> <a>mill</a> <a>council</a></p>", "0"),
    "next": ("<div><a>Next page</a> <a>Older posts</a></div>", "0"),
    "teasers": ("<div><h3><a>More stories</a></h3><p><a>Ten walks for the weekend in the hills</a></p><p><a>The bridge is closed again</a></p></div>", "000"),
    "legal": ("<div>All rights reserved by the owners</div>", "0"),
    "terms": ("<div><a>Terms</a> <a>Privacy</a></div>", "0"),
    "index": ("<div><a>Town and county</a> <a>Business and markets</a> <a>Weather for the week</a> <a>Sport and results</a> <a>Letters to the editor</a> <a>Births and deaths</a> <a>Jobs near you</a> <a>Houses to let</a></div>", "0"),
    "home": ("<div><a>Home</a></div>", "0"),
    "[": ("<article>", ""),
    "]": ("</article>", ""),
    "word": ("<p>Ends.</p>", "1"),
    "see": ("<p><a>Map</a></p>", "1"),
    "nav": ("<nav><ul><li><a>Home</a></li><li><a>To the news</a></li></ul></nav>", "00"),
    "ad": ("<div class='ad'>Buy two and get one free until the end of May.</div>", "0"),
    "call": ("<div class='ad'>Buy.</div>", "0"),
    "foot": ("<footer><a>Home</a></footer>", "0"),
    "copy": ("<footer>&copy; the paper. All rights reserved by its owners and by those who write for it.</footer>", "0"),
    "aside": ("<aside><p>Read also what the mill was built for and by whom it was sold.</p><p>Ads.</p></aside>", "00"),
    "sharing": ("<div class='article-share'><a>Share</a></div>", "0"),
    "shares": ("<ul class='social'><li><a>Mail</a></li><li><a>Print this page</a></li></ul>", "00"),
    "notice": ("<div class='cookie-notice'><p>We use cookies to count visits.</p></div>", "0"),
    "flow": (f"<div>{_LONG}</div>", "1"),
    "flows": (f"<div>{_MORE} {_LONG}</div>", "1"),
    "said": ("<div>He said that he had seen the plan and that it would not last through one winter.</div>", "1"),
    "bit": ("<div>Not yet, he said.</div>", "1"),
    "one": ("<div>Ends.</div>", "1"),
    "few": ("<p>Only three words</p>", "1"),
    "tiny": ("<p>a b c.</p>", "1"),
    "done": ("<p>It is done now and all is well with it.</p>", "1"),
    "code": ("<pre>total = price + cost\nprint total</pre>", "1"),
    "listing": ("<pre>" + "read line, add one to the count, go on to the next line until the end of the file; " * 4 + "</pre>", "1"),
    "item": ("<ul><li><p>First point is cost.</p></li></ul>", "1"),
    "items in text": ("<ol><li><p>The wall would cost more than the bridge did.</p></li><li>Time.</li></ol>", "11"),
    "table": ("<table><tr><th>Year<th>Cost<tr><td>1999<td>12 pounds<tr><td>2000<td>15 pounds</table>", "111111"),
    "quote": (f"<blockquote><p>{_MORE}</p></blockquote>", "1"),
    "caption": ("<figure><img src='a'><figcaption>The mill in May.</figcaption></figure>", "1"),
    "card": ("<a href='/b'><h3>The bridge is closed again</h3><p>Nobody knows for how long, and the town has asked for a ferry in its place.</p></a>", "00"),
    "cards": ("<div><a href='/c'><div><h3>Ten walks</h3><p>For the weekend in the hills near the town, with maps and what to eat on the way.</p></div></a><a href='/d'><div><h3>Late train</h3><p>It has not been on time since the new year began.</p></div></a></div>", "0000"),
    "thread": (f"<ol class='commentlist'><li class='comment'><p>{_LONG}</p></li><li class='comment'><p>Yes.</p></li></ol>", "00"),
    "voices": (f"<ul><li class='comment'>{_MORE}</li><li class='comment'><div><p>I agree with all of it and so does the whole street.</p><a>Reply</a></div></li></ul>", "000"),
    "side": (f"<div class='sidebar'><ul><li><a>Map</a></li><li>Open until five each day of the week.</li></ul><p>{_LONG}</p></div>", "000"),
    "talk": (f"<section class='comments'><p>{_LONG}</p><p>Yes.</p><p><a>Reply</a></p></section>", "000"),
}
PAGES = [
    "brand menu title long both short more next legal",
    "menu items title both sub long more terms",
    "items path title part long points both teasers terms",
    "brand items title long cited more tags teasers legal terms",
    "menu path long short both more next",
    "items title both both terms",
    "menu long more tags",
    "path title long sub points part both tags next legal",
    "brand menu both cited long next teasers",
    "menu title part part long part both terms legal",
    "nav ad [ title long word ] copy",
    "nav call [ title word ] foot",
    "nav [ title both long see ] foot",
    "home [ word ] copy",
    "home [ sub see long ] home",
    "nav ad [ title short call long word more ad part ] talk foot",
    "[ title cited aside see long talk ] copy",
    "nav [ long aside word aside points see ad part ] aside foot",
    "brand nav [ both ] legal terms",
    "call [ long see see word word part ] next foot",
    "menu home title both word part long more home",
    "home long more both home legal",
    "brand index title long both index terms",
    "index [ title both see ] index foot",
    "brand menu title long short word short more next",
    "items title both short short part more home legal",
    "long",
    "title both",
    "menu title long more",
    "home title both part short",
    "title long more legal",
    "[ title see long ] foot",
    "[ word see part ]",
    "[ sub cited see ] home",
    "[ few ]", "[ tiny ]", "[ done ]", "[ both ]", "[ code ]", "[ title tiny ]", "[ title few ] copy", "nav [ few ] foot", "nav ad [ tiny done ] copy", "menu title long done more legal", "[ word few tiny done ]",
    "[ title code done ]", "[ title long code tiny listing done ] copy", "nav [ title listing ] foot", "[ long item ]", "[ title long items in text done ] copy", "nav [ long item few ] thread foot", "[ quote few caption long ]", "[ caption long ] cards",
    "[ title table long ]", "nav [ title long table done ] copy", "menu title long table more legal", "title both table long", "menu title long listing more next legal", "brand title long items in text more legal", "menu title long quote caption more next",
    "[ title long ] thread", "[ both ] voices copy", "thread", "voices", "[ few ] thread", "menu title long more thread legal", "nav [ title both done ] voices foot", "menu title both voices", "side [ title long ] foot", "menu title both side legal", "side title long more",
    "[ title long ] cards", "[ title long ] card copy", "menu title long more cards legal", "cards [ both done ]", "card title both long", "menu title both card card next", "nav cards [ title few long ] cards foot",
    "[ long sharing talk ]", "[ title long shares more ]", "[ both sharing ]", "[ few sharing ] copy", "nav [ title sharing both see shares ] foot", "[ long notice done sharing ]", "notice [ tiny ] legal", "[ title see long see sharing ]",
    "flow flows", "title flow long flows legal", "brand menu title flow both flows next legal", "menu title flows long flow terms", "items path title flow flows said both legal", "brand title flows flow more", "menu flow long legal", "home title long flows part flow terms",
    "[ flow ]", "[ bit ]", "[ one ]", "[ title bit flow one ] copy", "nav [ title flows bit ] foot", "nav ad [ said flow word bit ] side copy", "[ title said one few ] foot", "nav [ flow bit tiny one flows ] thread foot", "[ said ]", "menu [ title bit one ] legal", "nav [ long bit part one ] cards copy",
    "long more", "both long", "part both", "long both long", "title long more both", "brand long more",
    "[ table ]", "[ item ]", "[ title items in text ]", "[ quote ]", "nav [ title word few tiny code item done table ] side copy",
]
#: Names of fragments in a page, the longest first.
_NAMED = re.compile("|".join(re.escape(k) for k in sorted(FRAGMENTS, key=len, reverse=True)))
#: The same within an article, where links and short blocks are text; names that only sound like boilerplate, and names and elements that are.
LABELLED += [
    (f"<div class='menu'><a>Home</a></div><article><h1>Links</h1><p>Plain <a>{_LONG}</a></p><ul><li><a>The first report of the year</a></li><li><a>The second</a></li></ul><p><a>All of them</a></p><p>{_MORE}</p></article>", "0111111"),
    (f"<article><h1>Survey</h1><p>{_LONG}</p><div id='related-work'><h2>Related work</h2><p>{_MORE}</p><p>Short.</p></div><section class='social-history'><h2>Social history</h2><p>{_LONG}</p></section></article>", "1111111"),
    (f"<main><h1>Signs</h1><p>{_MORE}</p><div class='article-share'><a>Share</a> <a>Save</a></div><div class='comment-list'><p>{_LONG}</p><p>Well said.</p></div></main>", "110" + "00"),
    (f"<div class='site-header'><a>Daily</a></div><div class='story'><h1>Ice</h1><p>{_LONG}</p><p>{_MORE}</p></div><div class='cookie-notice'>{_MORE}</div>", "01110"),
    (f"<article><div class='ad-box'>Sale ends on Sunday.</div><p>{_MORE}</p><div class='newsletter-block'><p>{_LONG}</p></div><p>Ends.</p></article>", "0101"),
    (f"<article><p>{_MORE}</p><nav><a>One</a> <a>Two</a></nav><form><p>{_LONG}</p></form><p><a>Notes</a></p></article><aside><p>{_LONG}</p></aside>", "10010"),
    (f"<main><p><a>{_MORE}</a></p><p>{_LONG}</p><section class='search-theory'><p><a>On search</a> and why it is hard to say what was meant by it.</p></section></main>", "111"),
]


class Tree:
    """Binary classification tree grown by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 7, least: int = 3):
        self.nodes: list[tuple[int, float, int, int, float]] = []
        self._grow(x, y, depth, least)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int) -> int:
        me, share = len(self.nodes), float(y.mean())
        self.nodes.append((-1, 0.0, 0, 0, share))
        best = (share * (1 - share) * len(y) - 1e-9, -1, 0.0)
        if depth and 0 < share < 1:
            for f in range(x.shape[1]):
                order = np.argsort(x[:, f], kind="stable")
                v, c = x[order, f], np.cumsum(y[order])
                cut = np.flatnonzero(v[1:] > v[:-1]) + 1
                cut = cut[(cut >= least) & (cut <= len(y) - least)]
                if not len(cut):
                    continue
                left, right = c[cut - 1], c[-1] - c[cut - 1]
                cost = left * (1 - left / cut) + right * (1 - right / (len(y) - cut))
                i = int(cost.argmin())
                if cost[i] < best[0]:
                    best = (float(cost[i]), f, float((v[cut[i] - 1] + v[cut[i]]) / 2))
        if best[1] >= 0:
            low = x[:, best[1]] <= best[2]
            a = self._grow(x[low], y[low], depth - 1, least)
            b = self._grow(x[~low], y[~low], depth - 1, least)
            self.nodes[me] = (best[1], best[2], a, b, share)
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x)), [(0, np.arange(len(x)))]
        while todo:
            i, rows = todo.pop()
            f, cut, a, b, share = self.nodes[i]
            if f < 0 or not len(rows):
                out[rows] = share
                continue
            low = x[rows, f] <= cut
            todo += [(a, rows[low]), (b, rows[~low])]
        return out


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the labelled pages."""
    x, y = [], []
    pages = [tuple("".join(FRAGMENTS[k][i] for k in _NAMED.findall(names)) for i in (0, 1)) for names in PAGES]
    for page, labels in [*LABELLED, *pages]:
        found = blocks_of(page)
        if len(found) != len(labels):
            raise ValueError(f"{len(labels)} labels for {len(found)} blocks: {[b.text for b in found]}")
        x.append(features(found))
        y += [int(c) for c in labels]
    return np.concatenate(x), np.array(y, dtype=float)


@lru_cache(1)
def tree() -> Tree:
    return Tree(*labelled_table())


def main_text(page: str | None) -> str:
    """The article text of a page, its blocks joined by a line break."""
    found = blocks_of(page or "")
    if not found:
        return ""
    keep = tree().predict(features(found)) >= 0.5
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Columns: id, url, text, n_chars."""
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"{id_col} {kinds[id_col]}, {url_col} {kinds[url_col]}, text string, n_chars bigint")
