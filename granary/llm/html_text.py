"""Main text of HTML pages by two-pass block rules.

First pass: the page is cut into blocks at block-level tags, and each block is judged by its length, its share of
stop words and its share of linked text: good, bad, or too short or too odd to tell.  Where the long blocks of a page
have next to no stop words of the list (another language), length and links decide alone.  Second pass: an undecided block takes the
label of the nearest decided block.  Menus, headers, footers, sidebars, notices, adverts, forms and reader
comments that the markup names are left out beforehand.

An article or main element is a prior: if it holds a third or more of the page's good text, the rest of the page goes, and
its undecided blocks stay if either neighbour is good; a smaller article beside other text is a teaser and goes.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from granary.llm._common import map_arrow, slices

#: Common words of four languages.
STOP_WORDS = frozenset(
    """
    the of and to a in is it that was for on are with as he be at by this from or an not but have had his they
    le la les de des du un une et est en que qui dans pour pas par sur au aux avec il elle ce se ne plus
    der die das und den dem ein eine in zu von mit ist im für auf nicht als auch es an werden aus er sie nach bei
    el los las del que y una con por para su al lo como más pero sus se no son
    """.split()
)
#: Elements that never hold text of the article.
_SKIPPED = frozenset("script style noscript template svg math textarea select option button iframe object canvas head title audio video map datalist dialog".split())
_BOILER = frozenset("nav footer aside menu".split())
_CONTAINERS = frozenset("div section article main header nav footer aside form menu ul ol dl li table tr td th tbody thead tfoot figure figcaption details body html blockquote fieldset p h1 h2 h3 h4 h5 h6 dd dt pre center address summary hgroup".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role that mark what isn't the article.
_MARKED = frozenset(
    """
    ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar
    navigation breadcrumb breadcrumbs sidebar side rail footer topbar cookie cookies consent gdpr
    notice alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist
    disqus reply replies respond social share sharing related recommended widget pagination pager toolbar search
    copyright legal disclaimer contentinfo complementary
    """.split()
)
#: Words that may stand beside those without changing what they say.
_NEUTRAL = frozenset(
    """
    site page main global top bottom left right upper lower primary secondary box block area section list wrapper wrap
    container bar inner outer content item items link links slot unit form post posts entry article articles news sticky
    fixed floating group panel title heading text body btn button buttons icon icons count meta js ui
    """.split()
)
#: Names of page headers, and words that may stand beside those; only outside of articles.
_HEADER, _OF_SITE = frozenset("header masthead".split()), frozenset("site global top main sticky fixed wrapper wrap container bar inner outer area".split())
_RAW = frozenset("script style textarea".split())
_TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_PART = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_WORDS = re.compile(r"[^\W\d_]+")
#: Blocks of fewer characters are too short to tell.
SHORT = 70
#: Scripts that are written without spaces between words: a character counts as three.
_DENSE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")


@dataclass
class Block:
    text: str
    linked: int
    article: int  # number of the article element around it, 0 if none
    main: bool
    form: bool
    likely: bool  # a paragraph or heading

    def __post_init__(self):
        self.size = len(self.text) + 2 * len(_DENSE.findall(self.text))
        said = _WORDS.findall(self.text.lower()) if self.size >= SHORT else []
        self.words, self.stops = len(said), sum(w in STOP_WORDS for w in said)

    @property
    def region(self) -> bool:
        return self.main or self.article > 0


def attributes(raw: str) -> dict[str, str]:
    """Attributes by lower-case name, the first of each; odd quotes belong to no name."""
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), a or b or c)
    return out


def left_out(raw: str, region: bool) -> bool:
    """Whether attributes mark an element as hidden or as no part of the article.

    A class, id, role or label counts as a whole: all its words are marks or say nothing else ('site-footer', but not
    'side-effects'); that of a page header counts outside of articles only.
    """
    if not raw or raw.isspace():
        return False
    said = attributes(raw)
    if "hidden" in said or _NO_DISPLAY.search(said.get("style", "")):
        return True
    for name in [*said.get("class", "").split(), said.get("id", ""), said.get("role", ""), said.get("aria-label", "")]:
        parts = {x.lower() for x in _PART.findall(_CAMEL.sub(" ", name))}
        if not parts:
            continue
        if not parts.isdisjoint(_MARKED) and parts <= _MARKED | _NEUTRAL | _HEADER:
            return True
        if not region and not parts.isdisjoint(_HEADER) and parts <= _HEADER | _OF_SITE:
            return True
    return False


@dataclass
class _Open:
    tag: str
    out: bool = False
    article: int = 0
    main: bool = False
    form: bool = False


def blocks(page: str) -> list[Block]:
    """Text blocks in page order, without what the markup names as not the article."""
    found: list[Block] = []
    parts: list[str] = []
    links = linked = articles = at = 0
    stack: list[_Open] = [_Open("")]
    held: Counter = Counter()  # tags on the stack
    unclosed: set[str] = set()  # tags without an end tag from here on
    likely = False
    n = len(page)

    def flush() -> None:
        nonlocal parts, linked
        if parts and (text := " ".join("".join(parts).split())):
            now = stack[-1]
            found.append(Block(text, linked, now.article, now.main, now.form, likely))
        parts, linked = [], 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not stack[-1].out:
            text = _html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len("".join(text.split()))

    def push(tag: str, **changes) -> None:
        now = stack[-1]
        stack.append(_Open(tag, **({"out": now.out, "article": now.article, "main": now.main, "form": now.form} | changes)))
        held[tag] += 1

    def pop(tag: str) -> None:
        """Closes the innermost element of this tag with all that is open in it."""
        while held[tag]:
            last = stack.pop()
            held[last.tag] -= 1
            if last.tag == tag:
                break

    def open_paragraph(tag: str) -> bool:
        """Whether only inline elements stand open in the innermost element of this tag."""
        return held[tag] > 0 and next(x.tag for x in reversed(stack) if x.tag == tag or x.tag in _CONTAINERS) == tag

    while at < n:
        tag = _TAG.search(page, at)
        if not tag:
            add(page[at:])
            break
        add(page[at : tag.start()])
        at = tag.end()
        name, raw = (tag[2] or "").lower(), tag[3]
        if not name:
            continue
        if tag[1]:
            if name == "a":
                links = max(0, links - 1)
            elif name in _CONTAINERS:
                flush()
                if name != "p" or open_paragraph("p"):
                    pop(name)
                links, likely = 0, False
            elif held[name]:
                pop(name)
            continue
        alone = raw.rstrip().endswith("/")
        if name in _SKIPPED:
            if alone or name in unclosed:
                continue
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            if end:
                at = end.end()
            elif name in _RAW:
                at = n
            else:
                unclosed.add(name)
            continue
        if name in ("br", "hr"):
            add("\n")
            if name == "hr":
                flush()
            continue
        if name in _VOID:
            continue
        if name == "a":
            links = 1
            continue
        if name not in _CONTAINERS and name != "form":
            # Inline elements matter only if they are left out, with those of the same tag in them.
            if not alone and (out := left_out(raw, True)) | (held[name] > 0):
                push(name, out=stack[-1].out or out)
            continue
        flush()
        links = 0
        if open_paragraph("p"):  # a block-level tag ends an open paragraph
            pop("p")
        if name == "li" and open_paragraph("li"):
            pop("li")
        now = stack[-1]
        inside = now.main or now.article > 0
        out = now.out or name in _BOILER or (name == "header" and not inside) or (name not in ("html", "body", "main") and not (name == "article" and not inside and "hidden" not in raw) and left_out(raw, inside))
        if not alone:
            changes = {"out": out}
            if not out and name == "article" and not now.article:
                articles += 1
                changes["article"] = articles
            elif not out and name == "main":
                changes["main"] = True
            elif name == "form":
                changes["form"] = True
            push(name, **changes)
        likely = name == "p" or len(name) == 2 and name[0] == "h"
    flush()
    return found


def judge(block: Block, covered: bool = True, long: int = 200, high: float = 0.12, low: float = 0.04, link_share: float = 0.34) -> bool | None:
    """First pass: True good, False bad, None too short or too odd to tell.  covered: the stop words tell about this page."""
    if block.linked / max(1, len("".join(block.text.split()))) > link_share:
        return False
    if "©" in block.text and block.size < 300 and not block.region:
        return False
    if block.size < SHORT:
        return None
    if not covered:
        return True
    share = block.stops / max(1, block.words)
    if share >= high:
        return True
    return None if share >= low or block.size < long or block.region else False


def scope_of(found: list[Block], first: list[bool | None]) -> tuple[list[int], bool]:
    """The blocks among which the article lies, and whether they are an article or main element's."""
    inside = [i for i in range(len(found)) if not found[i].form]
    if not any(first[i] for i in inside):  # a page that is one form
        inside = list(range(len(found)))
    mass = lambda at: sum(found[i].size for i in at if first[i])
    scope, region = inside, False
    for part in (lambda b: b.main, lambda b: b.article > 0):
        own = [i for i in scope if part(found[i])]
        if not own or all(first[i] is False for i in own):
            continue
        if 3 * mass(own) >= mass(scope):
            scope, region = own, True
        else:
            scope = [i for i in scope if not part(found[i])]
    return scope, region


def second(first: list[bool | None], scope: list[int], region: bool, likely: list[bool]) -> list[int]:
    """Second pass: the blocks that are good, or next to a good one.  Nearest decides; if two are as near, a good one."""
    before: dict[int, int] = {}
    last = None
    for place, i in enumerate(scope):
        if first[i] is not None:
            last = place
        elif last is not None:
            before[place] = last
    out, after = [], None
    for place in range(len(scope) - 1, -1, -1):
        i = scope[place]
        if first[i] is not None:
            after = place
            keep = first[i]
        else:
            near = sorted((abs(place - x), not first[scope[x]]) for x in (before.get(place), after) if x is not None)
            keep = (region and any(not bad for _, bad in near) or not near[0][1]) if near else region or likely[i]
        if keep:
            out.append(i)
    return out[::-1]


def main_text(page: str | None) -> str:
    """The article's text: blocks joined by one space; empty if there is none."""
    if not page:
        return ""
    found = blocks(page)
    covered = sum(b.stops for b in found) >= 0.05 * max(1, sum(b.words for b in found))
    first = [judge(b, covered) for b in found]
    scope, region = scope_of(found, first)
    return " ".join(found[i].text for i in second(first, scope, region, [b.likely for b in found]))


def extract(pages: DataFrame, html_col: str = "html", *carry: str) -> DataFrame:
    """Returns the carried columns, text and n_chars (code points) of each page's main text.

    Null, empty and text-free pages give an empty text; repeated rows repeat; pages are read whole.  Unclosed,
    crossed and cut-off tags are tolerated: what follows an unclosed script or style is part of it.  Other columns aren't
    read; a carried column may not be named text or n_chars.
    """
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in carry) + ", text string, n_chars long"

    def run(batches):
        for batch in slices(batches, html_col):
            texts = [main_text(h) for h in batch.column(len(carry)).to_pylist()]
            out = [batch.column(i) for i in range(len(carry))]
            yield pa.RecordBatch.from_arrays([*out, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*carry, "text", "n_chars"])

    return map_arrow(pages.select(*carry, html_col), run, schema)
