"""Main text of web pages by two passes of block rules.

The markup is read once, forgiving what browsers forgive: unclosed and crossed tags, a tag cut off at the end,
raw text in scripts. Text between block-level tags is a block. The first pass classifies each
block by the container it stands in, by its length, its link density and its density of stop words: good,
bad, or undecided where it is too short or falls between the limits. In the second pass undecided blocks
inherit the label of their nearest decided neighbours in the same container: good if either of the two
is equally near, good also inside an article without any decided block.

Blocks in menus, page headers, footers, sidebars, notices, adverts, forms and reader comments are bad
whatever they say: their elements, or the words of their class, id or role, tell. Names don't count for a
container that holds most of the page's good text while no marked article stands outside of such containers, unless
they name reader comments around it. A marked article (or main part) is a prior: its blocks need fewer stop words, and
blocks elsewhere are bad, unless a multiple of its text stands there in good blocks.

Defined cases: null html is empty and gives an empty text; pages are read whole, whatever their length;
repeated rows are treated alike; an empty table gives an empty result. Any white space is one space.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from driftline.llm.common import batch_of, map_rows, table

#: Characters of a block: under SHORT it is undecided, from LONG on it can be good by its stop words alone.
SHORT, LONG = 70, 200
#: Share of words that are stop words; inside of an article less is enough.
STOP_LOW, STOP_HIGH, STOP_ARTICLE = 0.2, 0.3, 0.1
#: How many times the good text of its articles a page must have outside of them for articles not to count.
OUTSIDE = 2
#: Share of characters in links above which a block is bad, outside and inside of an article.
LINKS, ARTICLE_LINKS = 0.2, 0.6

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset("""
a about after all also an and any are as at be been but by can could did do for from had has have he her his how
i if in into is it its more no not of on one or our out she so some than that the their them then there these
they this to up was we were what when which who will with would you your
au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou où par pas plus
pour que qui sa se ses son sont sur un une vous à été être
aber als auch auf aus bei bis das dass dem den der die durch ein eine einem einen einer er es für hat ich im ist
kann man mit nach nicht noch nur oder sich sie sind so über um und von war wenn werden wie wird zu zum zur
al como con cuando del donde el ella ellos entre era es esta este fue ha hay la las lo los me muy más ni no nos o
para pero por porque que se ser si sin sobre su sus también tiene un una y ya
""".split())

# Kinds of elements.
BLOCK_TAGS = frozenset("""
address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul
""".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BAD_TAGS = frozenset("nav footer aside form menu dialog button select template svg canvas object audio video head option label".split())
#: What may stand in the head of a page; anything else ends it.
HEAD_TAGS = frozenset("head base basefont bgsound link meta title style script noscript noframes template".split())

# Words that name a container in class, id or role; COMMENT_WORDS those of reader comments.
COMMENT_WORDS = frozenset("comment comments disqus replies respond reaction reactions".split())
BAD_WORDS = COMMENT_WORDS | frozenset("""
ad ads adv advert advertisement advertising sponsor sponsored sponsors banner promo promos promotion cookie cookies consent gdpr notice
notices notification alert popup modal overlay nav navbar navigation menu menus menubar breadcrumb breadcrumbs sidebar side aside widget foot
footer footers masthead topbar toolbar share sharing social related recommend recommended recommendation recommendations newsletter
subscribe subscription subscriber signup login search tags pagination pager complementary contentinfo dialog
""".split())
#: Words beside which a bad one tells of something else: a layout, a state, a part of the article.
NEUTRAL_WORDS = frozenset("no not has have with without open closed layout image images single hentry category tag tagged type format status left right enabled disabled".split())
GOOD_WORDS = frozenset("content article post entry main story body text page hentry".split())
_HEADER_NAMES = frozenset("header site-header page-header".split())
_CAMEL = re.compile(r"([a-z])([A-Z])")
_PARTS = re.compile(r"[-_]+")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)
_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*(?:>|$)|<[a-zA-Z][^>]*(?:>|$)""", re.DOTALL)
_RAW_END = {t: re.compile(f"</{t}(?=[\\s/>]|$)[^>]*>?", re.IGNORECASE) for t in RAW_TAGS}

GOOD, BAD, OPEN = 1, 0, None


class Named:
    """A container with a bad name: the one around it, its good characters, and whether it is for comments."""

    __slots__ = ("outer", "good", "comments", "bad")

    def __init__(self, outer: "Named | None", comments: bool):
        self.outer, self.good, self.comments, self.bad = outer, 0, comments, True


class Block:
    __slots__ = ("parts", "linked", "bad", "article", "named", "label", "text")

    def __init__(self, bad: bool, article: int, named: Named | None = None):
        self.parts: list[str] = []
        self.linked = 0
        self.bad, self.article, self.named, self.label, self.text = bad, article, named, OPEN, ""


def _is_bad(tag: str, attributes: str, article: int) -> bool:
    """Whether the element itself is bad or hidden."""
    if tag in BAD_TAGS or tag == "header" and not article:
        return True
    return bool(attributes) and tag not in ("html", "body") and _HIDDEN.search(attributes) is not None


def bad_name(value: str, article: int) -> tuple[bool, bool]:
    """Whether a value of class, id or role names a bad container, and whether one of reader comments.

    Only whole tokens count: a bad word alone, or a compound that ends or begins with one and has no neutral word.
    Compounds are set aside where another token names the content itself.
    """
    tokens = [_PARTS.split(_CAMEL.sub(r"\1-\2", t).lower().strip("-_")) for t in value.split()]
    content = any(len(t) == 1 and t[0] in GOOD_WORDS for t in tokens)
    for parts in tokens:
        hit = next((w for w in (parts[-1], parts[0]) if w in BAD_WORDS), None)
        if hit and not any(w in NEUTRAL_WORDS for w in parts) and (len(parts) == 1 or not content):
            return True, hit in COMMENT_WORDS
        if not article and "-".join(parts) in _HEADER_NAMES:
            return True, False
    return False, False


def _bad_names(tag: str, attributes: str, article: int) -> tuple[bool, bool]:
    """The same of an element's attributes."""
    if not attributes or tag in ("html", "body"):
        return False, False
    found = [bad_name(m[1] or m[2] or m[3] or "", article) for m in _NAMES.finditer(attributes)]
    return any(b for b, _ in found), any(c for _, c in found)


def judge_names(blocks: list[Block], containers: list[Named]) -> None:
    """Make the blocks bad whose container's name is bad, less those containers that hold most of the good text."""
    if not any(b.article and not b.bad and b.named is None for b in blocks):
        total = 0
        for b in blocks:
            if not b.bad and classify(b, False) == GOOD:
                total += len(b.text)
                if b.named is not None:
                    b.named.good += len(b.text)
        for c in reversed(containers):  # inner ones first
            if c.outer is not None:
                c.outer.good += c.good
        for c in containers:
            c.bad = c.comments or 2 * c.good <= total
    for c in containers:
        c.bad = c.bad or c.outer is not None and c.outer.bad
    for b in blocks:
        b.bad = b.bad or b.named is not None and b.named.bad


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order, with their texts, containers and linked characters."""
    out: list[Block] = []
    open_: dict[str, int] = {}  # how often each element is on the stack
    stack: list[tuple[str, bool, int, Named | None]] = []  # element, whether bad, number of the article around (0: none), bad name around
    containers: list[Named] = []
    articles = 0
    linked = False
    now = Block(False, 0)

    def around() -> tuple[bool, int, Named | None]:
        return stack[-1][1:] if stack else (False, 0, None)

    def close() -> None:
        nonlocal now
        if now.parts:
            now.text = " ".join(entities.unescape("".join(now.parts)).split())
            if now.text:
                out.append(now)
        now = Block(*around())

    def put(text: str) -> None:
        if text:
            if stack and stack[-1][0] == "head" and not text.isspace():
                drop()
                close()
            now.parts.append(text)
            if linked:
                now.linked += len(text)

    def push(tag: str, *rest) -> None:
        stack.append((tag, *rest))
        open_[tag] = open_.get(tag, 0) + 1

    def drop() -> str:
        tag = stack.pop()[0]
        open_[tag] -= 1
        return tag

    def pop(tag: str) -> None:
        if open_.get(tag):
            while drop() != tag:
                pass

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        tag = m[2].lower() if m[2] else ""
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                linked = False
            elif tag in BLOCK_TAGS or open_.get(tag):
                pop(tag)
                close()
            continue
        if stack and stack[-1][0] == "head" and tag not in HEAD_TAGS:
            drop()
            close()
        if tag in RAW_TAGS:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            if end is None:
                break
            continue
        if tag == "br":
            put(" ")
            continue
        if tag == "a":
            linked = True
        bad, article, named = around()
        own, (name, comments) = _is_bad(tag, m[3], article), _bad_names(tag, m[3], article)
        if tag in BLOCK_TAGS:
            if stack and stack[-1][0] == "p":
                drop()
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
                drop()
            bad, article, named = around()
            own = own or bad
        marks = tag in BLOCK_TAGS and (tag in ("article", "main") or "articlebody" in m[3].lower())
        if name and tag not in VOID_TAGS and (tag in BLOCK_TAGS or not m[3].endswith("/")):
            named = Named(named, comments and not marks)
            containers.append(named)
        if tag in BLOCK_TAGS:
            if marks:
                articles += not own
                article = 0 if own else article or articles
            if tag not in VOID_TAGS:
                push(tag, own, article, named)
            close()
        elif (own or name) and tag not in VOID_TAGS and not m[3].endswith("/"):
            push(tag, own or bad, article, named)
            close()
    close()
    judge_names(out, containers)
    return out


def stop_share(text: str) -> float:
    """Share of a text's words that are stop words."""
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / max(len(words), 1)


def classify(block: Block, in_article: bool) -> int | None:
    """First pass: by links, length and stop words; what stands in an article needs less of the last."""
    if block.bad or in_article and not block.article:
        return BAD
    n, share = len(block.text), block.linked / max(len(block.text), 1)
    if share > (ARTICLE_LINKS if block.article else LINKS):
        return BAD
    if n < SHORT:
        return OPEN
    stops = stop_share(block.text)
    if block.article:
        return GOOD if stops >= STOP_ARTICLE else OPEN
    if "©" in block.text or "all rights reserved" in block.text.lower():
        return BAD
    if stops >= STOP_HIGH and n >= LONG:
        return GOOD
    if stops >= STOP_LOW:
        return OPEN if n < LONG else GOOD
    return BAD if n >= LONG else OPEN


def articles_count(blocks: list[Block]) -> bool:
    """Whether the page's marked articles are where its text stands: they have text, and no multiple of it stands elsewhere."""
    if not any(b.article and not b.bad for b in blocks):
        return False
    good = [b for b in blocks if classify(b, False) == GOOD]
    inside = sum(len(b.text) for b in blocks if b.article and not b.bad)
    return sum(len(b.text) for b in good if not b.article) <= OUTSIDE * inside


def inherit(blocks: list[Block]) -> None:
    """Second pass: undecided blocks get the label of the nearest decided ones of their container."""
    groups: dict[int, list[Block]] = {}
    for b in blocks:
        if not b.bad:
            groups.setdefault(b.article, []).append(b)
    for article, group in groups.items():
        n, far = len(group), len(group) + 1
        before, after = [(far, OPEN)] * n, [(far, OPEN)] * n
        seen = (far, OPEN)
        for i, b in enumerate(group):
            before[i] = seen = (0, b.label) if b.label is not OPEN else (seen[0] + 1, seen[1])
        seen = (far, OPEN)
        for i in range(n - 1, -1, -1):
            b = group[i]
            after[i] = seen = (0, b.label) if b.label is not OPEN else (seen[0] + 1, seen[1])
        labels = []
        for (d, x), (e, y) in zip(before, after):
            near = x if d < e else y if e < d else GOOD if GOOD in (x, y) else x if x is not OPEN else y
            labels.append(near if near is not OPEN else (GOOD if article else BAD))
        for b, label in zip(group, labels):
            if b.label is OPEN:
                b.label = label


def main_text(page: str | None) -> str:
    if not page:
        return ""
    blocks = blocks_of(page)
    in_article = articles_count(blocks)
    for b in blocks:
        b.label = classify(b, in_article)
    inherit([b for b in blocks if not (in_article and not b.article)])
    return " ".join(b.text for b in blocks if b.label == GOOD)


_OUT = [("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())]


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages(page_id, url, html)``."""

    def make():
        def step(ids, urls, pages_):
            texts = [main_text(p) for p in pages_]
            return batch_of(_OUT, {"page_id": ids, "url": urls, "text": texts, "n_chars": [len(t) for t in texts]})

        return step

    return map_rows(pages, ["page_id", "url", "html"], make, "page_id long, url string, text string, n_chars long")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages"))
