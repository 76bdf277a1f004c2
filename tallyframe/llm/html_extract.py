"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. Elements that are menu, header, footer, sidebar or the like by their tag
or role are left out. A class, an id or a form only hints at that: such an element stays if it holds an article, or most
of the text of a page that has none. The first pass classifies the other blocks by link density, length and density
of stop words; the second lets undecided ones inherit from the nearest decided neighbours. Blocks of an
``article`` (or else ``main``) element are judged among themselves, and the rest of such a page is left out.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Common words of the languages that are expected.
STOP_WORDS = frozenset(
    """
    a about after all also an and any are as at be been but by can could do for from had has have he her his how i if in
    into is it its like more my no not of on one or other our out said she so some than that the their them then there
    these they this to up was we were what when which who will with would you your
    aber als am an auch auf aus bei bis das dass dem den der des die du durch ein eine einem einen einer er es für hat
    ich ihr im in ist ja kann man mit nach nicht noch nur oder sich sie sind so über um und uns von vor war was wenn
    werden wie wir wird zu zum zur
    au aux avec ce ces cette comme dans de des du elle en est et être eux il ils je la le les leur lui mais me même ne
    nous on ont ou par pas plus pour qu que qui sa sans se ses son sont sur un une vous
    al ante como con cual cuando de del desde donde el ella en entre era es esta este fue ha hay la las le lo los más me
    mi muy no nos o otro para pero por porque que quien se si sin sobre son su sus también un una y ya
    """.split()
)
# Fixed values of the markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section select summary table tbody td tfoot th thead tr ul".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup "
    "time tt u var".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEFT_OUT = frozenset(
    "aside audio button canvas dialog footer head header menu nav noscript object optgroup option search select svg "
    "template video".split()
) | RAW
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
# Words of class and id that mark a block as no part of the article.
MARKS = frozenset(
    "ad ads advert advertisement advertisements advertising adverts aside banner breadcrumb breadcrumbs comment commentlist "
    "comments consent cookie cookies dialog discussion disqus footer gdpr header login masthead menu modal nav navbar "
    "navigation newsletter notice notices notification overlay pager pagination popup promo promotion recommended related "
    "replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription "
    "toolbar widget".split()
)
COMMENT_MARKS = frozenset("comment comments commentlist discussion disqus replies reply respond".split())
# Parts of a class that say something else than what the element is: a state or an option, a topic, a phrase.
STATES = frozenset("allowed closed disabled enabled has hide is no not off on open show with without".split())
TOPICS = frozenset("cat category format status tag term topic type".split())
PHRASES = frozenset("a an and at by for from in of the to".split())
# What a start tag ends before itself: its own kind, unless one of these stands between.
SIBLINGS = {
    "li": frozenset("ul ol menu dir".split()),
    "dt": frozenset(["dl"]),
    "dd": frozenset(["dl"]),
    "tr": frozenset(["table"]),
    "td": frozenset(["table", "tr"]),
    "th": frozenset(["table", "tr"]),
}
TAG = re.compile(r"""<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>""")
LOOSE_TAG = re.compile(r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>[^>]*+)>")
NOT_P = BLOCKS - {"p"}
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Rules:
    """Thresholds of the first pass; lengths in characters, densities as shares."""

    short: int = 70
    long: int = 200
    few_stop_words: float = 0.15
    many_stop_words: float = 0.25
    links: float = 0.33


@dataclass
class Block:
    """Text between two block boundaries, and the article it stands in (0: none)."""

    article: int
    heading: bool = False
    hints: tuple[int, ...] = ()
    paragraph: bool = False
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    text: str = ""
    verdict: str = ""


def names_part(names: str, marks: frozenset[str]) -> bool:
    """Whether classes and ids name a part of a page that is in ``marks``.

    A class of several words does so if one of few words is a mark and none says that the class is about something
    else, as in ``no-sidebar``, ``category-social-science`` or ``notice-of-award``.
    """
    for name in re.sub(r"([a-z])([A-Z])", r"\1-\2", names).lower().split():
        parts = [p for p in re.split(r"[^a-z]+", name) if p]
        if len(parts) <= 3 and not marks.isdisjoint(parts):
            if parts[0] not in TOPICS and STATES.isdisjoint(parts) and PHRASES.isdisjoint(parts):
                return True
    return False


STAYS, HINTED, OUT = 0, 1, 2


def _place(name: str, attrs: str) -> int:
    """Whether an element stays, is out, or bears a hint that it is no part of the article."""
    if name in LEFT_OUT:
        return OUT
    hinted = HINTED if name == "form" else STAYS
    if not attrs.strip() or name in ("html", "body"):
        return hinted
    found = {k.lower(): html.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(attrs)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return OUT
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.IGNORECASE):
        return OUT
    if found.get("role", "").lower() in ROLES:
        return OUT
    names = f"{found.get('class', '')} {found.get('id', '')}"
    if names_part(names, COMMENT_MARKS):
        return OUT
    return HINTED if name not in ("article", "main") and names_part(names, MARKS) else hinted


def _tags(page: str) -> Iterator[tuple[str, re.Match | None]]:
    """The text before each tag, and the tag; at last the text after all tags with None.

    Comments and declarations end a text but are no tags. A quote that is never closed ends with its tag. What
    begins like a tag and has no end is dropped with all that follows.
    """
    start = at = 0
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            yield page[start:at], None
            start = at = end + 3 if end >= 0 else len(page)
        elif page[at + 1 : at + 2] in ("!", "?") or page.startswith("</", at) and not page[at + 2 : at + 3].isalpha():
            end = page.find(">", at)
            yield page[start:at], None
            start = at = end + 1 if end >= 0 else len(page)
        elif not re.match(r"</?[a-zA-Z]", page[at : at + 3]):
            at += 1
        else:
            tag = TAG.match(page, at) or LOOSE_TAG.match(page, at)
            yield page[start:at], tag
            if not tag:
                return
            start = at = tag.end()
            if tag["name"].lower() in RAW and not tag["end"] and not tag["attrs"].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag['name'])}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
                start = at = end.end() if end else len(page)
    yield page[start:], None


def blocks(page: str) -> list[Block]:
    """The blocks of a page outside of what its markup leaves out, in order."""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = []  # name, place, article
    is_open: Counter[str] = Counter()
    dropped = articles = links = elements = 0
    hints: tuple[int, ...] = ()  # the elements with a hint that are open
    holds_article: set[int] = set()
    now = Block(0)

    def flush(article: int, heading: bool = False, tag: str = "") -> None:
        nonlocal now
        if now.parts:
            out.append(now)
        now = Block(article, heading, hints, heading or tag == "p")

    def pop_to(i: int) -> None:
        nonlocal dropped, hints
        while len(stack) > i:
            name, place, _ = stack.pop()
            is_open[name] -= 1
            dropped -= place == OUT
            if place == HINTED:
                hints = hints[:-1]

    def open_above(name: str, limit: frozenset[str]) -> int:
        """Where ``name`` is open, looking down to the first of ``limit``; -1 if it isn't."""
        for i in range(len(stack) - 1, -1, -1) if is_open[name] else ():
            if stack[i][0] == name:
                return i
            if stack[i][0] in limit:
                break
        return -1

    def add(text: str) -> None:
        if text and not dropped:
            text = html.unescape(text)
            now.parts.append(text)
            if links > 0:
                now.link_chars += len("".join(text.split()))

    for text, tag in _tags(page):
        add(text)
        if not tag:
            continue
        name = tag["name"].lower()
        is_block = name in BLOCKS
        if tag["end"]:
            i = open_above(name, frozenset() if is_block else BLOCKS)
            before = hints
            if i >= 0:
                pop_to(i)
            if name == "a":
                links = max(0, links - 1)
            if is_block or hints != before:
                links = 0
                flush(stack[-1][2] if stack else 0)
            continue
        if name == "br":
            add("\n")
            continue
        article = stack[-1][2] if stack else 0
        if is_block:
            if name == "body":
                pop_to(0)
            i = open_above("p", NOT_P)
            if i >= 0:
                pop_to(i)
            if name in SIBLINGS and (i := open_above(name, SIBLINGS[name])) >= 0:
                pop_to(i)
            links = 0
            article = stack[-1][2] if stack else 0
            if name in ("article", "main"):
                articles += 1
                # An article inside ``main`` counts, not what stands around it there.
                article = articles if name == "article" else -articles
        place = STAYS if name in VOID or name in RAW else _place(name, tag["attrs"])
        if place == HINTED and name in INLINE:
            place = OUT
        if place == HINTED:
            elements += 1
            hints = (*hints, elements)
        if name in ("article", "main") and place == STAYS and not dropped:
            holds_article.update(hints)
        if is_block or place == HINTED:
            flush(article, name in HEADINGS, name)
        if name in VOID or name in RAW:
            continue
        if name == "a":
            links = 1
        dropped += place == OUT
        stack.append((name, place, article))
        is_open[name] += 1
    flush(0)
    for block in out:
        block.text = " ".join("".join(block.parts).split())
    return _without_hinted([b for b in out if b.text], holds_article)


def _without_hinted(found: list[Block], holds_article: set[int]) -> list[Block]:
    """The blocks less those in an element with a hint that holds neither an article nor most of the text."""
    inside: Counter[int] = Counter()
    several: Counter[int] = Counter()
    for block in found:
        for hint in block.hints:
            inside[hint] += len(block.text)
            several[hint] += 1
    whole = sum(len(b.text) for b in found)
    # One block alone is an advert on a short page rather than the article, unless there is nothing else.
    most = {h for h, n in inside.items() if 2 * n > whole and (several[h] > 1 or n == whole)}
    stays = holds_article if any(b.article for b in found) else holds_article | most
    return [b for b in found if stays.issuperset(b.hints)]


def classify(block: Block, rules: Rules) -> str:
    """First pass: good, near (good unless its neighbours say no), bad, or open."""
    text = block.text
    linked = block.link_chars / max(1, len(text) - text.count(" "))
    if linked > rules.links:
        return "bad"
    if len(text) < rules.short:
        return "bad" if linked and not block.article else "open"
    words = WORD.findall(text.lower())
    stop = sum(map(STOP_WORDS.__contains__, words)) / max(1, len(words))
    if stop >= rules.many_stop_words:
        return "good" if len(text) >= rules.long else "near"
    # What is long and has no stop words may be in another language, a table or a formula: its neighbours decide.
    return "near" if stop >= rules.few_stop_words else "open"


def inherit(section: list[Block]) -> None:
    """Second pass: blocks that are near or open take the side of the nearest decided neighbours.

    A heading belongs to what follows it. A near block is bad only between two bad neighbours, outside of an article
    also beside one. Where no neighbour is decided, or one at the end of an article, an article and a paragraph are
    good, other blocks bad.
    """
    n = len(section)
    decided = [b.verdict if b.verdict in ("good", "bad") else "" for b in section]
    before, after = [-1] * n, [n] * n
    for i in range(1, n):
        before[i] = i - 1 if decided[i - 1] else before[i - 1]
    for i in range(n - 2, -1, -1):
        after[i] = i + 1 if decided[i + 1] else after[i + 1]
    for i, block in enumerate(section):
        if decided[i]:
            continue
        default = "good" if block.article or block.paragraph else "bad"
        left = decided[before[i]] if before[i] >= 0 else ""
        right = decided[after[i]] if after[i] < n else ""
        if block.verdict == "near":
            sides = {left, right} if block.article else {left, right} - {""}
            block.verdict = "bad" if sides == {"bad"} else "good"
        elif not left or not right:
            block.verdict = default if block.article else left or right or default
        elif left == right:
            block.verdict = left
        elif block.heading:
            block.verdict = right
        else:
            nearer = (i - before[i]) - (after[i] - i)
            block.verdict = left if nearer < 0 else right if nearer > 0 else default


def main_text(page: str | None, rules: Rules | None = None) -> str:
    """The blocks of the article, one per line."""
    found = blocks(page) if page else []
    for wanted in (lambda a: a > 0, lambda a: a != 0):
        if any(wanted(b.article) for b in found):
            found = [b for b in found if wanted(b.article)]
            break
    rules = rules or Rules()
    for block in found:
        block.verdict = classify(block, rules)
    if not any(b.article or b.verdict in ("good", "near") for b in found):
        # Another language, tables or code: without stop words on the whole page, length and links have to do.
        for block in found:
            if block.verdict == "open" and len(block.text) >= rules.short:
                block.verdict = "good"
    section: list[Block] = []
    for block in found:
        if section and section[-1].article != block.article:
            inherit(section)
            section = []
        section.append(block)
    inherit(section)
    return "\n".join(b.text for b in found if b.verdict == "good")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``id_col``, ``url_col``, ``text``, ``n_chars``.

    Character references are decoded, white space inside a block (line breaks too) becomes one space, blocks are
    joined in page order by one line feed. Null or empty html gives an empty text. Broken markup is read as a
    browser would: unclosed elements end with what holds them, an unfinished tag at the end is dropped. Pages are
    judged one by one, so repeated rows give repeated results and an empty table an empty one; other columns are
    not read.
    """
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(2)]
            columns = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["id", "url", "text", "n_chars"])

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
