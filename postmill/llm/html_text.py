"""Main text of HTML pages by two-pass block rules.

Pass 1 judges each block by itself: stop-word density, length and link density; the names of elements and classes around it weigh in, and few decide alone. Pass 2 gives
blocks that were left open the label of their nearest decided neighbours, first of those in the same part of the page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import mapped, slices, texts

#: Function words of common languages of the web.
STOP_WORDS = frozenset("""
the of and to in a is that it for was on are as with be by this at from or an not have but which they you he she we his her their were has had will
der die das und ist nicht ein eine zu den mit von sich des auf für im dem auch als es an werden aus er hat dass sie nach bei um noch wie einem über
le la les de des du et un une est que qui dans en pour par sur pas au aux ce il elle plus avec ne se son sont ou cette ses mais nous vous
el los las del y que en un una es por con no para su al lo como más pero sus este ya o si porque cuando muy sin sobre
il di che e per non una sono con del della le da si dei nel alla o em do dos das na no os as uma mais het een van en niet dat op te zijn voor met
""".split())  # fmt: skip
#: Elements whose content is raw text and none of the page, up to their end tag or that of the page; then those whose content is left out only if they end.
RAW, DROPPED = frozenset("script style title textarea iframe noembed noframes xmp".split()), frozenset("noscript template svg math object canvas audio video select button".split())
#: Comments, declarations, then tags: what begins first counts, so a tag in a comment is none.
TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'<]++|"[^"<]*+"|'[^'<]*+')*+[^<>]*+)(?:>|\Z)""", re.S)
END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for name in RAW | DROPPED}
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that are kept on the stack, for what they say of the blocks inside.
HOLDERS = BLOCKS - {"p", "hr", "h1", "h2", "h3", "h4", "h5", "h6"} | {"span"}
ASIDE = frozenset("nav footer aside form menu dialog fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Elements that are a part of a page.
ROOMS = frozenset("html body article main section div header footer aside nav form dialog fieldset blockquote td th".split())
#: Words in a class or id that tell of something beside the article; of the second kind only outside an article, inside one they leave the block to its densities. So do those of the first kind inside an article, unless nothing but such words
#: and names of boxes make up a class: ``social-history`` may be a chapter.
BESIDE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|menu|navi?|navbar|navigation|sidebar|footer|masthead|topbar|breadcrumbs?|cookies?|consent|gdpr|notices?|popup|newsletter|subscribe|shar(?:e|ing)|social|comments?|respond|replies|disqus|pag(?:er|ination)|hidden)(?:$|[\s_-])", re.I)
MAYBE = re.compile(r"(?:^|[\s_-])(?:side|alert|modal|overlay|signup|login|related|recommend\w*|widget|toolbar|copyright|disclaimer|teasers?|skip)(?:$|[\s_-])", re.I)
BOXES = frozenset("box list section container wrapper wrap block area bar item inner outer content top bottom left right main header body link links button buttons nav global site page post unit slot".split())
#: Of which the first kind's own may also name a chapter.
CHAPTERS = frozenset("comment notice notices".split())
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

SHORT, LONG, LINKS, STOPS_LOW, STOPS_HIGH, UNKNOWN = 70, 200, 1 / 3, 0.10, 0.25, 0.05


@dataclass
class Block:
    text: str
    linked: int
    beside: bool
    maybe: bool
    inside: bool
    room: int
    heading: bool
    label: bool | None = None


def _beside(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element, ``inside`` an article or not, is beside the article for sure, or maybe, by its name and attributes."""
    if tag in ASIDE:
        return True, True
    maybe = False
    for name, *values in ATTRIBUTE.findall(attributes) if attributes.strip() else ():
        value = "".join(values)
        name = name.lower()
        if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, True
        if name in ("class", "id"):
            value = CAMEL.sub("-", value)
            if BESIDE.search(value):
                maybe = True
                if not inside or any(_plainly(x) for x in value.split()):
                    return True, True
            maybe = maybe or MAYBE.search(value) is not None
    return False, maybe


def _plainly(name: str) -> bool:
    """Whether a class is made up of words that tell of something beside the article, and of boxes."""
    parts = [x.lower() for x in re.split("[-_]+", name) if x]
    told = [BESIDE.search(x) is not None for x in parts]
    return any(told) and all(t or x in BOXES or MAYBE.search(x) or x.isdigit() for t, x in zip(told, parts)) and not CHAPTERS.issuperset(parts)


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool, int]] = []  # element, beside, maybe beside, inside an article, number of its part of the page
    parts: list[str] = []
    linked, link, heading, at, seek, rooms = 0, 0, False, 0, 0, 0
    unended: set[str] = set()  # elements of which no end tag follows

    def close() -> None:
        nonlocal linked, parts
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, min(linked, len(text)), *(stack[-1][1:] if stack else (False, False, False, 0)), heading))
        parts, linked = [], 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw)
            parts.append(text)
            if link:
                linked += len(" ".join(text.split()))

    while m := TOKEN.search(page, seek):
        say(page[at : m.start()])
        at = seek = m.end()
        if m[2] is None:  # a comment or declaration
            continue
        end, tag, attributes = m[1], m[2].lower(), m[3]
        if tag in END and not end:
            alone = attributes.endswith("/")
            ended = None if tag in unended or alone and tag not in RAW else END[tag].search(page, at)
            if ended:
                at = seek = ended.end()
            elif tag in RAW and not alone:
                at = seek = len(page)
            elif tag in RAW or not alone:
                unended.add(tag)
            parts.append(" ")
            continue
        if tag == "a":
            link = 0 if end else 1
        elif tag == "br":
            parts.append(" ")
        if tag not in HOLDERS and tag not in BLOCKS:
            continue
        if tag in BLOCKS:
            close()
            link = 0
            heading = tag in HEADINGS and not end
        if tag not in HOLDERS or attributes.endswith("/"):
            continue
        if end:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag == "span" and stack[k][1]:
                        close()
                    del stack[k:]
                    break
        else:
            beside, maybe, inside, room = stack[-1][1:] if stack else (False, False, False, 0)
            if tag in ROOMS:
                rooms += 1
                room = rooms
            if tag not in ("html", "body", "article", "main", "head"):
                own = _beside(tag, attributes, inside)
                beside, maybe = beside or own[0] or tag == "header" and not inside or own[1] and not inside, maybe or own[1]
            if tag == "span" and beside and not (stack and stack[-1][1]):
                close()
            stack.append((tag, beside, maybe, inside or tag in ("article", "main"), room))
    say(page[at:])
    close()
    return out


def _density(text: str) -> float:
    """The share of stop words."""
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)


def _foreign(text: str) -> bool:
    """Most letters are of a script that none of the stop words is written in."""
    letters = [c for c in text if c.isalpha()]
    return 2 * sum(c > "\u024f" for c in letters) > len(letters)


def judge(found: list[Block]) -> None:
    """Pass 1. An article that a page marks is trusted if it holds most of the page's prose; then what is outside is none of it. Where stop words can't tell, since the
    page has hardly any, or a block's script has none, length and link density decide. Few stop words in a long block leave it open, in an article too.
    """
    density = {id(b): _density(b.text) for b in found if len(b.text) >= SHORT and not b.beside and b.linked <= LINKS * len(b.text)}
    prose = [b for b in found if id(b) in density]
    unknown = sum(density[id(b)] * len(b.text) for b in prose) < UNKNOWN * sum(len(b.text) for b in prose)
    tells = {id(b): unknown or density[id(b)] >= STOPS_LOW or _foreign(b.text) for b in prose}
    within = sum(len(b.text) for b in prose if b.inside and tells[id(b)])
    marked = any(b.inside and not b.beside for b in found) and 2 * within >= sum(len(b.text) for b in prose if tells[id(b)])
    for b in found:
        size = len(b.text)
        if not marked:
            b.inside = False
        if b.beside or marked and not b.inside or b.linked > LINKS * size or b.text.startswith("©") and size < (SHORT if b.inside else LONG):
            b.label = False
        elif b.maybe:  # named as if beside, in an article: prose by its densities stays
            b.label = size >= SHORT and (unknown or density[id(b)] >= STOPS_HIGH or _foreign(b.text))
        elif size < SHORT:
            b.label = None if not b.linked or b.inside else False
        else:
            own = density[id(b)]
            if own >= STOPS_HIGH or own >= STOPS_LOW and (b.inside or size >= LONG):
                b.label = True
            else:  # few stop words: lists, tables and the like, which their neighbours decide
                b.label = True if own < STOPS_LOW and tells[id(b)] else None


def _sides(found: list[Block], kind) -> tuple[list[int | None], list[int | None]]:
    """The nearest decided block of the same kind before and after each block."""
    out = []
    for order in (range(len(found)), range(len(found) - 1, -1, -1)):
        side, last = [None] * len(found), {}
        for k in order:
            side[k] = last.get(kind(found[k]))
            if found[k].label is not None:
                last[kind(found[k])] = k
        out.append(side)
    return out[0], out[1]


def settle(found: list[Block]) -> None:
    """Pass 2: an open block takes the label of its nearest decided neighbours in its part of the page, else in or outside the article as it is, else anywhere. Where they differ, a heading takes the next one's, others the
    nearer one's; of equally near ones in the same part the one before counts, elsewhere it is out. Open blocks of an article without decided ones are all there is of it.
    """
    if not any(b.label for b in found) and not any(b.inside for b in found):  # nothing but short blocks beside boilerplate: they are all there is
        for b in found:
            b.label = bool(b.label is None)
        return
    ways = [_sides(found, kind) for kind in (lambda b: (b.room, b.inside), lambda b: b.inside, lambda b: None)]
    labels = [b.label for b in found]
    for k, b in enumerate(found):
        if labels[k] is not None:
            continue
        for way, (before, after) in enumerate(ways):
            i, j = before[k], after[k]
            if i is None and j is None:
                if way == 1 and b.inside:
                    b.label = True
                    break
                continue
            if i is None or j is None or labels[i] == labels[j]:
                b.label = labels[j if i is None else i]
            elif b.heading:
                b.label = labels[j]
            else:
                b.label = labels[i] if k - i < j - k or k - i == j - k and way == 0 else labels[j] if j - k < k - i else False
            break
        else:
            b.label = False


def main_text(page: str) -> str:
    found = blocks(page)
    judge(found)
    settle(found)
    return " ".join(b.text for b in found if b.label)


def extract_text(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Adds ``text, n_chars`` to each row of ``pages`` (html, ...). Null or empty html has an empty text; rows that repeat give equal rows;
    an empty table gives an empty result. Pages are read whole, whatever their length, and markup that never ends is read as far as it goes.

    ``keep`` names the input columns to return (default all); those with the names of added ones are replaced.
    """
    plain = pages.drop("text", "n_chars")
    keep = plain.columns if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            out = [main_text(x.decode("utf-8", "replace")) for x in texts(batch, "html")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=[*keep, "text", "n_chars"])

    need = plain.select(*dict.fromkeys([*keep, "html"]))
    return mapped(need, run, T.StructType([*(need.schema[c] for c in keep), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))


def op8_html(spark, sf_dir):
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), ["page_id", "url"])
