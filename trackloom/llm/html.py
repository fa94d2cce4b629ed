"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. What stands in menus, headers, footers,
asides, forms, adverts, notices and comment sections, by tag or by the words of class, id
and role, is decided against at once. Pass one looks at each other block by itself: the
share of its characters within links, its length, its share of stop words. Blocks that these
don't settle (short ones above all) stay open, and pass two gives them the label of the
nearest settled neighbours in their region: good if those on both sides are good, or the only
one is; between a good and a bad one, the nearer counts, and the good one at a tie. A page that
marks its article (article, main, role=main, itemprop=articleBody) has two regions: nothing
outside the article is good, and inside it all is but for what is out by its element or by a
name that says no other thing (a share bar, reader comments). Blocks inside it whose name could
mean either (a notice, something related, a discussion) are decided on by the two passes;
there an open block goes only if its settled neighbours are bad.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm import common

# Names of HTML elements and common words.
RAW = "script|style|noscript|template|iframe|svg|math|object|canvas|audio|video|textarea|select|title"
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
) - {"br"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never main text.
OUT = frozenset("nav footer aside form menu dialog button".split())
#: Containers that are followed on a stack.
HELD = OUT | frozenset("article main section div header fieldset ul ol li table td body span p".split())
#: Words in class, id or role that name what isn't main text.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert "
    "popup modal overlay sidebar sidenav rail menu menubar nav navbar navigation navigationbar breadcrumb breadcrumbs toolbar share sharing social follow "
    "related recommended recommendations newsletter subscribe subscription signup login masthead header footer copyright complementary contentinfo search "
    "comment comments commentlist disqus replies reply respond discussion widget pagination pager skip paywall disclaimer tagcloud".split()
)
#: Those of them that may also name a part of an article.
EITHER = frozenset(
    "notice notices alert banner related recommended recommendations discussion widget search rail header masthead footer copyright disclaimer complementary "
    "contentinfo overlay follow social skip respond reply replies subscription sponsor consent".split()
)
#: Names of what is no article though its element says so.
TEASER = frozenset("comment comments commentlist disqus replies reply ad ads advert adverts advertisement sponsored promo related recommended".split())
#: What notices speak of.
SAID = re.compile(r"\b(cookies?|privacy policy|terms of (use|service)|all rights reserved|newsletter|subscribe|sign (up|in)|log ?in|advertisement|sponsored)\b|©", re.I)
STOP = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were her all their there been "
    "if more when will would who so no out up into than them can only other some could time these two may then do first any my now such like our over "
    "de la le les des un une et en du est que qui dans pour pas sur au par plus avec ne se ce il elle son sa ses ou mais nous vous ont été aux ces leur "
    "der die das und ist nicht ein eine zu den mit von auf für im dem des sich auch als an es er sie wird bei aus sind noch wie nach einer um am haben nur "
    "el los las y del se no una con su para es al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde "
    "il di che è per un non sono da con del si le della più anche come ma o os as do da em um uma com não na no por mais dos como mas foi".split()
)
TOKEN = re.compile(
    rf"""(?P<comment><!--.*?(?:-->|\Z))
    |<(?P<raw>{RAW})\b[^>]*(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))
    |<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>[^<>"']*(?:(?:"[^"]*"|'[^']*')[^<>"']*)*)>
    |<[!?/a-zA-Z][^<>]*(?:>|\Z)""",
    re.X | re.S | re.I,
)
ATTR = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME_WORDS = re.compile(r"[a-z0-9]+")
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Rules:
    """Thresholds of pass one: share of linked characters, words of a short and of a long
    block, share of stop words, characters of a long block in an unknown language."""

    linked: float = 0.4
    short: int = 8
    long: int = 25
    stop_low: float = 0.12
    stop_high: float = 0.25
    wide: int = 120


#: What an element says about its content: nothing, that its name may be that of a part of an
#: article, that its name isn't, that the element itself isn't.
PLAIN, MAYBE, NAME, TAG = range(4)


@dataclass
class Block:
    text: str
    linked: int  # characters within links
    links: int
    out: bool  # decided against by where it stands
    inside: bool  # of a marked article
    either: bool  # inside it, by a name that could mean a part of it
    tag: str
    label: str = ""
    near: list = field(default_factory=list)  # (label, distance) of the settled neighbours


def blocks(html: str) -> list[Block]:
    """The blocks with any text, in page order."""
    found: list[Block] = []
    stack: list[tuple[str, int, bool]] = []  # (element, weight, opens an article)
    parts: list[str] = []
    state = {"linked": 0, "links": 0, "tag": ""}
    in_link, at = False, 0

    def standing() -> tuple[bool, bool, bool]:
        """(out, inside an article, either). An article isn't undone by the names around it, nor
        by a form around the whole page, but by an element or an attribute that hides it."""
        out = inside = either = closed = False
        for element, weight, article in stack:
            closed |= weight == TAG and element != "form"
            if article and not closed:
                inside, out, either = True, False, False
            out |= weight in (TAG, NAME) or (weight == MAYBE and not inside)
            either |= weight == MAYBE
        return out, inside, either and inside and not out

    def flush():
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out, inside, either = standing()
            found.append(Block(text, min(state["linked"], len(text)), state["links"], out, inside, either, state["tag"]))
        state["linked"] = 0
        state["links"] = 1 if in_link else 0

    def say(raw: str):
        if raw:
            text = unescape(raw)
            parts.append(text)
            if in_link:
                state["linked"] += len(text.strip())

    for m in TOKEN.finditer(html):
        say(html[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name == "a":
            in_link = not m["close"]
            state["links"] += in_link
            continue
        block = name in BLOCK
        if block:
            flush()
        if m["close"]:
            if any(e == name for e, _, _ in stack):
                while stack.pop()[0] != name:
                    pass
        elif name not in VOID and name in HELD and not (m["attrs"] or "").endswith("/"):
            attrs = {k.lower(): v.strip("\"'").lower() for k, v in ATTR.findall(m["attrs"] or "")}
            words = set(NAME_WORDS.findall(" ".join(attrs.get(k, "") for k in ("class", "id", "role"))))
            hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "")
            article = name in ("article", "main") or attrs.get("role") in ("main", "article") or "articlebody" in attrs.get("itemprop", "")
            named = words & NAMES if name != "body" else set()
            if name in OUT or hidden or (article and words & TEASER):
                weight = TAG
            elif article:
                weight = PLAIN  # classes of an article speak of the page's layout
            elif named:
                weight = MAYBE if named <= EITHER else NAME
            else:
                weight = NAME if name == "header" and not any(a for _, _, a in stack) else PLAIN
            if name == "p":  # a paragraph ends where the next one or any block begins
                stack[:] = [s for s in stack if s[0] != "p"]
            if weight or article or name not in ("p", "span", "li"):
                stack.append((name, weight, article and weight == PLAIN))
        if block:
            state["tag"] = name
    say(html[at:])
    flush()
    return found


def label(found: list[Block], rules: Rules) -> None:
    marked = any(b.inside and not b.out for b in found)
    words = [WORD.findall(b.text.lower()) for b in found]
    share = [sum(w in STOP for w in x) / len(x) if x else 0.0 for x in words]
    # A page in a language whose common words aren't known goes by length and links alone.
    known = any(s >= rules.stop_low for s, x in zip(share, words, strict=True) if len(x) >= rules.short)
    for b, x, stop in zip(found, words, share, strict=True):
        n, linked = len(x), b.linked / len(b.text)
        if b.out or (marked and not b.inside):
            b.label = "bad"
        elif marked and not b.either:
            b.label = "good"
        elif linked > rules.linked or (n < rules.long and SAID.search(b.text)):
            b.label = "bad"
        elif marked:
            b.label = "good" if n >= rules.short and (stop >= rules.stop_low or not known) else ""
        elif not known:
            b.label = "good" if n >= rules.long or len(b.text) >= rules.wide else "bad" if b.linked else ""
        elif n < rules.short:
            b.label = "bad" if b.linked else ""
        elif stop >= rules.stop_high:
            b.label = "good"
        elif stop >= rules.stop_low:
            b.label = "good" if n >= rules.long else ""
        elif n >= rules.long:
            b.label = "bad"
    # Pass two, a sweep from either side; in a page with an article only what stands in it counts.
    for order in (range(len(found)), range(len(found) - 1, -1, -1)):
        settled, place = "", 0
        for i in order:
            b = found[i]
            if b.label and not (marked and (b.out or not b.inside)):
                settled, place = b.label, i
            elif not b.label:
                b.near.append((settled, abs(i - place)))
    for b in found:
        if b.label:
            continue
        (before, d1), (after, d2) = b.near
        known = [x for x in (before, after) if x]
        if not known:
            b.label = "good" if marked else "bad"
        elif len(set(known)) == 1:
            b.label = known[0]
        elif marked:
            b.label = "good"
        elif d1 == d2:
            b.label = "good"
        else:
            b.label = before if d1 < d2 else after


def main_text(html: str | None, rules: Rules = Rules()) -> str:
    if not html:
        return ""
    found = blocks(html)
    label(found, rules)
    return " ".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page.

    Null or empty html: empty text. Pages of any length are read whole, repeated rows each give
    their row, extra columns aren't read, an empty table gives none.
    """

    def run(batches):
        for b in batches:
            got = [main_text(h, rules) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return common.pick(pages, page_id="long", url="string", html="string").mapInArrow(common.tidy(run), "page_id long, url string, text string, n_chars long")


def op10_html_blocks(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
