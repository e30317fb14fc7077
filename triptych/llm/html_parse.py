"""One web page as a sequence of tokens with their places in the page."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import xxhash

# How elements behave, and which are not part of an article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr img picture source".split())
DROPPED = frozenset(
    "head script style noscript template iframe object embed svg canvas audio video map nav menu footer aside form "
    "button select option optgroup textarea input fieldset dialog title noembed noframes".split())
DROPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Names of layouts too: an article in an element that is called so is still one.
LAYOUT_NAMES = frozenset("nav navbar navigation menu header masthead banner footer sidebar".split())
HEADINGS = frozenset("header masthead banner".split())
DROPPED_NAMES = LAYOUT_NAMES | frozenset(
    "menus breadcrumb breadcrumbs aside notice notices cookie cookies consent gdpr ad ads adv advert adverts advertisement advertisements "
    "advertising adsense sponsor sponsored promo promotion comment comments disqus replies respond share sharing "
    "social related recommended newsletter subscribe subscription popup modal overlay login signup signin search "
    "form pagination pager toolbar copyright".split())
MAIN = frozenset(["article", "main"])
# A class that begins so tells what the page has around the element, or has not.
ABOUT = frozenset(["has", "with", "no", "without"])
# How an element is dropped: not, by the name of its layout alone, by a part of a name or a whole one (in so many elements),
# or for good.
NOT, LAYOUT, LOOSE, NAMED, GONE = 0, 1, 2, 1 << 16, 1 << 40
# What an opening element ends, if it is open.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
        "th": ("td", "th"), "option": ("option",)}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|[^<]++|<", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
TITLE = re.compile("h[1-6]")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Piece:
    """Text between two tags: its token, and where it stands."""

    token: int
    text: str
    block: int
    dropped: int
    main: bool
    common: bool = False


@dataclass
class Page:
    """Tokens in page order; those that are text as pieces."""

    tokens: list[int] = field(default_factory=list)
    pieces: list[Piece] = field(default_factory=list)


def _token(*parts: str) -> int:
    """The token of a tag: an even number."""
    return xxhash.xxh64_intdigest("\0".join(parts)) >> 2 << 1


def is_text(token: int) -> bool:
    return token & 1 == 1


def _names(names: str) -> list[list[str]]:
    """The words of each class name or id, but of those that tell about the page."""
    parts = ([p.lower() for p in PART.findall(name)] for name in names.split())
    return [own for own in parts if own and own[0] not in ABOUT]


def _blocks(names: str) -> set[str]:
    """The words of names that are known blocks as a whole: one word, or several that each say so; digits do not count."""
    whole = ([word for word in own if not word.isdigit()] for own in _names(names))
    return {word for own in whole if DROPPED_NAMES.issuperset(own) for word in own}


def _dropped(name: str, attributes: str, in_main: bool) -> tuple[int, str]:
    """Whether an element is no part of an article, and what tells it from others of its name.

    In the main part a class must name a known block as a whole; ids, and names of headings,
    say nothing there. Elsewhere a part of a name is enough, if no article is inside.
    """
    if name in DROPPED or name == "header" and not in_main:
        return GONE, name
    if not attributes.strip():
        return NOT, name
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}
    names = found.get("class", "") + " " + found.get("id", "")
    label = f"{name} {' '.join(names.split())}".rstrip()
    roles = set(found.get("role", "").lower().split())
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or roles & DROPPED_ROLES or re.search(
            r"display\s*:\s*none", found.get("style", ""), re.I):
        return GONE, label
    if name in ("body", "html"):
        return NOT, label
    if in_main or name in MAIN:
        known = not TITLE.fullmatch(name) and _blocks(found.get("class", "")) - HEADINGS
        return (GONE if known else NOT), label
    words = {word for own in _names(names) for word in own} & DROPPED_NAMES
    return (NOT if not words else LAYOUT if words <= LAYOUT_NAMES
            else NAMED if _blocks(names) - LAYOUT_NAMES else LOOSE), label


def _within(dropped: int, own: int) -> int:
    """How an element is dropped in another."""
    if GONE in (dropped, own):
        return GONE
    return dropped | own if LAYOUT in (dropped, own) else dropped + own


def parse(source: str) -> Page:
    """The tokens of a page: tags and texts, each told apart by the path of blocks that it stands in."""
    page = Page()
    # Open elements: name, path, how dropped, whether in the main part.
    stack: list[tuple[str, str, int, bool]] = [("", "", NOT, False)]
    block = at = 0
    while at < len(source):
        m = TOKEN.match(source, at)
        at = m.end()
        if m[2] is None:
            if m[0][0] == "<" and len(m[0]) > 1:
                continue
            raw = m[0]
            name, path, dropped, main = stack[-1]
            text = " ".join(html.unescape(raw).split())
            token = _token(path, text) + 1 if text else 0
            if text:
                page.tokens.append(token)
            page.pieces.append(Piece(token, html.unescape(raw), block, dropped, main))
            continue
        name = m[2].lower()
        if name not in INLINE:
            block += 1
        if m[1]:
            deep = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            if deep:
                page.tokens.append(_token(stack[deep][1], "/"))
                del stack[deep:]
            continue
        if name not in INLINE:
            ends = ENDS.get(name, ()) + (() if name in ("br", "hr") else ("p",))
            deep = len(stack) - 1
            while deep and (stack[deep][0] in INLINE or stack[deep][0] in ends):
                if stack[deep][0] in ends:
                    del stack[deep:]
                deep -= 1
        _, path, dropped, main = stack[-1]
        own, label = _dropped(name, m[3], main)
        if name in MAIN:
            dropped &= ~LAYOUT
        inner = path if name in INLINE else f"{path}/{label}"
        page.tokens.append(_token(inner, name))
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}", re.I).search(source, at)
            at = end.start() if end else len(source)
        if name not in VOID and not m[3].endswith("/"):
            stack.append((name, inner, _within(dropped, own), main or name in MAIN or 'role="main"' in m[3]))
        elif name in RAW:
            stack.append((name, inner, GONE, main))
    return page


def main_text(page: Page, template: frozenset[int]) -> str:
    """The blocks of the article, one a line: what fills the slots of the template.

    With an `article` or `main` element only what stands in one counts; else all that is
    not dropped. If all such elements, or all texts, stand in elements of which a part of a
    name is that of a block, those in the fewest of them count: then it is a name of the
    page. So does an `article` or `main` in an element that is called a block as a whole, if the
    page has nothing else. Pieces that are `common` in their slots are left out too. A page that has no
    other texts, as copies of one article may be, keeps them, and one whose texts are all
    template keeps those.
    """
    filled = [p for p in page.pieces if p.dropped < GONE and not p.dropped & LAYOUT and p.text.strip()]
    filled = [p for p in filled if p.dropped < NAMED] or [p for p in filled if p.main]
    inside = any(p.main for p in filled)
    least = min((p.dropped for p in filled if p.main or not inside), default=NOT)
    pieces = [p for p in page.pieces if p.dropped == least and (p.main or not inside)]
    own = [p for p in pieces if p.token not in template]
    return _joined([p for p in own if not p.common]) or _joined(own) or _joined(pieces)


def _joined(pieces: list[Piece]) -> str:
    blocks: dict[int, list[str]] = {}
    for piece in pieces:
        blocks.setdefault(piece.block, []).append(piece.text)
    lines = (" ".join("".join(texts).split()) for texts in blocks.values())
    return "\n".join(line for line in lines if line)
