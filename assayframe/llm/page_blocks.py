"""Web pages as blocks of text with the zone they stand in."""

from __future__ import annotations

import functools
import html as entities
import re
from collections import Counter

#: Zones: page furniture, the article, undecided text of pages without a marked article, other text beside an article.
FURNITURE, ARTICLE, NEUTRAL, BESIDE = 0, 1, 2, 3

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)
      | <(script|style|textarea|iframe|noembed|xmp)\b(?:"[^"]*+"|'[^']*+'|[^'">])*+>.*?(?:</\1\s*>|\Z)
      | <(/?)([a-z][^\s/>]*)((?:"[^"]*+"|'[^']*+'|[^'">])*+)>
      | <[!?/][^>]*(?:>|\Z)
      | <[a-z][^<>]*\Z""", re.S | re.I | re.X)
_ATTRIBUTE = re.compile(r"""([^\s"'=/]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s"'=/]+)""")

# Elements by what they mean.
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr
  math mfrac mi mn mo mover mrow ms mspace msqrt msub msubsup msup mtext munder munderover""".split())
FURNITURE_TAGS = frozenset("nav footer aside button select option datalist dialog menu noscript template svg object audio video canvas map head".split())
CONTAINERS = FURNITURE_TAGS | frozenset("html body header article main section div ul ol dl table figure details fieldset center blockquote form".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
FURNITURE_WORDS = frozenset("""ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promos promotion banner nav navbar navigation menu menus
  breadcrumb breadcrumbs sidebar sidebars rail widget widgets related recommended recommendations share sharing social newsletter subscribe subscription signup
  cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay lightbox comment comments commentlist disqus reply replies respond
  discussion feedback footer masthead topbar toolbar pagination pager skip hidden login search offscreen paywall""".split())
READER_WORDS = frozenset("comment comments commentlist disqus reply replies respond discussion feedback".split())
PLAIN_WORDS = frozenset("""area article articles bar block bottom box button buttons center close col column container content form fixed global header icons inner item items left
  link links list main message module news outer page panel popular post posts primary right row secondary section site slot tags title tools top unit wrap wrapper""".split())
BODY_WORDS = frozenset("article post entry story main".split())
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


def names_furniture(name: str) -> str:
    """What a class or id names if all of its words name page furniture or parts of a page: ``reader``, ``furniture`` or nothing.

    A name with any other word, such as ``share-price``, names a topic.
    """
    words = {w.lower() for w in _NAME_PARTS.findall(name) if not w.isdigit()}
    if not words & FURNITURE_WORDS or words - FURNITURE_WORDS - PLAIN_WORDS:
        return ""
    return "reader" if words & READER_WORDS else "furniture"


@functools.lru_cache(maxsize=1 << 14)
def meaning(tag: str, attributes: str) -> str:
    """What an element holds: ``furniture``, ``article``, ``main``, ``header`` or nothing in particular.

    Furniture by element, role or style is certain; ``suspect`` and ``reader`` (comments) go by names only,
    and a ``form`` may hold a whole page.
    """
    found: dict[str, str] = {}
    for name, *values, bare in _ATTRIBUTE.findall(attributes):
        found.setdefault((name or bare).lower(), "".join(values))
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    role, style = found.get("role", "").lower(), re.sub(r"\s", "", found.get("style", "").lower())
    if tag in FURNITURE_TAGS or role in FURNITURE_ROLES or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style:
        return "furniture"
    named = {names_furniture(n) for n in names} if tag not in ("html", "body") else set()
    if "reader" in named:
        return "reader"
    if "furniture" in named:
        return "suspect"
    if tag == "form":
        return "form"
    if tag == "article" or found.get("itemprop", "").lower() == "articlebody":
        return "article"
    if tag == "main" or role == "main":
        return "main"
    if any((w := [x.lower() for x in _NAME_PARTS.findall(n)]) and w[0] in BODY_WORDS and w[-1] in ("body", "content", "text") for n in names):
        return "article"
    return "header" if tag == "header" else ""


def blocks(page: str | None) -> list[tuple[str, int]]:
    """``(text, zone)`` of every block in page order; white space is one space, character references are decoded.

    Open elements are tracked by name, so unclosed and stray tags do no harm; an article that begins inside unclosed
    navigation or page header ends that. Comments, scripts, styles and a tag cut off at the end hold no text. Articles mark
    the page only if they hold more than half of its text without furniture. An element that only its name or a form around
    it makes suspect is furniture if the unsuspected text is at least as long (for reader comments, and for names beside an
    article: if there is any), or if it consists of links; so no page loses its only text to a name. An article inside a form is not suspect.
    """
    if not page:
        return []
    raw: list[tuple[str, str, float, int]] = []
    stack: list[tuple[str, str, int]] = []
    suspects: list[str] = [""]  # kinds of the outermost suspect elements; 0 is none
    opened: Counter = Counter()  # open elements by name
    inside: Counter = Counter()  # and by meaning
    pieces: list[str] = []
    linked, in_link, at, suspect = 0, False, 0, 0

    def close(name: str) -> None:
        nonlocal suspect
        if opened[name]:
            while True:
                gone, kind, suspect = stack.pop()
                opened[gone] -= 1
                inside[kind] -= 1
                if gone == name:
                    return

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                where = "furniture" if inside["furniture"] else "article" if inside["article"] else "main" if inside["main"] else "header" if inside["header"] else "body"
                raw.append((text, where, linked / len(text), suspect))
            pieces.clear()
            linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if "&" in piece:
            piece = entities.unescape(piece)
        pieces.append(piece)
        if in_link:
            linked += len(piece.strip())

    for m in _TAG.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                in_link = not m[2]
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        flush()
        if tag not in CONTAINERS and "=" not in m[4]:
            continue
        if m[2]:
            close(tag)
        elif not m[4].endswith("/"):
            if tag == "body":
                close("head")
            kind = meaning(tag, m[4])
            if tag in CONTAINERS:
                if kind in ("article", "main"):
                    close("nav")
                    if not inside["article"] and not inside["main"]:
                        close("header")
                stack.append((tag, kind, suspect))
                opened[tag] += 1
                inside[kind] += 1
                if kind in ("article", "main") and suspects[suspect] == "form":
                    suspect = 0
                elif kind in ("suspect", "reader", "form") and not suspect:
                    suspects.append(kind)
                    suspect = len(suspects) - 1
    if at < len(page):
        add(page[at:])
    flush()
    chars, doubted, doubted_links = Counter(), Counter(), Counter()
    for text, where, links, doubt in raw:
        if where != "furniture":
            doubted[doubt] += len(text)
            doubted_links[doubt] += links * len(text)
        if not doubt:
            chars[where] += len(text)
    plain = doubted[0] - chars["header"]
    in_article = {doubt for _, where, _, doubt in raw if where == "article"}

    def is_furniture(doubt: int) -> bool:
        size = doubted[doubt]
        beside = suspects[doubt] == "suspect" and chars["article"] > 0 and doubt not in in_article
        return plain > 0 and (suspects[doubt] == "reader" or beside or size <= plain) or doubted_links[doubt] > 0.8 * size

    dropped = {i for i in range(1, len(suspects)) if is_furniture(i)}
    for text, where, _, doubt in raw:
        if doubt and doubt not in dropped:
            chars[where] += len(text)
    # an article with the smaller share of the text is a teaser: then all text is undecided
    teaser = 2 * chars["article"] <= chars["article"] + chars["main"] + chars["body"]
    marked = ("main" if chars["main"] else None) if not chars["article"] else None if teaser else "article"

    def zone(where: str, links: float, doubt: int) -> int:
        if where == "furniture" or doubt in dropped or where == "header" and not marked:
            return FURNITURE
        if marked:
            return ARTICLE if where == marked or where == "article" else BESIDE
        return FURNITURE if links > 0.8 else NEUTRAL

    return [(text, zone(where, links, doubt)) for text, where, links, doubt in raw]
