"""Main-content extraction by paragraph scores that rise to parents, discounted by link density.

The method, its word patterns and its weights are those of the public Readability algorithm (arc90's, later Mozilla's
Readability; Apache License 2.0), written anew on a flat tree.
"""

from __future__ import annotations

import re

from pageloom.kernels.dom import HEADINGS, Dom

# Class and id words that speak against or for a block, and tag weights.
UNLIKELY = re.compile(r"combx|comment|community|disqus|extra|foot|header|menu|remark|rss|shoutbox|sidebar|sponsor|ad-break|agegate|pagination|pager|popup|tweet|twitter|nav|breadcrumb|banner|promo|\bad\b", re.I)
MAYBE = re.compile(r"and|article|body|column|main|shadow", re.I)
POSITIVE = re.compile(r"article|body|content|entry|hentry|main|page|pagination|post|text|blog|story", re.I)
NEGATIVE = re.compile(r"combx|comment|com-|contact|foot|footer|footnote|masthead|media|meta|outbrain|promo|related|scroll|shoutbox|sidebar|sponsor|shopping|tags|tool|widget|nav", re.I)
TAG_WEIGHT = {"div": 5, "article": 10, "main": 10, "section": 5, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "form": -3, "aside": -5, "nav": -5, "footer": -5, "header": -5, **dict.fromkeys((*HEADINGS, "th"), -5)}
CHROME = frozenset("script style nav footer aside form noscript iframe button select input textarea".split())
BLOCKS = frozenset("a blockquote dl div img ol p pre table ul article section".split())

MIN_PARAGRAPH, MIN_RESULT = 25, 250


def _names(dom: Dom, i: int) -> str:
    return f"{dom.attrs[i].get('class', '')} {dom.attrs[i].get('id', '')}"


def _class_weight(dom: Dom, i: int) -> int:
    names = _names(dom, i)
    return 25 * bool(POSITIVE.search(names)) - 25 * bool(NEGATIVE.search(names)) if names.strip() else 0


def _link_density(dom: Dom, i: int) -> float:
    return sum(dom.length(a) for a in dom.find_all("a", within=i)) / max(1, dom.length(i))


def _dropped(dom: Dom, ruthless: bool) -> list[bool]:
    """Elements inside removed subtrees."""
    out = [False] * len(dom.tags)
    i = 0
    while i < len(out):
        tag, names = dom.tags[i], _names(dom, i)
        gone = tag in CHROME if ruthless else tag in ("script", "style")
        gone |= ruthless and tag not in ("html", "body", "article", "main") and bool(UNLIKELY.search(names)) and not MAYBE.search(names)
        if gone:
            out[i : dom.ends[i]] = [True] * (dom.ends[i] - i)
            i = dom.ends[i]
        else:
            i += 1
    return out


def _best(dom: Dom, gone: list[bool]) -> list[int]:
    """The top block and the siblings that belong to it."""
    scores: dict[int, float] = {}
    children: dict[int, set[str]] = {}
    for i, p in enumerate(dom.parents):
        children.setdefault(p, set()).add(dom.tags[i])
    for i, tag in enumerate(dom.tags):
        leaf = tag == "div" and not children.get(i, set()) & BLOCKS
        if gone[i] or not (tag in ("p", "pre", "td") or leaf):
            continue
        text = dom.text(i, " ")
        if len(text) < MIN_PARAGRAPH:
            continue
        gain = 1 + text.count(",") + min(len(text) // 100, 3)
        up = dom.parents[i]
        for share in (1.0, 0.5):
            if up < 0:
                break
            scores.setdefault(up, TAG_WEIGHT.get(dom.tags[up], 0) + _class_weight(dom, up))
            scores[up] += gain * share
            up = dom.parents[up]
    ranked = {i: s * (1 - _link_density(dom, i)) for i, s in scores.items()}
    if not ranked:
        return []
    top = max(ranked, key=lambda i: (ranked[i], -i))
    least = max(10.0, 0.2 * ranked[top])
    chosen = []
    for i in (k for k, p in enumerate(dom.parents) if p == dom.parents[top]):
        long_text = dom.tags[i] == "p" and dom.length(i) > 80 and _link_density(dom, i) < 0.25
        if i == top or not gone[i] and (ranked.get(i, 0) >= least or long_text):
            chosen.append(i)
    return chosen


def _chrome(dom: Dom, i: int) -> bool:
    """A block with few commas that is mostly links, or partly links under names that don't speak for it."""
    density = _link_density(dom, i)
    return density > 0.2 and dom.text(i).count(",") < 10 and (density > 0.5 or _class_weight(dom, i) < 25)


def _kept(dom: Dom, roots: list[int], gone: list[bool]) -> list[int]:
    """Elements of the result: link-heavy lists and low-weight headings go, with all inside them."""
    out = []
    for root in roots:
        i = root
        while i < dom.ends[root]:
            heavy = i != root and dom.tags[i] in ("ul", "ol", "div", "table", "section") and _chrome(dom, i)
            faint = dom.tags[i] in HEADINGS and (_class_weight(dom, i) < 0 or _link_density(dom, i) > 0.33)
            if gone[i] or heavy or faint:
                i = dom.ends[i]
            else:
                out.append(i)
                i += 1
    return out


def extract(dom: Dom) -> dict:
    """Text of the main content and how many headings, lists and code blocks it holds."""
    result: list[int] = []
    for ruthless in (True, False):
        gone = _dropped(dom, ruthless)
        result = _kept(dom, _best(dom, gone), gone)
        if sum(dom.length(i) for i in result[:1]) >= MIN_RESULT:
            break
    body = dom.first("body")
    if not result:
        result = _kept(dom, [body] if body is not None else [], _dropped(dom, False)) or list(range(len(dom.tags)))
    inside = set(result)
    text = " ".join(s for s in (t.strip() for t, p in zip(dom.texts, dom.text_parents, strict=True) if p in inside) if s)
    count = lambda *tags: sum(dom.tags[i] in tags for i in result)
    title = dom.first("title")
    return {"text": text, "title": dom.text(title).strip() if title is not None else "", "headings": count(*HEADINGS), "lists": count("ul", "ol"), "code": count("pre", "code")}
