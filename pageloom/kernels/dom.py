"""A flat HTML tree on the standard library's tokenizer.

Elements are numbered in document order, so a subtree is a range of numbers, and the text of an element is a range of
text nodes.  Lengths of stripped text come from prefix sums.  Void elements never stay open; an end tag closes up to
the nearest open element of its name and is ignored if there is none; script and style bodies are raw and are no text.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


class Dom(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = []
        self.attrs: list[dict[str, str]] = []
        self.parents: list[int] = []
        self.ends: list[int] = []  # one past the last element of the subtree
        self.first_text: list[int] = []
        self.last_text: list[int] = []
        self.raw: dict[int, str] = {}  # bodies of script and style
        self.texts: list[str] = []
        self.text_parents: list[int] = []
        self._open: list[int] = []
        self.by_tag: dict[str, list[int]] = {}
        self.feed(html)
        self.close()
        self._close_to(0)
        self.lengths = [0]
        for t in self.texts:
            self.lengths.append(self.lengths[-1] + len(t.strip()))

    def updatepos(self, i: int, j: int) -> int:
        """Line numbers are of no use here."""
        return j

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        i = len(self.tags)
        self.tags.append(tag)
        self.attrs.append({k: v or "" for k, v in reversed(attrs)} if attrs else {})
        self.parents.append(self._open[-1] if self._open else -1)
        self.ends.append(i + 1)
        self.first_text.append(len(self.texts))
        self.last_text.append(len(self.texts))
        self.by_tag.setdefault(tag, []).append(i)
        if tag not in VOID:
            self._open.append(i)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self._open) - 1, -1, -1):
            if self.tags[self._open[depth]] == tag:
                self._close_to(depth)
                return

    def _close_to(self, depth: int) -> None:
        for i in self._open[depth:]:
            self.ends[i], self.last_text[i] = len(self.tags), len(self.texts)
        del self._open[depth:]

    def handle_data(self, data: str) -> None:
        if self._open and self.tags[self._open[-1]] in ("script", "style"):
            i = self._open[-1]
            self.raw[i] = self.raw.get(i, "") + data
        else:
            self.texts.append(data)
            self.text_parents.append(self._open[-1] if self._open else -1)

    def find_all(self, *tags: str, within: int | None = None) -> list[int]:
        """Elements of these tags in document order; nested ones all count."""
        found = self.by_tag.get(tags[0], []) if len(tags) == 1 else sorted(i for t in tags for i in self.by_tag.get(t, ()))
        return found if within is None else [i for i in found if within < i < self.ends[within]]

    def first(self, *tags: str) -> int | None:
        return next(iter(self.find_all(*tags)), None)

    def count(self, *tags: str) -> int:
        return sum(len(self.by_tag.get(t, ())) for t in tags)

    def with_class(self, name: str) -> list[int]:
        return [i for i, a in enumerate(self.attrs) if "class" in a and name in a["class"].split()]

    def with_id(self, name: str) -> list[int]:
        return [i for i, a in enumerate(self.attrs) if a.get("id") == name]

    def rel(self, i: int) -> list[str]:
        return self.attrs[i].get("rel", "").split()

    def pieces(self, i: int | None = None) -> Iterator[str]:
        """Stripped non-empty text nodes of an element, or of the page."""
        span = self.texts if i is None else self.texts[self.first_text[i] : self.last_text[i]]
        return (s for s in map(str.strip, span) if s)

    def text(self, i: int | None = None, separator: str = "") -> str:
        return separator.join(self.pieces(i))

    def plain(self, i: int) -> str:
        """Text as it stands, unstripped."""
        return "".join(self.texts[self.first_text[i] : self.last_text[i]])

    def length(self, i: int | None = None) -> int:
        """Characters of ``text(i)``."""
        return self.lengths[-1] if i is None else self.lengths[self.last_text[i]] - self.lengths[self.first_text[i]]

    def metas(self, **wanted: str) -> list[int]:
        (key, value), *_ = wanted.items()
        return [i for i in self.by_tag.get("meta", ()) if self.attrs[i].get(key) == value]
