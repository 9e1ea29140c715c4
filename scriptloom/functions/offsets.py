"""Normalised text that knows its places in the raw text.

Search runs on the normalised form; places that are cut, marked or replaced are raw ones, whatever entities, tags, line ends or punctuation lie between.
The map from one to the other is kept piecewise: a piece begins only where characters were left out, added or joined, so that it takes a few bytes a
change and not some of each character. A place is found by bisection.
"""

from __future__ import annotations

import html
import re
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterable

from scriptloom.functions.similarity import LABEL, PUNCTUATION, SPEAKER, TAGS, TIMES

_ENTITY = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?")
_BLANK, _BLANKS = re.compile(r"\s"), re.compile("  +")


class Located:
    """A text with the raw span [start, end) of each of its characters.

    Pieces begin at ``at``. In a piece that is copied (``stop`` -1) places run on from ``raw``; in one that replaces, all characters span [raw, stop).
    """

    def __init__(self, raw: str):
        self.text, self.at, self.raw_at, self.stop = raw, array("i", [0]), array("i", [0]), array("i", [-1])

    def start(self, i: int) -> int:
        j = bisect_right(self.at, i) - 1
        return self.raw_at[j] + i - self.at[j] if self.stop[j] < 0 else self.raw_at[j]

    def end(self, i: int) -> int:
        j = bisect_right(self.at, i) - 1
        return self.raw_at[j] + i - self.at[j] + 1 if self.stop[j] < 0 else self.stop[j]

    def _rebuild(self, changes: Iterable[tuple[int, int, int]], first: int, last: int) -> None:
        """The pieces of [first, last) after changes (start, end, new length), in order; a replacement spans what it replaces."""
        at, raw, stop = array("i"), array("i"), array("i")
        place, old, j = 0, first, 0

        def add(begin: int, r: int, s: int) -> None:
            if not (s < 0 and stop and stop[-1] < 0 and raw[-1] + begin - at[-1] == r):  # else the last piece goes on
                at.append(begin)
                raw.append(r)
                stop.append(s)

        def copy(until: int) -> None:
            nonlocal place, old, j
            while old < until:
                while j + 1 < len(self.at) and self.at[j + 1] <= old:
                    j += 1
                to = min(until, self.at[j + 1]) if j + 1 < len(self.at) else until
                add(place, self.raw_at[j] + old - self.at[j] if self.stop[j] < 0 else self.raw_at[j], self.stop[j])
                place, old = place + to - old, to

        for a, z, size in changes:
            copy(a)
            if size:
                add(place, self.start(a), self.end(z - 1))
            place, old = place + size, z
        copy(last)
        if not at:
            add(0, self.start(min(first, max(0, len(self.text) - 1))), -1)
        self.at, self.raw_at, self.stop = at, raw, stop

    def replace(self, pattern: re.Pattern, by: str | Callable[[str], str]) -> Located:
        """Matches replaced; a replacement spans what it replaces."""
        text, changes, done = [], [], 0
        for m in pattern.finditer(self.text):
            a, z = m.span()
            new = by if isinstance(by, str) else by(m[0])
            if new == m[0]:
                continue
            text += (self.text[done:a], new)
            done = z
            if len(new) != 1 or z - a != 1:
                changes.append((a, z, len(new)))
        if changes:
            self._rebuild(changes, 0, len(self.text))
        if done:
            self.text = "".join([*text, self.text[done:]])
        return self

    def swap(self, pattern: re.Pattern, by: str) -> Located:
        """Matches of one character replaced by another, which moves nothing."""
        self.text = pattern.sub(by, self.text)
        return self

    def strip(self) -> Located:
        a, z = len(self.text) - len(self.text.lstrip()), len(self.text.rstrip())
        if a or z < len(self.text):
            self._rebuild((), a, max(a, z))
            self.text = self.text[a : max(a, z)]
        return self

    def lower(self) -> Located:
        if len(low := self.text.lower()) != len(self.text):  # a character whose lower case is longer
            self._rebuild([(i, i + 1, n) for i, c in enumerate(self.text) if (n := len(c.lower())) != 1], 0, len(self.text))
            low = "".join(c.lower() for c in self.text)
        self.text = low
        return self

    def raw(self, a: int, z: int) -> tuple[int, int]:
        """The raw span of the characters [a, z)."""
        return (self.start(a), self.end(z - 1)) if z > a else (self.start(a) if a < len(self.text) else 0,) * 2


def normalized(text: str, aggressive: bool = False) -> Located:
    """``similarity.normalize`` with places."""
    t = Located(text)
    if "&" in text:
        t.replace(_ENTITY, html.unescape)
    t.replace(TAGS, " ")
    for pattern in TIMES:
        t.replace(pattern, " ")
    if aggressive:
        t.replace(LABEL, "").replace(SPEAKER, "").swap(PUNCTUATION, " ")
    return t.swap(_BLANK, " ").replace(_BLANKS, " ").strip().lower()
