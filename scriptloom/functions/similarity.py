"""Sequence similarity as vectorised functions: what Spark has no built-in for.

The ratio is that of longest matching blocks (``difflib``), with its rule of popular characters, and the window is always
its second argument.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

ACCEPT, STOP = 0.85, 0.98
TAGS = re.compile(r"<[^>]+>")
TIMES = (re.compile(r"[\[\(]?\b\d+:\d{2}(?:\d{2})?(?:[ap]m)?[\]\)]?", re.I), re.compile(r"(?:^|\s)[\[\(]?:\d{2}\b[\]\)]?"))
LABEL, SPEAKER = re.compile(r"\*\*[^*]+:\*\*\s*"), re.compile(r"(Speaker \d+|Unknown Speaker):\s*", re.I)
PUNCTUATION = re.compile("[.,!?;:—\\-'\"()]")


def normalize(text: str, aggressive: bool = False) -> str:
    """The Python twin of ``functions.text.normalize``, with all entities."""
    text = TAGS.sub(" ", html.unescape(text))
    for pattern in TIMES:
        text = pattern.sub(" ", text)
    if aggressive:
        text = PUNCTUATION.sub(" ", SPEAKER.sub("", LABEL.sub("", text)))
    return " ".join(text.split()).lower()


#: Words whose characters are counted at a time, characters of a text up to whose number counts are kept for all needles, and what is read at a time.
COUNTED, KINDS, READ = 50_000, 160, 1 << 20


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Haystack:
    """A text that many needles are looked for in: normalised once, its words' places, characters and numbers worked out when a needle first asks for them.

    Nothing of it holds an object for each character or word, so that a text takes a few times its own size at most.
    """

    def __init__(self, raw: str, aggressive: bool = False):
        self.raw, self.aggressive, self.text = raw, aggressive, normalize(raw, aggressive)

    @classmethod
    def of_words(cls, words: list[str]) -> Haystack:
        """A text that is normalised already."""
        self = cls("")
        self.text = " ".join(words)
        return self

    @cached_property
    def starts(self) -> np.ndarray:
        """Where words begin, and where one after the last would."""
        at = [np.flatnonzero(_codes(self.text[a : a + READ]) == 32) + a for a in range(0, len(self.text), READ)]
        ends = np.concatenate([np.array([-1]), *at, np.array([len(self.text)])]) if self.text else np.array([-1])
        return (ends + 1).astype(np.int32)

    @property
    def size(self) -> int:
        return len(self.starts) - 1

    def window(self, first: int, size: int) -> str:
        return self.text[self.starts[first] : self.starts[first + size] - 1]

    @cached_property
    def known(self) -> frozenset[str]:
        return frozenset(self.text) | {" "}

    @cached_property
    def located(self):
        from scriptloom.functions.offsets import normalized

        return normalized(self.raw, self.aggressive)

    def span(self, first: int, last: int) -> tuple[int, int]:
        """The raw span of the words [first, last)."""
        return self.located.raw(int(self.starts[first]), int(self.starts[last]) - 1)

    def _counted(self, kinds: np.ndarray, first: int, last: int) -> np.ndarray:
        """Running counts of each kind of character in the words [first, last), without the blanks between."""
        code = _codes(self.text[self.starts[first] : self.starts[last] - 1])
        kind = np.minimum(np.searchsorted(kinds, code), len(kinds) - 1)
        known = (kinds[kind] == code) & (code != 32)
        word = np.cumsum(code == 32)
        counts = np.bincount((word * len(kinds) + kind)[known], minlength=(last - first) * len(kinds)).reshape(-1, len(kinds))
        return np.concatenate([np.zeros((1, len(kinds)), dtype=np.int32), np.cumsum(counts, axis=0, dtype=np.int32)])

    @cached_property
    def _all(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Kinds of characters and their running counts, of texts that are short enough to keep them."""
        kinds = np.array(sorted(map(ord, self.known)), dtype=np.uint32)
        return (kinds, self._counted(kinds, 0, self.size)) if 0 < self.size <= COUNTED and len(kinds) <= KINDS else None

    def bounds(self, needle: str, size: int) -> np.ndarray:
        """An upper bound of the ratio of ``needle`` to each window of ``size`` words: the share of characters that both could have in common.

        It is what ``SequenceMatcher.quick_ratio`` gives, for all windows at once from running counts of the needle's characters in the words.
        """
        kinds, wanted = np.unique(_codes(needle), return_counts=True)
        out = []
        for at in range(0, self.size - size + 1, COUNTED):
            last = min(self.size, at + COUNTED + size - 1)
            if self._all:
                place = np.minimum(np.searchsorted(self._all[0], kinds), len(self._all[0]) - 1)
                here = self._all[0][place] == kinds
                kinds, wanted, total = kinds[here], wanted[here], self._all[1][:, place[here]]
            else:
                total = self._counted(kinds, at, last)
            have = total[size:] - total[:-size]
            have[:, kinds == 32] += size - 1
            length = self.starts[at + size : last + 1] - self.starts[at : last + 1 - size] - 1
            out.append(2 * np.minimum(have, wanted).sum(axis=1) / (len(needle) + length))
        return np.concatenate(out) if out else np.empty(0)

    def best_window(self, needle: str, accept: float, stop: float, inclusive: bool = True) -> tuple[int | None, float]:
        """(first word, ratio) of the best window of as many words as ``needle`` has; the first of equal ones, stopping at ``stop``.

        Windows whose upper bound can't beat what is known are never compared, which changes nothing in the result.
        """
        size = len(needle.split())
        best, place = 0.0, None
        if not size or self.size < size:
            return None, 0.0
        common = sum(c in self.known for c in needle)
        if 2 * common / (len(needle) + common) < accept:  # no window can have enough of the needle's characters
            return None, 0.0
        bounds = self.bounds(needle, size)
        matcher = SequenceMatcher(None, needle)
        for i in np.flatnonzero(bounds >= accept - 1e-9).tolist():
            if bounds[i] < best - 1e-9:
                continue
            matcher.set_seq2(self.window(i, size))
            ratio = matcher.ratio()
            if ratio > best and ratio >= accept:
                best, place = ratio, i
                if ratio >= stop if inclusive else ratio > stop:
                    break
        return place, best

    def find(self, needle: str | None, accept: float = ACCEPT) -> tuple[int | None, int | None, float]:
        """(start, end, ratio) of ``needle``, places of the raw text: where it is contained after normalising, else its best window of words. A blank needle is nowhere."""
        wanted = normalize(needle, self.aggressive) if needle else ""
        if not wanted:
            return None, None, 0.0
        at = self.text.find(wanted)
        if at >= 0:
            at = max(0, self.located.text.find(wanted))
            return *self.located.raw(at, at + len(wanted)), 1.0
        place, ratio = self.best_window(wanted, accept, STOP)
        return (None, None, 0.0) if place is None else (*self.span(place, place + len(wanted.split())), ratio)

    def ratio(self, needle: str | None, accept: float = ACCEPT) -> float:
        """The ratio of ``find``, without its places."""
        wanted = normalize(needle, self.aggressive) if needle else ""
        return 0.0 if not wanted else 1.0 if wanted in self.text else self.best_window(wanted, accept, STOP)[1]

    @cached_property
    def numbered(self) -> tuple[dict[str, int], np.ndarray]:
        """The words' numbers by their first places, and the text as numbers."""
        number: dict[str, int] = {}
        parts, at = [], 0
        while at < self.size:
            last = min(self.size, at + COUNTED)
            words = self.window(at, last - at).split(" ")
            parts.append(np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int32, count=last - at))
            at = last
        return number, np.concatenate(parts) if parts else np.empty(0, np.int32)

    def word_span(self, quote: str, accept: float = 0.7) -> tuple[int, int, float] | None:
        """(first word, word after the last, share) of the quote's words: the exact run, else the densest cluster of matching blocks.

        Blocks are only looked for where three lengths of the quote hold enough of its words at all.
        """
        want = normalize(quote, True).split()
        if not want or not self.size:
            return None
        at = f" {self.text} ".find(f" {' '.join(want)} ")
        if at >= 0:
            first = int(np.searchsorted(self.starts, at))
            return first, first + len(want), 1.0
        number, ids = self.numbered
        own = np.array([number.get(w, -1) for w in want], dtype=np.int32)
        total = np.concatenate([[0], np.cumsum(np.isin(ids, own[own >= 0]))])
        reach = min(3 * len(want), len(ids))
        if (total[reach:] - total[:-reach]).max() < accept * len(want) - 1e-9:
            return None
        blocks = [b for b in SequenceMatcher(None, ids.tolist(), own.tolist(), autojunk=False).get_matching_blocks() if b.size]
        best, left, total = (0, 0, 0), 0, 0
        for b in blocks:  # two pointers: blocks within three times the quote's length
            total += b.size
            while b.a + b.size - blocks[left].a > 3 * len(want):
                total -= blocks[left].size
                left += 1
            if total > best[0]:
                best = (total, blocks[left].a, b.a + b.size)
        share = best[0] / len(want)
        return (best[1], best[2], share) if share >= accept else None


def best_window(needle: str, words: list[str], accept: float, stop: float, inclusive: bool = True) -> tuple[int | None, float]:
    """``Haystack.best_window`` in a list of normalised words."""
    return Haystack.of_words(words).best_window(needle, accept, stop, inclusive)


def find(needle: str | None, text: str | None, aggressive: bool = False, accept: float = ACCEPT) -> tuple[int | None, int | None, float]:
    """``Haystack.find`` of one needle."""
    return (None, None, 0.0) if text is None else Haystack(text, aggressive).find(needle, accept)


def word_span(quote: str, text: str, accept: float = 0.7) -> tuple[int, int, float] | None:
    """``Haystack.word_span`` of one quote."""
    return Haystack(text, True).word_span(quote, accept)


FOUND = "start int, end int, ratio double"


def find_text(aggressive: bool = False, accept: float = ACCEPT) -> Callable:
    """A function of (needle, text) that gives a struct of start, end and ratio."""

    @F.pandas_udf(FOUND)
    def udf(needle: pd.Series, text: pd.Series) -> pd.DataFrame:
        rows = [find(a, b, aggressive, accept) for a, b in zip(needle, text, strict=True)]
        return pd.DataFrame({"start": pd.array([r[0] for r in rows], dtype="Int32"), "end": pd.array([r[1] for r in rows], dtype="Int32"), "ratio": [r[2] for r in rows]})

    return udf


def ratios(accept: float = ACCEPT, raw: bool = False) -> Callable:
    """A function of (needles, text) that gives the ratio of each needle in the text, which is normalised once for all of them; with ``raw`` a needle that stands in the raw text has 1."""

    @F.pandas_udf("array<double>")
    def udf(needles: pd.Series, text: pd.Series) -> pd.Series:
        out = []
        for some, t in zip(needles, text, strict=True):
            have = None if t is None else Haystack(t)
            out.append([0.0 if have is None else 1.0 if raw and n and n in t else have.ratio(n, accept) for n in (some if some is not None else [])])
        return pd.Series(out)

    return udf


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two whole strings; null if either is."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def html_unescape(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """All entities as characters."""
    for s in batches:
        yield s.map(lambda t: None if t is None else html.unescape(t))
