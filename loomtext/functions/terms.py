"""Dictionary terms in text: longest-match search, boundary-aware replacement, and the metrics made of them."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

# The letters of the block, marks and digits included, and the inflections that may follow a term
# (those that begin with another of the list are left out: they allow nothing more).
LETTERS = "\u0900-\u097f"
SUFFIXES = ("साठी", "मध्ये", "कडे", "हून", "पर्यंत", "प्रमाणे", "च्या", "ची", "चा", "चे", "ला", "ना", "ने", "शी", "त", "ो", "ी", "े", "ा")
#: White space as Python's regular expressions see it.
_BLANKS = re.compile(r"\s+")


def fold(s: str) -> str:
    return _BLANKS.sub("", s.lower())


@dataclass
class Matcher:
    """A dictionary in one direction. boundary: "lenient" lets anything follow a term in a prediction, "suffix" only listed inflections."""

    terms: dict[str, str]
    boundary: str = "suffix"
    letters: str = LETTERS
    suffixes: Iterable[str] = SUFFIXES
    _sizes: dict[str, list[int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.boundary not in ("lenient", "suffix"):
            raise ValueError(f"boundary: {self.boundary}")
        by_first: dict[str, set[int]] = {}
        for t in self.terms:
            if t:
                by_first.setdefault(t[0], set()).add(len(t))
        self._sizes = {c: sorted(n, reverse=True) for c, n in by_first.items()}
        self._letter = re.compile(f"[{self.letters}]")
        self._tail = re.compile(rf"\Z|[^{self.letters}]|{'|'.join(map(re.escape, self.suffixes))}")

    def find(self, text: str | None) -> list[tuple[str, str]]:
        """Terms in order, the longest at each place, none within a longer word; a term that recurs is there again."""
        text, out, at = text or "", [], 0
        letter, n = self._letter.match, len(text or "")
        while at < n:
            step = 1
            if text[at] in self._sizes and (at == 0 or not letter(text[at - 1])):
                for size in self._sizes[text[at]]:
                    end = at + size
                    if end <= n and (end == n or not letter(text[end])) and text[at:end] in self.terms:
                        out.append((text[at:end], self.terms[text[at:end]]))
                        step = size
                        break
            at += step
        return out

    def _place(self, text: str, term: str, boundary: str, at: int = 0) -> int:
        """Where the term is from `at` on, no letter before it and what may follow it behind; -1 for nowhere. No pattern is kept for a term."""
        at = text.find(term, at)
        while at >= 0 and (at and self._letter.match(text[at - 1]) or boundary != "lenient" and not self._tail.match(text, at + len(term))):
            at = text.find(term, at + 1)
        return at

    def holds(self, text: str, term: str, boundary: str | None = None) -> bool:
        return self._place(text, term, boundary or self.boundary) >= 0

    def _put(self, text: str, term: str, target: str) -> str:
        """The text with the target in each of the term's places, which don't overlap."""
        out, done = [], 0
        while (at := self._place(text, term, self.boundary, done)) >= 0:
            out += [text[done:at], target]
            done = at + len(term)
        return "".join([*out, text[done:]])

    def rewrite(self, source: str | None, prediction: str | None, found: list[tuple[str, str]] | None = None) -> tuple[str, list[list[str]]]:
        """The prediction with the source's terms that were left untranslated put right, and what was put right.

        A later term sees the edits of earlier ones. Terms whose two forms fold alike are left alone.
        """
        text, edits = prediction or "", []
        for term, target in self.find(source) if found is None else found:
            if fold(term) != fold(target) and self.holds(text, term) and not self.holds(text, target):
                new = self._put(text, term, target)
                if new != text:
                    edits.append([term, target])
                    text = new
        return text, edits

    def metrics(self, source: str | None, prediction: str | None, found: list[tuple[str, str]] | None = None) -> tuple[int, int, int, int]:
        """alignment hits and total, translation hits and total; always by the lenient boundary."""
        got = [0, 0, 0, 0]
        for term, target in self.find(source) if found is None else found:
            hit = self.holds(prediction or "", target, "lenient")
            got[0] += hit
            got[1] += 1
            if fold(term) != fold(target):
                got[2] += hit
                got[3] += 1
        return tuple(got)


def spans(text: str | None, longest: int, letters: str = LETTERS) -> list[tuple[int, str]]:
    """(place, words) of every stretch up to `longest` that neither begins nor ends within a word: what a term can match."""
    text = text or ""
    letter = re.compile(f"[{letters}]").match
    begins = [i for i in range(len(text)) if i == 0 or not letter(text[i - 1])]
    ends = [i for i in range(1, len(text) + 1) if i == len(text) or not letter(text[i])]
    out, low = [], 0
    for b in begins:
        while low < len(ends) and ends[low] <= b:
            low += 1
        k = low
        while k < len(ends) and ends[k] - b <= longest:
            out.append((b, text[b : ends[k]]))
            k += 1
    return out


def greedy(found: list[tuple[int, str, str]]) -> list[tuple[str, str]]:
    """Of matches (place, term, target) those that a left-to-right search, longest first, takes."""
    out, done = [], 0
    for at, term, target in sorted(found, key=lambda x: (x[0], -len(x[1]))):
        if at >= done:
            out.append((term, target))
            done = at + len(term)
    return out
