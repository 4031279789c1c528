"""Personal data: exact patterns, and a semi-Markov conditional random field that adds what they miss.

Method. The patterns give the base spans. Stretches of the text that could hold more (digits with phone and card marks,
mail addresses with the marks spelt out) are cut into tokens, and a semi-Markov CRF segments each: every run of up to 16
tokens is a candidate for each type whose form it can have, scored as a whole by its digit count, grouping,
marks, neighbours and length; single tokens may be other text. A dynamic programme over the candidates chooses
boundaries and types jointly. Outside these stretches no candidate of any type exists, so leaving them out changes no
result. Weights are fitted by gradient ascent on the exact likelihood of generated, labelled stretches. Spans of the
model that overlap a base span are dropped: base spans stay as they are.

Defined cases: null text is empty and has no spans. Repeated rows and null ids are treated like others; an empty table
gives an empty one. Of segmentations that score alike the one with other text, then with the type named first, is taken.
Work on a text grows in proportion to its length, whatever it holds. Other columns are not read, whatever their names;
`mask_pii` hands them on.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: The look-behind only skips starts inside a run of digits, where the run's own start has failed for the same reason.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
LONGEST = 16


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the patterns find, by start and then kind."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, 0, found.end()))
        done = found.end() if found else at + 1
        at = text.find("@", done)
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


#: Stretches that can hold a candidate: at least seven digits with marks between them, or a mail address's parts. None is cut.
NUMBERS = re.compile(r"[+(]?[0-9](?:[-+(). /]{0,3}[0-9]){6,}+")
SPELT = re.compile(r"[A-Za-z0-9_.+-]{1,64}+ ?(?:[\[(] ?at ?[\])]|@| at ) ?[A-Za-z0-9-]{1,63}+(?: ?(?:[\[(] ?dot ?[\])]|\.| dot ) ?[A-Za-z0-9-]{1,63}+)+", re.I)
#: In every match of SPELT, so that texts without it need no search.
SPELT_MARK = re.compile(r"[\[(] ?at ?[\])]|@| at ", re.I)
TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^\sA-Za-z0-9]")


class Stretch:
    """Tokens of a part of a text, the words next to it, and its candidate segments with their features."""

    def __init__(self, text: str, start: int, end: int) -> None:
        self.starts, self.ends = array("q"), array("q")
        for m in TOKEN.finditer(text, start, end):
            self.starts.append(m.start())
            self.ends.append(m.end())
        before = re.findall(r"[A-Za-z]+", text[max(0, start - 24) : start])
        self.word = before[-1].lower() if before else ""
        self.glued = (start > 0 and text[start - 1].isalnum(), end < len(text) and text[end].isalnum())
        self.text = text

    @cached_property
    def spans(self) -> list[tuple[int, int]]:
        return list(zip(self.starts, self.ends, strict=True))

    @cached_property
    def tokens(self) -> list[str]:
        return [self.text[a:b] for a, b in self.spans]

    @cached_property
    def segments(self) -> list[tuple[int, int, int, tuple]]:
        """(first token, end token, type or -1 for other text, features)"""
        own = [self.begun(i) for i in range(len(self.starts))]
        return [s[0] for s in own] + [x for s in own for x in s[1:]]

    @cached_property
    def ending(self) -> dict[int, list[int]]:
        out = defaultdict(list)
        for k, s in enumerate(self.segments):
            out[s[1]].append(k)
        return out

    def begun(self, i: int) -> list[tuple[int, int, int, tuple]]:
        """The segments that begin at token i, other text first."""
        own = [self.text[a:b] for a, b in zip(self.starts[i : i + LONGEST], self.ends[i : i + LONGEST], strict=True)]
        out = [(i, i + 1, -1, ("other", "other:digit" if own[0].isdigit() else "other:mark"))]
        digits, groups, letters, marks, spelt = "", [], False, set(), False
        for j, t in enumerate(own):
            if t.isdigit():
                digits += t
                groups.append(len(t))
            elif t.isalpha():
                letters = True
                spelt |= t.lower() == "at"
            else:
                marks.add(t)
                spelt |= t == "@"
            if not t.isalnum():
                continue
            seen = own[: j + 1]
            if letters:
                if spelt and own[0].isalnum() and j:
                    out.append(self._segment(i, seen, 0, digits, groups, marks))
                continue
            if marks <= {"."} and len(groups) == 4 and own[0].isdigit():
                out.append(self._segment(i, seen, 1, digits, groups, marks))
            if marks <= {"-", ".", "/"} and 12 <= len(digits) <= 19 and own[0].isdigit() and luhn(digits):
                out.append(self._segment(i, seen, 2, digits, groups, marks))
            if own[0] in "+(" or own[0].isdigit():
                if 7 <= len(digits) <= 15:
                    out.append(self._segment(i, seen, 3, digits, groups, marks))
        return out

    def _segment(self, i: int, tokens: list[str], kind: int, digits: str, groups: list[int], marks: set[str]) -> tuple[int, int, int, tuple]:
        k, end = KINDS[kind], i + len(tokens)
        last = end == len(self.starts)
        f = [k, f"{k}:n{len(digits)}", f"{k}:g{'-'.join(map(str, groups[:6]))}", f"{k}:word:{self.word}", f"{k}:whole{i == 0}{last}", f"{k}:glued{(i == 0 and self.glued[0]) or (last and self.glued[1])}"]
        f += [f"{k}:mark{m}" for m in sorted(marks)]
        if kind == 0:
            own = [t.lower() for t in tokens]
            f += [f"{k}:parts{min(4, sum(t in ('dot', '.') for t in own[own.index('at') if 'at' in own else 0 :]))}", f"{k}:last{len(own[-1]) in (2, 3)}{own[-1].isalpha()}", f"{k}:bracket{bool(marks & set('[('))}"]
        elif kind == 1:
            f.append(f"{k}:octets{all(int(x) <= 255 for x in tokens if x.isdigit() and len(x) < 5)}")
        elif kind == 2:
            f.append(f"{k}:fours{all(g == 4 for g in groups[:-1])}")
        else:
            f += [f"{k}:first{tokens[0] if tokens[0] in '+(' else 'digit'}", f"{k}:groups{min(len(groups), 5)}", f"{k}:end{groups[-1]}"]
        return i, end, kind, tuple(f)

    def scores(self, w: dict[str, float]) -> list[float]:
        return [sum(w.get(f, 0.0) for f in s[3]) for s in self.segments]

    def best(self, w: dict[str, float]) -> list[tuple[int, int, int]]:
        """The best segmentation's entities, as (start, kind, end) in the text; segments are made as they are met, so none is kept."""
        n = len(self.starts)
        top, size, kinds = array("d", [0.0]) + array("d", [-math.inf]) * n, bytearray(n + 1), bytearray(n + 1)
        for i in range(n):
            for _, end, kind, features in self.begun(i):
                s = top[i] + sum(w.get(f, 0.0) for f in features)
                if s > top[end] or (kind < 0 and s == top[end]):
                    top[end], size[end], kinds[end] = s, end - i, kind + 1
        out, j = [], n
        while j:
            i = j - size[j]
            if kinds[j]:
                out.append((self.starts[i], kinds[j] - 1, self.ends[j - 1]))
            j = i
        return out[::-1]

    def gradient(self, w: dict[str, float], gold: set[tuple[int, int, int]], into: dict[str, float]) -> float:
        """Adds the gradient of the gold segmentation's log likelihood; returns that likelihood."""
        score, n = self.scores(w), len(self.tokens)
        ahead, behind = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
        add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b))) if min(a, b) > -math.inf else max(a, b)
        for j in range(1, n + 1):
            for k in self.ending[j]:
                ahead[j] = add(ahead[j], ahead[self.segments[k][0]] + score[k])
        for j in range(n, 0, -1):
            for k in self.ending[j]:
                i = self.segments[k][0]
                behind[i] = add(behind[i], behind[j] + score[k])
        inside = {t for a, b, _ in gold for t in range(a, b)}
        like = -ahead[n]
        for k, (i, end, kind, features) in enumerate(self.segments):
            p = math.exp(ahead[i] + score[k] + behind[end] - ahead[n])
            hit = (i, end, kind) in gold if kind >= 0 else i not in inside
            like += score[k] if hit else 0.0
            for f in features:
                into[f] += hit - p
        return like


def stretches(text: str) -> Iterator[Stretch]:
    if DIGIT.search(text):
        for m in NUMBERS.finditer(text):
            yield Stretch(text, m.start(), m.end())
    if SPELT_MARK.search(text):
        for m in SPELT.finditer(text):
            yield Stretch(text, m.start(), m.end())


def generated(seed: int = 17, n: int = 900) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Labelled lines: personal data in the forms that people write, and numbers that are none."""
    r, d = random.Random(seed), lambda k: "".join(r.choice("0123456789") for _ in range(k))
    rng = r
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8)))

    def card() -> str:
        body = r.choice("3456") + d(14)
        return body + next(c for c in "0123456789" if luhn(body + c))

    def fails() -> str:
        x = d(16)
        return x if not luhn(x) else x[:-1] + str((int(x[-1]) + 1) % 10)

    makers = [
        (3, lambda: f"+{r.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}"), (3, lambda: f"({d(3)}) {d(3)}-{d(4)}"), (3, lambda: f"{d(3)}-{d(3)}-{d(4)}"), (3, lambda: f"{d(3)}.{d(3)}.{d(4)}"), (3, lambda: f"1-{d(3)}-{d(3)}-{d(4)}"),
        (2, card), (2, lambda: (lambda c: f"{c[:4]} {c[4:8]} {c[8:12]} {c[12:]}")(card())), (2, lambda: (lambda c: f"{c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]}")(card())), (2, lambda: (lambda c: f"{c[:4]}/{c[4:8]}/{c[8:12]}/{c[12:]}")(card())),
        (1, lambda: ".".join(str(r.randint(0, 255)) for _ in range(4))),
        (0, lambda: f"{word()} [at] {word()} [dot] {r.choice(['com', 'org', 'net', 'de'])}"), (0, lambda: f"{word()}(at){word()}(dot){r.choice(['com', 'org', 'fr', 'es'])}"), (0, lambda: f"{word()}.{word()} at {word()} dot {r.choice(['com', 'org', 'net'])}"), (0, lambda: f"{word()} @ {word()}.{r.choice(['com', 'org'])}"),
        (-1, fails), (-1, lambda: (lambda c: f"{c[:4]} {c[4:8]} {c[8:12]} {c[12:]}")(fails())), (-1, lambda: d(r.randint(7, 15))), (-1, lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}"), (-1, lambda: f"{r.randint(1900, 2030)}/{r.randint(1, 12):02}/{r.randint(1, 28):02} {d(2)}"),
        (-1, lambda: f"{d(4)}.{d(4)}"), (-1, lambda: " ".join(d(r.randint(1, 3)) for _ in range(8))), (-1, lambda: f"{r.randint(256, 999)}.{d(3)}.{d(3)}.{d(3)}"), (-1, lambda: f"{d(5)}-{d(4)}"), (-1, lambda: f"{d(1)}.{d(2)}.{d(6)}"), (-1, lambda: " ".join(d(4) for _ in range(4))),
        (-1, lambda: f"{word()} at {word()}. {word()}"), (-1, lambda: f"{word()} at {word()} dot {word()} {word()}"),
    ]
    out = []
    for _ in range(n):
        kind, make = r.choice(makers)
        x = make()
        left, right = " ".join(word() for _ in range(3)) + " ", r.choice([" ", ". ", ", "]) + word() + "."
        out.append((left + x + right, [(len(left), kind, len(left) + len(x))] if kind >= 0 else []))
    return out


def train(examples: list[tuple[str, list[tuple[int, int, int]]]], rounds: int = 25, rate: float = 0.15, l2: float = 0.002) -> dict[str, float]:
    """Weights by AdaGrad on the exact likelihood, in a fixed order."""
    data = []
    for text, spans in examples:
        for s in stretches(text):
            gold = {(i, e, k) for i, e, k, _ in s.segments if k >= 0 and (s.spans[i][0], k, s.spans[e - 1][1]) in spans}
            data.append((s, gold))
    w, seen = defaultdict(float), defaultdict(lambda: 1e-6)
    for _ in range(rounds):
        for k in range(0, len(data), 20):
            g: dict[str, float] = defaultdict(float)
            for s, gold in data[k : k + 20]:
                s.gradient(w, gold, g)
            for f, x in g.items():
                x -= l2 * 20 * w[f]
                seen[f] += x * x
                w[f] += rate * x / math.sqrt(seen[f])
    return dict(w)


def all_spans(text: str, w: dict[str, float], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans and those of the model that overlap none of them nor each other, by start and then kind."""
    more = sorted({x for s in stretches(text) for x in s.best(w)})
    if not more:
        return base
    out, at, reach, done = list(base), 0, 0, 0
    for start, kind, end in more:
        while at < len(base) and base[at][0] < end:
            reach = max(reach, base[at][2])
            at += 1
        if start >= reach and start >= done:
            out.append((start, kind, end))
            done = end
    return sorted(out)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _find(weights):
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base = base_spans(text or "")
                n = np.bincount([k for _, k, _ in base], minlength=4).tolist() if base else [0] * 4
                rows.append((doc, *n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(all_spans(text or "", weights.value, base))))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names=names)

    return run


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, the base spans' counts and digest, and all spans."""
    own = documents(docs, id_col, text_col)
    weights = own.sparkSession.sparkContext.broadcast(train(generated()))
    return own.mapInArrow(_find(weights), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str | None, weights: dict[str, float]) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans are replaced as one, by the first's kind."""
    if not text:
        return text
    out, at = [], 0
    for start, kind, end in all_spans(text, weights, base_spans(text)):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with all personal data in the text column masked, and its other columns as they were."""
    weights = docs.sparkSession.sparkContext.broadcast(train(generated()))
    place = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(place)
            new = pa.array([masked(t, weights.value) for t in own.to_pylist()], own.type)
            yield pa.RecordBatch.from_arrays([new if i == place else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
