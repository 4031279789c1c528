"""Plain versions of the operators' contracts, and the fixture that they are held against."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, n long, band string, rep long"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def rows(seed=3, n=60):
    """Texts with copies, near copies, shared passages, odd white space, nulls, and a row given twice; clashing extra columns."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(400)]
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    texts = []
    for i in range(n):
        w = [r.choice(vocabulary) for _ in range(r.choice([3, 40, 120, 300]))]
        if i % 4 == 1:
            w = texts[-1].split(" ")
            for _ in range(r.choice([0, 1, 3, 30])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
        t = " ".join(w)
        texts.append(t + ("\n" + passage + "\n" if i % 6 == 5 else ""))
    texts += ["", None, " \t\n", "A b", "a B", "x", "aaaa " * 120, "-" * 500, "one\ntwo\n\none\nONE", " é\xa0b " * 40]
    out = [(i * 7 % (len(texts) + 3) if len(texts) + 3 != 70 else i, t) for i, t in enumerate(texts)]
    ids = random.Random(9).sample(range(1000), len(texts))
    out = [(d, t) for d, (_, t) in zip(ids, out, strict=True)]
    out.append(out[3])
    return [(d, t, f"s{i % 3}" if i % 5 else None, "en", len(t or ""), 1, "b", i) for i, (d, t) in enumerate(out)]


def shingles(text, size=4):
    w = WORD.findall(lower(text))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def near(docs):
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d)) for d in ids}


def repeats(docs):
    seen, out = set(), {}
    for d, t in sorted(set(docs), key=lambda x: x[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


def rules(text):
    t = text or ""
    w, lines = WORD.findall(t), t.split("\n")
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    dup = sum(1 for i, x in enumerate(lines) if WORD.search(x) and x in lines[:i])
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def unigram(docs):
    tokens = {d: [*WORD.findall(lower(t)), None] for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    c = Counter(w for d, t in docs if not held[d] for w in tokens[d])
    total, kinds = sum(c.values()), len(c)
    return {d: (held[d], len(x), sum(c[w] > 0 for w in x), total, sum(math.log10((c[w] + 1) / (total + kinds + 1)) for w in x)) for d, x in tokens.items()}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def personal(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)
