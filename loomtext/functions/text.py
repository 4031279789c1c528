"""Text functions as column expressions; all but `nfc`, `similarity` and `top_share` stay in the JVM."""

from __future__ import annotations

import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .batches import doubles, stretches, strings, worked

# The white space of Python's str.split, as a class of Java's regular expressions.
WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# Characters that show nothing.
INVISIBLE = "\u200b\u200c\u200d\ufeff\u200e\u200f\u00ad\u2060"
# Full-width marks and curly quotes, and what they become.
FANCY, PLAIN = "\uff0c\uff0e\uff1f\uff01\uff1a\uff1b\u201c\u201d\u2018\u2019", ",.?!:;\"\"''"
DEVANAGARI = r"[\u0900-\u097f]"
LATIN = "[A-Za-z]"


@arrow_udf(T.StringType())
def nfc(texts: pa.Array) -> pa.Array:
    """Unicode normal form C, which Spark has no function for. Stretches that are in it already are handed on as they are."""
    parts, same = [], True
    for (part,) in stretches(texts):
        own = part.to_pylist()
        new = [None if t is None else t if t.isascii() else unicodedata.normalize("NFC", t) for t in own]
        same = same and new == own
        parts.append(part if new == own else strings(new).cast(texts.type))
    return texts if same else pa.concat_arrays(parts)


def text(c: Column) -> Column:
    """Null counts as empty."""
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{WS}+|{WS}+\z", "")


def one_spaced(c: Column) -> Column:
    """White space of any kind becomes single blanks, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def drop_invisible(c: Column) -> Column:
    return F.translate(c, INVISIBLE, "")


def plain_punctuation(c: Column) -> Column:
    """Full-width marks and curly quotes to ASCII; four dots and more to three."""
    return F.regexp_replace(F.translate(c, FANCY, PLAIN), r"\.{4,}", "...")


def drop_outer_quotes(c: Column) -> Column:
    """Double quotes at the very ends go, and white space inside of them; quotes behind outer white space stay."""
    quotes = '["\u201c\u201d]+'
    return F.regexp_replace(F.regexp_replace(c, rf"\A{quotes}{WS}*", ""), rf"{WS}*{quotes}\z", "")


def normalized(c: Column, compose: bool = True) -> Column:
    """The full normalization, in its fixed order; without `compose` it skips NFC and stays in the JVM."""
    t = text(c)
    return one_spaced(drop_outer_quotes(plain_punctuation(drop_invisible(nfc(t) if compose else t))))


def folded(c: Column) -> Column:
    """Lower case without white space: the form in which texts are compared."""
    return F.regexp_replace(F.lower(c), f"{WS}+", "")


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"{WS}+"), lambda w: w != "")


def n_words(c: Column) -> Column:
    return F.size(words(c))


def share(c: Column, letters: str) -> Column:
    """Characters of a class against all but blanks; 0 for none."""
    return F.coalesce(F.try_divide(F.regexp_count(c, F.lit(letters)), F.length(F.replace(c, F.lit(" "), F.lit("")))), F.lit(0.0))


def dominated(c: Column, letters: str = DEVANAGARI, threshold: float = 0.3) -> Column:
    return share(c, letters) >= threshold


@arrow_udf(T.DoubleType())
def similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    """Positional similarity: places with the same character against the longer text; null where both are empty.

    Character by character, higher-order functions take a thousand times as long as numpy does here.
    """
    points = lambda x: np.frombuffer((x or "").encode("utf-32-le"), np.uint32)

    def one(x: str | None, y: str | None) -> float | None:
        p, q = points(x), points(y)
        n = min(len(p), len(q))
        return float((p[:n] == q[:n]).sum()) / max(len(p), len(q)) if len(p) or len(q) else None

    return worked(lambda xs, ys: [one(x, y) for x, y in zip(xs, ys, strict=True)], doubles, a, b)


def count_digits(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\p{Nd}"))


def count_letters(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\p{L}"))


def has_control(c: Column) -> Column:
    return c.rlike(r"[\p{C}&&[^\n\r\t]]")


@arrow_udf(T.DoubleType())
def top_share(texts: pa.Array) -> pa.Array:
    """Share of a text's most frequent word; null without words. One count per text, which no built-in function makes."""
    return worked(lambda xs: [max(Counter(w).values()) / len(w) if (w := (x or "").split()) else None for x in xs], doubles, texts)


def first_variant(c: Column) -> Column:
    """Of 'a / b' the first; of 'ab, cd' the first if there are several parts of two characters and more each."""
    s = strip(F.split_part(strip(c), F.lit("/"), F.lit(1)))
    parts = F.filter(F.transform(F.split(s, ","), strip), lambda p: p != "")
    several = F.contains(s, F.lit(",")) & (F.size(parts) > 1) & F.forall(parts, lambda p: F.length(p) > 1)
    return F.when(several, F.get(parts, 0)).otherwise(s)


def base_code(reason: Column) -> Column:
    """A reason without its detail in parentheses."""
    return F.regexp_replace(reason, rf"{WS}*\(.*\)", "")


def edits_text(edits: Column, arrow: str = " -> ", between: str = "; ") -> Column:
    """[[source, target], ...] as one text; null counts as none."""
    pairs = F.coalesce(edits, F.array().cast("array<array<string>>"))
    return F.array_join(F.transform(pairs, lambda e: F.concat(F.get(e, 0), F.lit(arrow), F.get(e, 1))), between)


def changed(raw: Column, final: Column) -> Column:
    return F.when(raw != final, "yes").otherwise("no")


def checkpoint_of(run: Column) -> Column:
    """The number in 'ckp_<number>', or null."""
    return F.nullif(F.regexp_extract(run, r"ckp_(\d+)", 1), F.lit("")).cast("int")


def run_label(path: Column, decoding: Column, edited: Column, width: int = 39) -> Column:
    """Last part of a run's path with its decoding, cut to a table column."""
    name = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    return F.left(F.concat(name, F.lit(" ["), decoding, F.when(edited, "+pe").otherwise(""), F.lit("]")), F.lit(width))
