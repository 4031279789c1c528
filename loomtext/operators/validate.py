"""Pair validation: every rule is one column expression, every row carries the reasons why it fails."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


#: What a decoder puts for bytes that it can't read.
REPLACEMENT = chr(0xFFFD)


@dataclass(frozen=True)
class Rules:
    """Columns, names and limits of the checks."""

    source: str = "mar"
    target: str = "bhb"
    pivot: str = "eng"
    source_name: str = "marathi"
    target_name: str = "bhili"
    pivot_name: str = "english"
    script: str = t.DEVANAGARI
    script_name: str = "devanagari"
    min_chars: int = 20
    min_words: int = 4
    min_pivot_chars: int = 5
    max_len_ratio: float = 3.5
    max_digit_ratio: float = 0.5
    copy_similarity: float = 0.90
    copy_min_chars: int = 10
    script_share: float = 0.3
    repeat_words: int = 5
    repeat_share: float = 0.4
    require_pivot: bool = True
    check_script: bool = True


def validated(df: DataFrame, rules: Rules = Rules(), details: bool = False) -> DataFrame:
    """Adds `reasons`, in the order of the checks; with `details` in the long form that names the figure.

    What several checks read (trimmed texts, folds, word counts) is worked out once per row, in columns of its own.
    """
    names = {"s": rules.source, "g": rules.target, "p": rules.pivot}
    own = df.withColumns({f"_{k}": t.strip(t.text(F.col(c))) for k, c in names.items()})
    s, g, p = F.col("_s"), F.col("_g"), F.col("_p")
    own = own.withColumns({"_ws": t.words(s), "_wg": t.words(g), "_fs": t.folded(s), "_fg": t.folded(g)})
    own = own.withColumns({"_near": t.similarity("_fs", "_fg"), "_ts": t.top_share("_s"), "_tg": t.top_share("_g")})
    sides = ((rules.source_name, s, F.col("_ws")), (rules.target_name, g, F.col("_wg")))
    ws, wg = F.size("_ws"), F.size("_wg")
    ratio, near = F.greatest(F.try_divide(ws, wg), F.try_divide(wg, ws)), F.col("_near")

    def flag(code: str, test: Column, detail: Column | None = None) -> Column:
        return F.when(test, F.concat(F.lit(code), detail) if details and detail is not None else F.lit(code))

    empty = [flag(f"empty_{n}", x == "") for n, x, _ in sides]
    if rules.require_pivot:
        empty.append(flag(f"empty_{rules.pivot_name}", p == ""))
    full = [flag(f"{n}_too_short", F.length(x) < rules.min_chars, F.format_string(" (%d chars)", F.length(x))) for n, x, _ in sides]
    full.append(flag(f"{rules.pivot_name}_too_short", (p != "") & (F.length(p) < rules.min_pivot_chars), F.format_string(" (%d chars)", F.length(p))))
    full += [flag(f"{n}_few_words", F.size(w) < rules.min_words, F.format_string(" (%d)", F.size(w))) for n, _, w in sides]
    full.append(flag("length_ratio", ratio > rules.max_len_ratio, F.format_string(" (%.1fx)", ratio)))
    full.append(flag("untranslated_copy", F.col("_fs") == F.col("_fg")))
    full.append(flag("near_duplicate", (near > rules.copy_similarity) & (F.length("_fs") > rules.copy_min_chars), F.format_string(" (%.0f%% similar)", near * 100)))
    if rules.check_script:
        full += [flag(f"{n}_not_{rules.script_name}", ~t.dominated(x, rules.script, rules.script_share)) for n, x, _ in sides]
        full.append(flag(f"{rules.pivot_name}_has_{rules.script_name}", (p != "") & t.dominated(p, rules.script, rules.script_share)))
    for n, x, _ in sides:
        d, a = t.count_digits(x), t.count_letters(x)
        full.append(flag(f"{n}_excessive_digits", (a > 0) & (F.try_divide(d, d + a) > rules.max_digit_ratio)))
    for n, x in (*((n, x) for n, x, _ in sides), (rules.pivot_name, p)):
        full.append(flag(f"{n}_corrupted_unicode", F.contains(x, F.lit(REPLACEMENT))))
        full.append(flag(f"{n}_control_chars", t.has_control(x)))
    for (n, _, w), top in zip(sides, ("_ts", "_tg"), strict=True):
        full.append(flag(f"{n}_repetitive", (F.size(w) > rules.repeat_words) & (F.col(top) > rules.repeat_share)))
    reasons = F.array_compact(F.when((s == "") | (g == ""), F.array(*empty)).otherwise(F.array(*empty, *full)))
    return own.select(*df.columns, reasons.alias("reasons"))


def normalized_pairs(df: DataFrame, rules: Rules = Rules(), compose: bool = True) -> DataFrame:
    return df.withColumns({c: t.normalized(F.col(c), compose) for c in (rules.pivot, rules.source, rules.target)})


def not_copied(df: DataFrame, source: str, target: str, threshold: float = 0.85) -> DataFrame:
    """Pairs with both sides that are not alike at `threshold` and more."""
    s, g = (t.strip(t.text(F.col(c))) for c in (source, target))
    return df.where((s != "") & (g != "") & ~F.coalesce(t.similarity(t.folded(s), t.folded(g)) >= threshold, F.lit(False)))


def with_both(df: DataFrame, source: str, target: str) -> DataFrame:
    return df.where((t.strip(t.text(F.col(source))) != "") & (t.strip(t.text(F.col(target))) != ""))


def pending(df: DataFrame, source: str, target: str) -> DataFrame:
    """Rows that have a source and still lack a target."""
    return df.where((t.strip(t.text(F.col(source))) != "") & (t.strip(t.text(F.col(target))) == ""))
