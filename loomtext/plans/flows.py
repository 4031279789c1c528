"""Whole flows: cleaning a corpus, and evaluating a direction. Everything up to the sinks is one lazy plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chrf
from ..functions import text as t
from ..functions.terms import Matcher
from ..operators import dedup, glossary, reports, split, stats, translate, validate
from ..operators.validate import Rules
from ..sources import io


@dataclass
class Cleaned:
    """One frame with `reasons`; the sinks and counts read it."""

    rows: DataFrame

    @property
    def accepted(self) -> DataFrame:
        return dedup.accepted(self.rows)

    @property
    def rejected(self) -> DataFrame:
        return dedup.rejected(self.rows)

    def reason_histogram(self) -> DataFrame:
        return stats.reason_histogram(self.rows)

    def summary(self) -> DataFrame:
        return stats.clean_summary(self.rows)


def clean(pairs: DataFrame, order: list[str], rules: Rules = Rules(), compose: bool = True, details: bool = False) -> Cleaned:
    """Normalize, validate, and drop repeats of valid pairs. Persist `rows` if several sinks read it."""
    checked = validate.validated(validate.normalized_pairs(pairs, rules, compose), rules, details)
    return Cleaned(dedup.routed(checked, order, rules.source, rules.target))


def training_set(main: DataFrame, direction: str, keys: list[str], targeted: DataFrame | None = None, times: int = 3, copy_threshold: float = 0.85, eval_split: float = 0.05, seed: int = 42, by_group: str | None = None) -> DataFrame:
    """Copy-filtered pairs with oversampled targeted ones, marked train or test, and their chats.

    The split is by row with its copy, as copies are drawn one by one; `by_group` keeps a group, copies and all, on one side.
    """
    d = translate.DIRECTIONS[direction]
    rows = validate.not_copied(main, d.source, d.target, copy_threshold)
    if targeted is not None:
        rows = split.oversampled(rows, validate.not_copied(targeted, d.source, d.target, 1.0), times)
    else:
        rows = rows.withColumn("copy", F.lit(0))
    rows = split.split_fraction(rows, eval_split, [by_group] if by_group else [*keys, "copy"], seed)
    return rows.withColumn("messages", translate.messages(translate.prompt(direction), F.col(d.source), F.col(d.target)))


def evaluate(pairs: DataFrame, direction: str, terms: DataFrame, factory: Callable[[], translate.Translator] = translate.echo, post_edit: bool = False, boundary: str = "suffix", letters: str = glossary.LETTERS, key: list[str] | None = None, decoding: translate.Decoding = translate.DECODINGS["greedy"]) -> DataFrame:
    """Predictions of one direction with their post-edits and glossary counts, and the key columns; persist it before its sink and its report."""
    d = translate.DIRECTIONS[direction]
    own = validate.with_both(pairs, d.source, d.target)
    own = own.withColumns({"source": F.trim(F.col(d.source)), "reference": F.trim(F.col(d.target)), "category": F.coalesce("category", F.lit("unknown"))})
    own = translate.translated(own, "source", factory, system=translate.prompt(direction), decoding=decoding)
    if post_edit:
        own = glossary.post_edited(own, terms, boundary, "source", "prediction_raw", letters)
    else:
        own = own.withColumns({"prediction_final": F.col("prediction_raw"), "post_edits": F.array().cast("array<array<string>>")})
    own = glossary.with_metrics(own, terms, "source", "prediction_final", letters)
    return own.select(*(key or []), "category", "source", "reference", "prediction_raw", "prediction_final", "post_edits", *glossary.METRICS)


def with_models(spark: SparkSession, paths: dict[str, str]) -> tuple[list[str], list[str]]:
    """Of directions and where their models should be: those that have one, and those to skip."""
    there = {d: io.exists(spark, p) for d, p in paths.items()}
    return [d for d in paths if there[d]], [d for d in paths if not there[d]]


def batch_test(rows: DataFrame, terms: DataFrame, direction: str = "bhb2mar", text: str = "bhili_text", factory: Callable[[], translate.Translator] = translate.echo, decoding: translate.Decoding = translate.Decoding(4, 256), letters: str = glossary.LETTERS) -> DataFrame:
    """Rows of a test sheet with their raw translation, the post-edited one and the edits; other columns are handed on."""
    own = translate.translated(rows, text, factory, system=translate.prompt(direction), decoding=decoding)
    done = glossary.post_edited(own, terms, "suffix", text, "prediction_raw", letters)
    return done.select(*rows.columns, "prediction_raw", "prediction_final", t.edits_text(F.col("post_edits"), "->").alias("glossary_edits"))


# What a translation of one text says where there is nothing to show.
NO_TEXT, NO_EDITS, SCORED = "(enter a sentence)", "(no glossary substitutions fired)", "chrF++ (post-edited vs reference): {score:.2f}"


def translate_one(text: str | None, direction: str, terms: dict[str, str], factory: Callable[[], translate.Translator] = translate.echo, reference: str | None = None, decoding: translate.Decoding = translate.Decoding(4, 256), letters: str = glossary.LETTERS) -> tuple[str, str, str, str]:
    """One text on the driver: raw translation, post-edited one, the edits by line, and its score where there is a reference."""
    text, reference = (text or "").strip(), (reference or "").strip()
    if not text:
        return "", "", NO_TEXT, ""
    raw = factory()([translate.chat(translate.prompt(direction), text)], decoding)[0].strip()
    final, edits = Matcher(terms, "suffix", letters).rewrite(text, raw)
    shown = "\n".join(f"{a}  ->  {b}" for a, b in edits) or NO_EDITS
    return raw, final, shown, SCORED.format(score=chrf.f_score(chrf.counters(final, reference))) if reference else ""


def report(predictions: DataFrame, direction: str, model: str = "", seconds: float | None = None) -> dict:
    """The report's entry for a direction, from three small aggregates."""
    whole, rate = reports.evaluated(predictions).first(), glossary.rates(predictions).first()
    return {
        "direction": direction, "model": model, "n_samples": whole.n if whole else 0, "chrf2pp": whole.chrf2pp if whole else 0.0,
        "chrf2pp_by_category": {r.category: {"chrf2pp": r.chrf2pp, "n": r.n} for r in reports.by_category(predictions).collect()},
        "comet": None, "comet_reliable": translate.DIRECTIONS[direction].comet_reliable,
        "glossary_alignment": rate.glossary_alignment, "glossary_alignment_hits_total": rate.glossary_alignment_hits_total,
        "translation_rate": rate.translation_rate, "translation_hits_total": rate.translation_rate_hits_total, "generation_time_sec": seconds,
    }
