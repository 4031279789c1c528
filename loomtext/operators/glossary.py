"""Glossary build with counted rules, and term search, rewriting and metrics over rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.batches import ints, lists, longs, strings, structs, worked
from ..functions.terms import LETTERS, Matcher, greedy, spans

#: Terms that are sent to every task; a larger glossary is joined instead.
MAX_SENT = 500_000


def judged(raw: DataFrame, source: str = "marathi", target: str = "devhali_bhili", foreign: str = t.LATIN, shortest: int = 2) -> DataFrame:
    """src, tgt (first variants) and `verdict`: why a row goes, the first rule that applies, or null."""
    a, b = (t.strip(t.text(F.col(c))) for c in (source, target))
    one = raw.withColumns({"_a": a, "_b": b}).withColumns({"src": t.first_variant(F.col("_a")), "tgt": t.first_variant(F.col("_b"))})
    verdict = (
        F.when((F.col("_a") == "") | (F.col("_b") == ""), "drop_empty")
        .when((F.col("src") == "") | (F.col("tgt") == ""), "drop_empty_after_normalize")
        .when(F.col("tgt").rlike(foreign), "drop_latin_bhili")
        .when((F.length("src") < shortest) | (F.length("tgt") < shortest), "drop_too_short")
    )
    return one.withColumn("verdict", verdict).drop("_a", "_b")


def built(rows: DataFrame, order: str = "ord") -> DataFrame:
    """(direction, src, tgt): for each term of either side the shortest partner, the first one of equals."""
    ok = rows.where("verdict is null")
    both = ok.select(F.explode(F.array(F.struct(F.lit("forward").alias("direction"), F.col("src"), F.col("tgt"), F.col(order).alias("ord")), F.struct(F.lit("backward").alias("direction"), F.col("tgt").alias("src"), F.col("src").alias("tgt"), F.col(order).alias("ord")))).alias("x")).select("x.*")
    return both.groupBy("direction", "src").agg(F.min_by("tgt", F.struct(F.length("tgt"), "ord")).alias("tgt"))


def glossary_counters(rows: DataFrame) -> DataFrame:
    """One row of counts: what was read, dropped by rule, kept, met again on either side, and alike on both."""
    ok = F.col("verdict").isNull()
    drops = [F.count_if(F.col("verdict") == v).alias(v) for v in ("drop_empty", "drop_empty_after_normalize", "drop_latin_bhili", "drop_too_short")]
    forward, backward = (F.count_distinct(F.when(ok, F.col(c))) for c in ("src", "tgt"))
    alike = F.count_if(ok & (t.folded(F.col("src")) == t.folded(F.col("tgt"))))
    return rows.agg(F.count("*").alias("total"), *drops, forward.alias("kept"), (F.count_if(ok) - forward).alias("collision_mar"), (F.count_if(ok) - backward).alias("collision_bhb"), alike.alias("kept_mar_equals_bhb"))


def contradictory(terms: DataFrame) -> DataFrame:
    """(src, tgt) pairs that stand in the glossary both ways round with different forms."""
    own = terms.select("src", "tgt").distinct()
    return own.join(own.select(F.col("tgt").alias("src"), F.col("src").alias("tgt")), ["src", "tgt"], "left_semi").where("src <> tgt")


def _matcher(terms: DataFrame, boundary: str, letters: str):
    got = terms.select("src", "tgt").toPandas()
    return terms.sparkSession.sparkContext.broadcast(Matcher(dict(zip(got["src"], got["tgt"], strict=True)), boundary, letters))


def _fits(terms: DataFrame) -> bool:
    return terms.limit(MAX_SENT + 1).count() <= MAX_SENT


def with_terms(df: DataFrame, terms: DataFrame, text: str = "source", letters: str = LETTERS, sent: bool | None = None) -> DataFrame:
    """Adds `terms`: the dictionary terms in a text, in order, as [source, target] pairs.

    A glossary of checked size is sent to the tasks. Beyond that, each stretch of a text that a term could fill is joined
    to it; a text is searched once, however many rows have it, and they meet its terms by its digest.
    """
    if _fits(terms) if sent is None else sent:
        held = _matcher(terms, "suffix", letters)

        @F.arrow_udf("array<array<string>>")
        def find(texts: pa.Array) -> pa.Array:
            return worked(lambda own: [[list(p) for p in held.value.find(x)] for x in own], lists(lists(strings)), texts)

        return df.withColumn("terms", find(F.col(text)))
    longest = int(terms.agg(F.max(F.length("src"))).first()[0] or 0)

    @F.arrow_udf("array<struct<at: int, src: string>>")
    def parts(texts: pa.Array) -> pa.Array:
        return worked(lambda own: [spans(x, longest, letters) for x in own], lists(structs(at=ints, src=strings)), texts)

    @F.arrow_udf("array<array<string>>")
    def taken(found: pa.Array) -> pa.Array:
        return worked(lambda own: [[list(p) for p in greedy([(x["at"], x["src"], x["tgt"]) for x in row])] for row in own], lists(lists(strings)), found)

    own = df.withColumn("_digest", F.sha2(t.text(F.col(text)), 256))
    texts = own.groupBy("_digest").agg(F.max(text).alias("_text"))
    hits = texts.select("_digest", F.explode(parts("_text")).alias("x")).select("_digest", "x.*").join(terms.select("src", "tgt"), "src")
    rows = hits.groupBy("_digest").agg(F.collect_list(F.struct("at", "src", "tgt")).alias("found")).select("_digest", taken("found").alias("_terms"))
    return own.join(rows, "_digest", "left").withColumn("terms", F.coalesce("_terms", F.array().cast("array<array<string>>"))).drop("_terms", "_digest")


def _with_work(df: DataFrame, terms: DataFrame, boundary: str, source: str, prediction: str, letters: str, sent: bool | None):
    """The frame, the two columns from which work is done, and a function that gives the matcher and a row's terms from the first.

    A glossary that is sent is searched where its terms are used, so one Python worker a task does both.
    """
    if _fits(terms) if sent is None else sent:
        held = _matcher(terms, boundary, letters)
        return df, (F.col(source), F.col(prediction)), lambda x: (held.value, held.value.find(x))
    own = with_terms(df, terms, source, letters, False)
    work = Matcher({}, boundary, letters)
    return own, (F.col("terms"), F.col(prediction)), lambda x: (work, [tuple(p) for p in x])


def post_edited(df: DataFrame, terms: DataFrame, boundary: str = "suffix", source: str = "source", prediction: str = "prediction", letters: str = LETTERS, sent: bool | None = None) -> DataFrame:
    """Adds prediction_final and post_edits.

    Marked as not deterministic, so that Spark doesn't edit each row a second time, in further workers, to filter by the edits.
    """
    own, columns, found = _with_work(df, terms, boundary, source, prediction, letters, sent)

    @F.arrow_udf("struct<text: string, edits: array<array<string>>>")
    def edit(sources: pa.Array, predictions: pa.Array) -> pa.Array:
        def one(xs: list, ps: list) -> list:
            return [m.rewrite(None, p, f) for (m, f), p in zip(map(found, xs), ps, strict=True)]

        return worked(one, structs(text=strings, edits=lists(lists(strings))), sources, predictions)

    return own.withColumn("_e", edit.asNondeterministic()(*columns)).withColumns({"prediction_final": F.col("_e.text"), "post_edits": F.col("_e.edits")}).drop("_e", "terms")


METRICS = ("alignment_hits", "alignment_total", "translation_hits", "translation_total")


def with_metrics(df: DataFrame, terms: DataFrame, source: str = "source", prediction: str = "prediction_final", letters: str = LETTERS, sent: bool | None = None) -> DataFrame:
    """Adds the four glossary counts of each row."""
    own, columns, found = _with_work(df, terms, "lenient", source, prediction, letters, sent)

    @F.arrow_udf("array<long>")
    def measure(sources: pa.Array, predictions: pa.Array) -> pa.Array:
        def one(xs: list, ps: list) -> list:
            return [list(m.metrics(None, p, f)) for (m, f), p in zip(map(found, xs), ps, strict=True)]

        return worked(one, lists(longs), sources, predictions)

    return own.withColumn("_m", measure.asNondeterministic()(*columns)).withColumns({n: F.get("_m", i) for i, n in enumerate(METRICS)}).drop("_m", "terms")


def rates(df: DataFrame, *by: str) -> DataFrame:
    """Ratios of sums, null where nothing was there to hit, and the sums as 'hits/total'."""
    s = {n: F.coalesce(F.sum(n), F.lit(0)) for n in METRICS}
    one = df.groupBy(*by).agg(*[x.alias(n) for n, x in s.items()])
    for name, a, b in (("glossary_alignment", *METRICS[:2]), ("translation_rate", *METRICS[2:])):
        one = one.withColumns({name: F.round(F.try_divide(F.col(a), F.col(b)), 4), f"{name}_hits_total": F.format_string("%d/%d", a, b)})
    return one
