"""Evaluation reports: nested reports flattened, compared, pivoted; fixed-width text of small frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chrf
from ..functions import text as t


def evaluated(df: DataFrame, *by: str, prediction: str = "prediction_final", reference: str = "reference") -> DataFrame:
    """chrF++ and row count over groups (over all rows without any): counters add up, so one pass and a small shuffle."""
    counted = df.select(*by, chrf.chrf_counters(F.col(prediction), F.col(reference)).alias("chrf"))
    one = counted.groupBy(*by).agg(chrf.summed().alias("c"), F.count("*").alias("n"))
    return one.select(*by, F.round(chrf.score(F.col("c")), 4).alias("chrf2pp"), "n")


def by_category(df: DataFrame, category: str = "category", least: int = 5, **names: str) -> DataFrame:
    """chrF++ of categories of `least` rows and more; a missing category is 'unknown'."""
    return evaluated(df.withColumn("category", F.coalesce(F.col(category), F.lit("unknown"))), "category", **names).where(F.col("n") >= least)


def run_rows(reports: DataFrame) -> DataFrame:
    """One row for each result of each report; report_no (if the reports have one) and result_no say where it stands."""
    numbered = reports if "report_no" in reports.columns else reports.withColumn("report_no", F.lit(0))
    r = numbered.select("run_name", "config", "report_no", F.posexplode("results").alias("result_no", "r"))
    return r.select("report_no", "result_no", F.col("run_name").alias("run"), t.checkpoint_of(F.col("run_name")).alias("checkpoint"), F.col("config.decoding").alias("decoding"), F.col("config.use_glossary_postedit").alias("edited"), F.col("r.direction").alias("direction"), F.col("r.chrf2pp").alias("chrf2pp"), F.col("r.glossary_alignment").alias("glossary_alignment"), F.col("r.translation_rate").alias("translation_rate"), F.col("r.generation_time_sec").alias("generation_time_sec"), F.col("r.n_samples").alias("n_samples"))


def category_rows(reports: DataFrame) -> DataFrame:
    """One row for each category of each result."""
    r = reports.select("run_name", "config", F.explode("results").alias("r")).select("run_name", "config", F.explode("r.chrf2pp_by_category"))
    return r.select(F.col("run_name").alias("run"), t.checkpoint_of(F.col("run_name")).alias("checkpoint"), F.col("config.decoding").alias("decoding"), F.col("key").alias("category"), F.col("value.chrf2pp").alias("chrf2pp"), F.col("value.n").alias("n"))


def ordered_runs(rows: DataFrame, *more: str) -> DataFrame:
    return rows.orderBy("checkpoint", "decoding", *more)


def category_pivot(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean chrF++ by category, a column for each checkpoint and decoding. Named columns save the pass that finds them."""
    named = rows.withColumn("_c", F.concat_ws("_", F.coalesce(F.col("checkpoint").cast("string"), F.lit("none")), "decoding"))
    return named.groupBy("category").pivot("_c", list(columns) if columns else None).agg(F.round(F.avg("chrf2pp"), 4))


def best_runs(rows: DataFrame, metrics: Sequence[str] = ("chrf2pp", "glossary_alignment", "translation_rate")) -> DataFrame:
    """The best run by each metric; of equals the first by checkpoint and decoding. Runs that lack a metric are passed over."""
    at = F.struct(F.coalesce(-F.col("checkpoint"), F.lit(-(2**31))).alias("k"), F.col("run"))
    long = rows.select("run", "checkpoint", "decoding", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")).select("*", "m.*").where("value is not null")
    pick = F.max_by(F.struct("run", "checkpoint", "decoding", "value"), F.struct(F.col("value"), at))
    return long.groupBy("metric").agg(pick.alias("b")).select("metric", "b.*")


def directions(rows: DataFrame) -> DataFrame:
    """(direction, place): the directions in order of appearance, from 1. There are few."""
    from pyspark.sql import Window

    first = rows.groupBy("direction").agg(F.min(F.struct("report_no", "result_no")).alias("at"))
    return first.select("direction", F.row_number().over(Window.orderBy("at", "direction")).alias("place"))


def compared(rows: DataFrame) -> DataFrame:
    """For each direction and report the first result, with the run's label; directions in order of appearance, runs in that of reports."""
    shown = F.struct("chrf2pp", "glossary_alignment", "translation_rate", "decoding", "edited")
    first = rows.groupBy("direction", "report_no", "run").agg(F.min_by(shown, "result_no").alias("r")).join(F.broadcast(directions(rows)), "direction")
    label = t.run_label(F.col("run"), F.col("r.decoding"), F.col("r.edited")).alias("label")
    return first.select("place", "report_no", "direction", label, "run", "r.chrf2pp", "r.glossary_alignment", "r.translation_rate").orderBy("place", "report_no")


def largest_first(rows: DataFrame) -> DataFrame:
    """Categories by rows, most first; of equals by name."""
    return rows.orderBy(F.desc("n"), "category")


def category_text(rows: DataFrame, direction: str, limit: int = 10_000) -> str:
    """A report's lines on the categories of a direction, largest first."""
    lines = [f"[{direction}] chrF++ by category:"]
    return "\n".join([*lines, *(f"  {r.category:<25} chrF++={r.chrf2pp:>8.4f}  n={r.n}" for r in _few(largest_first(rows), limit))])


def _few(df: DataFrame, limit: int) -> list:
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows: this text is for small frames")
    return rows


def series(rows: DataFrame, decoding: str | None = None) -> DataFrame:
    """Frames behind the plots: points by checkpoint for each decoding, shares in percent."""
    own = rows if decoding is None else rows.where(F.col("decoding") == decoding)
    percent = {c: (F.col(c) * 100) for c in ("glossary_alignment", "translation_rate") if c in rows.columns}
    return own.withColumns(percent).orderBy("decoding", "checkpoint")


def mean_score(rows: DataFrame) -> DataFrame:
    """Unweighted mean of the directions' scores."""
    return rows.agg(F.round(F.avg("chrf2pp"), 4).alias("mean_chrf2pp"), F.count_distinct("direction").alias("directions"))


def table_text(df: DataFrame, widths: dict[str, int], digits: int = 4, starred: str | None = None, star: str = "comet", limit: int = 10_000) -> str:
    """A small frame as fixed-width lines: '-' for null, numbers to the right, a star where `starred` is false. More rows than `limit` are an error."""
    lines = ["".join(f"{c:<{w}}" if i == 0 else f"{c:>{w}}" for i, (c, w) in enumerate(widths.items()))]
    lines.append("-" * len(lines[0]))
    for r in _few(df, limit):
        cells = []
        for i, (c, w) in enumerate(widths.items()):
            v = r[c]
            s = "-" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
            s += "*" * (starred is not None and c == star and v is not None and not r[starred])
            cells.append(f"{s:<{w}}" if i == 0 else f"{s:>{w}}")
        lines.append("".join(cells))
    return "\n".join(lines)
