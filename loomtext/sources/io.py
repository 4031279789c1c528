"""Readers and writers of the text formats, with explicit schemas."""

from __future__ import annotations

import csv
import glob
import json
import re
import uuid
from collections.abc import Sequence
from io import StringIO

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAIR = "id string, category string, eng string, hin string, mar string, bhb string"
REJECTED = PAIR + ", _rejection_reasons array<string>"
PREDICTION = "category string, source string, reference string, prediction_raw string, prediction_final string, post_edits array<array<string>>, alignment_hits long, alignment_total long, translation_hits long, translation_total long"
PREDICTION_LITE = "source string, reference string, prediction string"
GLOSSARY = "mar2bhb map<string,string>, bhb2mar map<string,string>, stats map<string,long>"
REPORT = (
    "run_name string, timestamp string, config struct<model_base:string,base_model:string,decoding:string,use_glossary_postedit:boolean,test_path:string,glossary:string>, "
    "results array<struct<direction:string,model:string,n_samples:long,chrf2pp:double,chrf2pp_by_category:map<string,struct<chrf2pp:double,n:long>>,comet:double,comet_reliable:boolean,"
    "glossary_alignment:double,glossary_alignment_hits_total:string,translation_rate:double,translation_hits_total:string,generation_time_sec:double>>"
)
TSV = {"sep": "\t", "header": True, "multiLine": True, "quote": '"', "escape": '"'}
#: For writing: white space at the ends of a cell is part of it.
AS_IS = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _fs(spark: SparkSession, path: str):
    """A path's file system and the path, as Hadoop has them: whatever Spark can read can be listed."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), own


def exists(spark: SparkSession, path: str) -> bool:
    fs, own = _fs(spark, path)
    return fs.exists(own)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """The files that a pattern names, in order; ** stands for any folders, hidden files are left out."""
    fixed = re.split(r"[*?\[]", pattern, maxsplit=1)[0]
    base = pattern if fixed == pattern else fixed.rpartition("/")[0] or ("/" if pattern.startswith("/") else ".")
    fs, own = _fs(spark, base)
    if not fs.exists(own):
        return []
    if base == pattern:
        return [pattern]
    root, fits, out = fs.makeQualified(own).toString().rstrip("/"), re.compile(glob.translate(pattern[len(base) :].lstrip("/"), recursive=True)), []
    deep = fs.listFiles(own, "/" in pattern[len(base) :].lstrip("/"))
    while deep.hasNext():
        tail = deep.next().getPath().toString()[len(root) :].lstrip("/")
        if fits.match(tail):
            out.append(f"{base.rstrip('/')}/{tail}")
    return sorted(out)


def _numbered(spark: SparkSession, df: DataFrame, paths: Sequence[str]) -> DataFrame:
    """Rows that have their `_file`, with its place among the paths as `file_no` and the path as `example_file`; a path given twice puts its rows in twice."""
    one_slash = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    qualified = [(lambda fs, p: fs.makeQualified(p).toUri().toString())(*_fs(spark, path)) for path in paths]
    files = spark.createDataFrame([(q, n, p) for n, (q, p) in enumerate(zip(qualified, paths, strict=True))], "_name string, file_no int, example_file string")
    return df.withColumn("_file", one_slash(F.col("_file"))).join(F.broadcast(files.withColumn("_name", one_slash(F.col("_name")))), F.col("_file") == F.col("_name")).drop("_file", "_name")


def read_jsonl(spark: SparkSession, paths: str | Sequence[str], schema: str = PAIR) -> DataFrame:
    """Lines of JSON, blank ones skipped, a malformed one an error; `file_no` counts the paths as given, repeats included.

    All files are one scan. A single path may be a folder or a pattern; several are files.
    """
    if not paths:
        raise ValueError("no input")
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    if isinstance(paths, str) or len(paths) == 1:
        return reader.json(paths if isinstance(paths, str) else paths[0]).withColumn("file_no", F.lit(0))
    rows = reader.json(list(dict.fromkeys(paths))).withColumn("_file", F.col("_metadata.file_path"))
    return _numbered(spark, rows, paths).drop("example_file")


def read_numbered_jsonl(spark: SparkSession, patterns: Sequence[str], schema: str = PREDICTION) -> DataFrame:
    """Lines of JSON of all files that match, with `example_file`, `file_no` and `example_idx`: the line's number, from 0, blank lines counted.

    All files are one scan of lines, large ones in blocks: a line's number is its place in its block and the lines of the
    blocks before it, which are counted first.
    """
    files = [f for p in patterns for f in matching(spark, p)]
    if not files:
        raise FileNotFoundError(f"no file matches {list(patterns)}")
    lines = spark.read.text(list(dict.fromkeys(files))).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    placed = lines.join(blocks, ["_file", "_block"]).withColumn("example_idx", F.col("_id") - F.col("_first") + F.col("_before")).where(F.trim("value") != "")
    rows = placed.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"), "_file", "example_idx")
    return _numbered(spark, rows, files).select("r.*", "example_file", "file_no", "example_idx")


def read_tsv(spark: SparkSession, path: str, required: Sequence[str] = ()) -> DataFrame:
    """Tab-separated with a header and quotes; nothing is inferred. Missing columns are an error."""
    df = spark.read.options(**TSV).csv(path)
    if gone := sorted(set(required) - set(df.columns)):
        raise ValueError(f"missing columns: {gone}")
    return df


def read_csv(spark: SparkSession, path: str, required: Sequence[str] = ()) -> DataFrame:
    df = spark.read.options(**TSV | {"sep": ","}).csv(path)
    if gone := sorted(set(required) - set(df.columns)):
        raise ValueError(f"missing columns: {gone}")
    return df


def convert_raw(raw: DataFrame, category: str = "") -> DataFrame:
    """Raw exports as pairs: wholly blank rows go, texts are trimmed, the category is given, English and Hindi are empty."""
    from ..functions import text as t

    some = F.exists(F.array(*[t.strip(t.text(F.col(c))) for c in raw.columns]), lambda x: x != "")
    clean = lambda c: t.strip(t.text(F.col(c)))
    return raw.where(some).select(clean("id").alias("id"), F.lit(category).alias("category"), F.lit("").alias("eng"), F.lit("").alias("hin"), clean("marathi").alias("mar"), clean("validated_translation").alias("bhb"))


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """(direction, src, tgt) of a glossary file."""
    g = spark.read.schema(GLOSSARY).option("multiLine", True).json(path)
    one = lambda c: g.select(F.lit(c).alias("direction"), F.explode(c).alias("src", "tgt"))
    return one("mar2bhb").unionByName(one("bhb2mar"))


def read_reports(spark: SparkSession, run_dirs: Sequence[str], name: str = "report.json") -> tuple[DataFrame, list[str]]:
    """The reports of those runs that have one, with `report_no` in the order given, and the runs that lack it."""
    paths = [f"{d.rstrip('/')}/{name}" for d in run_dirs]
    there = [p for p in paths if exists(spark, p)]
    gone = [d for d, p in zip(run_dirs, paths, strict=True) if p not in there]
    if not there:
        return spark.createDataFrame([], f"{REPORT}, report_no int"), gone
    rows = spark.read.schema(REPORT).option("multiLine", True).json(list(dict.fromkeys(there))).withColumn("_file", F.col("_metadata.file_path"))
    return _numbered(spark, rows, there).withColumnRenamed("file_no", "report_no").drop("example_file"), gone


def write_jsonl(df: DataFrame, path: str, single: bool = False) -> None:
    """Lines of JSON with nulls written out; `single` is for small results."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").options(**TSV | AS_IS | {"sep": ","}).csv(path)


def csv_text(df: DataFrame, bom: bool = False, limit: int = 1_000_000) -> str:
    """A small frame as CSV text; with a byte-order mark for spreadsheets. More than `limit` rows are an error."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows: use write_csv")
    out = StringIO()
    writer = csv.writer(out)
    writer.writerow(df.columns)
    writer.writerows(rows)
    return "\ufeff" * bom + out.getvalue()


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One small file, wherever Spark can write."""
    fs, own = _fs(spark, path)
    out = fs.create(own, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_csv_file(df: DataFrame, path: str, bom: bool = False) -> None:
    write_text(df.sparkSession, csv_text(df, bom), path)


def write_json_document(spark: SparkSession, content: dict, path: str) -> None:
    write_text(spark, json.dumps(content, ensure_ascii=False, indent=2), path)


def glossary_document(terms: DataFrame, counters: DataFrame, limit: int = 5_000_000) -> dict:
    """The glossary as one JSON object, for a file; checked against `limit` terms."""
    rows = terms.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} terms")
    side = lambda d: {r.src: r.tgt for r in rows if r.direction == d}
    return {"mar2bhb": side("forward"), "bhb2mar": side("backward"), "stats": counters.first().asDict()}


def split_paths(path: str) -> tuple[str, str]:
    """Where the parts of a split go: <base>_train.jsonl and <base>_test.jsonl."""
    base = path.rsplit(".", 1)[0]
    return f"{base}_train.jsonl", f"{base}_test.jsonl"


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share; under /tmp where the master is local and none is set."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
    return f"{(shared or 'file:///tmp/checkpoints').rstrip('/')}/{uuid.uuid4().hex}"
