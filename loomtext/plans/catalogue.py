"""The registered queries over the fixture tables, and the same in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chrf
from ..functions import text as t
from ..functions.terms import LETTERS, SUFFIXES
from ..operators import audit, checks, dedup, glossary, reports, split, stats, translate, validate
from ..operators.validate import Rules
from ..sources import io
from . import flows

#: The fixtures are in Latin script; what is Devanagari in production is a parameter.
RULES = Rules(script=t.LATIN, script_name="latin", max_digit_ratio=0.05)
LATIN_LETTERS = "A-Za-zÀ-ÿ"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- the same expressions in SQL
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A{WS}+|{WS}+\z', '', 'g')"


def _norm(x: str, compose: bool = False) -> str:
    invisible = " || ".join(f"chr({ord(c)})" for c in t.INVISIBLE)
    fancy = " || ".join(f"chr({ord(c)})" for c in t.FANCY)
    quotes = r'["\x{201c}\x{201d}]+'
    x = f"translate({'nfc_normalize' if compose else ''}(coalesce({x}, '')), {invisible}, '')"
    x = f"translate({x}, {fancy}, ',.?!:;\"\"''''')"
    x = rf"regexp_replace({x}, '\.{{4,}}', '...', 'g')"
    x = rf"regexp_replace(regexp_replace({x}, '\A{quotes}{WS}*', ''), '{WS}*{quotes}\z', '')"
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def _fold(x: str) -> str:
    return f"regexp_replace(lower({x}), '{WS}+', '', 'g')"


def _words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}+'), lambda w: w <> '')"


def _hits(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def _same(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE len(list_filter(list_zip(string_split({a}, ''), string_split({b}, '')), lambda p: p[1] = p[2])) END)"


def _top(x: str) -> str:
    w = _words(x)
    return f"(list_max(list_transform(list_distinct({w}), lambda d: len(list_filter({w}, lambda y: y = d)))) / nullif(len({w}), 0))"


PAIRS = """pairs AS (
  SELECT u.conv_id, u.turn, CAST(u.conv_id AS VARCHAR) AS id, CAST(u.conv_id % 7 AS VARCHAR) AS category,
         CASE WHEN u.conv_id % 5 = 0 THEN '' ELSE a.text END AS eng, u.text AS mar, a.text AS bhb
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant turns that follow, in the shape of sentence pairs."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("mar"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("bhb"))
    key = F.col("conv_id").cast("string")
    return u.join(a, ["conv_id", "turn"]).select("conv_id", "turn", key.alias("id"), (F.col("conv_id") % 7).cast("string").alias("category"), F.when(F.col("conv_id") % 5 == 0, "").otherwise(F.col("bhb")).alias("eng"), "mar", "bhb")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(name: str):
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _reasons_sql(r: Rules = RULES, pairs: str | None = None, compose: bool = False, details: bool = False) -> str:
    s, g, p, script = "s", "g", "p", "[A-Za-z]" if r.script == t.LATIN else "[ऀ-ॿ]"
    ws, wg = f"len({_words(s)})", f"len({_words(g)})"
    out = []
    add = lambda code, test, detail=None: out.append(f"CASE WHEN {test} THEN '{code}'{f' || {detail}' if details and detail else ''} END")
    for n, x in (("marathi", s), ("bhili", g)):
        add(f"{n}_too_short", f"len({x}) < {r.min_chars}", f"' (' || len({x}) || ' chars)'")
    add("english_too_short", f"{p} <> '' AND len({p}) < {r.min_pivot_chars}", f"' (' || len({p}) || ' chars)'")
    add("marathi_few_words", f"{ws} < {r.min_words}", f"' (' || {ws} || ')'")
    add("bhili_few_words", f"{wg} < {r.min_words}", f"' (' || {wg} || ')'")
    ratio = f"greatest({ws} / nullif({wg}, 0), {wg} / nullif({ws}, 0))"
    add("length_ratio", f"{ratio} > {r.max_len_ratio}", f"' (' || printf('%.1f', round({ratio}, 1)) || 'x)'")
    add("untranslated_copy", f"{_fold(s)} = {_fold(g)}")
    near = f"{_same(_fold(s), _fold(g))} / nullif(greatest(len({_fold(s)}), len({_fold(g)})), 0)"
    add("near_duplicate", f"{near} > {r.copy_similarity} AND len({_fold(s)}) > {r.copy_min_chars}", f"' (' || printf('%.0f', round({near} * 100)) || '% similar)'")
    share = lambda x: f"coalesce({_hits(x, script)} / nullif(len(replace({x}, ' ', '')), 0), 0)"
    for n, x in (("marathi", s), ("bhili", g)):
        add(f"{n}_not_{r.script_name}", f"{share(x)} < {r.script_share}")
    add(f"english_has_{r.script_name}", f"{p} <> '' AND {share(p)} >= {r.script_share}")
    for n, x in (("marathi", s), ("bhili", g)):
        d, a = _hits(x, r"\p{Nd}"), _hits(x, r"\p{L}")
        add(f"{n}_excessive_digits", f"{a} > 0 AND {d} / ({d} + {a}) > {r.max_digit_ratio}")
    for n, x in (("marathi", s), ("bhili", g), ("english", p)):
        add(f"{n}_corrupted_unicode", f"contains({x}, chr(65533))")
        add(f"{n}_control_chars", rf"regexp_matches(translate({x}, chr(9) || chr(10) || chr(13), ''), '\p{{C}}')")
    for n, x, w in (("marathi", s, ws), ("bhili", g, wg)):
        add(f"{n}_repetitive", f"{w} > {r.repeat_words} AND {_top(x)} > {r.repeat_share}")
    empty = [f"CASE WHEN {x} = '' THEN 'empty_{n}' END" for n, x in (("marathi", s), ("bhili", g), ("english", p))]
    full = f"CASE WHEN s = '' OR g = '' THEN [{', '.join(empty)}] ELSE [{', '.join(empty + out)}] END"
    return f"""{pairs or PAIRS},
n AS (SELECT conv_id, turn, {_norm('mar', compose)} AS s, {_norm('bhb', compose)} AS g, {_norm('eng', compose)} AS p FROM pairs),
r AS (SELECT *, list_filter({full}, lambda x: x IS NOT NULL) AS reasons FROM n),
f AS (SELECT *, CASE WHEN len(reasons) = 0 AND row_number() OVER (PARTITION BY len(reasons) = 0, {_fold('s')}, {_fold('g')} ORDER BY conv_id, turn) > 1
      THEN ['duplicate'] ELSE reasons END AS final FROM r)"""


def cleaned(spark: SparkSession, sf_dir: str) -> flows.Cleaned:
    return flows.clean(pairs(spark, sf_dir), ["conv_id", "turn"], RULES, compose=False)


# ---- pairs in Devanagari in which every rule fires: expressions that Spark and DuckDB read alike
_AZ, _DEV, _DEV2 = "abcdefghijklmnopqrstuvwxyz", "कखगघचछजझटठडढणतथदधनपफबभमयरल", "नपफबभमयरलकखगघचछजझटठडढणतथदध"


def _in_devanagari(x: str, letters: str = _DEV) -> str:
    return f"translate(lower({x}), '{_AZ}', '{letters}')"


_M, _B = _in_devanagari("said"), _in_devanagari("said", _DEV2)
#: What is wrong with a row, by its number: column -> text.
FAULTS: list[dict[str, str]] = [
    {"mar": "''"}, {"bhb": "'  '"}, {"eng": "NULL"}, {"mar": "''", "bhb": "NULL", "eng": "''"}, {"mar": f"left({_M}, 10)"}, {"bhb": f"left({_B}, 12)"}, {"eng": "'abc'"},
    {"bhb": _M}, {"bhb": f"{_M} || 'क'"}, {"mar": "lower(said)"}, {"bhb": "lower(said)"}, {"eng": _M}, {"mar": f"repeat('१२३४५ ६७८९० ', 8) || left({_M}, 20)"}, {"bhb": f"repeat('१२३४५ ६७८९० ', 8) || left({_B}, 20)"},
    {"mar": f"{_M} || '\ufffd'"}, {"eng": "said || '\ufffd'"}, {"bhb": f"{_B} || '\x07'"}, {"mar": f"{_M} || '\x08'"}, {"mar": f"repeat('कख ', 40) || left({_M}, 40)"}, {"bhb": f"repeat('गघ ', 40) || left({_B}, 40)"}, {"bhb": f"left({_B}, 40)"},
    {"mar": "'हे वाक्य चाचणीत दोनदा लिहिले आहे'", "bhb": "'यो बोल जाचणीमा बेन वख्त लखलो से'", "eng": "'This row is there twice'"}, {"mar": "' हे  वाक्य चाचणीत दोनदा लिहिले आहे '", "bhb": "'यो बोल जाचणीमा बेन वख्त लखलो से'", "eng": "'This row is there again'"},
    {"mar": f"'\u201c' || replace({_M}, 'क', 'क\u200d') || '.....\u201d'", "eng": "'\uff0c' || said || '\u2019\u00ad'"}, {"mar": f"{_M} || ' \u0915\u093c \u0958'", "eng": "'e\u0301tude ' || said"}, {"mar": f"' \"' || {_M} || '\" '", "bhb": f"'\u201c\u00a0' || {_B} || ' \"'"}, {}, {},
]


def _faulty(column: str, other: str) -> str:
    cases = " ".join(f"WHEN {k} THEN {f[column]}" for k, f in enumerate(FAULTS) if column in f)
    return f"CASE (conv_id * 7 + turn) % {len(FAULTS)} {cases} ELSE {other} END"


_COLUMNS = f"conv_id, turn, CAST(conv_id AS {{text}}) AS id, CAST(conv_id % 7 AS {{text}}) AS category, {_faulty('eng', 'said')} AS eng, {_faulty('mar', _M)} AS mar, {_faulty('bhb', _B)} AS bhb"
DPAIRS = f"pairs AS (SELECT {_COLUMNS.format(text='VARCHAR')} FROM (SELECT conv_id, turn, text AS said FROM conversations WHERE role = 'user'))"


def dpairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as pairs in Devanagari letters with an English side, one in each len(FAULTS) with each fault."""
    said = table("conversations")(spark, sf_dir).where("role = 'user'").withColumnRenamed("text", "said")
    said.createOrReplaceTempView("_said")
    return spark.sql(f"SELECT {_COLUMNS.format(text='STRING')} FROM _said")


def dcleaned(spark: SparkSession, sf_dir: str, details: bool = False) -> flows.Cleaned:
    return flows.clean(dpairs(spark, sf_dir), ["conv_id", "turn"], details=details)


@query(f"WITH {_reasons_sql(Rules(), DPAIRS, True)} SELECT conv_id, turn, s AS mar, g AS bhb, p AS eng, array_to_string(final, ',') AS reasons FROM f")
def clean_devanagari(spark, sf_dir):
    return dcleaned(spark, sf_dir).rows.select("conv_id", "turn", "mar", "bhb", "eng", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {_reasons_sql(Rules(), DPAIRS, True, True)} SELECT conv_id, turn, array_to_string(final, ',') AS reasons FROM f")
def reason_details(spark, sf_dir):
    return dcleaned(spark, sf_dir, True).rows.select("conv_id", "turn", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {_reasons_sql(Rules(), DPAIRS, True)} SELECT reason, count(*) AS n FROM (SELECT unnest(final) AS reason FROM f) GROUP BY 1")
def reason_histogram_devanagari(spark, sf_dir):
    return dcleaned(spark, sf_dir, True).reason_histogram()


@query(f"WITH {_reasons_sql(Rules(), DPAIRS, True)}, c AS (SELECT conv_id, turn, 'accepted' AS side, '' AS reasons FROM f WHERE len(final) = 0 UNION ALL SELECT conv_id, turn, 'rejected', array_to_string(final, ',') FROM f WHERE len(final) > 0) SELECT * FROM c")
def clean_routing(spark, sf_dir):
    done = dcleaned(spark, sf_dir)
    return done.accepted.select("conv_id", "turn", F.lit("accepted").alias("side"), F.lit("").alias("reasons")).unionByName(done.rejected.select("conv_id", "turn", F.lit("rejected").alias("side"), F.array_join("_rejection_reasons", ",").alias("reasons")))


@query(f"WITH {DPAIRS} SELECT conv_id, turn, round(coalesce({_hits('mar', '[ऀ-ॿ]')} / nullif(len(replace(mar, ' ', '')), 0), 0), 6) AS devanagari, coalesce({_hits('mar', '[ऀ-ॿ]')} / nullif(len(replace(mar, ' ', '')), 0), 0) >= 0.3 AS dominated FROM pairs")
def script_ratio_devanagari(spark, sf_dir):
    return dpairs(spark, sf_dir).select("conv_id", "turn", F.round(t.share(F.col("mar"), t.DEVANAGARI), 6).alias("devanagari"), t.dominated(F.col("mar")).alias("dominated"))


@query(f"WITH {DPAIRS} SELECT conv_id, turn FROM pairs WHERE {_strip('coalesce(mar, chr(32))')} <> '' AND {_strip('coalesce(bhb, chr(32))')} <> ''")
def both_sides(spark, sf_dir):
    return validate.with_both(dpairs(spark, sf_dir), "mar", "bhb").select("conv_id", "turn")


@query(f"WITH {DPAIRS}, f AS (SELECT conv_id, turn, CASE WHEN conv_id % 5 > 0 THEN {_fold('mar')} END AS k FROM pairs) SELECT conv_id, turn, row_number() OVER (PARTITION BY k ORDER BY conv_id, turn) > 1 AS is_duplicate FROM f")
def dedup_null_keys(spark, sf_dir):
    return dedup.keep_first(dpairs(spark, sf_dir), F.when(F.col("conv_id") % 5 > 0, t.folded(F.col("mar"))), ["conv_id", "turn"]).select("conv_id", "turn", "is_duplicate")


# ---- text and validation
@query(f"SELECT doc_id, {_norm('text')} AS text FROM documents")
def normalize_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", t.normalized(F.col("text"), compose=False).alias("text"))


@query("SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def nfc_normalize(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", t.nfc("text").alias("text"))


@query(f"SELECT doc_id, round(coalesce({_hits('text', '[A-Za-z]')} / nullif(len(replace(text, ' ', '')), 0), 0), 6) AS latin, round(coalesce({_hits('text', '[ऀ-ॿ]')} / nullif(len(replace(text, ' ', '')), 0), 0), 6) AS devanagari, coalesce({_hits('text', '[A-Za-z]')} / nullif(len(replace(text, ' ', '')), 0), 0) >= 0.3 AS is_latin FROM documents")
def script_ratio(spark, sf_dir):
    x = F.col("text")
    return docs(spark, sf_dir).select("doc_id", F.round(t.share(x, t.LATIN), 6).alias("latin"), F.round(t.share(x, t.DEVANAGARI), 6).alias("devanagari"), t.dominated(x, t.LATIN).alias("is_latin"))


@query(f"WITH {_reasons_sql()} SELECT conv_id, turn, array_to_string(final, ',') AS reasons FROM f")
def validate_reasons(spark, sf_dir):
    return cleaned(spark, sf_dir).rows.select("conv_id", "turn", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {_reasons_sql()} SELECT reason, count(*) AS n FROM (SELECT unnest(final) AS reason FROM f) GROUP BY 1")
def reason_histogram(spark, sf_dir):
    return cleaned(spark, sf_dir).reason_histogram()


@query(f"WITH {_reasons_sql()} SELECT count(*) AS n_input, count(*) FILTER (len(final) = 0) AS n_clean, count(*) FILTER (len(final) > 0) AS n_rejected, count(*) FILTER (list_contains(final, 'duplicate')) AS n_duplicate, round(count(*) FILTER (len(final) = 0) * 100.0 / nullif(count(*), 0), 4) AS percent_kept FROM f")
def clean_summary(spark, sf_dir):
    return cleaned(spark, sf_dir).summary()


@query(f"SELECT doc_id, len({_strip('text')}) < 20 AS too_short, len({_words('text')}) < 4 AS few_words FROM documents")
def short_texts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", (F.length(t.strip(F.col("text"))) < 20).alias("too_short"), (t.n_words(F.col("text")) < 4).alias("few_words"))


@query(rf"SELECT doc_id, CAST({_hits('text', chr(92) + 'p{Nd}')} AS BIGINT) AS digits, CAST({_hits('text', chr(92) + 'p{L}')} AS BIGINT) AS letters FROM documents")
def digit_letter_counts(spark, sf_dir):
    x = F.col("text")
    return docs(spark, sf_dir).select("doc_id", t.count_digits(x).cast("long").alias("digits"), t.count_letters(x).cast("long").alias("letters"))


@query(f"WITH w AS (SELECT doc_id, unnest({_words('text')}) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY 1, 2), s AS (SELECT doc_id, max(n) AS top, sum(n) AS n FROM c GROUP BY 1) SELECT d.doc_id, coalesce(s.n > 5 AND s.top / s.n > 0.4, false) AS repetitive FROM documents d LEFT JOIN s USING (doc_id)")
def repetitive_texts(spark, sf_dir):
    x = F.col("text")
    return docs(spark, sf_dir).select("doc_id", F.coalesce((t.n_words(x) > 5) & (t.top_share(x) > 0.4), F.lit(False)).alias("repetitive"))


@query(f"WITH {PAIRS}, f AS (SELECT conv_id, turn, {_fold('mar')} AS a, {_fold('bhb')} AS b FROM pairs) SELECT conv_id, turn, round({_same('a', 'b')} / nullif(greatest(len(a), len(b)), 0), 6) AS similarity FROM f")
def positional_similarity(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", F.round(t.similarity(t.folded(F.col("mar")), t.folded(F.col("bhb"))), 6).alias("similarity"))


@query(f"WITH {PAIRS}, f AS (SELECT *, {_fold('mar')} AS a, {_fold('bhb')} AS b FROM pairs) SELECT conv_id, turn FROM f WHERE a <> '' AND b <> '' AND NOT coalesce({_same('a', 'b')} / nullif(greatest(len(a), len(b)), 0) >= 0.05, false)")
def copy_filter(spark, sf_dir):
    return validate.not_copied(pairs(spark, sf_dir), "mar", "bhb", 0.05).select("conv_id", "turn")


# ---- dedup, counts, splits
@query(f"SELECT doc_id, row_number() OVER (PARTITION BY {_fold('text')} ORDER BY doc_id) > 1 AS is_duplicate FROM documents")
def dedup_keep_first(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "text")
    return dedup.keep_first(d, t.folded(F.col("text")), ["doc_id"]).select("doc_id", "is_duplicate")


@query(f"WITH w AS (SELECT 'text' AS side, len({_words('text')}) AS w FROM documents UNION ALL SELECT 'source', len({_words('source')}) FROM documents) SELECT side, count(*) AS n, min(w) AS min_words, max(w) AS max_words, CAST(sum(w) AS BIGINT) AS total_words, round(sum(w) / count(*), 4) AS avg_words FROM w GROUP BY 1")
def length_stats(spark, sf_dir):
    return stats.length_stats(docs(spark, sf_dir), ["text", "source"])


@query("SELECT coalesce(lang, 'unknown') AS category, count(*) AS n FROM documents GROUP BY 1")
def category_histogram(spark, sf_dir):
    return stats.category_histogram(docs(spark, sf_dir), "lang")


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || doc_id)) <= 100 THEN 'test' ELSE 'train' END AS split FROM documents")
def split_exact(spark, sf_dir):
    return split.split_exact(docs(spark, sf_dir).select("doc_id"), 100, ["doc_id"])


@query(f"WITH {PAIRS} SELECT conv_id, turn, CASE WHEN CAST('0x' || left(md5('42|' || id), 8) AS BIGINT) < CAST(floor(0.05 * 4294967296) AS BIGINT) THEN 'test' ELSE 'train' END AS split FROM pairs")
def split_by_group(spark, sf_dir):
    return split.split_fraction(pairs(spark, sf_dir), 0.05, ["id"]).select("conv_id", "turn", "split")


@query("SELECT doc_id, 0 AS copy FROM documents WHERE lang <> 'es' UNION ALL SELECT doc_id, unnest([1, 2, 3]) FROM documents WHERE lang = 'es'")
def oversample_union(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "lang")
    return split.oversampled(d.where("lang <> 'es'"), d.where("lang = 'es'"), 3).select("doc_id", "copy")


@query(f"WITH {PAIRS} SELECT id, count(*) AS n_rows, count(DISTINCT (mar, bhb)) AS n_distinct FROM pairs GROUP BY 1 HAVING count(DISTINCT (mar, bhb)) > 1")
def id_not_unique(spark, sf_dir):
    return checks.shared_ids(pairs(spark, sf_dir), "id", ["mar", "bhb"])


@query("SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct FROM (SELECT text, lang, count(*) AS n FROM documents GROUP BY ALL)")
def exact_row_dedup(spark, sf_dir):
    return checks.distinct_rows(docs(spark, sf_dir), ["text", "lang"])


@query("SELECT a.doc_id FROM documents a WHERE a.source <> 'src0' AND EXISTS (SELECT 1 FROM documents b WHERE b.source = 'src0' AND b.text = a.text AND b.lang = a.lang)")
def cross_source_duplicates(spark, sf_dir):
    d = docs(spark, sf_dir)
    return checks.in_both(d.where("source <> 'src0'"), d.where("source = 'src0'"), ["text", "lang"]).select("doc_id")


@query(f"WITH {PAIRS}, w AS (SELECT conv_id, turn, len({_words('bhb')}) / nullif(len({_words('mar')}), 0) AS r FROM pairs) SELECT conv_id, turn, round(r, 6) AS word_ratio FROM w WHERE NOT (r BETWEEN 0.4 AND 2.5)")
def misalignment_band(spark, sf_dir):
    return checks.off_band(pairs(spark, sf_dir), "mar", "bhb").select("conv_id", "turn", F.round("word_ratio", 6).alias("word_ratio"))


@query(f"WITH {PAIRS}, c AS (SELECT category, 'eng' AS \"column\", eng AS v FROM pairs UNION ALL SELECT category, 'mar', mar FROM pairs) SELECT category, \"column\", count(*) AS n_rows, count(*) FILTER ({_strip('v')} = '') AS n_missing, round(count(*) FILTER ({_strip('v')} = '') / count(*), 6) AS rate FROM c GROUP BY 1, 2")
def missing_rate(spark, sf_dir):
    return checks.missing_rates(pairs(spark, sf_dir), ["eng", "mar"], "category")


@query("WITH c AS (SELECT coalesce(source, 'unknown') AS category, count(*) AS n FROM documents GROUP BY 1) SELECT category, n, round(n / sum(n) OVER (), 6) AS share, round(n / min(n) OVER (), 6) AS times_smallest FROM c")
def imbalance(spark, sf_dir):
    return checks.imbalance(docs(spark, sf_dir), "source")


@query("SELECT doc_id FROM documents WHERE text IN (SELECT text FROM benchmark)")
def leak_exact(spark, sf_dir):
    return checks.leaked_exact(docs(spark, sf_dir), table("benchmark")(spark, sf_dir)).select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 1 AND text IN (SELECT text FROM documents WHERE doc_id % 2 = 0)")
def leak_exact_halves(spark, sf_dir):
    d = docs(spark, sf_dir)
    return checks.leaked_exact(d.where("doc_id % 2 = 1"), d.where("doc_id % 2 = 0")).select("doc_id")


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def leak_containment(spark, sf_dir):
    return checks.leaked_within(docs(spark, sf_dir), table("benchmark")(spark, sf_dir))


_SIDES = "CASE WHEN CAST('0x' || left(md5('42|' || conv_id || '|' || turn), 8) AS BIGINT) < 2147483648 THEN 'test' ELSE 'train' END"


@query(f"WITH {PAIRS}, s AS (SELECT *, {_SIDES} AS split FROM pairs) SELECT conv_id, turn FROM s WHERE split = 'train' AND id IN (SELECT id FROM s WHERE split = 'test')")
def leak_by_group(spark, sf_dir):
    s = split.split_fraction(pairs(spark, sf_dir), 0.5, ["conv_id", "turn"])
    return checks.leaked_group(s.where("split = 'train'"), s.where("split = 'test'"), "id").select("conv_id", "turn")


# ---- glossary
RAW = """raw AS (SELECT p_partkey AS ord, p_name AS marathi, CASE p_partkey % 6 WHEN 0 THEN p_type || ' / ' || p_brand WHEN 1 THEN p_type || ', ' || p_name WHEN 2 THEN '' WHEN 3 THEN 'x'
  WHEN 4 THEN p_brand ELSE p_name END AS devhali_bhili FROM part)"""


def raw_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, kind, brand, name = F.col("p_partkey") % 6, F.col("p_type"), F.col("p_brand"), F.col("p_name")
    target = F.when(k == 0, F.concat(kind, F.lit(" / "), brand)).when(k == 1, F.concat(kind, F.lit(", "), name)).when(k == 2, "").when(k == 3, "x").when(k == 4, brand).otherwise(name)
    return table("part")(spark, sf_dir).select(F.col("p_partkey").alias("ord"), name.alias("marathi"), target.alias("devhali_bhili"))


def _variant(x: str) -> str:
    s = _strip(f"split_part({_strip(x)}, '/', 1)")
    ps = f"list_filter(list_transform(string_split({s}, ','), lambda p: {_strip('p')}), lambda p: p <> '')"
    return f"CASE WHEN contains({s}, ',') AND len({ps}) > 1 AND len(list_filter({ps}, lambda p: len(p) < 2)) = 0 THEN ({ps})[1] ELSE {s} END"


JUDGED = f"""{RAW}, v AS (SELECT ord, {_strip('marathi')} AS a, {_strip('devhali_bhili')} AS b, {_variant('marathi')} AS src, {_variant('devhali_bhili')} AS tgt FROM raw),
j AS (SELECT *, CASE WHEN a = '' OR b = '' THEN 'drop_empty' WHEN src = '' OR tgt = '' THEN 'drop_empty_after_normalize' WHEN regexp_matches(tgt, '[0-9]') THEN 'drop_latin_bhili' WHEN len(src) < 2 OR len(tgt) < 2 THEN 'drop_too_short' END AS verdict FROM v)"""


def judged(spark, sf_dir):
    return glossary.judged(raw_glossary(spark, sf_dir), foreign="[0-9]")


@query(f"WITH {JUDGED}, b AS (SELECT 'forward' AS direction, src, tgt, ord FROM j WHERE verdict IS NULL UNION ALL SELECT 'backward', tgt, src, ord FROM j WHERE verdict IS NULL) SELECT direction, src, arg_min(tgt, (len(tgt), ord)) AS tgt FROM b GROUP BY 1, 2")
def glossary_build(spark, sf_dir):
    return glossary.built(judged(spark, sf_dir))


@query(f"WITH {JUDGED} SELECT count(*) AS total, {', '.join(f'''count(*) FILTER (verdict = '{x}') AS {x}''' for x in ('drop_empty', 'drop_empty_after_normalize', 'drop_latin_bhili', 'drop_too_short'))}, count(DISTINCT src) FILTER (verdict IS NULL) AS kept, count(*) FILTER (verdict IS NULL) - count(DISTINCT src) FILTER (verdict IS NULL) AS collision_mar, count(*) FILTER (verdict IS NULL) - count(DISTINCT tgt) FILTER (verdict IS NULL) AS collision_bhb, count(*) FILTER (verdict IS NULL AND {_fold('src')} = {_fold('tgt')}) AS kept_mar_equals_bhb FROM j")
def glossary_counters(spark, sf_dir):
    return glossary.glossary_counters(judged(spark, sf_dir))


TERMS = f"""toks AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[{LATIN_LETTERS}]+')) AS src FROM benchmark),
terms AS (SELECT src, CASE WHEN len(src) % 3 = 0 THEN src ELSE reverse(src) END AS tgt FROM toks WHERE regexp_full_match(src, '[a-z]{{5,}}'))"""


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table("benchmark")(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit(f"[{LATIN_LETTERS}]+"), F.lit(0))).alias("src")).where(F.col("src").rlike(r"\A[a-z]{5,}\z")).distinct()
    return words.withColumn("tgt", F.when(F.length("src") % 3 == 0, F.col("src")).otherwise(F.reverse("src")))


@query(f"WITH {TERMS}, both_ways AS (SELECT src, tgt FROM terms UNION SELECT tgt, src FROM terms WHERE len(src) % 2 = 0) SELECT DISTINCT a.src, a.tgt FROM both_ways a JOIN both_ways b ON a.src = b.tgt AND a.tgt = b.src WHERE a.src <> a.tgt")
def contradictory_pairs(spark, sf_dir):
    g = terms(spark, sf_dir)
    return glossary.contradictory(g.union(g.where(F.length("src") % 2 == 0).select("tgt", "src")).distinct())


PREDICTED = "predicted AS (SELECT conv_id, turn, category, mar AS source, bhb AS reference, bhb || ' ' || mar AS prediction FROM pairs)"
FOUND = f"""found AS (SELECT p.conv_id, p.turn, p.prediction, list([t.src, t.tgt] ORDER BY p.k) AS terms FROM
  (SELECT conv_id, turn, prediction, unnest(regexp_extract_all(source, '[{LATIN_LETTERS}]+')) AS w, generate_subscripts(regexp_extract_all(source, '[{LATIN_LETTERS}]+'), 1) AS k FROM predicted) p
  JOIN terms t ON t.src = p.w GROUP BY 1, 2, 3)"""


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("conv_id", "turn", "category", F.col("mar").alias("source"), F.col("bhb").alias("reference"), F.concat("bhb", F.lit(" "), "mar").alias("prediction"))


@query(f"WITH {PAIRS}, {PREDICTED}, {TERMS}, {FOUND} SELECT p.conv_id, p.turn, coalesce(array_to_string(list_transform(f.terms, lambda x: x[1] || ' -> ' || x[2]), '; '), '') AS terms FROM predicted p LEFT JOIN found f USING (conv_id, turn)")
def source_terms(spark, sf_dir):
    found = glossary.with_terms(predicted(spark, sf_dir), terms(spark, sf_dir), "source", letters=LATIN_LETTERS)
    return found.select("conv_id", "turn", t.edits_text(F.col("terms")).alias("terms"))


def _edited(spark, sf_dir, boundary):
    return glossary.post_edited(predicted(spark, sf_dir), terms(spark, sf_dir), boundary, letters=LATIN_LETTERS)


def _rewritten_sql(boundary: str, letters: str = LATIN_LETTERS) -> str:
    """edited: each prediction (text) and its edits after the terms found in its source, one after the other, by recursion."""
    suffix = f" AND (len(w) = len(x) OR regexp_matches(w[len(x) + 1:], '^({'|'.join(SUFFIXES)})'))" if boundary == "suffix" else ""
    fits = lambda x: f"(starts_with(w, {x}){suffix.replace('len(x)', f'len({x})')})"
    src, tgt = "terms[k][1]", "terms[k][2]"
    holds = lambda x: f"len(list_filter(runs, lambda w: {fits(x)})) > 0"
    new = f"array_to_string(list_transform(runs, lambda w: CASE WHEN {fits(src)} THEN {tgt} || w[len({src}) + 1:] ELSE w END), '')"
    return f"""step AS (SELECT p.conv_id, p.turn, p.prediction AS text, CAST([] AS VARCHAR[][]) AS edits, coalesce(f.terms, []) AS terms, 1 AS k FROM predicted p LEFT JOIN found f USING (conv_id, turn)
  UNION ALL SELECT conv_id, turn, new, CASE WHEN new <> text THEN list_append(edits, [{src}, {tgt}]) ELSE edits END, terms, k + 1 FROM
  (SELECT *, CASE WHEN {_fold(src)} <> {_fold(tgt)} AND {holds(src)} AND NOT ({holds(tgt)}) THEN {new} ELSE text END AS new FROM
  (SELECT *, regexp_extract_all(text, '[{letters}]+|[^{letters}]+') AS runs FROM step WHERE k <= len(terms)))),
edited AS (SELECT p.*, s.text AS final, s.edits FROM predicted p JOIN step s USING (conv_id, turn) WHERE s.k = len(s.terms) + 1)"""


_EDITS = "array_to_string(list_transform(edits, lambda e: e[1] || ' -> ' || e[2]), '; ')"


@query(f"WITH RECURSIVE {PAIRS}, {PREDICTED}, {TERMS}, {FOUND}, {_rewritten_sql('lenient')} SELECT conv_id, turn, final AS prediction_final, {_EDITS} AS post_edits FROM edited")
def post_edit_lenient(spark, sf_dir):
    return _edited(spark, sf_dir, "lenient").select("conv_id", "turn", "prediction_final", t.edits_text(F.col("post_edits")).alias("post_edits"))


@query(f"WITH RECURSIVE {PAIRS}, {PREDICTED}, {TERMS}, {FOUND}, {_rewritten_sql('suffix')} SELECT conv_id, turn, final AS prediction_final, {_EDITS} AS post_edits FROM edited")
def post_edit_suffix(spark, sf_dir):
    return _edited(spark, sf_dir, "suffix").select("conv_id", "turn", "prediction_final", t.edits_text(F.col("post_edits")).alias("post_edits"))


# the same in Devanagari, where predictions hold the source's words with inflections, listed ones and others
_ENDINGS = ["", "ला", "साठी", "अळी", "ांना"]
_INFLECTED = f"CASE (i{{first}}) % {len(_ENDINGS)} " + " ".join(f"WHEN {k} THEN '{e}'" for k, e in enumerate(_ENDINGS)) + " END"
DPREDICTED = f"""predicted AS (SELECT conv_id, turn, CAST(conv_id % 7 AS VARCHAR) AS category, m AS source, regexp_replace(m, ' ', ' क ') AS reference,
  array_to_string(list_transform(string_split(m, ' '), lambda w, i: w || {_INFLECTED.format(first=' - 1')}), ' ') AS prediction
  FROM (SELECT conv_id, turn, {_in_devanagari('text')} AS m FROM conversations WHERE role = 'user'))"""
DTERMS = f"{TERMS.replace('terms AS', 'latin AS')}, terms AS (SELECT {_in_devanagari('src')} AS src, {_in_devanagari('tgt')} AS tgt FROM latin)"
DFOUND = FOUND.replace(LATIN_LETTERS, LETTERS)


def dpredicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table("conversations")(spark, sf_dir).where("role = 'user'").select("conv_id", "turn", F.expr(_in_devanagari("text")).alias("m"))
    return m.select("conv_id", "turn", (F.col("conv_id") % 7).cast("string").alias("category"), F.col("m").alias("source"), F.regexp_replace("m", r"\A([^ ]*) ", "$1 क ").alias("reference"), F.expr(f"array_join(transform(split(m, ' '), (w, i) -> w || {_INFLECTED.format(first='')}), ' ')").alias("prediction"))


def dterms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms(spark, sf_dir).select(F.expr(_in_devanagari("src")).alias("src"), F.expr(_in_devanagari("tgt")).alias("tgt"))


def _dedited(spark, sf_dir, boundary="suffix"):
    return glossary.post_edited(dpredicted(spark, sf_dir), dterms(spark, sf_dir), boundary)


_DEDITED = f"{DPREDICTED}, {DTERMS}, {DFOUND}, {_rewritten_sql('suffix', LETTERS)}"


@query(f"WITH RECURSIVE {DPREDICTED}, {DTERMS}, {DFOUND}, {_rewritten_sql('lenient', LETTERS)} SELECT conv_id, turn, final AS prediction_final, {_EDITS} AS post_edits FROM edited")
def post_edit_devanagari_lenient(spark, sf_dir):
    return _dedited(spark, sf_dir, "lenient").select("conv_id", "turn", "prediction_final", t.edits_text(F.col("post_edits")).alias("post_edits"))


@query(f"WITH RECURSIVE {_DEDITED} SELECT conv_id, turn, final AS prediction_final, {_EDITS} AS post_edits FROM edited")
def post_edit_devanagari(spark, sf_dir):
    return _dedited(spark, sf_dir).select("conv_id", "turn", "prediction_final", t.edits_text(F.col("post_edits")).alias("post_edits"))


@query(f"WITH RECURSIVE {DPREDICTED.replace('AS prediction', 'AS inflected', 1).replace('m AS source', 'm AS source, m AS prediction')}, {DTERMS}, {DFOUND}, {_rewritten_sql('suffix', LETTERS)} SELECT conv_id, turn, source AS bhili_text, prediction AS prediction_raw, final AS prediction_final, {_EDITS.replace(' -> ', '->')} AS glossary_edits FROM edited")
def batch_test(spark, sf_dir):
    rows = dpredicted(spark, sf_dir).select("conv_id", "turn", F.col("source").alias("bhili_text"))
    return flows.batch_test(rows, dterms(spark, sf_dir))


MEASURED = f"""measured AS (SELECT p.conv_id, p.turn, coalesce(len(f.terms), 0) AS alignment_total,
  coalesce(len(list_filter(f.terms, lambda x: len(list_filter(regexp_extract_all(p.prediction, '[{LATIN_LETTERS}]+'), lambda w: starts_with(w, x[2]))) > 0)), 0) AS alignment_hits,
  coalesce(len(list_filter(f.terms, lambda x: x[1] <> x[2])), 0) AS translation_total,
  coalesce(len(list_filter(f.terms, lambda x: x[1] <> x[2] AND len(list_filter(regexp_extract_all(p.prediction, '[{LATIN_LETTERS}]+'), lambda w: starts_with(w, x[2]))) > 0)), 0) AS translation_hits
  FROM predicted p LEFT JOIN found f USING (conv_id, turn))"""


@query(f"WITH {PAIRS}, {PREDICTED}, {TERMS}, {FOUND}, {MEASURED} SELECT conv_id, turn, alignment_hits, alignment_total, translation_hits, translation_total FROM measured")
def glossary_metrics(spark, sf_dir):
    return glossary.with_metrics(predicted(spark, sf_dir), terms(spark, sf_dir), "source", "prediction", LATIN_LETTERS).select("conv_id", "turn", *glossary.METRICS)


@query(f"WITH {PAIRS}, {PREDICTED}, {TERMS}, {FOUND}, {MEASURED}, s AS (SELECT {', '.join(f'CAST(sum({m}) AS BIGINT) AS {m}' for m in glossary.METRICS)} FROM measured) SELECT *, round(alignment_hits / nullif(alignment_total, 0), 4) AS glossary_alignment, alignment_hits || '/' || alignment_total AS glossary_alignment_hits_total, round(translation_hits / nullif(translation_total, 0), 4) AS translation_rate, translation_hits || '/' || translation_total AS translation_rate_hits_total FROM s")
def glossary_rates(spark, sf_dir):
    return glossary.rates(glossary.with_metrics(predicted(spark, sf_dir), terms(spark, sf_dir), "source", "prediction", LATIN_LETTERS))


# ---- chrF++
_MARKS = lambda x: f"list_contains(string_split('!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', ''), {x})"
CHRF = f"""sides AS (SELECT conv_id, turn, category, 'h' AS side, prediction AS x FROM predicted UNION ALL SELECT conv_id, turn, category, 'r', reference FROM predicted),
units AS (SELECT conv_id, turn, category, side, string_split(regexp_replace(x, '{WS}+', '', 'g'), '') AS c,
  flatten(list_transform({_words('x')}, lambda w: CASE WHEN len(w) > 1 AND {_MARKS('right(w, 1)')} THEN [left(w, -1), right(w, 1)] WHEN len(w) > 1 AND {_MARKS('left(w, 1)')} THEN [left(w, 1), w[2:]] ELSE [w] END)) AS w FROM sides),
orders AS (SELECT u.*, o.o, CASE WHEN o.o <= 6 THEN u.c ELSE u.w END AS l, CASE WHEN o.o <= 6 THEN o.o ELSE o.o - 6 END AS n FROM units u, range(1, 9) o(o)),
grams AS (SELECT conv_id, turn, category, side, o, unnest(list_transform(range(1, len(l) - n + 2), lambda i: array_to_string(l[i : i + n - 1], chr(1)))) AS g FROM orders),
counts AS (SELECT conv_id, turn, category, side, o, g, count(*) AS k FROM grams GROUP BY ALL),
tot AS (SELECT conv_id, turn, category, o, CAST(sum(k) FILTER (side = 'h') AS BIGINT) AS h, CAST(sum(k) FILTER (side = 'r') AS BIGINT) AS r FROM counts GROUP BY ALL),
hit AS (SELECT a.conv_id, a.turn, a.o, CAST(sum(least(a.k, b.k)) AS BIGINT) AS m FROM counts a JOIN counts b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.o = b.o AND a.g = b.g AND a.side = 'h' AND b.side = 'r' GROUP BY ALL),
stat AS (SELECT t.conv_id, t.turn, t.category, t.o, coalesce(h, 0) AS h, coalesce(r, 0) AS r, coalesce(m, 0) AS m FROM tot t LEFT JOIN hit USING (conv_id, turn, o))"""


def _f(by: str, source: str, digits: int | None = 4) -> str:
    whole = "coalesce(5 * p * q / nullif(4 * p + q, 0), 0) * 100"
    return f"""SELECT {by}, {f'round({whole}, {digits})' if digits else whole} AS chrf2pp FROM
  (SELECT {by}, avg(m / h) FILTER (h > 0 AND r > 0) AS p, avg(m / r) FILTER (h > 0 AND r > 0) AS q FROM {source} GROUP BY ALL)"""


@query(f"WITH {PAIRS}, {PREDICTED}, {CHRF} {_f('conv_id, turn', 'stat')}")
def chrf_sentence(spark, sf_dir):
    return predicted(spark, sf_dir).select("conv_id", "turn", F.round(chrf.sentence_score(F.col("prediction"), F.col("reference")), 4).alias("chrf2pp"))


@query(f"WITH {PAIRS}, {PREDICTED}, {CHRF}, s AS (SELECT 0 AS one, o, sum(h) AS h, sum(r) AS r, sum(m) AS m FROM stat GROUP BY ALL), f AS ({_f('one', 's')}) SELECT chrf2pp, (SELECT count(*) FROM predicted) AS n FROM f")
def chrf_corpus(spark, sf_dir):
    return reports.evaluated(predicted(spark, sf_dir), prediction="prediction")


@query(f"WITH {PAIRS}, {PREDICTED}, {CHRF}, s AS (SELECT category, o, sum(h) AS h, sum(r) AS r, sum(m) AS m FROM stat GROUP BY ALL), f AS ({_f('category', 's')}) SELECT category, chrf2pp, n FROM f JOIN (SELECT category, count(*) AS n FROM predicted GROUP BY 1) USING (category) WHERE n >= 5")
def chrf_by_category(spark, sf_dir):
    return reports.by_category(predicted(spark, sf_dir), prediction="prediction")


# ---- audit, reports, review
def _audited(spark, sf_dir):
    rows = _dedited(spark, sf_dir).withColumns({"prediction_raw": F.col("prediction"), "example_file": F.lit("conversations"), "file_no": F.col("conv_id"), "example_idx": F.col("turn")})
    return audit.glossary_audit(rows)


AUDIT = f"""WITH RECURSIVE {_DEDITED},
scored AS (SELECT conv_id, turn * 2 AS turn, '' AS category, prediction, reference FROM edited WHERE len(edits) > 0 UNION ALL SELECT conv_id, turn * 2 + 1, '', final, reference FROM edited WHERE len(edits) > 0),
{CHRF.replace('FROM predicted', 'FROM scored')}, sent AS ({_f('conv_id, turn', 'stat', None)}),
shares AS (SELECT e.*, round(b.chrf2pp - a.chrf2pp, 9) / len(edits) AS share, unnest(edits) AS edit, row(e.conv_id, e.turn) AS ord FROM edited e JOIN sent a ON a.conv_id = e.conv_id AND a.turn = e.turn * 2 JOIN sent b ON b.conv_id = e.conv_id AND b.turn = e.turn * 2 + 1),
shown AS (SELECT *, struct_pack(f := 'conversations', i := turn, s := source, r := prediction, p := final) AS x FROM shares),
audit AS (SELECT edit[1] AS source_term, edit[2] AS target_term, count(*) AS n_fired, count(*) FILTER (share > 0.01) AS n_helped, count(*) FILTER (share < -0.01) AS n_hurt, count(*) FILTER (share BETWEEN -0.01 AND 0.01) AS n_neutral,
  CAST(sum(CAST(share AS DECIMAL(30, 12))) AS DOUBLE) AS net, coalesce(arg_max(x, ord) FILTER (share < 0), arg_min(x, ord)) AS x, min(ord) AS ord FROM shown GROUP BY 1, 2),
entries AS (SELECT source_term, target_term, n_fired, n_helped, n_hurt, n_neutral, round(net, 3) AS net_chrf_delta, round(net / n_fired, 4) AS avg_chrf_delta, x.f AS example_file, x.i AS example_idx, x.s AS example_source, x.r AS example_raw, x.p AS example_final, ord FROM audit)"""


@query(f"{AUDIT} SELECT * EXCLUDE (ord) FROM entries")
def glossary_audit(spark, sf_dir):
    return _audited(spark, sf_dir).drop("_first")


_RANKED = "row_number() OVER (ORDER BY net_chrf_delta {way}, ord, source_term, target_term)"


@query(f"{AUDIT}, r AS (SELECT *, 'harmful' AS \"end\", CAST({_RANKED.format(way='')} AS INTEGER) AS rank FROM entries UNION ALL SELECT *, 'helpful', CAST({_RANKED.format(way='DESC')} AS INTEGER) FROM entries) SELECT * EXCLUDE (ord) FROM r WHERE rank <= 10")
def audit_extremes(spark, sf_dir):
    return audit.extremes(_audited(spark, sf_dir)).drop("_first")


@query(f"{AUDIT} SELECT category, count(*) FILTER (len(edits) > 0) AS rows_with_edits, (SELECT count(DISTINCT edit) FROM shares s WHERE s.category = e.category) AS entries_fired FROM edited e WHERE len(edits) > 0 GROUP BY 1")
def audit_totals(spark, sf_dir):
    return audit.audit_totals(_dedited(spark, sf_dir), "category")


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as if they were evaluation runs: a report per customer and priority with a result for each status."""
    o = table("orders")(spark, sf_dir)
    run = F.concat(F.lit("run_ckp_"), (F.col("o_custkey") % 40 * 1000).cast("string"))
    one = o.groupBy(run.alias("run_name"), F.when(F.col("o_orderpriority") < "3", "beam").otherwise("greedy").alias("decoding"), F.concat(F.lit("dir_"), "o_orderstatus").alias("direction"), F.year("o_orderdate").cast("string").alias("year"))
    cat = one.agg(F.max("o_totalprice").alias("chrf2pp"), F.count("*").alias("n"))
    result = cat.groupBy("run_name", "decoding", "direction").agg(F.max("chrf2pp").alias("chrf2pp"), F.sum("n").alias("n_samples"), F.map_from_entries(F.collect_list(F.struct("year", F.struct("chrf2pp", "n")))).alias("cats"))
    r = F.struct("direction", "n_samples", "chrf2pp", F.col("cats").alias("chrf2pp_by_category"), F.lit(None).cast("double").alias("glossary_alignment"), F.lit(None).cast("double").alias("translation_rate"), F.lit(None).cast("double").alias("generation_time_sec"))
    # (of equal directions, which these have none of, the first would count)
    by_name = lambda a, b: F.when(a["direction"] < b["direction"], -1).when(a["direction"] > b["direction"], 1).otherwise(0)
    listed = F.array_sort(F.collect_list(r), by_name)
    number = (F.regexp_extract("run_name", r"(\d+)", 1).cast("int") + F.when(F.col("decoding") == "beam", 0).otherwise(1)).alias("report_no")
    return result.groupBy("run_name", "decoding").agg(listed.alias("results")).select("run_name", F.struct("decoding", F.lit(False).alias("use_glossary_postedit")).alias("config"), "results", number)


RUNS = """cat AS (SELECT 'run_ckp_' || (o_custkey % 40 * 1000) AS run, CASE WHEN o_orderpriority < '3' THEN 'beam' ELSE 'greedy' END AS decoding, 'dir_' || o_orderstatus AS direction, CAST(year(o_orderdate) AS VARCHAR) AS category,
  max(o_totalprice) AS chrf2pp, count(*) AS n, o_custkey % 40 * 1000 AS checkpoint FROM orders GROUP BY ALL),
runs AS (SELECT run, CAST(checkpoint AS INTEGER) AS checkpoint, decoding, direction, max(chrf2pp) AS chrf2pp, CAST(sum(n) AS BIGINT) AS n_samples FROM cat GROUP BY ALL)"""


@query(f"WITH {RUNS} SELECT run, checkpoint, decoding, direction, chrf2pp, n_samples FROM runs")
def report_flatten(spark, sf_dir):
    return reports.run_rows(_reports(spark, sf_dir)).select("run", "checkpoint", "decoding", "direction", "chrf2pp", "n_samples")


@query(f"WITH {RUNS} SELECT run, CAST(checkpoint AS INTEGER) AS checkpoint, decoding, category, chrf2pp, n FROM cat")
def report_categories(spark, sf_dir):
    return reports.category_rows(_reports(spark, sf_dir))


@query(f"WITH {RUNS} SELECT category, {', '.join(f'''round(avg(chrf2pp) FILTER (checkpoint = {c} AND decoding = '{d}'), 4) AS \"{c}_{d}\"''' for c in (0, 1000) for d in ('beam', 'greedy'))} FROM cat GROUP BY 1")
def category_pivot(spark, sf_dir):
    return reports.category_pivot(reports.category_rows(_reports(spark, sf_dir)), [f"{c}_{d}" for c in (0, 1000) for d in ("beam", "greedy")])


@query(f"WITH {RUNS} SELECT 'chrf2pp' AS metric, run, checkpoint, decoding, chrf2pp AS value FROM runs ORDER BY chrf2pp DESC, checkpoint LIMIT 1")
def best_checkpoint(spark, sf_dir):
    return reports.best_runs(reports.run_rows(_reports(spark, sf_dir)))


@query(f"WITH {RUNS} SELECT CAST(dense_rank() OVER (ORDER BY direction) AS INTEGER) AS place, direction, left(run || ' [' || decoding || ']', 39) AS label, run, chrf2pp FROM runs WHERE decoding = 'greedy'")
def run_compare(spark, sf_dir):
    return reports.compared(reports.run_rows(_reports(spark, sf_dir)).where("decoding = 'greedy'")).select("place", "direction", "label", "run", "chrf2pp")


@query(f"WITH {RUNS} SELECT run, checkpoint, decoding, chrf2pp * 100 AS percent, chrf2pp FROM runs WHERE decoding = 'beam' AND direction = 'dir_F'")
def run_series(spark, sf_dir):
    own = reports.run_rows(_reports(spark, sf_dir)).where("direction = 'dir_F'").withColumn("translation_rate", F.col("chrf2pp"))
    return reports.series(own, "beam").select("run", "checkpoint", "decoding", F.col("translation_rate").alias("percent"), "chrf2pp")


@query(f"WITH {RUNS}, c AS (SELECT category, CAST(sum(n) AS BIGINT) AS n FROM cat GROUP BY 1) SELECT * FROM c ORDER BY n DESC, category LIMIT 3")
def largest_categories(spark, sf_dir):
    return reports.largest_first(reports.category_rows(_reports(spark, sf_dir)).groupBy("category").agg(F.sum("n").alias("n"))).limit(3)


@query(f"WITH {RUNS} SELECT run, checkpoint, decoding, direction, chrf2pp, n_samples FROM runs")
def report_files(spark, sf_dir):
    path = io.scratch(spark)
    found = _reports(spark, sf_dir).withColumn("part", F.concat_ws("-", "run_name", "config.decoding"))
    found.repartition("part").write.partitionBy("part").json(path)
    there = {f.split("/")[-2]: f for f in io.matching(spark, f"{path}/part=*/part-*.json")}
    df, gone = io.read_reports(spark, [*there.values(), f"{path}/none"], "")
    return reports.run_rows(df).select("run", "checkpoint", "decoding", "direction", "chrf2pp", "n_samples")


@query(f"WITH {RUNS} SELECT round(avg(chrf2pp), 2) AS mean_chrf2pp, count(DISTINCT direction) AS directions FROM runs")
def mean_score(spark, sf_dir):
    return reports.mean_score(reports.run_rows(_reports(spark, sf_dir))).withColumn("mean_chrf2pp", F.round("mean_chrf2pp", 2))


@query(f"WITH {PAIRS} SELECT conv_id, turn FROM pairs WHERE {_strip('mar')} <> '' AND {_strip('eng')} = ''")
def pending_rows(spark, sf_dir):
    return validate.pending(pairs(spark, sf_dir), "mar", "eng").select("conv_id", "turn")


@query(f"WITH {PAIRS} SELECT conv_id, turn, CASE WHEN {_strip('mar')} <> '' AND {_strip('eng')} = '' THEN {_strip('mar')} ELSE eng END AS eng FROM pairs")
def backfill(spark, sf_dir):
    return translate.backfilled(pairs(spark, sf_dir), "mar", "eng").select("conv_id", "turn", "eng")


@query(f"WITH RECURSIVE {_DEDITED} SELECT category, source, reference, prediction AS prediction_raw, final AS prediction_final, CASE WHEN prediction <> final THEN 'yes' ELSE 'no' END AS changed_by_postedit, {_EDITS} AS post_edits, CAST(len(edits) AS INTEGER) AS num_edits, '' AS reviewer_verdict, '' AS reviewer_notes FROM edited WHERE len(edits) > 0 ORDER BY md5('42|' || source || '|' || prediction), source, prediction LIMIT 25")
def review_export(spark, sf_dir):
    rows = _dedited(spark, sf_dir).withColumn("prediction_raw", F.col("prediction"))
    return translate.review_rows(rows, 25)


@query(f"WITH RECURSIVE {_DEDITED} SELECT category, CAST(sum(len(edits)) AS BIGINT) AS num_edits, count(*) AS n_rows, count(*) FILTER (prediction <> final) AS changed FROM edited GROUP BY 1")
def review_all_rows(spark, sf_dir):
    rows = _dedited(spark, sf_dir).withColumn("prediction_raw", F.col("prediction"))
    one = translate.review_rows(rows, include_unedited=True).groupBy("category")
    return one.agg(F.sum("num_edits").alias("num_edits"), F.count("*").alias("n_rows"), F.count_if(F.col("changed_by_postedit") == "yes").alias("changed"))


# ---- files written and read back
@query(f"WITH {DPAIRS} SELECT id, category, eng, CAST(NULL AS VARCHAR) AS hin, mar, bhb, CAST(i AS INTEGER) AS file_no FROM pairs, range(2) r(i)")
def jsonl_round_trip(spark, sf_dir):
    path = io.scratch(spark)
    io.write_jsonl(dpairs(spark, sf_dir).drop("conv_id", "turn").coalesce(1), path)
    files = io.matching(spark, f"{path}/part-*")
    return io.read_jsonl(spark, [*files, *files])


@query("SELECT CAST(turn * 100000 + conv_id AS BIGINT) AS conv_id, turn, source, CAST(row_number() OVER (ORDER BY conv_id, turn) - 1 AS BIGINT) AS example_idx, 0 AS file_no FROM (SELECT conv_id, turn, text AS source FROM conversations WHERE role = 'user')")
def numbered_jsonl(spark, sf_dir):
    path = io.scratch(spark)
    rows = table("conversations")(spark, sf_dir).where("role = 'user'").select((F.col("turn") * 100000 + F.col("conv_id")).alias("conv_id"), "turn", F.col("text").alias("source"), F.col("conv_id").alias("_c"))
    io.write_jsonl(rows.repartition(1).sortWithinPartitions("_c", "turn").drop("_c"), path)
    return io.read_numbered_jsonl(spark, [f"{path}/**/part-*.json"], "conv_id long, turn long, source string").drop("example_file")


@query(f"WITH {DPAIRS} SELECT conv_id, turn, nullif(mar, '') AS mar, bhb, eng FROM pairs WHERE bhb IS NOT NULL AND eng <> ''")
def csv_round_trip(spark, sf_dir):
    path = io.scratch(spark)
    io.write_csv(dpairs(spark, sf_dir).where("bhb IS NOT NULL AND eng <> ''").select("conv_id", "turn", "mar", "bhb", "eng"), path)
    return io.read_csv(spark, path, ["mar", "bhb"]).withColumns({c: F.col(c).cast("long") for c in ("conv_id", "turn")})


@query(f"WITH {DPAIRS} SELECT id, 'agri' AS category, '' AS eng, '' AS hin, {_strip('mar')} AS mar, {_strip('coalesce(bhb, chr(32))')} AS bhb FROM pairs WHERE conv_id % 4 > 0")
def tsv_convert(spark, sf_dir):
    path, live = io.scratch(spark), F.col("conv_id") % 4 > 0
    cell = lambda c, blank: F.when(live, F.col(c)).otherwise(blank)
    raw = dpairs(spark, sf_dir).select(cell("turn", None).cast("string").alias("dp_id"), cell("id", " ").alias("id"), cell("mar", "").alias("marathi"), cell("bhb", " ").alias("validated_translation"))
    raw.write.options(**io.TSV | io.AS_IS).csv(path)
    return io.convert_raw(io.read_tsv(spark, path, ["id", "marathi", "validated_translation"]), "agri")


@query(f"WITH {JUDGED}, b AS (SELECT 'mar2bhb' AS direction, src, tgt, ord FROM j WHERE verdict IS NULL UNION ALL SELECT 'bhb2mar', tgt, src, ord FROM j WHERE verdict IS NULL) SELECT direction, src, arg_min(tgt, (len(tgt), ord)) AS tgt FROM b GROUP BY 1, 2")
def glossary_file(spark, sf_dir):
    rows, path = judged(spark, sf_dir), io.scratch(spark) + ".json"
    io.write_json_document(spark, io.glossary_document(glossary.built(rows), glossary.glossary_counters(rows)), path)
    return io.read_glossary(spark, path)


@query(f"""WITH {PAIRS} SELECT conv_id, turn, '{translate.prompt("mar2bhb").replace("'", "''")}' AS system, mar AS "user", bhb AS assistant, 'system,user,assistant' AS roles FROM pairs""")
def training_chats(spark, sf_dir):
    d = translate.DIRECTIONS["mar2bhb"]
    m = translate.messages(translate.prompt("mar2bhb"), F.col(d.source), F.col(d.target))
    chats = pairs(spark, sf_dir).select("conv_id", "turn", m.alias("m"))
    return chats.select("conv_id", "turn", *[F.get("m", i)["content"].alias(n) for i, n in enumerate(("system", "user", "assistant"))], F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"))


@query(f"WITH {PAIRS} SELECT conv_id, turn, 'Translate the text below to Bhili.' AS system, mar AS \"user\", 2 AS turns FROM pairs")
def backfill_chats(spark, sf_dir):
    chats = pairs(spark, sf_dir).select("conv_id", "turn", translate.messages(translate.short_prompt("bhb"), F.col("mar")).alias("m"))
    return chats.select("conv_id", "turn", F.get("m", 0)["content"].alias("system"), F.get("m", 1)["content"].alias("user"), F.size("m").alias("turns"))
