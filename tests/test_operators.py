"""Operators on inline rows with expected values worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from loomtext.functions import chrf
from loomtext.operators import audit, checks, dedup, glossary, reports, split, stats, translate, validate
from loomtext.operators.validate import Rules
from loomtext.plans import flows
from loomtext.sources import io
from loomtext.streaming import incremental

GOOD_M, GOOD_B = "आमच्या गावात उद्या मोठा बाजार भरणार आहे", "हामरा गावमा काल मोटो हाट भरायवालो से"


def pair(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, eng string, mar string, bhb string")


def reasons(spark, *rows, rules=Rules(), details=False):
    got = validate.validated(validate.normalized_pairs(pair(spark, *rows), rules), rules, details)
    return [r.reasons for r in got.orderBy("ord").collect()]


def test_reasons(spark):
    long_copy = "कापूस पीक फवारणी करा आता लगेच"
    got = reasons(
        spark,
        ("Spray it", GOOD_M, GOOD_B), ("", GOOD_M, GOOD_B), (None, "", None), ("Spray it", long_copy, long_copy),
        ("Spray it", "१२३४ ५६७८ ९०१२ ३४५६ ७८९०", GOOD_B), ("Spray it", GOOD_M + "\a", GOOD_B), ("Spray it", GOOD_M, "क क क क क " + "क" * 12),
        ("Spray it", GOOD_M, "क क क क क क " + "ख" * 10), (GOOD_M, GOOD_M, GOOD_B), ("abc", GOOD_M, GOOD_B), ("Spray it", "one two three four five six", GOOD_B),
    )
    assert got[0] == [] and got[1] == ["empty_english"]
    assert got[2] == ["empty_marathi", "empty_bhili", "empty_english"]
    assert got[3] == ["untranslated_copy", "near_duplicate"]
    assert got[4] == [] and got[5] == ["marathi_control_chars"]
    assert got[6] == ["bhili_repetitive"] and got[7] == ["bhili_repetitive"]
    assert got[8] == ["english_has_devanagari"] and got[9] == ["english_too_short"]
    assert got[10] == ["marathi_not_devanagari"]


def test_details_and_options(spark):
    (got,) = reasons(spark, ("", "क ख", GOOD_B), details=True)
    assert got[1] == "marathi_too_short (3 chars)" and "marathi_few_words (2)" in got
    (got,) = reasons(spark, (None, GOOD_M, GOOD_B), rules=Rules(require_pivot=False))
    assert got == []


def test_clean_flow(spark):
    df = pair(spark, ("Spray it", GOOD_M, GOOD_B), ("Spray it", GOOD_M + " ", GOOD_B), ("", GOOD_M, GOOD_B), ("Spray it", GOOD_M, GOOD_B + " नाय"))
    done = flows.clean(df, ["ord"])
    assert sorted(r.ord for r in done.accepted.collect()) == [0, 3]
    assert {r.ord: r._rejection_reasons for r in done.rejected.collect()} == {1: ["duplicate"], 2: ["empty_english"]}
    assert {r.reason: r.n for r in done.reason_histogram().collect()} == {"duplicate": 1, "empty_english": 1}
    s = done.summary().first()
    assert (s.n_input, s.n_clean, s.n_rejected, s.n_duplicate, s.percent_kept) == (4, 2, 2, 1, 50.0)
    empty = flows.clean(df.limit(0), ["ord"])
    assert empty.summary().first().percent_kept is None and stats.length_stats(empty.accepted, ["mar"]).count() == 0


def test_keep_first(spark):
    df = spark.createDataFrame([(3, "A b"), (1, "ab"), (2, "c")], "i int, x string")
    got = {r.i: r.is_duplicate for r in dedup.keep_first(df, F.regexp_replace(F.lower("x"), " ", ""), ["i"]).collect()}
    assert got == {1: False, 2: False, 3: True}
    df = spark.createDataFrame([(0, "a b"), (1, None), (2, "AB"), (3, None), (None, "c"), (4, "c")], "i int, x string")
    got = {r.i: r.is_duplicate for r in dedup.keep_first(df, F.regexp_replace(F.lower("x"), " ", ""), ["i"]).collect()}
    assert got == {0: False, 1: False, 2: True, 3: True, None: False, 4: True}
    plan = dedup.keep_first(df, F.col("x"), ["i"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 1


def test_routed_null_keys(spark):
    """Valid rows with a null key repeat each other; failed rows neither are marked nor mark others."""
    df = spark.createDataFrame([(0, None, []), (1, None, ["bad"]), (2, None, []), (3, "k", ["bad"]), (4, "k", []), (5, "k", [])], "i int, k string, reasons array<string>")
    got = {r.i: r.reasons for r in dedup.routed(df, ["i"], key=F.col("k")).collect()}
    assert got == {0: [], 1: ["bad"], 2: ["duplicate"], 3: ["bad"], 4: [], 5: ["duplicate"]}


def test_splits(spark):
    df = spark.range(50).withColumn("g", F.col("id") % 7)
    got = split.split_exact(df, 13, ["id"])
    assert got.where("split = 'test'").count() == 13
    assert {r.id for r in got.where("split = 'test'").collect()} == {r.id for r in split.split_exact(df.repartition(9), 13, ["id"]).where("split = 'test'").collect()}
    assert split.split_exact(df, 99, ["id"]).where("split = 'test'").count() == 50 and split.split_exact(df, 0, ["id"]).where("split = 'test'").count() == 0
    assert split.split_fraction(df, 0.5, ["g"]).groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    main, more = df.limit(2), df.limit(1)
    assert split.oversampled(main, more, 3).count() == 5 and split.oversampled(main, more, 0).count() == 2
    assert split.sampled(df, 0, ["id"], [F.col("id")]).count() == 50 and split.sampled(df, 5, ["id"], [F.desc("id")]).count() == 5


def test_glossary(spark):
    raw = spark.createDataFrame([(0, "m1", "bbb"), (1, "m1", "cc"), (2, "m1", "dd"), (3, "m2", "latin"), (4, "x", "कख"), (5, "", "कख"), (6, "/ a", "कख"), (7, "कख", "कख")], "ord int, marathi string, devhali_bhili string")
    rows = glossary.judged(raw.withColumn("devhali_bhili", F.translate("devhali_bhili", "bcd", "कखग")))
    c = glossary.glossary_counters(rows).first().asDict()
    assert c == {"total": 8, "drop_empty": 1, "drop_empty_after_normalize": 1, "drop_latin_bhili": 1, "drop_too_short": 1, "kept": 2, "collision_mar": 2, "collision_bhb": 0, "kept_mar_equals_bhb": 1}
    built = glossary.built(rows)
    assert {r.src: r.tgt for r in built.where("direction = 'forward'").collect()} == {"m1": "खख", "कख": "कख"}
    doc = io.glossary_document(built, glossary.glossary_counters(rows))
    assert doc["mar2bhb"]["m1"] == "खख" and doc["stats"]["total"] == 8
    both = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d"), ("e", "e")], "src string, tgt string")
    assert sorted((r.src, r.tgt) for r in glossary.contradictory(both).collect()) == [("a", "b"), ("b", "a")]


def test_terms_sent_and_joined_agree(spark):
    g = spark.createDataFrame([("कापूस पीक", "x"), ("कापूस", "y"), ("बोंड", "कवठ")], "src string, tgt string")
    df = spark.createDataFrame([(0, "कापूस पीक, बोंड बोंड"), (1, None), (2, "बोंडाला"), (3, "पीक कापूस"), (4, "कापूस पीक, बोंड बोंड")], "i int, source string")
    sent = {r.i: r.terms for r in glossary.with_terms(df, g, sent=True).collect()}
    joined = {r.i: r.terms for r in glossary.with_terms(df, g, sent=False).collect()}
    assert sent == joined and sent[0] == [["कापूस पीक", "x"], ["बोंड", "कवठ"], ["बोंड", "कवठ"]] and sent[1] == []


def test_evaluate_flow(spark):
    pairs = spark.createDataFrame([(i, "a" if i < 5 else None, "बोंड पीक", "कवठ पीक") for i in range(6)] + [(9, "a", " ", "x")], "id int, category string, mar string, bhb string")
    g = spark.createDataFrame([("बोंड", "कवठ")], "src string, tgt string")
    raw = flows.evaluate(pairs, "mar2bhb", g, key=["id"])
    done = flows.evaluate(pairs, "mar2bhb", g, post_edit=True, key=["id"])
    assert raw.count() == 6 and raw.first().post_edits == []
    assert {r.prediction_final for r in done.collect()} == {"कवठ पीक"}
    r = flows.report(done, "mar2bhb")
    assert r["chrf2pp"] == 100.0 and r["glossary_alignment_hits_total"] == "6/6" and list(r["chrf2pp_by_category"]) == ["a"] and r["comet"] is None
    assert flows.report(raw, "mar2bhb")["translation_rate"] == 0.0
    assert glossary.rates(raw.limit(0)).first().glossary_alignment is None


def test_audit(spark):
    rows = [(0, "f", 0, "s", "a b c d", "a b c d", "x b c d", [["a", "x"]]), (0, "f", 1, "s", "x b", "a b", "x b", [["a", "x"], ["b", "y"]]), (0, "f", 2, "s", "r", "r", "r", []), (0, "f", 3, "s", "r", "r", "r", None)]
    df = spark.createDataFrame(rows, "file_no int, example_file string, example_idx int, source string, reference string, prediction_raw string, prediction_final string, post_edits array<array<string>>")
    got = {(r.source_term, r.target_term): r for r in audit.worst_first(audit.glossary_audit(df)).collect()}
    hurt = chrf.f_score(chrf.counters("x b c d", "a b c d")) - 100
    helped = 100 - chrf.f_score(chrf.counters("a b", "x b"))
    a = got["a", "x"]
    assert (a.n_fired, a.n_helped, a.n_hurt, a.n_neutral, a.example_idx) == (2, 1, 1, 0, 0)
    assert a.net_chrf_delta == pytest.approx(hurt + helped / 2, abs=1e-3)
    assert got["b", "y"].example_idx == 1
    assert audit.extremes(audit.glossary_audit(df), 1).count() == 2
    t = audit.audit_totals(df).first()
    assert (t.rows_with_edits, t.entries_fired) == (2, 2)


def test_reports(spark, tmp_path):
    report = lambda name, dec, s: {"run_name": name, "timestamp": "t", "config": {"decoding": dec, "use_glossary_postedit": False}, "results": [{"direction": "mar2bhb", "n_samples": 3, "chrf2pp": s, "chrf2pp_by_category": {"a": {"chrf2pp": s, "n": 5}}, "comet_reliable": False, "comet": 0.5}]}
    for k, (name, dec, s) in enumerate([("ckp_1000", "greedy", 50.0), ("ckp_2000", "beam", 60.0)]):
        (tmp_path / str(k)).mkdir()
        (tmp_path / str(k) / "report.json").write_text(json.dumps(report(name, dec, s), indent=2))
    df, gone = io.read_reports(spark, [str(tmp_path / x) for x in ("0", "1", "2")])
    assert gone == [str(tmp_path / "2")]
    rows = reports.run_rows(df)
    assert {r.metric: r.run for r in reports.best_runs(rows).collect()} == {"chrf2pp": "ckp_2000"}
    assert reports.category_pivot(reports.category_rows(df), ["1000_greedy", "2000_beam"]).first().asDict() == {"category": "a", "1000_greedy": 50.0, "2000_beam": 60.0}
    assert [(r.place, r.label) for r in reports.compared(rows).collect()] == [(1, "ckp_1000 [greedy]"), (1, "ckp_2000 [beam]")]
    back, _ = io.read_reports(spark, [str(tmp_path / x) for x in ("1", "0", "1")])
    assert [(r.report_no, r.label) for r in reports.compared(reports.run_rows(back)).collect()] == [(0, "ckp_2000 [beam]"), (1, "ckp_1000 [greedy]"), (2, "ckp_2000 [beam]")]
    twice = spark.createDataFrame([(0, 1, "r", 1, "beam", False, "b", 7.0, None, None), (0, 0, "r", 1, "beam", False, "c", 5.0, None, None), (0, 2, "r", 1, "beam", False, "b", 9.0, None, None)], "report_no int, result_no int, run string, checkpoint int, decoding string, edited boolean, direction string, chrf2pp double, glossary_alignment double, translation_rate double")
    assert [(r.direction, r.chrf2pp) for r in reports.compared(twice).collect()] == [("c", 5.0), ("b", 7.0)]
    assert reports.mean_score(rows).first().mean_chrf2pp == 55.0
    assert [r.checkpoint for r in reports.ordered_runs(rows).collect()] == [1000, 2000]
    text = reports.table_text(df.select(F.explode("results").alias("r")).select("r.*"), {"direction": 12, "comet": 10, "translation_rate": 18}, starred="comet_reliable")
    assert "0.5000*" in text and text.rstrip().endswith("-")


def test_checks(spark):
    df = spark.createDataFrame([(1, "a", ""), (1, "b", "x"), (2, "a", None), (2, "a", None)], "id int, t string, e string")
    assert [tuple(r) for r in checks.shared_ids(df, "id", ["t"]).collect()] == [(1, 2, 2)]
    assert tuple(checks.distinct_rows(df).first()) == (4, 3)
    assert checks.in_both(df, df.where("id = 2"), ["t", "e"]).count() == 2
    assert {r["column"]: r.n_missing for r in checks.missing_rates(df, ["t", "e"]).collect()} == {"t": 0, "e": 3}
    within = checks.leaked_within(spark.createDataFrame([(1, "xx yy zz"), (2, None)], "doc_id long, text string"), spark.createDataFrame([(7, "yy"), (8, "yy"), (9, " "), (10, "q")], "item_id long, text string"))
    assert sorted(map(tuple, within.collect())) == [(1, 7), (1, 8)]
    assert checks.off_band(spark.createDataFrame([("a b c", "x"), ("a", "b"), ("", "b")], "s string, g string"), "s", "g").count() == 1


def test_translator(spark):
    df = spark.createDataFrame([(0, "a", ""), (1, " ", ""), (2, "b", "c")], "i int, mar string, bhb string")
    upper = lambda: lambda chats, decoding: [c[-1]["content"].upper() for c in chats]
    told = lambda: lambda chats, decoding: [f"{len(c)} {c[0]['content']} {decoding.beams} {decoding.temperature}" for c in chats]
    got = translate.backfilled(df, "mar", "bhb", told, translate.short_prompt("bhb"), translate.Decoding(temperature=0.5)).where("i = 0").first()
    assert got.bhb == "2 Translate the text below to Bhili. 1 0.5"
    assert {r.i: r.bhb for r in translate.backfilled(df, "mar", "bhb", upper).collect()} == {0: "A", 1: "", 2: "c"}
    assert "Marathi (mr) to Bhili (bhb)" in translate.prompt("mar2bhb")
    with pytest.raises(KeyError):
        translate.language("zz")
    rows = spark.createDataFrame([("a", "s", "r", "p", "q", [["x", "y"]]), (None, "s2", "r", "p", "p", None)], "category string, source string, reference string, prediction_raw string, prediction_final string, post_edits array<array<string>>")
    got = translate.review_rows(rows).collect()
    assert [(r.changed_by_postedit, r.post_edits, r.num_edits) for r in got] == [("yes", "x -> y", 1)]
    assert translate.review_rows(rows, include_unedited=True).count() == 2


def test_batch_test_and_single_text(spark):
    rows = spark.createDataFrame([("7", "बोंड पीक", "x"), ("8", " ", "y")], "issue_id string, bhili_text string, gloss string")
    g = spark.createDataFrame([("बोंड", "कवठ")], "src string, tgt string")
    got = flows.batch_test(rows, g)
    assert got.columns == ["issue_id", "bhili_text", "gloss", "prediction_raw", "prediction_final", "glossary_edits"]
    assert sorted(tuple(r)[3:] for r in got.collect()) == [("", "", ""), ("बोंड पीक", "कवठ पीक", "बोंड->कवठ")]
    terms = {"बोंड": "कवठ"}
    assert flows.translate_one(" ", "bhb2mar", terms) == ("", "", "(enter a sentence)", "")
    assert flows.translate_one(" बोंड ", "bhb2mar", terms, reference="कवठ") == ("बोंड", "कवठ", "बोंड  ->  कवठ", "chrF++ (post-edited vs reference): 100.00")
    assert flows.translate_one("x", "bhb2mar", terms)[2:] == ("(no glossary substitutions fired)", "")


def test_models_that_are_missing(spark, tmp_path):
    (tmp_path / "a").mkdir()
    assert flows.with_models(spark, {"mar2bhb": str(tmp_path / "a"), "bhb2mar": str(tmp_path / "b")}) == (["mar2bhb"], ["bhb2mar"])


def test_one_model_for_each_worker(spark):
    """Batches of a worker share a model, whatever the number of tasks."""
    import uuid

    made = lambda: (lambda name: lambda chats, decoding: [name] * len(chats))(uuid.uuid4().hex)
    df = spark.range(40).select(F.lit("a").alias("mar")).repartition(20)
    assert translate.translated(df, "mar", made).select("prediction_raw").distinct().count() < 20


def test_shuffle_and_series(spark):
    df = spark.range(50)
    a, b = ([r.id for r in split.shuffled(x, ["id"]).collect()] for x in (df, df.repartition(7)))
    assert a == b and sorted(a) == list(range(50)) and a != list(range(50)) and a != [r.id for r in split.shuffled(df, ["id"], 1).collect()]
    rows = spark.createDataFrame([("beam", 2, 0.5), ("beam", 1, None), ("greedy", 1, 0.25)], "decoding string, checkpoint int, translation_rate double")
    assert [tuple(r) for r in reports.series(rows).collect()] == [("beam", 1, None), ("beam", 2, 50.0), ("greedy", 1, 25.0)]
    assert reports.series(rows, "greedy").count() == 1
    n = spark.createDataFrame([("b", 2, 1.5), ("a", 2, 50.0), ("c", 9, 2.0)], "category string, n long, chrf2pp double")
    assert [r.category for r in reports.largest_first(n).collect()] == ["c", "a", "b"]
    assert reports.category_text(n, "mar2bhb").split("\n")[1].endswith("chrF++=  2.0000  n=9")
    with pytest.raises(ValueError, match="more than 2"):
        reports.table_text(n, {"category": 9}, limit=2)


def test_training_set(spark):
    df = spark.createDataFrame([(i, f"शब्द एक {i}", f"कोपास दोन {i}") for i in range(20)], "id int, mar string, bhb string")
    got = flows.training_set(df, "mar2bhb", ["id"], targeted=df.limit(2), times=3, by_group="id")
    assert got.count() == 26 and got.groupBy("id").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert got.first().messages[0].role == "system"


def test_files(spark, tmp_path):
    lines = tmp_path / "p.jsonl"
    lines.write_text('{"source": "s", "post_edits": [["a", "b"]]}\n\n{"source": "t"}\n', encoding="utf-8")
    got = io.read_numbered_jsonl(spark, [str(tmp_path / "*.jsonl")]).orderBy("example_idx").collect()
    assert [(r.example_idx, r.source, r.post_edits) for r in got] == [(0, "s", [["a", "b"]]), (2, "t", None)]
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "q.jsonl").write_text("\n".join(["", *(json.dumps({"source": f"{i} é"}) for i in range(3000))]), encoding="utf-8")
    (tmp_path / "deep" / ".hidden.jsonl").write_text("{}")
    assert io.matching(spark, str(tmp_path / "**" / "*.jsonl")) == [str(tmp_path / "deep/er/q.jsonl"), str(lines)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")  # the file is many blocks
    got = io.read_numbered_jsonl(spark, [str(tmp_path / "deep" / "*" / "q.jsonl"), str(lines), str(tmp_path / "**" / "q.jsonl")])
    rows = sorted((r.file_no, r.example_idx, r.source) for r in got.collect())
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [(i + 1, f"{i} é") for i in range(3000)]
    assert rows == [(0, *x) for x in want] + [(1, 0, "s"), (1, 2, "t")] + [(2, *x) for x in want]
    with pytest.raises(FileNotFoundError):
        io.read_numbered_jsonl(spark, [str(tmp_path / "none*")])
    assert io.read_jsonl(spark, [str(lines), str(lines)], io.PREDICTION).count() == 4
    tsv = tmp_path / "r.tsv"
    tsv.write_text('dp_id\tid\tmarathi\tvalidated_translation\n1\t7\t" a ""q"" "\tb\n\t\t\t\n', encoding="utf-8")
    raw = io.read_tsv(spark, str(tsv), ["id", "marathi", "validated_translation"])
    assert [tuple(r) for r in io.convert_raw(raw, "c").collect()] == [("7", "c", "", "", 'a "q"', "b")]
    with pytest.raises(ValueError, match="missing"):
        io.read_tsv(spark, str(tsv), ["other"])
    out = str(tmp_path / "out")
    io.write_jsonl(spark.createDataFrame([("क", None)], "a string, b string"), out, single=True)
    assert json.loads(next((tmp_path / "out").glob("part*")).read_text(encoding="utf-8")) == {"a": "क", "b": None}
    assert io.csv_text(raw.limit(0), bom=True).startswith("\ufeffdp_id")
    sheet = spark.createDataFrame([(' a "b"\n', "c, d ")], "x string, y string")
    io.write_csv(sheet, str(tmp_path / "sheet"))
    assert io.read_csv(spark, str(tmp_path / "sheet")).collect() == sheet.collect()
    io.write_csv_file(sheet, str(tmp_path / "sheet.csv"), bom=True)
    assert (tmp_path / "sheet.csv").read_bytes() == b'\xef\xbb\xbfx,y\r\n" a ""b""\n","c, d "\r\n'
    io.write_json_document(spark, {"k": "क"}, str(tmp_path / "k.json"))
    assert json.loads((tmp_path / "k.json").read_text(encoding="utf-8")) == {"k": "क"}
    assert {r.file_no: r["count"] for r in io.read_jsonl(spark, [str(lines), str(tmp_path / "deep/er/q.jsonl"), str(lines)], io.PREDICTION).groupBy("file_no").count().collect()} == {0: 2, 1: 3000, 2: 2}
    assert io.split_paths("x/y.jsonl") == ("x/y_train.jsonl", "x/y_test.jsonl")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text(json.dumps({"id": "1", "eng": "Spray it", "mar": GOOD_M, "bhb": GOOD_B}) + "\n", encoding="utf-8")
    rows = incremental.checked_stream(spark, str(tmp_path / "in"))
    q = incremental.start(rows, str(tmp_path / "out"), str(tmp_path / "progress"))
    q.awaitTermination(60)
    assert [r.reasons for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [[]]
