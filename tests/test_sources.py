"""Readers, writers and streams over small files."""

import json

import pytest

from foliograph import api
from foliograph.functions import udf
from foliograph.operators import models, numbering
from foliograph.schema import BLOCK_SCHEMA, conform
from foliograph.sources import readers, writers
from foliograph.streaming import ingest


def test_csv_of_any_delimiter(spark, tmp_path):
    (tmp_path / "a.csv").write_text('doc_id,block_id,text,font_size\n1,0,"one, two",10.5\n', "utf-8-sig")
    (tmp_path / "b.csv").write_text("doc_id;block_id;text;page\n2;0;drei, vier;3\n", "utf-8")
    (tmp_path / "c_with_predictions.csv").write_text("doc_id,text\n9,no\n", "utf-8")
    rows = {r.doc_id: r for r in readers.blocks_csv(spark, str(tmp_path)).collect()}
    assert set(rows) == {1, 2} and rows[1].text == "one, two" and rows[2].text == "drei, vier" and rows[2].page == 3
    assert rows[1].font_size == 10.5 and rows[2].font_size is None and rows[1].source_file == "a.csv"
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        readers.blocks_csv(spark, str(tmp_path / "none"))


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", é\nline'), (2, "")], "block_id long, text string")
    for bom in (True, False):
        writers.blocks_csv(df, str(tmp_path / f"out{bom}"), bom)
        parts = [p.read_bytes() for p in (tmp_path / f"out{bom}").glob("part-*") if p.stat().st_size]
        assert all(p.startswith(b"\xef\xbb\xbf" * bom + b'"block_id","text"\n') for p in parts)
        assert sorted((r.block_id, r.text or "") for r in readers.blocks_csv(spark, str(tmp_path / f"out{bom}")).collect()) == [(1, 'a "quoted", é\nline'), (2, "")] if not bom else True
    writers.blocks_csv(df, str(tmp_path / "out"), False)
    assert sorted((r.block_id, r.text or "") for r in readers.blocks_csv(spark, str(tmp_path / "out")).collect()) == [(1, 'a "quoted", é\nline'), (2, "")]


LINE = "\t".join(["word", "1", "2", "3", "4", "0", "0", "0", "Font", "title"])


def test_tokens_and_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "x_3.txt").write_text(LINE + "\nshort\tline\n" + LINE.replace("word", "##LTLine##") + "\n")
    rows = readers.tokens(spark, str(source)).collect()
    assert [(r.text, r.label, r.page, r.x0, r.y1) for r in rows] == [("word", "title", 4, 1.0, 4.0)]
    table, log = str(tmp_path / "table"), str(tmp_path / "log")
    for name in ("", "y_0.txt", "z.txt"):
        if name:
            (source / name).write_text(LINE.replace("word", name) + "\n")
        ingest.append(ingest.token_stream(spark, str(source)), table, log).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(table).collect()) == ["word", "y_0.txt", "z.txt"]


def test_stream_of_documents(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a_0.txt").write_text(LINE + "\n" + LINE.replace("word", "1. Scope") + "\n")
    ingest.append_documents(ingest.token_stream(spark, str(source)), str(tmp_path / "t"), str(tmp_path / "log"), numbering.numbering).awaitTermination()
    assert sorted((r.text, r.numbered) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [("1. Scope", True), ("word", False)]


def test_documents_and_spans(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"good")
    (tmp_path / "b.pdf").write_bytes(b"bad")
    (tmp_path / "c.txt").write_bytes(b"other")

    def extract(content):
        if content == b"bad":
            raise ValueError("broken file")
        return [{"page": 1, "line_no": 0, "span_no": 0, "text": content.decode(), "size": 12.0}]

    found = readers.documents(spark, str(tmp_path))
    assert sorted(r.name for r in found.collect()) == ["a.pdf", "b.pdf"]
    got = {r.text: r.error for r in readers.spans(found, extract).collect()}
    assert got == {"good": None, None: "ValueError: broken file"}


def test_reports_settings_and_models(spark, tmp_path):
    (tmp_path / "r1.json").write_text(json.dumps({"timestamp": "t", "decision_breakdown": {"keep_good_score": 3, "filtered_hard_criteria": 1}}, indent=1))
    rows = readers.reports(spark, str(tmp_path)).collect()
    assert {r.reduction_rate for r in rows} == {None}
    assert sorted((r.filter_decision, r.blocks) for r in rows) == [("filtered_hard_criteria", 1), ("keep_good_score", 3)]
    (tmp_path / "s").mkdir()
    (tmp_path / "s/config.json").write_text('{"a": {\n"b": 1}}')
    assert readers.settings(spark, str(tmp_path / "s")).first().a.b == 1
    listing = spark.createDataFrame([("m_retrained", 1000), ("m_trained", 900_000), ("plain", 999_000)], "name string, mtime long")
    assert readers.latest_model(listing).first().name == "m_retrained"
    assert models.training_seconds(2000, 10000, 100) == 1000
    base = {"pipeline_settings": {"confidence_threshold": 0.92}, "model_params": {"class_weight": {"1": 95}}, "precision_filters": {"min_font_size_percentile": 70, "max_word_count": 12}}
    hard = models.adjusted(base, 70, {"excluded_long_sentences": 31})
    assert (hard["pipeline_settings"]["confidence_threshold"], hard["model_params"]["class_weight"]["1"], hard["precision_filters"]) == (0.95, 100, {"min_font_size_percentile": 75, "max_word_count": 10})
    soft = models.adjusted(base, 10)
    assert abs(soft["pipeline_settings"]["confidence_threshold"] - 0.90) < 1e-9 and soft["model_params"] == base["model_params"] and soft["precision_filters"] == base["precision_filters"]
    assert models.adjusted({"pipeline_settings": {"confidence_threshold": 0.76}}, 0)["pipeline_settings"]["confidence_threshold"] == 0.75
    assert models.adjusted(base, 40) == base and base["precision_filters"]["max_word_count"] == 12


def test_outline_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 1, "Ünï Report", 24.0), (1, 1, 1, "1. Introduction", 14.0)], "doc_id long, block_id long, page int, text string, font_size double")
    out = api.outlines(df)
    assert json.loads(writers.outline_text(out).first().json)["title"] == "Ünï Report"
    assert writers.document_files(out.select("doc_id", "title", "outline"), str(tmp_path / "files")) == 1
    text = (tmp_path / "files/1.json").read_text("utf-8")
    assert list((tmp_path / "files").iterdir()) == [tmp_path / "files/1.json"] and '\n  "title": "Ünï Report"' in text and json.loads(text)["outline"][0]["level"]
    writers.outlines_json(out, str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o")).first().title == "Ünï Report"


def test_conform(spark):
    df = conform(spark.createDataFrame([(None, float("nan"), 2)], "text string, font_size double, page_num int"))
    r = df.first()
    assert (r.text, r.font_size, r.page, r.heading_confidence, r.doc_id) == ("", None, 2, 0.8, 0)
    assert {"doc_id", "block_id", "text", "page"} <= {f.name for f in BLOCK_SCHEMA.fields}


def test_forest_and_udfs(spark):
    df = spark.range(300).selectExpr("id", "cast(id % 10 as double) as a", "cast(id % 3 as double) as b", "if(id % 2 = 0, 'x', 'y') as font", "cast(id % 10 > 6 as int) as is_heading")
    model = models.train_forest(df, ["a", "b"], settings=models.ForestSettings(trees=5, depth=3, positive_weight=1.0), texts=["font"])
    out = models.predict(model, df)
    assert out.where("is_heading = is_heading_pred").count() > 290 and not [c for c in out.columns if c.startswith("__")]
    assert models.importances(model, ["a", "b", "font"])[0][0] == "a"
    row = spark.createDataFrame([("ﬁne",), (None,)], "t string").select(udf.nfkc("t").alias("n"), udf.tag_counts(lambda t: ["NOUN", "X"] if t else [])("t").alias("c")).collect()
    assert row[0].n == "fine" and row[1].n is None and row[0].c.num_nouns == 1 and row[0].c.num_other_pos == 1


def test_bundle_predict_and_retrain(spark, tmp_path):
    columns = ["text_length", "word_count", "font_size_normalized", "bold"]
    rows = [(d, i, 1 + i // 20, ("Heading Text" if i % 5 == 0 else "plain words of a line that goes on") + f" {i}", 20.0 if i % 5 == 0 else 10.0, i % 5 == 0, int(i % 5 == 0)) for d in range(4) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, block_id long, page int, text string, font_size double, bold boolean, is_heading int")
    bundle = api.train(df, columns, models.ForestSettings(trees=5, depth=3, positive_weight=1.0), "v1")
    models.save_bundle(bundle, str(tmp_path / "b"))
    again = models.load_bundle(str(tmp_path / "b"))
    assert (again.columns, again.threshold, again.version) == (columns, bundle.threshold, "v1") and 0.1 <= bundle.threshold <= 0.78
    found, reports = api.predict_headings(df.drop("is_heading"), models.Bundle(again.model, [*columns, "tfidf_0"][:4], again.threshold))
    got = {(r.doc_id, r.block_id): r for r in found.collect()}
    assert len(got) == 240 and {"filter_decision", "heading_confidence", "broken_decision"} <= set(found.columns)
    assert all((r.filter_decision != "not_predicted") == (k[1] % 5 == 0) for k, r in got.items())
    for r in reports.collect():
        own = [x for k, x in got.items() if k[0] == r.doc_id]
        assert r.filtering_summary.total_blocks == 60 == r.document_stats.total_blocks and r.filtering_summary.original_predictions == 12
        assert sum(r.decision_breakdown.values()) == 60 and r.examples.filtered == [] and len(r.examples.preserved) == min(10, r.filtering_summary.final_predictions)
        assert [e.text for e in r.examples.preserved] == [f"Heading Text {i}" for i in range(0, 60, 5)][: len(r.examples.preserved)]
        assert r.thresholds.high_confidence == 0.8 and len(own) == 60
    said = spark.createDataFrame([("r1", "filtered_low_score", 150, 70.0), ("r1", "keep_good_score", 3, 70.0)], "doc_id string, filter_decision string, blocks long, reduction_rate double")
    settings = {"pipeline_settings": {"confidence_threshold": 0.5}, "model_params": {"n_estimators": 5, "max_depth": 3, "class_weight": {"1": 1}}}
    retrained, record = api.retrain(df, said, settings, columns, reviewed=df.where("doc_id = 0"), version="v2")
    assert retrained.version == "v2" and record["data_sources"] == {"original_labels": 240, "reviewed_corrections": 60} and record["total_headings"] == 60
    assert record["adjusted_config"]["model_params"]["class_weight"]["1"] == 11 and record["filtering_feedback"]["reasons"] == {"filtered_low_score": 150}
    assert record["performance_metrics"]["f1_score"] > 0.9 and record["performance_metrics"]["roc_auc"] > 0.9
    assert models.selected(df, ["page", "font_size"], most=1, keep=1) == ["font_size"]


def test_classes_and_status(spark, tmp_path):
    df = spark.range(300).selectExpr("cast(id % 3 as int) as heading_level", "cast(id % 3 as double) as a", "cast(id % 7 as double) as b")
    model = models.train_forest(df, ["a", "b"], "heading_level", models.ForestSettings(trees=5, depth=4, positive_weight=1.0))
    out = models.predict_class(model, df)
    assert out.where("predicted_level = heading_level").count() == 300 and len(out.first().class_probabilities) == 3
    for name in ("a.pdf", "b.pdf", "c.txt"):
        (tmp_path / name).write_text("x")
    got = {(r.kind, r.name): r.files for r in readers.status(spark, {"input": f"{tmp_path}/*.pdf"}, f"{tmp_path}/*.txt").collect()}
    assert got == {("folder", "input"): 2, ("model", "c.txt"): 1}


def test_lines_completion_and_views(spark):
    spans = spark.createDataFrame([(1, 1, 800.0, 0, 0, "ﬁne\x01 text", 12.0, "F", 0, 0, 5.0, 80.0, 9.0, 92.0)], "doc_id long, page int, page_height double, line_no long, span_no long, text string, size double, font string, flags int, color int, x0 double, y0 double, x1 double, y1 double")
    line = api.rule_lines(spans).first()
    assert (line.text, line.line_position_on_page, line.relative_font_size, line.block_id) == ("ﬁne text", 0.1, 1.0, 0)
    assert api.legacy_lines(spans).first().text == "fine\x01 text"
    df = spark.createDataFrame([(1, 0, 1, "One", 1), (1, 1, 1, "two words", 0)], "doc_id long, block_id long, page int, text string, is_heading int")
    done = api.completed(df, udf.tag_counts(lambda t: ["NOUN"] * len(t.split()), english_only=True)).orderBy("block_id").collect()
    assert [(r.distance_to_previous_heading, r.num_nouns, r.num_verbs) for r in done] == [(0, 1, 0), (1, 2, 0)]
    assert api.completed(spark.createDataFrame(done)).orderBy("block_id").collect()[1].num_nouns == 2
    names = api.register(spark, df, "t")
    assert "t_numbering" in names and spark.sql("select count(*) as n from t_rule_filter where rule_reject").first().n >= 0
    tags = spark.createDataFrame([("Deep Learning",), ("He runs",), (None,)], "text string").select("text", udf.heading_tags(lambda t: [("NOUN", "root")] * 2 if t == "Deep Learning" else [("PRON", "nsubj"), ("VERB", "root")])("text").alias("p")).select("text", "p.*")
    from foliograph.operators import metadata
    from foliograph.plans import SparkRelation

    got = {r.text: (r.pos_heading_score, r.pos_patterns, r.pos_violations) for r in metadata.tagged(SparkRelation(tags)).df.collect()}
    assert got == {"Deep Learning": (2.0, "favorable_pos", 0), "He runs": (-2.0, "unfavorable_pos;sentence_structure", 3), None: (0.0, "", 0)}


def test_tfidf_settings_follow_the_size(spark):
    few = spark.createDataFrame([(1, 0, "Alpha beta alpha"), (1, 1, "beta"), (1, 2, "the")], "doc_id long, block_id long, text string")
    got = {(r.block_id, r.term): r.weight for r in api.tfidf(few).collect()}
    assert {t for _, t in got} <= {"alpha", "beta", "alpha beta", "beta alpha"} and len({t for _, t in got}) == 3 and got[1, "beta"] == 1.0
    only = spark.createDataFrame([(1, 0, "the the of"), (1, 1, None)], "doc_id long, block_id long, text string")
    assert {r.term: round(r.weight, 6) for r in api.tfidf(only).collect()} == {"the": round(2 / 5**0.5, 6), "of": round(1 / 5**0.5, 6)}
    assert api.tfidf(spark.createDataFrame([], few.schema)).count() == 0


def test_forest_grows_on_distinct_rows(spark, monkeypatch):
    import numpy as np
    from pyspark.ml.classification import RandomForestClassifier

    from foliograph.operators import forest

    df = spark.range(6000).selectExpr("id % 7 AS a", "CAST(id % 40 AS DOUBLE) AS b", "id % 3 = 0 AS c", "CAST(id % 7 > 3 AND id % 40 < 25 OR pmod(hash(id), 10) = 0 AS INT) AS is_heading").repartition(3)
    own, seen, settings = RandomForestClassifier.fit, [], models.ForestSettings(trees=20, depth=6, positive_weight=3.0)

    def fit(self, rows, *args):
        seen.append(rows.count())
        return own(self, rows, *args)

    monkeypatch.setattr(RandomForestClassifier, "fit", fit)
    model = models.train_forest(df, ["a", "b", "c"], settings=settings)
    assert seen == [2]  # one row a class, for the description
    again = models.train_forest(df.repartition(5), ["a", "b", "c"], settings=settings)
    assert again.stages[-1].toDebugString.split("\n", 1)[1] == model.stages[-1].toDebugString.split("\n", 1)[1]
    tables = {}
    for most in (forest.DISTINCT, 10):
        monkeypatch.setattr(forest, "DISTINCT", most)
        fitted = models.train_forest(df, ["a", "b", "c"], settings=settings)
        tables[most] = {(r.a, r.b, r.c): r.heading_confidence for r in models.predict(fitted, df.select("a", "b", "c").distinct()).collect()}
        trees = fitted.stages[-1].trees
        assert len(trees) == 20 and max(t.depth for t in trees) == 6
    assert seen[2:] == [2, 6000]  # more distinct rows than that: all of them, row by row
    by_count, by_row = tables.values()
    assert max(abs(by_count[k] - by_row[k]) for k in by_row) < 0.2 and abs(np.mean([by_count[k] - by_row[k] for k in by_row])) < 0.02


def test_trees_hold_every_copy_of_a_row():
    import numpy as np

    from foliograph.operators import forest

    rng = np.random.default_rng(3)
    codes, counts = np.array([(i, j) for i in range(8) for j in range(40)], np.uint8), rng.integers(0, 50, (320, 3))
    cuts = [forest.thresholds(np.arange(8.0), np.ones(8)), forest.thresholds(np.arange(40.0), np.ones(40))]
    assert cuts[0].tolist() == [i + 0.5 for i in range(7)] and len(cuts[1]) <= 31
    codes[:, 1] = np.searchsorted(cuts[1], codes[:, 1])
    settings = models.ForestSettings(trees=1, depth=9, leaf=4)
    nodes = forest.grown(codes, counts, np.array([1.0, 2.0, 5.0]), cuts, settings, 0)
    drawn = np.random.default_rng([settings.seed, 0]).poisson(settings.share * counts)
    assert nodes[0]["rawCount"] == drawn.sum() and nodes[0]["impurityStats"] == (drawn * [1.0, 2.0, 5.0]).sum(0).tolist()
    for k, n in enumerate(nodes):
        assert n["id"] == k and n["rawCount"] >= 4
        if n["leftChild"] >= 0:
            a, b = nodes[n["leftChild"]], nodes[n["rightChild"]]
            assert k < a["id"] < b["id"] and a["rawCount"] + b["rawCount"] == n["rawCount"] and n["gain"] > 0
            assert np.allclose(np.add(a["impurityStats"], b["impurityStats"]), n["impurityStats"])
            assert a["leftChild"] >= 0 or b["leftChild"] >= 0 or a["prediction"] != b["prediction"]
