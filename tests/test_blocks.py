"""Operators over documents: windows, merges, features and measures, against plain Python."""

import math
import statistics

import pytest

from foliograph import api, queries
from foliograph.operators import assembly, evaluation, features, filtering, merging, metadata, sequential
from foliograph.plans import SparkRelation
from foliograph.schema import conform

COLUMNS = "doc_id long, block_id long, page int, text string, font_size double, line_position_on_page double, is_heading int, heading_level int, is_heading_pred int, heading_confidence double"


def frame(spark, rows, columns=COLUMNS):
    return SparkRelation(spark.createDataFrame(rows, columns))


def block(i, text, page=1, size=10.0, pos=None, head=0, level=0, pred=0, conf=0.5, doc=1):
    return (doc, i, page, text, size, float(i) if pos is None else pos, head, level, pred, conf)


def in_order(r, *names):
    return [tuple(x[n] for n in names) if len(names) > 1 else x[names[0]] for x in r.df.orderBy("doc_id", "block_id").collect()]


def test_fonts(spark):
    sizes = [10.0, 10.0, 12.0, 24.0, None, 8.0]
    r = metadata.fonts(frame(spark, [block(i, "t", size=s) for i, s in enumerate(sizes)] + [block(0, "t", size=9.0, doc=2)]))
    got = in_order(r, "font_size_percentile_rank", "font_category", "font_size_jump", "font_size_std")
    assert [round(g[0], 6) if g[0] else None for g in got[:6]] == [50.0, 50.0, 80.0, 100.0, None, 20.0]
    assert [g[1] for g in got[:6]] == ["small", "small", "medium", "very_large", "small", "small"]
    assert [g[2] for g in got[:6]] == [False, False, False, True, False, False]
    assert math.isclose(got[0][3], statistics.stdev([s for s in sizes if s])) and got[6][3] is None and got[6][1] == "very_large"


def test_position_neighbours_and_blank_text(spark):
    long = "word " * 12
    r = metadata.positions(frame(spark, [block(0, "Short one"), block(1, long), block(2, "Short"), block(3, "Short"), block(4, None), block(5, long, page=2)]))
    assert in_order(r, "position_patterns") == ["page_top;isolated_short_text", "page_top", "page_top;isolated_short_text", "page_top", "page_bottom", "page_bottom"]
    assert in_order(r, "position_score") == [3, 2, 3, 2, -1, -1]


def test_first_heading_is_promoted_once(spark):
    base = metadata.comprehensive(frame(spark, [block(i, t, size=s) for i, (t, s) in enumerate([("a b c", 10.0), ("1.1 Two Words", 10.0), ("1.2 Two Words", 10.0), ("plain text here", 10.0)])]))
    levels = in_order(base, "recommended_level", "level_confidence", "heading_likelihood")
    likely = [x for x in levels if x[2] >= 0.3]
    assert likely and likely[0][0] == "H1"
    assert all(x[0] in ("H1", "H2", "H3") for x in levels) and all(0 <= x[2] <= 1 for x in levels)


def test_context(spark):
    rows = [block(i, "t", size=s, pred=p, pos=float(i)) for i, (s, p) in enumerate([(10.0, 1), (10.0, 0), (20.0, 1), (None, 1), (5.0, 0), (30.0, 0), (30.0, 0), (10.0, 0)])]
    got = in_order(filtering.context(frame(spark, rows)), "font_size_context", "heading_density", "position_context")
    for i in range(len(rows)):
        near = [j for j in range(max(0, i - 2), min(len(rows), i + 3)) if j != i]
        sizes, own = [rows[j][4] for j in near], rows[i][4]
        mean = None if None in sizes or own is None else sum(sizes) / len(sizes)
        want = "normal" if mean is None else "larger" if own > 1.2 * mean else "smaller" if own < 0.8 * mean else "normal"
        assert got[i][0] == want and math.isclose(got[i][1], sum(rows[j][8] for j in near) / len(near)), i
    assert [g[2] for g in got] == ["top"] * 4 + ["bottom"] * 4
    alone = filtering.context(frame(spark, [block(0, "t", pred=1)])).df.first()
    assert alone.heading_density == 0 and alone.font_size_context == "normal"


def test_decisions(spark):
    texts = ["Introduction", "docker", "the long way, by and by,", "1. Scope"]
    rows = [block(i, t, pred=1, conf=c) for i, t in enumerate(texts) for c in [(0.9, 0.1, 0.2, 0.6)[i]]] + [block(9, "not predicted")]
    r = filtering.decide(filtering.enhanced_score(frame(spark, rows)))
    got = dict(in_order(r, "text", "filter_decision"))
    assert got["Introduction"] == "keep_high_confidence" and got["not predicted"] == "not_predicted"
    assert set(got.values()) <= {"not_predicted", "filtered_hard_criteria", "filtered_soft_criteria", "keep_high_confidence", "keep_good_score", "keep_medium_quality", "keep_low_quality"}
    s = filtering.summary(r).df.first()
    assert s.total_blocks == 5 and s.original_predictions == 4 and s.filtered_count == s.original_predictions - s.final_predictions


def test_title_and_subtitle(spark):
    rows = [block(0, "abc", pred=1), block(1, "docker engine", pred=1), block(2, "A Great Title", pred=1), block(3, "no heading"), block(4, "Word", pred=1), block(5, "Methods and More Matters", pred=1), block(6, "Another Long Title There", pred=1)]
    roles = in_order(merging.document_title(frame(spark, rows)), "title_role")
    assert roles[2] == "document_title" and roles.count("document_title") == 1 and roles[0] is None and roles[1] is None
    late = [block(i, "text here") for i in range(100)] + [block(100, "A Great Title", pred=1)]
    assert set(in_order(merging.document_title(frame(spark, late)), "title_role")) == {None}
    assert in_order(merging.document_title(frame(spark, late[1:])), "title_role")[-1] == "document_title"


def test_prefixes_do_not_cascade(spark):
    rows = [block(0, "A", pred=1), block(1, "B.", pred=1), block(2, "Title", pred=1), block(3, "2.", pred=1), block(4, "lower", pred=1), block(5, "3", pred=1), block(6, "summary of it", pred=1), block(7, "4", pred=1), block(8, "Next", page=2, pred=1), block(9, "5", pred=0, page=2), block(10, "Six", pred=1, page=2)]
    got = in_order(merging.merge_prefixes(frame(spark, rows)), "merged_text", "is_heading_pred", "merge_decision")
    assert got[0][1:] == (0, "merged_into_next") and got[1] == ("A B.", 0, "merged_into_next") and got[2] == ("B. Title", 1, "merged_consecutive")
    assert got[4][0] == "lower" and got[6][0] == "3 summary of it" and got[8][0] == "Next" and got[10][0] == "Six"


def test_distance(spark):
    heads = [0, 1, 0, 0, 1, 0]
    r = frame(spark, [block(i, "t", head=h) for i, h in enumerate(heads)])
    assert in_order(merging.distance(r), "distance_to_previous_heading") == [None, 0, 1, 2, 0, 1]
    assert in_order(merging.distance(r, "0"), "distance_to_previous_heading") == [0, 0, 1, 2, 0, 1]


@pytest.mark.parametrize("text,parts", [("Intro: the text", ["Intro:", "the text"]), ("1.1 Scope. More", ["1.1 Scope.", "More"]), ("No mark", ["No mark"]), ("Ends.", ["Ends."]), (".5 and, so", [".5 and,", "so"]), ("a,b;c", ["a,", "b;c"]), ("10:30", ["10:30"]), ("x 1. y", ["x 1. y"]), (": lead", [":", "lead"])])
def test_split(spark, text, parts):
    rows = merging.split_rows(frame(spark, [block(0, text, head=1, level=2)])).df.orderBy("part").collect()
    assert [r.text for r in rows] == parts and [(r.is_heading, r.heading_level) for r in rows] == [(1, 2), (0, 0)][: len(parts)]


def test_combine_runs(spark):
    rows = [block(i, t, head=h, level=lv) for i, (t, h, lv) in enumerate([("a", 1, 1), ("b", 1, 1), ("c", 1, 2), ("d", 0, 0), ("e", 0, 0), ("f", 1, 2), ("g", 1, 0), ("h", 1, 0)])]
    assert in_order(merging.combine_runs(frame(spark, rows)), "text", "blocks") == [("a b", 2), ("c", 1), ("d", 1), ("e", 1), ("f", 1), ("g", 1), ("h", 1)]


def test_broken_headings(spark):
    words = ["Project", "India", "Plan of Work", "Alpha", "the", "Beta", "Gamma", "Delta", "Epsilon", "Zeta", "x"]
    df = frame(spark, [block(i, w, pred=1) for i, w in enumerate(words)]).df
    got = {r.block_id: (r.text, r.is_heading_pred, r.broken_decision) for r in api.merge_broken(df).collect()}
    assert got[0] == ("Project India Plan of Work", 1, "merged_broken_heading") and got[1][1:] == (0, "merged_into_broken_heading") and got[2][1] == 0
    assert got[3] == ("Alpha", 1, None) and got[5] == ("Beta Gamma Delta Epsilon", 1, "merged_broken_heading") and got[9] == ("Zeta", 1, None)


def test_broken_headings_across_batches(spark):
    import random

    rng = random.Random(2)
    pool = ["Alpha", "Beta", "the", "Gamma ray", "Delta", "x", "And", "Plan of Work", None, "Ab"]
    rows = [block(i, rng.choice(pool), page=1 + i // 9, pred=int(rng.random() < 0.8), doc=d) for d, n in enumerate([1, 2, 3, 4, 37, 50]) for i in range(n)]
    df = frame(spark, rows).df
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, found = spark.conf.get(key), []
    for size in ("1", "2", "5", "1000"):
        spark.conf.set(key, size)
        found.append(sorted(map(str, api.merge_broken(df).collect())))
    spark.conf.set(key, before)
    assert all(f == found[0] for f in found) and "merged_into_broken_heading" in str(found[0]) and len(found[0]) == len(rows)


def test_sequences(spark):
    docs = {1: ["1. A", "1.1 B", "1.2 C", "2. D", "2.3 E"], 2: ["4. A", "5. B", "5.1.1 C"], 3: ["1. A", "3. B"], 4: ["plain words"], 5: ["2.1 A", "2.2 B"], 6: ["1. A", "1.1 B"]}
    rows = [block(i, t, doc=d) for d, texts in docs.items() for i, t in enumerate(texts)]
    got = {r.doc_id: (r.numbered_blocks, r.has_proper_hierarchy, r.has_sequential_numbering, r.is_consistent) for r in api.check_sequences(frame(spark, rows).df).collect()}

    def brute(texts):
        last, good, proper, level, n = {}, True, True, 0, 0
        for t in texts:
            number = t.split()[0].rstrip(".")
            if not number.replace(".", "").isdigit():
                continue
            n += 1
            parts = number.split(".")
            proper, level = proper and len(parts) <= level + 1, len(parts)
            for place, part in enumerate(map(int, parts)):
                if place not in last or part == last[place] + 1:
                    last[place] = part
                else:
                    good = False
        return n, proper, good, proper and good

    assert got == {d: brute(texts) for d, texts in docs.items()}


def test_corpus_labels(spark):
    texts = [("1:Intro", "x"), ("1.Intro", "x"), ("1 Intro", "x"), ("1Intro", "x"), ("1.2.3 " + "w" * 100, "x"), ("Body", "section"), ("b" * 100, "section"), ("1. T", "title"), (" 2. S" + " " * 120, "x"), ("plain", "x")]
    df = spark.createDataFrame([(1, i, *t) for i, t in enumerate(texts)], "doc_id long, block_id long, text string, label string")
    assert in_order(merging.corpus_level(SparkRelation(df)), "heading_level") == [2, 2, 2, 0, 0, 2, 0, 1, 2, 0]


def test_retraining_features(spark):
    texts = ["Why?", "• a", "◦b", "- x", "3. Scope", "3. scope", " 12.  of", "see a.ORG", "ftp://x", "word " * 25, "z" * 99 + ".", "y" * 100 + ".", None]
    r = features.retraining_features(frame(spark, [block(i, t) for i, t in enumerate(texts)]), {"excluded_urls": 21, "excluded_long_sentences": 31})
    assert in_order(r, "is_question") == [1] + [0] * 12
    assert in_order(r, "is_list_item") == [0, 1, 1, 0, 0, 1, 1, 0, 0, 0, 0, 0, 0]
    assert in_order(r, "enhanced_url_detection") == [0] * 7 + [1, 1] + [0] * 4
    assert in_order(r, "is_long_sentence") == [0] * 11 + [1, 0]
    few = features.retraining_features(frame(spark, [block(0, "t")]), {"excluded_urls": 20, "excluded_long_sentences": 30})
    assert not few.has("enhanced_url_detection") and not few.has("is_long_sentence")


def test_feedback_of_reports(spark):
    rows = [("a", "filtered_low_score", 90, 40.0), ("a", "keep_good_score", 9, 40.0), ("b", "filtered_low_score", 11, 70.0), ("b", "excluded_urls", 500, 70.0), ("c", "not_predicted", 5, None)]
    r = SparkRelation(spark.createDataFrame(rows, "doc_id string, filter_decision string, blocks long, reduction_rate double"))
    got = evaluation.feedback(r).df.first()
    assert got.reports == 3 and math.isclose(got.average_reduction_rate, 110 / 3) and got.recommendations == "Many predictions filtered due to low scores - improve feature engineering"
    assert {(x.reason, x.kind, x.blocks) for x in evaluation.feedback_reasons(r).df.collect()} == {("filtered_low_score", "exclusion", 101), ("keep_good_score", "preservation", 9)}


def test_training_rows_are_of_two_decisions(spark):
    rows = [(*block(i, "t", conf=c), d) for i, (c, d) in enumerate([(0.95, "keep_high_confidence"), (0.85, "keep_high_confidence"), (0.5, "filtered_low_score"), (0.7, "filtered_low_score"), (0.1, "filtered_hard_criteria")])]
    r = frame(spark, rows, COLUMNS + ", filter_decision string")
    assert in_order(evaluation.training_rows(r), "block_id", "is_heading", "data_source") == [(0, 1, "high_conf_preserved"), (2, 0, "high_conf_filtered")]
    both = evaluation.training_union(r.where("block_id = 1"), r.where("block_id = 3"), r)
    assert sorted(x.data_source for x in both.df.collect()) == ["high_conf_filtered", "high_conf_preserved", "original_labels", "reviewed_corrections"]


def test_class_report_and_macro_auc(spark):
    pairs = [(1, 1), (1, 2), (2, 2), (2, 2), (3, 1)]
    df = spark.createDataFrame([(t, p, 0.9 if t == 1 else 0.2, float(p)) for t, p in pairs], "heading_level int, predicted_level int, p1 double, p2 double")
    got = {r.label: (r.support, r.predicted_blocks, r.precision, r.recall) for r in evaluation.class_report(SparkRelation(df)).df.collect()}
    assert got == {1: (2, 2, 0.5, 0.5), 2: (2, 3, 2 / 3, 1.0), 3: (1, 0, 0.0, 0.0)}
    area = lambda k, at: sum(1.0 if a[at] > b[at] else 0.5 if a[at] == b[at] else 0.0 for a in rows if a[0] == k for b in rows if b[0] != k) / sum(1 for a in rows if a[0] == k for b in rows if b[0] != k)
    rows = [tuple(r) for r in df.collect()]
    assert math.isclose(evaluation.macro_auc(SparkRelation(df), "heading_level", {1: "p1", 2: "p2"}).df.first().macro_auc, (area(1, 2) + area(2, 3)) / 2)


def test_page_blocks_hold_whole_elements(spark, tmp_path):
    from foliograph.sources import blocks

    html = '<title>T</title><!-- <p>no --><script>"<p>no"</script><h2 class="x">A <i>b</i></h2><p>one <b>two</b> three<br>four<ul><li id=1><a href="/x">link</a> more</li></ul><P style="a">five</P><footer>end</footer>'
    spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    rows = blocks.page(blocks.SparkTables(spark, str(tmp_path))).df.orderBy("block_id").collect()
    assert [(r.tag, r.text) for r in rows] == [("title", "T"), ("h2", "A b"), ("p", "one two three four"), ("li", "link more"), ("p", "five"), ("footer", "end")]


def test_outline_merge():
    def run(*entries):
        rows = [{"doc_id": 1, "place": i, "level": lv, "text": t, "page": p} for i, (t, lv, p) in enumerate(entries)]
        return [(r["text"], r["level"]) for r in sequential.outline_merge(iter(rows))]

    assert run(("1.", "H3", 1), ("Scope of it", "H1", 1), ("2", "H2", 1), ("lower", "H2", 1)) == [("1. Scope of it", "H1"), ("2", "H2"), ("lower", "H2")]
    assert run(("Alpha", "H1", 1), ("Beta", "H2", 1), ("Gamma", "H2", 1), ("Delta", "H2", 1), ("Last", "H3", 1)) == [("Alpha Beta Gamma Delta", "H1"), ("Last", "H3")]
    assert run(("A.", "H1", 1), ("Title", "H2", 2)) == [("A.", "H1"), ("Title", "H2")]
    assert run(("Ab", "H1", 1), ("C d", "H2", 1)) == [("Ab", "H1"), ("C d", "H2")] and run() == []


def test_span_assembly(spark):
    spans = spark.createDataFrame([(1, 1, 800.0, 0, 1, " b ", 12.0, "F", 2, 0, 5.0, 1.0, 9.0, 3.0), (1, 1, 800.0, 0, 0, "a", 10.0, "G", 5, 1, 1.0, 0.0, 4.0, 2.0), (1, 1, 800.0, 1, 0, " ", 20.0, "G", 0, 1, 1.0, 0.0, 4.0, 2.0)], "doc_id long, page int, page_height double, line_no long, span_no long, text string, size double, font string, flags int, color int, x0 double, y0 double, x1 double, y1 double")
    lines = assembly.relative_size(assembly.merge_spans(SparkRelation(spans)), SparkRelation(spans)).df.collect()
    assert len(lines) == 1
    r = lines[0]
    assert (r.text, r.x0, r.y0, r.x1, r.y1, r.font, r.font_size, r.bold, r.italic, r.underline) == ("a b", 1.0, 0.0, 9.0, 3.0, "G", 10.0, False, True, True)
    assert math.isclose(r.relative_font_size, 10 / 12)


def test_metrics_and_sweeps(spark):
    rows = [block(i, "t", head=h, pred=p, conf=c) for i, (h, p, c) in enumerate([(1, 1, 0.9), (1, 0, 0.3), (0, 1, 0.8), (0, 0, 0.1), (1, 1, 0.7), (0, 0, 0.3)])]
    r = frame(spark, rows)
    m = evaluation.metrics(r).df.first()
    assert (m.tp, m.fp, m.fn, m.tn) == (2, 1, 1, 2) and math.isclose(m.f1, 2 / 3)
    pairs = [(a[9], b[9]) for a in rows if a[6] for b in rows if not b[6]]
    assert math.isclose(evaluation.auc(r).df.first().auc, sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs))
    best = evaluation.precision_threshold(r, 0.5).df.first()
    at = [(sum(x[9] >= t and x[6] for x in rows), sum(x[9] >= t for x in rows), t) for t in [round(0.2 + 0.05 * i, 2) for i in range(14)]]
    assert math.isclose(best.precision, max(tp / n for tp, n, _ in at if n))
    assert evaluation.recall_threshold(r).df.first().threshold == 0.1 or evaluation.recall_threshold(r).df.first().recall == 1.0
    assert evaluation.metrics(frame(spark, [])).df.first().f1 in (0.0, None)


def test_box_features_of_flat_documents(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 5.0, 0.0, 9.0), (1, 1, 0.0, 6.0, 3.0, 9.0), (2, 0, 1.0, 5.0, 11.0, 9.0), (2, 1, None, None, None, None)], "doc_id long, block_id long, x0 double, y0 double, x1 double, y1 double")
    got = in_order(features.box_features(SparkRelation(df)), "x_position", "width", "aspect_ratio")
    assert got[0] == got[1] == (0.0, 100.0, 5.0) and got[2] == (1.0, 10.0, 2.0) and got[3][0] == 1.0


def test_outlines(spark):
    df = spark.createDataFrame([(1, 0, 1, "The Great Report", 24.0), (1, 1, 1, "1. Introduction", 14.0), (1, 2, 1, "some plain text that is no heading and says so at length.", 10.0), (1, 3, 2, "1.1 Scope", 12.0), (2, 0, 1, "nothing to see here, only a line of plain text", 10.0)], "doc_id long, block_id long, page int, text string, font_size double")
    got = {r.doc_id: r for r in api.outlines(df).collect()}
    assert got[1].title == "The Great Report" and got[1].valid and [(x.level, x.text, x.page) for x in got[1].outline][-2:] == [("H1", "1. Introduction", 1), ("H2", "1.1 Scope", 2)]
    assert got[2].outline == []


def test_entries_titles_and_boxes(spark):
    from foliograph.operators import outline

    nested = spark.createDataFrame([(1, "T", [("H1", "1. Scope", 1), ("H2", "plain", 2), ("H2", "IV.", 2)]), (2, "E", [])], "doc_id long, title string, outline array<struct<level:string,text:string,page:int>>")
    rows = outline.listing(outline.entries(SparkRelation(nested)), ["^pla"]).df.collect()
    assert sorted((r.doc_id, r.kind, r.text, r.page) for r in rows) == [(1, "numbered", "1. Scope", 1), (1, "personal", "plain", 2), (1, "roman", "IV.", 2)]
    r = SparkRelation(spark.createDataFrame([(None, "a_b-c.pdf"), ("", "x.pdf"), ("Meta", "y.pdf")], "title string, name string"))
    name = outline.filename_title(r.d, "name")
    assert [x.a for x in r.pick(a=outline.metadata_title(r.d, "title", name)).df.collect()] == ["A B C", "X", "Meta"]
    assert [x.a for x in r.pick(a=outline.metadata_title(r.d, "title", name, keep_empty=True)).df.collect()] == ["A B C", "", "Meta"]
    boxes = outline.boxed(frame(spark, [block(0, " A ", head=1, level=2), block(1, "no"), block(2, "B", head=1, level=1, page=3)])).df.orderBy("place").collect()
    assert [(b.place, b.text, b.level, b.page, b.x1, b.y1, b.x2, b.y2) for b in boxes] == [(1, "A", "2", 1, 0.0, 0.0, 100.0, 20.0), (2, "B", "1", 3, 0.0, 0.0, 100.0, 20.0)]


def test_filter_predictions_carries_columns(spark):
    df = frame(spark, [block(i, t, pred=1, conf=0.9) for i, t in enumerate(["1.", "Overview", "More", "Text"])]).df
    out = api.filter_predictions(df)
    assert set(df.columns) <= set(out.columns) and out.count() == 4
    assert out.where("text = '1. Overview'").count() == 1


def test_filter_predictions_of_some_columns(spark):
    import random

    rng = random.Random(5)
    pool = ["1.", "IV.", "A", "Overview", "Alpha", "Beta", "Plan of Work", "the plan", " 2 ", "Chapter", None, "some blue words, and more", "x"]
    rows = [block(i, rng.choice(pool), page=1 + i // 7, size=rng.choice([8.0, 12.0, 20.0]), pred=rng.choice([0, 1, 1, None]), conf=rng.random(), doc=d) for d, n in enumerate([1, 3, 40, 150]) for i in range(n)]
    df = frame(spark, rows).df
    keep = ["block_id", "doc_id", "text", "is_heading_pred", "filter_decision", "title_role", "merge_decision", "broken_decision"]
    old = merging.merge_prefixes(merging.document_title(filtering.decide(filtering.enhanced_score(SparkRelation(conform(df)), by_text=False))))
    old = api.merge_broken(old.add(text="merged_text").drop("merged_text").df).select(*keep)
    new = api.filter_predictions(df, keep)
    found = sorted(map(str, new.collect()))
    assert new.columns == keep and found == sorted(map(str, old.collect())) == sorted(map(str, api.filter_predictions(df).select(*keep).collect()))
    assert all(x in str(found) for x in ("document_title", "merged_into_next", "merged_consecutive", "merged_into_broken_heading"))
    windows = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Window [")
    assert windows(new) <= 7 < windows(api.filter_predictions(df))


def test_broken_headings_begin_at_single_words(spark):
    import random

    rng = random.Random(3)
    pool = ["Alpha", " Beta ", "the", "Gamma ray", "Delta", "x", "And", None, "Ab"]
    rows = [block(i, rng.choice(pool), page=1 + i // 9, pred=rng.choice([0, 1, 1, 1, None]), doc=d) for d, n in enumerate([2, 30, 90]) for i in range(n)]
    got = sorted(api.merge_broken(frame(spark, rows).df).collect(), key=lambda r: (r.doc_id, r.block_id))
    was = sorted(frame(spark, rows).df.collect(), key=lambda r: (r.doc_id, r.block_id))
    texts, heads, pages, docs = ([r[c] for r in was] for c in ("text", "is_heading_pred", "page", "doc_id"))
    done = [None] * len(was)
    took, gave = sequential.broken_headings(texts, heads, pages, docs, done, range(len(was)))
    assert [(r.text, r.is_heading_pred, r.broken_decision) for r in got] == list(zip(texts, heads, done)) and took and gave


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert metadata.comprehensive(empty).df.count() == 0 and api.outlines(empty.df).count() == 0 and filtering.score(empty).df.count() == 0


def test_every_query_against_duckdb(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("lineitem", "part", "pages", "documents", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    sql, wrong = queries.sql_queries(), []

    def rows(columns, found):
        return sorted(tuple("" if v is None or v != v else f"{v + 0.0:.6f}" if isinstance(v, float) else str(int(v)) if isinstance(v, bool) else str(v) for v in (r[c] for c in columns)) for r in found)

    for name, run in queries.spark_queries().items():
        if name in sql:
            df = run(spark, sf)
            names = sorted(df.columns)
            cursor = con.execute(sql[name])
            other = [x[0] for x in cursor.description]
            theirs = [dict(zip(other, r)) for r in cursor.fetchall()]
            if sorted(other) != names or rows(names, df.collect()) != rows(names, theirs):
                wrong.append(name)
    assert not wrong


def test_dataset_leaves_out_documents_of_hardly_any_headings(spark, monkeypatch):
    rows = [block(i, "t", head=int(i < heads), doc=doc) for doc, (n, heads) in enumerate([(10, 1), (200, 1), (400, 1), (10, 0)]) for i in range(n)]
    star = frame(spark, rows)
    assert sorted(r.doc_id for r in evaluation.usable_documents(star).df.select("doc_id").distinct().collect()) == [0, 1]
    monkeypatch.setattr(queries.blocks, "star", lambda t: star)
    kept = evaluation.split(evaluation.usable_documents(star)).where("NOT held_out")
    assert queries.n_dataset(None).df.collect() == queries.rounded(evaluation.dataset_stats(kept), "heading_percent").df.collect()


def test_forest_query_has_the_operators_settings(spark, monkeypatch):
    from foliograph.operators import models

    class Seen(Exception):
        pass

    def train(rows, columns, settings):
        raise Seen(settings)

    monkeypatch.setattr(models, "train_forest", train)
    with pytest.raises(Seen) as seen:
        queries.n_forest(spark, "/root/testdata/sf0.001")
    assert seen.value.args[0] == models.ForestSettings()


def test_few_files_are_dealt_to_all_tasks(spark, tmp_path):
    from foliograph.sources import blocks

    spark.range(300).selectExpr("id AS page_id", "'u' AS url", "concat('<p>page ', id, '</p>') AS html").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = blocks.page(blocks.SparkTables(spark, str(tmp_path))).df
        assert len([x for x in rows.rdd.glom().map(len).collect() if x]) > 1
        assert sorted((r.doc_id, r.block_id, r.text) for r in rows.collect()) == [(i, 0, f"page {i}") for i in range(300)]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    spark.range(300).repartition(spark.sparkContext.defaultParallelism).write.parquet(str(tmp_path / "many"))
    many = blocks.SparkRelation(spark.read.parquet(str(tmp_path / "many")))
    assert blocks.dealt(many, "id") is many
