"""Measures of predictions against labels, sweeps of thresholds, and feedback from reports."""

from __future__ import annotations

from collections.abc import Mapping

from ..plans import Relation, SparkRelation

TRUE, PRED, CONF = "is_heading", "is_heading_pred", "heading_confidence"


def metrics(r: Relation, *keys: str) -> Relation:
    """Accuracy, precision, recall and F1."""
    d = r.d
    n = lambda c: f"sum(CASE WHEN {c} THEN 1 ELSE 0 END)"
    r = r.group(*keys, tp=n(f"{TRUE} = 1 AND {PRED} = 1"), fp=n(f"{TRUE} = 0 AND {PRED} = 1"), fn=n(f"{TRUE} = 1 AND {PRED} = 0"), tn=n(f"{TRUE} = 0 AND {PRED} = 0"))
    r = r.add(**{c: f"CAST({c} AS BIGINT)" for c in ("tp", "fp", "fn", "tn")})
    zero = d.num(0.0)
    r = r.add(accuracy=d.ratio("(tp + tn)", "(tp + fp + fn + tn)"), precision=f"coalesce({d.ratio('tp', '(tp + fp)')}, {zero})", recall=f"coalesce({d.ratio('tp', '(tp + fn)')}, {zero})")
    return r.add(f1="CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE CAST(0 AS DOUBLE) END")


def confusion(r: Relation, true: str = "heading_level", predicted: str = "predicted_level") -> Relation:
    return r.group(true, predicted, blocks="count(*)")


def sweep(r: Relation, thresholds: list[float], value: str = CONF) -> Relation:
    """One row a threshold: tp, fp, fn, precision, recall, F1. The blocks are read once and not multiplied."""
    d = r.d
    sums = {}
    for i, t in enumerate(thresholds):
        sums[f"tp{i}"] = f"sum(CASE WHEN {value} >= {d.num(t)} AND {TRUE} = 1 THEN 1 ELSE 0 END)"
        sums[f"fp{i}"] = f"sum(CASE WHEN {value} >= {d.num(t)} AND {TRUE} = 0 THEN 1 ELSE 0 END)"
    r = r.group(**sums, positives=f"sum(CASE WHEN {TRUE} = 1 THEN 1 ELSE 0 END)").explode("i", d.array(range(len(thresholds))))
    one = lambda k: "CASE i " + " ".join(f"WHEN {i} THEN {k}{i}" for i in range(len(thresholds))) + " END"
    r = r.pick(threshold="CASE i " + " ".join(f"WHEN {i} THEN {d.num(t)}" for i, t in enumerate(thresholds)) + " END", tp=f"CAST({one('tp')} AS BIGINT)", fp=f"CAST({one('fp')} AS BIGINT)", fn=f"CAST(positives - ({one('tp')}) AS BIGINT)")
    r = r.add(precision=f"coalesce({d.ratio('tp', '(tp + fp)')}, {d.num(0.0)})", recall=f"coalesce({d.ratio('tp', '(tp + fn)')}, {d.num(0.0)})")
    return r.add(f1="CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE CAST(0 AS DOUBLE) END")


def recall_threshold(r: Relation) -> Relation:
    """The threshold of the best 0.4 F1 + 0.6 recall over .10 to .78; of equals the least."""
    r = sweep(r, [round(0.10 + 0.02 * i, 2) for i in range(35)])
    return r.add(goal=f"{r.d.num(0.4)} * f1 + {r.d.num(0.6)} * recall").top(1, "goal DESC, threshold")


def precision_threshold(r: Relation, target: float = 0.9, value: str = CONF) -> Relation:
    """The threshold of the best precision of at least ``target`` over .20 to .85; of equals the least. None: no row."""
    return sweep(r, [round(0.20 + 0.05 * i, 2) for i in range(14)], value).where(f"precision >= {r.d.num(target)}").top(1, "precision DESC, threshold")


def auc(r: Relation, value: str = CONF) -> Relation:
    """Area under the ROC curve, ties counted half, and the threshold of the greatest Youden index.

    Sums up to a score are those of the thousandths below it and those within its own. Scores are of 0 to 1, so there are at
    most 1,001 thousandths, the only rows that one window holds; scores of another range have to be brought to this one.
    """
    d = r.d
    by = r.group(value, pos=f"sum(CASE WHEN {TRUE} = 1 THEN 1 ELSE 0 END)", neg=f"sum(CASE WHEN {TRUE} = 0 THEN 1 ELSE 0 END)").add(b=f"CAST(floor({value} * 1000) AS BIGINT)")
    before = "OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    parts = by.group("b", bp="sum(pos)", bn="sum(neg)")
    parts = parts.pick("b", cp=f"coalesce(sum(bp) {before}, 0)", cn=f"coalesce(sum(bn) {before}, 0)", __p="sum(bp) OVER ()", __n="sum(bn) OVER ()")
    within = f"OVER (PARTITION BY b ORDER BY {value} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    by = by.join(parts, ["b"]).add(__neg=f"cn + sum(neg) {within}", __pos=f"cp + sum(pos) {within}")
    by = by.add(__below="__neg - neg", youden="CAST(__p - __pos + pos AS DOUBLE) / nullif(__p, 0) - CAST(__n - __neg + neg AS DOUBLE) / nullif(__n, 0)")
    area = f"sum(CAST(pos AS DOUBLE) * (__below + {d.num(0.5)} * neg)) / nullif(max(CAST(__p AS DOUBLE) * __n), 0)"
    return by.group(auc=area, youden_index="max(youden)", youden_threshold=f"min_by({value}, -round(youden, 9))")


def dataset_stats(r: Relation) -> Relation:
    return r.group(blocks="count(*)", headings=f"CAST(sum({TRUE}) AS BIGINT)", documents="count(DISTINCT doc_id)", heading_percent=f"{r.d.num(100.0)} * sum({TRUE}) / count(*)")


def usable_documents(r: Relation, least: float = 0.5) -> Relation:
    """The blocks of documents of which at least ``least`` percent are headings."""
    good = r.group("doc_id", __share=f"{r.d.num(100.0)} * sum({TRUE}) / count(*)").where(f"__share >= {r.d.num(least)}").pick("doc_id")
    return r.join(good, ["doc_id"], "left_semi")


def split(r: Relation, share: int = 20) -> Relation:
    """Add held_out: by a fixed rule, ``share`` percent of each class of each document."""
    return r.add(__i=f"row_number() OVER (PARTITION BY doc_id, {TRUE} ORDER BY block_id)").add(held_out=f"(__i % {100 // share} = 0)").drop("__i")


def feedback_reasons(reports: Relation) -> Relation:
    """(reason, kind, blocks): how often reports name each decision that filters or keeps."""
    d = reports.d
    kind = d.cases(("filter_decision LIKE '%filtered%'", "'exclusion'"), ("filter_decision LIKE '%keep%'", "'preservation'"))
    return reports.add(kind=kind).where("kind IS NOT NULL").group("filter_decision", "kind", blocks="CAST(sum(blocks) AS BIGINT)").pick("kind", "blocks", reason="filter_decision")


#: What to do, when, over the mean rate and the blocks that each decision with 'filtered' in its name has.
RECOMMENDATIONS = [
    ("average_reduction_rate > 50", "High false positive rate detected - consider stricter training criteria"),
    ("low_score > 100", "Many predictions filtered due to low scores - improve feature engineering"),
    ("urls > 20", "URL detection in text - enhance text preprocessing"),
    ("long_sentences > 30", "Long sentences being predicted as headings - improve length-based features"),
]


def feedback(reports: Relation) -> Relation:
    """One row over reports (doc_id, filter_decision, blocks, reduction_rate): how many, the mean of their rates, what to do.

    A report has a row for each of its decisions, all with its own rate. Only decisions named 'filtered' count as exclusions,
    so the counts of 'excluded_urls' and 'excluded_long_sentences' are 0 unless a report puts them under such a name.
    """
    d = reports.d
    n = lambda c: f"sum(CASE WHEN filter_decision LIKE '%filtered%' AND filter_decision = '{c}' THEN blocks ELSE 0 END)"
    each = reports.group("doc_id", reduction_rate=f"coalesce(max(reduction_rate), {d.num(0.0)})", low_score=n("filtered_low_score"), urls=n("excluded_urls"), long_sentences=n("excluded_long_sentences"))
    out = each.group(reports="count(*)", average_reduction_rate="avg(reduction_rate)", low_score="sum(low_score)", urls="sum(urls)", long_sentences="sum(long_sentences)")
    return out.pick("reports", "average_reduction_rate", recommendations=d.listed(*RECOMMENDATIONS, by="; "))


def training_rows(r: Relation) -> Relation:
    """Rows for retraining: confident kept headings as 1, those filtered for a low score and unsure as 0, tagged by source."""
    d = r.d
    good, bad = f"filter_decision = 'keep_high_confidence' AND heading_confidence >= {d.num(0.9)}", f"filter_decision = 'filtered_low_score' AND heading_confidence <= {d.num(0.6)}"
    if isinstance(r, SparkRelation):  # not a union, which would decide all blocks twice
        r = r.where(f"{good} OR {bad}", derived=True)
        return r.add(is_heading="CASE WHEN filter_decision LIKE 'keep%' THEN 1 ELSE 0 END", data_source="CASE WHEN filter_decision LIKE 'keep%' THEN 'high_conf_preserved' ELSE 'high_conf_filtered' END")
    kept = r.where(good, derived=True).add(is_heading="1", data_source="'high_conf_preserved'")
    lost = r.where(bad, derived=True).add(is_heading="0", data_source="'high_conf_filtered'")
    return kept.union(lost)


def training_union(original: Relation, reviewed: Relation | None = None, decided: Relation | None = None) -> Relation:
    """All rows to retrain on, by name: labels, reviewed corrections and confident decisions, tagged by data_source."""
    out = original.add(data_source="'original_labels'")
    if reviewed is not None:
        out = out.union(reviewed.add(data_source="'reviewed_corrections'"))
    return out if decided is None else out.union(training_rows(decided))


def class_report(r: Relation, true: str = "heading_level", predicted: str = "predicted_level") -> Relation:
    """One row a class: precision, recall, F1 and how many blocks are of it, 0 where a measure is undefined."""
    d = r.d
    own = r.group(true, support="count(*)", hits=f"sum(CASE WHEN {true} = {predicted} THEN 1 ELSE 0 END)").pick("support", "hits", label=true)
    said = r.group(predicted, predicted_blocks="count(*)").pick("predicted_blocks", label=predicted)
    both = own.join(said, ["label"], "full")
    both = both.add(**{c: f"CAST(coalesce({c}, 0) AS BIGINT)" for c in ("support", "hits", "predicted_blocks")})
    zero = d.num(0.0)
    both = both.add(precision=f"coalesce({d.ratio('hits', 'predicted_blocks')}, {zero})", recall=f"coalesce({d.ratio('hits', 'support')}, {zero})")
    return both.add(f1="CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE CAST(0 AS DOUBLE) END").drop("hits")


def macro_auc(r: Relation, label: str, probabilities: Mapping[int, str]) -> Relation:
    """One row: the mean area under the ROC curve of each class against the rest. ``probabilities``: class: column."""
    parts = [auc(r.pick(**{TRUE: f"CASE WHEN {label} = {k} THEN 1 ELSE 0 END", CONF: column})).pick("auc") for k, column in probabilities.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.group(classes="count(*)", macro_auc="avg(auc)")
