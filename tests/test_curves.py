import numpy as np
import pandas as pd
import pytest

from tidemark.operators import curves

RNG = np.random.default_rng(3)
EPS = 1e-12


def scored(spark, y, p, **more):
    return spark.createDataFrame(pd.DataFrame({"y": np.asarray(y, dtype=int), "p": np.asarray(p, dtype=float), **more}))


def points(y, p):
    """Ascending thresholds with precision and recall at score >= threshold."""
    t = np.unique(p)
    tp = np.array([((p >= x) & (y == 1)).sum() for x in t])
    n = np.array([(p >= x).sum() for x in t])
    return t, tp / n, tp / max(1, y.sum())


def f1(precision, recall):
    return 2 * precision * recall / (precision + recall + EPS)


CASES = {
    "mixed": (RNG.integers(0, 2, 400), np.round(RNG.uniform(size=400), 2)),
    "rare": ((RNG.uniform(size=600) < 0.05).astype(int), RNG.uniform(size=600)),
    "separated": (np.r_[np.zeros(50), np.ones(50)].astype(int), np.r_[np.linspace(0, 0.4, 50), np.linspace(0.6, 1, 50)]),
    "all equal": (np.array([0, 1, 1, 0]), np.full(4, 0.3)),
    "positives lowest": (np.array([1, 1, 0, 0, 0]), np.array([0.1, 0.1, 0.5, 0.6, 0.7])),
}


@pytest.mark.parametrize("case", CASES)
def test_metrics_and_curve(spark, case):
    y, p = CASES[case]
    curve = curves.score_curve(scored(spark, y, p), "p", "y")
    row = curves.ranking_metrics(curve).first()
    pos, neg = p[y == 1], p[y == 0]
    wins = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
    assert row["auroc"] == pytest.approx(wins)
    t, precision, recall = points(y, p)
    steps = recall - np.r_[recall[1:], 0]
    assert row["auprc"] == pytest.approx((steps * precision).sum())
    assert row["n"] == len(y) and row["prevalence"] == pytest.approx(y.mean())
    got = curves.pr_curve(curve).toPandas().sort_values("threshold", na_position="last")
    assert np.allclose(got["threshold"].iloc[:-1], t)
    assert np.allclose(got["precision"], np.r_[precision, 1]) and np.allclose(got["recall"], np.r_[recall, 0])


@pytest.mark.parametrize("case", CASES)
def test_threshold_alignments(spark, case):
    y, p = CASES[case]
    t, precision, recall = points(y, p)
    after_p, after_r = np.r_[precision[1:], 1], np.r_[recall[1:], 0]
    every = f1(precision, recall)
    best = int(np.argmax(every))
    expected = {
        "step_below": t[int(np.argmax(f1(after_p, after_r)))],
        "clamped": t[max(0, best - 1)],
        "exact": t[best],
    }
    curve = curves.score_curve(scored(spark, y, p), "p", "y")
    named = {a: curves.best_f1(a) for a in expected}
    for target in (0.0, 0.4, 0.5, 0.6, 1.0):
        named[f"recall {target}"] = curves.for_recall(target)
        ok = np.where(after_r >= target)[0]
        expected[f"recall {target}"] = t[ok[-1]] if len(ok) else t[0]
        named[f"exact {target}"] = curves.for_recall(target, "exact")
        expected[f"exact {target}"] = t[np.where(recall >= target)[0][-1]]
    for k in (-1, 0, 1, 3, len(p) - 1, len(p), len(p) + 5):
        named[f"top {k}"] = curves.for_top_k(k)
        expected[f"top {k}"] = 1.0 if k <= 0 else 0.0 if k >= len(p) else np.sort(p)[::-1][k - 1]
    got = curve.agg(*[c.alias(n) for n, c in named.items()]).first().asDict()
    assert {n: pytest.approx(v) for n, v in expected.items()} == got


@pytest.mark.parametrize("case", CASES)
def test_scenarios_equal_direct_counts(spark, case):
    y, p = CASES[case]
    df = scored(spark, y, p)
    table = curves.scenario_table(df, "p", "y", budgets=(3, 10_000)).toPandas()
    assert list(table["scenario"]) == ["F1_best", "Recall_40%", "Recall_50%", "Recall_60%", "Top3", "Top10000"]
    direct = curves.threshold_report(df, "p", "y", list(table["threshold"])).toPandas()
    for row, other in zip(table.itertuples(), direct.itertuples()):
        t = row.threshold
        counts = (((p >= t) & (y == 1)).sum(), ((p >= t) & (y == 0)).sum(), ((p < t) & (y == 1)).sum(), ((p < t) & (y == 0)).sum())
        assert (row.tp, row.fp, row.fn, row.tn) == counts == (other.tp, other.fp, other.fn, other.tn)
        assert row.tp + row.fp + row.fn + row.tn == len(y) and row.alerts == row.tp + row.fp
        assert row.ppv == pytest.approx(row.tp / (row.alerts + EPS))


def test_one_class_and_no_rows(spark):
    only = curves.ranking_metrics(curves.score_curve(scored(spark, [0, 0], [0.1, 0.2]), "p", "y")).first()
    assert only["auroc"] is None and only["auprc"] is None and only["n"] == 2
    empty = curves.score_curve(scored(spark, [0], [0.1]).where("p > 1"), "p", "y")
    got = empty.agg(curves.best_f1().alias("f"), curves.for_recall(0.5).alias("r"), curves.for_top_k(5).alias("k")).first()
    assert tuple(got) == (0.5, 0.5, 0.0)
    assert curves.pr_curve(empty).count() == 0


def test_groups_equal_separate_runs(spark):
    y, p = CASES["mixed"]
    g = np.where(np.arange(len(y)) % 3 == 0, "a", "b")
    df = scored(spark, y, p, g=g)
    grouped = {r["g"]: r for r in curves.metrics_by_period(df, "p", "y", "g", 20).collect()}
    table = curves.scenario_table(df, "p", "y", by=["g"]).toPandas()
    for group in "ab":
        part = df.where(f"g = '{group}'")
        alone = curves.ranking_metrics(curves.score_curve(part, "p", "y")).first()
        assert grouped[group]["auroc"] == pytest.approx(alone["auroc"])
        assert grouped[group]["auprc"] == pytest.approx(alone["auprc"])
        own = curves.scenario_table(part, "p", "y").toPandas()
        mine = table[table["g"] == group].drop(columns="g").reset_index(drop=True)
        pd.testing.assert_frame_equal(mine, own)
        assert grouped[group]["threshold"] == np.sort(p[g == group])[::-1][19]


def test_layout_does_not_matter(spark):
    y, p = CASES["mixed"]
    df = scored(spark, y, p)
    runs = [curves.scenario_table(d, "p", "y").collect() for d in (df, df.repartition(11), df.orderBy("p").coalesce(1))]
    assert runs[0] == runs[1] == runs[2]


@pytest.mark.parametrize("p", [np.round(RNG.uniform(size=500), 2), np.full(5, 0.4), np.array([0.0, 1.0])])
def test_histogram_matches_numpy(spark, p):
    got = curves.score_histogram(scored(spark, np.zeros(len(p)), p), "p").toPandas().sort_values("bin")
    counts, edges = np.histogram(p, bins=50)
    assert list(got["bin"]) == list(range(50)) and got["n"].sum() == len(p)
    # values that sit on an edge may fall to either side by rounding
    width = edges[1] - edges[0]
    on_edge = sum(np.isclose((x - edges[0]) / width, np.round((x - edges[0]) / width)) for x in p)
    assert np.abs(got["n"].to_numpy() - counts).sum() <= 2 * on_edge
