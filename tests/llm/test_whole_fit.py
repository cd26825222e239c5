"""What is learned comes from all rows."""

import numpy as np

from kadence.llm import personal_data
from kadence.llm.boosting import BoostedTrees
from kadence.llm.personal_data import learn_spans


def test_trees_fitted_to_rows_are_those_fitted_to_arrays(spark):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(0, 90, 3000), rng.integers(0, 2, 3000), rng.random(3000).round(2)]).astype(float)
    y = ((x[:, 0] > 40) ^ (x[:, 2] > 0.3)).astype(int)
    rows = spark.createDataFrame([(a, int(b)) for a, b in zip(x.tolist(), y, strict=True)], "x array<double>, y int")
    whole = BoostedTrees(rounds=8).fit_rows(rows.repartition(7))
    assert whole.trees == BoostedTrees(rounds=8).fit(x, y).trees
    assert whole.trees == BoostedTrees(rounds=8).fit_rows(rows.repartition(3, "y")).trees


def test_spans_are_learned_from_all_examples(spark, monkeypatch):
    """More than 20,000 different examples: all of them reach the trees or the thresholds."""
    rows = [(f"mail {'a' * p}{'1' * q}{'b' * (q % 3)}@{'c' * (1 + p % 5)}.org now",) for p in range(1, 101) for q in range(1, 51)]
    docs = spark.createDataFrame(rows, "text string")
    expected = {(tuple(x), y) for (text,) in rows for x, y, _ in personal_data._examples(text)}
    assert len(expected) > 20_000
    seen = []
    fit = BoostedTrees.fit_rows
    monkeypatch.setattr(BoostedTrees, "fit_rows", lambda self, df: seen.append(df.count()) or fit(BoostedTrees(rounds=2), df))
    settle = personal_data._thresholds
    monkeypatch.setattr(personal_data, "_thresholds", lambda df, p: seen.append(df.count()) or settle(df, p))
    assert min(learn_spans(docs).thresholds) <= 1
    assert sum(seen) == len(expected)


def test_thresholds_are_those_of_the_sorted_scores(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), round(float(s), 3), int(s + rng.normal() / 9 > 0.6)) for k, s in zip(rng.integers(0, 3, 4000), rng.random(4000), strict=True)]
    found = personal_data._thresholds(spark.createDataFrame(rows, "kind int, score double, y int"), 0.9)
    for kind in range(3):
        mine = sorted((-s, y) for k, s, y in rows if k == kind)
        scores, right = np.array([-s for s, _ in mine]), np.cumsum([y for _, y in mine])
        good = [i for i in range(len(mine)) if (i + 1 == len(mine) or scores[i + 1] < scores[i]) and right[i] >= 0.9 * (i + 1)]
        low = scores[good[-1]]
        wrong = max(-s for s, y in mine if not y and -s < low)
        assert found[kind] == max(0.5, (low + wrong) / 2)
