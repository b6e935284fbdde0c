import random

import pandas as pd
import pytest

from prefboard.operators import leaderboard


@pytest.mark.parametrize("seed", range(4))
def test_rank_correlation_with_ties_and_gaps(spark, seed):
    random.seed(seed)
    value = lambda: random.choice([None, 0.25, 0.25, 0.25, random.randint(0, 9) / 10, random.random()])
    rows = [(value(), value()) for _ in range(200)]
    frame = spark.createDataFrame(rows, "eng_Latn double, avg_multilingual double").repartition(7)
    got = leaderboard.spearman(frame).first()["spearman"]
    table = pd.DataFrame(rows, columns=["a", "b"]).dropna().rank(method="average")
    assert got == pytest.approx(table["a"].corr(table["b"]), abs=1e-12)


def test_no_rows_and_equal_values(spark):
    schema = "eng_Latn double, avg_multilingual double"
    assert leaderboard.spearman(spark.createDataFrame([], schema)).first()["spearman"] is None
    assert leaderboard.spearman(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], schema)).first()["spearman"] is None


def test_ranks_need_no_window(spark):
    frame = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0)], "eng_Latn double, avg_multilingual double")
    plan = leaderboard.spearman(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
