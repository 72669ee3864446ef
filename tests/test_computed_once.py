"""What is used more than once is computed once: plans, and results on lines that the shortcuts pass by."""

from pyspark.sql import functions as F

from verifold.functions import dates
from verifold.operators import lines as L
from verifold.plans import statements


def test_leaderboard_reads_its_scores_once(spark):
    rows = [(1, 0, "a", 3, 0, 5.0), (1, 1, "b", 3, 1, 5.0), (2, 1, "b", 2, 0, 4.0), (2, 0, "a", 0, 1, -1.0)]
    scores = spark.createDataFrame(rows, "doc_id long, strategy_idx int, strategy string, n_tx long, n_discarded long, score double")
    board = statements.strategy_leaderboard(scores)
    assert {tuple(r) for r in board.select("strategy", "n_tx", "n_discarded", "mean_score", "n_won").collect()} == {("a", 3, 1, 2.0, 1), ("b", 5, 1, 4.5, 1)}
    assert board._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_candidates_are_computed_once(spark):
    lines = statements.statement_lines(spark.createDataFrame([(1, "01/02/2024 COMPRA LOJA 10,01 D")], "doc_id int, text string"))
    plan = statements.candidates(lines)._jdf.queryExecution().optimizedPlan().toString()
    exploded = next(x for x in plan.split("\n") if "explode(filter(array(" in x)
    assert "regexp" not in exploded.lower() and "rlike" not in exploded.lower()


def test_shortcuts_of_lines(spark):
    rows = spark.createDataFrame([("1. 666, 44",), ("x - 5,00",), ("a. b",), ("1.\t666,44 -\tR$ 1,00",), ("plain",), (None,), ("x 01/02/2024 a 3.4.24 b",), ("01/02/2024 one\n02/02/2024 two",), ("01/02/2024 one",)], "x string")
    got = [tuple(r) for r in rows.select(L.compact_numbers(F.col("x")), F.array_join(L.split_on_dates(F.col("x")), "|"), dates.month_number(F.col("x"))).collect()]
    assert [g[0] for g in got] == ["1.666,44", "x -5,00", "a. b", "1.666,44 -R$ 1,00", "plain", None, "x 01/02/2024 a 3.4.24 b", "01/02/2024 one\n02/02/2024 two", "01/02/2024 one"]
    assert [g[1] for g in got][6:] == ["01/02/2024 a|3.4.24 b", "01/02/2024 one\n|02/02/2024 two", "01/02/2024 one"]
    assert [g[2] for g in got] == [None] * 9
