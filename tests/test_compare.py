import pytest

from shiftlab.operators.compare import control_comparison
from shiftlab.operators.orders import order_rate_deltas
from shiftlab.plans import control_report
from shiftlab.sources import comparison_rows_from_text, read_comparison_csv
from tests.helpers import rows
from tests.published_rates import ORDER_RATES

KNOWN = [("Delta_10W", 23, 29, 79.3), ("Delta_5W", 19, 29, 65.5)]


def test_published_rates(spark):
    data = comparison_rows_from_text(spark, ORDER_RATES)
    assert data.count() == 41
    assert rows(control_report(data)) == KNOWN
    by_date = control_report(data, keys=["Country", "Holiday", "Origin Date"])
    assert rows(by_date) == KNOWN
    deltas = data.select("Delta_5W", "Delta_10W").collect()
    assert order_rate_deltas(data).select("Delta_5W", "Delta_10W").collect() == deltas
    assert data.filter("Holiday = 'New Year’s Eve'").count() == 4


def test_published_rates_from_a_file(spark, tmp_path):
    path = tmp_path / "rates.csv"
    path.write_text(ORDER_RATES.strip() + "\n", encoding="utf-8")
    assert rows(control_report(read_comparison_csv(spark, str(path)))) == KNOWN


def compare(spark, data, **options):
    df = spark.createDataFrame(
        data, "ordinal int, Country string, Holiday string, cohort string, delta double"
    )
    return rows(control_comparison(df, ["delta"], ["ordinal"], **options))


def test_first_control_row_counts_and_groups_stay_apart(spark):
    data = [
        (1, "FR", "Easter", "Cohort A (0)", 0.1),
        (2, "FR", "Easter", "Cohort A (0)", 9.0),
        (3, "FR", "Easter", "Cohort B (-1)", 0.1),
        (4, "FR", "Easter", "Cohort C (+1)", 0.05),
        (5, "GB", "Easter", "Cohort B (-1)", 0.5),
        (6, None, "Easter", "Cohort A (0)", 0.0),
        (7, None, "Easter", "Cohort B (-1)", 0.5),
        (8, "FR", None, "Cohort B (-1)", 0.5),
    ]
    assert compare(spark, data) == [("delta", 1, 2, 50.0)]


def test_missing_values_are_comparisons_nobody_wins(spark):
    nan = float("nan")
    data = [
        (1, "FR", "x", "Cohort A (0)", 0.1),
        (2, "FR", "x", "Cohort B (-1)", None),
        (3, "FR", "x", "unlabelled", nan),
        (4, "FR", "x", None, 0.2),
        (5, "FR", "y", "Cohort A (0)", nan),
        (6, "FR", "y", "Cohort B (-1)", nan),
    ]
    assert compare(spark, data) == [("delta", 1, 4, 25.0)]


def test_nothing_to_compare(spark):
    assert compare(spark, [(1, "FR", "x", "Cohort B (-1)", 0.1)]) == [("delta", 0, 0, 0.0)]


@pytest.mark.parametrize("control, expected", [("A", 1), ("B", 0)])
def test_another_control(spark, control, expected):
    data = [(1, "FR", "x", "Cohort A (0)", 0.1), (2, "FR", "x", "Cohort B (-1)", 0.2)]
    assert compare(spark, data, control=control)[0][1] == expected


@pytest.mark.parametrize("wins, total, percent", [(1, 16, 6.2), (5, 16, 31.2), (1, 80, 1.2), (3, 16, 18.8), (167, 2000, 8.3)])
def test_percentages_are_rounded_like_printed_ones(spark, wins, total, percent):
    assert float(f"{wins / total * 100:.1f}") == percent
    df = spark.range(total + 1).selectExpr(
        "int(id) AS ordinal",
        "'GB' AS Country",
        "'x' AS Holiday",
        "if(id = 0, 'Cohort A (0)', 'Cohort B (-1)') AS cohort",
        f"if(id = 0, 0.5D, if(id <= {wins}, 1D, 0D)) AS delta",
    )
    assert rows(control_comparison(df, ["delta"], ["ordinal"])) == [("delta", wins, total, percent)]
