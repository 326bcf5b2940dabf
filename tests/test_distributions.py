import pytest

from tidemark.functions import distributions as d


@pytest.mark.parametrize(("x", "df", "p"), [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (18.307038, 10, 0.05), (0.0, 4, 1.0), (24.995790, 15, 0.05)])
def test_chi_squared_tail(x, df, p):
    assert float(d.chi_squared_tail(x, df)) == pytest.approx(p, abs=1e-6)


def test_normal_functions_invert_each_other(spark):
    df = spark.createDataFrame([(-1.96,), (0.0,), (2.5,)], "x double").withColumn("p", d.normal_cdf("x")).withColumn("back", d.normal_quantile("p"))
    rows = df.collect()
    assert rows[0].p == pytest.approx(0.0249979, abs=1e-6)
    assert all(r.back == pytest.approx(r.x, abs=1e-6) for r in rows)


@pytest.mark.parametrize(("x", "a", "b", "p"), [(4.964603, 1, 10, 0.05), (3.098391, 3, 20, 0.05), (2.532, 5, 30, 0.05), (0.0, 2, 5, 1.0)])
def test_f_tail(x, a, b, p):
    assert float(d.f_tail(x, a, b)) == pytest.approx(p, abs=2e-4)


def test_correlation_p_value_and_nulls(spark):
    df = spark.createDataFrame([(0.576, 12), (0.0, 30), (None, 5)], "r double, n long")
    rows = df.withColumn("p", d.correlation_p("r", "n")).collect()
    assert rows[0].p == pytest.approx(0.05, abs=1e-3) and rows[1].p == pytest.approx(1.0) and rows[2].p is None
