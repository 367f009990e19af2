import numpy as np

from aerolith.operators.imputation import SKY_CATEGORIES, SKY_NUMBERS, Category, Numeric, fill, fill_sky, fit, sky_records


def test_recovers_a_mixture(spark):
    r = np.random.default_rng(1)
    rows = []
    for i in range(4000):
        k = int(r.integers(0, 2))
        x = (10, 40)[k] + r.normal(0, 1)
        y = (5, -5)[k] + 0.8 * (x - (10, 40)[k]) + r.normal(0, 0.3)
        rows.append((i, float(x), float(y), k))
    numeric, cats = (Numeric("x", 1.0, -10.0, 60.0), Numeric("y", 1.0, -20.0, 20.0)), (Category("c", 2),)
    df = spark.createDataFrame(rows, "id bigint, x double, y double, c int")
    m = fit(df, numeric, cats, components=4)
    held = spark.createDataFrame([(i, x, None, None) for i, x, _, _ in rows[:300]], "id bigint, x double, y double, c int")
    got = {g.id: g for g in fill(held, m, numeric, cats, "id", ("y", "c")).collect()}
    error = np.sqrt(np.mean([(got[i].y - y) ** 2 for i, _, y, _ in rows[:300]]))
    assert error < 0.8 and all(got[i].c == c and got[i].y_filled and got[i].c_filled for i, _, _, c in rows[:300])


def test_edges(spark):
    schema = "obs_id bigint, INFRAR double, T double, INFRAR_near double, N int, N_near int"
    empty = spark.createDataFrame([], schema)
    assert fill_sky(empty).count() == 0
    rows = [(1, None, None, None, None, None), (2, 100.0, 5.0, float("nan"), 3, 3), (2, 100.0, 5.0, None, 3, 3), (3, float("nan"), 5.0, 101.0, 99, None)]
    got = {r.obs_id: r for r in fill_sky(spark.createDataFrame(rows, schema)).collect()}
    assert got[1].INFRAR_filled and got[1].N_filled and got[1].INFRAR is not None and 0 <= got[1].N <= 8
    assert not got[2].INFRAR_filled and got[2].INFRAR == 100 and got[3].N_filled and abs(got[3].INFRAR - 100) < 15


def test_company_leaves_the_row_out(spark):
    res = spark.createDataFrame([(1, 1, 60, 100.0, 4.0, 10.0), (2, 2, 70, 120.0, 6.0, 10.0), (3, 2, None, 90.0, 1.0, 10.0)], "obs_id bigint, station_id bigint, minute bigint, INFRAR_value double, N_value double, T double")
    st = spark.createDataFrame([(1, "A"), (2, "A"), (2, "A")], "station_id bigint, dep string")
    got = {r.obs_id: (r.INFRAR_near, r.N_near) for r in sky_records(res, st).collect()}
    assert got == {1: (120.0, 6), 2: (100.0, 4), 3: (None, None)}


def test_heldout_accuracy(spark, folder):
    """A fifth of the known values is hidden before anything is computed from them, then filled."""
    from aerolith.plans.problems import _resolved
    from aerolith.session import cut
    from aerolith.sources.tables import table

    res = cut(_resolved(spark, folder, "T").selectExpr("obs_id", "station_id", "minute", "INFRAR_value", "N_value", "T", "pmod(xxhash64(obs_id, 'held'), 5) = 0 AS held"))
    shown = res.selectExpr("obs_id", "station_id", "minute", "CASE WHEN NOT held THEN INFRAR_value END AS INFRAR_value", "CASE WHEN NOT held THEN N_value END AS N_value", "T")
    got = fill_sky(sky_records(shown, table(spark, folder, "stations", "station_id", "dep")))
    j = got.join(res.where("held").selectExpr("obs_id", "INFRAR_value AS x", "N_value AS true_n"), "obs_id")
    e = j.selectExpr("sqrt(avg(pow(INFRAR - x, 2))) AS rmse", "stddev(x) AS sd", "avg(CASE WHEN true_n IS NULL THEN NULL WHEN abs(N - true_n) <= 1 THEN 1.0 ELSE 0.0 END) AS near", "bool_and(INFRAR_filled AND N_filled) AS filled", "count(x) AS n").first()
    print(e)
    assert e.filled and e.n > 200 and e.rmse < 0.7 * e.sd and e.near > 0.4  # few stations share a department at this scale
