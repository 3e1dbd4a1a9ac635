import numpy as np
import pytest
from datetime import timedelta

from conftest import START
from thermogrid.operators import evaluate, profile

SCHEMA = (
    "series_id string, ts timestamp, now double, y array<double>, actual_tmax double, actual_tmin double, actual_tavg double, "
    "model string, yhat array<double>, tmax double, tmin double, tavg double"
)


def predictions(spark, cases):
    rows = []
    for model, pairs in cases.items():
        for i, (now, y, yhat) in enumerate(pairs):
            rows.append(("a", START + timedelta(hours=i), now, y, max(y), min(y), sum(y) / len(y), model, yhat, max(yhat), min(yhat), sum(yhat) / len(yhat)))
    return spark.createDataFrame(rows, SCHEMA)


def test_scores_equal_numpy(spark):
    rng = np.random.default_rng(2)
    pairs = []
    for _ in range(40):
        y = rng.normal(0, 4, 6)
        pairs.append((float(rng.normal()), y.tolist(), (y + rng.normal(0, 1.2, 6)).tolist()))
    r = evaluate.evaluate(predictions(spark, {"m": pairs})).first()
    y, p = np.array([c[1] for c in pairs]), np.array([c[2] for c in pairs])
    e, now = p - y, np.array([c[0] for c in pairs])
    keep = np.abs(y) > 0.5
    want = {
        "mae": np.abs(e).mean(), "rmse": np.sqrt((e**2).mean()), "mape": np.abs(e[keep] / y[keep]).mean() * 100,
        "r2": 1 - (e**2).sum() / ((y - y.mean()) ** 2).sum(),
        "acc_1": (np.abs(e) <= 1).mean() * 100, "acc_2": (np.abs(e) <= 2).mean() * 100,
        "tmax_mae": np.abs(y.max(1) - p.max(1)).mean(), "tavg_rmse": np.sqrt(((y.mean(1) - p.mean(1)) ** 2).mean()),
        "tmin_r2": 1 - ((p.min(1) - y.min(1)) ** 2).sum() / ((y.min(1) - y.min(1).mean()) ** 2).sum(),
    }
    for name, value in want.items():
        assert r[name] == pytest.approx(value), name
    up, said = y[:, -1] > now, p[:, -1] > now
    precision, recall = (up & said).sum() / said.sum(), (up & said).sum() / up.sum()
    assert r.directional_precision == pytest.approx(100 * precision) and r.directional_recall == pytest.approx(100 * recall)
    assert r.directional_f1 == pytest.approx(200 * precision * recall / (precision + recall)) and r.rows == 40


def test_degenerate_cases(spark):
    out = {r.model: r for r in evaluate.evaluate(predictions(spark, {
        "no_rise": [(5.0, [1.0, 2.0], [1.0, 9.0])], "nothing_said": [(5.0, [1.0, 9.0], [5.0, 5.0])],
        "constant_right": [(0.0, [0.4, 0.4], [0.4, 0.4])], "constant_wrong": [(0.0, [0.4, 0.4], [1.4, 0.4])],
    })).collect()}
    assert (out["no_rise"].directional_recall, out["no_rise"].directional_precision, out["no_rise"].directional_f1) == (0, 0, 0)
    assert out["nothing_said"].directional_precision == 0 and out["nothing_said"].directional_f1 == 0
    assert (out["constant_right"].r2, out["constant_wrong"].r2, out["constant_wrong"].mape) == (1.0, 0.0, 0.0)
    assert out["constant_wrong"].acc_1 == 100.0


def test_leaderboard_kpi_and_report(spark):
    good, bad = [(1.0, [2.0, 3.0], [2.0, 3.5])], [(1.0, [2.0, 3.0], [9.0, 9.0])]
    scores = evaluate.evaluate(predictions(spark, {"bad": bad, "good": good}))
    board = evaluate.leaderboard(scores).orderBy("place").collect()
    assert [(r.model, r.is_best) for r in board] == [("good", True), ("bad", False)]
    kpi = evaluate.kpi_summary(scores).first()
    assert (kpi.best_model, kpi.best_mae, kpi.best_acc_1) == ("good", 0.25, 100.0)
    report = {r.model_name: r for r in evaluate.metrics_report(scores).collect()}
    assert report["good"].hourly_24h["acc_1.0C"] == 100.0 and set(report["bad"].tmax.asDict()) == {"mae", "rmse", "mape", "r2"}


def test_residuals_tail_and_export(spark):
    pairs = [(float(i), [float(i), i + 1.0], [i + 0.5, i + 2.0]) for i in range(10)]
    table = predictions(spark, {"m": pairs, "n": pairs})
    residual = evaluate.residuals(table)
    assert {(r.n, r["mean"], r.std) for r in evaluate.residual_summary(residual).collect()} == {(10, 1.0, 0.0)}
    assert sum(r["count"] for r in profile.histogram(residual, ["model"], evaluate.RESIDUAL_BINS).collect()) == 20
    tail = evaluate.tail_rows(table, 3).collect()
    assert len(tail) == 6 and min(r.now for r in tail) == 7.0
    export = {r.model: r for r in evaluate.evaluation_export(table, 4).collect()}["m"]
    assert export.timestamps[0] == "2024-01-01 06:00" and export.last_timestamp == "2024-01-01 09:00"
    assert export.tmax == [8.0, 9.0, 10.0, 11.0] and export.sample_24h_profile == [9.5, 11.0] and export.actual_last_24h_profile == [9.0, 10.0]
    assert evaluate.tail_rows(table, 500).count() == 20
    assert sorted(map(str, evaluate.tail_rows(table, 3, 2).collect())) == sorted(map(str, tail))
    plan = evaluate.last_profiles(table)._jdf.queryExecution().executedPlan().toString()
    assert "last_ts" in plan and "max_by(yhat" not in plan
    assert {r.val_mae for r in evaluate.validation_mae(table).collect()} == {0.75}
