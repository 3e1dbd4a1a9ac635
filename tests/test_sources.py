import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import START, column, hours
from thermogrid.operators import history, hist2d
from thermogrid.plans import forecast, prepare
from thermogrid.operators.sliding import WindowShape
from thermogrid.schema import KEY, TS, SplitDates
from thermogrid.sources import paths, readers, writers
from thermogrid.sources.readers import RawSource

N = None
OLD = "STATION,DATE,TMP,DEW\n1,2024-01-01T00:00:00,\"+0100,1\",\"+0050,1\"\n1,2024-01-01T00:30:00,\"+0120,1\",\"+9999,9\"\n1,bad,\"+0100,1\",\"+0050,1\"\n1,2024-01-01T02:00:00,\"+0140,1\",\"+0060,1\"\n"
NEW = "DATE;temperature;dew_point_temperature\n2024-01-01 02:00:00;20.0;8\n2024-01-01 04:00:00;-999.9;9\n2024-01-01 04:10:00;16;9\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "old.csv").write_text(OLD)
    (tmp_path / "new.csv").write_text(NEW)
    return tmp_path


SOURCES = [RawSource("old.csv", encoding="auto"), RawSource("new.csv", sep=";", encoding="auto"), RawSource("absent.csv", sep=";", encoding="auto")]


def test_raw_files_are_decoded_by_content(spark, folder):
    old = readers.read_observations(spark, RawSource(str(folder / "old.csv"), encoding="tenths"))
    assert column(old, "temp") == [10.0, 12.0, 14.0] and column(old, "dew") == [5.0, N, 6.0]
    new = readers.read_observations(spark, RawSource(str(folder / "new.csv"), sep=";", encoding="auto"))
    assert column(new, "temp") == [20.0, N, 16.0]
    plan = old._jdf.queryExecution().executedPlan().toString()
    assert "STATION" not in plan.split("ReadSchema")[1]


def test_missing_columns_are_errors(spark, tmp_path):
    (tmp_path / "x.csv").write_text("WHEN,TMP,DEW\n1,2,3\n")
    (tmp_path / "y.csv").write_text("DATE,DEW\n1,2\n")
    for name in ("x", "y"):
        with pytest.raises(ValueError):
            readers.read_observations(spark, RawSource(str(tmp_path / f"{name}.csv"), encoding="auto"))


def test_folder_is_merged_then_preferred_when_cleaned(spark, folder):
    series = readers.load_observations(spark, str(folder), SOURCES)
    # Each file is filled before merging: hours 1 and 3 are in one file only, hour 2 is the mean of 14 and 20.
    assert column(series, "temp") == pytest.approx([11.0, 12.5, 17.0, 18.0, 16.0])
    prepare.clean_folder(spark, str(folder), SOURCES, str(folder / "cleaned"))
    assert paths.exists(spark, f"{folder}/cleaned/year=2024")
    again = readers.load_observations(spark, str(folder), [])
    assert column(again, "temp") == pytest.approx(column(series, "temp"))
    with pytest.raises(FileNotFoundError):
        readers.load_observations(spark, str(folder), [], prefer_clean=False)


def test_cleaned_csv_round_trip(spark, series, tmp_path):
    df = series([1.0, N, 3.0])
    writers.write_series_csv(df, str(tmp_path / "cleaned.csv"))
    back = readers.read_cleaned(spark, str(tmp_path / "cleaned.csv"))
    assert column(back, "temp") == [1.0, N, 3.0] and column(back, TS) == hours(3)


def station_file(path, rows):
    head = ",".join(readers.STATION_COLUMNS)
    path.write_text("\n".join([head, *rows]) + "\n", encoding="latin-1")


def test_station_files(spark, tmp_path):
    station_file(tmp_path / "weather_1.csv", ["2024-01-01 00:00:00,0,10.5,50,1000,90,3", "01/01/2024 01:00,0,11.5,50,1000,180,3"])
    station_file(tmp_path / "weather_2.csv", ["2024-01-01 00:00:00,0,1.5,50,1000,,3"])
    raw = readers.read_station_files(spark, f"{tmp_path}/*.csv")
    out = readers.clean_stations(raw)
    rows = {(r[KEY], r[TS]): r for r in out.collect()}
    assert set(rows) == {("station_1", START), ("station_1", datetime(2024, 1, 1, 1)), ("station_2", START)}
    first = rows["station_1", START]
    assert first.temperature_celsius == 10.5 and first.wind_y == pytest.approx(1.0) and "wind_direction_deg" not in out.columns
    assert rows["station_2", START].wind_x is None
    assert readers.read_station_files(spark, f"{tmp_path}/*.txt").count() == 0


def test_station_columns_go_by_their_names(spark, tmp_path):
    names = list(readers.STATION_COLUMNS)
    line = dict(zip(names, ["2024-01-01 00:00:00", "0.5", "10.5", "50", "1000", "90", "3"]))
    orders = {"weather_1": names, "weather_2": names[::-1], "weather_3": [n for n in names if n != "Humedad (%)"]}
    for name, order in orders.items():
        (tmp_path / f"{name}.csv").write_text(",".join(order) + "\n" + ",".join(line[c] for c in order) + "\n", encoding="latin-1")
    with (tmp_path / "weather_1.csv").open("a", encoding="latin-1") as f:
        f.write(",".join(["x"] * 9) + "\nshort,1\n")
    raw = readers.read_station_files(spark, f"{tmp_path}/*.csv")
    rows = {r[KEY]: r for r in readers.clean_stations(raw).collect()}
    assert all(rows[f"station_{i}"].temperature_celsius == 10.5 and rows[f"station_{i}"].precipitation_mm == 0.5 for i in (1, 2, 3))
    assert rows["station_3"].humidity_percent is None and rows["station_2"].humidity_percent == 50
    assert {raw.count(), len(raw.select("station_id").collect()), len(raw.select(*names[:2]).collect()), len(raw.collect())} == {3}
    audit = {r.station_id: (r.n_lines, r.n_bad) for r in readers.audit_station_files(spark, f"{tmp_path}/*.csv").collect()}
    assert audit == {"station_1": (3, 2), "station_2": (1, 0), "station_3": (1, 0)}


def test_jobs_do_not_grow_with_the_files(spark, tmp_path):
    names = list(readers.STATION_COLUMNS)
    for i in range(60):
        own = names[: 4 + i % 4] if i % 2 else names[::-1]
        lines = ["", ",".join(f'"{c}"' if i % 3 == 0 else c for c in own), *[",".join(f"{i}.{j}" for _ in own) for j in range(i % 5)], "   ", "1,2,3", ",".join(own) if i == 7 else ""]
        (tmp_path / f"weather_{i}.csv").write_bytes("\r\n".join(lines).encode("latin-1"))
    jobs = {}
    for pattern in ("weather_1.csv", "weather_*.csv"):
        spark.sparkContext.setJobGroup(pattern, pattern)
        found = {r.station_id: (r.n_lines, r.n_bad) for r in readers.audit_station_files(spark, f"{tmp_path}/{pattern}").collect()}
        jobs[pattern] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(pattern))
    spark.sparkContext.setJobGroup(None, None)
    assert found == {f"station_{i}": (i % 5 + 1, 1) for i in range(60)}
    assert jobs["weather_*.csv"] <= jobs["weather_1.csv"] + 1
    raw = readers.read_station_files(spark, f"{tmp_path}/weather_*.csv").collect()
    assert len(raw) == sum(i % 5 for i in range(60)) and all(r[names[0]] is not None and (r[names[6]] is None) == (int(r.station_id[8:]) % 4 < 3 and int(r.station_id[8:]) % 2 == 1) for r in raw)


def test_station_preparation_and_window_model(spark, tmp_path):
    rows = [f"{t:%Y-%m-%d %H:%M:%S},{i % 3},{10 + i % 24},{40 + i % 7},{1000 + i % 5},{(i * 37) % 360},{i % 4}" for i, t in enumerate(hours(200))]
    station_file(tmp_path / "weather_1.csv", rows)
    station_file(tmp_path / "weather_2.csv", rows[:50])
    out = str(tmp_path / "splits")
    prepare.prepare_stations(spark, f"{tmp_path}/*.csv", out, ["station_1"])
    parts = readers.read_splits(spark, out)
    assert [parts[s].count() for s in ("train", "val", "test")] == [140, 40, 20]
    model = prepare.train_last_step(spark, out, WindowShape(6, 3, 3), "temperature_celsius", epochs=3)
    assert len(model.history) == 3 and model.weights.shape == (8, 3)


def test_histories_prefer_the_consolidated_file(spark, tmp_path):
    record = lambda mae, n: {
        "epochs": [{"epoch": i, "val_mae": mae + n - i, "train_loss": 1.0} for i in range(1, n + 1)], "total_epochs": n, "best_val_mae": mae,
        "best_epoch": n, "lr_decay_events": [{"step": 1, "old_lr": 0.1, "new_lr": 0.05}], "final_status": "done", "underfitting_detected": True,
    }
    (tmp_path / "all.json").write_text(json.dumps({"Linear": record(0.5, 3)}, indent=2))
    (tmp_path / "linear.json").write_text(json.dumps(record(9.9, 2), indent=2))
    (tmp_path / "trees.json").write_text(json.dumps({"stages": [{"stage": 1, "trees_fitted": 8, "val_mae": 0.7}], "status": "Completed"}))
    table = readers.read_histories(spark, f"{tmp_path}/all.json", {
        "Linear": f"{tmp_path}/linear.json", "Trees": f"{tmp_path}/trees.json", "Gone": f"{tmp_path}/gone.json"})
    summary = {r.model: r for r in history.history_summary(table).collect()}
    assert set(summary) == {"Linear", "Trees"}
    linear, trees = summary["Linear"], summary["Trees"]
    assert (linear.steps, linear.best_val_mae, linear.rate_events, linear.fit, linear.final_status) == (3, 0.5, 1, "underfit", "done")
    assert (trees.steps, trees.rate_events, trees.fit, trees.final_status, trees.target_mae) == (1, 0, "good", "Completed", 1.0)
    assert [r.epoch for r in history.epoch_rows(table).orderBy("epoch").collect()] == [1, 2, 3]
    assert [r.trees_fitted for r in history.stage_rows(table).collect()] == [8]
    assert tuple(history.best_over_runs(table).first()) == (2, 0.5, "Linear")
    assert readers.read_histories(spark, None, {}).count() == 0


def test_frames_sink(spark, tmp_path):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 3), 1.5, 2.5)], "ts timestamp, t double, d double")
    prepare.hour_of_year_histogram(df, "ts", "t", "d", str(tmp_path / "h"))
    lines = spark.read.json(str(tmp_path / "h/frames"))
    assert lines.count() == hist2d.HOURS_OF_YEAR
    assert lines.where("hour = 3").first().frame == [[25, 25, 1]] and lines.where("hour = 4").first().frame == []
    meta = spark.read.json(str(tmp_path / "h/meta")).first()
    assert (meta.grid_size, meta.x_min, meta.y_max) == (50, 1.0, 3.0)


def test_run_folder_modes(spark, tmp_path):
    out = str(tmp_path / "run")
    assert writers.choose_mode(spark, out, ["a"]) == "reset"
    (tmp_path / "run").mkdir()
    with pytest.raises(ValueError, match="missing a"):
        writers.choose_mode(spark, out, ["a"])
    (tmp_path / "run" / "a").mkdir()
    assert writers.choose_mode(spark, out, ["a"]) == "resume"
    writers.prepare_outputs(spark, out, "resume")
    assert paths.exists(spark, f"{out}/a")
    writers.prepare_outputs(spark, out, "reset")
    assert not paths.exists(spark, out)
    with pytest.raises(ValueError):
        writers.prepare_outputs(spark, out, "other")


def test_whole_forecast_job_and_resume(spark, series, tmp_path):
    import math
    temp = [12 + 6 * math.sin(2 * math.pi * i / 24) + (i * 7919 % 13) / 10 for i in range(600)]
    params = forecast.JobParams(
        models=("persistence", "climatology", "ridge", "linear"), dates=SplitDates("2024-01-18", "2024-01-21"), epochs_per_iter=1, max_iters=2,
        target_mae=0.0)
    out = str(tmp_path / "run")
    first = forecast.run_forecast(series(temp), params, out)
    board = first["leaderboard"].orderBy("place").collect()
    assert len(board) == 4 and board[0].model == "ridge"
    assert first["history"].where("run_id = 'linear'").count() == 2
    for name in ("data_properties", "model_metrics", "test_predictions", "training_histories"):
        assert spark.read.json(f"{out}/{name}").count() > 0
    records = {r.model: r for r in readers.read_histories(spark, f"{out}/training_histories", {}).collect()}
    assert set(records) == {"linear"} and records["linear"].final_status == "underfit" and records["linear"].underfitting_detected
    assert [e.epoch for e in records["linear"].epochs] == [1, 2] and all(e.train_loss and e.val_loss for e in records["linear"].epochs)
    assert [i.status for i in records["linear"].iterations] == ["continue", "continue"]
    second = forecast.run_forecast(series(temp), params, out)
    assert second["history"].where("run_id = 'linear'").count() == 4
    with pytest.raises(ValueError):
        forecast.run_forecast(series(temp), forecast.JobParams(models=("unknown",)))


def test_describe_table(spark):
    df = spark.createDataFrame([(1, "a"), (2, N)], "k int, name string")
    out = prepare.describe_table(df)
    assert out["columns"].count() == 2 and out["missing"].first().variable == "name" and out["histograms"].count() == 30
    assert df.where(F.col("k") > 5).count() == 0


def test_a_job_that_dies_leaves_the_run_before_it(spark, series, tmp_path, monkeypatch):
    import math
    temp = [12 + 6 * math.sin(2 * math.pi * i / 24) + (i * 7919 % 13) / 10 for i in range(600)]
    params = forecast.JobParams(models=("persistence", "linear"), dates=SplitDates("2024-01-18", "2024-01-21"), epochs_per_iter=1, max_iters=1, target_mae=0.0)
    out = str(tmp_path / "run")
    forecast.run_forecast(series(temp), params, out)
    listed = {r["name"]: r["bytes"] for r in writers.read_manifest(spark, out).collect()}
    assert any(n.startswith("runs/linear/blocks/") for n in listed) and all((tmp_path / "run" / n).stat().st_size == size for n, size in listed.items())
    epochs = lambda: len(readers.read_histories(spark, f"{out}/training_histories", {}).first()["epochs"])
    for name in ("evaluate", "finish_run"):
        with monkeypatch.context() as patch:
            patch.setattr(forecast, name, lambda *a, **k: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                forecast.run_forecast(series(temp), params, out)
        assert epochs() == 1 and {r["name"] for r in writers.read_manifest(spark, out).collect()} == set(listed)
    (tmp_path / "run").rename(tmp_path / "run.before")  # dies between the renames, once with and once without a whole new run
    forecast.run_forecast(series(temp), params, out)
    assert epochs() == 2 and not (tmp_path / "run.before").exists() and not (tmp_path / "run.next").exists()
    (tmp_path / "run").rename(tmp_path / "run.next")
    writers.recover_run(spark, out)
    assert epochs() == 2
    # a reset is a new run beside the old one too
    fresh = writers.begin_run(spark, out, "reset")
    writers.write_json(spark.range(1), f"{fresh}/only")
    assert epochs() == 2
    writers.finish_run(spark, out)
    assert [n for n in paths.matching(spark, f"{out}/*") if not n.endswith(("only", "manifest.json"))] == []
    with pytest.raises(ValueError):
        writers.begin_run(spark, out, "other")
