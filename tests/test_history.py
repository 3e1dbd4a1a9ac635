import os
import random
import subprocess
import sys
from pathlib import Path

import pytest

from thermogrid.operators import history, rate_policy
from thermogrid.operators.rate_policy import RatePolicy, advance, start

N = None
SCHEMA = "run_id string, step int, val_mae double, val_loss double, train_loss double"


ROOT = Path(__file__).resolve().parents[1]


def runs(spark, metrics, train=None):
    rows = [
        (k, i, v, v, (train or {}).get(k, [1.0] * len(values))[i - 1])
        for k, values in metrics.items() for i, v in enumerate(values, 1)
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("block_steps", [2, 3, 1000])
def test_running_best(spark, block_steps):
    df = runs(spark, {"a": [5.0, 4.0, 4.0, 6.0, 3.0, 3.5], "b": [N, 2.0, 1.0]})
    out = {(r.run_id, r.step): r for r in history.running_best(df, block_steps=block_steps).collect()}
    assert [out["a", i].best_so_far for i in range(1, 7)] == [5, 4, 4, 4, 3, 3]
    assert [out["a", i].best_step for i in range(1, 7)] == [1, 2, 2, 2, 5, 5]
    assert [out["a", i].improved for i in range(1, 7)] == [True, True, False, False, True, False]
    assert out["b", 1].best_so_far is None and out["b", 3].best_step == 3
    status = {r.run_id: r for r in history.fit_status(history.running_best(df, block_steps=block_steps), 1.5).collect()}
    assert status["a"].status == "underfit" and (status["b"].status, status["b"].reached_at) == ("adequate", 3)


@pytest.mark.parametrize("block_steps", [2, 1000])
def test_overfit(spark, block_steps):
    val = [4.0, 3.0, 2.0, 2.6, 2.6, 2.5, 2.51, 9.0]
    df = runs(spark, {"a": val, "b": val}, {"a": [9.0] + [1.0] * 7, "b": [1.0] * 8})
    out = {(r.run_id, r.step): r.overfit for r in history.overfit_flags(df, block_steps=block_steps).collect()}
    # needs six steps, more than 1.25 times the minimum (2.5 is not), and a fallen training loss
    assert [out["a", i] for i in range(1, 9)] == [False] * 6 + [True, True]
    assert not any(out["b", i] for i in range(1, 9))


def walk(policy, metrics):
    state, out = start(policy), []
    for i, m in enumerate(metrics, 1):
        state = advance(policy, state, m, i)
        out.append((round(state.lr, 10), state.event))
    return out


def test_plateau_lowers_after_patience():
    assert walk(RatePolicy(initial_lr=0.1, patience=2), [5, 5, 5, 4, 4, 4]) == [
        (0.1, N), (0.1, N), (0.05, "plateau"), (0.05, N), (0.05, N), (0.025, "plateau")]


def test_small_gains_do_not_count_and_mode_max():
    assert walk(RatePolicy(initial_lr=0.1, patience=1, min_delta=0.5), [5.0, 4.6, 4.4])[1:] == [(0.05, "plateau"), (0.05, N)]
    assert walk(RatePolicy(initial_lr=0.1, patience=1, mode="max"), [1, 2, 2])[2] == (0.05, "plateau")


def test_cooldown_ignores_improvements():
    policy = RatePolicy(initial_lr=0.1, patience=1, cooldown=2)
    # steps three and four rest: the 1 is not recorded, so the 3 after them still improves on 5
    assert walk(policy, [5, 5, 1, 1, 3, 3]) == [
        (0.1, N), (0.05, "plateau"), (0.05, N), (0.05, N), (0.05, N), (0.025, "plateau")]


def test_other_shapes_and_floor_restart():
    assert walk(RatePolicy(policy="exponential_plateau", initial_lr=0.8, patience=1, restart_patience=0), [1] * 4) == [
        (0.8, N), (0.4, "exponential_plateau"), (0.2, "exponential_plateau"), (0.1, "exponential_plateau")]
    assert walk(RatePolicy(policy="step_plateau", factor=0.25, initial_lr=0.8, patience=1, min_lr=0.3, restart_patience=0), [1] * 5) == [
        (0.8, N), (0.6, "step_plateau"), (0.4, "step_plateau"), (0.3, "step_plateau"), (0.3, N)]
    policy = RatePolicy(initial_lr=0.4, patience=1, min_lr=0.2, restart_patience=2, restart_factor=0.9)
    # at the floor from step two; the second stale step there restarts, then two steps rest
    assert walk(policy, [1] * 7) == [
        (0.4, N), (0.2, "plateau"), (0.2, N), (0.4, "warm_restart_bump"), (0.4, N), (0.4, N), (0.2, "plateau")]
    assert walk(RatePolicy(enabled=False, initial_lr=0.4, patience=1), [1] * 5) == [(0.4, N)] * 5


def test_cyclic():
    up_down = [lr for lr, _ in walk(RatePolicy(policy="clr", initial_lr=1.0, min_lr=0.0, cycle_step_size=2), [0] * 8)]
    assert up_down == [0.5, 1.0, 0.5, 0.0, 0.5, 1.0, 0.5, 0.0]
    second = walk(RatePolicy(policy="cyclic", cyclic_mode="triangular2", initial_lr=1.0, min_lr=0.0, cycle_step_size=2), [0] * 6)
    assert second[5][0] == 0.5


def test_missing_metric_is_a_step_without_gain():
    assert walk(RatePolicy(initial_lr=0.1, patience=2), [5.0, None, None, 4.0])[2:] == [(0.05, "plateau"), (0.05, N)]


@pytest.mark.parametrize("policy", [
    RatePolicy(patience=3, min_lr=0.05, initial_lr=0.1, restart_patience=4, min_delta=0.3), RatePolicy(policy="step_plateau", patience=2, factor=0.3, initial_lr=0.1, restart_patience=0),
    RatePolicy(patience=1, cooldown=1, min_lr=0.01, initial_lr=0.1, restart_patience=2), RatePolicy(policy="cyclic", initial_lr=0.1),
    RatePolicy(policy="cyclic", cyclic_mode="exp_range", initial_lr=0.1, max_lr=0.3), RatePolicy(enabled=False),
])
def test_replay_equals_stepping(spark, policy):
    rng = random.Random(4)
    metrics = {f"r{k}": [rng.uniform(0, 2) for _ in range(rng.randint(1, 400))] for k in range(9)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    out = {}
    for r in rate_policy.replay(runs(spark, metrics), policy).collect():
        out[r.run_id, r.step] = r.lr
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for key, values in metrics.items():
        assert [out[key, i] for i in range(1, len(values) + 1)] == pytest.approx([lr for lr, _ in walk(policy, values)], abs=1e-9)


def shapes(rng, n=700):
    """Metrics that fall steadily, stand still, jump about, and fall in steps; a run of one step."""
    falling = [100.0 / (i + 1) + rng.uniform(0, 0.3) for i in range(n)]
    return {"falling": falling, "noise": [rng.uniform(0, 2) for _ in range(n)], "flat": [1.0] * n, "short": [1.0],
            "stairs": [10.0 - i // 90 + rng.uniform(0, 0.5) for i in range(n)], "gaps": [N if rng.random() < 0.3 else rng.gauss(5 - i / n, 1) for i in range(n)]}


@pytest.mark.parametrize("policy", [
    RatePolicy(patience=2, min_lr=0.01, initial_lr=0.1, restart_patience=3, cooldown=1), RatePolicy(patience=40, factor=0.3, initial_lr=0.1, restart_patience=0),
    RatePolicy(policy="exponential_plateau", patience=5, initial_lr=0.1, restart_patience=7, mode="max"), RatePolicy(policy="step_plateau", patience=300, factor=0.3, initial_lr=0.1, restart_patience=400),
])
@pytest.mark.parametrize("rounds,head", [(5, 8), (1, 2)])
def test_blocks_walked_side_by_side_equal_one_walk(spark, policy, rounds, head):
    metrics = shapes(random.Random(11))
    out = {}
    for r in rate_policy.replay(runs(spark, metrics), policy, block_steps=60, rounds=rounds, head=head).collect():
        out[r.run_id, r.step] = (r.metric, r.lr, r.best, r.stale, r.resting, r.decays, r.event)
    assert len(out) == sum(map(len, metrics.values()))
    for key, values in metrics.items():
        state = start(policy)
        for i, m in enumerate(values, 1):
            state = advance(policy, state, m, i)
            assert out[key, i] == (m, state.lr, state.best, state.stale, state.resting, state.decays, state.event), (key, i)


def test_best_over_runs(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 0.7), ("c", 0.4), ("d", N)], "model string, best_val_mae double")
    assert tuple(history.best_over_runs(df).first()) == (4, 0.4, "c")


def test_replay_needs_no_installed_package(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from thermogrid.session import local_session
from thermogrid.operators.rate_policy import RatePolicy, replay
spark = local_session(1, shuffle_partitions=1)
df = spark.createDataFrame([("a", i, 1.0) for i in range(4)], "run_id string, step long, val_loss double")
print("LR", [r.lr for r in replay(df, RatePolicy(initial_lr=0.1, patience=1)).orderBy("step").collect()])
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "LR [0.1, 0.05, 0.025, 0.0125]" in out.stdout, out.stderr[-800:]
