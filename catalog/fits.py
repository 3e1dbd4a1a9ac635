"""Fitted models and their run state, each with SQL that fits the same model in closed form or step by step.

``lineitem`` plays the training rows: quantity and discount explain the price (in thousands). Every fifth order is held out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from thermogrid.models.boosting import HistogramBoosting
from thermogrid.models.linear import GradientRidge, Ridge
from thermogrid.models.restartable import RestartableLinear
from thermogrid.models.trees import BoostedTrees
from thermogrid.operators import history, split
from thermogrid.operators.rate_policy import RatePolicy
from thermogrid.plans.forecast import JobParams, run_forecast, training_records
from thermogrid.schema import KEY
from thermogrid.session import materialise, scratch_path
from thermogrid.sources import readers, writers

from .inputs import CHUNK_HOURS, DATES, clean_grid, observations, table
from .oracle import OBS, PARTS, PLACED, SCALER, SCORES, SQL, chain, r
from .queries import WINDOW, _history, query

ALPHA = 2.0
STEADY = RatePolicy(monitor="val_mae", patience=999, initial_lr=0.1)
TARGETS = {"y": "y", "target_tmax": "y + quantity", "target_tmin": "y - 3 * discount", "target_tavg": "y * quantity / 10"}


def _priced(spark, sf):
    return materialise(table(spark, sf, "lineitem").selectExpr(
        "l_quantity as quantity", "l_discount as discount", "l_extendedprice / 1000 as y", "l_orderkey % 5 = 0 as held",
    ).selectExpr("*", *[f"{e} as {n}" for n, e in TARGETS.items() if n != "y"], "y as target_h1"))


PRICED = f"""priced AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in TARGETS.items() if n != 'y')} FROM (
  SELECT l_quantity AS quantity, l_discount AS discount, l_extendedprice / 1000 AS y, l_orderkey % 5 = 0 AS held FROM lineitem))"""


# --- ridge ----------------------------------------------------------------------------------------------


def _ridge(spark, sf):
    return Ridge(ALPHA, ["quantity", "discount"], ["y"]).fit(_priced(spark, sf).where("not held"))


@query
def ridge_weights(spark, sf):
    return _ridge(spark, sf).weights_table(spark)


@query
def model_files(spark, sf):
    """Weights after saving and loading."""
    path, features = scratch_path(spark), ["quantity", "discount"]
    _ridge(spark, sf).save(spark, path)
    return Ridge(ALPHA, features, ["y"]).load(spark, path).weights_table(spark)


def _solved():
    """Normal equations of two standardised columns with a penalty, solved by hand for each target."""
    sums = ", ".join(
        f"sum((quantity - ma) / sa * ({t} - m_{t})) AS a_{t}, sum((discount - mb) / sb * ({t} - m_{t})) AS b_{t}" for t in TARGETS)
    means = ", ".join(f"avg({t}) AS m_{t}" for t in TARGETS)
    ctes = (
        PRICED, "train AS (SELECT * FROM priced WHERE NOT held)",
        f"m AS (SELECT avg(quantity) AS ma, avg(discount) AS mb, stddev_samp(quantity) AS sa, stddev_samp(discount) AS sb, {means} FROM train)",
        f"""c AS (SELECT count(*) - 1 + {ALPHA} AS d, sum((quantity - ma) / sa * (discount - mb) / sb) AS ab, {sums} FROM train, m)""",
        "w AS (" + " UNION ALL ".join(
            f"""SELECT '{t}' AS target, m_{t} AS mean, ma, mb, (a_{t} * d - b_{t} * ab) / (d * d - ab * ab) / sa AS wa,
            (b_{t} * d - a_{t} * ab) / (d * d - ab * ab) / sb AS wb FROM c, m""" for t in TARGETS) + ")",
    )
    terms = {"": "mean - ma * wa - mb * wb", "quantity": "wa", "discount": "wb"}
    return chain(*ctes) + " UNION ALL ".join(
        f"SELECT 'ridge' AS model, target, '{n}' AS term, {r(e, 'weight')} FROM w" for n, e in terms.items())


SQL["ridge_weights"] = SQL["model_files"] = _solved()


@query
def collinear_weights(spark, sf):
    """Least squares on two columns that differ by 1e-7 of a third: what the first's unit brings, and the third's."""
    rows = _priced(spark, sf).where("not held").selectExpr("*", "quantity + 1e-7 * (discount * 100) as near")
    model = Ridge(0.0, ["quantity", "near"], ["y"]).fit(rows)
    w = {t: model.weights[:, i] for i, t in enumerate(TARGETS)}
    return spark.createDataFrame([(t, round(float(v[1] + v[2]), 4), round(float(v[2] * 1e-7), 4)) for t, v in w.items()], "target string, both double, apart double")


_APART = [PRICED, "near AS (SELECT *, (quantity + CAST(1e-7 AS DOUBLE) * (discount * 100) - quantity) / CAST(1e-7 AS DOUBLE) AS c FROM priced WHERE NOT held)",
          "m AS (SELECT avg(quantity) AS ma, avg(c) AS mc FROM near)",
          "p AS (SELECT sum((quantity - ma) * (quantity - ma)) AS aa, sum((quantity - ma) * (c - mc)) AS ac, sum((c - mc) * (c - mc)) AS cc FROM near, m)",
          "s AS (" + " UNION ALL ".join(f"SELECT '{t}' AS target, sum((quantity - ma) * {t}) AS ay, sum((c - mc) * {t}) AS cy FROM near, m" for t in TARGETS) + ")"]
SQL["collinear_weights"] = chain(*_APART) + f"""SELECT target, {r('round((ay * cc - cy * ac) / (aa * cc - ac * ac), 4)', 'both')},
  {r('round((cy * aa - ay * ac) / (aa * cc - ac * ac), 4)', 'apart')} FROM s, p"""


# --- gradient steps -------------------------------------------------------------------------------------

GRADIENT = dict(alpha=0.01, max_epochs=8, steps_per_epoch=2, block=3)


@query
def gradient_epochs(spark, sf):
    rows = _priced(spark, sf)
    model = GradientRidge(policy=STEADY, features=["quantity"], targets=["y"], **GRADIENT)
    model.fit(rows.where("not held"), rows.where("held"))
    return spark.createDataFrame(model.history, "epoch int, val_mae double, learning_rate double")


def _one_feature():
    """Training rows and all rows with the feature and the target standardised by training rows; the cross-product and count."""
    return (
        PRICED, """m AS (SELECT avg(quantity) AS mx, avg(y) AS my, stddev_samp(quantity) AS sx, stddev_pop(y) AS sy
        FROM priced WHERE NOT held)""",
        "z AS (SELECT held, (quantity - mx) / sx AS x, (y - my) / sy AS y, sy FROM priced, m)",
        "c AS (SELECT sum(x * x) AS xx, sum(x * y) AS xy, count(*) AS n FROM z WHERE NOT held)",
    )


SQL["gradient_epochs"] = "WITH RECURSIVE " + ",\n".join((*_one_feature(), f"""
steps AS (SELECT 0 AS t, CAST(0 AS DOUBLE) AS w UNION ALL
  SELECT t + 1, w - {STEADY.initial_lr} * ((xx * w - xy) / n + {GRADIENT['alpha']} * w) FROM steps, c WHERE t < 16)""")) + f"""
SELECT CAST(t / 2 AS INTEGER) AS epoch, {r('avg(abs(w * x - y) * sy)', 'val_mae')}, {r(str(STEADY.initial_lr), 'learning_rate')}
FROM steps, z WHERE held AND t > 0 AND t % 2 = 0 GROUP BY t"""


# --- restartable run ------------------------------------------------------------------------------------

RUN = dict(learning_rate=0.02, policy=RatePolicy(patience=999), epochs_per_iter=2, max_iters=2, target_mae=0.0, steps_per_epoch=5)


@query
def restartable_epochs(spark, sf):
    """Two blocks, then two more by a second job that resumes the run folder: the history of one long run."""
    rows, path = _priced(spark, sf), scratch_path(spark)
    for reset in (True, False):
        model = RestartableLinear(features=["quantity"], targets=["y"], **RUN)
        model.fit(rows.where("not held"), rows.where("held"), run_path=path, reset=reset)
    return model.history_table(spark)


#: The rate is halved after every epoch but the first, as no loss gains what the policy asks for.
FALLING = {**RUN, "policy": RatePolicy(patience=1, min_delta=1e9, factor=0.5, min_lr=1e-9)}


@query
def restartable_rates(spark, sf):
    """Two jobs of two blocks while the rate falls: the second goes on from the first's weights, optimiser and policy."""
    rows, path = _priced(spark, sf), scratch_path(spark)
    for reset in (True, False):
        model = RestartableLinear(features=["quantity"], targets=["y"], **FALLING)
        model.fit(rows.where("not held"), rows.where("held"), run_path=path, reset=reset)
    return model.history_table(spark)


def _adam(names, slopes, lr):
    """Select list of one Adam step: ``slopes`` are SQL of each weight's slope, ``t`` the steps done."""
    out = []
    for name, slope in zip(names, slopes):
        mean, square = f"(0.9 * m_{name} + CAST(0.1 AS DOUBLE) * ({slope}))", f"(0.999 * s_{name} + CAST(0.001 AS DOUBLE) * ({slope}) * ({slope}))"
        step = f"{mean} / (1 - pow(CAST(0.9 AS DOUBLE), t + 1)) / (sqrt({square} / (1 - pow(CAST(0.999 AS DOUBLE), t + 1))) + 1e-7)"
        out += [f"{name} - {lr} * {step} AS {name}", f"{mean} AS m_{name}", f"{square} AS s_{name}"]
    return ", ".join(out)


def _zeros(names):
    return ", ".join(f"CAST(0 AS DOUBLE) AS {p}{n}" for n in names for p in ("", "m_", "s_"))


SQL["restartable_epochs"] = "WITH RECURSIVE " + ",\n".join((*_one_feature(), f"""
steps AS (SELECT 0 AS t, {_zeros(['w'])} UNION ALL
  SELECT t + 1, {_adam(['w'], ['(xx * w - xy) / n'], RUN['learning_rate'])} FROM steps, c WHERE t < 40)""")) + f"""
SELECT CAST((t + 5) // 10 AS INTEGER) AS iteration, CAST(t // 5 AS INTEGER) AS epoch,
  {r('avg((w * x - y) * (w * x - y)) FILTER (NOT held)', 'train_loss')}, {r('avg((w * x - y) * (w * x - y)) FILTER (held)', 'val_loss')},
  {r('avg(abs(w * x - y) * sy) FILTER (NOT held)', 'train_mae')}, {r('avg(abs(w * x - y) * sy) FILTER (held)', 'val_mae')},
  {r(str(RUN['learning_rate']), 'lr')}
FROM steps, z WHERE t > 0 AND t % 5 = 0 GROUP BY t"""


_RATE = f"({RUN['learning_rate']} * pow(CAST(0.5 AS DOUBLE), greatest(t // 5 - 1, 0)))"
SQL["restartable_rates"] = SQL["restartable_epochs"].replace(_adam(["w"], ["(xx * w - xy) / n"], RUN["learning_rate"]), _adam(["w"], ["(xx * w - xy) / n"], _RATE)).replace(
    r(str(RUN["learning_rate"]), "lr"), r(_RATE.replace("t // 5", "(t // 5 - 1)"), "lr"))


# --- last step of sliding windows -----------------------------------------------------------------------


def _last_step():
    """Adam on the cross-products of the last input step (two columns) and six label steps, until two epochs bring nothing."""
    labels, last = range(1, WINDOW.label_width + 1), WINDOW.total - 1
    w = "(PARTITION BY series_id, split ORDER BY pos)"
    ahead = ", ".join(f"lead(temp, {WINDOW.label_start + i - 1}) OVER {w} AS y_{i}" for i in labels)
    products = {"n": "count(*)", "a": "sum(xa)", "b": "sum(xb)", "aa": "sum(xa * xa)", "ab": "sum(xa * xb)", "bb": "sum(xb * xb)"}
    per_label = ", ".join(f"[sum(y_{i}), sum(xa * y_{i}), sum(xb * y_{i}), sum(y_{i} * y_{i})]" for i in labels)
    slopes = ["(n * w0 + a * w1 + b * w2 - y0) / n", "(a * w0 + aa * w1 + ab * w2 - ya) / n", "(b * w0 + ab * w1 + bb * w2 - yb) / n"]
    loss = """sum(n * w0 * w0 + aa * w1 * w1 + bb * w2 * w2 + 2 * (a * w0 * w1 + b * w0 * w2 + ab * w1 * w2)
      - 2 * (y0 * w0 + ya * w1 + yb * w2) + yy)"""
    return "WITH RECURSIVE " + ",\n".join((
        OBS, PLACED, PARTS, SCALER,
        "z AS (SELECT series_id, pos, split, (temp - temp_mean) / temp_std AS temp, (dew - dew_mean) / dew_std AS dew FROM parts JOIN scaler USING (series_id))",
        f"""windows AS (SELECT * FROM (SELECT split, lead(temp, {WINDOW.input_width - 1}) OVER {w} AS xa, lead(dew, {WINDOW.input_width - 1}) OVER {w} AS xb,
          {ahead}, lead(pos, {last}) OVER {w} IS NOT NULL AS whole FROM z) WHERE whole AND split <> 'test')""",
        f"sums AS (SELECT split, {', '.join(f'{e} AS {k}' for k, e in products.items())}, [{per_label}] AS per FROM windows GROUP BY split)",
        f"""c AS (SELECT * EXCLUDE (per), per[j][1] AS y0, per[j][2] AS ya, per[j][3] AS yb, per[j][4] AS yy
          FROM sums, (SELECT unnest(range(1, {WINDOW.label_width + 1})) AS j))""",
        f"""steps AS (SELECT 0 AS t, j, {_zeros(['w0', 'w1', 'w2'])} FROM c WHERE split = 'train' UNION ALL
          SELECT t + 1, j, {_adam(['w0', 'w1', 'w2'], slopes, 0.001)} FROM steps JOIN c USING (j) WHERE split = 'train' AND t < 1000)""",
        f"""losses AS (SELECT t // 50 AS epoch, {loss} FILTER (split = 'train') / any_value(n) FILTER (split = 'train') / {WINDOW.label_width} AS loss,
          {loss} FILTER (split = 'val') / any_value(n) FILTER (split = 'val') / {WINDOW.label_width} AS val_loss
          FROM steps JOIN c USING (j) WHERE t > 0 AND t % 50 = 0 GROUP BY t)""",
        """stale AS (SELECT *, val_loss >= min(val_loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS waits FROM losses)""",
        "ends AS (SELECT min(epoch) AS last FROM (SELECT epoch, waits AND lag(waits) OVER (ORDER BY epoch) AS stops FROM stale) WHERE stops)",
    )) + f"""
SELECT CAST(epoch AS BIGINT) AS epoch, {r('loss')}, {r('val_loss')}, 'last_step' AS model FROM losses, ends WHERE epoch <= coalesce(last, 20)"""


SQL["last_step_linear"] = _last_step()


# --- boosted stumps -------------------------------------------------------------------------------------


@query
def boosted_stumps(spark, sf):
    """Two trees of one split each; the forecast at every value of the feature."""
    rows = _priced(spark, sf)
    model = BoostedTrees(horizons=(1,), max_iter=2, max_depth=1, learning_rate=0.1, features=["discount"]).fit(rows.where("not held"))
    return model.predict(rows.select("discount").distinct()).select(
        "discount", F.col("pred_trees.yhat")[0].alias("y"), *[F.col(f"pred_trees.{s}").alias(s) for s in ("tmax", "tmin", "tavg")])


def _stump(source, out):
    """Best split of the ordered values by squared error, and the mean on the side of each value. ``source``: target, v, n, s."""
    sides = f"""{out}_l AS (SELECT target, v, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER a AS nt, sum(s) OVER a AS st FROM {source}
      WINDOW w AS (PARTITION BY target ORDER BY v), a AS (PARTITION BY target))"""
    best = f"""{out}_b AS (SELECT target, arg_max({{'v': v, 'l': sl / nl, 'r': (st - sl) / (nt - nl)}}, sl * sl / nl + (st - sl) * (st - sl) / (nt - nl)) AS b
      FROM {out}_l WHERE nt > nl GROUP BY target)"""
    return sides, best, f"{out} AS (SELECT target, v, n, s, CASE WHEN v <= b.v THEN b.l ELSE b.r END AS f FROM {source} JOIN {out}_b USING (target))"


_HATS = {"y": "y", "target_tmax": "tmax", "target_tmin": "tmin", "target_tavg": "tavg"}
SQL["boosted_stumps"] = chain(
    PRICED, "sums AS (" + " UNION ALL ".join(
        f"SELECT '{t}' AS target, discount AS v, count(*) AS n, sum({t}) AS s FROM priced WHERE NOT held GROUP BY discount" for t in TARGETS) + ")",
    *_stump("sums", "one"),
    # The library's second tree is fitted to twice what is left.
    "left_over AS (SELECT target, v, n, 2 * (s - n * f) AS s FROM one)", *_stump("left_over", "two"),
    "hat AS (SELECT target, v, one.f + 0.1 * two.f AS p FROM one JOIN two USING (target, v))",
) + f"SELECT {r('v', 'discount')}, " + ", ".join(r(f"max(p) FILTER (target = '{t}')", n) for t, n in _HATS.items()) + " FROM hat GROUP BY v"


# --- one ensemble in stages -----------------------------------------------------------------------------

#: Three stages of a tree of depth two; the rate is halved after the second, as no error gains what the policy asks for.
STAGED = dict(horizons=(1,), max_iter=3, stage_trees=1, max_depth=2, max_bins=256, learning_rate=0.5, features=["quantity", "discount"],
              policy=RatePolicy(monitor="val_mae", patience=1, min_delta=1e9, factor=0.5, min_lr=1e-5))
STAGE_RATES = (0.5, 0.5, 0.25)


def _staged(spark, sf):
    rows = _priced(spark, sf)
    return rows, HistogramBoosting(**STAGED).fit(rows.where("not held"), rows.where("held"))


@query
def boosted_margin(spark, sf):
    """The forecast of the whole ensemble at every pair of values of the features."""
    rows, model = _staged(spark, sf)
    return model.predict(rows.select("quantity", "discount").distinct()).select(
        "quantity", "discount", F.col("pred_trees.yhat")[0].alias("y"), *[F.col(f"pred_trees.{s}").alias(s) for s in ("tmax", "tmin", "tavg")])


@query
def boosted_stages(spark, sf):
    """Trees, held-out error and rate of each stage."""
    return spark.createDataFrame(_staged(spark, sf)[1].history, "stage long, trees_fitted long, val_mae double, learning_rate double")


def _grown(source, out, depth, rate, least=20):
    """CTEs of one tree on what ``source`` (target, q, d, n, s, p) leaves over in its cells; ``out`` is the same with the tree taken off."""
    steps, at = [f"{out}_0 AS (SELECT *, 0 AS node FROM {source})"], f"{out}_0"
    for level in range(depth):
        sides = " UNION ALL ".join(f"""SELECT target, node, '{f}' AS f, {f} AS v, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER a AS nt, sum(s) OVER a AS st
          FROM (SELECT target, node, {f}, sum(n) AS n, sum(s) AS s FROM {at} GROUP BY target, node, {f} HAVING sum(n) > 0)
          WINDOW w AS (PARTITION BY target, node ORDER BY {f}), a AS (PARTITION BY target, node)""" for f in "qd")
        steps += [f"{out}_s{level} AS ({sides})",
                  f"""{out}_b{level} AS (SELECT target, node, arg_max({{'f': f, 'v': v}}, sl * sl / nl + (st - sl) * (st - sl) / (nt - nl)) AS b
                    FROM {out}_s{level} WHERE nl >= {least} AND nt - nl >= {least} GROUP BY target, node)""",
                  f"""{out}_{level + 1} AS (SELECT x.* EXCLUDE (node), 2 * node + CASE WHEN CASE WHEN b.f = 'q' THEN q ELSE d END > b.v THEN 2 ELSE 1 END AS node
                    FROM {at} AS x JOIN {out}_b{level} USING (target, node))"""]
        at = f"{out}_{level + 1}"
    leaf = "sum(s) OVER l / sum(n) OVER l"
    return [*steps, f"""{out} AS (SELECT target, q, d, n, s - {rate} * n * m AS s, p + {rate} * m AS p
      FROM (SELECT *, {leaf} AS m FROM {at} WINDOW l AS (PARTITION BY target, node)))"""]


_ENSEMBLE = [PRICED, "cells AS (" + " UNION ALL ".join(
    f"""SELECT '{t}' AS target, quantity AS q, discount AS d, count(*) FILTER (NOT held) AS n, coalesce(sum({t}) FILTER (NOT held), 0) AS s
    FROM priced GROUP BY quantity, discount""" for t in TARGETS) + ")",
    "tree0 AS (SELECT target, q, d, n, s - n * m AS s, m AS p FROM (SELECT *, sum(s) OVER (PARTITION BY target) / sum(n) OVER (PARTITION BY target) AS m FROM cells))"]
for _k, _rate in enumerate(STAGE_RATES):
    _ENSEMBLE += _grown(f"tree{_k}", f"tree{_k + 1}", STAGED["max_depth"], _rate)
SQL["boosted_margin"] = chain(*_ENSEMBLE) + f"SELECT {r('q', 'quantity')}, {r('d', 'discount')}, " + ", ".join(
    r(f"max(p) FILTER (target = '{t}')", n) for t, n in _HATS.items()) + f" FROM tree{len(STAGE_RATES)} GROUP BY q, d"
SQL["boosted_stages"] = chain(*_ENSEMBLE) + " UNION ALL ".join(
    f"""SELECT CAST({k} AS BIGINT) AS stage, CAST({k} AS BIGINT) AS trees_fitted, {r('avg(abs(y - p))', 'val_mae')}, {r(str(_rate), 'learning_rate')}
    FROM priced JOIN tree{k} ON quantity = q AND discount = d WHERE held AND target = 'y'""" for k, _rate in enumerate(STAGE_RATES, 1))


# --- scaling, histories and run folders -----------------------------------------------------------------


@query
def inverse_scaling(spark, sf):
    """Scaled by the training rows of each series and back."""
    rows, columns = materialise(split.positional_split(observations(spark, sf), ["event_id"])), ["temp", "dew"]
    scaler = split.fit_scaler(rows.where(F.col("split") == "train"), columns, [KEY])
    back = split.invert_scaling(split.standardize(rows, scaler, columns, [KEY]), scaler, columns, [KEY])
    return back.select("series_id", "event_id", "temp", "dew", "split")


SQL["inverse_scaling"] = chain(OBS, PLACED, PARTS) + f"SELECT series_id, event_id, {r('temp')}, {r('dew')}, split FROM parts"


@query
def history_files(spark, sf):
    """Records of runs (a run per segment, an epoch per year and month), written as one keyed file and read back."""
    orders = table(spark, sf, "orders").join(
        table(spark, sf, "customer").selectExpr("c_custkey as o_custkey", "c_mktsegment as model"), "o_custkey")
    epochs = orders.groupBy("model", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        F.max("o_totalprice").alias("val_mae"), F.count(F.lit(1)).alias("n"))
    runs = epochs.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("month", "val_mae", "n"))).alias("_e"))
    records = runs.selectExpr(
        "model", "transform(_e, (e, i) -> named_struct('epoch', cast(i + 1 as int), 'val_mae', e.val_mae, 'lr', e.n / 10)) as epochs",
        "transform(filter(_e, e -> e.n % 2 = 0), e -> named_struct('step', cast(e.n as int), 'policy', e.month)) as lr_decay_events",
        "array_min(_e.val_mae) as best_val_mae", "cast(array_position(_e.val_mae, array_min(_e.val_mae)) as int) as best_epoch",
        "model < 'D' as overfitting_detected",
    )
    path = scratch_path(spark)
    writers.write_histories(records, path)
    back = readers.read_histories(spark, path, {})
    events = back.select("model", F.expr("aggregate(lr_decay_events.step, 0, (a, s) -> a + s)").alias("event_steps"),
                         F.expr("aggregate(epochs.lr, 0D, (a, s) -> a + s)").alias("lr_sum"))
    return history.history_summary(back).join(events, "model")


SQL["history_files"] = f"""WITH e AS (SELECT c_mktsegment AS model, strftime(o_orderdate, '%Y-%m') AS month, max(o_totalprice) AS v, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY month) AS epoch FROM e)
SELECT model, CAST(count(*) AS INTEGER) AS steps, CAST(count(*) FILTER (n % 2 = 0) AS INTEGER) AS rate_events, 'Completed' AS final_status,
  CASE WHEN model < 'D' THEN 'overfit' ELSE 'good' END AS fit, {r('CAST(1 AS DOUBLE)', 'target_mae')}, {r('min(v)', 'best_val_mae')},
  CAST(arg_min(epoch, (v, epoch)) AS INTEGER) AS best_epoch, CAST(coalesce(sum(n) FILTER (n % 2 = 0), 0) AS INTEGER) AS event_steps,
  {r('sum(n / 10)', 'lr_sum')} FROM k GROUP BY model"""


@query
def job_histories(spark, sf):
    """What a job writes of all models that learn step by step, read back: each model's steps with errors and rates."""
    rows, path = _priced(spark, sf), scratch_path(spark)
    train, held = rows.where("not held"), rows.where("held")
    steepest = GradientRidge(policy=STEADY, features=["quantity"], targets=["y"], **GRADIENT).fit(train, held)
    blocks = RestartableLinear(features=["quantity"], targets=["y"], **{**RUN, "max_iters": 4}).fit(train, held)
    trees = HistogramBoosting(**STAGED).fit(train, held)
    writers.write_histories(training_records([steepest, blocks, trees], spark), path)
    back = readers.read_histories(spark, path, {})
    stages = history.stage_rows(back).select("model", F.col("stage").alias("step"), "val_mae", "learning_rate")
    epochs = history.epoch_rows(back).select("model", F.col("epoch").alias("step"), "val_mae", F.coalesce("lr", "learning_rate").alias("learning_rate"))
    return epochs.unionByName(stages)


def _within(name, columns):
    return f"SELECT {columns} FROM ({SQL[name]})"


SQL["job_histories"] = " UNION ALL ".join([
    _within("gradient_epochs", "'ridge_gradient' AS model, epoch AS step, val_mae, learning_rate"), _within("restartable_epochs", "'linear' AS model, epoch AS step, val_mae, lr AS learning_rate"),
    _within("boosted_stages", "'trees' AS model, CAST(stage AS INTEGER) AS step, val_mae, learning_rate")])


@query
def stage_flags(spark, sf):
    """Whole jobs with one model and with two chosen: the scores of what each ran."""
    series = materialise(clean_grid(spark, sf))
    jobs = {"one": ("persistence",), "two": ("persistence", "climatology")}
    out = [run_forecast(series, JobParams(models=models, dates=DATES, chunk_hours=CHUNK_HOURS))["scores"].select(F.lit(job).alias("job"), "model", "rows", "mae", "rmse", "acc_1")
           for job, models in jobs.items()]
    return out[0].unionByName(out[1])


_SCORED = chain(*[c.replace(f"ts >= TIMESTAMP '{DATES.val_start}'", f"ts >= TIMESTAMP '{DATES.test_start}'") for c in SCORES])
SQL["stage_flags"] = _SCORED + f"""SELECT job, model, rows, {r('mae')}, {r('rmse')}, {r('acc_1')} FROM scores, (SELECT unnest(['one', 'two']) AS job)
WHERE job = 'two' OR model = 'persistence'"""


@query
def run_modes(spark, sf):
    """A run folder from new over half written to resumed and reset: the mode found, and the rows of state there."""
    path, needed, found = scratch_path(spark), ["state", "more"], []
    state = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("split"))

    def look(moment):
        try:
            mode = writers.choose_mode(spark, path, needed)
        except ValueError:
            mode = "incomplete"
        parts = readers.read_splits(spark, f"{path}/state") if mode != "reset" else {}
        found.append((moment, mode, spark.read.parquet(f"{path}/state").count() if parts else 0))
        return mode

    look("new")
    writers.write_splits(state, f"{path}/state")
    look("half")
    writers.write_splits(state, f"{path}/more")
    writers.prepare_outputs(spark, path, look("whole"))
    look("resumed")
    writers.prepare_outputs(spark, path, "reset")
    look("wiped")
    return spark.createDataFrame(found, "moment string, mode string, state_rows long")


SQL["run_modes"] = """SELECT moment, mode, n * (SELECT count(*) FROM orders) AS state_rows FROM (VALUES
  ('new', 'reset', 0), ('half', 'incomplete', 1), ('whole', 'resume', 1), ('resumed', 'resume', 1), ('wiped', 'reset', 0)) AS v(moment, mode, n)"""


@query
def history_block_ends(spark, sf):
    """Runs stopped as over-fitted, judged after every third step."""
    return history.overfit_stops(history.overfit_flags(_history(spark, sf)), every=3)


SQL["history_block_ends"] = SQL["history_overfit"].split("SELECT run_id, step,")[0] + """SELECT run_id, min(step) AS stopped_at FROM (
  SELECT *, min(value) OVER w AS low, first_value(train_loss) OVER w AS first FROM runs WINDOW w AS (PARTITION BY run_id ORDER BY step))
WHERE step % 3 = 0 AND step >= 6 AND value > 1.25 * low AND train_loss < first GROUP BY run_id"""
