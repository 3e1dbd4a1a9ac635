"""Analysis of training histories: running best, stop rules, summaries.

Histories are long tables with one row per ``(run_id, step)``. Windows run over time-ordered blocks of
steps with carried summaries, so a run with very many steps does not end up in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RUN = "run_id"
STEP = "step"
BLOCK_STEPS = 10_000

# Steps before over-fitting is judged, and the tolerated rise of the validation loss.
OVERFIT_MIN_STEPS = 6
OVERFIT_RATIO = 1.25


def _blocked(history: DataFrame, block_steps: int) -> DataFrame:
    return history.withColumn("_block", F.floor(F.col(STEP) / block_steps))


def _earlier() -> Window:
    return Window.partitionBy(RUN).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)


def _inside() -> Window:
    return Window.partitionBy(RUN, "_block").orderBy(STEP)


def running_best(history: DataFrame, metric: str = "val_mae", block_steps: int = BLOCK_STEPS) -> DataFrame:
    """Best metric so far, whether the step improved on it strictly, and the step of the best.

    A prefix scan in two levels on plain numbers: a step is a block's candidate if its metric is below all before it in the block.
    The least metric and the last candidate of each block (its best) are hash aggregates, and carried over the blocks; a block whose best is below
    all earlier ones hands on that step.
    """
    before = _inside().rowsBetween(Window.unboundedPreceding, -1)
    to_here = _inside().rowsBetween(Window.unboundedPreceding, 0)
    low = F.min(metric).over(before)
    candidate = F.col(metric).isNotNull() & (low.isNull() | (F.col(metric) < low))
    rows = _blocked(history, block_steps).select(RUN, STEP, metric, "_block", F.when(candidate, F.col(STEP)).alias("_candidate"))
    blocks = rows.groupBy(RUN, "_block").agg(F.min(metric).alias("_low"), F.max("_candidate").alias("_at"))
    past = F.min("_low").over(_earlier())
    led = blocks.select(RUN, "_block", "_low", past.alias("_past"), F.when(past.isNull() | (F.col("_low") < past), F.col("_at")).alias("_lead"))
    carry = led.select(RUN, "_block", "_past", F.max("_lead").over(_earlier()).alias("_past_at"))
    joined = rows.join(carry, [RUN, "_block"])
    ahead = F.col("_candidate").isNotNull() & (F.col("_past").isNull() | (F.col(metric) < F.col("_past")))
    marked = joined.withColumn("_improved", F.when(ahead, F.col(STEP)))
    best_step = F.coalesce(F.max("_improved").over(to_here), F.col("_past_at"))
    best = F.least(F.min(metric).over(to_here), F.col("_past"))
    return marked.withColumns({"best_so_far": best, "best_step": best_step}).select(
        RUN, STEP, metric, "best_so_far", "best_step", (F.col("best_step") == F.col(STEP)).alias("improved")
    )


def overfit_flags(
    history: DataFrame, val_loss: str = "val_loss", train_loss: str = "train_loss", block_steps: int = BLOCK_STEPS
) -> DataFrame:
    """Steps at which validation loss has risen well above its minimum while training loss has fallen."""
    rows = _blocked(history, block_steps).select(RUN, STEP, val_loss, train_loss, "_block")
    blocks = rows.groupBy(RUN, "_block").agg(
        F.min(val_loss).alias("_low"), F.min(STEP).alias("_start"), F.min_by(train_loss, STEP).alias("_opening"))
    whole = Window.partitionBy(RUN).orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carry = blocks.select(
        RUN, "_block", F.min("_low").over(_earlier()).alias("_past_low"), F.first("_start").over(whole).alias("_start"), F.first("_opening").over(whole).alias("first_train_loss"))
    to_here = _inside().rowsBetween(Window.unboundedPreceding, 0)
    flagged = rows.join(carry, [RUN, "_block"]).select(
        RUN, STEP, val_loss, train_loss,
        F.least(F.min(val_loss).over(to_here), F.col("_past_low")).alias("lowest_val_loss"),
        "first_train_loss", (F.col(STEP) - F.col("_start") + 1).alias("steps_done"),
    )
    overfit = (
        (F.col("steps_done") >= OVERFIT_MIN_STEPS)
        & (F.col(val_loss) > F.lit(OVERFIT_RATIO) * F.col("lowest_val_loss"))
        & (F.col(train_loss) < F.col("first_train_loss"))
    )
    return flagged.withColumn("overfit", overfit)


def overfit_stops(flags: DataFrame, every: int) -> DataFrame:
    """First step at which a run judged only at the end of each block of ``every`` steps is found over-fitted; other runs have no row."""
    ends = flags.where(F.col("overfit") & (F.col("steps_done") % every == 0))
    return ends.groupBy(RUN).agg(F.min(STEP).alias("stopped_at"))


def fit_status(best: DataFrame, target: float, metric: str = "val_mae") -> DataFrame:
    """Per run: ``adequate`` once the best metric reaches the target, else ``underfit``."""
    per_run = best.groupBy(RUN).agg(
        F.min("best_so_far").alias("best"),
        F.max("best_step").alias("best_step"),
        F.min(F.when(F.col("best_so_far") <= target, F.col(STEP))).alias("reached_at"),
        F.count(F.lit(1)).alias("steps"),
    )
    return per_run.withColumn("status", F.when(F.col("reached_at").isNotNull(), "adequate").otherwise("underfit"))


def best_over_runs(runs: DataFrame, best: str = "best_val_mae", name: str = "model") -> DataFrame:
    """Number of models, and the least non-zero best error with its model."""
    usable = F.when(F.col(best) != 0, F.struct(F.col(best).alias("v"), F.col(name).alias("k")))
    return runs.agg(F.count(F.lit(1)).alias("models"), F.min(usable).alias("_b")).select(
        "models", F.col("_b.v").alias("best_val_mae"), F.col("_b.k").alias("best_model")
    )


def epoch_rows(histories: DataFrame) -> DataFrame:
    """Nested history records to one row per epoch (or stage)."""
    return histories.select("model", F.explode("epochs").alias("_e")).select("model", "_e.*")


def stage_rows(histories: DataFrame) -> DataFrame:
    return histories.select("model", F.explode("stages").alias("_e")).select("model", "_e.*")


def history_summary(histories: DataFrame) -> DataFrame:
    """Steps run, rate changes, best epoch and status of each model's history record."""
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    steps = F.coalesce(
        F.nullif(F.col("total_epochs"), F.lit(0)), F.nullif(size("epochs"), F.lit(0)), size("stages")
    )
    fit = (
        F.when(F.coalesce("overfitting_detected", F.lit(False)), "overfit")
        .when(F.coalesce("underfitting_detected", F.lit(False)), "underfit").otherwise("good")
    )
    return histories.select(
        "model", steps.alias("steps"), size("lr_decay_events").alias("rate_events"),
        F.coalesce("final_status", "status", F.lit("Completed")).alias("final_status"), fit.alias("fit"),
        F.coalesce("target_mae", F.lit(1.0)).alias("target_mae"), "best_val_mae", "best_epoch",
    )
