"""Analysis of training-metric logs: (`run_id`, `tag`, `step`, `value`), one row per point."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnflow.constants import IGNORED_LABEL
from turnflow.plans.ordering import with_position

TRAIN_LOSS = "train/loss"
EVAL_LOSS = "eval/loss"
LEARNING_RATE = "train/learning_rate"
GRADIENT_NORM = "train/grad_norm"
SERIES = ["run_id", "tag"]
STRETCH = 65_536
OVERFITTING_GAP = 0.5


def smooth(log: DataFrame, window: int = 5, stretch: int = STRETCH) -> DataFrame:
    """Add `smoothed`, the trailing mean; the first points and short series stay as they are.

    A series is cut into stretches of positions. The last points of a stretch are also
    given to the next one, so that its first means are complete.
    """
    if window - 1 > stretch:
        raise ValueError(f"a window of {window} points does not fit a stretch of {stretch}")
    placed = with_position(log, ["step"], tuple(SERIES), total="_size")
    home = F.floor(F.col("position") / stretch)
    lent = F.col("position") % stretch > stretch - window
    copies = F.when(lent, F.array(home, home + 1)).otherwise(F.array(home))
    near = Window.partitionBy(*SERIES, "_stretch").orderBy("position").rowsBetween(1 - window, 0)
    raw = (F.col("position") < window - 1) | (F.col("_size") <= window)
    means = (
        placed.withColumn("_stretch", F.explode(copies)).repartition(*SERIES, "_stretch")
        .withColumn("_mean", F.avg("value").over(near))
        .filter(F.col("_stretch") == home)
    )
    return means.select(
        *log.columns, F.when(raw, F.col("value")).otherwise(F.col("_mean")).alias("smoothed")
    )


def train_loss_report(log: DataFrame, tag: str = TRAIN_LOSS) -> DataFrame:
    """First, last and lowest value per run, and the improvement from first to last."""
    ends = log.filter(F.col("tag") == tag).groupBy("run_id").agg(
        F.min_by("value", "step").alias("initial"),
        F.max_by("value", "step").alias("final"),
        F.min("value").alias("min"),
    )
    return ends.withColumn("improvement", F.col("initial") - F.col("final"))


def _best_columns() -> list[Column]:
    return [
        F.min_by("value", "step").alias("initial"),
        F.max_by("value", "step").alias("final"),
        F.min("value").alias("best"),
        F.min_by("step", F.struct("value", "step")).alias("best_step"),
    ]


def eval_loss_report(log: DataFrame, tag: str = EVAL_LOSS) -> DataFrame:
    """First, last and best value per run, the step of the first best and its place in the series."""
    series = log.filter(F.col("tag") == tag).select("run_id", "tag", "step", "value")
    placed = with_position(series, ["step"], ("run_id",))
    # points of one step: the last one's place counts them all
    last = F.max("position").over(Window.partitionBy("run_id", "step"))
    return placed.withColumn("_place", last + 1).groupBy("run_id").agg(
        *_best_columns(), F.min_by("_place", F.struct("value", "step")).alias("best_epoch_approx")
    )


def overfitting_check(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Last evaluation loss minus last training loss, for the runs that have both."""
    gap = F.col("eval_final") - F.col("train_final")
    return train.select("run_id", F.col("final").alias("train_final")).join(
        evaluation.select("run_id", F.col("final").alias("eval_final")), "run_id"
    ).select("run_id", gap.alias("train_eval_gap"), (gap > OVERFITTING_GAP).alias("is_overfitting"))


def convergence_report(log: DataFrame, train_tag: str = TRAIN_LOSS, eval_tag: str = EVAL_LOSS) -> DataFrame:
    """The three reports as one JSON record per run; a part that a run lacks is left out."""
    train, evaluation = train_loss_report(log, train_tag), eval_loss_report(log, eval_tag)

    def part(df: DataFrame, name: str) -> DataFrame:
        return df.select("run_id", F.struct(*[c for c in df.columns if c != "run_id"]).alias(name))

    parts = part(train, "train_loss").join(part(evaluation, "eval_loss"), "run_id", "full").join(
        part(overfitting_check(train, evaluation), "overfitting"), "run_id", "left"
    )
    return parts.select("run_id", F.to_json(F.struct("train_loss", "eval_loss", "overfitting")).alias("report"))


def token_losses(logits: DataFrame) -> DataFrame:
    """Loss of each labeled token: the logits of a position score the label of the next one.

    The next label is read along the sequence. A table stored with `sources.logits.write_logits` is laid out
    for that, so its logits are not exchanged.
    """
    along = Window.partitionBy("seq").orderBy("pos")
    following = logits.withColumn("_next", F.lead(F.struct("pos", "label")).over(along))
    labeled = following.filter((F.col("_next.pos") == F.col("pos") + 1) & (F.col("_next.label") != IGNORED_LABEL))
    return labeled.select("seq", F.col("_next.pos").alias("pos"), _cross_entropy(F.col("logits"), F.col("_next.label")).alias("loss"))


def _cross_entropy(logits: Column, label: Column) -> Column:
    values = F.transform(logits, lambda x: x.cast("double"))
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return top + F.log(total) - F.get(values, label)


def masked_perplexity(logits: DataFrame) -> DataFrame:
    """Exponential of the mean loss over all labeled tokens; infinite from a mean of 100 on."""
    mean = token_losses(logits).agg(F.avg("loss").alias("mean_loss"), F.count("*").alias("tokens"))
    finite = F.exp(F.least("mean_loss", F.lit(100.0)))
    return mean.withColumn("perplexity", F.when(F.col("mean_loss") < 100, finite).otherwise(F.lit(float("inf"))))


def best_checkpoint(log: DataFrame, tag: str = EVAL_LOSS) -> DataFrame:
    """Step with the lowest evaluation loss per run, the first one on a tie."""
    best = log.filter(F.col("tag") == tag).groupBy("run_id").agg(*_best_columns())
    return best.select("run_id", "best_step", F.col("best").alias("best_loss"))


def early_stop_point(log: DataFrame, tag: str = EVAL_LOSS, patience: int = 3, stretch: int = STRETCH) -> DataFrame:
    """First step per run at which `patience` evaluations in a row brought no new best.

    A stretch of positions is summed up by its lowest value and the first place of it, which
    is its last new best if it beats the stretches before. One such row per stretch carries
    the best so far and the place of the last new best into the next.
    """
    series = log.filter(F.col("tag") == tag).select("run_id", "step", "value")
    placed = with_position(series, ["step"], ("run_id",)).withColumn("_stretch", F.floor(F.col("position") / stretch))
    earlier = Window.partitionBy("_run").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        placed.groupBy(F.col("run_id").alias("_run"), F.col("_stretch").alias("_of"))
        .agg(F.min("value").alias("_low"), F.min_by("position", F.struct("value", "position")).alias("_at"))
        .withColumn("_best", F.min("_low").over(earlier))
        .withColumn("_new_at", F.when(F.col("_best").isNull() | (F.col("_low") < F.col("_best")), F.col("_at")))
        .withColumn("_last", F.max("_new_at").over(earlier))
        .select("_run", "_of", "_best", "_last")
    )
    same = F.col("run_id").eqNullSafe(F.col("_run")) & (F.col("_stretch") == F.col("_of"))
    order = Window.partitionBy("run_id", "_stretch").orderBy("position")
    best = F.least("_best", F.min("value").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.when(best.isNull() | (F.col("value") < best), F.col("position"))
    since = (
        placed.join(carried, same).repartition("run_id", "_stretch").withColumn("_new", new)
        .withColumn("_since", F.greatest("_last", F.max("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    )
    return since.filter(F.col("position") - F.col("_since") >= patience).groupBy("run_id").agg(F.min("step").alias("stop_step"))


def training_curves(
    log: DataFrame,
    train_tag: str = TRAIN_LOSS,
    eval_tag: str = EVAL_LOSS,
    rate_tag: str = LEARNING_RATE,
    norm_tag: str = GRADIENT_NORM,
    window: int = 5,
) -> DataFrame:
    """Raw and smoothed series of the four charts; validation loss and learning rate are not smoothed."""
    panels = F.array(
        *[F.struct(F.lit(panel).alias("panel"), F.lit(tag).alias("of"), F.lit(smoothed).alias("keeps_smoothed"))
          for panel, tag, smoothed in [
              ("training_loss", train_tag, True),
              ("train_vs_eval", train_tag, True),
              ("train_vs_eval", eval_tag, False),
              ("learning_rate", rate_tag, False),
              ("gradient_norm", norm_tag, True),
          ]]
    )
    shown = log.filter(F.col("tag").isin(train_tag, eval_tag, rate_tag, norm_tag))
    return (
        smooth(shown, window)
        .withColumn("_panel", F.explode(F.filter(panels, lambda p: p["of"] == F.col("tag"))))
        .select(
            "run_id", F.col("_panel.panel").alias("panel"), "tag", "step", "value",
            F.when(F.col("_panel.keeps_smoothed"), F.col("smoothed")).alias("smoothed"),
        )
    )
