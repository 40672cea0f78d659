"""Training-metric queries."""

from pyspark.sql import functions as F

from catalog.explore import rounded
from catalog.registry import query
from turnflow.operators import training_metrics as metrics
from turnflow.sources.bridge import logits, metric_log
from turnflow.sources.logits import read_logits, write_logits
from turnflow.sources.metric_log import sorted_points

TRAIN, EVAL, RATE, NORM = "click", "view", "signup", "purchase"
LOG = "log AS (SELECT 'r0' AS run_id, event_type AS tag, event_id AS step, value FROM events)"
SMOOTHED = """smoothed AS (
  SELECT *, CASE WHEN nth < 5 OR n <= 5 THEN value ELSE mean END AS smoothed FROM (
    SELECT *, row_number() OVER w AS nth, count(*) OVER (PARTITION BY run_id, tag) AS n,
           avg(value) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS mean
    FROM log WINDOW w AS (PARTITION BY run_id, tag ORDER BY step)))"""


def log_sql(select: str) -> str:
    return f"WITH {LOG}, {SMOOTHED} {select}"


@query(log_sql("SELECT run_id, tag, step, value FROM log"))
def metric_points(spark, folder):
    log = metric_log(spark, folder)
    return sorted_points(log.unionByName(log))


@query(log_sql("SELECT run_id, tag, step, value, round(smoothed, 6) AS smoothed FROM smoothed"))
def smooth(spark, folder):
    return rounded(metrics.smooth(metric_log(spark, folder)), "smoothed")


TRAINED = f"""SELECT run_id, arg_min(value, step) AS initial, arg_max(value, step) AS final, min(value) AS min,
  round(arg_min(value, step) - arg_max(value, step), 6) AS improvement FROM log WHERE tag = '{TRAIN}' GROUP BY 1"""
EVALUATED = f"""SELECT run_id, arg_min(value, step) AS initial, arg_max(value, step) AS final, min(value) AS best,
  min(step) FILTER (value = low) AS best_step, min(nth) FILTER (value = low) AS best_epoch_approx
  FROM (SELECT *, min(value) OVER (PARTITION BY run_id) AS low, row_number() OVER (PARTITION BY run_id ORDER BY step) AS nth
        FROM log WHERE tag = '{EVAL}') GROUP BY 1"""


@query(log_sql(TRAINED))
def train_loss_report(spark, folder):
    return rounded(metrics.train_loss_report(metric_log(spark, folder), TRAIN), "improvement")


@query(log_sql(EVALUATED))
def eval_loss_report(spark, folder):
    return metrics.eval_loss_report(metric_log(spark, folder), EVAL)


GAP = f"SELECT t.run_id, e.final - t.final AS gap FROM ({TRAINED}) t JOIN ({EVALUATED}) e ON e.run_id = t.run_id"


@query(log_sql(f"SELECT run_id, round(gap, 6) AS train_eval_gap, gap > 0.5 AS is_overfitting FROM ({GAP})"))
def overfitting_check(spark, folder):
    log = metric_log(spark, folder)
    found = metrics.overfitting_check(metrics.train_loss_report(log, TRAIN), metrics.eval_loss_report(log, EVAL))
    return rounded(found, "train_eval_gap")


@query(log_sql(f"""SELECT t.run_id, t.min AS train_min, e.best_step, e.best_epoch_approx, round(gap, 6) AS gap
  FROM ({TRAINED}) t JOIN ({EVALUATED}) e ON e.run_id = t.run_id JOIN ({GAP}) g ON g.run_id = t.run_id"""))
def convergence_report(spark, folder):
    report = metrics.convergence_report(metric_log(spark, folder), TRAIN, EVAL)

    def field(path, kind):
        return F.get_json_object("report", path).cast(kind)

    return report.select(
        "run_id", field("$.train_loss.min", "double").alias("train_min"),
        field("$.eval_loss.best_step", "long").alias("best_step"),
        field("$.eval_loss.best_epoch_approx", "long").alias("best_epoch_approx"),
        F.round(field("$.overfitting.train_eval_gap", "double"), 6).alias("gap"),
    )


LOSSES = """WITH points AS (
  SELECT vec_id // 50 AS seq, vec_id % 50 AS pos, embedding::DOUBLE[] AS x, CASE WHEN vec_id % 4 = 0 THEN -100 ELSE label END AS label
  FROM embeddings
), losses AS (
  SELECT l.seq, l.pos, list_max(s.x) + ln(list_sum(list_transform(s.x, lambda v: exp(v - list_max(s.x))))) - s.x[l.label + 1] AS loss
  FROM points s JOIN points l ON l.seq = s.seq AND l.pos = s.pos + 1 WHERE l.label <> -100
)"""


@query(f"{LOSSES} SELECT seq, pos, round(loss, 6) AS loss FROM losses")
def token_losses(spark, folder):
    return rounded(metrics.token_losses(logits(spark, folder)), "loss")


@query(f"{LOSSES} SELECT round(avg(loss), 6) AS mean_loss, count(*) AS tokens, round(exp(avg(loss)), 6) AS perplexity FROM losses")
def masked_perplexity(spark, folder):
    return rounded(metrics.masked_perplexity(logits(spark, folder)), "mean_loss", "perplexity")


@query(f"{LOSSES} SELECT round(avg(loss), 6) AS mean_loss, count(*) AS tokens, round(exp(avg(loss)), 6) AS perplexity FROM losses")
def masked_perplexity_stored(spark, folder):
    """The same over a table laid out by sequence, whose logits stay where they are."""
    stored = read_logits(spark, write_logits(logits(spark, folder)))
    return rounded(metrics.masked_perplexity(stored), "mean_loss", "perplexity")


@query(log_sql(f"SELECT run_id, best_step, best AS best_loss FROM ({EVALUATED})"))
def best_checkpoint(spark, folder):
    return metrics.best_checkpoint(metric_log(spark, folder), EVAL)


@query(log_sql(f"""SELECT run_id, min(step) AS stop_step FROM (
  SELECT *, nth - max(CASE WHEN low IS NULL OR value < low THEN nth END) OVER (PARTITION BY run_id ORDER BY nth) AS waited FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step) AS nth,
           min(value) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low
    FROM log WHERE tag = '{EVAL}')) WHERE waited >= 40 GROUP BY 1"""))
def early_stop_point(spark, folder):
    return metrics.early_stop_point(metric_log(spark, folder), EVAL, patience=40)


def panel_sql(panel: str, tag: str, smoothed: bool) -> str:
    kept = "round(smoothed, 6)" if smoothed else "NULL::DOUBLE"
    return f"SELECT run_id, '{panel}' AS panel, tag, step, value, {kept} AS smoothed FROM smoothed WHERE tag = '{tag}'"


@query(log_sql(" UNION ALL ".join([
    panel_sql("training_loss", TRAIN, True), panel_sql("train_vs_eval", TRAIN, True), panel_sql("train_vs_eval", EVAL, False),
    panel_sql("learning_rate", RATE, False), panel_sql("gradient_norm", NORM, True),
])))
def training_curves(spark, folder):
    return rounded(metrics.training_curves(metric_log(spark, folder), TRAIN, EVAL, RATE, NORM), "smoothed")
