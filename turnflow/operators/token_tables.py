"""Token counts, statistics and fixed-length token rows of a table of training examples."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnflow.constants import (
    CONTEXT_LENGTH, IGNORED_LABEL, PAD_ID, STORED_PERCENTILES, TOKENIZE_LENGTH, TRAINING_LENGTH,
)
from turnflow.functions.chat import MESSAGE_END, conversation_for_sft, render_chat, render_prompt
from turnflow.functions.tokens import (
    WorkerTokenizer, attention_mask, count_tokens, pad, piece_ids, pieces, tokenize, tokenize_at,
)
from turnflow.operators.checks import require_columns, require_rows
from turnflow.plans.shared import with_computed_once, written

Tokenizer = Callable[[list[str]], list[list[int]]]


def _cut(column: str, length: int) -> Column:
    return F.slice(column, 1, length)


def tokenize_dataset(
    df: DataFrame,
    tokenizer: Tokenizer | None = None,
    max_length: int = TOKENIZE_LENGTH,
    truncation: bool = True,
    padding: bool = True,
    pad_id: int = PAD_ID,
) -> DataFrame:
    """Ids of the rendered messages, cut and padded, with mask; labels repeat the ids, padding too."""
    require_columns(df, ["messages"])
    text = render_chat(F.col("messages"))
    if tokenizer is None:
        kept = df.withColumn("_pieces", pieces(text))
        if truncation:
            kept = kept.withColumn("_pieces", _cut("_pieces", max_length))
        kept = with_computed_once(kept, "_ids", piece_ids(F.col("_pieces")))
    else:
        kept = with_computed_once(df, "_ids", tokenize(text, tokenizer))
        if truncation:
            kept = kept.withColumn("_ids", _cut("_ids", max_length))
    length = max_length if padding else 0
    padded = kept.withColumn("input_ids", pad(F.col("_ids"), length, pad_id))
    return padded.select(
        "input_ids",
        attention_mask(F.size("_ids"), length).alias("attention_mask"),
        F.col("input_ids").alias("labels"),
        (F.col("original_index") if "original_index" in df.columns else F.lit(-1).cast("long")).alias("original_index"),
        (F.col("num_turns") if "num_turns" in df.columns else F.lit(0)).alias("num_turns"),
    )


def with_token_count(df: DataFrame, tokenizer: Tokenizer | None = None) -> DataFrame:
    """Add `token_count`: the ids there are, else the tokens of the messages without the target."""
    if "input_ids" in df.columns:
        return df.withColumn("token_count", F.size("input_ids"))
    text = render_chat(F.col("messages"))
    count = count_tokens(text) if tokenizer is None else F.size(tokenize(text, tokenizer))
    return with_computed_once(df, "token_count", count)


def token_statistics(counts: DataFrame, by: str | None = None) -> DataFrame:
    """Size, moments and exact interpolated percentiles of `token_count`.

    An exact percentile holds one counter per distinct count, so its memory follows the
    longest example and not the number of rows.
    """
    grouped = counts.groupBy(by) if by else counts.groupBy()
    shares = F.array(*[F.lit(p / 100) for p in STORED_PERCENTILES])
    stats = grouped.agg(
        F.count("*").alias("n"),
        F.avg("token_count").alias("mean"),
        F.min("token_count").cast("long").alias("min"),
        F.max("token_count").cast("long").alias("max"),
        F.stddev_pop("token_count").alias("std"),
        F.percentile("token_count", shares).alias("_p"),
    )
    named = {f"p{p}": F.col("_p")[i] for i, p in enumerate(STORED_PERCENTILES)}
    return stats.withColumns(named).withColumn("median", F.col("p50")).drop("_p")


def mark_truncated(df: DataFrame, max_length: int | Column = CONTEXT_LENGTH) -> DataFrame:
    """Add whether `token_count` exceeds the limit, and by how much."""
    limit = F.lit(max_length)
    return df.withColumns({
        "will_truncate": F.col("token_count") > limit,
        "tokens_over_limit": F.greatest(F.col("token_count") - limit, F.lit(0)),
    })


def truncation_stats(marked: DataFrame, by: str | None = None) -> DataFrame:
    """Truncated rows, their percentage, the largest and the mean excess.

    `truncated_rows` has the rows themselves: their number follows the table.
    """
    grouped = marked.groupBy(by) if by else marked.groupBy()
    excess = F.when(F.col("will_truncate"), F.col("tokens_over_limit"))
    truncated = F.count_if("will_truncate")
    return grouped.agg(
        F.count("*").alias("total_examples"),
        truncated.alias("truncated_count"),
        F.try_divide(truncated * 100.0, F.count("*")).alias("truncated_percentage"),
        F.max("tokens_over_limit").cast("long").alias("max_tokens_over"),
        F.coalesce(F.avg(excess), F.lit(0.0)).alias("avg_tokens_over"),
    )


def truncated_rows(marked: DataFrame) -> DataFrame:
    """Index and excess of the rows that will be truncated."""
    return marked.filter("will_truncate").select("original_index", "tokens_over_limit")


def truncation_report(df: DataFrame, max_length: int = CONTEXT_LENGTH) -> tuple[DataFrame, DataFrame]:
    """Marked rows and their statistics; an empty table is an error."""
    require_rows(df, "cannot process an empty dataset")
    marked = mark_truncated(with_token_count(df), max_length)
    return marked, truncation_stats(marked)


def recommended_max_length(counts: DataFrame, percentile: float = 95.0) -> DataFrame:
    """One row with the length: a stored percentile, or mean + 2 deviations for any other."""
    if not 0 <= percentile <= 100:
        raise ValueError(f"percentile must be between 0 and 100, got {percentile}")
    share = int(percentile)
    stats = token_statistics(counts)
    value = F.col(f"p{share}") if share in STORED_PERCENTILES else F.col("mean") + 2 * F.col("std")
    return stats.select(value.cast("long").alias("recommended_max_length"))


def analyze_splits(df: DataFrame, percentile: float = 95.0) -> tuple[DataFrame, DataFrame]:
    """Token and truncation statistics per split, and the overall truncated share.

    The limit comes from the train split. Tokens are counted once: all steps read the
    written counts.
    """
    counted = df if "token_count" in df.columns else with_token_count(df)
    counts = written(counted.select("split", "original_index", "token_count"), "token-counts")
    limit = recommended_max_length(counts.filter(F.col("split") == "train"), percentile).scalar()
    marked = mark_truncated(counts, limit)
    per_split = token_statistics(counts, "split").join(truncation_stats(marked, "split"), "split")
    truncated = F.count_if("will_truncate")
    overall = marked.agg(
        F.max(limit).alias("recommended_max_length"),
        F.count("*").alias("total_examples"),
        truncated.alias("truncated_count"),
        F.try_divide(truncated * 100.0, F.count("*")).alias("truncated_percentage"),
    )
    return per_split.withColumn("recommended_max_length", limit), overall


def prepare_sft(
    df: DataFrame,
    tokenizer: Tokenizer | None = None,
    max_length: int = TRAINING_LENGTH,
    pad_id: int = PAD_ID,
) -> DataFrame:
    """Ids, mask and labels for training on the answer only.

    Labels hold the ignored value over the prompt and over padding. With the built-in
    tokenizer the prompt's pieces are reused for the full text: the answer starts on a
    new line, where no piece goes across. A `WorkerTokenizer` encodes the full text once and tells by the places of its tokens
    where the answer begins; any other function of texts encodes the prompt as well.
    """
    require_columns(df, ["messages", "target_response"])
    messages, target = F.col("messages"), F.col("target_response")
    full = conversation_for_sft(messages, target)
    if tokenizer is None:
        prompt = pieces(render_prompt(F.slice(full, F.lit(1), F.size(full) - 1)))
        answer = pieces(F.concat(target, F.lit(MESSAGE_END)))
        rows = with_computed_once(df, "_prompt", prompt).withColumn("_prompt_length", F.size("_prompt"))
        rows = with_computed_once(rows, "_ids", piece_ids(F.slice(F.concat("_prompt", answer), 1, max_length)))
    elif isinstance(tokenizer, WorkerTokenizer):
        cut = with_computed_once(df, "_prompt", F.length(render_prompt(messages)))
        found = with_computed_once(cut, "_found", tokenize_at(render_chat(full), F.col("_prompt"), tokenizer))
        rows = found.withColumns({"_prompt_length": F.col("_found.before"), "_ids": F.slice("_found.ids", 1, max_length)})
    else:
        rows = with_computed_once(df, "_prompt_length", F.size(tokenize(render_prompt(messages), tokenizer)))
        rows = with_computed_once(rows, "_ids", F.slice(tokenize(render_chat(full), tokenizer), 1, max_length))
    ids, masked = F.col("_ids"), F.least(F.col("_prompt_length"), F.size("_ids"))
    labels = F.concat(
        F.array_repeat(F.lit(IGNORED_LABEL), masked), F.slice(ids, masked + 1, F.size(ids) - masked)
    )
    return rows.select(
        pad(F.col("_ids"), max_length, pad_id).alias("input_ids"),
        attention_mask(F.size("_ids"), max_length).alias("attention_mask"),
        pad(labels, max_length, IGNORED_LABEL).alias("labels"),
        *[F.col(c) for c in ("original_index", "num_turns") if c in df.columns],
    )


def untrainable_examples(prepared: DataFrame) -> DataFrame:
    """Rows without a single trainable label: their answer was cut off."""
    return prepared.filter(~F.exists("labels", lambda x: x != IGNORED_LABEL))


def model_inputs(df: DataFrame, metadata: bool = False) -> DataFrame:
    """The columns a model reads, with labels if there are any, and metadata on request."""
    columns = ["input_ids", "attention_mask"]
    if "labels" in df.columns:
        columns.append("labels")
    if metadata:
        columns += [c for c in ("original_index", "num_turns") if c in df.columns]
    return require_columns(df, columns).select(*columns)


def truncate_prompt(ids: Column, max_length: int = TRAINING_LENGTH) -> Column:
    """The first `max_length` ids, so the newest turns are the ones lost."""
    return F.slice(ids, 1, max_length)


def prompt_ids(df: DataFrame, tokenizer: Tokenizer | None = None, max_length: int = TRAINING_LENGTH) -> DataFrame:
    """Add `prompt_ids`, the truncated ids of the rendered prompt."""
    prompt = render_prompt(F.col("messages"))
    if tokenizer is None:
        return df.withColumn("_pieces", pieces(prompt)).withColumn(
            "prompt_ids", piece_ids(_cut("_pieces", max_length))
        ).drop("_pieces")
    return df.withColumn("prompt_ids", truncate_prompt(tokenize(prompt, tokenizer), max_length))
