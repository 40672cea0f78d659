"""Fixed-size batches and their padding."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnflow.constants import IGNORED_LABEL, PAD_ID, VOCAB_SIZE
from turnflow.plans.ordering import with_position, with_shuffled_position


def assign_batches(
    df: DataFrame, id_col: str, batch_size: int = 4, shuffle: bool = True, seed: int = 42, by: tuple[str, ...] = ()
) -> DataFrame:
    """Add `batch`, the number of the row's batch, and `slot`, its place there.

    Only the last batch of a group may be short. Rows with the same id, or none, are rows
    of their own.
    """
    if shuffle:
        placed = with_shuffled_position(df, id_col, seed, by, "_place")
    else:
        placed = with_position(df, [id_col], by, "_place")
    return placed.withColumns({
        "batch": F.floor(F.col("_place") / batch_size),
        "slot": F.col("_place") % batch_size,
    }).drop("_place")


def collate(
    df: DataFrame,
    by: tuple[str, ...] = (),
    pad_id: int = PAD_ID,
    mlm: bool = False,
    share: float = 0.15,
    mask_id: int = VOCAB_SIZE + 1,
    seed: int = 42,
) -> DataFrame:
    """Pad ids and mask to the longest row of the batch and add labels.

    Causal labels repeat the ids without padding. With `mlm`, a share of the ids is chosen by
    a seeded digest of row and place. Of these, 80 % become the mask, 10 % a random id and
    10 % stay; labels hold the original of the chosen ones only.
    """
    batch = Window.partitionBy(*by, "batch")
    rows = df.withColumn("_length", F.max(F.size("input_ids")).over(batch))
    missing = F.col("_length") - F.size("input_ids")

    def filled(ids, value):
        return F.concat(ids, F.array_repeat(F.lit(value), missing))

    def draw(i, at: int):
        """32 bits of the digest of a place, from its `at`-th hex digit."""
        place = F.concat_ws(":", F.lit(str(seed)), F.col("original_index").cast("string"), i.cast("string"))
        return F.conv(F.substring(F.md5(place), at, 8), 16, 10).cast("long")

    def chosen(x, i):
        return (draw(i, 1) < int(share * 2**32)) & (x != pad_id)

    def disguised(x, i):
        kind = draw(i, 9) % 10
        return F.when(kind < 8, mask_id).when(kind == 8, (draw(i, 17) % VOCAB_SIZE).cast("int")).otherwise(x)

    ids = F.col("input_ids")
    if mlm:
        shown = F.transform(ids, lambda x, i: F.when(chosen(x, i), disguised(x, i)).otherwise(x))
        labels = F.transform(ids, lambda x, i: F.when(chosen(x, i), x).otherwise(IGNORED_LABEL))
    else:
        shown = ids
        labels = F.transform(ids, lambda x: F.when(x != pad_id, x).otherwise(IGNORED_LABEL))
    return rows.withColumns({
        "_shown": filled(shown, pad_id),
        "_mask": filled(F.col("attention_mask"), 0),
        "_labels": filled(labels, IGNORED_LABEL),
    }).drop("input_ids", "attention_mask", "labels", "_length").withColumnsRenamed(
        {"_shown": "input_ids", "_mask": "attention_mask", "_labels": "labels"}
    )
