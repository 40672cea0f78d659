"""Chat formatting: budgeted windows over the turns of a conversation, in DataFrame functions only.

Prefix sums of turn tokens cut a conversation into spans of whole turns. Every window holds the
system turn, a limited piece of earlier turns for context, and one span; only assistant turns of
the span are trained on, so each is trained on exactly once.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the template. Control strings of a text are escaped, see `escape`.
TURN, END = "<|turn|>", "<|end|>\n"
#: Tokens that the marks of a turn take.
MARKS = 4
#: Turn numbers that one window function sees together.
STRETCH = 1024


def escape(text: Column, line: bool = False) -> Column:
    r"""Make control strings harmless: `\` becomes `\b`, `<|` becomes `<\p|`; in a line, a line end `\n`."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("<\\p|"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if line else out


def unescape(text: Column) -> Column:
    """Undo `escape`: every backslash in an escaped text belongs to one of its three marks."""
    plain = F.replace(F.replace(text, F.lit("\\p"), F.lit("")), F.lit("\\n"), F.lit("\n"))
    return F.replace(plain, F.lit("\\b"), F.lit("\\"))


def budgeted_windows(
    turns: DataFrame,
    budget: int = 1024,
    history: int = 256,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Windows of formatted turns: conv_id, window, formatted, new_from, n_new, n_tokens, loss.

    `formatted` is the text, `new_from` the character at which what no earlier window trained on
    begins, `n_new` how many turns those are, `loss` the character spans (start, chars) of the
    assistant texts under the loss mask. Tokens are words plus MARKS per turn. A turn belongs to
    the span of the budget's cell in which its prefix sum lies; a turn that crosses a cell's end
    is a span of its own, so a window keeps the budget unless one turn, or the system turn,
    exceeds it alone. A system turn that leaves less than a quarter of the budget is kept whole.

    Turns are ordered by turn (null first), then role and text; repeated rows are turns of their
    own. A null role or text is empty. A null id is a conversation of its own. Other columns are
    ignored. An empty table gives no windows.
    """
    rows = turns.select(
        F.col(id_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).withColumn("stretch", F.floor(F.col("turn") / STRETCH))
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    within = Window.partitionBy("conv_id", "stretch").orderBy(*order)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("place", F.row_number().over(within))
        .withColumn("tokens", F.lit(MARKS) + F.regexp_count("text", F.lit(r"\S+")))
        .withColumn("opens", (F.col("place") == 1) & (F.col("role") == "system"))
    )
    placed = _with_offsets(rows, before)
    room = F.greatest(F.lit(budget - history) - F.col("system_tokens"), F.lit(max(1, budget // 4)))
    spans = (
        placed.withColumn("room", room)
        .withColumn("cell", F.floor(F.col("sum_before") / F.col("room")))
        .withColumn("last", F.floor((F.col("sum_before") + F.col("tokens") - 1) / F.col("room")))
        .withColumn("window", F.when(F.col("is_system"), 0).otherwise(
            2 * F.col("cell") + (F.col("last") > F.col("cell")).cast("int")))
    )
    return _formatted(spans, history)


def _with_offsets(rows: DataFrame, before) -> DataFrame:
    """Add sum_before, n_before and what is known of the system turn; only one row per stretch is carried on."""
    per = rows.groupBy("conv_id", "stretch").agg(
        F.count("*").alias("n"),
        F.sum("tokens").alias("all_tokens"),
        F.max(F.when(F.col("opens"), F.col("tokens"))).alias("opening_tokens"),
    )
    stretches = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("stretch"))
    earlier = stretches.rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        per.withColumn("first", F.row_number().over(stretches) == 1)
        .withColumn("opening", F.first(F.coalesce("opening_tokens", F.lit(0))).over(stretches))
        .select(
            F.col("conv_id").alias("c"), F.col("stretch").alias("s"), "first",
            F.col("opening").alias("system_tokens"),
            F.coalesce(F.sum("all_tokens").over(earlier), F.lit(0)).alias("carry"),
            F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_carry"),
        )
    )
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("stretch").eqNullSafe(F.col("s"))
    running = rows.withColumn("local", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    return (
        running.join(carried, same)
        .withColumn("is_system", F.col("first") & F.col("opens"))
        .withColumn("place", F.col("n_carry") + F.col("place"))
        .withColumn("sum_before", F.greatest(F.col("carry") + F.col("local") - F.col("system_tokens"), F.lit(0)))
        .drop("c", "s", "first", "opens", "carry", "n_carry", "local", "stretch")
    )


def _formatted(spans: DataFrame, history: int) -> DataFrame:
    piece = F.concat(F.lit(TURN), escape(F.col("role"), line=True), F.lit("\n"), escape(F.col("text")), F.lit(END))
    own = spans.select(
        "conv_id", "window", "place", "tokens", "sum_before", "room", "is_system",
        piece.alias("piece"),
        (F.length(F.lit(TURN)) + F.length(escape(F.col("role"), line=True)) + 1).alias("head"),
        F.length(escape(F.col("text"))).alias("chars"),
        (F.col("role") == "assistant").alias("trained"),
    )
    starts = own.groupBy("conv_id", "window").agg(
        F.min(F.when(~F.col("is_system"), F.col("sum_before"))).alias("start"),
        F.min("place").alias("first_place"),
    ).select(F.col("conv_id").alias("c"), F.col("window").alias("w"), "start", "first_place")
    # A turn can be context of the spans that start at most `history` tokens behind its own start.
    reach = F.least(F.lit(history), F.col("room"))
    later = F.explode(F.sequence(
        F.col("window") + 1, 2 * F.floor((F.col("sum_before") + reach) / F.col("room")) + 1))
    context = (
        own.where(~F.col("is_system"))
        .where(F.col("window") < 2 * F.floor((F.col("sum_before") + reach) / F.col("room")) + 1)
        .withColumn("w2", later)
        .join(starts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("w2") == F.col("w")))
        .where((F.col("start") - F.col("sum_before") <= reach) & (F.col("place") < F.col("first_place")))
        .select("conv_id", F.col("w2").alias("window"), "place", "tokens", "piece", "head", "chars",
                F.lit(False).alias("trained"), F.lit(False).alias("new"))
    )
    targets = own.select("conv_id", "window", "place", "tokens", "piece", "head", "chars", "trained",
                         F.lit(True).alias("new"))
    system = own.where("is_system").select(
        F.col("conv_id").alias("c"), F.col("piece").alias("system"), F.col("tokens").alias("system_tokens"))
    grouped = (
        targets.unionByName(context)
        .groupBy("conv_id", "window")
        .agg(F.array_sort(F.collect_list(F.struct("place", "piece", "head", "chars", "trained", "new", "tokens")))
             .alias("turns"))
        .join(system, F.col("conv_id").eqNullSafe(F.col("c")), "left")
        # the span that holds the system turn itself does not repeat it
        .withColumn("repeated", F.when(F.exists("turns", lambda t: (t["place"] == 1) & t["new"]), F.lit(""))
                    .otherwise(F.coalesce("system", F.lit(""))))
        .withColumn("at", F.length("repeated"))
    )
    # where each turn begins: the lengths before it, summed along the window
    begins = F.aggregate(
        "turns", F.array(F.col("at")),
        lambda got, t: F.concat(got, F.array(F.element_at(got, -1) + F.length(t["piece"]))))
    placed = grouped.withColumn("begins", begins)
    pairs = F.arrays_zip(F.col("turns").alias("t"), F.slice("begins", 1, F.size("turns")).alias("b"))
    kept = F.filter(pairs, lambda p: p["t"]["trained"])
    n_old = F.size(F.filter("turns", lambda t: ~t["new"]))
    return placed.select(
        "conv_id", "window",
        F.concat("repeated", F.array_join(F.transform("turns", lambda t: t["piece"]), "")).alias("formatted"),
        F.element_at("begins", n_old + 1).alias("new_from"),
        (F.size("turns") - n_old).alias("n_new"),
        (F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + t["tokens"])
         + F.when(F.col("at") > 0, F.col("system_tokens")).otherwise(0)).alias("n_tokens"),
        F.transform(kept, lambda p: F.struct(
            (p["b"] + p["t"]["head"]).alias("start"), p["t"]["chars"].alias("chars"))).alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """One row per conversation, taken from the formatted text alone: its turns and trained texts, joined.

    Columns: conv_id, n_turns, turns (role, line end, text, line end per turn), loss_text, formatted_chars.
    The digest of a whole conversation needs its whole text in one row; nothing else is gathered.
    """
    new = F.expr("substring(formatted, new_from + 1)")
    pieces = F.filter(F.split(new, r"<\|end\|>\n"), lambda p: p != "")
    body = lambda p: F.substring(p, F.lit(len(TURN) + 1), F.length(p))
    role = lambda p: unescape(F.substring_index(body(p), "\n", 1))
    said = lambda p: unescape(
        F.substring(body(p), F.length(F.substring_index(body(p), "\n", 1)) + 2, F.length(p)))
    line = F.array_join(F.transform(pieces, lambda p: F.concat(role(p), F.lit("\n"), said(p), F.lit("\n"))), "")
    trained = F.array_join(
        F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["chars"]))), "")
    per = windows.select("conv_id", "window", F.size(pieces).alias("n"), line.alias("line"),
                         trained.alias("trained"), F.length("formatted").alias("chars"))
    return (
        per.groupBy("conv_id")
        .agg(F.sum("n").alias("n_turns"),
             F.array_sort(F.collect_list(F.struct("window", "line", "trained"))).alias("parts"),
             F.sum("chars").alias("formatted_chars"))
        .select("conv_id", "n_turns",
                F.array_join(F.col("parts.line"), "").alias("turns"),
                F.array_join(F.col("parts.trained"), "").alias("loss_text"), "formatted_chars")
    )
