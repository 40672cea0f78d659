"""Conversations stored one row per message: (`conv_id`, `turn`, `part`) orders them.

No step gathers a conversation, nor a run of assistant turns. Rows are dealt by stretches of `STRETCH` turns, which
windows work through; what a stretch needs from the others is one row per stretch. Messages are rows of at
most `CHUNK` characters: a chunk is told by its message (the place of the message's first turn) and its offset, the
characters of the message before it.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnflow.functions.chat import MESSAGE_END, message_header, render_message
from turnflow.functions.messages import calls_tools, map_role, tool_names, wrap_think
from turnflow.functions.text import clean_text, is_blank
from turnflow.functions.tokens import count_tokens, joins_words
from turnflow.operators.shaping import size_stats

STRETCH = 1024
CHUNK = 65_536


def extract_turns(messages: DataFrame) -> DataFrame:
    """Non-blank messages with role, cleaned content and the tool-call flag."""
    return messages.filter(~is_blank(F.col("content"))).select(
        "conv_id",
        "turn",
        "part",
        map_role(F.col("type"), F.col("role")).alias("role"),
        clean_text(F.col("content")).alias("content"),
        "type",
        calls_tools(F.col("tool_calls")).alias("has_tool_calls"),
    )


def tool_flags(messages: DataFrame) -> DataFrame:
    """Per conversation: does any raw message, blank ones included, call a tool?"""
    return messages.groupBy("conv_id").agg(F.max(calls_tools(F.col("tool_calls"))).alias("has_tool_calls"))


def tool_usage(messages: DataFrame) -> DataFrame:
    """Calls per tool name."""
    return messages.select(F.explode(tool_names(F.col("tool_calls"))).alias("tool")).groupBy("tool").agg(
        F.count("*").alias("calls")
    )


def _in_stretches(turns: DataFrame, stretch: int) -> DataFrame:
    """Turns with their text as it is merged, dealt by conversation and stretch, and their run inside the stretch.

    `_run` is the place where the turn's message starts in the stretch, `_at_edge` whether that is the first turn of
    the stretch, so that the message may have begun earlier, `_before` its characters before this turn.
    """
    assistant = F.col("role") == "assistant"
    piece = F.when(assistant, wrap_think(F.col("type"), F.col("content"))).otherwise(F.col("content"))
    cut = turns.select(
        "conv_id", "turn", "part", "role", assistant.alias("_assistant"), F.floor(F.col("turn") / stretch).alias("_stretch"),
        piece.alias("_piece"), F.length(piece).cast("long").alias("_chars"), F.right(piece, F.lit(1)).alias("_end"))
    # both keys are named, or rows already partitioned by conversation would stay where they are
    spread = cut.repartition("conv_id", "_stretch")
    in_order = Window.partitionBy("conv_id", "_stretch").orderBy("turn", "part")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    previous = F.lag("_assistant").over(in_order)
    opens = ~F.col("_assistant") | ~F.coalesce(previous, F.lit(False))
    start = F.when(F.col("_opens"), F.struct("turn", "part", previous.isNull().alias("edge"), F.col("_sum").alias("sum")))
    return (
        spread.withColumns({"_opens": opens, "_sum": F.sum("_chars").over(so_far) - F.col("_chars")})
        .withColumns({"_start": start, "_left": F.when(~opens, F.lag("_end").over(in_order)),
                      "_next": F.lead("_assistant").over(in_order)})
        .withColumn("_start", F.max("_start").over(so_far))
        .withColumns({"_run": F.struct("_start.turn", "_start.part"), "_at_edge": F.col("_start.edge") & F.col("_assistant"),
                      "_before": F.col("_sum") - F.col("_start.sum")})
        .drop("_opens", "_sum", "_start")
    )


def _carried(placed: DataFrame) -> DataFrame:
    """Per stretch what its first and last message need from other stretches, and where the conversation ends.

    `_goes_on`: its first turn continues the last message of the stretch before, which starts at `_from` and
    has `_earlier` characters, the last of them `_char`. `_more`: the next stretch continues its last message.
    """
    place = F.struct("turn", "part")
    tail = F.struct("_assistant", "_at_edge", "_run", (F.col("_before") + F.col("_chars")).alias("chars"), "_end")
    stretches = placed.groupBy("conv_id", "_stretch").agg(
        F.max_by(tail, place).alias("_tail"), F.min_by("_assistant", place).alias("_first"))
    along = Window.partitionBy("conv_id").orderBy("_stretch")
    goes_on = F.col("_first") & F.coalesce(F.lag("_tail._assistant").over(along), F.lit(False))
    linked = stretches.withColumn("_goes_on", goes_on).withColumn(
        "_message", F.sum((~(F.col("_tail._at_edge") & F.col("_goes_on"))).cast("long")).over(along))
    same = Window.partitionBy("conv_id", "_message").orderBy("_stretch")
    summed = linked.withColumns({
        "_begun": F.first("_tail._run").over(same), "_total": F.sum("_tail.chars").over(same)})
    end = F.max(F.struct("_stretch", "_begun", "_tail._assistant")).over(Window.partitionBy("conv_id"))
    return summed.select(
        "conv_id", "_stretch", "_goes_on",
        F.lag("_begun").over(along).alias("_from"), F.lag("_total").over(along).alias("_earlier"),
        F.lag("_tail._end").over(along).alias("_char"),
        F.coalesce(F.lead("_goes_on").over(along), F.lit(False)).alias("_more"), end.alias("_conversation_end"))


def merge_assistant_runs(turns: DataFrame, stretch: int = STRETCH, chunk: int = CHUNK) -> DataFrame:
    """Messages in chunks: a run of assistant turns joined, any other turn as it is.

    (`turn`, `part`) is the place of the message's first turn, `offset` its characters before the chunk, `chars`
    those in it, `merged_turns` the turns that begin in it. Chunks end after `chunk` characters and where a
    stretch ends, so no row grows with the length of a run, and ordered by offset they make the message. `closes`
    marks a message's last chunk, `preceding` is the character before a later one; `is_last` marks the chunks of the
    conversation's last message and `answered` whether that is an assistant's.

    Rows are exchanged once, by conversation and stretch.
    """
    placed = _in_stretches(turns, stretch)
    rows = placed.join(_carried(placed), ["conv_id", "_stretch"])
    continued = F.col("_at_edge") & F.col("_goes_on")
    start = F.when(continued, F.col("_from")).otherwise(F.col("_run"))
    # the last turn of the stretch goes on if the next stretch says so
    ends = ~F.col("_assistant") | ~F.coalesce("_next", "_more")
    low, high = (F.floor(x / chunk) for x in (F.col("_before"), F.col("_before") + F.greatest(F.col("_chars") - 1, F.lit(0))))
    dealt = rows.select(
        "conv_id", "_stretch", "turn", "part", "role", "_piece", "_chars", "_before", start.alias("_start"), ends.alias("_ends"),
        F.when(continued, F.col("_earlier")).otherwise(F.lit(0)).alias("_base"),
        F.when(continued, F.coalesce("_left", "_char")).otherwise(F.col("_left")).alias("_left"),
        (F.col("_conversation_end._begun") == start).alias("_last"), F.col("_conversation_end._assistant").alias("_answered"),
        F.explode(F.sequence(low, high)).alias("_chunk"))
    begin = F.greatest(F.col("_chunk") * chunk - F.col("_before"), F.lit(0))
    end = F.least((F.col("_chunk") + 1) * chunk - F.col("_before"), F.col("_chars"))
    cut = dealt.withColumns({"_begin": begin, "_stop": end}).withColumns({
        "_text": F.substring("_piece", F.col("_begin") + 1, F.col("_stop") - F.col("_begin")),
        "_left": F.when(F.col("_begin") > 0, F.substring("_piece", F.col("_begin"), F.lit(1))).otherwise(F.col("_left"))})
    place = F.struct("turn", "part")
    return (
        cut.groupBy("conv_id", "_stretch", "_start", "_chunk").agg(
            F.max("role").alias("role"),
            F.min(F.col("_base") + F.col("_before") + F.col("_begin")).alias("offset"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "part", "_text"))), lambda t: t["_text"]), "").alias("content"),
            F.sum(F.col("_stop") - F.col("_begin")).alias("chars"),
            F.count_if(F.col("_begin") == 0).alias("merged_turns"),
            F.min_by(F.struct("_left"), place)["_left"].alias("preceding"),
            F.max(F.col("_ends") & (F.col("_stop") == F.col("_chars"))).alias("closes"),
            F.max("_last").alias("is_last"), F.max("_answered").alias("answered"))
        .select("conv_id", "_start.turn", "_start.part", "role", "offset", "content", "chars", "merged_turns", "preceding", "closes",
                "is_last", "answered")
    )


def whole_messages(chunks: DataFrame) -> DataFrame:
    """One row per message, for messages that fit a row."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "content")))
    return chunks.groupBy("conv_id", "turn", "part").agg(
        F.max("role").alias("role"), F.array_join(F.transform(ordered, lambda c: c["content"]), "").alias("content"),
        F.sum("merged_turns").alias("merged_turns"), F.sum("chars").alias("chars"))


def conversation_ends(chunks: DataFrame) -> DataFrame:
    """Per conversation: counters, and the role and size of the last message."""
    opens = F.col("offset") == 0

    def count(role: str) -> Column:
        return F.count_if(opens & (F.col("role") == role))

    last = F.max(F.struct("turn", "part", (F.col("offset") + F.col("chars")).alias("chars"), "role"))
    return chunks.groupBy("conv_id").agg(
        F.count_if(opens).alias("num_messages"),
        count("user").alias("user_messages"),
        count("assistant").alias("assistant_messages"),
        count("tool").alias("tool_messages"),
        F.sum("chars").alias("chars"),
        last.alias("_last"),
    ).withColumns({"last_role": F.col("_last.role"), "last_chars": F.col("_last.chars")}).drop("_last")


def turn_counters(ends: DataFrame) -> DataFrame:
    """Turn counters of the usable conversations; the target message is not counted."""
    return ends.filter(F.col("last_role") == "assistant").select(
        "conv_id",
        (F.col("num_messages") - 1).alias("num_turns"),
        F.col("user_messages").alias("num_user_turns"),
        (F.col("assistant_messages") - 1).alias("num_assistant_turns"),
        F.col("tool_messages").alias("num_tool_turns"),
        (F.col("chars") - F.col("last_chars")).alias("turn_chars"),
    )


def split_target(chunks: DataFrame) -> DataFrame:
    """Chunks of the usable conversations, with `is_target` on those of the last message."""
    return chunks.filter("answered").withColumnRenamed("is_last", "is_target").drop("answered")


def with_system_messages(inputs: DataFrame, prompts: DataFrame) -> DataFrame:
    """Put each conversation's system message, at turn -1 and in one chunk, before its other messages."""
    system = prompts.select(
        "conv_id", F.lit(-1).cast("long").alias("turn"), F.lit(0).alias("part"), F.lit("system").alias("role"),
        F.lit(0).cast("long").alias("offset"), F.col("system_prompt").alias("content"),
        F.lit(None).cast("string").alias("preceding"), F.lit(True).alias("closes"))
    return system.unionByName(inputs.select(*system.columns))


def rendered_messages(chunks: DataFrame) -> DataFrame:
    """Template form of each chunk; in order of (`turn`, `part`, `offset`) they make the text."""
    header = F.when(F.col("offset") == 0, message_header(F.col("role"))).otherwise("")
    return chunks.withColumn("segment", F.concat(header, "content", F.when(F.col("closes"), MESSAGE_END).otherwise("")))


def token_counts(split: DataFrame, prompts: DataFrame) -> DataFrame:
    """Tokens per usable conversation, of its system message and all messages before the target.

    No token spans two messages, so counts add up; one that spans two chunks counts in the first.
    """
    spans = F.coalesce(joins_words(F.col("preceding"), F.col("content")), F.lit(False)) & (F.col("offset") > 0)
    own = count_tokens(F.col("segment")) - spans.cast("int")
    counted = rendered_messages(split).withColumn("_tokens", F.when(~F.col("is_target"), own).otherwise(0))
    of_prompt = prompts.select("conv_id", count_tokens(render_message(F.lit("system"), F.col("system_prompt"))).alias("_system"))
    return (
        counted.groupBy("conv_id").agg(F.sum("_tokens").alias("_tokens")).join(of_prompt, "conv_id", "left")
        .select("conv_id", (F.col("_tokens") + F.coalesce("_system", F.lit(0))).alias("token_count"))
    )


def preprocessing_stats(counters: DataFrame, prompts: DataFrame) -> DataFrame:
    """Turn and character statistics of the usable conversations, system messages included."""
    sizes = counters.join(prompts, "conv_id").select(
        "num_turns", (F.col("turn_chars") + F.length("system_prompt")).alias("content_length")
    )
    return size_stats(sizes)
