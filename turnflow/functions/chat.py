"""Chat template: messages as one text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

ASSISTANT_HEADER = "<|im_start|>assistant\n"
MESSAGE_END = "<|im_end|>\n"


def message_header(role: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"))


def render_message(role: Column, content: Column) -> Column:
    return F.concat(message_header(role), content, F.lit(MESSAGE_END))


def render_chat(messages: Column) -> Column:
    """All messages in template form; an empty list is an error."""
    text = F.array_join(F.transform(messages, lambda m: render_message(m["role"], m["content"])), "")
    empty = F.raise_error(F.lit("cannot render an empty list of messages"))
    return F.when(F.size(messages) > 0, text).otherwise(empty.cast("string"))


def render_prompt(messages: Column) -> Column:
    """`render_chat` followed by the header of the answer to come."""
    return F.concat(render_chat(messages), F.lit(ASSISTANT_HEADER))


def conversation_for_sft(messages: Column, target: Column) -> Column:
    """Messages with the target answer appended; either one empty is an error."""
    no_messages = F.raise_error(F.lit("messages must not be empty"))
    no_target = F.raise_error(F.lit("target_response must not be empty"))
    answer = F.struct(F.lit("assistant").alias("role"), target.alias("content"))
    return (
        F.when(F.coalesce(F.size(messages), F.lit(0)) <= 0, no_messages.cast("array<struct<role:string,content:string>>"))
        .when(F.coalesce(target, F.lit("")) == "", no_target.cast("array<struct<role:string,content:string>>"))
        .otherwise(F.concat(messages, F.array(answer)))
    )
