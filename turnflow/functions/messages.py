"""Column functions on single messages of a conversation."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnflow.constants import INTERNAL_TYPE, ROLE_OF_TYPE, TOOL_NAME


def map_role(message_type: Column, role: Column) -> Column:
    """Role of a turn: decided by its type, else its own role, else unknown."""
    known = F.create_map(*[F.lit(x) for pair in ROLE_OF_TYPE.items() for x in pair])
    own = F.when(role != "", role)
    return F.coalesce(F.try_element_at(known, message_type), own, F.lit("unknown"))


def wrap_think(message_type: Column, content: Column) -> Column:
    """Content of an internal assistant turn inside think tags, any other unchanged."""
    wrapped = F.concat(F.lit("<think>"), content, F.lit("</think>"))
    return F.when(message_type == INTERNAL_TYPE, wrapped).otherwise(content)


def calls_tools(tool_calls: Column) -> Column:
    return F.coalesce(tool_calls != "", F.lit(False))


def tool_names(tool_calls: Column) -> Column:
    return F.regexp_extract_all(tool_calls, F.lit(TOOL_NAME), F.lit(1))
