"""Text, profile and conversation queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog.explore import rounded
from catalog.inputs import documents, examples, long, merged_long, prompts_long, raw, stored_raw
from catalog.registry import query
from catalog.sql import (
    cleaned, examples_sql, long_examples_sql, long_merged_sql, long_sql, long_turns_sql, mapped_role, merged_sql,
    WHITESPACE, money, number, prompt, quoted, raw_sql, turns_sql,
)
from turnflow.constants import THINK_BLOCK
from turnflow.functions import messages as message_functions
from turnflow.functions import profile as profile_functions
from turnflow.functions import text
from turnflow.operators import checks, shaping, turns

def row_id():
    return F.col("`primary id`").alias("id")


PROFILE = ["company_name", "annual_revenue", "number_of_employees", "total_payroll", "number_of_vehicles",
           "building_construction", "state", "company_description", "lob"]


@query(raw_sql(f"SELECT id, {', '.join(PROFILE)} FROM raw"))
def company_profile(spark, folder):
    df = raw(spark, folder)
    return df.select(row_id(), profile_functions.company_profile(df).alias("p")).select("id", "p.*")


@query(f"SELECT doc_id, md5({cleaned('text')}) AS clean FROM documents")
def clean_text(spark, folder):
    return text.with_clean_text(documents(spark, folder), "text", "t").select("doc_id", F.md5("t").alias("clean"))


@query(f"SELECT conv_id, turn, {cleaned('text')} AS clean FROM conversations")
def clean_conversations(spark, folder):
    return spark.read.parquet(f"{folder}/conversations.parquet").select(
        "conv_id", "turn", text.clean_text(F.col("text")).alias("clean")
    )


@query(raw_sql(f"""SELECT id, {money('annual_revenue')} AS revenue, {number('number_of_employees')} AS employees,
  {money('total_payroll')} AS payroll, coalesce(building_construction, 'N/A') AS building FROM raw"""))
def format_value(spark, folder):
    return raw(spark, folder).select(
        row_id(),
        text.format_integer(F.col("annual revenue"), currency=True).alias("revenue"),
        text.format_integer(F.col("number of employees")).alias("employees"),
        text.format_integer(F.col("total payroll"), currency=True).alias("payroll"),
        text.format_string(F.col("building construction")).alias("building"),
    )


@query(raw_sql(f"SELECT id, {prompt('raw')} AS prompt FROM raw"))
def system_prompt(spark, folder):
    df = raw(spark, folder)
    return df.select(row_id(), profile_functions.system_prompt(profile_functions.company_profile(df)).alias("prompt"))


@query(raw_sql(f"""SELECT id, coalesce(company_name, 'N/A') AS name, {money('annual_revenue')} AS revenue,
  {number('number_of_employees')} AS employees, coalesce(lob, 'N/A') AS lob, company_description AS description FROM raw"""))
def parse_profile(spark, folder):
    df = raw(spark, folder)
    prompts = df.select(row_id(), profile_functions.system_prompt(profile_functions.company_profile(df)).alias("prompt"))
    parsed = prompts.withColumn("p", profile_functions.parse_profile(F.col("prompt")))
    return parsed.select(
        "id", F.col("p")["Name"].alias("name"), F.col("p")["Annual Revenue"].alias("revenue"),
        F.col("p")["Employees"].alias("employees"), F.col("p")["Line of Business"].alias("lob"),
        F.col("p")["Description"].alias("description"),
    )


@query(raw_sql("""SELECT r.id, coalesce(bool_or(tool_calls <> ''), false) AS has_tool_calls
  FROM raw r LEFT JOIN raw_messages m ON m.id = r.id GROUP BY 1"""))
def has_tool_calls(spark, folder):
    return raw(spark, folder).select(row_id(), shaping.has_tool_calls(F.col("trace")).alias("has_tool_calls"))


@query(long_sql("SELECT id AS conv_id, bool_or(tool_calls <> '') AS has_tool_calls FROM raw_messages GROUP BY 1"))
def has_tool_calls_of_turns(spark, folder):
    return turns.tool_flags(long(spark, folder))


@query(f"""SELECT doc_id, md5(regexp_replace(
  substr(text, 1, coalesce(list_min(list_filter([instr(text, '. '), instr(text, ' | '), instr(text, chr(10))], lambda x: x > 0)), length(text) + 1) - 1),
  '^{WHITESPACE}+|{WHITESPACE}+$', '', 'g')) AS kept FROM documents""")
def trim_at_stop(spark, folder):
    kept = text.trim_at_stop(F.col("text"), [". ", " | ", "\n"])
    return documents(spark, folder).select("doc_id", F.md5(kept).alias("kept"))


@query(merged_sql(f"SELECT id, pos, regexp_replace(content, {quoted(THINK_BLOCK)}, '', 'g') AS answer FROM merged WHERE role = 'assistant'"))
def strip_think(spark, folder):
    merged = shaping.with_merged_turns(shaping.with_turns(raw(spark, folder))).select(row_id(), F.posexplode("merged").alias("at", "m"))
    return merged.filter("m.role = 'assistant'").select(
        "id", (F.col("at") + 1).cast("long").alias("pos"), text.strip_think(F.col("m.content")).alias("answer")
    )


@query(turns_sql("""SELECT id, row_number() OVER (PARTITION BY id ORDER BY turn, part) AS pos, role, content, type, has_tool_calls
  FROM turns"""))
def extract_turns(spark, folder):
    kept = shaping.with_turns(raw(spark, folder)).select(row_id(), F.posexplode("turns").alias("at", "t"))
    return kept.select("id", (F.col("at") + 1).cast("long").alias("pos"), "t.*")


LONG_TURNS = "SELECT id AS conv_id, turn, part, {columns} FROM turns"


@query(long_turns_sql(LONG_TURNS.format(columns="role, content, type, has_tool_calls")))
def extract_turns_of_turns(spark, folder):
    return turns.extract_turns(long(spark, folder))


@query(raw_sql(f"""SELECT id, row_number() OVER (PARTITION BY id ORDER BY turn, part) - 1 + turn // 13 AS turn,
  {mapped_role('type', 'role')} AS mapped FROM raw_messages"""))
def map_role(spark, folder):
    rows = raw(spark, folder).select(row_id(), F.posexplode("trace").alias("turn", "m")).filter(F.col("m").isNotNull())
    return rows.select(
        "id", F.col("turn").cast("long").alias("turn"),
        message_functions.map_role(F.col("m.type"), F.col("m.role")).alias("mapped"),
    )


@query(turns_sql("SELECT id, role, count(*) AS turns, count(*) FILTER (WHERE has_tool_calls) AS with_tools FROM turns GROUP BY 1, 2"))
def turn_tool_flag(spark, folder):
    kept = shaping.with_turns(raw(spark, folder)).select(row_id(), F.explode("turns").alias("t"))
    return kept.groupBy("id", "t.role").agg(
        F.count("*").alias("turns"), F.count_if("t.has_tool_calls").alias("with_tools")
    )


@query(long_turns_sql(LONG_TURNS.format(
    columns="CASE WHEN type = 'internal assistant' THEN '<think>' || content || '</think>' ELSE content END AS wrapped"
) + " WHERE role = 'assistant'"))
def wrap_think(spark, folder):
    kept = turns.extract_turns(long(spark, folder)).filter("role = 'assistant'")
    return kept.select(
        "conv_id", "turn", "part", message_functions.wrap_think(F.col("type"), F.col("content")).alias("wrapped")
    )


@query(merged_sql("SELECT id, pos, role, content FROM merged"))
def merge_assistant_runs(spark, folder):
    merged = shaping.with_merged_turns(shaping.with_turns(raw(spark, folder))).select(row_id(), F.posexplode("merged").alias("at", "m"))
    return merged.select("id", (F.col("at") + 1).cast("long").alias("pos"), "m.role", "m.content")


@query(long_merged_sql("""SELECT id AS conv_id, turn, part, role, content, merged_turns, length(content)::BIGINT AS chars
  FROM merged"""))
def merge_assistant_runs_of_turns(spark, folder):
    chunks = turns.merge_assistant_runs(turns.extract_turns(long(spark, folder)))
    return turns.whole_messages(chunks)


@query(long_merged_sql("""SELECT id AS conv_id, turn, part, length(content)::BIGINT AS chars, md5(content) AS content, true AS bounded FROM merged"""))
def message_chunks_of_turns(spark, folder):
    """Messages cut into chunks of 64 characters at most, joined again in order of their offsets."""
    chunks = turns.merge_assistant_runs(turns.extract_turns(long(spark, folder)), chunk=64)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "content"))), lambda c: c["content"]), "")
    return chunks.groupBy("conv_id", "turn", "part").agg(
        F.max(F.col("offset") + F.col("chars")).alias("chars"), F.md5(joined).alias("content"),
        (F.max(F.length("content")) <= 64).alias("bounded"))


@query(merged_sql(f"""SELECT id, pos, role, content FROM merged
  UNION ALL SELECT id, 0, 'system', {prompt('raw')} FROM raw WHERE id IN (SELECT id FROM turns)"""))
def build_messages(spark, folder):
    built = shaping.with_messages(shaping.with_turns(raw(spark, folder))).filter(F.size("turns") > 0)
    return built.select(row_id(), F.posexplode("messages").alias("pos", "m")).select(
        "id", F.col("pos").cast("long").alias("pos"), "m.role", "m.content"
    )


@query(examples_sql("""SELECT e.id, e.target_response, count(*) AS messages, arg_max(m.role, m.pos) AS last_role
  FROM examples e JOIN messages m ON m.id = e.id GROUP BY ALL"""))
def split_target(spark, folder):
    shaped = shaping.shape_examples(shaping.keep_correct(raw(spark, folder))).filter(F.col("reject_reason").isNull())
    return shaping.split_target(shaped).select(
        row_id(), "target_response", F.size("messages").cast("long").alias("messages"),
        F.element_at("messages", -1)["role"].alias("last_role"),
    )


@query(long_examples_sql("""SELECT m.id AS conv_id, m.turn, m.part, m.role, md5(m.content) AS content, m.pos = u.last AS is_target
  FROM merged m JOIN usable u ON u.id = m.id"""))
def split_target_of_turns(spark, folder):
    split = turns.split_target(merged_long(spark, folder)).withColumn("role", F.struct("role", "is_target"))
    return turns.whole_messages(split).select(
        "conv_id", "turn", "part", "role.role", F.md5("content").alias("content"), "role.is_target"
    )


COUNTERS = "id, num_turns, num_user_turns, num_assistant_turns, num_tool_turns"


@query(examples_sql(f"SELECT {COUNTERS} FROM examples"))
def count_turns(spark, folder):
    names = ["num_turns", "num_user_turns", "num_assistant_turns", "num_tool_turns"]
    return examples(spark, folder).select(F.col("original_index").alias("id"), *[F.col(c).cast("long") for c in names])


@query(long_examples_sql(f"SELECT {COUNTERS} FROM examples"))
def count_turns_of_turns(spark, folder):
    counters = turns.turn_counters(turns.conversation_ends(merged_long(spark, folder)))
    return counters.drop("turn_chars").withColumnRenamed("conv_id", "id")


@query(raw_sql("SELECT id, task, correct FROM raw WHERE correct"))
def keep_correct(spark, folder):
    return shaping.keep_correct(raw(spark, folder)).select(row_id(), "task", "correct")


@query(raw_sql("SELECT id, row_number() OVER (ORDER BY id) - 1 AS original_index FROM raw"))
def add_original_index(spark, folder):
    return shaping.with_original_index(raw(spark, folder), "primary id").select(F.col("primary id").alias("id"), "original_index")


@query(raw_sql("SELECT id, row_number() OVER (ORDER BY md5(id::VARCHAR)) - 1 AS original_index FROM raw"))
def original_index_as_stored(spark, folder):
    """Positions in a corpus whose ids follow no order."""
    stored = stored_raw(spark, folder, F.md5(F.col("primary id").cast("string")))
    return shaping.with_original_index(stored).select(F.col("primary id").alias("id"), "original_index")


REASONS = """SELECT r.id, CASE WHEN NOT has_trace THEN 'missing trace' WHEN e.id IS NULL THEN 'no valid turn'
  ELSE 'does not end with an assistant message' END AS reject_reason
  FROM raw r LEFT JOIN ends e ON e.id = r.id WHERE r.correct AND (e.id IS NULL OR e.last_role <> 'assistant')"""


@query(examples_sql(REASONS))
def reject_invalid(spark, folder):
    return shaping.rejected_examples(raw(spark, folder))


PREPROCESSED = """SELECT e.* EXCLUDE (id), i.original_index, r.reference_answer, r.correct, r.assistant_model
  FROM (SELECT id, task, target_response, num_turns, num_user_turns, num_assistant_turns, num_tool_turns,
               md5(text) AS text FROM examples) e
  JOIN (SELECT id, row_number() OVER (ORDER BY {order}) - 1 AS original_index FROM raw) i ON i.id = e.id
  JOIN raw r ON r.id = e.id"""


def digested(made):
    from turnflow.functions.chat import render_chat

    counters = {c: F.col(c).cast("long") for c in made.columns if c.startswith("num_")}
    return made.withColumns(counters).withColumn("text", F.md5(render_chat(F.col("messages")))).drop("messages")


@query(examples_sql(PREPROCESSED.format(order="id")))
def preprocess(spark, folder):
    return digested(shaping.preprocess(stored_raw(spark, folder, F.col("primary id"))))


@query(examples_sql(PREPROCESSED.format(order="id DESC")))
def preprocess_falling_ids(spark, folder):
    """A corpus whose ids fall while the positions of its rows rise."""
    return digested(shaping.preprocess(stored_raw(spark, folder, F.desc("primary id"))))


@query(examples_sql("SELECT md5(text) AS text, count(*) AS n, count(*) AS n_index FROM examples GROUP BY 1"))
def preprocess_repeated_ids(spark, folder):
    """Keys that are null or repeated lose no row, and every row has an index of its own."""
    from turnflow.functions.chat import render_chat

    key = F.col("primary id")
    rows = raw(spark, folder).withColumn("primary id", F.when(key % 5 != 0, key % 10))
    made = shaping.preprocess(rows).select(F.md5(render_chat(F.col("messages"))).alias("text"), "original_index")
    every = made.withColumn("same", F.count("*").over(Window.partitionBy("original_index")))
    return every.groupBy("text").agg(F.count("*").alias("n"), F.count_if(F.col("same") == 1).alias("n_index"))


@query("SELECT doc_id, lang FROM documents")
def require_columns(spark, folder):
    return checks.require_columns(documents(spark, folder), ["doc_id", "lang"]).select("doc_id", "lang")


SIZES = """SELECT count(*) AS num_examples, round(avg(num_turns), 6) AS turns_mean, min(num_turns)::BIGINT AS turns_min,
  max(num_turns)::BIGINT AS turns_max, round(avg(chars), 6) AS chars_mean, min(chars)::BIGINT AS chars_min,
  max(chars)::BIGINT AS chars_max FROM examples"""


@query(examples_sql(SIZES))
def preprocessing_stats(spark, folder):
    return rounded(shaping.preprocessing_stats(examples(spark, folder)), "turns_mean", "chars_mean")


@query(long_examples_sql(SIZES))
def preprocessing_stats_of_turns(spark, folder):
    counters = turns.turn_counters(turns.conversation_ends(merged_long(spark, folder)))
    return rounded(turns.preprocessing_stats(counters, prompts_long(spark, folder)), "turns_mean", "chars_mean")


@query(examples_sql("""SELECT (SELECT count(*) FROM usable) AS processed,
  (SELECT count(*) FROM raw WHERE correct IS NOT true) AS filtered,
  (SELECT count(*) FROM raw WHERE correct) - (SELECT count(*) FROM usable) AS failed,
  round((SELECT count(*) FROM usable) * 100.0 / (SELECT count(*) FROM raw), 6) AS success_rate"""))
def preprocess_report(spark, folder):
    return rounded(shaping.preprocess_report(raw(spark, folder)), "success_rate")
