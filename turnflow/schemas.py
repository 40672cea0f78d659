"""Declared schemas of the tables the toolkit reads and writes."""

from pyspark.sql import types as T

MESSAGE = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
])

TRACE_MESSAGE = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("tool_calls", T.StringType()),
])

TRACE = T.StructType([
    T.StructField("primary id", T.LongType()),
    T.StructField("company task id", T.LongType()),
    T.StructField("assistant model name", T.StringType()),
    T.StructField("task", T.StringType()),
    T.StructField("company name", T.StringType()),
    T.StructField("annual revenue", T.LongType()),
    T.StructField("number of employees", T.LongType()),
    T.StructField("total payroll", T.LongType()),
    T.StructField("number of vehicles", T.LongType()),
    T.StructField("building construction", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("company description", T.StringType()),
    T.StructField("lob", T.StringType()),
    T.StructField("reference answer", T.StringType()),
    T.StructField("correct", T.BooleanType()),
    T.StructField("trace", T.ArrayType(TRACE_MESSAGE)),
])

PROFILE = T.StructType([
    T.StructField("company_name", T.StringType()),
    T.StructField("annual_revenue", T.LongType()),
    T.StructField("number_of_employees", T.LongType()),
    T.StructField("total_payroll", T.LongType()),
    T.StructField("number_of_vehicles", T.LongType()),
    T.StructField("building_construction", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("company_description", T.StringType()),
    T.StructField("lob", T.StringType()),
])

METRIC_LOG = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("step", T.LongType()),
    T.StructField("value", T.DoubleType()),
])

GENERATED = T.StructType([
    T.StructField("original_index", T.LongType()),
    T.StructField("task", T.StringType()),
    T.StructField("messages", T.ArrayType(MESSAGE)),
    T.StructField("target_response", T.StringType()),
    T.StructField("generated_response", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("generation_time_ms", T.DoubleType()),
])

CRITERION = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("evaluation_steps", T.ArrayType(T.StringType())),
    T.StructField("weight", T.DoubleType()),
    T.StructField("optional", T.BooleanType()),
])

JUDGED = T.StructType([
    T.StructField("content", T.StringType()),
    T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("cost_usd", T.DoubleType()),
    T.StructField("latency_ms", T.DoubleType()),
    T.StructField("attempts", T.IntegerType()),
    T.StructField("error", T.StringType()),
])
