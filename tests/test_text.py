import pytest
from pyspark.sql import functions as F

from turnflow.functions import messages, profile, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, clean", [
    ("Hello    world\n\ntest", "Hello world test"),
    ("  trimmed  ", "trimmed"),
    ("wait?!?!..", "wait."),
    ("Really???", "Really?"),
    ("a  b\x1cc", "a b c"),
    ("one. two!", "one. two!"),
])
def test_clean_text(spark, raw, clean):
    assert one(spark, text.clean_text(F.lit(raw))) == clean


def test_clean_text_needs_a_string_column(spark):
    with pytest.raises(TypeError):
        text.with_clean_text(spark.range(1), "id", "clean")


@pytest.mark.parametrize("raw, blank", [(None, True), ("", True), (" \t \x1f", True), (" x ", False)])
def test_is_blank(spark, raw, blank):
    assert one(spark, text.is_blank(F.lit(raw).cast("string"))) is blank


@pytest.mark.parametrize("value, currency, shown", [
    (None, False, "N/A"), (None, True, "N/A"), (1234567, True, "$1,234,567"), (50, True, "$50"),
    (1000, False, "1000"), (1001, False, "1,001"), (-5000, False, "-5000"), (-5000, True, "$-5,000"), (0, False, "0"),
])
def test_format_integer(spark, value, currency, shown):
    assert one(spark, text.format_integer(F.lit(value).cast("long"), currency)) == shown


@pytest.mark.parametrize("raw, stops, kept", [
    ("Hello STOP world", ["STOP"], "Hello"),
    ("a END b STOP c", ["STOP", "END"], "a"),
    (" nothing here ", ["STOP"], "nothing here"),
    (" as it is ", [], "as it is"),
    ("anything", [""], ""),
])
def test_trim_at_stop(spark, raw, stops, kept):
    assert one(spark, text.trim_at_stop(F.lit(raw), stops)) == kept


@pytest.mark.parametrize("raw, score", [
    ("Good. SCORE: 4", 4), ("SCORE:0", 0), ("SCORE: 10", 1), ("SCORE: 7", None), ("no score", None),
    ("SCORE: 2 then SCORE: 5", 2), ("SCORE:\n 5", 5),
])
def test_parse_score(spark, raw, score):
    assert one(spark, text.parse_score(F.lit(raw))) == score


def test_strip_think(spark):
    assert one(spark, text.strip_think(F.lit("<think>a\nb</think>yes<think>c</think>!"))) == "yes!"


@pytest.mark.parametrize("kind, role, mapped", [
    ("underwriter", "x", "user"), ("user-facing assistant", None, "assistant"), ("internal assistant", "", "assistant"),
    ("tool", "assistant", "tool"), (None, "system", "system"), ("other", "", "unknown"), ("", None, "unknown"),
])
def test_map_role(spark, kind, role, mapped):
    made = messages.map_role(F.lit(kind).cast("string"), F.lit(role).cast("string"))
    assert one(spark, made) == mapped


PROFILE_TEXT = "Intro\n\n## Company Profile\n\n- Name: Acme: Corp\n-no\n- Empty\n- Name: Beta\n - Payroll : $5 \n\n## Tools\n- Not: this"


def test_parse_profile(spark):
    parsed = one(spark, profile.parse_profile(F.lit(PROFILE_TEXT)))
    assert parsed == {"Name": "Beta", "Payroll": "$5"}


def test_parse_profile_keeps_everything_after_the_first_separator(spark):
    assert one(spark, profile.parse_profile(F.lit("## Company Profile\n- A: b: c"))) == {"A": "b: c"}


def test_parse_profile_without_a_section(spark):
    with pytest.raises(Exception, match="Company Profile"):
        one(spark, profile.parse_profile(F.lit("nothing")))
