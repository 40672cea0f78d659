"""Company profile: from raw columns, to a system prompt, and back."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnflow.constants import PROFILE_FIELDS, PROFILE_SECTION, SYSTEM_PREAMBLE
from turnflow.functions.text import format_integer, format_string, strip
from turnflow.schemas import PROFILE


def company_profile(df: DataFrame) -> Column:
    """The nine company fields as one struct; a column the table lacks becomes null."""
    fields = []
    for source, name in PROFILE_FIELDS.items():
        value = F.col(f"`{source}`") if source in df.columns else F.lit(None)
        fields.append(value.cast(PROFILE[name].dataType).alias(name))
    return F.struct(*fields)


def system_prompt(profile: Column) -> Column:
    """System message for a profile; the description line only when there is one."""
    description = profile["company_description"]
    return F.concat_ws(
        "\n",
        F.lit(SYSTEM_PREAMBLE),
        F.concat(F.lit("- Name: "), format_string(profile["company_name"])),
        F.concat(F.lit("- Annual Revenue: "), format_integer(profile["annual_revenue"], currency=True)),
        F.concat(F.lit("- Employees: "), format_integer(profile["number_of_employees"])),
        F.concat(F.lit("- Total Payroll: "), format_integer(profile["total_payroll"], currency=True)),
        F.concat(F.lit("- Vehicles: "), format_integer(profile["number_of_vehicles"])),
        F.concat(F.lit("- Building Construction: "), format_string(profile["building_construction"])),
        F.concat(F.lit("- State: "), format_string(profile["state"])),
        F.concat(F.lit("- Line of Business: "), format_string(profile["lob"])),
        F.when(description != "", F.concat(F.lit("- Description: "), description)),
    )


def profile_map(system_text: Column) -> Column:
    """`- key: value` lines of the profile section as a map; null without a section.

    A repeated key keeps its first place and its last value.
    """
    section = F.when(
        F.rlike(system_text, F.lit(PROFILE_SECTION)),
        strip(F.regexp_extract(system_text, PROFILE_SECTION, 1)),
    )
    lines = F.filter(
        F.transform(F.split(section, "\n"), strip),
        lambda line: line.startswith("- ") & line.contains(": "),
    )
    pairs = F.transform(lines, lambda line: F.split(F.substring(line, F.lit(3), F.length(line)), ": ", 2))
    pairs = F.transform(pairs, lambda pair: F.transform(pair, strip))


    def add(found: Column, pair: Column) -> Column:
        replaced = F.transform_values(found, lambda key, value: F.when(key == pair[0], pair[1]).otherwise(value))
        return F.when(F.map_contains_key(found, pair[0]), replaced).otherwise(
            F.map_concat(found, F.create_map(pair[0], pair[1]))
        )

    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), add)


def parse_profile(system_text: Column) -> Column:
    """Profile fields of a system message as a map; a message without them is an error."""
    missing = F.raise_error(F.lit("no '## Company Profile' section found in the system message"))
    return F.coalesce(profile_map(system_text), missing.cast("map<string,string>"))


def profile_lines(profile: Column) -> Column:
    lines = F.transform(F.map_entries(profile), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"]))
    return F.array_join(lines, "\n")
