"""SQL building blocks shared by the checks: the derived inputs as common table expressions."""

from turnflow.constants import PIECE, SYSTEM_PREAMBLE, VOCAB_SIZE
from turnflow.sources.bridge import TOOLS

# The characters Python counts as white space; in this dialect \s covers only some of them.
WHITESPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WHITESPACE = WHITESPACE.replace("[", "[^", 1)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def tool_call(number: str) -> str:
    tools = ", ".join(quoted(t) for t in TOOLS)
    return f"'[{{''name'': ''' || ([{tools}])[({number}) % {len(TOOLS)} + 1] || '''}}]'"


def blank(text: str) -> str:
    return f"NOT coalesce(regexp_matches({text}, {quoted(NOT_WHITESPACE)}), false)"


def cleaned(text: str) -> str:
    spaced = f"trim(regexp_replace({text}, '{WHITESPACE}+', ' ', 'g'), ' ')"
    return rf"regexp_replace({spaced}, '([.!?]){{2,}}', '\1', 'g')"


def mapped_role(message_type: str, role: str) -> str:
    return (
        f"CASE WHEN {message_type} = 'underwriter' THEN 'user' "
        f"WHEN {message_type} IN ('user-facing assistant', 'internal assistant') THEN 'assistant' "
        f"WHEN {message_type} = 'tool' THEN 'tool' ELSE coalesce(nullif({role}, ''), 'unknown') END"
    )


def pieces(text: str) -> str:
    return f"regexp_extract_all({text}, {quoted(PIECE)})"


def piece_id(piece: str) -> str:
    return f"(('0x' || substr(md5({piece}), 1, 8))::BIGINT % {VOCAB_SIZE})"


def rendered(role: str, content: str) -> str:
    return f"('<|im_start|>' || {role} || chr(10) || {content} || '<|im_end|>' || chr(10))"


def money(value: str) -> str:
    return f"coalesce('$' || format('{{:,}}', {value}), 'N/A')"


def number(value: str) -> str:
    return f"coalesce(CASE WHEN {value} > 1000 THEN format('{{:,}}', {value}) ELSE {value}::VARCHAR END, 'N/A')"


def prompt(p: str) -> str:
    """System message built from profile columns of table alias `p`."""
    lines = [
        f"'- Name: ' || coalesce({p}.company_name, 'N/A')",
        f"'- Annual Revenue: ' || {money(p + '.annual_revenue')}",
        f"'- Employees: ' || {number(p + '.number_of_employees')}",
        f"'- Total Payroll: ' || {money(p + '.total_payroll')}",
        f"'- Vehicles: ' || {number(p + '.number_of_vehicles')}",
        f"'- Building Construction: ' || coalesce({p}.building_construction, 'N/A')",
        f"'- State: ' || coalesce({p}.state, 'N/A')",
        f"'- Line of Business: ' || coalesce({p}.lob, 'N/A')",
        f"CASE WHEN {p}.company_description <> '' THEN '- Description: ' || {p}.company_description END",
    ]
    return f"concat_ws(chr(10), {quoted(SYSTEM_PREAMBLE)}, {', '.join(lines)})"


PROFILES = """
revenue AS (SELECT o_custkey, round(sum(o_totalprice))::BIGINT AS revenue FROM orders GROUP BY 1),
profiles AS (
  SELECT c_custkey, c_mktsegment AS segment, c_name AS company_name, revenue AS annual_revenue,
         (c_custkey * 37) % 5000 AS number_of_employees, round(c_acctbal * 10)::BIGINT AS total_payroll,
         c_custkey % 7 AS number_of_vehicles,
         CASE WHEN c_custkey % 11 <> 0 THEN 'Masonry' END AS building_construction,
         n_name AS state, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment || ' company' END AS company_description,
         lower(c_mktsegment) AS lob
  FROM customer LEFT JOIN revenue ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
)"""

# Raw examples from documents: `raw` has one row each, `raw_messages` one row per message.
RAW = f"""{PROFILES},
raw AS (
  SELECT d.doc_id AS id, d.source AS assistant_model, CASE WHEN d.doc_id % 50 <> 49 THEN d.lang END AS task,
         'answer in ' || d.lang AS reference_answer, l.quality = 1 AS correct, d.text IS NOT NULL AS has_trace,
         string_split(d.text, chr(10)) AS lines,
         len(string_split(d.text, chr(10))) + len(string_split(d.text, chr(10))) // 13
           + len(list_filter(range(len(string_split(d.text, chr(10)))), lambda i: d.doc_id % 2 = 0 AND i % 11 <> 10 AND (d.doc_id + i) % 5 = 1))
           AS n_messages, p.*
  FROM (SELECT doc_id, text, lang, source FROM documents
        UNION ALL SELECT -1 - doc_id, NULL, lang, source FROM documents WHERE doc_id % 97 = 96) d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN profiles p ON p.c_custkey = d.doc_id
),
numbered AS (
  SELECT id, i AS turn, part, CASE WHEN part = 1 THEN lines[i + 1] ELSE '' END AS line, kind
  FROM (SELECT id, i, lines, CASE WHEN i % 11 = 10 THEN -1 ELSE (id + i) % 5 END AS kind
        FROM raw, unnest(range(len(lines))) AS t(i) WHERE has_trace), unnest(range(2)) AS p(part)
  WHERE part = 1 OR (kind = 1 AND id % 2 = 0)
),
raw_messages AS (
  SELECT id, turn, part,
         CASE kind WHEN -1 THEN 'system' WHEN 0 THEN 'user' ELSE 'assistant' END AS role,
         line AS content,
         CASE WHEN kind = 0 THEN 'underwriter' WHEN kind IN (1, 3) THEN 'internal assistant'
              WHEN kind = 2 THEN 'tool' WHEN kind = 4 THEN 'user-facing assistant' END AS type,
         CASE WHEN kind = 1 THEN {tool_call('id + turn')} ELSE '' END AS tool_calls
  FROM numbered
)"""

# The same two tables from conversations.
LONG = f"""{PROFILES},
raw AS (
  SELECT c.conv_id AS id, l.quality = 1 AS correct, p.*
  FROM (SELECT DISTINCT conv_id FROM conversations) c
  LEFT JOIN labels l ON l.doc_id = c.conv_id LEFT JOIN profiles p ON p.c_custkey = c.conv_id
),
cuts AS (SELECT *, instr(text, chr(10)) AS cut FROM conversations),
raw_messages AS (
  SELECT conv_id AS id, turn, 0 AS part, 'assistant' AS role, '' AS content, 'internal assistant' AS type,
         {tool_call('conv_id')} AS tool_calls
  FROM cuts WHERE role = 'assistant' AND turn % 3 = 1
  UNION ALL
  SELECT conv_id, turn, 1, 'assistant', substr(text, 1, cut - 1), 'internal assistant', ''
  FROM cuts WHERE role = 'assistant' AND cut > 0
  UNION ALL
  SELECT conv_id, turn, 2, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END,
         CASE WHEN role = 'assistant' AND cut > 0 THEN substr(text, cut + 1) ELSE text END,
         CASE role WHEN 'user' THEN 'underwriter' WHEN 'system' THEN 'tool' ELSE 'user-facing assistant' END, ''
  FROM cuts
)"""

# From `raw` and `raw_messages`: kept turns, merged messages, usable conversations.
TURNS = f"""
turns AS (
  SELECT id, turn, part, {mapped_role('type', 'role')} AS role, {cleaned('content')} AS content, type,
         coalesce(tool_calls <> '', false) AS has_tool_calls
  FROM raw_messages WHERE NOT ({blank('content')})
)"""
MERGED = f"""{TURNS},
marked AS (
  SELECT *, CASE WHEN role = 'assistant' AND lag(role) OVER w = 'assistant' THEN 0 ELSE 1 END AS starts,
         CASE WHEN type = 'internal assistant' THEN '<think>' || content || '</think>' ELSE content END AS piece
  FROM turns WINDOW w AS (PARTITION BY id ORDER BY turn, part)
),
runs AS (
  SELECT *, sum(starts) OVER (PARTITION BY id ORDER BY turn, part ROWS UNBOUNDED PRECEDING) AS run FROM marked
),
merged AS (
  SELECT id, run::BIGINT AS pos, min(turn) AS turn, arg_min(part, turn * 10 + part) AS part, min(role) AS role,
         string_agg(piece, '' ORDER BY turn, part) AS content, count(*) AS merged_turns
  FROM runs GROUP BY id, run
)"""
EXAMPLES = f"""{MERGED},
ends AS (
  SELECT id, max(pos) AS last, arg_max(role, pos) AS last_role, arg_max(content, pos) AS target_response
  FROM merged GROUP BY id
),
usable AS (
  SELECT e.id, last, target_response FROM ends e JOIN raw r ON r.id = e.id
  WHERE last_role = 'assistant' AND r.correct
),
messages AS (
  SELECT m.id, m.pos, m.role, m.content FROM merged m JOIN usable u ON u.id = m.id WHERE m.pos < u.last
  UNION ALL
  SELECT u.id, 0, 'system', {prompt('r')} FROM usable u JOIN raw r ON r.id = u.id
),
examples AS (
  SELECT m.id, any_value(r.task) AS task, any_value(u.target_response) AS target_response,
         count(*) - 1 AS num_turns, count(*) FILTER (WHERE role = 'user') AS num_user_turns,
         count(*) FILTER (WHERE role = 'assistant') AS num_assistant_turns, count(*) FILTER (WHERE role = 'tool') AS num_tool_turns,
         string_agg({rendered('role', 'content')}, '' ORDER BY pos) AS text, sum(length(content)) AS chars
  FROM messages m JOIN usable u ON u.id = m.id
  JOIN (SELECT id, {{task}} AS task FROM raw) r ON r.id = m.id GROUP BY m.id
)"""


def raw_sql(select: str) -> str:
    return f"WITH {RAW} {select}"


def turns_sql(select: str) -> str:
    return f"WITH {RAW}, {TURNS} {select}"


def merged_sql(select: str) -> str:
    return f"WITH {RAW}, {MERGED} {select}"


def examples_sql(select: str, more: str = "") -> str:
    return f"WITH {RAW}, {EXAMPLES.replace('{task}', 'task')}{more} {select}"


def long_sql(select: str) -> str:
    return f"WITH {LONG} {select}"


def long_turns_sql(select: str) -> str:
    return f"WITH {LONG}, {TURNS} {select}"


def long_merged_sql(select: str) -> str:
    return f"WITH {LONG}, {MERGED} {select}"


def long_examples_sql(select: str) -> str:
    return f"WITH {LONG}, {EXAMPLES.replace('{task}', 'segment')} {select}"


TOOL_NAMES = f"""regexp_extract_all(tool_calls, {quoted(f"'name':{WHITESPACE}*'([^']+)'")}, 1)"""
