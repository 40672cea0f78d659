"""SQL of the queries of this folder that SQL can express."""

from turnflow.llm.chat_windows import END, MARKS, TURN
from turnflow.llm.seed_extend import WINDOW as WORDS
from turnflow.llm.suffix_dedup import WINDOW

#: Windows of bytes as hex text; runs of removed windows; what is left between the runs.
SUFFIX_DEDUP = f"""
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
  SELECT doc_id, p.s AS s, p.w AS w FROM (
    SELECT doc_id, unnest(list_transform(range(len(h) // 2 - {WINDOW - 1}),
                                         lambda s: {{'s': s, 'w': md5(substr(h, 2 * s + 1, {2 * WINDOW}))}})) AS p FROM texts)
),
least AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w),
gone AS (SELECT x.doc_id, s FROM windows x JOIN least USING (w) WHERE first < x.doc_id),
marked AS (
  SELECT *, coalesce(s > lag(s) OVER d + {WINDOW}, true) AS opens FROM gone WINDOW d AS (PARTITION BY doc_id ORDER BY s)
),
numbered AS (SELECT doc_id, s, count(*) FILTER (opens) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM marked),
runs AS (SELECT doc_id, run, min(s) AS b, max(s) + {WINDOW} AS e FROM numbered GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, coalesce(lag(e) OVER d, 0) AS a, b AS z FROM runs WINDOW d AS (PARTITION BY doc_id ORDER BY b)
  UNION ALL
  SELECT t.doc_id, coalesce(max(e), 0), any_value(len(h)) // 2 FROM texts t LEFT JOIN runs r ON r.doc_id = t.doc_id GROUP BY t.doc_id
),
kept AS (
  SELECT t.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (z - a)), '' ORDER BY a, z) AS left_over
  FROM texts t JOIN gaps g ON g.doc_id = t.doc_id GROUP BY t.doc_id
)
SELECT t.doc_id, len(t.h) // 2 AS n_bytes, (len(t.h) - len(k.left_over)) // 2 AS n_removed,
       (SELECT count(*) FROM runs r WHERE r.doc_id = t.doc_id) AS n_spans, sha256(unhex(k.left_over)) AS kept_sha256
FROM texts t JOIN kept k ON k.doc_id = t.doc_id"""


#: Windows of words as digests; the words that no repeated window covers, in order.
SEED_EXTEND = f"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
windows AS (
  SELECT doc_id, p.s AS s, p.w AS w FROM (
    SELECT doc_id, unnest(list_transform(range(len(words) - {WORDS - 1}),
             lambda s: {{'s': s, 'w': md5(array_to_string(words[s + 1 : s + {WORDS}], ' '))}})) AS p FROM texts)
),
ranked AS (SELECT doc_id, s, rank() OVER (PARTITION BY w ORDER BY doc_id, s) AS place FROM windows),
gone AS (SELECT doc_id, unnest(range(s, s + {WORDS})) AS k FROM ranked WHERE place > 1),
lost AS (SELECT doc_id, list(DISTINCT k) AS ks FROM gone GROUP BY doc_id),
kept AS (
  SELECT t.doc_id, len(words) AS n_words,
         list_filter(words, lambda w, k: ks IS NULL OR NOT list_contains(ks, k - 1)) AS left_over
  FROM texts t LEFT JOIN lost l ON l.doc_id = t.doc_id
)
SELECT doc_id, n_words, n_words - len(left_over) AS n_removed, sha256(array_to_string(left_over, ' ')) AS kept_sha256 FROM kept"""


def chat_windows(budget: int, history: int) -> str:
    """Windows by the same prefix sums; of the formatted texts only the lengths are needed."""
    escaped = "replace(replace({}, '\\', '\\b'), '<|', '<\\p|')"
    size = (f"{len(TURN) + 1 + len(END)} + length(replace({escaped.format('role')}, chr(10), '\\n')) "
            f"+ length({escaped.format('text')})")
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
placed AS (
  SELECT *, row_number() OVER w AS place, {size} AS size, {MARKS} + len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS tokens
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
),
opened AS (SELECT conv_id AS c, tokens AS system_tokens, size AS system_size FROM placed WHERE place = 1 AND role = 'system'),
summed AS (
  SELECT p.*, place = 1 AND role = 'system' AS is_system, coalesce(system_size, 0) AS system_size,
         greatest(coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                  - coalesce(system_tokens, 0), 0)::BIGINT AS before,
         greatest({budget - history} - coalesce(system_tokens, 0), {max(1, budget // 4)}) AS room
  FROM placed p LEFT JOIN opened o ON o.c = p.conv_id
),
cut AS (
  SELECT *, CASE WHEN is_system THEN 0
                 ELSE 2 * (before // room) + ((before + tokens - 1) // room > before // room)::INTEGER END AS win
  FROM summed
),
starts AS (
  SELECT conv_id AS c, win AS w, min(before) FILTER (NOT is_system) AS start, min(place) AS first_place,
         sum(size) AS own, bool_or(is_system) AS has_system, any_value(system_size) AS system_size
  FROM cut GROUP BY 1, 2
),
context AS (
  SELECT c, w, sum(size) AS context
  FROM cut JOIN starts ON c = conv_id AND w > win AND place < first_place
  WHERE NOT is_system AND start - before <= least({history}, room) GROUP BY 1, 2
),
lengths AS (
  SELECT s.c AS conv_id, sum(own + coalesce(context, 0) + CASE WHEN has_system THEN 0 ELSE system_size END)::BIGINT AS formatted_chars
  FROM starts s LEFT JOIN context x ON x.c = s.c AND x.w = s.w GROUP BY 1
),
digests AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
         coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
         sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256
  FROM placed GROUP BY 1
)
SELECT d.*, formatted_chars FROM digests d JOIN lengths l ON l.conv_id = d.conv_id"""
