"""The queries of `workload.queries` in DuckDB's SQL."""

from __future__ import annotations

# The prompts, spelled out once more for the SQL side.
GERMAN_TEMPLATE = """You are helping to build a test set for English to German idiom translation.

Idiom: **{idiom}**
What it means: {meaning}
German counterpart: "{german_idiom}"

Write one natural English sentence with the idiom in bold. Then give that sentence in German three times:
A - idiomatic, with the German counterpart exactly as given
B - correct, saying what is meant without any idiom
C - wrong, the idiom carried over word by word

Answer with a single JSON object and nothing else. Its keys:
english_sentence, target_A, target_B, target_C"""

IDENTIFICATION_TEMPLATE = """You know the idioms of both English and Urdu well.

English idiom: "{idiom}"
What it means: "{meaning}"
Used in: "{sentence}"

Which Urdu idiom or proverb comes closest to this figurative meaning?

Answer with a single JSON object and nothing else. Its keys:
urdu_idiom_native (in Perso-Arabic script), urdu_idiom_roman (in Latin script)"""

URDU_TEMPLATE = """You are helping to build a test set for English to Urdu idiom translation.

English sentence: "{sentence}"
English idiom: "{idiom}"
What it means: "{meaning}"
Urdu idiom in Perso-Arabic script: "{urdu_native}"
Urdu idiom in Latin script: "{urdu_roman}"

Translate the sentence six times, three times in each script.
A - idiomatic, with the Urdu idiom of that script exactly as given
B - correct, saying what is meant without the idiom
C - wrong, the English idiom carried over word by word
Each Latin version is the same sentence as the Perso-Arabic one of its letter.

Answer with a single JSON object and nothing else. Its keys:
target_A_native, target_B_native, target_C_native, target_A_roman, target_B_roman, target_C_roman"""

ORACLE_SQL: dict[str, str] = {}

# Unicode whitespace, spelled out once more for the SQL side.
_SPACES = " || ".join(f"chr({n})" for n in [
    9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def _gather(table: str, keys: str, position: str, extra: str = "") -> str:
    texts = ", ".join(f"max(CASE WHEN {position} % 4 = {i} THEN text END) AS {name}"
                      for i, name in enumerate(("src", "cand_a", "cand_b", "cand_c")))
    return f"SELECT {keys}, {texts}{extra} FROM {table} GROUP BY ALL"


_SOURCE = ", ".join(f"max(CASE WHEN doc_id % 4 = 0 THEN {c} END) AS {c}" for c in ("lang", "source"))
TRI = _gather("documents", "doc_id // 4 AS seg_id", "doc_id", ", " + _SOURCE)
CONV = _gather("conversations", "conv_id, turn // 4 AS part", "turn")
COMPLETE = "src IS NOT NULL AND cand_a IS NOT NULL AND cand_b IS NOT NULL AND cand_c IS NOT NULL"


def _words(text: str) -> str:
    return f"string_split({text}, ' ')"


def _overlap(hyp: str, against: str) -> str:
    return (f"CAST(floor(100 * len(list_intersect({_words(hyp)}, {_words(against)})) "
            f"/ len(list_distinct({_words(hyp)}))) AS DOUBLE)")


QE = [(f"Score_QE_{c.upper()}", f"cand_{c}", "src") for c in "abc"]
REF = [(f"Score_{h.upper()}_Ref_{r.upper()}", f"cand_{h}", f"cand_{r}")
       for r in "abc" for h in "abc" if h != r]
NINE = QE + REF


def _scores(tasks, form=_overlap) -> str:
    return ", ".join(f"{form(hyp, against)} AS {label}" for label, hyp, against in tasks)


def _scored(tasks, form=_overlap, keep="seg_id, lang, source") -> str:
    return f"SELECT {keep}, {_scores(tasks, form)} FROM ({TRI})"


def _distance(hyp: str, against: str) -> str:
    return f"100 - {_overlap(hyp, against)}"


def _nan_below(hyp: str, against: str) -> str:
    return (f"CASE WHEN len(list_distinct({_words(hyp)})) < 20 THEN CAST('NaN' AS DOUBLE) "
            f"ELSE {_overlap(hyp, against)} END")


CONV_SCORED = (f"SELECT conv_id, part, {_scores(NINE, _nan_below)} FROM ({CONV}) WHERE {COMPLETE}")


def _wins(left: str, right: str, sign: str) -> str:
    """Comparisons with NaN count as lost; NaN is not above everything here."""
    return (f"CAST(sum(CASE WHEN {left} {sign} {right} AND NOT isnan({left}) AND NOT isnan({right}) "
            f"THEN 1 ELSE 0 END) AS DOUBLE) / count(*)")


def _pair_rows(source: str, sign: str, by: str = "") -> str:
    head, tail = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return " UNION ALL ".join(
        f"SELECT {head}'{a}{b}' AS pair, {_wins('Score_QE_' + a, 'Score_QE_' + b, sign)} AS win_rate "
        f"FROM s{tail}" for a, b in ("AB", "AC", "BC")).join([f"WITH s AS ({source}) ", ""])


def _mean_rows(source: str, by: str, skip: bool) -> str:
    return f"WITH s AS ({source}) " + " UNION ALL ".join(
        f"SELECT {by}, '{label}' AS task, avg({label})"
        + (f" FILTER (WHERE NOT isnan({label}))" if skip else "")
        + f" AS average FROM s GROUP BY {by}" for label, _, _ in NINE)


ORACLE_SQL["triples_from_documents"] = f"SELECT seg_id, src, cand_a, cand_b, cand_c FROM ({TRI})"
ORACLE_SQL["drop_incomplete_triples_of_conversations"] = f"SELECT * FROM ({CONV}) WHERE {COMPLETE}"
ORACLE_SQL["qe_scores_wide"] = _scored(QE, keep="seg_id")
ORACLE_SQL["nine_task_scores_long"] = " UNION ALL ".join(
    f"SELECT seg_id, '{label}' AS task, {str(against == 'src').lower()} AS is_qe, "
    f"{_overlap(hyp, against)} AS score FROM ({TRI})" for label, hyp, against in NINE)
ORACLE_SQL["nine_task_scores_of_pairs"] = ORACLE_SQL["nine_task_scores_long"]
ORACLE_SQL["nine_task_scores_wide"] = _scored(NINE, keep="seg_id")
ORACLE_SQL["batch_scorer_pandas"] = ORACLE_SQL["nine_task_scores_wide"]
ORACLE_SQL["request_reply_round_trip"] = ORACLE_SQL["nine_task_scores_wide"]
ORACLE_SQL["replies_by_line_order"] = f"SELECT * EXCLUDE (Score_A_Ref_C) FROM ({ORACLE_SQL['nine_task_scores_wide']})"
ORACLE_SQL["averages_propagate_nan"] = _mean_rows(CONV_SCORED, "conv_id", skip=False)
ORACLE_SQL["averages_skip_nan"] = _mean_rows(CONV_SCORED, "part", skip=True)
ORACLE_SQL["exact_averages"] = f"WITH s AS ({CONV_SCORED}) " + " UNION ALL ".join(
    f"SELECT conv_id, '{label}' AS task, fsum({label}) / count({label}) AS average FROM s GROUP BY conv_id"
    for label, _, _ in NINE)
ORACLE_SQL["win_rates_with_nan"] = _pair_rows(CONV_SCORED, ">", "part")
ORACLE_SQL["win_rates_higher_better"] = _pair_rows(_scored(QE), ">")
ORACLE_SQL["win_rates_lower_better"] = _pair_rows(_scored(QE, _distance), "<")
ORACLE_SQL["win_rates_by_language"] = _pair_rows(_scored(QE), ">", "lang")

ORACLE_SQL["report_rows"] = f"WITH s AS ({_scored(NINE, _distance)}) " + " UNION ALL ".join(
    [f"SELECT lang, 'averages' AS section, '{label}' AS key, avg({label}) AS value FROM s GROUP BY lang"
     for label, _, _ in NINE]
    + [f"SELECT lang, 'win_rates' AS section, '{a}_beats_{b}' AS key, "
       f"{_wins('Score_QE_' + a, 'Score_QE_' + b, '<')} AS value FROM s GROUP BY lang"
       for a, b in ("AB", "AC", "BC")])

_LABELS = {"A": "Figurative", "B": "Literal", "C": "Incorrect"}
ORACLE_SQL["report_rows_labelled"] = f"WITH s AS ({_scored(QE)}) " + " UNION ALL ".join(
    [f"SELECT '{kind}' AS kind, 'averages' AS section, '{prefix}{c}_{_LABELS[c]}' AS key, "
     f"avg(Score_QE_{c}) AS value FROM s"
     for kind, prefix in (("judge", ""), ("calibrated", "QE_")) for c in "ABC"]
    + [f"SELECT '{kind}' AS kind, 'win_rates' AS section, '{prefix}{a}_vs_{b}' AS key, "
       f"{_wins('Score_QE_' + a, 'Score_QE_' + b, '>')} AS value FROM s"
       for kind, prefix, pairs in (("judge", "win_rate_", ["AB"]), ("calibrated", "", ["AB", "AC", "BC"]))
       for a, b in pairs])

ORACLE_SQL["scorer_failure_policy"] = (
    f"WITH t AS ({TRI}), failed AS (SELECT source, "
    + ", ".join(f"bool_or(NOT contains(cand_{c}, ' ')) AS bad_{c}" for c in "abc")
    + " FROM t GROUP BY source) SELECT seg_id, t.source, "
    + ", ".join(f"CASE WHEN bad_{c} THEN 0.0 ELSE {_overlap('cand_' + c, 'src')} END "
                f"AS Score_QE_{c.upper()}, bad_{c} AS failed_Score_QE_{c.upper()}" for c in "abc")
    + " FROM t JOIN failed ON t.source = failed.source")

_BAD = f"WITH t AS ({TRI}), bad AS (SELECT count(*) AS n, " + ", ".join(
    f"bool_or(NOT contains(cand_{c}, ' ')) AS bad_{c}" for c in "abc") + " FROM t), "
_JUDGED = _BAD + "s AS (SELECT n, bad_a, bad_b, bad_c, " + ", ".join(
    f"CASE WHEN bad_{c} THEN 0.0 ELSE {_overlap('cand_' + c, 'src')} END AS Score_QE_{c.upper()}"
    for c in "abc") + " FROM t, bad) "
ORACLE_SQL["judge_with_failed_call"] = _JUDGED + " UNION ALL ".join(
    [f"SELECT 'averages' AS section, '{c}_{name}' AS key, avg(Score_QE_{c}) AS value FROM s"
     for c, name in (("A", "Figurative"), ("B", "Literal"), ("C", "Incorrect"))]
    + [f"SELECT 'win_rates' AS section, 'win_rate_A_vs_B' AS key, {_wins('Score_QE_A', 'Score_QE_B', '>')} AS value FROM s"]
    + [f"SELECT 'failed' AS section, 'Score_QE_{c.upper()}' AS key, "
       f"CASE WHEN bad_{c} THEN CAST(n AS DOUBLE) ELSE 0 END AS value FROM bad" for c in "abc"])
ORACLE_SQL["distance_with_failed_task"] = _BAD + f"s AS ({_scored(NINE, _distance, keep='seg_id')}) " + " UNION ALL ".join(
    [f"SELECT 'averages' AS section, '{label}' AS key, avg({label}) AS value FROM s, bad "
     f"WHERE NOT bad_{hyp[-1]} HAVING count(*) > 0" for label, hyp, _ in NINE]
    + [f"SELECT 'win_rates' AS section, '{a}_beats_{b}' AS key, "
       f"{_wins('Score_QE_' + a, 'Score_QE_' + b, '<')} AS value FROM s, bad "
       f"WHERE NOT bad_{a.lower()} AND NOT bad_{b.lower()} HAVING count(*) > 0" for a, b in ("AB", "AC", "BC")]
    + [f"SELECT 'failed' AS section, '{label}' AS key, "
       f"CASE WHEN bad_{hyp[-1]} THEN CAST(n AS DOUBLE) ELSE 0 END AS value FROM bad" for label, hyp, _ in NINE])

# The code is what the judge calls the language.
ORACLE_SQL["language_codes_at_scorer"] = " UNION ALL ".join(
    f"SELECT '{language}' AS language, seg_id, "
    + ", ".join(f"CAST(length(cand_{c}) % 7 + {10 * len(code) + 1} AS DOUBLE) AS Score_QE_{c.upper()}" for c in "abc")
    + f" FROM ({TRI}) WHERE {COMPLETE}"
    for language, code in (("de", "de"), ("ur-native", "ur"), ("ur-roman", "ur_roman")))

_NAMES = {"de": ("Figurative", "Literal", "Incorrect"),
          "ur-native": ("Native Idiomatic", "Native Descriptive", "Native Literal"),
          "ur-roman": ("Roman Idiomatic", "Roman Descriptive", "Roman Literal")}
ORACLE_SQL["language_reports"] = f"WITH s AS ({_scored(QE)} WHERE {COMPLETE}) " + " UNION ALL ".join(
    [f"SELECT '{language}' AS language, 'QE_{c}_{name}' AS key, avg(Score_QE_{c}) AS value FROM s"
     for language, names in _NAMES.items() for c, name in zip("ABC", names)]
    + [f"SELECT '{language}' AS language, '{a}_vs_{b}' AS key, {_wins('Score_QE_' + a, 'Score_QE_' + b, '>')} AS value FROM s"
       for language in _NAMES for a, b in ("AB", "AC", "BC")])

# The replies of one language are lost and one reply is there twice, so these tasks are left out.
ORACLE_SQL["request_count_guard"] = _scored(
    [t for t in NINE if t[0] not in ("Score_A_Ref_C", "Score_B_Ref_A")], keep="seg_id")

ORACLE_SQL["csv_round_trip_clean"] = """
SELECT doc_id, text, CASE lang WHEN 'de' THEN '"' || text || '"' WHEN 'fr' THEN NULL
  WHEN 'es' THEN ' ' || text || chr(9) ELSE '\\", ' || text || '\\' END AS note FROM documents"""

ORACLE_SQL["quoted_split_scan"] = """
SELECT doc_id, 'a "q"' || chr(13) || chr(10) || text || chr(10) || chr(10) AS text, lang FROM documents"""

ORACLE_SQL["header_resolution"] = """
SELECT c_custkey AS seg_id, c_name AS src, c_acctbal AS cand_a, c_mktsegment AS cand_b,
  c_name || '!' AS cand_c FROM customer"""

ORACLE_SQL["blank_idiom_filter"] = f"""
WITH lines AS (SELECT doc_id, lang, source, string_split(text, chr(10)) AS parts FROM documents),
numbered AS (SELECT doc_id, lang, source, unnest(parts) AS line, generate_subscripts(parts, 1) AS n
  FROM lines),
stripped AS (SELECT doc_id, n, trim(line, {_SPACES}) AS idiom, source AS meaning, lang AS german_idiom
  FROM numbered)
SELECT row_number() OVER (ORDER BY doc_id, n) - 1 AS idiom_id, idiom, meaning, german_idiom
FROM stripped WHERE idiom <> ''"""

ORACLE_SQL["base_table_scan"] = """
SELECT p_partkey AS idiom_id, p_name AS idiom, p_type AS meaning, p_brand AS german_idiom
FROM part WHERE p_type <> 'SMALL'"""

ORACLE_SQL["curated_scan"] = """
SELECT CAST(p_partkey AS INTEGER) AS idiom_id, p_name AS english_idiom,
  p_type || ', ' || p_brand AS urdu_roman, translate(p_name, 'aeion', 'اےیون') AS urdu_native FROM part"""

ORACLE_SQL["row_ordinals"] = """
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS seg_id FROM orders"""


def _filled(template: str, values: dict[str, str]) -> str:
    text = "'" + template.replace("'", "''") + "'"
    for name, column in values.items():
        text = text.replace("{" + name + "}", f"' || {column} || '")
    return text


_PROMPT = {"idiom": "p_name", "meaning": "p_type", "german_idiom": "p_brand",
           "sentence": "'It is a ' || p_name", "urdu_native": "p_brand", "urdu_roman": "p_type"}
ORACLE_SQL["prompt_table"] = f"""
SELECT p_partkey AS idiom_id, {_filled(GERMAN_TEMPLATE, _PROMPT)} AS german_prompt,
  {_filled(IDENTIFICATION_TEMPLATE, _PROMPT)} AS identification_prompt,
  {_filled(URDU_TEMPLATE, _PROMPT)} AS urdu_prompt FROM part"""

_URDU_BODY = ", ".join(f'"target_{c}_{script}": "\' || \'{c}{script[0]}\' || k || \'"'
                       for script in ("native", "roman") for c in "ABC")
ATTEMPTS = f"""
ev AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    event_id % 12 // 4 AS stage_no FROM events),
body AS (SELECT *, CASE stage_no
    WHEN 0 THEN CASE WHEN k % 11 = 0 THEN '{{"target_A": "a' || k || '"}}'
      ELSE '{{"english_sentence": "' || event_type || ' ' || k || '", "target_A": "a' || k
        || '", "target_B": "b' || k || '", "target_C": "c' || k || '"}}' END
    WHEN 1 THEN CASE WHEN k % 7 = 0 THEN '{{"urdu_idiom_native": "' || event_type || '"}}'
      ELSE '{{"urdu_idiom_native": "' || event_type || '", "urdu_idiom_roman": "'
        || CASE WHEN k % 5 = 0 THEN '' ELSE 'r' || k END || '"}}' END
    ELSE '{{{_URDU_BODY}}}' END AS object FROM ev),
att AS (SELECT event_id, ['german', 'urdu_ident', 'urdu_trans'][stage_no + 1] AS stage,
    event_id // 12 AS idiom_id, CAST(event_id % 4 + 1 AS INTEGER) AS attempt,
    CASE k % 6 WHEN 0 THEN object WHEN 1 THEN '```json' || chr(10) || object || chr(10) || '```'
      WHEN 2 THEN 'Here it is:' || chr(10) || object || chr(10)
      WHEN 3 THEN object || ' Hope this helps!' WHEN 4 THEN '{{}}' END AS response,
    CASE WHEN k % 6 < 5 THEN k END AS prompt_tokens,
    CASE WHEN k % 6 < 5 THEN 99 - k END AS completion_tokens FROM body),
bare AS (SELECT *, trim(regexp_replace(trim(regexp_replace(trim(response, {_SPACES}),
    '^```.*?\\n', '', 's'), {_SPACES}), '```$', ''), {_SPACES}) AS whole FROM att),
tail AS (SELECT *, regexp_extract(whole, '\\{{.*\\}}\\s*$', 0, 's') AS ending FROM bare),
picked AS (SELECT *, CASE WHEN json_valid(whole) AND json_type(whole) = 'OBJECT' THEN whole
    WHEN json_valid(ending) AND json_type(ending) = 'OBJECT' THEN ending END AS found FROM tail),
parsed AS (SELECT *, CASE WHEN len(json_keys(found)) > 0 THEN found END AS reply FROM picked)
"""


def _key(name: str) -> str:
    return f"json_extract_string(reply, '$.{name}')"


ORACLE_SQL["extract_json_replies"] = f"""
WITH {ATTEMPTS} SELECT event_id, reply IS NOT NULL AS valid,
  {_key('english_sentence')} AS english_sentence, {_key('target_A')} AS target_a,
  {_key('urdu_idiom_roman')} AS urdu_idiom_roman, {_key('target_C_roman')} AS target_c_roman FROM parsed"""

ORACLE_SQL["first_valid_attempt"] = f"""
WITH {ATTEMPTS} SELECT stage, idiom_id, attempt, {_key('english_sentence')} AS english_sentence,
  {_key('urdu_idiom_roman')} AS urdu_idiom_roman, {_key('target_A_native')} AS "target_A_native"
FROM parsed WHERE reply IS NOT NULL AND attempt <= 3
QUALIFY row_number() OVER (PARTITION BY stage, idiom_id ORDER BY attempt) = 1"""

_URDU_KEYS = [f"target_{c}_{script}" for script in ("native", "roman") for c in "ABC"]


def _stage(name: str, keys: list[str], required: str = "TRUE") -> str:
    fields = ", ".join(f'{_key(k)} AS "{k}"' for k in keys)
    return f"""(SELECT idiom_id, attempt, {fields} FROM parsed
  WHERE stage = '{name}' AND reply IS NOT NULL AND {required} AND attempt <= 3
  QUALIFY row_number() OVER (PARTITION BY idiom_id ORDER BY attempt) = 1)"""


STAGES = f"""{ATTEMPTS},
g AS {_stage('german', ['english_sentence', 'target_A', 'target_B', 'target_C'],
             "json_contains(json_keys(reply)::JSON, '\"english_sentence\"')")},
i AS {_stage('urdu_ident', ['urdu_idiom_native', 'urdu_idiom_roman'])},
u AS {_stage('urdu_trans', _URDU_KEYS)}"""

_WIDE = """p_partkey AS "Idiom ID", p_name AS "English Idiom", p_type AS "Meaning",
  english_sentence AS "English Sentence", p_brand AS "German Idiom Match",
  "target_A" AS "German Target A (Figurative)", "target_B" AS "German Target B (Alternative)",
  "target_C" AS "German Target C (Literal Incorrect)",
  native AS "Urdu Native Idiom", roman AS "Urdu Roman Idiom", """ + ", ".join(
    f'CASE WHEN native <> \'\' AND roman <> \'\' THEN "target_{c}_{script}" END '
    f'AS "Urdu {script.title()} Target {c} ({kind})"'
    for script in ("native", "roman")
    for c, kind in (("A", "Idiomatic"), ("B", "Descriptive"), ("C", "Literal")))


def _dataset(native: str, roman: str, more: str = "") -> str:
    return f"""WITH {STAGES}, named AS (SELECT part.*, g.*, {native} AS native, {roman} AS roman
  FROM part JOIN g ON p_partkey = g.idiom_id LEFT JOIN i ON p_partkey = i.idiom_id {more})
SELECT {_WIDE} FROM named LEFT JOIN u ON p_partkey = u.idiom_id"""


ORACLE_SQL["stage_gating"] = _dataset("urdu_idiom_native", "urdu_idiom_roman")
ORACLE_SQL["dataset_creation"] = _dataset(
    "coalesce('t' || toxic, urdu_idiom_native)", "coalesce('q' || quality, urdu_idiom_roman)",
    "LEFT JOIN labels ON p_partkey = doc_id")

_D = f"d AS ({ORACLE_SQL['dataset_creation']})"


def _script(column: str, own: str, other: str) -> str:
    return (f'("{column}" IS NULL OR (regexp_matches("{column}", \'\\p{{{own}}}\') '
            f'AND NOT regexp_matches("{column}", \'\\p{{{other}}}\')))')


def _has(text: str, phrase: str, around: str = "") -> str:
    return (f"coalesce(\"{phrase}\" <> '' AND contains(\"{text}\", '{around}' || \"{phrase}\" || '{around}'), FALSE)")


_SCRIPT_COLUMNS = {script: [f"Urdu {script} Idiom", *(f"Urdu {script} Target {c} ({kind})" for c, kind in (
    ("A", "Idiomatic"), ("B", "Descriptive"), ("C", "Literal")))] for script in ("Native", "Roman")}
_RULES = {
    "sentence has the idiom in bold": _has("English Sentence", "English Idiom", "**"),
    "German A uses the idiom": _has("German Target A (Figurative)", "German Idiom Match"),
    **{f"{script.lower()} A uses the idiom": f'("{columns[1]}" IS NULL OR {_has(columns[1], columns[0])})'
       for script, columns in _SCRIPT_COLUMNS.items()},
    **{f"{script.lower()} texts are in their script": " AND ".join(
        _script(c, *(("Arabic", "Latin") if script == "Native" else ("Latin", "Arabic"))) for c in columns)
       for script, columns in _SCRIPT_COLUMNS.items()}}
ORACLE_SQL["created_dataset_violations"] = f"WITH {_D} " + " UNION ALL ".join(
    f"SELECT \"Idiom ID\", '{rule}' AS rule FROM d WHERE NOT ({ok})" for rule, ok in _RULES.items())

_READ = {"de": [f"German Target {c}" for c in ("A (Figurative)", "B (Alternative)", "C (Literal Incorrect)")],
         "ur-native": _SCRIPT_COLUMNS["Native"][1:], "ur-roman": _SCRIPT_COLUMNS["Roman"][1:]}
_CHAIN = " UNION ALL ".join(
    f"SELECT '{language}' AS language, " + ", ".join(
        f'CAST(10 * length("{c}") + length("English Sentence") AS DOUBLE) AS Score_QE_{r}' for r, c in zip("ABC", columns))
    + ' FROM d WHERE "English Sentence" <> \'\' AND ' + " AND ".join(f'"{c}" <> \'\'' for c in columns)
    for language, columns in _READ.items())
ORACLE_SQL["created_dataset_reports"] = f"WITH {_D}, s AS ({_CHAIN}) " + " UNION ALL ".join(
    [f"SELECT '{language}' AS language, 'QE_{c}_{name}' AS key, avg(Score_QE_{c}) AS value FROM s WHERE language = '{language}'"
     for language, names in _NAMES.items() for c, name in zip("ABC", names)]
    + [f"SELECT '{language}' AS language, '{a}_vs_{b}' AS key, {_wins('Score_QE_' + a, 'Score_QE_' + b, '>')} AS value "
       f"FROM s WHERE language = '{language}'" for language in _NAMES for a, b in ("AB", "AC", "BC")])

ORACLE_SQL["retry_rounds"] = f"""
WITH {ATTEMPTS}, tries AS (SELECT p_partkey AS idiom_id, unnest([1, 2, 3]) AS attempt FROM part),
checked AS (SELECT t.idiom_id, t.attempt, prompt_tokens, completion_tokens,
  coalesce({_key('english_sentence')} IS NOT NULL, FALSE) AS valid
  FROM tries t LEFT JOIN parsed p
    ON p.stage = 'german' AND p.idiom_id = t.idiom_id AND p.attempt = t.attempt),
ends AS (SELECT idiom_id, min(attempt) FILTER (WHERE valid) AS done FROM checked GROUP BY idiom_id)
SELECT c.idiom_id, c.attempt, c.prompt_tokens, c.valid FROM checked c
JOIN ends e ON c.idiom_id = e.idiom_id WHERE c.attempt <= coalesce(done, 3)"""

_MADE = f"""WITH {ATTEMPTS}, ends AS (SELECT stage, idiom_id,
    min(attempt) FILTER (WHERE reply IS NOT NULL AND attempt <= 3) AS done
  FROM parsed GROUP BY stage, idiom_id),
sums AS (SELECT p.stage, sum(prompt_tokens) AS tokens_in, sum(completion_tokens) AS tokens_out
  FROM parsed p JOIN ends e ON p.stage = e.stage AND p.idiom_id = e.idiom_id
  WHERE p.attempt <= coalesce(done, 3) GROUP BY p.stage),
every AS (SELECT * FROM sums UNION ALL SELECT 'total', sum(tokens_in), sum(tokens_out) FROM sums),
costs AS (SELECT stage, CAST(tokens_in AS BIGINT) AS prompt_tokens,
  CAST(tokens_out AS BIGINT) AS completion_tokens,
  round(tokens_in / 1000.0::DOUBLE * 0.01::DOUBLE + tokens_out / 1000.0::DOUBLE * 0.1::DOUBLE, 6) AS cost
  FROM every)"""
ORACLE_SQL["token_cost_rollup"] = f"{_MADE} SELECT * FROM costs"
ORACLE_SQL["formatted_costs"] = f"{_MADE} SELECT stage, '$' || format('{{:.4f}}', cost) AS cost FROM costs"

ORACLE_SQL["curation_override"] = """
SELECT d.doc_id AS idiom_id, coalesce('q' || quality, source) AS urdu_idiom_roman,
  coalesce('t' || toxic, lang) AS urdu_idiom_native
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""

ORACLE_SQL["candidate_pool_choice"] = """
WITH pool AS (SELECT doc_id AS idiom_id, 'documents' AS generator, text AS candidate FROM documents
  UNION ALL SELECT conv_id, 'turns', text FROM conversations
  UNION ALL SELECT page_id, 'pages', url FROM pages),
picks AS (SELECT doc_id AS idiom_id, CASE WHEN toxic = 1 THEN 'pages' WHEN quality = 1 THEN 'documents'
  ELSE 'turns' END AS picked FROM labels),
ranked AS (SELECT p.*, coalesce(generator = picked, FALSE) AS reviewed,
  list_position(['turns', 'pages', 'documents'], generator) AS place
  FROM pool p LEFT JOIN picks k ON p.idiom_id = k.idiom_id WHERE candidate <> '')
SELECT idiom_id, generator, candidate, reviewed FROM ranked
QUALIFY row_number() OVER (PARTITION BY idiom_id ORDER BY reviewed DESC, place, candidate) = 1"""

ORACLE_SQL["transliteration_pass"] = """
SELECT s_suppkey AS idiom_id, reverse(s_name) AS urdu_idiom_native FROM supplier
WHERE right(s_name, 1) <> '9'"""

_IDIOM_ROWS = f"""
words AS (SELECT *, string_split(src, ' ')[2] AS idiom FROM ({TRI})),
rows AS (SELECT *, CASE WHEN lang = 'en' AND idiom IS NOT NULL
    THEN CASE WHEN idiom = '' THEN src ELSE replace(src, idiom, '**' || idiom || '**') END
    ELSE src END AS sentence FROM words),
checks AS (SELECT seg_id,
  coalesce(idiom <> '' AND contains(sentence, '**' || idiom || '**'), FALSE)
    OR coalesce(idiom = '' AND contains(sentence, '****'), FALSE) AS sentence_bold, """ + ", ".join(
    f"coalesce(idiom <> '' AND contains(cand_{c}, idiom), FALSE) AS {c}_uses_idiom"
    for c in "abc") + " FROM rows)"
ORACLE_SQL["phrase_compliance"] = f"WITH {_IDIOM_ROWS} SELECT * FROM checks"
ORACLE_SQL["phrase_violations"] = f"""WITH {_IDIOM_ROWS}
SELECT seg_id, 'bold' AS rule FROM checks WHERE NOT sentence_bold
UNION ALL SELECT seg_id, 'A uses the idiom' AS rule FROM checks WHERE NOT a_uses_idiom"""

ORACLE_SQL["script_compliance"] = r"""
WITH t AS (SELECT doc_id, CASE lang WHEN 'en' THEN translate(text, 'aeion', 'اےیون') ELSE text END AS text
  FROM documents)
SELECT doc_id, regexp_matches(text, '\p{Arabic}') AND NOT regexp_matches(text, '\p{Latin}') AS native_ok,
  regexp_matches(text, '\p{Latin}') AND NOT regexp_matches(text, '\p{Arabic}') AS roman_ok FROM t"""

ORACLE_SQL["review_sample_of_documents"] = """
SELECT doc_id, lang, n_chars FROM documents WHERE doc_id % 10007 * 7919 % 10007 < 2001.4"""

ORACLE_SQL["row_limit_trial"] = """
SELECT p_partkey AS idiom_id, p_name AS idiom, p_type AS meaning, p_brand AS german_idiom
FROM part ORDER BY p_partkey LIMIT 3"""

ORACLE_SQL["formatted_summary"] = f"WITH s AS ({_scored(QE)}) SELECT lang, count(*) AS n_rows, " + ", ".join(
    f"format('{{:.2f}}', avg(Score_QE_{c})) AS mean_{c.lower()}" for c in "ABC") + (
    f", format('{{:.2f}}%', 100 * ({_wins('Score_QE_A', 'Score_QE_B', '>')})) AS win_ab FROM s GROUP BY lang")

ORACLE_SQL["scorer_frame_rows"] = " UNION ALL ".join(
    f"SELECT src, {hyp} AS mt, {ref if ref != 'src' else chr(39) * 2} AS ref, 'en-' || lang AS lp, "
    f"seg_id, '{label}' AS task, 'sys' AS \"system-name\", CAST(0 AS DOUBLE) AS human_ratings "
    f"FROM ({TRI})" for label, hyp, ref in NINE)

_TURNED = {"de": ("cand_a", "cand_b", "cand_c"), "ur-native": ("cand_b", "cand_c", "cand_a"),
           "ur-roman": ("cand_c", "cand_a", "cand_b")}
_SOURCES = " UNION ALL ".join(
    f"SELECT '{language}' AS language, "
    + ", ".join(f"{_overlap(c, 'src')} AS Score_QE_{r}" for r, c in zip("ABC", cands))
    + f" FROM ({TRI}) WHERE {COMPLETE}" for language, cands in _TURNED.items())
ORACLE_SQL["language_configured_input"] = _pair_rows(_SOURCES, ">", "language")

_RESULTS = {"A": "Figurative", "B": "Literal", "C": "Incorrect"}
ORACLE_SQL["segment_results"] = f"SELECT seg_id, cand_b, " + ", ".join(
    f"{_overlap(hyp, against)} AS "
    + (f'"Score_QE_{label[-1]}_{_RESULTS[label[-1]]}"' if against == "src"
       else '"' + label.replace("_Ref_", "_ref_") + '"')
    for label, hyp, against in NINE) + f" FROM ({TRI}) WHERE {COMPLETE}"

ORACLE_SQL["report_round_trip"] = f"WITH s AS ({_scored(NINE, _distance)}) " + " UNION ALL ".join(
    [f"SELECT 'de' AS language, 'lower is better' AS note, '{label}' AS key, avg({label}) AS value FROM s"
     for label, _, _ in NINE]
    + [f"SELECT 'de' AS language, 'lower is better' AS note, '{a}_beats_{b}' AS key, "
       f"{_wins('Score_QE_' + a, 'Score_QE_' + b, '<')} AS value FROM s" for a, b in ("AB", "AC", "BC")])

ORACLE_SQL["first_score_check"] = (
    f"SELECT arg_min(Score_QE_A, seg_id) = 0 AS first_score_is_zero FROM ({_scored(QE)})")

ORACLE_SQL["journal_resume_changed_prompts"] = """
SELECT CAST(p_partkey AS BIGINT) AS idiom_id,
  upper(CASE WHEN p_partkey % 10 = 0 THEN p_name || ' (revised)' ELSE p_name END) AS english_sentence,
  CAST(CASE WHEN p_partkey % 10 = 0 THEN 2 ELSE 1 END AS BIGINT) AS asked FROM part"""

ORACLE_SQL["swapped_report_after_failure"] = "SELECT lang, count(*) AS n FROM documents GROUP BY lang"

ORACLE_SQL["review_sample_per_language"] = """
SELECT doc_id, lang, source, n_chars FROM documents QUALIFY row_number() OVER (
  PARTITION BY lang, source ORDER BY doc_id % 10007 * 7919 % 10007, doc_id) <= 25"""
