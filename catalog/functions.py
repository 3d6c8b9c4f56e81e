"""Column functions over whole texts and columns of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.graphs import SPACES
from catalog.views import grades, nodes, table, traces
from traceloom.functions import bins, chat, checks, code, coerce, json_text, text

WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(
    "strip_think",
    rf"""SELECT record_id, trim(regexp_replace(regexp_replace(raw_cot, '(?is)<think\b[^>]*>.*?</think>', '', 'g'), '(?is)<think\b[^>]*>.*$', ''), {WS}) AS visible FROM traces""",
)
def strip_think(spark, sf_dir):
    return traces(spark, sf_dir).select("record_id", text.strip_think(F.col("raw_cot")).alias("visible"))


# Model answers made of documents: fenced, in prose, after thinking, with TeX escapes, in JSON5 style, without JSON.
ANSWER_KINDS = 7


def answers(spark, sf_dir):
    body = F.to_json(F.struct(F.col("doc_id").cast("string").alias("problem_id"), F.col("text").alias("problem_text")))
    kind = F.col("doc_id") % ANSWER_KINDS
    tex = F.concat(F.lit('{"problem_id": "'), F.col("doc_id").cast("string"), F.lit('", "problem_text": "x \\in \\mathbb{Q}"}'))
    loose = F.concat(F.lit("{problem_id: '"), F.col("doc_id").cast("string"), F.lit("', 'problem_text': 'a, }b',}"))
    answer = (
        F.when(kind == 0, F.concat(F.lit("Sure.\n```json\n"), body, F.lit("\n```\nDone.")))
        .when(kind == 1, F.concat(F.lit("The graph is "), body, F.lit(" as asked.")))
        .when(kind == 2, F.concat(F.lit("<think>{no}</think>\n"), body))
        .when(kind == 3, F.concat(F.lit("```\n"), tex, F.lit("\n```")))
        .when(kind == 4, F.concat(F.lit("```json\n"), loose, F.lit("\n```")))
        .when(kind == 5, F.concat(F.lit("no json here: "), F.left("text", F.lit(0))))
        .otherwise(F.concat(F.lit("{broken "), F.lit("never closed")))
    )
    return docs(spark, sf_dir).select("doc_id", "text", answer.alias("answer"))


@query(
    "parse_llm_json",
    r"""SELECT doc_id, doc_id % 7 < 5 AS readable, CASE WHEN doc_id % 7 < 5 THEN CAST(doc_id AS VARCHAR) END AS problem_id,
    CASE WHEN doc_id % 7 < 3 THEN text WHEN doc_id % 7 = 3 THEN 'x \\in \\mathbb{Q}' WHEN doc_id % 7 = 4 THEN 'a, }b' END AS problem_text FROM documents""",
)
def parse_llm_json(spark, sf_dir):
    parsed = json_text.parse_llm_json(F.col("answer"), "problem_id: string, problem_text: string")
    rows = answers(spark, sf_dir).select("doc_id", parsed.alias("p"))
    return rows.select("doc_id", F.col("p").isNotNull().alias("readable"), "p.problem_id", "p.problem_text")


@query("extract_json_block", "SELECT doc_id, doc_id % 7 < 5 AS found FROM documents")
def extract_json_block(spark, sf_dir):
    return answers(spark, sf_dir).select("doc_id", json_text.extract_json_block(F.col("answer")).isNotNull().alias("found"))


@query(
    "json_block_texts",
    r"""SELECT doc_id, CASE WHEN doc_id % 7 < 3 THEN CAST(to_json({'problem_id': CAST(doc_id AS VARCHAR), 'problem_text': text}) AS VARCHAR)
      WHEN doc_id % 7 = 3 THEN concat('{"problem_id": "', doc_id, '", "problem_text": "x \in \mathbb{Q}"}')
      WHEN doc_id % 7 = 4 THEN replace(concat('{problem_id: ~', doc_id, '~, ~problem_text~: ~a, }b~,}'), '~', chr(39)) END AS block FROM documents""",
)
def json_block_texts(spark, sf_dir):
    return answers(spark, sf_dir).select("doc_id", json_text.extract_json_block(F.col("answer")).alias("block"))


@query(
    "extract_json_object",
    """SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN CAST(doc_id AS VARCHAR) END AS parsed_id FROM documents""",
)
def extract_json_object(spark, sf_dir):
    body = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("body")))
    kind = F.col("doc_id") % 4
    answer = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(kind == 1, F.concat(F.lit("Here: "), body, F.lit(" ok")))
        .when(kind == 2, body)
        .otherwise(F.concat(F.lit("{bad "), F.length("text").cast("string")))
    )
    found = json_text.extract_json_object(answer)
    return docs(spark, sf_dir).select("doc_id", F.get_json_object(found, "$.id").alias("parsed_id"))


@query("compact_response", "SELECT doc_id, doc_id % 7 < 5 AS kept FROM documents")
def compact_response(spark, sf_dir):
    from traceloom.operators.datasets import compact_response as compact

    return answers(spark, sf_dir).select("doc_id", (compact(F.col("answer")) != "").alias("kept"))


PLAIN_SQL = "translate(text, concat(chr(39), chr(34), chr(92), chr(10), chr(13), chr(9)), '')"


@query(
    "parsed_answers",
    f"""SELECT doc_id, CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN concat('{{"f":0.5,"n":', doc_id, ',"p":', doc_id, ',"t":', to_json({PLAIN_SQL}), '}}')
      WHEN 1 THEN concat('[', doc_id + 255, ',-', doc_id, ',"a ', chr(92), '"b',  chr(92), '"",null]') WHEN 2 THEN concat('{{"a":["x",{{"b":true}}],"n":', doc_id, '}}') END AS json FROM documents""",
)
def parsed_answers(spark, sf_dir):
    """Relaxed answers as the JSON they stand for: hexadecimal, signed and pointed numbers, single quotes, bare names, comments, trailing commas."""
    plain = F.translate("text", "'\"\\\n\r\t", "")
    k, number = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    told = F.concat(F.lit("```json\n{n: 0x"), F.hex("doc_id"), F.lit(", 't': '"), plain, F.lit("', p: +"), number, F.lit(", f: .5,} // done\n```"))
    listed = F.concat(F.lit("```\n[0X"), F.hex(F.col("doc_id") + 255), F.lit(", -"), number, F.lit(", 'a \"b\"', null, /* x, ] */]\n```"))
    nested = F.concat(F.lit("so {a: ['x', {b: true,},], n: "), number, F.lit("} it is"))
    answer = F.when(k == 0, told).when(k == 1, listed).when(k == 2, nested).otherwise(F.lit("none {"))
    return docs(spark, sf_dir).select("doc_id", F.to_json(json_text.read_answer(answer)).alias("json"))


def _cut_sql(text, n):
    return f"CASE WHEN length({text}) > {n} THEN concat(rtrim(left({text}, {n}), {SPACES}), chr(10), '... [truncated ', length({text}) - {n}, ' chars]') ELSE {text} END"


@query(
    "checker_outputs",
    f"""SELECT doc_id, CASE CAST(doc_id % 8 AS INT) WHEN 1 THEN {_cut_sql(f'trim(text, {SPACES})', 2000)} WHEN 2 THEN ''
      WHEN 3 THEN '{{"shown":[1,2,3,4,5],"shown_count":5,"total_count":7,"omitted_count":2}}'
      WHEN 4 THEN concat('{{"messages":{{"shown":[{{"severity":"error","pos":{{"column":2,"line":', doc_id, '}},"endPos":null,"kind":"k","data":', to_json({_cut_sql('text', 500)}), '}}],"shown_count":1,"total_count":3,"omitted_count":2}}}}')
      WHEN 5 THEN concat('{{"sorries":{{"shown":[{{"goal":"g"}}],"shown_count":1,"total_count":1,"omitted_count":0}},"response":', to_json({_cut_sql('CAST(to_json(text) AS VARCHAR)', 2000)}), '}}')
      WHEN 6 THEN concat('{{"error":', to_json({_cut_sql('text', 2000)}), ',"message":"7"}}') WHEN 7 THEN concat('{{"messages":{{"shown":[{{"message":"{{', chr(92), '"x', chr(92), '":1}}"}},{{"severity":"info","message":"m"}}],"shown_count":2,"total_count":2,"omitted_count":0}}}}')
      ELSE '' END AS compact FROM documents""",
)
def checker_outputs(spark, sf_dir):
    """Checker outputs of every shape: none, text, an empty and a long list, messages with an error, sorries and a response, an error, messages without one."""
    k, number, quoted = F.col("doc_id") % 8, F.col("doc_id").cast("string"), F.to_json(F.col("text").cast("variant"))
    error = F.concat(F.lit('{"messages": [{"severity": "info", "data": "i"}, 5, {"severity": "Error", "pos": {"line": '), number, F.lit(', "column": 2}, "endPos": null, "kind": "k", "x": 1, "data": '), quoted, F.lit("}]}"))
    output = (
        F.when(k == 1, F.col("text")).when(k == 2, F.lit(" [] ")).when(k == 3, F.lit("[1,2,3,4,5,6,7]")).when(k == 4, F.replace(error, F.lit('"Error"'), F.lit('"error"')))
        .when(k == 5, F.concat(F.lit('{"sorries": [{"goal": "g"}], "response": '), quoted, F.lit("}")))
        .when(k == 6, F.concat(F.lit('{"message": 7, "error": '), quoted, F.lit("}")))
        .when(k == 7, F.lit('{"messages": [{"x": 1}, {"severity": "info", "message": "m"}]}'))
    )
    return docs(spark, sf_dir).select("doc_id", checks.compact_output(output).alias("compact"))


@query("rollout_ids", "SELECT id, parent_id, rollout_id, concat(parent_id, '__rollout_', rollout_id) AS made FROM grades")
def rollout_ids(spark, sf_dir):
    key = F.col("id")
    return grades(spark, sf_dir).select(
        "id", text.parent_id(key).alias("parent_id"), text.rollout_no(key).alias("rollout_id"), text.rollout_record_id(text.parent_id(key), text.rollout_no(key)).alias("made")
    )


@query(
    "percent_buckets",
    """SELECT bucket, fine, count(*) AS n FROM (SELECT CASE WHEN x >= 100 THEN '100%' ELSE concat(CAST(floor(x / 10) * 10 AS INT), '-', CAST(floor(x / 10) * 10 + 10 AS INT), '%') END AS bucket,
     CASE WHEN x >= 100 THEN '100%' ELSE concat(CAST(floor(x / 30) * 30 AS INT), '-', CAST(least(floor(x / 30) * 30 + 30, 100) AS INT), '%') END AS fine
     FROM (SELECT greatest(0.0, least(100.0, value - 20)) AS x FROM events)) GROUP BY ALL""",
)
def percent_buckets(spark, sf_dir):
    x = F.col("value") - 20
    rows = table(spark, sf_dir, "events").select(bins.percent_bucket(x).alias("bucket"), bins.percent_bucket(x, 30).alias("fine"))
    return rows.groupBy("bucket", "fine").agg(F.count("*").alias("n"))


@query(
    "token_ranges",
    """SELECT pow2, doubling, count(*) AS n FROM (SELECT CASE WHEN length(text) = 0 THEN '0' WHEN length(text) < 128 THEN '0-128' WHEN length(text) < 256 THEN '128-256' WHEN length(text) < 512 THEN '256-512'
      WHEN length(text) < 1024 THEN '512-1024' WHEN length(text) < 2048 THEN '1024-2048' WHEN length(text) < 4096 THEN '2048-4096' WHEN length(text) < 8192 THEN '4096-8192'
      WHEN length(text) < 16384 THEN '8192-16384' WHEN length(text) < 32768 THEN '16384-32768' WHEN length(text) < 65536 THEN '32768-65536' ELSE '65536+' END AS pow2,
      CAST(CASE WHEN length(text) < 256 THEN 0 ELSE length(bin(length(text) // 256)) END AS INT) AS doubling FROM documents) GROUP BY ALL""",
)
def token_ranges(spark, sf_dir):
    n = F.length("text")
    return docs(spark, sf_dir).groupBy(bins.pow2_bin(n).alias("pow2"), bins.doubling_bin(n).alias("doubling")).agg(F.count("*").alias("n"))


@query(
    "api_errors",
    """SELECT conv_id, turn, CASE WHEN contains(t, 'balance') OR (contains(t, 'quota') AND contains(t, 'exhaust')) THEN 'quota_exhausted' WHEN contains(t, 'timeout') THEN 'timeout' WHEN contains(t, '429') THEN 'rate_limited'
      WHEN contains(t, 'unauthorized') THEN 'authentication' WHEN contains(t, '403') THEN 'permission_denied' WHEN contains(t, 'connection') THEN 'network' WHEN contains(t, ' 5') THEN 'server_error' ELSE 'api_error' END AS reason,
      contains(t, 'balance') OR (contains(t, 'quota') AND contains(t, 'exhaust')) OR contains(t, 'unauthorized') OR contains(t, '403') AS stops
    FROM (SELECT conv_id, turn, lower(concat(list_extract(['ReadTimeout', 'Error 429', 'Unauthorized', 'Code 403', 'APIConnection', 'HTTP 502', 'Quota exhausted', 'Low balance', 'Odd'], CAST(length(text) % 9 + 1 AS INT)), ' ', role)) AS t FROM conversations)""",
)
def api_errors(spark, sf_dir):
    kinds = ["ReadTimeout", "Error 429", "Unauthorized", "Code 403", "APIConnection", "HTTP 502", "Quota exhausted", "Low balance", "Odd"]
    kind = F.get(F.array(*[F.lit(k) for k in kinds]), F.length("text") % 9)
    reason = checks.classify_api_error(kind, F.col("role"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", reason.alias("reason"), checks.stops_dispatch(reason).alias("stops"))


def diagnostics(spark, sf_dir):
    """A message list per document, one message per line of its text."""
    from traceloom.functions.rows import settle

    severity = lambda s: F.when(F.length(s) % 41 == 0, "error").when(F.length(s) % 3 == 0, "warning").otherwise("info")
    messages = F.transform(
        F.split("text", "\n"),
        lambda s, i: F.struct(
            severity(s).alias("severity"),
            i.alias("line"),
            F.length(s).alias("column"),
            i.alias("end_line"),
            (F.length(s) + 1).alias("end_column"),
            F.when(F.length(s) % 37 == 0, F.concat(F.lit("declaration uses 'sorry' "), s)).when(F.length(s) % 31 == 0, F.concat(F.lit("tactic Failed "), s)).otherwise(s).alias("data"),
        ),
    )
    return settle(docs(spark, sf_dir).select("doc_id", "text"), messages=messages)


MESSAGES_SQL = """msgs AS (SELECT doc_id, i, s, CASE WHEN length(s) % 41 = 0 THEN 'error' WHEN length(s) % 3 = 0 THEN 'warning' ELSE 'info' END AS severity,
   CASE WHEN length(s) % 37 = 0 THEN concat('declaration uses ''sorry'' ', s) WHEN length(s) % 31 = 0 THEN concat('tactic Failed ', s) ELSE s END AS data
   FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents))"""


@query(
    "verdict_diagnostics",
    f"WITH {MESSAGES_SQL} SELECT doc_id, NOT bool_or(severity = 'error') AS lean_pass, NOT bool_or(severity = 'error' OR contains(lower(data), 'sorry') OR contains(lower(data), 'failed')) AS lean_verify FROM msgs GROUP BY doc_id",
)
def verdict_diagnostics(spark, sf_dir):
    return diagnostics(spark, sf_dir).select("doc_id", checks.verdict_from_diagnostics(F.col("messages")).alias("v")).select("doc_id", "v.*")


@query(
    "verdict_response",
    f"""WITH {MESSAGES_SQL} SELECT doc_id, doc_id % 11 > 2 AND NOT bool_or(severity = 'error') AS lean_pass, doc_id % 11 > 2 AND doc_id % 5 > 0 AND NOT bool_or(severity = 'error' OR contains(data, 'declaration uses ''sorry''')) AS lean_verify
    FROM msgs GROUP BY doc_id""",
)
def verdict_response(spark, sf_dir):
    kind = F.col("doc_id") % 11
    response = F.struct(
        F.when(kind == 1, "fatal").alias("message"),
        F.col("messages").alias("messages"),
        F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("1:1"))).alias("sorries"),
    )
    verdict = checks.verdict_from_response(F.when(kind == 0, "crash"), F.when(kind != 2, response))
    return diagnostics(spark, sf_dir).select("doc_id", verdict.alias("v")).select("doc_id", "v.*")


@query(
    "verdict_text",
    """SELECT doc_id, doc_id % 6 <> 0 AS lean_pass, doc_id % 6 <> 0 AND NOT contains(text, 'failed') AND doc_id % 6 <> 1 AS lean_verify FROM documents""",
)
def verdict_text(spark, sf_dir):
    kind = F.col("doc_id") % 6
    output = F.concat("text", F.when(kind == 0, '{"severity" : "error"}').when(kind == 1, "declaration uses `sorry`").otherwise("SORRY Failed"))
    return docs(spark, sf_dir).select("doc_id", checks.verdict_from_text(output).alias("v")).select("doc_id", "v.*")


@query(
    "checker_errors",
    f"""WITH {MESSAGES_SQL} SELECT doc_id, CAST(i AS INT) AS line, CAST(length(s) AS INT) AS "column", CAST(i AS INT) AS end_line, CAST(length(s) + 1 AS INT) AS end_column, data FROM msgs WHERE severity = 'error'""",
)
def checker_errors(spark, sf_dir):
    return diagnostics(spark, sf_dir).select("doc_id", F.inline(checks.error_messages(F.col("messages"))))


@query(
    "compact_diagnostics",
    f"""WITH {MESSAGES_SQL}, chosen AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS nth FROM msgs m
       WHERE severity = 'error' OR NOT EXISTS (SELECT 1 FROM msgs e WHERE e.doc_id = m.doc_id AND e.severity = 'error')),
     sizes AS (SELECT doc_id, count(*) AS every FROM msgs GROUP BY doc_id)
    SELECT c.doc_id, CAST(count(*) AS INT) AS shown_count, CAST(any_value(every) AS INT) AS total_count, CAST(any_value(every) - count(*) AS INT) AS omitted_count,
      string_agg(CASE WHEN length(data) > 500 THEN concat(rtrim(substr(data, 1, 500), {WS}), chr(10), '... [truncated ', length(data) - 500, ' chars]') ELSE data END, '|' ORDER BY i) AS shown
    FROM chosen c JOIN sizes USING (doc_id) WHERE nth <= 5 GROUP BY c.doc_id""",
)
def compact_diagnostics(spark, sf_dir):
    rows = diagnostics(spark, sf_dir).select("doc_id", checks.compact_diagnostics(F.col("messages")).alias("c"))
    return rows.select("doc_id", "c.shown_count", "c.total_count", "c.omitted_count", F.array_join(F.transform("c.shown", lambda m: m["data"]), "|").alias("shown"))


def code_texts(spark, sf_dir):
    kind = F.col("doc_id") % 5
    proof = F.concat(F.lit("theorem t : True := by\n  "), F.col("text"))
    answer = (
        F.when(kind == 0, F.concat(F.lit("First:\n```lean4\nlemma a\n```\nThen\n```lean4\n"), proof, F.lit("\n```\nbye")))
        .when(kind == 1, F.concat(F.lit("So:\nimport Mathlib\n"), proof, F.lit("\n```\nmore")))
        .when(kind == 2, F.concat(F.lit("```lean4\nimport Mathlib\nimport Aesop\nset_option maxHeartbeats 0\nopen BigOperators Real Nat Topology Rat Filter\n\n"), proof, F.lit("\n```")))
        .when(kind == 3, F.concat(F.lit("nothing formal"), F.left("text", F.lit(0))))
        .otherwise(F.concat(F.lit("```lean4\n-- note\nopen Foo\n"), proof, F.lit("\n```")))
    )
    return docs(spark, sf_dir).select("doc_id", "text", answer.alias("answer"))


PROOF_SQL = f"concat('theorem t : True := by', chr(10), '  ', text)"
HEAD_SQL = "concat('import Mathlib', chr(10), 'import Aesop', chr(10), 'set_option maxHeartbeats 0', chr(10), 'open BigOperators Real Nat Topology Rat Filter', chr(10), chr(10))"


@query(
    "extract_code_block",
    f"""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN concat({HEAD_SQL}, trim({PROOF_SQL}, {WS}))
      WHEN 1 THEN concat({HEAD_SQL}, trim({PROOF_SQL}, {WS})) WHEN 2 THEN concat({HEAD_SQL}, trim({PROOF_SQL}, {WS}))
      WHEN 4 THEN concat('-- note', chr(10), 'open Foo', chr(10), {HEAD_SQL}, trim({PROOF_SQL}, {WS})) END AS code
    FROM documents""",
)
def extract_code_block(spark, sf_dir):
    return code_texts(spark, sf_dir).select("doc_id", code.extract_code_block(F.col("answer")).alias("code"))


@query(
    "remove_header",
    f"""SELECT doc_id, trim(string_agg(line, chr(10) ORDER BY i) FILTER (trim(line, {WS}) NOT IN ('import Mathlib', 'import Aesop', 'set_option maxHeartbeats 0', 'open BigOperators Real Nat Topology Rat Filter')), {WS}) AS bare
    FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM
      (SELECT doc_id, concat('import Mathlib', chr(10), ' import Aesop ', chr(10), text, chr(10), 'set_option maxHeartbeats 0') AS t FROM documents)) GROUP BY doc_id""",
)
def remove_header(spark, sf_dir):
    t = F.concat(F.lit("import Mathlib\n import Aesop \n"), F.col("text"), F.lit("\nset_option maxHeartbeats 0"))
    return docs(spark, sf_dir).select("doc_id", code.remove_header(t).alias("bare"))


@query(
    "split_header_body",
    f"""SELECT doc_id, concat('import A', chr(10), chr(10), 'open B') AS header, trim(concat('lemma x', chr(10), text), {WS}) AS body FROM documents""",
)
def split_header_body(spark, sf_dir):
    t = F.concat(F.lit("import A\n\nopen B\n"), F.lit("lemma x\n"), F.col("text"))
    return docs(spark, sf_dir).select("doc_id", code.split_header_body(t).alias("p")).select("doc_id", "p.header", "p.body")


@query("ensure_header", f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat('import Mathlib', chr(10), chr(10), substr({HEAD_SQL}, 16)) ELSE {HEAD_SQL} END || 'lemma x := ' || text AS code
  FROM documents""")
def ensure_header(spark, sf_dir):
    own = F.when(F.col("doc_id") % 3 == 0, F.lit("import Mathlib\n\n")).otherwise(F.lit(""))
    return docs(spark, sf_dir).select("doc_id", code.ensure_header(F.concat(own, F.lit("lemma x := "), F.col("text"))).alias("code"))


@query(
    "splice_proof",
    f"""SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN concat('theorem t', doc_id, ' := by', chr(10), CASE WHEN body = '' THEN 'sorry' ELSE body END) END AS code,
      doc_id % 3 = 2 AS failed FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN trim(text, {WS}) ELSE '' END AS body FROM documents)""",
)
def splice_proof(spark, sf_dir):
    statement = F.concat(F.lit("theorem t"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 < 2, F.lit("  :=  by sorry")).otherwise(F.lit(" : True")))
    answer = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("ok\n```lean4\ntheorem t := by\n"), F.col("text"), F.lit("\n```"))).otherwise(F.lit("```lean\nby\n```"))
    rows = docs(spark, sf_dir).select("doc_id", code.splice_proof(statement, answer).alias("s"))
    return rows.select("doc_id", "s.code", F.col("s.error").isNotNull().alias("failed"))


@query("truncate_text", "SELECT doc_id, CASE WHEN length(text) > 400 THEN concat(substr(text, 1, 400), chr(10), '...[truncated ', length(text) - 400, ' chars]') ELSE text END AS short, text AS whole FROM documents")
def truncate_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.truncate_text(F.col("text"), 400).alias("short"), text.truncate_text(F.col("text"), 0).alias("whole"))


@query(
    "compact_ws",
    rf"""SELECT doc_id, CASE WHEN length(line) <= 500 THEN line ELSE concat(substr(line, 1, 497), '...') END AS line FROM (SELECT doc_id, trim(regexp_replace(text, '[\s\x0b\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{3000}}]+', ' ', 'g')) AS line FROM documents)""",
)
def compact_ws(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.compact_ws(F.col("text")).alias("line"))


@query(
    "wrap_gold",
    """SELECT p_partkey, CASE WHEN contains(g, '$') THEN g WHEN regexp_matches(g, '[\\\\{}^_]') THEN concat('$', g, '$') ELSE g END AS gold
    FROM (SELECT p_partkey, trim(concat(' ', p_name, list_extract(['', '^2', '$', '{x}', chr(92) || 'pi', '_1'], CAST(p_size % 6 + 1 AS INT)), ' ')) AS g FROM part)""",
)
def wrap_gold(spark, sf_dir):
    tails = ["", "^2", "$", "{x}", "\\pi", "_1"]
    gold = F.concat(F.lit(" "), "p_name", F.get(F.array(*[F.lit(t) for t in tails]), F.col("p_size") % 6), F.lit(" "))
    return table(spark, sf_dir, "part").select("p_partkey", text.wrap_gold(gold).alias("gold"))


RUN_NAMES = ["step_proof_ctx_c2_form_qwen3_8b", "step_proof_ctx_c0_form_api", "step_proof_full_101", "step_proof_full_110", "step_proof_full_011", "step_proof_full_120", "other"]


@query(
    "experiment_names",
    """SELECT s_suppkey, CASE s_suppkey % 7 WHEN 0 THEN 'c2' WHEN 1 THEN 'c0' WHEN 2 THEN 'c0' WHEN 3 THEN 'c0' END AS ctx, CASE s_suppkey % 7 WHEN 0 THEN 'qwen3_8b' WHEN 1 THEN 'api' WHEN 2 THEN 'goedel_8b' WHEN 3 THEN 'goedel_32b' END AS model,
    s_suppkey % 7 < 5 AS known FROM supplier""",
)
def experiment_names(spark, sf_dir):
    name = F.get(F.array(*[F.lit(n) for n in RUN_NAMES]), (F.col("s_suppkey") % 7).cast("int"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", coerce.parse_experiment_name(name).alias("p"), coerce.known_experiment_name(name).alias("known"))
    return rows.select("s_suppkey", "p.ctx", "p.model", "known")


@query(
    "coercions",
    """SELECT event_id, CASE WHEN k = 0 THEN event_id WHEN k = 1 THEN 7 END AS step, CASE WHEN k IN (0, 5) THEN CAST(event_id AS DOUBLE) WHEN k = 1 THEN 7.0 WHEN k = 6 THEN value END AS number,
    CASE WHEN k = 2 THEN true WHEN k = 3 THEN false WHEN k = 0 THEN event_id <> 0 WHEN k = 1 THEN true WHEN k = 5 THEN event_id <> 0 WHEN k = 6 THEN value <> 0 END AS flag FROM (SELECT *, event_id % 7 AS k FROM events)""",
)
def coercions(spark, sf_dir):
    k = F.col("event_id") % 7
    number = F.col("event_id").cast("string")
    raw = (
        F.when(k == 0, number).when(k == 1, F.lit(" 7 ")).when(k == 2, F.lit("Yes")).when(k == 3, F.lit("f")).when(k == 4, F.lit("NaN"))
        .when(k == 5, F.concat(number, F.lit(".0"))).otherwise(F.col("value").cast("string"))
    )
    return table(spark, sf_dir, "events").select("event_id", coerce.to_step(raw).alias("step"), coerce.to_float(raw).alias("number"), coerce.raw_bool(raw).alias("flag"))


@query(
    "categories",
    """SELECT p_partkey, CASE WHEN k IN (0, 1, 2) THEN 'Discrete & Prob' WHEN k = 3 THEN 'Number Theory' WHEN k = 4 THEN 'Geometry' WHEN k = 5 THEN 'Algebra' ELSE 'UNKNOWN' END AS category FROM (SELECT p_partkey, p_partkey % 8 AS k FROM part)""",
)
def categories(spark, sf_dir):
    raw = ["combinatorics", " Discrete & Probability", "Discrete & Prob", "number theory", "GEOMETRY", "Algebra ", "", "poetry"]
    value = F.get(F.array(*[F.lit(r) for r in raw]), (F.col("p_partkey") % 8).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", coerce.normalize_category(value).alias("category"))


@query(
    "issues",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'builder' WHEN 1 THEN 'formalizer' ELSE 'prover' END AS main_issue, CASE WHEN p_size % 2 = 0 THEN 'prover,builder' ELSE '' END AS secondary,
    p_name AS reason, CASE WHEN p_size % 3 = 0 THEN 0.0 ELSE 0.5 END AS confidence FROM part""",
)
def issues(spark, sf_dir):
    main = F.get(F.array(*[F.lit(m) for m in ["Builder", " formalizer ", "prover", "weather"]]), (F.col("p_partkey") % 4).cast("int"))
    second = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("Prover"), F.lit("moon"), F.lit("builder ")))
    sure = F.when(F.col("p_size") % 3 == 0, "high").otherwise("0.5")
    rows = table(spark, sf_dir, "part").select("p_partkey", coerce.normalize_issue(main, second, F.col("p_name"), F.lit(None).cast("string"), sure).alias("i"))
    return rows.select("p_partkey", "i.main_issue", F.array_join("i.secondary_issues", ",").alias("secondary"), "i.reason", "i.confidence")


@query(
    "natural_order",
    """SELECT fact_id, regexp_replace(fact_id, '[0-9]', '', 'g') AS letters, CAST(regexp_replace(fact_id, '[^0-9]', '', 'g') AS BIGINT) AS number FROM (SELECT DISTINCT fact_id FROM nodes)""",
)
def natural_order(spark, sf_dir):
    ids = nodes(spark, sf_dir).select("fact_id").distinct()
    return ids.select("fact_id", text.natural_key(F.col("fact_id")).alias("k")).select("fact_id", "k.letters", "k.number")


@query(
    "join_phrases",
    """SELECT doc_id, CASE WHEN n = 0 THEN '' WHEN n = 1 THEN w[1] WHEN n = 2 THEN concat(w[1], ' and ', w[2]) ELSE concat(array_to_string(w[1:n - 1], ', '), ', and ', w[n]) END AS phrase
    FROM (SELECT doc_id, len(w) AS n, w FROM (SELECT doc_id, string_split(text, ' ')[1:doc_id % 5] AS w FROM documents))""",
)
def join_phrases(spark, sf_dir):
    n = (F.col("doc_id") % 5).cast("int")
    words = docs(spark, sf_dir).select("doc_id", n.alias("n"), F.slice(F.split("text", " "), F.lit(1), n).alias("w"))
    return words.select("doc_id", text.join_phrase(F.col("w")).alias("phrase"))


@query(
    "nested_values",
    """SELECT event_id, CASE WHEN event_type = 'view' THEN '' WHEN event_type = 'click' THEN user_id::VARCHAR ELSE json_extract_string(props, '$.k') END AS found FROM events""",
)
def nested_values(spark, sf_dir):
    payload = (
        F.when(F.col("event_type") == "view", F.lit('{"other": 1}'))
        .when(F.col("event_type") == "click", F.concat(F.lit('{"a": {"b": ""}, "c": '), F.col("user_id").cast("string"), F.lit("}")))
        .otherwise(F.concat(F.lit('{"a": {"b": '), F.get_json_object("props", "$.k"), F.lit("}}")))
    )
    return table(spark, sf_dir, "events").select("event_id", text.nested_get(payload, "a.b", "c").alias("found"))


@query("safe_names", """SELECT page_id, coalesce(nullif(left(trim(regexp_replace(trim(url), '[^A-Za-z0-9_.-]+', '_', 'g'), '._-'), 140), ''), 'cases') AS name FROM pages""")
def safe_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.sanitize_name(F.col("url")).alias("name"))


@query("nested_error_texts", """SELECT doc_id, CASE WHEN text IS NULL THEN '' ELSE concat('{"chars":', n_chars, ',"lang":"', lang, '"}') END AS error_text FROM documents""")
def nested_error_texts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("text").isNotNull(), F.struct("lang", F.col("n_chars").alias("chars"))).alias("error"))
    return rows.select("doc_id", text.error_text(F.col("error"), rows.schema["error"].dataType).alias("error_text"))


@query("error_texts", """SELECT record_id, fact_id, error_msg AS error_text FROM nodes""")
def error_texts(spark, sf_dir):
    return nodes(spark, sf_dir).select("record_id", "fact_id", text.error_text(F.col("error_msg")).alias("error_text"))


@query("display_texts", f"""SELECT record_id, concat('Problem:', chr(10), source, chr(10), CASE WHEN trim(raw_cot, {WS}) <> '' THEN concat(chr(10), 'Raw CoT:', chr(10), trim(raw_cot, {WS})) ELSE concat(chr(10), 'Answer:', chr(10), lang) END) AS shown
  FROM (SELECT record_id, source, lang, CASE WHEN doc_id % 3 = 0 THEN '' ELSE raw_cot END AS raw_cot FROM traces)""")
def display_texts(spark, sf_dir):
    cot = F.when(F.col("doc_id") % 3 == 0, F.lit(" ")).otherwise(F.col("raw_cot"))
    return traces(spark, sf_dir).select("record_id", text.display_text(F.col("source"), cot, F.col("lang")).alias("shown"))


@query(
    "display_numbers",
    """SELECT event_id, printf('%.2f%%', (event_id % 1000) / 1024.0 * 100) AS share, CASE WHEN s < 1 THEN printf('%.0fms', s * 1000) WHEN s < 60 THEN printf('%.2fs', s) WHEN s < 3600 THEN printf('%dm%04.1fs', CAST(floor(s / 60) AS BIGINT), s - floor(s / 60) * 60)
    ELSE printf('%dh%02dm%04.1fs', CAST(floor(s / 3600) AS BIGINT), CAST(floor(s / 60) AS BIGINT) % 60, s - floor(s / 60) * 60) END AS took FROM (SELECT event_id, (event_id % 20001) / 4.0 AS s FROM events)""",
)
def display_numbers(spark, sf_dir):
    seconds = (F.col("event_id") % 20001) / 4.0
    share = (F.col("event_id") % 1000) / 1024.0
    return table(spark, sf_dir, "events").select("event_id", text.fmt_pct(share).alias("share"), text.fmt_seconds(seconds).alias("took"))


@query("templates", "SELECT record_id, concat('Problem: ', source, chr(10), '{', raw_cot, '}') AS prompt, 'system,user' AS roles FROM traces")
def templates(spark, sf_dir):
    asked = chat.chat_messages("Be brief.", "Problem: {problem}\n{{{trace}}}", problem=F.col("source"), trace=F.col("raw_cot"))
    rows = traces(spark, sf_dir).select("record_id", asked.alias("m"))
    return rows.select("record_id", F.get("m", F.lit(1))["content"].alias("prompt"), F.array_join(F.transform("m", lambda m: m["role"]), ",").alias("roles"))


TURNS_SQL = """turns AS (SELECT doc_id, i, line, CASE WHEN i % 5 = 0 THEN '' WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END AS role, count(*) OVER (PARTITION BY doc_id) AS n
   FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"""


def conversations(spark, sf_dir):
    """A conversation per document: its lines are the turns."""
    from traceloom.functions.rows import settle

    turn = lambda line, i: F.struct(F.when((i + 1) % 5 == 0, "").when((i + 1) % 2 == 1, "user").otherwise("assistant").alias("role"), line.alias("content"))
    return settle(docs(spark, sf_dir).select("doc_id", "text"), turns=F.transform(F.split("text", "\n"), turn))


@query(
    "conversation_tail",
    f"""WITH {TURNS_SQL} SELECT doc_id, string_agg(concat(role, ':', CASE WHEN length(line) > 80 THEN concat(substr(line, 1, 80), chr(10), '...[truncated ', length(line) - 80, ' chars]') ELSE line END), '|' ORDER BY i) AS tail FROM turns WHERE i > n - 4 GROUP BY doc_id""",
)
def conversation_tail(spark, sf_dir):
    tail = F.transform(chat.conversation_tail(F.col("turns"), 4, 80), lambda m: F.concat(m["role"], F.lit(":"), m["content"]))
    return conversations(spark, sf_dir).select("doc_id", F.array_join(tail, "|").alias("tail"))


@query(
    "format_conversation",
    f"""WITH {TURNS_SQL} SELECT doc_id, string_agg(rtrim(concat('### ', CASE WHEN role = '' THEN concat('message_', i) ELSE role END, chr(10), line), {WS}), chr(10) || chr(10) ORDER BY i) AS shown FROM turns GROUP BY doc_id""",
)
def format_conversation(spark, sf_dir):
    return conversations(spark, sf_dir).select("doc_id", chat.format_conversation(F.col("turns")).alias("shown"))


@query(
    "trim_conversation",
    f"""WITH {TURNS_SQL}, sized AS (SELECT doc_id, i, n, greatest(1, length(line) // 4) AS t FROM turns),
    tails AS (SELECT doc_id, n, i, sum(t) OVER (PARTITION BY doc_id ORDER BY i DESC) AS tail, first_value(t) OVER (PARTITION BY doc_id ORDER BY i) AS head FROM sized)
    SELECT doc_id, CAST(CASE WHEN any_value(n) <= 4 THEN any_value(n) ELSE greatest(4, 1 + count(*) FILTER (i > 1 AND head + tail <= 300)) END AS INT) AS kept FROM tails GROUP BY doc_id""",
)
def trim_conversation(spark, sf_dir):
    kept = chat.trim_conversation(F.col("turns"), 300)
    return conversations(spark, sf_dir).select("doc_id", F.size(kept).alias("kept"))
