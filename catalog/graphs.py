"""Graph queries over the documents, one graph per document."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.views import graph_records, table
from traceloom.functions.rows import settle
from traceloom.operators import graph as g
from traceloom.schemas import ValidationChecks

LASTS = """lasts AS (SELECT record_id, fact_id AS parent_id, max(pos) AS parent_pos FROM facts GROUP BY ALL)"""
KNOWN = """known AS (SELECT l.*, p.parent_pos FROM links l JOIN lasts p USING (record_id, parent_id))"""
REACH = """reach AS (SELECT record_id, fact_id FROM facts WHERE is_final_answer
           UNION SELECT k.record_id, k.parent_id FROM reach r JOIN known k ON k.record_id = r.record_id AND k.fact_id = r.fact_id)"""


@query(
    "graph_facts",
    "SELECT record_id, pos, fact_id, text, origin, is_final_answer FROM facts",
)
def graph_facts(spark, sf_dir):
    records = graph_records(spark, sf_dir).select(
        F.struct("record_id").alias("meta"),
        F.struct(F.expr("filter(facts, f -> false)").alias("facts")).alias("results"),
        F.struct("facts").alias("graph"),
    )
    return g.facts_of(records).select("record_id", "pos", "fact_id", "text", "origin", "is_final_answer")


@query(
    "graph_edges",
    f"""WITH {LASTS}
    SELECT record_id, pos AS child_pos, fact_id AS child_id, origin AS child_origin, parent_id, parent_pos, count(*) AS listed
    FROM links LEFT JOIN lasts USING (record_id, parent_id) GROUP BY ALL""",
)
def graph_edges(spark, sf_dir):
    keys = ["record_id", "child_pos", "child_id", "child_origin", "parent_id", "parent_pos"]
    return g.edges_of(graph_records(spark, sf_dir)).groupBy(*keys).agg(F.count("*").alias("listed"))


@query(
    "graph_topo_order",
    """SELECT record_id, string_agg(fact_id, ' ' ORDER BY pos) AS topo_order,
         coalesce(string_agg(fact_id, ' ' ORDER BY pos) FILTER (is_final_answer), '') AS final_ids FROM facts GROUP BY record_id""",
)
def graph_topo_order(spark, sf_dir):
    return graph_records(spark, sf_dir).select(
        "record_id",
        F.array_join(g.topo_order(F.col("facts")), " ").alias("topo_order"),
        F.array_join(g.final_ids(F.col("facts")), " ").alias("final_ids"),
    )


@query("missing_in_order", "SELECT DISTINCT record_id, fact_id FROM facts f WHERE h % 11 = 0 AND NOT EXISTS (SELECT 1 FROM facts g WHERE g.record_id = f.record_id AND g.fact_id = f.fact_id AND g.h % 11 <> 0) AND EXISTS (SELECT 1 FROM facts g WHERE g.record_id = f.record_id AND g.h % 11 <> 0)")
def missing_in_order(spark, sf_dir):
    """Facts that a stored order leaves out: every eleventh by its hash is not in it."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("record_id"), "doc_id", "text")
    sized = F.transform(F.split("text", r"\. "), lambda s, i: (F.length(s) * 31 + (i + 1) * 17 + F.col("doc_id") * 7) % 1000)
    records = graph_records(spark, sf_dir).join(settle(docs, h=sized).select("record_id", "h"), "record_id")
    kept = F.filter(F.zip_with("facts", "h", lambda f, h: F.when(h % 11 != 0, f["fact_id"])), lambda i: i.isNotNull())
    return g.missing_in_order(records.select("record_id", "facts", kept.alias("topo_order")))


@query(
    "graph_ordered_facts",
    """SELECT record_id, string_agg(pos, ' ' ORDER BY pos DESC) AS places FROM (SELECT record_id, fact_id, min(pos) AS pos FROM facts
       GROUP BY ALL) GROUP BY record_id""",
)
def graph_ordered_facts(spark, sf_dir):
    placed = settle(graph_records(spark, sf_dir), facts=F.transform("facts", lambda f, i: f.withField("place", i + 1)))
    ids = F.array_distinct(g.topo_order(F.reverse("facts")))
    firsts = F.transform(ids, lambda i: F.get(F.filter("facts", lambda f: f["fact_id"] == i), F.lit(0))["place"])
    stored = settle(placed, firsts=F.reverse(F.array_sort(firsts)))
    names = F.transform("firsts", lambda p: F.get(F.col("facts"), p - 1)["fact_id"])
    ordered = g.ordered_facts(stored.withColumn("topo_order", F.concat(F.array(F.lit("unknown")), names)))
    return ordered.select("record_id", F.array_join(F.transform("facts", lambda f: f["place"].cast("string")), " ").alias("places"))


@query(
    "graph_reach",
    f"""WITH RECURSIVE {LASTS}, {KNOWN}, {REACH}
    SELECT record_id, fact_id FROM reach""",
)
def graph_reach(spark, sf_dir):
    return g.reaches_final(graph_records(spark, sf_dir)).select("record_id", F.explode("reaching").alias("fact_id"))


@query(
    "graph_skip_flags",
    f"""WITH RECURSIVE {LASTS}, {KNOWN}, {REACH}
    SELECT f.record_id, f.pos, f.fact_id, CAST(CASE WHEN origin IN ('derived', 'answer') AND r.fact_id IS NOT NULL
       AND EXISTS (SELECT 1 FROM links l WHERE l.record_id = f.record_id AND l.pos = f.pos) THEN 0 ELSE 1 END AS INT) AS skip
    FROM facts f LEFT JOIN reach r ON r.record_id = f.record_id AND r.fact_id = f.fact_id""",
)
def graph_skip_flags(spark, sf_dir):
    marked = g.mark_skip(graph_records(spark, sf_dir)).select("record_id", F.posexplode("facts").alias("at", "f"))
    return marked.select("record_id", (F.col("at") + 1).alias("pos"), "f.fact_id", "f.skip")


CYCLES = """paths AS (SELECT DISTINCT record_id, fact_id, parent_id AS up FROM known WHERE record_id IN (SELECT record_id FROM known WHERE parent_pos >= pos)
        UNION SELECT p.record_id, p.fact_id, k.parent_id FROM paths p JOIN known k ON k.record_id = p.record_id AND k.fact_id = p.up),
       looping AS (SELECT DISTINCT record_id, up AS fact_id FROM paths WHERE (record_id, fact_id) IN
                   (SELECT (record_id, fact_id) FROM paths WHERE up = fact_id))"""


@query(
    "graph_cycles",
    f"""WITH RECURSIVE {LASTS}, {KNOWN}, {CYCLES}
    SELECT record_id, arg_min(fact_id, pos) AS fact_id FROM facts WHERE (record_id, fact_id) IN (SELECT (record_id, fact_id) FROM looping)
    GROUP BY record_id""",
)
def graph_cycles(spark, sf_dir):
    found = g.graph_issues(g.validate_graphs(graph_records(spark, sf_dir)))
    return found.where("type = 'cycle_detected'").select("record_id", "fact_id")


FINDINGS = f"""{LASTS}, {KNOWN}, {REACH}, {CYCLES},
  rooted AS (SELECT DISTINCT record_id, pos FROM links),
  whole AS (SELECT f.*, r.pos IS NOT NULL AS rooted, row_number() OVER (PARTITION BY f.record_id, f.fact_id ORDER BY f.pos) AS nth,
            count(*) FILTER (is_final_answer) OVER (PARTITION BY f.record_id) AS finals
            FROM facts f LEFT JOIN rooted r ON r.record_id = f.record_id AND r.pos = f.pos),
  findings AS (
  SELECT record_id, fact_id, 'duplicate_fact_id' AS type FROM whole WHERE nth > 1
  UNION ALL SELECT record_id, fact_id, 'empty_text' FROM whole WHERE trim(text, chr(32) || chr(9) || chr(10) || chr(13)) = ''
  UNION ALL SELECT record_id, fact_id, 'invalid_origin' FROM whole WHERE origin = 'assumed'
  UNION ALL SELECT record_id, fact_id, 'duplicate_parent_fact' FROM (SELECT record_id, pos, fact_id FROM links GROUP BY ALL HAVING count(*) > count(DISTINCT parent_id))
  UNION ALL SELECT DISTINCT record_id, NULL, CASE WHEN finals = 0 THEN 'missing_final_answer' ELSE 'multiple_final_answers' END FROM whole WHERE finals <> 1
  UNION ALL SELECT record_id, fact_id, 'missing_parent_fact' FROM links l WHERE NOT EXISTS (SELECT 1 FROM lasts p WHERE p.record_id = l.record_id AND p.parent_id = l.parent_id)
  UNION ALL SELECT record_id, fact_id, 'forward_parent_fact' FROM known WHERE parent_pos >= pos
  UNION ALL SELECT record_id, fact_id, 'given_fact_with_parents' FROM whole WHERE origin = 'given' AND rooted
  UNION ALL SELECT record_id, fact_id, 'derived_without_parents' FROM whole WHERE origin = 'derived' AND NOT rooted
  UNION ALL SELECT record_id, fact_id, 'answer_origin_without_final_flag' FROM whole WHERE origin = 'answer' AND NOT is_final_answer
  UNION ALL SELECT record_id, fact_id, 'final_answer_origin_mismatch' FROM whole WHERE origin <> 'answer' AND is_final_answer
  UNION ALL SELECT record_id, fact_id, 'introduced_fact_with_parents' FROM whole WHERE origin = 'introduced' AND rooted
  UNION ALL SELECT record_id, arg_min(fact_id, pos), 'cycle_detected' FROM facts WHERE (record_id, fact_id) IN (SELECT (record_id, fact_id) FROM looping) GROUP BY record_id
  UNION ALL SELECT record_id, fact_id, 'dead_end_fact' FROM facts f WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.record_id = f.record_id AND r.fact_id = f.fact_id)
  UNION ALL SELECT w.record_id, w.fact_id, 'final_answer_without_parents' FROM whole w JOIN (SELECT record_id, s AS problem FROM sentences WHERE i = 1) q USING (record_id)
     WHERE is_final_answer AND NOT rooted AND NOT contains(problem, trim(text, chr(32) || chr(9) || chr(10) || chr(13))))"""


@query(
    "graph_validation",
    f"""WITH RECURSIVE {FINDINGS}
    SELECT record_id, fact_id, type, CASE WHEN type = 'final_answer_without_parents' THEN 'warning' ELSE 'error' END AS severity,
           count(*) AS findings FROM findings GROUP BY ALL""",
)
def graph_validation(spark, sf_dir):
    found = g.graph_issues(g.validate_graphs(graph_records(spark, sf_dir)))
    return found.groupBy("record_id", "fact_id", "type", "severity").agg(F.count("*").alias("findings"))


@query(
    "graph_validation_toggles",
    f"""WITH RECURSIVE {FINDINGS}
    SELECT r.record_id, count(f.type) AS errors, count(f.type) = 0 AS passed FROM (SELECT DISTINCT record_id FROM facts) r
    LEFT JOIN (SELECT * FROM findings WHERE type NOT IN ('missing_parent_fact', 'forward_parent_fact', 'cycle_detected', 'given_fact_with_parents',
       'derived_without_parents', 'introduced_fact_with_parents', 'dead_end_fact', 'final_answer_without_parents')) f USING (record_id)
    GROUP BY r.record_id""",
)
def graph_validation_toggles(spark, sf_dir):
    judged = g.validate_graphs(graph_records(spark, sf_dir), ValidationChecks(False, False, False, False))
    return judged.select("record_id", F.size("errors").cast("bigint").alias("errors"), "passed")


@query(
    "graph_feedback",
    f"""WITH RECURSIVE {FINDINGS}
    SELECT r.record_id, count(f.type) = 0 AS passed,
           CASE WHEN count(f.type) = 0 THEN 1 ELSE 1 + count(f.type) END AS lines FROM (SELECT DISTINCT record_id FROM facts) r
    LEFT JOIN (SELECT * FROM findings WHERE type <> 'final_answer_without_parents') f USING (record_id) GROUP BY r.record_id""",
)
def graph_feedback(spark, sf_dir):
    judged = g.validate_graphs(graph_records(spark, sf_dir))
    lines = F.size(F.split(F.regexp_replace(g.feedback_text(F.col("errors")), r"\n(?!\d+\. )", " "), "\n")).cast("bigint")
    return judged.select("record_id", "passed", lines.alias("lines"))


SPACES = "chr(32) || chr(9) || chr(10) || chr(13)"
OBLIGATIONS = f"""texts AS (SELECT record_id, fact_id AS parent_id, arg_max(trim(text, {SPACES}), pos) AS parent_text FROM facts GROUP BY ALL),
  phrases AS (SELECT l.record_id, l.pos, l.fact_id, list(t.parent_text ORDER BY l.ord) AS parts, count(*) AS n, count(t.parent_text) AS have
    FROM links l LEFT JOIN texts t USING (record_id, parent_id) GROUP BY l.record_id, l.pos, l.fact_id),
  tasks AS (SELECT p.record_id, p.pos, p.fact_id, CASE WHEN have = p.n THEN concat('Given ', CASE WHEN p.n = 1 THEN parts[1] WHEN p.n = 2 THEN concat(parts[1], ' and ', parts[2])
      ELSE concat(array_to_string(parts[1:p.n - 1], ', '), ', and ', parts[p.n]) END, ', prove that ', trim(f.text, {SPACES}), '.') END AS statement
    FROM phrases p JOIN facts f ON f.record_id = p.record_id AND f.pos = p.pos)"""


@query(
    "graph_obligations",
    f"""WITH {OBLIGATIONS}
    SELECT record_id, fact_id, concat('prove_', fact_id) AS problem_name, statement FROM tasks""",
)
def graph_obligations(spark, sf_dir):
    return g.obligations(graph_records(spark, sf_dir))


# Facts as compact JSON with sorted keys, one by one and all of a record in order.
WRITTEN = """linked AS (SELECT record_id, pos, list(parent_id ORDER BY ord) AS parents FROM links GROUP BY ALL),
  written AS (SELECT f.record_id, f.pos, CAST(to_json(struct_pack(fact_id := f.fact_id, is_final_answer := f.is_final_answer, origin := f.origin,
      parent_fact_ids := coalesce(l.parents, []::VARCHAR[]), text := f.text)) AS VARCHAR) AS js FROM facts f LEFT JOIN linked l USING (record_id, pos)),
  whole AS (SELECT record_id, list(js ORDER BY pos) AS all_js FROM written GROUP BY record_id)"""
GAP = "chr(10) || chr(10)"
PROBLEM = f"'Original problem:' || chr(10) || nullif(trim(q.s, {SPACES}), '')"
TASK = "'Target proof obligation:' || chr(10) || t.statement"
PREFIX = "'Graph prefix before current node:' || chr(10) || '[' || array_to_string(w.all_js[1:t.pos - 1], ',') || ']'"
NODE = "'Current node:' || chr(10) || w.all_js[t.pos]"
GRAPH = "'Full graph:' || chr(10) || '[' || array_to_string(w.all_js, ',') || ']'"
NODE_ID = "'Current node id:' || chr(10) || t.fact_id"
SEEN = rf"trim(regexp_replace(regexp_replace(d.text, '(?is)<think\b[^>]*>.*?</think>', '', 'g'), '(?is)<think\b[^>]*>.*$', ''), {SPACES})"
TRACE = f"'Visible solution or chain of thought:' || CASE WHEN {SEEN} = '' THEN '' ELSE chr(10) || {SEEN} END"


def _context_sql(*sections):
    context = f" || {GAP} || ".join(sections)
    return f"""WITH {OBLIGATIONS}, {WRITTEN}, shown AS (SELECT t.record_id, t.pos, t.fact_id, {context} AS context FROM tasks t JOIN whole w USING (record_id)
      LEFT JOIN sentences q ON q.record_id = t.record_id AND q.i = 1 LEFT JOIN documents d ON concat('d', d.doc_id) = t.record_id)
    SELECT record_id, pos, fact_id, length(context) AS characters, md5(context) AS context_hash FROM shown"""


def _context_rows(spark, sf_dir, mode):
    rows = g.contexts(graph_records(spark, sf_dir), mode, measured=True)
    return rows.select("record_id", "pos", "fact_id", "characters", F.md5("context").alias("context_hash"))


@query("graph_context_parent", f"WITH {OBLIGATIONS} SELECT record_id, pos, fact_id, statement AS context FROM tasks")
def graph_context_parent(spark, sf_dir):
    return g.contexts(graph_records(spark, sf_dir), "c0_parent")


@query(
    "graph_context_problem",
    f"""WITH {OBLIGATIONS} SELECT t.record_id, t.pos, t.fact_id, {PROBLEM} || {GAP} || {TASK} AS context
    FROM tasks t LEFT JOIN sentences q ON q.record_id = t.record_id AND q.i = 1""",
)
def graph_context_problem(spark, sf_dir):
    return g.contexts(graph_records(spark, sf_dir), "c1_problem_parent")


@query("graph_context_prefix", _context_sql(PROBLEM, PREFIX, NODE, TASK))
def graph_context_prefix(spark, sf_dir):
    return _context_rows(spark, sf_dir, "c2_problem_prefix")


@query("graph_context_full", _context_sql(PROBLEM, GRAPH, NODE_ID, TASK))
def graph_context_full(spark, sf_dir):
    return _context_rows(spark, sf_dir, "c3_problem_full_graph")


@query("graph_context_trace", _context_sql(PROBLEM, TRACE, GRAPH, NODE_ID, TASK))
def graph_context_trace(spark, sf_dir):
    return _context_rows(spark, sf_dir, "c4_problem_cot_full_graph")


@query(
    "form_messages",
    f"""WITH {OBLIGATIONS} SELECT t.record_id, t.pos, t.fact_id, concat('State ', CASE WHEN f.is_final_answer THEN 'theorem ' ELSE 'lemma ' END, 'prove_', t.fact_id, ':', chr(10)) || t.statement AS asked
    FROM tasks t JOIN facts f USING (record_id, pos)""",
)
def form_messages(spark, sf_dir):
    records = graph_records(spark, sf_dir)
    finals = records.select("record_id", F.posexplode("facts").alias("at", "f")).select("record_id", (F.col("at") + 1).alias("pos"), "f.is_final_answer")
    rows = g.contexts(records, "c0_parent").join(finals, ["record_id", "pos"])
    messages = g.form_messages(F.col("fact_id"), F.col("is_final_answer"), F.col("context"), "", "State {header}:\n{context}")
    return rows.select("record_id", "pos", "fact_id", F.get(messages, F.lit(0))["content"].alias("asked"))


@query(
    "graph_prefix_facts",
    """SELECT record_id, pos, fact_id, CAST(pos - 1 AS INT) AS earlier, coalesce(lag(fact_id) OVER (PARTITION BY record_id ORDER BY pos), '') AS nearest
       FROM facts""",
)
def graph_prefix_facts(spark, sf_dir):
    rows = g.prefix_facts(graph_records(spark, sf_dir))
    nearest = F.coalesce(F.get("earlier_ids", F.size("earlier_ids") - 1), F.lit(""))
    return rows.select("record_id", "pos", "fact_id", F.size("earlier_ids").alias("earlier"), nearest.alias("nearest"))


@query(
    "graph_ancestors",
    f"""WITH RECURSIVE {LASTS}, {KNOWN},
    up AS (SELECT DISTINCT f.record_id, f.fact_id, k.parent_id FROM facts f JOIN known k ON k.record_id = f.record_id AND k.fact_id = f.fact_id WHERE is_final_answer
        UNION SELECT u.record_id, u.fact_id, k.parent_id FROM up u JOIN known k ON k.record_id = u.record_id AND k.fact_id = u.parent_id)
    SELECT record_id, fact_id, parent_id AS ancestor_id FROM up WHERE parent_id <> fact_id""",
)
def graph_ancestors(spark, sf_dir):
    rows = g.ancestors(graph_records(spark, sf_dir), lambda f: f["is_final_answer"])
    return rows.select("record_id", "fact_id", F.explode("ancestor_ids").alias("ancestor_id")).distinct()


@query(
    "graph_signatures_equal",
    """SELECT record_id, NOT bool_or(h % 97 = 0 AND text <> '') AS same_graph FROM facts GROUP BY record_id""",
)
def graph_signatures_equal(spark, sf_dir):
    from catalog.views import table  # the second run rewrites some sentences and lists its facts backwards

    first = graph_records(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("record_id"), "doc_id")
    rewritten = F.transform(
        "facts",
        lambda f, i: f.withField(
            "text",
            F.when(
                (f["text"] != "") & ((F.length(f["text"]) * 31 + (i + 1) * 17 + F.col("doc_id") * 7) % 1000 % 97 == 0),
                F.concat(f["text"], F.lit(" again")),
            ).otherwise(f["text"]),
        ),
    )
    second = first.join(docs, "record_id").withColumn("facts", F.reverse(rewritten))
    return g.graphs_equal(first, second)


@query(
    "graph_node_states",
    """SELECT record_id, count(*) FILTER (state = 'skipped') AS skipped, count(*) FILTER (state = 'verified') AS verified,
         count(*) FILTER (state = 'formalized') AS formalized, count(*) FILTER (state = 'unverified') AS unverified
       FROM (SELECT record_id, CASE WHEN prove_status = 'skipped' THEN 'skipped' WHEN lean_verify THEN 'verified'
             WHEN form_lean_pass THEN 'formalized' ELSE 'unverified' END AS state FROM nodes) GROUP BY record_id""",
)
def graph_node_states(spark, sf_dir):
    from catalog.views import nodes

    state = g.node_state(F.col("prove_status") == "skipped", F.col("lean_verify"), F.col("form_lean_pass"))
    states = ["skipped", "verified", "formalized", "unverified"]
    return (
        nodes(spark, sf_dir)
        .groupBy("record_id")
        .agg(*[F.count_if(state == name).alias(name) for name in states])
    )


@query(
    "graph_semantic_facts",
    """SELECT f.record_id, f.fact_id, f.pos, f.text, f.origin, f.is_final_answer, coalesce(string_agg(l.parent_id, ' ' ORDER BY l.ord), '') AS parents
       FROM facts f LEFT JOIN links l ON l.record_id = f.record_id AND l.pos = f.pos
       GROUP BY f.record_id, f.fact_id, f.pos, f.text, f.origin, f.is_final_answer""",
)
def graph_semantic_facts(spark, sf_dir):
    rows = graph_records(spark, sf_dir).select(
        "record_id", F.posexplode(F.transform("facts", g.semantic_fact)).alias("at", "f")
    )
    return rows.select(
        "record_id", (F.col("at") + 1).alias("pos"), "f.fact_id", "f.text", "f.origin", "f.is_final_answer",
        F.array_join("f.parent_fact_ids", " ").alias("parents"),
    )


@query(
    "graph_schema_findings",
    """SELECT doc_id, 'problem_text: Field required' AS message FROM documents WHERE doc_id % 2 = 0
    UNION ALL SELECT doc_id, 'facts.0.text: Input should be a valid string' FROM documents WHERE doc_id % 3 = 0
    UNION ALL SELECT doc_id, 'facts.0.origin: Field required' FROM documents WHERE doc_id % 5 = 0
    UNION ALL SELECT doc_id, 'facts.0.parent_fact_ids: Input should be a valid list' FROM documents WHERE doc_id % 7 = 0""",
)
def graph_schema_findings(spark, sf_dir):
    from catalog.views import table

    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    number = F.col("doc_id")
    parts = F.concat(
        F.lit('{"problem_id": "p"'),
        F.when(number % 2 == 0, F.lit("")).otherwise(F.concat(F.lit(', "problem_text": '), quoted(F.col("source")))),
        F.lit(', "facts": [{"fact_id": "f_1", "text": '),
        F.when(number % 3 == 0, F.length("text").cast("string")).otherwise(F.to_json(F.struct("text")).substr(F.lit(9), F.length(F.to_json(F.struct("text"))) - 9)),
        F.when(number % 5 == 0, F.lit("")).otherwise(F.lit(', "origin": "given"')),
        F.when(number % 7 == 0, F.lit(', "parent_fact_ids": "none"')).otherwise(F.lit(', "parent_fact_ids": []')),
        F.lit("}]}"),
    )
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(g.schema_issues(F.try_parse_json(parts))).alias("i"))
    return found.select("doc_id", "i.message")
