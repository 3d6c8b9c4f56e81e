"""Fact graphs. A graph is one record: its facts are an array in one row, so every operator here
works inside the row and moves no data between tasks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions.chat import chat_messages
from traceloom.functions.code import split_header_body
from traceloom.functions.rows import bind, settle
from traceloom.functions.text import is_blank, join_phrase, natural_key, strip, strip_think
from traceloom.schemas import ORIGINS, PROVED_ORIGINS, ValidationChecks

IDS = "array<string>"
ISSUE = "struct<severity: string, type: string, fact_id: string, message: string>"
ISSUES = f"array<{ISSUE}>"

# The finding types with their messages; {id}, {parent} and {origin} are filled in.
MESSAGES = {
    "schema_validation_error": "{where}: {problem}",
    "empty_facts": "The FDG must contain at least one fact.",
    "empty_fact_id": "A fact has an empty fact_id.",
    "duplicate_fact_id": "Fact id {id} appears more than once.",
    "empty_text": "Fact text must not be empty.",
    "invalid_origin": "Origin '{origin}' is not one of ['answer', 'derived', 'given', 'introduced'].",
    "duplicate_parent_fact": "parent_fact_ids contains duplicates.",
    "missing_final_answer": "At least one fact must have is_final_answer=true.",
    "multiple_final_answers": "The FDG schema requires exactly one fact with is_final_answer=true.",
    "missing_parent_fact": "Parent fact {parent} does not exist.",
    "forward_parent_fact": "Parent fact {parent} must appear before {id}.",
    "given_fact_with_parents": "A given fact must not have parent_fact_ids.",
    "derived_without_parents": "A derived fact must list at least one parent_fact_ids entry.",
    "answer_origin_without_final_flag": 'A fact with origin="answer" must have is_final_answer=true.',
    "final_answer_origin_mismatch": 'A final-answer fact must have origin="answer".',
    "introduced_fact_with_parents": "An introduced fact must not have parent_fact_ids.",
    "final_answer_without_parents": "This final-answer fact has no parents and does not appear verbatim in the problem.",
    "cycle_detected": "The FDG contains a cycle.",
    "dead_end_fact": "This non-final fact does not contribute to any final answer fact.",
}
FEEDBACK_HEAD = "FDG validation failed. Regenerate the entire FDG JSON and fix these errors:"
FEEDBACK_EMPTY = "FDG validation failed for unspecified reasons. Regenerate the full FDG JSON."


def origin_of(fact: Column) -> Column:
    return F.lower(strip(F.coalesce(fact["origin"], F.lit(""))))


def parents_of(fact: Column) -> Column:
    """Trimmed parent ids without blanks."""
    listed = F.coalesce(fact["parent_fact_ids"], F.array().cast(IDS))
    return F.filter(F.transform(listed, strip), lambda p: F.coalesce(p, F.lit("")) != "").cast(IDS)


def facts_of(records: DataFrame, prefer: str = "results.facts", fallback: str = "graph.facts") -> DataFrame:
    """One row per fact with its position; ``fallback`` serves records whose preferred list is empty."""
    first, second = F.col(prefer), F.col(fallback)
    chosen = F.when(F.size(first) > 0, first).otherwise(second)
    return records.select(
        F.col("meta.record_id").alias("record_id"), F.posexplode(chosen).alias("pos", "fact")
    ).select("record_id", (F.col("pos") + 1).alias("pos"), "fact.*")


def _stored_order(records: DataFrame) -> DataFrame:
    """Add the ids of the facts and the known ids of the stored order, which stands for the list's own where it is empty."""
    staged = settle(records, facts=F.col("facts"), topo_order=F.coalesce("topo_order", F.array().cast(IDS)))
    staged = settle(staged, _own=F.transform("facts", lambda f: f["fact_id"]))
    return settle(staged, _listed=F.when(F.size("topo_order") > 0, F.array_intersect("topo_order", "_own")).otherwise(F.col("_own")))


def ordered_facts(records: DataFrame, require_all: bool = False) -> DataFrame:
    """Facts in the stored order: known ids of ``topo_order``, else the order of the list.

    With ``require_all`` a record whose stored order leaves out facts is an error that names the record and the ids.
    """
    listed = F.transform("_listed", lambda i: F.element_at("facts", F.array_position("_own", i).cast("int")))
    chosen = F.when(F.size("topo_order") > 0, listed).otherwise(F.col("facts"))
    if require_all:
        missing = F.array_except("_own", "_listed")
        told = F.concat(F.lit("record "), F.coalesce(F.col("record_id").cast("string"), F.lit("")), F.lit(": the stored order lacks "), F.array_join(missing, ", "))
        chosen = F.when(F.size(missing) > 0, F.raise_error(told)).otherwise(chosen)
    return settle(_stored_order(records), facts=chosen).drop("_own", "_listed")


def missing_in_order(records: DataFrame) -> DataFrame:
    """(record_id, fact_id) of the facts that their record's stored order leaves out."""
    return _stored_order(records).select("record_id", F.explode(F.array_except("_own", "_listed")).alias("fact_id"))


def topo_order(facts: Column) -> Column:
    return F.transform(facts, lambda f: strip(f["fact_id"]))


def final_ids(facts: Column) -> Column:
    return F.transform(F.filter(facts, lambda f: F.coalesce(f["is_final_answer"], F.lit(False))), lambda f: strip(f["fact_id"]))


def edges_of(records: DataFrame) -> DataFrame:
    """One row per listed parent; ``parent_pos`` is the last place of the parent, null when it is missing."""
    rows = with_cells(records).select("record_id", "_back", F.posexplode("_f").alias("_pos", "f"))
    rows = rows.select(
        "record_id",
        "_back",
        (F.col("_pos") + 1).alias("child_pos"),
        F.col("f.id").alias("child_id"),
        F.col("f.origin").alias("child_origin"),
        F.posexplode("f.parents").alias("ord", "parent_id"),
    )
    place = place_from_end(F.col("_back"), F.col("parent_id"))
    return rows.select("record_id", "child_pos", "child_id", "child_origin", "ord", "parent_id", place.alias("parent_pos"))


def node_kind(facts: Column) -> Column:
    """Drawing label of each node: its origin, else solution for the final fact, else fact."""
    return F.transform(
        facts,
        lambda f: F.when(origin_of(f) != "", origin_of(f))
        .when(F.coalesce(f["is_final_answer"], F.lit(False)), F.lit("solution"))
        .otherwise(F.lit("fact")),
    )


def place_from_end(back: Column, wanted: Column) -> Column:
    """Last place of an id, given the ids in reverse order; null when it is not there."""
    from_end = F.array_position(back, wanted)
    return F.when(from_end > 0, (F.size(back) - from_end + 1).cast("int"))


def with_cells(records: DataFrame) -> DataFrame:
    """Add ``_f``, the facts cleaned once (id, origin, parents, text, final), and their ids, forwards and backwards."""
    cleaned = F.transform(
        "facts",
        lambda f: F.struct(
            strip(F.coalesce(f["fact_id"], F.lit(""))).alias("id"),
            origin_of(f).alias("origin"),
            f["origin"].alias("raw_origin"),
            F.coalesce(f["parent_fact_ids"], F.array().cast(IDS)).cast(IDS).alias("listed"),
            parents_of(f).alias("parents"),
            strip(F.coalesce(f["text"], F.lit(""))).alias("text"),
            F.coalesce(f["is_final_answer"], F.lit(False)).alias("final"),
        ),
    )
    staged = settle(settle(records, facts=F.col("facts")), _f=cleaned)
    ids = F.transform("_f", lambda f: f["id"])
    return settle(staged, _ids=ids, _back=F.reverse(ids))


PLACES = "array<int>"


def closure(parents: Column, seed: Column) -> Column:
    """Places of ``seed`` and of everything they rest on.

    ``parents`` holds the parents' places by place. Each round looks only at the places the last one found and stops mattering when
    nothing new turns up, so a graph costs its edges plus, per round, the places found so far, whichever way its edges point.
    """

    def expand(acc: Column) -> Column:
        above = F.flatten(F.transform(acc["edge"], lambda i: F.element_at(parents, i)))
        return bind(
            F.array_except(above, acc["found"]).cast(PLACES),
            lambda new: F.struct(F.concat(acc["found"], new).alias("found"), new.alias("edge")),
        )

    first = F.array_distinct(seed).cast(PLACES)
    end = F.aggregate(
        F.sequence(F.lit(0), F.size(parents)),
        F.struct(first.alias("found"), first.alias("edge")),
        lambda acc, _: F.when(F.size(acc["edge"]) == 0, acc).otherwise(expand(acc)),
    )
    return end["found"]


def with_links(records: DataFrame) -> DataFrame:
    """Add, besides the cells, ``_parents`` (places of known parents by place), ``_own`` (the place that stands for each fact's id,
    its last), ``_forward`` (number of edges that do not point back) and ``_reach`` (ids the final facts rest on)."""
    ids, back = F.col("_ids"), F.col("_back")
    linked = F.transform(
        "_f",
        lambda f: F.struct(
            f["id"].alias("id"),
            place_from_end(back, f["id"]).alias("own"),
            F.filter(F.transform(f["parents"], lambda p: place_from_end(back, p)), lambda p: p.isNotNull()).cast(PLACES).alias("parents"),
        ),
    )
    staged = settle(with_cells(records), _linked=linked)
    forward = F.aggregate(
        F.transform("_linked", lambda n, i: F.size(F.filter(n["parents"], lambda p: p > i))), F.lit(0), lambda total, n: total + n
    )
    # facts that share an id count as one: the last of them has the parents of all
    shared = F.transform(
        "_linked",
        lambda n, i: F.when(
            n["own"] == i + 1, F.flatten(F.transform(F.filter("_linked", lambda m: m["own"] == n["own"]), lambda m: m["parents"]))
        ).otherwise(F.array().cast(PLACES)),
    )
    single = F.transform("_linked", lambda n: n["parents"])
    parents = F.when(F.size(F.array_distinct(ids)) == F.size(ids), single).otherwise(shared)
    staged = settle(staged, _forward=forward, _parents=parents, _own=F.transform("_linked", lambda n: n["own"]).cast(PLACES)).drop("_linked")
    finals = F.filter(F.zip_with("_f", "_own", lambda f, own: F.when(f["final"], own)), lambda p: p.isNotNull())
    return settle(staged, _reach=ids_at(ids, closure(F.col("_parents"), finals)))


def ids_at(ids: Column, places: Column) -> Column:
    return F.transform(places, lambda p: F.element_at(ids, p)).cast(IDS)


CELL_COLUMNS = ["_f", "_ids", "_back"]
LINK_COLUMNS = [*CELL_COLUMNS, "_parents", "_own", "_forward", "_reach"]


def cycle_reaching() -> Column:
    """Ids from which a cycle can be reached through children, of records with links.

    Facts without a child that is still there are taken away round by round; what stays leads to a cycle. Only a graph with an
    edge that does not point back can hold one.
    """
    start = F.array_distinct("_own").cast(PLACES)

    def peel(acc: Column) -> Column:
        above = F.flatten(F.transform(acc["left"], lambda i: F.element_at("_parents", i)))
        return F.struct(F.array_intersect(acc["left"], above).cast(PLACES).alias("left"), F.size(acc["left"]).alias("before"))

    end = F.aggregate(
        F.sequence(F.lit(0), F.size("_ids")),
        F.struct(start.alias("left"), F.lit(-1).alias("before")),
        lambda acc, _: F.when(F.size(acc["left"]) == acc["before"], acc).otherwise(peel(acc)),
    )
    return F.when(F.col("_forward") > 0, ids_at(F.col("_ids"), end["left"])).otherwise(F.array().cast(IDS))


def reaches_final(records: DataFrame) -> DataFrame:
    """Add ``reaching``: ids of the facts some final answer rests on, the final ones included."""
    return with_links(records).withColumn("reaching", F.col("_reach")).drop(*LINK_COLUMNS)


def _with_skip(linked: DataFrame) -> DataFrame:
    def skip(cell: Column) -> Column:
        counts = cell["origin"].isin(PROVED_ORIGINS) & F.array_contains(F.col("_reach"), cell["id"]) & (F.size(cell["parents"]) > 0)
        return F.when(counts, 0).otherwise(1)

    return settle(linked, facts=F.zip_with("facts", "_f", lambda f, cell: f.withField("skip", skip(cell))))


def mark_skip(records: DataFrame) -> DataFrame:
    """Set ``skip`` of each fact: 0 only for derived and answer facts with parents that lead to the answer."""
    return _with_skip(with_links(records)).drop(*LINK_COLUMNS)


def _issue(kind: str, fact_id: Column | None = None, severity: str = "error", **fill: Column) -> Column:
    text = F.lit(MESSAGES[kind])
    for slot, value in fill.items():
        text = F.replace(text, F.lit("{" + slot + "}"), value)
    return F.struct(
        F.lit(severity).alias("severity"),
        F.lit(kind).alias("type"),
        (F.lit(None).cast("string") if fact_id is None else fact_id).alias("fact_id"),
        text.alias("message"),
    ).cast(ISSUE)


def _found(*pairs: tuple[Column, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(test, issue) for test, issue in pairs])).cast(ISSUES)


def _node_issues(cells: Column, ids: Column) -> Column:
    """Findings about one fact on its own."""

    def check(f: Column, i: Column) -> Column:
        fact_id, listed = f["id"], f["listed"]
        return F.when(fact_id == "", F.array(_issue("empty_fact_id")).cast(ISSUES)).otherwise(
            _found(
                (F.array_position(ids, fact_id) <= i, _issue("duplicate_fact_id", fact_id, id=fact_id)),
                (f["text"] == "", _issue("empty_text", fact_id)),
                (
                    ~f["origin"].isin(ORIGINS),
                    _issue("invalid_origin", fact_id, origin=F.coalesce(f["raw_origin"], F.lit(""))),
                ),
                (F.size(F.array_distinct(listed)) != F.size(listed), _issue("duplicate_parent_fact", fact_id)),
            )
        )

    return F.flatten(F.transform(cells, check))


def _link_issues(cells: Column, back: Column, checks: ValidationChecks) -> Column:
    """Findings about one fact's parents and origin."""

    def check(f: Column, i: Column) -> Column:
        fact_id, origin, final = f["id"], f["origin"], f["final"]
        rooted = F.size(f["parents"]) > 0

        def link(p: Column) -> Column:
            return bind(
                F.coalesce(place_from_end(back, p), F.lit(0)),
                lambda place: F.when(place == 0, _issue("missing_parent_fact", fact_id, parent=p)).when(
                    place >= i + 1, _issue("forward_parent_fact", fact_id, parent=p, id=fact_id)
                ),
            )

        rules = []
        if checks.origin_rules:
            rules.append(((origin == "given") & rooted, _issue("given_fact_with_parents", fact_id)))
            rules.append(((origin == "derived") & ~rooted, _issue("derived_without_parents", fact_id)))
        rules.append(((origin == "answer") & ~final, _issue("answer_origin_without_final_flag", fact_id)))
        rules.append((final & (origin != "answer"), _issue("final_answer_origin_mismatch", fact_id)))
        if checks.introduced_without_parents:
            rules.append(((origin == "introduced") & rooted, _issue("introduced_fact_with_parents", fact_id)))
        if not checks.dependency_structure:
            return _found(*rules)
        return F.concat(F.array_compact(F.transform(f["parents"], link)).cast(ISSUES), _found(*rules))

    return F.flatten(F.transform(cells, check))


def validate_graphs(records: DataFrame, checks: ValidationChecks = ValidationChecks()) -> DataFrame:
    """Add ``errors``, ``warnings`` and ``passed`` to records with ``facts`` and ``problem_text``, and set ``skip``.

    Findings keep the order in which a reader of the graph would meet them. Where records have ``schema_errors`` and a record's list
    holds any, these are its findings and nothing else is looked at.
    """
    cells, ids, back = F.col("_f"), F.col("_ids"), F.col("_back")
    finals = F.size(F.filter(cells, lambda f: f["final"]))
    none = F.array().cast(ISSUES)
    warned = F.transform(
        F.filter(
            cells,
            lambda f: f["final"] & (F.size(f["parents"]) == 0) & ~F.contains(F.coalesce(F.col("problem_text"), F.lit("")), f["text"]),
        ),
        lambda f: _issue("final_answer_without_parents", f["id"], "warning"),
    ).cast(ISSUES)
    in_cycle = F.col("_cyclic")
    first_cyclic = F.get(F.filter(ids, lambda i: F.array_contains(in_cycle, i)), F.lit(0))
    cycles = F.when(F.size(in_cycle) > 0, F.array(_issue("cycle_detected", first_cyclic)).cast(ISSUES)).otherwise(none)
    dead = F.transform(
        F.filter(ids, lambda i: ~F.array_contains(F.col("_reach"), i)), lambda i: _issue("dead_end_fact", i)
    ).cast(ISSUES)
    parts = [
        _node_issues(cells, ids),
        _found((finals == 0, _issue("missing_final_answer")), (finals > 1, _issue("multiple_final_answers"))),
        _link_issues(cells, back, checks),
    ]
    if checks.dependency_structure:
        parts.append(cycles)
    if checks.all_facts_reach_answer:
        parts.append(dead)
    empty = F.size(F.coalesce(F.col("facts"), F.array().cast(records.schema["facts"].dataType))) == 0
    linked = _with_skip(with_links(records))
    if checks.dependency_structure:
        linked = settle(linked, _cyclic=cycle_reaching())
    mistyped = F.size(F.coalesce("schema_errors", none)) > 0 if "schema_errors" in records.columns else F.lit(False)
    first = F.when(mistyped, F.col("schema_errors")) if "schema_errors" in records.columns else F.when(F.lit(False), none)
    judged = settle(
        linked,
        errors=F.coalesce(first, F.when(empty, F.array(_issue("empty_facts")).cast(ISSUES)).otherwise(F.concat(*parts))),
        warnings=F.when(mistyped | empty, none).otherwise(warned),
    )
    return judged.withColumn("passed", F.size("errors") == 0).drop("_cyclic", *LINK_COLUMNS)


def graph_issues(validated: DataFrame) -> DataFrame:
    """One row per finding of validated records, numbered within errors and warnings."""
    rows = validated.select("record_id", F.posexplode(F.concat("errors", "warnings")).alias("ord", "issue"))
    return rows.select("record_id", "ord", "issue.*")


def feedback_text(errors: Column) -> Column:
    """Numbered list of the errors for the next try."""
    lines = F.transform(
        errors,
        lambda e, i: F.concat(
            (i + 1).cast("string"),
            F.lit(". "),
            F.when(is_blank(e["fact_id"]), F.lit("")).otherwise(F.concat(F.lit("["), e["fact_id"], F.lit("] "))),
            e["message"],
        ),
    )
    return F.when(F.size(errors) == 0, F.lit(FEEDBACK_EMPTY)).otherwise(
        F.concat(F.lit(FEEDBACK_HEAD + "\n"), F.array_join(lines, "\n"))
    )


def obligation(cell: Column) -> Column:
    """'Given A, B, and C, prove that D.' for one of ``with_cells``; null for roots and where a parent is missing."""
    text_at = lambda place: F.get(F.col("_f"), place - 1)["text"]
    texts = F.transform(cell["parents"], lambda p: text_at(place_from_end(F.col("_back"), p)))

    def sentence(parts: Column) -> Column:
        told = F.concat(F.lit("Given "), join_phrase(parts), F.lit(", prove that "), cell["text"], F.lit("."))
        return F.when((F.size(parts) > 0) & ~F.exists(parts, lambda t: t.isNull()), told)

    return bind(texts, sentence)


def obligations(records: DataFrame) -> DataFrame:
    """One row per fact that has parents, with its proof obligation."""
    rows = F.transform(
        F.filter("_f", lambda f: F.size(f["parents"]) > 0),
        lambda f: F.struct(
            f["id"].alias("fact_id"),
            F.concat(F.lit("prove_"), f["id"]).alias("problem_name"),
            obligation(f).alias("statement"),
        ),
    )
    return with_cells(records).select("record_id", F.inline(rows))


def semantic_fact(fact: Column) -> Column:
    """The five fields that carry meaning, in name order."""
    return F.struct(
        strip(fact["fact_id"]).alias("fact_id"),
        F.coalesce(fact["is_final_answer"], F.lit(False)).alias("is_final_answer"),
        F.coalesce(fact["origin"], F.lit("")).alias("origin"),
        F.coalesce(fact["parent_fact_ids"], F.array().cast(IDS)).alias("parent_fact_ids"),
        F.coalesce(fact["text"], F.lit("")).alias("text"),
    )


# Context modes and the headings of their sections.
CONTEXT_MODES = ["c0_parent", "c1_problem_parent", "c2_problem_prefix", "c3_problem_full_graph", "c4_problem_cot_full_graph"]
HEADINGS = {
    "problem": "Original problem:\n",
    "prefix": "Graph prefix before current node:\n",
    "node": "Current node:\n",
    "trace": "Visible solution or chain of thought:",
    "graph": "Full graph:\n",
    "node_id": "Current node id:\n",
    "task": "Target proof obligation:\n",
}


def contexts(records: DataFrame, mode: str, measured: bool = False) -> DataFrame:
    """One row per non-root fact with the text a formaliser would see in ``mode``; ``measured`` adds its length as ``characters``.

    Needs ``problem_text``, ``raw_cot`` and ``facts``. Facts are written as compact JSON with sorted keys.
    The text is null where the mode needs a problem and the record has none, or where a parent is missing. The sections that the facts of a
    record share are written, and measured, once; the whole text is put together row by row, so no record's texts are held at once.
    """
    if mode not in CONTEXT_MODES:
        raise ValueError(f"unknown context mode {mode!r}; one of {CONTEXT_MODES}")
    titled = lambda name, body: F.concat(F.lit(HEADINGS[name]), body)
    listed = lambda parts: F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))
    shared = {"_problem": titled("problem", F.nullif(strip(F.col("problem_text")), F.lit("")))}
    if mode in CONTEXT_MODES[2:]:
        shared["_json"] = F.transform("facts", lambda f: F.to_json(semantic_fact(f)))
    if mode == CONTEXT_MODES[4]:
        seen = strip_think(F.coalesce(F.col("raw_cot"), F.lit("")))
        shared["_trace"] = titled("trace", F.when(seen == "", F.lit("")).otherwise(F.concat(F.lit("\n"), seen)))
    staged = settle(with_cells(records), **shared)
    gap = F.lit("\n\n")
    sections = [F.col("_problem")] + ([F.col("_trace")] if mode == CONTEXT_MODES[4] else [])
    if mode in CONTEXT_MODES[3:]:
        sections.append(titled("graph", listed(F.col("_json"))))
    staged = settle(staged, _shared=F.concat(*[piece for section in sections for piece in (section, gap)]))
    staged = settle(staged, _chars=F.length("_shared"))
    rows = F.transform(
        F.filter(
            F.transform("_f", lambda f, i: F.struct(i.alias("i"), f.alias("cell"))), lambda r: F.size(r["cell"]["parents"]) > 0
        ),
        lambda r: F.struct((r["i"] + 1).alias("pos"), r["cell"]["id"].alias("fact_id"), obligation(r["cell"]).alias("_statement")),
    )
    kept = ["record_id", "_shared", "_chars"] + (["_json"] if mode == "c2_problem_prefix" else [])
    told = staged.select(*kept, F.inline(rows))
    task = titled("task", F.col("_statement"))
    at = F.col("pos") - 1
    if mode == "c0_parent":
        pieces = [F.col("_statement")]
    elif mode == "c1_problem_parent":
        pieces = [F.col("_shared"), task]
    elif mode == "c2_problem_prefix":
        earlier = listed(F.slice(F.col("_json"), F.lit(1), at))
        pieces = [F.col("_shared"), titled("prefix", earlier), gap, titled("node", F.get("_json", at)), gap, task]
    else:
        pieces = [F.col("_shared"), titled("node_id", F.col("fact_id")), gap, task]
    context = F.concat(*pieces).alias("context")
    if not measured:
        return told.select("record_id", "pos", "fact_id", context)
    once = mode in (CONTEXT_MODES[0], CONTEXT_MODES[2])
    size = F.length(F.concat(*pieces)) if once else F.col("_chars") + F.length(F.concat(*pieces[1:]))
    return told.select("record_id", "pos", "fact_id", context, size.cast("long").alias("characters"))


def form_messages(fact_id: Column, final: Column, context: Column, system: str, user: str) -> Column:
    """Chat messages that ask for a formal statement; the user template has {header} and {context}."""
    keyword = F.when(F.coalesce(final, F.lit(False)), F.lit("theorem ")).otherwise(F.lit("lemma "))
    return chat_messages(system, user, header=F.concat(keyword, F.lit("prove_"), fact_id), context=context)


# Fixed value: the note added where the formal statement did not pass.
BROKEN_NOTE = "\n\nThe previous Lean4 code I sent you contains errors. Please take that into account."


def prove_messages(statement: Column, code: Column, passed: Column, system: str, user: str) -> Column:
    """Chat messages that ask for a proof; the user template may use {statement}, {code}, {header} and {body}."""
    parts = split_header_body(F.coalesce(code, F.lit("")))
    asked = chat_messages(system, user, statement=strip(statement), code=code, header=parts["header"], body=parts["body"])
    broken = (F.coalesce(code, F.lit("")) != "") & ~F.coalesce(passed, F.lit(False))
    return F.transform(
        asked,
        lambda m: m.withField(
            "content",
            F.concat(m["content"], F.when(broken & (m["role"] == "user"), F.lit(BROKEN_NOTE)).otherwise(F.lit(""))),
        ),
    )


def prefix_facts(records: DataFrame) -> DataFrame:
    """Per fact the ids of the facts that stand before it."""
    rows = F.transform(
        "_ids",
        lambda fact_id, i: F.struct(
            (i + 1).alias("pos"), fact_id.alias("fact_id"), F.slice(F.col("_ids"), F.lit(1), i).alias("earlier_ids")
        ),
    )
    return with_cells(records).select("record_id", F.inline(rows))


def visiting_orders(ids: list[str], parents: list[list[str]], targets: list[bool]) -> list[list[str]]:
    """For each target the known ids it rests on, in the order in which a walk up its parents is done with them.

    A fact is done after its own parents, in their listed order, so parents stand before children whichever way the list runs. Of facts
    that share an id all parents count. Each walk goes over its facts and edges once, with a stack of its own.
    """
    above: dict[str, list[str]] = {}
    for fact_id, own in zip(ids, parents, strict=True):
        above.setdefault(fact_id, []).extend(own)
    out = []
    for k, wanted in enumerate(targets):
        if not wanted:
            continue
        seen, done, stack = set(), [], [iter(above[ids[k]])]
        path: list[str | None] = [None]
        while stack:
            fact_id = next(stack[-1], None)
            if fact_id is None:
                stack.pop()
                if (ended := path.pop()) is not None:
                    done.append(ended)
            elif fact_id not in seen:
                seen.add(fact_id)
                if fact_id in above:
                    stack.append(iter(above[fact_id]))
                    path.append(fact_id)
        out.append([fact_id for fact_id in done if fact_id != ids[k]])
    return out


def ancestor_lists(wanted) -> Column:
    """For records with cells, the ancestors of each fact that satisfies ``wanted``, by a walk in Arrow batches."""
    @F.pandas_udf(f"array<{IDS}>")
    def walk(ids: pd.Series, parents: pd.Series, targets: pd.Series) -> pd.Series:
        return pd.Series([visiting_orders(list(i), [list(p) for p in up], list(t)) for i, up, t in zip(ids, parents, targets, strict=True)])

    targets = F.transform("facts", lambda f: F.coalesce(wanted(f), F.lit(False)))
    return walk("_ids", F.transform("_f", lambda f: f["parents"]), targets)


def ancestors(records: DataFrame, wanted) -> DataFrame:
    """For each fact that satisfies ``wanted``, the facts it rests on, parents before children (``visiting_orders``)."""
    cells = with_cells(records.where(F.col("facts").isNotNull()))
    staged = settle(cells, _chosen=F.filter(F.col("facts"), wanted)).withColumn("_lists", ancestor_lists(wanted))
    rows = F.zip_with("_chosen", "_lists", lambda f, found: F.struct(strip(f["fact_id"]).alias("fact_id"), found.alias("ancestor_ids")))
    return staged.select("record_id", F.inline(rows))


def graph_signature(facts: Column) -> Column:
    """Order-free text of a graph's meaning: equal graphs have equal signatures."""
    parts = F.transform(
        facts,
        lambda f: F.struct(
            natural_key(strip(f["fact_id"])).alias("key"),
            strip(F.coalesce(f["text"], F.lit(""))).alias("text"),
            F.array_sort(parents_of(f)).alias("parents"),
            origin_of(f).alias("origin"),
            F.coalesce(f["is_final_answer"], F.lit(False)).alias("final"),
        ),
    )
    return F.sha2(F.to_json(F.array_sort(parts)), 256)


def graphs_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records of two runs with whether their graphs mean the same; null where one run lacks the record."""
    left = a.select("record_id", graph_signature(F.col("facts")).alias("_a"))
    right = b.select("record_id", graph_signature(F.col("facts")).alias("_b"))
    return left.join(right, "record_id", "full").select("record_id", (F.col("_a") == F.col("_b")).alias("same_graph"))


def node_state(skipped: Column, verified: Column, formalised: Column) -> Column:
    """skipped, else verified, else formalized, else unverified."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(skipped), F.lit("skipped"))
        .when(yes(verified), F.lit("verified"))
        .when(yes(formalised), F.lit("formalized"))
        .otherwise(F.lit("unverified"))
    )


# Spellings of flags, and the messages about mistyped fields.
TRUE_TEXTS = ["1", "on", "t", "true", "y", "yes"]
FALSE_TEXTS = ["0", "off", "f", "false", "n", "no"]
TYPE_PROBLEMS = {
    "text": "Input should be a valid string",
    "list": "Input should be a valid list",
    "flag": "Input should be a valid boolean",
    "flag_value": "Input should be a valid boolean, unable to interpret input",
    "number": "Input should be a valid integer",
    "number_text": "Input should be a valid integer, unable to parse string as an integer",
    "number_part": "Input should be a valid integer, got a number with a fractional part",
    "document": "Input should be a valid dictionary or instance of FDGDocument",
    "fact": "Input should be a valid dictionary or instance of FactItem",
}
NUMERIC = "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


def _shape(v: Column) -> Column:
    return F.schema_of_variant(v)


def _as_text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def read_flag(v: Column) -> Column:
    """A boolean, a number 0 or 1, or a spelled flag; null when it is none of them."""
    number, word = F.try_variant_get(v, "$", "double"), F.lower(_as_text(v))
    return (
        F.when(_shape(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(_shape(v).rlike(NUMERIC), F.when(number == 1, True).when(number == 0, False))
        .when(_shape(v) == "STRING", F.when(word.isin(TRUE_TEXTS), True).when(word.isin(FALSE_TEXTS), False))
    )


def read_whole(v: Column) -> Column:
    """A whole number, a flag as 0 or 1, or a whole number as text; null when it is none of them."""
    number = F.try_variant_get(v, "$", "double")
    return (
        F.when(_shape(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int"))
        .when(_shape(v).rlike(NUMERIC), F.when(number == F.floor(number), number.try_cast("int")))
        .when(_shape(v) == "STRING", F.when(strip(_as_text(v)).rlike(r"^[+-]?[0-9]+(\.0+)?$"), strip(_as_text(v)).try_cast("double").try_cast("int")))
    )


def typed_facts(document: Column) -> Column:
    """The facts of a document without schema findings, in the fact type."""
    facts = F.coalesce(F.try_variant_get(document, "$.facts", "array<variant>"), F.array().cast("array<variant>"))
    get = lambda f, name, kind: F.try_variant_get(f, f"$.{name}", kind)
    return F.transform(
        facts,
        lambda f: F.struct(
            get(f, "fact_id", "string").alias("fact_id"),
            get(f, "text", "string").alias("text"),
            F.coalesce(get(f, "parent_fact_ids", IDS), F.array().cast(IDS)).alias("parent_fact_ids"),
            F.coalesce(read_flag(get(f, "is_final_answer", "variant")), F.lit(False)).alias("is_final_answer"),
            get(f, "origin", "string").alias("origin"),
            F.coalesce(read_whole(get(f, "skip", "variant")), F.lit(0)).alias("skip"),
        ),
    )


def schema_issues(document: Column) -> Column:
    """Findings about missing or mistyped fields of a parsed document (a VARIANT), in field order; none for a null document."""

    def issue(where: Column, kind: str) -> Column:
        problem = TYPE_PROBLEMS.get(kind, kind)
        return _issue("schema_validation_error", None, where=where, problem=F.lit(problem))

    def text_field(owner: Column, name: str, where: Column) -> Column:
        value = F.try_variant_get(owner, f"$.{name}", "variant")
        return F.when(value.isNull(), issue(where, "Field required")).when(_shape(value) != "STRING", issue(where, "text"))

    def flag_field(owner: Column, where: Column) -> Column:
        value = F.try_variant_get(owner, "$.is_final_answer", "variant")
        readable = _shape(value).rlike(NUMERIC) | (_shape(value) == "STRING")
        wrong = F.when(readable, issue(where, "flag_value")).otherwise(issue(where, "flag"))
        return F.when(value.isNotNull() & read_flag(value).isNull(), wrong)

    def whole_field(owner: Column, where: Column) -> Column:
        value = F.try_variant_get(owner, "$.skip", "variant")
        wrong = (
            F.when(_shape(value).rlike(NUMERIC), issue(where, "number_part"))
            .when(_shape(value) == "STRING", issue(where, "number_text"))
            .otherwise(issue(where, "number"))
        )
        return F.when(value.isNotNull() & read_whole(value).isNull(), wrong)

    def list_field(owner: Column, name: str, where: Column) -> Column:
        value = F.try_variant_get(owner, f"$.{name}", "variant")
        return F.when(value.isNotNull() & ~_shape(value).startswith("ARRAY"), issue(where, "list"))

    def of_fact(f: Column, i: Column) -> Column:
        base = F.concat(F.lit("facts."), i.cast("string"))
        at = lambda name: F.concat(base, F.lit(f".{name}"))
        parents = F.coalesce(F.try_variant_get(f, "$.parent_fact_ids", "array<variant>"), F.array().cast("array<variant>"))
        mistyped = F.transform(
            parents, lambda p, k: F.when(_shape(p) != "STRING", issue(F.concat(at("parent_fact_ids"), F.lit("."), k.cast("string")), "text"))
        )
        fields = F.concat(
            F.array(text_field(f, "fact_id", at("fact_id")), text_field(f, "text", at("text")), list_field(f, "parent_fact_ids", at("parent_fact_ids"))),
            mistyped,
            F.array(flag_field(f, at("is_final_answer")), text_field(f, "origin", at("origin")), whole_field(f, at("skip"))),
        )
        return F.when(_shape(f).startswith("OBJECT"), F.array_compact(fields)).otherwise(F.array(issue(base, "fact"))).cast(ISSUES)

    top = F.array(
        text_field(document, "problem_id", F.lit("problem_id")),
        text_field(document, "problem_text", F.lit("problem_text")),
        list_field(document, "facts", F.lit("facts")),
    )
    facts = F.coalesce(F.try_variant_get(document, "$.facts", "array<variant>"), F.array().cast("array<variant>"))
    found = F.concat(F.array_compact(top).cast(ISSUES), F.flatten(F.transform(facts, of_fact)))
    return (
        F.when(document.isNull(), F.array().cast(ISSUES))
        .when(_shape(document).startswith("OBJECT"), found)
        .otherwise(F.array(issue(F.lit(""), "document")).cast(ISSUES))
    )
