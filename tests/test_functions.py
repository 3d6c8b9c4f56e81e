"""Column functions on hand-made values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from traceloom.functions import bins, chat, checks, code, coerce, json_text, text
from traceloom.operators import datasets


def one(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0]["v"]


@pytest.mark.parametrize(
    "value, visible, unclosed",
    [
        ("<think>a</think> b", "b", False),
        ("a <THINK id=1>b", "a", True),
        ("<think>x</think> y <think>z", "y", True),
        (" plain\n", "plain", False),
        ("<thinking>kept", "<thinking>kept", False),
    ],
)
def test_think(spark, value, visible, unclosed):
    assert one(spark, text.strip_think(F.lit(value))) == visible
    assert one(spark, text.has_unclosed_think(F.lit(value))) is unclosed


@pytest.mark.parametrize(
    "answer, block",
    [
        ('```json\n{"a": 1}\n```\n```json\n[1]\n```', '{"a": 1}'),
        ("```json\n[1]\n```\n```json\n[2]\n```", "[2]"),
        ('so {"a": {"b": 1}} and {"c": 2}', '{"a": {"b": 1}}'),
        ('<think>{"x": 0}</think>{"y": 1}', '{"y": 1}'),
        ('<think>{"x": 0} {"y": 1}', '{"x": 0}'),
        ("nothing", None),
        ("{never closed", None),
        ("stray } then {a}", "{a}"),
    ],
)
def test_json_block(spark, answer, block):
    assert one(spark, json_text.extract_json_block(F.lit(answer))) == block


@pytest.mark.parametrize(
    "answer, value",
    [
        ('{"a": "x"}', "x"),
        ('{"a": "x \\in y"}', "x \\\\in y"),
        ("{'a': 'x'}", "x"),
        ("{a: 'x',}", "x"),
        ("```json\n{'a': 'p, ]q', // note\n}\n```", "p, ]q"),
        ("{'a': ", None),
    ],
)
def test_parse(spark, answer, value):
    parsed = one(spark, json_text.parse_llm_json(F.lit(answer), "a: string"))
    assert (parsed["a"] if parsed else None) == value


def test_report_json(spark):
    assert one(spark, json_text.extract_json_object(F.lit('x {"a": 1} y'))) == '{"a": 1}'
    assert one(spark, json_text.extract_json_object(F.lit("x {'a'} y"))) is None


@pytest.mark.parametrize("p, label", [(0, "0-10%"), (9.99, "0-10%"), (10, "10-20%"), (99.9, "90-100%"), (100, "100%"), (130, "100%"), (-5, "0-10%")])
def test_percent_bucket(spark, p, label):
    assert one(spark, bins.percent_bucket(F.lit(float(p)))) == label


@pytest.mark.parametrize("x, b", [(-1.0, 0), (1.0, 39), (1.01, None), (-1.2, None), (0.0, 20), (float("nan"), None)])
def test_fixed_bin(spark, x, b):
    assert one(spark, bins.fixed_bin(F.lit(x), -1.0, 1.0, 0.05)) == b


@pytest.mark.parametrize("n, b, label", [(0, 0, "[0,256)"), (255, 0, "[0,256)"), (256, 1, "[256,512)"), (1023, 2, "[512,1024)"), (1024, 3, "[1024,2048)")])
def test_doubling(spark, n, b, label):
    assert one(spark, bins.doubling_bin(F.lit(n))) == b
    assert one(spark, bins.doubling_label(bins.doubling_bin(F.lit(n)))) == label


MESSAGE = checks.diagnostics_type()


def response(spark, error, fatal, messages, sorries):
    body = F.lit(None) if messages is None else F.struct(
        F.lit(fatal).alias("message"),
        F.array(*[F.struct(F.lit(s).alias("severity"), *[F.lit(0).alias(n) for n in ("line", "column", "end_line", "end_column")], F.lit(d).alias("data")) for s, d in messages]).cast(MESSAGE).alias("messages"),
        F.lit(sorries).cast("array<string>").alias("sorries") if sorries is None else F.array(*[F.lit(s) for s in sorries]).alias("sorries"),
    )
    if messages is None:
        body = F.lit(None).cast(f"struct<message: string, messages: {MESSAGE}, sorries: array<string>>")
    v = one(spark, checks.verdict_from_response(F.lit(error), body))
    return v["lean_pass"], v["lean_verify"]


def test_response_verdicts(spark):
    assert response(spark, None, None, [("info", "ok")], None) == (True, True)
    assert response(spark, None, None, [("error", "type mismatch")], None) == (False, False)
    assert response(spark, None, None, [], ["1:2"]) == (True, False)
    assert response(spark, None, None, [("warning", "declaration uses 'sorry'")], None) == (True, False)
    assert response(spark, "timeout", None, None, None) == (False, False)
    assert response(spark, None, "fatal", [], None) == (False, False)
    assert response(spark, None, None, None, None) == (False, False)


@pytest.mark.parametrize("value, verdict", [("", (True, True)), ('"severity" : "error"', (False, False)), ("it failed", (True, False)), ("it Failed", (True, True))])
def test_text_verdicts(spark, value, verdict):
    v = one(spark, checks.verdict_from_text(F.lit(value)))
    assert (v["lean_pass"], v["lean_verify"]) == verdict


@pytest.mark.parametrize(
    "message, lean, skipped, status, label",
    [
        ("anything", "", False, "running", "running"),
        ("anything", "", True, "failed", "skipped"),
        ("Prompt token count", "", False, "failed", "token_overflow"),
        ("application type mismatch", "", False, "failed", "lean_type_mismatch"),
        ('{"severity": "error", "data": "failed to synthesize"}', "", False, "failed", "lean_synthesis_failed"),
        ("failed to synthesize", "", False, "failed", "lean_synthesis_failed"),
        ("tactic x failed", "", False, "failed", "lean_tactic_failed"),
        ("", "code", False, "failed", "lean_error_other"),
        ("", "", False, "failed", "failed_no_error_msg"),
        ("odd", "", False, "failed", "other_error"),
    ],
)
def test_error_classes(spark, message, lean, skipped, status, label):
    assert one(spark, checks.classify_error(F.lit(message), F.lit(lean), F.lit(skipped), F.lit(status))) == label


HEADER = "import Mathlib\nimport Aesop\nset_option maxHeartbeats 0\nopen BigOperators Real Nat Topology Rat Filter"


@pytest.mark.parametrize(
    "source, result",
    [
        ("lemma a", f"{HEADER}\n\nlemma a"),
        (f"{HEADER}\n\nlemma a", f"{HEADER}\n\nlemma a"),
        (f"{HEADER}\nlemma a", f"{HEADER}\n\nlemma a"),
        ("import Mathlib\n\nlemma a", "import Mathlib\n\nimport Aesop\nset_option maxHeartbeats 0\nopen BigOperators Real Nat Topology Rat Filter\n\nlemma a"),
        ("\n\nlemma a", f"{HEADER}\n\nlemma a"),
    ],
)
def test_header(spark, source, result):
    assert one(spark, code.ensure_header(F.lit(source))) == result


def test_code_blocks(spark):
    assert one(spark, code.bare_code_block(F.lit("```lean4\na\n```\n```lean4\nb\n```"))) == "b"
    assert one(spark, code.bare_code_block(F.lit("words\n  theorem x\n y\n```\nz"))) == "theorem x\n y"
    assert one(spark, code.bare_code_block(F.lit("words"))) is None
    spliced = one(spark, code.splice_proof(F.lit("theorem t : p := by sorry"), F.lit("```lean4\ntheorem t := by\n  simp\n```")))
    assert (spliced["code"], spliced["body"], spliced["error"]) == ("theorem t : p := by\nsimp", "simp", None)
    assert one(spark, code.splice_proof(F.lit("theorem t"), F.lit("x")))["error"]
    assert one(spark, code.proof_body(F.lit("by"))) == "sorry"


def test_small_text_functions(spark):
    assert one(spark, text.parent_id(F.lit("a__rollout_1__rollout_2"))) == "a__rollout_1"
    assert one(spark, text.rollout_no(F.lit("a__rollout_1__rollout_2"))) == 2
    assert one(spark, text.rollout_no(F.lit("a"))) is None
    assert one(spark, text.wrap_gold(F.lit(" x^2 "))) == "$x^2$"
    assert one(spark, text.wrap_gold(F.lit("\\pi"))) == "$\\pi$"
    assert one(spark, text.truncate_text(F.lit("abcdef"), 4)) == "abcd\n...[truncated 2 chars]"
    assert one(spark, text.fmt_seconds(F.lit(3727.5))) == "1h02m07.5s"
    assert one(spark, coerce.to_step(F.lit("true"))) is None and one(spark, coerce.to_step(F.lit('" 12 "'))) == 12
    assert one(spark, coerce.to_float(F.lit("inf"))) is None


def test_trim_conversation(spark):
    turns = F.array(*[chat.message("user", F.lit("x" * 40)) for _ in range(8)])
    assert len(one(spark, chat.trim_conversation(turns, 60))) == 6
    assert len(one(spark, chat.trim_conversation(turns, 1))) == 4


def test_template_needs_its_slots():
    with pytest.raises(ValueError):
        chat.render_template("{a} {b}", a=F.lit(1))


@pytest.mark.parametrize("answer, gold, right", [("\\boxed{\\frac{1}{2}}", "\\frac{1}{2}", 1), ("so 1,000", "1000.0", 1), ("3.1415926", "3.1415927", 1), ("4", "5", 0), (None, "5", 0)])
def test_grading(spark, answer, gold, right):
    row = datasets.grade_answers(spark.createDataFrame([(answer, gold)], "answer string, gold string")).collect()[0]
    assert row["is_correct"] == right


@pytest.mark.parametrize(
    "answer, value",
    [
        ("{a: 0x1F, b: -0xff, c: 0XFFFFFFFFFFFFFFFFFF}", '{"a":31,"b":-255,"c":4.722366482869645E21}'),
        ("{'a': 'say \"x\"', b: [1,2,], /* n, */ c: .5, d: 5., e: +7} // end", '{"a":"say \\"x\\"","b":[1,2],"c":0.5,"d":5,"e":7}'),
        ('{"a": "0x1F // no", b1: 12}', '{"a":"0x1F // no","b1":12}'),
        ("{a: ", None),
    ],
)
def test_relaxed_answers(spark, answer, value):
    assert one(spark, F.to_json(json_text.read_answer(F.lit("```json\n" + answer + "\n```")))) == value


def test_strict_pieces(spark):
    for relaxed, strict in [(r"'it\'s'", '"it\'s"'), ("'a\\\nb'", '"ab"'), (r"'\x41\v\q'", r'"\u0041\u000bq"'), ("'a\nb'", r'"a\nb"'), ("x1 0x0", "x1 0")]:
        assert one(spark, json_text.strict_pieces(F.lit(relaxed))) == strict


def test_typed_scalars(spark):
    from traceloom.functions import coerce

    for text, number, flag in [('"5.0"', 5.0, None), ("5.0", 5.0, True), ("0", 0.0, False), ("true", None, True), ('"True"', None, True), ("null", None, None), ("[1]", None, None), ('"1e400"', None, None), ('" no "', None, False)]:
        value = F.parse_json(F.lit(text))
        assert (one(spark, coerce.typed_float(value)), one(spark, coerce.typed_bool(value))) == (number, flag), text
    assert one(spark, coerce.to_bool(F.lit(" 7 "))) is None


def test_answers_with_findings_stay_whole(spark):
    from traceloom.operators.datasets import compact_response

    assert one(spark, compact_response(F.lit('{"problem_id": "p", "problem_text": 5, "facts": [1]}'))) == '{"facts":[1],"problem_id":"p","problem_text":5}'
    good = '{"problem_id": "p", "problem_text": "q", "z": 1, "facts": [{"fact_id": "f", "text": "t", "origin": "given", "skip": 1}]}'
    assert one(spark, compact_response(F.lit(good))) == '{"problem_id":"p","problem_text":"q","facts":[{"fact_id":"f","text":"t","parent_fact_ids":[],"is_final_answer":false,"origin":"given"}]}'
    assert one(spark, compact_response(F.lit("none"))) == ""


@pytest.mark.parametrize(
    "raw, flag",
    [("0", False), ("7", True), (" 7 ", True), ("5.0", True), ("0.0", False), ("true", True), ("Yes", True), ("f", False), ('"5"', None), ('"no"', False), ("NaN", None), ("[1]", None), (None, None)],
)
def test_flags_of_raw_json(spark, raw, flag):
    assert one(spark, coerce.raw_bool(F.lit(raw).cast("string"))) is flag


def test_coercions_read_numbers_as_flags(spark):
    from catalog.functions import coercions

    rows = coercions(spark, "/root/testdata/sf0.001").where("event_id % 7 IN (0, 1, 5)").collect()
    assert rows and all(r.flag is (r.event_id % 7 == 1 or r.event_id != 0) for r in rows)
