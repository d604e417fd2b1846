"""Patterns: long lines, repeated groups, and the dialect, held against a linear-time engine."""

import random

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from shapewright.functions.loops import survey
from shapewright.functions.patterns import PatternError, translate
from shapewright.operators.lines import Region
from shapewright.plans.shape import Shape

MANY = 1 << 20


def captures(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "capture_id long, text string")


@pytest.mark.parametrize(
    ("pattern", "unit", "end"),
    [
        (r"^(?P<x>(?:a|b)*)$", "ab", ""),
        (r"^(?P<x>(?:\w+,|;)*)$", "k1,;", ""),
        (r'^"(?P<x>(?:[^"\\]|\\.)*)"$', '\\"x', ""),
        (r"^(?P<x>(?:a|ab)*)c$", "aab", "c"),
        (r"^(?P<x>(?:\s+\S+)*)\s*$", " xy", "  "),
        (r"^(?P<x>(?:(?:a|b)+ ?)*)$", "ab a ", ""),
        (r"^(?P<x>(?:a|b)*?)(?P<y>b*)$", "aab", "bbb"),
        (r"^(?P<x>((a)|(b))+)$", "ab", ""),
    ],
)
def test_lines_of_a_mebibyte(spark, pattern, unit, end):
    line = unit * (MANY // len(unit) - 2) + end
    line = f'"{line}"' if pattern.startswith('^"') else line
    told = Shape("regex", patterns=[pattern]).read(captures(spark, line, "no such"), "report").collect()
    want = pc.extract_regex(pa.array([line]), pattern.replace("((a)|(b))", "(?:a|b)"))[0].as_py()
    got = next(r for r in told if r.capture_id == 0)
    assert got.refusal is None and got.x == want["x"]
    assert len(told) == 2


def test_parts_of_a_document_with_long_lines(spark):
    line = "ab" * (MANY // 4)
    shape = Shape("composite", parts={"a": Shape("regex", Region(after="^A$", until="^B$"), patterns=[r"^(?P<x>(?:a|ab)*)$"]), "b": Shape("regex_input", Region(after="^B$"), patterns=[r"^(?P<y>(?:(?:x|y)+\n?)*)$"])})
    (got,) = shape.documents(captures(spark, f"A\n{line}\nB\n" + "xy\nyx\n" * 20000)).collect()
    assert got.a[0].x == line and len(got.b.y) == 120000 - 1


def test_a_condition_on_a_longer_line_than_the_stack_takes_is_an_error(spark):
    shape = Shape("regex", Region(ignore=(r"^(?:a|ab)*$",)), patterns=[r"^(?P<x>c.*)$"])
    assert [r.x for r in shape.read(captures(spark, "abaab\nc1")).collect()] == ["c1"]
    with pytest.raises(Exception, match="characters under the pattern"):
        shape.read(captures(spark, "ab" * MANY + "\nc1")).collect()
    possessive = Shape("regex", Region(ignore=(r"^(?:a|b)*$",)), patterns=[r"^(?P<x>c.*)$"])
    assert [r.x for r in possessive.read(captures(spark, "ab" * (MANY // 4) + "\nc1")).collect()] == ["c1"]


def test_which_repeats_are_possessive():
    for pattern in (r"(?:a|b)*$", r"(?:[^,;]*,)*;", r"(?:\d+\.)+[a-z]", r"(?:ab)*", r"(?:a|bc)+?$"):
        assert not survey(pattern).deep and survey(pattern).possessive, pattern
    for pattern in (r"(?:a|b)*a", r"(?:a|ab)*$", r"(?:a*)*$", r"(?:a|b)*?", r"(?:a|-)*\b", r"(?:\s+\S+)*\s*$", r"(?i:(?:k|x)*)é", r"(?:(?:a){1,20}){2,}"):
        assert survey(pattern).deep, pattern
    assert survey(r"a*b+[cd]*.{3,}(?:x|y){2,8}\S+").possessive == frozenset()


def _drawn(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 3)
    if kind < 2:
        return rng.choice(["a", "b", "c", "[ab]", "[^a]", r"\d", "1", "."])
    if kind == 2:
        return "".join(_drawn(rng, depth + 1) for _ in range(2))
    if kind == 3:
        return "(?:" + "|".join(_drawn(rng, depth + 1) for _ in range(rng.randrange(2, 4))) + ")"
    inner = _drawn(rng, depth + 1)
    return f"(?:{inner}){rng.choice(['*', '+', '?', '*?', '+?', '{2,}', '{1,20}'])}"


@pytest.mark.parametrize("seed", [7, 8, 9])
def test_drawn_patterns_match_as_in_the_linear_engine(spark, seed):
    """What is possessive, too: over 400 patterns with 60 texts each."""
    rng = random.Random(seed)
    patterns = []
    while len(patterns) < 400:
        body = _drawn(rng)
        if len(body) < 60 and "(?:" in body:
            patterns.append(rng.choice(["^(?P<x>%s)$", "(?P<x>%s)", "^(?P<x>%s)(?P<y>b.*)?", "(?P<x>%s)[c1]"]) % body)
    assert sum(bool(survey(p).possessive) for p in patterns) > 60
    texts = ["".join(rng.choice("abc1") for _ in range(rng.randrange(0, 9))) for _ in range(60)]
    known = [translate(p) for p in patterns]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(*[F.regexp_extract("t", p.java, 1).alias(f"p{k}") for k, p in enumerate(known)], *[p.matches(F.col("t")) for p in known]).collect()
    for k, p in enumerate(patterns):
        assert [r[len(known) + k] for r in rows] == pc.match_substring_regex(pa.array(texts), p).to_pylist(), p
    for k, p in enumerate(patterns):
        if known[k].deep:  # the linear engine's own
            continue
        want = [(x or {}).get("x") or "" for x in pc.extract_regex(pa.array(texts), p).to_pylist()]
        assert [r[k] for r in rows] == want, p


@pytest.mark.parametrize(
    ("pattern", "text", "hit"),
    [
        (r"\bfoo", "éfoo", True), (r"\bfoo", "xfoo", False), (r"o\b", "foo", True), (r"o\B", "foo", True), (r"\Boo", "foo", True), (r"\Bfoo", "foo", False),
        (r"(?i)É", "é", True), (r"(?i:É)x", "éx", True), (r"(?i)k", "K", True), (r"^[[:blank:]]+$", " \t", True), (r"^[[:word:]]+$", "a_1", True), (r"^[[:word:]]+$", "é", False),
        (r"^[[:cntrl:]]$", "\x01", True), (r"^[[:graph:]]+$", "a!", True), (r"^[[:graph:]]+$", "a b", False), (r"^[[:print:]]+$", "a b", True), (r"^[[:ascii:]]+$", "é", False), (r"^[[:^ascii:]]+$", "é", True), (r"^[^[:word:]]+$", "- ", True),
    ],
)
def test_dialect(spark, pattern, text, hit):
    assert spark.createDataFrame([(text,)], "t string").select(translate(pattern).matches(F.col("t"))).first()[0] is hit
    assert pc.match_substring_regex(pa.array([text]), pattern)[0].as_py() is hit


def test_what_is_no_pattern_is_a_problem():
    for pattern in ("[[:nosuch:]]", "[[:alpha", "(?U)a", "(?<=a)b", r"(a)\1"):
        with pytest.raises(PatternError):
            translate(pattern)
    assert Shape("regex", patterns=["[[:nosuch:]]"]).problems()
