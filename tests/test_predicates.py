import pytest
from pyspark.sql import functions as F

from arbora.lang import expr
from arbora.lang.rules import compile_rules, compile_selector
from arbora.operators import predicates as P
from arbora.operators.select import decision


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [(1, "Green apples", 35, ["Green", "cloth"]), (2, "Green", None, []), (3, None, 36, None), (4, "Green pears", 36, ["Green", "moss", "in", "jars"])],
        "id int, attr string, n int, xs array<string>",
    )


def ids(df, test):
    return [r.id for r in df.where(test).orderBy("id").collect()]


CASES = {
    'eq(attr, "Green")': [2], 'eq(attr, "Green", null)': [2, 3], 'ne(attr, "Green")': [1, 3, 4], 'eq(n, "36")': [3, 4], "eq(n, 36)": [3, 4],
    "gt(n, 35)": [3, 4], "le(n, 35)": [1], "between(n, 35, 35)": [1], "outside(n, 0, 35)": [3, 4],
    'like(attr, "pears|apples")': [1, 4], 'unlike(attr, "pears")': [1, 2, 3], 'like(attr, null)': [3], 'like(attr, ref("xs.missing?"))': [3],
    "any(xs)": [1, 4], "none(xs)": [2, 3], 'any(xs, eq(@, "Green"))': [1, 4], 'all(xs, like(@, "e|o"))': [1, 2, 3], 'notall(xs, like(@, "e|o"))': [4],
    "mt(xs, 1)": [1, 4], 'me(xs, 2, like(@, "e|o"))': [1, 4], "ft(xs, 1)": [2, 3], "fe(xs, 2)": [1, 2, 3], "num(xs, 2, 3)": [1],
    'in(attr, "xs")': [], 'notin(attr, "xs")': [1, 2, 3, 4], 'and(eq(n, 36), eq(attr, null))': [3], "and()": [1, 2, 3, 4], "or()": [],
    "not(gt(n, 35))": [1, 2], "nand(gt(n, 35), any(xs))": [1, 2, 3], "nor(eq(n, 36), any(xs))": [2],
}


@pytest.mark.parametrize("text", CASES)
def test_selector(rows, text):
    if "missing" in text:
        text = text.replace("xs.missing?", "attr2?")
    assert ids(rows, compile_selector(text, expr.of(rows))) == CASES[text.replace("attr2?", "xs.missing?")]


def test_no_selector_is_ever_null(rows):
    for text in CASES:
        text = text.replace("xs.missing?", "attr2?")
        assert rows.where(compile_selector(text, expr.of(rows)).isNull()).count() == 0


def test_rules_decide_by_first_match(rows):
    rules, settings = compile_rules('config(limit(3), names("a", "b")); Row("one", gt(n, 35)).accept("x", any(xs)).reject("y"); Row("two").accept("z", eq(n, null))', expr.of(rows))
    assert settings == {"limit": 3, "names": ["a", "b"]}
    got = {r.id: r.d and (r.d.ruleId, r.d.actionId, r.d.accept) for r in rows.select("id", decision(rules).alias("d")).collect()}
    assert got == {1: None, 2: ("two", "z", True), 3: ("one", "y", False), 4: ("one", "x", True)}


def test_ref_compares_columns(rows):
    assert ids(rows, P.gt("n", P.ref(F.col("id") * 9))) == [1, 3]
