"""Condition language: tokens, invalid expressions, evaluation (cases as data)."""

import pytest
from pyspark.sql import functions as F

from formlake.functions.conditions import (InvalidExpressionError, Resolver, compile_condition,
                                           condition_errors, tokenize)

# The condition cases of the reference's own test-suite (valid expressions with
# their tokens in our flat form, invalid expressions, false and true evaluations).
VALID = [
    ("a&&b", ["a", "&&", "b"]),
    ("a &&b", ["a", "&&", "b"]),
    ("a && b", ["a", "&&", "b"]),
    ("(a&&(b))", ["(", "a", "&&", "(", "b", ")", ")"]),
    ("(a&&b)", ["(", "a", "&&", "b", ")"]),
    ("((aa)) && b", ["(", "(", "aa", ")", ")", "&&", "b"]),
    ("((aa)&&(aa||bb))", ["(", "(", "aa", ")", "&&", "(", "aa", "||", "bb", ")", ")"]),
    ("a&&(b||c&&!(!d||(e&&f)))&&(g||h)",
     ["a", "&&", "(", "b", "||", "c", "&&", "!", "(", "!", "d", "||", "(", "e", "&&", "f", ")", ")", ")",
      "&&", "(", "g", "||", "h", ")"]),
    ("a&&b&&c(d,e)", ["a", "&&", "b", "&&", "c", "(", "d", ",", "e", ")"]),
    ('a||"b"||c', ["a", "||", '"b"', "||", "c"]),
    ('"a\\"b\\\\\\"c\\\\"', ['"a\\"b\\\\\\"c\\\\"']),
]

INVALID = ["a!&&b", "a&&(c||d", "a&b", "a&&b&&(c", "a&&b&&c)", "a&&b&&c(d", "a&&b&&c(d,", "a&&b&&c(d e)",
           "a(b(c)", '"a', '"\\"', 'a "', 'a "b']

FALSE = ["true && false", "(true && false)", "false && false", "false || false", "true && (false && !true)",
         'contains("abc", "b") && contains("abc", "d")']
TRUE = ["true && true", "true && (true || false)", "false || !false",
        "true && (false || (!true)) || (true && true)",
        'matches("a\\"b\\\\\\"c\\\\", "^(z|[a]).(?:b{1,})..[asxdc].$")', 'matches("abc", "B", "i")',
        '!(matches("abc", "d"))', 'contains("abc", "b")', '!(contains("abc", "d"))',
        'contains("abc", "b") && contains("abc", "c")']


class NameIsTrue(Resolver):
    def boolean(self, name):
        return F.lit(name == "true")

    def value(self, name):
        return None


@pytest.mark.parametrize("expr,tokens", VALID)
def test_tokens(expr, tokens):
    assert tokenize(expr) == tokens


def test_invalid_expressions_found_by_spark_job(spark):
    df = spark.createDataFrame([("t", f"i{n}", e) for n, e in enumerate(INVALID)],
                               "template_id string, item_id string, cond string")
    flagged = {r.item_id for r in condition_errors(df).select("item_id").distinct().collect()}
    assert flagged == {f"i{n}" for n in range(len(INVALID))}


def test_valid_expressions_not_flagged(spark):
    ok = [e for e, _ in VALID if "c(d" not in e]  # c is not a registered function
    df = spark.createDataFrame([("t", f"v{n}", e) for n, e in enumerate(ok)],
                               "template_id string, item_id string, cond string")
    assert condition_errors(df).count() == 0


@pytest.mark.parametrize("expr", INVALID)
def test_invalid_expressions_do_not_compile(expr):
    with pytest.raises(InvalidExpressionError):
        compile_condition(expr, NameIsTrue())


def test_evaluation(spark):
    cols = [compile_condition(e, NameIsTrue()).alias(f"f{n}") for n, e in enumerate(FALSE)]
    cols += [compile_condition(e, NameIsTrue()).alias(f"t{n}") for n, e in enumerate(TRUE)]
    row = spark.range(1).select(*cols).first().asDict()
    assert not any(v for k, v in row.items() if k.startswith("f"))
    assert all(v for k, v in row.items() if k.startswith("t"))


def test_equal_precedence_left_to_right(spark):
    # a || b && c with a = true, c = false is (a || b) && c = false
    class R(NameIsTrue):
        def boolean(self, name):
            return F.lit({"a": True, "b": False, "c": False}[name])

    assert spark.range(1).select(compile_condition("a || b && c", R()).alias("x")).first().x is False


def test_empty_condition_is_true(spark):
    assert spark.range(1).select(compile_condition("", NameIsTrue()).alias("x")).first().x is True
