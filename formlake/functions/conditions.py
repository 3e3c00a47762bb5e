"""The questionnaire condition language.

Two halves:

* ``condition_tokens`` / ``condition_errors`` – a Spark job over the item table that splits
  every condition into tokens with one regular expression and checks the token sequence
  with window functions (bracket balance, operator/operand adjacency).
* ``compile_tokens`` – turns the tokens of one condition into a boolean ``Column``. The
  template is small (tens to hundreds of items) so its tokens are collected once; the
  compiled Columns are then evaluated over all submissions in one narrow projection.

Semantics kept from the reference: ``&&`` and ``||`` have *equal* precedence and fold left
to right; ``!`` negates the next single operand or group; an empty condition is true;
``f(args)`` calls a registered function with string arguments.
"""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formlake.session import let

# One token: a quoted string with backslash escapes, a two-character operator, a
# single-character special, or a run of name characters.
TOKEN_PATTERN = r'"(?:\\.|[^"\\])*"|&&|\|\||[!(),]|[^ ()!&|,"]+'
BINARY_OPS = {"&&", "||", ","}


class InvalidExpressionError(ValueError):
    """A condition that the language rejects."""


# ---------------------------------------------------------------------------
# Function registry (extendable): name -> builder over string Columns.
# ---------------------------------------------------------------------------
def _fn_matches(s: Column, pattern: Column, flags: Column | None = None) -> Column:
    """Unanchored regular-expression search; flags i, m, s become inline flags."""
    if flags is not None:
        fl = F.regexp_replace(flags, "[^ims]", "")
        pattern = F.when(fl != "", F.concat(F.lit("(?"), fl, F.lit(")"), pattern)).otherwise(pattern)
    return F.coalesce(F.rlike(F.coalesce(s, F.lit("")), pattern), F.lit(False))


def _fn_contains(s: Column, needle: Column) -> Column:
    return F.coalesce(F.contains(F.coalesce(s, F.lit("")), needle), F.lit(False))


FUNCTIONS: dict[str, Callable[..., Column]] = {"matches": _fn_matches, "contains": _fn_contains}


def register_function(name: str, builder: Callable[..., Column]) -> None:
    """Add a condition function; ``builder`` receives string Columns, returns a boolean Column."""
    FUNCTIONS[name] = builder


# ---------------------------------------------------------------------------
# Token job (runs on Spark over any number of templates).
# ---------------------------------------------------------------------------
def condition_tokens(items: DataFrame, cond_col: str = "cond",
                     keys: tuple[str, ...] = ("template_id", "item_id")) -> DataFrame:
    """One row per token: ``(*keys, pos, token, kind)``; pos starts at 0."""
    toks = (items.where(F.coalesce(F.trim(F.col(cond_col)), F.lit("")) != "")
            .select(*keys, F.posexplode(F.regexp_extract_all(F.col(cond_col), F.lit(TOKEN_PATTERN), 0))
                    .alias("pos", "token")))
    return toks.withColumn("kind", token_kind(F.col("token")))


def token_kind(token: Column) -> Column:
    return (F.when(token.isin("&&", "||", ","), "binop").when(token == "!", "not").when(token == "(", "open").when(token == ")", "close")
            .when(token.startswith('"'), "string").when(token.isin(*FUNCTIONS.keys()), "func").otherwise("name"))


def target_of(word: Column) -> Column:
    """The id that a word of a condition refers to: without a leading ``^`` and a ``/yes``, ``/no`` or ``/value`` at its end."""
    plain = F.when(word.startswith("^"), F.substring(word, F.lit(2), F.length(word))).otherwise(word)

    def cut(w: Column) -> Column:
        out = F
        for end in ("/yes", "/no", "/value"):
            out = out.when(w.endswith(end), F.substring(w, F.lit(1), F.length(w) - len(end)))
        # an end before a last line break counts as well
        return out.when(w.contains("/"), F.regexp_replace(w, r"(/yes|/no|/value)$", "")).otherwise(w)

    return let(plain, cut)


def condition_errors(items: DataFrame, cond_col: str = "cond",
                     keys: tuple[str, ...] = ("template_id", "item_id")) -> DataFrame:
    """Invalid conditions with a reason: ``(*keys, cond, pos, reason)``.

    Findings are a function of the condition's text (``condition_findings``), so no row leaves its place.
    """
    conds = items.where(F.coalesce(F.trim(F.col(cond_col)), F.lit("")) != "").select(*keys, F.col(cond_col).alias("cond"))
    return conds.select(*keys, "cond", F.inline(condition_findings(F.col("cond"))))


def condition_findings(cond: Column) -> Column:
    """array<struct(pos, reason)>: what is wrong with a condition, by token; none for an empty or valid one.

    Residual characters not covered by a token, unbalanced brackets and illegal neighbours are found
    among the condition's tokens. What is invalid is decided by ``programs.condition_program``: whatever
    else it rejects is reported with its reason, once.
    """
    from formlake.functions.programs import program_of_tokens, well_formed

    none = F.array().cast("array<struct<pos:int,reason:string>>")
    found = let(F.regexp_extract_all(cond, F.lit(TOKEN_PATTERN), F.lit(0)),
                lambda tokens: _findings_of_tokens(cond, tokens, program_of_tokens(cond, tokens)["reason"]))
    return F.when(cond.isNull() | well_formed(cond), none).otherwise(found)


def _findings_of_tokens(cond: Column, tokens: Column, why: Column) -> Column:
    """``condition_findings`` of a condition whose tokens, and the reason why it has no program, are known."""
    from formlake.functions.programs import STRAY, has_strays

    kinds = F.transform(tokens, token_kind)
    delta = lambda k: F.when(k == "open", 1).when(k == "close", -1).otherwise(0)
    depths = lambda ks: F.aggregate(ks, F.array().cast("array<int>"), lambda a, k: F.concat(
        a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + delta(k))))
    operand = ["name", "string", "func", "close"]

    def reason(kind, prev, following, depth, final_depth):
        return (F.when(depth < 0, "unbalanced ')'")
                .when(following.isNull() & (final_depth != 0), "unbalanced '('")
                .when(kind.isin("name", "string") & prev.isin(*operand), "missing operator")
                .when((kind == "func") & prev.isin(*operand), "missing operator")
                .when((kind == "open") & prev.isin("name", "string", "close"), "group after operand")
                .when((kind == "binop") & (prev.isNull() | prev.isin("binop", "not", "open")), "operator without left operand")
                .when((kind == "close") & prev.isin("binop", "not"), "operator without right operand")
                .when((kind == "binop") & following.isNull(), "operator without right operand")
                .when((kind == "not") & following.isin("not", "func", "binop", "close"), "'!' must precede an operand or a group")
                .when((kind == "not") & following.isNull(), "'!' must precede an operand or a group")
                .when((kind == "func") & ~F.coalesce(following == "open", F.lit(False)), "function without arguments"))

    def finding(pos, text):
        return F.struct(pos.cast("int").alias("pos"), text.cast("string").alias("reason"))

    def at_tokens(ks):
        found = let(depths(ks), lambda ds: F.transform(ks, lambda k, i: finding(i, reason(
            k, F.get(ks, i - 1), F.get(ks, i + 1), F.get(ds, i), F.try_element_at(ds, F.lit(-1))))))
        return F.filter(found, lambda f: f["reason"].isNotNull())

    none = F.array().cast("array<struct<pos:int,reason:string>>")
    whole = F.filter(F.array(finding(F.lit(0), why)), lambda f: f["reason"] != STRAY)
    neighbours = let(kinds, lambda ks: let(at_tokens(ks), lambda found: F.when((F.size(found) > 0) | (F.size(ks) == 0), found).otherwise(whole)))
    stray = F.when(has_strays(cond, tokens), F.array(finding(F.lit(None), F.lit(STRAY)))).otherwise(none)
    return F.when(F.coalesce(F.trim(cond), F.lit("")) == "", none).otherwise(F.concat(neighbours, stray))


# ---------------------------------------------------------------------------
# Compiler (driver side, one template at a time).
# ---------------------------------------------------------------------------
def tokenize(expr: str | None) -> list[str]:
    """Flat token list of one condition (the same regex as the Spark job)."""
    expr = expr or ""
    tokens = re.findall(TOKEN_PATTERN, expr)
    if re.sub(TOKEN_PATTERN, "", expr).strip():
        raise InvalidExpressionError(f"Invalid expression: {expr!r}")
    return tokens


def _nest(tokens: list[str], expr: str):
    """Group the flat tokens by brackets into nested lists."""
    stack: list[list] = [[]]
    for tok in tokens:
        if tok == "(":
            stack.append([])
        elif tok == ")":
            if len(stack) == 1:
                raise InvalidExpressionError(f"Invalid expression (unbalanced ')'): {expr!r}")
            group = stack.pop()
            stack[-1].append(group)
        else:
            stack[-1].append(tok)
    if len(stack) != 1:
        raise InvalidExpressionError(f"Invalid expression (unbalanced '('): {expr!r}")
    return stack[0]


def unescape_string(token: str) -> str:
    """Strip the outer quotes and backslash escapes of a string literal."""
    return re.sub(r'\\(.)|^"|"$', lambda m: m.group(1) or "", token)


class Resolver:
    """Maps a name of the condition language to Columns (see ``TemplateCompiler``)."""

    def boolean(self, name: str) -> Column:  # pragma: no cover - interface
        raise NotImplementedError

    def value(self, name: str) -> Column | None:  # pragma: no cover - interface
        """String Column for ``x/value`` references, else None."""
        raise NotImplementedError


def compile_tokens(tokens: list[str], resolver: Resolver, expr: str = "") -> Column:
    """Compile one tokenized condition into a boolean Column."""
    if not tokens:
        return F.lit(True)
    return _compile_group(_nest(tokens, expr), resolver, expr)


def compile_condition(expr: str | None, resolver: Resolver) -> Column:
    return compile_tokens(tokenize(expr), resolver, expr or "")


def _operand(el, resolver: Resolver, expr: str) -> Column:
    """Boolean Column of one operand (name, string literal or bracketed group)."""
    if isinstance(el, list):
        return _compile_group(el, resolver, expr)
    if el.startswith('"'):
        return F.lit(unescape_string(el) != "")
    if el in ("!", "&&", "||", ",") or el in FUNCTIONS:  # noqa: SIM114
        raise InvalidExpressionError(f"Invalid expression: {expr!r}")
    return resolver.boolean(el)


def _argument(el, resolver: Resolver, expr: str) -> Column:
    """String Column of a function argument."""
    if isinstance(el, list):
        raise InvalidExpressionError(f"Invalid expression (nested group as argument): {expr!r}")
    if el.startswith('"'):
        return F.lit(unescape_string(el))
    v = resolver.value(el)
    if v is None:
        raise InvalidExpressionError(f"Invalid expression (argument {el!r} is not a string): {expr!r}")
    return v


def _compile_group(group: list, resolver: Resolver, expr: str) -> Column:
    # Pass 1: operands, negation and function calls become boolean Columns.
    terms: list = []
    i = 0
    while i < len(group):
        el = group[i]
        if el == "!":
            nxt = group[i + 1] if i + 1 < len(group) else None
            if nxt is None or (isinstance(nxt, str) and (nxt == "!" or nxt in FUNCTIONS or nxt in BINARY_OPS)):
                raise InvalidExpressionError(f"Invalid expression ('!' position): {expr!r}")
            terms.append(~_operand(group[i + 1], resolver, expr))
            i += 2
        elif isinstance(el, str) and el in FUNCTIONS:
            if i + 1 >= len(group) or not isinstance(group[i + 1], list):
                raise InvalidExpressionError(f"Invalid expression (call without arguments): {expr!r}")
            raw_args = [[]]
            for a in group[i + 1]:
                if a == ",":
                    raw_args.append([])
                else:
                    raw_args[-1].append(a)
            if any(len(a) != 1 for a in raw_args):
                raise InvalidExpressionError(f"Invalid expression (bad arguments): {expr!r}")
            given = [_argument(a[0], resolver, expr) for a in raw_args]
            try:
                inspect.signature(FUNCTIONS[el]).bind(*given)
            except TypeError:
                raise InvalidExpressionError(f"Invalid expression (number of arguments): {expr!r}") from None
            terms.append(FUNCTIONS[el](*given))
            i += 2
        elif isinstance(el, str) and el in BINARY_OPS:
            terms.append(el)
            i += 1
        else:
            terms.append(_operand(el, resolver, expr))
            i += 1
    # Pass 2: operand (op operand)* folded left to right, equal precedence.
    if not terms or isinstance(terms[0], str):
        raise InvalidExpressionError(f"Invalid expression: {expr!r}")
    result = terms[0]
    j = 1
    while j < len(terms):
        op = terms[j]
        if not isinstance(op, str) or j + 1 >= len(terms) or isinstance(terms[j + 1], str):
            raise InvalidExpressionError(f"Invalid expression: {expr!r}")
        if op == ",":
            raise InvalidExpressionError(f"Invalid expression (',' outside a call): {expr!r}")
        rhs = terms[j + 1]
        result = (result & rhs) if op == "&&" else (result | rhs)
        j += 2
    return result


def references(expr: str | None) -> list[str]:
    """Names an expression refers to (no strings, operators or function names)."""
    out = []
    for t in tokenize(expr):
        if t in ("(", ")", "!", "&&", "||", ",") or t.startswith('"') or t in FUNCTIONS:
            continue
        out.append(t)
    return out


def reference_target(name: str) -> str:
    """Item id behind a reference: leading ``^`` and trailing /yes, /no, /value removed."""
    return re.sub(r"(/yes|/no|/value)$", "", re.sub(r"^\^", "", name))
