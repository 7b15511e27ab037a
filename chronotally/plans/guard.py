"""What may be asked in SQL: one statement that reads the engine's own tables, by an allow-list over the parsed plan.

The text is parsed by Spark, not analysed, and every node of the plan, subqueries and common table expressions included, must be of a
kind that only reads; relations are the engine's tables or names that the statement itself defines; functions are built-in ones of
groups that compute from their arguments. Everything else is refused: files as tables, scripts, reflection, variables, identifiers made from text, commands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession

from .statements import StatementError

# fixed values
MAX_BYTES, MAX_TOKENS, MAX_OPERATORS, MAX_SELECTS = 512 * 1024, 100_000, 400, 100
#: Plan nodes that read or combine rows.
NODES = frozenset("""
Project Filter Aggregate Join LateralJoin AsOfJoin Union Intersect Except Distinct Deduplicate Sort GlobalLimit LocalLimit Offset Tail
SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedRelation UnresolvedInlineTable ResolvedInlineTable OneRowRelation LocalRelation Range
UnresolvedWith UnresolvedHaving Pivot Unpivot Generate WithWindowDefinition Window Expand Sample UnresolvedTableValuedFunction UnresolvedTVFAliases
UnresolvedHint
""".split())
#: Groups of built-in functions whose results depend on their arguments alone, or on the clock.
GROUPS = frozenset("agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs date_funcs datetime_funcs generator_funcs hash_funcs json_funcs lambda_funcs map_funcs math_funcs predicate_funcs string_funcs struct_funcs table_funcs url_funcs variant_funcs window_funcs".split())
#: Functions of other groups that are harmless too.
FUNCTIONS = frozenset("typeof equal_null uuid rand randn random".split())
#: Table functions.
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple".split())
#: Expressions of the parser whose meaning isn't fixed by the text.
REFUSED = frozenset("ExpressionWithUnresolvedIdentifier VariableReference UnresolvedVariable CallMethodViaReflection TryReflect NamedParameter PosParameter NamedArgumentExpression FunctionTableSubqueryArgumentExpression".split())


class GuardError(StatementError):
    pass


def bare(text: str) -> str:
    """SQL without comments and with empty literals."""
    return re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`", "''", re.sub(r"--[^\n]*|/\*.*?\*/", " ", text, flags=re.S))


def check_size(text: str) -> None:
    if len(text.encode()) > MAX_BYTES:
        raise GuardError("the statement is too large")
    plain = bare(text)
    if len(re.findall(r"\w+|[^\w\s]", plain)) > MAX_TOKENS:
        raise GuardError("the statement has too many tokens")
    if len(re.findall(r"\b(?:and|or|union|intersect|except|join|not)\b|\|\||[-+*/%]", plain, re.I)) > MAX_OPERATORS:
        raise GuardError("the statement has too many operators")
    if len(re.findall(r"\b(?:select|values)\b", plain, re.I)) > MAX_SELECTS:
        raise GuardError("the statement has too many selects")


def _each(seq: JavaObject) -> Iterator[JavaObject]:
    at = seq.iterator()
    while at.hasNext():
        yield at.next()


def _kind(node: JavaObject) -> str:
    return node.getClass().getSimpleName().rstrip("$")


class ReadOnly:
    """Checks statements of one session against ``tables``."""

    def __init__(self, spark: SparkSession, tables: tuple[str, ...]):
        self.state = spark._jsparkSession.sessionState()
        self.registry = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
        self.identifier = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier
        self.tables = frozenset(tables)

    def statement(self, text: str) -> set[str]:
        """The engine's tables that one reading statement names; raises for any other."""
        plain = bare(text).strip().rstrip(";")
        if ";" in plain:
            raise GuardError("one statement at a time")
        self._no_variables(text)
        if not re.match(r"\(*\s*(select|with|values|from|table)\b", plain, re.I):
            raise GuardError("only statements that read are allowed")
        try:
            plan = self.state.sqlParser().parsePlan(text.strip().rstrip(";"))
        except Exception as error:  # noqa: BLE001 - the parser's own error, of a Java class
            raise StatementError(f"the statement doesn't parse: {str(error).splitlines()[0]}") from error
        used: set[str] = set()
        self._plan(plan, frozenset(), used)
        return used

    def expression(self, text: str) -> None:
        """One expression over the columns at hand, without a subquery."""
        self._no_variables(text)
        try:
            parsed = self.state.sqlParser().parseExpression(text)
        except Exception as error:  # noqa: BLE001
            raise StatementError(f"the expression doesn't parse: {str(error).splitlines()[0]}") from error
        self._expression(parsed, None, set())

    def _no_variables(self, text: str) -> None:
        if "${" in text:  # the parser would put settings and the environment in their place
            raise GuardError("variables are not allowed")

    def _plan(self, node: JavaObject, defined: frozenset[str], used: set[str]) -> None:
        kind = _kind(node)
        if kind not in NODES:
            raise GuardError(f"only statements that read are allowed ({kind})")
        if kind == "UnresolvedWith":
            for relation in _each(node.cteRelations()):
                name, alias = str(relation._1()), relation._2()
                own = defined | {name.lower()} if node.allowRecursion() else defined
                self._plan(alias, own, used)
                defined = defined | {name.lower()}
        elif kind == "UnresolvedRelation":
            parts = [str(p) for p in _each(node.multipartIdentifier())]
            name = parts[0].lower()
            if len(parts) > 1 or name not in defined | self.tables:
                raise GuardError(f"unknown table {'.'.join(parts)}")
            if name not in defined:
                used.add(name)
        elif kind == "UnresolvedTableValuedFunction":
            parts = [str(p) for p in _each(node.name())]
            if len(parts) > 1 or parts[0].lower() not in TABLE_FUNCTIONS:
                raise GuardError(f"the table function {'.'.join(parts)} is not allowed")
        for expression in _each(node.expressions()):
            self._expression(expression, defined, used)
        if kind == "Generate":
            self._expression(node.generator(), defined, used)
        if kind == "LateralJoin":
            self._expression(node.right(), defined, used)
        for child in _each(node.children()):
            self._plan(child, defined, used)

    def _expression(self, node: JavaObject, defined: frozenset[str] | None, used: set[str]) -> None:
        kind = _kind(node)
        if kind in REFUSED:
            raise GuardError(f"{kind} is not allowed")
        if kind == "UnresolvedFunction":
            self._function([str(p) for p in _each(node.nameParts())])
        elif kind == "UnresolvedGenerator":
            self._function([str(node.name().funcName())])
        elif hasattr(node, "plan") and kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "InSubquery"):
            if defined is None:
                raise StatementError("a subquery is not allowed here")
            if kind != "InSubquery":
                self._plan(node.plan(), defined, used)
        elif kind == "UnresolvedWindowExpression":
            pass
        for child in _each(node.children()):
            self._expression(child, defined, used)
        if kind == "InSubquery":
            self._expression(node.query(), defined, used)

    def _function(self, parts: list[str]) -> None:
        name = parts[-1].lower()
        if len(parts) == 1 and name in FUNCTIONS:
            return
        found = self.registry.lookupFunction(self.identifier(name))
        if len(parts) > 1 or found.isEmpty() or found.get().getGroup() not in GROUPS:
            raise GuardError(f"the function {'.'.join(parts)} is not allowed")
