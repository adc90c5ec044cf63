"""Statements that may read given views and nothing else.

The check is on plans, never on text. The parsed plan may hold only query nodes, functions of
known names and nothing that is named by an expression; the resolved plan, with its subqueries
and common tables, may end only in a given view or in rows the statement spells out itself. What
was checked is what runs: the rows come from the parsed plan, the text is not read again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

LOGICAL = "org.apache.spark.sql.catalyst.plans.logical."
ANALYSIS = "org.apache.spark.sql.catalyst.analysis."
EXPRESSIONS = "org.apache.spark.sql.catalyst.expressions."

# Nodes that only pass on, combine or shape the rows below them.
SHAPING = {
    LOGICAL + name
    for name in (
        "Aggregate", "CTERelationDef", "Deduplicate", "Distinct", "Except", "Expand", "Filter", "Generate",
        "GlobalLimit", "Intersect", "Join", "LateralJoin", "LocalLimit", "Offset", "Pivot",
        "Project", "Repartition", "RebalancePartitions", "RepartitionByExpression", "ResolvedHint", "Sample", "Sort",
        "SubqueryAlias", "Union", "UnionLoop", "UnresolvedHint", "Unpivot", "Window", "WithCTE", "WithWindowDefinition",
    )
}
SHAPING |= {EXPRESSIONS + "PipeOperator"}
# Rows written out in the statement, and references to its own common tables.
OWN_ROWS = {LOGICAL + name for name in ("CTERelationRef", "LocalRelation", "OneRowRelation", "Range", "UnionLoopRef")}
OWN_ROWS |= {f"{LOGICAL}OneRowRelation$"}
UNRESOLVED_NODES = {
    ANALYSIS + name
    for name in (
        "UnresolvedHaving", "UnresolvedInlineTable", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases",
        "UnresolvedTVFAliases", "UnresolvedTableValuedFunction",
    )
}
UNRESOLVED_NODES |= {LOGICAL + "UnresolvedWith"}
UNRESOLVED_EXPRESSIONS = {
    ANALYSIS + name
    for name in (
        "UnresolvedAlias", "UnresolvedAttribute", "UnresolvedExtractValue", "UnresolvedFunction", "UnresolvedGenerator",
        "UnresolvedInlineTable", "UnresolvedOrdinal", "UnresolvedRegex", "UnresolvedStar", "UnresolvedStarExcept",
        "UnresolvedStarExceptOrReplace", "UnresolvedStarWithColumns",
    )
}
# Of the functions that Spark files under "misc", those that depend on their arguments alone.
HARMLESS = {"assert_true", "raise_error", "typeof", "bitmap_bit_position", "bitmap_bucket_number", "bitmap_count", "hll_sketch_estimate", "hll_union"}
TABLE_FUNCTIONS = {
    "explode", "explode_outer", "inline", "inline_outer", "json_tuple", "posexplode", "posexplode_outer", "range", "stack",
}
# What a session's own SQL function becomes; its body is walked like any other expression.
OWN_FUNCTION = ANALYSIS + "SQLScalarFunction"
REFUSED_GROUPS = {"misc_funcs", "", None}


class RefusedStatement(ValueError):
    """The statement is not a query over the views it may read."""


def _plain_function(own: SparkSession, name: str) -> bool:
    """Whether a built-in function may be used, by its group: none that reflects, reads files or
    tells of the session."""
    if name in HARMLESS:
        return True
    identifier = own.sparkContext._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name)
    info = own._jsparkSession.sessionState().functionRegistry().lookupFunction(identifier)
    if not info.isDefined():
        return False
    found = info.get()
    return found.getClassName().startswith(EXPRESSIONS) and found.getGroup() not in REFUSED_GROUPS


def _each(items) -> Iterator:
    return (items.apply(i) for i in range(items.size()))


def _kind(node) -> str:
    name = node.getClass().getName()
    return name if name in OWN_ROWS else name.removesuffix("$")


class _Walk:
    """Every node and expression of a plan, those of subqueries and common tables included."""

    def __init__(self, own: SparkSession, views: Iterable[str], functions: Iterable[str] = ()):
        self.own, self.views, self.functions = own, {v.lower() for v in views}, {f.lower() for f in functions}
        java_class = own.sparkContext._jvm.java.lang.Class
        self.plan_expression = java_class.forName(EXPRESSIONS + "PlanExpression")
        self.query_plan = java_class.forName("org.apache.spark.sql.catalyst.plans.QueryPlan")

    def run(self, plan) -> None:
        pending = [plan]
        while pending:
            node = pending.pop()
            if self.node(node):
                continue
            pending += [*_each(node.children()), *(n for n in _each(node.innerChildren()) if self.query_plan.isInstance(n))]
            expressions = list(_each(node.expressions()))
            while expressions:
                expression = expressions.pop()
                self.expression(expression)
                expressions += _each(expression.children())
                if self.plan_expression.isInstance(expression):
                    pending.append(expression.plan())

    def node(self, node) -> bool:
        """Refuse the node, or say whether the walk ends there."""
        raise NotImplementedError

    def expression(self, expression) -> None:
        raise NotImplementedError


class _Parsed(_Walk):
    def node(self, node) -> bool:
        kind = _kind(node)
        if kind not in SHAPING | OWN_ROWS | UNRESOLVED_NODES:
            raise RefusedStatement(f"only queries are allowed, not {kind.rpartition('.')[2]}")
        if kind.endswith("UnresolvedTableValuedFunction"):
            self.known(list(_each(node.name())), TABLE_FUNCTIONS.__contains__)
        return False

    def expression(self, expression) -> None:
        kind = _kind(expression)
        if kind.endswith(".UnresolvedFunction"):
            self.known(list(_each(expression.nameParts())), self.function)
        elif kind.endswith(".UnresolvedGenerator"):
            name = expression.name()
            self.known([name.funcName(), *([name.database().get()] if name.database().isDefined() else [])], self.function)
        elif kind not in UNRESOLVED_EXPRESSIONS and (
            not kind.startswith(EXPRESSIONS) or kind.startswith(EXPRESSIONS + "objects.") or "Reflect" in kind
        ):
            raise RefusedStatement(f"expression not allowed: {kind.rpartition('.')[2]}")

    def function(self, name: str) -> bool:
        return name in self.functions or _plain_function(self.own, name)

    def known(self, parts: list[str], allowed: Callable[[str], bool]) -> None:
        if len(parts) != 1 or not allowed(parts[0].lower()):
            raise RefusedStatement(f"function not allowed: {'.'.join(parts)}")


class _Resolved(_Walk):
    def node(self, node) -> bool:
        kind = _kind(node)
        if kind == LOGICAL + "View":
            name = node.desc().identifier()
            if not node.isTempView() or name.database().isDefined() or name.table().lower() not in self.views:
                raise RefusedStatement(f"relation not allowed: {name.unquotedString()}")
            return True
        if kind not in SHAPING | OWN_ROWS:
            raise RefusedStatement(f"relation not allowed: {kind.rpartition('.')[2]}")
        return False

    def expression(self, expression) -> None:
        kind = _kind(expression)
        if not kind.startswith(EXPRESSIONS) and kind != OWN_FUNCTION or "Reflect" in kind:
            raise RefusedStatement(f"expression not allowed: {kind.rpartition('.')[2]}")


def guarded(own: SparkSession, sql: str, views: Iterable[str], functions: Iterable[str] = ()) -> DataFrame:
    """The rows of a query over ``views``, temporary views of the session ``own``.

    ``functions`` are further functions that the session defines. Anything else is refused.
    """
    views = list(views)
    parsed = own._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    _Parsed(own, views, functions).run(parsed)
    dataset = own.sparkContext._jvm.org.apache.spark.sql.classic.Dataset
    try:
        rows = dataset.ofRows(own._jsparkSession, parsed)
    except AnalysisException as e:
        if "NOT_FOUND" in (e.getCondition() or ""):
            raise RefusedStatement(f"unknown relation: {e.getMessageParameters()}") from None
        raise
    _Resolved(own, views).run(rows.queryExecution().analyzed())
    return DataFrame(rows, own)
