"""Every table a statement refers to, and every function, from its parsed plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from halyard.errors import invalid
from halyard.guard.lexer import tokens

# fixed values: plan nodes that a read may be made of; all else is refused
READS = set(
    """Project Filter Sort GlobalLimit LocalLimit Offset Aggregate Distinct Join Union Intersect Except SubqueryAlias LateralJoin
    Window WithWindowDefinition UnresolvedHaving UnresolvedRelation UnresolvedWith UnresolvedInlineTable LocalRelation OneRowRelation
    UnresolvedTableValuedFunction UnresolvedSubqueryColumnAliases Sample Pivot UnresolvedPivot Unpivot UnresolvedHint Generate
    WithCTE Expand Deduplicate Tail UnresolvedOrdinal AsOfJoin UnresolvedTVFAliases UnionLoop UnionLoopRef ResolvedInlineTable Range
    Repartition RepartitionByExpression RebalancePartitions UnresolvedQualify""".split()
)
# fixed values: functions that reach beyond the data
FORBIDDEN = set(
    """java_method reflect try_reflect input_file_name input_file_block_start input_file_block_length
    current_user session_user user version spark_partition_id assert_true raise_error read_files pg_sleep sleep""".split()
)


@dataclass(frozen=True)
class TableRef:
    parts: tuple[str, ...]

    @property
    def name(self) -> str:
        return ".".join(self.parts)


def _seq(x) -> list:
    return [x.apply(i) for i in range(x.size())]


class _Walk:
    def __init__(self) -> None:
        self.tables: dict[TableRef, None] = {}
        self.functions: set[str] = set()
        self.bad: str | None = None

    def plan(self, p, known: frozenset[str]) -> None:
        name = p.getClass().getSimpleName()
        if name == "UnresolvedWith":
            # a CTE is known to those after it and to the body; to itself only if recursive
            recursive = bool(p.allowRecursion())
            for pair in _seq(p.cteRelations()):
                cte = pair._1()
                self.plan(pair._2(), known | {cte.lower()} if recursive else known)
                known = known | {cte.lower()}
            self.plan(p.child(), known)
            return
        if name not in READS:
            self.bad = self.bad or name
            return
        if name == "UnresolvedRelation":
            parts = tuple(_seq(p.multipartIdentifier()))
            if not (len(parts) == 1 and parts[0].lower() in known):
                self.tables[TableRef(parts)] = None
        if name == "UnresolvedTableValuedFunction":
            self.functions.add(".".join(_seq(p.name())).lower())
        for e in _seq(p.expressions()):
            self.expression(e, known)
        for c in _seq(p.children()):
            self.plan(c, known)
        if name == "UnresolvedSubqueryColumnAliases" or name == "SubqueryAlias":
            return
        for c in _seq(p.innerChildren()):
            if c.getClass().getName().startswith("org.apache.spark.sql.catalyst.plans"):
                self.plan(c, known)

    def expression(self, e, known: frozenset[str]) -> None:
        name = e.getClass().getSimpleName()
        if name == "UnresolvedFunction":
            self.functions.add(".".join(_seq(e.nameParts())).lower())
        if hasattr(e, "plan") and name in {"ScalarSubquery", "Exists", "ListQuery", "InSubquery", "LateralSubquery", "ArraySubquery", "FunctionTableSubqueryArgumentExpression"}:
            inner = e.query() if name == "InSubquery" else e
            self.plan(inner.plan(), known)
        for c in _seq(e.children()):
            self.expression(c, known)


def inspect(spark: SparkSession, sql: str) -> list[TableRef]:
    """The tables of one read in the order they stand in the text. EngineError if
    it doesn't parse, isn't only a read, or calls a forbidden function."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:  # the JVM's parse error
        text = str(getattr(e, "java_exception", e)).strip().splitlines()
        text = next((x for x in text if x.strip()), "syntax error")
        raise invalid("syntax_error", text[:300], error=text[:300]) from None
    w = _Walk()
    w.plan(plan, frozenset())
    if w.bad:
        raise invalid("non_select", "only SELECT is allowed", stmt=w.bad)
    bad = sorted(f for f in w.functions if f.split(".")[-1] in FORBIDDEN)
    if bad:
        raise invalid("forbidden_function", f"{bad[0]} isn't allowed", function=bad[0])
    first: dict[str, int] = {}
    for t in tokens(sql):
        if t.kind in {"word", "quoted"}:
            first.setdefault(t.text.strip('`"').lower(), t.at)
    return sorted(w.tables, key=lambda t: (first.get(t.parts[-1].lower(), len(sql)), t.name))
