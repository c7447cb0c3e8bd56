"""What the guard refuses and what it finds."""

from __future__ import annotations

import random
import threading

import pytest

from halyard.config import Config, Route, find_route, parse_routes, timeout_ms
from halyard.errors import EngineError
from halyard.guard.authorize import AccessList, authorize
from halyard.guard.dialect import rewrite
from halyard.guard.gate import Gate
from halyard.guard.lexer import single, statements
from halyard.guard.plan import TableRef, inspect

ROUTE = Route("db", "svc", "/nowhere")

#: Statements of Spark's grammar that aren't queries, by what they are for.
COMMANDS = {
    "rows": ["insert overwrite events select * from events", "insert into lineitem table lineitem", "merge into part p using supplier s on p_partkey = s_suppkey when not matched then insert *", "update customer set c_acctbal = 0", "delete from region", "load data inpath '/x' into table part", "truncate table nation partition (n = 1)"],
    "definitions": ["create or replace temporary view v as select * from part", "create function f as 'a.B'", "create namespace n", "drop view if exists v", "alter table part rename to q", "alter view v as select 1", "comment on table part is 'x'", "msck repair table part", "replace table q as select 1"],
    "session": ["use other", "set spark.sql.ansi.enabled = false", "set time zone 'UTC'", "reset", "add jar '/x.jar'", "list files", "cache lazy table part", "uncache table part", "clear cache", "refresh table part"],
    "looking around": ["show tables", "describe extended part", "desc part", "explain formatted select * from part", "analyze table part compute statistics"],
    "other dialects": ["call p()", "lock table part", "listen x", "rollback", "savepoint s", "prepare q as select 1", "discard all"],
    "queries that write": ["from lineitem insert into part select *", "map l_orderkey using 'cat' as x from lineitem"],
}


def spellings(sql: str) -> list[str]:
    """The same statement in other letter case, between comments and blanks."""
    return [sql, sql.upper(), f"\n\t{sql} ;", f"-- select 1\n{sql}", f"/* select /* 1 */ ; */ {sql}"]


@pytest.mark.parametrize("family", COMMANDS)
def test_commands_are_refused(family):
    for sql in COMMANDS[family]:
        for text in spellings(sql):
            with pytest.raises(EngineError) as e:
                single(text)
            assert e.value.reason == "non_select", text
            assert e.value.to_dict()["code"] == 400
        # a read beside it doesn't help, on either side
        for text in (f"select 1; {sql}", f"{sql}; select 1"):
            with pytest.raises(EngineError) as e:
                single(text)
            assert e.value.reason == "non_select", text


#: Places in a query over lineitem that a clause may hide in; {} stands for it.
PLACES = ["{}", "({})", "select * from ({}) s", "select * from customer where c_custkey in ({})", "with a as (select 1 as x), b as ({}) select * from b"]


@pytest.mark.parametrize("place", PLACES)
def test_locks_and_targets_are_refused(place):
    strengths = [" ".join(w) for w in (("update",), ("share",), ("key", "share"), ("no", "key", "update"))]
    clauses = [f"for {s}{tail}" for s in strengths for tail in ("", " of l", " skip locked", " nowait")]
    for text in [f"select l_orderkey from lineitem l limit 3 {c}" for c in clauses] + ["select l_orderkey into kept from lineitem", "select distinct l_tax into temporary kept from lineitem"]:
        for t in spellings(place.format(text))[:2]:
            with pytest.raises(EngineError) as e:
                single(t)
            assert e.value.reason == "write_side_effect", t


@pytest.mark.parametrize("change", ["insert into region values (9, 'x', '')", "delete from part where p_size > 3 returning p_partkey", "update supplier set s_acctbal = s_acctbal + 1 returning *", "merge into nation using region on true when matched then delete"])
def test_changes_in_a_cte_are_refused(change):
    for outer in ("{} select count(*) from changed", "select * from ({} table changed) t", "with first as (select 1), second as ({} select 1) select * from second", "select (({} select max(1) from changed))"):
        for hint in ("", "materialized ", "not materialized "):
            with pytest.raises(EngineError) as e:
                single(outer.format(f"with changed as {hint}({change})"))
            assert e.value.reason == "data_modifying_cte"


@pytest.mark.parametrize("reason,texts", [("empty", ["", " \n", ";", ";;", "/* select 1 */", "--"]), ("multi_statement", ["values (1); table part", "select 1; select 1;"]), ("syntax_error", ["part", "'select 1'", "1 + 1", "select 1 /* /* */", "?"])])
def test_texts_without_one_statement(reason, texts):
    for text in texts:
        with pytest.raises(EngineError) as e:
            single(text)
        assert e.value.reason == reason, text


class Writer:
    """Writes a random query over the test tables and keeps account of the tables in
    it, in the order of their first mention, and of the names its CTEs hide."""

    TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

    def __init__(self, seed: int):
        self.random, self.mentioned, self.n = random.Random(seed), [], 0

    def name(self) -> str:
        self.n += 1
        return f"t{self.n}"

    def table(self, hidden: frozenset[str]) -> str:
        t = self.random.choice(self.TABLES)
        shown = self.random.choice([t, t, t.upper(), f"`{t}`", f"public.{t}"])
        ref = shown.strip("`")
        if "." in ref or t not in hidden:
            self.mentioned.append(ref)
        return shown

    def relation(self, deep: int, hidden: frozenset[str]) -> str:
        kind = self.random.randrange(8 if deep else 3)
        if kind < 3:
            return f"{self.table(hidden)} AS {self.name()}"
        if kind == 3:
            return f"({self.query(deep - 1, hidden)}) {self.name()}"
        if kind == 4:
            how = self.random.choice(["JOIN", "LEFT SEMI JOIN", "LEFT ANTI JOIN", "RIGHT OUTER JOIN", "FULL JOIN"])
            return f"{self.relation(deep - 1, hidden)} {how} ({self.query(deep - 1, hidden)}) {self.name()} ON 1 = 1"
        if kind == 5:
            return f"{self.relation(deep - 1, hidden)}, LATERAL ({self.query(deep - 1, hidden)}) {self.name()}"
        if kind == 6:
            return f"(VALUES (1), (2)) {self.name()}(c)"
        return f"range({self.random.randrange(9)}) {self.name()}"

    def value(self, deep: int, hidden: frozenset[str]) -> str:
        kind = self.random.randrange(6) if deep else 0
        if kind == 1:
            return f"({self.query(deep - 1, hidden)})"
        if kind == 2:
            return f"nullif({self.value(deep - 1, hidden)}, 'SELECT x FROM nowhere')"
        if kind == 3:
            return f"CASE WHEN {self.test(deep - 1, hidden)} THEN {self.value(deep - 1, hidden)} END"
        if kind == 4:
            return f"sum(1) OVER (PARTITION BY {self.value(deep - 1, hidden)})"
        return "count(*)"

    def test(self, deep: int, hidden: frozenset[str]) -> str:
        kind = self.random.randrange(4) if deep else 0
        if kind == 1:
            return f"NOT EXISTS ({self.query(deep - 1, hidden)})"
        if kind == 2:
            return f"1 NOT IN ({self.query(deep - 1, hidden)})"
        if kind == 3:
            return f"({self.test(deep - 1, hidden)} OR {self.test(deep - 1, hidden)})"
        return "2 > 1 /* FROM nowhere */"

    def query(self, deep: int, hidden: frozenset[str] = frozenset()) -> str:
        if deep and self.random.random() < 0.25:  # a CTE, now and then under a table's own name
            cte = self.random.choice([self.name(), self.random.choice(self.TABLES)])
            body = self.query(deep - 1, hidden)
            return f"WITH {cte} AS ({body}) SELECT count(*) FROM ({self.query(deep - 1, hidden | {cte})}) {self.name()}"
        if deep and self.random.random() < 0.2:
            how = self.random.choice(["UNION", "UNION ALL", "EXCEPT", "MINUS ALL", "INTERSECT ALL"])
            return f"({self.query(deep - 1, hidden)}) {how} ({self.query(deep - 1, hidden)})"
        # the parts are written in the order they stand in the text
        text = f"SELECT {self.value(deep, hidden)} FROM {self.relation(deep, hidden)}"
        if self.random.random() < 0.5:
            text += f" WHERE {self.test(deep, hidden)}"
        if self.random.random() < 0.3:
            text += f" HAVING {self.test(deep, hidden)}"
        return text


def test_tables_of_random_queries(spark):
    """Whatever the nesting, exactly the tables that are mentioned are found, and in
    order where each name is written one way and names no CTE."""
    seen = 0
    for seed in range(80):
        w = Writer(seed)
        sql = w.query(3)
        single(sql)
        found = [t.name for t in inspect(spark, rewrite(sql))]
        want = list(dict.fromkeys(w.mentioned))
        assert sorted(found) == sorted(want), sql
        if len({n.split(".")[-1].lower() for n in want}) == len(want) and "WITH" not in sql:
            assert found == want, sql
        seen += len(want)
    assert seen > 100


#: What Spark has besides, over the test tables: the tables that each text reads.
ONLY_IN_SPARK = [
    ("lineitem", "SELECT * FROM lineitem PIVOT (sum(l_quantity) FOR l_returnflag IN ('A', 'N', 'R'))"),
    ("part", "SELECT * FROM part UNPIVOT (v FOR k IN (p_size, p_retailprice))"),
    ("events", "SELECT k, n FROM events LATERAL VIEW OUTER explode(split(event_type, '_')) w AS k LATERAL VIEW posexplode(array(1)) AS m, n"),
    ("customer orders", "SELECT o_custkey, rank() OVER (PARTITION BY o_custkey ORDER BY (SELECT min(c_acctbal) FROM customer)) FROM orders"),
    ("supplier nation region", "SELECT s_name FROM supplier ORDER BY (SELECT count(*) FROM nation WHERE n_regionkey > (SELECT avg(r_regionkey) FROM region))"),
    ("lineitem", "SELECT * FROM lineitem TABLESAMPLE (25 PERCENT) REPEATABLE (7)"),
    ("lineitem", "SELECT count(*) FROM lineitem TABLESAMPLE BERNOULLI (25)"),
    ("events", "SELECT /*+ REPARTITION(3, user_id) */ window.start FROM events GROUP BY window(ts, '1 hour')"),
    ("nation", "SELECT n_name FROM ONLY nation"),
    ("nation", "TABLE nation"),
    ("customer", "WITH c AS NOT MATERIALIZED (SELECT * FROM customer), d AS (TABLE c) SELECT * FROM d NATURAL JOIN c"),
    ("part", "WITH part AS (SELECT p_size FROM part) SELECT * FROM part"),
    ("later events", "WITH a AS (SELECT * FROM later), later AS (SELECT * FROM events) SELECT * FROM a, later"),
    ("", "WITH RECURSIVE up(x) AS (VALUES (1) UNION ALL SELECT 2 * x FROM up WHERE x < 99) SELECT max(x) FROM up"),
    ("", "SELECT explode(sequence(1, 5))"),
    ("csv./somewhere/part", "SELECT * FROM csv.`/somewhere/part`"),
    ("a.b.part", "SELECT * FROM a.b.part"),
]


@pytest.mark.parametrize("names,sql", ONLY_IN_SPARK)
def test_tables_of_other_forms(spark, names, sql):
    single(sql)
    assert [t.name for t in inspect(spark, rewrite(sql))] == names.split()


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT TRANSFORM (p_size) USING 'cat' AS (b) FROM part",
        "SELECT java_method('java.lang.System', 'exit', 0)",
        "SELECT reflect('java.lang.System', 'getenv', 'HOME')",
        "SELECT * FROM part WHERE p_size = (SELECT try_reflect('java.lang.System', 'nanoTime'))",
        "SELECT max(input_file_name()) FROM events",
    ],
)
def test_escapes(spark, sql):
    with pytest.raises(EngineError) as e:
        single(sql)
        inspect(spark, sql)
    assert e.value.reason in {"non_select", "forbidden_function"}


def test_words_in_strings_and_names_are_no_statements():
    for sql in ("SELECT 'DELETE FROM x; DROP' AS a", 'SELECT "update" FROM t', "SELECT a AS into_x, b -- ; DELETE\n FROM t", "SELECT deleted FROM t WHERE note = 'for update'", "SELECT replace(a, 'x', 'y') FROM t;", "(SELECT 1)"):
        single(sql)
    assert len(statements("SELECT 1;;; ")) == 1


def test_syntax_error_by_the_parser(spark):
    with pytest.raises(EngineError) as e:
        inspect(spark, "SELECT FROM WHERE x y z")
    assert e.value.reason == "syntax_error" and e.value.details["error"]


def test_rewrites(spark):
    def one(expr):
        return spark.sql(rewrite(f"SELECT {expr} AS x")).head().x

    assert one("1::text || 'a'") == "1a"
    assert str(one("'1.235'::numeric")) == "1.235000000000000000"
    assert one("7::int8") == 7
    assert one("ARRAY[1, 2]") == [1, 2]
    assert one("'abc' ~ '^a'") is True and one("'abc' !~ '^a'") is False
    assert spark.sql(rewrite("""SELECT j->>'k' AS x FROM (SELECT '{"k": "v"}' AS j) t""")).head().x == "v"
    assert spark.sql(rewrite("SELECT t.j->>'k' AS x FROM (SELECT '{\"k\": 5}' AS j) t FETCH FIRST 1 ROW ONLY")).head().x == "5"
    assert rewrite("SELECT 'a::text'") == "SELECT 'a::text'"
    assert rewrite("SELECT x::numeric(12,2)") == "SELECT x::numeric(12,2)"


def test_authorize():
    allow = lambda names: lambda t: t in names
    refs = [TableRef(("orders",)), TableRef(("public", "events"))]
    authorize(refs, ROUTE, allow({"svc.db.orders", "svc.db.events"}))
    with pytest.raises(EngineError) as e:
        authorize(refs, ROUTE, allow({"svc.db.orders"}))
    assert e.value.kind == "permission_denied" and e.value.reason == "not_granted" and e.value.details["table"] == "public.events"
    assert e.value.details["candidate_fqns"] == ["svc.db.events"]
    for parts in (("other", "orders"), ("a", "public", "orders"), ("parquet", "/x")):
        with pytest.raises(EngineError) as e:
            authorize([TableRef(parts)], ROUTE, lambda t: True)
        assert e.value.reason == "unknown_table"
    with pytest.raises(EngineError):
        authorize(refs, ROUTE, None)


def test_access_list_reloads_and_fails_closed():
    state = {"rev": 1, "pairs": [("u", "a.b.C")], "fail": False}

    def load():
        if state["fail"]:
            raise OSError
        return state["rev"], state["pairs"]

    acl = AccessList(load, lambda: state["rev"], every=0)
    assert acl.allows("u", "A.b.c") and not acl.allows("v", "a.b.c") and acl.revision == 1
    state.update(rev=2, pairs=[])
    assert not acl.allows("u", "a.b.c")
    state.update(rev=3, fail=True)
    assert not acl.allows("u", "a.b.c") and acl.revision == -1
    state.update(fail=False, pairs=[("u", "a.b.c")])
    assert acl.allows("u", "a.b.c")


def test_gate():
    g = Gate(2, 3)
    with g.slot("a"), g.slot("a"):
        with pytest.raises(EngineError) as e, g.slot("a"):
            pass
        assert e.value.reason == "key_concurrency_limit"
        with g.slot("b"):
            with pytest.raises(EngineError) as e, g.slot("c"):
                pass
            assert e.value.reason == "process_concurrency_limit"
    with g.slot("a"):
        pass
    most, now, lock = [0], [0], threading.Lock()

    def work():
        for _ in range(200):
            try:
                with g.slot(threading.current_thread().name):
                    with lock:
                        now[0] += 1
                        most[0] = max(most[0], now[0])
                    with lock:
                        now[0] -= 1
            except EngineError:
                pass

    ts = [threading.Thread(target=work) for _ in range(8)]
    [t.start() for t in ts]
    [t.join() for t in ts]
    assert most[0] <= 3 and not g._held


def test_config():
    assert [timeout_ms(x) for x in ("30s", "30000ms", "1min", "1h", "1d", "250", "1.5s")] == [30_000, 30_000, 60_000, 3_600_000, 86_400_000, 250, 1500]
    for bad in ("", "x", "5 weeks", "-1s"):
        with pytest.raises(ValueError):
            timeout_ms(bad)
    routes = parse_routes('[{"dbname": "a", "service": "s", "path": "/p"}, {"dbname": "b", "service": "s", "path": "/q"}]')
    assert find_route(routes, "b").path == "/q"
    for name, reason in ((None, "dbname_required"), ("c", "unknown_dbname")):
        with pytest.raises(EngineError) as e:
            find_route(routes, name)
        assert e.value.reason == reason
    assert find_route({"a": routes["a"]}, None).dbname == "a"
    for bad in ('[{"dbname": "a.b", "service": "s", "path": "/p"}]', '[{"dbname": "a", "service": "s"}]', '[{"dbname": "a", "service": "s", "path": "/p"}, {"dbname": "a", "service": "s", "path": "/p"}]'):
        with pytest.raises(ValueError):
            parse_routes(bad)
    c = Config.from_env({"HALYARD_ROW_CAP": "1000", "HALYARD_TIMEOUT_MS": "5s"})
    assert c.row_cap == 1000 and c.timeout_ms == 5000
    for cap in ("499", "5001"):
        with pytest.raises(ValueError):
            Config.from_env({"HALYARD_ROW_CAP": cap})
