"""The facade: six tools that callers use, and the contract around SQL."""

from __future__ import annotations

import itertools
import os
import threading
import time
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from halyard.config import ENUM_VALUES, FQN_CHARS, QUERY_CHARS, SEARCH_HITS, Config, Route, find_route
from halyard.errors import INTERNAL, EngineError, invalid, map_spark_error
from halyard.functions.encode import capped
from halyard.guard.authorize import AccessList, authorize
from halyard.guard.dialect import rewrite
from halyard.guard.gate import Gate
from halyard.guard.lexer import single, tokens
from halyard.guard.plan import TableRef, inspect
from halyard.records.log import CallLog, status_of
from halyard.semantic.graph import relation_summary, traverse
from halyard.semantic.metric import metric_sql
from halyard.semantic.search import SEARCHABLE, fuse, keyword_hits, live, vector_hits
from halyard.semantic.store import Store

STAGES = ("auth", "perm", "parse", "exec", "return")


@dataclass(frozen=True)
class Caller:
    user: str
    key: str


class Clock:
    """Milliseconds of the stages of one call; a stage not begun isn't there."""

    def __init__(self) -> None:
        self.ms: dict[str, int] = {}

    @contextmanager
    def stage(self, name: str):
        t = time.monotonic()
        try:
            yield
        finally:
            self.ms[name] = self.ms.get(name, 0) + int((time.monotonic() - t) * 1000)


class Engine:
    """All tools over one session, one configuration and one catalogue.

    embed turns query texts into vectors; without it, or if it fails, a search uses
    keywords alone."""

    def __init__(self, spark: SparkSession, config: Config, store: Store | None = None, embed: Callable[[Sequence[str]], Sequence[Sequence[float]]] | None = None, log: CallLog | None = None):
        self.spark, self.config, self.embed, self.log = spark, config, embed, log
        self.store = store
        self.gate = Gate(config.key_concurrency, config.process_concurrency)
        self.access = AccessList(self._grants, lambda: store.revision) if store is not None else None
        self._sessions: dict[str, SparkSession] = {}
        self._ids, self._lock = itertools.count(1), threading.Lock()

    def _grants(self) -> tuple[int, list[tuple[str, str]]]:
        n = self.store.revision
        return n, [(r.user_id, r.table_fqn) for r in self.store.read("grants").select("user_id", "table_fqn").distinct().toLocalIterator()]

    # SQL

    def execute_sql(self, caller: Caller, sql: str, dbname: str | None = None, plan_id: str | None = None) -> dict[str, Any]:
        """One read over granted tables: {columns, rows, meta}. At most row_cap rows,
        with meta.truncated if there were more."""
        return self._logged(caller, "execute_sql", {"sql": sql, "dbname": dbname}, plan_id, lambda c: self._sql(caller, sql, dbname, plan_id, c))

    def _sql(self, caller: Caller, sql: str, dbname: str | None, plan_id: str | None, clock: Clock) -> dict[str, Any]:
        if not self.config.routes:
            raise invalid("not_configured", "no database is configured")
        if not sql or not sql.strip():
            raise invalid("empty", "there is no statement")
        with self.gate.slot(caller.key):
            began = time.monotonic()
            route = find_route(self.config.routes, dbname)
            session, text, refs = self._checked(caller, sql, route, clock)
            self._views(session, route, refs)
            with clock.stage("exec"):
                columns, rows, cut = self._run(session, text)
            meta = {"row_count": len(rows), "truncated": cut, "dbname": route.dbname, "plan_id": plan_id, "elapsed_ms": int((time.monotonic() - began) * 1000)}
            return {"columns": columns, "rows": rows, "meta": meta}

    def _checked(self, caller: Caller, sql: str, route: Route, clock: Clock) -> tuple[SparkSession, str, list[TableRef]]:
        with clock.stage("parse"):
            ts = single(sql)
            text = rewrite(sql[ts[0].at : ts[-1].at + len(ts[-1].text)])
            session = self._session(route)
            refs = inspect(session, text)
        with clock.stage("perm"):
            authorize(refs, route, None if self.access is None else lambda t: self.access.allows(caller.user, t))
        return session, _unqualified(text, refs), refs

    def _session(self, route: Route) -> SparkSession:
        """Each database has its own views, so that equal table names don't meet."""
        with self._lock:
            if route.dbname not in self._sessions:
                self._sessions[route.dbname] = self.spark.newSession()
            return self._sessions[route.dbname]

    def _views(self, session: SparkSession, route: Route, refs: list[TableRef]) -> None:
        for name in {r.parts[-1].lower() for r in refs}:
            if not session.catalog._jcatalog.tableExists(name):
                try:
                    session.read.parquet(f"{route.path}/{name}.parquet").createOrReplaceTempView(name)
                except Exception as e:
                    raise map_spark_error(e) from None

    def _run(self, session: SparkSession, text: str):
        tag = f"halyard-{os.getpid()}-{next(self._ids)}"
        late = threading.Event()

        sc = self.spark.sparkContext

        def stop() -> None:
            late.set()
            sc.cancelJobsWithTag(tag)

        timer = threading.Timer(self.config.timeout_ms / 1000, stop)
        timer.daemon = True
        sc.addJobTag(tag)
        sc.setInterruptOnCancel(True)
        timer.start()
        try:
            return capped(session.sql(text), self.config.row_cap)
        except EngineError:
            raise
        except Exception as e:
            raise map_spark_error(e, late.is_set()) from None
        finally:
            timer.cancel()
            sc.removeJobTag(tag)

    # the catalogue

    def _need_store(self) -> Store:
        if self.store is None:
            raise invalid("not_configured", "no catalogue is configured")
        return self.store

    def search_entities(self, caller: Caller, query: str, type: str = "", plan_id: str | None = None) -> dict[str, Any]:
        return self._logged(caller, "search_entities", {"query": query, "type": type}, plan_id, lambda c: self._search(query, type))

    def _search(self, query: str, type: str) -> dict[str, Any]:
        _text(query, QUERY_CHARS, "query")
        if type not in {"", *SEARCHABLE}:
            raise invalid("bad_type", f"can't search for {type}", types=list(SEARCHABLE))
        store = self._need_store()
        kinds = [type] if type else list(SEARCHABLE)
        entities = live(store.read("entities"))
        kw = keyword_hits(entities, query, kinds)
        near = self.spark.createDataFrame([], "fqn string, distance double, vec_rank int")
        if self.embed is not None:
            try:
                q = self.embed([query])[0]
                mine = entities.where(F.col("kind").isin(kinds)).select("fqn")
                vectors = store.read("embeddings").select(F.col("entity_fqn").alias("fqn"), "vector").join(mine, "fqn", "left_semi")
                near = vector_hits(vectors, "fqn", "vector", q)
                near.schema  # noqa: B018
            except Exception:
                pass
        every = fuse(kw, near, "fqn", 10 * SEARCH_HITS).join(entities.select("fqn", "kind", "name", "description"), "fqn")
        rows = every.orderBy(F.desc("score"), F.asc_nulls_last("kw_rank"), F.asc_nulls_last("vec_rank"), "fqn").collect()
        return {"hits": [{k: r[k] for k in ("fqn", "kind", "name", "description")} for r in rows[:SEARCH_HITS]], "total": len(rows)}

    def _entity(self, fqn: str):
        _text(fqn, FQN_CHARS, "fqn")
        rows = live(self._need_store().read("entities")).where(F.col("fqn") == fqn).limit(1).collect()
        if not rows:
            raise invalid("not_found", f"no entity {fqn}", fqn=fqn)
        return rows[0]

    def get_entity(self, caller: Caller, fqn: str, plan_id: str | None = None) -> dict[str, Any]:
        def run(_: Clock) -> dict[str, Any]:
            e = self._entity(fqn)
            values = live(self.store.read("enum_values")).where(F.col("column_fqn") == fqn).orderBy("value").limit(ENUM_VALUES + 1).collect()
            edges = relation_summary(self.store.read("relations"), fqn).orderBy("type", "direction", "other").collect()
            summary: dict[str, dict[str, list[str]]] = {}
            for r in edges:
                summary.setdefault(r.type, {"out": [], "in": []})[r.direction].append(r.other)
            return {
                "entity": {k: v for k, v in e.asDict().items() if k not in {"tombstone", "updated_at"}},
                "enum_values": [{"value": v.value, "label": v.label} for v in values[:ENUM_VALUES]],
                "enum_truncated": len(values) > ENUM_VALUES,
                "relations": summary,
                "relations_truncated": bool(edges and edges[0].truncated),
            }

        return self._logged(caller, "get_entity", {"fqn": fqn}, plan_id, run)

    def traverse_relations(self, caller: Caller, fqn: str, relation: str, direction: str = "out", max_depth: int = 1, plan_id: str | None = None) -> dict[str, Any]:
        def run(_: Clock) -> dict[str, Any]:
            self._entity(fqn)
            g = traverse(self.store.read("relations"), fqn, relation, direction or "out", max_depth)
            return {"nodes": g.nodes, "edges": g.edges, "truncated": g.truncated}

        return self._logged(caller, "traverse_relations", {"fqn": fqn, "relation": relation, "direction": direction, "max_depth": max_depth}, plan_id, run)

    def get_metric_definition(self, caller: Caller, fqn: str, time_range: dict[str, str] | None = None, plan_id: str | None = None) -> dict[str, Any]:
        def run(_: Clock) -> dict[str, Any]:
            e = self._entity(fqn)
            if e.kind != "metric":
                raise invalid("wrong_kind", f"{fqn} is a {e.kind}", fqn=fqn, kind=e.kind)
            tables = sorted(r.dst_fqn for r in live(self.store.read("relations")).where((F.col("type") == "describes") & (F.col("src_fqn") == fqn)).select("dst_fqn").collect())
            cols = live(self.store.read("entities")).where((F.col("kind") == "column") & F.col("is_time") & F.substring_index("fqn", ".", 3).isin(tables)).select("fqn").orderBy("fqn").collect() if tables else []
            times: dict[str, list[str]] = {}
            for c in cols:
                times.setdefault(c.fqn.rsplit(".", 1)[0], []).append(c.fqn)
            if time_range is not None and not (time_range.get("start") and time_range.get("end")):
                raise invalid("bad_time", "a range needs start and end")
            m = metric_sql(e.name, e.expression, e.filter or "", tables, times, (time_range["start"], time_range["end"]) if time_range else None)
            return {"fqn": fqn, "expression": e.expression, "aggregation": e.aggregation, "filter": e.filter, "tables": tables, "dry_run_sql": m.sql, "time_applied": m.time_applied, "note": "; ".join(m.notes)}

        return self._logged(caller, "get_metric_definition", {"fqn": fqn, "time_range": time_range}, plan_id, run)

    def list_enum_values(self, caller: Caller, fqn: str, plan_id: str | None = None) -> dict[str, Any]:
        def run(_: Clock) -> dict[str, Any]:
            e = self._entity(fqn)
            if e.kind != "column":
                raise invalid("wrong_kind", f"{fqn} is a {e.kind}", fqn=fqn, kind=e.kind)
            mine = live(self.store.read("enum_values")).where(F.col("column_fqn") == fqn)
            total = mine.count()
            rows = mine.orderBy("value").limit(ENUM_VALUES).collect()
            return {"values": [{"value": r.value, "label": r.label} for r in rows], "total": total, "truncated": total > len(rows)}

        return self._logged(caller, "list_enum_values", {"fqn": fqn}, plan_id, run)

    def _logged(self, caller: Caller, tool: str, params: dict[str, Any], plan_id: str | None, run: Callable[[Clock], dict[str, Any]]) -> dict[str, Any]:
        """Run one call and log it; the log never decides the outcome."""
        clock, error, result = Clock(), None, None
        try:
            result = run(clock)
            return result
        except EngineError as e:
            error = e
            raise
        except Exception as e:
            error = EngineError(INTERNAL, f"{type(e).__name__}: {str(e)[:300]}", {})
            raise error from e
        finally:
            if self.log is not None:
                meta = (result or {}).get("meta", {})
                reject = error.to_dict() | {"code": error.kind, "details": {k: str(v) for k, v in error.details.items()}} if error else None
                self.log.append({"user": caller.user, "key": caller.key[:8], "tool": tool, "params": params, "stages_ms": clock.ms, "status": status_of(error), "rows": meta.get("row_count"), "truncated": meta.get("truncated"), "plan_id": plan_id, "reject": reject})

    def self_check(self) -> list[str]:
        """All problems of the configuration at once: folders that can't be read,
        settings that the results depend on."""
        out = []
        if self.spark.conf.get("spark.sql.session.timeZone") != "UTC":
            out.append("spark.sql.session.timeZone isn't UTC")
        if self.spark.conf.get("spark.sql.ansi.enabled", "true") != "true":
            out.append("spark.sql.ansi.enabled isn't true")
        fs = self.spark._jvm.org.apache.hadoop.fs
        for r in self.config.routes.values():
            p = fs.Path(r.path)
            try:
                if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
                    out.append(f"{r.dbname}: no folder {r.path}")
            except Exception as e:
                out.append(f"{r.dbname}: {str(e)[:200]}")
        return out


def _text(s: str, most: int, what: str) -> None:
    if not s or not s.strip():
        raise invalid("empty", f"{what} is empty")
    if len(s) > most:
        raise invalid("too_long", f"{what} has more than {most} characters", limit=most)


def _unqualified(text: str, refs: list[TableRef]) -> str:
    """The text with `public.t` as `t`, as views have no schema."""
    if not any(len(r.parts) > 1 for r in refs):
        return text
    ts = tokens(text)
    names = {r.parts[-1].lower() for r in refs if len(r.parts) == 2}
    out, at = [], 0
    for a, dot, b in zip(ts, ts[1:], ts[2:]):
        if a.text.strip('"`').lower() == "public" and dot.text == "." and b.text.strip('"`').lower() in names:
            out.append(text[at : a.at])
            at = b.at
    return "".join([*out, text[at:]])


