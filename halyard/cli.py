"""Commands: python -m halyard COMMAND ...; settings come from HALYARD_* variables."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.catalog.check import calibrate, cross_check, exit_code, live_columns, ordered
from halyard.catalog.ddl import migration_files, replay
from halyard.catalog.draft import draft, merge_documents, render
from halyard.config import Config
from halyard.errors import EngineError
from halyard.execute import Caller, Engine
from halyard.records.log import CallLog, retain
from halyard.semantic.credentials import create_key, revoke_key, user_of
from halyard.semantic.store import Store
from halyard.semantic.sync import apply_grants, change_grant, sync
from halyard.session import make_session
from halyard.sources.yaml_files import load_manifest, yaml


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="halyard", description=__doc__)
    p.add_argument("--master", default="local[*]")
    sub = p.add_subparsers(dest="command", required=True)
    for name, *args in (
        ("serve-stdio",),
        ("key-create", "user"),
        ("key-revoke", "key"),
        ("grant-add", "user", "target"),
        ("grant-remove", "user", "target"),
        ("grants-apply", "file"),
        ("grants-snapshot",),
        ("semantic-sync", "folder"),
        ("semantic-backup", "to"),
        ("selfcheck",),
        ("log-roll",),
        ("scan", "manifest", "root", "out"),
        ("calibrate", "draft", "dbname"),
    ):
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
    sub.choices["semantic-sync"].add_argument("--dry-run", action="store_true")
    sub.choices["serve-stdio"].add_argument("--key", required=True)
    for name in ("semantic-sync", "serve-stdio"):
        sub.choices[name].add_argument("--embedder", help="MODULE:FUNCTION that turns a list of texts into a list of vectors")
    sub.choices["scan"].add_argument("--models", help="JSON lines or Parquet of the models' columns: service, table, column, type")
    return p


def scan(manifest: str, root: str, out: str) -> list[str]:
    """Drafts of all services of a manifest, merged into those already in `out`;
    what was odd in their migrations."""
    odd = []
    Path(out).mkdir(parents=True, exist_ok=True)
    for s in load_manifest(Path(manifest).read_text("utf-8")):
        where = Path(root) / s["dir"] / "migrations"
        found = replay(p.read_text("utf-8") for p in migration_files(str(where))) if s["db"] else replay([])
        odd += [f"{s['name']}: {w}" for w in found.warnings]
        to = Path(out) / f"{s['name']}.yaml"
        doc = draft(s["name"], s["db"], found)
        if to.exists():
            doc = merge_documents(doc, yaml.safe_load(to.read_text("utf-8")))
        to.write_text(render(doc), "utf-8")
    return odd


def embedder(name: str | None):
    """The function named MODULE:FUNCTION, None without a name."""
    if not name:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def drafted(folder: str) -> list[tuple[str, str, str, str, str]]:
    """(service, schema, table, column, type) of all drafts of a folder."""
    rows = []
    for p in sorted(Path(folder).glob("*.yaml")):
        doc = yaml.safe_load(p.read_text("utf-8"))
        rows += [(doc["service"], t.get("schema") or "public", t["name"], c["name"], c.get("type") or "") for d in doc.get("databases") or [] for t in d.get("tables") or [] for c in t.get("columns") or []]
    return rows


def against_models(spark, folder: str, models: str) -> DataFrame:
    """Findings of the drafts of a folder against the columns of the code's models."""
    draft_columns = spark.createDataFrame(drafted(folder), "service string, schema string, table string, column string, type string")
    kind = "service string, table string, column string, type string"
    rows = spark.read.schema(kind).parquet(models) if models.endswith(".parquet") else spark.read.schema(kind).json(models)
    wide = F.concat_ws(".", "service", "table").alias("table")
    return ordered(cross_check(draft_columns.select(wide, "column", "type"), rows.select(wide, "column", "type")))


def report(findings: DataFrame) -> int:
    for r in findings.toLocalIterator():
        print(r.severity, r.message)
    return exit_code(findings)


def serve(engine: Engine, store: Store, key: str, lines, out) -> None:
    """One JSON call per line, {"tool": ..., "arguments": {...}}, one JSON result each."""
    caller = Caller(user_of(store, key), key)
    tools = {t: getattr(engine, t) for t in ("search_entities", "get_entity", "traverse_relations", "get_metric_definition", "list_enum_values", "execute_sql")}
    for line in lines:
        try:
            call = json.loads(line)
            answer = {"result": tools[call["tool"]](caller, **call.get("arguments", {}))}
        except EngineError as e:
            answer = {"error": e.to_dict()}
        except (ValueError, KeyError, TypeError) as e:
            answer = {"error": {"kind": "invalid_request", "code": 400, "message": str(e), "details": {}}}
        print(json.dumps(answer, ensure_ascii=False, default=str), file=out, flush=True)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return run(a)
    except EngineError as e:
        print(json.dumps(e.to_dict(), ensure_ascii=False), file=sys.stderr)
        return 1
    except (OSError, ValueError, KeyError, ImportError, AttributeError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1


def run(a: argparse.Namespace) -> int:
    """Exit code: 0, or 2 if scan or calibrate found an error; main gives 1 for what can't be run."""
    if a.command == "scan":
        for w in scan(a.manifest, a.root, a.out):
            print(f"warn {w}")
        return report(against_models(make_session(master=a.master), a.out, a.models)) if a.models else 0
    config = Config.from_env()
    spark = make_session(master=a.master)
    store = Store(spark, config.store)
    if a.command == "key-create":
        print(create_key(store, a.user))
    elif a.command == "key-revoke":
        return int(not revoke_key(store, a.key))
    elif a.command in ("grant-add", "grant-remove"):
        print(json.dumps(change_grant(spark, store, a.user, a.target, a.command == "grant-add")))
    elif a.command == "grants-apply":
        print(json.dumps(apply_grants(spark, store, Path(a.file).read_text("utf-8"))))
    elif a.command == "grants-snapshot":
        for r in store.read("grants").orderBy("user_id", "table_fqn").toLocalIterator():
            print(r.user_id, r.table_fqn)
    elif a.command == "semantic-sync":
        r = sync(spark, store, a.folder, a.dry_run, embedder(a.embedder), config.embedding_model)
        print(json.dumps(r.changes))
        for w in r.warnings:
            print(f"warn {w}")
    elif a.command == "semantic-backup":
        store.backup(a.to)
    elif a.command == "selfcheck":
        problems = Engine(spark, config, store).self_check()
        print("\n".join(problems) or "ok")
        return int(bool(problems))
    elif a.command == "log-roll":
        import datetime as dt

        print(json.dumps(retain(spark, config.log_dir, dt.datetime.now(dt.timezone.utc).date(), config.raw_days, config.summary_days)))
    elif a.command == "calibrate":
        doc = yaml.safe_load(Path(a.draft).read_text("utf-8"))
        route = config.routes[a.dbname]
        rows = [(t.get("schema") or "public", t["name"], c["name"], c.get("type") or "") for d in doc.get("databases") or [] for t in d.get("tables") or [] for c in t.get("columns") or []]
        columns = spark.createDataFrame(rows, "schema string, table string, column string, type string")
        there = {p.name[:-8]: spark.read.parquet(str(p)) for p in sorted(Path(route.path).glob("*.parquet"))}
        return report(ordered(calibrate(columns, live_columns(spark, there))))
    elif a.command == "serve-stdio":
        serve(Engine(spark, config, store, embedder(a.embedder), CallLog(config.log_dir)), store, a.key, sys.stdin, sys.stdout)
    return 0
