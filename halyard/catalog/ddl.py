"""The structure of a database, by replaying its migrations in order.

A fold over statements, each of which depends on those before it, and as small as
what people write by hand; what comes out is a set of rows for DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

from halyard.guard.lexer import Token, statements

NAME_BYTES = 63
# fixed values: words that end a column's type, and table constraints
_END = {"NOT", "NULL", "DEFAULT", "PRIMARY", "UNIQUE", "CHECK", "REFERENCES", "CONSTRAINT", "GENERATED", "COLLATE", "DEFERRABLE", "USING", "STORAGE", "COMPRESSION"}
_TABLE_PART = {"CONSTRAINT", "PRIMARY", "UNIQUE", "CHECK", "FOREIGN", "EXCLUDE", "LIKE"}
_QUIET = {"OWNER", "ENABLE", "DISABLE", "VALIDATE", "CLUSTER", "SET", "RESET", "REPLICA", "INHERIT", "NO", "FORCE"}


@dataclass
class Table:
    name: str
    schema: str
    columns: dict[str, str] = field(default_factory=dict)
    checks: dict[str, tuple[str, list[str]]] = field(default_factory=dict)
    references: dict[str, tuple[list[str], str, list[str]]] = field(default_factory=dict)

    def enums(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for col, values in self.checks.values():
            out[col] = [*out.get(col, []), *(v for v in values if v not in out.get(col, []))]
        return out


@dataclass
class Structure:
    tables: dict[str, Table] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    def columns(self) -> list[tuple[str, str, str, str, int]]:
        """(schema, table, column, type, position) of all columns."""
        return [(t.schema, t.name, c, k, n) for t in sorted(self.tables.values(), key=lambda t: t.name) for n, (c, k) in enumerate(t.columns.items())]

    def edges(self) -> list[tuple[str, str, str]]:
        """(table, target, join condition) between tables of the structure, once each."""
        out = set()
        for t in self.tables.values():
            for cols, target, theirs in t.references.values():
                if target in self.tables:
                    out.add((t.name, target, " AND ".join(f"{t.name}.{a} = {target}.{b}" for a, b in zip(cols, theirs))))
        return sorted(out)

    def counts(self) -> dict[str, int]:
        return {"tables": len(self.tables), "columns": sum(len(t.columns) for t in self.tables.values()), "enums": sum(len(t.enums()) for t in self.tables.values()), "references": len(self.edges())}


def migration_files(folder: str) -> list[Path]:
    """The *.up.sql files of a folder in order of name; subfolders don't count."""
    return sorted(p for p in Path(folder).glob("*.up.sql") if p.is_file())


class _Reader:
    """Tokens of one statement with a place in them."""

    def __init__(self, ts: list[Token], text: str):
        self.ts, self.text, self.at = ts, text, 0

    def word(self, n: int = 0) -> str:
        return self.ts[self.at + n].word if self.at + n < len(self.ts) else ""

    def take(self, *words: str) -> bool:
        """Step over these words if they come next."""
        if all(self.word(n) == w for n, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def peek(self, n: int = 0) -> str:
        return self.ts[self.at + n].text if self.at + n < len(self.ts) else ""

    def name(self) -> tuple[str, str]:
        """(schema, name) of a possibly qualified identifier."""
        parts = [self._ident()]
        while self.peek() == ".":
            self.at += 1
            parts.append(self._ident())
        return (parts[-2] if len(parts) > 1 else ""), parts[-1]

    def _ident(self) -> str:
        t = self.ts[self.at]
        self.at += 1
        return t.text[1:-1].replace('""', '"') if t.kind == "quoted" else t.text.lower()

    def group(self) -> list[Token]:
        """The tokens in the parentheses that open here."""
        depth, start = self.ts[self.at].depth, self.at + 1
        self.at = start
        while self.at < len(self.ts) and not (self.ts[self.at].text == ")" and self.ts[self.at].depth == depth):
            self.at += 1
        inner = self.ts[start : self.at]
        self.at += 1
        return inner


def _split(ts: list[Token]) -> Iterator[list[Token]]:
    """Parts between commas of the outer level."""
    if not ts:
        return
    depth, part = min(t.depth for t in ts), []
    for t in ts:
        if t.text == "," and t.depth == depth:
            yield part
            part = []
        else:
            part.append(t)
    if part:
        yield part


def _source(text: str, ts: list[Token]) -> str:
    return re.sub(r"\s+", " ", text[ts[0].at : ts[-1].at + len(ts[-1].text)]).strip() if ts else ""


def _idents(ts: list[Token]) -> list[str]:
    return [t.text[1:-1] if t.kind == "quoted" else t.text.lower() for t in ts if t.kind in {"word", "quoted"}]


def replay(texts: Iterable[str], schema: str = "public") -> Structure:
    """The structure after all statements of all texts."""
    s = Structure()
    for text in texts:
        for ts in statements(text):
            _statement(s, _Reader(ts, text), schema)
    return s


def _statement(s: Structure, r: _Reader, schema: str) -> None:
    if r.take("CREATE"):
        for w in ("UNLOGGED", "TEMP", "TEMPORARY"):
            r.take(w)
        if r.take("TABLE"):
            _create(s, r, schema)
    elif r.take("ALTER", "TABLE"):
        r.take("IF", "EXISTS")
        r.take("ONLY")
        _, name = r.name()
        t = s.tables.get(name)
        if t is None:
            s.warnings.append(f"ALTER of the unknown table {name}")
            return
        for part in _split(r.ts[r.at :]):
            _alter(s, t, _Reader(part, r.text))
    elif r.take("DROP", "TABLE"):
        r.take("IF", "EXISTS")
        for part in _split(r.ts[r.at :]):
            s.tables.pop(_Reader(part, r.text).name()[1], None)


def _create(s: Structure, r: _Reader, schema: str) -> None:
    keep = r.take("IF", "NOT", "EXISTS")
    own, name = r.name()
    own = own or schema
    old = s.tables.get(name)
    if old is not None and old.schema != own:
        s.warnings.append(f"table {name} is in the schemas {old.schema} and {own}")
    if old is not None and keep:
        return
    if r.peek() != "(":
        s.warnings.append(f"CREATE TABLE {name} has no list of columns")
        return
    t = s.tables[name] = Table(name, own)
    for part in _split(r.group()):
        p = _Reader(part, r.text)
        if p.word() in _TABLE_PART:
            _constraint(s, t, p)
        else:
            _column(s, t, p)


def _column(s: Structure, t: Table, p: _Reader) -> None:
    _, name = p.name()
    start, depth = p.at, p.ts[0].depth
    while p.at < len(p.ts) and not (p.ts[p.at].word in _END and p.ts[p.at].depth == depth):
        p.at += 1
    t.columns[name] = _source(p.text, p.ts[start : p.at])
    label = ""
    while p.at < len(p.ts):
        if p.take("CONSTRAINT"):
            label = p.name()[1]
        elif p.take("CHECK"):
            _check(s, t, label or f"{t.name}_{name}_check", p.group())
            label = ""
        elif p.take("REFERENCES"):
            _, target = p.name()
            theirs = _idents(p.group()) if p.peek() == "(" else [name]
            t.references[label or auto_name(t.name, name, "fkey")] = ([name], target, theirs)
            label = ""
        else:
            p.at += 1


def auto_name(table: str, column: str, end: str) -> str:
    """The name of an unnamed constraint, cut to what fits an identifier."""
    return f"{table}_{column}_{end}".encode()[:NAME_BYTES].decode("utf-8", "ignore")


def _constraint(s: Structure, t: Table, p: _Reader) -> None:
    label = p.name()[1] if p.take("CONSTRAINT") else ""
    if p.take("CHECK"):
        _check(s, t, label or f"{t.name}_check{len(t.checks)}", p.group())
    elif p.take("FOREIGN", "KEY"):
        cols = _idents(p.group())
        if p.take("REFERENCES"):
            _, target = p.name()
            theirs = _idents(p.group()) if p.peek() == "(" else cols
            t.references[label or auto_name(t.name, cols[0], "fkey")] = (cols, target, theirs)


def _check(s: Structure, t: Table, label: str, ts: list[Token]) -> None:
    """CHECK (col IN ('a', 'b')), also as col = ANY (ARRAY[...]), into enum values;
    other checks don't matter here."""
    plain = [x for x in ts if x.text not in "()[]" and x.word not in {"TEXT", "VARCHAR", "CHARACTER", "VARYING"} and x.text not in {"::", ":"}]
    words = [x.word for x in plain]
    if len(plain) < 3 or plain[0].kind not in {"word", "quoted"}:
        return
    if words[1] == "IN":
        rest = plain[2:]
    elif plain[1].text == "=" and words[2] == "ANY":
        rest = [x for x in plain[3:] if x.word != "ARRAY"]
    else:
        return
    values = [x for x in rest if x.text != ","]
    if not values or any(x.kind not in {"string", "number"} for x in values):
        return
    col = _idents(plain[:1])[0]
    texts = [x.text[1:-1].replace("''", "'") if x.kind == "string" else x.text for x in values]
    if "" in texts:
        s.warnings.append(f"{t.name}.{col}: an empty enum value is left out")
    t.checks[label] = (col, [x for x in texts if x])


def _alter(s: Structure, t: Table, p: _Reader) -> None:
    if p.take("ADD"):
        if p.word() in _TABLE_PART:
            _constraint(s, t, p)
            return
        p.take("COLUMN")
        if p.take("IF", "NOT", "EXISTS") and p.peek().lower().strip('"') in t.columns:
            return
        _column(s, t, p)
    elif p.take("DROP"):
        if p.take("CONSTRAINT"):
            p.take("IF", "EXISTS")
            name = p.name()[1]
            t.checks.pop(name, None)
            t.references.pop(name, None)
            return
        p.take("COLUMN")
        p.take("IF", "EXISTS")
        name = p.name()[1]
        t.columns.pop(name, None)
        t.checks = {k: v for k, v in t.checks.items() if v[0] != name}
        t.references = {k: v for k, v in t.references.items() if name not in v[0]}
    elif p.take("ALTER"):
        p.take("COLUMN")
        _, name = p.name()
        p.take("SET", "DATA")
        if p.take("TYPE"):
            start = p.at
            while p.at < len(p.ts) and p.ts[p.at].word not in _END:
                p.at += 1
            if name in t.columns:
                t.columns[name] = _source(p.text, p.ts[start : p.at])
    elif p.take("RENAME"):
        s.warnings.append(f"RENAME in {t.name} isn't followed")
    elif p.word() not in _QUIET:
        s.warnings.append(f"ALTER TABLE {t.name} {p.peek()} isn't known")
