"""The log of calls: one JSON line each, by day; summaries; what is kept how long."""

from __future__ import annotations

import datetime as dt
import json
import os
import re
import shutil
import threading
from collections.abc import Callable, Iterable
from pathlib import Path
from typing import Any, TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One line. `params` is JSON of any shape.
SCHEMA = (
    "kind string, ts timestamp, user string, key string, tool string, params string, stages_ms map<string,bigint>, status string, rows int,"
    " truncated boolean, plan_id string, reject struct<kind:string,code:string,message:string,details:map<string,string>>, event string"
)
STATUSES = ("success", "rejected", "timeout", "parse_error")


def status_of(error: Any) -> str:
    """success, or by the error's reason timeout, parse_error or rejected."""
    if error is None:
        return "success"
    return {"timeout": "timeout", "syntax_error": "parse_error"}.get(error.reason, "rejected")


class CallLog:
    """Appends lines to raw-YYYY-MM-DD.jsonl of a folder, readable by the owner only.
    A failing disk never fails the call that is logged."""

    def __init__(self, folder: str, clock: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.timezone.utc)):
        self.folder, self.clock, self._lock = Path(folder), clock, threading.Lock()

    def append(self, record: dict[str, Any]) -> bool:
        now = self.clock()
        line = {"kind": "tool_call", "ts": now.isoformat(timespec="microseconds").replace("+00:00", "Z")} | {k: v for k, v in record.items() if v is not None}
        try:
            with self._lock:
                self.folder.mkdir(parents=True, exist_ok=True)
                fd = os.open(self.folder / f"raw-{now:%Y-%m-%d}.jsonl", os.O_WRONLY | os.O_APPEND | os.O_CREAT, 0o600)
                with os.fdopen(fd, "a", encoding="utf-8") as f:
                    f.write(json.dumps(line, ensure_ascii=False) + "\n")
            return True
        except OSError:
            return False


def read_log(spark: SparkSession, path: str, since: dt.datetime | None = None) -> DataFrame:
    """The lines of a folder or files with `log_day` from the file's name. Lines that
    aren't JSON objects, such as a torn last one, are skipped."""
    raw = spark.read.schema(SCHEMA + ", __bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad").json(path)
    day = F.regexp_extract(F.col("_metadata.file_name"), r"raw-(\d{4}-\d{2}-\d{2})", 1)
    rows = raw.withColumn("log_day", F.try_to_date(day)).where("__bad IS NULL AND kind IS NOT NULL").drop("__bad")
    return rows.where(F.col("ts") >= F.lit(since)) if since else rows


def summary_path(folder: str, day: str) -> Path:
    return Path(folder) / f"summary-{day}.json"


def _summarized_size(folder: str, day: str) -> int | None:
    """The size of the raw file that a day's summary was made of, from its head alone."""
    try:
        with open(summary_path(folder, day), encoding="utf-8") as f:
            found = re.match(r'\{"date": "[^"]*", "raw_size": (\d+)', f.read(200))
    except OSError:
        return None
    return int(found[1]) if found else None


def _write_summary(out: TextIO, day: str, size: int, lines: Iterable[str]) -> None:
    """One JSON object of lines that come in order: tools, reasons, then keywords."""
    out.write(f'{{"date": "{day}", "raw_size": {size}')
    at = -1
    shapes = (("calls", "tool", "{", "}"), ("rejects", "reason", "{", "}"), ("keywords", "keyword", "[", "]"))

    def go_to(n: int) -> None:
        nonlocal at
        while at < n:
            out.write((shapes[at][3] if at >= 0 else "") + (f', "{shapes[at + 1][0]}": {shapes[at + 1][2]}' if at + 1 < len(shapes) else "}"))
            at += 1

    go_to(0)
    first = True
    for line in lines:
        r = json.loads(line)
        n = next(n for n, (_, key, *_) in enumerate(shapes) if key in r)
        first = first or n > at
        go_to(n)
        name = r.pop(shapes[n][1])
        value = {"keyword": name, "count": r["n"]} if n == 2 else r["n"] if n == 1 else r
        out.write(("" if first else ", ") + (f"{json.dumps(name, ensure_ascii=False)}: " if n < 2 else "") + json.dumps(value, ensure_ascii=False))
        first = False
    go_to(len(shapes))


def summarize(spark: SparkSession, folder: str, today: dt.date) -> list[str]:
    """Summaries of all finished days whose raw file has another size than when it
    was summarised; a line that came late makes its day be summarised again. Gives
    the days. Tasks write the lines of summaries, of which each day's object is put
    together line by line and put in place in one step."""
    from halyard.records.rollup import summary_lines

    due: dict[str, int] = {}
    for p in sorted(Path(folder).glob("raw-????-??-??.jsonl")):
        day, size = p.stem[4:], p.stat().st_size
        if day < today.isoformat() and _summarized_size(folder, day) != size:
            due[day] = size
    if not due:
        return []
    log = read_log(spark, folder + "/raw-*.jsonl").where(F.col("log_day").cast("string").isin(list(due)))
    made = Path(folder) / f".summaries-{os.getpid()}"
    lines = summary_lines(log)
    # sorted by range within a day, so that its parts follow each other by their names
    lines.repartitionByRange("date", "o", "name").sortWithinPartitions("date", "o", "name").select("date", "line").write.mode("overwrite").partitionBy("date").text(str(made))
    for day, size in due.items():
        tmp = summary_path(folder, day).with_suffix(".tmp")
        parts = sorted((made / f"date={day}").glob("part-*"))
        with open(tmp, "w", encoding="utf-8") as out:
            _write_summary(out, day, size, (line for p in parts for line in p.open(encoding="utf-8")))
        os.replace(tmp, summary_path(folder, day))
    shutil.rmtree(made, ignore_errors=True)
    return sorted(due)


def retain(spark: SparkSession, folder: str, today: dt.date, raw_days: int, summary_days: int) -> list[str]:
    """Summarise what is due, then remove raw files and summaries of days at or before
    today less their number of days. Gives the removed names."""
    summarize(spark, folder, today)
    gone = []
    for pattern, days in (("raw-*.jsonl", raw_days), ("summary-*.json", summary_days)):
        last = (today - dt.timedelta(days=days)).isoformat()
        for p in sorted(Path(folder).glob(pattern)):
            if p.stem.split("-", 1)[1] <= last:
                p.unlink()
                gone.append(p.name)
    return gone
