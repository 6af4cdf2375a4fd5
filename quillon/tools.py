"""The tool facade: named tools over an engine, roles, audit rows, and chart specifications."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from quillon.engine import Engine
from quillon.errors import AccessDenied, QueryError
from quillon.operators.access import SecurityContext, check_tool, tools_of
from quillon.sources.inspection import describe_columns, suggest_model, table_kind

CHARTS = ("LINE", "BAR", "PIE", "SCATTER")
PIE_ROWS = 8


@dataclass
class Audit:
    trace_id: str
    tool: str
    role: str
    arguments: dict
    success: bool
    duration_ms: int
    error: str | None = None
    at: float = field(default_factory=time.time)


def infer_chart(rows: list[dict], kinds: dict[str, str], grouped: bool) -> dict:
    """Kind and axes of a chart: a time field makes a line, a few groups a pie, else bars.  kinds: logical type by column."""
    if not rows:
        raise QueryError("no rows to draw")
    columns = list(rows[0])
    number = [c for c in columns if isinstance(rows[0][c], (int, float)) and not isinstance(rows[0][c], bool)]
    times = [c for c in columns if kinds.get(c) in ("DAY", "DATETIME") or any(w in c.lower() for w in ("date", "month", "year", "day"))]
    labels = [c for c in columns if c not in number or c in times]
    x = (times or labels or columns)[0]
    y = next((c for c in number if c != x), columns[-1])
    kind = "LINE" if times else "PIE" if grouped and len(rows) <= PIE_ROWS else "BAR"
    return chart(kind, rows, x, y)


def chart(kind: str, rows: list[dict], x: str, y: str, title: str | None = None) -> dict:
    """A specification of a chart; drawing it is the client's part."""
    if kind.upper() not in CHARTS:
        raise QueryError(f"{kind!r} is no chart")
    if rows and (x not in rows[0] or y not in rows[0]):
        raise QueryError("an axis isn't among the columns")
    return {"type": kind.upper(), "title": title, "xField": x, "yField": y, "data": [{x: r[x], y: r[y]} for r in rows]}


class Tools:
    """Calls tools by name for a role, and keeps an audit row of each call."""

    def __init__(self, engine: Engine, page_size: int = 20):
        self.engine, self.page_size, self.audits = engine, page_size, []
        self.handlers: dict[str, Callable[[dict, SecurityContext], object]] = {
            "dataset.get_metadata": lambda a, c: engine.metadata(a.get("models")),
            "dataset.describe_model_internal": lambda a, c: engine.describe(a["model"]),
            "dataset.query_model_v2": self._query,
            "dataset.inspect_table": self._inspect,
            "chart.generate": lambda a, c: chart(a["type"], a["data"], a["xField"], a["yField"], a.get("title")),
            "dataset.export_with_chart": self._export,
            "dataset.open_in_viewer": lambda a, c: engine.save_query(a["model"], a["payload"], a.get("seconds", 3600)),
            "system.ping": lambda a, c: "pong",
        }

    def list(self, role: str) -> list[str]:
        return [t for t in tools_of(role) if t in self.handlers]

    def call(self, tool: str, arguments: dict, role: str = "ANALYST", context: SecurityContext | None = None) -> object:
        began, error = time.time(), None
        try:
            check_tool(role, tool)
            if tool not in self.handlers:
                raise AccessDenied(f"no tool {tool!r}")
            return self.handlers[tool](arguments, context or SecurityContext())
        except Exception as wrong:
            error = f"{type(wrong).__name__}: {wrong}"
            raise
        finally:
            self.audits.append(Audit(uuid.uuid4().hex, tool, role, arguments, error is None, int((time.time() - began) * 1000), error))

    def audit_rows(self):
        """The audit as a DataFrame, to be appended wherever it is kept."""
        rows = [{**asdict(a), "arguments": str(a.arguments)} for a in self.audits]
        return self.engine.spark.createDataFrame(rows, "trace_id string, tool string, role string, arguments string, success boolean, duration_ms bigint, error string, at double")

    def _query(self, a: dict, c: SecurityContext) -> dict:
        if not a.get("model") or a.get("payload") is None:
            raise QueryError("model and payload are needed")
        mode = a.get("mode", "execute")
        found = self.engine.query(a["model"], a["payload"], c, self.page_size, mode)
        return found.collect() if mode == "execute" else {"items": [], "columns": found.items.columns, "joined": found.joined}

    def _inspect(self, a: dict, c: SecurityContext) -> dict:
        df = self.engine.frame_of(a["table"])
        columns = describe_columns(df)
        return {"table": a["table"], "kind": table_kind(columns), "columns": columns, "model": suggest_model(camel_title(a["table"]), a["table"], df)}

    def _export(self, a: dict, c: SecurityContext) -> dict:
        found = self._query(a, c)
        kinds = {f["name"]: f["type"] for f in self.engine.describe(a["model"])["fields"]}
        made = a.get("chart")
        drawn = chart(made["type"], found["items"], made["xField"], made["yField"]) if made else infer_chart(found["items"], kinds, bool(a["payload"].get("groupBy")))
        return {**found, "chart": drawn}


def camel_title(name: str) -> str:
    return "".join(p[:1].upper() + p[1:] for p in name.split("_"))
