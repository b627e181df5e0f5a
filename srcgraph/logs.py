"""Log records as JSON lines."""

from __future__ import annotations

import json
import logging
from datetime import UTC, datetime


class JsonLines(logging.Formatter):
    """One object a record: ts in UTC with milliseconds, level, run_id, logger, context and msg."""

    def format(self, record: logging.LogRecord) -> str:
        at = datetime.fromtimestamp(record.created, UTC)
        context = getattr(record, "context", None)
        row = {"ts": at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z", "level": record.levelname, "run_id": getattr(record, "run_id", None), "logger": record.name}
        return json.dumps(row | {"context": dict(context) if isinstance(context, dict) else {}, "msg": record.getMessage()}, ensure_ascii=False)


def to_file(path: str, run_id: str | None = None, logger: str = "srcgraph") -> logging.Handler:
    """Add a handler that appends the logger's records, with the run's id where they have none."""
    handler = logging.FileHandler(path, encoding="utf-8")
    handler.setFormatter(JsonLines())

    def mark(record: logging.LogRecord) -> bool:
        if getattr(record, "run_id", None) is None:
            record.run_id = run_id
        return True

    handler.addFilter(mark)
    logging.getLogger(logger).addHandler(handler)
    return handler
