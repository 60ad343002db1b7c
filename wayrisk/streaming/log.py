"""Log lines as JSON objects."""

from __future__ import annotations

import datetime as dt
import json
import logging


class JsonLines(logging.Formatter):
    """One object a line: time in UTC, level, logger, message, and the error if there is one."""

    def format(self, record: logging.LogRecord) -> str:
        at = dt.datetime.fromtimestamp(record.created, dt.UTC).isoformat()
        line = {"timestamp": at, "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        if record.exc_info:
            line["exception"] = self.formatException(record.exc_info)
        return json.dumps(line, ensure_ascii=False)
