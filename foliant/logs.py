"""Log lines of `key=value` pairs, files that rotate by size or by day, and a filter for the noise of polling."""

from __future__ import annotations

import logging
import re
import sys
from logging.handlers import RotatingFileHandler, TimedRotatingFileHandler
from pathlib import Path

POLL = re.compile(r"GET /jobs(?:\?| HTTP|/[a-f0-9]{32} HTTP)", re.IGNORECASE)


def key_values(**fields: object) -> str:
    """functions.text.key_values() for one line: None as `-`, booleans in lower case, line ends escaped."""
    shown = {k: "-" if v is None else str(v).lower() if isinstance(v, bool) else str(v).replace("\n", "\\n") for k, v in fields.items()}
    return " ".join(f"{k}={v}" for k, v in shown.items())


def log_event(log: logging.Logger, level: int, event: str, **fields: object) -> None:
    log.log(level, key_values(event=event, **fields))


def file_handler(path: Path, mode: str = "size", most_bytes: int = 50 << 20, backups: int = 10, days: int = 7) -> logging.Handler:
    """A file that starts anew at midnight, beyond a size, or never where the limits are zero."""
    path.parent.mkdir(parents=True, exist_ok=True)
    if mode == "time" and days > 0:
        return TimedRotatingFileHandler(path, when="midnight", interval=1, backupCount=days, encoding="utf-8")
    if most_bytes > 0 and backups > 0:
        return RotatingFileHandler(path, maxBytes=most_bytes, backupCount=backups, encoding="utf-8")
    return logging.FileHandler(path, encoding="utf-8")


def configure(verbose: bool = False, path: Path | None = None, **rotation: object) -> None:
    handlers = [logging.StreamHandler(sys.stdout), *([file_handler(path, **rotation)] if path else [])]
    logging.basicConfig(level=logging.DEBUG if verbose else logging.INFO, format="%(asctime)s | %(levelname)-7s | %(name)s | %(message)s", handlers=handlers, force=True)


class WithoutPolling(logging.Filter):
    """Leaves out what clients write into an access log by asking for the state of jobs again and again."""

    def filter(self, record: logging.LogRecord) -> bool:
        return not POLL.search(record.getMessage())
