"""Loggers of the library."""

from __future__ import annotations

import logging


def get_logger(name: str = "") -> logging.Logger:
    return logging.getLogger(f"fleetlens.{name}" if name else "fleetlens")


def setup_logging(level: int | str = logging.INFO) -> logging.Logger:
    """One handler on the library's logger, whatever the root logger does."""
    own = get_logger()
    own.setLevel(level)
    if not own.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        own.addHandler(handler)
    return own
