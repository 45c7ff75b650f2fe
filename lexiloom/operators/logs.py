"""The engine's logger: two levels of its own, set from the environment.

``LEXILOOM_LOG_LEVEL`` is a level's name (TRACE, DEBUG, INFO, SUCCESS, WARNING, ERROR, CRITICAL) or OFF;
INFO where it is unset, and an error for any other name.
"""

from __future__ import annotations

import logging
import os
import sys

TRACE, SUCCESS = 5, 25
LEVELS = ("TRACE", "DEBUG", "INFO", "SUCCESS", "WARNING", "ERROR", "CRITICAL")
FORMAT = "%(asctime)s | %(levelname)-8s | %(name)s:%(lineno)d - %(message)s"

logging.addLevelName(TRACE, "TRACE")
logging.addLevelName(SUCCESS, "SUCCESS")


class EngineLogger(logging.Logger):
    def trace(self, message, *args, **more):
        if self.isEnabledFor(TRACE):
            self._log(TRACE, message, args, **more)

    def success(self, message, *args, **more):
        if self.isEnabledFor(SUCCESS):
            self._log(SUCCESS, message, args, **more)


def logger(name: str = "lexiloom", level: str | None = None, stream=None) -> EngineLogger:
    """The logger of a name, its level read anew from ``level`` or the environment; one handler however often it is asked for."""
    want = (level or os.environ.get("LEXILOOM_LOG_LEVEL", "INFO")).strip().upper()
    if want != "OFF" and want not in LEVELS:
        raise ValueError(f"a log level is one of {(*LEVELS, 'OFF')}")
    found = logging.Logger.manager.loggerDict.get(name)
    if not isinstance(found, EngineLogger):
        found = EngineLogger(name)
        found.parent, found.propagate = logging.root, False
        logging.Logger.manager.loggerDict[name] = found
    if stream is not None or not found.handlers:
        found.handlers.clear()
        handler = logging.StreamHandler(stream or sys.stderr)
        handler.setFormatter(logging.Formatter(FORMAT))
        found.addHandler(handler)
    found.disabled = want == "OFF"
    found.setLevel(logging.CRITICAL if want == "OFF" else logging.getLevelName(want))
    return found
