"""Named queries over the driver's tables, each with SQL that says the same where SQL can."""

from . import events, logs, qc, sensor, streams  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
