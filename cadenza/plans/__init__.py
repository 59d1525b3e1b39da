"""The library's queries over the driver's tables, with their oracles."""

from cadenza.plans import background, coding, containers, measures, relational, segments, streams  # noqa: F401
from cadenza.plans.registry import ORACLES, QUERIES  # noqa: F401
