"""All registered queries."""

from netloom.plans import q_circuits, q_detection, q_metrics, q_sources, q_values, q_wiring  # noqa: F401
from netloom.plans.registry import ORACLES, QUERIES  # noqa: F401
