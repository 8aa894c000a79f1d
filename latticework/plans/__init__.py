"""Query plans: views over the given tables and the registered queries."""

from latticework.plans.registry import OPERATORS, ORACLES, QUERIES  # noqa: F401
from latticework.plans import calibration_queries  # noqa: F401
from latticework.plans import signal_queries  # noqa: F401
from latticework.plans import peak_queries  # noqa: F401
from latticework.plans import micro_queries  # noqa: F401
from latticework.plans import crystal_queries  # noqa: F401
from latticework.plans import evaluation_queries  # noqa: F401
from latticework.plans import candidate_queries  # noqa: F401
from latticework.plans import evidence_queries  # noqa: F401
from latticework.plans import recovery_queries  # noqa: F401
from latticework.plans import pixel_queries  # noqa: F401
from latticework.plans import source_queries  # noqa: F401
