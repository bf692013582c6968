"""All registered queries."""

from mendframe.plans import diagnosis, evaluation, repairs, step_log  # noqa: F401
from mendframe.plans.registry import ORACLES, QUERIES  # noqa: F401
