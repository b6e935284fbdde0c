"""All registered queries."""

from prefboard.plans import agreement, boards, judging, scores, shaping, storage  # noqa: F401
from prefboard.plans.registry import ORACLE, QUERIES  # noqa: F401
