"""Every query the repository answers, by name."""

from gramlaw.queries import columns, policy, searches, statistics  # noqa: F401
from gramlaw.queries.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
