"""Queries over the driver tables; importing this package fills the registry."""

from . import q_checks, q_classview, q_io, q_judge, q_metrics, q_text  # noqa: F401
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
