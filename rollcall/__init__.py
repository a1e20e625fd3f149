"""Quality checks, encoding, de-duplication and matching of customer lists on Spark."""

from .labels import DEFAULT_LABELS, PARTNER, PRIMARY, VENDOR, Labels
from .operators.rules import FieldRule, FieldSpec
from .plans.export import export_run
from .plans.run import STAGES, ListRun, run_lists

__all__ = [
    "DEFAULT_LABELS",
    "FieldRule",
    "FieldSpec",
    "Labels",
    "ListRun",
    "PARTNER",
    "PRIMARY",
    "STAGES",
    "VENDOR",
    "export_run",
    "run_lists",
]
