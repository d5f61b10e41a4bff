"""Checked queries; importing the modules fills the registry."""

from calltide.checks import (  # noqa: F401
    advice,
    aggregates,
    clocks,
    labels,
    learning,
    parsing,
    reports,
    streams,
)
from calltide.checks.base import ORACLE, QUERIES  # noqa: F401
