"""All registered queries of the trace library."""

from . import intervals, overview, reports, runtime, serving, spaces, steps, tables, texts, utilization  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
