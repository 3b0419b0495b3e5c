"""Registered queries, grouped by the part of the pipeline they exercise."""

from insidertrail.plans import registry
from insidertrail.plans import inputs_and_scalars  # noqa: F401
from insidertrail.plans import joins_and_windows  # noqa: F401
from insidertrail.plans import scores_and_signals  # noqa: F401
from insidertrail.plans import serving  # noqa: F401
from insidertrail.plans import streams  # noqa: F401
from insidertrail.plans import trades  # noqa: F401
from insidertrail.plans import research  # noqa: F401
from insidertrail.plans import levers  # noqa: F401

QUERIES = registry.QUERIES
ORACLES = registry.ORACLES
