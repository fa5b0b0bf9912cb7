"""All registered queries."""

from statewise.plans import (  # noqa: F401
    queries_evidence,
    queries_groups,
    queries_joins,
    queries_models,
    queries_resample,
    queries_stats,
    queries_tables,
    queries_vectors,
)
from statewise.plans.registry import ORACLES, QUERIES  # noqa: F401
