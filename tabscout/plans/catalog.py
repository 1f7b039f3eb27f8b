"""Everything that is registered."""
from tabscout.plans import (  # noqa: F401
    file_queries, flagship, loss_queries, round_trip_queries, run_queries, sample_queries, vector_queries, view_queries,
)
from tabscout.plans.registry import ORACLES, QUERIES  # noqa: F401
