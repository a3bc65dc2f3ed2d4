"""Importing this package registers every query."""

from talus.plans.queries import (  # noqa: F401
    expressions,
    hierarchies,
    metric_reports,
    page_extracts,
    searches,
    states,
    training_sets,
    vector_jobs,
)
