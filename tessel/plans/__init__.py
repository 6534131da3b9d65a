"""Named queries over the driver's tables."""

from tessel.plans import catalog, evaluation, intake, pipelines, records, retrieval, state, streams, values
from tessel.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "catalog", "evaluation", "intake", "pipelines", "records", "retrieval", "state", "streams", "values"]
