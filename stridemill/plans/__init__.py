from stridemill.plans import features, files, runlogs, samples, scores, streams  # noqa: F401
from stridemill.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
