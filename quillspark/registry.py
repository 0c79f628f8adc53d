"""All registered queries and the SQL that an independent engine runs for the same rows."""

from quillspark.plans import evaluation_queries, graph_queries, more_queries, other_queries  # noqa: F401  registers them
from quillspark.plans.common import ORACLES, QUERIES  # noqa: F401
