"""Contract queries over the driver's tables, each with the SQL it must equal."""

from ridgeline.contract import aggregates, alignments, graphs, intervals, joins, kernels, projections, scalars, statistics, windows  # noqa: F401
from ridgeline.contract.base import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
