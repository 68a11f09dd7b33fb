"""Every operator bound to the test tables, next to the SQL that must give the same rows.

``queries()`` maps a name to ``(spark, folder) -> DataFrame``; ``sql()`` maps the names
that plain SQL can express to that SQL.
"""

from casario.plans.catalog import cleaning, geography, harvest, learning, serving, upserts  # noqa: F401
from casario.plans.catalog.registry import queries, sql

__all__ = ["queries", "sql"]
