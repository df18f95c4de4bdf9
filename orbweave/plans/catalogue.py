"""All queries of the reconstruction operators by name, and independent SQL for those that it can express.

The SQL is written from the definitions: transforms as direct sums, filters as joins to weight tables, solvers as unrolled steps.
"""

from __future__ import annotations

from . import catalogue_images, catalogue_runs, catalogue_sql, catalogue_volumes

QUERIES = catalogue_images.QUERIES | catalogue_volumes.QUERIES | catalogue_runs.QUERIES | catalogue_sql.QUERIES
ORACLE_SQL = catalogue_images.ORACLE_SQL | catalogue_volumes.ORACLE_SQL | catalogue_runs.ORACLE_SQL | catalogue_sql.ORACLE_SQL
