"""Named queries over the tables, each on whole tables, with SQL where there is an equivalent."""

from lectern.plans import indexed, library, queries, search, selection  # noqa: F401  (each registers its queries)
from lectern.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
