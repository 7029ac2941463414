"""All registered queries of the core."""

from palimpsest.plans import cluster, problems, store, store_sql

QUERIES = {**store.QUERIES, **cluster.QUERIES, **problems.QUERIES}
SQL = {**store_sql.SQL, **cluster.SQL, **problems.SQL}
