"""All queries of the core and the SQL that checks them."""

from . import checks, corpus, learned, numeric, storage

QUERIES = corpus.QUERIES | numeric.QUERIES | learned.QUERIES | storage.QUERIES | checks.QUERIES
SQL = corpus.SQL | numeric.SQL | learned.SQL | storage.SQL | checks.SQL | {"affinity_of_index": numeric.SQL["affinity_mixed"]}
