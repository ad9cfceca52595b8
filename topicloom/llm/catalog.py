"""All queries of the training-data operators and the SQL that checks them."""

from . import distinctive, leaks, neighbours, new_text, pairs, reading_level, similar_groups, subjects, term_counts, tokenize

_MODULES = (similar_groups, neighbours, term_counts, pairs, distinctive, tokenize, leaks, reading_level, subjects, new_text)

QUERIES = {name: run for m in _MODULES for name, run in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
