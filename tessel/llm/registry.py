"""All queries of this subpackage."""

from tessel.llm import queries_reading, queries_scans, queries_text

_ALL = (queries_text, queries_scans, queries_reading)
QUERIES = {k: v for m in _ALL for k, v in m.QUERIES.items()}
SQL = {k: v for m in _ALL for k, v in m.SQL.items()}
