"""All queries of the reliability engine and what DuckDB says to the same question."""

from . import answers, reliability

QUERIES = answers.QUERIES | reliability.QUERIES
ORACLE_SQL = answers.ORACLE_SQL | reliability.ORACLE_SQL
