"""All queries and SQL counterparts of the llm operators."""

from notegraph.llm import graph_text, text_queries

MODULES = [graph_text, text_queries]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
