"""All queries of the core."""

from strandloom import queries_assembly, queries_graph, queries_more, queries_records, queries_skew  # noqa: F401, graph and record queries register with the assembly ones

MODULES = (queries_skew, queries_assembly)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
