"""All queries of the core, with the SQL of those that SQL can express."""

from __future__ import annotations

from yarrow.operators import answers, chunking, contexts, evidence, judging, preparation, quality, relational, reports, retrieval, structure
from yarrow.plans import pipelines

_MODULES = (retrieval, evidence, contexts, preparation, judging, chunking, structure, reports, answers, relational, quality, pipelines)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
