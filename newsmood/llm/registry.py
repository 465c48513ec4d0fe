"""What the entry point adds: the operators' queries and the pipeline, with their SQL."""

from __future__ import annotations

import corpus_pipeline
from newsmood.llm.queries import ORACLE, QUERIES

LLM_QUERIES = {**QUERIES, "pipeline": corpus_pipeline.run}
LLM_ORACLE = {**ORACLE, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}
