"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from revlens.llm import queries as _q
from revlens.llm import sql as _sql


def queries():
    return {**_q.QUERIES, "pipeline": corpus_pipeline.run}


def oracle_sql():
    return dict(_sql.ORACLES)
