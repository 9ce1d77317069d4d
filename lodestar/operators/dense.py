"""Exact vector search.

Rows are put into lists around centres (`clusters`), queries visit their own list first and then those whose bound
reaches their k-th score so far; a visit is a matrix product of packed blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from lodestar.operators import clusters

BLOCK = clusters.BLOCK


def search(rows: DataFrame, queries: DataFrame, k: int, metric: str = "ip", skip_self: bool = True, block: int = BLOCK) -> DataFrame:
    """rows, queries: (vec_id long, vec array<float>), null vectors left out. Returns (qid, did, score, rank).

    metric: ip (inner product) or l2 (squared distance, least first, score negated). Scores are rounded to 6 places
    before they are ranked, ties go by id.
    """
    if metric not in clusters.METRICS:
        raise ValueError(f"unknown metric {metric}")
    return clusters.search(clusters.build(rows, block=block), queries, k, metric, skip_self)
