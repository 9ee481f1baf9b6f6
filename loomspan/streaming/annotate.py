"""Overlap annotation of a stream of intervals against a static target table: each micro-batch is one bucketed equi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loomspan.operators.intervals import overlap_join, position_class


def annotate_stream(queries: DataFrame, targets: DataFrame, **bins) -> DataFrame:
    """Hits of streamed queries: target, query, intersect, union, qlen, tlen, qpos. Stateless, so late rows need no watermark."""
    keys = ("chr", "strand")
    pairs = overlap_join(queries.select(*keys, "id", "start", "end"), targets.select(*keys, "id", "start", "end"), keys, **bins)
    return pairs.withColumn("qpos", position_class()).selectExpr("t_id as target", "q_id as query", "intersect", "`union`", "qlen", "tlen", "qpos")
