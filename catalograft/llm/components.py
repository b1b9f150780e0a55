"""Connected components of a table of links, round by round in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalograft.llm.common import local_components
from catalograft.session import settle


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a task, batch by batch: each end with the smallest end it reaches."""
    for batch in batches:
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        nodes, least = local_components(a, b)
        keep = nodes != least
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes[keep], pa.int64()), pa.array(least[keep], pa.int64())], ["a", "b"]
        )


def components(links: DataFrame) -> DataFrame:
    """(id, component): every end of a link with the smallest end it reaches.

    In: links (a, b) of longs in any direction, repeats and loops allowed. Every round links
    the larger neighbours of each node, then the smaller ones, to the smallest, which needs
    about log(n) rounds on any shape. A node's neighbours are never gathered: its smallest
    is an aggregate, joined back, so a node with very many links can be split. Each round
    is a table in the checkpoint folder.
    """
    ends = F.least("a", "b"), F.greatest("a", "b")
    links = links.where("a is not null and b is not null").select(
        ends[1].alias("a"), ends[0].alias("b")
    )
    links = settle(links.mapInArrow(_forest, "a long, b long").distinct())
    before = None
    while True:
        # larger neighbours to the smallest of a node and its neighbours
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        star = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        star = settle(star.where("a != b").distinct())
        # a node and its smaller neighbours to the smallest of them
        least = star.groupBy("a").agg(F.min("b").alias("m"))
        down = star.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = settle(down.union(least.select("a", F.col("m").alias("b"))).distinct())
        now = links.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if now == before:
            break
        before = now
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
