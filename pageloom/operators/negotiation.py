"""Content negotiation: what a site answers to five Accept headers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bonus points of an alternative format that is served.
BONUS = (("markdown", 10.0), ("json", 5.0), ("plain", 3.0))


def negotiation_scores(responses: DataFrame) -> DataFrame:
    """Scores of (url, accept_header, status_code, content_hash); text/html is the baseline."""
    answer = F.struct("accept_header", "status_code", "content_hash")
    html = F.col("accept_header") == "text/html"
    rows = responses.groupBy("url").agg(F.max(F.when(html, answer)).alias("base"), F.collect_list(F.when(~html, answer)).alias("others"))
    served = F.filter("others", lambda x: x["status_code"] == 200)
    return rows.select("url", availability(served).alias("format_availability_score"), consistency(served).alias("content_consistency_score"), optimised(served).alias("agent_optimization_detected"))


def availability(served: Column) -> Column:
    def bonus(x: Column) -> Column:
        return reduce(lambda e, b: F.when(x["accept_header"].contains(b[0]), b[1]).otherwise(e), reversed(BONUS), F.lit(0.0))

    points = F.aggregate(served, F.lit(50.0), lambda s, x: s + 12.5 + bonus(x))
    return F.when(F.coalesce(F.col("base.status_code") != 200, F.lit(True)), 0.0).otherwise(F.least(points, F.lit(100.0)))


def _other(served: Column) -> Column:
    return F.size(F.filter(served, lambda x: ~x["content_hash"].eqNullSafe(F.col("base.content_hash"))))


def consistency(served: Column) -> Column:
    return F.when(F.size(served) == 0, 100.0).otherwise(_other(served) / F.size(served).cast("double") * 100.0)


def optimised(served: Column) -> Column:
    return ((F.size(served) >= 2) & (_other(served) > 0)) | F.exists(served, lambda x: x["accept_header"].contains("markdown"))
