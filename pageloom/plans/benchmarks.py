"""Benchmark urls and the scores expected of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Url sets, and (url, least score, most score, category).
URL_SETS = {
    "champions": (
        "https://docs.github.com/en", "https://learn.microsoft.com/en-us/azure/", "https://developer.mozilla.org/en-US/docs/Web/HTML",
        "https://docs.python.org/3/tutorial/", "https://kubernetes.io/docs/concepts/overview/what-is-kubernetes/", "https://reactjs.org/docs/getting-started.html",
    ),
    "problematic": (
        "https://stackoverflow.com/questions/tagged/azure", "https://reddit.com/r/programming", "https://techcrunch.com", "https://buzzfeed.com", "https://old-forum-example.com",
    ),
    "decent": (
        "https://en.wikipedia.org/wiki/Cloud_computing", "https://cloud.google.com/functions/docs/concepts/overview", "https://aws.amazon.com/s3/getting-started/",
        "https://medium.com/@tech/programming-article", "https://blog.golang.org/go1.15",
    ),
    "edge_cases": (
        "https://news.ycombinator.com", "https://single-page-app.example.com", "https://pdf-like-document.example.com", "https://heavy-javascript-site.example.com",
    ),
    "mixed": (
        "https://docs.github.com/en", "https://stackoverflow.com/questions/tagged/python", "https://en.wikipedia.org/wiki/Machine_learning", "https://learn.microsoft.com/en-us/dotnet/",
        "https://news.ycombinator.com", "https://developer.mozilla.org/en-US/docs/Web/CSS", "https://aws.amazon.com/documentation/", "https://reddit.com/r/webdev",
    ),
}
EXPECTATIONS = (
    ("https://docs.github.com/en", 80.0, 100.0, "champion"),
    ("https://learn.microsoft.com/en-us/azure/", 80.0, 95.0, "champion"),
    ("https://developer.mozilla.org/en-US/docs/Web/HTML", 75.0, 95.0, "champion"),
    ("https://stackoverflow.com/questions/tagged/azure", 20.0, 50.0, "problematic"),
    ("https://reddit.com/r/programming", 25.0, 45.0, "problematic"),
    ("https://en.wikipedia.org/wiki/Cloud_computing", 60.0, 85.0, "decent"),
    ("https://cloud.google.com/functions/docs/concepts/overview", 45.0, 75.0, "decent"),
    ("https://news.ycombinator.com", 30.0, 60.0, "edge_case"),
)


def url_set(spark: SparkSession, name: str) -> DataFrame:
    """place and url of a named set."""
    return spark.createDataFrame(list(enumerate(URL_SETS[name])), "place int, url string")


def url_sets(spark: SparkSession) -> DataFrame:
    """set and urls, the number of its urls, of every set."""
    return spark.createDataFrame([(name, len(urls)) for name, urls in URL_SETS.items()], "set string, urls int")


def expectations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EXPECTATIONS), "url string, expected_min double, expected_max double, category string")
