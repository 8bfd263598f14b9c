"""File profiles: what a file looks like before anything is scored."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numbers import percent, ratio
from ..functions.text import NONE, SKIP_REASONS, should_skip

EMPTY_RATE_LIMIT = 0.1
LONG_TEXT_LIMIT = 5000


def profile_rows(
    df: DataFrame,
    file_col: str = "source_file",
    text_col: str = "text",
    empty_rate_limit: float = EMPTY_RATE_LIMIT,
    long_text_limit: int = LONG_TEXT_LIMIT,
) -> DataFrame:
    """One row per file from a triaged table, in a single grouped pass."""
    reason = F.col("skip_reason")
    valid = reason == NONE
    length = F.when(valid, F.length(text_col))
    rows = F.count("*")
    counts = {name: f"n_{name}" for name in SKIP_REASONS if name != NONE}
    grouped = df.groupBy(file_col).agg(
        rows.alias("total_rows"),
        ratio(F.count_if(should_skip(reason)), rows).alias("empty_rate"),
        F.coalesce(F.floor(ratio(F.sum(length), F.count(length))), F.lit(0))
        .cast("bigint")
        .alias("avg_text_length"),
        F.coalesce(F.max(length), F.lit(0)).cast("bigint").alias("max_text_length"),
        *[F.count_if(reason == name).alias(column) for name, column in counts.items()],
    )
    too_empty = F.col("empty_rate") > empty_rate_limit
    too_long = F.col("max_text_length") > long_text_limit

    def issue(code: str, n, pct):
        return F.struct(
            F.lit(code).alias("code"), n.cast("bigint").alias("n"), pct.cast("double").alias("pct")
        )

    found = [
        F.when(
            too_empty,
            issue(
                "empty_rate",
                F.round(F.col("empty_rate") * F.col("total_rows")),
                F.col("empty_rate") * 100.0,
            ),
        )
    ]
    for name, column in counts.items():
        share = percent(F.col(column), F.col("total_rows"))
        found.append(F.when(F.col(column) > 0, issue(name, F.col(column), share)))
    found.append(F.when(too_long, issue("long_text", F.col("max_text_length"), F.lit(0.0))))
    return grouped.withColumn(
        "status", F.when(too_empty | too_long, "warning").otherwise("valid")
    ).withColumn("issues", F.array_compact(F.array(*found)))


def issue_codes(issues: str = "issues"):
    return F.array_join(F.transform(F.col(issues), lambda item: item["code"]), "|")


def status_rollup(profiles: DataFrame) -> DataFrame:
    """Number of files per status, all three statuses always listed."""
    n = {name: F.count_if(F.col("status") == name) for name in ("valid", "warning", "error")}
    rows = F.array(
        *[F.struct(F.lit(name).alias("status"), count.alias("n")) for name, count in n.items()]
    )
    return profiles.agg(rows.alias("rows")).select(F.inline("rows"))
