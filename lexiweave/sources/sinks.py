"""Writers of edges, scores and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_edge_csv(edges: DataFrame, path: str) -> None:
    """src, dst, weight with a header, a file per partition."""
    edges.select("src", "dst", "weight").write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_edge_parquet(edges: DataFrame, path: str) -> None:
    edges.select("src", "dst", "weight").write.mode("overwrite").parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_metadata(stats: DataFrame, path: str) -> None:
    """A one-row table as JSON with the time of writing."""
    stats.withColumn("created", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")).coalesce(1).write.mode("overwrite").json(path)


def write_results(results: dict[str, DataFrame], path: str) -> None:
    """Several results in one place: JSON lines of name and row, in a folder for each name."""
    for name, rows in results.items():
        rows.select(F.to_json(F.struct(F.lit(name).alias("name"), F.struct(*rows.columns).alias("row"))).alias("value")).write.mode("overwrite").text(f"{path}/name={name}")


def format_table(headers: list[str], rows: list[tuple]) -> str:
    """Rows as aligned text; no rows give an empty string."""
    if not rows:
        return ""
    cells = [[str(h) for h in headers], *[[str(c) for c in r] for r in rows]]
    width = [max(len(r[i]) for r in cells) for i in range(len(headers))]
    line = lambda r: "  ".join(c.ljust(w) for c, w in zip(r, width)).rstrip()
    return "\n".join([line(cells[0]), "  ".join("-" * w for w in width), *map(line, cells[1:])])
