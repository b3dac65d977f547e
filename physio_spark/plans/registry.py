"""Registry of queries over the supplied tables, each with the SQL that defines its result."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from physio_spark.runtime import prepare

DIGITS = 6


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def tidy(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round doubles (adding 0 turns -0 into 0) and widen integers, as the SQL side does."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        out.append(c.alias(name))
    return df.select(*out)


def final(
    body: str,
    select: str,
    doubles: Sequence[str] = (),
    longs: Sequence[str] = (),
    digits: int = DIGITS,
) -> str:
    """Complete a WITH clause: run ``select`` and bring numbers to the common form."""
    fixes = [f"round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in doubles]
    fixes += [f"CAST({c} AS BIGINT) AS {c}" for c in longs]
    replace = f" REPLACE ({', '.join(fixes)})" if fixes else ""
    head = f"WITH {body.strip().rstrip(',')} " if body.strip() else ""
    return f"{head}SELECT *{replace} FROM ({select}) AS result"


def query(name: str, sql: str | None = None, digits: int = DIGITS):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(prepare(spark), sf_dir), digits)

        REGISTRY[name] = Query(name, run, sql)
        return fn

    return register
