"""What is registered: queries by name and their SQL.

``query`` fills both; the SQL names the adapters' views as common table expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.plans.adapters import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Register a function under its name, with its SQL over the given views."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            head = ", ".join(f"{v} AS ({SQL[v]})" for v in views)
            body = sql.strip()
            if head:
                body = f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
            ORACLE_SQL[fn.__name__] = body
        return fn

    return register


def u_sql(key: str, seed: int) -> str:
    """``sampling.uniform`` in SQL."""
    return f"CAST('0x' || substring(md5({key} || ':{seed}'), 1, 8) AS BIGINT) / 4294967296.0"


def m_sql(key: str, seed: int) -> str:
    """``faults.draw`` in SQL."""
    return f"CAST(floor({u_sql(key, seed)} * 2147483648.0) AS BIGINT)"


def choice(values, at: Column, kind: str = "string") -> Column:
    """One of the values by place."""
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), at.cast("int"))


def sql_choice(values, at: str) -> str:
    """``choice`` in SQL."""
    quoted = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() for v in values)
    return f"([{quoted}])[CAST({at} AS BIGINT) + 1]"
