"""A registry of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rounded(col: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(F.col(col) if isinstance(col, str) else col, digits) + F.lit(0.0)


def rounded_columns(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: rounded(n, digits) for n in names})


def sql_columns(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 as {n}" for n in names)


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable:
        def keep(fn: Callable) -> Callable:
            self.queries[fn.__name__] = fn
            if sql:
                self.sql[fn.__name__] = sql
            return fn

        return keep


# The driver tables as images, volumes and orientations, in SQL.
EACH = "each_ as (select vec_id as id, unnest(embedding)::double as v, unnest(range(0, 64))::int as p from embeddings)"
PX = f"{EACH}, px as (select id as image_id, 0 as panel, p // 8 as r, p % 8 as c, v from each_)"
PX4 = f"{EACH}, px4 as (select id as image_id, p // 16 as panel, (p % 16) // 4 as r, p % 4 as c, v from each_)"
VOL = f"{EACH}, vol as (select id as vol_id, p // 16 as i, (p // 4) % 4 as j, p % 4 as k, v from each_)"
DET = (
    "det as (select 0 as panel, r, c, c - 3.5::double as qx, r - 3.5::double as qy, 0.0::double as qz, 7 - r as ix, c as iy "
    "from (select unnest(range(0, 8))::int as r) cross join (select unnest(range(0, 8))::int as c))"
)
ORIENT = (
    "raw_q as (select vec_id as image_id, embedding[1]::double as a, embedding[2]::double as b, embedding[3]::double as c, embedding[4]::double as d from embeddings), "
    "orient as (select image_id, a / s as w, b / s as x, c / s as y, d / s as z from (select *, sqrt(a * a + b * b + c * c + d * d) as s from raw_q))"
)
ROT = (
    "rot as (select image_id, 1 - 2 * (y * y + z * z) as m00, 2 * (x * y - w * z) as m01, 2 * (x * z + w * y) as m02, 2 * (x * y + w * z) as m10, "
    "1 - 2 * (x * x + z * z) as m11, 2 * (y * z - w * x) as m12, 2 * (x * z - w * y) as m20, 2 * (y * z + w * x) as m21, 1 - 2 * (x * x + y * y) as m22 from orient)"
)
HKL = (
    "hkl as (select image_id, panel, r, c, m00 * qx + m10 * qy + m20 * qz as h, m01 * qx + m11 * qy + m21 * qz as k, m02 * qx + m12 * qy + m22 * qz as l from rot cross join det)"
)
PAIRS = (
    f"{EACH}, pairs as (select a.id as image_id, b.id as ref_id, sum((a.v - b.v) * (a.v - b.v)) as distance, "
    "sum((a.v - b.v) * (a.v - b.v) / (1 + a.p)) as weighted from each_ a join each_ b on a.p = b.p and a.id % 20 = 0 and b.id <> a.id group by 1, 2)"
)
