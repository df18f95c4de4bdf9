"""Running aggregates within keys of any size: in blocks of bounded length, and over the blocks' totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of one block, whose rows are taken in one task.
BLOCK = 4096

#: Associative aggregates: (of many, of two).
HOW = {"sum": (F.sum, lambda a, b: a + b), "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b)), "max": (F.max, lambda a, b: F.greatest(a, b))}


def running(rows: DataFrame, key: list[str], at: Column, last: int, what: dict[str, tuple[Column, str]], block: int = BLOCK) -> DataFrame:
    """``rows`` with, for each name, the aggregate (a column and one of HOW) over the rows of the same key up to and with the row's own place.

    ``at`` is a place from 0 to ``last``, each once in a key; keys aren't null. A key that holds a third of all rows is taken in as many
    parts as it has blocks. ``rows`` is read twice if there is more than one block: write it to a table first.
    """
    rows = rows.withColumns({"__at": at, "__block": F.floor(at / block)})
    within = Window.partitionBy(*key, "__block").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumns({n: HOW[how][0](c).over(within) for n, (c, how) in what.items()})
    if last >= block:
        totals = rows.groupBy(*key, "__block").agg(*[HOW[how][0](c).alias(f"__{n}") for n, (c, how) in what.items()])
        before = Window.partitionBy(*key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.withColumns({f"__{n}": HOW[how][0](f"__{n}").over(before) for n, (_, how) in what.items()})
        out = out.join(totals, [*key, "__block"])
        both = lambda n, how: F.when(F.col(f"__{n}").isNull(), F.col(n)).when(F.col(n).isNull(), F.col(f"__{n}")).otherwise(HOW[how][1](F.col(n), F.col(f"__{n}")))
        out = out.withColumns({n: both(n, how) for n, (_, how) in what.items()}).drop(*[f"__{n}" for n in what])
    return out.drop("__at", "__block")
