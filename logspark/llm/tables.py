"""Small helpers of the operators: columns by exact name, names that clash with nothing, tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from logspark.session import scratch_path


def quoted(name: str) -> str:
    """``name`` as one identifier, dots and back-ticks included."""
    return "`" + name.replace("`", "``") + "`"


def exact(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col(quoted(name))


def free(taken: Iterable[str], *wanted: str) -> list[str]:
    """``wanted``, each lengthened until no name in ``taken`` equals it whatever the case."""
    used = {n.lower() for n in taken}
    out = []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def settled(df: DataFrame, name: str = "turn") -> DataFrame:
    """``df`` written to the shared folder and read again: no earlier plan is kept, and a lost executor loses nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
