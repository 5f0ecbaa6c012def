"""Writers (K1-K4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def write_units(df: DataFrame, path: str, columns: list[str] | None = None, fmt: str = "tsv") -> None:
    """K1: fixed column order; as TSV with flags as 1 and 0 and arrays joined by ``;``, or as Parquet."""
    d = df.select(*(columns or df.columns))
    if fmt == "parquet":
        d.write.mode("errorifexists").parquet(path)
        return
    out = []
    for f in d.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, T.BooleanType):
            c = c.cast("int").cast("string")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, ";")
        out.append(c.alias(f.name))
    d.select(*out).write.mode("errorifexists").csv(path, sep="\t", header=True, nullValue="", quote="", emptyValue="")


def write_unit_set(units: DataFrame, inner: DataFrame, path: str, fmt: str = "tsv") -> None:
    """K2: units and their inner boundaries beside each other."""
    write_units(units, f"{path}_units", fmt=fmt)
    write_units(inner, f"{path}_internal_boundaries", fmt=fmt)


def write_report(report: DataFrame, path: str) -> None:
    """K3: long metric report, one folder per analysis."""
    report.write.mode("errorifexists").partitionBy("analysis").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """K4: run parameters or rates as JSON lines."""
    df.write.mode("errorifexists").json(path)
