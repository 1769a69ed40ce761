"""Strict parsing of text cells into typed columns; a cell that does not parse is null and marks its record."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_INTEGERS = {"byte": "tinyint", "short": "smallint", "int": "int", "long": "bigint"}
SIMPLE = ("boolean", "byte", "short", "int", "long", "float", "double", "decimal", "char", "string", "timestamp", "enum")


def spark_type(kind: str, scale: int = 18) -> str:
    """The Spark type that stores a property kind; ``array<x>`` and ``option<x>`` nest one simple kind."""
    if kind.startswith("array<"):
        return f"array<{spark_type(kind[6:-1], scale)}>"
    if kind.startswith("option<"):
        return spark_type(kind[7:-1], scale)
    base = kind.split("(")[0]
    if base not in SIMPLE:
        raise ValueError(f"unknown property kind {kind}")
    return {"decimal": f"decimal(38,{scale})", "char": "string", "enum": "string", **_INTEGERS}.get(base, base)


def parse(cell: Column, kind: str, scale: int = 18) -> Column:
    """``struct<ok:boolean,v:T>`` of a text cell; a null cell does not parse."""
    out = spark_type(kind, scale)
    if kind.startswith("option<"):
        inner = parse(F.regexp_extract(cell, r"(?s)^\[(.*)\]$", 1), kind[7:-1], scale)
        some = cell.rlike(r"(?s)^\[.*\]$")
        return F.struct(F.coalesce((cell == "None") | (some & inner["ok"]), F.lit(False)).alias("ok"), F.when(some & inner["ok"], inner["v"]).cast(out).alias("v"))
    if kind.startswith("array<"):
        body = F.regexp_extract(cell, r"(?s)^\[(.*)\]$", 1)
        # like a split that forgets empty items at the end
        items = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(body, ",+$", ""), ","))
        parsed = F.transform(items, lambda x: parse(x, kind[6:-1], scale))
        good = cell.rlike(r"(?s)^\[.*\]$") & F.forall(parsed, lambda p: p["ok"])
        return F.struct(F.coalesce(good, F.lit(False)).alias("ok"), F.when(good, F.transform(parsed, lambda p: p["v"])).cast(out).alias("v"))
    base = kind.split("(")[0]
    if base == "boolean":
        value = F.when(F.lower(cell).isin("true", "1"), F.lit(True)).when(F.lower(cell).isin("false", "0"), F.lit(False))
    elif base in _INTEGERS:
        value = F.when(cell.rlike("^[+-]?[0-9]+$"), cell.try_cast(out))
    elif base == "decimal":
        value = F.when(cell.rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"), cell.try_cast(out))
    elif base in ("float", "double", "timestamp"):
        value = cell.try_cast(out)
    elif base == "char":
        value = F.when(F.length(cell) == 1, cell)
    elif base == "enum":
        names = kind[5:-1].split("|")
        by_number = F.get(F.array(*map(F.lit, names)), F.when(cell.rlike("^[0-9]{1,4}$"), cell.try_cast("int")))
        value = F.coalesce(F.when(cell.isin(*names), cell), by_number)
    else:
        value = cell
    return F.struct(value.isNotNull().alias("ok"), value.cast(out).alias("v"))
