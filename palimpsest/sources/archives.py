"""Snapshots as ZIP archives of CSV files, one for each element type, and their import as versions."""

from __future__ import annotations

import io
import re
import time
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.parsing import parse
from ..operators.store import Load, Store
from ..operators.tables import materialize
from ..plans.schema import Schema

CONFIG = "import.properties"


class ArchiveError(ValueError):
    pass


def template(schema: Schema) -> str:
    """The header line of each file that an archive of this schema may hold."""
    names = [n.name for n in schema.nodes] + [e.name for e in schema.edges if not schema.is_key_edge(e.name)]
    return "\n".join(f"{n}.csv:" + ",".join(_quote(c) for c, _ in schema.header(n)) for n in names)


def _quote(cell: str) -> str:
    return '"' + cell.replace('"', '""') + '"' if re.search(r'[",\r\n]', cell) else cell


def parse_config(text: str) -> tuple[dict[str, str], dict[str, dict[str, str]]]:
    """Global settings, and settings by element, of ``[Element.]key = value`` lines."""
    globals_, by_element = {}, {}
    for line in text.splitlines():
        line = line.strip()
        if not line or line[0] in "#!":
            continue
        m = re.match(r"([^=:\s]+)\s*[=:\s]\s*(.*)$", line)
        if not m:
            continue
        element, dot, key = m[1].partition(".")
        if dot:
            by_element.setdefault(element, {})[key] = m[2]
        else:
            globals_[m[1]] = m[2]
    return globals_, by_element


def unpack(spark: SparkSession, path: str) -> DataFrame:
    """``element``, ``n`` (record number, 0 for the header) and ``cells`` of every CSV record in the archive's root.

    Archives are read by Spark, so they may lie in any file system it knows; each is unpacked by the task that reads
    it, record by record.  The settings file comes as the element ``import.properties`` with one cell.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv

        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if name == CONFIG:
                            yield pd.DataFrame({"element": [CONFIG], "n": [0], "cells": [[z.read(name).decode("utf-8")]]})
                        elif "/" not in name and name.endswith(".csv"):
                            rows = []
                            with z.open(name) as f:
                                for n, cells in enumerate(csv.reader(io.TextIOWrapper(f, "utf-8", newline=""))):
                                    rows.append((name[:-4], n, cells))
                                    if len(rows) == 10_000:
                                        yield pd.DataFrame(rows, columns=["element", "n", "cells"])
                                        rows = []
                            if rows:
                                yield pd.DataFrame(rows, columns=["element", "n", "cells"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "element string, n long, cells array<string>")


@dataclass
class Report:
    version: int = 0
    warnings: list[str] = field(default_factory=list)
    rejects: dict[str, DataFrame] = field(default_factory=dict)  # records that did not parse
    refused: dict[str, DataFrame] = field(default_factory=dict)  # records without their parent or ends


def typed(schema: Schema, element: str, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of one element as typed rows with ``_n``, and those with a cell too few, too many or unreadable."""
    keys, data = schema.table_columns(element)
    columns = keys + data
    right = F.size("cells") == len(columns)
    cells = [F.when(right, parse(F.get(F.col("cells"), F.lit(i)), p.kind, p.scale)).alias(f"_c{i}") for i, (_, p) in enumerate(columns)]
    parsed = records.select("n", "cells", right.alias("_right"), *cells)
    good = F.col("_right")
    for i in range(len(columns)):
        good = good & F.coalesce(F.col(f"_c{i}.ok"), F.lit(False))
    rows = parsed.filter(good).select(*(F.col(f"_c{i}.v").alias(c) for i, (c, _) in enumerate(columns)), F.col("n").alias("_n"))
    return rows, parsed.filter(~good).select("n", "cells")


def _read(store: Store, path: str) -> tuple[DataFrame, dict[str, str], list[str]]:
    spark, schema = store.spark, store.schema
    records = materialize(unpack(spark, path), "records")
    heads = {r["element"]: r["cells"] for r in records.filter("n = 0").collect()}
    if CONFIG not in heads:
        raise ArchiveError(f"{CONFIG} is missing")
    _, settings = parse_config(heads.pop(CONFIG)[0])
    warnings, modes = [], {}
    known = [n.name for n in schema.nodes] + [e.name for e in schema.edges]
    for name, header in heads.items():
        if name not in known:
            warnings.append(f"{name}: no such element")
        elif schema.is_key_edge(name):
            warnings.append(f"{name}: follows its node and is not imported")
        elif header != [c for c, _ in schema.header(name)]:
            raise ArchiveError(f"{name}: the header must be {','.join(c for c, _ in schema.header(name))}")
        else:
            mode = settings.get(name, {}).get("import")
            if mode is None:
                warnings.append(f"{name}: import mode not set, full assumed")
            elif mode not in ("full", "incremental"):
                raise ArchiveError(f"{name}: unknown import mode {mode}")
            modes[name] = mode or "full"
    return records, modes, warnings


def import_archive(store: Store, path: str, previous: str | None = None, source: str | None = None) -> Report:
    """Import an archive as the next version.

    Each element is loaded ``full`` (what is absent is deleted) or ``incremental`` (nothing is deleted).  With the
    archive of the last import at hand, a full load whose element was full there too is done as a difference: only new
    and changed records are written and only keys that left the file are deleted.  A ``source`` names the import: one that
    a version has already is not applied again.
    """
    records, modes, warnings = _read(store, path)
    last, last_modes = (None, {})
    if previous:
        last, last_modes, _ = _read(store, previous)
    report, loads = Report(warnings=warnings), {}
    for name, mode in modes.items():
        of = lambda all_: all_.filter((F.col("element") == name) & (F.col("n") > 0))  # noqa: B023, E731
        rows, report.rejects[name] = typed(store.schema, name, of(records))
        before = typed(store.schema, name, of(last))[0] if mode == "full" and last_modes.get(name) == "full" else None
        loads[name] = Load(rows, mode, before)
    report.version, report.refused = store.load(loads, source)
    return report


def import_and_file(store: Store, path: str, folder: str) -> Report:
    """``import_archive``, then move the archive to ``imported/<version>.zip`` or ``failed/<time>-<name>`` of a folder.

    The version that an archive became remembers its name, time and length, so a second try after a crash only files it.
    """
    fs, jvm_path = store._fs, store.spark._jvm.org.apache.hadoop.fs.Path
    folder, name = folder.rstrip("/"), path.rstrip("/").rpartition("/")[2]
    last = f"{folder}/imported/{store.version()}.zip"
    if not fs.exists(jvm_path(path)):  # filed by a try before this one
        return Report(store.version(), [f"{name}: no longer there"])
    status = fs.getFileStatus(jvm_path(path))
    source = f"{name}:{status.getModificationTime()}:{status.getLen()}"

    def move(to: str) -> None:
        fs.mkdirs(jvm_path(to).getParent())
        fs.rename(jvm_path(path), jvm_path(to))

    try:
        report = import_archive(store, path, last if fs.exists(jvm_path(last)) else None, source)
    except Exception:
        move(f"{folder}/failed/{int(time.time() * 1000)}-{name}")
        raise
    move(f"{folder}/imported/{report.version}.zip")
    return report
