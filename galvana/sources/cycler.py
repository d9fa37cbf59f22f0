"""Readers of cycler exports: raw samples, step ends, pair labels, manifests, feature tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galvana.sources import units

#: Logical fields, their canonical units and the headers that stand for them, best first.
FIELDS: dict[str, tuple[str | None, list[str]]] = {
    "cycle": (None, ["cycle", "TotalCycle", "Cycle", "CycleNo", "Cycle_Index"]),
    "voltage": ("V", ["voltage", "Voltage", "Volt", "Ewe"]),
    "current": ("A", ["current", "Current", "AvgCurrent", "I"]),
    "charge_capacity": ("Ah", ["charge_capacity", "ChargeCapacity", "Chg_Capacity"]),
    "discharge_capacity": ("Ah", ["discharge_capacity", "DischargeCapacity", "Dchg_Capacity"]),
    "charge_cv_capacity": ("Ah", ["charge_cv_capacity", "CVCapacity"]),
    "capacity": ("Ah", ["capacity", "Capacity"]),
    "step_type": (None, ["step_type", "StepType", "Type"]),
    "step_no": (None, ["step_no", "StepNo", "Step"]),
    "time": ("s", ["time", "TotalTime", "TotalTime_sec", "Time"]),
    "step_time": ("s", ["step_time", "StepTime", "StepTime_sec"]),
    "data_point": (None, ["data_point", "DataPoint", "Index"]),
    "temperature": ("degC", ["temperature", "Temperature", "Temp"]),
}


@dataclass(frozen=True)
class ColumnMap:
    """Headers that the caller names for logical fields, and units that it states."""

    columns: Mapping[str, str] = field(default_factory=dict)
    units: Mapping[str, str] = field(default_factory=dict)


#: The default maps; both rely on the aliases.
PRESETS = {"pne_default": ColumnMap(), "studio_default": ColumnMap()}


def _plain(header: str) -> str:
    plain = re.sub(r"_(sec|min|mAh|Ah|mA|mV|degC)$", "", re.split(r"[\[(]", header)[0].strip())
    return plain.replace(" ", "").replace("_", "").lower()


def resolve_column(columns: Sequence[str], name: str, explicit: str | None = None) -> str | None:
    """The header of a logical field: the stated one, else by alias, exactly before loosely; alias order beats column order."""
    if explicit:
        if explicit not in columns:
            raise ValueError(f"no column {explicit!r} for {name}")
        return explicit
    aliases = FIELDS[name][1]
    for a in aliases:
        if a in columns:
            return a
    for a in aliases:
        for c in columns:
            if _plain(c) == _plain(a):
                return c
    return None


def normalize(df: DataFrame, column_map: ColumnMap | None = None) -> DataFrame:
    """Logical columns in canonical units, a derived ``capacity``, the other columns kept, rows without a cycle dropped.

    A second call changes nothing. Assumed units stand in the columns' metadata.
    """
    m = column_map or ColumnMap()
    taken: dict[str, str] = {}
    for name in FIELDS:
        found = resolve_column([c for c in df.columns if c not in taken.values()], name, m.columns.get(name))
        if found:
            taken[name] = found
    out: list[Column] = []
    for name, header in taken.items():
        unit = FIELDS[name][0]
        source = F.col(f"`{header}`")
        if unit:
            if header == name:
                if name in m.units and units.factor(m.units[name], unit) != 1:
                    raise ValueError(f"{name} is in {unit} already")
                scale, assumed = 1.0, False
            else:
                scale, assumed = units.resolve(header, unit, m.units.get(name))
            out.append((source.try_cast("double") * scale).alias(name, metadata={"unit": unit, "unit_assumed": assumed}))
        else:
            out.append((source if name == "step_type" else source.try_cast("long")).alias(name))
    if "capacity" not in taken and {"charge_capacity", "discharge_capacity"} <= set(taken):
        scaled = {c: F.col(f"`{taken[c]}`").try_cast("double") * (1.0 if taken[c] == c else units.resolve(taken[c], "Ah", m.units.get(c))[0]) for c in ("charge_capacity", "discharge_capacity")}
        out.append(F.greatest(scaled["charge_capacity"], scaled["discharge_capacity"]).alias("capacity"))
    extras = [F.col(f"`{c}`") for c in df.columns if c not in taken.values() and c not in taken and c != "capacity"]
    rows = df.select(*out, *extras)
    return rows.where(F.col("cycle").isNotNull()) if "cycle" in taken else rows


def with_row_id(df: DataFrame) -> DataFrame:
    """Add ``file`` and ``row_id``: file order matters, and ids rise within a file as Spark reads it."""
    return df.withColumns({"file": F.col("_metadata.file_path"), "row_id": F.monotonically_increasing_id()})


def cell_id_of(file: Column | str) -> Column:
    """The cell in a path's parent folder or file name, as ``M01Ch005``."""
    path = F.col(file) if isinstance(file, str) else file
    found = F.regexp_extract(path, r"(M\d+Ch\d+)", 1)
    return F.when(found != "", found).otherwise(F.regexp_extract(path, r"([^/]+?)(?:_raw)?\.[^./]+$", 1))


def read_cycler_csv(spark: SparkSession, path: str | Sequence[str], column_map: ColumnMap | None = None, encoding: str = "UTF-8") -> DataFrame:
    """Raw samples of one or many files; malformed lines are left out."""
    raw = spark.read.option("header", True).option("mode", "DROPMALFORMED").option("encoding", encoding).csv(path)
    rows = normalize(with_row_id(raw), column_map)
    return rows.withColumn("cell_id", cell_id_of("file")) if "cell_id" not in rows.columns else rows


def raw_paths(spark: SparkSession, folder: str) -> list[str]:
    """The raw files of a folder: ``*_raw.csv`` where there are any, else ``*.csv``. Names alone come to the driver."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for pattern in ("*_raw.csv", "*.csv"):
        found = sorted(str(x.getPath()) for x in files.globStatus(jvm.org.apache.hadoop.fs.Path(path, pattern)) or [])
        if found:
            return found
    return []


def step_end_path(raw_path: str) -> str:
    """The step-end file beside a raw file, by name."""
    return re.sub(r"(?:_raw)?\.csv$", "_StepEnd.csv", raw_path)


def step_duration_s(value: Column | str) -> Column:
    """Seconds of ``H:M:S``, ``M:S`` or a number; null for anything else."""
    v = F.trim(F.col(value) if isinstance(value, str) else value)
    p = F.transform(F.split(v, ":"), lambda x: x.try_cast("double"))
    n = F.size(p)
    return F.when(n == 3, p[0] * 3600 + F.try_element_at(p, F.lit(2)) * 60 + F.try_element_at(p, F.lit(3))).when(n == 2, p[0] * 60 + F.try_element_at(p, F.lit(2))).otherwise(v.try_cast("double"))


def leg_of_current(current: Column | str, dead: float = 0.05) -> Column:
    i = F.col(current) if isinstance(current, str) else current
    return F.when(i > dead, "charge").when(i < -dead, "discharge").otherwise("rest")


def read_step_ends(spark: SparkSession, path: str, encoding: str = "cp949") -> DataFrame:
    """Step-end rows of all ``*StepEnd.csv`` below a folder, with leg and duration."""
    raw = spark.read.option("header", True).option("encoding", encoding).option("pathGlobFilter", "*StepEnd.csv").option("recursiveFileLookup", True).csv(path)
    rows = normalize(with_row_id(raw))
    if "StepTime" in raw.columns:
        rows = rows.withColumn("step_time_s", step_duration_s(F.col("step_time").cast("string")) if "step_time" in rows.columns else F.lit(None).cast("double"))
    return rows.withColumns({"leg": leg_of_current("current"), "cell_id": cell_id_of("file")})


def pair_cycles(labels: DataFrame) -> DataFrame:
    """``pair_label, tagged_cycle, cycle`` from labels ``Cycle-N`` (PairLabel, cycle, row_id); of repeated ones the last."""
    n = F.regexp_extract("PairLabel", r"(?i)cycle\s*-\s*(\d+)", 1).try_cast("long")
    rows = labels.withColumn("tagged_cycle", n).where("tagged_cycle is not null")
    return rows.groupBy("tagged_cycle").agg(F.max_by("cycle", "row_id").alias("cycle"), F.max_by("PairLabel", "row_id").alias("pair_label"))


def routine_tags(kinds: DataFrame) -> DataFrame:
    """Where no labels are: a cell's routine cycles numbered from 1."""
    w = Window.partitionBy("cell_id").orderBy("cycle")
    return kinds.where("protocol_kind = 'routine'").select("cell_id", "cycle", F.row_number().over(w).cast("long").alias("tagged_cycle"))


def read_manifest(spark: SparkSession, path: str, doe: str) -> DataFrame:
    """``arm, cell_id, path`` of the cells of an experiment."""
    cells = spark.read.option("multiLine", True).json(path).select(F.explode("cells").alias("c")).select("c.*")
    return cells.where(F.col("doe") == doe).select("arm", "cell_id", "path")


def half_cell_cycles(samples: DataFrame, reset: float = -0.01, trend: float = 0.01, keys: Sequence[str] = ("file",)) -> DataFrame:
    """Cycles of a half cell's log (time, voltage, row_id): segments at clock resets, a new cycle at each start of a discharge."""
    w = Window.partitionBy(*keys).orderBy("row_id")
    rows = samples.withColumn("_s", F.sum(F.coalesce(F.col("time") - F.lag("time").over(w) < reset, F.lit(False)).cast("int")).over(w))
    ends = rows.groupBy(*keys, "_s").agg((F.max_by("voltage", "row_id") - F.min_by("voltage", "row_id")).alias("_dv"))
    kind = F.when(F.col("_dv") > trend, "charge").when(F.col("_dv") < -trend, "discharge").otherwise("rest")
    v = Window.partitionBy(*keys).orderBy("_s")
    ends = ends.withColumn("step_type", kind).withColumn("_n", ((F.col("step_type") == "discharge") & (F.coalesce(F.lag("step_type").over(v), F.lit("")) != "discharge")).cast("int"))
    ends = ends.withColumn("cycle", F.greatest(F.lit(1), F.sum("_n").over(v)))
    return rows.join(ends.select(*keys, "_s", "step_type", "cycle"), [*keys, "_s"]).drop("_s")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A feature table by its suffix: Parquet, else CSV with a header."""
    return spark.read.parquet(path) if path.rstrip("/").endswith((".parquet", ".pq")) else spark.read.option("header", True).option("inferSchema", True).csv(path)
