"""Entry points: extract features, score them, diagnose, compare arms, report on a folder."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galvana.operators import diagnose, doe, protocol, registry, score, tools, wide
from galvana.sources import cycler, sinks


def extract(samples: DataFrame, setting: wide.Setting = wide.Setting(), order: Sequence[str] = ("row_id",)) -> DataFrame:
    """The wide row of each cell and cycle out of samples (cell_id, cycle, row_id, time, step_type, current, voltage, capacity)."""
    return wide.feature_rows(samples, setting, order)


def extract_csv(spark: SparkSession, path: str | Sequence[str], column_map: cycler.ColumnMap | None = None, cycles: Sequence[int] | None = None, setting: wide.Setting = wide.Setting()) -> DataFrame:
    samples = cycler.read_cycler_csv(spark, path, column_map)
    return extract(samples.where(F.col("cycle").isin(list(cycles))) if cycles is not None else samples, setting)


def score_features(features: DataFrame, health: str = "SoHQ", top_n: int = 15) -> dict[str, DataFrame]:
    """Track A: row scores, contributions, summary and the top indicators."""
    columns = registry.primary_indicator_columns(features)
    summary = score.summarize(features, columns, health)
    return {"scores": score.score_rows(features, columns), "contributions": score.score_long(features, columns), "summary": summary, "top": score.top_per_family(summary, "score", top_n)}


def diagnose_features(features: DataFrame, rules: diagnose.Rules = diagnose.FULL_CELL, health: str = "SoHQ") -> dict[str, DataFrame]:
    """Track A with screens over cycles and cells, and Track B's rule scores; neither is causal."""
    columns = registry.primary_indicator_columns(features)
    screened = score.screen(features, columns, health)
    return score_features(features, health) | {"screen": screened, "cells": score.compare_cells(features, columns), "modes": diagnose.diagnose(features, rules)}


def diagnose_csv(spark: SparkSession, path: str | Sequence[str], rules: diagnose.Rules = diagnose.FULL_CELL, setting: wide.Setting = wide.Setting()) -> dict[str, DataFrame]:
    features = extract_csv(spark, path, setting=setting)
    return {"features": features} | diagnose_features(features, rules)


def diagnose_folder(spark: SparkSession, folder: str, output: str, rules: diagnose.Rules = diagnose.FULL_CELL, setting: wide.Setting = wide.Setting()) -> dict[str, str]:
    """Features and every diagnosis table of a folder's raw files, written below ``output``; the paths by name."""
    paths = cycler.raw_paths(spark, folder)
    if not paths:
        raise ValueError(f"no CSV below {folder}")
    features_path = os.path.join(output, "features.parquet")
    sinks.write_table(extract_csv(spark, paths, setting=setting), features_path)
    features = cycler.read_table(spark, features_path)
    known = [c for c in ("SoHQ", "EoC_restV_end", "EoD_restV_end", "EoC_dchgR_10s", "EoD_chgR_10s", "CE") if c in features.columns]
    tables = diagnose_features(features, rules) | {"indicators": tools.indicator_summary(features, known)}
    out = {"features": features_path}
    for name, table in tables.items():
        out[name] = os.path.join(output, f"{name}.parquet")
        sinks.write_table(table, out[name])
    return out


def compare_arms(features: DataFrame, columns: Sequence[str], early_cycles: int = 30) -> dict[str, DataFrame]:
    """Early parameters, fade, trajectories, late spread and summaries of arms."""
    return {
        "early": doe.early_parameters(features, columns, early_cycles),
        "fade": doe.early_fade(features, early_cycles=early_cycles),
        "trajectories": doe.arm_trajectories(features, columns),
        "late_spread": doe.late_spread(features, columns),
        "summary": doe.arm_summary(features, columns),
    }


def routine(features: DataFrame, steps: DataFrame) -> DataFrame:
    """The rows to score: routine cycles by the protocol of their steps (dchg, current)."""
    return protocol.scoring_rows(protocol.attach_protocol(features, protocol.protocol_kinds(protocol.protocol_flags(protocol.cycle_steps(steps)))))
