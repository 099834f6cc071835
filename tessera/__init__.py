"""A PySpark-native analytics engine: relational operators, functions and constrained optimisation over DataFrames."""

from __future__ import annotations

import os
from pathlib import Path


def share_path(spark) -> None:
    """Lets Python workers import this package from where the driver has it, whatever folder Spark was started in."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join(p for p in (root, *paths) if p)


def connect(*args, **options):
    """A session that takes SQL and hands out relations; see tessera.session."""
    from tessera.session import connect as made

    con = made(*args, **options)
    share_path(con.spark)
    return con
