"""Session settings that suit the engine's plans."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers started from now on import this library from where the driver has it.

    Needed where the driver found it by its module path alone; a cluster without that folder gets the library by
    ``--py-files`` or an installed package.
    """
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, *paths]))
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Settings that may change while a session runs.

    Recognition projects about fifty fields from one line.  Fused into one method that is more code than the JVM compiles,
    and runs three times slower than the same operators unfused, so wide operators are left unfused.
    Constraints are not propagated: through the projections' chains of names over file names that are told by patterns they
    multiply until the planner's memory is used up.
    """
    spark.conf.set("spark.sql.codegen.maxFields", "50")
    spark.conf.set("spark.sql.constraintPropagation.enabled", "false")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    return spark
