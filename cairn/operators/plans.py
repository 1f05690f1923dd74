"""Task plans as a model writes them: JSON to steps, and the checks a plan must pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.graph import dag_validate

# Tools that a step may ask for, and how many steps a plan has.
STEP_TOOLS = ("write_file", "run_command", "search_code", "ask_user")
MIN_STEPS, MAX_STEPS = 5, 10

_RAW = "plan array<struct<id:string,description:string,details:string,dependencies:string,suggested_tool:string>>"


def _parsed(raw: DataFrame) -> DataFrame:
    """(plan, steps) of ``raw`` (plan, raw); a bare array counts as the plan."""
    text = F.when(F.ltrim("raw").startswith("["), F.concat(F.lit('{"plan":'), "raw", F.lit("}"))).otherwise(F.col("raw"))
    return raw.select("plan", F.try_parse_json("raw").isNotNull().alias("valid"), F.from_json(text, _RAW)["plan"].alias("steps"))


def plan_convert(raw: DataFrame) -> DataFrame:
    """Steps (plan, ord, id, description, details, deps, action): a missing id becomes step_N, missing details the
    description, dependencies that are no list an empty one, and a tool that is not known no tool."""
    s = _parsed(raw).select("plan", F.posexplode("steps").alias("ord", "s"))
    description = F.trim(F.coalesce("s.description", F.lit("")))
    return s.select(
        "plan", "ord", F.coalesce(F.nullif("s.id", F.lit("")), F.concat(F.lit("step_"), (F.col("ord") + 1).cast("string"))).alias("id"),
        description.alias("description"), F.coalesce(F.nullif(F.trim("s.details"), F.lit("")), description).alias("details"),
        F.coalesce(F.from_json("s.dependencies", "array<string>"), F.array().cast("array<string>")).alias("deps"),
        F.when(F.col("s.suggested_tool").isin(*STEP_TOOLS), F.col("s.suggested_tool")).otherwise("").alias("action"),
    )


def plan_merge_checks(raw: DataFrame) -> DataFrame:
    """One row (plan, violation) per check a plan fails: json, plan, description, count, missing, self, cycle."""
    p = _parsed(raw)
    steps = plan_convert(raw)
    flat = p.filter("not valid or steps is null or size(steps) not between 5 and 10").select("plan", F.when(~F.col("valid"), "json").when(F.col("steps").isNull(), "plan").otherwise("count").alias("violation"))
    blank = steps.filter("description = ''").select("plan", F.lit("description").alias("violation"))
    return reduce(DataFrame.unionByName, [flat, blank, dag_validate(steps).select("plan", "violation")]).distinct()
