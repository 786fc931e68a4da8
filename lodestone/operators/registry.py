"""Models, their roles, and the model tables' merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import listing
from lodestone.streaming import queue


def role_models(roles: DataFrame, models: DataFrame) -> DataFrame:
    """(role, name, status) of roles (role, model_id) and models (id, name, status); a
    role whose model isn't there has no row."""
    return roles.join(models.select(F.col("id").alias("model_id"), "name", "status"), "model_id").select("role", "name", "status")


def assign(roles: DataFrame, models: DataFrame, role: str, name: str) -> DataFrame:
    """roles with a role given to a model; LookupError for a model that isn't there."""
    found = listing.lookup(models, "name", name).select(F.lit(role).alias("role"), F.col("id").alias("model_id"))
    return listing.upsert(roles, found, "role")


def wanted_models(role_names: DataFrame, candidates: DataFrame) -> DataFrame:
    """The tagged names (name) that roles or candidates ask for, each once."""
    return listing.union_of(*[m.select(text.model_tag(F.col("name")).alias("name")) for m in (role_names, candidates)])


def found_or_created(models: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """models (id, name, status) with a row, not ready yet, for every name that it lacks,
    and the pulls that these need (type, queue, options). Ids go on from the largest; new
    names get them in their order."""
    new = listing.missing_from(names.select(text.model_tag(F.col("name")).alias("name")), models.select("name"))
    top = models.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    rows = new.crossJoin(F.broadcast(top)).select((F.col("top") + 1 + F.monotonically_increasing_id()).alias("id"), "name", F.lit("new").alias("status"))
    return models.unionByName(rows.select(*models.columns)), queue.pull_jobs(new)


def deleted(models: DataFrame, roles: DataFrame, identity: int) -> tuple[DataFrame, DataFrame]:
    """models without one of them, and the job that removes it from the server
    (type, queue, options). ValueError while a role uses it, LookupError if it isn't there."""
    gone = listing.lookup(models, "id", identity)
    job = gone.select(F.lit("delete_llm_model").alias("type"), F.lit("io").alias("queue"), F.to_json(F.struct("name")).alias("options"))
    return listing.guarded_delete(models, "id", identity, roles, "model_id"), job


def created_integration(integrations: DataFrame, fresh: DataFrame) -> DataFrame:
    """integrations with one more; ValueError for a name that is taken."""
    name = fresh.first()["name"]
    if not integrations.filter(F.col("name") == name).isEmpty():
        raise ValueError(f"{name!r} is taken")
    return integrations.unionByName(fresh.select(*integrations.columns))


def replaced_integration(integrations: DataFrame, identity: int, **fields) -> DataFrame:
    """integrations with all given fields of one replaced; its status may only move as the
    machine allows, else ValueError. LookupError if it isn't there."""
    held = listing.lookup(integrations, "id", identity).first()
    move = (held["status"], fields.get("status", held["status"]))
    if move[0] != move[1] and move not in queue.INTEGRATION:
        raise ValueError(f"{move[0]} can't become {move[1]}")
    own = F.col("id") == identity
    return integrations.select(*[F.when(own, F.lit(fields[c])).otherwise(F.col(c)).cast(integrations.schema[c].dataType).alias(c) if c in fields else F.col(c) for c in integrations.columns])
