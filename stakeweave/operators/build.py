"""From validated rows to the ownership network: names are resolved to entities, entities become nodes and relations edges."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stakeweave.plans.iterate import cut, some

from . import resolve

PROMOTERS = ("Promoter", "Promoter Group")


class Network(NamedTuple):
    nodes: DataFrame  # id, name, entity_type, listed
    edges: DataFrame  # holder, held, stake (a fraction), role, records
    issues: DataFrame  # line, kind, message of relations that resolution made one with themselves
    names: DataFrame  # raw, filed_type, entity_id


class SelfOwnershipError(ValueError):
    """Two names of one relation belong to the same entity."""


def filed(records: DataFrame) -> DataFrame:
    """raw, filed_type, listed, cin, line of both sides of records(holder_name, entity_type, held_name[, holder_cin, held_cin, line])."""
    for c, kind in (("holder_cin", "string"), ("held_cin", "string"), ("line", "long")):
        records = records if c in records.columns else records.withColumn(c, F.lit(None).cast(kind))
    holder = F.struct(F.col("holder_name").alias("raw"), F.lower("entity_type").alias("filed_type"), F.lit(False).alias("listed"), F.col("holder_cin").alias("cin"), "line")
    held = F.struct(F.col("held_name").alias("raw"), F.lit("corporate").alias("filed_type"), F.lit(True).alias("listed"), F.col("held_cin").alias("cin"), "line")
    return records.select(F.inline(F.array(holder, held)))


def network(records: DataFrame, strict: bool = False, **switches) -> Network:
    """The network of loaded records(holder_name, entity_type, held_name, stake in percent[, holder_role, line, holder_cin, held_cin]).

    Every entity is a node, with or without edges; parallel relations are summed. A relation whose names resolve to one entity
    is an issue, not an edge; strict raises SelfOwnershipError instead. `switches` are those of resolve.merge_candidates.
    """
    for c, kind in (("holder_role", "string"), ("line", "long")):
        records = records if c in records.columns else records.withColumn(c, F.lit(None).cast(kind))
    obs = resolve.observations(filed(records))
    roots, _ = resolve.merged(obs, cut(resolve.merge_candidates(obs, **switches)))
    found = cut(resolve.entities(obs, roots))
    names = cut(resolve.entity_map(obs, roots, found))
    holder = names.select(F.col("raw").alias("holder_name"), F.col("filed_type").alias("filed"), F.col("entity_id").alias("holder"))
    held = names.filter("filed_type = 'corporate'").select(F.col("raw").alias("held_name"), F.col("entity_id").alias("held"))
    told = cut(records.withColumn("filed", F.lower("entity_type")).join(holder, ["holder_name", "filed"]).join(held, "held_name"))
    same = told.filter("holder = held")
    if strict and some(same):
        row = same.select("line", "holder_name", "held_name").first()
        raise SelfOwnershipError(f"line {row.line}: {row.holder_name!r} and {row.held_name!r} are one entity")
    issues = same.select("line", F.lit("self_ownership_resolved").alias("kind"), F.concat_ws(" ", "holder_name", F.lit("and"), "held_name", F.lit("are one entity"), "holder").alias("message"))
    promoter = F.bool_or(F.coalesce(F.col("holder_role").isin(*PROMOTERS), F.lit(False)))
    edges = told.filter("holder != held").groupBy("holder", "held").agg(
        (F.sum("stake") / 100).alias("stake"), F.when(promoter, PROMOTERS[0]).otherwise(F.max("holder_role")).alias("role"), F.count("*").alias("records")
    )  # a promoter edge has one such record at least
    return Network(found.select(F.col("entity_id").alias("id"), "name", "entity_type", "listed"), edges, issues, names)
