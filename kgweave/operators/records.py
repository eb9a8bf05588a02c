"""Projects, apps and pipelines as tables: resolution, guards, listings, merges of settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tabular import keep_one


def live_projects(projects: DataFrame, include_deleted: bool = False) -> DataFrame:
    return projects if include_deleted else projects.where(~F.coalesce("deleted", F.lit(False)))


def resolve_graphs(apps: DataFrame, projects: DataFrame, fallback_when: str = "unresolved") -> DataFrame:
    """app_id, graph_id of published apps through their projects, in order.

    Where none resolves (or, for "unlisted", where no project is listed at all) the saved graph ids stand in."""
    app = apps.where("is_published")
    listed = app.select("app_id", F.posexplode(F.coalesce("workflow_data.selectedProjectIds", F.array().cast("array<string>"))).alias("ord", "project_id"))
    found = listed.join(live_projects(projects).select("project_id", "graph_id"), "project_id").where("graph_id is not null").select("app_id", "ord", "graph_id")
    covered = (found if fallback_when == "unresolved" else listed).select("app_id").distinct()
    saved = app.join(covered, "app_id", "left_anti").select("app_id", F.posexplode(F.coalesce("workflow_data.selectedGraphIds", F.array().cast("array<string>"))).alias("ord", "graph_id"))
    return keep_one(found.unionByName(saved), ["app_id", "graph_id"], [F.col("ord")])


def referencing_apps(projects: DataFrame, apps: DataFrame) -> DataFrame:
    """Projects with the apps that use them, empty where none does."""
    used = apps.select("app_id", "name", F.explode("workflow_data.selectedProjectIds").alias("project_id")).groupBy("project_id").agg(F.sort_array(F.collect_set(F.struct("app_id", "name"))).alias("apps"))
    out = projects.join(used, "project_id", "left")
    return out.withColumn("apps", F.coalesce("apps", F.array().cast(used.schema["apps"].dataType)))


def deletable(projects: DataFrame, apps: DataFrame) -> DataFrame:
    """Projects that no app uses."""
    return projects.join(apps.select(F.explode("workflow_data.selectedProjectIds").alias("project_id")), "project_id", "left_anti")


def with_project(apps: DataFrame, app_id: str, project_id: str, add: bool = True) -> DataFrame:
    """The app's list with the project once, or without it."""
    ids = F.coalesce("workflow_data.selectedProjectIds", F.array().cast("array<string>"))
    changed = F.array_union(ids, F.array(F.lit(project_id))) if add else F.array_remove(ids, project_id)
    return apps.withColumn("workflow_data", F.when(F.col("app_id") == app_id, F.col("workflow_data").withField("selectedProjectIds", changed)).otherwise(F.col("workflow_data")))


def newest(df: DataFrame, limit: int, key: str, at: str = "created_at") -> DataFrame:
    return df.orderBy(F.desc(at), key).limit(limit)


def pipeline_progress(pipelines: DataFrame) -> DataFrame:
    """Share of stages that are done, in per cent, half up."""
    done = F.size(F.filter("stages", lambda s: s["status"].endswith("completed")))
    return pipelines.withColumn("percent", F.when(F.size("stages") > 0, F.round(100 * done / F.size("stages"))).otherwise(0).cast("int"))


def retry_from(pipelines: DataFrame, stage: str) -> DataFrame:
    """The named stage and all after it waiting again."""
    place = F.array_position(F.transform("stages", lambda s: s["name"]), stage) - 1
    reset = F.transform("stages", lambda s, i: F.when((i >= place) & (place >= 0), s.withField("status", F.lit("pending")).withField("message", F.lit(None).cast("string"))).otherwise(s))
    return pipelines.withColumn("stages", reset).withColumn("current_stage_index", F.greatest(place, F.lit(0)).cast("int"))


def merge_types(old: DataFrame, new: DataFrame, name: str = "name") -> DataFrame:
    """Ontology types of both; names that differ by case only are one, the old first."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    return keep_one(both.withColumn("_key", F.lower(F.trim(name))), ["_key"], [F.col("_side"), F.col(name)]).drop("_side", "_key")


def words_pool(clauses: DataFrame, source: str = "source") -> DataFrame:
    """Topics with their entities, sorted, per source and over all (source null)."""
    each = clauses.select(source, F.explode("topics").alias("t")).select(source, F.trim("t.topic").alias("topic"), F.explode_outer("t.entities").alias("entity")).where("topic <> ''").withColumn("entity", F.nullif(F.trim("entity"), F.lit("")))
    collected = F.sort_array(F.collect_set("entity")).alias("entities")
    return each.groupBy(source, "topic").agg(collected).unionByName(each.groupBy("topic").agg(collected).withColumn(source, F.lit(None).cast(dict(each.dtypes)[source])).select(source, "topic", "entities"))
