"""Benchmark fixtures and task manifests: JSON documents that are checked when they are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIXTURE = "id string, budget bigint, messages array<string>, secrets array<string>, clean array<string>, facts array<string>"
MANIFEST = "version string, tasks array<struct<id:string,category:string,path:string>>"


def broken_fixture() -> Column:
    """The first rule that a fixture breaks: it must test something. Probes of a kind are distinct, occur in its messages, and clean ones are no secrets."""
    text = F.array_join("messages", "\n")
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    twice = lambda c: F.size(c) != F.size(F.array_distinct(c))
    rules = [
        ("no_messages", none("messages")), ("bad_budget", ~F.coalesce(F.col("budget") > 0, F.lit(False))), ("no_secrets", none("secrets")), ("no_facts", none("facts")),
        ("repeated_probe", twice("secrets") | twice("facts") | F.coalesce(twice("clean"), F.lit(False))), ("blank_probe", F.exists(F.concat("secrets", "facts"), lambda x: F.trim(x) == "")),
        ("absent_probe", F.exists(F.concat("secrets", "facts"), lambda x: ~F.contains(text, x))), ("clean_is_secret", F.coalesce(F.arrays_overlap("clean", "secrets"), F.lit(False))),
    ]
    out = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        out = F.when(broken, name).otherwise(out)
    return out


def load_fixture(spark: SparkSession, path: str) -> DataFrame:
    """Fixtures of a JSON document; raises with the first rule broken."""
    rows = spark.read.schema(FIXTURE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    bad = rows.select("id", broken_fixture().alias("code")).where("code is not null").first()
    if bad or rows.isEmpty():
        raise ValueError(f"fixture {bad.id if bad else path}: {bad.code if bad else 'empty'}")
    return rows


def manifest_tasks(manifest: DataFrame) -> DataFrame:
    """(version, id, category, path, code) of each task of some manifests: within one, ids are distinct, paths stay inside and are distinct, categories are named."""
    t = manifest.select("version", F.explode("tasks").alias("t")).select("version", "t.id", "t.category", "t.path")
    n = t.groupBy("version", "id").agg(F.count(F.lit(1)).alias("n_id"))
    p = t.groupBy("version", "path").agg(F.count(F.lit(1)).alias("n_path"))
    told = t.join(n, ["version", "id"], "left").join(p, ["version", "path"], "left")
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    outside = F.col("path").startswith("/") | F.col("path").rlike(r"(^|/)\.\.(/|$)")
    code = F.when(blank(F.col("id")) | blank(F.col("path")), "blank").when(F.col("n_id") > 1, "repeated_id").when(F.col("n_path") > 1, "repeated_path").when(blank(F.col("category")), "no_category").when(outside, "path_outside")
    return told.select("version", "id", "category", "path", code.alias("code"))


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The tasks of a manifest; raises with the first rule broken."""
    rows = manifest_tasks(spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path))
    bad = rows.where("code is not null").orderBy("id").first()
    if bad or rows.isEmpty():
        raise ValueError(f"manifest task {bad.id if bad else path}: {bad.code if bad else 'empty'}")
    return rows.drop("code")
