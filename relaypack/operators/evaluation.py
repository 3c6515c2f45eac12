"""Evaluation: grading of JSON answers, aggregates by condition, latency ranks, reproducible stratified samples."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relaypack.functions.arrow import arrow_function


def strict_load(text: str):
    """JSON without repeated keys and without NaN or infinities."""

    def pairs(items):
        out = dict(items)
        if len(out) != len(items):
            raise ValueError("repeated key")
        return out

    def refuse(x):
        raise ValueError(f"{x} is no JSON")

    return json.loads(text, object_pairs_hook=pairs, parse_constant=refuse)


def _at(value, path: str):
    for part in path.split("."):
        if isinstance(value, dict) and part in value:
            value = value[part]
        elif isinstance(value, list) and part.isdigit() and int(part) < len(value):
            value = value[int(part)]
        else:
            raise KeyError(part)
    return value


def _same(a, b) -> bool:
    """Equal and of one type all through: true is no 1."""
    if type(a) is not type(b):
        return False
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    if isinstance(a, list):
        return len(a) == len(b) and all(map(_same, a, b))
    return a == b


@arrow_function("string")
def check_json(answer: pd.Series, path: pd.Series, operator: pd.Series, expected: pd.Series) -> pd.Series:
    """passed, mismatch, missing_path or invalid_json of each check of an answer."""

    def one(a, p, o, e):
        try:
            value = strict_load(a)
        except (ValueError, TypeError):
            return "invalid_json"
        try:
            value = _at(value, p)
        except KeyError:
            return "missing_path"
        want = json.loads(e)
        if o == "equals":
            ok = _same(value, want)
        else:
            ok = isinstance(value, (list, str)) and all((w in value) if isinstance(value, str) else any(_same(w, v) for v in value) for w in want)
        return "passed" if ok else "mismatch"

    return pd.Series([one(*x) for x in zip(answer, path, operator, expected, strict=True)])


def grade(checks: DataFrame) -> DataFrame:
    """answer_id, n_checks, n_passed, success of checks (answer_id, answer, check_path, operator, expected)."""
    told = checks.withColumn("reason", check_json("answer", "check_path", "operator", "expected"))
    return told.groupBy("answer_id").agg(F.count(F.lit(1)).alias("n_checks"), F.count_if(F.col("reason") == "passed").alias("n_passed"), F.bool_and(F.col("reason") == "passed").alias("success"))


def suite_aggregate(records: DataFrame, by: str = "condition") -> DataFrame:
    """Sums by condition; unknown usage is counted apart from zero, and means leave it out."""
    return records.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("success").alias("n_success"), F.sum(F.coalesce("tokens", F.lit(0))).cast("long").alias("tokens"),
        F.count_if(F.col("tokens").isNull()).alias("n_unknown"), F.avg("tokens").alias("mean_tokens"),
    )


def nearest_rank(values: DataFrame, by: list[str], value: str, share: float = 0.95) -> DataFrame:
    """Median (mean of the middle two) and the value of nearest rank."""
    return values.groupBy(*by).agg(F.median(value).alias("p50"), F.expr(f"percentile_disc({share}) within group (order by {value})").alias("p_rank"), F.count(F.lit(1)).alias("n"))


def hash_rank(seed: str, key: str) -> Column:
    return F.sha2(F.concat(F.lit(seed + ":"), F.col(key)), 256)


def stratified(rows: DataFrame, n: int, seed: str, *, key: str = "instance_id", one_per: str = "repo", strata: tuple[str, ...] = ("repo", "difficulty")) -> DataFrame:
    """A sample of n rows: one of each repo in hash order, then the strata by largest remainder, by hash inside.

    Nothing is ordered globally but to take its first n; of the strata only sums go to the driver.
    """
    h = rows.withColumns({"_h": hash_rank(seed, key), "_rh": hash_rank(seed, one_per)})
    firsts = h.groupBy(one_per, "_rh").agg(F.min_by(key, "_h").alias(key)).orderBy("_rh").limit(n).select(key)
    taken = firsts.count()
    rest = h.join(firsts, key, "left_anti")
    sizes = rest.groupBy(*strata).agg(F.count(F.lit(1)).alias("size"))
    total, left = sizes.agg(F.sum("size")).first()[0] or 0, max(0, n - taken)
    if not total:
        return rows.join(firsts, key, "left_semi")
    sizes = sizes.withColumns({"quota": F.expr(f"({left} * size) div {total}"), "over": F.expr(f"({left} * size) % {total}")})
    spare = left - (sizes.agg(F.sum("quota")).first()[0] or 0)  # below the number of strata, and no more than n
    more_of = sizes.orderBy(F.desc("over"), *strata).limit(spare).select(*(F.col(c).alias(f"_{c}") for c in strata), F.lit(1).alias("one"))
    sizes = sizes.join(more_of, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in strata], "left").select(*strata, (F.col("quota") + F.coalesce("one", F.lit(0))).alias("quota"))
    more = rest.join(sizes, [*strata]).withColumn("_n", F.row_number().over(Window.partitionBy(*strata).orderBy("_h"))).where("_n <= quota").select(key)
    return rows.join(firsts.unionAll(more), key, "left_semi")


def splits(rows: DataFrame, seed: str, sizes: dict[str, int], *, key: str = "instance_id", **how) -> DataFrame:
    """rows with ``split``: disjoint samples drawn one after the other, each from what the ones before left."""
    out, left = None, rows
    for name, n in sizes.items():
        part = stratified(left, n, f"{seed}:{name}", key=key, **how).withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
        left = left.join(part.select(key), key, "left_anti")
    return out


def cyclic(tasks: DataFrame, conditions: tuple[str, ...], place: str = "idx") -> DataFrame:
    """Each task under each condition, their order turned by one from task to task."""
    c = F.posexplode(F.array(*map(F.lit, conditions))).alias("_i", "condition")
    return tasks.select("*", c).withColumn("turn", F.pmod(F.col("_i") - F.col(place), F.lit(len(conditions))).cast("int")).drop("_i")


#: Probes that are broadcast at once: so many, of so many bytes.
PROBES, PROBE_BYTES = 5_000, 8 << 20


def retention(texts: DataFrame, probes: DataFrame, *, text: str = "text", probe: str = "probe") -> DataFrame:
    """probe, n_texts: how many texts hold each probe. Probes are a stated set against all texts, in blocks whose size is checked."""
    n, size = probes.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(probe)), F.lit(0))).first()
    blocks = max(1, -(-n // PROBES), -(-size // PROBE_BYTES))
    told = None
    for b in range(blocks):
        part = probes.where(F.pmod(F.xxhash64(probe), F.lit(blocks)) == b) if blocks > 1 else probes
        hit = texts.join(F.broadcast(part), F.contains(F.col(text), F.col(probe))).groupBy(probe).agg(F.count(F.lit(1)).alias("n"))
        told = hit if told is None else told.unionAll(hit)
    return probes.join(told, probe, "left").select(probe, F.coalesce("n", F.lit(0)).alias("n_texts"))
