"""Daily profiles and their k-means clusters.

All entities and kinds of profiles are clustered in one plan, a group for each: the days of one entity are a matrix of a
known size (a century of quarter hours is 36,525 x 96), which one task holds. Fits and silhouettes run there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .entities import ENTITY_DAY, peak_normalize

KEYS = ["entity_id", "profile_kind"]
SCHEMA = "entity_id string, profile_kind string, success boolean, k int, labels array<struct<local_date:date,cluster_id:int>>, scores array<struct<k:int,silhouette:double>>"


def profile_matrix(df: DataFrame, *, per_day: int, value: str = "demand_kw") -> DataFrame:
    """entity_id, local_date, profile: complete days only, in time order."""
    p = F.transform(F.array_sort(F.collect_list(F.struct("ts_s", F.col(value).alias("v")))), lambda x: x["v"])
    got = df.groupBy(*ENTITY_DAY).agg(F.count("*").alias("n"), F.count(value).alias("seen"), p.alias("profile"))
    return got.where((F.col("n") == per_day) & (F.col("seen") == per_day)).select(*ENTITY_DAY, "profile")


def profiles(frame: DataFrame, *, per_day: int) -> DataFrame:
    """Absolute and peak-normalized profiles of all entities: entity_id, profile_kind, local_date, profile."""
    f = peak_normalize(frame)
    kinds = (("absolute", "demand_kw"), ("normalized", "peak_normalized"))
    a, b = (
        profile_matrix(f, per_day=per_day, value=value).withColumn("profile_kind", F.lit(kind)) for kind, value in kinds
    )
    return a.unionByName(b).select(*KEYS, "local_date", "profile")


def kmeans(x: np.ndarray, k: int, seed: int, tries: int, rounds: int = 300) -> np.ndarray:
    """Labels of the best of ``tries`` runs, each from seeds that lie far apart by chance (k-means++)."""
    rng, best = np.random.default_rng(seed), (np.inf, np.zeros(len(x), int))
    norm = (x * x).sum(1)
    for _ in range(tries):
        centers = x[rng.integers(len(x))][None]
        for _ in range(1, k):
            far = np.maximum(0, (norm[:, None] - 2 * x @ centers.T + (centers * centers).sum(1)).min(1))
            centers = np.vstack(
                [centers, x[rng.choice(len(x), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(x))]]
            )
        label = None
        for _ in range(rounds):
            apart = norm[:, None] - 2 * x @ centers.T + (centers * centers).sum(1)
            new = apart.argmin(1)
            if label is not None and (new == label).all():
                break
            label = new
            size = np.bincount(label, minlength=k)
            sums = np.zeros_like(centers)
            np.add.at(sums, label, x)
            centers = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], x[apart.min(1).argmax()])
        cost = float(((x - centers[label]) ** 2).sum())
        if cost < best[0] - 1e-9:
            best = (cost, label)
    return best[1]


def silhouette(x: np.ndarray, label: np.ndarray, block: int = 1024) -> float | None:
    """Mean Euclidean silhouette, in blocks of rows; a cluster of one scores 0, a single cluster nothing."""
    kinds, own = np.unique(label, return_inverse=True)
    if len(kinds) < 2:
        return None
    size, total = np.bincount(own), 0.0
    norm = (x * x).sum(1)
    member = np.eye(len(kinds))[own]
    for at in range(0, len(x), block):
        some = slice(at, at + block)
        apart = np.sqrt(np.maximum(0, norm[some, None] - 2 * x[some] @ x.T + norm))
        apart[np.arange(len(apart)), np.arange(at, at + len(apart))] = 0
        sums = apart @ member
        mine = own[some]
        row = np.arange(len(mine))
        a = sums[row, mine] / np.maximum(size[mine] - 1, 1)
        mean = sums / size
        mean[row, mine] = np.inf
        b = mean.min(1)
        most = np.maximum(a, b)
        total += np.where((size[mine] > 1) & (most > 0), (b - a) / np.where(most > 0, most, 1), 0).sum()
    return float(total / len(x))


def cluster_profiles(matrix: DataFrame, *, max_k: int = 8, seed: int = 42, tries: int = 10) -> DataFrame:
    """One row per entity and kind: success, k, labels and scores. ``matrix``: entity_id, profile_kind, local_date,
    profile. k is the first best silhouette of 2 to max_k; under four days it is 1, under two there are no clusters.
    Clusters are numbered by their earliest day."""

    def run(t: pa.Table) -> pa.Table:
        order = np.argsort(np.array(t["local_date"].cast(pa.int32())), kind="stable")
        days = t["local_date"].take(pa.array(order)).to_pylist()
        x = np.array(t["profile"].to_pylist(), float)[order]
        scores: list[dict] = []
        label, k = np.zeros(len(x), int), 1 if len(x) >= 2 else 0
        if len(x) >= 4:
            fits = {i: kmeans(x, i, seed, tries) for i in range(2, min(max_k, len(x) - 1) + 1)}
            scores = [{"k": i, "silhouette": s} for i, fit in fits.items() if (s := silhouette(x, fit)) is not None]
            if scores:
                k = max(scores, key=lambda s: (s["silhouette"], -s["k"]))["k"]
                label = fits[k]
        _, first = np.unique(label, return_index=True)
        number = {int(label[i]): n for n, i in enumerate(np.sort(first))}
        labels = [
            {"local_date": d, "cluster_id": number[int(c)]} for d, c in zip(days, label, strict=True)
        ] if k else []
        cols = {
            "entity_id": [t["entity_id"][0].as_py()],
            "profile_kind": [t["profile_kind"][0].as_py()],
            "success": [k > 0],
            "k": [k],
            "labels": [labels],
            "scores": [scores],
        }
        kinds = {
            "labels": pa.list_(pa.struct([("local_date", pa.date32()), ("cluster_id", pa.int32())])),
            "scores": pa.list_(pa.struct([("k", pa.int32()), ("silhouette", pa.float64())])),
            "k": pa.int32(),
        }
        return pa.table({c: pa.array(v, kinds.get(c)) for c, v in cols.items()})

    return matrix.groupBy(*KEYS).applyInArrow(run, SCHEMA)


def labels(clusters: DataFrame) -> DataFrame:
    return clusters.where("success").select(*KEYS, F.explode("labels").alias("x")).select(*KEYS, "x.*")


def cluster_stats(clusters: DataFrame, matrix: DataFrame) -> DataFrame:
    """A row for each cluster: size, share of days, greatest value of its centre, mean spread of its intervals."""
    days = labels(clusters).join(matrix, [*KEYS, "local_date"])
    own = [*KEYS, "cluster_id"]
    per = days.select(*own, F.posexplode("profile").alias("i", "v")).groupBy(*own, "i").agg(
        F.avg("v").alias("m"), F.stddev_pop("v").alias("s")
    )
    center = F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"])
    shape = per.groupBy(*own).agg(
        F.max("m").alias("representative_peak"), F.avg("s").alias("within_cluster_variability"), center.alias("center")
    )
    sizes = days.groupBy(*own).agg(F.count("*").alias("cluster_size"))
    total = days.groupBy(*KEYS).agg(F.count("*").alias("_n"))
    sizes = sizes.join(total, KEYS).withColumn(
        "percentage_of_days", 100.0 * F.col("cluster_size") / F.col("_n")
    ).drop("_n")
    return sizes.join(shape, own)
