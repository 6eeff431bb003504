"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells, one representative per group.

Only vectors of one label and length can link, so each label and length has cells of its own: one for every ``per_cell``
vectors. Every vector has its nearest centre's cell as home. A partner at an angle of at most a = acos(threshold) may
live in another cell only if the plane between the two centres is within a of the vector; so a vector is also sent, as a
guest, to each cell with x.(c - c') <= sin(a) |c - c'|. Each home then sees all partners of its vectors: no link is lost
(recall is 1 by the bound), and each vector's links are counted in its own home only. How many guests there are depends
on how well the data cluster; labels of one cell have none.

Vectors of one label with equal components are one class with a weight. Homes and guests of a large cell are dealt into
blocks; pairs of blocks are compared as matrix products, of vectors in order of their angle to the centre: partners have
angles that differ by at most a, so the product of a run of vectors spans only those near it. Only counts and the edges
of a spanning forest come out, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, materialize, table
from .components import components, roots

THRESHOLD = 0.93
#: The centres of all labels are fitted on about this many classes, by hash; all vectors are then assigned.
SAMPLE = 8192
#: Vectors for which a label gets one cell; and the cells of all labels that the driver fits and sends along at most.
#: Beyond that cells get larger and cost more, with the same result.
PER_CELL, MAX_CELLS = 4096, 4096
BLOCK = 2048


def spherical_kmeans(x: np.ndarray, k: int, *, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centres; k-means++ seeds, then assignment by the largest dot product; empty cells take the worst-served rows."""
    rng = np.random.default_rng(seed)
    centers = x[rng.integers(len(x))][None]
    best = x @ centers[0]
    for _ in range(1, k):
        far = np.maximum(1 - best, 0)
        pick = rng.choice(len(x), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(x))
        centers = np.vstack([centers, x[pick]])
        best = np.maximum(best, x @ x[pick])
    for _ in range(rounds):
        dots = x @ centers.T
        home = dots.argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, home, x)
        norm = np.linalg.norm(sums, axis=1)
        empty = np.flatnonzero(norm == 0)
        sums[empty] = x[np.argsort(dots.max(1))[: len(empty)]]
        norm[empty] = 1.0
        centers = sums / norm[:, None]
    return centers


def _unit(blobs: list[bytes], kind: type) -> np.ndarray:
    """Rows of unit length, in double precision; scaled first, so that no square over- or underflows."""
    x = np.frombuffer(b"".join(blobs), kind).astype(np.float64).reshape(len(blobs), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1)[:, None]


def near_dedup(
    vectors: DataFrame,
    *,
    threshold: float = THRESHOLD,
    per_cell: int = PER_CELL,
    block: int = BLOCK,
    sample: int = SAMPLE,
) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept, for ``vectors`` of vec_id, embedding, label.

    Rows whose label, vec_id or vector is null, whose vector is empty, zero or has a null or non-finite component, link
    with nothing; vectors of different length neither. Repeated rows count as vectors of their own. Empty tables and
    columns of any name are fine.
    """
    e = F.col("embedding")
    usable = (
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & e.isNotNull()
        & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists(e, lambda x: x != 0)
    )
    double = "double" in dict(vectors.dtypes)["embedding"]
    kind = np.float64 if double else np.float32
    rows = vectors.select("vec_id", "label", e.alias("embedding"), F.coalesce(usable, F.lit(False)).alias("ok"))
    keys = ["label", "dim", "k1", "k2"]
    rows = rows.withColumn("label", F.col("label").cast("string")).withColumn("dim", F.size("embedding")).withColumn(
        "k1", F.xxhash64(F.lit(1), "embedding")
    ).withColumn("k2", F.xxhash64("embedding", F.lit(2)))
    good = rows.where("ok")
    classes = materialize(
        good.groupBy(*keys).agg(
            F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.first("embedding").alias("embedding")
        ),
        "vec-classes",
    )
    centers = _centers(classes, per_cell, sample)
    links = _compare(classes, centers, kind, threshold, block)
    links = materialize(links, "vec-links")
    found = links.groupBy("id").agg(F.sum("links").alias("links"))
    comp = components(links.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    per_class = classes.drop("embedding").join(found, "id", "left").join(
        comp.withColumnRenamed("node", "id"), "id", "left"
    )
    per_class = per_class.select(
        *keys,
        "weight",
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
    )
    n_good = classes.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    out = join_counted(
        rows.where("ok"), per_class, keys, "weight", n_good, "vec_id"
    ).select("vec_id", "n_links", "component_id")
    rest = rows.where("not ok").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _centers(classes: DataFrame, per_cell: int, sample: int) -> dict[tuple[str, int], np.ndarray]:
    """Centres by (label, length), for those with more vectors than one cell takes; MAX_CELLS of them at most."""
    counts = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > per_cell)
    big = counts.orderBy(F.desc("n"), "label", "dim").limit(MAX_CELLS).collect()
    if not big:
        return {}
    cells = {(r["label"], r["dim"]): -(-r["n"] // per_cell) for r in big}
    scale = min(1.0, MAX_CELLS / sum(cells.values()))
    share = min(1.0, sample / sum(r["n"] for r in big))
    # A row for each of these labels, MAX_CELLS at most.
    wanted = F.broadcast(classes.sparkSession.createDataFrame(list(cells), "label string, dim int"))
    some = classes.join(wanted, ["label", "dim"]).where(
        F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1_000_000)) < share * 1_000_000
    )
    rows = some.orderBy(F.xxhash64("id"), "id").limit(2 * sample).select(
        "label", "dim", "embedding"
    ).toArrow().to_pylist()
    by: dict[tuple[str, int], list] = {}
    for r in rows:
        by.setdefault((r["label"], r["dim"]), []).append(r["embedding"])
    out = {}
    for key, vectors in by.items():
        x = np.array(vectors, np.float64)
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1)[:, None]
        if (k := min(len(x), int(cells[key] * scale))) > 1:
            out[key] = spherical_kmeans(x, k)
    return out


def _compare(
    classes: DataFrame, centers: dict[tuple[str, int], np.ndarray], kind: type, threshold: float, block: int
) -> DataFrame:
    sine = float(np.sqrt(max(0.0, 1 - threshold**2))) + 1e-9
    widest = float(np.arccos(min(1.0, threshold))) + 1e-6
    apart = {key: np.sqrt(np.maximum(0.0, 2 - 2 * c @ c.T)) for key, c in centers.items()}
    types = {
        "label": pa.string(), "dim": pa.int32(), "cell": pa.int32(), "home": pa.bool_(), "angle": pa.float64(),
        "id": pa.int64(), "weight": pa.int64(), "v": pa.binary(),
    }

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                d = b.slice(at, 2048).to_pydict()
                blobs = [np.array(v, kind).tobytes() for v in d["embedding"]]
                cells: list[list[tuple[int, bool, float]]] = [[(0, True, 0.0)] for _ in blobs]
                own: dict[tuple[str, int], list[int]] = {}
                for i, key in enumerate(zip(d["label"], d["dim"], strict=True)):
                    if key in centers:
                        own.setdefault(key, []).append(i)
                for key, rows in own.items():
                    dots = _unit([blobs[i] for i in rows], kind) @ centers[key].T
                    home = dots.argmax(1)
                    near = dots.max(1)[:, None] - dots <= sine * apart[key][home]
                    angle = np.arccos(np.clip(dots, -1, 1))
                    for n, i in enumerate(rows):
                        cells[i] = [(int(c), bool(c == home[n]), float(angle[n, c])) for c in np.flatnonzero(near[n])]
                out: dict[str, list] = {k: [] for k in types}
                for i, cs in enumerate(cells):
                    for c, at_home, angle in cs:
                        for k, v in zip(
                            types,
                            (d["label"][i], d["dim"][i], c, at_home, angle, d["id"][i], d["weight"][i], blobs[i]),
                            strict=True,
                        ):
                            out[k].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in types.items()], names=list(types))

    shape = "label string, dim int, cell int, home boolean, angle double, id long, weight long, v binary"
    sent = materialize(
        classes.select("label", "dim", "id", "weight", "embedding").mapInArrow(assign, shape), "vec-cells"
    )
    cell = ["label", "dim", "cell"]
    sizes = sent.groupBy(*cell).agg(
        F.ceil(F.count_if("home") / block).cast("int").alias("nq"),
        F.ceil(F.count("*") / block).cast("int").alias("nt"),
        F.count("*").alias("rows"),
    ).where("nq > 0")
    placed = join_counted(sent, sizes, cell, "rows", sent.count(), "id")
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ask = placed.where("home").select(
        *cell, part("nq").alias("q"), every("nt").alias("t"), F.lit(True).alias("ask"), "angle", "id", "weight", "v"
    )
    answer = placed.select(
        *cell, every("nq").alias("q"), part("nt").alias("t"), F.lit(False).alias("ask"), "angle", "id", "weight", "v"
    )

    def compare(t: pa.Table) -> pa.Table:
        ask = np.array(t["ask"].to_pylist(), bool)
        ids, weight, v, angle = np.array(t["id"]), np.array(t["weight"]), t["v"].to_pylist(), np.array(t["angle"])
        qi, ti = np.flatnonzero(ask), np.flatnonzero(~ask)
        qi, ti = qi[np.argsort(angle[qi], kind="stable")], ti[np.argsort(angle[ti], kind="stable")]
        none = pa.table(
            {"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())}
        )
        if not len(qi) or not len(ti):
            return none
        target = _unit([v[i] for i in ti], kind)
        all_ids, at = np.unique(ids, return_inverse=True)
        links, left, right = np.zeros(len(all_ids), np.int64), [], []
        for k in range(0, len(qi), 256):
            some = qi[k : k + 256]
            low, high = np.searchsorted(angle[ti], [angle[some[0]] - widest, angle[some[-1]] + widest])
            a, b = np.nonzero(_unit([v[i] for i in some], kind) @ target[low:high].T >= threshold)
            a, b = some[a], ti[low:high][b]
            other = ids[a] != ids[b]
            a, b = a[other], b[other]
            np.add.at(links, at[a], weight[b])
            # A spanning forest of what was found so far replaces the pairs.
            root = roots(
                len(all_ids), np.concatenate([*left, at[a]]).astype(int), np.concatenate([*right, at[b]]).astype(int)
            )
            moved = np.flatnonzero(root != np.arange(len(root)))
            left, right = [moved], [root[moved]]
        root = roots(len(all_ids), left[0], right[0])
        keep = np.flatnonzero((links > 0) | (root != np.arange(len(root))))
        return pa.table({"id": all_ids[keep], "links": links[keep], "root": all_ids[root[keep]]})

    return ask.unionByName(answer).groupBy(*cell, "q", "t").applyInArrow(compare, "id long, links long, root long")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
