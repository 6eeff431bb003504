"""Dedup of bytes of repeated 100-byte strings, by minimum-fingerprint sampling.

This stands in the place of prefix doubling over a suffix array, which was not built: no ranks are doubled and no
(rank, position) pairs are sorted by Spark. Names are 64-bit fingerprints of bytes, so that the name of any string
follows from two prefix sums; equal names meet in one bucket and are sorted there:

1. h = 32 bytes, on sampled positions. Of the 69 positions at which a 32-byte string can start in a 100-byte string, the
   one with the least code stands for it. Equal 100-byte strings choose equal places, so a name that occurs once rules
   out all strings that chose it. Pairs of all other positions would be 35 times as many and larger than the input.
2. Past the threshold, by runs. All strings of a document that chose the same place form a run of up to 168 bytes. Runs
   with equal names are equal: all but the first repeat as a whole.
3. At the threshold. First runs whose 32 bytes also start other runs are cut into their 100-byte strings; these are
   named and sorted, and all but the first of each name repeat.

Copies of whole documents are set aside first. What a task holds is one bucket of names; names within one piece of the
input that repeat in it are settled there, so that a passage in a third of all documents reaches its bucket once a
piece. Bytes to remove come back as merged intervals.

A name may also begin many different runs (32 bytes that a third of all documents have, each in other surroundings).
Where one piece holds more than HOT_RUNS different runs of a name, they go round the bucket of that name, which learns
only that the name is hot and lets its own runs pass too. The 100-byte strings of all runs of hot names are named by 128
bits and dealt by these, not by the run's name. Step 2 only spares step 3 work, so the threshold affects cost alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, join_counted, materialize, materialize_with, shuffle_partitions, table
from .shingles import mix, pieces

LENGTH = 100
SEED = 32
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0xA0761D6478BD642F
#: Another code for each byte, for a second name of strings that are compared by names alone.
OTHER_BYTES = mix(BYTES ^ np.uint64(0xD6E8FEB86659FD93))
PIECE = 2 << 20
#: Bytes of text whose names make one bucket (names and places take about 0.8 bytes for each byte of text).
BUCKET = 64 << 20
#: Beyond this number of buckets (4 TB of text) a piece would send each of them too few names; then buckets grow.
MOST_BUCKETS = 1 << 16
#: Different runs of one name in one piece (of about 60,000 runs) beyond which the name is hot.
HOT_RUNS = 32
#: Runs of hot names that are cut into strings at once (168 bytes each at most).
HOT_BATCH = 8_000
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, n of each."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            x = np.full(max(n, PIECE + (PIECE >> 2)), base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_sums(buffer: np.ndarray, codes: np.ndarray = BYTES) -> np.ndarray:
    up, _ = _power(len(buffer) + 1)
    out = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(codes[buffer] * up[:-1], out=out[1:])
    return out


def names(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of the strings [start, end)."""
    _, down = _power(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    pad = (-len(x)) % w
    b = np.append(x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, w)
    ahead = np.minimum.accumulate(b, 1).ravel()
    behind = np.minimum.accumulate(b[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def runs(buffer: np.ndarray, ends: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end (``ends``): document, first and last string start of each run (places in the buffer),
    the name of the chosen ``seed`` bytes and the name of the run."""
    none = np.zeros(0, np.int64)
    if len(buffer) < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = prefix_sums(buffer)
    at = np.arange(len(buffer) - seed + 1)
    code = names(sums, at, at + seed)
    least = window_min((code & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64), length - seed + 1)
    chosen = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.arange(len(chosen))
    doc = np.searchsorted(ends, start, side="right")
    inside = start + length <= ends[np.minimum(doc, len(ends) - 1)]
    start, doc, chosen = start[inside], doc[inside], chosen[inside]
    if not len(start):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    new = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1]))))
    lo, hi = start[new], start[np.append(new[1:], len(start)) - 1]
    return doc[new], lo, hi, code[chosen[new]], names(sums, lo, hi + length)


def _first_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys (the last two only order), and which rows in that order begin a new group."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys[:-2]:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order, new


def _starts(size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of runs laid end to end, every string in them: its run, its start within the run, its place in the buffer."""
    many = size - length + 1
    inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return np.repeat(np.arange(len(size)), many), inner, np.repeat(np.cumsum(size) - size, many) + inner


def _intervals(doc: np.ndarray, start: np.ndarray, length: int) -> list[np.ndarray]:
    """Strings as intervals of their documents; strings that begin one byte after another make one interval."""
    order = np.lexsort((start, doc))
    d, s = doc[order], start[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1)
    first = np.flatnonzero(new)
    return [d[first], s[first], s[np.append(first[1:], len(d))[: len(first)] - 1] + length]


def bucket_count(spark: SparkSession, size: int) -> int:
    """Buckets of names for ``size`` bytes of text: one for each BUCKET bytes, so that what a task holds does not grow
    with the input, up to MOST_BUCKETS; two for each shuffle partition at least."""
    return max(16, 2 * shuffle_partitions(spark), min(MOST_BUCKETS, size // BUCKET))


def repeats(docs: DataFrame, *, length: int = LENGTH, size: int = 0) -> DataFrame:
    """id, a, b: intervals [a, b) of bytes that a string repeats; they may overlap. ``docs``: id (long, unique), text;
    ``size``: their bytes, by which the buckets are laid out (results do not depend on it)."""
    spark = docs.sparkSession
    buckets = bucket_count(spark, size)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.array(b.column(0), np.int64)
            for at, texts in pieces(b.column(1), PIECE):
                ends = np.cumsum([len(t) for t in texts])
                doc, lo, hi, name, run = runs(np.frombuffer(b"".join(texts), np.uint8), ends, length)
                if not len(doc):
                    continue
                first = (ends - [len(t) for t in texts])[doc]
                own, lo, hi = ids[at + doc], lo - first, hi - first
                # Runs that repeat in this piece are settled here.
                order, new = _first_of(name, run, own, lo)
                begun, different = np.unique(name[order[new]], return_counts=True)
                hot = begun[different > HOT_RUNS]
                aside = own[order] % buckets
                bucket = np.where(new, (name[order] % np.uint64(buckets)).astype(np.int64), -1 - aside)
                bucket = np.where(new & np.isin(name[order], hot), -1 - buckets - aside, bucket)
                by = np.argsort(bucket, kind="stable")
                tell = (hot % np.uint64(buckets)).astype(np.int64)
                which = np.union1d(bucket, tell)
                cut = np.searchsorted(bucket[by], np.append(which, buckets))
                for i, x, y in zip(which.tolist(), cut[:-1], cut[1:], strict=True):
                    take = order[by[x:y]]
                    yield _row(i, name[take], run[take], own[take], lo[take], hi[take], hot[tell == i])

    def _row(
        bucket: int, name: np.ndarray, run: np.ndarray, own: np.ndarray, lo: np.ndarray, hi: np.ndarray, hot: np.ndarray
    ) -> pa.RecordBatch:
        if bucket < 0:
            name, run = name[:0], run[:0]
        blobs = [
            name.tobytes(),
            run.tobytes(),
            own.tobytes(),
            lo.astype(np.uint32).tobytes(),
            (hi - lo).astype(np.uint8).tobytes(),
            hot.tobytes(),
        ]
        columns = ["bucket", "name", "run", "own", "lo", "more", "hot"]
        return pa.RecordBatch.from_arrays(
            [pa.array([bucket], pa.int32()), *[pa.array([x], pa.binary()) for x in blobs]], names=columns
        )

    def settle(t: pa.Table) -> pa.Table:
        read = lambda c, kind: np.frombuffer(b"".join(t[c].to_pylist()), kind)
        own, lo, more = read("own", np.int64), read("lo", np.uint32).astype(np.int64), read(
            "more", np.uint8
        ).astype(np.int64)
        bucket = t["bucket"][0].as_py()
        if bucket < 0:
            again = np.full(len(own), bucket >= -buckets)
            return pa.table(
                {
                    "id": own,
                    "lo": lo,
                    "hi": lo + more,
                    "name": np.zeros(len(own), np.int64),
                    "again": again,
                    "hot": ~again,
                }
            )
        name, run = read("name", np.uint64), read("run", np.uint64)
        order, new = _first_of(name, run, own, lo)
        sorted_name = name[order]
        hot = np.isin(sorted_name, read("hot", np.uint64))
        kinds = np.unique(sorted_name[new], return_counts=True)
        cut = new & (hot | np.isin(sorted_name, kinds[0][kinds[1] > 1]))
        take = np.flatnonzero(~new | cut)
        at = order[take]
        cols = {"id": own[at], "lo": lo[at], "hi": lo[at] + more[at], "name": name[at].astype(np.int64)}
        return pa.table({**cols, "again": ~new[take], "hot": hot[take]})

    shape = "bucket int, name binary, run binary, own binary, lo binary, more binary, hot binary"
    dealt = docs.mapInArrow(deal, shape).groupBy("bucket")
    settled = materialize(
        dealt.applyInArrow(settle, "id long, lo long, hi long, name long, again boolean, hot boolean"), "substring-runs"
    )
    whole = settled.where("again").select("id", F.col("lo").alias("a"), (F.col("hi") + length).alias("b"))
    ask = settled.where("not again").groupBy("id").agg(
        F.collect_list(F.struct("lo", "hi", "name", "hot")).alias("runs")
    )
    ids = ask.select("id")
    n = ids.count()
    some = docs.join(F.broadcast(ids) if n <= BROADCAST_ROWS else ids.hint("merge"), "id", "left_semi")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot: list[tuple[int, int, bytes]] = []
        for b in batches:
            out: dict[str, list] = {"bucket": [], "name": [], "id": [], "lo": [], "bytes": []}
            for i, t, rs in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                raw = t.as_py().encode()
                for r in rs:
                    string = raw[r["lo"] : r["hi"] + length]
                    if r["hot"]:
                        hot.append((i, r["lo"], string))
                        if len(hot) >= HOT_BATCH:
                            yield from strings_of(hot)
                            hot = []
                        continue
                    out["bucket"].append(r["name"] % buckets)
                    out["name"].append(r["name"])
                    out["id"].append(i)
                    out["lo"].append(r["lo"])
                    out["bytes"].append(string)
                if len(out["id"]) > 20_000:
                    yield pa.RecordBatch.from_pydict(out, schema=cut_schema)
                    out = {k: [] for k in out}
            if out["id"]:
                yield pa.RecordBatch.from_pydict(out, schema=cut_schema)
        if hot:
            yield from strings_of(hot)

    def strings_of(hot: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        """The strings of runs of hot names, as (two names, id, start) in one blob for each bucket; those that repeat
        among these runs are settled here."""
        own, lo = np.array([x[0] for x in hot], np.int64), np.array([x[1] for x in hot], np.int64)
        size = np.array([len(x[2]) for x in hot])
        buffer = np.frombuffer(b"".join([x[2] for x in hot]), np.uint8)
        of, inner, place = _starts(size, length)
        code, other = (names(prefix_sums(buffer, codes), place, place + length) for codes in (BYTES, OTHER_BYTES))
        doc, start = own[of], lo[of] + inner
        order, new = _first_of(code, other, doc, start)
        packed = np.stack([code, other, doc.view(np.uint64), start.view(np.uint64)], 1)[order]
        bucket = np.where(new, buckets + (code[order] % np.uint64(buckets)).astype(np.int64), -1 - doc[order] % buckets)
        by = np.argsort(bucket, kind="stable")
        which, first = np.unique(bucket[by], return_index=True)
        for i, x, y in zip(which.tolist(), first, np.append(first[1:], len(by)), strict=True):
            row = {"bucket": [i], "name": [0], "id": [0], "lo": [0], "bytes": [packed[by[x:y]].tobytes()]}
            yield pa.RecordBatch.from_pydict(row, schema=cut_schema)

    cut_schema = pa.schema(
        [("bucket", pa.int32()), ("name", pa.int64()), ("id", pa.int64()), ("lo", pa.int64()), ("bytes", pa.binary())]
    )

    def compare(t: pa.Table) -> pa.Table:
        bucket = t["bucket"][0].as_py()
        found = same_names(t, bucket) if bucket < 0 or bucket >= buckets else same_runs(t)
        d, a, b = (np.concatenate(x) for x in zip([np.zeros(0, np.int64)] * 3, *found, strict=True))
        return pa.table({"id": d, "a": a, "b": b})

    def same_names(t: pa.Table, bucket: int) -> list[list[np.ndarray]]:
        packed = np.frombuffer(b"".join(t["bytes"].to_pylist()), np.uint64).reshape(-1, 4)
        code, other, doc, start = packed[:, 0], packed[:, 1], packed[:, 2].astype(
            np.int64
        ), packed[:, 3].astype(np.int64)
        if bucket >= 0:
            order, new = _first_of(code, other, doc, start)
            doc, start = doc[order[~new]], start[order[~new]]
        return [_intervals(doc, start, length)]

    def same_runs(t: pa.Table) -> list[list[np.ndarray]]:
        name, own, lo = np.array(t["name"], np.int64), np.array(t["id"], np.int64), np.array(t["lo"], np.int64)
        blobs = t["bytes"].to_pylist()
        size = np.array([len(x) for x in blobs])
        parts: list[list[np.ndarray]] = []
        order = np.argsort(name, kind="stable")
        edge = np.flatnonzero(np.concatenate(([True], name[order][1:] != name[order][:-1])))
        edge = np.append(edge, len(order))
        # Names are taken together until about PIECE bytes; strings with equal names are in one of these lots.
        total = np.concatenate(([0], np.cumsum(size[order])))
        at = 0
        while at < len(edge) - 1:
            stop = max(at + 1, int(np.searchsorted(total[edge], total[edge[at]] + PIECE, side="right")) - 1)
            rows = order[edge[at] : edge[stop]]
            at = stop
            buffer = np.frombuffer(b"".join([blobs[i] for i in rows]), np.uint8)
            of, inner, place = _starts(size[rows], length)
            doc, start = own[rows][of], lo[rows][of] + inner
            by, new = _first_of(names(prefix_sums(buffer), place, place + length), doc, start)
            again = by[~new]
            parts.append(_intervals(doc[again], start[again], length))
        return parts

    strings = some.join(ask, "id").select("id", "text", "runs").mapInArrow(
        cut_out, "bucket int, name long, id long, lo long, bytes binary"
    )
    found = strings.groupBy("bucket").applyInArrow(compare, "id long, a long, b long")
    return whole.unionByName(found)


def merged(intervals: DataFrame) -> DataFrame:
    """id, cut: the maximal intervals of each document, as pairs of 64-bit integers."""
    many = 2 * shuffle_partitions(intervals.sparkSession)

    def run(t: pa.Table) -> pa.Table:
        d, a, b = (np.array(t[c], np.int64) for c in ("id", "a", "b"))
        order = np.lexsort((a, d))
        d, a, b = d[order], a[order], b[order]
        doc = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        ids, blobs = [], []
        for x, y in zip(doc, np.append(doc[1:], len(d)), strict=True):
            far = np.maximum.accumulate(b[x:y])
            new = np.flatnonzero(np.concatenate(([True], a[x:y][1:] > far[:-1])))
            ids.append(int(d[x]))
            blobs.append(np.stack([a[x:y][new], far[np.append(new[1:], y - x) - 1]], 1).astype("<i8").tobytes())
        return pa.table({"id": pa.array(ids, pa.int64()), "cut": pa.array(blobs, pa.binary())})

    return intervals.withColumn(
        "part", F.pmod(F.xxhash64("id"), F.lit(many))
    ).groupBy("part").applyInArrow(run, "id long, cut binary")


def remove_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, keep_text: bool = False
) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the remaining bytes where ``keep_text``.

    Null texts count as empty. Rows without a doc_id, and further texts under a doc_id that is taken, take no part and
    lose nothing; equal rows have equal results. Texts shorter than ``length`` bytes lose nothing.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    )
    marks, totals = materialize_with(
        rows.select(
            "id",
            F.octet_length("text").cast("long").alias("n"),
            F.xxhash64("text").alias("h1"),
            F.xxhash64("text", F.lit(1)).alias("h2"),
        ),
        "substring-marks",
        rows=F.count("*"),
        size=F.sum("n"),
    )
    real = marks.where(F.col("id").isNotNull() & (F.col("n") >= length))
    firsts = real.groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    copies = join_counted(
        real, firsts.where("copies > 1"), ["n", "h1", "h2"], "copies", totals["rows"] or 0, "id"
    ).where("id <> rep").select("id", "n", "h1")
    taken = real.groupBy("id").agg(F.min("h1").alias("own"), F.count_distinct("h1").alias("texts"))
    odd = taken.where("texts > 1").select("id", "own")
    out_of = materialize(
        copies.select("id", "h1").distinct().unionByName(
            real.join(odd, "id").where("h1 <> own").select("id", "h1").distinct()
        ).distinct(),
        "substring-aside",
    )
    aside = out_of.count()
    keyed = rows.where(
        F.col("id").isNotNull() & (F.octet_length("text") >= length)
    ).withColumn("h1", F.xxhash64("text"))
    part = keyed.join(
        F.broadcast(out_of) if aside <= BROADCAST_ROWS else out_of.hint("merge"), ["id", "h1"], "left_anti"
    ).select("id", "text")
    whole = copies.join(odd, "id", "left_anti").select(
        "id", F.lit(0).cast("long").alias("a"), F.col("n").alias("b")
    ).distinct()
    found = repeats(part, length=length, size=totals["size"] or 0)
    cuts = merged(found.unionByName(whole)).join(odd.select("id", "own"), "id", "left")
    cuts = materialize(cuts, "substring-cuts")
    size = cuts.agg(F.sum(F.octet_length("cut")), F.count("*")).first()
    small = (size[0] or 0) <= 16_000_000 and size[1] <= BROADCAST_ROWS
    joined = rows.withColumn("h1", F.xxhash64("text")).join(
        F.broadcast(cuts) if small else cuts.hint("merge"), "id", "left"
    )
    joined = joined.select(
        "id", "text", F.when(F.col("own").isNull() | (F.col("own") == F.col("h1")), F.col("cut")).alias("cut")
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                out = []
                for t, c in zip(part.column(1), part.column(2), strict=True):
                    raw, spans = t.as_py().encode(), np.frombuffer(c.as_py() or b"", "<i8").reshape(-1, 2).tolist()
                    left, kept = 0, []
                    for x, y in spans:
                        kept.append(raw[left:x])
                        left = y
                    rest = b"".join([*kept, raw[left:]])
                    out.append(
                        (
                            len(raw),
                            len(raw) - len(rest),
                            len(spans),
                            hashlib.sha256(rest).hexdigest(),
                            rest if keep_text else None,
                        )
                    )
                cols = [
                    pa.array(x, k)
                    for x, k in zip(
                        zip(*out, strict=True),
                        (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()),
                        strict=True,
                    )
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols[: 4 + keep_text]], names=shape)

    shape = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep_text]
    return joined.mapInArrow(
        finish,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text,
    )


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
