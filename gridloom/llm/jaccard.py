"""N-gram Jaccard join by T-occurrence search.

Documents with equal shingle sets are one class. The search among classes:

1. Order. Codes of shingles are in random order; those found in many sets are moved behind the others, the most frequent
   last. Frequencies are counted over all documents (over the lower half of each set in code order, where prefixes
   lie); the list of frequent codes is bounded, since any order is right and only the cost depends on it.
2. Short lists. A set of n needs an overlap of a = ceil(3n/4) with any partner, so two partners share at least T of the
   first n - a + T codes of both. These codes are dealt to inverted lists. Short lists are merged: pairs are counted,
   and those that reach T in all are candidates. Long lists are not merged: their documents, by runs of sizes that can
   match, become one candidate group.
3. Candidates form groups (connected components). Within a group each set is a query to the inverted index of the
   group's sets: DivideSkip merges its short lists, and looks for the survivors in the long ones by binary search; all
   that reach the overlap are links. Only the edges of a spanning forest come out of a task, never the pairs.
   A group larger than a block is first held against up to PIVOTS of its own sets, block by block. Sets linked to
   pivots of one class are connected, so no pair of them is looked at again. Only sets outside the group's largest class
   go on as queries; they meet the others by bands of size that can match, a block of queries with a block of sets.
4. Components of the links.

No pair is lost: a true pair shares T codes in lists; if one of them is long, it is in one group through it, else it is
counted T times. Texts are read four times rather than storing their sets, which would be larger than they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, drop, join_counted, join_small, materialize, materialize_with, shuffle_partitions, table
from .components import components, roots
from .shingles import mix, pieces, shingle_sets

WORDS = 5
PERCENT = 75
#: Lists longer than this are long.
SHORT = 32
#: The most frequent codes that are moved back; more of them stay in code order.
FREQUENT = 1 << 18
BLOCK = 1024
PIVOTS = 16
#: Bytes of lists that a task gathers before it deals them out to the buckets.
HELD = 8 << 20
#: Shingles of all sets whose lists make one bucket, so that what a task holds does not grow with the input; beyond
#: MOST_BUCKETS (some 3 TB of text) the rows for each bucket would get small, and buckets grow instead.
BUCKET = 8 << 20
MOST_BUCKETS = 1 << 16
#: In DivideSkip, T / (MU * log(longest list) + 1) lists count as long.
MU = 0.05


def need(n: np.ndarray | int, percent: int = PERCENT):
    """Least overlap of a set of n with any partner."""
    return -(-percent * n // 100)


def extra(n: np.ndarray | int):
    """Shared codes asked for in the prefixes."""
    return 1 + n // 12


def _tail(codes: np.ndarray) -> np.ndarray:
    return (codes >> np.uint64(20)) & np.uint64(0xFFFFFFFF)


def _combined(codes: np.ndarray, buckets: int) -> np.ndarray:
    return ((codes % np.uint64(buckets)) << np.uint64(32)) | _tail(codes)


def _only(docs: DataFrame, keys: DataFrame, n: int, how: str) -> DataFrame:
    """Rows of docs (id, text) whose id is in ``keys`` (id and few numbers), or is not (how = anti). Keys are counted:
    while there are few they are broadcast, and else both sides are shuffled."""
    return docs.join(F.broadcast(keys) if n <= BROADCAST_ROWS else keys.hint("merge"), "id", how)


def _parts(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    which, first = np.unique(bucket[order], return_index=True)
    for b, x, y in zip(which.tolist(), first, np.append(first, len(order))[1:], strict=True):
        yield b, order[x:y]


def _gathered(items: Iterator, share: int) -> Iterator[list]:
    """Lists of items (code arrays, or tuples that begin with one), about HELD * share bytes of codes in each, so that
    the rows for the buckets do not get small where there are many buckets."""
    held, size = [], 0
    for x in items:
        held.append(x)
        size += (x[0] if isinstance(x, tuple) else x).nbytes
        if size >= HELD * share:
            yield held
            held, size = [], 0
    if held:
        yield held


def _batches(rows: list[tuple], types: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    for r in range(0, len(rows), 64):
        columns = zip(*rows[r : r + 64], strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(columns, types.values(), strict=True)], names=list(types)
        )


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """id, n, s1, s2: size of the set and a 128-bit sum over it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in pieces(b.column(1)):
                sets = shingle_sets(texts, k)
                n = pa.array([len(s) for s in sets], pa.int64())
                s1 = pa.array([int(s.sum().astype(np.int64)) for s in sets], pa.int64())
                s2 = pa.array([int(mix(s).sum().astype(np.int64)) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(texts)), n, s1, s2], names=["id", "n", "s1", "s2"]
                )

    return docs.mapInArrow(run, "id long, n long, s1 long, s2 long")


def frequencies(docs: DataFrame, k: int, buckets: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes (with their bucket) counted in more than SHORT sets and their counts, the most frequent ``limit``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = (
            s[: len(s) // 2 + 1] for b in batches for _, texts in pieces(b.column(1)) for s in shingle_sets(texts, k)
        )
        for held in _gathered(lists, 2):
            codes, n = np.unique(_combined(np.concatenate(held), buckets), return_counts=True)
            tail = (codes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            cut = _parts((codes >> np.uint64(32)).astype(np.int64))
            rows = [(i, tail[at].tobytes(), n[at].astype(np.uint32).tobytes()) for i, at in cut]
            yield from _batches(rows, {"bucket": pa.int32(), "codes": pa.binary(), "counts": pa.binary()})

    def total(t: pa.Table) -> pa.Table:
        codes, counts = (np.frombuffer(b"".join(t[c].to_pylist()), np.uint32) for c in ("codes", "counts"))
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        at = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        n = np.add.reduceat(counts[order].astype(np.int64), at)
        keep = n > SHORT
        high = np.int64(t["bucket"][0].as_py()) << np.int64(32)
        return pa.table({"code": codes[at][keep].astype(np.int64) | high, "n": n[keep]})

    counted = docs.mapInArrow(
        count, "bucket int, codes binary, counts binary"
    ).groupBy("bucket").applyInArrow(total, "code long, n long")
    top = counted.orderBy(F.col("n").desc(), "code").limit(limit).toArrow()
    code, n = np.array(top["code"], np.uint64), np.array(top["n"], np.int64)
    order = np.argsort(code)
    return code[order], n[order]


def candidates(docs: DataFrame, k: int, buckets: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """a, b, c, t: pairs with the number c of shared codes in short lists and the t they must reach; links of long lists
    have c = t."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    types = {
        "bucket": pa.int32(), "ids": pa.binary(), "sizes": pa.binary(), "counts": pa.binary(), "codes": pa.binary()
    }

    def prefix(s: np.ndarray) -> np.ndarray:
        often, count = shared.value
        p = min(len(s), len(s) - need(len(s)) + extra(len(s)))
        if not len(often):
            return s[:p]
        own = _combined(s, buckets)
        place = np.minimum(np.searchsorted(often, own), len(often) - 1)
        hot = often[place] == own
        first = np.flatnonzero(~hot)
        if len(first) < p:
            late = np.flatnonzero(hot)
            first = np.concatenate([first, late[np.argsort(count[place[late]], kind="stable")]])
        return s[first[:p]]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int, int]]:
        for b in batches:
            ids = np.array(b.column(0), np.int64)
            for at, texts in pieces(b.column(1)):
                for i, s in zip(ids[at : at + len(texts)].tolist(), shingle_sets(texts, k), strict=True):
                    if len(s):
                        yield prefix(s), i, len(s)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _gathered(prefixes(batches), 1):
            lists, ids, n = zip(*held, strict=True)
            ids, n = np.array(ids, np.int64), np.array(n, np.int32)
            doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            codes = np.concatenate(lists)
            rows = []
            for i, take in _parts((codes % np.uint64(buckets)).astype(np.int64)):
                d, m = np.unique(doc[take], return_counts=True)
                tail = _tail(codes[take]).astype(np.uint32)
                rows.append((i, ids[d].tobytes(), n[d].tobytes(), m.astype(np.int32).tobytes(), tail.tobytes()))
            yield from _batches(rows, types)

    def merge(t: pa.Table) -> pa.Table:
        read = lambda c, kind: np.frombuffer(b"".join(t[c].to_pylist()), kind)
        times = read("counts", np.int32)
        ids, n, codes = np.repeat(read("ids", np.int64), times), np.repeat(
            read("sizes", np.int32), times
        ), read("codes", np.uint32)
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        start = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        length = np.diff(np.append(start, len(codes)))
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for m in range(2, SHORT + 1):
            if len(at := start[length == m]):
                x, y = np.triu_indices(m, 1)
                for c in range(0, len(at), max(1, 2_000_000 // len(x))):
                    some = at[c : c + max(1, 2_000_000 // len(x))]
                    a, b = order[(some[:, None] + x).ravel()], order[(some[:, None] + y).ravel()]
                    fits = (np.minimum(n[a], n[b]) >= need(np.maximum(n[a], n[b]))) & (ids[a] != ids[b])
                    left.append(a[fits])
                    right.append(b[fits])
        a, b = np.concatenate(left), np.concatenate(right)
        asked = np.minimum(extra(n[a]), extra(n[b])).astype(np.int64)
        a, b = np.maximum(ids[a], ids[b]), np.minimum(ids[a], ids[b])
        by = np.lexsort((b, a))
        a, b, asked = a[by], b[by], asked[by]
        new = np.flatnonzero(
            np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        ) if len(a) else np.zeros(0, int)
        out = [(a[new], b[new], np.diff(np.append(new, len(a))), asked[new])]
        for s, m in zip(start[length > SHORT], length[length > SHORT], strict=True):
            own = order[s : s + m]
            own = own[np.lexsort((ids[own], n[own]))]
            # A new run starts where the next size is too large for the one before, and so for all before.
            run = np.flatnonzero(np.concatenate(([True], n[own][:-1] < need(n[own][1:]))))
            hub = np.repeat(ids[own][run], np.diff(np.append(run, m)))
            far = hub != ids[own]
            a, b = np.maximum(ids[own], hub)[far], np.minimum(ids[own], hub)[far]
            out.append((a, b, np.ones(len(a), np.int64), np.ones(len(a), np.int64)))
        a, b, c, asked = (np.concatenate(x) for x in zip(*out, strict=True))
        # Links of long lists stand for themselves: the least that is asked for wins.
        by = np.lexsort((asked, b, a))
        a, b, c, asked = a[by], b[by], c[by], asked[by]
        keep = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
        return pa.table({"a": a[keep], "b": b[keep], "c": c[keep].astype(np.int64), "t": asked[keep].astype(np.int64)})

    dealt = docs.mapInArrow(deal, "bucket int, ids binary, sizes binary, counts binary, codes binary")
    found = dealt.groupBy("bucket").applyInArrow(merge, "a long, b long, c long, t long")
    return found.groupBy("a", "b").agg(F.sum("c").alias("c"), F.min("t").alias("t")).where("c >= t")


def divide_skip(
    index: tuple[np.ndarray, np.ndarray, np.ndarray], sizes: np.ndarray, query: np.ndarray, percent: int = PERCENT
) -> np.ndarray:
    """Sets of the index with a Jaccard similarity of percent or more to the query.

    ``index``: codes in order, the start of each code's list (with the end), and the lists' sets in order; ``sizes`` of
    the sets. Short lists are merged and counted; a set that can still reach the overlap is looked for in long lists.
    """
    codes, start, sets = index
    at = np.minimum(np.searchsorted(codes, query), len(codes) - 1)
    at = at[codes[at] == query]
    if not len(at):
        return np.zeros(0, np.int64)
    length = start[at + 1] - start[at]
    at = at[np.argsort(length, kind="stable")]
    length = np.sort(length)
    least = need(len(query), percent)
    n_long = min(len(at) - 1, least - 1, int(least / (MU * np.log(max(int(length[-1]), 2)) + 1)))
    short, long_ = at[: len(at) - n_long], at[len(at) - n_long :]

    def spans(x: np.ndarray) -> np.ndarray:
        size = start[x + 1] - start[x]
        return np.repeat(start[x] - np.cumsum(size) + size, size) + np.arange(size.sum())

    # A stable sort of sorted lists laid end to end merges them run by run.
    merged = np.sort(sets[spans(short)], kind="stable")
    first = np.flatnonzero(np.concatenate(([True], merged[1:] != merged[:-1])))
    found, count = merged[first], np.diff(np.append(first, len(merged)))
    alive = (count >= least - n_long) & (sizes[found] >= least) & (need(sizes[found], percent) <= len(query))
    found, count = found[alive], count[alive]
    if not len(found):
        return found
    if len(found) * len(long_) <= (start[long_ + 1] - start[long_]).sum():
        for i in long_:
            own = sets[start[i] : start[i + 1]]
            place = np.minimum(np.searchsorted(own, found), len(own) - 1)
            count = count + (own[place] == found)
    else:
        # So many survivors that merging the long lists as well is cheaper than looking them up.
        count = count + np.bincount(sets[spans(long_)], minlength=len(sizes))[found]
    return found[100 * count >= percent * (sizes[found] + len(query) - count)]


def inverted(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    code = np.concatenate(sets)
    own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(code, kind="stable")
    code = code[order]
    start = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    return code[start], np.append(start, len(code)), own[order]


def band(size: Column, percent: int) -> Column:
    """Bands of sizes; sets that link are in one band or in two neighbouring ones."""
    return F.floor(F.log(size.cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("int")


def _sets_of(t: pa.Table, rows: np.ndarray) -> list[np.ndarray]:
    blobs = t["codes"]
    return [np.frombuffer(blobs[int(x)].as_py(), np.uint64) for x in rows]


def _forest(n: int, links: Iterator[tuple[int, np.ndarray]]) -> np.ndarray:
    """Smallest index reachable, of links (query, found) that are folded as they come."""
    root, a, b, many = np.arange(n), [], [], 0
    for x, found in links:
        a.append(np.full(len(found), x))
        b.append(found)
        many += len(found)
        if many > 200_000:
            root = roots(n, np.concatenate([*a, np.arange(n)]), np.concatenate([*b, root]))
            a, b, many = [], [], 0
    return roots(n, np.concatenate([*a, np.arange(n)]), np.concatenate([*b, root]))


def _search(t: pa.Table, percent: int) -> pa.Table:
    """Edges of a forest of the links between rows that ask and rows that answer (a set may do both), by group."""
    ids, grp, asks, answers = (np.array(t[c]) for c in ("id", "grp", "asks", "answers"))
    order = np.argsort(grp, kind="stable")
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for rows in np.split(order, np.flatnonzero(np.diff(grp[order])) + 1):
        index, query = rows[answers[rows]], rows[asks[rows]]
        if not len(index) or not len(query):
            continue
        sets = _sets_of(t, index)
        lists, size = inverted(sets), np.array([len(s) for s in sets])
        all_ids, place = np.unique(ids[rows], return_inverse=True)
        at = dict(zip(rows.tolist(), place.tolist(), strict=True))
        own = np.array([at[x] for x in index.tolist()])
        found = (
            (at[x], own[divide_skip(lists, size, s, percent)])
            for x, s in zip(query.tolist(), _sets_of(t, query), strict=True)
        )
        root = _forest(len(all_ids), found)
        moved = np.flatnonzero(root != np.arange(len(root)))
        out.append((all_ids[moved], all_ids[root[moved]]))
    a, b = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.table({"a": a, "b": b})


def links(docs: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b: a spanning forest of the links within each candidate group. ``members``: id, grp."""
    spark = docs.sparkSession
    members, total = materialize_with(members, "jaccard-members", n=F.count(F.lit(1)))
    n = total["n"]
    blocks = materialize(
        members.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "jaccard-blocks"
    )
    placed, total = materialize_with(
        join_small(members, blocks, "grp", "inner", n), "jaccard-placed", large=F.count_if(F.col("blocks") > 1)
    )
    drop(members)
    texts = _only(docs, placed, n, "inner").select("id", "text", "grp", "blocks")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, some in pieces(b.column(1)):
                made = shingle_sets(some, k)
                part = b.slice(at, len(some))
                cols = [
                    part.column(0),
                    pa.array([s.tobytes() for s in made], pa.binary()),
                    pa.array([len(s) for s in made], pa.int64()),
                    *part.columns[2:],
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "codes", "n", "grp", "blocks"])

    shape = "id long, codes binary, n long, grp long, blocks int"
    yes = F.lit(True)
    found = lambda t: _search(t, percent)
    # Small groups share a task.
    task = F.pmod(F.xxhash64("grp"), F.lit(8 * shuffle_partitions(spark)))
    small = texts.where("blocks = 1").mapInArrow(sets, shape).select(
        "id", "codes", "grp", yes.alias("asks"), yes.alias("answers"), task.alias("task")
    )
    edges = small.groupBy("task").applyInArrow(found, "a long, b long")
    if not total["large"]:
        return edges
    large = materialize(texts.where("blocks > 1").mapInArrow(sets, shape), "jaccard-large")
    near, apart = _by_pivots(large, total["large"], percent)
    edges = edges.unionByName(near)
    if not apart:
        return edges
    asking, n_asking = apart
    # The rows that ask, and all rows that answer, in bands of size.
    b = band(F.col("n"), percent)
    everything = large.withColumn("band", b)
    ask = join_small(everything, asking, "id", "inner", n_asking).drop("blocks")
    count = F.ceil(F.count(F.lit(1)) / BLOCK).cast("int")
    ask_blocks = ask.select(
        "grp", F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])).alias("band")
    ).groupBy("grp", "band").agg(count.alias("nq"))
    answer_blocks = everything.groupBy("grp", "band").agg(count.alias("nt"))
    plan = materialize(ask_blocks.join(answer_blocks, ["grp", "band"]), "jaccard-plan")
    rows = plan.count()
    part = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    ask = ask.withColumn("band", F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])))
    ask = join_small(ask, plan, ["grp", "band"], "inner", rows).select(
        "id", "codes", "grp", "band", part("nq").alias("q"), every("nt").alias("t"), yes.alias("asks"),
        (~yes).alias("answers"),
    )
    answer = join_small(everything, plan, ["grp", "band"], "inner", rows).select(
        "id", "codes", "grp", "band", every("nq").alias("q"), part("nt").alias("t"), (~yes).alias("asks"),
        yes.alias("answers"),
    )
    return edges.unionByName(
        ask.unionByName(answer).groupBy("grp", "band", "q", "t").applyInArrow(found, "a long, b long")
    )


def _by_pivots(large: DataFrame, n: int, percent: int) -> tuple[DataFrame, tuple[DataFrame, int] | None]:
    """Links of all sets of large groups with up to PIVOTS sets of their own group; and the ids (with their number) of
    the sets outside each group's largest class of pivots and sets linked to them, None if there are none."""
    block = F.pmod(F.xxhash64("id"), "blocks").cast("int")
    chosen = large.groupBy(
        "grp", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(PIVOTS)).cast("int").alias("bit")
    ).agg(F.min("id").alias("id")).select("id", "bit")
    chosen, total = materialize_with(chosen, "jaccard-pivots", n=F.count(F.lit(1)))
    pivots = join_small(large, chosen, "id", "inner", total["n"]).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    rows = large.withColumn("bit", F.lit(-1)).withColumn("block", block)
    columns = ["id", "codes", "grp", "block", "bit"]

    def hold(t: pa.Table) -> pa.Table:
        ids, bit = np.array(t["id"], np.int64), np.array(t["bit"])
        hub, own = np.flatnonzero(bit >= 0), np.flatnonzero(bit < 0)
        sets = _sets_of(t, hub)
        lists, size = inverted(sets), np.array([len(s) for s in sets])
        met = [divide_skip(lists, size, s, percent) for s in _sets_of(t, own)]
        mask = [int(sum(1 << int(bit[hub[x]]) for x in m)) for m in met]
        kind = pa.list_(pa.int64())
        return pa.table(
            {
                "id": ids[own],
                "grp": pa.repeat(t["grp"][0], len(own)),
                "mask": pa.array(mask, pa.int64()),
                "hubs": pa.array([ids[hub[m]].tolist() for m in met], kind),
            }
        )

    met = pivots.select(*columns).unionByName(rows.select(*columns)).groupBy("grp", "block").applyInArrow(
        hold, "id long, grp long, mask long, hubs array<long>"
    )
    met = materialize(met, "jaccard-met")
    masks = met.groupBy("grp", "mask").agg(F.count(F.lit(1)).alias("n"))

    def classes(t: pa.Table) -> pa.Table:
        """At most 2**PIVOTS rows: the masks of a group; all but those of the largest class ask."""
        mask, many = np.array(t["mask"], np.int64), np.array(t["n"], np.int64)
        bits = [np.flatnonzero((int(m) >> np.arange(PIVOTS)) & 1) for m in mask]
        a = np.concatenate([np.full(len(x), x[0]) for x in bits if len(x)] or [np.zeros(0, int)]).astype(int)
        root = roots(PIVOTS, a, np.concatenate([x for x in bits if len(x)] or [np.zeros(0, int)]).astype(int))
        own = np.array([root[x[0]] if len(x) else PIVOTS + i for i, x in enumerate(bits)])
        size = np.bincount(own, np.where(mask > 0, many, 0), PIVOTS + len(mask))
        ask = own != size.argmax()
        return pa.table({"grp": pa.repeat(t["grp"][0], int(ask.sum())), "mask": mask[ask]})

    apart, total = materialize_with(
        masks.groupBy("grp").applyInArrow(classes, "grp long, mask long"), "jaccard-apart", n=F.count(F.lit(1))
    )
    edges = met.select("id", F.explode("hubs").alias("b")).where("id <> b").select(F.col("id").alias("a"), "b")
    if not total["n"]:
        return edges, None
    asking, total = materialize_with(
        join_small(
            met.select("id", "grp", "mask"), apart, ["grp", "mask"], "inner", total["n"]
        ).select("id").distinct(),
        "jaccard-asking",
        n=F.count(F.lit(1)),
    )
    return edges, (asking, total["n"])


def jaccard_components(
    docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", k: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id.

    Null, empty and blank texts have no shingles and are linked with nothing. Rows that share a doc_id are one node with
    several texts, its links being those of any of them. Rows with a null doc_id have no component and link nothing.
    Columns of ``docs`` may have any names; doc_id must be an integer.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    base, sets = materialize_with(signatures(rows, k), "jaccard-sets", shingles=F.sum("n"))
    real = base.where("n > 0 and id is not null")
    classes = real.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    first, total = materialize_with(classes.where("copies > 1"), "jaccard-classes", n=F.count(F.lit(1)))
    # All that is no representative stays out of the search; ids of several texts stay in.
    copies = join_small(
        real, first, ["n", "s1", "s2"], "inner", total["n"]
    ).where("id <> rep").select("id", "rep").distinct()
    copies, total = materialize_with(copies, "jaccard-copies", n=F.count(F.lit(1)))
    drop(first)
    several = base.where("id is not null").groupBy("id").agg(
        F.count(F.lit(1)).alias("texts")
    ).where("texts > 1").select("id")
    aside = copies.select("id").distinct().join(several, "id", "left_anti")
    texts = _only(rows.where("id is not null"), aside, total["n"], "left_anti")
    buckets = max(16, shuffle_partitions(spark), min(MOST_BUCKETS, (sets["shingles"] or 0) // BUCKET))
    pairs = materialize(candidates(texts, k, buckets, frequencies(texts, k, buckets, FREQUENT)), "jaccard-candidates")
    groups = components(pairs)
    drop(pairs)
    members = groups.select(F.col("node").alias("id"), F.col("component").alias("grp"))
    members = members.unionByName(
        groups.select(F.col("component").alias("id"), F.col("component").alias("grp")).distinct()
    )
    edges = links(texts, members, k, percent).unionByName(
        copies.select(F.col("id").alias("a"), F.col("rep").alias("b"))
    )
    found = components(edges)
    got = base.join(found, base["id"] == found["node"], "left")
    return got.select(
        base["id"].alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group, the one of the smallest doc_id; same columns."""
    found = jaccard_components(docs, **options).where("doc_id <> component_id").select(
        F.col("doc_id").alias("_gone")
    ).distinct()
    return docs.join(found, docs["doc_id"] == found["_gone"], "left_anti")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
