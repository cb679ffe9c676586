"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations, with multiprobe buckets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.llm.components import components
from merchantry.session import store

_PAIRS_AT_ONCE = 100_000


@lru_cache(maxsize=8)
def _signs(width: int, rotations: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice([-1.0, 1.0], (rotations, 3, width))


def _hadamard(rows: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row."""
    n, width = rows.shape
    step = 1
    while step < width:
        halves = rows.reshape(n, width // (2 * step), 2, step)
        rows = np.stack([halves[:, :, 0] + halves[:, :, 1], halves[:, :, 0] - halves[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return rows


def codes(vectors: np.ndarray, tables: int, probes: int, seed: int = 7) -> np.ndarray:
    """Bucket numbers, rows x tables x (1 + probes): a vector's own bucket, then those it nearly fell into.

    A bucket is the nearest signed axis after each of two random rotations. The next buckets replace
    the axis of a rotation by the second or third, or both by the second; those that lose least come first.
    """
    n, dims = vectors.shape
    width = max(4, 1 << (dims - 1).bit_length())
    unit = np.zeros((n, width))
    unit[:, :dims] = vectors / np.sqrt((vectors ** 2).sum(axis=1, keepdims=True))
    axes, loss = [], []
    for signs in _signs(width, 2 * tables, seed):
        rows = unit
        for flips in signs:
            rows = _hadamard(rows * flips)
        size = np.abs(rows)
        best = np.argpartition(-size, 2, axis=1)[:, :3]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(size, best, axis=1), axis=1, kind="stable"), axis=1)
        value = np.take_along_axis(rows, best, axis=1)
        axes.append(2 * best + (value < 0))
        loss.append((np.abs(value[:, :1]) - np.abs(value)) / np.abs(value[:, :1]))
    options = np.array([(1, 0), (0, 1), (1, 1), (2, 0), (0, 2)])
    out = np.empty((n, tables, 1 + probes), np.int64)
    for t in range(tables):
        one, other = axes[2 * t], axes[2 * t + 1]
        out[:, t, 0] = one[:, 0] * 2 * width + other[:, 0]
        total = loss[2 * t][:, options[:, 0]] + loss[2 * t + 1][:, options[:, 1]]
        for p, choice in enumerate(np.argsort(total, axis=1, kind="stable")[:, :probes].T):
            pick = options[choice]
            rows = np.arange(n)
            out[:, t, 1 + p] = one[rows, pick[:, 0]] * 2 * width + other[rows, pick[:, 1]]
    return out


def _first_meeting(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For rows of codes, table * 2 ** 40 + bucket of the first bucket where both come together and one is at home.

    Every such pair has one, whichever bucket it is looked at in, so it is counted there alone.
    """
    out = np.full(len(left), -1, np.int64)
    for t in range(left.shape[1] - 1, -1, -1):
        at_right = (left[:, t] == right[:, t, :1]).any(axis=1)
        at_left = (right[:, t] == left[:, t, :1]).any(axis=1)
        home_right, home_left = right[:, t, 0], left[:, t, 0]
        bucket = np.where(at_right & at_left, np.minimum(home_left, home_right), np.where(at_right, home_right, home_left))
        out = np.where(at_right | at_left, t << 40 | bucket, out)
    return out


def _labels(nodes: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node reachable by links (a, b), for nodes 0 to nodes - 1."""
    label = np.arange(nodes)
    while len(a):
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    return label


def _unit_pairs(units: np.ndarray, sides: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs to compare, a bounded number at once: rows are sorted by unit and then side.

    Side 0 meets side 1; a unit with side 0 alone is compared within itself.
    """
    bounds = np.r_[np.flatnonzero(np.r_[True, units[1:] != units[:-1]]), len(units)]
    sizes = np.diff(bounds)
    zeros = np.add.reduceat((sides == 0).astype(np.int64), bounds[:-1])
    pairs = np.where(zeros == sizes, sizes * (sizes - 1) // 2, zeros * (sizes - zeros))
    block = np.cumsum(pairs) // _PAIRS_AT_ONCE
    for number in np.unique(block).tolist():
        left, right = [], []
        for u in np.flatnonzero((block == number) & (pairs > 0)).tolist():
            first, size, own = bounds[u], sizes[u], zeros[u]
            if own == size:
                i, j = np.triu_indices(size, 1)
            else:
                i, j = np.divmod(np.arange(own * (size - own)), size - own)
                j = j + own
            left.append(first + i)
            right.append(first + j)
        if left:
            left, right = np.concatenate(left), np.concatenate(right)
            for at in range(0, len(left), _PAIRS_AT_ONCE):
                yield left[at:at + _PAIRS_AT_ONCE], right[at:at + _PAIRS_AT_ONCE]


def near_duplicates(
    vectors: DataFrame, least_cosine: float = 0.98, tables: int = 6, probes: int = 3, unit_rows: int = 1_000
) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of (vec_id, embedding, label).

    Rows are compared only when their labels are equal and not null and their vectors have one
    length; null or zero vectors and those with null or non-finite components link with
    nothing. Pairs that share a bucket in which one of them is at home are decided by the
    cosine in double precision: no link is below `least_cosine`, and few above it are missed.

    Equal vectors of a label are hashed once and count as often as they occur, so copies cost
    nothing. A bucket of more than `unit_rows` rows is cut into parts that are compared pair by
    pair in separate units, so a hot bucket spreads over tasks. A pair is counted in the first
    bucket where it meets; units return counts of links and a spanning forest, never all pairs.
    vec_ids are taken as unique; rows with one vec_id share their counts. A null vec_id
    has no links and a null component. An empty table gives an empty result.
    """
    fine = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    fine &= F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine &= F.exists("embedding", lambda x: x != 0)
    good = vectors.where(fine).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    classes = store(
        good.groupBy("label", "vector").agg(F.min("vec_id").alias("root"), F.count("*").alias("copies")), "vector-classes"
    )
    units = _units(classes, tables, probes, unit_rows)
    found = store(_linked(units, least_cosine, tables, probes), "vector-links")
    counts = found.where("links is not null").groupBy("root").agg(F.sum("links").alias("links"))
    labels = components(found.where("other is not null").select(F.col("root").alias("a"), F.col("other").alias("b")))
    by_class = classes.join(counts, "root", "left").join(labels.withColumnRenamed("id", "root"), "root", "left")
    by_class = by_class.select(
        "label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component_id", "root").alias("component_id"),
    )
    known = good.join(by_class, ["label", "vector"]).select("vec_id", "n_links", "component_id").dropDuplicates(["vec_id"])
    return vectors.select("vec_id").join(known, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
    )


def _units(classes: DataFrame, tables: int, probes: int, unit_rows: int) -> DataFrame:
    """Rows (unit, side, root, copies, vector, codes, meeting): what is compared with what."""
    schema = "place int, home boolean, root long, copies long, label int, vector binary, codes binary, dims int, bucket long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            lengths = np.diff(whole.column("vector").offsets.to_numpy()) if whole.num_rows else []
            for dims in np.unique(lengths).tolist():
                batch = whole.filter(pa.array(lengths == dims))
                rows = np.array(batch.column("vector").to_pylist(), np.float64).reshape(-1, dims)
                found = codes(rows, tables, probes)
                data, coded = [r.tobytes() for r in rows], [c.astype("<i4").tobytes() for c in found]
                n, each = len(rows), tables * (1 + probes)
                index = pa.array(np.repeat(np.arange(n), each))
                place, slot = np.divmod(np.tile(np.arange(each), n), 1 + probes)
                yield pa.RecordBatch.from_arrays([
                    pa.array(place.astype(np.int32)), pa.array(slot == 0), batch.column("root").take(index),
                    batch.column("copies").take(index), batch.column("label").cast(pa.int32()).take(index),
                    pa.array(data, pa.binary()).take(index), pa.array(coded, pa.binary()).take(index),
                    pa.array(np.full(n * each, dims, np.int32)), pa.array(found.reshape(-1)),
                ], names=["place", "home", "root", "copies", "label", "vector", "codes", "dims", "bucket"])

    key = ["label", "dims", "place", "bucket"]
    rows = store(classes.mapInArrow(run, schema), "vector-buckets")
    sizes = rows.groupBy(*key).agg(
        F.count(F.when(F.col("home"), 1)).alias("homes"), F.count(F.when(~F.col("home"), 1)).alias("guests")
    ).where("homes > 0 and homes + guests > 1")
    rows = rows.join(sizes, key)
    parts, guest_parts = F.ceil(F.col("homes") / unit_rows).cast("int"), F.ceil(F.col("guests") / unit_rows).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("guest_parts", guest_parts)
    part = F.pmod(F.xxhash64("root"), F.when(F.col("home"), F.col("parts")).otherwise(F.col("guest_parts"))).cast("int")
    rows = rows.withColumn("part", part)

    def unit(kind: str, first, second, side):
        return F.struct(F.lit(kind).alias("kind"), first.alias("first"), second.alias("second"), side.alias("side"))

    own = F.col("part")
    among_homes = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: unit(
        "homes", F.least(own, k), F.greatest(own, k), F.when(own <= k, F.lit(0)).otherwise(F.lit(1))))
    with_guests = F.when(F.col("guest_parts") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("guest_parts") - 1, F.lit(0))), lambda k: unit(
        "guests", own, k, F.lit(0)))).otherwise(F.filter(among_homes, lambda u: F.lit(False)))
    as_guest = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: unit("guests", k, own, F.lit(1)))
    all_units = F.when(F.col("home"), F.concat(among_homes, with_guests)).otherwise(as_guest)
    return rows.withColumn("u", F.explode(all_units)).select(
        F.xxhash64("label", "dims", "place", "bucket", "u.kind", "u.first", "u.second").alias("unit"), "u.side",
        "root", "copies", "vector", "codes", "dims", (F.shiftleft(F.col("place").cast("long"), 40) + F.col("bucket")).alias("meeting"),
    )


def _linked(units: DataFrame, least_cosine: float, tables: int, probes: int) -> DataFrame:
    """(root, links, null) and (root, null, other): partial counts of links, and links that connect what a task has seen."""
    dealt = units.repartition("unit").sortWithinPartitions("unit", "side", "root")

    def linked(batch: pa.Table) -> Iterator[pa.RecordBatch]:
        unit, side = batch.column("unit").to_numpy(), batch.column("side").to_numpy()
        root, copies = batch.column("root").to_numpy(), batch.column("copies").to_numpy()
        dims, meeting = batch.column("dims").to_numpy(), batch.column("meeting").to_numpy()
        coded = np.frombuffer(b"".join(batch.column("codes").to_pylist()), "<i4").astype(np.int64).reshape(len(unit), tables, 1 + probes)
        data = batch.column("vector").to_pylist()
        width = int(dims.max())
        vectors = np.zeros((len(unit), width))
        for size in np.unique(dims).tolist():  # the vectors of a unit have one length
            own = np.flatnonzero(dims == size)
            vectors[own, :size] = np.frombuffer(b"".join(data[i] for i in own.tolist()), np.float64).reshape(-1, size)
        norms = np.sqrt((vectors ** 2).sum(axis=1))
        nodes, node = np.unique(root, return_inverse=True)
        links = np.zeros(len(nodes), np.int64)
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for left, right in _unit_pairs(unit, side):
            cosine = np.einsum("ij,ij->i", vectors[left], vectors[right]) / (norms[left] * norms[right])
            near = (cosine >= least_cosine) & (root[left] != root[right]) & (meeting[left] == meeting[right])
            left, right = left[near], right[near]
            first = _first_meeting(coded[left], coded[right]) == meeting[left]
            left, right = left[first], right[first]
            np.add.at(links, node[left], copies[right])
            np.add.at(links, node[right], copies[left])
            label = _labels(len(nodes), node[left], node[right])
            moved = np.flatnonzero(label != np.arange(len(nodes)))
            ends.append((moved, label[moved]))
        a, b = (np.concatenate(side) for side in zip(*ends)) if ends else (np.zeros(0, np.int64),) * 2
        label = _labels(len(nodes), a, b)
        some, moved = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([
            pa.array(np.r_[nodes[some], nodes[moved]], pa.int64()),
            pa.concat_arrays([pa.array(links[some], pa.int64()), pa.nulls(len(moved), pa.int64())]),
            pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(nodes[label[moved]], pa.int64())]),
        ], names=["root", "links", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            unit = held.column("unit").to_numpy()
            last = int(np.searchsorted(unit, unit[-1]))  # the last unit may go on in the next batch
            if last:
                yield from linked(held.slice(0, last).combine_chunks())
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield from linked(held.combine_chunks())

    return dealt.mapInArrow(run, "root long, links long, other long")
