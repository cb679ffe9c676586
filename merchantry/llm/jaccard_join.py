"""Exact set similarity join of documents by their word shingles, in tiles of one rare shingle and one band of sizes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantry.llm.byte_words import DARK, find_words, window_hashes
from merchantry.llm.components import components
from merchantry.llm.text_blocks import KEY_BITS, Asked, answers, asks, opened_counts, range_bits, store_blocks, unpacked_rows
from merchantry.llm.worker_memory import lean
from merchantry.session import in_few_tasks, read_bytes, store

SHINGLE = 5
_SIGNATURE_WORDS = 4  # of 64 bits
_EARLIER = 2  # rarer keys of its class that a row of a tile knows
_BEFORE = [f"before{i}" for i in range(_EARLIER)]
_MEMBER = ["root", "n", "place", *[f"s{i}" for i in range(_SIGNATURE_WORDS)], *_BEFORE]
_MEMBERS_MET = (8, 64)  # of a tile's largest component, round by round, by those outside it
_DRAW_BITS = 24
_PAIR_TILE_BYTES = 2 << 20  # of stored tiles, for each task that writes their pairs
_PAIR_BYTES = 4 << 10  # of stored pairs, for each task that compares them


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(first, hashes): text i has the distinct shingle hashes first[i]:first[i + 1], ascending.

    Shingles are runs of 5 words; a text with fewer has all its words as one; without words it has none.
    """
    words = find_words(texts, DARK, lower=True)
    hashes = words.hashes()
    places, shingles = window_hashes(hashes, words.first, SHINGLE)
    owner = np.searchsorted(words.first, places, side="right") - 1
    counts = np.diff(words.first)
    for size in range(1, SHINGLE):
        few = np.flatnonzero(counts == size)
        if len(few):
            at = words.first[few]
            _, own = window_hashes(hashes[(at[:, None] + np.arange(size)).ravel()], np.arange(len(few) + 1) * size, size)
            owner, shingles = np.r_[owner, few], np.r_[shingles, own ^ np.uint64(size)]
    order = np.lexsort((shingles, owner))
    owner, shingles = owner[order], shingles[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (shingles[1:] != shingles[:-1])
    owner, shingles = owner[new], shingles[new]
    return np.searchsorted(owner, np.arange(len(texts) + 1)), shingles


def _set_columns(texts: list[bytes]) -> list:
    first, shingles = shingle_sets(texts)
    digests = [hashlib.blake2b(shingles[a:b].tobytes(), digest_size=16).digest() for a, b in zip(first[:-1], first[1:])]
    return [np.diff(first).tolist(), digests]


def signatures(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Bitmaps of n sets: each bit is the parity of the set's hashes that fall on it.

    Two bitmaps differ in at most as many bits as the sets have elements that the other lacks.
    """
    bits = _SIGNATURE_WORDS * 64
    parity = np.bincount(owner * bits + (hashes >> np.uint64(3)).astype(np.int64) % bits, minlength=n * bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view("<i8").reshape(n, _SIGNATURE_WORDS)


def _least_shared(size: Column, other: Column, percent: int) -> Column:
    """The smallest intersection for which 100 * intersection >= percent * union."""
    return F.ceil(percent * (size + other) / F.lit(100.0 + percent) - 1e-9)


def similar_classes(docs: DataFrame, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(members, links): doc_id, n_shingles and root of every document, and linked pairs (a, b) of roots.

    Documents with one shingle set are a class; its root is its smallest doc_id. Links are
    pairs of classes with 100 * intersection >= percent * union: enough of them that two classes
    are connected by links exactly when they are in the whole graph of such pairs. Empty
    sets and null doc_ids are linked with nothing.

    A pair that is similar enough shares a shingle among the rarest few of each set, in an order
    of all shingles by how many documents have them. Tiles hold the classes with one such shingle
    in one band of sizes and the next. First every class of a tile is compared with the tile's
    smallest class, which connects groups of near copies with one comparison a class. What is
    outside a tile's largest component then meets a few members of it, then some more, and at last, so
    that nothing is missed, all classes of other components; each pair at its first shared key, seldom again. Bit counts of the signatures bound the intersection from above; the pairs that pass
    are decided by intersecting the sorted sets.
    """
    blocks = store_blocks(
        docs, "shingle-blocks", _set_columns, "sizes array<long>, digests array<binary>",
        (pa.list_(pa.int64()), pa.list_(pa.binary())),
    )
    bits = range_bits(blocks)
    work = blocks.select("block", "payload")

    def asked(row: dict) -> Asked:
        return Asked.of(shingle_sets(unpacked_rows(row["payload"])[1])[1])[0]

    counts = answers(asks(work, bits, 255, asked), 255)
    rows = blocks.select("block", F.posexplode(F.arrays_zip("doc_ids", "sizes", "digests")).alias("place", "row")).select(
        "block", "place", F.col("row.doc_ids").alias("doc_id"), F.col("row.sizes").alias("n_shingles"), F.col("row.digests").alias("digest")
    )
    filled = rows.where("n_shingles > 0 and doc_id is not null")
    classes = store(
        filled.groupBy("digest").agg(F.min(F.struct("doc_id", "block", "place")).alias("first")).select(
            "digest", F.col("first.doc_id").alias("root"), "first.block", "first.place"), "shingle-classes"
    )
    members = rows.join(classes.select("digest", "root"), "digest", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("root")).alias("root")
    )
    chosen = classes.groupBy("block").agg(F.collect_list(F.struct("place", "root")).alias("chosen"))
    tiles, sets = _tiles_and_sets(work.join(chosen, "block").join(counts, "block", "left"), percent)
    links = _stored_links(_star_pairs(tiles, percent), tiles, sets, percent)
    labels = components(links)
    for some_members in (*_MEMBERS_MET, None):
        more = _stored_links(_crossing_pairs(tiles, labels, percent, some_members), tiles, sets, percent)
        links = links.union(more)
        labels = components(links) if some_members else labels
    return members, links


def _tiles_and_sets(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Stored (key, root, n, place, signature words, keys before it) for the rare shingles of each class, and (root, n, shared) of those classes.

    `shared` are the set's hashes that other documents have too: no others can be in an intersection.
    """
    schema = "root long, n int, keys binary, ranks binary, signature binary, shared binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                first, shingles = shingle_sets(unpacked_rows(row["payload"])[1])
                places = np.array([c["place"] for c in row["chosen"]], np.int64)
                roots = np.array([c["root"] for c in row["chosen"]], np.int64)
                frequency = opened_counts(row["counts"])[Asked.of(shingles)[1]].astype(np.int64)
                size = np.diff(first)
                owner = np.repeat(np.arange(len(size)), size)
                marks = signatures(owner, shingles, len(size))
                # Rarest first, then by hash; only shingles of two documents or more can be shared.
                order = np.lexsort((shingles, frequency, owner))
                rank = np.arange(len(order)) - first[owner]
                least = -(-percent * size // 100)
                key = (rank < (size - least + 1)[owner]) & (frequency[order] > 1)
                key_hashes = (shingles[order] >> np.uint64(64 - KEY_BITS)).astype("<i8")
                key_first = np.r_[0, np.cumsum(key)][first]
                key_hashes, key_ranks = key_hashes[key], rank[key].astype("<i4")
                shared = frequency > 1
                shared_first = np.r_[0, np.cumsum(shared)][first]
                shared_hashes = shingles[shared].astype("<u8")
                use = key_first[places + 1] > key_first[places]
                places, roots = places[use], roots[use]
                yield pa.RecordBatch.from_arrays([
                    pa.array(roots), pa.array(size[places].astype(np.int32)),
                    pa.array([key_hashes[key_first[p]:key_first[p + 1]].tobytes() for p in places.tolist()], pa.binary()),
                    pa.array([key_ranks[key_first[p]:key_first[p + 1]].tobytes() for p in places.tolist()], pa.binary()),
                    pa.array([marks[p].tobytes() for p in places.tolist()], pa.binary()),
                    pa.array([shared_hashes[shared_first[p]:shared_first[p + 1]].tobytes() for p in places.tolist()], pa.binary()),
                ], names=["root", "n", "keys", "ranks", "signature", "shared"])

    stored = store(rows.mapInArrow(lean(run), schema), "shingle-sets")
    key_schema = ", ".join(["key long, root long, n int, place int", *[f"{name} long" for name in _MEMBER[3:]]])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(value.as_py(), "<i8") for value in batch.column(2)]
            times = [len(part) for part in parts]
            if not sum(times):
                continue
            marks = np.frombuffer(b"".join(value.as_py() for value in batch.column(4)), "<i8").reshape(-1, _SIGNATURE_WORDS)
            ranks = np.frombuffer(b"".join(value.as_py() for value in batch.column(3)), "<i4")
            columns = [np.concatenate(parts), np.repeat(batch.column(0).to_numpy(), times), np.repeat(batch.column(1).to_numpy(), times), ranks]
            columns += [np.repeat(marks[:, i], times) for i in range(_SIGNATURE_WORDS)]
            number = np.arange(len(columns[0])) - np.repeat(np.cumsum(times) - times, times)
            columns += [np.where(number > i, np.roll(columns[0], i + 1), -1) for i in range(_EARLIER)]
            yield pa.RecordBatch.from_arrays([pa.array(column) for column in columns], names=["key", *_MEMBER])

    all_keys = stored.select("root", "n", "keys", "ranks", "signature").mapInArrow(lean(keys), key_schema)
    # Bands grow by a quarter: sets whose sizes allow the similarity are in one band or in neighbours.
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    return store(all_keys.withColumn("band", band), "shingle-tiles"), stored.select("root", "n", "shared")


def _bounded(left: str, right: str, percent: int) -> Column:
    """Whether sizes, places and bit counts leave room for a large enough intersection.

    The rarest shingle that two sets share has none of their intersection before it in either, so
    at that shingle no more can be shared than follows it in the set with less to come.
    """
    differing = sum(
        (F.bit_count(F.col(f"{left}.s{i}").bitwiseXOR(F.col(f"{right}.s{i}"))) for i in range(_SIGNATURE_WORDS)), F.lit(0)
    )
    size, other = F.col(f"{left}.n"), F.col(f"{right}.n")
    most = F.floor((size + other - differing) / 2)
    left_to_come, right_to_come = size - F.col(f"{left}.place"), other - F.col(f"{right}.place")
    least = _least_shared(size, other, percent)
    return (
        (100 * F.least(size, other) >= percent * F.greatest(size, other))
        & (F.least(left_to_come, right_to_come) >= least) & (most >= least)
    )


def _first_met(left: str, right: str) -> Column:
    """False where the two sets share one of the last few rarer keys of both, whose tile they meet in as well.

    Sets meet by their rarest shared key in any case, and near copies, which share most keys, seldom by another.
    """
    same = [
        (F.col(f"{left}.{one}") == F.col(f"{right}.{other}")) & (F.col(f"{left}.{one}") >= 0) for one in _BEFORE for other in _BEFORE
    ]
    return ~reduce(Column.__or__, same)


def _in_own_and_lower_tile(tiles: DataFrame) -> DataFrame:
    return tiles.withColumn("tile", F.explode(F.array("band", F.col("band") - 1)))


def _star_pairs(tiles: DataFrame, percent: int) -> DataFrame:
    """(a, b): the smallest class of each tile's own band with every other class of the tile."""
    order = F.struct("n", *[c for c in _MEMBER if c != "n"])
    centre = tiles.groupBy("key", F.col("band").alias("tile")).agg(F.min(order).alias("c"))
    centre = centre.select("key", "tile", "c.*").alias("l")
    every = _in_own_and_lower_tile(tiles).alias("r")
    return every.join(centre, ["key", "tile"]).where((F.col("l.root") != F.col("r.root")) & _bounded("l", "r", percent)).select(
        F.least("l.root", "r.root").alias("a"), F.greatest("l.root", "r.root").alias("b"))


def _crossing_pairs(tiles: DataFrame, labels: DataFrame, percent: int, some_members: int | None = None) -> DataFrame:
    """(a, b): pairs of a tile that no links connect yet, once or a few times each.

    One side leaves out the tile's largest component, so a large group of connected classes is
    met only by the few outside it; with `some_members`, by these with about so many of the component alone.
    """
    known = tiles.join(labels, tiles["root"] == labels["id"], "left").select(
        *tiles.columns, F.coalesce("component_id", "root").alias("component"))
    mixed = known.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    known = store(known.join(mixed.select("key"), "key"), "mixed-tiles")
    every = _in_own_and_lower_tile(known)
    largest = every.groupBy("key", "tile", "component").agg(F.count("*").alias("size")).groupBy("key", "tile").agg(
        F.max(F.struct("size", "component")).alias("m")).select("key", "tile", F.col("m.component").alias("main"), "m.size")
    placed = every.join(largest, ["key", "tile"])
    some = placed.where(F.col("component") != F.col("main")).drop("size").alias("l")
    others = every
    if some_members:
        # Members of the lowest hashes, much the same ones in all tiles of a group.
        drawn = F.xxhash64("root").bitwiseAND((1 << _DRAW_BITS) - 1) * F.col("size") < some_members << _DRAW_BITS
        others = placed.where((F.col("component") == F.col("main")) & drawn).drop("main", "size")
    # Two of a band are in two tiles, and two outside the largest component on both sides; once is enough.
    once = ((F.col("l.band") == F.col("tile")) | (F.col("r.band") == F.col("tile"))) & (
        (F.col("r.component") == F.col("l.main")) | (F.col("l.root") < F.col("r.root")))
    pairs = some.join(others.alias("r"), ["key", "tile"]).where(
        (F.col("l.component") != F.col("r.component")) & once & _first_met("l", "r") & _bounded("l", "r", percent))
    return pairs.select(F.least("l.root", "r.root").alias("a"), F.greatest("l.root", "r.root").alias("b"))


def _stored_links(pairs: DataFrame, tiles: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The stored links among pairs of the tiles, each once.

    Pairs are written before their sets are joined: then their true size is known, few of them are broadcast, and the
    tasks follow their number.
    """
    found = store(in_few_tasks(pairs.distinct(), read_bytes(tiles), _PAIR_TILE_BYTES), "shingle-pairs")
    return store(in_few_tasks(_verified(found, sets, percent), read_bytes(found), _PAIR_BYTES), "shingle-links")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are similar enough, by intersecting the sorted sets."""
    left = sets.select(F.col("root").alias("a"), F.col("n").alias("n_a"), F.col("shared").alias("set_a"))
    right = sets.select(F.col("root").alias("b"), F.col("n").alias("n_b"), F.col("shared").alias("set_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            a, b = batch.column("set_a"), batch.column("set_b")
            sizes = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            for i in range(batch.num_rows):
                one, other = np.frombuffer(a[i].as_buffer(), "<u8"), np.frombuffer(b[i].as_buffer(), "<u8")
                both = np.concatenate([one, other])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * shared >= percent * (int(sizes[i]) - shared)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return pairs.join(right, "b").join(left, "a").mapInArrow(lean(run), "a long, b long")


def similarity_groups(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links, itself included) of every document.

    Texts are compared whole, A-Z in lower case. Null texts count as empty; a document without
    words is alone in its component; repeated rows have a row each, and rows of one doc_id are taken as linked; rows with a null
    doc_id have a null component; an empty table gives an empty result; other columns are ignored.
    """
    members, links = similar_classes(docs, percent)
    labels = components(links).withColumnRenamed("id", "root")
    return members.join(labels, "root", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "root", "doc_id")).alias("component_id"))
