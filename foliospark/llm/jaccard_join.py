"""Self-join on the Jaccard similarity of n-gram sets by vertical partitioning.

All n-grams get one global order, rare ones first. It is cut into fragments; the overlap of a pair is
counted in each fragment apart and summed per pair, so the result is exact. Pairs to count come from
the low end of the same order: two sets that are similar enough share an n-gram among the first few
of each. Texts with equal sets are one class throughout. Every pair of classes is compared once, and all links are
counted. Where a list of classes is long, its pairs are not made: the classes are compared block against block,
and a block gives each class's number of links and only so many links as span what links.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .shingles import sets

#: Cells of the frequency sketch that gives the global order: a bound of its size, whatever the input. The order decides what is fast, never what is found.
CELLS = 1 << 22
#: Bits of a digest that number a class. Sets of different digests that share a number get numbers of their own, below zero: some 5 of 10^10 sets, 54,000 of 10^12.
NODE_BITS = 63


def _cell(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(6)) & np.uint64(CELLS - 1)).astype(np.int64)


def _digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _numbered(digest: bytes, bits: int) -> int:
    return int.from_bytes(digest[:8], "little") & ((1 << bits) - 1)


def _first_pass(size: int, bits: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("node", pa.int64()), ("chunk", pa.int64()), ("cells", pa.binary())])

    def run(batches):
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            ns, digests, nodes = [], [], []
            for grams in sets(batch["text"], size):
                digest = _digest(grams)
                ns.append(len(grams)), digests.append(digest), nodes.append(_numbered(digest, bits) if len(grams) else None)
                np.add.at(counts, _cell(grams), 1)
            empty = pa.nulls(len(ns))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), batch["text_hash"], pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), pa.array(nodes, pa.int64()), empty.cast(pa.int64()), empty.cast(pa.binary())], schema=schema)
        for chunk, cells in common.packed(counts):
            yield pa.RecordBatch.from_pylist([{"chunk": chunk, "cells": cells}], schema)

    return run, "doc_id long, text_hash long, n long, digest binary, node long, chunk long, cells binary"


def _levels(total: np.ndarray) -> bytes:
    """The sum of a chunk's counts, as one level for each cell: the bit length of its count; then the counts of each level."""
    levels = np.ceil(np.log2(total + 1)).astype(np.uint8)
    return levels.tobytes() + np.bincount(levels, weights=total, minlength=64).astype("<i8").tobytes()


def _classes(each: DataFrame) -> tuple[DataFrame, DataFrame, dict[bytes, int]]:
    """``each`` with one node for each digest, the classes of equal sets (written), and the digests whose node is no part of them.

    A number that two digests share stays with the least one; the others are counted down from -1.
    """
    counted = [F.min("doc_id").alias("low"), F.max("n").alias("n"), F.count("*").alias("copies")]
    some = each.where("n > 0")
    classes = common.written(some.groupBy("node").agg(*counted, F.min("digest").alias("least"), F.max("digest").alias("most")), "classes")
    shared = classes.where("least <> most").select("node", "least")
    more = some.join(shared.hint("merge"), "node").where("digest <> least").select("digest").distinct().orderBy("digest")
    moved = {bytes(r["digest"]): -1 - k for k, r in enumerate(more.collect())}  # n^2 / 2^64 of n sets
    if not moved:
        return each, classes, moved
    numbers = F.broadcast(each.sparkSession.createDataFrame(list(moved.items()), "digest binary, moved long"))
    each = each.join(numbers, "digest", "left").withColumn("node", F.coalesce("moved", "node")).drop("moved")
    again = shared.select("node").unionAll(numbers.select("moved"))
    anew = each.where("n > 0").join(again.hint("merge"), "node", "left_semi").groupBy("node").agg(*counted).select("node", "low", "copies", "n")
    known = common.written(classes.where("least = most").select("node", "low", "copies", "n").unionAll(anew), "classes")
    common.dropped(classes)
    return each, known, moved


def _keys(grams: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Places in the global order: the level of the cell, then 58 bits of the hash."""
    return np.sort((levels[_cell(grams)].astype(np.uint64) << np.uint64(58)) | (grams >> np.uint64(6)))


def _pivots(mass: np.ndarray, fragments: int) -> np.ndarray:
    """Where the global order is cut, so that each fragment holds about as many n-grams."""
    upto, cuts = np.cumsum(mass), []
    for k in range(1, fragments):
        want = upto[-1] * k // fragments
        level = min(len(mass) - 1, int(np.searchsorted(upto, want, "right")))
        inside = (want - (upto[level - 1] if level else 0)) / max(1, mass[level])
        cuts.append((level << 58) | int(inside * (1 << 58)))
    return np.array(cuts, np.uint64)


#: Similar sets of enough n-grams share so many among their first ones; more of them rule out more pairs that share a passage only.
COMMON = 8
#: A list of up to so many classes gives pairs; larger ones are gathered in clusters, compared in blocks of about so many n-grams and classes.
MOST_LISTED, BLOCK_GRAMS, BLOCK_CLASSES = 200, 200_000, 4000


#: Overlaps of a block are counted for so many pairs at a time.
PAIRS_HELD = 1 << 22
#: A task hands segments on when it holds so many bytes of them.
HELD_BYTES = 4 << 20


def _block_links(percent: int):
    """Between the classes of two blocks (or within one): the number of rows that each class links with, and links that span what links."""

    def run(table: pa.Table) -> pa.Table:
        nodes, first = np.unique(table["node"].to_numpy(), return_index=True)
        copies, sides = table["copies"].to_numpy()[first], table["side"].to_numpy()[first]
        at, parts, grams = np.searchsorted(nodes, table["node"].to_numpy()), table["fragment"].to_numpy(), table["grams"]
        sizes = np.zeros(len(nodes), np.int64)
        one_block = 0 <= table["i"][0].as_py() == table["j"][0].as_py()
        left = np.flatnonzero(sides == 0)
        right = left if one_block else np.flatnonzero(sides == 1)
        place = np.full(len(nodes), -1)
        place[right] = np.arange(len(right))
        held = []
        for part in np.unique(parts):
            rows = np.flatnonzero(parts == part)
            rows = rows[np.unique(at[rows], return_index=True)[1]]
            keys = {int(at[r]): np.frombuffer(grams[int(r)].as_buffer(), np.uint64) for r in rows}
            for x, k in keys.items():
                sizes[x] += len(k)
            theirs = [(place[x], k) for x, k in keys.items() if place[x] >= 0]
            if theirs:
                all_keys = np.concatenate([k for _, k in theirs])
                owner = np.concatenate([np.full(len(k), i) for i, k in theirs])
                order = np.argsort(all_keys, kind="stable")
                held.append((keys, all_keys[order], owner[order]))
        root, links, a, b = np.arange(len(nodes)), np.zeros(len(nodes), np.int64), [], []
        step = max(1, PAIRS_HELD // max(1, len(right)))
        for start in range(0, len(left), step):
            some = left[start : start + step]
            sums = np.zeros((len(some), len(right)), np.int32)
            for keys, all_keys, owner in held:  # partial overlaps of each fragment, summed
                for i, x in enumerate(some.tolist()):
                    if (k := keys.get(x)) is not None:
                        lo, hi = np.searchsorted(all_keys, k, "left"), np.searchsorted(all_keys, k, "right")
                        n = hi - lo
                        found = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                        sums[i] += np.bincount(owner[found], minlength=len(right)).astype(np.int32)
            for i, x in enumerate(some):
                linked = right[sums[i].astype(np.int64) * (100 + percent) >= (sizes[x] + sizes[right]) * percent]
                linked = linked[linked != x]
                links[x] += copies[linked].sum()
                if not one_block:
                    links[linked] += copies[x]
                apart, of = np.unique(root[linked], return_index=True)
                of, apart = of[apart != root[x]], apart[apart != root[x]]
                if len(apart):
                    a.append(np.full(len(of), nodes[x])), b.append(nodes[linked[of]])
                    root[np.isin(root, apart)] = root[x]
        with_links = np.flatnonzero(links)
        node, hub = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
        none = pa.nulls(len(with_links), pa.int64())
        spanning = pa.table({"node": pa.array(node), "hub": pa.array(hub), "links": pa.nulls(len(node), pa.int64())})
        return pa.concat_tables([spanning, pa.table({"node": pa.array(nodes[with_links]), "hub": none, "links": pa.array(links[with_links])})])

    return run


def jaccard_components(docs: DataFrame, words: int = 4, percent: int = 85, fragments: int = 4, most_listed: int = MOST_LISTED, block_grams: int = BLOCK_GRAMS, block_classes: int = BLOCK_CLASSES, node_bits: int = NODE_BITS) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links, text_hash, component`` for every row of ``docs(doc_id, text)``.

    A text's set is its distinct shingles of ``words`` words, A-Z in lower case; with fewer words, all of them as
    one. Null, empty and blank texts have empty sets and are linked with nothing. Two rows link when
    100 * intersection >= ``percent`` * union; component_id is the least doc_id that links lead to. Equal
    sets link. Repeated rows are equal sets. Rows with null ids link by equal sets, and to others only through a row with an id and the same set.
    A component of rows without ids has a null component_id, but ``component``, a number of its own, null for empty sets; ``text_hash`` is the text's xxhash64.
    Very long texts are sets as any other. No rows give none. Other columns, whatever their names, are ignored. ``n_links`` is the number of other rows that a row links with, those of equal sets too; for a row
    without an id, and for others' links with it, those of equal sets and of rows with an id and the same set.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", common.text_of().alias("text"))
    run, schema = _first_pass(words, node_bits)
    first = common.written(docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, schema), "sets")
    each, classes, moved = _classes(first.where("chunk is null").select("doc_id", "text_hash", "n", "digest", "node"))
    levels, mass = np.zeros(CELLS, np.uint8), np.zeros(64, np.int64)
    for row in common.added_up(first.where("chunk is not null"), ["chunk"], last=_levels).collect():  # CELLS bytes at most
        levels[row["chunk"] * common.CHUNK : (row["chunk"] + 1) * common.CHUNK] = np.frombuffer(row["cells"], np.uint8, common.CHUNK)
        mass += np.frombuffer(row["cells"], "<i8", offset=common.CHUNK)
    cuts = _pivots(mass, fragments)
    shared = spark.sparkContext.broadcast(levels)

    def node_of(grams: np.ndarray) -> int:
        digest = _digest(grams)
        node = moved.get(digest)
        return _numbered(digest, node_bits) if node is None else node

    def least_size(n: int) -> int:
        return (percent * n + 99) // 100

    def shared_grams(n: int) -> int:
        """Similar sets share at least so many n-grams among the first n - least_size(n) + that many of each."""
        return min(COMMON, least_size(n))

    def prefixes(batches):
        seen: set[int] = set()  # copies within a task are sent once; a bounded memory of them, for copies do no harm
        for batch in batches:
            tokens, nodes, ns, places = [], [], [], []
            for grams in sets(batch["text"], words):
                n = len(grams)
                if 100 * n < percent * (n + 1):
                    continue  # so small a set is similar to no other one
                node = node_of(grams)
                if node in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(node)
                head = _keys(grams, shared.value)[: n - least_size(n) + shared_grams(n)]
                tokens.append(head), nodes.append(np.full(len(head), node)), ns.append(np.full(len(head), n)), places.append(np.arange(len(head)))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(nodes), pa.int64()), pa.array(np.concatenate(ns), pa.int32()), pa.array(np.concatenate(places), pa.int32())], names=["token", "node", "n", "place"])

    heads = docs.mapInArrow(prefixes, "token long, node long, n int, place int")
    # an n-gram of one class alone makes no pair, and a class with too few others' n-grams has none
    lists = common.written(heads.groupBy("token").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("token"), "tokens")
    common.release(spark)
    posts = all_posts = common.written(heads.join(lists, "token").groupBy("token", "node").agg(F.max("n").alias("n"), F.max("place").alias("place")), "posts")
    common.dropped(lists)
    common.release(spark)

    def common_grams(n: str) -> str:
        return f"least({COMMON}, ({percent} * {n} + 99) div 100)"

    smallest = f"(({percent} * n + 99) div 100)"
    enough = posts.groupBy("node").agg(F.max("n").alias("n"), F.count("*").alias("k")).where(f"k >= {common_grams(smallest)}").select("node")
    posts = common.written(posts.join(enough, "node", "left_semi"), "posts")
    common.dropped(all_posts)
    fits = f"100 * least(n, m) >= {percent} * greatest(n, m)"

    def counted(pairs: DataFrame, *more) -> DataFrame:
        """``node, hub, n, m, k`` of pairs whose common n-grams, by number and first and last place, still allow the overlap they need."""
        places = [f(c).alias(a) for f, c, a in ((F.min, "place", "p0"), (F.min, "q", "q0"), (F.max, "place", "p1"), (F.max, "q", "q1"))]
        each = pairs.groupBy("node", "hub").agg(F.max("n").alias("n"), F.max("m").alias("m"), F.count("*").alias("k"), *places, *more)
        bound = "(k + least(n - p1 - 1, m - q1 - 1)) * {0} >= {1} * (n + m) and (1 + least(n - p0 - 1, m - q0 - 1)) * {0} >= {1} * (n + m)".format(100 + percent, percent)
        return each.where(f"k >= least({common_grams('n')}, {common_grams('m')}) and {bound}")

    needed = common.written(posts.select("node").distinct().join(classes.select("node", F.col("low").alias("doc_id")), "node"), "needed")

    def segments(batches):
        def made(nodes, rows, parts, blobs):
            return pa.RecordBatch.from_arrays([nodes.take(pa.array(rows, pa.int64())), pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], names=["node", "fragment", "grams"])

        for batch in batches:
            rows, parts, blobs, held = [], [], [], 0
            for i, (node, grams) in enumerate(zip(batch["node"].to_pylist(), sets(batch["text"], words), strict=True)):
                if len(grams) and node_of(grams) == node:
                    keys = _keys(grams, shared.value)
                    ends = [0, *np.searchsorted(keys, cuts).tolist(), len(keys)]
                    for k in range(fragments):
                        if ends[k] < ends[k + 1]:
                            rows.append(i), parts.append(k), blobs.append(keys[ends[k] : ends[k + 1]].tobytes())
                    held += keys.nbytes
                    if held > HELD_BYTES:
                        yield made(batch["node"], rows, parts, blobs)
                        rows, parts, blobs, held = [], [], [], 0
            yield made(batch["node"], rows, parts, blobs)

    reps = docs.join(needed.hint("merge"), "doc_id").select("node", "text")
    parts = common.written(reps.mapInArrow(segments, "node long, fragment int, grams binary"), "segments")
    common.dropped(needed)
    common.release(spark)

    # all pairs that share an n-gram early enough for the overlap they need
    lengths = posts.groupBy("token").agg(F.count("*").alias("list"))
    listed = common.written(posts.join(lengths, "token"), "lists")
    common.dropped(posts)
    # large lists: clusters of classes that such lists connect, block against block
    large = listed.where(F.col("list") > most_listed)
    lead = large.groupBy("token").agg(F.min("node").alias("lead"))
    clusters = common.connected_components(large.join(lead, "token").select(F.col("node").alias("a"), F.col("lead").alias("b")))
    clusters = common.written(clusters.withColumnRenamed("root", "cluster"), "clusters")
    small = listed.where(F.col("list") <= most_listed)
    other = small.select("token", F.col("node").alias("hub"), F.col("n").alias("m"), F.col("place").alias("q"))
    left = counted(small.join(other, "token").where(f"node < hub and {fits}"))
    # a pair of one cluster is compared there, and nowhere else
    left = left.join(clusters, "node", "left").join(clusters.select(F.col("node").alias("hub"), F.col("cluster").alias("its")), "hub", "left")
    left = common.written(left.where("cluster is null or its is null or cluster <> its").select("node", "hub"), "pairs")
    sized = classes.select("node", "n", "copies")
    members = clusters.join(sized, "node")
    wide = members.groupBy("cluster").agg(F.greatest(F.ceil(F.sum("n") / block_grams), F.ceil(F.count("*") / block_classes)).alias("blocks"))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = members.join(wide, "cluster").withColumn("mine", mine).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select(F.col("cluster").alias("of"), F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"), "node", "copies", (F.col("mine") > F.col("with")).cast("int").alias("side"))
    # a pair's second class is a block of its own, against the first ones, dealt over as many blocks as they need: both kinds take the segments in one join
    minus = F.lit(-1).cast("long")
    first_ones = left.join(sized, "node").select(F.col("hub").alias("of"), "node", "n", "copies")
    shares = first_ones.groupBy("of").agg(F.greatest(F.ceil(F.sum("n") / block_grams), F.ceil(F.count("*") / block_classes)).alias("blocks"))
    of_hubs = shares.join(sized.withColumnRenamed("node", "of"), "of").withColumn("part", F.explode(F.sequence(F.lit(1).cast("long"), "blocks")))
    hubs = of_hubs.select("of", minus.alias("i"), (-F.col("part")).alias("j"), F.col("of").alias("node"), "copies", F.lit(0).alias("side"))
    several = shares.where("blocks > 1").select("of", "blocks")  # few: of all others the one block is known
    ones = first_ones.join(several, "of", "left").select("of", minus.alias("i"), (-1 - F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1).cast("long")))).alias("j"), "node", "copies", F.lit(1).alias("side"))
    paired = hubs.unionAll(ones)
    asked = common.written(dealt.unionAll(paired), "blocks")
    found = asked.hint("merge").join(parts, "node").groupBy("of", "i", "j").applyInArrow(_block_links(percent), "node long, hub long, links long")
    found = common.written(found, "linked")
    common.dropped(asked, parts, left, clusters, listed)
    common.release(spark)
    roots = common.connected_components(found.where("hub is not null").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    links = found.where("hub is null").groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.join(roots, "node", "left").select("node", "low", "copies", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    known = named.join(least, "root").join(links, "node", "left")
    known = common.written(known.select("node", "root", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "components")
    common.dropped(found, classes)
    return each.join(known, "node", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        "text_hash",
        F.col("root").alias("component"),
    )


def op1_ngram_jaccard_join(spark, sf_dir):
    return jaccard_components(common.documents(spark, sf_dir))
