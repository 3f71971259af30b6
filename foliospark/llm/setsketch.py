"""Near copies by SetSketch registers.

A register of a set is the least of its elements' random values, on a scale of powers of a base and cut off at both ends; the registers of a union are the
larger ones of both sets'. The more two sets have in common the more registers are equal, so sets that agree in all registers of a
band become candidates. How far a pair's registers go up and down against each other gives, with both sizes, the likelihood of each similarity; pairs for which
the asked one is out of the question go. What is left is confirmed on the full sets, in blocks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .shingles import sets

#: Registers are bytes: with this base and rate they hold sets of one to some billions of elements.
BASE, RATE, TOP = 1.1, 20.0, 255
#: Two sets of similarity 0.8 miss each other in all bands about 2 times in a million, those of 0.85 5 times in a thousand million.
BANDS, ROWS = 40, 6
REGISTERS = BANDS * ROWS
#: A pair goes when its likeliest similarity is so much likelier than the asked one, in logarithms: five standard errors.
SURE = 12.5
#: Classes of one band up to which their pairs are made; longer lists are compared in blocks of so many classes.
MOST_LISTED, BLOCK_SKETCHES = 64, 1000
#: N-grams and classes of a block in which links are confirmed.
BLOCK_GRAMS, BLOCK_CLASSES = 200_000, 4000
_random = np.random.default_rng(13)
_FLIP = _random.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2)
_TIMES = _random.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketches(found: list[np.ndarray]) -> np.ndarray:
    """A row of registers for each set of hashes; an empty set has all 0."""
    out = np.zeros((len(found), REGISTERS), np.uint8)
    full = np.array([i for i, x in enumerate(found) if len(x)], np.int64)
    if not len(full):
        return out
    every = np.concatenate([found[i] for i in full])
    starts = np.concatenate([[0], np.cumsum([len(found[i]) for i in full])[:-1]])
    least = np.empty((REGISTERS, len(full)))
    for k in range(REGISTERS):
        least[k] = np.minimum.reduceat((every ^ _FLIP[k]) * _TIMES[k], starts)
    value = -np.log1p(-(least + 0.5) / 2.0**64) / RATE
    out[full] = np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, TOP).astype(np.uint8).T
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(a, b)


def _passes(same: np.ndarray, above: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs of sets with ``n`` and ``m`` elements may have the asked similarity: ``same`` registers are equal and in ``above`` the first set's is higher."""
    below = REGISTERS - same - above
    u = n / (n + m)
    v = 1 - u

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = (-np.log1p(-np.maximum(x, 1e-12) * (BASE - 1) / BASE) / np.log(BASE) for x in (u - v * j, v - u * j))
        return above * np.log(up) + below * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))

    asked = np.full(len(u), percent / 100)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    within = asked <= high + 1e-9
    golden = (np.sqrt(5) - 1) / 2
    for _ in range(30):  # one peak
        a, b = high - golden * (high - low), low + golden * (high - low)
        left = likelihood(a) > likelihood(b)
        low, high = np.where(left, low, a), np.where(left, b, high)
    best = (low + high) / 2
    return within & ((best >= asked) | (likelihood(best) - likelihood(np.minimum(asked, np.minimum(u / v, v / u))) <= SURE))


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in column), np.uint8).reshape(-1, REGISTERS)


def _first_pass(size: int):
    names = ["doc_id", "text_hash", "n", "digest", "sketch"]

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                ids, hashes, at, part, held = batch["doc_id"].cast(pa.int64()), batch["text_hash"], 0, [], 0

                def row_batch(part, at):
                    digests = pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in part], pa.binary())
                    rows = pa.array([x.tobytes() for x in sketches(part)], pa.binary())
                    return pa.RecordBatch.from_arrays([ids.slice(at, len(part)), hashes.slice(at, len(part)), pa.array([len(x) for x in part], pa.int64()), digests, rows], names=names)

                for grams in sets(batch["text"], size):
                    part.append(grams)
                    held += len(grams)
                    if held > 1 << 17:
                        yield row_batch(part, at)
                        at, part, held = at + len(part), [], 0
                if part:
                    yield row_batch(part, at)

    return run, "doc_id long, text_hash long, n long, digest binary, sketch binary"


def _bands(batches):
    """A row for each band of each class, under a hash of its registers and the band's number."""
    for batch in batches:
        values = _registers(batch["sketch"])
        with np.errstate(over="ignore"):
            packed = np.zeros((len(values), BANDS, 8), np.uint8)
            packed[:, :, :ROWS] = values.reshape(-1, BANDS, ROWS)
            packed[:, :, ROWS] = np.arange(BANDS)
        keys = packed.view("<i8").reshape(-1)  # six registers and the band: no hash, no collisions
        at = pa.array(np.repeat(np.arange(len(values)), BANDS))
        yield pa.RecordBatch.from_arrays([pa.array(keys), batch["node"].take(at), batch["n"].take(at)], names=["band", "node", "n"])


def _likely_pairs(percent: int):
    def run(batches):
        for batch in batches:
            a, b = _registers(batch["sketch"]), _registers(batch["other_sketch"])
            ok = _passes((a == b).sum(1), (a > b).sum(1), batch["n"].to_numpy(), batch["m"].to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([batch["node"], batch["hub"]], names=["node", "hub"]).filter(pa.array(ok))

    return run


def _joined(label: np.ndarray, x: int, others: np.ndarray) -> np.ndarray:
    """Those of ``others`` that bring a component of their own to that of x, one for each; all become one."""
    own, first = np.unique(label[others], return_index=True)
    first, own = first[own != label[x]], own[own != label[x]]
    if len(own):
        label[np.isin(label, own)] = label[x]
    return others[first]


def _likely_in_block(percent: int):
    """Of the classes of two blocks of a long list, or of one: pairs that may link, so many as span all that do.

    Pairs that agree in as many registers as the asked similarity makes us expect are taken at once, those that agree in under a half are out of the question, and
    what lies between waits for its likelihood; nobody looks at pairs that are joined already.
    """
    expected = REGISTERS * np.log1p(percent / 100 * (BASE - 1)) / np.log(BASE)

    def run(table: pa.Table) -> pa.Table:
        values, n, nodes = _registers(table["sketch"]), table["n"].to_numpy(), table["node"]
        side = table["side"].to_numpy()
        one = table["i"][0] == table["j"][0]
        left = np.flatnonzero(side == 0)
        right = left if one else np.flatnonzero(side == 1)
        label = np.unique(np.array([c.as_buffer().to_pybytes() for c in table["part"]], object), return_inverse=True)[1]
        at, of, open_x, open_y, open_same = [], [], [], [], []
        for x in left.tolist():
            others = right[label[right] != label[x]]
            others = others[others > x] if one else others
            if not len(others):
                continue
            same = np.count_nonzero(values[others] == values[x], axis=1)
            wait = (same < expected) & (same * 2 >= REGISTERS)
            open_x.append(np.full(int(wait.sum()), x)), open_y.append(others[wait]), open_same.append(same[wait])
            joined = _joined(label, x, others[same >= expected])
            at.append(np.full(len(joined), x)), of.append(joined)
        if open_x:
            x, y, same = (np.concatenate(v) for v in (open_x, open_y, open_same))
            for start in range(0, len(x), 1 << 18):
                a, b, s = x[start : start + (1 << 18)], y[start : start + (1 << 18)], same[start : start + (1 << 18)]
                apart = label[a] != label[b]
                a, b, s = a[apart], b[apart], s[apart]
                ok = _passes(s, np.count_nonzero(values[a] > values[b], axis=1), n[a], n[b], percent)
                for u, v in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
                    if label[u] != label[v]:
                        label[label == label[v]] = label[u]
                        at.append(np.array([u])), of.append(np.array([v]))
        left_ones, right_ones = (np.concatenate([np.zeros(0, np.int64), *v]) for v in (at, of))
        return pa.table({"node": nodes.take(pa.array(left_ones)), "hub": nodes.take(pa.array(right_ones))})

    return run


def _links_in_block(percent: int):
    """Of the classes of two blocks of a cluster, or of one, with their full sets: links that span all that link."""

    def run(table: pa.Table) -> pa.Table:
        nodes, side = table["node"], table["side"].to_numpy()
        grams = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["grams"]]
        sizes = np.array([len(x) for x in grams])
        one = table["i"][0] == table["j"][0]
        left = np.flatnonzero(side == 0)
        right = left if one else np.flatnonzero(side == 1)
        keys = np.concatenate([np.zeros(0, np.uint64), *[grams[i] for i in right]])
        owner = np.repeat(np.arange(len(right)), sizes[right])
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        label, a, b = np.arange(len(nodes)), [], []
        for x in left.tolist():
            if (label[right] == label[x]).all():
                continue
            low, high = np.searchsorted(keys, grams[x], "left"), np.searchsorted(keys, grams[x], "right")
            k = high - low
            found = np.repeat(low - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())
            both = np.bincount(owner[found], minlength=len(right))
            ok = right[both * (100 + percent) >= (sizes[x] + sizes[right]) * percent]
            joined = _joined(label, x, ok)
            a.append(np.full(len(joined), x)), b.append(joined)
        at, of = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
        return pa.table({"node": nodes.take(pa.array(at)), "hub": nodes.take(pa.array(of))})

    return run


def _dealt(members: DataFrame, group: str, blocks, *more: str) -> DataFrame:
    """``members(group, node, ...)`` once for every pair of the group's blocks that they are in: ``i, j``, and ``side`` 1 for the second block's."""
    mine = F.pmod(F.xxhash64("node"), F.col("blocks"))
    rows = members.withColumn("blocks", blocks).withColumn("mine", mine).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.select(group, F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"), "node", *more, (F.col("mine") > F.col("with")).cast("int").alias("side"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, most_listed: int = MOST_LISTED, block_sketches: int = BLOCK_SKETCHES, block_grams: int = BLOCK_GRAMS, block_classes: int = BLOCK_CLASSES) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``.

    A text's set is its distinct shingles of ``words`` words, A-Z in lower case; with fewer words, all of them as one. Null, empty and blank texts have empty sets, are
    linked with nothing and kept. Rows link when 100 * intersection >= ``percent`` * union; component_id is the least doc_id that links lead to, and its row is kept.
    A link is always right, for it is counted on the full sets; one may be missed when no band shows it, see BANDS, or by likelihood, see SURE; ``percent`` should be 80 or more.

    Texts with equal sets are one class and compared once. Rows with null ids take part; a component of such rows alone has a null component_id and all of them are kept.
    Repeated rows are equal sets. Very long texts are sets as any other. No rows give none. Other columns, whatever their names, are ignored.
    """
    run, schema = _first_pass(words)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    first = common.written(rows.mapInArrow(run, schema), "sketches")
    # one row stands for a class: that with the least id, of these that with the least hash
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), "text_hash")
    classes = first.where("n > 0").groupBy(F.col("digest").alias("node")).agg(F.min(row).alias("row"), F.max("n").alias("n"), F.min("sketch").alias("sketch"))
    classes = common.written(classes, "classes")
    common.release(docs.sparkSession)
    posts = classes.select("sketch", "node", "n").mapInArrow(_bands, "band long, node binary, n long")
    lists = posts.groupBy("band").agg(F.count("*").alias("list")).where("list > 1")
    posts = common.written(posts.join(lists, "band"), "bands")
    its = classes.select("node", "n", "sketch")

    def likely_of(pairs: DataFrame) -> DataFrame:
        theirs = its.select(F.col("node").alias("hub"), F.col("n").alias("m"), F.col("sketch").alias("other_sketch"))
        both = pairs.join(its.hint("merge"), "node").join(theirs.hint("merge"), "hub").where(f"100 * least(n, m) >= {percent} * greatest(n, m)")
        return both.select("node", "hub", "n", "m", "sketch", "other_sketch").mapInArrow(_likely_pairs(percent), "node binary, hub binary")

    # all of a list with its first one; for what follows, those that it joins count as one part, so that a large group makes no pairs
    lead = posts.groupBy("band").agg(F.min("node").alias("hub"))
    stars = common.written(likely_of(posts.join(lead, "band").where("node <> hub").select("node", "hub").distinct()), "stars")
    common.release(docs.sparkSession)
    parts = common.connected_components(stars.select(F.col("node").alias("a"), F.col("hub").alias("b"))).withColumnRenamed("root", "part")
    parted = posts.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    several = parted.groupBy("band").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("band")
    parted = common.written(parted.join(several, "band"), "parts")
    common.dropped(posts)
    small = parted.where(F.col("list") <= most_listed)
    other = small.select("band", F.col("node").alias("hub"), F.col("n").alias("m"), F.col("part").alias("its_part"))
    pairs = small.join(other, "band").where(f"node < hub and part <> its_part and 100 * least(n, m) >= {percent} * greatest(n, m)").select("node", "hub").distinct()
    dealt = _dealt(parted.where(F.col("list") > most_listed), "band", F.ceil(F.col("list") / block_sketches), "part")
    blocks = dealt.join(its.hint("merge"), "node").groupBy("band", "i", "j").applyInArrow(_likely_in_block(percent), "node binary, hub binary")
    likely = common.written(likely_of(pairs).unionAll(blocks).unionAll(stars), "likely")
    common.dropped(parted, stars)
    common.release(docs.sparkSession)
    clusters = common.connected_components(likely.select(F.col("node").alias("a"), F.col("hub").alias("b"))).withColumnRenamed("root", "cluster")
    members = common.written(clusters.join(classes.select("node", "n", "row"), "node"), "clusters")
    needed = members.select("node", "row.*")

    def full_sets(batches):
        for batch in batches:
            found = list(sets(batch["text"], words))
            keep = [i for i, (node, x) in enumerate(zip(batch["node"].to_pylist(), found, strict=True)) if hashlib.blake2b(x.tobytes(), digest_size=16).digest() == node]
            yield pa.RecordBatch.from_arrays([batch["node"].take(pa.array(keep, pa.int64())), pa.array([found[i].tobytes() for i in keep], pa.binary())], names=["node", "grams"])

    keyed = rows.select(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), "text_hash", "text")
    reps = keyed.join(needed.hint("merge"), ["no_id", "id", "text_hash"]).select("node", "text").mapInArrow(full_sets, "node binary, grams binary")
    reps = common.written(reps.dropDuplicates(["node"]), "sets")
    common.release(docs.sparkSession)
    wide = members.groupBy("cluster").agg(F.greatest(F.ceil(F.sum("n") / block_grams), F.ceil(F.count("*") / block_classes)).alias("blocks"))
    asked = _dealt(members.join(wide, "cluster"), "cluster", F.col("blocks"))
    links = asked.hint("merge").join(reps, "node").groupBy("cluster", "i", "j").applyInArrow(_links_in_block(percent), "node binary, hub binary")
    links = common.written(links, "links")
    common.dropped(likely, members, reps)
    common.release(docs.sparkSession)
    roots = common.connected_components(links.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    named = classes.join(roots, "node", "left").select("node", "row", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("row").alias("least"))
    known = named.join(least, "root").select(F.col("node").alias("digest"), F.when(~F.col("least.no_id"), F.col("least.id")).alias("lowest"))
    known = common.written(known, "components")
    common.dropped(links, classes)
    found = first.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(known, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("lowest")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op13_near_duplicates(spark, sf_dir):
    return near_duplicates(common.documents(spark, sf_dir), words=4)
