"""Ranked lexical search over postings.

An index is a table of posting blocks: for a term and a run of documents that were read together, the documents of the run that hold the term and how
often. Blocks stand in buckets by their term, a bucket is dealt over several files by runs, and each file is sorted by term. A search
joins the terms of its items to the blocks, scores every match in whole numbers, sums by item and document, and takes each item's best ones by row
number.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Terms are runs of ASCII digits and letters and of anything beyond ASCII; in UTF-8 all bytes of the latter are 0x80 and more. Only A-Z are lowered.
_TERMS = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Texts inverted together, in bytes and in number; a longer text is a run of its own.
RUN_BYTES, RUN_TEXTS = 1 << 24, 1 << 16
BUCKETS = 64
#: Input partitions of documents to one slice of every bucket; monotonically_increasing_id has the partition's number from this bit on.
PARTITIONS_A_SLICE, PARTITION_BIT = 64, 33
#: Rows of an item block's terms: so many travel to every task. More items are searched in more blocks, the same way.
BLOCK_TERMS = 200_000
_POSTING = np.dtype([("doc", "<u2"), ("tf", "<u4")])
_DOCUMENT = np.dtype([("row", "<i8"), ("id", "<i8"), ("no_id", "?"), ("n", "<i8")])


@dataclass
class Index:
    """``blocks(bucket, term, run, held, postings)``, ``runs(run, documents)``, the number of documents with a term, and of all terms with repeats."""

    blocks: DataFrame
    runs: DataFrame
    documents: int
    terms: int


def terms_of(text: str | None) -> list[bytes]:
    return _TERMS.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def _inverted(texts: list[bytes], rows: np.ndarray, ids: pa.Array) -> pa.RecordBatch:
    """The posting blocks of one run, and a row without a term that has the run's documents."""
    found, counts, lengths, docs = [], [], [], np.zeros(len(texts), _DOCUMENT)
    docs["row"], docs["id"], docs["no_id"] = rows, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
    for i, text in enumerate(texts):
        tf = Counter(_TERMS.findall(text.lower()))
        found.extend(tf)
        counts.extend(tf.values())
        lengths.append(len(tf))
        docs["n"][i] = sum(tf.values())
    coded = pa.array(found, pa.binary()).dictionary_encode()
    codes = coded.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    postings = np.zeros(len(order), _POSTING)
    postings["doc"], postings["tf"] = np.repeat(np.arange(len(texts)), lengths)[order], np.array(counts, np.int64)[order]
    held = np.bincount(codes, minlength=len(coded.dictionary))
    offsets = np.concatenate([[0], np.cumsum(held)]) * _POSTING.itemsize
    blocks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(held), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(postings.tobytes())])
    term = pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.nulls(1, pa.string())])
    payload = pa.concat_arrays([blocks.cast(pa.binary()), pa.array([docs.tobytes()], pa.binary())])
    held = np.append(held, (docs["n"] > 0).sum())
    return pa.RecordBatch.from_arrays([term, pa.array(np.full(len(held), rows[0])), pa.array(held, pa.int64()), payload], names=["term", "run", "held", "postings"])


def _postings(batches):
    for batch in batches:
        texts = batch["text"].cast(pa.large_binary())
        upto = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy())])
        rows, ids, at = batch["row"].to_numpy(), batch["doc_id"].cast(pa.int64()), 0
        while at < len(texts):
            end = min(at + RUN_TEXTS, max(at + 1, int(np.searchsorted(upto, upto[at] + RUN_BYTES, "right")) - 1))
            yield _inverted(texts.slice(at, end - at).to_pylist(), rows[at:end], ids.slice(at, end - at))
            at = end


def _all_terms(batches):
    for batch in batches:
        sums = [int(np.frombuffer(d.as_buffer(), _DOCUMENT)["n"].sum()) for d in batch["postings"]]
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int64())], names=["n"])


def index(docs: DataFrame, buckets: int = BUCKETS) -> Index:
    """The postings of all of ``docs(doc_id, text)``, written to the shared folder.

    Every row is a document, also one that repeats another's id; null ids are kept. Null and empty texts, and those without a term, are in no block and
    count as no document. Very long texts are runs of their own. No rows give an empty index. Other columns, whatever their names, are ignored.
    A frequent term has one block for each run, so that no row grows with the corpus; the slices of a bucket grow with the number of input partitions.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    made = rows.mapInArrow(_postings, "term string, run long, held long, postings binary")
    bucket = F.when(F.col("term").isNull(), -1).otherwise(F.pmod(F.xxhash64("term"), F.lit(buckets))).cast("int")
    slice_ = F.floor(F.shiftright("run", PARTITION_BIT) / PARTITIONS_A_SLICE)
    dealt = made.repartition(bucket, slice_).withColumn("bucket", bucket).sortWithinPartitions("bucket", "term")
    path = f"{common.shared_dir(spark).rstrip('/')}/foliospark-postings-{common.uuid.uuid4().hex}"
    dealt.write.partitionBy("bucket").parquet(path)
    common.release(spark)
    blocks, runs = (spark.read.schema(dealt.schema).parquet(path).where(which) for which in ("bucket >= 0", "bucket = -1"))
    blocks.scratch_path = path
    words = runs.select("postings").mapInArrow(_all_terms, "n long").agg(F.sum("n")).first()[0]
    return Index(blocks, runs.select("run", F.col("postings").alias("documents")), runs.agg(F.sum("held")).first()[0] or 0, words or 0)


def _item_terms(items: DataFrame, buckets: int) -> DataFrame:
    """``item, item_id, term, asked, bucket``: the terms of each item, with how often it has them."""

    def run(batches):
        for batch in batches:
            found = [Counter(terms_of(t)) for t in batch["text"].to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]), pa.int64())
            terms = pa.array([t for f in found for t in f], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch["item"].take(at), batch["item_id"].take(at), terms, pa.array([n for f in found for n in f.values()], pa.int64())], names=["item", "item_id", "term", "asked"])

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), common.text_of().alias("text"))
    made = rows.mapInArrow(run, "item long, item_id long, term string, asked long")
    return made.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))


def search(of: Index, items: DataFrame, k: int = 20, buckets: int = BUCKETS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each of ``items(item_id, text)``, those with a score above 0 only.

    Equal scores go by ascending doc_id, nulls last, rows that repeat an id among themselves by their place. Items without a term have no rows;
    rows that repeat an item_id are items of their own. Scores are whole numbers; a term's weight comes of its number of documents.
    Items are taken in blocks of about ``block_terms`` terms: a block's terms, and only they, go to every task. All documents that hold a term are scored.
    """
    asked = common.written(_item_terms(items, buckets), "items")
    blocks = max(1, -(-asked.count() // block_terms))
    found = None
    for b in range(blocks):
        mine = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        best = _searched(of, mine, k)
        if blocks > 1:
            best = common.written(best, "best")
        found = best if found is None else found.unionAll(best)
    return found


def _scored(n_docs: int, n_terms: int):
    """The postings of the blocks of one run, each with its document's id and what the term adds to a score; a run's documents meet all its blocks here."""

    def run(blocks: pa.Table, runs: pa.Table) -> pa.Table:
        docs = np.frombuffer(runs["documents"][0].as_buffer(), _DOCUMENT)
        raw = [x.as_buffer() for x in blocks["postings"]]
        postings = np.frombuffer(b"".join(raw), _POSTING)
        sizes = np.array([len(x) for x in raw], np.int64) // _POSTING.itemsize
        mine, tf = docs[postings["doc"]], postings["tf"].astype(np.int64)
        m = 75 + 25 * mine["n"] * n_docs // max(1, n_terms)
        part = np.repeat(blocks["w"].to_numpy(), sizes) * (1_000_000_000 * tf // (1000 * tf + 12 * m))
        ids = pa.array(mine["id"], mask=mine["no_id"])
        made = pa.table({"row": pa.array(mine["row"]), "doc_id": ids, "t": pa.array(np.repeat(blocks["t"].to_numpy(), sizes)), "part": pa.array(part)})
        return made.filter(pa.array(part > 0))

    return run


def _searched(of: Index, asked: DataFrame, k: int) -> DataFrame:
    terms = common.written(asked.select("bucket", "term").distinct().coalesce(1).withColumn("t", F.monotonically_increasing_id()), "terms")  # at most a block's terms
    held = of.blocks.select("bucket", "term", "held").join(F.broadcast(terms), ["bucket", "term"]).groupBy("bucket", "term", "t").agg(F.sum("held").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * of.documents + 2) / (2.0 * F.col("df") + 1))).cast("long")
    known = common.written(held.select("bucket", "term", "t", weight.alias("w")).coalesce(1), "weights")
    matched = of.blocks.select("bucket", "term", "run", "postings").join(F.broadcast(known), ["bucket", "term"]).select("run", "t", "w", "postings")
    parts = matched.groupBy("run").cogroup(of.runs.groupBy("run")).applyInArrow(_scored(of.documents, of.terms), "row long, doc_id long, t long, part long")
    wanted = asked.join(F.broadcast(known), ["bucket", "term"]).select("item", "item_id", "t", "asked")
    # a document's matches meet before its items do: a frequent term goes over once, not once for each item that asks for it
    scored = parts.repartition("row").join(F.broadcast(wanted), "t").groupBy("row", "doc_id", "item", "item_id").agg(F.sum(F.col("asked") * F.col("part")).alias("score"))
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark, sf_dir):
    return search(index(common.documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, ts, CAST(len(ts) AS BIGINT) AS n FROM d WHERE len(ts) > 0),
s AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS words FROM h),
tf AS (SELECT doc_id, n, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, n, unnest(ts) AS t FROM h) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), s),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
x AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words)))) AS BIGINT) AS score FROM q JOIN w USING (t) JOIN tf USING (t), s GROUP BY 1, 2)
SELECT item_id, rank, doc_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM x WHERE score > 0) WHERE rank <= 20"""
