"""Text providers over paragraphs with their neighbours, in Arrow batches: row by row, or item by item with an end at the first failure, and a ledger of answers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from ..config import Settings
from ..functions import plain
from ..functions import text as T
from ..sources import scratch
from ..sources.layout_json import ProviderError, with_retry
from . import providers
from .reconcile import until_first_error

#: Further providers by name: each takes (previous, current, next) and returns a text or raises ProviderError.
PROVIDERS: dict[str, Callable[[str, str, str], str]] = {}


def translated(df: DataFrame, provider: str | None = None, attempts: int = 3, context: bool = True, settings: Settings | None = None, transport: providers.Transport = providers.send, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """``df`` with ``answer`` and ``error``: a failed row has the kind of its error, others keep going.

    Texts come with neighbours (``prev_text``, ``next_text``) where asked. The provider is made once for each task. Errors that may pass are
    tried again after doubling waits; blank texts are not sent.
    """
    known = Settings(**{**vars(settings or Settings()), **({"provider": provider} if provider else {})})
    own = PROVIDERS.get(known.provider)
    if own is None:
        providers.provider(known, transport)  # an unknown name or a missing setting is an error at once

    @F.pandas_udf("answer string, error string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        call = own or providers.provider(known, transport)
        for before, text, after in batches:
            out = []
            for p, c, n in zip(before, text, after, strict=True):
                try:
                    out.append((with_retry(lambda p=p, c=c, n=n: call(p, c, n), attempts, sleep=wait) if c else "", None))
                except ProviderError as error:
                    out.append((None, error.kind))
            yield pd.DataFrame(out, columns=["answer", "error"])

    blank = F.lit("")
    text = F.coalesce("text", blank)
    made = df.withColumn("_r", run(F.col("prev_text") if context else blank, text, F.col("next_text") if context else blank))
    cleaned = T.clean_answer(F.col("_r.answer"))
    error = F.coalesce(F.col("_r.error"), F.when(cleaned.isNull() & (text != ""), "temporary"))
    return made.withColumn("answer", cleaned).withColumn("error", error).drop("_r")


def with_sources(df: DataFrame) -> DataFrame:
    """``comment``: the answer with the snippet of its source, as new annotations carry it; answers that replace a stored text go without."""
    return df.withColumn("comment", T.with_source(F.col("answer"), F.col("text")))


def all_or_nothing(df: DataFrame, item: str) -> DataFrame:
    """Without items of which any row failed."""
    bad = df.where("error is not null").select(item).distinct()
    return df.join(bad, item, "left_anti")


def up_to_error(df: DataFrame, item: str, order: str) -> DataFrame:
    return until_first_error(df, item, order, F.col("error").isNotNull())


#: Kinds of errors after which a task makes no further call: the next one would fail in the same way.
BREAKS = ("quota", "auth")


def translated_in_order(df: DataFrame, item: str, order: str, provider: str | None = None, attempts: int = 3, context: bool = True, settings: Settings | None = None, transport: providers.Transport = providers.send, wait: Callable[[float], None] = time.sleep, breaks: tuple[str, ...] = BREAKS, held: str | None = None) -> DataFrame:
    """``df`` with ``answer``, ``error`` and ``calls``: each item's rows are sent one after the other, and none after the item's first failure.

    A row that isn't reached has neither answer nor error; a failed one has the kind of its error and was tried as often as ``calls`` says. Errors that
    may pass are tried again after doubling waits; an answer without a text counts as one. Blank texts are not sent. Where the column ``held`` has an answer, it is taken without a call.
    After an error of a kind in ``breaks`` the task sends nothing more: rows that would be next in their item get that kind with no call.

    Rows of an item meet in one task, sorted there with what spills to disk, and pass through in batches: what is kept in mind is one item's state, so an
    item of any length will do. Its calls are one after the other by intent; items are spread over all tasks. Rows without an item are one item.
    """
    known = Settings(**{**vars(settings or Settings()), **({"provider": provider} if provider else {})})
    own = PROVIDERS.get(known.provider)
    if own is None:
        providers.provider(known, transport)  # an unknown name or a missing setting is an error at once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = own or providers.provider(known, transport)
        now, stopped, broken, begun, made = None, False, None, False, 0

        def ask(*texts: str) -> str:
            nonlocal made
            made += 1
            answer = plain.clean_answer(call(*texts))
            if not answer:
                raise ProviderError("temporary", "answer without a text")
            return answer

        for batch in batches:
            rows, out = len(batch), []
            column = lambda n: batch[n].to_pylist() if n in batch.schema.names else [None] * rows  # noqa: B023, E731
            texts = column("text")
            before, after = (column(n) if context else [None] * rows for n in ("prev_text", "next_text"))
            for key, *parts, text, kept in zip(column(item), before, after, texts, column(held), strict=True):
                if not begun or key != now:
                    now, stopped, begun = key, False, True
                answer = error = None
                made = 0
                if stopped:
                    pass
                elif not text:
                    answer = ""
                elif kept is not None:
                    answer = kept
                elif broken:
                    error = broken
                else:
                    try:
                        answer = with_retry(lambda p=parts, c=text: ask(p[0] or "", c, p[1] or ""), attempts, sleep=wait)
                    except ProviderError as failure:
                        error = failure.kind
                        broken = error if error in breaks else None
                stopped = stopped or error is not None
                out.append((answer or None, error, made))
            new = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "answer", "error", "calls"])

    schema = ty.StructType([*df.schema.fields, ty.StructField("answer", ty.StringType()), ty.StructField("error", ty.StringType()), ty.StructField("calls", ty.IntegerType())])
    return df.repartition(item).sortWithinPartitions(item, order).mapInArrow(run, schema)


# the ledger: answers under what was asked, so that nothing is paid for twice

LEDGER = "key string, answer string, error string, calls int, run string, row long, provider string, model string, lang string"


def content_key(context: bool) -> Column:
    """What an answer belongs to: the text, and its neighbours where they are sent."""
    parts = ["text", *(["prev_text", "next_text"] if context else [])]
    return F.sha2(F.to_json(F.array(*[F.coalesce(F.col(n), F.lit("")) for n in parts])), 256)


def _named(settings: Settings) -> tuple[str, str, str]:
    name = providers.provider_name(settings.provider)
    return name, {"chatgpt": settings.chat_model, "local_llm": settings.local_model}.get(name) or "-", settings.target_lang or "-"


def ledger(spark: SparkSession, path: str, settings: Settings | None = None) -> DataFrame:
    """The rows of a ledger, of one provider, model and language where settings are given: these are folders, of which only the asked one is read."""
    if not scratch.exists(spark, path):
        return spark.createDataFrame([], LEDGER)
    rows = spark.read.schema(LEDGER).parquet(path)
    if settings is None:
        return rows
    name, model, lang = _named(settings)
    return rows.where((F.col("provider") == name) & (F.col("model") == model) & (F.col("lang") == lang))


def translated_with_ledger(df: DataFrame, item: str, order: str, path: str, settings: Settings, context: bool = True, wave_rows: int = 1_000_000, **how) -> DataFrame:
    """As ``translated_in_order``, but what the ledger at ``path`` has an answer for is not sent, and what comes back is in the ledger before it is returned.

    Items go in waves of about ``wave_rows`` rows, each wave with its own job. Its outcomes are appended to the ledger when it ends, so a run that is killed
    has lost one wave at most, a second run sends only what failed or wasn't reached, and the result is read from the ledger: an executor lost later costs no call.
    A later wave finds the answers of the ones before; equal texts of one wave are each sent. No rows give none.
    """
    spark = df.sparkSession
    name, model, lang = _named(settings)
    asked = scratch.written(df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_key", content_key(context)), "asked")
    waves, run = max(1, -(-asked.count() // wave_rows)), scratch.uuid.uuid4().hex
    for wave in range(waves):
        mine = asked.where(F.pmod(F.xxhash64(item), F.lit(waves)) == wave)
        have = ledger(spark, path, settings).where("answer is not null").groupBy(F.col("key").alias("_key")).agg(F.min("answer").alias("_held"))
        made = translated_in_order(mine.join(have, "_key", "left"), item, order, context=context, settings=settings, held="_held", **how)
        rows = made.select(F.col("_key").alias("key"), "answer", "error", "calls", F.lit(run).alias("run"), F.col("_row").alias("row"), *[F.lit(v).alias(n) for n, v in (("provider", name), ("model", model), ("lang", lang))])
        rows.write.mode("append").partitionBy("provider", "model", "lang").parquet(path)
    mine = ledger(spark, path, settings).where(F.col("run") == run).select(F.col("row").alias("_row"), "answer", "error", "calls")
    return asked.join(mine, "_row").drop("_row", "_key")
