"""A remote library as a source and a sink of Spark: pages that are read in parallel, and batches that are written once.

A transport is a function of ``(method, path, params, headers, body)`` that gives ``(status, headers, body)``. It travels to the tasks by pickling.
"""

from __future__ import annotations

import base64
import hashlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from ..operators.reconcile import batches
from .layout_json import ProviderError, with_retry

Transport = Callable[[str, str, dict, dict, bytes], tuple[int, dict, bytes]]

ITEMS = "key string, version long, parent string, item_type string, title string, tags array<string>, data string, tag string"
#: Rows of one request, and requests of one partition.
PAGE, PAGES = 100, 10
#: Of a longer list a partition takes more requests, so that there are no more partitions than that.
PARTITIONS = 2000
# Fixed value: the header in which the service tells how many rows there are.
TOTAL = "Total-Results"
BATCH = "_batch"


def pickled(transport: Transport) -> str:
    return base64.b64encode(cloudpickle.dumps(transport)).decode()


def _unpickled(text: str) -> Transport:
    return cloudpickle.loads(base64.b64decode(text))


def _asked(transport: Transport, method: str, path: str, params: dict, headers: dict | None = None, body: bytes = b"", wait=time.sleep) -> tuple[int, dict, bytes]:
    """One request, tried again while the service is busy or can't be reached."""

    def once():
        try:
            status, found, answer = transport(method, path, params, headers or {}, body)
        except OSError as error:
            raise ProviderError("temporary", f"{type(error).__name__}: {error}") from error
        if status == 429 or status >= 500:
            raise ProviderError("rate_limit" if status == 429 else "temporary", f"status {status} for {path}")
        return status, found, answer

    return with_retry(once, sleep=wait)


# reading


@dataclass
class Pages(InputPartition):
    """Rows ``start`` to ``stop`` of what a path lists; without ``stop``, all that follow."""

    path: str
    params: dict
    start: int = 0
    stop: int | None = None


@dataclass
class _Asked:
    tags: list = field(default_factory=lambda: [None])
    parents: list = field(default_factory=lambda: [None])
    kinds: set | None = None


class ItemsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.transport = _unpickled(options["transport"])
        self.prefix, self.page, self.pages = options.get("prefix", ""), int(options.get("page_rows", PAGE)), int(options.get("partition_pages", PAGES))
        self.asked = _Asked()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """A tag and a parent go to the service, a kind of item is tested row by row here; all else is left to Spark."""
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            name = f.attribute[0] if values is not None and len(f.attribute) == 1 else None
            if name == "tag" and self.asked.tags == [None]:
                self.asked.tags = sorted(set(values))
            elif name == "parent" and self.asked.parents == [None]:
                self.asked.parents = sorted(set(values))
            elif name == "item_type" and self.asked.kinds is None:
                self.asked.kinds = set(values)
            else:
                yield f

    def partitions(self) -> list[Pages]:
        made = []
        for parent in self.asked.parents:
            path = f"{self.prefix}/items" if parent is None else f"{self.prefix}/items/{parent}/children"
            for tag in self.asked.tags:
                params = {} if tag is None else {"tag": tag}
                status, headers, _ = _asked(self.transport, "GET", path, params | {"start": 0, "limit": 1})
                if status == 404:
                    continue
                total = headers.get(TOTAL)
                if total is None:  # who doesn't say how many there are is walked through to the end
                    made.append(Pages(path, params))
                else:
                    step = self.page * max(self.pages, -(-int(total) // (self.page * PARTITIONS)))
                    made += [Pages(path, params, at, min(at + step, int(total))) for at in range(0, int(total), step)]
        return made or [Pages("", {}, 0, 0)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        at, wanted = partition.start, partition.params.get("tag")
        while partition.stop is None or at < partition.stop:
            limit = self.page if partition.stop is None else min(self.page, partition.stop - at)
            _, _, body = _asked(self.transport, "GET", partition.path, partition.params | {"start": at, "limit": limit})
            rows = json.loads(body)
            if not rows:
                return
            at += len(rows)  # by what came, before anything is tested here
            for row in rows:
                data = row.get("data") or {}
                if self.asked.kinds is not None and data.get("itemType") not in self.asked.kinds:
                    continue
                tags = [t["tag"] for t in data.get("tags") or [] if isinstance(t, dict) and (t.get("tag") or "").strip()]
                for tag in dict.fromkeys(tags) if tags else [None]:
                    if wanted is None or tag == wanted:
                        yield row.get("key"), row.get("version"), data.get("parentItem"), data.get("itemType"), data.get("title"), tags, json.dumps(data, ensure_ascii=False), tag


class Items(DataSource):
    """Items of a library, a row for each item and tag (one without tag for items without), read by ranges of pages.

    ``tag = ...`` and ``parent = ...`` are asked of the service; without them all items are listed.
    """

    @classmethod
    def name(cls) -> str:
        return "library_items"

    def schema(self) -> str:
        return ITEMS

    def reader(self, schema) -> ItemsReader:
        return ItemsReader(self.options)

    def writer(self, schema, overwrite: bool) -> CreateWriter:
        return CreateWriter(self.options, schema.fieldNames())


def read_items(spark: SparkSession, transport: Transport, prefix: str = "", page_rows: int = PAGE, partition_pages: int = PAGES) -> DataFrame:
    """The items of a library. Filters on ``tag`` and ``parent`` reach the service, which needs a setting of Spark's that is made here."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Items)
    return spark.read.format("library_items").options(transport=pickled(transport), prefix=prefix, page_rows=str(page_rows), partition_pages=str(partition_pages)).load()


# writing


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: totals, and the first few reasons of failures."""

    batches: int
    planned: int
    created: int
    failed: int
    samples: list


class CreateWriter(DataSourceWriter):
    """Creates rows in batches of one item; a batch has a key made of the run, the item and its place, by which the service knows it when it comes again."""

    def __init__(self, options: dict, names: list[str]):
        self.transport, self.names = _unpickled(options["transport"]), names
        self.run, self.path, self.item, self.wait = options["run"], options["path"], options["item"], _unpickled(options["wait"])

    def _sent(self, key: str, rows: list[dict]) -> tuple[int, dict]:
        """The number of rows created, and what is said of those that aren't, by their place."""
        status, _, body = _asked(self.transport, "POST", self.path, {}, {"Write-Token": key}, json.dumps(rows, ensure_ascii=False, default=str).encode(), self.wait)
        if status >= 400:
            return 0, {i: f"status {status}" for i in range(len(rows))}
        answer = json.loads(body)
        if isinstance(answer, list):
            return len(answer), {}
        good, bad = (answer.get(n) or {} for n in ("successful", "failed"))
        if not good and not bad:
            return len(rows), {}
        return len(good), {int(i): str(why) for i, why in bad.items() if str(i).isdigit()}

    def _batches(self, rows) -> Iterator[tuple[str, list[dict]]]:
        """Rows that stand together with one item and batch, which the rows lose."""
        named = (dict(zip(self.names, row, strict=True)) for row in rows)
        for (item, number), part in groupby(named, lambda r: (r[self.item], r[BATCH])):
            yield f"{item}-{number}", [{n: v for n, v in r.items() if n != BATCH} for r in part]

    def write(self, rows) -> Written:
        done = Written(0, 0, 0, 0, [])
        for name, batch in self._batches(rows):
            key = hashlib.sha1(f"{self.run}-{name}".encode()).hexdigest()
            created, bad = self._sent(key, batch)
            for i in sorted(bad):  # once more, alone
                again, why = self._sent(f"{key}-{i}", [batch[i]])
                created += again
                done.samples += [f"{name}: {w}" for w in why.values()][: 3 - len(done.samples)]
            done.batches, done.planned, done.created, done.failed = done.batches + 1, done.planned + len(batch), done.created + created, done.failed + len(batch) - created
        return done

    def commit(self, messages: list[Written | None]) -> None:
        known = [m for m in messages if m is not None]
        figures = {n: sum(getattr(m, n) for m in known) for n in ("batches", "planned", "created", "failed")}
        body = json.dumps(figures | {"samples": [s for m in known for s in m.samples][:3]}).encode()
        _asked(self.transport, "PUT", f"/runs/{self.run}", {}, {}, body)

    def abort(self, messages: list[Written | None]) -> None:
        """What was written stays under its keys, so that the same run, started again, goes on from there."""
        _asked(self.transport, "PUT", f"/runs/{self.run}", {}, {}, json.dumps({"aborted": True}).encode())


def create_items(rows: DataFrame, item: str, order: list[str], transport: Transport, run: str, path: str = "/items", batch_rows: int = 10, wait: Callable[[float], None] = time.sleep) -> dict:
    """Creates ``rows`` in batches of ``batch_rows`` within each item and gives the run's figures: batches, planned, created, failed and samples of failures.

    A task that is tried again, a second attempt beside a slow one, or the whole job under the same ``run`` sends each batch under the same key; the service, which keeps
    the first answer of a key, creates nothing twice. For that the rows of an item have to be in one order: ``order`` should tell them apart. The figures are those
    that the tasks commit with; a job that fails leaves none. Batches are numbered first and then dealt out, so that an item with many rows is no task of its own.
    """
    rows.sparkSession.dataSource.register(Items)
    # a number of partitions, for by their few bytes Spark would put all batches in one
    dealt = batches(rows, item, order, batch_rows).withColumnRenamed("batch", BATCH).repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, item, BATCH).sortWithinPartitions(item, BATCH, *order)
    dealt.write.format("library_items").options(transport=pickled(transport), run=run, path=path, item=item, wait=pickled(wait)).mode("append").save()
    return json.loads(_asked(transport, "GET", f"/runs/{run}", {})[2])
