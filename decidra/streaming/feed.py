"""A paged review feed as a stream: a source with an offset and a read limit, collection that publishes a product's reviews
all at once or not at all, and sinks that a repeated batch does not change.

A feed is a folder with a folder `page=<n>` for each page number from 0, of JSON files with one page of one product in a line."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from decidra.operators.reviews import first_messages

PAGE = "product string, page int, status int, last boolean, contents array<struct<id:string,content:string>>"
COLLECTED = "product string, pos int, content string"
STATE = "ended boolean, keys array<string>, contents array<string>"


class _File(InputPartition):
    def __init__(self, page: int, path: str):
        self.page, self.path = page, path


class _FeedReader(DataSourceStreamReader):
    """Offset: the number of pages of each product that have been read.

    What latestOffset() has answered last is kept in the file `progress`, so a reader that is started again never answers less
    than before. If that answer was taken up, the next one may be higher."""

    def __init__(self, options: dict):
        self.fs, self.folder = arrow_fs.FileSystem.from_uri(options["path"]) if "://" in options["path"] else (arrow_fs.LocalFileSystem(), options["path"].removeprefix("file:"))
        self.limit, self.progress = max(1, int(options.get("pagespertrigger", 1))), f"{self.folder}/_progress-{options.get('reader', 'main')}"
        self.taken, self.said = 0, None

    def initialOffset(self) -> dict:
        return {"pages": 0}

    def _there(self) -> int:
        """How many pages, from 0 on without a gap, are in the feed."""
        found = {f.base_name for f in self.fs.get_file_info(arrow_fs.FileSelector(self.folder)) if f.type == arrow_fs.FileType.Directory}
        n = 0
        while f"page={n}" in found:
            n += 1
        return n

    def latestOffset(self) -> dict:
        if self.said is None:
            at = self.fs.get_file_info(self.progress)
            if at.type == arrow_fs.FileType.File:
                with self.fs.open_input_stream(self.progress) as f:
                    self.said = self.taken = int(f.read() or 0)
                return {"pages": self.said}
            self.said = 0
        most = min(self._there(), self.taken + self.limit)
        if most > self.said:
            with self.fs.open_output_stream(self.progress) as f:
                f.write(str(most).encode())
            self.said = most
        return {"pages": self.said}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.taken = max(self.taken, end["pages"])
        out = []
        for page in range(start["pages"], end["pages"]):
            for f in self.fs.get_file_info(arrow_fs.FileSelector(f"{self.folder}/page={page}")):
                if f.type == arrow_fs.FileType.File and f.size and not f.base_name.startswith(("_", ".")):
                    out.append(_File(page, f.path))
        return out

    def read(self, partition: _File) -> Iterator[tuple]:
        with self.fs.open_input_stream(partition.path) as f:
            for line in iter_lines(f):
                body = json.loads(line)
                rows = body.get("contents")
                rows = [(r.get("id"), r.get("content")) for r in rows] if isinstance(rows, list) else None
                yield str(body["product"]), partition.page, body.get("status"), body.get("last"), rows

    def commit(self, end: dict) -> None:
        """Nothing to free: pages stay where they are."""


def iter_lines(stream, size: int = 1 << 20) -> Iterator[bytes]:
    rest = b""
    while chunk := stream.read(size):
        *lines, rest = (rest + chunk).split(b"\n")
        yield from (x for x in lines if x.strip())
    if rest.strip():
        yield rest


class ReviewFeed(DataSource):
    """Options: path; pagesPerTrigger, the most pages of each product in a batch; reader, a name for the progress of each of
    several queries over one feed."""

    @classmethod
    def name(cls) -> str:
        return "reviewfeed"

    def schema(self) -> str:
        return PAGE

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _FeedReader(self.options)


def review_feed(spark: SparkSession, path: str, pages_per_trigger: int = 1, reader: str = "main") -> DataFrame:
    spark.dataSource.register(ReviewFeed)
    return spark.readStream.format("reviewfeed").option("pagesPerTrigger", pages_per_trigger).option("reader", reader).load(path)


def collected_stream(pages: DataFrame, most: int = 20, size: int = 20) -> DataFrame:
    """product, pos, content as operators.reviews.collected gives them, each product's in the batch that ends its feed.

    Until then a product's reviews are kept as state, at most `most` of them; a page with another status than 200 drops them, and
    the product publishes nothing. A product that has ended is remembered by a flag, so that later pages of it count for nothing: the
    state is a flag for each product of the feed, and reviews of the open ones. Pages of a product must come in order, in one
    batch or several."""
    space = F.transform("contents", lambda r: F.struct(r["id"].alias("id"), _collapsed(r["content"]).alias("content")))

    def collect(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ended, keys, contents = state.get if state.exists else (False, [], [])
        own = pd.concat(list(batches)).sort_values("page") if not ended else None
        keys, contents, publish = list(keys), list(contents), False
        for row in own.itertuples() if own is not None else ():
            if row.page >= -(-most // size):
                break
            if row.status is not None and not pd.isna(row.status) and row.status != 200:
                ended, keys, contents = True, [], []
                break
            found = list(row.contents) if row.contents is not None else []
            seen = set(keys)
            for r in found:
                name = r["id"] if r["id"] is not None else r["content"]
                if r["content"] and len(contents) < most and name not in seen:
                    seen.add(name)
                    keys.append(name)
                    contents.append(r["content"])
            if len(contents) >= most or (row.last is not None and not pd.isna(row.last) and row.last) or len(found) < size or row.page + 1 >= -(-most // size):
                ended = publish = True
                break
        out = pd.DataFrame({"product": [key[0]] * len(contents), "pos": range(1, len(contents) + 1), "content": contents}) if publish else None
        state.update((ended, [] if ended else keys, [] if ended else contents))
        if out is not None and len(out):
            yield out

    clean = pages.select("product", "page", "status", "last", space.alias("contents"))
    return clean.groupBy("product").applyInPandasWithState(collect, COLLECTED, STATE, "append", GroupStateTimeout.NoTimeout)


def _collapsed(content: F.Column) -> F.Column:
    from decidra.functions.scalars import collapse

    return F.coalesce(collapse(content), F.lit(""))


def published(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a folder for each batch, which the same batch replaces when it comes again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def first_messages_published(path: str, tag: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the first message of type `tag` of each product (see reviews.first_messages), of all batches: a product that
    an earlier batch has published is processed no more. Batches after this one count for nothing, so a batch that comes
    again gives what it gave before."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        first = first_messages(batch, tag)
        done = earlier(spark, path, number)
        if done is not None:
            first = first.join(done.select("product"), "product", "left_anti")
        first.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def earlier(spark: SparkSession, path: str, number: int) -> DataFrame | None:
    """What batches before this one have published."""
    from decidra.sources.versions import Folder

    folder = Folder(spark, path)
    names = [n for n in folder.names("") if n.startswith("batch=") and int(n.removeprefix("batch=")) < number]
    return spark.read.option("basePath", path).parquet(*(f"{path}/{n}" for n in names)) if names else None


