"""Recorded answers of web APIs as a Spark data source: pages that name the next one, and schemas by API.

``spark.read.format("recorded").option("path", folder)`` reads ``folder/api=<name>/page=<token>/*``, each file one page
of JSON.  A page lists its items under the API's own field and names the next page's token.  Spark gets a partition for
``pages`` files, so an API's pages are read side by side.  A page that cannot be read gives one row with ``error`` and
stops nothing; a token that no recorded page has gives one, too.

Rows are api, page, pos, item (its JSON), next and error; ``typed`` makes columns of items, by the API's fields.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "api string, page string, pos int, item string, next string, error string"


@dataclass(frozen=True)
class Api:
    """Where an API's answers have their items and the next token, and the fields of an item by a common name."""

    name: str
    items: str
    token: str
    fields: tuple[tuple[str, str], ...]  # (name, JSON path)


class Pages(InputPartition):
    def __init__(self, files: Sequence[tuple[str, str, str]]) -> None:
        self.files = list(files)  # (api, page, path)


class RecordedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.files, self.root = fs.FileSystem.from_uri(options["path"])
        self.apis = {a[0]: a[1:] for a in json.loads(options["apis"])}  # name: (items, token)
        self.pages = int(options.get("pages", "16"))

    def partitions(self) -> Sequence[InputPartition]:
        found = []
        for info in self.files.get_file_info(fs.FileSelector(self.root, recursive=True)):
            parts = dict(p.split("=", 1) for p in info.path.split("/") if "=" in p)
            name = info.base_name
            if info.is_file and not name.startswith(("_", ".")) and parts.get("api") in self.apis:
                found.append((parts["api"], unquote(parts.get("page", name)), info.path))
        found.sort()
        return [Pages(found[i : i + self.pages]) for i in range(0, len(found), self.pages)] or [Pages([])]

    def read(self, partition: Pages) -> Iterator[tuple]:
        for api, page, path in partition.files:
            items, token = self.apis[api]
            try:
                with self.files.open_input_stream(path) as f:
                    answer = json.loads(f.read())
                listed, following = answer[items], answer.get(token)
                rows = [(api, page, i, json.dumps(x), following, None) for i, x in enumerate(listed)]
            except Exception as e:  # noqa: BLE001  whatever a page has, the others are read
                rows = [(api, page, None, None, None, f"{type(e).__name__}: {e}"[:200])]
            yield from rows or [(api, page, None, None, following, None)]


class Recorded(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return RecordedReader(dict(self.options))


def read(spark: SparkSession, folder: str, apis: Sequence[Api], pages: int = 16) -> DataFrame:
    """All rows of the recorded pages of ``apis``, those of errors among them."""
    spark.dataSource.register(Recorded)
    named = json.dumps([[a.name, a.items, a.token] for a in apis])
    return spark.read.format("recorded").option("path", folder).option("apis", named).option("pages", pages).load()


def typed(rows: DataFrame, api: Api) -> DataFrame:
    """The items of one API with its fields as columns of text; a field that an item lacks is null."""
    column: list[Column] = [F.get_json_object("item", path).alias(name) for name, path in api.fields]
    return rows.where((F.col("api") == api.name) & F.col("item").isNotNull()).select("page", "pos", *column)


def errors(rows: DataFrame) -> DataFrame:
    """api, page, error: pages that could not be read, and tokens that lead to no recorded page."""
    broken = rows.where("error IS NOT NULL").select("api", "page", "error")
    named = rows.where("next IS NOT NULL").select("api", F.col("next").alias("page")).distinct()
    absent = named.join(rows.select("api", "page").distinct(), ["api", "page"], "left_anti")
    return broken.unionByName(absent.withColumn("error", F.lit("not recorded")))


def record(answers: DataFrame, folder: str) -> None:
    """Write answers (api, page, body) as recorded pages, one file each."""
    answers.select("api", "page", F.regexp_replace("body", "\n", " ").alias("body")).repartition("api", "page").write.mode("append").partitionBy("api", "page").text(folder)
