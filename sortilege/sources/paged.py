"""A batch source for listings that are served in pages, or in pages of date windows.

    spark.dataSource.register(Pages)
    spark.read.format("json_pages").options(at="https://host/posts?page={page}&per_page=100", per_page=100).load()

`at` names a page: {page} stands for its number, {after} and {before} for the days of a
window. It may be an http address or a path in any file system that pyarrow opens; a
folder stands for the one file in it. A page is a JSON array of items; a page shorter
than per_page, an empty one or an error object ends the listing.

Without windows each page is a partition, and in long listings each stretch of pages, so that tasks do not
grow in number with the pages: the last page is found first, by doubling and halving, with a few reads on the driver. With `start` each window is a partition, which walks its own pages, so that no
listing grows deep. A page that cannot be read gives one row with `error`
set, and its neighbours their items: one bad page costs one page.
"""

from __future__ import annotations

import datetime as dt
import json
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "id long, slug string, date string, link string, acf string, page int, after date, error string"
#: The code of the error object behind the last page; any other one is reported.
PAST_END = "rest_post_invalid_page_number"
#: No listing is taken to have more pages.
MOST_PAGES = 1 << 30
#: Pages read at most to tell whether a listing goes on behind one that fails; if all of them fail it ends there.
LOOK_AHEAD = 4
#: Partitions of a listing without windows: a longer one has stretches of neighbouring pages.
MOST_PARTITIONS = 64


def fetch(at: str, timeout: float = 60.0) -> bytes:
    """The bytes of an http address, of a file, or of the one file of a folder."""
    if at.startswith(("http://", "https://")):
        try:
            with urllib.request.urlopen(at, timeout=timeout) as got:
                return got.read()
        except urllib.error.HTTPError as e:
            body = e.read()
            if body.lstrip()[:1] == b"{":  # an error object tells more than its status
                return body
            raise
    fs, path = pyarrow.fs.FileSystem.from_uri(at if "://" in at or at.startswith("file:") else f"file://{at}")
    if fs.get_file_info(path).type == pyarrow.fs.FileType.Directory:
        path = min(f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(path)) if f.is_file and not f.base_name.startswith(("_", ".")))
    with fs.open_input_stream(path) as f:
        return f.read()


@dataclass
class Listing:
    """Where the pages lie and how they are read."""

    at: str
    per_page: int = 100
    tries: int = 1
    timeout: float = 60.0

    def page(self, number: int, after: dt.date | None = None, before: dt.date | None = None) -> tuple[list[dict], str | None]:
        """The items of a page and what went wrong; neither where the listing has ended before it."""
        at, wrong = self.at.replace("{page}", str(number)).replace("{after}", str(after)).replace("{before}", str(before)), None
        for _ in range(self.tries):
            try:
                got = json.loads(fetch(at, self.timeout))
            except FileNotFoundError:
                return [], None  # where pages are files, none is written past the end
            except Exception as e:  # noqa: BLE001
                wrong = f"{type(e).__name__}: {e}"[:500]
                continue
            if isinstance(got, dict):
                code = str(got.get("code", "no list"))
                return [], None if code == PAST_END else f"{code}: {str(got.get('message', ''))[:200]}"
            return [x for x in got or [] if isinstance(x, dict)], None
        return [], wrong

    def full(self, number: int) -> bool:
        """Whether pages may follow this one. One that cannot be read says nothing: the first of the next few that can be read tells."""
        for n in range(number, number + LOOK_AHEAD):
            items, wrong = self.page(n)
            if not wrong:
                return len(items) >= (self.per_page if n == number else 1)
        return False

    def last(self, first: int, most: int) -> int:
        """The last page of the walk, in about twice the logarithm of its number of reads: the pages before it are full."""
        low, at, step = first, first, 1
        while at <= most and self.full(at):
            low, at, step = at + 1, at + step, step * 2
        high = min(at, most)
        while low < high:
            middle = (low + high) // 2
            if self.full(middle):
                low = middle + 1
            else:
                high = middle
        return min(low, most)


@dataclass
class Page(InputPartition):
    """A stretch of pages: the first one's number, and how many there are."""

    number: int
    pages: int = 1


@dataclass
class Window(InputPartition):
    after: dt.date
    before: dt.date


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        number = lambda k, default: int(options.get(k, default))
        self.listing = Listing(options["at"], number("per_page", 100), number("tries", 1), float(options.get("timeout", 60)))
        self.first, self.most, self.days = number("first_page", 1), number("max_pages", MOST_PAGES), number("days", 7)
        self.start = options.get("start")
        self.end = dt.date.fromisoformat(options["end"]) if "end" in options else dt.date.today() + dt.timedelta(days=1)

    def partitions(self) -> list[InputPartition]:
        if self.start is None:
            last = self.listing.last(self.first, self.first + self.most - 1)
            many = -(-(last + 1 - self.first) // MOST_PARTITIONS)
            return [Page(n, min(many, last + 1 - n)) for n in range(self.first, last + 1, max(1, many))]
        out, at = [], dt.date.fromisoformat(self.start)
        while at <= self.end:
            out.append(Window(at, at + dt.timedelta(days=self.days)))
            at = out[-1].before
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if isinstance(partition, Page):
            for n in range(partition.number, partition.number + partition.pages):
                yield from self._rows(n, None, *self.listing.page(n))
            return
        for n in range(self.first, self.first + self.most):
            items, wrong = self.listing.page(n, partition.after, partition.before)
            yield from self._rows(n, partition.after, items, wrong)
            if wrong or len(items) < self.listing.per_page:
                return

    def _rows(self, number: int, after: dt.date | None, items: list[dict], wrong: str | None) -> Iterator[tuple]:
        text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))
        for x in items:
            i = x.get("id")
            yield i if isinstance(i, int) else None, text(x.get("slug")), text(x.get("date")), text(x.get("link")), text(x.get("acf")), number, after, None
        if wrong:
            yield None, None, None, None, None, number, after, wrong


class Pages(DataSource):
    """The source `json_pages`. Options: at, per_page, first_page, max_pages, tries, timeout; start, end, days for windows."""

    @classmethod
    def name(cls) -> str:
        return "json_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        if "at" not in self.options:
            raise ValueError("json_pages needs the option 'at'")
        return Reader(dict(self.options))


def read(spark: SparkSession, at: str, **options) -> DataFrame:
    """The listing's rows, with failed pages as rows that have an error."""
    spark.dataSource.register(Pages)
    return spark.read.format("json_pages").options(at=at, **{k: v for k, v in options.items() if v is not None}).load()


def items(rows: DataFrame) -> DataFrame:
    """The items alone, as `payloads.records` takes them."""
    return rows.filter("error IS NULL").select("id", "slug", "date", "link", "acf")


def failures(rows: DataFrame) -> DataFrame:
    """page, after, error of the pages that could not be read."""
    return rows.filter("error IS NOT NULL").select("page", "after", "error")


def write_pages(items: DataFrame, path: str, *folders: str) -> None:
    """Writes items (page, nth and the columns of an item) as listings: one array for each page, in the order of nth, under `folders` and page=N."""
    item = F.to_json(F.struct("id", "slug", "date", "link", F.from_json("acf", "map<string,variant>").alias("acf")))
    held = items.groupBy(*folders, "page").agg(F.array_sort(F.collect_list(F.struct("nth", item.alias("i")))).alias("a"))
    text = held.select(*folders, "page", F.concat(F.lit("["), F.array_join(F.transform("a", lambda x: x["i"]), ","), F.lit("]")).alias("value"))
    text.repartition(*folders, "page").write.partitionBy(*folders, "page").text(path)
