"""Writers of items: JSON, JSON lines, Markdown, WARC records, text by group, batches."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusmill.functions import urls as U, web
from corpusmill.operators import dom

ITEM = ("value", "source_url", "spider", "callback", "id")


def _line() -> Column:
    """An item as JSON, its payload embedded as it is, nulls written."""
    q = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1), F.lit("null"))
    text = lambda c: F.when(F.col(c).isNull(), F.lit("null")).otherwise(q(c))
    return F.concat(F.lit('{"value":'), F.coalesce("value", F.lit("null")), F.lit(',"source_url":'), text("source_url"), F.lit(',"spider":'), text("spider"), F.lit(',"callback":'), text("callback"), F.lit(',"id":'), text("id"), F.lit("}"))


def jsonl(items: DataFrame) -> DataFrame:
    return items.select(_line().alias("value"))


def write_jsonl(items: DataFrame, path: str, append: bool = False) -> None:
    jsonl(items).write.mode("append" if append else "overwrite").text(path)


def write_json(items: DataFrame, path: str, order_col: str = "id") -> None:
    """One JSON array over the files of the folder, in the order of their names: [, items joined by commas, ]."""
    lines = items.repartitionByRange(order_col).sortWithinPartitions(order_col).select(_line().alias("line"))
    # The first range is never empty, so the number 0 stands for the first item of all.
    body = lines.select(F.concat(F.when(F.monotonically_increasing_id() == 0, F.lit("")).otherwise(F.lit(",")), "line").alias("value"))
    spark = items.sparkSession
    spark.createDataFrame([("[",)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/part=0")
    body.write.mode("overwrite").text(f"{path}/part=1")
    spark.createDataFrame([("]",)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/part=2")


def markdown_blocks(items: DataFrame) -> DataFrame:
    """What each item adds to a merged Markdown document: its html, or else its text; the others nothing."""
    v = F.from_json("value", "html string, text string")
    md = F.when(v["html"].isNotNull(), F.concat(dom.html_to_markdown(v["html"]), F.lit("\n\n---\n\n"))).when(v["text"].isNotNull(), F.concat(v["text"], F.lit("\n")))
    return items.withColumn("markdown", md).filter("markdown is not null")


def write_markdown_pages(items: DataFrame, path: str) -> DataFrame:
    """A file per item with html, through a Hadoop-independent folder that all machines share; returns name and bytes. Of
    several items whose urls give one name the later ones, by url and id, get a number."""
    v = F.from_json("value", "html string")
    pages = items.withColumn("html_", v["html"]).filter("html_ is not null")
    named = pages.select(U.url_to_filename(F.col("source_url"), F.monotonically_increasing_id()).alias("name"), "source_url", "id", dom.html_to_markdown(F.col("html_")).alias("text"))
    clash = Window.partitionBy("name").orderBy("source_url", "id")
    named = named.withColumn("nth", F.row_number().over(clash)).select(F.when(F.col("nth") == 1, F.col("name")).otherwise(F.concat(F.regexp_replace("name", r"\.md$", ""), F.lit("_"), F.col("nth").cast("string"), F.lit(".md"))).alias("name"), "text")

    def write(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        for pdf in batches:
            for name, text in zip(pdf["name"], pdf["text"], strict=True):
                with store.open_output_stream(os.path.join(root, name)) as f:
                    f.write(text.encode())
            yield pdf.assign(bytes=pdf["text"].map(lambda t: len(t.encode())))[["name", "bytes"]]

    return named.mapInPandas(write, "name string, bytes long")


def warc_record(url: Column, status: Column, headers: Column, body: Column, date: str) -> Column:
    """A response record as bytes, by expressions only; line breaks in url and headers become spaces."""
    clean = lambda c: F.translate(c, "\r\n", "  ")
    lines = F.array_join(F.transform(F.map_entries(headers), lambda e: F.concat(clean(e["key"]), F.lit(": "), clean(e["value"]), F.lit("\r\n"))), "")
    block = F.concat(F.lit("HTTP/1.1 "), status.cast("string"), F.lit(" "), web.status_text(status), F.lit("\r\n"), lines, F.lit("\r\n"))
    size = (F.octet_length(block) + F.octet_length(body)).cast("string")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), clean(url), F.lit(f"\r\nWARC-Date: {date}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    return F.concat(F.encode(head, "UTF-8"), F.encode(block, "UTF-8"), body.cast("binary"))


def write_warc(items: DataFrame, path: str, date: str) -> None:
    """The html of items as records of status 200 without headers, each followed by an empty line's two line ends. The text
    writer keeps bytes as they are."""
    v = F.from_json("value", "html string")
    pages = items.withColumn("html_", v["html"]).filter("html_ is not null")
    record = warc_record(F.col("source_url"), F.lit(200), F.from_json(F.lit("{}"), "map<string,string>"), F.encode("html_", "UTF-8"), date)
    pages.select(record.cast("string").alias("value")).write.mode("overwrite").option("lineSep", "\r\n\r\n").text(path)


def numbered_batches(items: DataFrame, n: int, order_col: str = "id") -> DataFrame:
    """items with batch: runs of n rows, counted in each range of order_col by itself, so that the last batch of a range may be smaller."""
    ranged = items.repartitionByRange(order_col).sortWithinPartitions(order_col).withColumn("row_", F.monotonically_increasing_id())
    return ranged.withColumn("batch", F.shiftright("row_", 33) * (1 << 33) + F.floor((F.col("row_") % (1 << 33)) / n)).drop("row_")


def tee(items: DataFrame, *outputs: ItemOutput) -> DataFrame:
    """Write items to each output and hand them on; an output's error ends the run."""
    for out in outputs:
        out.write(items)
    return items


class Items:
    """A collection of items: its length, rows, JSON and JSON lines. from_values gives items without provenance."""

    def __init__(self, df: DataFrame):
        self.df = df

    @classmethod
    def from_values(cls, spark, values: list[str] | DataFrame) -> Items:
        """Of JSON texts, or of a table with a column value."""
        rows = values if isinstance(values, DataFrame) else spark.createDataFrame([(v,) for v in values], "value string")
        return cls(rows.select("value", F.lit("").alias("source_url"), F.lit("").alias("spider"), F.lit(None).cast("string").alias("callback"), F.lit("").alias("id")))

    def __len__(self) -> int:
        return self.df.count()

    def __iter__(self):
        return self.df.toLocalIterator()

    def to_jsonl(self) -> DataFrame:
        return jsonl(self.df)

    def to_file(self, path: str, format: str = "jsonl") -> None:
        with_output = ItemOutput(path, format).open()
        with_output.write(self.df)
        with_output.close()


def write_batches(items: DataFrame, n: int, flush: Callable[[list], None]) -> None:
    """flush(rows) for every n rows of a partition, and for the rest; an error in it fails the job."""

    def run(rows):
        held = []
        for r in rows:
            held.append(r)
            if len(held) == n:
                flush(held)
                held = []
        if held:
            flush(held)

    items.foreachPartition(run)


def write_grouped_text(items: DataFrame, path: str, group: str, book: str, chapter: str, content: str, order_col: str) -> None:
    """Folders by group and files of text in which chapters follow one another, headed by their names."""
    safe = lambda c, d: F.regexp_replace(F.coalesce(F.col(c), F.lit(d)), r'[\\/:*?"<>|\p{Cntrl}]', "_")
    text = F.concat(F.lit("========== "), F.coalesce(F.col(chapter), F.lit("untitled")), F.lit(" ==========\n"), F.coalesce(F.col(content), F.lit("")), F.lit("\n"))
    rows = items.select(safe(group, "unknown").alias("group"), safe(book, "unknown").alias("book"), F.col(order_col).alias("o_"), text.alias("value"))
    rows.repartition("group", "book").sortWithinPartitions("group", "book", "o_").drop("o_").write.mode("overwrite").partitionBy("group", "book").text(path)


class ItemOutput:
    """A sink that is opened, written to and closed; opening and closing twice is fine, writing to a closed one an error."""

    def __init__(self, path: str, format: str = "jsonl", append: bool = False, date: str = "2024-01-01T00:00:00Z"):
        self.path, self.format, self.append, self.date, self.opened, self.written = path, format, append, date, False, 0

    def open(self) -> ItemOutput:
        self.opened = True
        return self

    def write(self, items: DataFrame) -> DataFrame:
        if not self.opened:
            raise RuntimeError("the output is not open")
        if self.format == "jsonl":
            write_jsonl(items, self.path, self.append or self.written > 0)
        elif self.format == "json":
            write_json(items, self.path)
        elif self.format == "markdown":
            write_markdown_pages(items, self.path).count()
        elif self.format == "warc":
            write_warc(items, self.path, self.date)
        else:
            raise ValueError(self.format)
        self.written += 1
        return items

    def close(self) -> None:
        self.opened = False
