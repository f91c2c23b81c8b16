"""Sources and sinks beside Parquet: JSON lines, whole files, PDF guards, logs, CSV, tab-separated cards, natural-key export and import."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window



def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines with a declared schema; broken lines become rows of nulls."""
    return spark.read.schema(schema).json(path)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def pdf_files(spark: SparkSession, path: str, most_bytes: int = 500_000_000) -> DataFrame:
    """(path, length, content, valid): a valid file has the magic bytes and a bearable size."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return files.select("path", "length", "content", ((F.substring("content", 1, 4) == F.lit(b"%PDF")) & (F.col("length") <= most_bytes)).alias("valid"))


def parsed_pages(files: DataFrame, parse: Callable[[bytes], list[str]], first: int = 1, last: int | None = None) -> DataFrame:
    """(path, page, text) of the pages ``first`` to ``last`` by an injected parser, file by file within a partition."""

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                texts = parse(content)[first - 1 : last]
                yield pd.DataFrame({"path": [path] * len(texts), "page": range(first, first + len(texts)), "text": texts})

    return files.select("path", "content").mapInPandas(pages, "path string, page int, text string")


def log_events(lines: DataFrame, order: str, start: str, event: str) -> DataFrame:
    """Lines of a log that match ``event`` with the value of the last ``start`` line before: (name, value) by file."""
    name = F.regexp_extract("value", start, 1)
    w = Window.partitionBy("path").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("name", F.last(F.when(name != "", name), ignorenulls=True).over(w))
    return rows.withColumn("found", F.regexp_extract("value", event, 1)).filter("found <> ''").select("path", order, "name", "found")


def question_csv(bank: DataFrame) -> DataFrame:
    """The bank with its options map as five columns and line breaks as blanks: ready for ``write.csv``."""
    flat = lambda c: F.regexp_replace(c, r"[\r\n]+", " ")
    return bank.select("id", flat(F.col("stem")).alias("stem"), *[flat(F.col("options")[x]).alias(f"option_{x.lower()}") for x in "ABCDE"], "answer")


def card_lines(cards: DataFrame) -> DataFrame:
    """Front, back and tag of cards as tab-separated lines, HTML escaped: ready for ``write.text``."""

    def escaped(c: str) -> Column:
        out = F.coalesce(F.col(c), F.lit(""))
        for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\t", " "), ("\n", "<br>")):
            out = F.replace(out, F.lit(char), F.lit(entity))
        return out

    return cards.select(F.concat_ws("\t", escaped("front"), F.concat_ws("<br><br>", escaped("back"), escaped("note")), F.replace("tag", F.lit(" "), F.lit("_"))).alias("value"))


#: White space of any script.
SPACES = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"


def natural_key(ref: str = "source_ref", stem: str = "stem") -> Column:
    """The row's reference, else a hash of its stem in lower case with runs of white space as one blank; marks stay. An empty reference is none, a null stem empty."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(F.col(stem), F.lit(""))), SPACES, " "), "^ | $", "")
    return F.coalesce(F.nullif(F.col(ref), F.lit("")), F.concat(F.lit("sha1:"), F.sha1(F.encode(flat, "UTF-8"))))


def imported(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows and those new ones whose key isn't there yet, the first of each key: running it twice changes nothing."""
    once = new.dropDuplicates(keys).join(existing, keys, "left_anti")
    return existing.unionByName(once.select(*existing.columns))


def renamed_citations(df: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """``old`` replaced in a text column where it isn't part of a longer title (a capital or digit follows, or a letter touches)."""
    import re

    guard = rf"(?<![\w])\Q{old}\E(?!\w|,? [A-Z0-9])"
    return df.withColumn(column, F.regexp_replace(column, guard, re.sub(r"([\\$])", r"\\\1", new)))


def outlined(files: DataFrame, outline: Callable[[bytes], list[tuple[int, int, str]]]) -> DataFrame:
    """(path, page, depth, title) of each file's bookmarks by an injected reader; titles without underscores and control characters, empty ones out."""

    def marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame([(path, *m) for m in outline(content)], columns=["path", "page", "depth", "title"])

    rows = files.select("path", "content").mapInPandas(marks, "path string, page int, depth int, title string")
    title = F.trim(F.regexp_replace(F.replace("title", F.lit("_"), F.lit(" ")), r"[\x00-\x1F\x7F]", ""))
    return rows.withColumn("title", title).filter("page >= 0 and title <> ''")


def page_counts(files: DataFrame, known: DataFrame, count: Callable[[bytes], int]) -> DataFrame:
    """(name, pages) of ``files`` (path, content): from ``known`` where a name is in it, counted else; names that are gone drop out."""
    named = files.withColumn("name", F.element_at(F.split("path", "/"), -1))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"name": batch["name"], "pages": [count(c) for c in batch["content"]]})

    new = named.join(known, "name", "left_anti").select("name", "content").mapInPandas(counted, "name string, pages int")
    return known.join(named.select("name"), "name", "left_semi").select("name", "pages").unionByName(new)


def vector_files(spark: SparkSession, path: str, names: str = "refs", vectors: str = "vecs") -> DataFrame:
    """(ref, embedding) of NumPy archives with an array of names and a matrix of vectors, file by file within a partition."""
    import io

    import numpy as np

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as held:
                    yield pd.DataFrame({"ref": held[names].astype(str), "embedding": list(held[vectors].astype("float32"))})

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path)
    return found.select("content").mapInPandas(rows, "ref string, embedding array<float>")


def bookmarks_csv(concepts: DataFrame, questions: DataFrame) -> DataFrame:
    """Bookmarks of concepts and questions as one table with a ``type``: ready for ``write.csv``. What a kind lacks is empty."""
    flat = F.replace(F.coalesce("content", F.lit("")), F.lit("\n"), F.lit(" "))
    when = F.coalesce(F.date_format("created_at", "yyyy-MM-dd HH:mm"), F.lit(""))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    one = concepts.select(F.lit("concept").alias("type"), flat.alias("content"), text("book_title").alias("book_title"), text("page_number").alias("page_number"), when.alias("created_at"))
    two = questions.select(F.lit("mcq").alias("type"), flat.alias("content"), F.lit("").alias("book_title"), F.lit("").alias("page_number"), when.alias("created_at"))
    return one.unionByName(two)


def disputed_report(recalls: DataFrame) -> DataFrame:
    """Disputed answers with their evidence as one text: ready for ``write.csv``."""
    told = F.transform("evidence", lambda e: F.concat(e["book"], F.lit(" p."), e["page"].cast("string"), F.lit(": "), e["quote"]))
    return recalls.filter(F.col("verdict").isin("contradicted", "books_conflict")).select("page", "id", "question", "answer", "verdict", F.concat_ws(" | ", told).alias("evidence"))


def appended(rows: DataFrame, path: str, rows_per_file: int = 5000) -> None:
    """Append ``rows`` to a Parquet table in files of at most ``rows_per_file`` rows."""
    rows.write.mode("append").option("maxRecordsPerFile", rows_per_file).parquet(path)


def snapshot(tables: dict[str, DataFrame], folder: str) -> None:
    """Write each table as Parquet under its name in ``folder``: a dump that ``restored`` reads."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder.rstrip('/')}/{name}.parquet")


def restored(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet") for name in names}
