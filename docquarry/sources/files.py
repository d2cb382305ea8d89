"""Files other than tables: JSON, text logs, documents as bytes; and JSON as a sink."""

from __future__ import annotations

import io
import uuid
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.functions.markup import html_strings
from docquarry.lineage import remove
from docquarry.session import ship_package

# Encodings in the order in which they are tried; the last takes any bytes.
ENCODINGS = ("utf-8-sig", "utf-8", "windows-1250", "iso-8859-2", "latin-1")
# Endings of the documents that are read.
ENDINGS = ("pdf", "docx", "txt", "md", "html", "htm", "tex", "latex")
# Fixed value: the namespace of the paragraphs of a word processor's file.
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def json_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of JSON files that hold a list or one object each."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def log_lines(spark: SparkSession, path: str, pattern: str, last: int | None = None) -> DataFrame:
    """(path, at, line): lines of text logs that the pattern finds; with `last` only so many from the end of each file.

    at is the place of a line among those that were found in the same part of its file, in order.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    rows = rows.where(F.rlike("line", F.lit(pattern)))
    if last is None:
        return rows
    place = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("at")))
    return rows.withColumn("place", place).where(F.col("place") <= last).drop("place")


def decoded(data: bytes | None) -> str | None:
    """bytes as text by the first encoding that fits."""
    if data is None:
        return None
    for name in ENCODINGS:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return None


def docx_text(data: bytes) -> str:
    """The paragraphs of a word processor's file, a line each, those of tables and empty ones left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as parts:
        body = ElementTree.fromstring(parts.read("word/document.xml")).find(f"{_WORD}body")
    signs = {f"{_WORD}tab": "\t", f"{_WORD}br": "\n", f"{_WORD}cr": "\n"}
    out = []
    for paragraph in body.findall(f"{_WORD}p"):
        said = "".join(e.text or "" if e.tag == f"{_WORD}t" else signs.get(e.tag, "") for run in paragraph.iter(f"{_WORD}r") for e in run)
        if said:
            out.append(said)
    return "\n".join(out)


def extracted(data: bytes, ending: str) -> str:
    """The text of a document by its ending; a sentence in brackets where a file of a binary format can't be read."""
    if ending in ("html", "htm"):
        return html_strings(decoded(data))
    if ending == "docx":
        try:
            return docx_text(data)
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError) as e:
            return f"[Error: Could not extract text from .{ending} file: {e}]"
    if ending == "pdf":
        return f"[Error: Could not extract text from .{ending} file: no reader for this format]"
    return decoded(data)


def documents(spark: SparkSession, folder: str, endings: tuple[str, ...] = ENDINGS) -> DataFrame:
    """(path, ending, n_bytes, text) of the files of a folder, and below, that have one of the endings, in small or capital letters.

    Bytes are read by Spark, whatever the store, and turned into text in Arrow batches of few files; a file is held whole by
    its task, so one of more than 2 GB fails. There is no reader for pdf: such files are listed and their
    text says so.
    """
    ship_package(spark)
    either = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in endings]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(either) + "}").option("recursiveFileLookup", True).load(folder)

    @F.arrow_udf("string")
    def text(contents: pa.Array, names: pa.Array) -> pa.Array:
        return pa.array([extracted(c, n) for c, n in zip(contents.to_pylist(), names.to_pylist())], pa.string())

    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.select("path", ending.alias("ending"), F.col("length").alias("n_bytes"), text("content", ending).alias("text"))


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line; what was there before goes."""
    rows.write.mode("overwrite").json(path)


def replace_table(rows: DataFrame, path: str) -> None:
    """Writes a whole table in place of the one that was there, which rows may be read from.

    The new table is written beside the old one and takes its name when it is whole, so that a write that
    fails leaves the old one as it was. Between two renames the name is free for a moment.
    """
    spark = rows.sparkSession
    fresh, old = (f"{path.rstrip('/')}.{end}-{uuid.uuid4().hex}" for end in ("new", "old"))
    try:
        rows.write.parquet(fresh)
    except BaseException:
        remove(spark, fresh)
        raise
    place = spark._jvm.org.apache.hadoop.fs.Path
    store = place(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    there = store.exists(place(path))
    if there and not store.rename(place(path), place(old)):
        raise OSError(f"can't move {path}")
    if not store.rename(place(fresh), place(path)):
        if there:
            store.rename(place(old), place(path))
        raise OSError(f"can't move the new table to {path}")
    if there:
        remove(spark, old)
    spark.catalog.refreshByPath(path)


#: A line of an access log: client, time, method, path, status and size.
_ACCESS = r'^(\S+) \S+ \S+ \[([^\]]+)\] "(\S+) (\S+)[^"]*" (\d{3}) (\d+|-)'


def access_log(spark: SparkSession, path: str, statuses: tuple[int, ...] | None = None, last: int | None = None) -> DataFrame:
    """(path, at, client, time, method, url, status, n_bytes) of lines of access logs with one of the statuses, or of all that
    have the form; with `last` only so many from the end of each file. A time that can't be read is null."""
    pattern = _ACCESS if statuses is None else _ACCESS.replace(r"(\d{3})", "(" + "|".join(map(str, statuses)) + ")")
    rows = log_lines(spark, path, pattern, last)
    part = lambda k: F.regexp_extract("line", _ACCESS, k)
    time = F.try_to_timestamp(part(2), F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
    return rows.select(
        "path", "at", part(1).alias("client"), time.alias("time"), part(3).alias("method"), part(4).alias("url"), part(5).cast("int").alias("status"),
        F.nullif(part(6), F.lit("-")).try_cast("long").alias("n_bytes"),
    )
