"""Loosely structured CSV/TSV exports, read as strings.

The encoding and the delimiter are found from all bytes of the input, by a distributed scan of its blocks; only the
header line is looked for in the first bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headwater.operators.normalize import normalize_posts
from headwater.plans.lineage import stage
from headwater.sources.schema import NA_TOKENS

HEAD = 1 << 20
SPARE, WHOLE = "__hw_spare", "__hw_whole"


@dataclass(frozen=True)
class Dialect:
    encoding: str
    separator: str
    columns: tuple[str, ...]
    broken_lines: bool = True  # whether quoted fields may hold line breaks


def sniff_encoding(head: bytes) -> str:
    """From a byte-order mark; else UTF-16 if there are NUL bytes, UTF-8 if it decodes, else Latin-1."""
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "UTF-16"
    if head[:3] == b"\xef\xbb\xbf":
        return "UTF-8"
    if b"\x00" in head[:4096]:
        return "UTF-16LE" if head[1:2] == b"\x00" else "UTF-16BE"
    for cut in range(4):  # the head may end within a character
        try:
            head[: len(head) - cut].decode("utf-8")
            return "UTF-8"
        except UnicodeDecodeError:
            continue
    return "ISO-8859-1"


def sniff_separator(header: str, tabs: int, commas: int) -> str:
    """Tab if the text has more tabs than commas, else the one of ``, ; |`` most frequent in the header line."""
    if tabs > commas:
        return "\t"
    best = max(",;|", key=header.count)
    return best if header.count(best) else ","


def sniff(head: bytes, encoding: str | None = None, tabs: int | None = None, commas: int | None = None, broken_lines: bool = True) -> Dialect:
    """The dialect of a text by its first bytes, or by what is known of all of it."""
    import csv
    import io

    encoding = encoding or sniff_encoding(head)
    text = head.decode(encoding, "ignore").lstrip("\ufeff")
    header = text.splitlines()[0] if text.splitlines() else ""
    separator = sniff_separator(header, text.count("\t") if tabs is None else tabs, text.count(",") if commas is None else commas)
    row = next(csv.reader(io.StringIO(text, newline=""), delimiter=separator), [])
    names: list[str] = []
    for k, name in enumerate(row):
        name = name.strip() or f"_c{k}"
        while name in names:
            name += "_"
        names.append(name)
    return Dialect(encoding, separator, tuple(names), broken_lines)


def sniff_all(spark: SparkSession, path: str) -> Dialect:
    """The dialect by all bytes, counted line by line in parallel; UTF-16 (by its mark or NUL bytes) by the first ones."""
    head = first_bytes(spark, path)
    encoding = sniff_encoding(head)
    if encoding.startswith("UTF-16"):
        return sniff(head)
    lines = spark.read.text(path)  # lines as they are: a line's bytes are not changed by reading them as a string
    raw = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    count = lambda c: F.coalesce(F.sum(F.regexp_count(raw, F.lit(c))), F.lit(0))
    odd = F.coalesce(F.max(F.regexp_count(raw, F.lit('"')) % 2), F.lit(0))
    invalid = F.coalesce(F.max((~F.is_valid_utf8("value")).cast("int")), F.lit(0))
    seen = lines.agg(count("\t").alias("tabs"), count(",").alias("commas"), odd.alias("odd"), invalid.alias("invalid")).first()
    return sniff(head, "ISO-8859-1" if seen.invalid else "UTF-8", seen.tabs, seen.commas, bool(seen.odd))


def first_bytes(spark: SparkSession, path: str, n: int = HEAD) -> bytes:
    """The first bytes of a file (of a folder: of its first file), through Hadoop's file systems."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(p).isDirectory():
        files = sorted(f.getPath().toString() for f in fs.listStatus(p) if f.isFile() and not f.getPath().getName().startswith(("_", ".")))
        p = jvm.org.apache.hadoop.fs.Path(files[0])
    stream = fs.open(p)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def read_delimited(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """All columns as strings; missing-value tokens are null, short rows padded, rows with too many fields dropped.

    A spare last column tells rows that are too long: one field too many fills the schema, so that the reader finds
    no fault, and an even longer one has text there (or an empty field, which goes unnoticed). Only where quotes do
    not close on their line is a file read as a whole; else it is split among tasks.
    """
    dialect = sniff_all(spark, path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*dialect.columns, SPARE, WHOLE)])
    raw = (
        spark.read.schema(schema)
        .option("header", True).option("enforceSchema", True).option("sep", dialect.separator).option("encoding", dialect.encoding)
        .option("multiLine", dialect.broken_lines).option("columnNameOfCorruptRecord", WHOLE).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
        .csv(path)
    )
    kept = raw.where(F.col(SPARE).isNull() & F.col(WHOLE).isNotNull())
    clean = kept.select(*(F.when(~F.col(f"`{c}`").isin(NA_TOKENS), F.col(f"`{c}`")).alias(c) for c in dialect.columns))
    return clean if limit is None else clean.limit(limit)


def read_posts(spark: SparkSession, path: str, profile: str = "alias", limit: int | None = None) -> DataFrame:
    """Canonical posts of a file with a row_id in file order, kept as a table so that it never changes."""
    raw = read_delimited(spark, path, limit).withColumn("row_id", F.monotonically_increasing_id())
    return stage(normalize_posts(raw, profile, keep=["row_id"]))
