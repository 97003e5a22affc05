"""File sources and sinks: documents, manifests, JSON lines, event frames, metric pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from ..functions.text import file_format
from ..operators.curate import require_unique

PLAIN, MARKED = (".txt",), (".md", ".html", ".htm")
_BLOCKS = {"p", "div", "li", "tr", "table", "section", "article", "br", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6"}


class _Html(HTMLParser):
    """Text, headings and tables of a page; scripts and styles are left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.headings: list[tuple[int, str]] = []
        self.tables = self.hidden = 0
        self.depth: int | None = None
        self.title: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        if tag in _BLOCKS:
            self.parts.append("\n")
        if tag == "table":
            self.tables += 1
        if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            self.depth, self.title = int(tag[1]), []

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        if self.depth and tag == f"h{self.depth}":
            self.headings.append((self.depth, " ".join("".join(self.title).split())))
            self.depth = None
        if tag in _BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)
            if self.depth:
                self.title.append(data)


def parse_html(page: str) -> tuple[str, list[tuple[int, str]], int]:
    parser = _Html()
    parser.feed(page)
    parser.close()
    lines = [" ".join(line.split()) for line in "".join(parser.parts).split("\n")]
    return "\n".join(line for line in lines if line), parser.headings, parser.tables


def parse_markdown(page: str) -> tuple[str, list[tuple[int, str]], int]:
    headings, tables, before = [], 0, False
    for line in page.split("\n"):
        mark = len(line) - len(line.lstrip("#"))
        if 1 <= mark <= 6 and line[mark : mark + 1] == " ":
            headings.append((mark, line[mark:].strip()))
        row = line.lstrip().startswith("|")
        tables += row and not before
        before = row
    return page, headings, tables


def documents(spark: SparkSession, path: str) -> DataFrame:
    """path, format, content, headings, tables, digest of every file; an unsupported suffix is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    kind = file_format(F.col("path"))
    known = kind.isin(*PLAIN, *MARKED)
    rows = files.withColumn("format", F.when(known, kind).otherwise(F.raise_error(F.concat(F.lit("unsupported file: "), F.col("path")))))
    schema = "path string, format string, content string, headings array<struct<depth:int,title:string>>, tables int, digest string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        heading = pa.list_(pa.struct([("depth", pa.int32()), ("title", pa.string())]))
        for batch in batches:
            out = []
            for where, raw, suffix in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                page = raw.decode("utf-8")
                text, found, tables = parse_html(page) if suffix in (".html", ".htm") else parse_markdown(page) if suffix == ".md" else (page, [], 0)
                out.append((where, suffix, text, [{"depth": a, "title": b} for a, b in found], tables, sha256(raw).hexdigest()))
            kinds = (pa.string(), pa.string(), pa.string(), heading, pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["path", "format", "content", "headings", "tables", "digest"])

    return rows.select("path", "content", "format").mapInArrow(run, schema)


def require_schema(df: DataFrame, schema: ty.StructType) -> DataFrame:
    """The frame, or an error that lists missing and differing columns."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f.name for f in schema if f.name not in have] + [f"{f.name}: {have[f.name].simpleString()}" for f in schema if f.name in have and have[f.name] != f.dataType]
    if wrong:
        raise ValueError(f"unexpected schema: {wrong}")
    return df.select(*[f.name for f in schema])


def manifest(spark: SparkSession, path: str, schema: ty.StructType, key: str) -> DataFrame:
    """A CSV manifest with a declared schema; a malformed row or a repeated key is an error."""
    rows = spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", enforceSchema=False)
    return require_unique(rows, key)


def write_manifest(df: DataFrame, path: str, schema: ty.StructType, key: str) -> None:
    require_unique(require_schema(df, schema), key).orderBy(key).write.mode("overwrite").csv(path, header=True)


def json_lines(spark: SparkSession, path: str, schema: ty.StructType, key: str | None = None) -> DataFrame:
    """One JSON object a line with a declared schema; malformed lines and repeated keys are errors. Reads .gz too."""
    rows = spark.read.json(path, schema=schema, mode="FAILFAST")
    return require_unique(rows, key) if key else rows


def write_json_lines(df: DataFrame, path: str, key: str, compression: str | None = None) -> None:
    writer = df.orderBy(key).write.mode("overwrite")
    (writer.option("compression", compression) if compression else writer).json(path)


def latest_lines(spark: SparkSession, path: str, schema: ty.StructType, key: str, order: str, needed: str) -> DataFrame:
    """The last line of each key; malformed lines and those without the needed text are skipped."""
    rows = spark.read.json(path, schema=schema, mode="DROPMALFORMED").where(F.col(key).isNotNull() & (F.trim(F.coalesce(F.col(needed), F.lit(""))) != ""))
    return rows.groupBy(key).agg(*[F.max_by(c, order).alias(c) for c in rows.columns if c != key])


def event_frames(text: DataFrame, column: str, key: str) -> DataFrame:
    """key, frame, event, data of a server-sent event stream; data lines of one frame are joined."""
    frames = text.select(key, F.posexplode(F.split(F.regexp_replace(column, "\r\n?", "\n"), "\n\n+")).alias("frame", "f")).where(F.trim("f") != "")
    lines = F.split("f", "\n")

    def field(name: str):
        return F.transform(F.filter(lines, lambda s: F.startswith(s, F.lit(f"{name}:"))), lambda s: F.regexp_replace(s, f"^{name}: ?", ""))

    return frames.select(key, "frame", F.coalesce(F.get(field("event"), F.lit(0)), F.lit("message")).alias("event"), F.array_join(field("data"), "\n").alias("data"))


def metric_samples(lines: DataFrame, column: str = "value") -> DataFrame:
    """name, labels, value of a metrics page in exposition format; comments and malformed lines are skipped."""
    pattern = r"^([a-zA-Z_:][\w:]*)(?:\{(.*)\})?\s+([^\s]+)"
    rows = lines.where(F.col(column).rlike(pattern) & ~F.startswith(column, F.lit("#")))
    pairs = F.regexp_extract_all(F.regexp_extract(column, pattern, 2), F.lit(r'(\w+)="((?:[^"\\]|\\.)*)"'), F.lit(0))
    entries = F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"^(\w+)=", 1).alias("key"), F.regexp_extract(p, r'="(.*)"$', 1).alias("value")))
    number = F.regexp_extract(column, pattern, 3)
    value = F.when(number == "+Inf", F.lit(float("inf"))).otherwise(number.try_cast("double"))
    return rows.select(F.regexp_extract(column, pattern, 1).alias("name"), F.map_from_entries(entries).alias("labels"), value.alias("value"))


def load_stats(spark: SparkSession, path: str) -> DataFrame:
    """name, metric, value of a load test's CSV; cells that are no number are skipped."""
    rows = spark.read.csv(path, header=True)
    numbers = [c for c in rows.columns if c not in ("Type", "Name")]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").try_cast("double").alias("value")) for c in numbers])).alias("c")
    return rows.select(F.col("Name").alias("name"), cells).select("name", "c.*").where("value is not null")


def verified(manifest_rows: DataFrame, files: DataFrame) -> DataFrame:
    """Files joined to their manifest rows (path, sha256); a missing file or another digest is an error."""
    both = manifest_rows.join(files, "path", "left")
    fine = F.col("digest").eqNullSafe(F.col("sha256"))
    return both.withColumn("content", F.when(fine, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("missing or changed: "), F.col("path")))))
