"""A data source for exports of a document store: files of JSON documents, one a line, below one folder.

    spark.dataSource.register(DocumentSource)
    spark.read.format("documents").schema("userId string, `attributes.mode` string").option("path", folder).load()
    spark.readStream.format("documents").schema(...).option("path", folder).load()

The schema is the projection: only its fields, top-level or by a dotted path, are read out of a document. Filters on top-level
or dotted fields are tested on the document before anything of it is converted. Files are read in ranges of bytes, by as many
tasks. A stream has a cursor for each file, the bytes of it that were read; a store that exports a file for each user has a
cursor for each user. Paths are any that pyarrow's file systems open.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import datasource as D
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of a range of a file; documents of a page (an Arrow batch).
RANGE_BYTES, PAGE = 64 << 20, 2000


@dataclass
class Range(D.InputPartition):
    """The documents whose line ends in (start, end] of a file."""

    file: str
    start: int
    end: int


def listed(path: str) -> tuple[pafs.FileSystem, list[pafs.FileInfo]]:
    """The files below a folder (or the file itself), by name; names that begin with . or _ are left out."""
    fs, root = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    info = fs.get_file_info(root)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
    return fs, sorted((f for f in found if f.type == pafs.FileType.File and f.base_name[0] not in "._"), key=lambda f: f.path)


def lines(fs: pafs.FileSystem, part: Range, step: int = 1 << 20, self_contained: bool = True) -> Iterator[bytes]:
    """The lines that end in the range, without their ends; the last line of a file that is complete may lack its own."""
    with fs.open_input_file(part.file) as f:
        size = f.size()
        at = part.start
        while at > 0:  # back to the start of the line that goes on over the range's start
            a = max(0, at - 4096)
            f.seek(a)
            cut = f.read(at - a).rfind(b"\n")
            if cut >= 0:
                at = a + cut + 1
                break
            at = a
        f.seek(at)
        rest, end = b"", part.end
        while at < end:
            chunk = f.read(min(step, end - at))
            if not chunk:
                break
            at += len(chunk)
            *whole, rest = (rest + chunk).split(b"\n")
            yield from whole
        if rest and self_contained and end >= size:
            yield rest


def value_at(doc, path: str):
    """A field by its name, or along a dotted path; the store's typed values ($oid, $date, $numberLong) are plain ones."""
    if isinstance(doc, dict) and path in doc:
        return plain(doc[path])
    head, _, tail = path.partition(".")
    return value_at(doc[head], tail) if tail and isinstance(doc, dict) and head in doc else None


def plain(v):
    if isinstance(v, dict) and len(v) == 1:
        (k, x), = v.items()
        if k == "$oid":
            return x
        if k in ("$numberLong", "$numberInt"):
            return int(x)
        if k in ("$numberDouble", "$numberDecimal"):
            return float(x)
        if k == "$date":
            x = plain(x)
            return datetime.fromtimestamp(x / 1000, timezone.utc) if isinstance(x, int) else datetime.fromisoformat(x)
    return v


TESTS = {
    D.EqualTo: lambda v, x: v == x, D.GreaterThan: lambda v, x: v > x, D.GreaterThanOrEqual: lambda v, x: v >= x, D.LessThan: lambda v, x: v < x,
    D.LessThanOrEqual: lambda v, x: v <= x, D.In: lambda v, x: v in x, D.StringStartsWith: lambda v, x: v.startswith(x),
}


class DocumentReader(D.DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.schema, self.filters = options["path"], schema, []
        self.size = int(options.get("rangebytes", RANGE_BYTES))

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        for f in filters:
            name = ".".join(f.attribute)
            kind = self.schema[name].dataType.typeName() if name in self.schema.names else None
            if type(f) in TESTS and kind in ("string", "long", "integer", "double", "boolean"):
                self.filters.append((name, type(f), f.value))
            elif isinstance(f, D.IsNotNull) and kind:
                self.filters.append((name, D.IsNotNull, None))
            else:
                yield f

    def partitions(self) -> list[Range]:
        _, files = listed(self.path)
        return [Range(f.path, a, min(f.size, a + self.size)) for f in files for a in range(0, f.size, self.size)] or [Range("", 0, 0)]

    def kept(self, doc: dict) -> bool:
        for name, kind, x in self.filters:
            v = value_at(doc, name)
            try:
                if v is None or kind is not D.IsNotNull and not TESTS[kind](v, x):
                    return False
            except (TypeError, AttributeError):  # a value of another type than the schema has
                return False
        return True

    def read(self, partition: Range, complete: bool = True) -> Iterator[pa.RecordBatch]:
        fs = pafs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else pafs.LocalFileSystem()
        schema = to_arrow_schema(self.schema)
        page: list[dict] = []
        for line in () if not partition.file else lines(fs, partition, self_contained=complete):
            try:
                doc = json.loads(line) if line.strip() else None
            except ValueError:
                doc = None
            if isinstance(doc, dict) and self.kept(doc):
                page.append(doc)
                if len(page) == PAGE:
                    yield self.batch(page, schema)
                    page = []
        if page:
            yield self.batch(page, schema)

    def batch(self, page: list[dict], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([column([value_at(d, f.name) for d in page], f.type) for f in schema], schema=schema)


def column(values: list, kind: pa.DataType) -> pa.Array:
    """Values as a column; those that do not fit are null, nested ones are JSON where text is asked for."""
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return pa.array([v if isinstance(v, str) or v is None else json.dumps(v, default=str) for v in values], kind)
    try:
        return pa.array(values, kind)
    except (pa.ArrowInvalid, pa.ArrowTypeError, OverflowError):
        return pa.array([one(v, kind) for v in values], kind)


def one(v, kind: pa.DataType):
    try:
        return pa.scalar(v, kind).as_py()
    except (pa.ArrowInvalid, pa.ArrowTypeError, OverflowError, ValueError):
        return None


class DocumentStream(D.DataSourceStreamReader):
    """The same files as they grow. Offsets: file -> bytes read. A line without its end waits for it."""

    def __init__(self, options: dict, schema: StructType):
        self.reader = DocumentReader(options, schema)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {f.path: f.size for f in listed(self.reader.path)[1]}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        size = self.reader.size
        return [Range(f, a, min(to, a + size)) for f, to in sorted(end.items()) for a in range(start.get(f, 0), to, size)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.reader.read(partition, complete=False)


class DocumentSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        raise ValueError("name the fields to read: .schema(...)")

    def reader(self, schema: StructType) -> DocumentReader:
        return DocumentReader(self.options, schema)

    def streamReader(self, schema: StructType) -> DocumentStream:
        return DocumentStream(self.options, schema)


def documents(spark, path: str, schema: str | StructType, range_bytes: int = RANGE_BYTES):
    """The documents below a folder. Malformed lines are left out; a field that is not there, or does not fit, is null."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocumentSource)
    return spark.read.format("documents").schema(schema).option("path", path).option("rangeBytes", range_bytes).load()


def document_stream(spark, path: str, schema: str | StructType):
    spark.dataSource.register(DocumentSource)
    return spark.readStream.format("documents").schema(schema).option("path", path).load()
