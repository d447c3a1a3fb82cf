"""Files of pages as a Python data source: a partition for each file, page filters pushed into the reader, failures as warnings.

Two kinds of files are read. A text file has form feeds between its pages. A zip file has a member
for each page, in the order of their names: ``.txt`` with its text, or ``.json`` with its laid-out
words ([text, x0, y0, x1, y1] each), rulings, width and number of images; its comment may be a
JSON object, the document's metadata. Only members that are asked for are opened.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timezone
from fnmatch import fnmatch

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

FORMAT, VERSION = "factloom_pages", "1"
PAGES = (
    "file_id string, filename string, page_number int, text string, words array<struct<word:int,text:string,x0:double,y0:double,x1:double,y1:double>>,"
    " rulings array<struct<x0:double,y0:double,x1:double,y1:double>>, width double, image_count int, opened int"
)
DOCUMENTS = "file_id string, path string, filename string, sha256 string, byte_size long, page_count int, metadata map<string,string>, parser_version string, created_at timestamp, parsed_at timestamp, warnings array<string>"
BLANK_SHARE = 0.6
_CHUNK = 1 << 20


class Wanted:
    """The page numbers that filters and options leave: a range, perhaps a set, perhaps the first few only."""

    def __init__(self, most: int | None = None) -> None:
        self.least, self.last, self.only, self.most = 1, None, None, most

    def take(self, f: Filter) -> bool:
        """Whether a filter is on the page number and now counts."""
        if getattr(f, "attribute", None) != ("page_number",):
            return False
        if isinstance(f, (EqualTo, In)):
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.only = values if self.only is None else self.only & values
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.least = max(self.least, f.value + isinstance(f, GreaterThan))
        elif isinstance(f, (LessThan, LessThanOrEqual)):
            last = f.value - isinstance(f, LessThan)
            self.last = last if self.last is None else min(self.last, last)
        else:
            return False
        return True

    def has(self, n: int) -> bool:
        return n >= self.least and (self.last is None or n <= self.last) and (self.only is None or n in self.only)

    def beyond(self, n: int) -> bool:
        """Whether no page from ``n`` on is wanted."""
        return (self.last is not None and n > self.last) or (self.only is not None and n > max(self.only, default=0))


class TextPages:
    """The pages of a text file, read piece by piece up to the last one wanted."""

    metadata: dict[str, str] = {}

    def __init__(self, source: io.BufferedIOBase) -> None:
        self.source = source

    def count(self) -> int:
        self.source.seek(0)
        return 1 + sum(piece.count(b"\f") for piece in iter(lambda: self.source.read(_CHUNK), b""))

    def pages(self, wanted: Wanted) -> Iterator[tuple[int, dict | Exception]]:
        self.source.seek(0)
        n, held = 1, []
        while not wanted.beyond(n):
            piece = self.source.read(_CHUNK)
            *ended, rest = piece.split(b"\f")
            for part in ended:
                if wanted.has(n):
                    yield n, self._page(b"".join([*held, part]))
                n, held = n + 1, []
            if wanted.has(n):
                held.append(rest)
            if not piece:
                if wanted.has(n):
                    yield n, self._page(b"".join(held))
                return

    @staticmethod
    def _page(raw: bytes) -> dict | Exception:
        try:
            return {"text": raw.decode("utf-8")}
        except UnicodeDecodeError as e:
            return e


class ZipPages:
    """The pages of a zip file; a member is opened when its page is wanted."""

    def __init__(self, source: io.BufferedIOBase) -> None:
        self.zip = zipfile.ZipFile(source)
        self.members = sorted(i.filename for i in self.zip.infolist() if re.search(r"\.(txt|json)$", i.filename))
        if any(self.zip.getinfo(m).flag_bits & 1 for m in self.members):
            raise PermissionError("password-protected")
        try:
            said = json.loads(self.zip.comment or b"{}")
        except ValueError:
            said = {}
        self.metadata = {str(k): str(v) for k, v in said.items() if v not in (None, "")} if isinstance(said, dict) else {}

    def count(self) -> int:
        return len(self.members)

    def pages(self, wanted: Wanted) -> Iterator[tuple[int, dict | Exception]]:
        for n, name in enumerate(self.members, 1):
            if wanted.beyond(n):
                return
            if wanted.has(n):
                yield n, self._page(name)

    def _page(self, name: str) -> dict | Exception:
        try:
            raw = self.zip.read(name).decode("utf-8")
            if name.endswith(".txt"):
                return {"text": raw}
            said = json.loads(raw)
            words = [(i, str(w[0]), *map(_number, w[1:5])) for i, w in enumerate(said.get("words") or [])]
            rulings = [tuple(map(_number, r[:4])) for r in said.get("rulings") or []]
            return {"text": said.get("text"), "words": words, "rulings": rulings, "width": _number(said.get("width")), "image_count": int(said.get("images") or 0)}
        except (zipfile.BadZipFile, ValueError, LookupError, TypeError, AttributeError, EOFError, OSError) as e:
            return e


def _number(x: object) -> float | None:
    return None if x is None else float(x)  # type: ignore[arg-type]


def opened(source: io.BufferedIOBase) -> TextPages | ZipPages:
    """The pages of a file, by its first bytes."""
    head = source.read(4)
    source.seek(0)
    return ZipPages(source) if head[:2] == b"PK" else TextPages(source)


class File(InputPartition):
    def __init__(self, path: str, size: int, changed: datetime | None) -> None:
        self.path, self.size, self.changed = path, size, changed


class PagesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.glob = options["path"], options.get("glob", "*")
        self.emit = options.get("emit", "pages")
        most = options.get("max_pages")
        self.wanted = Wanted(int(most) if most else None)
        if options.get("page_numbers") is not None:
            self.wanted.only = {int(n) for n in options["page_numbers"].split(",") if n.strip()}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on the page number stay here, for they say which pages are opened; with a cap they would change which pages come first."""
        for f in filters:
            if self.emit != "pages" or self.wanted.most is not None or not self.wanted.take(f):
                yield f

    def _files(self) -> fs.FileSystem:
        return fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()

    def partitions(self) -> list[File]:
        root = fs.FileSystem.from_uri(self.path)[1] if "://" in self.path else self.path
        files = self._files()
        top = files.get_file_info(root)
        if top.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"no such file or folder: {self.path}")
        found = [top] if top.is_file else files.get_file_info(fs.FileSelector(root, recursive=True))
        return [File(i.path, i.size, i.mtime) for i in sorted(found, key=lambda i: i.path) if i.is_file and fnmatch(i.base_name, self.glob) and not i.base_name.startswith((".", "_"))]

    def read(self, partition: File) -> Iterator[tuple]:
        warnings: list[str] = []
        digest, size, pages = "", partition.size, None
        try:
            source = self._files().open_input_file(partition.path)
            sha = hashlib.sha256()
            for piece in iter(lambda: source.read(_CHUNK), b""):
                sha.update(piece)
            digest = sha.hexdigest()
            source.seek(0)
            pages = opened(source)
            yield from self._told(partition, pages, digest, warnings)
        except (OSError, zipfile.BadZipFile, NotImplementedError) as e:
            warnings.append(f"cannot be read ({type(e).__name__}: {e})")
            if self.emit == "documents":
                yield self._document(partition, digest, size, 0, {}, warnings)

    def _told(self, file: File, pages: TextPages | ZipPages, digest: str, warnings: list[str]) -> Iterator[tuple]:
        """Rows of one file: its pages, or itself with what its pages warn of."""
        name, seen, blank = file.path.rpartition("/")[2], 0, 0
        wanted = self.wanted
        total = pages.count() if self.emit == "documents" or wanted.most is not None else 0
        if wanted.most is not None:
            left = [n for n in range(1, total + 1) if wanted.has(n)]
            if len(left) > wanted.most:
                warnings.append(f"truncated to the first {wanted.most} of {len(left)} pages")
            wanted = Wanted()
            wanted.only = set(left[: self.wanted.most])
        for n, page in pages.pages(wanted):
            seen += 1
            if isinstance(page, Exception):
                warnings.append(f"page {n}: cannot be read ({type(page).__name__})")
                blank += 1
                continue
            blank += not ((page.get("text") or "").strip() or page.get("words"))
            if self.emit == "pages":
                yield (digest[:16], name, n, page.get("text"), page.get("words") or [], page.get("rulings") or [], page.get("width"), page.get("image_count", 0), seen)
        if self.emit == "documents":
            if not seen or blank >= BLANK_SHARE * seen:
                warnings.append("most pages have no text: the document needs character recognition first")
            yield self._document(file, digest, file.size, total, pages.metadata, warnings)

    @staticmethod
    def _document(file: File, digest: str, size: int, count: int, metadata: dict[str, str], warnings: list[str]) -> tuple:
        return (digest[:16] or None, file.path, file.path.rpartition("/")[2], digest or None, size, count, metadata, VERSION, file.changed, datetime.now(timezone.utc), warnings)


class PagesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return DOCUMENTS if self.options.get("emit") == "documents" else PAGES

    def reader(self, schema) -> PagesReader:
        return PagesReader(dict(self.options))


def _load(spark: SparkSession, path: str, emit: str, glob: str, page_numbers: list[int] | None, max_pages: int | None) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagesSource)
    reader = spark.read.format(FORMAT).option("emit", emit).option("glob", glob)
    if page_numbers is not None:
        reader = reader.option("page_numbers", ",".join(map(str, page_numbers)))
    if max_pages is not None:
        reader = reader.option("max_pages", max_pages)
    return reader.load(path)


def read_pages(spark: SparkSession, path: str, glob: str = "*", page_numbers: list[int] | None = None, max_pages: int | None = None) -> DataFrame:
    """Pages of the files under ``path``: file_id, filename, page_number, text, words, rulings, width, image_count, opened.

    A filter on page_number opens only those pages; ``opened`` tells how many pages of its file
    were opened up to a row's own. page_numbers outside a file are left out; max_pages, which
    counts after page_numbers, keeps the first ones. Files and pages that cannot be read give no
    rows: ``read_documents`` says why.
    """
    return _load(spark, path, "pages", glob, page_numbers, max_pages)


def read_documents(spark: SparkSession, path: str, glob: str = "*", page_numbers: list[int] | None = None, max_pages: int | None = None) -> DataFrame:
    """One row for each file, readable or not: ids, size, page_count, metadata, times, and warnings (unreadable file or page, pages cut off, mostly blank)."""
    return _load(spark, path, "documents", glob, page_numbers, max_pages)


def words_and_rulings(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words and rulings of pages, as ``operators.grids`` takes them, keyed by file_id and page_number."""
    keys = ["file_id", "page_number"]
    words = pages.select(*keys, "width", F.explode("words").alias("w")).select(*keys, "w.*", "width")
    return words, pages.select(*keys, F.explode("rulings").alias("r")).select(*keys, "r.*")
