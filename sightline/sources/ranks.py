"""Compressed rank files as data sources: lines read within a byte budget, filters on the host applied where they are read.

Rank files are tab-separated lines (harmonic rank and value, page-rank rank and value, host written backwards), one gzip
stream a file; lines that are empty or begin with # are left out. A gzip stream can't be split, so a file is a partition.
Paths name files or folders of any file system that Arrow knows (local, hdfs, s3, gs).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringEndsWith, StringStartsWith

_FIELDS = "harmonic_rank double, harmonic_value double, pagerank_rank double, pagerank_value double, host_reversed string"
ROWS = f"{_FIELDS}, file string, truncated_scan boolean"
SCANS = f"file string, bytes long, truncated_scan boolean, matches array<struct<{_FIELDS.replace(' ', ':').replace(',:', ',')}>>"
#: Compressed bytes that a scan reads of a file, and matches after which it stops, where the options don't say (fixed values).
MAX_BYTES, MAX_MATCHES = 64 << 20, 10
_CHUNK = 1 << 18


@dataclass
class RankFile(InputPartition):
    """One file, and how many bytes of it there are and may be read."""

    uri: str
    size: int
    budget: int | None

    @property
    def truncated(self) -> bool:
        """A file of exactly the budget counts too: whether more would follow isn't known to who stops there."""
        return self.budget is not None and self.size >= self.budget


def _files(path: str, budget: int | None) -> list[RankFile]:
    """Files of path, or of the folder at path and those below it, in the order of their names; hidden ones are left out."""
    system, root = (fs.LocalFileSystem(), path) if "://" not in path and not path.startswith("file:") else fs.FileSystem.from_uri(path)
    prefix = path[: len(path) - len(root)] if path.endswith(root) else ""
    found = system.get_file_info(root)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    every = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
    shown = [f for f in every if f.type == fs.FileType.File and not any(p[:1] in ("_", ".") for p in f.path[len(root) :].split("/"))]
    return [RankFile(prefix + f.path, f.size, budget) for f in sorted(shown, key=lambda f: f.path)]


def _chunks(part: RankFile) -> Iterator[tuple[bytes, int, bool]]:
    """(decompressed bytes, compressed bytes read so far, whether a member ends with them); members of a stream follow each other, a torn end is no error."""
    system, name = (fs.LocalFileSystem(), part.uri) if "://" not in part.uri and not part.uri.startswith("file:") else fs.FileSystem.from_uri(part.uri)
    left, unzip = part.budget if part.budget is not None else part.size, zlib.decompressobj(wbits=31)
    read = 0
    with system.open_input_stream(name, compression=None) as file:
        while left > 0 and (raw := file.read(min(_CHUNK, left))):
            left, read = left - len(raw), read + len(raw)
            while raw:
                try:
                    out = unzip.decompress(raw, _CHUNK)
                except zlib.error:
                    return  # what follows the last member, or is damaged
                yield out, read, unzip.eof
                raw = unzip.unconsumed_tail
                if unzip.eof:
                    raw, unzip = unzip.unused_data, zlib.decompressobj(wbits=31)
    if out := unzip.flush():
        yield out, read, False


def _lines(part: RankFile) -> Iterator[tuple[list[str], int]]:
    """(fields of a line, compressed bytes read so far), and at the end once ([], all that was read).

    A last line without its end counts where the stream is whole; where it is cut the line is, too, and its host may be another one.
    """
    rest, read, ended = b"", 0, True
    for out, read, ended in _chunks(part):
        *whole, rest = (rest + out).split(b"\n")
        for line in whole:
            if fields := _fields(line):
                yield fields, read
    if ended and (fields := _fields(rest)):
        yield fields, read
    yield [], read


def _fields(line: bytes) -> list[str]:
    text = line.decode("utf-8", "replace").strip()
    return [] if not text or text.startswith("#") else text.split("\t")


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def _row(fields: list[str]) -> tuple:
    held = [*fields[:5], *[""] * (5 - len(fields))]
    return (*[_number(x) for x in held[:4]], held[4] if len(fields) > 4 else None)


class _Reader(DataSourceReader):
    """Lines of each file as rows."""

    def __init__(self, path: str, budget: int | None) -> None:
        self.path, self.budget = path, budget

    def partitions(self) -> list[RankFile]:
        return _files(self.path, self.budget)

    def passes(self, host: str | None) -> bool:
        return True

    def read(self, partition: RankFile | None) -> Iterator[tuple]:
        if partition is None:  # what Spark passes where there are no files
            return
        for fields, _ in _lines(partition):
            if fields and self.passes(fields[4] if len(fields) > 4 else None):
                yield (*_row(fields), partition.uri, partition.truncated)


class _FilteringReader(_Reader):
    """Applies filters on host_reversed before a row is made."""

    def __init__(self, path: str, budget: int | None) -> None:
        super().__init__(path, budget)
        self.tests: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes =, in, startswith, endswith and is not null on the host; gives back what Spark has to apply itself."""
        kinds = {EqualTo: "is", In: "in", StringStartsWith: "starts", StringEndsWith: "ends"}
        for f in filters:
            if type(f) in kinds and f.attribute == ("host_reversed",):
                self.tests.append((kinds[type(f)], f.value))
            elif type(f) is IsNotNull and f.attribute == ("host_reversed",):
                self.tests.append(("there", True))
            else:
                yield f

    def passes(self, host: str | None) -> bool:
        return not self.tests or (host is not None and all(value is not None and _holds(kind, value, host) for kind, value in self.tests))


def _holds(kind: str, value, host: str) -> bool:
    if kind == "there":
        return True
    if kind == "in":
        return host in [v for v in value if v is not None]
    return {"is": host.__eq__, "starts": host.startswith, "ends": host.endswith}[kind](value)


class _Scanner(_Reader):
    """One row a file: its first matches of a host, after which reading stops."""

    def __init__(self, path: str, budget: int | None, host: str, most: int) -> None:
        super().__init__(path, budget)
        self.host, self.most = host, most

    def read(self, partition: RankFile | None) -> Iterator[tuple]:
        if partition is None:  # what Spark passes where there are no files
            return
        found, read, below = [], 0, "." + self.host
        for fields, read in _lines(partition):
            if not fields:
                continue
            if any(f == self.host or f.endswith(below) for f in fields):
                found.append(_row(fields))
                if len(found) >= self.most:
                    break
        yield (partition.uri, read, partition.truncated, found)


def _whole(text: str | None, least: int, name: str) -> int | None:
    if text is None:
        return None
    if int(text) < least:
        raise ValueError(f"{name} must be {least} or more")
    return int(text)


class RankRows(DataSource):
    """Format rank_rows: all lines of path; option maxBytes bounds the compressed bytes that are read of each file, pushFilters
    (true or false) lets the reader apply filters on the host, which Spark allows only where its own setting is on."""

    @classmethod
    def name(cls) -> str:
        return "rank_rows"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        kind = _FilteringReader if self.options.get("pushFilters") == "true" else _Reader
        return kind(self.options["path"], _whole(self.options.get("maxBytes"), 0, "maxBytes"))


class RankScans(DataSource):
    """Format rank_scans: for each file of path its first maxMatches lines with a field that is hostReversed or ends in a dot and it."""

    @classmethod
    def name(cls) -> str:
        return "rank_scans"

    def schema(self) -> str:
        return SCANS

    def reader(self, schema) -> DataSourceReader:
        budget, most = self.options.get("maxBytes", str(MAX_BYTES)), self.options.get("maxMatches", str(MAX_MATCHES))
        return _Scanner(self.options["path"], _whole(budget, 0, "maxBytes"), self.options["hostReversed"], _whole(most, 1, "maxMatches"))


def reversed_host(name: str) -> str:
    """www.a.example -> example.a, as functions.urls.reversed_host has it for columns."""
    return ".".join(reversed(name.strip().lower().removeprefix("www.").split(".")))


def rows(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """Rank files as a table (ROWS). Filters on host_reversed reach the reader where spark.sql.python.filterPushdown.enabled is on."""
    spark.dataSource.register(RankRows)
    reader = spark.read.format("rank_rows").option("pushFilters", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower())
    return (reader if max_bytes is None else reader.option("maxBytes", max_bytes)).load(path)


def scans(spark: SparkSession, path: str, domain: str, max_bytes: int = MAX_BYTES, max_matches: int = MAX_MATCHES) -> DataFrame:
    """For each rank file (SCANS): the first lines of a domain, compressed bytes read, and whether the budget ends before the file may do."""
    spark.dataSource.register(RankScans)
    return spark.read.format("rank_scans").option("maxBytes", max_bytes).option("maxMatches", max_matches).option("hostReversed", reversed_host(domain)).load(path)


def write(ranked: DataFrame, path: str, files: int) -> None:
    """ranked(harmonic_rank, harmonic_value, pagerank_rank, pagerank_value, host_reversed) as gzip rank files of ranges of the rank."""
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    ranked.select(*names).repartitionByRange(files, "harmonic_rank").sortWithinPartitions("harmonic_rank").write.csv(path, sep="\t", compression="gzip", quote="", nullValue="", emptyValue="")
