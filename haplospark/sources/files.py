"""Files of the formats as data sources: after ``register(spark)``, ``spark.read.format("haplospark.bed").load(path)`` and the like.

A file is read in byte ranges, a task each; a line or record belongs to the range in which it begins. With the option ``keys``
(a JSON list) only rows with these values of the format's key column are made; that is decided before the rest of a line is
split. It is an option and not a pushed filter, as Spark 4.1 keeps what a filter pushed with the loaded relation: another
DataFrame over the same load would then read the first one's rows. Paths may be files or folders, local or of any file system
that pyarrow knows. The readers of ``readers`` do the same by Spark's own text source.
"""

from __future__ import annotations

import gzip
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .readers import HITS, INTERVALS

#: Bytes of a range, lines of a batch, and about how many bytes of sequences a batch has.
RANGE_BYTES, BATCH_LINES, BATCH_BYTES = 32 << 20, 8192, 8 << 20
GENOTYPE = "struct<gt: int, dp: int, gq: int>"
SITE = "contig string, pos int, ref string, alts array<string>, qual double"
LONG_GENOTYPES = SITE + ", sample_id string, gt int, dp int, gq int"


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def _located(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def data_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files below a folder in order; names that begin with ``_`` or ``.`` are no data."""
    from pyarrow import fs

    system, root = _located(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
    hidden = lambda p: any(part[:1] in "_." for part in p[len(root) :].split("/") if part)
    return sorted((f.path, f.size) for f in found if f.is_file and f.size and not hidden(f.path))


def _opened(system, path: str) -> io.BufferedReader:
    return io.BufferedReader(system.open_input_file(path), 1 << 20)


def lines_of(system, part: Range) -> Iterator[bytes]:
    """The lines that begin in a range, without their ends. Compressed files have one range."""
    if part.path.endswith(".gz"):
        with gzip.open(_opened(system, part.path)) as f:
            yield from (line.rstrip(b"\r\n") for line in f)
        return
    with _opened(system, part.path) as f:
        at = part.start
        if at:
            f.seek(at - 1)
            at += len(f.readline()) - 1
        while at < part.end and (line := f.readline()):
            at += len(line)
            yield line.rstrip(b"\r\n")


class _Reader(DataSourceReader):
    """Ranges of files -> Arrow batches of the source's rows."""

    def __init__(self, source: _Source, schema: StructType) -> None:
        self.source, self.schema = source, schema
        keys = source.options.get("keys")
        self.wanted = None if keys is None else {str(k).encode() for k in json.loads(keys)}

    def partitions(self) -> list[Range]:
        size = int(self.source.options.get("rangeBytes", RANGE_BYTES))
        files = data_files(self.source.options["path"])
        return [Range(p, a, min(a + size, n)) for p, n in files for a in range(0, n, n if p.endswith(".gz") else size)]

    def read(self, partition: Range | None) -> Iterator:
        if partition is None:  # no ranges
            return
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        for batch in self.source.batches(self.source.rows(partition, self.wanted)):
            columns = zip(*batch, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class _Source(DataSource):
    """A format: its name, key column, and the rows of a range, of which only those with wanted keys are made."""

    short, key, batch_rows = "", "contig", BATCH_LINES

    @classmethod
    def name(cls) -> str:
        return f"haplospark.{cls.short}"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self, schema)

    def batches(self, rows: Iterator[tuple]) -> Iterator[list[tuple]]:
        while batch := list(islice(rows, self.batch_rows)):
            yield batch

    def rows(self, part: Range, wanted: set[bytes] | None) -> Iterator[tuple]:
        system, _ = _located(self.options["path"])
        for line in lines_of(system, part):
            if line.strip() and not line.startswith(b"#") and (wanted is None or line.split(b"\t", 1)[0] in wanted):
                yield self.row(line.decode().split("\t"))

    def row(self, fields: list[str]) -> tuple:
        raise NotImplementedError


class IntervalFiles(_Source):
    """BED: contig, start, end, name."""

    short = "bed"

    def schema(self) -> str:
        return INTERVALS

    def row(self, fields: list[str]) -> tuple:
        return fields[0], int(fields[1]), int(fields[2]), fields[3] if len(fields) > 3 else None


class DepthFiles(_Source):
    """contig, 1-based position, depth -> contig, pos (0-based), depth."""

    short = "depth"

    def schema(self) -> str:
        return "contig string, pos int, depth bigint"

    def row(self, fields: list[str]) -> tuple:
        contig, pos, depth = fields
        return contig, int(pos) - 1, int(depth)


class HitFiles(_Source):
    """Tabular hits of 11 columns; a line of another width is an error."""

    short, key = "hits", "query"
    _types = tuple({"string": str, "double": float, "int": int}[x.split()[1]] for x in HITS.split(","))

    def schema(self) -> str:
        return HITS

    def row(self, fields: list[str]) -> tuple:
        if len(fields) != len(self._types):
            raise ValueError(f"a hit has {len(self._types)} columns, not {len(fields)}")
        return tuple(t(v) for t, v in zip(self._types, fields, strict=True))


class GenotypeFiles(_Source):
    """VCF: contig, pos (1-based), ref, alts, qual and, by the header, a column per sample with gt (0, 1 or NULL), dp and gq.

    With the option ``long`` a row per site and sample instead, as ``readers.parse_vcf`` gives them: for any number of samples,
    where a column each would make a plan that grows with them.
    """

    short, batch_rows = "vcf", 1024

    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.long = options.get("long", "false").lower() == "true"
        self.names: list[str] = []

    def reader(self, schema: StructType) -> DataSourceReader:
        if self.long:
            self.names, self.batch_rows = self.samples(), BATCH_LINES
        return super().reader(schema)

    def rows(self, part: Range, wanted: set[bytes] | None) -> Iterator[tuple]:
        sites = super().rows(part, wanted)
        if not self.long:
            return sites
        return ((*site[:5], name, *call) for site in sites for name, call in zip(self.names, site[5:], strict=True))

    def samples(self) -> list[str]:
        """The sample names of the first header line; only the heads of files are read."""
        system, _ = _located(self.options["path"])
        for path, size in data_files(self.options["path"]):
            for line in lines_of(system, Range(path, 0, size)):
                if line.startswith(b"#CHROM"):
                    return line.decode().split("\t")[9:]
                if line and not line.startswith(b"#"):
                    break
        return []

    def schema(self) -> str:
        if self.long:
            return LONG_GENOTYPES
        quoted = [f"`{s.replace('`', '``')}` {GENOTYPE}" for s in self.samples()]
        return ", ".join([SITE, *quoted])

    def row(self, fields: list[str]) -> tuple:
        keys = fields[8].split(":") if len(fields) > 8 else []
        at = [keys.index(k) if k in keys else -1 for k in ("GT", "DP", "GQ")]
        out = [fields[0], int(fields[1]), fields[3], fields[4].split(","), _number(fields[5], float)]
        known: dict = {}  # equal values are parsed once per line
        for value in fields[9:]:
            call = known.get(value)
            if call is None:
                v = value.split(":")
                gt, dp, gq = (v[i] if 0 <= i < len(v) else "" for i in at)
                call = int(gt) if gt in ("0", "1") else None, _number(dp, int), _number(gq, int)
                call = known[value] = call if self.long else dict(zip(("gt", "dp", "gq"), call, strict=True))
            out.append(call)
        return tuple(out)


def _number(text: str, kind: type):
    try:
        return kind(text)
    except ValueError:
        return None


class SequenceFiles(_Source):
    """FASTA: sample_id (the first word of a header), seq in capitals. A record belongs to the range in which its header begins."""

    short, key = "fasta", "sample_id"

    def schema(self) -> str:
        return "sample_id string, seq string"

    def batches(self, rows: Iterator[tuple]) -> Iterator[list[tuple]]:
        batch, size = [], 0
        for row in rows:
            batch.append(row)
            size += len(row[1])
            if size >= BATCH_BYTES or len(batch) == BATCH_LINES:
                yield batch
                batch, size = [], 0
        if batch:
            yield batch

    def rows(self, part: Range, wanted: set[bytes] | None) -> Iterator[tuple]:
        system, _ = _located(self.options["path"])
        with gzip.open(_opened(system, part.path)) if part.path.endswith(".gz") else _opened(system, part.path) as f:
            at, name, pieces = part.start, None, []
            if at:
                f.seek(at - 1)
                at += len(f.readline()) - 1
            ends = float("inf") if part.path.endswith(".gz") else part.end
            while line := f.readline():
                begins, at = at, at + len(line)
                if line.startswith(b">"):
                    if name is not None:
                        yield name.decode(), b"".join(pieces).decode().upper()
                    if begins >= ends:
                        return
                    word = (line[1:].split() or [b""])[0]
                    name, pieces = (word if wanted is None or word in wanted else None), []
                elif name is not None:
                    pieces.append(b"".join(line.split()))
                elif begins >= ends:
                    return
            if name is not None:
                yield name.decode(), b"".join(pieces).decode().upper()


FORMATS = (IntervalFiles, DepthFiles, HitFiles, GenotypeFiles, SequenceFiles)


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session."""
    for source in FORMATS:
        spark.dataSource.register(source)


def open_files(spark: SparkSession, short: str, path: str, keys: list[str] | None = None, **options: str) -> DataFrame:
    """The rows of the files at a path; with keys only those that have one of them."""
    register(spark)
    if keys is not None:
        options["keys"] = json.dumps(keys)
    return spark.read.format(f"haplospark.{short}").options(**options).load(path)


def long_genotypes(wide: DataFrame) -> DataFrame:
    """A row per site with a column per sample -> a row per site and sample, as ``readers.parse_vcf`` gives them.

    The plan has an expression per sample; files of many samples are read with the option ``long``.
    """
    from pyspark.sql import functions as F

    site = ["contig", "pos", "ref", "alts", "qual"]
    samples = wide.columns[len(site) :]
    quoted = lambda s: f"`{s.replace('`', '``')}`"
    each = F.array(*[F.struct(F.lit(s).alias("sample_id"), F.col(quoted(s)).alias("g")) for s in samples])
    return wide.select(*site, F.explode(each).alias("x")).select(*site, "x.sample_id", "x.g.gt", "x.g.dp", "x.g.gq")
