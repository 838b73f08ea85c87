"""Sequence tiles read by byte range.

The index gives the byte offset of every chromosome, so the plan lists (chromosome, tile
range) partitions and each task seeks to its own bytes.  No task reads a whole chromosome
and the driver reads the index only.

``write_sequence_tiles`` writes tiles the same way: every task lays its tiles out one line each
in a file of its own and reports where each run of tiles begins; the driver writes these places
as the index.  ``read_sequence_parts`` reads them back by byte range.  Files of failed attempts
are in no index and never read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..operators.sequence import TILE_BP


def _open(path: str):
    from pyarrow import fs

    if "://" in path:
        filesystem, inner = fs.FileSystem.from_uri(path)
    else:
        filesystem, inner = fs.LocalFileSystem(), path
    return filesystem.open_input_file(inner)


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _create(path: str):
    filesystem, inner = _filesystem(path)
    filesystem.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return filesystem.open_output_stream(inner)


@dataclass
class TileRange(InputPartition):
    chrom: str
    length: int
    offset: int
    linebases: int
    linewidth: int
    first_tile: int
    last_tile: int  # exclusive


class TileReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.index = options.get("index", self.path + ".fai")
        self.tile_bp = int(options.get("tile_bp", TILE_BP))
        self.per_task = max(1, int(options.get("tiles_per_task", 256)))

    def partitions(self):
        with _open(self.index) as handle:
            rows = handle.read().decode().splitlines()
        out = []
        for row in rows:
            if not row.strip():
                continue
            name, length, offset, bases, width = row.split("\t")[:5]
            tiles = -(-int(length) // self.tile_bp)
            for first in range(0, tiles, self.per_task):
                out.append(
                    TileRange(
                        name, int(length), int(offset), int(bases), int(width),
                        first, min(first + self.per_task, tiles),
                    )
                )
        return out

    def read(self, part: TileRange):
        lo = max(part.first_tile * self.tile_bp - 1, 0)
        hi = min(part.last_tile * self.tile_bp + 1, part.length)

        def byte_of(base: int) -> int:
            return part.offset + base // part.linebases * part.linewidth + base % part.linebases

        with _open(self.path) as handle:
            handle.seek(byte_of(lo))
            raw = handle.read(byte_of(hi - 1) + 1 - byte_of(lo))
        seq = raw.decode().replace("\n", "").replace("\r", "").upper()
        if len(seq) != hi - lo:
            raise ValueError(f"{part.chrom}: expected {hi - lo} bases, read {len(seq)}")
        for tile in range(part.first_tile, part.last_tile):
            start = tile * self.tile_bp
            end = min(start + self.tile_bp, part.length)
            left = seq[start - 1 - lo] if start > 0 else "N"
            right = seq[end - lo] if end < part.length else "N"
            yield part.chrom, tile, start, left + seq[start - lo : end - lo] + right


#: Name of the index that a writer leaves beside its files.
PARTS_INDEX = "parts.tsv"


@dataclass
class Segment:
    """A run of tiles in one file: ``n`` bases of a chromosome from ``start``, a line per tile."""

    chrom: str
    start: int
    n: int
    file: str
    offset: int
    linebases: int

    def byte_of(self, base: int) -> int:
        own = base - self.start
        return self.offset + own // self.linebases * (self.linebases + 1) + own % self.linebases


@dataclass
class Written(WriterCommitMessage):
    segments: list


class TileWriter(DataSourceWriter):
    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.tile_bp = int(options.get("tile_bp", TILE_BP))

    def write(self, rows):
        name = f"part-{uuid.uuid4().hex}.fa"
        segments, at, out = [], 0, None
        for row in rows:
            own = row.seq[1:-1]
            if len(own) > self.tile_bp or row.tile_start != row.tile * self.tile_bp:
                raise ValueError(f"{row.chrom}: tile {row.tile} does not lie on a grid of {self.tile_bp} bases")
            if out is None:
                out = _create(f"{self.path}/{name}")
            last = segments[-1] if segments else None
            follows = (
                last is not None and last.chrom == row.chrom and last.start + last.n == row.tile_start and last.n % self.tile_bp == 0
            )
            if not follows:
                head = f">{row.chrom}:{row.tile_start}\n".encode()
                out.write(head)
                at += len(head)
                segments.append(Segment(row.chrom, row.tile_start, 0, name, at, self.tile_bp))
            segments[-1].n += len(own)
            out.write(own.encode() + b"\n")
            at += len(own) + 1
        if out is not None:
            out.close()
        return Written(segments)

    def commit(self, messages):
        """The index of all runs: as long as tasks and chromosomes, not as bases."""
        found = sorted((s for m in messages if m is not None for s in m.segments), key=lambda s: (s.chrom, s.start))
        with _create(f"{self.path}/{PARTS_INDEX}") as out:
            for s in found:
                out.write(f"{s.chrom}\t{s.start}\t{s.n}\t{s.file}\t{s.offset}\t{s.linebases}\n".encode())

    def abort(self, messages):
        """Nothing to undo: without an index the files are not read."""


@dataclass
class PartRange(InputPartition):
    segment: Segment
    first: int  # bases
    last: int  # exclusive
    left: Segment | None  # where the base before and the base behind are
    right: Segment | None


class PartsReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.per_task = max(1, int(options.get("tiles_per_task", 256)))

    def partitions(self):
        with _open(f"{self.path}/{PARTS_INDEX}") as handle:
            rows = [x.split("\t") for x in handle.read().decode().splitlines()]
        segments = [Segment(c, int(start), int(n), file, int(offset), int(bases)) for c, start, n, file, offset, bases in rows]
        ends = {(s.chrom, s.start + s.n): s for s in segments}
        starts = {(s.chrom, s.start): s for s in segments}
        out = []
        for s in segments:
            step = self.per_task * s.linebases
            for first in range(s.start, s.start + s.n, step):
                last = min(first + step, s.start + s.n)
                left = s if first > s.start else ends.get((s.chrom, s.start))
                right = s if last < s.start + s.n else starts.get((s.chrom, last))
                out.append(PartRange(s, first, last, left, right))
        return out

    def _bases(self, segment: Segment, first: int, last: int) -> str:
        with _open(f"{self.path}/{segment.file}") as handle:
            handle.seek(segment.byte_of(first))
            raw = handle.read(segment.byte_of(last - 1) + 1 - segment.byte_of(first))
        return raw.decode().replace("\n", "").upper()

    def read(self, part: PartRange):
        s, width = part.segment, part.segment.linebases
        seq = self._bases(s, part.first, part.last)
        if len(seq) != part.last - part.first:
            raise ValueError(f"{s.chrom}: expected {part.last - part.first} bases, read {len(seq)}")
        before = self._bases(part.left, part.first - 1, part.first) if part.left else "N"
        behind = self._bases(part.right, part.last, part.last + 1) if part.right else "N"
        shown = before + seq + behind
        for at in range(part.first, part.last, width):
            end = min(at + width, part.last)
            yield s.chrom, at // width, at, shown[at - part.first : end - part.first + 2]


class SequenceTiles(DataSource):
    @classmethod
    def name(cls):
        return "sequence_tiles"

    def schema(self):
        return "chrom string, tile bigint, tile_start bigint, seq string"

    def reader(self, schema):
        return PartsReader(self.options) if self.options.get("layout") == "parts" else TileReader(self.options)

    def writer(self, schema, overwrite):
        return TileWriter(self.options)


def read_sequence_tiles(
    spark: SparkSession, fasta: str, tile_bp: int = TILE_BP, index: str | None = None, tiles_per_task: int = 256
) -> DataFrame:
    """Tiles (chrom, tile, tile_start, seq) of an indexed sequence file."""
    spark.dataSource.register(SequenceTiles)
    reader = (
        spark.read.format("sequence_tiles")
        .option("path", fasta)
        .option("tile_bp", tile_bp)
        .option("tiles_per_task", tiles_per_task)
    )
    return (reader.option("index", index) if index else reader).load()


def write_sequence_tiles(tiles: DataFrame, folder: str, tile_bp: int = TILE_BP) -> None:
    """Write tiles (chrom, tile, tile_start, seq with its two flanking bases) and their index to a new folder.

    Tiles are dealt out by ranges, so a task has runs of neighbours, and each task writes its own file.
    """
    tiles.sparkSession.dataSource.register(SequenceTiles)
    rows = tiles.select("chrom", F.col("tile").cast("bigint"), F.col("tile_start").cast("bigint"), "seq")
    (
        rows.repartitionByRange("chrom", "tile")
        .sortWithinPartitions("chrom", "tile")
        .write.format("sequence_tiles")
        .option("path", folder)
        .option("tile_bp", tile_bp)
        .mode("append")
        .save()
    )


def read_sequence_parts(spark: SparkSession, folder: str, tiles_per_task: int = 256) -> DataFrame:
    """Tiles of a folder of ``write_sequence_tiles``; flanking bases come from the neighbouring runs."""
    spark.dataSource.register(SequenceTiles)
    reader = spark.read.format("sequence_tiles").option("path", folder).option("layout", "parts")
    return reader.option("tiles_per_task", tiles_per_task).load()
