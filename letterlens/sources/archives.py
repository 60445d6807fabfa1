"""Archives of mail (tar, compressed or not) read by many tasks, with memory bounded by a member and not by an archive.

Spark's text reader cuts a bzip2 file at its compressed blocks, so the blocks of one archive are decompressed in parallel;
line feeds are as good a separator as any for bytes. Decompressed bytes are written once, in pieces. The lengths of a
split's pieces, summed over the splits before it, place every piece in the archive. Members' headers stand at multiples of
512 and carry a check sum: each task looks for them in its pieces. What looks like a header within a member's contents is
told apart by walking the candidates in order, a few numbers each. Members then take their slices from the pieces that
they overlap, found by an equi-join on cells of offsets.
"""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterlens.shared import BROADCAST_BYTES, new_folder, sized_side, write_once
from letterlens.sources.ordered import before_split, ordered_lines

BLOCK = 512
#: Bytes of a piece, which a task holds at a time, and of a cell of offsets.
PIECE = 1 << 20
CELL = 1 << 20
#: Types of tar entries that describe the entry after them, that are files, and that have no contents.
DESCRIBES, FILES, NO_CONTENTS = (b"L", b"K", b"x", b"X"), (b"0", b"\0", b"7"), (b"1", b"2", b"3", b"4", b"5", b"6")


def pieces(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """file, split, at (from the split's begin) and data: the decompressed bytes in pieces; a split ends a piece."""
    def glued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, at, held, size = None, 0, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([place[0]]), pa.array([place[1]], pa.int64()), pa.array([at], pa.int64()), pa.array([b"".join(held)], pa.binary())], ["file", "split", "at", "data"])

        for batch in batches:
            for file, split, value in zip(*(batch.column(c).to_pylist() for c in ("file", "split", "value")), strict=True):
                if place != (file, split):
                    if held:
                        yield out()
                    place, at, held, size = (file, split), 0, [], 0
                held += (value, b"\n")
                size += len(value) + 1
                if size >= piece:
                    yield out()
                    at, held, size = at + size, [], 0
        if held:
            yield out()

    return ordered_lines(spark, path).mapInArrow(glued, "file string, split long, at long, data binary")


def _headers_in(data: bytes, first: int) -> list[tuple[int, int, bytes]]:
    """Offset, end and type of what has a header's check sum; data begins at offset `first`, a multiple of BLOCK, and is whole blocks."""
    blocks = np.frombuffer(data, np.uint8).reshape(-1, BLOCK)
    field = blocks[:, 148:156]
    plausible = ((field == 32) | (field == 0) | ((field >= 48) & (field <= 55))).all(1) & ((field >= 49) & (field <= 55)).any(1)
    out = []
    for k in np.flatnonzero(plausible).tolist():
        try:
            info = tarfile.TarInfo.frombuf(blocks[k].tobytes(), "utf-8", "surrogateescape")
        except tarfile.HeaderError:
            continue
        kind, size = info.type, 0 if info.type in NO_CONTENTS else info.size
        at = first + k * BLOCK
        out.append((at, at + BLOCK + -(-size // BLOCK) * BLOCK, kind))
    return out


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Headers of whole blocks; of blocks that a piece has a part of, the part."""
    names = ["file", "at", "until", "kind", "data"]
    for batch in batches:
        rows = []
        for file, at, data in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "data")), strict=True):
            begin, end = -at % BLOCK, (at + len(data)) % BLOCK
            if begin >= len(data):
                rows.append((file, at, None, None, data))
                continue
            if begin:
                rows.append((file, at, None, None, data[:begin]))
            whole = len(data) - end
            if whole > begin:
                rows += [(file, *h, None) for h in _headers_in(data[begin:whole], at + begin)]
            if end:
                rows.append((file, at + whole, None, None, data[whole:]))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of each file, its candidates in order: those that begin where an entry may, with what describes them."""
    file, until, begin = None, 0, None
    for batch in batches:
        out = []
        for f, at, end, kind in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "until", "kind")), strict=True):
            if f != file:
                file, until, begin = f, 0, None
            if at < until:
                continue  # within an entry's contents
            until = end
            if kind in DESCRIBES:
                begin = at if begin is None else begin
                continue
            if kind in FILES:
                out.append((file, at if begin is None else begin, end))
            begin = None
        columns = list(zip(*out, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["file", "begin", "end"])


def entries(placed: DataFrame) -> DataFrame:
    """file, begin and end of each file in the archives, with the headers that describe it. placed: file, at (in the archive), data."""
    schema = "file string, at long, until long, kind binary, data binary"
    found = write_once(placed.mapInArrow(_find, schema), new_folder(placed.sparkSession, "tar-headers"))
    parts = found.where("data is not null").groupBy("file", F.expr(f"at div {BLOCK}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", "data"))).alias("parts"))
    block = F.aggregate("parts", F.lit(None).cast("binary"), lambda acc, p: F.when(acc.isNull(), p.data).otherwise(F.concat(acc, p.data)))
    seams = parts.select("file", (F.col("block") * BLOCK).alias("at"), block.alias("data")).where(F.octet_length("data") == BLOCK)
    headers = found.where("data is null").unionByName(seams.mapInArrow(_find, schema).where("data is null"))
    # One row of a few numbers for an entry; of a file's rows a task holds none but the last.
    return headers.select("file", "at", "until", "kind").repartition("file").sortWithinPartitions("file", "at").mapInArrow(_walk, "file string, begin long, end long")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Name and contents of the one file that each small archive has."""
    for batch in batches:
        for file, data in zip(batch.column("file").to_pylist(), batch.column("data").to_pylist(), strict=True):
            try:
                with tarfile.open(fileobj=io.BytesIO(data), mode="r:") as tar:
                    member = next((m for m in tar if m.isfile()), None)
                    content = None if member is None else tar.extractfile(member).read()
            except tarfile.ReadError:
                continue  # the archive breaks off in this entry
            if content is not None:
                yield pa.RecordBatch.from_arrays([pa.array([f"{file}#{member.name}"]), pa.array([content], pa.binary())], ["path", "content"])


def read_archives(spark: SparkSession, path: str, piece: int = PIECE, cell: int = CELL, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The members of .tar, .tar.bz2 (or otherwise compressed) archives: path (archive#member) and content.

    Names are those of the archive, long ones included. Directories and links are left out; contents may hold archives
    of their own. An archive that breaks off gives the members before the break. Empty files are passed over by Spark's readers.
    """
    cut = write_once(pieces(spark, path, piece), new_folder(spark, "tar-pieces"))
    starts = before_split(cut.groupBy("file", "split").agg(F.sum(F.octet_length("data").cast("long")).alias("bytes")), "bytes")
    placed = cut.join(sized_side(starts, "file", limit=limit), ["file", "split"]).select("file", (F.col("before") + F.col("at")).alias("at"), "data")
    members = write_once(entries(placed), new_folder(spark, "tar-entries"))
    cells = lambda first, last: F.explode(F.sequence(F.expr(f"{first} div {cell}"), F.expr(f"{last} div {cell}")))
    wanted = members.withColumn("cell", cells("begin", "(end - 1)"))
    stop = F.col("at") + F.octet_length("data")
    # A piece and a member that share several cells meet in the first of them; shares come in the order of the archive.
    shares = (placed.withColumn("stop", stop).withColumn("cell", cells("at", "(stop - 1)")).join(sized_side(wanted, "file", limit=limit), ["file", "cell"])
              .where(F.col("cell") == F.expr(f"greatest(at, begin) div {cell}")).where("at < end and stop > begin")
              .select("file", "begin", "end", "at", "stop", F.substring("data", (F.greatest(F.col("begin") - F.col("at"), F.lit(0)) + 1).cast("int"), (F.least("end", "stop") - F.greatest("begin", "at")).cast("int")).alias("data")))
    alone = (F.col("at") <= F.col("begin")) & (F.col("stop") >= F.col("end"))
    parts = shares.where(~alone).groupBy("file", "begin").agg(F.array_sort(F.collect_list(F.struct("at", "data"))).alias("parts"))
    whole = F.aggregate("parts", F.lit(None).cast("binary"), lambda acc, p: F.when(acc.isNull(), p.data).otherwise(F.concat(acc, p.data)))
    return shares.where(alone).select("file", "data").unionByName(parts.select("file", whole.alias("data"))).mapInArrow(_unpacked, "path string, content binary")


def write_archives(members: DataFrame, path: str) -> None:
    """members (name, content) as tar archives in bzip2, one a partition.

    An entry's padding ends with a line feed, as does contents that need none, so that Spark's text writer, which ends
    each row with one, gives the archive's bytes.
    """
    def entry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                content = content if content.endswith(b"\n") or len(content) % BLOCK else content + b"\n"
                info = tarfile.TarInfo(name)
                info.size = len(content)
                data = info.tobuf(tarfile.GNU_FORMAT) + content + b"\0" * (-len(content) % BLOCK)
                out.append(data[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    rows = members.select("name", "content").mapInArrow(entry, "value binary")
    rows.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "bzip2").text(path)
