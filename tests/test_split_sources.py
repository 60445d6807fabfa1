"""Quoted CSV and archives, read by many tasks, against whole reads."""

import bz2
import csv
import io
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from letterlens.sources import archives, mail_csv
from letterlens.sources.mail import read_archives, read_mail_csv
from letterlens.sources.ordered import before_split, ordered_lines


@pytest.fixture
def small_splits(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")

    def split(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    yield split
    for k, v in kept.items():
        spark.conf.set(k, v)


def _quoted(x):
    return '"' + x.replace('"', '""') + '"'


def _csv(rows, end="\n"):
    return "file,message" + end + "".join(f"{a},{b}{end}" for a, b in rows)


def _mails(n, seed, end="\n"):
    rng = random.Random(seed)
    parts = ["plain words", 'said "yes"', end, ",", "", "é ñ", 'a ""quote""', f"{end}{end}From: x", "x" * 40, " lead", '"', f'",{end}']
    return [(f"box{i % 3}/{i}", _quoted("".join(rng.choices(parts, k=rng.randint(0, 9))))) for i in range(n)]


@pytest.mark.parametrize("size", [90, 1 << 20])
@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_quoted_csv_is_read_as_by_one_task(spark, tmp_path, small_splits, size, limit):
    small_splits(size)
    (tmp_path / "a.csv").write_text(_csv(_mails(40, 1)), newline="")
    (tmp_path / "b.csv").write_text(_csv([*_mails(15, 2), ("open/field", "unquoted"), ("empty", ""), ("quoted-empty", '""')]) + "\n\nlast/one,without end", newline="")
    (tmp_path / "c.csv").write_text("file,message\n", newline="")
    got = [r.value for r in mail_csv.csv_records(spark, str(tmp_path), limit).where("not first").collect()]
    want = spark.read.csv(str(tmp_path), header=True, multiLine=True, escape='"', quote='"')
    assert len(got) == want.count() == 59
    again = mail_csv.read_quoted_csv(spark, str(tmp_path))
    assert sorted(map(str, again.collect())) == sorted(map(str, want.collect()))
    if size == 90:  # a record that takes several splits is there once
        assert ordered_lines(spark, str(tmp_path)).select("file", "split").distinct().count() > 10


def test_a_message_longer_than_many_splits(spark, tmp_path, small_splits):
    small_splits(400)
    long = "line of a long message\n" * 200
    (tmp_path / "a.csv").write_text(_csv([("one", "short"), ("two", _quoted(long)), ("three", _quoted("end,\nof it"))]), newline="")
    got = {r.path: bytes(r.content).decode() for r in read_mail_csv(spark, str(tmp_path)).collect()}
    assert got == {"one": "short", "two": long, "three": "end,\nof it"}


def test_carriage_returns(spark, tmp_path, small_splits):
    small_splits(300)
    (tmp_path / "a.csv").write_text(_csv(_mails(30, 4, "\r\n"), "\r\n"), newline="")
    # Messages keep their bytes; Spark's own reader turns CR LF into LF within quotes, too.
    want = [(a, b or None) for a, b in csv.reader(io.StringIO((tmp_path / "a.csv").read_bytes().decode(), newline=""))][1:]
    assert sorted(map(str, map(tuple, mail_csv.read_quoted_csv(spark, str(tmp_path)).collect()))) == sorted(map(str, want))


def test_sums_before_splits(spark):
    rows = spark.createDataFrame([("a", 0, 3), ("a", 64, 4), ("a", 128, 5), ("b", 0, 7)], "file string, split long, n long")
    assert sorted(map(tuple, before_split(rows, "n").collect())) == [("a", 0, 0), ("a", 64, 3), ("a", 128, 7), ("b", 0, 0)]


def _archive(members, level=1, kind=tarfile.GNU_FORMAT):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=kind) as tar:
        folder = tarfile.TarInfo("mail")
        folder.type = tarfile.DIRTYPE
        tar.addfile(folder)
        for name, content in members:
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
        link = tarfile.TarInfo("link")
        link.type, link.linkname = tarfile.SYMTYPE, "mail"
        tar.addfile(link)
    return bz2.compress(out.getvalue(), level) if level else out.getvalue()


def _members(n, seed):
    rng = random.Random(seed)
    out = [(f"mail/{i:05d}", rng.randbytes(rng.choice([0, 1, 100, 511, 512, 513, 3_000, 9_000]))) for i in range(n)]
    nested = _archive([("inner/1", b"within"), ("inner/2", b"\n" * 600)], 0)
    return [*out, ("nested.tar", nested), ("long/" + "n" * 180, b"long name"), ("ünïcode", b"bytes \xff\xfe\r\n"), ("lines", b"\n\n\n"), ("big", rng.randbytes(300_000))]


@pytest.mark.parametrize("kind,piece,cell,limit", [(tarfile.GNU_FORMAT, 1 << 20, 1 << 20, 1 << 20), (tarfile.PAX_FORMAT, 700, 2_000, 0), (tarfile.GNU_FORMAT, 5_000, 512, 1 << 20)])
def test_archives_are_read_as_by_one_task(spark, tmp_path, small_splits, kind, piece, cell, limit):
    small_splits(50_000)
    want = {}
    for name, seed, level in (("a.tar.bz2", 1, 1), ("b.tar.bz2", 2, 9), ("c.tar", 3, 0)):
        own = _members(80, seed)
        (tmp_path / name).write_bytes(_archive(own, level, kind))
        want |= {f"{name}#{n}": c for n, c in own}
    got = read_archives(spark, str(tmp_path), piece, cell, limit).collect()
    assert len(got) == len(want)
    assert {r.path.rsplit("/", r.path.split("#")[1].count("/") + 1)[-1] if "#" not in r.path else r.path[r.path.rindex("/", 0, r.path.index("#")) + 1:]: bytes(r.content) for r in got} == want
    splits = archives.pieces(spark, str(tmp_path), piece).groupBy("file").agg(F.count_distinct("split").alias("n")).collect()
    assert max(r.n for r in splits if r.file.endswith("a.tar.bz2")) > 3  # one archive, several tasks


def test_pieces_are_bounded(spark, tmp_path, small_splits):
    small_splits(1 << 20)
    (tmp_path / "a.tar.bz2").write_bytes(_archive([(f"m{i}", b"line\n" * 5_000) for i in range(200)]))
    sizes = archives.pieces(spark, str(tmp_path), 100_000).agg(F.max(F.octet_length("data")), F.count("*")).first()
    assert sizes[0] < 110_000 and sizes[1] > 40


def test_a_broken_archive_gives_what_is_before_the_break(spark, tmp_path):
    whole = _archive([(f"m{i}", bytes([i]) * 700) for i in range(30)], 0)
    (tmp_path / "a.tar").write_bytes(whole[:len(whole) // 2])
    got = sorted(r.path.split("#")[1] for r in read_archives(spark, str(tmp_path)).collect())
    assert 5 < len(got) < 30


def test_written_archives_come_back(spark, tmp_path):
    rows = [(f"m{i}", (f"text {i}\n" * (i * 7)).encode()) for i in range(1, 60)]
    archives.write_archives(spark.createDataFrame(rows, "name string, content binary").repartition(3), str(tmp_path / "out"))
    got = {r.path.split("#")[1]: bytes(r.content) for r in read_archives(spark, str(tmp_path / "out")).collect()}
    assert got == dict(rows)
    part = next((tmp_path / "out").glob("*.bz2"))
    with tarfile.open(fileobj=io.BytesIO(bz2.decompress(part.read_bytes()))) as tar:
        assert all(tar.extractfile(m).read() == dict(rows)[m.name] for m in tar)
