"""Lines, archives and digests of files against Python's own readers."""

import gzip
import hashlib
import random
import resource
import tarfile

import pytest
from pyspark.sql import functions as F

from tidemark.operators import integrity
from tidemark.sources import archive, lines


def test_line_positions(spark, tmp_path):
    """Several files, plain and gzip, with both line ends and blank lines, in many splits."""
    import duckdb

    rng = random.Random(4)
    made = {}
    for k, name in enumerate(("a.txt", "b.txt", "c.txt.gz", "d.txt")):
        rows = [rng.choice(["", "  ", "\t"]) if rng.random() < 0.05 else f"line {k} {rng.randrange(10**6)} é" for _ in range(rng.choice([0, 1, 900, 4000]) if k else 3000)]
        raw = "".join(x + rng.choice(["\n", "\r\n"]) for x in rows).encode()
        raw = raw[:-1] if k == 3 and rows else raw  # no end of line at the end
        (tmp_path / name).write_bytes(gzip.compress(raw) if name.endswith("gz") else raw)
        made[name] = rows
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {mode: [(r.file.rsplit("/", 1)[1], r.pos, r.value.rstrip("\r")) for r in lines.line_positions(spark, str(tmp_path), mode).collect()] for mode in ("keep", "skip")}
        across = sorted((r.pos, r.value) for r in lines.line_positions(spark, str(tmp_path), "keep", across=True).collect())
        with pytest.raises(Exception, match="blank line"):
            lines.line_positions(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    wanted = sorted((f, k, x) for f, rows in made.items() for k, x in enumerate(rows))
    assert sorted(got["keep"]) == wanted and sorted(got["skip"]) == [x for x in wanted if x[2].strip()]
    assert [x for _, x in across] == [x for f in sorted(made) for x in made[f]] and [p for p, _ in across] == list(range(len(wanted)))
    text = duckdb.sql(f"SELECT content FROM read_text('{tmp_path}/a.txt')").fetchall()[0][0]
    assert [x[2] for x in sorted(got["keep"]) if x[0] == "a.txt"] == [x.rstrip("\r") for x in text.split("\n")[:-1]]
    with pytest.raises(ValueError, match="blank lines"):
        lines.line_positions(spark, str(tmp_path), "drop")


@pytest.mark.parametrize("form", [tarfile.USTAR_FORMAT, tarfile.GNU_FORMAT, tarfile.PAX_FORMAT])
def test_archive_index(spark, tmp_path, form):
    rng = random.Random(form)
    names = [f"file{k}.json.gz" for k in range(20)] + ["deep/" * 15 + "x" * 60] + ([] if form == tarfile.USTAR_FORMAT else ["y" * 180, "é" * 70])
    for k in range(3):
        with tarfile.open(tmp_path / f"{k}.tar", "w", format=form) as out:
            folder = tarfile.TarInfo("folder")
            folder.type = tarfile.DIRTYPE
            out.addfile(folder)
            for name in names:
                raw = rng.randbytes(rng.choice([0, 1, 511, 512, 513, 5000]))
                info = tarfile.TarInfo(f"{k}/{name}")
                info.size = len(raw)
                out.addfile(info, __import__("io").BytesIO(raw))
    got = archive.archive_index(spark, f"{tmp_path}/*.tar").collect()
    wanted = []
    for k in range(3):
        with tarfile.open(tmp_path / f"{k}.tar") as own:
            wanted += [(f"{k}.tar", m.name, m.offset, m.offset_data, m.size) for m in own.getmembers()]
    assert sorted((r.archive.rsplit("/", 1)[1], r.name, r.header_offset, r.data_offset, r["size"]) for r in got) == sorted(wanted)
    assert {r.kind for r in got} == {"0", "5"}


def test_index_goes_on_and_breaks(spark, tmp_path):
    def add(mode, names):
        with tarfile.open(tmp_path / "a.tar", mode) as out:
            for name in names:
                info = tarfile.TarInfo(name)
                info.size = 700
                out.addfile(info, __import__("io").BytesIO(b"z" * 700))

    add("w", ["one", "two"])
    begun = archive.archive_index(spark, str(tmp_path / "a.tar"))
    begun = spark.createDataFrame(begun.collect(), archive.INDEX)
    add("a", ["three", "four"])
    more = archive.archive_index(spark, str(tmp_path / "a.tar"), begun).collect()
    assert [(r.name, r.header_offset) for r in more] == [("three", 3072), ("four", 4608)]
    raw = bytearray((tmp_path / "a.tar").read_bytes())
    raw[1536 + 20] ^= 1  # within the second header
    (tmp_path / "bad.tar").write_bytes(raw)
    (tmp_path / "cut.tar").write_bytes(raw[:1000])
    for name, said in (("bad.tar", "checksum"), ("cut.tar", "past the archive's end")):
        with pytest.raises(Exception, match=said):
            archive.archive_index(spark, str(tmp_path / name)).collect()


def test_archives_are_written_as_they_are_read(spark, tmp_path):
    rows = [(f"s{k % 3}", k, f"m{k}", bytes([k]) * (k * 37)) for k in range(60)]
    table = spark.createDataFrame(rows, "archive string, place int, name string, data binary")
    assert {(r.archive, r.members) for r in archive.write_archives(table, str(tmp_path / "out")).collect()} == {("s0", 20), ("s1", 20), ("s2", 20)}
    with tarfile.open(tmp_path / "out" / "s1.tar") as own:
        assert [(m.name, own.extractfile(m).read()) for m in own.getmembers()] == [(n, d) for a, _, n, d in rows if a == "s1"]


def test_hashes_of_files_of_any_size(spark, tmp_path):
    """A large sparse file in the memory of a piece, and small files, by either way."""
    for k in range(1, 5):
        (tmp_path / f"{k}.bin").write_bytes(random.Random(k).randbytes(k * 1000))
    for whole in (0, 2500, 10**9):
        got = {(r.path.rsplit("/", 1)[1], r["size"], r.sha256) for r in integrity.file_hashes(spark, str(tmp_path), whole).collect()}
        assert got == {(f"{k}.bin", k * 1000, hashlib.sha256(random.Random(k).randbytes(k * 1000)).hexdigest()) for k in range(1, 5)}
    big = tmp_path / "big"
    with open(big, "wb") as f:
        f.truncate(3 << 30)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = integrity.hash_in_pieces(str(big))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100 * 1024  # kilobytes
    state = hashlib.sha256()
    for _ in range(3 << 10):
        state.update(bytes(1 << 20))
    assert found == state.hexdigest()
    big.unlink()


def test_window_reads_few_files(spark, tmp_path):
    from tidemark.sources import layout

    rng = random.Random(2)
    rows = [(k, rng.randrange(100_000)) for k in range(5000)]
    path = str(tmp_path / "log")
    layout.lay_out(spark.createDataFrame(rows, "seq bigint, t bigint"), path, files=20)
    got = layout.read_window(spark, path, 40_000, 47_000)
    assert sorted(r.seq for r in got.collect()) == sorted(k for k, t in rows if 40_000 <= t < 47_000)
    every = spark.read.parquet(f"{path}/rows").inputFiles()
    assert len(every) == 20 and 1 <= len(got.inputFiles()) <= 4
    assert layout.read_window(spark, path, 10**6, 10**7).isEmpty()
    with pytest.raises(Exception, match="exists"):
        layout.lay_out(spark.createDataFrame(rows, "seq bigint, t bigint"), path)


def test_broken_order_is_an_error(spark, tmp_path):
    from tidemark.sources import layout

    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(k, 3 if k == 7 else k) for k in range(10)], "seq bigint, t bigint").coalesce(1)
    rows.write.parquet(f"{path}/rows")
    file = spark.read.parquet(f"{path}/rows").inputFiles()[0]
    ranges = spark.createDataFrame([(file, 0, 9, 10)], "file string, lo bigint, hi bigint, n bigint")
    ranges.write.parquet(f"{path}/ranges")
    with pytest.raises(ValueError, match="not in order"):
        layout.read_window(spark, path, 0, 5)
    assert layout.read_window(spark, path, 0, 5, checked=False).count() == 6
    ranges.union(spark.createDataFrame([("other", 4, 20, 1)], ranges.schema)).write.parquet(f"{path}/more/ranges")
    rows.where("seq < 5").write.parquet(f"{path}/more/rows")
    with pytest.raises(ValueError, match="ranges of time meet"):
        layout.check_order(spark, f"{path}/more", spark.read.parquet(f"{path}/more/rows"))


def test_json_paths_at_any_depth(spark):
    from tidemark.operators import profile

    texts = ['{"a": 1, "b": {"c": [1, 2.5, {"d": null}], "e": "x"}}', '{"a": "s", "b": []}', '{"a": {"a": {"a": true}}}', None]
    table = spark.createDataFrame([(t,) for t in texts], "value string").withColumn("path", F.lit(1))
    got = {(r.path, r.kind): (r.n, r.in_rows, r.in_every_row) for r in profile.profile(table, "value").collect()}
    assert got == {
        ("$", "object"): (3, 3, True), ("$.a", "integer"): (1, 1, True), ("$.a", "string"): (1, 1, True), ("$.a", "object"): (1, 1, True), ("$.a.a", "object"): (1, 1, False),
        ("$.a.a.a", "boolean"): (1, 1, False), ("$.b", "object"): (1, 1, False), ("$.b", "array"): (1, 1, False), ("$.b.c", "array"): (1, 1, False), ("$.b.c[*]", "integer"): (1, 1, False),
        ("$.b.c[*]", "number"): (1, 1, False), ("$.b.c[*]", "object"): (1, 1, False), ("$.b.c[*].d", "null"): (1, 1, False), ("$.b.e", "string"): (1, 1, False),
    }
    assert profile.profile(table, "value", limit=1).where("path = '$'").first().n == 1
    assert profile.profile(table.where("false"), "value").count() == 0
    with pytest.raises(Exception, match="MALFORMED"):
        profile.profile(spark.createDataFrame([("{",)], "value string"), "value").collect()
