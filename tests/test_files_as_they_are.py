"""Listings and transcripts read from storage rather than from cells."""

import pytest
from pyspark.sql import functions as F

from cairn.operators import transcripts as ts
from cairn.sources import lines, listing

TALKS = {
    "tall ship+1.txt": "Log of a voyage\nSpeakers:\nK: Kai (Rope Works, Quay) #kai\nMAIN\n  K:  cast off\nand haul\nL: done\nEND OF TRANSCRIPT\n",
    "deep/ünder.txt": "first\r\nK: one\r\n\r\nL: two\r\nlast",
    "deep/only-ends.txt": "\n\n",
    "deep/long.txt": "head\n" + "".join(f"{'KL'[i % 2]}: words of turn {i}\n" for i in range(3000)) + "the end",
}


@pytest.fixture
def talks(tmp_path, table):
    for name, text in TALKS.items():
        (tmp_path / "deep").mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    cells = table([("g", n, t) for n, t in TALKS.items()], "graph_id string, doc_id string, text string")
    return str(tmp_path), cells


@pytest.fixture(params=[None, 4000], ids=["whole", "cut"])
def ranges(spark, request):
    """Once as usual, once in byte ranges of 4,000 bytes, on tasks with several of them."""
    name = "spark.sql.files.maxPartitionBytes"
    if request.param:
        spark.conf.set(name, request.param)
    yield request.param
    spark.conf.unset(name)


@pytest.mark.parametrize("kept", [(0, 0), (1, 1)])
def test_lines_of_files_are_those_of_cells(spark, talks, rows, ranges, kept):
    root, cells = talks
    read = lines.read_lines(spark, root, "g")
    found = ts.normalize_lines(read, *kept)
    assert rows(found, "doc_id", "line_no", "line") == rows(ts.normalize_transcript(cells, *kept), "doc_id", "line_no", "line")
    if ranges:
        starts = spark.read.text(root + "/deep/long.txt").select("_metadata.file_block_start").distinct().count()
        assert starts > 5


def test_rows_of_transcripts_in_files(spark, talks, rows, ranges):
    root, cells = talks
    made, wanted = ts.transcript_rows_of_lines(lines.read_lines(spark, root, "g")), ts.transcript_rows(cells)
    for name in wanted:
        assert rows(made[name]) == rows(wanted[name])


def test_a_single_file(spark, talks):
    root, _ = talks
    read = lines.read_lines(spark, f"{root}/tall ship+1.txt", "g").orderBy("line_no").collect()
    assert [r["line"] for r in read] == TALKS["tall ship+1.txt"].split("\n")
    assert {r["doc_id"] for r in read} == {"tall ship+1.txt"}


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "a" / "_b c" / "d%20").mkdir(parents=True)
    (tmp_path / "a" / "_b c" / "x+y ü.txt").write_text("x")
    (tmp_path / "a" / "_b c" / "d%20" / "_z").write_text("zz")
    (tmp_path / "a" / "empty").mkdir()
    (tmp_path / "a" / "nothing").write_text("")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "config").write_text("hidden")
    (tmp_path / "c2c-output").mkdir()
    (tmp_path / "c2c-output" / "made.csv").write_text("generated")
    (tmp_path / "config.json").write_text("{}")
    (tmp_path / "_top.md").write_text("abc")
    (tmp_path / "a" / "around").symlink_to(tmp_path / "a", target_is_directory=True)
    return tmp_path


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_every_name_of_a_tree_arrives(spark, tree, rows, scheme):
    found = listing.list_tree(spark, f"{scheme}{tree}", "g")
    assert rows(found, "graph_id", "file_name", "relative_path", "length") == [
        ("g", "_top.md", "_top.md", 3),
        ("g", "_z", "a/_b c/d%20/_z", 2),
        ("g", "nothing", "a/nothing", 0),
        ("g", "x+y ü.txt", "a/_b c/x+y ü.txt", 1),
    ]
    assert found.filter(F.col("last_modified").isNull()).count() == 0


def test_a_tree_is_listed_by_many_tasks(spark, tmp_path, rows, monkeypatch):
    for i in range(40):
        (tmp_path / f"f{i}").mkdir()
        for j in range(3):
            (tmp_path / f"f{i}" / f"n{j}").write_text("x")
    monkeypatch.setattr(listing, "FOLDERS_PER_TASK", 4)
    found = listing.list_tree(spark, str(tmp_path), "g")
    plain = listing.list_folder(spark, str(tmp_path), "g")
    columns = ["graph_id", "file_name", "relative_path", "length", F.date_trunc("second", "last_modified").alias("at")]
    assert rows(found, *columns) == rows(plain, *columns) and found.count() == 120
    spread = spark.range(40).select(F.concat(F.lit("f"), "id").alias("relative_path")).repartition(10, "relative_path")
    tasks = spread.mapInArrow(listing.entries(str(tmp_path)), listing.ENTRY).select(F.spark_partition_id().alias("task")).distinct().count()
    assert tasks > 5


def test_a_tree_that_is_not_there(spark, tmp_path):
    with pytest.raises(Exception, match="nowhere"):
        listing.list_tree(spark, f"{tmp_path}/nowhere", "g").count()
    (tmp_path / "bare").mkdir()
    assert listing.list_tree(spark, f"{tmp_path}/bare", "g").count() == 0
