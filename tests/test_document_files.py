"""One file a row behind a commit, and names that never clash."""

import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.operators import render as R
from tessella.sources import document_files as D
from tessella.tables import Scratch


def listing(path):
    """Visible files; a task that outlives its job's end may leave a hidden staging folder, as with Spark's own writers."""
    return {f: open(f"{path}/{f}", encoding="utf-8").read() for f in os.listdir(path) if not f.startswith("_")} if os.path.isdir(path) else None


def frame(spark, rows, partitions=3):
    return spark.createDataFrame(rows, "name string, content string").repartition(partitions)


def test_files_appear_with_the_commit(spark, tmp_path):
    rows = [(f"n{i}.md", f"text é {i}\n" if i % 5 else None) for i in range(40)]
    D.write_files(frame(spark, rows), str(tmp_path / "out"))
    assert listing(tmp_path / "out") == {n: c or "" for n, c in rows}
    D.write_files(frame(spark, [("n1.md", "new"), ("z.md", "z")]), str(tmp_path / "out"), overwrite=False)
    assert len(listing(tmp_path / "out")) == 41 and listing(tmp_path / "out")["n1.md"] == "new"
    D.write_files(frame(spark, [("only.md", "x")]), f"file://{tmp_path}/out")
    assert listing(tmp_path / "out") == {"only.md": "x"}


def test_nothing_is_visible_of_a_failed_job(spark, tmp_path):
    D.write_files(frame(spark, [("old.md", "old")]), str(tmp_path / "out"))
    bad = frame(spark, [(f"n{i}.md", "x") for i in range(30)], 4).withColumn("content", F.when(F.col("name") == "n17.md", F.raise_error(F.lit("lost"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        D.write_files(bad, str(tmp_path / "out"))
    assert listing(tmp_path / "out") == {"old.md": "old"}
    for name in ("a/b", "_x", ".y", ""):
        with pytest.raises(Exception, match="not a file name"):
            D.write_files(frame(spark, [(name, "x")], 1), str(tmp_path / "out"))
    assert listing(tmp_path / "out") == {"old.md": "old"}


def test_names_are_distinct(spark):
    titles = ["same"] * 60 + ["Same", "a b", "a-b", "a--b", "a-2", "a", "a", "a", "", None, "///", "x" * 60, "x" * 50] + ["same-2"] * 3
    rows = list(enumerate(titles))
    scratch = Scratch(spark)
    got = {r.k: r.name for r in D.distinct_names(spark.createDataFrame(rows, "k int, title string").repartition(4), F.col("title"), "k", scratch).collect()}
    assert len({n.lower() for n in got.values()}) == len(rows)
    groups = defaultdict(list)
    for k, t in rows:
        plain = t if t in ("same", "Same", "a", "a-2", "same-2") else None
        if plain:
            groups[plain.lower()].append((k, plain))
    for members in groups.values():
        assert [got[k] for k, _ in members] == [f"{t}--{i}" if i > 1 else t for i, (_, t) in enumerate(members, 1)]


def test_export_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "A b/c", "# A", "<map/>"), (2, "a B c", "# B", None), (3, "", "# C", "<m/>")], "doc int, title string, md string, mm string")
    got = {(r.doc, r.format): (r.file, r.note) for r in R.export_files(df, str(tmp_path / "e"), "doc", ("md", "mm")).collect()}
    assert {k: os.path.basename(f) for k, (f, _) in got.items()} == {(1, "md"): "A-b-c.md", (2, "md"): "a-B-c--2.md", (3, "md"): "report.md", (1, "mm"): "A-b-c.mm", (3, "mm"): "report.mm"}
    assert listing(tmp_path / "e") == {"A-b-c.md": "# A", "a-B-c--2.md": "# B", "report.md": "# C", "A-b-c.mm": "<map/>", "report.mm": "<m/>"}


def test_exports_beside_a_folder_that_cannot_be(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b", "# a")], "doc int, title string, md string")
    (tmp_path / "taken").write_text("a file")
    assert [r.file for r in R.export_files(df, str(tmp_path / "taken"), "doc", ("md",)).collect()] == [f"{tmp_path}/taken-md/a-b.md"]
    got = R.export_files(df, str(tmp_path / "taken" / "below"), "doc", ("md",)).collect()
    assert [r.file for r in got] == [None] and got[0].note.startswith(R.EXPORT_FAILED)
