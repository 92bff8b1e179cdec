"""Texts as files of a tree: every byte comes back, empty texts too, and a text is one entry of its folder."""

from pathlib import Path

from emberline import source_queries
from emberline.sources.files import read_files, write_files


def test_files_hold_the_bytes_of_their_texts(spark, tmp_path):
    texts = {"a/b/x.txt": "line\r\n\n", "a/y.txt": "", "z.txt": "é  \U0001f600\n", "a/b/w.txt": "no end"}
    rows = spark.createDataFrame([*texts.items(), ("a/none.txt", None)], "path string, text string").repartition(3)
    assert write_files(rows, f"file:{tmp_path}/tree") == 4
    for base in (f"{tmp_path}/tree", f"file:{tmp_path}/tree"):
        assert {r["path"]: r["text"] for r in read_files(spark, base, "*.txt").collect()} == {p: t + "\n" for p, t in texts.items()}
    assert write_files(rows, f"{tmp_path}/tree") == 4  # as a task that runs again
    assert sorted(str(p.relative_to(tmp_path / "tree")) for p in (tmp_path / "tree").rglob("*") if p.is_file()) == sorted(texts)


def test_a_text_is_one_entry(spark, tmp_path, monkeypatch):
    """Entries and not bytes are what a tree of small files costs."""
    monkeypatch.setattr(source_queries, "checkpoint_dir", lambda _: str(tmp_path))
    n = source_queries.files_read_back(spark, "/root/testdata/sf0.001").count()
    entries = list(next(Path(tmp_path).glob("files-*")).rglob("*"))
    assert n >= 190 and len(entries) == n + 7
