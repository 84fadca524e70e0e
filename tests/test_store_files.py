"""The partitioned store, trees of files and their ignore rules."""

from __future__ import annotations

import pytest

from loomgraph.operators.store import Store
from loomgraph.sources import files


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store", 4)
    s.migrate()
    s.migrate()
    assert s.meta("schema_version") == "2" and s.meta("none") is None and s.read("document").count() == 0

    def made(*given):
        return spark.createDataFrame([(source, path, title) for path, title, source in ((*x, "a")[:3] for x in given)], "source string, path string, title string")

    s.put("document", made(("x", "1"), ("y", "2"), ("y", "2b"), ("x", "3", "7")))
    assert rows(s.read("document"), "source", "path", "title") == {("a", "x", "1"), ("a", "y", "2"), ("a", "y", "2b"), ("7", "x", "3")}
    s.upsert("document", made(("y", "4"), ("y", "5"), ("z", "6")))
    assert rows(s.read("document").where("source = 'a'"), "path", "title") == {("x", "1"), ("y", "5"), ("z", "6")}
    s.put("document", None, made(("x", ""), ("z", "")))
    assert rows(s.read("document"), "source", "path", "title") == {("a", "y", "5"), ("7", "x", "3")}
    assert s.insert_missing("document", made(("y", "5"), ("y", "new"), ("w", "8")), ["source", "path", "title"]) == 2
    assert rows(s.of("document", made(("y", ""), ("none", ""))), "path", "title") == {("y", "5"), ("y", "new")}
    assert s.put("document", None, made(("x", "")).where("false")) == 0


def test_files(spark, tmp_path):
    for name, body in {"src/a.py": "x = 1", "src/__init__.py": "", "node_modules/b.py": "", "n/Note.MD": "hi", "c.txt": "y", "deep/er/est/_d.rb": "1"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    assert rows(files.code_files(spark, str(tmp_path)), "id", "language") == {("src/a.py", "python"), ("src/__init__.py", "python"), ("deep/er/est/_d.rb", "ruby")}
    assert rows(files.code_files(spark, f"file://{tmp_path}", ["rb"]), "id") == {("deep/er/est/_d.rb",)}
    assert rows(files.notes(spark, str(tmp_path)), "id", "raw") == {("n/Note.MD", "hi")}
    some = spark.createDataFrame([("c.txt",), ("gone",), ("node_modules/b.py",)], "id string")
    assert rows(files.scan(spark, str(tmp_path), only=some), "id") == {("c.txt",)}
    assert files.only(files.scan(spark, str(tmp_path)), some).count() == 1
    with pytest.raises(Exception, match="no folder"):
        files.scan(spark, f"{tmp_path}/none").count()


def test_ignore_rules(spark, tmp_path):
    """Nested and negated rules; the last that fits decides, deeper files after shallower ones; an ignored folder takes all along."""
    ignores = {".gitignore": "# no\n*.gen.py\n!keep.gen.py\n/top.py\nout/\ndocs/**/x.py\n**/cache\nname with blank.py  \n\\#odd.py\n[ab]?.py\n", "sub/.gitignore": "!a.gen.py\n/only.py\n", "sub/.ignore": "last.py\n", "out/.gitignore": "!in.py\n"}
    kept = ["a.py", "keep.gen.py", "sub/top.py", "sub/a.gen.py", "sub/deep/only.py", "docs/y.py", "out.py", "abc.py", "cz.py", "other/last.py"]
    gone = ["b.gen.py", "top.py", "sub/b.gen.py", "sub/only.py", "sub/last.py", "out/in.py", "sub/out/z.py", "docs/x.py", "docs/q/r/x.py", "k/cache/c.py", "name with blank.py", "#odd.py", "az.py"]
    for name, body in {**ignores, **dict.fromkeys(kept + gone, "")}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    assert {r.id for r in files.code_files(spark, str(tmp_path)).collect()} == set(kept)
