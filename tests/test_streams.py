"""Change streams: removals from listings, failed batches done again, issue updates from a stored minute on."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from loomgraph.jobs.index import Settings, index
from loomgraph.operators.store import Store
from loomgraph.sources.connectors import Source
from loomgraph.streaming import issues, watch

EVENTS = "source string, path string, kind string"


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def write(root, **files):
    for name, body in files.items():
        path = root / name.replace("__", "/").replace("_md", ".md")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)


def test_watch_follows_a_folder(spark, tmp_path):
    """Added, changed and removed notes are indexed; others are not looked at."""
    write(tmp_path, notes__one_md="# One\nsee [[two]]", notes__sub__two_md="# Two", notes___hidden_md="# Hidden", notes__three_md="# Three", notes__node_modules__x_md="no")
    source, store, seen = Source("notes", "notes", f"{tmp_path}/notes"), Store(spark, f"file://{tmp_path}/store", 4), []

    def reindex(paths, number):
        seen.append(sorted(r.path for r in paths.collect()))
        index(spark, store, [source], only=paths)

    def run():
        watch.follow(spark, source, f"{tmp_path}/ck", reindex, once=True).awaitTermination(120)

    run()
    assert seen == [["_hidden.md", "one.md", "sub/two.md", "three.md"]] and store.read("document").count() == 4
    assert rows(store.read("edge").where("relation = 'references'"), "src", "dst") == {("document:notes:one.md", "document:notes:sub/two.md")}
    write(tmp_path, notes__one_md="# One, changed", notes__new_md="# New")
    (tmp_path / "notes/sub/two.md").unlink()
    run()
    assert seen[1:] == [["new.md", "one.md", "sub/two.md"]]
    assert rows(store.read("document"), "title") == {("One, changed",), ("New",), ("Hidden",), ("Three",)}
    run()
    assert len(seen) == 2


def test_failed_batches_are_done_again(spark, tmp_path):
    def event(name, *paths):
        spark.createDataFrame([("s", p, "write") for p in paths], EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    seen = []

    def reindex(paths, number):
        seen.append(sorted(r.path for r in paths.collect()))
        if len(seen) < 3:
            raise RuntimeError("not now")

    def run():
        q = watch.watch(watch.stream(spark, f"{tmp_path}/in", EVENTS), reindex, f"{tmp_path}/ck", once=True)
        q.awaitTermination(60)
        assert q.exception() is None

    event("1", "a", "b")
    run()
    event("2", "b", "c")
    run()
    event("3", "d")
    run()
    event("4", "e")
    run()
    assert seen == [["a", "b"], ["a", "b", "c"], ["a", "b", "c", "d"], ["e"]]


def test_relevant_by_extension(spark):
    e = spark.createDataFrame([("s", "a.md", "write"), ("s", "b.rs", "write"), ("s", "x/vendor/c.md", "write"), ("s", "d.md", "access")], EVENTS)
    assert rows(watch.relevant(e, ("**/vendor/**",), ("md",)), "path") == {("a.md",)}


def test_issue_updates(spark, tmp_path):
    def export(*found):
        (tmp_path / "pages").mkdir(exist_ok=True)
        (tmp_path / "pages/1.json").write_text(json.dumps({"issues": [{"key": k, "fields": {"summary": s, "updated": at}} for k, s, at in found]}))

    source, store = Source("board", "issues", f"{tmp_path}/pages"), Store(spark, f"file://{tmp_path}/store", 4)

    def run(checkpoint):
        q = issues.follow(spark, store, source, f"{tmp_path}/{checkpoint}", once=True)
        q.awaitTermination(120)
        assert q.exception() is None

    export(("A-1", "one", "2026-05-01T10:00:30.000+0000"), ("A-2", "two", "2026-05-01T12:00:30.000+0200"), ("A-3", "no time", "soon"))
    run("ck")
    assert rows(store.read("document"), "path") == {("A-1",), ("A-2",), ("A-3",)} and store.meta("issues.board.updated").startswith("2026-05-01 10:00:30")
    first = store.read("file").select("path", "updated").collect()
    # a delta: one of the cursor's minute again, one new, one older than the cursor; what it lacks stays
    export(("A-1", "one", "2026-05-01T10:00:30.000+0000"), ("A-4", "four", "2026-05-02T00:00:00Z"), ("A-0", "old", "2026-04-01T00:00:00Z"))
    run("ck")
    assert rows(store.read("document"), "path") == {("A-1",), ("A-2",), ("A-3",), ("A-4",)} and store.meta("issues.board.updated").startswith("2026-05-02")
    assert {tuple(r) for r in first} <= rows(store.read("file"), "path", "updated")
    # a new stream goes on from the minute in the store
    export(("A-2", "two, later", "2026-05-03T00:00:00Z"), ("A-1", "never read", "2026-05-01T23:00:00Z"))
    run("other")
    assert rows(store.read("document").where("path in ('A-1', 'A-2')"), "title") == {("A-1 — one",), ("A-2 — two, later",)}
    # a forced run of an empty export removes all and drops the cursor
    export()
    index(spark, store, [source], Settings(force=True))
    assert store.read("document").count() == 0 and store.meta("issues.board.updated") is None


def test_moments():
    assert [issues.minute(issues.moment(x)) for x in ("2026-05-01T12:00:30.000+0200", "2026-05-01T10:00:30Z", "2026-05-01T10:00:30")] == ["2026-05-01 10:00"] * 3
    assert issues.moment("soon") is None and issues.moment(None) is None


def test_hourly_stream(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch.repartition(2).write.parquet(f"{tmp_path}/in")
    q = watch.hourly(spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")).writeStream.outputMode("complete").format("memory").queryName("hourly").trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = {(r.h, r.event_type, r.n) for r in batch.groupBy(F.date_trunc("hour", "ts").cast("timestamp").alias("h"), "event_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert rows(spark.table("hourly"), "hour", "event_type", "n") == want
