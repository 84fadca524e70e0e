"""The index job over a generated corpus of source files and notes: seconds of a first run and of one with nothing to do."""

from __future__ import annotations

import json
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

from loomgraph.jobs.index import Settings, index
from loomgraph.operators.store import Store
from loomgraph.sources.connectors import Source


def generate(root: Path, files: int, notes: int) -> None:
    """Ruby files with a module and a method each, and notes that name a module each."""
    (root / "repo").mkdir(parents=True)
    (root / "vault").mkdir()
    for i in range(1, files + 1):
        (root / f"repo/f{i:05d}.rb").write_text(f"module M{i:05d}\n  def call_{i:05d}\n    1\n  end\nend\n")
    for i in range(1, notes + 1):
        (root / f"vault/Note-{i:05d}.md").write_text(f"# Note {i:05d}\n\nMentions M{i:05d} occasionally.\n")


def measure(spark: SparkSession, root: Path, files: int = 1000, notes: int = 2000) -> dict[str, float | int]:
    """Seconds of a cold and a warm run, and what the two have indexed; no embeddings, mentions of full names alone."""
    generate(root, files, notes)
    sources = [Source("code", "code", f"{root}/repo", ("ruby",)), Source("notes", "notes", f"{root}/vault")]
    store, settings, out = Store(spark, f"file://{root}/store"), Settings(mention_threshold=0.99), {}
    for name in ("cold", "warm"):
        began = time.time()
        report = index(spark, store, sources, settings)
        out |= {f"{name}_s": round(time.time() - began, 2), f"{name}_indexed": sum(r["indexed"] for r in report.values())}
    return out


if __name__ == "__main__":
    made = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    made.range(1000).selectExpr("sum(id)").collect()
    sizes = [int(x) for x in sys.argv[1:3]] or [1000, 2000]
    print(json.dumps(measure(made, Path(tempfile.mkdtemp(prefix="spark-index-")) / "corpus", *sizes)))
    made.stop()
