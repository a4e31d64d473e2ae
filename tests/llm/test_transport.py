"""Ids of any kind come through every operator; workers need not have the package."""

import os
import subprocess
import sys
import textwrap
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftlab.llm import bpe, decontam, imatch, language, lines, packing, pii, quality, secrets, sharding, simhash

REPO = Path(__file__).resolve().parents[2]
ITEM = "Which of these rivers flows through the old town before it reaches the sea?"
OPERATORS = {
    "op1": lambda docs, items, labels: sharding.shard_documents(docs),
    "op2": lambda docs, items, labels: quality.predict(docs, labels),
    "op3": lambda docs, items, labels: simhash.near_duplicates(docs),
    "op4": lambda docs, items, labels: language.predict(docs),
    "op5": lambda docs, items, labels: secrets.scan(docs),
    "op6": lambda docs, items, labels: imatch.edited_documents(docs),
    "op7": lambda docs, items, labels: lines.duplicate_lines(docs),
    "op8": lambda docs, items, labels: packing.pack_documents(docs),
    "op9": lambda docs, items, labels: pii.pseudonymise(docs),
    "op10": lambda docs, items, labels: decontam.contaminations(docs, items),
    "op13": lambda docs, items, labels: bpe.encode_documents(docs),
}
IDS = {"long": [2**60 + 1, 2**60 + 3, None], "string": ["b-2", "a-1", None]}


@pytest.mark.parametrize("kind", IDS)
@pytest.mark.parametrize("name", OPERATORS)
def test_ids_stay_as_they_are(spark, name, kind):
    fields = [T.StructField("doc_id", T.LongType() if kind == "long" else T.StringType())]
    fields += [T.StructField(c, T.StringType()) for c in ("text", "lang", "source")]
    rows = [(i, f"{ITEM}\nA line that all of the three documents have, word for word, in one place.\nmail x{k}@example.org", "en", "s") for k, i in enumerate(IDS[kind])]
    docs = spark.createDataFrame(rows, T.StructType(fields)).coalesce(1)
    items = spark.createDataFrame([(2**60 + 5, ITEM)], "item_id long, text string")
    labels = docs.where("doc_id is not null").select("doc_id", F.lit(1).cast("long").alias("quality"))
    found = OPERATORS[name](docs, items, labels)
    assert found.schema["doc_id"].dataType == fields[0].dataType
    got = {r["doc_id"] for r in found.collect()}
    # Of equal lines one document keeps its own.
    assert len(got) == 2 and got < set(IDS[kind]) if name == "op7" else got == set(IDS[kind])
    if name == "op10":
        assert {r["item_id"] for r in found.collect()} == {2**60 + 5}


def test_workers_without_the_package_run_every_query(tmp_path):
    script = f"""
        import sys
        sys.path.insert(0, {str(REPO)!r})
        from pyspark.sql import SparkSession
        from pyspark.sql import functions as F
        spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).getOrCreate()
        def importable(batches):
            import importlib.util
            for b in batches:
                yield b.assign(id=int(importlib.util.find_spec("shiftlab") is not None))
        assert spark.range(1).mapInPandas(importable, "id long").first()[0] == 0
        from __spark_entry__ import CORPUS_QUERIES
        folder = {str(tmp_path / "tables")!r}
        for name, n in (("documents", 30), ("labels", 200), ("benchmark", 5), ("conversations", 60)):
            spark.read.parquet("/root/testdata/sf0.001/" + name + ".parquet").limit(n).write.parquet(folder + "/" + name + ".parquet")
        for name, query in CORPUS_QUERIES.items():
            query(spark, folder).write.format("noop").mode("overwrite").save()
            print("ran", name)
    """
    own = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    # The vocabulary files' package may be one that is found by the path.
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(":") if p and Path(p).resolve() != REPO]
    if paths:
        own["PYTHONPATH"] = ":".join(paths)
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(script)], cwd=tmp_path, env=own, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.count("ran ") == 14
