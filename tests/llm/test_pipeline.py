"""The pipeline's stages on small tables."""

import collections

import pytest

import corpus_pipeline
from quillon.llm import decontaminate, jaccard, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.stage(step(spark, docs, SF), name)
        seen[name] = (before, docs)
    for name, (before, after) in list(seen.items())[:-1]:
        assert after.columns == before.columns, name
    labels, bench = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("labels", "benchmark"))
    before, after = seen["toxicity"]
    assert {r.doc_id for r in toxicity.score(before, labels).where("predicted = 0").collect()} == {r.doc_id for r in after.collect()}
    before, after = seen["near_duplicates"]
    groups = collections.defaultdict(set)
    for r in jaccard.join(before).collect():
        groups[r.class_id].add(r.doc_id)
    assert {r.doc_id for r in after.collect()} == {min(g) for g in groups.values()}
    before, after = seen["decontamination"]
    leaks = {r.doc_id for r in decontaminate.contaminated(before, bench).collect()}
    assert leaks and {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - leaks
    before, after = seen["tokens"]
    assert collections.Counter(r.doc_id for r in before.collect()) == collections.Counter(r.doc_id for r in after.collect())


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 100
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None


def test_entry_without_the_subpackage(tmp_path):
    """__spark_entry__ still imports when the subpackage and the pipeline are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root / "quillon", tmp_path / "quillon", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'discordance_wls' in q and not any(k.startswith('op') for k in q); e.oracle_sql(); e.entry"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


@pytest.mark.parametrize("name", ["op4_repeated_spans", "op1_url_trust"])
def test_registered(name):
    import __spark_entry__

    assert name in __spark_entry__.queries() and name in __spark_entry__.oracle_sql()
