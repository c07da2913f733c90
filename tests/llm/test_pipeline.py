"""The stages one after the other, each against brute force on what it was given; and the guard."""

from __future__ import annotations

import pathlib
import shutil
import subprocess
import sys

import pytest

import corpus_pipeline
from stridemill.llm import toxicity
from tests.llm import test_minhash, test_packing, test_substrings

ROOT = pathlib.Path(__file__).resolve().parent.parent.parent


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    given, results = docs, []
    for name, step in corpus_pipeline.STAGES:
        step(spark, given, data).write.parquet(f"{tmp_path}/{name}")
        given = spark.read.parquet(f"{tmp_path}/{name}")
        results.append(given)
    clean, single, cut, packed = results
    assert all(frame.columns == columns for frame in results[:-1])

    texts = dict(docs.select("doc_id", "text").collect())
    model = toxicity.fit_on_labels(docs, spark.read.parquet(f"{data}/labels.parquet"))
    scores = {r.doc_id: r.score for r in toxicity.score(docs.select("doc_id", "text"), model).collect()}
    assert {r.doc_id for r in clean.collect()} == {i for i, s in scores.items() if s < 0.7}

    rows = [(r.doc_id, r.text) for r in clean.collect()]
    classes, border = test_minhash.brute_classes(rows)
    assert not border
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for c in classes.values()})
    assert {(r.doc_id, r.text) for r in single.collect()} <= set(rows)

    kept = test_substrings.brute([(r.doc_id, r.text) for r in single.collect()], 20)
    got = cut.collect()
    assert len(got) == single.count()
    for r in got:
        assert r.text == " ".join(kept[r.doc_id, texts[r.doc_id]][0]) and r.n_chars == len(r.text)

    test_packing.whole(packed.collect(), {r.doc_id: r.text for r in got}, (512, 1024, 2048, 4096))


def test_run_gives_the_last_stage(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert "sequence_id" in out.columns and out.count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "packing"]


def test_the_rest_works_without_the_subpackage(tmp_path):
    copy = tmp_path / "copy"
    ignore = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", ".pytest_cache")
    shutil.copytree(ROOT, copy, ignore=ignore)
    (copy / "stridemill" / "llm" / "__pycache__").mkdir(parents=True)  # what a deletion may leave
    code = "import __spark_entry__ as e; n = e.queries(); assert n and not [q for q in n if q.startswith('op')] and 'pipeline' not in n"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, check=True, timeout=120)
    code = "import __spark_entry__ as e; n = e.queries(); assert len([q for q in n if q.startswith('op')]) == 13 and 'pipeline' in n"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, check=True, timeout=120)


@pytest.mark.parametrize("library", ["ahocorasick", "tokenizers", "regex", "public_tokenizers"])
def test_the_rest_works_without_a_library_of_the_subpackage(library):
    code = f"import sys; sys.modules['{library}'] = None; import __spark_entry__ as e; n = e.queries(); assert len(n) > 100 and 'pipeline' not in n"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "stridemill").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "stridemill").parts:
            assert "stridemill.llm" not in path.read_text()
