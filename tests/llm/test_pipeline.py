"""The pipeline's stages against brute force, each on its own input, and the entry without the subpackage."""

import os
import random
import re
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from tessera.llm import decontaminate, quality_classifier, secret_scan, simhash, source_mix

REPO = Path(__file__).resolve().parents[2]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def make(spark, folder):
    rng = random.Random(12)
    words = [f"word{k}" for k in range(800)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    items = [prose(30) for _ in range(8)]
    docs, labels = [], []
    for k in range(400):
        body = prose(rng.randint(40, 120))
        good = k % 10 != 0
        if not good:
            body = ["spam"] * 60
        elif k % 10 == 1:
            body[5:5] = items[k % 8]
        elif k % 10 == 2:
            body[3:3] = ['token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"']
        elif k % 10 == 3 and k > 10:
            body = docs[k - 6][1].split()
            body[len(body) // 2] = "edited"
        text = " ".join(body)
        docs.append((k, text, "en", f"s{k % 4}", len(text)))
        labels.append((k, int(good), 0))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return items


def test_stages(spark, tmp_path):
    folder = str(tmp_path / "in")
    items = make(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-duplicates", "benchmark decontamination", "secret scan", "source mixing"]
    run = lambda name, d: stages[name](spark, d, folder)

    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = {r.doc_id: r.predicted for r in quality_classifier.score_quality(docs, labels).collect()}
    good = run("quality classifier", docs)
    assert good.columns == COLUMNS and {r.doc_id for r in good.collect()} == {k for k, p in scored.items() if p} == {k for k in range(400) if k % 10}

    text = {r.doc_id: r.text for r in good.collect()}
    sets = {k: set(simhash.shingle_hashes(t.encode(), 5)) for k, t in text.items()}
    head = {k: k for k in text}
    for a in sorted(text):
        for b in sorted(text):
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and head[a] != head[b]:
                low, high = sorted((head[a], head[b]))
                head = {k: low if v == high else v for k, v in head.items()}
    single = run("SimHash near-duplicates", good)
    assert single.columns == COLUMNS and {r.doc_id for r in single.collect()} == set(head.values()) != set(head)

    clean = run("benchmark decontamination", single)
    holds = lambda t: any(" ".join(i) in t for i in items)
    assert clean.columns == COLUMNS and {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect() if not holds(r.text)}
    assert clean.count() < single.count()

    safe = run("secret scan", clean)
    before = {r.doc_id: r.text for r in clean.collect()}
    assert safe.columns == COLUMNS
    for r in safe.collect():
        assert r.text == re.sub(r'token = "[0-9a-f]{40}', "<secret>", before[r.doc_id]) and r.n_chars == len(r.text)
    assert not any(secret_scan.base_spans(r.text) for r in safe.collect()) and safe.count() == clean.count()

    mixed = run("source mixing", safe)
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in safe.collect()}
    assert sorted((r.doc_id, r.replica) for r in mixed.collect()) == sorted((r.doc_id, r.replica) for r in source_mix.mix_sources(safe).collect())

    whole = corpus_pipeline.run(spark, folder)
    assert sorted((r.doc_id, r.replica, r.text) for r in whole.collect()) == sorted((r.doc_id, r.replica, r.text) for r in mixed.collect())


def test_stage_edges(spark, odd, empty, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([(3, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd("leaks"), odd("secrets"), odd("score")):
            out = stage(spark, docs, folder)
            out.collect()
            assert out.columns[: len(docs.columns)] == docs.columns, name
        assert stage(spark, empty, folder).count() == 0, name


def test_a_task_holds_one_python_worker(spark, tmp_path):
    """Two Python steps in a row are two workers a task, and Spark keeps them for the stages that follow."""
    folder = str(tmp_path / "in")
    make(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        plan = stage(spark, docs, folder)._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"ArrowEvalPython|MapInArrow|BatchEvalPython", plan)) <= 1, name


def test_registered_queries():
    import __spark_entry__ as entry

    queries = entry.queries()
    assert [sum(q.startswith(f"op{n}_") for q in queries) for n in range(1, 11)] == [1] * 10 and "pipeline" in queries
    assert set(entry.oracle_sql()) <= set(queries)


def test_entry_without_the_subpackage(tmp_path):
    copy = tmp_path / "repo"
    for path in REPO.rglob("*.py"):
        part = path.relative_to(REPO)
        if "llm" not in part.parts and part.name != "corpus_pipeline.py":
            (copy / part).parent.mkdir(parents=True, exist_ok=True)
            (copy / part).write_text(path.read_text())
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') and q[2].isdigit() for q in e.queries()))"], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(copy)})
    assert said.returncode == 0 and said.stdout.split()[-1] == "False" and int(said.stdout.split()[-2]) > 50, said.stderr
    for path in (REPO / "tessera").rglob("*.py"):
        if "llm" not in path.parts:
            assert "tessera.llm" not in path.read_text() and "from .llm" not in path.read_text()


def test_decontaminate_is_not_broadcasting_documents():
    index = decontaminate.Index([(k, b"a b c d e f g h i j k l") for k in range(50)])
    import pickle

    assert len(pickle.dumps(index)) / 50 < 200_000
