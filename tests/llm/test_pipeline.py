import os
import subprocess
import sys

from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def write_tables(spark, path):
    from tests.llm.test_models import corpus

    rows, labels = corpus(9, 600)
    docs = [(i, t, "en", "s", len(t), "kept") for i, t in rows]
    docs += [(1000 + k, docs[1][1], "en", "s", 0, "copy") for k in range(5)]
    docs += [(2000, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "s", 0, "leak"), (3000, None, "en", "s", 0, "null"), (3001, "", "en", "s", 0, "empty")]
    names = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    spark.createDataFrame(docs, names).write.parquet(f"{path}/documents.parquet")
    marks = [(i, 0 if i % 50 == 2 else 1, t) for i, t in labels]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, "beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs, dict(labels)


def test_stages_take_effect(spark, tmp_path):
    import corpus_pipeline as C

    docs, toxic = write_tables(spark, str(tmp_path))
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, step in C.STAGES:
        df = C.stage(step(spark, df, str(tmp_path)), name)
        seen[name] = df
    for name, _ in C.STAGES[:-1]:
        assert seen[name].columns == ["doc_id", "text", "lang", "source", "n_chars", "extra"]
    ids = {n: {r.doc_id for r in seen[n].select("doc_id").collect()} for n, _ in C.STAGES}
    clean = [i for i, t in toxic.items() if not t]
    assert len(set(clean) & ids["toxicity"]) > 0.97 * len(clean)
    assert len([i for i, t in toxic.items() if t and i in ids["toxicity"]]) < 0.1 * sum(toxic.values())
    copies = {1, *range(1000, 1005)}
    assert len(ids["near_duplicates"] & copies) == 1
    assert 2000 not in ids["decontamination"]
    assert ids["packing"] == ids["decontamination"]
    assert seen["packing"].agg(F.sum("length")).first()[0] > 0


def test_entry_without_the_subpackage():
    code = "import sys; sys.modules['evflow.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']; print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ROOT})
    assert out.returncode == 0 and int(out.stdout) > 50, out.stderr


def test_queries_are_registered():
    from evflow.llm.queries import QUERIES

    assert {int(q[2:].split("_")[0]) for q in QUERIES} == set(range(1, 14))
