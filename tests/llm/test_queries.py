"""The registered queries, the pipeline, and the entry file without this subpackage."""

import os
import random
import subprocess
import sys

import duckdb
import pytest

import corpus_pipeline
from dossier.llm.queries import ENTRIES
from tools.check_oracle import compare

FOLDER = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_every_operator_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in ENTRIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(n for n, e in ENTRIES.items() if e.sql))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
    good, note = compare(spark, con, FOLDER, ENTRIES[name])
    assert good, note


def test_pipeline_stages_take_effect(spark, tmp_path):
    columns = spark.read.parquet(f"{FOLDER}/documents.parquet").columns
    docs, counts = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        assert docs.columns == columns or k == len(corpus_pipeline.STAGES) - 1
    assert counts == sorted(counts, reverse=True) and counts[0] < 200 and counts[1] < counts[0] and counts[3] < counts[2]
    whole = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(tuple, whole.collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)


def test_entry_without_the_subpackage(tmp_path):
    """A copy without the two folders still imports and lists the other queries."""
    for name in os.listdir(REPO):
        if name not in ("corpus_pipeline.py", "dossier", ".git"):
            os.symlink(f"{REPO}/{name}", tmp_path / name)
    os.mkdir(tmp_path / "dossier")
    for name in os.listdir(f"{REPO}/dossier"):
        if name != "llm":
            os.symlink(f"{REPO}/dossier/{name}", tmp_path / "dossier" / name)
    os.remove(tmp_path / "__spark_entry__.py")
    with open(f"{REPO}/__spark_entry__.py") as source, open(tmp_path / "__spark_entry__.py", "w") as out:
        out.write(source.read())
    code = "import __spark_entry__ as e; n = set(e.queries()); print(len(n), any(x.startswith('op') and x[2].isdigit() for x in n), 'pipeline' in n)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split()[-2:] == ["False", "False"]


def test_repeats_stage_cuts_passages_of_51_words(spark):
    """A shared passage of 51 words goes from both texts; what stands around it, and other texts, stay."""
    rng = random.Random(77)

    def prose(words):
        return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(words))

    passage = prose(51)
    assert len(passage) >= corpus_pipeline.PASSAGE_BYTES
    around = [(prose(60), prose(60)) for _ in range(3)]
    short = " ".join(passage.split(" ")[:30])
    rows = [(i, f"{a} {passage} {b}" if i < 2 else f"{a} {short} {b}") for i, (a, b) in enumerate(around)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in corpus_pipeline.repeats(spark, docs, FOLDER).collect()}
    for i, (before, after) in enumerate(around[:2]):
        # The spaces on both sides are shared as well, and a letter or two may be by chance.
        assert out[i].startswith(before[:-9]) and out[i].endswith(after[9:]) and len(out[i]) <= len(before + after)
    assert out[2] == rows[2][1]
