"""The pipeline against its stages done by hand, and the registered queries against their SQL."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline as C
from navpulse.llm import toxicity
from navpulse.llm.queries import ORACLES, QUERIES
from test_catalog import canonical, duck  # noqa: F401
from test_dedup import classes, exact_brute, print_of
from test_packing import brute as pack_brute
from test_suffix_dedup import brute as suffix_brute

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("thenadoris") for _ in range(rnd.randrange(2, 9))) for _ in range(500)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage, rows, labels = text(60), [], []
    for i in range(240):
        t = text(rnd.randrange(1, 120))
        if i % 8 == 0:
            t += " grobnik zulptar grobnik " + text(3)
        elif i % 9 == 1:
            t = rnd.choice(rows)[1]
        elif i % 9 == 2:
            t += " " + passage + " " + text(5)
        elif i % 9 == 3:
            old = rnd.choice(rows)[1].split(" ")
            old[rnd.randrange(len(old))] = "changed"
            t = " ".join(old)
        rows.append((i, t, "en", f"src{i % 3}", len(t)))
        labels.append((i, 1, int("grobnik" in t)))
    folder = str(tmp_path_factory.mktemp("small"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_pipeline_does_what_its_stages_say(spark, small):
    folder, rows = small
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    scores = toxicity.toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()
    left = {i: (t, s) for i, t, _, s, _ in rows}
    toxic = {r["doc_id"] for r in scores if r["predicted"]}
    assert toxic == {i for i, (t, _) in left.items() if "grobnik" in t}
    left = {i: x for i, x in left.items() if i not in toxic}
    kept = exact_brute([(i, t) for i, (t, _) in left.items()])
    left = {i: x for i, x in left.items() if kept[i][2]}
    reached = classes({i: print_of(t) for i, (t, _) in left.items()})
    left = {i: x for i, x in left.items() if reached[i] == i}
    cut = suffix_brute({i: t.encode() for i, (t, _) in left.items()}, 100)

    stage = docs
    for name, fn in C.STAGES[:-1]:
        stage = fn(spark, stage, folder)
        assert stage.columns == docs.columns and stage.schema.simpleString() == docs.schema.simpleString(), name
    made = {r["doc_id"]: r for r in stage.collect()}
    assert set(made) == set(left)
    for i, r in made.items():
        assert hashlib.sha256(r["text"].encode()).hexdigest() == cut[i][3]
        assert r["n_chars"] == len(r["text"]) and r["source"] == left[i][1]

    got = {}
    for r in C.run(spark, folder).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["size"], r["bin_id"], r["bin_offset"]))
    texts = {i: (r["text"], r["source"]) for i, r in made.items()}
    order = sorted(texts, key=lambda i: (-len(texts[i][0].split()), i))
    marks = {i: "".join(t.split()) for i, (t, _) in texts.items()}
    want = pack_brute([len(texts[i][0].split()) for i in order], [texts[i][1] for i in order], [marks[i] for i in order], 2048)
    assert {i: sorted(x, key=lambda p: p[0]) for i, x in got.items()} == dict(zip(order, want))


def test_stages_bear_empty_and_odd_tables(spark, small):
    folder, _ = small
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(None, None, None, None, None), (1, "", None, None, 0), (2, None, "en", "s", None), (1, "", None, None, 0)]
    for rows in ([], odd):
        stage = spark.createDataFrame(rows, schema)
        for _, fn in C.STAGES:
            stage = fn(spark, stage, folder)
        stage.collect()


def test_contract():
    assert 4 <= len(C.STAGES) <= 5
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES}
    assert {*QUERIES, "pipeline"} <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):  # noqa: F811
    df = QUERIES[name](spark, FOLDER)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    assert got[1]
    if name in ORACLES:
        cur = duck.execute(ORACLES[name])
        assert got == canonical([c[0] for c in cur.description], cur.fetchall())


def test_stages_keep_columns_of_any_name(spark, small):
    """Columns called like those the operators use come through each stage as they were."""
    folder, _ = small
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(80)
    extra = ["toxic", "toxicity", "_text", "_ranges", "_of", "kept", "keep_id", "component_id", "fp", "class", "row", "of", "hashes"]
    for c in extra:
        docs = docs.withColumn(c, F.concat(F.lit(f"{c} "), "doc_id"))
    for name, stage in C.STAGES[:-1]:
        made = stage(spark, docs, folder)
        assert made.columns == docs.columns, name
        assert all(r[c] == f"{c} {r['doc_id']}" for r in made.collect() for c in extra), name
    C.STAGES[-1][1](spark, docs, folder).collect()
