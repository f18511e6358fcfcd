"""The registered queries and the pipeline over the small test tables."""

import hashlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from lintlake.llm import common, host_rules, mixing, near_copies, sentencepiece_bpe, simhash, toxicity
from lintlake.llm.labelled import fold
from lintlake.llm.oracle import oracle_sql
from lintlake.llm.queries import piece_model_path, queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="test tables are not there")


def test_thirteen_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 14))
    assert {*queries(), "pipeline"} <= set(entry_point.queries())


@pytest.mark.parametrize("name", sorted(queries().keys() - {"op11_hard_negatives", "op13_whitening"}))
def test_one_row_for_each_row(spark, name):
    table = "pages" if name.startswith("op10_") else "documents"
    key = "page_id" if table == "pages" else "doc_id"
    wanted = sorted(r[0] for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(key).collect())
    found = queries()[name](spark, str(DATA))
    assert sorted(r[0] for r in found.select(key).collect()) == wanted


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    df = queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    expected = con.sql(oracle_sql()[name])
    order = [expected.columns.index(c) for c in columns]
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    assert got == sorted((tuple(r[i] for i in order) for r in expected.fetchall()), key=str)


def smallest_of_groups(rows):
    """The smallest id of each group linked by fingerprints of three bits' distance or by alike shingle sets, by comparing all pairs."""
    prints = np.array([simhash.fingerprint(r.text) for r in rows], np.uint64)
    sets = [set(near_copies.shingle_set(r.text).tolist()) for r in rows]
    least = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 3).tolist() + [
                j for j, other in enumerate(sets) if len(sets[i] & other) >= 0.8 * len(sets[i] | other)
            ]:
                low = min(least[i], least[j])
                changed |= least[i] != low or least[j] != low
                least[i] = least[j] = low
    groups = {}
    for i, r in zip(least, rows):
        groups[i] = min(groups.get(i, r.doc_id), r.doc_id)
    return groups.values()


def test_pipeline_stage_by_stage(spark):
    """Every stage against what its own operator says about the stage's input."""
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, steps = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        steps[name] = (docs, common.written(stage(spark, docs, str(DATA)), "test-stage"))
        docs = steps[name][1]
    for name in list(stages)[:-1]:
        assert steps[name][1].columns == columns

    def ids(df):
        return sorted(r.doc_id for r in df.select("doc_id").collect())

    before, after = steps["quality_rules"]
    assert ids(after) == ids(host_rules.judge(before).where("kept"))
    before, after = steps["toxicity"]
    model = toxicity.fit(before, spark.read.parquet(f"{DATA}/labels.parquet"), fold(5) != 0)
    assert ids(after) == sorted(r.doc_id for r in before.collect() if model.scores([r.text])[0] < 0.5)
    before, after = steps["simhash_near_dedup"]
    assert ids(after) == sorted(smallest_of_groups(before.collect()))
    before, after = steps["mixing"]
    wanted = [r.doc_id for r in mixing.mix(before).collect() for _ in range(r.copies * r.rows)]
    assert ids(after) == sorted(wanted)
    before, after = steps["sentencepiece"]
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_model_path())
    hashed = sorted(
        (r.doc_id, hashlib.sha256(np.array([1, *library.encode(r.text), 2], "<u4").tobytes()).hexdigest()) for r in before.collect()
    )
    assert sorted((r.doc_id, r.ids_sha256) for r in after.collect()) == hashed
    whole = corpus_pipeline.run(spark, str(DATA)).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, after.collect()))
    assert sentencepiece_bpe.digests(after.limit(0).selectExpr("doc_id", "CAST(NULL AS BINARY) AS token_ids", "'' AS decoded")).count() == 0


def test_pipeline_of_odd_rows(odd_docs, spark):
    labels = str(DATA)
    for docs in (odd_docs, odd_docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, labels).count() <= 3 * docs.count()


def test_pipeline_keeps_clashing_columns(spark, make_docs):
    text = " ".join(f"word{i}" for i in range(60))
    extra = [f"'x' AS {c}" for c in ("kept", "Score", "n_words", "fingerprint", "size", "copies", "rows", "shard", "label", "component")]
    docs = make_docs([(i, f"{text} {i}", f"s{i % 3}") for i in range(9)]).selectExpr("*", *extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, str(DATA))
        assert found.columns == docs.columns, name
        rows = found.collect()
        assert all({r[c] for c in docs.columns[5:]} == {"x"} and r.lang == "en" for r in rows), name
        assert rows or name == "mixing"


def test_shared_folder_is_required_on_a_cluster():
    class Context:
        master = "spark://host:7077"

    class Conf:
        @staticmethod
        def get(name, default=None):
            return default

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(Session)
