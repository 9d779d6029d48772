"""The pipeline's stages on documents with every awkward case, and the registered queries' columns."""

import os
import random

import pyarrow as pa
import pytest
from helpers import corpus, frame, prose, vocabulary

import corpus_pipeline
from quizlens.llm import simhash


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables documents, labels and benchmark, with foul words, copies, a test item and personal data planted."""
    rng, words = random.Random(21), vocabulary(2000)
    rows = [(i, prose(rng, words, rng.randint(30, 120))) for i in range(200)]
    foul = [i for i in range(200) if rng.random() < 0.3]
    rows = [(i, t + " rotten wretch" * (i in foul)) for i, t in rows]
    clean = [i for i in range(200) if i not in foul]
    item = prose(rng, words, 40)
    rows += [(300, dict(rows)[clean[0]]), (301, dict(rows)[clean[1]] + " more"), (302, item + " " + prose(rng, words, 30)), (303, prose(rng, words, 60) + " write to ann.19@mail5.example.com or +1 (743) 555-3824, 555-3824"), (304, None), (305, ""), (306, prose(rng, words, 20) + " r0tten and w.r.e.t.c.h")]
    rows += [r for r in corpus() if r[0] is None]
    path = str(tmp_path_factory.mktemp("tables"))
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in foul)) for i in range(200)], "doc_id long, quality long, toxic long").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, dict((r for r in rows if r[0] is not None)), set(foul), clean


@pytest.fixture(scope="module")
def steps(spark, folder, tmp_path_factory):
    path, out = folder[0], []
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        to = str(tmp_path_factory.mktemp("steps") / str(k))
        stage(spark, docs, path).write.parquet(to)
        docs = spark.read.parquet(to)
        out.append((name, docs))
    return dict(out)


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_are_the_five_in_order(steps, spark, folder):
    assert list(steps) == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]
    columns = spark.read.parquet(f"{folder[0]}/documents.parquet").columns
    assert all(df.columns == columns for name, df in steps.items() if name != "packing")


def test_toxic_documents_go_and_clean_ones_stay(steps, folder):
    _, rows, foul, clean = folder
    kept = texts(steps["toxicity"])
    assert not foul & set(kept) and 306 not in kept
    assert set(clean) | {300, 301, 302, 303, 304, 305} <= set(kept)
    assert all(kept[d] == rows[d] for d in kept if d is not None)


def test_one_of_each_group_stays(steps, folder):
    clean = folder[3]
    kept, before = texts(steps["near_duplicates"]), texts(steps["toxicity"])
    assert clean[0] in kept and clean[1] in kept and 300 not in kept and 301 not in kept
    assert set(before) - set(kept) <= {300, 301, 304, 305, None}


def test_near_duplicates_are_found_by_fingerprints(spark, monkeypatch):
    """Without any band, copies in a class of near_duplicates go; different texts that a run gives one fingerprint stay."""

    def apart(k):
        def run(batches):
            for batch in batches:
                keys = pa.array([[x] for x in batch["same"].to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["same"], keys], names=["doc_id", "same", "keys"])

        return run

    monkeypatch.setattr(simhash, "_banded", apart)
    rng, words = random.Random(23), vocabulary(3000)
    rows = []
    for i in range(40):
        tokens = prose(rng, words, 300).split(" ")
        rows.append((i, " ".join(tokens)))
        tokens[rng.randrange(300)] = "other"
        rows += [(100 + i, " ".join(tokens)), (200 + i, rows[-1][1])]
    runs = [(300 + i, f"{prose(rng, words, 60)} {'- ' * 200} {prose(rng, words, 40)}") for i in range(10)]
    prints = {d: simhash.fingerprint(t) for d, t in rows + runs}
    close = {i for i in range(40) if (prints[i] ^ prints[100 + i]).bit_count() <= simhash.RADIUS}
    kept = set(texts(corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows + runs), "")))
    assert 20 < len(close) < 40 and len({prints[d] for d, _ in runs}) < 10
    assert kept == {*range(40), *(100 + i for i in range(40) if i not in close), *(d for d, _ in runs)}


def test_contaminated_documents_go(steps):
    assert set(texts(steps["near_duplicates"])) - set(texts(steps["decontamination"])) == {302}


def test_personal_data_are_masked_and_all_else_stays(steps):
    before, after = texts(steps["decontamination"]), texts(steps["personal_data"])
    assert set(before) == set(after)
    assert after[303].endswith("write to [EMAIL] or [PHONE], [PHONE]")
    assert all(after[d] == before[d] for d in before if d != 303)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in steps["personal_data"].collect())


def test_everything_kept_is_packed(steps):
    packed = steps["packing"].collect()
    assert {r.doc_id for r in packed} == set(texts(steps["personal_data"]))
    assert max(r.offset + r.length for r in packed) <= 2048


def test_stages_take_empty_tables_and_repeated_rows(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    extra = docs.unionByName(docs).selectExpr("*", "1 as row", "'x' as score", "0 as fp", "text as _same")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), path).count() == 0, name
        made = stage(spark, extra, path)
        assert name == "packing" or made.columns == extra.columns
        assert made.count() > 0


def test_run_gives_the_last_stage(spark, folder, steps):
    got = corpus_pipeline.run(spark, folder[0])
    key = lambda df: sorted((repr(r.doc_id), r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert key(got) == key(steps["packing"])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no shared tables")
def test_registered_queries(spark):
    from quizlens.llm.queries import QUERIES

    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11))
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    for name, q in QUERIES.items():
        df = q(spark, SF)
        rows = df.collect()
        assert {r.doc_id for r in rows} == {r.doc_id for r in documents.select("doc_id").collect()}, name


@pytest.mark.skipif(not os.path.isdir(SF), reason="no shared tables")
def test_registered_queries_equal_their_sql(spark):
    import duckdb

    from quizlens.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in SQL.items():
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        df = QUERIES[name](spark, SF)
        assert sorted(df.columns) == sorted(names)
        assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == sorted(found.fetchall(), key=repr)


