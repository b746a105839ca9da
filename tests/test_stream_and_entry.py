"""Stream restarts, sweeps against single runs, and the driver contract."""

import os
import subprocess
import sys
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from boxlore.operators import metrics, suppression
from boxlore.plans import sweeps
from boxlore.streaming import consensus_stream as C
from check import TABLES, rows_of
from tests.test_boxes import GT, PRED, make

SF = "/root/testdata/sf0.001"


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    votes, out, ckpt = (str(tmp_path / n) for n in ("votes", "out", "ckpt"))
    schema = "ann_id long, voter int, vote boolean"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(votes)
    write([(1, 1, True), (1, 2, True), (2, 1, False)])
    write([(3, 1, None)])
    assert C.incremental_consensus(spark, votes, out, ckpt, files_per_batch=1) == 2
    assert C.incremental_consensus(spark, votes, out, ckpt) == 0
    write([(4, 1, True), (1, 1, False), (1, 2, False)])
    assert C.incremental_consensus(spark, votes, out, ckpt) == 1
    got = C.results(spark, out).collect()
    assert {r.ann_id: r.consensus for r in got} == {1: "mismatch", 2: "mismatch", 3: "error", 4: "match"} and len(got) == 4


def test_votes_are_sorted_in_bounded_parts(spark, monkeypatch):
    """A file of any size is dealt out before its votes are sorted."""
    monkeypatch.setattr(C, "ROWS", 1000)
    votes = spark.range(20_000).selectExpr("id % 5000 AS ann_id", "cast(id % 5 AS int) AS voter", "id >= 15000 AS vote", "timestamp_seconds(id) AS at", "'f' AS file", "id AS row").coalesce(1)
    last = C._last(votes)
    held = last.groupBy(F.spark_partition_id()).count().collect()
    assert len(held) == 20 and max(r["count"] for r in held) < 500
    assert last.count() == last.where("vote AND row >= 15000").count() == 5000


def test_stream_replay_stores_nothing_twice(spark, tmp_path):
    votes, out = str(tmp_path / "votes"), str(tmp_path / "out")
    spark.createDataFrame([(1, 1, True), (2, 1, False)], "ann_id long, voter int, vote boolean").coalesce(1).write.parquet(votes)
    # The batch was stored but its progress was lost: a fresh checkpoint replays it.
    C.incremental_consensus(spark, votes, out, str(tmp_path / "ckpt1"))
    C.incremental_consensus(spark, votes, out, str(tmp_path / "ckpt2"))
    assert C.stored_votes(spark, out).count() == C.results(spark, out).count() == 2


@pytest.mark.parametrize("files_per_batch", [1, 10])
def test_stream_loses_no_vote(spark, tmp_path, files_per_batch):
    votes, out = str(tmp_path / "votes"), str(tmp_path / "out")
    for voter, vote in ((1, True), (2, False), (3, False), (1, False), (1, True)):
        spark.createDataFrame([(7, voter, vote), (8, voter, None)], "ann_id long, voter int, vote boolean").coalesce(1).write.mode("append").parquet(votes)
        time.sleep(0.05)  # files are told apart by their time
        if voter == 3:
            C.incremental_consensus(spark, votes, out, str(tmp_path / "ckpt"), files_per_batch)
    C.incremental_consensus(spark, votes, out, str(tmp_path / "ckpt"), files_per_batch)
    assert {r.ann_id: (r.yes, r.no, r.consensus) for r in C.results(spark, out).collect()} == {7: (1, 2, "mismatch"), 8: (0, 0, "error")}


def test_parts_are_merged(spark, tmp_path, monkeypatch):
    votes, out = str(tmp_path / "votes"), str(tmp_path / "out")
    want = {}
    for i in range(11):
        rows = [(a, i % 3, (a + i) % 2 == 0) for a in range(i, i + 4)]
        want |= {(a, v): x for a, v, x in rows}
        spark.createDataFrame(rows, "ann_id long, voter int, vote boolean").coalesce(1).write.mode("append").parquet(votes)
        time.sleep(0.05)
    monkeypatch.setattr(C.compact, "__defaults__", (3,))
    assert C.incremental_consensus(spark, votes, out, str(tmp_path / "ckpt"), files_per_batch=1) == 11
    held = C.parts(spark, out)
    assert held == {9: 4, 10: 4, -2 * C._LEVEL - 8: 30}  # nine batches of 36 votes are one part of the second level
    stored = lambda: {(r.ann_id, r.voter): r.vote for r in C.stored_votes(spark, out).collect()}
    assert stored() == want
    # All batches once more, as after lost progress: the merged votes come back and count once.
    C.incremental_consensus(spark, votes, out, str(tmp_path / "again"), files_per_batch=1)
    assert stored() == want and C.compact(spark, out, 100) == 0


def test_threshold_sweep_equals_single_runs(spark):
    preds, gts = make(31, images=3)
    p, g = spark.createDataFrame(preds, PRED), spark.createDataFrame(gts, GT)
    got = {(r.conf, r.nms_iou): r for r in sweeps.threshold_sweep(p, g, [0.1, 0.6], [0.3, 0.6]).collect()}
    assert len(got) == 4
    for (conf, t), row in got.items():
        kept = suppression.nms(p.where(F.col("score") >= conf), t)
        want = metrics.hybrid_score(kept, g).first()
        assert row.hybrid == pytest.approx(want.hybrid) and row.n_preds == kept.count()


def test_entry_and_contract(spark):
    row = entry.entry(spark).first()
    assert 0 < row.hybrid < 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["met_5_hybrid_score", "fus_1_nms", "fus_6_wbf_weighted", "join_14_catalog_reconcile", "til_2_tile_dataset", "join_18_relabel_candidates"])
def test_queries_match_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    res = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, res.fetchall())


def test_workers_need_no_installed_package(tmp_path):
    """A session started elsewhere, whose Python workers cannot import the package, runs functions that need Python."""
    code = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
import __spark_entry__ as entry
from boxlore.session import local_session
spark = local_session(2, 2)
for name in ("fus_6_wbf_weighted", "join_12_topk_similarity", "udf_1_batch_predict"):
    key = next(k for k in entry.queries() if k.startswith(name[:6]) and name.split("_")[0] in k)
    print(key, entry.queries()[key](spark, {SF!r}).count())
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.returncode == 0, out.stderr[-2000:]
    assert all(int(line.split()[1]) > 0 for line in out.stdout.splitlines() if line.count(" ") == 1)
