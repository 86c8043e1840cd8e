from __future__ import annotations

import random

from pyspark.sql import functions as F

from quirekit.operators import jobs as ops
from quirekit.operators.running import gaps, running_total


def frame(spark, rows, schema="job_id bigint, path string, status string"):
    return spark.createDataFrame(rows, schema)


def test_status_rules(spark):
    jobs = frame(spark, [(1, "/a.pdf", None), (2, "/b.pdf", "Paused"), (3, "/c.pdf", "Done"), (4, "/d.pdf", "Processing")])
    assert [r.job_id for r in ops.pending(jobs).collect()] == [1]
    assert ops.has_incomplete(jobs).first().has_incomplete is True
    s = F.col("status")
    row = {r.job_id: r for r in jobs.select("job_id", ops.stop_status(s).alias("a"), ops.pause_status(s).alias("b"), ops.restore_status(s).alias("c")).collect()}
    assert (row[1].a, row[2].a, row[3].a, row[4].a) == ("Stopped", "Stopped", "Done", "Processing")
    assert (row[1].b, row[4].b) == ("Paused", "Paused") and (row[2].c, row[4].c) == ("Queued", "Queued")


def test_new_paths_with_one_hot_path(spark):
    queue = frame(spark, [(1, "/known", "Queued")])
    incoming = frame(spark, [(i, "/hot" if i % 3 else f"/p{i}", None) for i in range(2, 300)] + [(500, "/known", None)])
    got = {(r.path, r.job_id) for r in ops.add_new_paths(queue, incoming).collect()}
    assert ("/hot", 2) in got and not any(path == "/known" for path, _ in got)
    assert len(got) == 1 + len([i for i in range(2, 300) if i % 3 == 0])


def test_global_ordinal_with_equal_keys(spark):
    rng = random.Random(2)
    rows = [(i, "/same" if rng.random() < 0.4 else f"/p{rng.randint(0, 50)}", None) for i in range(500)]
    placed = ops.global_ordinal(frame(spark, rows).repartition(7), [F.col("path").asc()], "job_id")
    got = [(r.path, r.job_id) for r in sorted(placed.collect(), key=lambda r: r.ordinal)]
    assert got == sorted((p, i) for i, p, _ in rows)
    assert sorted(r.ordinal for r in placed.collect()) == list(range(500))


def test_running_total_with_one_hot_key(spark):
    rows = [("hot" if i % 3 else f"k{i % 5}", i, i % 7) for i in range(400)]
    got = running_total(spark.createDataFrame(rows, "k string, at bigint, v bigint"), "k", "at", "v", "sum", span=16).collect()
    sums: dict[str, int] = {}
    want = {}
    for key, at, value in rows:
        sums[key] = sums.get(key, 0) + value
        want[key, at] = sums[key]
    assert {(r.k, r.at): r["sum"] for r in got} == want


def test_gaps_cross_spans(spark):
    rows = [("a", "2024-01-01 23:59:50"), ("a", "2024-01-02 00:00:20"), ("b", "2024-01-05 00:00:00"), ("a", "2024-01-04 00:00:20")]
    times = spark.createDataFrame(rows, "k string, t string").select("k", F.to_timestamp("t").alias("t"))
    got = sorted((r.k, r.gap) for r in gaps(times, "k", "t", "gap").collect() if r.gap is not None)
    assert got == [("a", 30.0), ("a", 172800.0)]


def test_first_scope_error(spark):
    rows = [(1, "/a.pdf", "Queued", "1-2", 5), (2, "/b.txt", "Queued", "9", 5), (3, "/c.pdf", "Done", "9", 5), (4, "/d.pdf", None, "9", 5)]
    jobs = frame(spark, rows, "job_id bigint, path string, status string, page_scope string, total_pages bigint")
    row = ops.first_scope_error(jobs).first()
    assert (row.job_id, row.filename) == (4, "d.pdf") and "exceeds" in row.details


def test_expand_scopes_and_names(spark):
    rows = [(1, "/a.pdf", False, "1-2, 4"), (2, "/b.pdf", True, "1,2"), (3, "/c.txt", False, "1,2")]
    jobs = frame(spark, rows, "job_id bigint, path string, merge_files boolean, page_scope string")
    got = sorted((r.job_id, r.part_no, r.page_scope) for r in ops.expand_scopes(jobs).collect())
    assert got == [(1, 0, "1-2"), (1, 1, "4"), (2, 0, "1,2"), (3, 0, "1,2")]
    named = jobs.select(ops.output_base(F.lit("doc"), F.lit(".pdf"), F.col("page_scope")).alias("n")).collect()
    assert {r.n for r in named} == {"doc_pages_1-2_4", "doc_pages_1_2"}


def test_target_dir_keeps_tree_below_root(spark):
    rows = [(1, "/in/a/b/x.pdf", "/in"), (2, "/in/x.pdf", "/in"), (3, "/other/x.pdf", "/in")]
    jobs = frame(spark, rows, "job_id bigint, path string, root string")
    got = [r.d for r in jobs.select("job_id", ops.target_dir(F.col("path"), F.col("root"), F.lit("/out"), F.lit(1), F.lit(True)).alias("d")).orderBy("job_id").collect()]
    assert got == ["/out/a/b", "/out", "/out"]
