from __future__ import annotations

import random

from pyspark.sql import functions as F

from quirekit.streaming import chunks, runs
from quirekit.streaming.requests import cached, given_up


def write(spark, rows, folder, name):
    spark.createDataFrame(rows, "doc_id bigint, seq int, last boolean, chunk string").coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def cut(doc, text, size):
    pieces = [text[i : i + size] for i in range(0, len(text), size)]
    return [(doc, i, i == len(pieces) - 1, piece) for i, piece in enumerate(pieces)]


def stream_of(spark, batches, folder):
    """One file per batch, read one file per trigger."""
    for number, rows in enumerate(batches):
        part = f"{folder}/raw{number}"
        spark.createDataFrame(rows, "doc_id bigint, seq int, last boolean, chunk string").coalesce(1).write.parquet(part)
    schema = spark.read.parquet(f"{folder}/raw0").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/raw*")


def test_assembly_across_batches_in_any_order(spark, tmp_path):
    rng = random.Random(4)
    texts = {i: "".join(rng.choice("abc\n") for _ in range(rng.randint(1, 60))) for i in range(12)}
    rows = [row for doc, text in texts.items() for row in cut(doc, text, 7)]
    rng.shuffle(rows)
    stream = stream_of(spark, [rows[i::4] for i in range(4)], str(tmp_path))
    got = runs.run_available(chunks.assemble(stream), str(tmp_path / "work"))
    assert {r.doc_id: r.text for r in got.collect()} == texts


def test_lines_carried_across_batches(spark, tmp_path):
    rows = cut(1, "First line here\nSECOND\nlast words end.", 5)
    stream = stream_of(spark, [rows[:3], rows[3:6], rows[6:]], str(tmp_path))
    got = runs.run_available(chunks.lines_as_html(stream), str(tmp_path / "work"))
    assert [r.html for r in sorted(got.collect(), key=lambda r: r.line_no)] == [
        "<p>First line here</p>", "<h3>SECOND</h3>", "<p>last words end.</p>",
    ]


def test_image_payload_spanning_batches(spark, tmp_path):
    rows = [(1, 0, False, 'a <img src="data:image/png;base64,AAAA'), (1, 1, False, "BBBB"), (1, 2, True, 'CC" alt="x"> b')]
    stream = stream_of(spark, [rows[:1], rows[1:2], rows[2:]], str(tmp_path))
    got = runs.run_available(chunks.suppress_images(stream), str(tmp_path / "work"))
    text = "".join(r.chunk for r in sorted(got.collect(), key=lambda r: r.seq))
    assert text == 'a <img src="about:blank" alt="x"> b'


def test_image_payload_cut_anywhere():
    """Whatever the chunk borders, the chunks put together are the cleaned text."""
    text = """a src x <img src = "data:image/png;base64,AAAA'BB" alt="s"> b <img SRC='about:blank'> <p src="data:text/plain,keep"> s sr"""
    whole, _, held = chunks.suppress_payload(text, "", True)
    assert "AAAA" not in whole and "data:text/plain,keep" in whole and not held
    for size in range(1, len(text)):
        out, quote, held = [], "", ""
        pieces = [text[i : i + size] for i in range(0, len(text), size)]
        for number, piece in enumerate(pieces):
            done, quote, held = chunks.suppress_payload(held + piece, quote, number == len(pieces) - 1)
            out.append(done)
        assert "".join(out) == whole, size


def test_chunks_that_come_twice(spark, tmp_path):
    rows = cut(1, "abcdefghij", 4)
    stream = stream_of(spark, [[rows[0], rows[0], rows[2]], [rows[1], rows[1]], [rows[2], rows[0]]], str(tmp_path))
    got = runs.run_available(chunks.assemble(stream), str(tmp_path / "work"))
    assert [(r.doc_id, r.text) for r in got.collect()] == [(1, "abcdefghij")]


def test_missing_chunk_gives_nothing(spark, tmp_path):
    rows = cut(1, "abcdefghij", 4)
    stream = stream_of(spark, [[rows[0], rows[0]], [rows[2]]], str(tmp_path))
    assert runs.run_available(chunks.assemble(stream), str(tmp_path / "work")).count() == 0


def test_restart_publishes_only_new_input(spark, tmp_path):
    source = str(tmp_path / "in")

    def add(values, number):
        spark.createDataFrame([(v,) for v in values], "v int").coalesce(1).write.mode("append").parquet(source)

    add([1, 2], 0)
    schema = spark.read.parquet(source).schema
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    runs.run_available(stream(), str(tmp_path / "work"))
    add([3], 1)
    got = runs.run_available(stream(), str(tmp_path / "work"))
    assert sorted(r.v for r in got.collect()) == [1, 2, 3]


def test_totals_survive_replay(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a",), ("a",), ("b",)], "k string").write.parquet(source)
    totals = spark.readStream.schema("k string").parquet(source).groupBy("k").count()
    got = runs.run_totals(totals, str(tmp_path / "work"))
    assert sorted((r.k, r["count"]) for r in got.collect()) == [("a", 2), ("b", 1)]


def state_rows(spark, folder, name):
    """Rows of a state variable that a finished stream has left behind."""
    return spark.read.format("statestore").option("stateVarName", name).load(f"{folder}/checkpoint").count()


def test_orders_and_repeats_of_chunks(spark, tmp_path):
    """Whatever the order and the repeats, each operator gives what it gives for the whole text; only turns stay in state."""
    rng = random.Random(11)
    texts = {i: "".join(rng.choice(["ab ", "\n", 'src="data:image/png;base64,QUJD" ', "X: "]) for _ in range(rng.randint(1, 12))) for i in range(8)}
    rows = [row for doc, text in texts.items() for row in cut(doc, text, 6)]
    rows += rng.choices(rows, k=len(rows) // 2)
    rng.shuffle(rows)
    batches = [rows[i::4] for i in range(4)]
    for fn in (chunks.assemble, chunks.suppress_images, chunks.lines_as_html):
        work = tmp_path / fn.__name__
        work.mkdir()
        got = runs.run_available(fn(stream_of(spark, batches, str(work))), str(work / "work")).collect()
        for doc, text in texts.items():
            own = [r for r in got if r.doc_id == doc]
            if fn is chunks.assemble:
                assert [r.text for r in own] == [text]
            elif fn is chunks.suppress_images:
                own.sort(key=lambda r: r.seq)
                assert [r.seq for r in own] == list(range(len(own))) and "".join(r.chunk for r in own) == chunks.suppress_payload(text, "", True)[0]
            else:
                assert sorted(r.line_no for r in own) == [i for i, line in enumerate(text.split("\n")) if line.strip()]
        assert state_rows(spark, f"{work}/work", "turn") == len(texts) and state_rows(spark, f"{work}/work", "waiting") == 0
    assert state_rows(spark, f"{tmp_path}/assemble/work", "parts") == 0


def timed_stream(spark, batches, folder):
    for number, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "key string, sec bigint").selectExpr("key", "timestamp_seconds(sec) AS time")
        frame.coalesce(1).write.parquet(f"{folder}/raw{number}")
    return spark.readStream.schema("key string, time timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/raw*")


def waits(rows, stall, wall, end):
    """Given-up requests of each key by hand; ``end`` is the last watermark."""
    out = []
    for key in {k for k, _ in rows}:
        started = None
        for time in [*sorted(t for k, t in rows if k == key), None]:
            if started is not None:
                due, kind = (last + stall, "stall") if wall is None or last + stall <= started + wall else (started + wall, "wall")
                if (time is not None and time >= due) or (time is None and due <= end):
                    out.append((key, kind, started, last, due, count))
                    started = None
            if time is not None and started is None:
                started, last, count = time, time, 0
            if time is not None:
                last, count = time, count + 1
    return sorted(out)


def seconds(rows):
    return sorted((r.key, r.kind, *(int(t.timestamp()) for t in (r.started, r["last"], r["at"])), r.chunks) for r in rows)


def test_silent_key_is_given_up(spark, tmp_path):
    """A key that never sends again is given out when others move the time on, and leaves no state."""
    batches = [[("quiet", 1000), ("busy", 1000)], [("busy", 1060)], [("busy", 1110), ("busy", 1150)], [("busy", 1200)]]
    got = runs.run_available(given_up(timed_stream(spark, batches, str(tmp_path)), "key", "time"), str(tmp_path / "work"), settle=True)
    assert seconds(got.collect()) == [("busy", "wall", 1000, 1150, 1180, 4), ("quiet", "stall", 1000, 1000, 1120, 1)]
    assert state_rows(spark, f"{tmp_path}/work", "open") == 1  # the request that "busy" began at 1200


def test_waits_equal_brute_force(spark, tmp_path):
    rng = random.Random(3)
    time, rows = 10_000, []
    for _ in range(120):
        time += rng.choice([1, 5, 20, 60])
        rows.append((rng.choice("abcd"), time))
    for number, wall in enumerate((180, None)):
        work = tmp_path / str(number)
        work.mkdir()
        stream = timed_stream(spark, [rows[i : i + 30] for i in range(0, 120, 30)], str(work))
        got = runs.run_available(given_up(stream, "key", "time", stall_ms=120_000, wall_ms=wall and wall * 1000), str(work / "work"), settle=True)
        assert seconds(got.collect()) == waits(rows, 120, wall, time)


def test_cache_evicts_the_least_recently_used(spark, tmp_path):
    rng = random.Random(8)
    asked = [(i, f"k{min(int(rng.expovariate(0.12)), 40)}", rng.choice([0, 5, 5, 5, 900])) for i in range(300)]
    for number in range(3):
        spark.createDataFrame(asked[number::3], "place bigint, cache_key string, size bigint").coalesce(1).write.parquet(f"{tmp_path}/raw{number}")
    stream = spark.readStream.schema("place bigint, cache_key string, size bigint").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/raw*")
    got = runs.run_available(cached(stream, F.col("place"), F.col("cache_key"), F.col("size"), shards=1, entries=7, longest=100), str(tmp_path / "work")).collect()
    order, held, want = [r for number in range(3) for r in asked[number::3]], [], {}
    for place, key, size in order:
        hit, gone = key in held, 0
        if hit:
            held.remove(key)
        if hit or 0 < size <= 100:
            held.append(key)
        if len(held) > 7:
            held.pop(0)
            gone = 1
        want[place] = (hit, gone)
    assert {r.place: (r.hit, r.evicted) for r in got} == want
    assert any(hit for hit, _ in want.values()) and any(gone for _, gone in want.values())
    assert state_rows(spark, f"{tmp_path}/work", "kept") == 7 == state_rows(spark, f"{tmp_path}/work", "order")


def test_tables_as_folders_of_part_files(spark, tmp_path):
    """A table is one file or a folder of part files; a stream reads either, and later parts too, paced or not."""
    rows = [(i, f"text {i}") for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    frame.limit(0).write.parquet(f"{tmp_path}/pages.parquet")
    read = lambda pace=None: runs.read_stream(spark, str(tmp_path), "documents", pace)
    for pace in (None, 1):
        got = runs.run_available(read(pace), f"{tmp_path}/work{pace}")
        assert sorted(map(tuple, got.collect())) == rows
    spark.createDataFrame([(30, "late")], frame.schema).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    assert runs.run_available(read(), f"{tmp_path}/workNone").count() == 31
    whole = chunks.assemble(chunks.to_chunks(read(), "doc_id", F.col("text"), 3))
    assert sorted(map(tuple, runs.run_available(whole, f"{tmp_path}/whole").collect())) == [*rows, (30, "late")]


def test_stream_queries_read_folders_of_part_files(spark, tmp_path):
    import __spark_entry__ as entry_module

    sf = "/root/testdata/sf0.001"
    for name, key in (("documents", "doc_id"), ("pages", "page_id")):
        spark.read.parquet(f"{sf}/{name}.parquet").filter(F.col(key) % 10 == 3).repartition(2).write.parquet(f"{tmp_path}/{name}.parquet")
    queries = entry_module.queries()
    for name in ("stm_02_stateless_clean", "stm_06_stream_cache_keys", "stm_06_lru_cache"):
        assert queries[name](spark, str(tmp_path)).count() > 0


def test_ended_requests_are_built_by_column():
    """Times come as columns of numbers, not as one object for each request."""
    from quirekit.streaming.requests import _Waits

    waits = _Waits(120_000, 180_000)
    [frame] = waits._rows(("a",), [waits._end(1_500, 2_250, 2), waits._end(0, 170_000, 9)])
    assert list(frame.columns) == ["key", "kind", "started", "last", "at", "chunks"]
    assert [str(frame[c].dtype) for c in ("started", "last", "at")] == ["datetime64[ns]"] * 3
    assert frame["key"].tolist() == ["a", "a"] and frame["kind"].tolist() == ["stall", "wall"] and frame["chunks"].tolist() == [2, 9]
    assert [t.value // 1_000_000 for t in frame["at"]] == [122_250, 180_000] and frame["started"][0].value == 1_500 * 1_000_000
    assert list(waits._rows(("a",), [])) == []
