import random

import pytest

from shelfmark.streaming import ingest as N
from shelfmark.streaming import ratelimit as R
from shelfmark.streaming.ratelimit import admission_sink, rate_limit, rate_limit_stream


def limit_reference(events, limit, window_ms):
    held, out = {}, {}
    for key, event_id, ts in sorted(events, key=lambda e: (e[0], e[2], e[1])):
        inside = [t for t in held.get(key, []) if t > ts - window_ms]
        if len(inside) >= limit:
            wait = inside[0] + window_ms - ts if inside else 0
            out[event_id] = (False, max(1, (wait + 999) // 1000))
        else:
            inside.append(ts)
            out[event_id] = (True, 0)
        held[key] = inside
    return out


def events(seed):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 2, 3]), i, rng.randrange(0, 60_000)) for i in range(300)]
    return rows + [(4, 1000 + i, i * 40_000) for i in range(10)]


@pytest.mark.parametrize("limit", [0, 1, 3])
def test_rate_limit_equals_one_by_one(spark, limit):
    rows = events(limit)
    df = spark.createDataFrame(rows, "key long, event_id long, ts_ms long")
    got = {r["event_id"]: (r["allowed"], r["retry_after"]) for r in rate_limit(df, limit, 5).collect()}
    assert got == limit_reference(rows, limit, 5000)


def busy_key(kind, n=6000):
    rng = random.Random(3)
    if kind == "light":  # the guess comes true on the way
        times = sorted(rng.randrange(0, 4_000_000) for _ in range(n))
    elif kind == "even":  # two entry states never meet
        times = [i * 100 for i in range(n)]
    else:  # many events at one time
        times = [i // 700 * 900 for i in range(n)]
    return [("hot", i, t) for i, t in enumerate(times)] + [("cold", n + i, i * 977) for i in range(40)] + [(None, 2 * n + i, i * 400) for i in range(40)]


@pytest.mark.parametrize("kind", ["light", "even", "crowded"])
@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_a_key_that_holds_most_events_is_dealt_out(spark, kind, rounds, monkeypatch):
    """Equal to one pass, and no task decides more than its part of the hot key."""
    rows = busy_key(kind)
    df = spark.createDataFrame(rows, "key string, event_id long, ts_ms long")
    sizes = []
    before = R.entry_states

    def watched(placed, *options):
        sizes.extend(r["n"] for r in placed.groupBy(R.F.spark_partition_id()).agg(R.F.count("*").alias("n")).collect())
        return before(placed, *options)

    monkeypatch.setattr(R, "entry_states", watched)
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["event_id"]: (r["allowed"], r["retry_after"]) for r in rate_limit(df, 3, 5, rounds).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == limit_reference([(k or "", i, t) for k, i, t in rows], 3, 5000)
    assert len(sizes) >= 8 and max(sizes) <= len(rows) / 4


def test_events_without_time_and_no_events(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 5)], "key long, event_id long, ts_ms long")
    got = {r["event_id"]: (r["allowed"], r["retry_after"]) for r in rate_limit(df, 1, 5).collect()}
    assert got == {1: (None, None), 2: (True, 0)}
    assert rate_limit(df.limit(0), 1, 5).collect() == []


def arriving(spark, rows, schema, folder, parts):
    """A stream of one micro-batch per part."""
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(folder / f"p{n}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def test_rate_limit_stream_of_a_hot_text_key(spark, tmp_path):
    """More rows of a key in a micro-batch than a frame holds go through map state."""
    rng = random.Random(2)
    rows = sorted([(rng.choice(["a", "a", "a", "b"]), i, rng.randrange(0, 90_000)) for i in range(900)], key=lambda e: e[2])
    stream = arriving(spark, rows, "key string, event_id long, ts_ms long", tmp_path / "in", [rows[:500], rows[500:]])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        admission_sink(stream, 3, 5, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {r["event_id"]: (r["allowed"], r["retry_after"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == limit_reference(rows, 3, 5000)


def test_idle_state_expires(spark, tmp_path):
    import time

    rows = [(1, 1, 0), (1, 2, 1), (1, 3, 2)]
    stream = arriving(spark, rows, "key long, event_id long, ts_ms long", tmp_path / "in", [rows])
    query = rate_limit_stream(stream, 1, 1, expire_idle=True).writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(processingTime="1 second").start()
    try:
        deadline = time.time() + 60
        while time.time() < deadline and not any(s["numRowsTotal"] == 0 and s["numRowsRemoved"] for p in query.recentProgress for s in p["stateOperators"]):
            time.sleep(1)
        assert sorted((r["event_id"], r["allowed"]) for r in spark.table("idle").collect()) == [(1, True), (2, False), (3, False)]
    finally:
        query.stop()


def test_rate_limit_stream_keeps_state(spark, tmp_path):
    rows = sorted(events(7), key=lambda e: e[2])
    schema = "key long, event_id long, ts_ms long"
    for n, part in enumerate((rows[:150], rows[150:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n}"))
    arriving = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    )
    query = (
        rate_limit_stream(arriving, 3, 5)
        .writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    got = {r["event_id"]: (r["allowed"], r["retry_after"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == limit_reference(rows, 3, 5000)


DOC = N.DOCUMENT_STREAM


def kbs(spark):
    return spark.createDataFrame([(1, 128, 16)], "kb_id long, chunk_size int, chunk_overlap int")


def test_ingest_replaces_quarantines_and_marks_failures(spark, tmp_path):
    root, source = str(tmp_path / "out"), str(tmp_path / "in")
    first = [
        (1, 1, "a.txt", "txt", ["t"], "old text"),
        (2, 1, "b.md", "md", [], "# Head\n\nbody ![p](data:image/png;base64,YWJj)"),
        (3, 1, "c.exe", "exe", [], "binary"),
        (4, 1, "d.pdf", "pdf", [], '{"not": "a list"}'),
        (5, 1, "e.txt", "txt", [], None),
    ]
    spark.createDataFrame(first, DOC).coalesce(1).write.parquet(source)
    N.ingest_stream(spark, source, kbs(spark), root, str(tmp_path / "cp")).awaitTermination()
    rows = {(r["document_id"], r["chunk_index"]): r for r in N.current_chunks(spark, root).collect()}
    assert rows[(1, 0)]["content"] == "old text" and rows[(1, 0)]["sparse"]["indices"]
    (asset,) = spark.read.parquet(f"{root}/assets").collect()
    assert rows[(2, 1)]["content"] == f"body ![p]({asset['url']})" and asset["chunk_id"] == rows[(2, 1)]["chunk_id"]
    status = {r["document_id"]: (r["status"], r["error_message"]) for r in spark.read.parquet(f"{root}/manifest").collect()}
    assert status[1] == ("completed", None)
    assert status[3] == ("failed", "Unsupported document type: exe")
    assert status[4] == ("failed", "Layout output is not a list")
    (bad,) = spark.read.parquet(f"{root}/rejected").collect()
    assert (bad["document_id"], bad["reason"]) == (5, "missing_content")
    assert spark.read.parquet(f"{root}/assets").count() == 1

    # the document comes again with new text; only that document changes
    spark.createDataFrame([(1, 1, "a.txt", "txt", ["t"], "new")], DOC).coalesce(1).write.mode("append").parquet(source)
    N.ingest_stream(spark, source, kbs(spark), root, str(tmp_path / "cp")).awaitTermination()
    after = {(r["document_id"], r["chunk_index"]): r["content"] for r in N.current_chunks(spark, root).collect()}
    assert after[(1, 0)] == "new" and {k for k in after if k[0] == 2} == {k for k in rows if k[0] == 2}

    # a retried batch overwrites its own output
    before = sorted(map(str, N.current_chunks(spark, root).collect()))
    N.ingest_batch(spark.createDataFrame([(1, 1, "a.txt", "txt", ["t"], "new")], DOC), 1, kbs(spark), root)
    assert sorted(map(str, N.current_chunks(spark, root).collect())) == before


def test_dedup_stream_checks_state_and_batch(spark, tmp_path):
    schema = "document_id long, kb_id long, name string, file_hash string, position long"
    parts = [[(1, 1, "a", "x", 1), (2, 1, "a", "y", 2), (3, 1, "b", "x", 3), (4, 1, "c", "z", 4)], [(5, 1, "d", "z", 5), (6, 2, "c", "z", 6), (7, 1, "b", "q", 7)]]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        arriving = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        N.dedup_stream(arriving, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    kept = sorted(r["document_id"] for r in spark.read.parquet(str(tmp_path / "out" / "registered")).collect())
    assert kept == [1, 4, 6, 7]
    refused = sorted((r["document_id"], r["reason"]) for r in spark.read.parquet(str(tmp_path / "out" / "refused")).collect())
    assert refused == [(2, "duplicate_name"), (3, "duplicate_file_hash"), (5, "duplicate_file_hash")]


def test_newest_by_arrival_and_damaged_files(spark, tmp_path):
    import os

    source, root = tmp_path / "in", str(tmp_path / "out")
    for n, row in enumerate([(1, 1, "z", "txt", [], "old"), (1, 1, "a", "txt", [], "new")]):
        spark.createDataFrame([row], DOC).coalesce(1).write.parquet(str(tmp_path / f"w{n}"))
        (file,) = [f for f in os.listdir(tmp_path / f"w{n}") if f.endswith(".parquet")]
        os.makedirs(source, exist_ok=True)
        target = source / f"{'ba'[n]}.parquet"
        target.write_bytes((tmp_path / f"w{n}" / file).read_bytes())
        os.utime(target, (1_000_000 + n, 1_000_000 + n))
    (source / "damaged.parquet").write_bytes(b"PAR1 nothing PAR1")
    N.ingest_stream(spark, str(source), kbs(spark), root, str(tmp_path / "cp")).awaitTermination()
    assert [r["content"] for r in N.current_chunks(spark, root).collect()] == ["new"]
    assert [os.path.basename(r["path"]) for r in N.unread_files(spark, str(source), root).collect()] == ["damaged.parquet"]


def test_partly_read_file_is_listed(spark, tmp_path):
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    source, root = tmp_path / "in", str(tmp_path / "out")
    os.makedirs(source)
    rows = [{"document_id": i, "kb_id": 1, "name": f"n{i}", "file_type": "txt", "tags": ["t"], "content": f"text {i}"} for i in range(40)]
    schema = pa.schema([("document_id", pa.int64()), ("kb_id", pa.int64()), ("name", pa.string()), ("file_type", pa.string()), ("tags", pa.list_(pa.string())), ("content", pa.string())])
    for name, part in (("whole", rows[:20]), ("partly", rows[20:])):
        pq.write_table(pa.Table.from_pylist(part, schema), source / f"{name}.parquet", row_group_size=10)
    second = pq.ParquetFile(source / "partly.parquet").metadata.row_group(1)
    begin = min(second.column(i).dictionary_page_offset or second.column(i).data_page_offset for i in range(second.num_columns))
    data = bytearray((source / "partly.parquet").read_bytes())
    data[begin : begin + second.total_byte_size // 2] = b"\xff" * (second.total_byte_size // 2)
    (source / "partly.parquet").write_bytes(bytes(data))
    N.ingest_stream(spark, str(source), kbs(spark), root, str(tmp_path / "cp")).awaitTermination()
    read = {r["document_id"] for r in N.current_chunks(spark, root).collect()}
    assert set(range(20)) < read < set(range(40))
    assert [(os.path.basename(r["path"]), r["reason"]) for r in N.unread_files(spark, str(source), root).collect()] == [("partly.parquet", "partly_read_file")]


def test_progress_stream(spark, tmp_path):
    schema = "document_id long, stage string, progress int, at long"
    rows = [(1, "queued", 10, 1), (1, "completed", 100, 5), (2, "parsing", 24, 3), (1, "parsing", 24, 2)]
    for n, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n}"))
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    N.progress_stream(arriving, str(tmp_path / "cp"), "newest_stage").awaitTermination()
    assert sorted((r["document_id"], r["stage"]) for r in spark.table("newest_stage").collect()) == [(1, "completed"), (2, "parsing")]


def test_compact_keeps_rows_and_manifest(spark, tmp_path):
    from shelfmark.sources import sinks as S

    path, manifest = str(tmp_path / "t"), str(tmp_path / "m")
    for batch, rows in enumerate([[(1, "a"), (2, "b")], [(1, "c")]]):
        df = spark.createDataFrame(rows, "document_id long, v string")
        S.write_batch(df, path, batch)
        S.write_batch(df.select("document_id"), manifest, batch)
    held = S.compact(spark, path, spark.read.parquet(manifest), str(tmp_path / "c"))
    got = sorted(tuple(r) for r in S.read_current(spark, str(tmp_path / "c" / "rows"), held).collect())
    assert got == [(1, "c"), (2, "b")]


def test_private_folder_only_on_one_machine():
    from shelfmark.session import private_folder

    with pytest.raises(ValueError):
        private_folder("spark://host:7077")
