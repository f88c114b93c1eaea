"""Lines, files, the sink and the stream."""

import random

import pytest

from ledgerline.operators.parse import events_of
from ledgerline.plans.project import Projections, updated
from ledgerline.sources.log_files import decoded, discover_logs, lines_of, read_lines, registered, split_lines, time_of
from ledgerline.sources.sink import append_events, heads_of, idempotent, justified, marks_of, registered_heads
from ledgerline.streaming.ingest import attached_stream, ingest
from ledgerline.streaming.tail import tail
from tests.support import events, files, melee, parsed, projected, step
from tests.test_engine import GOLDEN, group_fight

DATA = GOLDEN.encode("cp1252")


def test_lines_keep_offsets_and_wait_for_their_end():
    assert list(split_lines(b"ab\r\ncd\n\nxy")) == [(0, 4, b"ab", False), (4, 3, b"cd", False), (7, 1, b"", False)]
    assert list(split_lines(b"ab\ncd", flush_tail=True)) == [(0, 3, b"ab", False), (3, 2, b"cd", False)]
    assert list(split_lines(b"ab\ncd\n", start=3)) == [(3, 3, b"cd", False)]


def test_long_lines_come_in_flagged_fragments():
    got = list(split_lines(b"a" * 10 + b"\nok\n", most=4))
    assert [(a, n, over) for a, n, _, over in got] == [(0, 4, True), (4, 4, True), (8, 3, True), (11, 3, False)]
    assert [x[0] for x in split_lines(b"a" * 10, most=4)] == [0, 4]


@pytest.mark.parametrize("seed", range(5))
def test_reading_in_chunks_equals_reading_whole(seed):
    rng, at, no, ts, out = random.Random(seed), 0, 0, 0, []
    while at < len(DATA):
        size = min(len(DATA), at + rng.randint(1, 400))
        for row in lines_of(DATA[:size], at, no, ts):
            out.append(row)
            at, no, ts = row[1] + row[2], row[0], row[5]
        if size == len(DATA):
            break
    assert out == list(lines_of(DATA))


def test_times():
    assert time_of("[Fri Jul 10 17:14:01 2026] x") == 1783703641000
    assert time_of("[Fri Jul  5 17:14:01 2026] ") == 1783271641000
    for bad in ("[Fri Feb 30 17:14:01 2026] ", "[Xxx Jul 10 17:14:01 2026] ", "[Fri Jul 10 24:14:01 2026] ", "Fri Jul 10", "[Fri Jul 10 17:14:01 2026]x", ""):
        assert time_of(bad) is None


def test_decoding_is_total():
    assert decoded(bytes(range(256))).encode("utf-8") and decoded(b"\x80\x93\xe9") == "€“é"


def test_unknown_lines_carry_the_last_time(spark):
    text = GOLDEN.splitlines()[0] + "\nno time here\n" + GOLDEN.splitlines()[1] + "\n"
    got = parsed(spark, "first\n" + text).orderBy("seq").collect()
    assert [r.type for r in got] == ["raw_unknown", "zone_enter", "raw_unknown", "stance_change_begin"]
    assert got[0].ts == 0 and got[2].ts == got[1].ts and got[2].rule_id is None


def test_discovery_registration_and_resume(spark, tmp_path):
    cut = DATA.index(b"\n", 700) + 1
    for name, data in (("xlog_Owner_north.east.txt", DATA[: cut + 9]), ("xlog_Other_srv.txt", DATA), ("readme.txt", b"x"), ("xlog_bad.txt", b"x")):
        (tmp_path / name).write_bytes(data)
    (tmp_path / "deeper").mkdir()
    found = discover_logs(spark, str(tmp_path))
    assert sorted((r.character, r.server) for r in found.collect()) == [("Other", "srv"), ("Owner", "north.east")]
    known = registered(found)
    first = events_of(read_lines(spark, known))
    store = str(tmp_path / "events")
    n = append_events(first, store)
    assert append_events(first, store) == 0
    (tmp_path / "xlog_Owner_north.east.txt").write_bytes(DATA)
    stored = spark.read.parquet(store)
    resume = registered_heads(stored).join(known, "log_file_id")
    rest = events_of(read_lines(spark, known, resume=resume))
    assert append_events(rest, store) == 2 * 27 - n
    got = spark.read.parquet(store).groupBy("log_file_id").count().collect()
    assert sorted(r["count"] for r in got) == [27, 27]
    (tmp_path / "xlog_Other_srv.txt").write_bytes(b"short\n")
    with pytest.raises(Exception, match="truncated"):
        read_lines(spark, known, resume=resume).collect()


@pytest.mark.parametrize(("ending", "lead"), [(b"[Fri Jul 10 17:1", b""), (b"x" * 700, b"\xef\xbb\xbf"), (b"y" * 90 + b"\r\n\n", b"")])
def test_long_files_are_read_in_splits(spark, tmp_path, ending, lead):
    data = lead + DATA + b"no time \x80\xff\r\n" * 9 + b"z" * 400 + b"\n" + DATA + ending
    for name in ("xlog_Owner_one.txt", "xlog_Other_two.txt"):
        (tmp_path / name).write_bytes(data)
    known = registered(discover_logs(spark, str(tmp_path)))
    starts = [r[1] for r in lines_of(data, most=64)]
    where = known.first()["path"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "333")
    try:
        for flush in (False, True):
            whole, split = (read_lines(spark, known, flush, most=64, whole_bytes=n) for n in (1 << 20, 100))
            assert sorted(split.collect()) == sorted(whole.collect())
        cut = len(starts) // 2
        for at in (starts[cut], starts[-1]):
            resume = spark.createDataFrame([(where, at, 7, 5)], "path string, byte_offset long, seq long, last_ts long")
            whole, split = (read_lines(spark, known, True, most=64, resume=resume, whole_bytes=n) for n in (1 << 20, 100))
            assert sorted(split.collect()) == sorted(whole.collect())
        late = spark.createDataFrame([(where, len(data) + 1, 7, 5)], "path string, byte_offset long, seq long, last_ts long")
        with pytest.raises(Exception, match="truncated"):
            read_lines(spark, known, resume=late, whole_bytes=100).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_sink_refuses_what_does_not_agree(spark, tmp_path):
    store, rows = str(tmp_path / "e"), events(spark, *group_fight())
    append_events(rows, store)
    with pytest.raises(ValueError, match="differs"):
        append_events(rows.replace({"melee_hit #5": "other"}, subset="raw"), store)
    with pytest.raises(ValueError, match="another offset"):
        append_events(rows.withColumn("byte_offset", rows["byte_offset"] + 1), store)
    with pytest.raises(Exception, match="rows differ under one key"):
        idempotent(rows.union(rows.withColumn("raw", rows["type"])), ["log_file_id", "byte_offset"]).collect()
    claimed = spark.createDataFrame([(1, 5, 19), (2, 1, 1)], "log_file_id long, byte_offset long, seq long")
    from pyspark.sql import functions as F

    reasons = {r.log_file_id: r.reason for r in justified(rows.withColumn("byte_length", F.lit(40)), claimed).collect()}
    assert set(reasons) == {1, 2} and "empty" in reasons[2]


def test_sink_keeps_its_contract(spark, tmp_path):
    from pyspark.sql import functions as F

    store, rows = str(tmp_path / "e"), events(spark, *group_fight())
    hit = rows.filter("type = 'melee_hit'").first()
    assert append_events(rows, store) == rows.count()
    changed = rows.withColumn("amount", F.when(F.col("seq") == hit.seq, 777).otherwise(F.col("amount")))
    with pytest.raises(ValueError, match="differs"):
        append_events(changed, store)
    twice = events(spark, *group_fight(), number=2).filter("seq < 3")
    with pytest.raises(ValueError, match="two offsets"):
        append_events(twice.union(twice.withColumn("byte_offset", F.col("byte_offset") + 7)), store)
    pair = spark.createDataFrame([(1, None, "x"), (1, "x", None)], "k long, a string, b string")
    with pytest.raises(Exception, match="rows differ under one key"):
        idempotent(pair, ["k"]).collect()
    assert idempotent(pair.filter("a is null").union(pair.filter("a is null")), ["k"]).count() == 1


def test_watermarks_move_with_the_rows(spark, tmp_path):
    store, rows = str(tmp_path / "e"), events(spark, *group_fight())
    end = registered_heads(rows).first()
    append_events(rows.filter("seq <= 9"), store)
    assert heads_of(spark.read.parquet(marks_of(store))).first().seq == 9
    claim = lambda at, seq: spark.createDataFrame([(1, at, seq)], "log_file_id long, byte_offset long, seq long")
    rest = rows.filter("seq > 9")
    for wrong in (claim(end.byte_offset + 1, end.seq), claim(end.byte_offset, end.seq + 1)):
        with pytest.raises(ValueError, match="not borne out"):
            append_events(rest, store, wrong)
    assert spark.read.parquet(store).count() == 9  # nothing of a refused batch was written
    assert append_events(rest, store, claim(end.byte_offset, end.seq)) == rows.count() - 9
    assert append_events(rest, store, claim(end.byte_offset, end.seq)) == 0
    head = heads_of(spark.read.parquet(marks_of(store))).first()
    assert (head.byte_offset, head.seq) == (end.byte_offset, end.seq)
    from pyspark.sql import functions as F

    late = events(spark, *group_fight()[:2]).withColumn("seq", F.col("seq") + 100).withColumn("byte_offset", F.col("byte_offset") + 1)
    with pytest.raises(ValueError, match="moves back"):
        append_events(late, store)


def test_an_update_equals_a_rebuild_with_signals_and_empties_what_is_gone(spark, tmp_path):
    from ledgerline.schema import Options

    folder, rows = str(tmp_path / "tables"), events(spark, *group_fight())
    one = files(spark)
    told = spark.createDataFrame([(1, 1, 1_760_000_000_000, "Ann", "You", "user_assertion")], "log_file_id long, seq long, ts long, pet string, owner string, evidence_type string")
    updated(folder, rows, one, None, None, Options(), told)
    want = Projections(rows, one, signals=told).entity_links.select("pet", "owner").collect()
    assert want and spark.read.parquet(folder + "/entity_links").select("pet", "owner").collect() == want
    updated(folder, rows, one, None)  # without the signal the log has no such link any more
    spark.catalog.clearCache()
    left = [r.pet for r in spark.read.parquet(folder + "/entity_links").select("pet").collect()] if (tmp_path / "tables" / "entity_links").exists() and list((tmp_path / "tables" / "entity_links").glob("*/*.parquet")) else []
    assert left == [r.pet for r in Projections(rows, one).entity_links.select("pet").collect()]


def test_tailing_resumes_and_equals_the_batch(spark, tmp_path):
    logs, store, marks = tmp_path / "logs", str(tmp_path / "events"), str(tmp_path / "checkpoint")
    logs.mkdir()
    for cut in (700, 1500, len(DATA)):
        (logs / "xlog_Owner_srv.txt").write_bytes(DATA[:cut])
        ingest(tail(spark, str(logs)), store, marks).awaitTermination(120)
    got = spark.read.parquet(store).orderBy("seq").select("seq", "raw", "ts", "type", "byte_offset").collect()
    assert got == parsed(spark, GOLDEN).orderBy("seq").select("seq", "raw", "ts", "type", "byte_offset").collect()


def test_the_tailer_swaps_to_the_newest_files_and_back(tmp_path):
    import os

    from ledgerline.streaming.tail import LogTailReader

    line = DATA[: DATA.index(b"\n") + 1]
    a, b = (str(tmp_path / f"xlog_Owner_{x}.txt") for x in "ab")

    def put(path, lines, when):
        with open(path, "wb") as f:
            f.write(line * lines)
        os.utime(path, (when, when))

    reader, at, got = LogTailReader({"path": str(tmp_path), "maxFiles": "1"}), {}, []
    for step_ in ((a, 2, 10), (b, 1, 20), (a, 3, 15), (a, 4, 30)):
        put(*step_)
        rows, after = reader.read(at)
        rows = list(rows)
        assert rows == list(reader.readBetweenOffsets(at, after))
        got.append([(r[0][-5], r[1], r[2]) for r in rows])
        at = after
    # a line that a file gains while it is not among the newest waits until it is
    assert got == [[("a", 1, 1), ("a", 1, 2)], [("b", 2, 1)], [], [("a", 1, 3), ("a", 1, 4)]]
    os.remove(a)  # a file that is gone is no longer read, its place is kept
    assert list(reader.read(at)[0]) == [] and reader.read(at)[1] == at


def test_streamed_fights_equal_batch_fights(spark, tmp_path):
    rng, steps = random.Random(2), []
    for _ in range(120):
        a, b = rng.sample(["You", "Ann", "Bob", "a rat", "a bat", "Boss"], 2)
        steps.append(melee(rng.choice([500, 4000, 16_000]), a, b, 3) if rng.random() < 0.8 else step(900, "heal", healer=a, target=b, amount=1))
    p = projected(spark, events(spark, *steps))
    timeline = p.timeline.select("log_file_id", "session_no", "seq", "ts", "type", "a_canonical", "b_canonical", "a_side", "b_side").cache()
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(4):
        timeline.filter(f"seq > {i * 30} and seq <= {(i + 1) * 30}").coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(timeline.schema).parquet(str(folder))
        attached_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()
    assert got == p.attached.orderBy("seq").collect() and len(got) > 60


def test_update_equals_rebuild(spark, tmp_path):
    one, two = events(spark, *group_fight()), events(spark, *group_fight(), number=2)
    known = files(spark, n=2)
    marks = updated(str(tmp_path / "a"), one.unionByName(two.filter("seq <= 8")), known, None)
    updated(str(tmp_path / "a"), one.unionByName(two), known, marks)
    Projections(one.unionByName(two), known).write(str(tmp_path / "b"))
    for name in ("sessions", "encounters", "actor_stats", "xp_events", "zones", "entities", "event_links"):
        a, b = (spark.read.parquet(str(tmp_path / x / name)) for x in "ab")
        assert a.exceptAll(b.select(a.columns)).count() == 0 and a.count() == b.count(), name


def test_listeners_hear_of_growth_alone(spark, tmp_path):
    from time import sleep

    from ledgerline.streaming.live import LiveLogs

    logs = tmp_path / "logs"
    logs.mkdir()
    cut = DATA.index(b"\n", 900) + 1
    (logs / "xlog_Owner_srv.txt").write_bytes(DATA[:cut])
    live, heard = LiveLogs(spark, str(logs), str(tmp_path / "store")), []
    with pytest.raises(RuntimeError, match="not started"):
        live.refresh()
    end = live.on_update(heard.append)
    first = live.start().collect()
    try:
        assert live.status == "live" and [r.seq for r in first] == [DATA[:cut].count(b"\n")]
        live.refresh()
        assert not heard
        (logs / "xlog_Owner_srv.txt").write_bytes(DATA)
        for _ in range(120):
            last = live.refresh()
            if heard and live.heads[1] == DATA.count(b"\n"):
                break
            sleep(0.5)
        assert heard and [r.seq for r in last.collect()] == [DATA.count(b"\n")]
        end()
        (logs / "xlog_Owner_srv.txt").write_bytes(b"short\n")
        for _ in range(120):
            live.refresh()
            if live.status == "failed":
                break
            sleep(0.5)
        assert "truncated" in str(live.error)
    finally:
        live.stop()
