import random
from datetime import datetime

from pyspark.sql import functions as F

from pageloom.plans import chat
from pageloom.sources import stores
from pageloom.streaming import messages

EVENT = ("conv_id long, run_id string, run_started_at timestamp, seq long, pass int, event string, chunk string, "
         "tool_calls array<struct<id:string,name:string,arg:string>>")


def events(spark):
    at = datetime(2024, 1, 1)
    end = lambda seq, p, *calls: (1, "r1", at, seq, p, chat.END, None, list(calls))
    text = lambda run, seq, p, c: (1, run, at, seq, p, chat.STREAM, c, None)
    return spark.createDataFrame([
        text("r1", 2, 1, "b"), text("r1", 1, 1, "a"), end(3, 1, ("c1", "get", "Axe"), ("c2", "none", "x"), ("c3", "get", "No")),
        text("r1", 5, 2, "d"), text("r1", 4, 2, "c"), end(6, 2, ("c9", "get", "Axe")),
        text("r2", 1, 1, "x"), text("r2", 2, 2, "never"), (1, "r2", at, 3, 1, "on_chain_start", "y", None), (1, "r2", at, 4, 1, chat.END, None, []),
    ], EVENT)


def registry(spark):
    return {"get": (spark.createDataFrame([("Axe", 1)], "name string, n int"), "name")}


def test_history(spark):
    steps = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "tool", "t"), (1, 3, "assistant", "a")],
                                  "conv_id long, turn long, role string, text string")
    history = chat.rebuild_history(steps)
    assert [(r.kind, r.text) for r in history.orderBy("turn").collect()] == [("human", "q"), ("ai", "a")]
    new = spark.createDataFrame([(1, 4, "z")], "conv_id long, turn long, text string")
    longer = chat.append_turns(history, new, new, new).orderBy("turn", "rank")
    assert [r.kind for r in longer.collect()] == ["human", "ai", "human", "tool", "ai"]
    one = chat.prompts(history).first().prompt
    assert "Human: User message: q \n\n Chat History: human: q\nai: a" in one
    lines = chat.prompt_lines(history).orderBy(F.col("pos").asc_nulls_first()).collect()
    assert lines[0].line + "\n".join(x.line for x in lines[1:]) == one
    assert chat.prompts(history, system="Be brief.").first().prompt.startswith("System: Be brief.\nHuman: ")


def test_tool_calls_and_answers(spark):
    ev = events(spark)
    got = {r.tool_call_id: (r.content, r.error) for r in chat.dispatch(chat.tool_calls(ev), registry(spark)).collect()}
    assert got == {"c1": ('{"name":"Axe","n":1}', None), "c2": (None, "unknown tool none"), "c3": (None, None)}
    assert {r.run_id: r.text for r in chat.answers(ev).collect()} == {"r1": "abcd", "r2": "x"}
    # A run that only called unknown tools does not go on, here as in with_tools.
    assert {r.run_id: r.text for r in chat.answers(ev, ["other"]).collect()} == {"r1": "ab", "r2": "x"}
    runs = chat.with_tools(ev.select("run_id").distinct(), chat.dispatch(chat.tool_calls(ev), registry(spark)))
    assert [r.run_id for r in runs.collect()] == ["r1"]


def test_answers_of_interleaved_passes_at_high_places(spark):
    base = 10_000_000
    rows = [(1, "r", None, base + i, 1 + i % 2, chat.STREAM, f"{i},", None) for i in range(1000)]
    rows.append((1, "r", None, base + 5000, 1, chat.END, None, [("c", "get", "Axe")]))
    got = chat.answers(spark.createDataFrame(rows, EVENT).repartition(5)).collect()
    assert [r.text for r in got] == ["".join(f"{i}," for i in (*range(0, 1000, 2), *range(1, 1000, 2)))]


def test_thread_state(spark):
    rows = [(i, p, "llm", {k: v}, f"2024-01-0{i} 00:00:00", [("user", f"m{i}")], ("assistant", f"o{i}")) for i, p, k, v in [
        (1, "wiki", "session_id", "t"), (3, "wiki", "conversation_id", "t"), (2, "wiki", "thread_id", "t"), (4, "wiki", "other", "t"), (5, "x", "thread_id", "t")]]
    runs = spark.createDataFrame(rows, "run_id int, project string, run_type string, metadata map<string,string>, start_time string, "
                                       "messages array<struct<role:string,text:string>>, output struct<role:string,text:string>")
    assert stores.runs_for_thread(runs, "t", "wiki").count() == 3
    state = chat.thread_state(stores.runs_by_thread(runs, "wiki")).first()
    assert [m.text for m in state.messages] == ["m3", "o3"]


def test_streams_equal_batch(spark, tmp_path):
    ev = events(spark)
    ev.write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(ev.schema).parquet(f"{tmp_path}/events")
    land = lambda: messages.land_events(stream, f"{tmp_path}/landed", f"{tmp_path}/land-cp")
    read = lambda: {r.run_id: r.text for r in messages.read_messages(spark, f"{tmp_path}/landed").collect()}
    land()
    assert read() == {"r1": "abcd", "r2": "x"} == {r.run_id: r.text for r in chat.answers(ev).collect()}
    # A run of years before that comes last is there all the same.
    old = [(7, "r0", datetime(2020, 1, 1), 1, 1, chat.STREAM, "late", None)]
    spark.createDataFrame(old, EVENT).write.mode("append").parquet(f"{tmp_path}/events")
    land()
    assert read() == {"r0": "late", "r1": "abcd", "r2": "x"}
    responses = messages.stream_responses(stream, registry(spark))
    messages.run_available(responses, f"{tmp_path}/out", f"{tmp_path}/cp")
    batch = chat.dispatch(chat.tool_calls(spark.read.parquet(f"{tmp_path}/events")), registry(spark))
    back = spark.read.parquet(f"{tmp_path}/out").select(*batch.columns)
    assert back.exceptAll(batch).count() == 0 and back.count() == batch.count()


def test_batches_rewrite_the_buckets_they_touch(spark, tmp_path):
    """Late, split and repeated batches give what one batch gives, and other buckets' files stay as they are."""
    rng = random.Random(5)
    row = lambda run, seq, p: (run, f"r{run}", None, seq, p, chat.STREAM, f"{run}.{seq};", None)
    rows = [row(run, seq, 1 + seq % 2) for run in range(40) for seq in range(6)]
    rows += [(run, f"r{run}", None, 90, 1, chat.END, None, [("c", "get", "Axe")]) for run in range(0, 40, 2)]
    rows += [(run, f"r{run}", None, 91, 1, "other", None, None) for run in range(50)]
    rng.shuffle(rows)
    late = [r for r in rows if r[0] in (3, 4)][:5]
    early = [r for r in rows if r not in late]
    path = f"{tmp_path}/t"
    put = lambda part, batch: messages.assemble(spark.createDataFrame(part, EVENT), batch, path, ("get",), buckets=16)
    files = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "t/messages").rglob("*.parquet")}
    put(early[:120], 0)
    put(early[120:], 1)
    before = files()
    put(late, 2)
    after = files()
    touched = {f.parent.name for f in before if f not in after} | {f.parent.name for f in after if f not in before}
    assert 1 <= len(touched) <= 2 and len({f.parent.name for f in after}) > 5
    put(early[120:], 1)
    put(late, 2)
    put([r for r in rows if r[5] == "other"], 3)
    got = {(r.conv_id, r.run_id): r.text for r in messages.read_messages(spark, path).collect()}
    want = {(r.conv_id, r.run_id): r.text for r in chat.answers(spark.createDataFrame(rows, EVENT), ("get",)).collect()}
    assert got == {k: v for k, v in want.items() if k[0] < 40} and len(got) == 40


def test_session_history_is_written_once(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    step = lambda n: spark.createDataFrame([(1, n, "user", f"m{n}")], schema).write.mode("append").parquet(f"{tmp_path}/in")
    step(0)
    source = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    for n in (1, 2):
        messages.session_history(source(), f"{tmp_path}/t", f"{tmp_path}/cp")
        step(n)
    messages.session_history(source(), f"{tmp_path}/t", f"{tmp_path}/cp")
    assert sorted(r.turn for r in stores.read_conversations(spark, f"{tmp_path}/t").collect()) == [0, 1, 2]


def test_streams_read_files_and_folders(spark, tmp_path):
    """The stream queries give their batch rows whether a table is a file or a folder of part files."""
    from pageloom.bindings import QUERIES

    given = "/root/testdata/sf0.001"
    for name in ("events", "conversations", "nation", "part"):
        spark.read.parquet(f"{given}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    for stream, batch in (("stream_tools", "tool_responses"), ("stream_history", "history")):
        for folder in (given, str(tmp_path)):
            got, want = QUERIES[stream](spark, folder), QUERIES[batch](spark, folder)
            assert got.count() == want.count() and got.exceptAll(want.select(*got.columns)).count() == 0
    said = QUERIES["answers"](spark, given).where("text != ''")
    for folder in (given, str(tmp_path)):
        got = QUERIES["stream_messages"](spark, folder).where("text != ''")
        assert got.count() == said.count() and got.exceptAll(said.select(*got.columns)).count() == 0
