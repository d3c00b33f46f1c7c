import json
import random

import pytest
from pyspark.sql import functions as F

from umbra.operators import walk
from umbra.streaming import chunks, events

VALUES = {"[REDACTED_EMAIL_1]": 'jo"@mail.com'}


def test_numbers_and_order_survive():
    text = '{"b":0.70,"a":[1e400,12345678901234567890123],"t":"\\u2028<&>"}'
    assert walk.encode(walk.decode(text)) == '{"a":[1e400,12345678901234567890123],"b":0.70,"t":"\\u2028<&>"}'
    for bad in ("{", "1 2", "NaN"):
        with pytest.raises(ValueError):
            walk.decode(bad)


def test_leaves_of_a_messages_request(spark):
    body = {
        "model": "m",
        "metadata": {"user_id": "x"},
        "messages": [
            {"role": "user", "content": [{"type": "text", "text": "t1"}, {"type": "image", "source": {"type": "url", "url": "data:x"}}, {"type": "thinking", "thinking": "no"}]},
            {"role": "assistant", "content": [{"type": "tool_use", "id": "i", "name": "n", "input": {"model": "inner", "password": "p w"}}]},
        ],
        "system": "s",
        "tools": [{"name": "n", "description": "d", "input_schema": {"description": "no"}}],
    }
    df = spark.createDataFrame([(1, json.dumps(body)), (2, "no json")], "k int, body string")
    rows = walk.leaves(df, "k").orderBy("ord").collect()
    assert [(r["text"], r["field"], r["opaque"]) for r in rows] == [("d", "", False), ("s", "", False), ("t1", "", False), ("inner", "model", True), ("p w", "password", True)]


def test_whole_requests_and_back(spark):
    body = {"messages": [{"role": "user", "content": "password=hunter22 jo@mail.com"}, {"role": "user", "content": "was hunter22"}, {"role": "assistant", "content": [{"type": "tool_use", "input": {"api_key": "a b", "n": 1.50}}]}]}
    df = spark.createDataFrame([(1, json.dumps(body)), (2, '{"messages": []}')], "k int, body string")
    done, vault, counts = walk.redact_requests(df, "k")
    out = {r["k"]: r["redacted_body"] for r in done.collect()}
    assert json.loads(out[1])["messages"][0]["content"] == "password=[REDACTED_SECRET_1] [REDACTED_EMAIL_1]"
    assert json.loads(out[1])["messages"][1]["content"] == "was [REDACTED_SECRET_1]"
    assert '"api_key":"[REDACTED_SECRET_2]","n":1.5' in out[1]
    assert json.loads(out[1])["system"] == walk.NOTE and out[2] == '{"messages":[]}'
    values = {r["placeholder"]: r["value"] for r in vault.collect()}
    back = json.loads(walk.restore_body(out[1], values, walk.MESSAGES))
    assert back["messages"] == body["messages"]
    assert {(r["kind"], r["n"]) for r in counts.collect()} == {("SECRET", 3), ("EMAIL", 1)}


def test_notes():
    assert walk.add_note({"messages": []}, walk.MESSAGES)["system"] == walk.NOTE
    assert walk.add_note({"messages": [], "system": "a"}, walk.MESSAGES)["system"] == "a\n\n" + walk.NOTE
    assert walk.add_note({"input": []}, walk.MESSAGES) == {"input": []}
    assert walk.add_note({"input": "x"}, walk.CHAT) == {"input": "x"}
    assert walk.add_note({"messages": [{"role": "user", "content": "x"}]}, walk.CHAT)["messages"][0] == {"role": "system", "content": walk.NOTE}
    assert walk.add_note({"messages": [{"role": "developer", "content": [1]}]}, walk.CHAT)["messages"][0]["content"][-1]["text"] == walk.NOTE
    assert walk.add_note({"input": []}, walk.RESPONSES)["instructions"] == walk.NOTE


def _sse(*values, done=False):
    return "".join(f"data: {json.dumps(v)}\n\n" for v in values) + ("data: [DONE]\n\n" if done else "")


def _data(text):
    return [json.loads(e.data) for e in events.parse(text) if e.data != "[DONE]"]


def test_messages_stream():
    delta = lambda t, **d: {"type": "content_block_delta", "index": 0, "delta": {"type": t} | d}
    body = _sse(delta("text_delta", text="mail [REDA"), delta("thinking_delta", thinking="[REDACTED_EMAIL_1]"), delta("text_delta", text="CTED_EMAIL_1] ["), {"type": "content_block_stop", "index": 0})
    out, _ = events.restore(body, VALUES, walk.MESSAGES)
    got = _data(out)
    assert "".join(e["delta"].get("text", "") for e in got if "delta" in e) == 'mail jo"@mail.com ['
    assert got[1]["delta"]["thinking"] == "[REDACTED_EMAIL_1]" and [e["type"] for e in got][-1] == "content_block_stop"


def test_chat_stream_and_arguments():
    chunk = lambda delta, finish=None: {"id": "c", "choices": [{"index": 0, "delta": delta, "finish_reason": finish}]}
    call = lambda a: {"tool_calls": [{"index": 0, "function": {"arguments": a}}]}
    body = _sse(chunk(call('{"to":"[REDACTED')), chunk(call('_EMAIL_1]"}')), chunk({"content": "x ["}), chunk({}, "stop"), done=True)
    out, _ = events.restore(body, VALUES, walk.CHAT)
    got = _data(out)
    arguments = "".join(c["function"]["arguments"] for e in got for c in e["choices"][0]["delta"].get("tool_calls", []))
    assert json.loads(arguments) == {"to": 'jo"@mail.com'}
    assert "".join(e["choices"][0]["delta"].get("content", "") for e in got) == "x [" and out.endswith("data: [DONE]\n\n")


def test_responses_stream(spark):
    body = "event: response.created\r\ndata: " + json.dumps({"type": "response.created", "response": {"id": "r1"}}) + "\r\n\r\n" + _sse(
        {"type": "response.output_text.delta", "output_index": 0, "content_index": 0, "delta": "[REDACTED_EMAIL"},
        {"type": "response.output_text.delta", "output_index": 0, "content_index": 0, "delta": "_1]"},
        {"type": "response.output_text.done", "output_index": 0, "content_index": 0, "text": "[REDACTED_EMAIL_1]"},
    ).rstrip("\n")
    df = spark.createDataFrame([(1, body, VALUES), (2, None, None)], "k int, body string, values map<string,string>")
    rows = {r["k"]: r for r in events.restore_streams(df, "k", "openai-responses").collect()}
    got = _data(rows[1]["restored"])
    assert rows[1]["response_id"] == "r1" and "".join(e.get("delta", "") for e in got) == 'jo"@mail.com' == got[-1]["text"]
    assert rows[2]["restored"] is None


def test_unchanged_events_stay_as_they_are():
    body = ': note\nevent: ping\ndata:  {"b":1,  "a":2}\n\n'
    assert events.restore(body, VALUES, walk.MESSAGES)[0] == body


def test_streaming_state_equals_batch(spark, tmp_path):
    parts = ["x [REDACTED", "_EMAIL_1", "] y [", ""]
    rows = [("s", i, t, i == 3, json.dumps(VALUES)) for i, t in enumerate(parts)]
    schema = "stream string, seq long, text string, last boolean, values_json string"
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = chunks.restore_stream(source).writeStream.format("memory").queryName("restored").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert "".join(r["out"] for r in spark.table("restored").orderBy("seq").collect()) == 'x jo"@mail.com y ['
    batch = spark.createDataFrame(rows, schema).withColumn("values", F.from_json("values_json", "map<string,string>"))
    assert "".join(r["out"] for r in chunks.restore_batch(batch).orderBy("seq").collect()) == 'x jo"@mail.com y ['


def test_long_streams_are_restored_in_segments(spark):
    rng, values = random.Random(6), {"[REDACTED_EMAIL_1]": "joe@mail.com", "[REDACTED_SECRET_12]": "s3cr[t"}
    rows, want = [], {}
    for k in range(25):
        words = ["[REDACTED_EMAIL_1]", "[REDACTED_SECRET_12]", "[REDACTED_EMAIL_9]", "[REDACTED_", "[", "x" * 70, "text ", "[REDACTED_A" + "B" * 60, "ä"]
        whole = "".join(rng.choice(words) for _ in range(rng.randrange(60)))
        pieces, at = [], 0
        while at < len(whole):
            n = rng.choice([0, 1, 1, 2, 5, 30])
            pieces.append(whole[at : at + n])
            at += n
        pieces += [""] * rng.randrange(4) + [None] * (k % 2)
        pending, out = "", []
        for piece in pieces:
            done, pending = chunks.feed(pending, piece or "", values)
            out.append(done)
        if out:
            out[-1] += chunks.flush(pending, values)
        want |= {(k, i): o for i, o in enumerate(out)}
        rows += [(k, i, p, values if i == 0 else None) for i, p in enumerate(pieces)]
    df = spark.createDataFrame(rows, "stream long, seq long, text string, values map<string,string>").repartition(5)
    for segment in (1, 7, 8192):
        got = [(r["stream"], r["seq"], r["out"]) for r in chunks.restore_batch(df, segment=segment).collect()]
        assert len(got) == len(want) and {(s, i): o for s, i, o in got} == want
