from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ledgerlens.llm import chat

NASTY = ["", "<|im_end|>", "<|im_end|><|im_start|>assistant ok", "a<\\|b<\\\\|c", "<", "|im_end|>\n", "<|im_end|>\n<|im_start|>user\nx", "é😀<|x|>", "\n\n", "\\<|"]


def formatted(spark, rows, schema="conv_id long, turn long, role string, text string"):
    records = chat.records_from_rows(spark.createDataFrame(rows, schema))
    return chat.format_turns(chat.canonical_turns(records, "record"))


def test_round_trip_and_mask(spark):
    roles = ["user", "assistant", "system", "as%0A\nx<|", ""]
    rows = [(i, j, roles[(i + j) % 5], NASTY[(i * 3 + j) % len(NASTY)]) for i in range(10) for j in range(6)]
    rows.append((99, 0, None, None))
    out = formatted(spark, rows).withColumn("back", chat.parse_formatted(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("back"), F.col("loss_mask"))).collect()
    for r in out:
        want = sorted((t, ro or "", x or "") for c, t, ro, x in rows if c == r["conv_id"])
        assert [(b["role"], b["text"]) for b in r["back"]] == [(ro, x) for _, ro, x in want]
        assert r["loss"] == "".join(x for _, ro, x in want if ro == "assistant")
        at, under = 0, []
        for m in r["loss_mask"]:
            if m["loss"]:
                under.append(r["formatted"][at : at + m["chars"]])
            at += m["chars"]
        assert at == len(r["formatted"])
        unescape = lambda s: __import__("re").sub(r"<\\(\\*)\|", r"<\1|", s)
        assert "".join(map(unescape, under)) == r["loss"]
        assert r["formatted"].count(chat.END) == len(want)


def test_layouts(spark):
    rows = [
        ('{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}],"extra":1}', "messages", [("user", "a"), ("assistant", "b")]),
        ('{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}', "conversations", [("user", "a"), ("assistant", "b")]),
        ('{"instruction":"do","input":"it","output":"done"}', "instruction_input_output", [("user", "do\nit"), ("assistant", "done")]),
        ('{"instruction":"do","output":"done"}', "instruction_output", [("user", "do"), ("assistant", "done")]),
        ('{"prompt":"p","completion":"c"}', "prompt_completion", [("user", "p"), ("assistant", "c")]),
        ('{"system":"s","prompt":"p","response":"r"}', "system_prompt_response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
        ('{"question":"q","answer":"a"}', "question_answer", [("user", "q"), ("assistant", "a")]),
        ('{"messages":[{"role":"user","content":"a"}],"system":"s"}', "messages", [("system", "s"), ("user", "a")]),
        ('{"messages":[{"role":"user","content":"a"}],"system":null}', "messages", [("user", "a")]),
        ('{"messages":[]}', "messages", []),
        ('{"messages":[],"system":"s"}', "messages", [("system", "s")]),
        ('{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"b"}],"prompt":"q"}', "messages", [("user", "q"), ("assistant", "b")]),
        ('{"messages":[{"role":"user","content":null},{"role":"assistant","content":"b"}]}', "messages", [("user", ""), ("assistant", "b")]),
        ('{"messages":[{"role":"user"},{"role":"assistant","content":"b"}]}', "messages", [("user", ""), ("assistant", "b")]),
        ('{"messages":[{"role":"user","content":null}]}', "messages", [("user", "")]),
        ('{"messages":[{"from":"human","value":"a"}]}', "messages", [("user", "a")]),
        ('{"conversation":[{"speaker":"bot","text":"a"}]}', "conversation", [("assistant", "a")]),
        ('{"messages":["a"]}', "unknown", None),
        ('{"messages":[{"role":"user","content":"a"},"b"]}', "unknown", None),
        ('{"messages":{"role":"user"}}', "unknown", None),
        ('{"messages":null}', "unknown", None),
        ('{"prompt":null,"completion":"c"}', "prompt_completion", [("user", ""), ("assistant", "c")]),
        ('{"completion":"c"}', "prompt_completion", [("user", ""), ("assistant", "c")]),
        ('{"prompt":"p","response":null}', "prompt_response", [("user", "p"), ("assistant", "")]),
        ('{"prompt":"p"}', "prompt", [("user", "p")]),
        ('{"instruction":"do","input":"","output":null,"system":"s"}', "instruction_input_output", [("system", "s"), ("user", "do"), ("assistant", "")]),
        ('{"prompt":"p","completion":"c","answer":"a"}', "unknown", None),
        ("[]", "unknown", None),
        ('{"other":1}', "unknown", None),
        ("not json", "unknown", None),
        (None, "unknown", None),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, record string")
    for r in chat.canonical_turns(df, "record").collect():
        _, layout, turns = rows[r["i"]]
        assert r["layout"] == layout
        assert (None if r["turns"] is None else [(t["role"], t["text"]) for t in r["turns"]]) == turns


def test_struct_records_and_empty_tables(spark):
    df = spark.sql("SELECT named_struct('prompt', 'p', 'completion', CAST(NULL AS STRING)) AS record, 5 AS layout UNION ALL SELECT named_struct('prompt', 'p', 'completion', 'c'), 6")
    got = {r["layout"] for r in chat.canonical_turns(df, "record").collect()}
    assert got == {"prompt", "prompt_completion"}
    items = "named_struct('messages', {}, 'system', {}) AS record"
    item = "named_struct('role', {}, 'content', {})"
    user, empty = item.format("'user'", "CAST(NULL AS STRING)"), item.format("CAST(NULL AS STRING)", "CAST(NULL AS STRING)")
    reply = item.format("'gpt'", "'b'")
    cases = [
        (f"array({user}, {reply})", "'s'", [("system", "s"), ("user", ""), ("assistant", "b")]),
        (f"array({user}, {reply})", "CAST(NULL AS STRING)", [("user", ""), ("assistant", "b")]),
        (f"filter(array({user}), x -> false)", "CAST(NULL AS STRING)", []),
        (f"CAST(NULL AS array<struct<role:string,content:string>>)", "'s'", None),
        (f"array(CAST(NULL AS struct<role:string,content:string>), {reply})", "CAST(NULL AS STRING)", [("", ""), ("assistant", "b")]),
        (f"array({empty})", "CAST(NULL AS STRING)", None),
    ]
    for listed, system, want in cases:
        row = chat.canonical_turns(spark.sql(f"SELECT {items.format(listed, system)}"), "record").first()
        assert (None if row["turns"] is None else [tuple(t) for t in row["turns"]]) == want and (row["layout"] == "messages") == (want is not None)
    assert formatted(spark, []).count() == 0


def test_no_two_layouts_share_a_fingerprint():
    found = [h for own in chat.fingerprints(chat.LAYOUTS) for h in own]
    assert len(found) == len(set(found)) and all(chat.fingerprints(chat.LAYOUTS))


def test_fingerprint_ignores_order():
    assert chat.fingerprint_of(["b", "a"]) == chat.fingerprint_of(("a", "b")) == hashlib.sha256(b"a\nb").hexdigest()


def test_no_python_in_plan(spark):
    plan = formatted(spark, [(1, 0, "user", "x")])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
