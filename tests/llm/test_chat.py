import random

import duckdb

from termloom.llm import chat

SCHEMA = "conv_id bigint, seq bigint, turn bigint, kind string, role string, text string"


def slow_fold(events):
    """One event after another."""
    rank = {k: i for i, k in enumerate(chat.KINDS)}
    state, seen = {}, set()
    ok = [e for e in events if None not in (e[0], e[1], e[2]) and e[3] in rank]
    for c, seq, turn, kind, role, text in sorted(ok, key=lambda e: (e[0], e[1], rank[e[3]], e[2], e[4] is not None, e[4] or "", e[5] or "")):
        key = (c, seq, turn, kind, role, text or "")
        if key in seen:
            continue
        seen.add(key)
        conv = state.setdefault(c, {})
        old = conv.get(turn, {"role": None, "parts": None})
        role = role if role is not None else old["role"]
        if kind in ("edit", "regenerate"):
            for t in [t for t in conv if t > turn]:
                conv[t]["parts"] = None
        parts = [text or ""] if kind != "delta" else [*(old["parts"] or []), text or ""]
        conv[turn] = {"role": role, "parts": parts}
    return {(c, t): (m["role"] or "user", "".join(m["parts"])) for c, conv in state.items() for t, m in conv.items() if m["parts"] is not None}


def test_against_one_event_at_a_time(spark):
    rng = random.Random(3)
    events = []
    for c in range(200):
        for s in range(rng.randrange(14)):
            events.append((c, s if rng.random() < 0.9 else rng.randrange(5), rng.randrange(4), rng.choice([*chat.KINDS, "delta", "delta"]), rng.choice([None, "user", "assistant"]), rng.choice(["a", "b", "", None, "c\n"])))
            if rng.random() < 0.1:
                events.append(events[-1])
    events += [(None, 1, 1, "message", "user", "x"), (1, None, 1, "message", "user", "x"), (1, 1, None, "message", "user", "x"), (1, 99, 1, "unknown", "user", "x"), (1, 99, 1, None, "user", "x")]
    rng.shuffle(events)
    got = {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in chat.fold(spark.createDataFrame(events, SCHEMA)).collect()}
    assert got == slow_fold(events)


def test_rendering(spark):
    long = "word " * 50_000
    rows = [(1, 0, "user", "hi <|im_end|>"), (1, 2, None, None), (1, 1, "assistant", "line\nline\n"), (2, 0, "system", long), (None, 0, "user", "x"), (3, None, "user", "x")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, kind string, seq int")
    got = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    assert got[1]["text"] == "<|im_start|>user\nhi < |im_end|><|im_end|>\n<|im_start|>assistant\nline\nline\n<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert got[1]["n_messages"] == 3 and got[1]["n_chars"] == len(got[1]["text"]) and len(got[2]["text"]) > len(long) and set(got) == {1, 2}
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    got = chat.format_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(chat.SQL).fetchall())


def test_repeated_turns(spark):
    """The last version of a turn stands, by role and text; the same in SQL."""
    rows = [(1, 0, "user", "ask"), (1, 1, "assistant", "first answer\nof two"), (1, 1, "assistant", "second answer\nof two"), (1, 1, "assistant", "second answer\nof two"),
            (1, 2, "user", "b"), (1, 2, None, "z"), (1, 2, "user", "a"), (2, 0, None, "x"), (2, 0, None, None), (2, 5, "assistant", "late"), (2, 5, "user", "early")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: tuple(r) for r in chat.format_conversations(df).collect()}
    line = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    want = {1: line("user", "ask") + line("assistant", "second answer\nof two") + line("user", "b"), 2: line("user", "x") + line("user", "early")}
    assert got == {c: (c, n, len(want[c]), want[c]) for c, n in ((1, 3), (2, 2))}
    con = duckdb.connect()
    conversations = df.toPandas()  # noqa: F841
    assert sorted(con.sql(chat.SQL).fetchall()) == sorted(got.values())
