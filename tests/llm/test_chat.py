"""Chat formatting against a sequential model of the event log."""

import hashlib
import random
from pathlib import Path

import duckdb
import pytest
from helpers import plain

from tallybook.llm import chat

EVENTS = "conv_id long, seq long, message long, kind string, role string, text string, turns int, formatted string"


def model(events):
    """Final (message, role, text) per conversation."""
    out = {}
    seen = set()
    order = sorted(events, key=lambda e: tuple((x is not None, x if x is not None else 0) for x in e[1:3]) + (e[3], e[4] or "", e[5] or ""))
    for conv, seq, message, kind, role, text in order:
        key = (conv, seq, message, kind, role or "", text or "")
        if key in seen:
            continue
        seen.add(key)
        messages = out.setdefault(conv, {})
        if kind == "regenerate":
            for m in [m for m in messages if m >= message]:
                del messages[m]
        elif kind == "edit" or message not in messages:
            messages[message] = [role or "", text or ""]
        else:
            messages[message][1] += text or ""
    return {(c, m): tuple(v) for c, ms in out.items() for m, v in ms.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fold(spark, seed):
    r = random.Random(seed)
    bits = ["hi", "", None, "\\", "<b>", "###", "\n</turn>\n", "ä🙂", "</turn>", "\\l"]
    events = [
        (r.choice([1, 2, None]), seq, r.randint(0, 3), r.choice(["delta"] * 5 + ["edit", "regenerate"]), r.choice(["user", "assistant", "a>b\n", None]), r.choice(bits))
        for seq in range(60)
    ]
    events += r.sample(events, 10)  # delivered twice
    table = spark.createDataFrame([(*e, 1, "x") for e in r.sample(events, len(events))], EVENTS)
    found = {(m["conv_id"], m["message"]): m["text"] for m in chat.fold(table).collect()}
    want = model(events)
    assert found == {k: v[1] for k, v in want.items()}
    parsed = chat.parse(chat.format_chats(table)).collect()
    by_conv = {}
    for p in sorted(parsed, key=lambda p: (str(p["conv_id"]), p["position"])):
        by_conv.setdefault(p["conv_id"], []).append((p["text"], p["loss_text"] if p["role"] == "assistant" else None))
        assert p["loss_text"] == (p["text"] if p["role"] == "assistant" else "")
    for conv in {k[0] for k in want}:
        assert [t for t, _ in by_conv[conv]] == [want[k][1] for k in sorted(k for k in want if k[0] == conv)]


def test_regeneration_and_edits(spark):
    log = [(1, 0, 0, "delta", "user", "Q"), (1, 1, 1, "delta", "assistant", "wr"), (1, 2, 1, "delta", "assistant", "ong"), (1, 3, 2, "delta", "user", "no"),
           (1, 4, 1, "regenerate", "assistant", None), (1, 5, 1, "delta", "assistant", "rig"), (1, 6, 1, "delta", "assistant", "ht"), (1, 7, 0, "edit", "user", "Q!"),
           (2, 0, 0, "delta", "user", "gone"), (2, 1, 0, "regenerate", "user", "")]
    [row] = chat.format_chats(spark.createDataFrame([(*e, 1, "x") for e in log], EVENTS)).collect()
    assert row["formatted"] == "<user>\nQ!\n</turn>\n<assistant>\nright\n</turn>\n"
    assert [row["formatted"][t["loss_start"] : t["loss_end"]] for t in row["turns"]] == ["", "right"]


def test_query(spark):
    rows = [(1, 0, "user", "a\\b<c>"), (1, 1, "assistant", "ä # </turn>"), (1, 2, "assistant", None), (2, 0, None, "x" * 30_000), (None, 0, "user", "q"), (3, 0, "assistant", "")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n_turns int")
    found = {r["conv_id"]: r for r in chat.op5_chat_format(spark, docs).collect()}
    rows += [(-7, 0, "user", chat.PLANTED), (-7, 1, "assistant", chat.PLANTED)]
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        loss = "".join(t for role, t in turns if role == "assistant")
        digest = hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        escaped = sum(len(x) + sum(x.count(c) for c in "\\<>#") for turn in turns for x in turn)
        r = found[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"]) == (len(turns), digest, len(loss))
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and r["formatted_chars"] == escaped + 12 * len(turns)
    assert {r["conv_id"] for r in chat.op5_chat_format(spark, docs.limit(0)).collect()} == {-7}
    assert plain(chat.format_chats(chat.events_of(docs.limit(0)))) == []


def test_tied_and_repeated_turns(spark):
    """Every row of the table is a turn, as in the query's SQL."""
    rows = [(1, 0, "user", "q"), (1, 0, "user", "q"), (1, 1, "assistant", "a <b>"), (1, 1, "assistant", "a <b>"), (1, None, "user", "end"),
            (2, 0, "user", "x"), (2, 0, "assistant", "y"), (2, None, "assistant", None), (2, None, "assistant", ""), (None, 3, "assistant", "z"), (None, 3, "assistant", "z")]
    schema = "conv_id long, turn long, role string, text string"
    found = {r["conv_id"]: r.asDict() for r in chat.op5_chat_format(spark, spark.createDataFrame(rows, schema)).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    names = [c[0] for c in con.execute(chat.SQL).description]
    want = {r[0]: dict(zip(names, r)) for r in con.fetchall()}
    assert {c: r["n_turns"] for c, r in found.items()} == {1: 5, 2: 4, None: 2, -7: 2}
    for conv, row in want.items():
        tied = {"turns_sha256"} if conv == 2 else set()  # SQL leaves the order of different tied rows open
        assert all(found[conv][k] == v for k, v in row.items() if k not in tied)
    line = "assistant\ny\nuser\nx\n" + "assistant\n\n" * 2
    assert found[2]["turns_sha256"] == hashlib.sha256(line.encode()).hexdigest()


def test_service_log_folds_back(spark):
    """Drafts, discarded answers and redeliveries are in the log, and none of them in what is folded."""
    texts = ["", None, "a", "ab", "abc", "long <text> # of \\ pieces", "ä🙂" * 7, "(draft) ", "x" * 10_000]
    rows = [(c, t, ["user", "assistant", "assistant", None][(c + t) % 4], texts[(3 * c + t) % len(texts)]) for c in range(6) for t in range(11)]
    rows += [(None, 0, "assistant", "q"), (None, 1, "assistant", "q"), (9, 4, "assistant", "tie"), (9, 4, "assistant", "tie")]
    turns = chat.events_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    log = chat.service_log(turns)
    events = [tuple(e) for e in log.select("conv_id", "seq", "message", "kind", "role", "text").collect()]
    assert {e[3] for e in events} == {"delta", "edit", "regenerate"}
    assert len(set(events)) < len(events) and events != sorted(events, key=str)
    want = {(r["conv_id"], r["message"]): (r["role"] or "", r["text"] or "") for r in turns.collect()}
    assert model(events) == want
    assert {(m["conv_id"], m["message"]): (m["role"], m["text"]) for m in chat.fold(log).collect()} == want
    assert chat.service_log(turns.limit(0)).isEmpty()


def test_main_path_is_native():
    source = Path(chat.__file__).read_text()
    assert not any(word in source for word in ("udf", "mapIn", "applyIn", "rdd", "pandas", "pyarrow"))
