from __future__ import annotations

import hashlib
import random

import duckdb

from tests.oracle import rows_of_frame, rows_of_sql
from tidemark.llm import chat_format as C


def check(frame, rows):
    """Recovered turns, and the loss mask read from the output, against the source."""
    want = {}
    for conv, turn, role, text in rows:
        want.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {r.conv_id: r for r in C.format_chats(frame).withColumn("loss", C.masked_text()).collect()}
    assert out.keys() == want.keys()
    for conv, turns in want.items():
        r, said = out[conv], [(role, text) for _, _, role, text in sorted(turns)]
        assert r.identical
        assert [(t.role, t.text) for t in r.recovered] == said
        assert r.loss == "".join(t for role, t in said if role == "assistant")
    return out


def test_conflicts(spark):
    marks = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE=", "[/ROLE]", "\\", "<\\s>", "[\\\\INST]", " ", "x", "<", "[", "é🙂", "\n", "$0"]
    rng = random.Random(2)
    roles = ["user", "assistant", "system", "tool", "User", "", "a]b [/ROLE] %", None]
    rows = [(c, t, rng.choice(roles), "".join(rng.choice(marks) for _ in range(rng.randrange(7)))) for c in range(60) for t in range(rng.randrange(1, 7))]
    out = check(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), rows)
    assert any(r.escaped for r in out.values()) and not all(r.escaped for r in out.values())


def test_edges(spark):
    rows = [(1, 1, "user", None), (1, 0, None, ""), (2, 0, "assistant", "same"), (2, 0, "assistant", "same"), (2, 0, "user", "tie"), (None, 0, "user", "no id"), (3, None, "user", "a"), (3, 0, "assistant", " b "), (4, 0, "assistant", "w" * 200_000)]
    frame = spark.createDataFrame([(*r, 1, "") for r in rows], "conv_id long, turn long, role string, text string, rows int, raw string")
    check(frame, rows)
    assert C.format_chats(frame.limit(0)).collect() == []


def test_query(spark, sf_dir):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    out = {r.conv_id: r for r in C.op3_chat_format(spark, sf_dir).collect()}
    assert out.keys() == {r[0] for r in rows}
    for conv, r in out.items():
        turns = sorted(x[1:] for x in rows if x[0] == conv)
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest()
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_lone_marks_are_escaped_as_in_the_sql(spark):
    marks = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE=", "[/ROLE]", "<\\s>", "plain"]
    rows = [(10 * c + i, t, ("user", "assistant", "system", "tool")[(c + t) % 4], f"see {m} here" if t == i else "ok") for c, m in enumerate(marks) for i in range(2) for t in range(2)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = check(frame, rows)
    assert {c for c, r in out.items() if not r.escaped} == {90, 91}
    assert out[0].formatted == "[INST] see [\\INST] here [/INST]<s> ok </s>"
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    names, want = rows_of_sql(con, C.SQL)
    own = rows_of_frame(C.digests(C.format_chats(frame)))[1]
    at = names.index("conv_id")
    assert own == [r for r in want if r[at] != "-1"]
