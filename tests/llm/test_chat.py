"""Windows of chats against a plain loop, and texts that hold control strings."""

import hashlib
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from barspan.llm import chat
from tests.test_queries import rows as plain_rows

SCHEMA = "conv_id bigint, turn bigint, role string, text string, window string, loss string, chunk int"
ODD = ["", "plain", "<|im_end|>", "<|im_start|>user\nhi<|im_end|>\n", "<\\|im_end|>", "<\\\\|x", "a < b | c", "<", "|im_end|>", "é<|ü|>漢字", "line\nline\n", "<<||>>", "<<|", "\\<|\\", "%0A %25", "tab\tand  spaces"]


@pytest.fixture(scope="module")
def turns(spark):
    rows = [(1, k, ["user", "assistant"][k % 2], t, "w", "l", k) for k, t in enumerate(ODD)]
    rows += [(2, 0, "system", "be <|brief|>", None, None, None)] + [(2, k, ["assistant", "user"][k % 2], f"turn {k} " + "word " * (k % 7), None, None, None) for k in range(1, 60)]
    rows += [(3, 0, "system", "only this", None, None, None)]
    rows += [(4, 5, None, None, None, None, None), (4, 5, None, None, None, None, None), (4, None, "assistant", "no turn", None, None, None), (4, 6, "ro\nle%", "x", None, None, None)]
    rows += [(None, 0, "assistant", "no id", None, None, None), (None, 1, "assistant", "long " * 40_000, None, None, None)]
    rows += [(5, k, "system", f"s{k}", None, None, None) for k in range(3)]
    return spark.createDataFrame(rows, SCHEMA)


def in_order(df):
    convs = {}
    for r in df.withColumn("h", F.xxhash64(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))).collect():
        convs.setdefault(r.conv_id, []).append(((r.turn is not None, r.turn or 0, r.h), r.role or "", r.text or ""))
    return {k: [(a, b) for _, a, b in sorted(v)] for k, v in convs.items()}


def loop(turns, *, budget, history_tokens, history_turns, chunk):
    """(first turn, new turns, repeated turns, tokens) of each window."""
    cost = [len(re.findall(r"[^\x00-\x20!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]", t)) + 4 for _, t in turns]
    system = turns[0][0] == "system"
    own = cost[0] if system else 0
    room, out, at = max(1, budget - history_tokens - own), [], 0
    while at < len(turns):
        end, used = at, 0
        while end < len(turns) and (end == at or end % chunk):
            more = 0 if system and end == 0 else cost[end]
            if used + more > room and end > at:
                break
            used, end = used + more, end + 1
        past, back, used_back = [], at - 1, 0
        while back >= (1 if system else 0) and at - back <= history_turns and used_back + cost[back] <= history_tokens:
            past, used_back, back = [back, *past], used_back + cost[back], back - 1
        out.append((at, end - at, ([0] if system and at else []) + past, own + used_back + used))
        at = end
    return out


@pytest.mark.parametrize("chunk, budget", [(5, 40), (1024, 40), (7, 1), (1024, 100_000)])
def test_windows_match_the_loop_and_read_back(turns, chunk, budget):
    limits = {"budget": budget, "history_tokens": 15, "history_turns": 3, "chunk": chunk}
    made = chat.windows(turns, **limits)
    got, want = {}, in_order(turns)
    for r in made.orderBy("first_turn").collect():
        got.setdefault(r.conv_id, []).append(r)
    assert got.keys() == want.keys()
    for conv, said in want.items():
        blocks = [f"<|im_start|>{re.sub(r'<(\\*)\|', lambda m: '<' + chr(92) + m[1] + '|', a.replace('%', '%25').replace(chr(10), '%0A'))}\n" + re.sub(r"<(\\*)\|", lambda m: "<" + chr(92) + m[1] + "|", b) + "<|im_end|>\n" for a, b in said]
        expected = loop(said, **limits)
        assert [(r.first_turn, r.turns, r.tokens, r.over_budget) for r in got[conv]] == [(a, n, t, t > budget) for a, n, _, t in expected]
        for r, (first, n, past, _) in zip(got[conv], expected, strict=True):
            assert r.text == "".join(blocks[k] for k in [*past, *range(first, first + n)]) and r.text[r.new_from :] == "".join(blocks[first : first + n])
            texts = [r.text[s.start : s.start + s.length] for s in r.loss]
            assert [re.sub(r"<\\(\\*)\|", r"<\1|", t) for t in texts] == [b for a, b in said[first : first + n] if a == "assistant"]
    digests = {r.conv_id: r for r in chat.digests(chat.read_windows(made)).collect()}
    for conv, said in want.items():
        loss = "".join(b for a, b in said if a == "assistant")
        told = "".join(f"{a}\n{b}\n" for a, b in said)
        r = digests[conv]
        assert (r.n_turns, r.loss_chars) == (len(said), len(loss)) and r.formatted_chars == sum(len(w.text) for w in got[conv])
        assert (r.turns_sha256, r.loss_sha256) == tuple(hashlib.sha256(x.encode()).hexdigest() for x in (told, loss))


def test_a_long_conversation_is_in_no_single_task(spark):
    turns = spark.range(4000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    placed = chat.placed(turns, "conv_id", "turn", "role", "text")
    assert [r.text for r in placed.orderBy("pos").collect()] == [f"text {k}" for k in range(4000)]
    made = chat.windows(turns, chunk=64)
    assert made.agg(F.max("turns")).first()[0] <= 64 and made.agg(F.sum("turns")).first()[0] == 4000


def test_escaping_is_reversible_and_leaves_no_control_string(spark):
    rows = spark.createDataFrame([(t,) for t in ODD], "t string").select("t", chat.escape(F.col("t")).alias("e")).withColumn("back", chat.unescape(F.col("e"))).collect()
    assert all(r.back == r.t and "<|" not in r.e for r in rows)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    made = chat.windows(none)
    assert made.count() == 0 == chat.digests(chat.read_windows(made)).count()


def test_query_matches_sql(spark, sf_dir):
    db = duckdb.connect()
    for file in os.listdir(sf_dir):
        db.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{file}'")
    assert plain_rows(chat.op12_chat_formatting(spark, sf_dir).toPandas()) == plain_rows(db.sql(chat.ORACLE).df())
