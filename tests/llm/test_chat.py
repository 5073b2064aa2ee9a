import random

import numpy as np
import pandas as pd

from relflow.llm.chat import SEGMENT, Transitions, format_chats, parse, render, viterbi
from relflow.llm.queries import op10_chat_formatting

SF = "/root/testdata/sf0.001"


def test_recorded_roles_come_back(spark):
    want = pd.read_parquet(f"{SF}/conversations.parquet")
    got = op10_chat_formatting(spark, SF).toPandas().merge(want.rename(columns={"role": "r"}), on=["conv_id", "turn"])
    assert got.copies.sum() == len(want) and got.agrees.all()
    assert (got.rendered == [render([(r, t)]) for r, t in zip(got.r, got.text, strict=True)]).all()


def test_roles_without_markers():
    turns = [("system", "You help."), ("user", "Why is it so?"), (None, "Because."), ("user", "And this?"), (None, "That too.")]
    assert [x[0][0] for x in parse(turns)] == ["system", "user", "assistant", "user", "assistant"]


def test_markers_in_the_text():
    text = "User: hello there?\nmore of it\nAssistant: a reply\n### Human:\nagain"
    assert parse([(None, text)]) == [[("user", "hello there?\nmore of it"), ("assistant", "a reply"), ("user", "\nagain")]]
    assert parse([(None, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>")]) == [[("user", "\nhi"), ("assistant", "\nyo")]]
    assert parse([("user", "note: a plain line\nhttp://x")]) == [[("user", "note: a plain line\nhttp://x")]]
    assert parse([(None, None)]) and parse([]) == []


def test_viterbi_against_all_paths():
    import itertools

    from relflow.llm.chat import Line

    t, rng = Transitions(), random.Random(1)
    for _ in range(5):
        lines = [Line(rng.choice(["why?", "x" * 300, "ok"]), rng.choice([None, "user", "assistant"]), rng.random() < 0.4) for _ in range(4)]

        def weight(path, lines=lines):
            p, prev = 1.0, None
            for (r, opens), line in zip(path, lines, strict=True):
                name = ("system", "user", "assistant", "tool")[r]
                if prev is None:
                    p *= t.first[r] if opens else 0
                elif opens:
                    p *= (1 - t.stay) * t.follow[prev][r]
                else:
                    p *= t.stay if prev == r else 0
                shown = t.own_mark if line.mark == name else t.other_mark if line.mark else 1 - t.own_mark - 3 * t.other_mark
                inner = t.inner_mark if line.mark else 1 - 4 * t.inner_mark
                p *= (shown if opens else inner) * ((t.at_break if line.at_break else t.inside) if opens else (1 - t.at_break if line.at_break else 1 - t.inside))
                p *= t.asks[r] if line.text.endswith("?") else 1 - t.asks[r]
                p *= t.long[r] if len(line.text) > 200 else 1 - t.long[r]
                prev = r
            return p

        best = max(itertools.product(itertools.product(range(4), (True, False)), repeat=4), key=weight)
        assert np.isclose(weight(viterbi(lines, t)), weight(best))


def test_odd_conversations(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, None, None), (None, 3, "bot", "x"), (2, None, "", ""), (2, None, "alien", "y\n\nz")]
    rows += [(9, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(3 * SEGMENT)]
    rows += [(8, 0, "user", f"same turn {i}") for i in range(500)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumnRenamed("text", "text")
    got = format_chats(df.selectExpr("*", "1 as rendered", "2 as copies")).toPandas()
    assert got.copies.sum() == len(rows) and len(got) == len(set(rows))
    nine = got[got.conv_id == 9].sort_values("turn")
    assert nine.agrees.all() and len(nine) == 3 * SEGMENT
    assert format_chats(df.limit(0)).count() == 0


def test_long_conversations_are_parsed_whole(spark):
    # unmarked rows over many segments, and a turn number that repeats, against one transcript each
    rng = random.Random(3)
    speakers = [None, None, None, "user", "assistant", "tool"]
    rows = [(1, i, rng.choice(speakers), rng.choice(["ok", "why?", "x" * 300]) + f" {i}" + rng.choice(["", "?", "\nand more"])) for i in range(5 * SEGMENT)]
    rows += [(2, 0, rng.choice(["", "user", "assistant"]), f"same turn {i:03}" + rng.choice(["", "?", "\nAssistant: so"])) for i in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
        got = out.collect()
        assert out.rdd.getNumPartitions() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    shown = {(r["conv_id"], r["turn"], r["role"], r["n_lines"], r["rendered"]) for r in got}
    for conv in (1, 2):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1], r[2] or "", r[3]))
        want = {(conv, r[1], r[2], r[3].count("\n") + 1, render(x)) for r, x in zip(mine, parse([(r[2], r[3]) for r in mine]), strict=True)}
        assert want == {x for x in shown if x[0] == conv}


def test_chained_parts_give_the_path_of_the_whole():
    from relflow.llm.chat import Line, chained, transfer

    t, rng = Transitions(), random.Random(4)
    lines = [Line(rng.choice(["why?", "x" * 300, "ok"]), rng.choice([None, None, "user", "assistant"]), rng.random() < 0.4) for _ in range(120)]
    parts = [lines[:1], lines[1:40], lines[40:41], lines[41:]]
    ends = chained([transfer(p, t) for p in parts])
    assert [x for p, (enter, leave) in zip(parts, ends, strict=True) for x in viterbi(p, t, enter, leave)] == viterbi(lines, t)
