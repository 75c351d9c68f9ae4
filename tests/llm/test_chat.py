"""Preference formatting against a plain Python version."""

import random

from pyspark.sql import Row

from harrow.llm import chat

SCHEMA = "pair_id long, chosen array<struct<turn:long,role:string,text:string>>, rejected array<struct<turn:long,role:string,text:string>>, prompt string"


def render(turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for _, r, t in turns)


def mask(turns):
    spans, pos = [], 0
    for turn in turns:
        text = render([turn])
        if turn[1] == "assistant":
            spans.append(f"{pos + len('<|im_start|>assistant') + 1}:{pos + len(text) - 1}")
        pos += len(text)
    return ",".join(spans)


def brute(chosen, rejected):
    n = 0
    if chosen is not None and rejected is not None:
        while n < min(len(chosen), len(rejected)) and chosen[n][1:] == rejected[n][1:]:
            n += 1
    c, r = (chosen or [])[n:], (rejected or [])[n:]
    return n, render((chosen or [])[:n]), render(c), mask(c), render(r), mask(r)


def test_formats_match(spark):
    rng, rows = random.Random(9), []
    for i in range(200):
        turns = [(k, rng.choice(["user", "assistant", "system"]), rng.choice(["hi", "é🎉 there", "", "x" * 300])) for k in range(rng.randrange(6))]
        other = turns[: rng.randrange(len(turns) + 1)] + [(k, "assistant", rng.choice("ab")) for k in range(rng.randrange(3))]
        rows.append((i, turns, other, "clash"))
    rows += [(900, None, rows[3][1], None), (901, rows[3][1], None, None), (902, None, None, None), (903, [], [], None)]
    for r in chat.format_preferences(spark.createDataFrame(rows, SCHEMA)).collect():
        _, chosen, rejected, _ = next(x for x in rows if x[0] == r.pair_id)
        assert (r.n_shared, r.prompt, r.chosen_text, r.chosen_mask, r.rejected_text, r.rejected_mask) == brute(chosen, rejected)


def test_branches(spark):
    rng, rows = random.Random(4), [(None, 0, "user", "x"), (4, 0, "assistant", None), (5, None, "assistant", "A5"), (5, 1, None, "t"), (5, 1, None, "t"), (7, 0, "assistant", "no partner")]
    for i in range(20, 80):
        rows += [(i, k, "user" if k % 2 == 0 else "assistant", rng.choice(["same", f"own {i}"])) for k in range(rng.randrange(7))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    turns = {}
    for i, *turn in sorted(((i, -1 if k is None else k, r or "", t or "") for i, k, r, t in rows if i is not None)):
        turns.setdefault(i, []).append(tuple(turn))
    got = {r.conv_id: r for r in chat.format_preferences(chat.branched(df)).collect()}
    assert set(got) == set(turns) and len({r.n_shared for r in got.values()}) > 4
    for i, own in turns.items():
        at = i % (len(own) + 1)
        r = got[i]
        want = brute(own, own[:at] + turns.get(i ^ 1, [])[at:])
        assert (r.n_shared, r.prompt, r.chosen_text, r.chosen_mask, r.rejected_text, r.rejected_mask) == want
    assert chat.format_preferences(chat.branched(df.limit(0))).count() == 0
    assert chat.ordered_turns(df).where("conv_id = 7").first().turns[0] == Row(turn=0, role="assistant", text="no partner")


def test_very_long_conversation(spark):
    """20,000 turns in time that grows like the power 1.5 of their number."""
    rows = [(0, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(20_000)]
    r = chat.format_preferences(chat.branched(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert r.chosen_mask == mask([x[1:] for x in rows]) and r.n_shared == 0
