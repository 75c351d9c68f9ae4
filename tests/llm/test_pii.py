"""Base spans against Python's own patterns; the voted additions on planted text."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from harrow.llm import pii

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def brute(text):
    spans = []
    for n, kind in enumerate(KINDS):
        for m in re.finditer(PATTERNS[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                spans.append((m.start(), n, m.end()))
    spans.sort()
    return [sum(s[1] == n for s in spans) for n in range(4)], hashlib.sha256(",".join(f"{KINDS[n]}:{s}:{e}" for s, n, e in spans).encode()).hexdigest()


def odd_texts():
    rng = random.Random(11)
    texts = [None, "", "a@b.com+x@y.z.w é🎉 q@r.st", "1.2.3.4.5.6.7.8 999.1.1.1 001.002.003.004", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (017) 555-7713) +49 30 1234567-", "@" * 50, "1" * 9000, "a" * 60000, "1." * 3000, "+1" * 3000, "é x@y.zz, " * 300]
    for _ in range(400):
        texts.append("".join(rng.choice(["a", "1", "4", ".", "@", "-", " ", "+", "(", ")", "é", "🎉", "_", "%", "b.c", "1.2.3", "4111 1111 1111 1111"]) for _ in range(rng.randrange(50))))
    return texts


def test_base_spans_match_brute_force(spark):
    texts = odd_texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(4)
    rows = {r.doc_id: r for r in pii.personal_data(df).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        counts, digest = brute(text)
        r = rows[i]
        assert ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) == (counts, digest), text
        base = ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.span_list if s.base)
        assert hashlib.sha256(base.encode()).hexdigest() == digest


def test_votes_add_spans_and_redact(spark):
    good = ["please call me at (415) 555-0134 today", "my ssn 123-45-6789 is here", "write to jane [at] mail [dot] com now", "regards, Dr. Mary Smith"] * 30
    bad = ["see version 415.555.0134x of it", "order 000 000 0000 went out", "serial 000-00-0000 as printed"] * 30
    base = ["mail bob@site.org or +1 415 555 0134 ok"] * 30
    rows = [(i, t) for i, t in enumerate([*good, *bad, *base, None, "nothing here"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.personal_data(df).collect()}
    assert [got[i] for i in range(4)] == ["phone:18:32", "ssn:7:18", "email:9:33", "name:9:23"]
    assert got[120] == got[121] == got[122] == "" and got[241] == got[240] == ""
    text = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert text[0] == "please call me at [PHONE] today" and text[210] == "mail [EMAIL] or [PHONE] ok"
    assert text[240] is None and text[241] == "nothing here" and text[120] == rows[120][1]


def test_many_spans_take_linear_time(spark):
    """Texts of 50,000 spans; overlapping kinds; a replaced text of many blocks."""
    mails = " ".join(f"user{i}@mail{i}.org" for i in range(50_000))
    mixed = " ".join(f"call (415) 555-{i % 10000:04d} or +1 415 555 {i % 10000:04d} at 10.0.{i % 256}.1" for i in range(17_000))
    df = spark.createDataFrame([(1, mails), (2, mixed), (3, "no " * 50_000)], "doc_id long, text string")
    began = time.monotonic()
    rows = {r.doc_id: r for r in pii.personal_data(df).collect()}
    text = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert time.monotonic() - began < 60
    for i, t in ((1, mails), (2, mixed)):
        counts, digest = brute(t)
        assert ([rows[i].n_email, rows[i].n_ip, rows[i].n_card, rows[i].n_phone], rows[i].base_sha256) == (counts, digest)
    assert text[1] == " ".join(["[EMAIL]"] * 50_000) and text[3] == "no " * 50_000
    assert text[2].startswith("call [PHONE] or [PHONE] at [IP] call") and text[2].count("[IP]") == 17_000


def test_added_spans_lie_outside_base_ones(spark):
    """Added spans against a plain search: loose matches that overlap with no base span, of which the classifier keeps some."""
    rng = random.Random(3)
    bits = ["a@b.com", "+1 415 555 0134", "(415) 555-0134", "123-45-6789", "10.1.1.1", "Dr. Mary Smith", "x", "DE89 3704 0044 0532 0130 00", "4111 1111 1111 1111", "415.555.0134", "jane [at] mail [dot] com"]
    texts = [rng.choice(["", " ", ", "]).join(rng.choice(bits) for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", pii._candidates(F.col("text")).alias("c"))
    loose = re.compile(r"(?<![A-Za-z0-9+(.-])(?:" + "|".join(f"(?:{p.replace('(?i:at)', '[aA][tT]').replace('(?i:dot)', '[dD][oO][tT]')})" for p in pii.LOOSE.values()) + ")")
    for r in df.collect():
        base = [(s.start, s.end) for s in r.c or [] if s.base]
        want = sorted((m.start(), m.end()) for m in loose.finditer(texts[r.doc_id]) if not any(b < m.end() and m.start() < e for b, e in base))
        assert sorted((s.start, s.end) for s in r.c or [] if not s.base) == want, texts[r.doc_id]


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.personal_data(empty).count() == 0 and pii.redacted(empty).count() == 0


@pytest.mark.parametrize("share", [0.2, 0.7])
def test_reliabilities_separate_two_classes(share):
    rng, counts = random.Random(4), {}
    for _ in range(4000):
        yes = rng.random() < share
        votes = tuple((1 if yes else -1) if rng.random() < a else 0 if rng.random() < 0.5 else (-1 if yes else 1) for a in (0.9, 0.8, 0.7, 0.6, 0.5, 0.8))
        counts[votes] = counts.get(votes, 0) + 1
    prior, tables = pii.reliabilities(counts)
    assert abs(prior - share) < 0.1
    assert pii.posterior_of((1, 1, 1, 0, 0, 1), prior, tables) > 0.9 > 0.1 > pii.posterior_of((-1, -1, -1, 0, 0, -1), prior, tables)
