"""Personal data by weak supervision, in DataFrame functions only.

Base patterns (email, ip, card, phone) always count. Looser candidates (spelled-out addresses, national phone numbers,
social security numbers, bank accounts, titled names) are voted on by labelers: formats (regex), lists (gazetteer) and
neighbouring words (context). Expectation-maximisation over the counts of vote patterns estimates how reliable each
labeler is; its posteriors train a final classifier on features of the span, which decides on the candidates. Only the
pattern counts, whose number is bounded by the labelers and features, reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import let, running, settle

KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "name")

# The base patterns, in forms that match the same spans in linear time: a match begins where a run of its first
# characters does, or where the last match ended, and repeats don't give characters back.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"[A-Za-z0-9._-]{2,40} ?[\[(](?i:at)[\])] ?[A-Za-z0-9-]{2,40} ?[\[(](?i:dot)[\])] ?[A-Za-z]{2,10}",
    "phone": r"(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?![A-Z0-9])",
    "name": r"(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]{1,20}(?: [A-Z][a-z]{1,20})?",
}
ANY_LOOSE = r"(?<![A-Za-z0-9+(.-])(?:" + "|".join(f"(?:{p})" for p in LOOSE.values()) + ")"

# Lists of the gazetteer labeler (fixed values).
FIRST_NAMES = (
    "james|mary|robert|patricia|john|jennifer|michael|linda|david|elizabeth|william|barbara|richard|susan|joseph|jessica|thomas|sarah|"
    "charles|karen|anna|peter|paul|maria|hans|jean|marie|pierre|carlos|juan|jose|luis|anita|ahmed|fatima|wei|yuki|ivan|olga"
)
TOP_DOMAINS = "com|org|net|edu|gov|io|info|de|fr|es|uk|it|nl|eu|us|ca|au|jp|cn|in|br|ch|at"
IBAN_LANDS = "DE|FR|ES|GB|IT|NL|BE|CH|AT|PT|IE|PL|SE|DK|NO|FI"
WORDS_FOR = (
    r"(?i)(?:phone|call|tel|mobile|cell|fax|contact|reach|mail|write to|address|ssn|social security|account|iban|bank|card|visa|signed|patient|"
    r"telefon|anruf|konto|t.l.phone|compte|tel.fono|correo|cuenta|name|ip|host|server)\W*\w*\W*$"
)
WORDS_AGAINST = r"(?i)(?:version|v|isbn|issn|part no|order|item|page|figure|section|chapter|article|model|serial|rfc|doi|\$|€|£)\W*$"
LABELERS = ("format", "listed", "context", "against", "variety", "edges")


def _spans(text: Column, pattern: str) -> Column:
    """Matches with their code-point bounds and neighbourhood: array<struct<m, start, end, before, after>>."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    none = F.from_json(F.lit("[]"), "array<struct<m:string,start:int,end:int,before:string,after:string>>")

    def placed(rows: Column) -> Column:
        ends = running(F.transform(rows, lambda r: F.length(r["g"]) + F.length(r["m"])), lambda a, b: a + b)
        return F.zip_with(
            rows, ends, lambda r, end: F.struct(r["m"].alias("m"), (end - F.length(r["m"])).alias("start"), end.alias("end"), F.right(r["g"], F.lit(40)).alias("before"), F.left(r["h"], F.lit(1)).alias("after"))
        )

    def rows(found: Column) -> Column:
        each = lambda gaps: F.arrays_zip(found.alias("m"), F.slice(gaps, F.lit(1), F.size(found)).alias("g"), F.slice(gaps, F.lit(2), F.size(found)).alias("h"))
        return F.when(F.size(found) > 0, let(let(gaps, each), placed)).otherwise(none)

    return let(found, rows)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return F.length(_digits(m)).between(14, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def _votes(kind: Column, m: Column, before: Column, after: Column, base: Column) -> list[Column]:
    """1 for, -1 against, 0 no opinion, in the order of LABELERS."""
    digits = _digits(m)
    sign = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    strict = base | (kind == "phone") & m.rlike(r"^\([0-9]{3}\) ?[0-9]{3}-|^([0-9]{3})([ .-])[0-9]{3}\2") | (kind == "ssn") & ~m.rlike("^(?:000|666|9)|-00-|-0000$") | (kind == "iban") & (F.length(F.replace(m, F.lit(" "))) >= 15) | (kind == "email")
    listed = (kind == "email") & m.rlike(rf"(?i)\W(?:{TOP_DOMAINS})$") | (kind == "iban") & m.rlike(f"^(?:{IBAN_LANDS})") | (kind == "name") & m.rlike(rf"(?i)\b(?:{FIRST_NAMES})\b") | (kind == "card") & digits.rlike("^[3-6]")
    unlisted = (kind == "iban") | (kind == "phone") & ~base & m.rlike(r"^\(?[01]")
    same = digits.rlike(r"^([0-9])\1*$") & (F.length(digits) > 0)
    glued = before.rlike(r"[A-Za-z0-9_#$/=-]$") | after.rlike("^[A-Za-z0-9_#/=-]")
    return [sign(strict, F.lit(False)), sign(listed, unlisted), sign(before.rlike(WORDS_FOR), F.lit(False)), sign(F.lit(False), before.rlike(WORDS_AGAINST)), sign(F.lit(False), same), sign(~glued, glued)]


def _features(kind: Column, m: Column, before: Column, after: Column) -> list[Column]:
    """Bucketed features of the final classifier."""
    share = F.length(_digits(m)) * 4 / F.length(m)
    return [kind, F.concat_ws(" ", kind, F.least(F.length(m), F.lit(30)).cast("string")), F.concat_ws(" ", kind, F.floor(share).cast("string")), F.when(before.rlike(WORDS_FOR), "for").when(before.rlike(WORDS_AGAINST), "against").otherwise("none"), F.when(before == "", "start").when(before.rlike(r"\s$"), "space").otherwise("other")]


def _outside(found: Column) -> Column:
    """The base spans, and those others of a known kind that overlap with none of them, ordered by what they are placed by.

    A span is placed by its start if it is base, else by its end, before base spans that begin there: those before it
    begin before its end, so it overlaps with one of them if the largest of their ends is past its start."""
    known = F.filter(found, lambda s: s["base"] | s["kind"].isNotNull())
    keyed = F.array_sort(F.transform(known, lambda s: F.struct(F.when(s["base"], s["start"]).otherwise(s["end"]).alias("at"), s["base"].cast("int").alias("late"), s.alias("s"))))

    def free(spans: Column) -> Column:
        reach = running(F.transform(spans, lambda r: F.when(r["late"] == 1, r["s"]["end"]).otherwise(-1)), F.greatest, -1)
        kept = F.filter(F.arrays_zip(spans.alias("r"), reach.alias("reach")), lambda x: (x["r"]["late"] == 1) | (x["reach"] <= x["r"]["s"]["start"]))
        return F.transform(kept, lambda x: x["r"]["s"])

    return F.when(F.exists(known, lambda s: ~s["base"]) & F.exists(known, lambda s: s["base"]), let(keyed, free)).otherwise(known)


def _candidates(text: Column) -> Column:
    """Every base match and every loose candidate outside them, with votes and features; null if there is none."""
    every = []
    for kind in KINDS[:4]:
        gate = text.contains("@") if kind == "email" else text.contains("+") if kind == "phone" else text.rlike("[0-9]")
        good = F.filter(_spans(text, BASE[kind]), lambda s: _valid(kind, s["m"]))
        every.append(F.when(gate, F.transform(good, lambda s: s.withField("kind", F.lit(kind)).withField("base", F.lit(True)))))
    loose_kind = lambda m: F.coalesce(*[F.when(m.rlike(f"^(?:{p})$"), k) for k, p in LOOSE.items()])
    loose = F.transform(_spans(text, ANY_LOOSE), lambda s: s.withField("kind", loose_kind(s["m"])).withField("base", F.lit(False)))
    every.append(F.when(text.rlike(r"[0-9]{3}|\((?i:dot)\)|\[(?i:dot)\]|(?:Mr|Mrs|Ms|Dr|Prof)\b"), loose))
    empty = F.from_json(F.lit("[]"), "array<struct<m:string,start:int,end:int,before:string,after:string,kind:string,base:boolean>>")
    found = F.concat(*[F.coalesce(e, empty) for e in every])

    def described(found: Column) -> Column:
        return F.transform(
            found,
            lambda s: F.struct(
                s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base"),
                F.concat_ws(",", F.array(*_votes(s["kind"], s["m"], s["before"], s["after"], s["base"])).cast("array<string>")).alias("votes"),
                F.array(*_features(s["kind"], s["m"], s["before"], s["after"])).alias("features"),
            ),
        )

    return let(found, lambda x: F.when(F.size(x) > 0, described(_outside(x))))


def reliabilities(patterns: dict[tuple[int, ...], int], rounds: int = 50) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """Expectation-maximisation over vote patterns and their counts: the prior, and for each labeler the probability of
    each vote for spans that are (second) and aren't (first) personal data. Started from the majority of the votes."""
    posterior = {p: 0.5 + 0.45 * max(-1.0, min(1.0, sum(p) / 2)) for p in patterns}
    prior, tables = 0.5, []
    for _ in range(rounds):
        total = sum(patterns.values())
        yes = sum(n * posterior[p] for p, n in patterns.items())
        prior = (yes + 1) / (total + 2)
        tables = []
        for i in range(len(LABELERS)):
            table = {}
            for vote in (-1, 0, 1):
                y = sum(n * posterior[p] for p, n in patterns.items() if p[i] == vote)
                a = sum(n for p, n in patterns.items() if p[i] == vote)
                table[vote] = ((a - y + 1) / (total - yes + 3), (y + 1) / (yes + 3))
            tables.append(table)
        posterior = {p: posterior_of(p, prior, tables) for p in patterns}
    return prior, tables


def posterior_of(pattern: tuple[int, ...], prior: float, tables: list[dict[int, tuple[float, float]]]) -> float:
    odds = math.log(prior / (1 - prior)) + sum(math.log(t[v][1] / t[v][0]) for t, v in zip(tables, pattern))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def train(found: DataFrame) -> tuple[dict[str, float], float]:
    """Weights of the final classifier's features ('number:value') and its bias, from all spans of found."""
    spans = found.select(F.explode("spans").alias("s")).select("s.votes", "s.features")
    counts = [(tuple(map(int, r.votes.split(","))), r.n) for r in spans.groupBy("votes").agg(F.count("*").alias("n")).collect()]
    if not counts:
        return {}, 0.0
    prior, tables = reliabilities(dict(counts))
    cells = spans.select("votes", F.posexplode("features").alias("i", "value")).groupBy("votes", "i", "value").agg(F.count("*").alias("n")).collect()
    yes, no = {}, {}
    for r in cells:
        p = posterior_of(tuple(map(int, r.votes.split(","))), prior, tables)
        key = f"{r.i}:{r.value}"
        yes[key], no[key] = yes.get(key, 0) + r.n * p, no.get(key, 0) + r.n * (1 - p)
    all_yes = sum(v for k, v in yes.items() if k.startswith("0:"))
    all_no = sum(v for k, v in no.items() if k.startswith("0:"))
    weights = {k: math.log((yes[k] + 1) / (all_yes + 2)) - math.log((no[k] + 1) / (all_no + 2)) for k in yes}
    return weights, math.log((all_yes + 1) / (all_no + 1))


def _decided(spans: Column, weights: dict[str, float], bias: float) -> Column:
    """Those of the spans that are base or that the final classifier accepts, ordered by start, then kind."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    keep = lambda s: s["base"]
    if weights:
        table = F.create_map(*[F.lit(x) for k, w in sorted(weights.items()) for x in (k, w)])
        score = lambda s: F.aggregate(F.transform(s["features"], lambda v, i: F.coalesce(F.try_element_at(table, F.concat(i.cast("string"), F.lit(":"), v)), F.lit(0.0))), F.lit(bias), lambda a, b: a + b)
        keep = lambda s: s["base"] | (score(s) > 0)
    none = F.from_json(F.lit("[]"), "array<struct<start:int,kind_no:int,end:int,kind:string,base:boolean>>")
    fields = lambda s: F.struct(s["start"].alias("start"), F.element_at(order, s["kind"]).alias("kind_no"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base"))
    return F.coalesce(F.array_sort(F.transform(F.filter(spans, keep), fields)), none)


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): n_email, n_ip, n_card, n_phone of the base patterns, base_sha256, spans
    (kind:start:end of base and accepted spans, comma-joined), and span_list (array of struct).

    Bounds count code points, end exclusive. Null text is empty; repeated rows give repeated rows; other columns are
    ignored; without candidates anywhere nothing is added. The text is scanned once; spans are kept in a checkpoint.
    """
    found = settle(docs.select(F.col("doc_id").cast("long"), _candidates(F.coalesce("text", F.lit(""))).alias("spans")))
    found = found.select("doc_id", _decided(F.col("spans"), *train(found)).alias("spans"))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    digest = F.sha2(said(F.filter("spans", lambda s: s["base"])).cast("binary"), 256)
    return found.select("doc_id", *[count(k) for k in KINDS[:4]], digest.alias("base_sha256"), said(F.col("spans")).alias("spans"), F.col("spans").alias("span_list"))


#: Code points of a block of text: a piece is cut from the blocks it lies in, as cutting reads a string from its start.
BLOCK = 4096


def _replace(text: Column, spans: Column) -> Column:
    """text with the ordered spans replaced by [KIND]; what a span overlaps with the one before goes with that one."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def piece(blocks: Column, begin: Column, end: Column) -> Column:
        first = F.floor(begin / BLOCK).cast("int")
        own = F.slice(blocks, first + 1, F.floor(F.greatest(end - 1, begin) / BLOCK).cast("int") - first + 1)
        return F.substr(F.array_join(own, ""), begin - first * BLOCK + 1, end - begin)

    def shown(spans: Column, reach: Column, blocks: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.slice(reach, F.lit(1), F.size(spans) - 1))
        fresh = F.filter(F.arrays_zip(spans.alias("s"), before.alias("at")), lambda x: x["s"]["start"] >= x["at"])
        parts = F.transform(fresh, lambda x: F.concat(piece(blocks, x["at"], x["s"]["start"]), F.lit("["), F.upper(x["s"]["kind"]), F.lit("]")))
        return F.concat(F.array_join(parts, ""), piece(blocks, F.element_at(reach, -1), F.length(text)))

    ends = running(F.transform(spans, lambda s: s["end"]), F.greatest)
    return let(blocks, lambda b: let(ends, lambda reach: shown(spans, reach, b)))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each personal span of text replaced by its kind in brackets, as in [EMAIL]; all columns are kept.

    Overlapping spans are replaced as one, by the first's kind. Texts without spans, and nulls, are returned as they
    are. The text is scanned twice, to learn and to replace; nothing but pattern counts is shuffled."""
    found = _candidates(F.coalesce("text", F.lit("")))
    weights, bias = train(docs.select(found.alias("spans")))
    text = let(_decided(found, weights, bias), lambda s: F.when(F.size(s) > 0, _replace(F.col("text"), s)).otherwise(F.col("text")))
    return docs.withColumn("text", text)
