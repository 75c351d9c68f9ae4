"""Which sections of a page a reasoning refers to, and the filtered view that follows from it.

``sections`` has (page_id, pos, section_id, content, role, interactive_count) and the reasoning about its page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions.regex import grab, java, let, strip

SIMILAR, MATCH, SECTIONS_PER_ELEMENT = 0.8, 0.5, 3
RADIUS, INDIRECT_RADIUS, INDIRECT_RATIO, INDIRECT_MOST, TOKEN_LENGTH, PREVIEW, HEAD, HEAD_TOKENS = 3, 1, 0.20, 15, 4, 80, 200, 8
#: How telling an attribute is; others count 0.3. Attributes that tell groups of elements apart.
WEIGHTS = {"data-testid": 1.0, "aria-label": 0.8, "id": 1.0, "name": 0.6, "href": 0.7, "placeholder": 0.5, "type": 0.1, "role": 0.1}
STRUCTURAL = ("data-testid", "name", "role", "type")


def words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, java(r"[\s\x1c-\x1f]+")), lambda w: w != "")


def multiset_similarity(pairs: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """(key, similarity): shared over all words of two texts, counted with repeats; 1 if both have none.

    Words are counted before the shuffle on (key, word); no text is compared with another directly."""
    side = lambda column, sign: pairs.select(key, F.explode(words(F.coalesce(column, F.lit("")))).alias("w"), F.lit(sign).alias("side"))
    counts = side(a, 0).union(side(b, 1)).groupBy(key, "w").agg(F.count_if(F.col("side") == 0).alias("x"), F.count_if(F.col("side") == 1).alias("y"))
    sums = counts.groupBy(key).agg(F.sum(F.least("x", "y")).alias("shared"), F.sum(F.greatest("x", "y")).alias("total"))
    return pairs.select(key).join(sums, key, "left").select(key, F.coalesce(F.col("shared") / F.col("total"), F.lit(1.0)).alias("similarity"))


def similarity(a: Column, b: Column) -> Column:
    """The same as one expression: the words of both texts are sorted and counted in one pass."""
    side = lambda text, n: F.transform(words(F.coalesce(text, F.lit(""))), lambda w: F.struct(w.alias("w"), F.lit(n).alias("side")))
    nothing = F.struct(F.lit(None).cast("string").alias("w"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("shared"), F.lit(0).alias("total"))

    def step(s: Column, r: Column) -> Column:
        same, mine = s["w"].eqNullSafe(r["w"]), r["side"] == 0
        x, y = F.when(same, s["x"]).otherwise(0), F.when(same, s["y"]).otherwise(0)
        done = lambda name, pick: F.when(same, s[name]).otherwise(s[name] + pick(s["x"], s["y"])).alias(name)
        return F.struct(r["w"].alias("w"), (x + F.when(mine, 1).otherwise(0)).alias("x"), (y + F.when(mine, 0).otherwise(1)).alias("y"), done("shared", F.least), done("total", F.greatest))

    def ratio(s: Column) -> Column:
        total = s["total"] + F.greatest(s["x"], s["y"])
        return F.when(total > 0, (s["shared"] + F.least(s["x"], s["y"])) / total).otherwise(1.0)

    return F.aggregate(F.array_sort(F.concat(side(a, 0), side(b, 1))), nothing, step, ratio)


def boundary_match(value: Column, text: Column) -> Column:
    """Whether value stands in text with no word character on either side."""
    quoted = F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?!\w)"))
    return F.call_function("rlike", text, quoted)


def element_score(element: Column, reasoning: Column) -> Column:
    """How strongly a reasoning refers to an element (tag, attributes, classes, element_text, full_tag_str)."""
    weights = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    full = element["full_tag_str"]

    def of(e: Column) -> Column:
        weight = F.coalesce(F.try_element_at(weights, e["key"]), F.lit(0.3))
        return (
            F.when((e["key"] == "class") | (F.coalesce(e["value"], F.lit("")) == ""), 0.0)
            .when(F.contains(reasoning, F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), weight)
            .when((F.length(e["value"]) >= 6) & boundary_match(e["value"], reasoning), weight * 0.6)
            .otherwise(0.0)
        )

    attributes = F.aggregate(F.map_entries(element["attributes"]), F.lit(0.0), lambda a, e: a + of(e))
    eligible = F.filter(element["classes"], lambda c: F.length(c) >= 4)
    found = F.size(F.filter(eligible, lambda c: boundary_match(c, reasoning)))
    by_class = F.when(F.size(eligible) > 0, found / F.size(eligible) * 0.4).otherwise(0.0)
    by_text = F.when((F.length(element["element_text"]) > 2) & boundary_match(element["element_text"], reasoning), 0.3).otherwise(0.0)
    return F.when((F.length(full) > 20) & F.contains(reasoning, full), 2.0).otherwise(attributes + F.coalesce(by_class, F.lit(0.0)) + F.coalesce(by_text, F.lit(0.0)))


def element_signature(element: Column) -> Column:
    parts = [F.when(F.map_contains_key(element["attributes"], a), F.concat(F.lit(f"{a}="), element["attributes"][a])) for a in STRUCTURAL]
    return F.concat_ws("|", element["tag"], *parts)


def matched_elements(elements: DataFrame) -> DataFrame:
    """elements (page_id, section_id, ord, element, reasoning) that match, with score and signature; of each signature on
    a page the three best stay (``kept``)."""
    scored = elements.withColumn("score", element_score(F.col("element"), F.col("reasoning"))).where(F.col("score") >= MATCH).withColumn("signature", element_signature(F.col("element")))
    best = Window.partitionBy("page_id", "signature").orderBy(F.desc("score"), "ord")
    return scored.withColumn("rank", F.row_number().over(best)).withColumn("kept", F.col("rank") <= SECTIONS_PER_ELEMENT)


def direct_references(sections: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """(page_id, section_id) whose id the reasoning names, and those kept by a matched element elsewhere."""
    named = sections.where(F.contains("reasoning", F.col("section_id"))).select("page_id", "section_id")
    if matched is None:
        return named.distinct()
    rest = matched.where("kept").select("page_id", "section_id").join(named, ["page_id", "section_id"], "left_anti")
    return named.union(rest).distinct()


def id_tokens(section_id: Column) -> Column:
    """Parts of a section id: four characters or more, not numbers, each once."""
    return F.array_distinct(F.filter(F.split(F.lower(section_id), "[-_]"), lambda p: (F.length(p) >= TOKEN_LENGTH) & ~p.rlike(r"^\d+$")))


def content_tokens(content: Column) -> Column:
    """Words of the first 200 characters: letters only, four or more, lower case, each once."""
    return F.array_distinct(F.filter(F.transform(words(F.left(content, F.lit(HEAD))), F.lower), lambda w: (F.length(w) >= TOKEN_LENGTH) & w.rlike(r"^\p{L}+$")))


def token_idf(sections: DataFrame) -> DataFrame:
    """(page_id, token, idf): ln(1 + sections / sections with the token), over ids and leading content."""
    total = sections.groupBy("page_id").agg(F.count("*").alias("n"))
    tokens = sections.select("page_id", F.explode(F.array_distinct(F.concat(id_tokens(F.col("section_id")), content_tokens(F.col("content"))))).alias("token"))
    return tokens.groupBy("page_id", "token").agg(F.count("*").alias("df")).join(total, "page_id").select("page_id", "token", F.log1p(F.col("n") / F.col("df")).alias("idf"))


def indirect_references(sections: DataFrame, referenced: DataFrame) -> DataFrame:
    """(page_id, section_id, score, source): the best of a page's other sections by tokens that the reasoning names,
    weighted by rarity; a fifth of all, 1 to 15."""
    idf = token_idf(sections)
    budget = sections.groupBy("page_id").agg(F.least(F.greatest(F.lit(1), F.floor(F.count("*") * INDIRECT_RATIO)), F.lit(INDIRECT_MOST)).alias("budget"))
    rest = sections.where(strip(F.col("reasoning")) != "").join(referenced.select("page_id", "section_id"), ["page_id", "section_id"], "left_anti")
    low = F.lower("reasoning")
    one = lambda tokens, source: rest.select("page_id", "section_id", "pos", F.explode(tokens).alias("token"), F.lit(source).alias("source"), low.alias("low"))
    tokens = one(id_tokens(F.col("section_id")), "id_tokens").union(one(F.slice(content_tokens(F.col("content")), 1, HEAD_TOKENS), "content"))
    weighed = tokens.withColumn("hit", boundary_match(F.col("token"), F.col("low"))).drop("low").join(idf, ["page_id", "token"])
    scored = weighed.groupBy("page_id", "section_id", "pos", "source").agg((F.sum(F.when(F.col("hit"), F.col("idf")).otherwise(0.0)) / F.sum("idf")).alias("score"))
    best = scored.groupBy("page_id", "section_id", "pos").agg(F.max(F.struct("score", (F.col("source") == "id_tokens").alias("first"))).alias("b"))
    best = best.select("page_id", "section_id", "pos", F.col("b.score").alias("score"), F.when(F.col("b.first"), "id_tokens").otherwise("content").alias("source")).where("score > 0")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "pos")))
    return ranked.join(budget, "page_id").where("rank <= budget").drop("budget", "rank", "pos")


def tiers(sections: DataFrame, referenced: DataFrame, indirect: DataFrame | None = None, radius: int = RADIUS, indirect_radius: int = INDIRECT_RADIUS) -> DataFrame:
    """sections with tier: kept, indirect, neighbor or distant. Neighbours are found by a window, without a join."""
    marked = sections.join(referenced.select("page_id", "section_id", F.lit(True).alias("is_kept")).distinct(), ["page_id", "section_id"], "left")
    if indirect is not None:
        marked = marked.join(indirect.select("page_id", "section_id", F.lit(True).alias("is_indirect")).distinct(), ["page_id", "section_id"], "left")
    else:
        marked = marked.withColumn("is_indirect", F.lit(None).cast("boolean"))
    marked = marked.withColumn("is_indirect", F.col("is_indirect") & F.col("is_kept").isNull())
    near = lambda r: Window.partitionBy("page_id").orderBy("pos").rowsBetween(-r, r)
    close = F.coalesce(F.max("is_kept").over(near(radius)), F.lit(False)) | F.coalesce(F.max("is_indirect").over(near(indirect_radius)), F.lit(False))
    tier = F.when(F.col("is_kept"), "kept").when(F.col("is_indirect"), "indirect").when(close, "neighbor").otherwise("distant")
    return marked.withColumn("tier", tier).drop("is_kept", "is_indirect")


def runs(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, value, start, end, n) of maximal runs of equal value: gaps and islands."""
    by = Window.partitionBy(key).orderBy(order)
    run = rows.withColumn("change", F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(by))).cast("int"), F.lit(1)))
    run = run.withColumn("run", F.sum("change").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(key, "run", value).agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n")).drop("run")


def section_header(section_id: Column, role: Column, interactive: Column) -> Column:
    return F.format_string("--- [%s] %s (%d interactive) ---", section_id, F.when(F.coalesce(role, F.lit("")) == "", "content").otherwise(role), F.coalesce(interactive, F.lit(0)))


def filtered_view(tiered: DataFrame) -> DataFrame:
    """(page_id, view): kept and indirect sections in full, neighbours as headers, runs of distant ones as one line."""
    by = Window.partitionBy("page_id").orderBy("pos")
    far = F.col("tier") == "distant"
    t = tiered.withColumn("run", F.sum(F.coalesce((far != F.lag(far).over(by)) | ~far, F.lit(True)).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    head = section_header(F.col("section_id"), F.col("role"), F.col("interactive_count"))
    body = F.when(F.col("tier").isin("kept", "indirect"), F.concat(head, F.lit("\n"), strip(F.col("content")))).when(F.col("tier") == "neighbor", F.concat(head, F.lit("\n[omitted]")))
    blocks = t.groupBy("page_id", "run").agg(F.min("pos").alias("pos"), F.first(body, ignorenulls=True).alias("body"), F.count("*").alias("n"))
    text = F.coalesce("body", F.format_string("[%d sections omitted]", F.col("n")))
    return blocks.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", text.alias("text")))), lambda x: x["text"]), "\n\n").alias("view"))


# ---- previews --------------------------------------------------------------------------------------------------------


def cut_at_word(text: Column, most: int) -> Column:
    """The beginning of text, up to a space in the second half of it, and three dots."""
    head = F.left(text, F.lit(most))
    space = F.length(head) - F.instr(F.reverse(head), " ")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.when((F.instr(head, " ") > 0) & (space > most // 2), F.left(head, space)).otherwise(head), F.lit("...")))


def cut_at_word_reverse(text: Column, most: int) -> Column:
    """Three dots and the end of text, from a space in the first half of it."""
    tail = F.right(text, F.lit(most))
    space = F.instr(tail, " ") - 1
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.lit("..."), F.when((space > 0) & (space < most // 2), F.substr(tail, space + 2)).otherwise(tail)))


def interactive_label(element: Column) -> Column:
    """tag "label" of an element, by its text or the first telling attribute; null without one."""
    attr = lambda a: F.when(element["attributes"][a] != "", element["attributes"][a])
    href = attr("href")
    label = F.coalesce(F.when(element["element_text"] != "", element["element_text"]), attr("aria-label"), attr("data-testid"), attr("placeholder"), F.when(F.length(href) > 40, F.concat(F.left(href, F.lit(40)), F.lit("..."))).otherwise(href))
    short = F.when(F.length(label) > 30, F.concat(F.left(label, F.lit(27)), F.lit("..."))).otherwise(label)
    return F.concat(element["tag"], F.lit(' "'), short, F.lit('"'))


def clean_line(text: Column) -> Column:
    return F.regexp_replace(F.replace(strip(text), F.lit("\n"), F.lit(" ")), " {2,}", " ")


def preview(content: Column, elements: Column | None = None, most: int = PREVIEW) -> Column:
    """One line on a section: its beginning and end, its length, and up to three elements."""
    clean = clean_line(content)
    text = F.when(F.length(clean) <= 2 * most, clean).otherwise(F.concat(cut_at_word(clean, most), F.lit(" ··· "), cut_at_word_reverse(clean, most)))
    labels = F.lit("")
    if elements is not None:
        named = F.filter(F.transform(F.slice(elements, 1, 3), interactive_label), lambda x: x.isNotNull())
        labels = F.when(F.size(named) > 0, F.concat(F.lit(" | "), F.array_join(named, ", "))).otherwise("")
    return F.concat(F.lit('[preview: "'), text, F.lit('" | '), F.length(strip(content)).cast("string"), F.lit(" chars"), F.coalesce(labels, F.lit("")), F.lit("]"))


def meta_line(section_id: Column, content: Column, interactive: Column, role: Column, labels: Column) -> Column:
    """A section as a line of the metadata block."""
    clean = F.replace(clean_line(content), F.lit("|"), F.lit("¦"))
    head, tail = F.left(clean, F.lit(100)), F.right(clean, F.lit(100))
    start = F.when(F.length(clean) <= 100, clean).when(F.instr(head, " ") > 0, grab(head, r"^(.*) ", 1, "s")).otherwise(head)
    end = F.when(F.length(clean) <= 100, "").when(F.instr(tail, " ") > 0, F.regexp_replace(tail, r"^[^ ]* ", "")).otherwise(tail)
    return F.concat_ws("|", section_id, F.length(strip(content)).cast("string"), interactive.cast("string"), role, start, end, F.array_join(labels, ";"))


def full_analysis_needed(views: DataFrame) -> DataFrame:
    """views (conv_id, turn, text) with full: whether a page differs by more than a fifth from the last one that was
    analysed in full. What counts as the last depends on all before, so a conversation is scanned in order, and its turns
    are gathered: it must fit into a worker, which the context window of a model sees to. For longer ones there is the
    streaming form, whose state is the words of one turn."""
    import pandas as pd

    from collections import Counter

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        base, out = None, []
        for text in pdf.sort_values("turn")["text"].fillna(""):
            own = Counter(text.split())
            total = sum((own | base).values()) if base is not None else 0
            full = base is None or (sum((own & base).values()) / total if total else 1.0) < SIMILAR
            base = own if full else base
            out.append(full)
        return pdf.sort_values("turn")[["conv_id", "turn"]].assign(full=out)

    return views.select("conv_id", "turn", "text").groupBy("conv_id").applyInPandas(scan, "conv_id long, turn long, full boolean")
