"""Statistics, trimming and compaction of agent transcripts.

``messages`` has (conv_id, idx, role, blocks), blocks an array of (type, text, name, input, content, is_error); turns
with plain text are messages of one text block. Windows run within a conversation; sums are partial before a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions.regex import grab, let, strip

BLOCK = "struct<type:string,text:string,name:string,input:string,content:string,is_error:boolean>"
SIZE_BUCKETS = (("<1K", 1_000), ("1-5K", 5_000), ("5-20K", 20_000), ("20-100K", 100_000), (">100K", None))
#: Turns after which a page view becomes a skeleton, and a stub; messages a history holds, and keeps when trimmed.
SKELETON_AGE, STUB_AGE, MAX_MESSAGES, KEEP_MESSAGES = 2, 5, 80, 60
#: Compression: messages and estimated tokens it takes at least, interactions it leaves, tokens from which it is split.
LEAST_MESSAGES, LEAST_TOKENS, KEEP_PAIRS, SPLIT_TOKENS, THREE_WAY_TOKENS = 4, 3_000, 5, 20_000, 40_000
VIEW_START, VIEW_END, ZOOM_START, ZOOM_END = "__PAGE_VIEW_START__", "__PAGE_VIEW_END__", "__ZOOM_START__", "__ZOOM_END__"
OMITTED = "[Earlier exploration steps omitted. The above shows your initial task and page view. Recent steps follow.]"
META_START, META_END = "__SECTION_META__", "__SECTION_META_END__"


def from_turns(turns: DataFrame) -> DataFrame:
    """Messages of a table (conv_id, turn, role, text)."""
    none = F.lit(None).cast("string")
    block = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), none.alias("name"), none.alias("input"), none.alias("content"), F.lit(False).alias("is_error"))
    return turns.select("conv_id", F.col("turn").alias("idx"), "role", F.array(block).alias("blocks"))


# ---- sizes -----------------------------------------------------------------------------------------------------------


def block_chars(b: Column) -> Column:
    """Characters of a block that count towards its size."""
    n = lambda c: F.coalesce(F.length(c), F.lit(0))
    return n(b["content"]) + F.when(b["type"] == "text", n(b["text"])).otherwise(0) + F.when(b["type"] == "tool_use", n(b["input"])).otherwise(0)


def message_chars(blocks: Column) -> Column:
    return F.aggregate(blocks, F.lit(0).cast("long"), lambda a, b: a + block_chars(b))


def estimated_tokens(chars: Column) -> Column:
    """Four characters a token."""
    return F.floor(chars / 4)


def sized(messages: DataFrame) -> DataFrame:
    """messages with chars and tokens."""
    return messages.withColumn("chars", message_chars(F.col("blocks"))).withColumn("tokens", estimated_tokens(F.col("chars")))


def role_stats(messages: DataFrame) -> DataFrame:
    """Number, characters and estimated tokens of messages by role."""
    return sized(messages).groupBy("role").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"))


def content_type_stats(messages: DataFrame) -> DataFrame:
    """Number and characters of blocks by type; tool calls by name."""
    blocks = messages.select(F.explode("blocks").alias("b"))
    kind = F.when(F.col("b.type") == "tool_use", F.concat(F.lit("tool_use:"), F.coalesce("b.name", F.lit("?")))).otherwise(F.col("b.type"))
    return blocks.groupBy(kind.alias("content_type")).agg(F.count("*").alias("n"), F.sum(block_chars(F.col("b"))).alias("chars"))


def size_bucket(chars: Column) -> Column:
    chain = F.when(chars < SIZE_BUCKETS[0][1], SIZE_BUCKETS[0][0])
    for label, top in SIZE_BUCKETS[1:-1]:
        chain = chain.when(chars < top, label)
    return chain.otherwise(SIZE_BUCKETS[-1][0])


def size_histogram(sizes: DataFrame, chars: str = "chars") -> DataFrame:
    """(bucket, n) of a column of sizes, with a row for every bucket."""
    spark = sizes.sparkSession
    buckets = spark.createDataFrame([(label,) for label, _ in SIZE_BUCKETS], "bucket string")
    counts = sizes.groupBy(size_bucket(F.col(chars)).alias("bucket")).agg(F.count("*").alias("n"))
    return buckets.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def largest(messages: DataFrame, k: int = 10) -> DataFrame:
    """The k largest messages: one top-k, no full sort."""
    return sized(messages).orderBy(F.desc("chars"), "conv_id", "idx").limit(k).select("conv_id", "idx", "role", "chars")


def coverage(messages: DataFrame, share: float = 0.8) -> DataFrame:
    """By conversation, how many of the largest messages hold the given share of all characters."""
    by_size = Window.partitionBy("conv_id").orderBy(F.desc("chars"), "idx")
    ranked = sized(messages).select("conv_id", "idx", "chars").withColumns({"rank": F.row_number().over(by_size), "running": F.sum("chars").over(by_size.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("chars").over(Window.partitionBy("conv_id"))})
    return ranked.where(F.col("running") >= F.col("total") * share).groupBy("conv_id").agg(F.min("rank").alias("n_messages"))


def hotspots(messages: DataFrame) -> DataFrame:
    """Characters by what they are spent on, one row."""
    m = sized(messages)
    of = lambda kind: F.aggregate(F.filter("blocks", lambda b: b["type"] == kind), F.lit(0).cast("long"), lambda a, b: a + block_chars(b))
    views = F.aggregate(F.filter("blocks", lambda b: (b["type"] == "tool_result") & (block_chars(b) > 5000)), F.lit(0).cast("long"), lambda a, b: a + block_chars(b))
    has_result, user, agent = F.exists("blocks", lambda b: b["type"] == "tool_result"), F.col("role") == "user", F.col("role") == "assistant"
    total = lambda cond, what, name: F.coalesce(F.sum(F.when(cond, what)), F.lit(0)).alias(name)
    return m.agg(
        total(user & ~has_result & (F.col("chars") >= 200), F.col("chars"), "task_messages"), total(agent, of("text"), "agent_text"), total(agent, of("tool_use"), "agent_code"),
        total(user & has_result, views, "page_views"), total(user & has_result, of("tool_result") - views, "other_results"), total(user & ~has_result & (F.col("chars") < 200), F.col("chars"), "nudges"),
    )


def growth(usage: DataFrame) -> DataFrame:
    """By conversation of usage (conv_id, turn, input_tokens): mean change a turn, the largest, and its turn (first on ties)."""
    by_turn = Window.partitionBy("conv_id").orderBy("turn")
    steps = usage.withColumn("delta", F.col("input_tokens") - F.lag("input_tokens").over(by_turn)).where("delta is not null")
    return steps.groupBy("conv_id").agg(F.avg("delta").alias("avg_delta"), F.max("delta").alias("max_delta"), F.max_by("turn", F.struct("delta", -F.col("turn"))).alias("max_turn"))


def cumulative(usage: DataFrame, columns=("input_tokens", "output_tokens")) -> DataFrame:
    """usage with running totals of its columns by turn."""
    running = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return usage.withColumns({f"cumulative_{c}": F.sum(c).over(running) for c in columns})


def tool_summary(calls: DataFrame) -> DataFrame:
    """calls (name, duration_ms, content, is_error) by tool, with each tool's share of the time."""
    n = F.coalesce(F.length("content"), F.lit(0))
    by = calls.groupBy(F.coalesce("name", F.lit("?")).alias("name")).agg(
        F.count("*").alias("n"), F.sum("duration_ms").alias("total_ms"), F.avg("duration_ms").alias("avg_ms"), F.max("duration_ms").alias("max_ms"), F.sum(n).alias("chars"), F.max(n).alias("max_chars"),
        F.count_if("is_error").alias("errors"),
    )
    whole = F.sum("total_ms").over(Window.partitionBy())  # one row a tool
    return by.withColumn("share", F.when(whole > 0, F.col("total_ms") / whole).otherwise(0.0))


def filter_savings(analyses: DataFrame) -> DataFrame:
    """Totals of analyses (total_page_chars, filtered_page_chars) and what the filter saves, one row."""
    sums = analyses.agg(F.count("*").alias("n"), F.sum("total_page_chars").alias("total_chars"), F.sum("filtered_page_chars").alias("filtered_chars"))
    return sums.withColumn("saved", F.when(F.col("total_chars") > 0, 1 - F.col("filtered_chars") / F.col("total_chars")).otherwise(0.0))


# ---- prices and thresholds -------------------------------------------------------------------------------------------


def bare_model(model: Column) -> Column:
    """A model's name without its provider."""
    return F.when(F.contains(model, F.lit(":")), F.regexp_replace(model, "^[^:]*:", "")).otherwise(model)


def with_prefix_match(rows: DataFrame, model: str, table: DataFrame, key: str) -> DataFrame:
    """rows with the row of a small table whose key is the bare model name or its longest prefix; nulls without one.

    The table holds a price list: a few hundred rows, whatever the data. It is broadcast."""
    name = bare_model(F.col(model))
    names = rows.select(model).distinct()
    best = names.join(F.broadcast(table), F.expr(f"startswith({_sql_bare(model)}, {key})"), "left")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy(model).orderBy(F.desc_nulls_last(F.length(key)), key))).where("rank = 1").drop("rank")
    return rows.join(ranked, model, "left").withColumn("bare_model", name)


def _sql_bare(model: str) -> str:
    return f"if(contains({model}, ':'), regexp_replace({model}, '^[^:]*:', ''), {model})"


def cost(input_tokens: Column, output_tokens: Column, cache_read: Column, cache_create: Column, prices: dict[str, Column]) -> Column:
    """Price in dollars of token counts, prices by the million; cached tokens are billed at their own rates."""
    billed = F.greatest(input_tokens - cache_read - cache_create, F.lit(0))
    parts = ((billed, "input"), (output_tokens, "output"), (cache_read, "cache_read"), (cache_create, "cache_write"))
    total = F.lit(0.0)
    for n, name in parts:
        total = total + n / 1e6 * prices[name]
    return total


def cost_by_price(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """What total usage (input_tokens, output_tokens, cache_read, cache_create) would cost at every row of a price list."""
    total = usage.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "cache_read", "cache_create")])
    both = total.crossJoin(F.broadcast(prices))  # one row against a price list
    return both.select("model", cost(*[F.col(c) for c in ("input_tokens", "output_tokens", "cache_read", "cache_create")], {c: F.col(c + "_price") for c in ("input", "output", "cache_read", "cache_write")}).alias("cost"))


def trigger_fraction(model: Column) -> Column:
    """Share of the context window from which a history is compressed, by the words in a model's name."""
    name = F.lower(bare_model(model))
    small = name.contains("mini") | name.contains("nano") | name.contains("small") | name.contains("lite")
    return F.when(name.contains("claude"), F.when(name.contains("haiku"), 0.65).when(name.contains("opus"), 0.80).otherwise(0.75)).when(small, 0.20).otherwise(0.40)


def compression_threshold(window: Column, fraction: Column) -> Column:
    return F.floor(window * fraction)


# ---- history ---------------------------------------------------------------------------------------------------------


def is_tool_result(role: Column, blocks: Column) -> Column:
    return (role == "user") & F.exists(blocks, lambda b: b["type"] == "tool_result")


def _plain(blocks: Column) -> Column:
    """The text of a message that is one text block; empty otherwise."""
    return F.when((F.size(blocks) == 1) & (F.try_element_at(blocks, F.lit(1))["type"] == "text"), F.try_element_at(blocks, F.lit(1))["text"]).otherwise("")


def is_rejection(role: Column, blocks: Column) -> Column:
    text = _plain(blocks)
    return (role == "user") & (text.contains("## Function Rejected") | text.contains("VALIDATION RESULT") | text.contains("Script rejected"))


def is_script_submission(role: Column, blocks: Column) -> Column:
    return (role == "assistant") & F.exists(blocks, lambda b: (b["type"] == "text") & b["text"].contains("async def scrape("))


def trimmed(messages: DataFrame, most: int = MAX_MESSAGES, keep: int = KEEP_MESSAGES) -> DataFrame:
    """Histories of more than ``most`` messages cut to the first, a marker, and the last ``keep`` without leading tool
    results; shorter ones as they are. Columns conv_id, idx, role, blocks; the marker's idx is half past the first's."""
    by = Window.partitionBy("conv_id")
    m = messages.withColumns({"n": F.count("*").over(by), "asc": F.row_number().over(by.orderBy("idx")), "desc": F.row_number().over(by.orderBy(F.desc("idx")))})
    recent = F.col("desc") <= keep
    sound = F.max(F.when(recent & ~is_tool_result(F.col("role"), F.col("blocks")), 1)).over(by.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    kept = m.withColumn("sound", sound).where((F.col("n") <= most) | (F.col("asc") == 1) | (recent & F.col("sound").isNotNull()))
    none = F.lit(None).cast("string")
    note = F.array(F.struct(F.lit("text").alias("type"), F.lit(OMITTED).alias("text"), none.alias("name"), none.alias("input"), none.alias("content"), F.lit(False).alias("is_error")))
    marker = kept.where((F.col("n") > most) & (F.col("asc") == 1)).select("conv_id", (F.col("idx") + 0.5).alias("idx"), F.lit("user").alias("role"), note.alias("blocks"))
    return kept.select("conv_id", F.col("idx").cast("double").alias("idx"), "role", "blocks").unionByName(marker)


def compression_plan(messages: DataFrame, summary_marker: str) -> DataFrame:
    """By conversation: where a compression would begin and end, what it would hold, and whether it is worth it.

    It begins after the last summary (or the first message) and leaves the last five pairs of an assistant's and a
    user's message; the latest rejection, with the submission before it, is protected."""
    by = Window.partitionBy("conv_id").orderBy("idx")
    m = sized(messages).withColumns({"pos": F.row_number().over(by) - 1, "before": F.lag("role").over(by)})
    m = m.withColumns({"summary": _plain(F.col("blocks")).startswith(summary_marker), "pair": (F.col("role") == "user") & (F.col("before") == "assistant")})
    back = Window.partitionBy("conv_id").orderBy(F.desc("pos"))
    m = m.withColumns({"pairs_after": F.sum(F.col("pair").cast("int")).over(back.rowsBetween(Window.unboundedPreceding, 0)), "rejected": is_rejection(F.col("role"), F.col("blocks")), "submitted": is_script_submission(F.col("role"), F.col("blocks"))})
    ends = m.groupBy("conv_id").agg(
        F.coalesce(F.max(F.when(F.col("summary"), F.col("pos"))) + 1, F.lit(1)).alias("start"),
        F.coalesce(F.min(F.when(F.col("pair") & (F.col("pairs_after") <= KEEP_PAIRS), F.col("pos") - 1)), F.count("*")).alias("end"),
    )
    inside = m.join(ends, "conv_id").where("pos >= start and pos < end")
    last = inside.groupBy("conv_id").agg(F.max(F.when(F.col("rejected"), F.col("pos"))).alias("rejection"))
    inside = inside.join(last, "conv_id").withColumn("protected", F.coalesce((F.col("pos") == F.col("rejection")) | ((F.col("pos") == F.col("rejection") - 1) & F.col("submitted")), F.lit(False)))
    plan = inside.groupBy("conv_id", "start", "end").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.count_if(~F.col("protected")).alias("n_free"), F.coalesce(F.sum(F.when(~F.col("protected"), F.col("tokens"))), F.lit(0)).alias("free_tokens"))
    worth = (F.col("n") >= LEAST_MESSAGES) & (F.col("tokens") >= LEAST_TOKENS) & (F.col("n_free") >= LEAST_MESSAGES) & (F.col("free_tokens") >= LEAST_TOKENS)
    calls = F.when(F.col("free_tokens") >= THREE_WAY_TOKENS, 3).when(F.col("free_tokens") >= SPLIT_TOKENS, 2).otherwise(1)
    return plan.withColumn("worth_it", worth).withColumn("calls", F.when(worth, calls).otherwise(0))


def turn_range(messages: DataFrame) -> DataFrame:
    """By conversation, the first and last turn that status messages ('[Turn n/') name, else 1 to the number of answers."""
    named = grab(_plain(F.col("blocks")), r"\[Turn (\d+)/").cast("int")
    got = messages.groupBy("conv_id").agg(F.min(named).alias("low"), F.max(named).alias("high"), F.count_if(F.col("role") == "assistant").alias("answers"))
    return got.select("conv_id", F.coalesce("low", F.lit(1)).alias("start_turn"), F.coalesce("high", F.greatest(F.col("answers"), F.lit(1))).alias("end_turn"))


def middle_cut(text: Column, most: int = 8000) -> Column:
    """Text over ``most`` characters without its middle."""
    half = most // 2
    note = F.format_string("\n\n[... %d chars omitted ...]\n\n", F.length(text) - most)
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(half)), note, F.right(text, F.lit(half)))).otherwise(text)


def serialised(messages: DataFrame) -> DataFrame:
    """(conv_id, transcript): a conversation as readable text, long tool results cut in the middle, turn status left out."""

    def shown(b: Column) -> Column:
        text = strip(F.coalesce(b["text"], F.lit("")))
        agent = F.col("role") == "assistant"
        result = strip(F.coalesce(b["content"], F.lit("")))
        return (
            F.when((b["type"] == "text") & (text == ""), None)
            .when((b["type"] == "text") & agent, F.concat(F.lit("ASSISTANT:\n"), text, F.lit("\n")))
            .when((b["type"] == "text") & text.startswith("[Turn ") & text.contains("remaining"), None)
            .when(b["type"] == "text", F.concat(F.lit("USER: "), text, F.lit("\n")))
            .when(b["type"] == "tool_use", F.concat(F.lit("TOOL CALL: "), F.coalesce(b["name"], F.lit("?")), F.lit("("), F.coalesce(b["input"], F.lit("")), F.lit(")\n")))
            .when((b["type"] == "tool_result") & (result != ""), F.concat(F.when(b["is_error"], "TOOL ERROR:\n").otherwise("TOOL RESULT:\n"), middle_cut(result), F.lit("\n")))
        )

    by = Window.partitionBy("conv_id").orderBy("idx")
    m = messages.withColumn("turn", F.count_if(F.col("role") == "assistant").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    head = F.when(F.col("role") == "assistant", F.concat(F.lit("--- Turn "), F.col("turn").cast("string"), F.lit(" ---\n")))
    part = F.concat_ws("\n", head, F.array_join(F.filter(F.transform("blocks", shown), lambda x: x.isNotNull()), "\n"))
    return m.select("conv_id", F.struct("idx", part.alias("part")).alias("p")).groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["part"]), "\n").alias("transcript"))


# ---- ageing ----------------------------------------------------------------------------------------------------------


def stage_of(age: Column) -> Column:
    """full, skeleton or stub, by the turns since a page view was made; without a known turn it is old."""
    return F.when(F.coalesce(age, F.lit(STUB_AGE)) >= STUB_AGE, "stub").when(age >= SKELETON_AGE, "skeleton").otherwise("full")


def view_age(text: Column, current_turn: Column) -> Column:
    return current_turn - grab(text, r"__TURN_(\d+)__").cast("int")


def section_meta(text: Column) -> Column:
    """array of (id, chars, interactive, role, start, end, labels) of the metadata block in a page view; null without one."""
    block = grab(text, rf"{META_START}(.*?){META_END}", 1, "s")
    lines = F.filter(F.transform(F.split(block, "\n"), strip), lambda x: F.size(F.split(x, r"\|")) >= 7)
    bar = lambda x: F.replace(x, F.lit("¦"), F.lit("|"))

    def parse(line: Column) -> Column:
        p = F.split(line, r"\|")
        return F.struct(
            p[0].alias("id"), p[1].try_cast("int").alias("chars"), p[2].try_cast("int").alias("interactive"), p[3].alias("role"), bar(p[4]).alias("start"), bar(p[5]).alias("end"),
            F.filter(F.split(p[6], ";"), lambda x: x != "").alias("labels"),
        )

    return F.filter(F.transform(lines, parse), lambda m: m["chars"].isNotNull() & m["interactive"].isNotNull())


def view_sections(view: Column) -> Column:
    """array of (id, content) of the section headers in a page view."""
    found = F.regexp_extract_all(view, F.lit(r"(?s)--- \[([^\]]+)\] [^\n]*? ---(.*?)(?=--- \[[^\]]+\] [^\n]*? ---|__SECTION_META__|\z)"), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"^--- \[([^\]]+)\]", 1).alias("id"), strip(F.regexp_replace(x, r"^--- \[[^\]]+\] [^\n]*? ---", "")).alias("content")))


def kept_sections(view: Column) -> Column:
    """Sections of a page view that are shown in full."""
    return F.filter(view_sections(view), lambda s: (s["content"] != "") & ~F.substring_index(s["content"], "\n", 1).startswith("["))


def view_header(view: Column) -> Column:
    return F.coalesce(grab(view, r"(=== Page State[^\n]*?===)"), F.lit("=== Page State ==="))


def stubbed(view: Column) -> Column:
    """A page view as its address, the kept sections and an index."""

    def made(s: Column) -> Column:
        ids, kept = s["ids"], s["kept"]
        some = lambda x, n: F.concat(F.array_join(F.slice(x, 1, n), ", "), F.when(F.size(x) > n, ", ...").otherwise(""))
        told = F.when(F.size(kept) > 0, F.concat(F.lit(", "), F.size(kept).cast("string"), F.lit(" kept: "), some(kept, 6))).otherwise("")
        index = F.when(F.size(ids) > 0, F.concat(F.lit("\n[all: "), some(ids, 15), F.lit("]"))).otherwise("")
        return F.concat(view_header(view), F.lit(" [stub]\n["), s["total"].cast("string"), F.lit(" sections"), told, F.lit(" — call show_page(page) for current state.]"), index)

    meta = section_meta(view)
    headers = F.transform(view_sections(view), lambda x: x["id"])
    omitted = F.aggregate(F.regexp_extract_all(view, F.lit(r"\[(\d+) sections omitted\]"), F.lit(1)), F.lit(0), lambda a, x: a + x.cast("int"))
    ids = F.coalesce(F.transform(meta, lambda m: m["id"]), headers)
    total = F.when(meta.isNotNull(), F.size(meta)).otherwise(F.size(headers) + omitted)
    return let(F.struct(ids.alias("ids"), F.transform(kept_sections(view), lambda x: x["id"]).alias("kept"), total.alias("total")), made)


def skeleton(view: Column) -> Column:
    """A page view whose kept sections stay and whose others become previews; null without a metadata block."""

    def made(s: Column) -> Column:
        def block(m: Column) -> Column:
            head = F.format_string("--- [%s] %s (%d interactive) ---\n", m["id"], F.when(m["role"] == "", "content").otherwise(m["role"]), m["interactive"])
            own = F.try_element_at(F.transform(F.filter(s["kept"], lambda k: k["id"] == m["id"]), lambda k: k["content"]), F.lit(1))
            text = F.when(m["end"] != "", F.concat(m["start"], F.lit(" ··· ..."), m["end"])).otherwise(m["start"])
            labels = F.when(F.size(m["labels"]) > 0, F.concat(F.lit(" | "), F.array_join(m["labels"], ", "))).otherwise("")
            return F.concat(head, F.coalesce(own, F.concat(F.lit('[preview: "'), text, F.lit('" | '), m["chars"].cast("string"), F.lit(" chars"), labels, F.lit("]"))))

        return F.concat(view_header(view), F.lit(" [skeleton]\n\n"), F.array_join(F.transform(s["meta"], block), "\n\n"))

    meta = section_meta(view)
    return F.when(meta.isNotNull(), let(F.struct(meta.alias("meta"), kept_sections(view).alias("kept")), made))


def aged_view(text: Column, current_turn: Column) -> Column:
    """A tool result with its page view at the stage of its age: full, skeleton or stub. Stubs stay."""
    view = strip(grab(text, rf"{VIEW_START}\n?(.*?){VIEW_END}", 1, "s"))
    before, after = F.substring_index(text, VIEW_START, 1), F.regexp_replace(text, rf"(?s)^.*?{VIEW_END}", "")
    turn = grab(text, r"(__TURN_\d+__)")
    put = lambda body: F.concat(before, F.lit(VIEW_START + "\n"), body, F.lit("\n" + VIEW_END), after)
    stage = stage_of(view_age(text, current_turn))
    return (
        F.when(view.isNull() | text.contains("[stub]"), text)
        .when(stage == "stub", put(stubbed(view)))
        .when((stage == "skeleton") & ~text.contains("[skeleton]"), F.coalesce(put(F.concat(F.coalesce(F.concat(turn, F.lit("\n")), F.lit("")), skeleton(view))), text))
        .otherwise(text)
    )


def aged_zooms(text: Column, current_turn: Column) -> Column:
    """A tool result whose zoom blocks of five turns or more ago, or of unknown turn, are stubs."""
    pattern = rf"(?s){ZOOM_START}.*?{ZOOM_END}"
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def one(z: Column) -> Column:
        ids = F.coalesce(strip(grab(z, rf"^{ZOOM_START}\|([^|]*)\|")), F.lit("unknown"))
        body = F.when(F.instr(z, "\n") > 0, F.regexp_replace(F.regexp_replace(z, r"(?s)^[^\n]*\n", ""), rf"{ZOOM_END}\z", "")).otherwise("")
        lines = F.length(body) - F.length(F.replace(body, F.lit("\n"))) + 1
        stub = F.format_string('[Zoom stub for sections: %s — %d lines condensed. Call zoom_section(page, "section-id") to re-inspect.]', ids, lines)
        young = F.coalesce(view_age(z, current_turn) < STUB_AGE, F.lit(False))
        return F.when(z.contains("Zoom stub") | young, z).otherwise(F.concat(F.lit(ZOOM_START + "|"), ids, F.lit("|\n"), stub, F.lit("\n" + ZOOM_END)))

    parts = F.zip_with(gaps, F.transform(found, one), lambda g, z: F.concat(g, F.coalesce(z, F.lit(""))))
    return F.when(F.size(found) > 0, F.array_join(parts, "")).otherwise(text)


# ---- looking into text -----------------------------------------------------------------------------------------------


def sample_lines(text: Column, slices: int = 7, lines: int = 15) -> Column:
    """array of (line, text): evenly spaced slices of lines; all lines if they are few."""
    numbered = F.transform(F.split(text, "\n"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    step = F.greatest(F.lit(1), F.floor((F.size(numbered) - lines) / (slices - 1)))
    starts = F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda k: k * step)
    return F.when(F.size(numbered) <= slices * lines, numbered).otherwise(F.filter(numbered, lambda x: F.exists(starts, lambda s: (x["line"] > s) & (x["line"] <= s + lines))))


def search_lines(text: Column, query: str, context: int = 3, most: int = 50) -> Column:
    """struct<n, hits>: how many lines hold the query in any case, and the first of them with their context (start is the
    number of the first line shown). Contexts that overlap are repeated."""
    rows = F.split(text, "\n")
    at = F.filter(F.transform(rows, lambda x, i: F.when(F.contains(F.lower(x), F.lit(query.lower())), i)), lambda i: i.isNotNull())

    def hit(i: Column) -> Column:
        first = F.greatest(i - context, F.lit(0))
        return F.struct((i + 1).alias("line"), (first + 1).alias("start"), F.array_join(F.slice(rows, first + 1, i - first + context + 1), "\n").alias("text"))

    return F.struct(F.size(at).alias("n"), F.transform(F.slice(at, 1, most), hit).alias("hits"))


def view_lines(text: Column, start: int, end: int, most: int = 200) -> Column:
    """Lines start to end (from 1, inclusive), 200 at most."""
    return F.array_join(F.slice(F.split(text, "\n"), max(1, start), max(0, min(end - max(1, start) + 1, most))), "\n")


# ---- histories for other readers -------------------------------------------------------------------------------------


def attempt_history(attempts: DataFrame, most: int) -> DataFrame:
    """(job_id, history) of earlier attempts (job_id, attempt_no, script, feedback, exit_code, output): long scripts cut in
    the middle, the first fifteen lines of output, and which attempt of how many is next."""
    script = F.when(F.length("script") > 1500, F.concat(F.left("script", F.lit(750)), F.lit("\n# ... (truncated) ...\n"), F.right("script", F.lit(750)))).otherwise(F.col("script"))
    sample = F.array_join(F.slice(F.split("output", "\n"), 1, 15), "\n")
    part = F.format_string(
        "### Attempt %d\n**Script used:**\n```python\n%s\n```\n**Rejection feedback:** %s\n**Exit code:** %s\n**Output sample (first 15 lines):**\n```\n%s\n```\n",
        "attempt_no", script, F.coalesce("feedback", F.lit("")), F.coalesce(F.col("exit_code").cast("string"), F.lit("None")), F.coalesce(sample, F.lit("")),
    )
    rows = attempts.groupBy("job_id").agg(F.max("attempt_no").alias("last"), F.transform(F.sort_array(F.collect_list(F.struct("attempt_no", part.alias("p")))), lambda x: x["p"]).alias("parts"))
    head = F.format_string(f"## Previous Attempts (you are reviewing attempt %d of {most})\n\n", F.col("last") + 1)
    return rows.select("job_id", F.concat(head, F.array_join("parts", "\n")).alias("history"))


def conversation_summary(messages: DataFrame, most: int = 3000) -> DataFrame:
    """(conv_id, summary): every message under a heading, long texts and results cut in the middle."""
    note = "\n\n... (truncated) ...\n\n"
    short = lambda x: F.when(F.length(x) > most, F.concat(F.left(x, F.lit(most // 2)), F.lit(note), F.right(x, F.lit(most // 2)))).otherwise(x)

    def shown(b: Column) -> Column:
        call = F.concat(F.lit("**Tool call: `"), F.coalesce(b["name"], F.lit("?")), F.lit("`** — "), F.coalesce(b["input"], F.lit("")))
        result = F.concat(F.when(b["is_error"], "**Tool ERROR:**\n```\n").otherwise("**Tool result:**\n```\n"), short(F.coalesce(b["content"], F.lit(""))), F.lit("\n```"))
        return F.when(b["type"] == "text", short(F.coalesce(b["text"], F.lit("")))).when(b["type"] == "tool_use", call).when(b["type"] == "tool_result", result)

    by = Window.partitionBy("conv_id").orderBy("idx")
    body = F.array_join(F.filter(F.transform("blocks", shown), lambda x: x.isNotNull()), "\n\n")
    m = messages.select("conv_id", "idx", F.format_string("### %s (message %d)\n\n%s\n", F.upper("role"), F.row_number().over(by), body).alias("p"))
    return m.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "p"))), lambda x: x["p"]), "\n").alias("summary"))


def summary_halves(messages: DataFrame) -> DataFrame:
    """(conv_id, n, cut): how many messages, and where the first of two halves ends: after the user's message that follows
    the middle assistant's; half the messages where there are fewer than two answers."""
    by = Window.partitionBy("conv_id").orderBy("idx")
    m = messages.withColumns({"pos": F.row_number().over(by) - 1, "answer": F.sum((F.col("role") == "assistant").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))})
    m = m.withColumns({"n": F.count("*").over(Window.partitionBy("conv_id")), "answers": F.count_if(F.col("role") == "assistant").over(Window.partitionBy("conv_id"))})
    middle = F.floor(F.col("answers") / 2) + 1
    after = F.min(F.when((F.col("role") == "user") & (F.col("answer") >= middle), F.col("pos") + 1))
    own = F.min(F.when((F.col("role") == "assistant") & (F.col("answer") == middle), F.col("pos") + 1))
    got = m.groupBy("conv_id", "n", "answers").agg(after.alias("after"), own.alias("own"))
    return got.select("conv_id", "n", F.when(F.col("answers") < 2, F.floor(F.col("n") / 2)).otherwise(F.coalesce("after", "own")).cast("int").alias("cut"))
