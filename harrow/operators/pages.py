"""Page operators: node table, text, sections, repeated groups, cleaning, zoom, static interactive elements.

Tree work runs in Arrow functions over (page_id, html), one page at a time; what can be said of nodes as rows is done by
built-in operators on the node table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from harrow.functions import dom, sanitize
from harrow.functions.regex import first_label

NODE_SCHEMA = (
    "page_id long, node_id int, parent_id int, depth int, pos int, tag string, attrs map<string,string>, text string, tail string, subtree_end int, size int, "
    "hidden boolean, excluded boolean, shape string"
)
REFERENCE = "struct<xpath:string,css_selector:string,tag:string,dom_index:int,attributes:map<string,string>>"
ELEMENT = "struct<iid:int,tag:string,attributes:map<string,string>,classes:array<string>,element_text:string,full_tag_str:string>"
SECTION_SCHEMA = (
    f"page_id long, pos int, id string, text string, start_element {REFERENCE}, end_element {REFERENCE}, content_hash string, interactive_hash string, depth int, is_interactive boolean, "
    f"interactive_count int, parent_tag string, semantic_role string, char_start int, char_end int, elements array<{ELEMENT}>"
)
INTERACTIVE_SCHEMA = "page_id long, iid int, node_id int, tag string, attributes map<string,string>, text string, selector string, detected_by array<string>"

# What makes an element interactive.
NATIVE_TAGS = frozenset("button input select textarea details summary label".split())
ARIA_ROLES = frozenset("button link tab menuitem option checkbox radio slider switch combobox searchbox textbox treeitem".split())
ARIA_ATTRIBUTES = ("aria-expanded", "aria-haspopup", "aria-pressed", "aria-checked")


def per_page(pages: DataFrame, rows_of: Callable[[str | None], list[dict]], schema: str) -> DataFrame:
    """Rows that a function makes of each page's html, with its page_id. No shuffle; a page is one unit of work."""
    arrow: pa.Schema | None = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page_id, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [{"page_id": page_id, **row} for row in rows_of(page)]
                for start in range(0, len(rows), 5_000):
                    yield pa.RecordBatch.from_pylist(rows[start : start + 5_000], arrow)

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(run, schema)


def _map(d: dict) -> list[tuple]:
    return list(d.items())


def _node_batches(names: tuple[str, ...], arrow: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Nodes column by column, those of many small pages in one batch and those of a large page in several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = {name: [] for name in ("page_id", *names)}

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            n = len(columns["page_id"])
            if n >= least:
                for start in range(0, n, 5_000):
                    yield pa.RecordBatch.from_arrays([pa.array(columns[f.name][start : start + 5_000], f.type) for f in arrow], schema=arrow)
                for values in columns.values():
                    values.clear()

        for batch in batches:
            for page_id, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tree = dom.parse(page)
                if tree is not None:
                    columns["page_id"] += [page_id] * len(tree)
                    for name in names:
                        columns[name] += _NODE_VALUES[name](tree)
                    yield from flush(5_000)
        yield from flush(1)

    return run


def _places(tree: dom.Tree) -> list[int]:
    places = [0] * len(tree)
    for kids in tree.children:
        for i, c in enumerate(kids):
            places[c] = i
    return places


#: What a column of the node table holds, for all nodes of a tree.
_NODE_VALUES = {
    "node_id": lambda tree: range(len(tree)), "parent_id": lambda tree: [None, *tree.parent[1:]], "depth": lambda tree: tree.depth, "pos": _places, "tag": lambda tree: tree.tag,
    "attrs": lambda tree: [_map(a) for a in tree.attrs], "text": lambda tree: tree.text, "tail": lambda tree: tree.tail, "subtree_end": lambda tree: tree.end, "size": dom.sizes,
    "hidden": lambda tree: [tree.hidden(n) for n in range(len(tree))], "excluded": lambda tree: [t in dom.EXCLUDED for t in tree.tag],
    "shape": lambda tree: [",".join(f"{tree.tag[c]}:{len(tree.children[c])}" for c in kids) for kids in tree.children],
}


def node_table(pages: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """The nodes of pages (page_id, html) in document order; the descendants of a node are node_id + 1 to subtree_end - 1.
    With names, only page_id and those columns are made."""
    names = tuple(_NODE_VALUES) if names is None else names
    schema = ", ".join(part for part in NODE_SCHEMA.split(", ") if part.split()[0] in ("page_id", *names))
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(_node_batches(names, arrow), schema)


def visible_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes that neither are nor lie in hidden or excluded ones. In document order a node is covered while the furthest
    end of such a node before it lies beyond it: one window, no range join."""
    by = Window.partitionBy("page_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(F.col("hidden") | F.col("excluded"), F.col("subtree_end"))).over(by)
    return nodes.withColumn("__reach", reach).where(F.coalesce(F.col("__reach") <= F.col("node_id"), F.lit(True))).drop("__reach")


def repeated_groups(nodes: DataFrame, least: int = 3) -> DataFrame:
    """(page_id, parent_id, signature, n, first_node) of visible children of one parent with equal tag, classes and
    children (shape). The page is parsed once; the window over its nodes and the groups need one shuffle by page."""
    classes = F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(F.coalesce(F.col("attrs")["class"], F.lit("")), r"\s+"), lambda c: c != ""))), ".")
    seen = visible_nodes(nodes).where((F.col("size") > 0) & F.col("parent_id").isNotNull())
    signed = seen.withColumn("signature", F.concat_ws("|", "tag", classes, "shape"))
    groups = signed.groupBy("page_id", "parent_id", "signature").agg(F.count("*").alias("n"), F.min("node_id").alias("first_node"))
    return groups.where(F.col("n") >= least)


def group_members(pages: DataFrame) -> DataFrame:
    """(page_id, node_id, parent_id, group_no) of all repeated groups, exact ones first, then by shape."""

    def rows(page: str | None) -> list[dict]:
        tree = dom.parse(page)
        found = dom.repeated_groups(tree, dom.sizes(tree)) if tree is not None else {}
        return [{"node_id": n, "parent_id": p, "group_no": k} for n, (p, k) in sorted(found.items())]

    return per_page(pages, rows, "page_id long, node_id int, parent_id int, group_no int")


def page_text(pages: DataFrame) -> DataFrame:
    """(page_id, text, elements): readable text and the interactive elements in it."""

    def rows(page: str | None) -> list[dict]:
        tree = dom.parse(page)
        text, elements = dom.render(tree) if tree is not None else ("", [])
        return [{"text": text, "elements": [_element(e) for e in elements]}]

    return per_page(pages, rows, f"page_id long, text string, elements array<{ELEMENT}>")


def _element(e: dict) -> dict:
    return {**e, "attributes": _map(e["attributes"])}


def page_sections(pages: DataFrame, least: int = 500, preferred: int = 15_000, most: int = 30_000) -> DataFrame:
    """The sections of pages in order (SECTION_SCHEMA)."""

    def rows(page: str | None) -> list[dict]:
        refer = lambda r: {**r, "attributes": _map(r["attributes"])}
        return [
            {**s, "pos": i, "start_element": refer(s["start_element"]), "end_element": refer(s["end_element"]), "elements": [_element(e) for e in s["elements"]]}
            for i, s in enumerate(dom.sections(page, None, least, preferred, most))
        ]

    return per_page(pages, rows, SECTION_SCHEMA)


def cleaned(pages: DataFrame, options: sanitize.Options = sanitize.CONSERVATIVE, words: frozenset[str] = sanitize.CLASS_WORDS) -> DataFrame:
    """(page_id, html) cleaned by a preset or own options; words is the dictionary that class names are judged by."""
    return per_page(pages, lambda page: [{"html": sanitize.clean(page, options, words)}], "page_id long, html string")


def unstable_classes(names: DataFrame, column: str = "name", words: frozenset[str] = sanitize.CLASS_WORDS) -> DataFrame:
    """(name, unstable) of the distinct values of a column of class names: each name is judged once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0)
            yield pa.RecordBatch.from_arrays([own, pa.array([sanitize.is_unstable_class(x, words=words) for x in own.to_pylist()], pa.bool_())], names=["name", "unstable"])

    return names.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("name")).distinct().mapInArrow(run, "name string, unstable boolean")


def zoomed(pages: DataFrame, sections: DataFrame, wanted: DataFrame) -> DataFrame:
    """(page_id, html): pages with the wanted sections (page_id, id) in full; ids that a page doesn't have give a note.

    Sections are joined by id to their node ranges; a page's ranges meet in one row."""
    have = sections.select("page_id", "id", F.struct(F.col("start_element.dom_index").alias("a"), F.col("end_element.dom_index").alias("b")).alias("range"))
    asked = wanted.select("page_id", "id").distinct().join(have, ["page_id", "id"], "left").groupBy("page_id")
    ranges = asked.agg(F.collect_list("range").alias("ranges"), F.array_sort(F.collect_list(F.when(F.col("range").isNull(), F.col("id")))).alias("missing"))
    joined = pages.select(F.col("page_id").cast("long"), "html").join(ranges, "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, spans, missing in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                out.append(f"Section ID(s) not found: {', '.join(missing)}" if missing else dom.zoom(page, [(s["a"], s["b"]) for s in spans]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["page_id", "html"])

    return joined.mapInArrow(run, "page_id long, html string")


def _interactive_rows(page: str | None) -> list[dict]:
    tree = dom.parse(page)
    if tree is None:
        return []
    unseen = [False] * len(tree)
    layers: dict[int, list[str]] = {}
    for n in range(len(tree)):
        a, tag = tree.attrs[n], tree.tag[n]
        unseen[n] = (tree.parent[n] >= 0 and unseen[tree.parent[n]]) or tree.hidden(n) or tag in ("script", "style", "noscript", "template", "head")
        if unseen[n] or "disabled" in a or a.get("aria-disabled") == "true" or (tag == "input" and a.get("type", "").lower() == "hidden"):
            continue
        native = tag in NATIVE_TAGS or (tag == "a" and "href" in a) or a.get("contenteditable") == "true" or (a.get("tabindex", "-").lstrip("+").isdigit())
        aria = a.get("role") in ARIA_ROLES or any(x in a for x in ARIA_ATTRIBUTES)
        if native or aria:
            layers[n] = [x for x, yes in (("layer1_native", native), ("layer2_aria", aria)) if yes]
    inner = {n for n in layers if tree.tag[n] in ("label", "summary") and _covered(tree, n, layers)}
    rows = []
    for n in sorted(set(layers) - inner):
        shown = {k: v for k, v in tree.attrs[n].items() if k not in ("class", "style", "data-iid", "data-hidden")}
        rows.append({"iid": len(rows) + 1, "node_id": n, "tag": tree.tag[n], "attributes": _map(shown), "text": tree.inner_text(n).strip()[:500], "selector": dom.css_selector(tree, n), "detected_by": layers[n]})
    return rows


def _covered(tree: dom.Tree, n: int, found: dict) -> bool:
    """Whether an element lies in a link or button that was found."""
    while (n := tree.parent[n]) >= 0:
        if n in found and tree.tag[n] in ("a", "button"):
            return True
    return False


def interactive_elements(pages: DataFrame) -> DataFrame:
    """Interactive elements that static HTML tells of (native elements, tabindex, ARIA): neither hidden nor disabled.

    Geometry, computed style and accessibility trees need a browser and are not read."""
    return per_page(pages, _interactive_rows, INTERACTIVE_SCHEMA)


def section_lines(sections: DataFrame) -> DataFrame:
    """Summaries of sections: id, role, number of interactive elements and characters."""
    return sections.select("page_id", "pos", "id", F.col("semantic_role").alias("role"), "interactive_count", F.length("text").alias("char_count"))


def element_lines(elements: DataFrame) -> DataFrame:
    """Summaries of interactive elements, their text cut at 100."""
    return elements.select("page_id", "iid", "tag", F.left(F.coalesce("text", F.lit("")), F.lit(100)).alias("text"), "selector", "attributes")


def page_view(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, view): a header with the address, then every section under its own."""
    block = F.concat(F.format_string("--- [%s] %s (%d interactive) ---\n", "id", "semantic_role", "interactive_count"), F.col("text"), F.lit("\n"))
    body = sections.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", block.alias("t")))), lambda x: x["t"]), "\n").alias("body"))
    head = F.format_string("=== Page State #%d | %s ===\n\n", F.col("page_id"), F.col("url"))
    return pages.join(body, "page_id", "left").select("page_id", F.concat(head, F.coalesce("body", F.lit(""))).alias("view"))


def checkpoint_summary(checkpoints: DataFrame) -> DataFrame:
    """One line for every checkpoint, titles cut at 50."""
    title = F.when(F.length("title") > 50, F.concat(F.left("title", F.lit(47)), F.lit("..."))).otherwise(F.col("title"))
    return checkpoints.select("number", F.format_string("CP-%d  %s  %s  (%d elements, %.1fs)", "number", F.coalesce("label", F.lit("")), F.coalesce(title, F.lit("")), F.coalesce("element_count", F.lit(0)), F.coalesce("timestamp_s", F.lit(0.0))).alias("line"))


def checkpoint_views(checkpoints: DataFrame) -> DataFrame:
    """(page_id, view) of checkpoints (number, url, html, data_preview): cleaned and cut into sections; the data preview
    is a section of its own, and pages without sections show their visible text."""
    pages = checkpoints.select(F.col("number").cast("long").alias("page_id"), "url", "html")
    rows = page_sections(cleaned(pages, sanitize.Options(collapse=False)))
    from harrow.functions.pages import visible_text

    view = page_view(rows, pages.select("page_id", "url"))
    plain = checkpoints.select(F.col("number").cast("long").alias("page_id"), visible_text(F.col("html")).alias("plain"), "data_preview")
    none = ~F.contains("view", F.lit("--- ["))
    data = F.when(F.coalesce("data_preview", F.lit("")) != "", F.concat(F.lit("\n--- [data-preview] data (0 interactive) ---\n"), F.col("data_preview"), F.lit("\n"))).otherwise("")
    return view.join(plain, "page_id").select("page_id", F.concat("view", F.when(none, F.coalesce("plain", F.lit(""))).otherwise(""), data).alias("view"))


def without_markers(html: Column) -> Column:
    """HTML without the attributes that detection adds."""
    return F.regexp_replace(F.regexp_replace(html, r'\s*data-iid="[^"]*"', ""), r'\s*data-hidden="[^"]*"', "")


def rendered_metadata(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """Nodes with an iid and the metadata of their element (page_id, iid, attributes); nodes without metadata stay.
    The attributes of the page win over those of the metadata; only allowed ones are kept."""
    marked = nodes.withColumn("iid", F.col("attrs")["data-iid"].try_cast("int")).where("iid is not null")
    both = marked.join(elements.select("page_id", "iid", F.col("attributes").alias("meta")), ["page_id", "iid"], "left")
    own = F.map_filter("attrs", lambda k, v: k.isin(*dom.SHOWN_ATTRIBUTES))
    extra = F.map_filter(F.coalesce("meta", F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*dom.SHOWN_ATTRIBUTES) & ~F.map_contains_key("attrs", k))
    return both.select("page_id", "iid", "node_id", "tag", F.map_concat(own, extra).alias("attributes"))


def removed_elements(before: DataFrame, after: DataFrame) -> DataFrame:
    """Interactive elements (page_id, iid) that are gone."""
    return before.join(after.select("page_id", "iid"), ["page_id", "iid"], "left_anti")


#: Calls that dump a whole page into the conversation, and what they are called.
DUMPS = (
    (r"\bpage\s*\.\s*content\s*\(", "page.content()"),
    (r"""\.\s*inner_html\s*\(\s*["'](?:html|body)["']""", '.inner_html("html"/"body")'),
    (r"document\s*\.\s*documentElement\s*\.\s*outerHTML", "document.documentElement.outerHTML"),
    (r"document\s*\.\s*body\s*\.\s*innerHTML", "document.body.innerHTML"),
)


def raw_dump(code: Column) -> Column:
    """What in submitted code dumps a page's raw HTML; null if nothing does."""
    return first_label(code, DUMPS)
