"""Trees, text, sections, groups, cleaning, zoom, on small pages whose results follow from the rules."""

from harrow.functions import dom, sanitize
from harrow.operators import pages

CARD = "<div class='card'><h2>Item {0}</h2><p>" + "Some words about it. " * 40 + "</p></div>"
PAGE = "<html><head><title>t</title></head><body><nav><a href='/'>Home</a></nav><div id='list'>" + "".join(CARD.format(i) for i in range(5)) + "</div><footer>End</footer></body></html>"


def text(page):
    return dom.render(dom.parse(page))[0]


def test_tree_recovers():
    tree = dom.parse("<ul><li>a<li>b</ul><p>one<p>two<div>three</div>")
    assert [tree.tag[n] for n in range(len(tree))] == ["div", "ul", "li", "li", "p", "p", "div"]
    assert [tree.parent[n] for n in range(len(tree))] == [-1, 0, 1, 1, 0, 0, 0]
    assert dom.parse("") is None and dom.parse(None) is None and dom.parse("plain") is None
    for n in range(len(tree)):
        assert all(n < c < tree.end[n] for c in tree.children[n])


def test_text_rules():
    assert text("<div><p>a  b</p><p>c<br>d</p><script>x</script><img alt='pic'></div>") == "a b\n\nc\nd\n\npic"
    assert text("<div>a<span style='display: none'>b</span><span aria-hidden=true>c</span><b>d</b></div>") == "ad"
    assert text("<p>x <a data-iid=3 href='/q?a=1&amp;b=2' onclick=z>go</a> y</p>") == 'x <a href="/q?a=1&amp;b=2">go</a> y'
    assert text("<div data-iid=1>in</div>") == "<div>\nin\n</div>"
    assert text("<p>a<svg aria-label='logo'><path/></svg>b</p>") == "alogob"
    _, elements = dom.render(dom.parse("<p><input data-iid=2 name=q class='x y'></p>"))
    assert elements == [{"iid": 2, "tag": "input", "attributes": {"name": "q"}, "classes": ["x", "y"], "element_text": None, "full_tag_str": '<input name="q">'}]


def test_sections():
    found = dom.sections(PAGE)
    assert [s["semantic_role"] for s in found][1:6] == ["repeated-item"] * 5
    assert [s["id"] for s in found[1:6]] == [f"item-{i + 1}-div-item-{i}" for i in range(5)]
    assert found[0]["semantic_role"] == "navigation" and found[-1]["semantic_role"] == "footer"
    assert all(a["char_end"] + 2 == b["char_start"] for a, b in zip(found, found[1:]))
    assert dom.sections("") == [] and dom.sections(None) == []


def test_groups():
    tree = dom.parse("<ul><li class=a><b></b>x</li><li class=a><b></b>y</li><li class=a><b></b>z</li><li class=q>w</li></ul>")
    assert dom.repeated_groups(tree, dom.sizes(tree)) == {1: (0, 0), 3: (0, 0), 5: (0, 0)}
    assert dom.alike_classes([frozenset("ab"), frozenset("ac"), frozenset("ad")]) and not dom.alike_classes([frozenset("a"), frozenset("b"), frozenset("c")])
    assert dom.alike_classes([frozenset(c) for c in "abcde"]) and dom.alike_classes([frozenset(), frozenset(), frozenset("a")])


def test_cleaning():
    page = "<html><head><title>x</title></head><body onload=a><!-- c --><div style='x' data-gtm-id=1 data-k=2 class='sc-bdVTJa card' href='" + "u" * 100 + "'>t</div><svg><path d=1></svg><script>s</script></body></html>"
    out = sanitize.clean(page)
    assert "script" not in out and "<!--" not in out and "title" not in out and "path" not in out and "onload" not in out and "style" not in out
    assert 'class="card"' in out and 'data-k="2"' in out and "data-gtm" not in out and "u" * 80 + "...(omitted)" in out
    many = "<ul>" + "".join(f"<li>{i}</li>" for i in range(12)) + "</ul>"
    out = sanitize.clean(many)
    assert "6 similar items omitted" in out and out.count("<li>") == 6
    assert sanitize.clean(many, sanitize.Options(collapse=False)).count("<li>") == 12
    tight = sanitize.clean("<body><nav>n</nav><div><span></span></div><p>k</p></body>", sanitize.AGGRESSIVE)
    assert tight == "<body><p>k</p></body>"


def test_unstable_classes():
    assert all(map(sanitize.is_unstable_class, ["sc-bdVTJa", "css-1a2b3c", "_3xk2F", "jss12", "svelte-1hjk32", "a8f2d1c9e0"]))
    assert not any(map(sanitize.is_unstable_class, ["product-card", "flex", "mt-4", "nav", "ab", "hover:bg-x", "", "data-x1", "userProfile"]))
    assert sanitize.clean_classes('<a class="css-1a2b3c">') == "<a >"


def test_zoom():
    page = "<html><body><p>a</p><p>b</p><p>c</p><p>d</p><div><i>x</i></div></body></html>"
    out = dom.zoom(page, [(6, 6)])
    assert "<i>" in out and "2 elements omitted" in out and out.count("...") == 2 and "x" in out and "b" not in out.replace("body", "")


def test_operators(spark):
    df = spark.createDataFrame([(1, PAGE, "u"), (2, "", "u"), (3, None, "u")], "page_id long, html string, url string")
    nodes = pages.node_table(df)
    assert nodes.where("page_id = 1").count() == len(dom.parse(PAGE)) and nodes.where("page_id > 1").count() == 0
    groups = pages.repeated_groups(nodes).collect()
    assert [(g.n, g.signature.split("|")[0]) for g in groups] == [(5, "div")]
    seen = {r.node_id for r in pages.visible_nodes(nodes).collect()}
    tree = dom.parse(PAGE)
    assert seen == {n for n in range(len(tree)) if dom.sizes(tree)[n] > 0}
    assert {r.page_id: r.text for r in pages.page_text(df).collect()}[2] == ""
    sections = pages.page_sections(df)
    view = {r.page_id: r.view for r in pages.page_view(sections, df).collect()}
    assert view[1].startswith("=== Page State #1 | u ===\n\n--- [nav-home] navigation (0 interactive) ---\n")
    wanted = spark.createDataFrame([(1, "item-2-div-item-1"), (2, "none")], "page_id long, id string")
    out = {r.page_id: r.html for r in pages.zoomed(df, sections, wanted).collect()}
    assert "Item 1" in out[1] and "Item 3" not in out[1] and "not found: none" in out[2]
    elements = spark.createDataFrame([(1, "<a href=x>l</a><button disabled>d</button><div role=tab tabindex=0>t</div><p hidden style='display:none'><input></p><a>no</a>")], "page_id long, html string")
    assert [(r.tag, r.detected_by) for r in pages.interactive_elements(elements).orderBy("iid").collect()] == [("a", ["layer1_native"]), ("div", ["layer1_native", "layer2_aria"])]
