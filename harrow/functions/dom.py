"""A page as a table of nodes, and what can be read from it.

Tags are read with the standard library's parser into flat arrays in document order; ``end[i]`` is one past the last
descendant of node i, so "descendant of" is a range of node numbers. Recovery is by our own rules: void elements have no
content; an end tag closes the nearest open element of its name (others are ignored); p, li, dt, dd, tr, td, th and
option are closed by what can't stand inside them; text outside elements belongs to the root. For well-formed pages the
tree is that of any parser, without inserted elements such as tbody.
"""

from __future__ import annotations

import hashlib
import html
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

# Sets of tags and attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption col colgroup dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
EXCLUDED = frozenset("script style noscript template head svg textarea xmp".split())
SHOWN_ATTRIBUTES = frozenset("href src type name value placeholder role aria-label aria-expanded aria-haspopup data-testid id action method".split())
SEMANTIC = frozenset("article aside details dialog fieldset figure footer form header main nav section table ul ol dl".split())
CLOSED_BY = {
    "p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
}
SCOPE = frozenset("ul ol dl table select div section article body html".split())
STRICT_ROLES = {"nav": "navigation", "header": "header", "footer": "footer", "form": "form", "table": "table", "aside": "sidebar", "article": "article", "main": "main-content", "ul": "list", "ol": "list"}
TRUSTED_ROLES = frozenset("navigation banner contentinfo complementary main form search region alert alertdialog dialog tablist toolbar menu menubar listbox".split())
MENU_ROLES, MENU_ITEM_ROLES = frozenset(["menu", "listbox", "menubar"]), frozenset(["menuitem", "menuitemradio", "menuitemcheckbox", "option"])
HIDING_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Tree:
    """Nodes in document order. ``text`` stands before a node's first child, ``tail`` after its end tag."""

    tag: list[str] = field(default_factory=list)
    attrs: list[dict[str, str]] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    tail: list[str] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    comments: dict[int, list[str]] = field(default_factory=dict)  # before which node, for placeholders

    def add(self, tag: str, attrs: dict[str, str], parent: int) -> int:
        n = len(self.tag)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.end.append(n + 1)
        self.text.append("")
        self.tail.append("")
        self.children.append([])
        if parent >= 0:
            self.children[parent].append(n)
        return n

    def __len__(self) -> int:
        return len(self.tag)

    def inner_text(self, node: int) -> str:
        """All text inside a node."""
        parts = []
        for n in range(node, self.end[node]):
            parts.append((n, self.text[n]))
        own = [self.text[node]]
        open_nodes = []
        for n in range(node + 1, self.end[node]):
            while open_nodes and n >= self.end[open_nodes[-1]]:
                own.append(self.tail[open_nodes.pop()])
            own.append(self.text[n])
            open_nodes.append(n)
        while open_nodes:
            own.append(self.tail[open_nodes.pop()])
        return "".join(own)

    def within(self, node: int, tag: str) -> list[int]:
        """Nodes of a tag inside a node, itself included."""
        return [n for n in range(node, self.end[node]) if self.tag[n] == tag]

    def hidden(self, node: int) -> bool:
        a = self.attrs[node]
        return a.get("data-hidden") == "true" or a.get("aria-hidden") == "true" or bool(a.get("style") and HIDING_STYLE.search(a["style"]))


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tree, self.open = Tree(), []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        while self.open and tag in CLOSED_BY.get(self.tree.tag[self.open[-1]], ()):
            self._close(len(self.open) - 1)
        if tag in ("html", "body", "head") and tag in self.tree.tag:  # a second one is not a new element
            return
        known: dict[str, str] = {}
        for name, value in attrs:
            known.setdefault(name, value or "")
        n = self.tree.add(tag, known, self.open[-1] if self.open else -1)
        if tag not in VOID:
            self.open.append(n)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.tree.tag[self.open[-1]] == tag and tag in ("path", "circle", "rect", "line", "use", "svg", "g"):
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.tree.tag[self.open[at]] == tag:
                self._close(at)
                return

    def _close(self, at: int) -> None:
        for n in self.open[at:]:
            self.tree.end[n] = len(self.tree)
        del self.open[at:]

    def handle_data(self, data: str) -> None:
        if not len(self.tree):
            return
        top = self.open[-1] if self.open else 0
        if self.tree.children[top]:
            self.tree.tail[self.tree.children[top][-1]] += data
        else:
            self.tree.text[top] += data


def parse(page: str | None) -> Tree | None:
    """The tree of a page, or None for one without elements. Several top elements get a root of tag div."""
    if not page or not page.strip():
        return None
    builder = _Builder()
    builder.feed(page)
    builder.close()
    builder._close(0)
    tree = builder.tree
    if not len(tree):
        return None
    tops = [n for n in range(len(tree)) if tree.parent[n] < 0]
    if len(tops) > 1:
        return _rooted(tree, tops)
    return tree


def _rooted(tree: Tree, tops: list[int]) -> Tree:
    out = Tree()
    out.add("div", {}, -1)
    for n in range(len(tree)):
        m = out.add(tree.tag[n], tree.attrs[n], tree.parent[n] + 1 if tree.parent[n] >= 0 else 0)
        out.text[m], out.tail[m], out.end[m] = tree.text[n], tree.tail[n], tree.end[n] + 1
    out.end[0] = len(out)
    return out


# ---- text ------------------------------------------------------------------------------------------------------------


def _spaces(text: str) -> str:
    return re.sub(r"\n[ \t]*", "\n", re.sub(r"[ \t]+", " ", text))


def shown_attributes(tree: Tree, node: int, meta: dict[str, str] | None) -> dict[str, str]:
    merged = {**(meta or {}), **tree.attrs[node]}
    return {k: v for k, v in merged.items() if k in SHOWN_ATTRIBUTES}


def opening(tag: str, attributes: dict[str, str]) -> str:
    told = "".join(f' {k}="{v.replace("&", "&amp;").replace(chr(34), "&quot;")}"' for k, v in sorted(attributes.items()))
    return f"<{tag}{told}>"


def render(tree: Tree, nodes: list[int] | None = None, metadata: dict[int, dict[str, str]] | None = None) -> tuple[str, list[dict]]:
    """Readable text of the given subtrees (default: all), and the interactive elements in it.

    Interactive elements (data-iid) keep their tags with the allowed attributes; blocks are set apart by blank lines;
    hidden and excluded elements are left out, but for the label of an svg and the alternative text of an image. The
    walk is a loop over node numbers: what must follow a subtree waits on a stack until its range ends."""
    out: list[str] = []
    found: list[dict] = []
    say = lambda text: out.append(t) if (t := _spaces(text)) and t != " " else None
    tops = [0] if nodes is None else nodes
    for at, top in enumerate(tops):
        pending: list[tuple[int, list[str], str]] = []  # (end of the range, what closes it, tail)
        n, stop = top, tree.end[top]
        while n < stop or pending:
            while pending and n >= pending[-1][0]:
                _, closing, tail = pending.pop()
                for piece in closing:
                    if piece == "newline":
                        if out and not out[-1].endswith("\n"):
                            out.append("\n")
                    else:
                        out.append(piece)
                if tail:
                    say(tail)
            if n >= stop:
                break
            tag, a = tree.tag[n], tree.attrs[n]
            tail = tree.tail[n] if n != top or at < len(tops) - 1 else ""
            skip = tag in EXCLUDED or tree.hidden(n) or tag in ("img", "br")
            if skip:
                if tag == "svg" and a.get("aria-label", "").strip():
                    say(a["aria-label"].strip())
                elif tag == "img" and not tree.hidden(n) and a.get("alt", "").strip():
                    say(a["alt"].strip())
                elif tag == "br" and not tree.hidden(n):
                    out.append("\n")
                if tail:
                    say(tail)
                n = tree.end[n]
                continue
            block, iid, closing = tag in BLOCK, a.get("data-iid"), []
            if block:
                out.append("\n\n")
            if iid is not None and re.fullmatch(r"\s*[+-]?\d+\s*", iid):
                attributes = shown_attributes(tree, n, (metadata or {}).get(int(iid)))
                start = opening(tag, attributes)
                out.append(start)
                found.append({"iid": int(iid), "tag": tag, "attributes": attributes, "classes": a.get("class", "").split(), "element_text": tree.inner_text(n).strip() or None, "full_tag_str": start})
                if tag not in VOID:
                    if block:
                        out.append("\n")
                        closing.append("newline")
                    closing.append(f"</{tag}>")
            if block:
                closing.append("\n\n")
            if tree.text[n]:
                say(tree.text[n])
            pending.append((tree.end[n], closing, tail))
            n += 1
    text = re.sub(r"[ \t]+$", "", "".join(out), flags=re.M)
    return re.sub(r"\n{3,}", "\n\n", text).strip(), found


# ---- repeated groups -------------------------------------------------------------------------------------------------


def sizes(tree: Tree) -> list[int]:
    """Characters that each subtree takes as HTML; 0 for excluded and hidden ones."""
    own, gone = [0] * len(tree), [False] * len(tree)
    for n in range(len(tree)):
        gone[n] = (tree.parent[n] >= 0 and gone[tree.parent[n]]) or tree.tag[n] in EXCLUDED or tree.hidden(n)
        if not gone[n]:
            own[n] = 2 + len(tree.tag[n]) + sum(4 + len(k) + len(v) for k, v in tree.attrs[n].items())
            if tree.tag[n] not in VOID:
                own[n] += 3 + len(tree.tag[n]) + len(tree.text[n])
    for n in range(len(tree) - 1, 0, -1):
        up = tree.parent[n]
        if not gone[up] and tree.tag[up] not in VOID:
            own[up] += own[n] + len(tree.tail[n])
    return own


def class_set(tree: Tree, node: int) -> frozenset[str]:
    return frozenset(tree.attrs[node].get("class", "").split())


def exact_signature(tree: Tree, node: int) -> tuple:
    """Tag, classes, and each child's tag with its number of children."""
    return tree.tag[node], class_set(tree, node), tuple((tree.tag[c], len(tree.children[c])) for c in tree.children[node])


def shape_signature(tree: Tree, node: int) -> tuple:
    """Tag and the children's tags."""
    return tree.tag[node], tuple(tree.tag[c] for c in tree.children[node])


def alike_classes(sets: list[frozenset[str]], threshold: float = 0.3) -> bool:
    """Whether members of one shape belong together: no or few classes, one that most share, five members or more, or a
    Jaccard similarity of all of at least the threshold."""
    filled = [s for s in sets if s]
    if len(filled) < len(sets) / 2 or not filled:
        return True
    every = frozenset().union(*sets)
    if any(2 * sum(c in s for s in sets) > len(sets) for c in every) or len(sets) >= 5:
        return True
    return len(frozenset.intersection(*sets)) / len(every) >= threshold


def repeated_groups(tree: Tree, size: list[int], least: int = 3) -> dict[int, tuple[int, int]]:
    """node -> (parent, number of its group there), for members of repeated groups."""
    member: dict[int, tuple[int, int]] = {}
    for parent in range(len(tree)):
        seen = [c for c in tree.children[parent] if size[c] > 0]
        if len(seen) < least:
            continue
        k = 0
        for sign in (exact_signature, shape_signature):
            buckets: dict[tuple, list[int]] = {}
            for c in seen:
                if c not in member:
                    buckets.setdefault(sign(tree, c), []).append(c)
            for group in buckets.values():
                if len(group) >= least and (sign is exact_signature or alike_classes([class_set(tree, c) for c in group])):
                    member.update((c, (parent, k)) for c in group)
                    k += 1
    return member


# ---- sections --------------------------------------------------------------------------------------------------------


@dataclass
class Piece:
    """A run of sibling subtrees that will be a section."""

    nodes: list[int]
    size: int
    depth: int
    group: tuple[int, int] | None = None


def _joined(pieces: list[Piece]) -> Piece:
    return Piece([n for p in pieces for n in p.nodes], sum(p.size for p in pieces), min(p.depth for p in pieces), pieces[0].group)


def _batches(pieces: list[Piece], least: int) -> list[Piece]:
    """Equal batches of about the least size; halves round to even."""
    total = len(pieces)
    mean = sum(p.size for p in pieces) / total
    each = max(1, round(least / mean)) if mean > 0 else 1
    n = max(1, round(total / each))
    cuts = [i * (total // n) + min(i, total % n) for i in range(n + 1)]
    return [_joined(pieces[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


class Sectioner:
    """Cuts a page into sections of least to most characters, keeping repeated items whole."""

    def __init__(self, tree: Tree, least: int = 500, preferred: int = 15_000, most: int = 30_000) -> None:
        self.tree, self.least, self.preferred, self.most = tree, least, preferred, most
        self.size = sizes(tree)
        bodies = [n for n in range(len(tree)) if tree.tag[n] == "body"]
        self.root = bodies[0] if bodies else 0
        self.group = {n: g for n, g in repeated_groups(tree, self.size).items() if self.root <= g[0] < tree.end[self.root]}
        self.holders = {g[0] for g in self.group.values()}

    def shown(self, node: int) -> list[int]:
        return [c for c in self.tree.children[node] if self.size[c] > 0]

    def is_menu(self, node: int) -> bool:
        t = self.tree
        if t.attrs[node].get("role", "").lower() in MENU_ROLES or t.tag[node] == "select":
            return True
        roles = [t.attrs[c].get("role", "").lower() for c in t.children[node]]
        items = sum(r in MENU_ITEM_ROLES for r in roles)
        return len(roles) >= 3 and items == sum(bool(r) for r in roles) and items >= len(roles) / 2

    def is_wrapper(self, node: int) -> bool:
        """A plain container of several blocks, which is cut although it would fit."""
        if self.tree.tag[node] in SEMANTIC or self.is_menu(node):
            return False
        blocks = [self.size[c] for c in self.shown(node) if self.tree.tag[c] in BLOCK]
        return len(blocks) >= 3 or len(blocks) == 2 and max(blocks) > self.preferred * 0.4

    def cut(self, node: int, depth: int = 0) -> list[Piece]:
        t, size = self.tree, self.size[node]
        whole = [Piece([node], size, depth)]
        if size == 0:
            return []
        if self.is_menu(node):
            return whole if size <= self.preferred else []
        if node in self.group and size <= self.most:
            return [Piece([node], size, depth, self.group[node])]
        frame = t.tag[node] in ("html", "body")
        if not frame and (size < self.least or size <= self.preferred and not self.is_wrapper(node)):
            return whole
        kids = self.shown(node)
        if not kids:
            return whole
        if node not in self.holders and len(kids) >= 2 and len({t.tag[c] for c in kids}) == 1:
            return self._uniform(kids, depth + 1)
        pieces = [p for c in kids for p in (self.cut(c, depth + 1))]
        if not pieces:
            return whole if size <= self.most else []
        return self._gather(pieces)

    def _uniform(self, kids: list[int], depth: int) -> list[Piece]:
        """Siblings of one tag: each a section if the median is large enough, else equal batches."""
        pieces = [p for c in kids for p in (self.cut(c, depth) if self.size[c] > self.most else [Piece([c], self.size[c], depth)])]
        if not pieces:
            return []
        median = sorted(p.size for p in pieces)[len(pieces) // 2]
        return pieces if median >= self.least else _batches(pieces, self.least)

    def _gather(self, pieces: list[Piece]) -> list[Piece]:
        """Neighbours that are too small are joined, never across groups."""
        out: list[Piece] = []
        run: list[Piece] = []

        def close() -> None:
            if len(run) >= 3 and all(len(p.nodes) == 1 for p in run) and len({self.tree.tag[p.nodes[0]] for p in run}) == 1:
                out.extend(_batches(run, self.least))
            elif run:
                out.append(_joined(run))
            run.clear()

        for p in pieces:
            if run and p.group != run[0].group or p.size >= self.least:
                close()
            if p.size >= self.least:
                out.append(p)
                continue
            run.append(p)
            if sum(q.size for q in run) >= self.least:
                out.append(_joined(run))
                run.clear()
        close()
        return out


def slug(text: str, most: int = 20) -> str:
    return re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-")[:most]


def section_name(tree: Tree, nodes: list[int], index: int, used: set[str], position: int | None) -> str:
    """An id from a section's headings, links, placeholders, number of items, first words or parent; unique on the page."""
    tag = tree.tag[nodes[0]]
    said = lambda ns: [t for n in ns if (t := tree.inner_text(n).strip())]
    words = said(h for n in nodes for level in range(1, 7) for h in tree.within(n, f"h{level}"))
    if not words:
        words = [t for t in said(a for n in nodes for a in tree.within(n, "a")) if len(t) < 40][:4]
    if not words:
        words = [p for n in nodes for i in tree.within(n, "input") if (p := tree.attrs[i].get("placeholder", "").strip())]
    if tag in ("ul", "ol") and (items := sum(len(tree.within(n, "li")) for n in nodes)):
        words.append(f"{items}-items")
    if not words:
        words = [w for w in " ".join(tree.inner_text(n).strip() for n in nodes).split()[:5] if len(w) > 1]
    if not words and tree.parent[nodes[0]] >= 0:
        above = tree.attrs[tree.parent[nodes[0]]]
        words = [above["id"]] if above.get("id") else above.get("class", "").split()[:1]
    told = "-".join(s for w in words[:4] if (s := slug(w))) or f"section-{index}"
    base = f"{f'item-{position}-' if position is not None else ''}{tag}-{told}"[:60]
    name, k = base, 2
    while name in used:
        name, k = f"{base}-{k}", k + 1
    used.add(name)
    return name


def css_selector(tree: Tree, node: int) -> str:
    """A selector of a node: its id, its test id, or a path of tags."""
    a = tree.attrs[node]
    if a.get("id") and not re.search(r"\s", a["id"]):
        return f"#{a['id']}"
    if a.get("data-testid"):
        return f'[data-testid="{a["data-testid"]}"]'
    path = []
    while True:
        tag, up = tree.tag[node], tree.parent[node]
        if tag in ("html", "body") or up < 0:
            path.append(tag)
            break
        same = [c for c in tree.children[up] if tree.tag[c] == tag]
        first = (tree.attrs[node].get("class", "").split() or [""])[0]
        if len(same) > 1:
            path.append(f"{tag}:nth-of-type({same.index(node) + 1})")
        else:
            path.append(f"{tag}.{first}" if re.fullmatch(r"[a-zA-Z_-][a-zA-Z0-9_-]*", first) else tag)
        node = up
    return " > ".join(reversed(path))


def xpath(tree: Tree, node: int) -> str:
    parts = []
    while node >= 0:
        up = tree.parent[node]
        same = [c for c in tree.children[up] if tree.tag[c] == tree.tag[node]] if up >= 0 else [node]
        parts.append(tree.tag[node] + (f"[{same.index(node) + 1}]" if len(same) > 1 else ""))
        node = up
    return "/" + "/".join(reversed(parts))


def reference(tree: Tree, node: int) -> dict:
    kept = {k: tree.attrs[node][k] for k in ("id", "class", "role", "name", "data-testid", "aria-label", "href") if k in tree.attrs[node]}
    return {"xpath": xpath(tree, node), "css_selector": css_selector(tree, node), "tag": tree.tag[node], "dom_index": node, "attributes": kept}


def semantic_role(tree: Tree, nodes: list[int], repeated: bool) -> str:
    for n in nodes:
        if tree.tag[n] in STRICT_ROLES:
            return STRICT_ROLES[tree.tag[n]]
    for n in nodes:
        if (role := tree.attrs[n].get("role", "").lower().strip()) in TRUSTED_ROLES:
            return role
    return "repeated-item" if repeated else "content"


def short_hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def sections(page: str | None, metadata: dict[int, dict[str, str]] | None = None, least: int = 500, preferred: int = 15_000, most: int = 30_000) -> list[dict]:
    """The sections of a page in order."""
    tree = parse(page)
    if tree is None:
        return []
    cutter = Sectioner(tree, least, preferred, most)
    used: set[str] = set()
    counters: dict[tuple[int, int], int] = {}
    out, offset = [], 0
    for i, piece in enumerate(cutter.cut(cutter.root)):
        text, elements = render(tree, piece.nodes, metadata)
        if not text.strip():
            continue
        position = None
        if piece.group is not None:
            position = counters[piece.group] = counters.get(piece.group, 0) + 1
        inside = [n for top in piece.nodes for n in range(top, tree.end[top]) if "data-iid" in tree.attrs[n]]
        get = lambda n, k: tree.attrs[n].get(k, "")
        sign = "|".join(sorted(f"{tree.tag[n]}:iid={get(n, 'data-iid')}:href={get(n, 'href')}:name={get(n, 'name')}:role={get(n, 'role')}" for n in inside))
        up = tree.parent[piece.nodes[0]]
        out.append({
            "id": section_name(tree, piece.nodes, i, used, position), "text": text, "start_element": reference(tree, piece.nodes[0]), "end_element": reference(tree, piece.nodes[-1]),
            "content_hash": short_hash(text), "interactive_hash": short_hash(sign), "depth": piece.depth, "is_interactive": bool(inside), "interactive_count": len(inside),
            "parent_tag": tree.tag[up] if up >= 0 else "", "semantic_role": semantic_role(tree, piece.nodes, any(n in cutter.group for n in piece.nodes)),
            "char_start": offset, "char_end": offset + len(text), "elements": elements,
        })
        offset += len(text) + 2
    return out


# ---- writing HTML ----------------------------------------------------------------------------------------------------


def serialise(tree: Tree, pretty: bool = False, keep: set[int] | None = None) -> str:
    """The tree as HTML; with keep, only those nodes. Pretty output has a tag or text on each line."""
    out: list[str] = []
    pending: list[int] = []
    pad = lambda d: " " * d if pretty else ""
    end_line = "\n" if pretty else ""

    def say(text: str, depth: int, raw: bool) -> None:
        text = text.strip() if pretty else text
        if text:
            out.append(pad(depth) + (text if raw else html.escape(text, quote=False)) + end_line)

    def close() -> None:
        n = pending.pop()
        for note in tree.comments.get(-n - 1, ()):
            out.append(f"{pad(tree.depth[n] + 1)}<!--{note}-->{end_line}")
        if tree.tag[n] not in VOID:
            out.append(f"{pad(tree.depth[n])}</{tree.tag[n]}>{end_line}")
        say(tree.tail[n], tree.depth[n], False)

    n = 0
    while n < len(tree):
        while pending and n >= tree.end[pending[-1]]:
            close()
        for note in tree.comments.get(n, ()):
            out.append(f"{pad(tree.depth[n])}<!--{note}-->{end_line}")
        if keep is not None and n not in keep:
            say(tree.tail[n], tree.depth[n], False)
            n = tree.end[n]
            continue
        attributes = "".join(f' {k}="{html.escape(v)}"' for k, v in tree.attrs[n].items())
        out.append(f"{pad(tree.depth[n])}<{tree.tag[n]}{attributes}>{end_line}")
        say(tree.text[n], tree.depth[n] + 1, tree.tag[n] in ("script", "style"))
        pending.append(n)
        n += 1
    while pending:
        close()
    return "".join(out)


def zoom(page: str | None, ranges: list[tuple[int, int]]) -> str:
    """The page with the nodes of the ranges (first and last node number) in full, their ancestors as shells, and other
    elements as placeholders: one or two each as <tag>...</tag>, more as the first, a note and the last."""
    tree = parse(page)
    if tree is None or any(max(r) >= len(tree) for r in ranges):
        return ""
    inside, shell = set(), set()
    for a, b in ranges:
        a, b = min(a, b), max(a, b)
        inside.update(range(a, b + 1))
        for n in (a, b):
            inside.update(range(n, tree.end[n]))
    for n in inside:
        while (n := tree.parent[n]) >= 0 and n not in inside and n not in shell:
            shell.add(n)
    out = Tree()
    copy = {}

    def put(n: int, text: str, attrs: dict[str, str]) -> int:
        m = out.add(tree.tag[n], attrs, copy.get(tree.parent[n], -1))
        out.text[m] = text
        return m

    n = 0
    while n < len(tree):
        if n in inside:
            copy[n] = put(n, tree.text[n], tree.attrs[n])
            out.tail[copy[n]] = tree.tail[n] if tree.parent[n] in inside else ""
            n += 1
        elif n in shell:
            copy[n] = put(n, "", tree.attrs[n])
            n += 1
        else:
            brothers = tree.children[tree.parent[n]] if tree.parent[n] >= 0 else [n]
            run = [n]
            for b in brothers[brothers.index(n) + 1 :]:
                if b in inside or b in shell:
                    break
                run.append(b)
            ends = run if len(run) < 3 else [run[0], run[-1]]
            for b in ends:
                m = put(b, "...", {})
                if len(run) > 2 and b == run[-1]:
                    out.comments[m] = [f" {len(run) - 2} elements omitted "]
            n = tree.end[run[-1]]
    for n in range(len(out) - 1, -1, -1):
        out.end[n] = max([n + 1, *(out.end[c] for c in out.children[n])])
    return re.sub(r'\s*data-(?:iid|hidden)="[^"]*"', "", serialise(out, True)).strip() + "\n"
