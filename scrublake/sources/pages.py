"""HTML pages: elements, static text nodes, page context and an audit of what was left out.

The tree is read by an Arrow-batched parser on the executors; what is chosen and cut afterwards is in DataFrame functions where these can say
it. There is no layout engine: boxes come from a table of layout rows, told by XPath. Without it, boxes are unknown, and
of the reasons for leaving elements out only own overlays, hidden inputs and hidden style can be told.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrublake.functions.boxes import box, viewport
from scrublake.functions.text import collapse, half_up

# What counts as interactive or static, attributes that are kept, tags that close others or have no content.
CONTROLS = ("input", "button", "select", "textarea", "a", "img")
ROLES = ("img", "button", "link", "textbox", "checkbox", "combobox", "menuitem")
STATIC = ("span", "div", "p", "li", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6")
KEPT = (
    "name", "type", "role", "placeholder", "aria-label", "aria-labelledby", "aria-describedby", "aria-hidden", "aria-expanded", "aria-checked", "aria-disabled",
    "disabled", "readonly", "required", "href", "title", "alt", "value", "data-testid",
)
OVERLAYS = ("sih-privacy-overlay-root", "kw-detection-overlay-root", "kw-debug-highlights-container")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
SAME = {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
SCOPES = {"li": {"ul", "ol"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "option": {"select"}, "dt": {"dl"}, "dd": {"dl"}}
#: What stands on lines of its own in visible text, and what is a cell.
BLOCKS = CLOSES_P | {"body", "html", "li", "dt", "dd", "tr", "caption", "figure", "figcaption", "option", "legend", "details", "summary"}
CELLS = {"td", "th"}
_SPACE = re.compile("[\t\n\x0b\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]+")


def squeezed(text: str) -> str:
    return _SPACE.sub(" ", text).strip(" ")


class Node:
    """An element. Filled in while the tree is read: its place in document order and where its subtree ends, its text's place in the page's
    pieces, and what it inherits."""

    __slots__ = ("attrs", "bare", "children", "end", "index", "inside", "overlay", "parent", "place", "places", "shown", "tag", "veiled", "visibility")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.place, self.places = 1, {}
        if parent is not None:
            self.place = parent.places[tag] = parent.places.get(tag, 0) + 1
            parent.children.append(self)

    def up(self) -> Iterator[Node]:
        n: Node | None = self
        while n is not None and n.tag:
            yield n
            n = n.parent


def styled(n: Node) -> dict[str, str]:
    """Display, visibility and opacity of a node's own style, where it says something."""
    if "style" not in n.attrs and "hidden" not in n.attrs:
        return {}
    out = {"display": "none"} if "hidden" in n.attrs else {}
    for part in n.attrs.get("style", "").lower().split(";"):
        name, _, value = part.partition(":")
        if name.strip() in ("display", "visibility", "opacity"):
            out[name.strip()] = value.replace("!important", "").strip()
    return out


class Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.open: dict[str, int] = {}

    def _leave(self, n: Node) -> None:
        """Close everything up to n."""
        while self.at is not n.parent:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def _close(self, tags: set[str], scope: set[str]) -> None:
        if any(self.open.get(t) for t in tags):
            for n in self.at.up():
                if n.tag in tags:
                    return self._leave(n)
                if n.tag in scope:
                    return None
        return None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES_P:
            self._close({"p"}, {"button", "td", "th", "table"})
        if tag in SAME:
            self._close(SAME[tag], SCOPES[tag])
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        if tag not in VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.open.get(tag):
            for n in self.at.up():
                if n.tag == tag:
                    return self._leave(n)
        return None

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def css_escaped(ident: str) -> str:
    """A name as it stands in a selector."""
    out = []
    for i, c in enumerate(ident):
        if c == "\0":
            out.append("\uFFFD")
        elif c < " " or c == "\x7f" or ("0" <= c <= "9" and (i == 0 or (i == 1 and ident[0] == "-"))):
            out.append(f"\\{ord(c):x} ")
        elif c == "-" and len(ident) == 1:
            out.append("\\-")
        elif c >= "\x80" or c in "-_" or c.isalnum():
            out.append(c)
        else:
            out.append("\\" + c)
    return "".join(out)


#: Pieces of text, or the place where a part that is passed over ends.
Pieces = list[str | int]


def gathered(pieces: Pieces, a: int, b: int, over: bool, most: int | None = None) -> str:
    """Text of the pieces from a to b; ``over``: without the parts that are passed over. Stops after ``most`` characters besides blanks."""
    out, size = [], 0
    while a < b:
        p = pieces[a]
        if isinstance(p, int):
            a = p if over else a + 1
            continue
        out.append(p)
        a += 1
        if most is not None:
            size += len("".join(p.split()))
            if size > most:
                break
    return "".join(out)


class Page:
    """A page's nodes in document order, read in one pass: texts are places in lists of pieces, and what is inherited or counted is known to
    each node, so that a row costs the length of its own text and path, however deep the tree is."""

    def __init__(self, html: str, overlays: tuple[str, ...] = OVERLAYS) -> None:
        tree = Tree()
        tree.feed(html)
        tree.close()
        self.root, self.nodes = tree.root, []
        #: All text, with the ends of controls; and text as a reader sees it, with breaks, and the ends of hidden parts.
        self.bare: Pieces = []
        self.shown: Pieces = []
        #: How many controls come before each node.
        self.controls = [0]
        self._read(overlays)
        self.by_id: dict[str, list[Node]] = {}
        self.labels: dict[str, Node] = {}
        #: Places of the nodes of a tag and name.
        self.named: dict[tuple[str, str], list[int]] = {}
        for n in self.nodes:
            self.by_id.setdefault(n.attrs.get("id", ""), []).append(n)
            if n.tag == "label" and n.attrs.get("for"):
                self.labels.setdefault(n.attrs["for"], n)
            if name := n.attrs.get("name"):
                self.named.setdefault((n.tag, name), []).append(n.index)
        self.before: dict[int, Node] = {}
        for p in [self.root, *self.nodes]:
            kids = [c for c in p.children if isinstance(c, Node)]
            self.before.update((id(b), a) for a, b in zip(kids, kids[1:], strict=False))
        self._said: dict[int, str] = {}

    def _read(self, overlays: tuple[str, ...]) -> None:
        bare, shown, last_break = self.bare, self.shown, -1
        self.root.overlay, self.root.veiled, self.root.visibility, self.root.index = False, False, "visible", -1
        stack: list[tuple[Node | str, bool]] = [(c, True) for c in reversed(self.root.children)]
        marks: dict[int, tuple[int | None, int | None, str]] = {}

        def put(gap: str) -> None:
            nonlocal last_break
            if last_break != len(shown) - 1 or not shown:
                last_break = len(shown)
                shown.append(gap)

        while stack:
            n, enters = stack.pop()
            if isinstance(n, str):
                bare.append(n)
                if n.strip():
                    shown.append(n)
                elif n:
                    put(" ")
            elif enters:
                up, style = n.parent, styled(n)
                n.index = len(self.nodes)
                self.nodes.append(n)
                self.controls.append(self.controls[-1] + (n.tag in CONTROLS[:5]))
                n.overlay = up.overlay or n.attrs.get("id") in overlays
                n.visibility = style.get("visibility", up.visibility)
                n.veiled = up.veiled or style.get("display") == "none"
                gone = style.get("display") == "none" or style.get("visibility") in ("hidden", "collapse")
                gap = "\n" if n.tag in BLOCKS or n.tag == "br" else "\t" if n.tag in CELLS else ""
                if gap:
                    put(gap)
                control = hidden = None
                if n.tag in CONTROLS[:4]:
                    control = len(bare)
                    bare.append(control + 1)
                if gone or n.tag in ("script", "style", "template", "noscript"):
                    hidden, last_break = len(shown), -1
                    shown.append(hidden + 1)
                n.bare, n.shown = (len(bare), 0), (len(shown), 0)
                marks[id(n)] = (control, hidden, gap)
                stack.append((n, False))
                stack += [(c, True) for c in reversed(n.children)]
            else:
                control, hidden, gap = marks.pop(id(n))
                n.end, n.bare, n.shown = len(self.nodes), (n.bare[0], len(bare)), (n.shown[0], len(shown))
                n.inside = self.controls[n.end] - self.controls[n.index + 1]
                if control is not None:
                    bare[control] = len(bare)
                if hidden is not None:
                    shown[hidden], last_break = len(shown), -1
                if gap:
                    put(gap)

    def text(self, n: Node, most: int | None = None) -> str:
        """All text inside."""
        return gathered(self.bare, *n.bare, False, most)

    def own_text(self, n: Node, most: int | None = None) -> str:
        """Text inside, controls left out."""
        return "" if n.tag in CONTROLS[:4] else gathered(self.bare, *n.bare, True, most)

    def seen_text(self, n: Node, most: int) -> str:
        """Text as a reader sees it, squeezed; one of over ``most`` characters may be cut after these. What is hidden itself has all its text."""
        return squeezed(gathered(self.shown, *n.shown, True, most))

    def parent_text(self, n: Node) -> str:
        """Text of a node without its controls, up to where it is too long for a label; once for all fields in it."""
        if id(n) not in self._said:
            self._said[id(n)] = squeezed(self.own_text(n, 80))
        return self._said[id(n)]

    def first(self, ident: str) -> Node | None:
        return next(iter(self.by_id.get(ident, ())), None) if ident else None

    def only(self, parent: Node, tag: str, name: str) -> bool:
        """Whether one node alone below ``parent`` has this tag and name."""
        places = self.named.get((tag, name), [])
        at = bisect_left(places, parent.index + 1)
        end = len(self.nodes) if parent is self.root else parent.end
        return at < len(places) and places[at] < end and (at + 1 == len(places) or places[at + 1] >= end)

    def selector(self, node: Node) -> str:
        """A unique id, or steps up to one: by name among siblings' subtrees, else by place among siblings of the tag."""
        path: list[str] = []
        n: Node | None = node
        while n is not None and n.tag and n.tag != "html":
            ident = n.attrs.get("id", "").strip()
            if ident and len(self.by_id.get(ident, ())) == 1:
                path.append(f"#{css_escaped(ident)}")
                break
            name, parent = n.attrs.get("name"), n.parent
            if name and parent is not None and self.only(parent, n.tag, name):
                path.append(f'{n.tag}[name="{css_escaped(name)}"]')
            else:
                path.append(f"{n.tag}:nth-of-type({n.place})")
            n = parent
        return " > ".join(reversed(path))

    def xpath(self, node: Node) -> str:
        return "/" + "/".join(reversed([f"{n.tag}[{n.place}]" for n in node.up()]))

    def label(self, n: Node) -> str | None:
        """What names a field: label for, label around, aria label, labelling element, the sibling before, the parent's text."""
        ident = n.attrs.get("id", "").strip()
        if ident:
            found = self.labels.get(ident)
            if found is not None and (text := squeezed(self.text(found))):
                return text
        around = next((x for x in n.up() if x.tag == "label"), None)
        if around is not None:
            if -id(around) not in self._said:
                self._said[-id(around)] = squeezed(self.own_text(around))
            if text := self._said[-id(around)]:
                return text
        if text := n.attrs.get("aria-label", "").strip():
            return text
        by = self.first(n.attrs.get("aria-labelledby", ""))
        if by is not None and (text := squeezed(self.text(by))):
            return text
        if n.parent is not None:
            before = self.before.get(id(n))
            if before is not None and before.tag not in CONTROLS[:5] and 0 < len(text := squeezed(self.text(before, 80))) <= 80:
                return text
            if n.parent is not self.root and 0 < len(text := self.parent_text(n.parent)) <= 80:
                return text
        return None

    def says(self, n: Node) -> str:
        if text := n.attrs.get("aria-label", "").strip():
            return text
        by = self.first(n.attrs.get("aria-labelledby", ""))
        if by is not None and (text := self.text(by).strip()):
            return text
        if n.tag in ("input", "textarea"):
            if text := n.attrs.get("placeholder", "").strip():
                return text
            value = n.attrs.get("value", "") if n.tag == "input" else self.text(n)
            if value.strip() and n.attrs.get("type", "").lower() != "password":
                return value.strip()
        for k in ("alt", "title"):
            if text := n.attrs.get(k, "").strip():
                return text
        text = self.seen_text(n, 120)
        return text if len(text) <= 120 else text[:117] + "..."

    def style(self, n: Node) -> str | None:
        """Why a style hides a node: its own display or opacity, its or an outer visibility, or an outer part that isn't displayed."""
        own = styled(n)
        display = own.get("display") or ("none" if n.veiled else "block" if n.tag in BLOCKS else "inline")
        clear = bool(re.fullmatch(r"0(\.0*)?%?|\.0+", own.get("opacity", "")))
        if display == "none" or n.visibility in ("hidden", "collapse") or clear or n.veiled:
            return f"display={display}, visibility={n.visibility}, opacity={0 if clear else 1}"
        return None


def _interactive(n: Node) -> bool:
    return n.tag in CONTROLS or n.attrs.get("role") in ROLES or n.attrs.get("contenteditable", "-") in ("", "true")


def _attributes(n: Node) -> dict[str, str]:
    password = n.attrs.get("type") == "password"
    return {k: "[PROTECTED]" if k == "value" and password else n.attrs[k].strip() for k in KEPT if n.attrs.get(k)}


ROW = "page_id long, kind string, idx int, id string, tag_name string, type string, role string, text string, label_text string, selector string, xpath string, attributes map<string,string>, overlay boolean, unsized boolean, style string"
CONTEXT = "page_id long, title string, og string, description string, headings array<string>, content string"


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[f.split()[0] for f in re.sub(r"<[^>]*>", "", schema).split(", ")])


def _mapped(pages: DataFrame, each, schema: str, overlays: tuple[str, ...] = OVERLAYS) -> DataFrame:
    """``each`` gives the rows of a page; a page that is null has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.iloc[at : at + 64]
                yield _frame([r for i, h in zip(part["page_id"], part["html"], strict=True) if h is not None for r in each(i, Page(h, overlays))], schema)

    return pages.select("page_id", "html").mapInPandas(run, schema)


def rows(pages: DataFrame, kinds: tuple[str, ...] = ("element", "static"), overlays: tuple[str, ...] = OVERLAYS, all_static: bool = False) -> DataFrame:
    """Each page (page_id, html) parsed once: its interactive elements (kind element) and static texts of 3 to 300 characters (kind static), each
    numbered by ``idx`` in document order, with what hides them.

    Of static nodes of a page with equal text only the first that nothing hides is given, as no other can be taken; ``all_static``: all of them,
    for judging by boxes.
    """

    def each(page_id: int, page: Page) -> Iterator[tuple]:
        elements = static = 0
        said: set[str] = set()
        for n in page.nodes:
            if _interactive(n) and "element" in kinds:
                kind = n.attrs.get("type") or {"input": "text", "button": "submit"}.get(n.tag)
                label = page.label(n) if n.tag in ("input", "select", "textarea") else None
                unsized = n.tag == "input" and n.attrs.get("type", "").lower() == "hidden"
                yield (
                    page_id, "element", elements, n.attrs.get("id") or f"kw-el-{elements}", n.tag, kind, n.attrs.get("role") or None, page.says(n), label, page.selector(n), page.xpath(n),
                    _attributes(n), n.overlay, unsized, page.style(n),
                )
            elements += _interactive(n)
            if n.tag in STATIC:
                static += 1
                if "static" not in kinds or n.inside or n.overlay:
                    continue
                style = page.style(n)
                text = page.seen_text(n, 300)
                if not 3 <= len(text) <= 300 or (not all_static and (style or text in said)):
                    continue
                said.add(text)
                yield page_id, "static", static - 1, n.attrs.get("id") or f"kw-static-{static - 1}", n.tag, None, None, text, None, page.selector(n), page.xpath(n), None, n.overlay, False, style

    return _mapped(pages, each, ROW, overlays)


def judged(found: DataFrame, layout: DataFrame | None = None, viewports: DataFrame | None = None) -> DataFrame:
    """Rows with bbox, reason and details: why one isn't visible, the first of EXTENSION_OVERLAY, ZERO_DIMENSIONS, OUT_OF_VIEWPORT and CSS_HIDDEN,
    or null.

    ``layout`` has page_id, xpath, left, top, width, height, and perhaps display, visibility and opacity as computed; what it doesn't have isn't
    drawn and has no size. ``viewports`` has page_id, width, height, device_pixel_ratio; unknown ones take fallbacks. Without a layout boxes are null.
    """
    overlay = F.when(F.col("overlay"), F.struct(F.lit("EXTENSION_OVERLAY").alias("reason"), F.lit("Belongs to extension overlay").alias("details")))
    why = lambda name, details: F.struct(F.lit(name).alias("reason"), details.alias("details"))
    whole = lambda x: half_up(x).cast("long").cast("string")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    sizes = lambda w, h: text("width=", whole(w), ", height=", whole(h))
    if layout is None:
        zero = F.lit(0.0)
        w = overlay.when(F.col("unsized"), why("ZERO_DIMENSIONS", sizes(zero, zero))).when(F.col("style").isNotNull(), why("CSS_HIDDEN", F.col("style")))
        none = F.lit(None).cast("struct<left:double,top:double,width:double,height:double>")
        return found.withColumn("_w", w).select("*", none.alias("bbox"), "_w.reason", "_w.details").drop("_w")
    sides = ("left", "top", "width", "height")
    given = [F.col(c).alias(f"_{c}") for c in ("display", "visibility", "opacity") if c in layout.columns]
    at = layout.select("page_id", "xpath", *(F.col(c).cast("double").alias(f"_{c}") for c in sides), *given)
    if viewports is None:
        unknown = F.lit(None).cast("double")
        found = found.withColumn("_v", viewport(unknown, unknown, unknown))
    else:
        found = found.join(viewports.select("page_id", *(F.col(c).cast("double").alias(f"_v{c[0]}") for c in ("width", "height", "device_pixel_ratio"))), "page_id", "left")
        found = found.withColumn("_v", viewport(F.nullif("_vw", F.lit(0.0)), F.nullif("_vh", F.lit(0.0)), F.col("_vd"))).drop("_vw", "_vh", "_vd")
    found = found.join(at, ["page_id", "xpath"], "left").na.fill(0.0, [f"_{c}" for c in sides])
    left, top, width, height = (F.col(f"_{c}") for c in sides)
    out = (top + height <= 0) | (left + width <= 0) | (top >= F.col("_v.height")) | (left >= F.col("_v.width"))
    hidden, details = F.col("style").isNotNull(), F.col("style")
    if len(given) == 3:
        hidden = (F.col("_display") == "none") | F.col("_visibility").isin("hidden", "collapse") | (F.col("_opacity") == 0)
        details = text("display=", F.col("_display"), ", visibility=", F.col("_visibility"), ", opacity=", F.regexp_replace(F.col("_opacity").cast("string"), r"\.0$", ""))
    w = overlay.when((width == 0) | (height == 0), why("ZERO_DIMENSIONS", sizes(width, height)))
    w = w.when(out, why("OUT_OF_VIEWPORT", text("top=", whole(top), ", bottom=", whole(top + height), ", vh=", whole(F.col("_v.height"))))).when(hidden, why("CSS_HIDDEN", details))
    rounded = box(*(half_up(x) for x in (left, top, width, height)))
    return found.withColumn("_w", w).withColumn("bbox", rounded).select("*", "_w.reason", "_w.details").drop("_w", "_v", *(f"_{c}" for c in sides), *(f"_{c}" for c in ("display", "visibility", "opacity")))


def candidates(pages: DataFrame, overlays: tuple[str, ...] = OVERLAYS, layout: DataFrame | None = None, viewports: DataFrame | None = None) -> DataFrame:
    """All interactive elements of ``pages`` (page_id, html) in document order, with reason and details where one is left out; with boxes if
    there is a layout."""
    found = judged(rows(pages, ("element",), overlays), layout, viewports)
    boxes = [] if layout is None else ["bbox"]
    return found.select("page_id", F.col("idx").alias("el_idx"), "id", "tag_name", "type", "role", "text", "label_text", "selector", "xpath", "attributes", *boxes, "reason", "details")


def elements(pages: DataFrame, overlays: tuple[str, ...] = OVERLAYS, layout: DataFrame | None = None, viewports: DataFrame | None = None) -> DataFrame:
    """Visible interactive elements; numbers count the invisible ones too."""
    return candidates(pages, overlays, layout, viewports).where("reason is null").drop("reason", "details")


def skipped(pages: DataFrame, overlays: tuple[str, ...] = OVERLAYS, layout: DataFrame | None = None, viewports: DataFrame | None = None) -> DataFrame:
    """Interactive elements that are left out: page_id, el_idx, tag_name, text, reason, details, and bbox if there is a layout."""
    boxes = [] if layout is None else ["bbox"]
    return candidates(pages, overlays, layout, viewports).where("reason is not null").select("page_id", "el_idx", "tag_name", "text", "reason", "details", *boxes)


def audit(pages: DataFrame, overlays: tuple[str, ...] = OVERLAYS, layout: DataFrame | None = None, viewports: DataFrame | None = None) -> DataFrame:
    """Per page: elements in all, kept, and left out by reason."""
    c = candidates(pages, overlays, layout, viewports)
    counted = {r: F.count_if(F.col("reason") == r) for r in ("EXTENSION_OVERLAY", "ZERO_DIMENSIONS", "OUT_OF_VIEWPORT", "CSS_HIDDEN")}
    return c.groupBy("page_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("reason").isNull()).alias("kept"), *(v.alias(k.lower()) for k, v in counted.items()))


def count_inputs(pages: DataFrame) -> DataFrame:
    """Per page: how many input elements it has, hidden ones too, and what the privacy inspection says of them."""
    c = candidates(pages).where("tag_name = 'input'").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    said = F.concat(F.lit("🔒 Privacy audit complete: "), n.cast("string"), F.lit(" input field(s) analyzed."))
    return pages.select("page_id").join(c, "page_id", "left").select("page_id", n.alias("field_count"), said.alias("message"))


def taken(found: DataFrame, patterns) -> DataFrame:
    """Of judged rows, the visible elements, and the visible static nodes that ``patterns`` (text column to array of names) finds something in; of
    these, of equal texts in a page (case and white space aside) the first. Adds matched_patterns."""
    names = F.when(F.col("kind") == "static", patterns(F.col("text")))
    seen = found.where("reason is null").withColumn("matched_patterns", names).where("kind = 'element' or size(matched_patterns) > 0")
    key = F.when(F.col("kind") == "static", F.lower(F.regexp_replace("text", " ", ""))).otherwise(F.col("idx").cast("string"))
    first = F.row_number().over(Window.partitionBy("page_id", "kind", key).orderBy("idx"))
    return seen.withColumn("_n", first).where(F.col("_n") == 1).drop("_n")


def static_nodes(pages: DataFrame, patterns, overlays: tuple[str, ...] = OVERLAYS, layout: DataFrame | None = None, viewports: DataFrame | None = None) -> DataFrame:
    """Static text nodes of 3 to 300 characters that ``patterns`` (text column to array of names) finds something in; of equal texts in a
    page (case and white space aside) the first."""
    found = taken(judged(rows(pages, ("static",), overlays, all_static=layout is not None), layout, viewports), patterns)
    boxes = [] if layout is None else ["bbox"]
    return found.select("page_id", F.col("idx").alias("node_idx"), "id", "tag_name", "text", "selector", "xpath", *boxes, "matched_patterns")


def context(pages: DataFrame) -> DataFrame:
    """page_id, title, url, meta_description, headings (the first five of h1 and h2), simplified_content (800 characters)."""

    def each(page_id: int, page: Page) -> Iterator[tuple]:
        title = next((squeezed(page.text(n)) for n in page.nodes if n.tag == "title"), None)
        meta = lambda k, v: next((n.attrs.get("content", "") for n in page.nodes if n.tag == "meta" and n.attrs.get(k) == v), None)
        main = next((n for n in page.nodes if n.tag in ("main", "article") or n.attrs.get("id") == "content" or n.attrs.get("role") == "main"), None)
        main = main or next((n for n in page.nodes if n.tag == "body"), None)
        headings = (page.text(n).strip() for n in page.nodes if n.tag in ("h1", "h2"))
        yield page_id, title, meta("property", "og:description"), meta("name", "description"), list(islice(filter(None, headings), 5)), page.text(main, 800) if main else ""

    c = _mapped(pages, each, CONTEXT)
    c = c.select(
        "page_id", F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled Page")).alias("title"), F.coalesce("description", "og", F.lit("")).alias("meta_description"),
        "headings", F.substring(collapse(F.col("content")), 1, 800).alias("simplified_content"),
    )
    return pages.select("page_id", "url").join(c, "page_id", "left")


def overlaid(fallback: DataFrame, content: DataFrame, key: str = "tab_id") -> DataFrame:
    """Tab rows with what the page itself says, where it says something."""
    c = content.select(key, *(F.col(x).alias(f"_c_{x}") for x in content.columns if x != key))
    joined = fallback.join(c, key, "left")
    rest = [x for x in fallback.columns if x != key]
    more = [x for x in content.columns if x not in fallback.columns]
    return joined.select(key, *(F.coalesce(f"_c_{x}", x).alias(x) if x in content.columns else F.col(x) for x in rest), *(F.col(f"_c_{x}").alias(x) for x in more))
