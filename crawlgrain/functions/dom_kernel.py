"""HTML text -> one flat DOM row. The only parsing done in Python; all analysis is Spark expressions.

Runs inside ``mapInArrow``: Arrow batches of (page_id, url, html) come in, Arrow batches of DOM rows go out.
Nodes are numbered in document order, so the subtree of node ``n`` is ``node_id..subtree_end`` and its
text is the slice ``t0..t1`` of the page's visible strings.
"""

from __future__ import annotations

import re
from collections import Counter
from html.entities import html5
from html.parser import HTMLParser
from itertools import accumulate, chain

import pyarrow as pa

# HTML elements that never have content.
VOID_TAGS = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem "
    "meta nextid param source spacer track wbr".split()
)
# Elements whose strings are not page text, and elements that keep blank strings as written.
HIDDEN_TEXT_TAGS = frozenset(("script", "style", "template"))
KEEP_BLANKS_TAGS = frozenset(("pre", "textarea"))
ASCII_BLANKS = " \n\t\f\r"
# Elements whose content some parser versions read as raw text.
RAW_TEXT_TAGS = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
PLAIN_START = re.compile("<([a-zA-Z][a-zA-Z0-9]*)>")
PLAIN_END = re.compile("</([a-zA-Z][a-zA-Z0-9]*)>")
# Mark of an element with more than one child or string.
MANY = ("many", None)

NODE_FIELDS = [
    ("node_id", pa.int32()),
    ("parent_id", pa.int32()),
    ("depth", pa.int32()),
    ("tag", pa.string()),
    ("elem_idx", pa.int32()),
    ("tag_idx", pa.int32()),
    ("tag_total", pa.int32()),
    ("n_children", pa.int32()),
    ("subtree_end", pa.int32()),
    ("attrs", pa.map_(pa.string(), pa.string())),
    ("id", pa.string()),
    ("classes", pa.list_(pa.string())),
    ("t0", pa.int32()),
    ("t1", pa.int32()),
    ("only_seg", pa.int32()),
    ("only_hidden", pa.int32()),
    ("text_len", pa.int32()),
    ("in_pager", pa.bool_()),
]
NODE_TYPE = pa.struct(NODE_FIELDS)
HIDDEN_TYPE = pa.struct([("node_id", pa.int32()), ("kind", pa.string()), ("text", pa.string())])

DOM_SCHEMA = (
    "page_id long, url string, html_len int, nodes array<struct<node_id:int, parent_id:int, depth:int, tag:string, "
    "elem_idx:int, tag_idx:int, tag_total:int, n_children:int, subtree_end:int, attrs:map<string,string>, "
    "id:string, classes:array<string>, t0:int, t1:int, only_seg:int, only_hidden:int, text_len:int, in_pager:boolean>>, "
    "segs array<string>, "
    "hidden array<struct<node_id:int, kind:string, text:string>>, warning string"
)

ROWS_PER_OUTPUT_BATCH = 64
# A page's row is some times its html: this bounds what one output batch holds.
BYTES_PER_OUTPUT_BATCH = 4 << 20
PARTS = ("nodes", "segs", "hidden")


class DomBuilder(HTMLParser):
    """Builds one document as parallel lists: one entry per element, per visible string, per hidden string."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.tag: list[str] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.attrs: list[dict] = []
        self.t0: list[int] = []
        self.t1: list[int] = []
        self.end: list[int] = []
        self.sole: list[tuple | None] = []
        self.segs: list[str] = []
        self.hidden: list[tuple] = []
        self.stack: list[int] = []
        self.open_tags: Counter = Counter()
        self.hiding: list[str] = []
        self.keeping_blanks = 0
        self.pending: list[str] = []

    def updatepos(self, i, j):
        """Line numbers are not needed."""
        return j

    # Most tags are plain <p> or </p>: read those with one match, leave every other form to the base class.
    def parse_starttag(self, i):
        plain = PLAIN_START.match(self.rawdata, i)
        if plain is None or (tag := plain[1].lower()) in RAW_TEXT_TAGS:
            return super().parse_starttag(i)
        self.handle_starttag(tag, ())
        return plain.end()

    def parse_endtag(self, i):
        plain = PLAIN_END.match(self.rawdata, i) if self.cdata_elem is None else None
        if plain is None:
            return super().parse_endtag(i)
        self.handle_endtag(plain[1].lower())
        return plain.end()

    # -- strings ---------------------------------------------------------------------------------
    def handle_data(self, data):
        self.pending.append(data)

    def handle_entityref(self, name):
        self.pending.append(html5.get(name + ";", "&" + name))

    def handle_charref(self, name):
        code = int(name[1:], 16) if name[:1] in "xX" else int(name)
        char = bytes([code]).decode("cp1252", "ignore") if code < 256 else ""
        if not char and code < 0x110000 and not 0xD800 <= code < 0xE000:
            char = chr(code)
        self.pending.append(char or "\N{REPLACEMENT CHARACTER}")

    def handle_comment(self, data):
        self._special("comment", data)

    def handle_decl(self, decl):
        self._special("doctype", decl)

    def handle_pi(self, data):
        self._special("instruction", data)

    def unknown_decl(self, data):
        if data.upper().startswith("CDATA["):
            self._special(None, data[len("CDATA["):])
        else:
            self._special("declaration", data)

    def _special(self, kind, data):
        if self.pending:
            self._flush()
        self._add_string(data, kind)

    def _flush(self):
        """End the current run of character data and references: they form one string."""
        text = "".join(self.pending)
        self.pending.clear()
        if not self.keeping_blanks and not text.strip(ASCII_BLANKS):
            text = "\n" if "\n" in text else " "
        self._add_string(text, self.hiding[-1] if self.hiding else None)

    def _add_string(self, text, kind):
        owner = self.stack[-1] if self.stack else -1
        if kind is None:
            ref = ("seg", len(self.segs))
            self.segs.append(text)
        else:
            ref = ("hidden", len(self.hidden))
            self.hidden.append((owner, kind, text))
        if owner >= 0:
            self.sole[owner] = MANY if self.sole[owner] else ref

    # -- elements --------------------------------------------------------------------------------
    def handle_starttag(self, tag, attrs):
        self._open(tag, attrs)
        if tag in VOID_TAGS:
            self._pop()

    def handle_startendtag(self, tag, attrs):
        self._open(tag, attrs)
        self._pop()

    def handle_endtag(self, tag):
        if self.pending:
            self._flush()
        if self.open_tags[tag]:
            while self._pop() != tag:
                pass

    def _open(self, tag, attrs):
        if self.pending:
            self._flush()
        node = len(self.tag)
        parent = self.stack[-1] if self.stack else -1
        if parent >= 0:
            self.sole[parent] = MANY if self.sole[parent] else ("node", node)
        self.tag.append(tag)
        self.parent.append(parent)
        self.depth.append(len(self.stack))
        self.attrs.append({name: value or "" for name, value in attrs} if attrs else None)
        self.t0.append(len(self.segs))
        self.t1.append(0)
        self.end.append(0)
        self.sole.append(None)
        self.stack.append(node)
        self.open_tags[tag] += 1
        if tag in HIDDEN_TEXT_TAGS:
            self.hiding.append(tag)
        elif tag in KEEP_BLANKS_TAGS:
            self.keeping_blanks += 1

    def _pop(self):
        node = self.stack.pop()
        tag = self.tag[node]
        self.end[node] = len(self.tag) - 1
        self.t1[node] = len(self.segs)
        self.open_tags[tag] -= 1
        if tag in HIDDEN_TEXT_TAGS:
            self.hiding.pop()
        elif tag in KEEP_BLANKS_TAGS:
            self.keeping_blanks -= 1
        return tag

    def finish(self):
        self.close()
        if self.pending:
            self._flush()
        while self.stack:
            self._pop()
        return self

    def node_columns(self):
        """The node lists in NODE_FIELDS order, with sibling positions and the lone string of each element."""
        size = len(self.tag)
        siblings, same_tag = Counter(), Counter()
        elem_idx, tag_idx = [0] * size, [0] * size
        for node, key in enumerate(zip(self.parent, self.tag)):
            siblings[key[0]] += 1
            same_tag[key] += 1
            elem_idx[node], tag_idx[node] = siblings[key[0]], same_tag[key]
        lone = {"seg": [None] * size, "hidden": [None] * size}
        for node in range(size - 1, -1, -1):
            kind, ref = self.sole[node] or MANY
            if kind == "node":
                for refs in lone.values():
                    refs[node] = refs[ref]
            elif kind != "many":
                lone[kind][node] = ref
        return [
            range(size), self.parent, self.depth, self.tag, elem_idx, tag_idx,
            [same_tag[key] for key in zip(self.parent, self.tag)], [siblings[node] for node in range(size)],
            self.end, [a.items() if a else () for a in self.attrs],
            [a.get("id") if a else None for a in self.attrs],
            [a["class"].split() if a and "class" in a else () for a in self.attrs],
            self.t0, self.t1, lone["seg"], lone["hidden"], self._text_lengths(), self._in_pagers(),
        ]

    def _text_lengths(self):
        """Characters of each element's text, from running sums over the strings."""
        shown = list(accumulate(map(len, self.segs), initial=0))
        out = [shown[b] - shown[a] for a, b in zip(self.t0, self.t1)]
        # Script, style and template show their own hidden strings instead; such elements seldom nest.
        for node, tag in enumerate(self.tag):
            if tag in HIDDEN_TEXT_TAGS:
                out[node] = 0
        for owner, kind, text in self.hidden:
            while owner >= 0:
                if self.tag[owner] == kind:
                    out[owner] += len(text)
                owner = self.parent[owner] if kind == "template" else -1
        return out

    def _in_pagers(self):
        """Whether an element lies inside one whose class names contain 'pag': the furthest end of those seen so far."""
        out, furthest = [], -1
        for node, attrs in enumerate(self.attrs):
            out.append(node <= furthest)
            if attrs and "pag" in attrs.get("class", ""):
                furthest = max(furthest, self.end[node])
        return out


NO_NODES = [()] * len(NODE_FIELDS)


def parse_html(html, with_nodes=True):
    """(node columns, segs, hidden, warning); a document that fails gives no nodes and a warning."""
    if html is None:
        return NO_NODES, [], [], "no html"
    try:
        dom = DomBuilder()
        dom.feed(html)
        dom.finish()
    except Exception as exc:  # one bad page must not fail the job
        return NO_NODES, [], [], f"{type(exc).__name__}: {exc}"
    return dom.node_columns() if with_nodes else NO_NODES, dom.segs, dom.hidden, None


def _offsets(rows):
    return pa.array(list(accumulate(map(len, rows), initial=0)), pa.int32())


def _typed(values, data_type):
    if pa.types.is_map(data_type):
        pairs = list(chain.from_iterable(values))
        return pa.MapArray.from_arrays(_offsets(values), pa.array([k for k, _ in pairs], pa.string()),
                                       pa.array([v for _, v in pairs], pa.string()))
    if pa.types.is_list(data_type):
        return pa.ListArray.from_arrays(_offsets(values), pa.array(list(chain.from_iterable(values)), pa.string()))
    return pa.array(values, data_type)


def _struct_lists(offsets, columns, struct_type):
    fields = list(struct_type)
    arrays = [_typed(list(values), field.type) for values, field in zip(columns, fields)]
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(arrays, fields=fields))


def _dom_batch(page_ids, urls, htmls, parts=PARTS):
    parsed = [parse_html(html, "nodes" in parts) for html in htmls]
    empty = lambda name, rows: rows if name in parts else [[]] * len(rows)
    parsed = [(p[0], s, h, p[3]) for p, s, h in zip(
        parsed, empty("segs", [p[1] for p in parsed]), empty("hidden", [p[2] for p in parsed]))]
    node_columns = [chain.from_iterable(page) for page in zip(*(p[0] for p in parsed))]
    hidden = list(chain.from_iterable(p[2] for p in parsed))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(page_ids, pa.int64()),
            pa.array(urls, pa.string()),
            pa.array([len(html) if html is not None else 0 for html in htmls], pa.int32()),
            _struct_lists(_offsets([p[0][0] for p in parsed]), node_columns, NODE_TYPE),
            _typed([p[1] for p in parsed], pa.list_(pa.string())),
            _struct_lists(_offsets([p[2] for p in parsed]), list(zip(*hidden)) or [(), (), ()], HIDDEN_TYPE),
            pa.array([p[3] for p in parsed], pa.string()),
        ],
        names=["page_id", "url", "html_len", "nodes", "segs", "hidden", "warning"],
    )


def parser(parts=PARTS):
    """``mapInArrow`` function that fills the given parts of a DOM row and leaves the others empty. Output batches are
    small in rows and in html, since a page may be far larger than its row suggests."""
    def parse_batches(batches):
        for batch in batches:
            sizes = [len(html or "") for html in batch.column("html").to_pylist()]
            start = held = 0
            for row, size in enumerate(sizes):
                if row > start and (row - start == ROWS_PER_OUTPUT_BATCH or held + size > BYTES_PER_OUTPUT_BATCH):
                    yield _dom_batch(*(c.to_pylist() for c in batch.slice(start, row - start).columns), parts)
                    start, held = row, 0
                held += size
            if start < len(sizes):
                yield _dom_batch(*(c.to_pylist() for c in batch.slice(start).columns), parts)

    return parse_batches
