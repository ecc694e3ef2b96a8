"""Main text of web pages by union-free regular-expression inference.

Pages of one host are token streams from one template. A wrapper starts as the stream of one page and is aligned
with further pages of the host, level by level: equal neighbours fold into a repeated group, tokens that
one side lacks become optional groups, and texts that differ become slots; a text that stays equal on
all pages is part of the template. The wrapper's article is the element that holds most slot text outside
navigation, notices and the like. Each page is then read by its host's wrapper.

All pages of a host make its wrapper: each input partition aligns its own distinct pages of a host, and these templates are
aligned with each other (copies in other partitions weigh again). The wrapper is applied to every page.

Defined results: null or empty html gives the empty text; a page whose url has no host shares the wrapper of all such
pages; a page that its wrapper does not fit is read by a wrapper of its own; rows with null or repeated ids
are read one by one; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.scratch import Scratch

HOSTS = 1000  # held by a task before it gives out what it has
DEPTH = 150
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select)\b.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_SELF = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}
_AROUND = set("nav header footer aside form head title button label fieldset dialog menu".split())
_ASIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu|breadcrumbs?|sidebar|side|aside|footer|header|masthead|topbar"
    r"|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|share|sharing|social|related|recommend\w*"
    r"|comments?|commentlist|replies|reply|respond|disqus|discussion|login|search|form|pagination|pager|widget|toolbar|skip)(?:$|[\s_-])",
    re.I,
)
_SPACE = re.compile(r"\s+")


class Node:
    """An element: its key (tag, class, id), children (nodes and texts) and whether it stands beside the article."""

    __slots__ = ("aside", "key", "kids", "many", "tag")

    def __init__(self, tag: str, key: str, aside: bool) -> None:
        self.tag, self.key, self.aside = tag, key, aside
        self.kids: list = []
        self.many = False


def parse(page: str) -> Node:
    """A lenient tree: block elements close an open paragraph, items close items, stray end tags are ignored."""
    root = Node("", "", False)
    stack = [root]
    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            stack[-1].kids.append(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag not in _BLOCK and stack[k].tag in _BLOCK:
                    break
            continue
        if tag in _BLOCK:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in _BLOCK:
                    break
        if tag in _SELF:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in _SELF[tag]:
                    break
        attrs = m[4]
        names = " ".join(v for x in _NAMED.finditer(attrs) for v in (x[2] or x[3] or x[4],) if v) if attrs and "=" in attrs else ""
        key = f"{tag}.{re.sub(r'[0-9]+', '#', names)}" if names else tag
        aside = tag in _AROUND or bool(names and _ASIDE.search(names)) or bool(attrs and _HIDDEN.search(attrs))
        node = Node(tag, key, aside and tag not in ("html", "body", "article", "main"))
        stack[-1].kids.append(node)
        if tag not in _VOID and not attrs.endswith("/") and len(stack) < DEPTH:
            stack.append(node)
    if at < len(page):
        stack[-1].kids.append(page[at:])
    return root


def clean(text: str) -> str:
    return _SPACE.sub(" ", entities.unescape(text)).strip()


# Wrappers: a template is {"k": key, "t": tag, "a": aside, "m": repeated, "o": optional, "c": children};
# a text is {"s": constant text, or None for a slot, "n": characters seen, "o": optional}.


def template(node: Node) -> dict:
    """The wrapper of one page."""
    kids = [template(x) if isinstance(x, Node) else {"s": x, "n": len(x), "o": False} for x in ((y if isinstance(y, Node) else clean(y)) for y in node.kids) if x]
    return {"k": node.key, "t": node.tag, "a": node.aside, "m": False, "o": False, "c": fold(kids)}


def fold(kids: list[dict]) -> list[dict]:
    """Neighbours with equal keys become one repeated group."""
    out: list[dict] = []
    for kid in kids:
        if out and _name(out[-1]) == _name(kid) and "k" in kid:
            out[-1] = align(out[-1], kid)
            out[-1]["m"] = True
        else:
            out.append(kid)
    return out


def _name(x: dict) -> str:
    return x["k"] if "k" in x else "#text"


def align(a: dict, b: dict) -> dict:
    """The least union-free template of both."""
    if "s" in a:
        return {"s": a["s"] if a["s"] == b["s"] else None, "n": a["n"] + b["n"], "o": a["o"] or b["o"]}
    left, right = a["c"], b["c"]
    kids: list[dict] = []
    mine, its = [_name(x) for x in left], [_name(x) for x in right]
    if mine == its:
        return a | {"m": a["m"] or b["m"], "o": a["o"] or b["o"], "c": fold([align(x, y) for x, y in zip(left, right, strict=True)])}
    names = SequenceMatcher(None, mine, its, autojunk=False)
    for op, i, j, k, m in names.get_opcodes():
        if op == "equal":
            kids += [align(x, y) for x, y in zip(left[i:j], right[k:m], strict=True)]
        else:
            kids += [x | {"o": True} for x in (*left[i:j], *right[k:m])]
    return a | {"m": a["m"] or b["m"], "o": a["o"] or b["o"], "c": fold(kids)}


def expression(t: dict) -> str:
    """The wrapper as a regular expression over tokens."""
    if "s" in t:
        body = "#TEXT" if t["s"] is None else t["s"]
    else:
        body = f"<{t['k']}>{''.join(map(expression, t['c']))}</{t['t']}>" if t["k"] else "".join(map(expression, t["c"]))
    return f"({body}){'+' if t.get('m') else ''}{'?' if t['o'] else ''}" if t.get("m") or t["o"] else body


def infer(pages: list[str]) -> dict:
    """The wrapper of some pages."""
    pages = list(dict.fromkeys(pages))
    whole = template(parse(pages[0]))
    for page in pages[1:]:
        whole = align(whole, template(parse(page)))
    return wrapper_of(whole, len(pages))


def wrapper_of(whole: dict, count: int) -> dict:
    """{"path": keys down to the article, "fixed": template texts within it} of the template of `count` distinct pages."""

    def mass(t: dict) -> int:
        if "s" in t:
            return t["n"] if t["s"] is None or count < 3 else 0
        return 0 if t["a"] else sum(map(mass, t["c"]))

    def named(t: dict, path: list[str]) -> list[tuple[int, list[str]]]:
        out = []
        for c in t["c"]:
            if "k" in c and not c["a"]:
                here = [*path, c["k"]]
                if c["t"] in ("article", "main"):
                    out.append((mass(c), here))
                out += named(c, here)
        return out

    best = max(named(whole, []), default=(0, []), key=lambda x: (x[0], len(x[1])))
    node, path = whole, []
    if best[0] > 0.2 * mass(whole):
        path = best[1]
        for key in path:
            node = next(c for c in node["c"] if c.get("k") == key and not c["a"])
    while True:  # further down as long as one block holds nearly all
        top = max(((mass(c), c) for c in node["c"] if "k" in c and c["t"] in _BLOCK and not c["m"]), default=(0, None), key=lambda x: x[0])
        if top[1] is None or top[0] < 0.9 * mass(node) or top[1]["t"] in ("p", "pre", "h1") or path and node["t"] in ("article", "main"):
            break
        node = top[1]
        path = [*path, node["k"]]

    def fixed(t: dict) -> list[str]:
        if "s" in t:
            return [t["s"]] if t["s"] is not None and not t["o"] else []
        return [x for c in t["c"] if not t.get("m") for x in fixed(c)]

    return {"path": path, "fixed": sorted(set(fixed(node))) if count >= 3 else []}


def _find(node: Node, path: list[str]) -> list[Node]:
    found = [node]
    for key in path:
        found = [c for n in found for c in n.kids if isinstance(c, Node) and c.key == key and not c.aside]
    return found


def _blocks(node: Node, out: list[list[str]]) -> None:
    for c in node.kids:
        if isinstance(c, str):
            out[-1].append(c)
        elif c.tag in ("br", "wbr"):
            out[-1].append(" ")
        elif not c.aside:
            block = c.tag in _BLOCK
            if block:
                out.append([])
            _blocks(c, out)
            if block:
                out.append([])


def read(page: str | None, wrapper: dict | None) -> str:
    """The article of a page."""
    if not page:
        return ""
    root = parse(page)
    found = _find(root, wrapper["path"]) if wrapper else []
    if not found:
        wrapper = infer([page])
        found = _find(root, wrapper["path"])
    out: list[list[str]] = []
    for node in found:
        out.append([])
        _blocks(node, out)
    texts = [t for t in (clean("".join(b)) for b in out) if t]
    fixed = set(wrapper["fixed"])
    return "\n".join([t for t in texts if t not in fixed] or texts)


def _templates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, html, mark) of a partition to a template for each host, with the marks of up to three distinct pages."""
    held: dict[str, tuple[dict, set[int], int]] = {}

    def out() -> pa.RecordBatch:
        body = [zlib.compress(json.dumps(t).encode(), 1) for t, _, _ in held.values()]
        marks = [sorted(seen)[:3] for _, seen, _ in held.values()]
        first = [mark for _, _, mark in held.values()]
        batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(first, pa.int64()), pa.array(marks, pa.list_(pa.int64())), pa.array(body, pa.binary())], ["host", "first", "marks", "template"])
        held.clear()
        return batch

    for batch in batches:
        for i in range(batch.num_rows):
            host, mark = batch.column(0)[i].as_py(), batch.column(2)[i].as_py()
            own = held.get(host)
            if own is not None and mark in own[1]:
                continue
            page = template(parse(batch.column(1)[i].as_py()))
            if own is None:
                if len(held) >= HOSTS:
                    yield out()
                held[host] = page, {mark}, mark
            else:
                own[1].add(mark)
                held[host] = align(own[0], page), own[1], own[2]
    if held:
        yield out()


def _wrappers(rows: pd.DataFrame) -> pd.DataFrame:
    whole = None
    for body in rows.sort_values(["first", "template"])["template"]:
        part = json.loads(zlib.decompress(body))
        whole = part if whole is None else align(whole, part)
    count = len({m for marks in rows["marks"] for m in marks})  # up to three of each are enough: three make a template
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [json.dumps(wrapper_of(whole, count))]})


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    loaded: dict[str, dict] = {}
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            texts = []
            for page, w in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                if w is not None and w not in loaded:
                    if len(loaded) > 1000:
                        loaded.clear()
                    loaded[w] = json.loads(w)
                texts.append(read(page, loaded.get(w)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def host_of(url: F.Column) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def wrappers(pages: DataFrame) -> DataFrame:
    """host and wrapper (JSON) of every host. pages: page_id, url, html, host."""
    rows = pages.where(F.octet_length("html") > 0).select("host", "html", F.xxhash64("html").alias("mark"))
    parts = rows.mapInArrow(_templates, "host string, first long, marks array<long>, template binary")
    return parts.groupBy("host").applyInPandas(_wrappers, "host string, wrapper string")


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    own = Scratch(spark, "htmltext").put(wrappers(pages), "wrappers")
    joined = pages.join(own, "host", "left").select("page_id", "url", "html", "wrapper")
    return joined.mapInArrow(_read, "page_id long, url string, text string, n_chars long")
