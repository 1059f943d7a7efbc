"""Main text of pages by wrappers, union-free regular expressions inferred for each host.

A page is read into a tree of labelled elements. Pages of a host are aligned one
after another: where labels agree, elements are merged; runs of one label, or of
a few in turn, become a repeated group; what only one side has becomes an
optional group; text that differs becomes a slot, text that never does stays
constant. The result says of every place how much text it has held. The place
that holds the article is chosen on the wrapper and then read out of each page:
the one that tags or names mark as the article, or else the lowest that holds
every slot, so that what varies between pages is never lost and what all pages
of a host repeat around it is.

Elements may be nested to any depth: trees are walked with stacks, and a place is
named by the digest of its path. Wrappers are merged within a map batch first,
then in salted groups, then for each host, so a host of any size sends small
templates only.
"""

from __future__ import annotations

import html as entities
import json
import re
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import landed

SALTS = 64
BROADCAST_BYTES = 64 << 20  # choices of all hosts beyond this are joined by a shuffle
CONSTANT_PAGES = 5  # a host with fewer pages does not show which text is constant
SHOWN = 64  # longer texts stand in a wrapper as a digest of all they hold

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|textarea|select|head)\b.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>"
    r"|<[!?/][^>]*+>"
    r"|[^<]++|<",
    re.S | re.I,
)
_CLOSED = re.compile(r"""(?:^|[\s"'])/$""")  # not the end of a value without quotes
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong"
    " sub sup time tt u var wbr br img label ruby rt rp".split()
)
_OUT = frozenset(
    "nav header footer aside form button dialog menu object audio video canvas input fieldset script style".split()
)
_ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hr main menu nav ol p pre section table ul".split()
)
#: an opening tag ends an open element of these kinds
_ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"),
}
#: elements that the search for the place of the article goes down into
_CONTAINERS = frozenset("#page html body div section main article center table tbody tr td".split())
_SCOPE = frozenset("div article section main body ul ol dl table blockquote td th aside nav header footer form".split())

_NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|side-?bar|comments?|replies|disqus|cookie\w*|consent|notice|alert"
    r"|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|share|sharing|social|related|recommend\w*|popup|modal|newsletter"
    r"|subscri\w*|login|signup|toolbar|pagination|pager|skip|complementary|contentinfo|search|widget)(?:$|[\s_-])",
    re.I,
)
_CONTENT = re.compile(
    r"(?:^|[\s_-])(?:article|content|post|entry|story|main|text|body-?text|articlebody)(?:$|[\s_-])", re.I
)


class Element:
    __slots__ = ("tag", "marks", "label", "items")

    def __init__(self, tag, marks=""):
        self.tag, self.marks, self.items = tag, marks, []  # items: elements and texts
        self.label = tag + ("." + re.sub(r"\d+", "0", marks) if marks else "")


def _marks(attributes: str) -> str:
    found = [m[2].strip("\"'") for m in _ATTRIBUTE.finditer(attributes)]
    return " ".join(" ".join(found).split()).lower()


def parse(page: str) -> Element:
    root = Element("#page")
    stack = [root]
    depth: dict[str, int] = {}  # how many elements of a kind are open

    def close(tags, scope):
        if not any(depth.get(tag) for tag in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                for element in stack[i:]:
                    depth[element.tag] -= 1
                del stack[i:]
                return
            if stack[i].tag in scope:
                return

    for m in _TOKEN.finditer(page):
        tag = m[3]
        if tag is None:
            text = m[0]
            if text[0] != "<" or len(text) == 1:
                stack[-1].items.append(entities.unescape(text))
            continue
        tag = tag.lower()
        if m[2]:
            close((tag,), ())
            continue
        if tag in _ENDS_P:
            close(("p",), _SCOPE)
        if tag in _ENDS:
            close(_ENDS[tag], ("ul", "ol", "dl", "table", "select"))
        element = Element(tag, _marks(m[4]))
        stack[-1].items.append(element)
        if tag not in _VOID and not _CLOSED.search(m[4]):
            stack.append(element)
            depth[tag] = depth.get(tag, 0) + 1
    return root


def _is_out(element: Element) -> bool:
    if element.tag in ("body", "html", "article", "main"):
        return False
    return element.tag in _OUT or bool(element.marks and _NOISE.search(element.marks))


# A template is [label, is out, pages, repeated, optional, text characters, constant text or None, children].
LABEL, OUT, PAGES, REPEATED, OPTIONAL, CHARS, TEXT, CHILDREN = range(8)


def _digest(text: str) -> str:
    return blake2b(text.encode("utf-8", "replace"), digest_size=12).hexdigest()


def _constant(text: str) -> str:
    """What stands for a text in a wrapper; equal for equal texts only."""
    return text if len(text) <= SHOWN else f"{len(text)}:{_digest(text)}"


def _below(path: str, label: str) -> str:
    """The name of the place that a label has below another place."""
    return _digest(f"{path}/{label}")


def _done(task):
    """The result of a generator that yields generators for their results, to any depth."""
    tasks, value = [task], None
    while tasks:
        try:
            tasks.append(tasks[-1].send(value))
            value = None
        except StopIteration as end:
            tasks.pop()
            value = end.value
    return value


def _template(root: Element) -> list:
    def node(element, out):
        return [element.label, out or _is_out(element), 1, False, False, 0, None, []]

    whole = node(root, False)
    waiting, order = [(root, whole)], []
    while waiting:
        element, made = waiting.pop()
        order.append(made)
        for item in element.items:
            if not isinstance(item, str):
                made[CHILDREN].append(node(item, made[OUT]))
                waiting.append((item, made[CHILDREN][-1]))
            elif text := " ".join(item.split()):
                made[CHILDREN].append(["#", made[OUT], 1, False, False, len(text), _constant(text), []])
    for made in reversed(order):  # children before their parents
        made[CHILDREN] = _done(_folded(made[CHILDREN]))
    return whole


def _folded(children: list):
    """Runs of one label, or of two or three in turn, as one repeated group."""
    for period in (1, 2, 3):
        done, i = [], 0
        while i < len(children):
            group = children[i : i + period]
            names = [c[LABEL] for c in group]
            j = i + period
            while len(group) == period and [c[LABEL] for c in children[j : j + period]] == names:
                for k in range(period):
                    group[k] = yield _aligned(group[k], children[j + k], one_page=True)
                    group[k][REPEATED] = True
                j += period
            if j > i + period:
                done += group
                i = j
            else:
                done.append(children[i])
                i += 1
        children = done
    return children


def _aligned(a: list, b: list, one_page: bool = False):
    """One template for both; the labels are equal.

    Of a group that one page repeats, the constant text is that of all its members.
    """
    if one_page and a[TEXT] is not None and b[TEXT] is not None:
        text = _constant(a[TEXT] + "\n" + b[TEXT])
    else:
        text = a[TEXT] if a[TEXT] == b[TEXT] else None
    pages = max(a[PAGES], b[PAGES]) if one_page else a[PAGES] + b[PAGES]
    out = [a[LABEL], a[OUT] or b[OUT], pages, a[REPEATED] or b[REPEATED], a[OPTIONAL] or b[OPTIONAL],
           a[CHARS] + b[CHARS], text, []]
    xs, ys, i, j = a[CHILDREN], b[CHILDREN], 0, 0
    children = []

    def skip(items):
        for item in items:
            children.append([*item[:OPTIONAL], True, *item[CHARS:]])

    while i < len(xs) and j < len(ys):
        if xs[i][LABEL] == ys[j][LABEL]:
            both = yield _aligned(xs[i], ys[j], one_page)
            children.append(both)
            i, j = i + 1, j + 1
            continue
        to_x = next((k for k in range(i, len(xs)) if xs[k][LABEL] == ys[j][LABEL]), None)
        to_y = next((k for k in range(j, len(ys)) if ys[k][LABEL] == xs[i][LABEL]), None)
        if to_x is not None and (to_y is None or to_x - i <= to_y - j):
            skip(xs[i:to_x])
            i = to_x
        elif to_y is not None:
            skip(ys[j:to_y])
            j = to_y
        else:
            skip([xs[i], ys[j]])
            i, j = i + 1, j + 1
    skip(xs[i:])
    skip(ys[j:])
    out[CHILDREN] = yield _folded(children)
    return out


def _merged(a: list, b: list) -> list:
    return _done(_aligned(a, b))


def _in_order(template: list):
    """Every node, parents before children, children in order."""
    waiting = [template]
    while waiting:
        node = waiting.pop()
        yield node
        waiting += reversed(node[CHILDREN])


def to_json(template: list) -> str:
    """The nodes in order, each with the number of its children."""
    return json.dumps([[*node[:CHILDREN], len(node[CHILDREN])] for node in _in_order(template)])


def from_json(text: str) -> list:
    root = [None] * CHILDREN + [[]]
    open_ = [(root, 1)]
    for *node, children in json.loads(text):
        while not open_[-1][1]:
            open_.pop()
        parent, left = open_.pop()
        open_.append((parent, left - 1))
        node.append([])
        parent[CHILDREN].append(node)
        open_.append((node, children))
    return root[CHILDREN][0]


def regular_expression(template: list) -> str:
    """The wrapper as a readable union-free expression; '#' is a text slot."""

    def shown(node):
        if node[LABEL] == "#":
            body = "#" if node[TEXT] is None else "'" + node[TEXT] + "'"
        else:
            parts = []
            for child in node[CHILDREN]:
                parts.append((yield shown(child)))
            body = f"<{node[LABEL]}>{''.join(parts)}</>"
        sign = ("+" if node[REPEATED] else "") + ("?" if node[OPTIONAL] else "")
        return f"({body}){sign}" if sign else body

    return _done(shown(template))


def choose(template: list) -> dict:
    """Where a wrapper has the article.

    {"main": its place, "through": the places above it, "constant": places of links that are the same on all pages}
    """
    many = template[PAGES] >= CONSTANT_PAGES
    label, above, below = {}, {}, {}  # of a place
    chars: dict[str, int] = {}  # characters of content below a place, those of links by a quarter
    slots: dict[str, int] = {}  # characters outside links that differ between pages
    plain: dict[str, int] = {}  # characters outside links
    links, varying = set(), set()
    top = _below("", template[LABEL])
    order = []  # (place, own characters, of slots, outside links)
    waiting = [(template, "", False)]
    nodes = []
    while waiting:
        node, path, linked = waiting.pop()
        if node[OUT]:
            continue
        if node[LABEL] == "#":
            fixed = many and node[TEXT] is not None and node[PAGES] == template[PAGES]
            if linked:
                (links if fixed else varying).add(path)
            else:
                plain[path] = plain.get(path, 0) + node[CHARS]
                slots[path] = slots.get(path, 0) + (0 if fixed else node[CHARS])
            order.append((path, node[CHARS] // 4 if linked else node[CHARS]))
            continue
        place = _below(path, node[LABEL])
        if place not in label:
            label[place], above[place] = node[LABEL], path
            below.setdefault(path, []).append(place)
            nodes.append(place)
        linked = linked or node[LABEL].split(".")[0] == "a"
        for child in node[CHILDREN]:
            waiting.append((child, place, linked))
    for path, count in order:
        chars[path] = chars.get(path, 0) + count
    for place in reversed(nodes):  # a place is first met after the one above it
        for counts in (chars, slots, plain):
            counts[above[place]] = counts.get(above[place], 0) + counts.get(place, 0)

    best, main = None, None
    for place in nodes:
        tag, _, marks = label[place].partition(".")
        rank = 3 if tag == "article" else 2 if tag == "main" or "main" in marks.split() else 1 if _CONTENT.search(marks) else 0
        held = chars.get(place, 0)
        if rank and held and held * 3 >= chars.get(top, 0) and (best is None or (rank, held) > best):
            best, main = (rank, held), place
    menus = []
    if main is None:
        if slots.get(top):
            menus = sorted(links - varying)
        counts = next((c for c in (slots, plain, chars) if c.get(top)), chars)
        main = top
        while True:
            down = [p for p in below.get(main, ()) if counts.get(p, 0) == counts.get(main, 0)]
            if not counts.get(main) or not down or label[down[0]].split(".")[0] not in _CONTAINERS:
                break
            main = down[0]
    through, place = [], main
    while place:
        place = above.get(place, "")
        if place:
            through.append(place)
    return {"main": main, "through": through, "constant": menus}


def extract(page: str | None, choice: dict | None = None) -> str:
    """The main text of a page, with a host's choice or else its own."""
    if not page:
        return ""
    root = parse(page)
    for own in (choice, None):
        if own is None:
            own = choose(_template(root))
        blocks = _blocks(root, own)
        if blocks:
            return "\n".join(blocks)
    return ""


def _blocks(root: Element, choice: dict) -> list[str]:
    main, through, constant = choice["main"], set(choice["through"]), set(choice["constant"])
    blocks, line = [], []
    own = False  # whether the line holds more than links of a menu

    def flush():
        nonlocal own
        text = " ".join("".join(line).split())
        line.clear()
        if text and own:
            blocks.append(text)
        own = False

    end = object()
    waiting = [(root, "", False)]  # (element, text or end of a block; the place it is in; whether that is in the article)
    while waiting:
        item, path, inside = waiting.pop()
        if item is end:
            flush()
        elif isinstance(item, str):
            if inside:
                line.append(item)
                own = own or bool(path not in constant and item.strip())
        elif not _is_out(item):
            place = path if inside and not constant else _below(path, item.label)
            if not (inside or place == main or place in through):
                continue
            inside = inside or place == main
            if item.tag == "br" and inside:
                line.append(" ")
            if item.tag not in _INLINE:
                flush()
                waiting.append((end, "", False))
            waiting += [(below, place, inside) for below in reversed(item.items)]
    flush()
    return blocks


def host_of(url):
    """Host name of a url column; what has none shares the empty host."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def _infer(batches):
    for batch in batches:
        wrappers: dict[str, list] = {}
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            for host, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if page:
                    new = _template(parse(page))
                    wrappers[host] = _merged(wrappers[host], new) if host in wrappers else new
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(wrappers), pa.string()), pa.array([to_json(w) for w in wrappers.values()], pa.string())],
            names=["host", "wrapper"],
        )


def _joined(table: pa.Table) -> pa.Table:
    host = table.column("host")[0].as_py()
    whole = None
    for text in sorted(table.column("wrapper").to_pylist()):
        one = from_json(text)
        whole = one if whole is None else _merged(whole, one)
    return pa.table({"host": [host], "wrapper": [to_json(whole)]})


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper): a template in JSON for every host."""
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    kind = "host string, wrapper string"
    parts = rows.mapInArrow(_infer, kind)
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    few = salted.groupBy("host", "salt").applyInArrow(_joined, kind)
    return few.groupBy("host").applyInArrow(_joined, kind)


def main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(id, url, text) for every row of ``pages``.

    Blocks in page order joined by a line feed, white space within one turned
    into single spaces, character references decoded. Null and empty pages give
    an empty text; a page without the place that its host's wrapper names is
    read by a wrapper of its own; null urls and urls without a host share one.
    Elements are nested to any depth. Without an article that tags or names mark,
    blocks of nothing but links that all pages of a host (five or more) share at
    one place are a menu.
    Rows may repeat and ids may be null; other columns are ignored; an empty
    table gives an empty result.
    """
    wrappers = infer_wrappers(pages, url_col, html_col)

    def decide(batches):
        for batch in batches:
            choices = [json.dumps(choose(from_json(w))) for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(choices, pa.string())], names=["host", "choice"])

    choices = landed(wrappers.mapInArrow(decide, "host string, choice string"))
    size = choices.agg(F.sum(F.octet_length("host") + F.octet_length("choice") + 64)).first()[0] or 0
    few = size <= BROADCAST_BYTES
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host")
    )
    rows = rows.join(F.broadcast(choices) if few else choices, "host", "left").select("id", "url", "html", "choice")

    def read(batches):
        for batch in batches:
            texts = [
                extract(page, json.loads(choice) if choice else None)
                for i in range(0, batch.num_rows, 64)
                for page, choice in zip(*(batch.slice(i, 64).column(c).to_pylist() for c in (2, 3)))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"]
            )

    schema = rows.select("id", "url", F.lit("").alias("text")).schema
    return rows.mapInArrow(read, schema).toDF(id_col, url_col, "text")
