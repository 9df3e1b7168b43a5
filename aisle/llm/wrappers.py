"""Main text of web pages by wrappers inferred per host.

All pages of a host are read as token streams and aligned with each other into wrappers, regular
expressions without unions: tags that agree stay, neighbours of one kind fold into a repeated group,
tags of one side only become optional groups, and differing texts become slots. Pages whose text lies
in other elements get a wrapper of their own, so a host has one per template. Wrappers count the pages
of every part, which makes them addable: groups of pages are aligned first, then their wrappers.

Every page is matched against the wrapper of its template. The element that holds most of the slots'
text is the main part. Inside it, texts that never change on any page are left out, and so are optional
or repeated groups of links; names and classes only hint at menus, adverts and the like.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisle.llm.common import by_size, materialise

#: So many wrappers meet in one step of the merge.
FAN_IN = 64
RULES_SENT = 5_000
#: Elements below this depth are put next to each other, with all their text.
DEPTH = 120
#: Wrappers that share at least this part of their text's places are of one template.
ALIKE = 0.3

#: Element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head title script style noscript template iframe svg canvas object".split())
ASIDE = frozenset(
    "nav footer aside form button select option label input textarea dialog menu".split()
)
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup "
    "time tt u var wbr br img".split()
)
PROSE = frozenset("p blockquote pre figure figcaption h1 h2 h3 h4 h5 h6".split())
#: Words in class, id or role that hint at what is not main text, as a whole name or a part of one.
_WORDS = (
    r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|alert|popup|modal|nav\w*|menu|"
    r"breadcrumbs?|sidebar|widget|header|masthead|footer|comments?|replies|disqus|share|social|related|recommended|"
    r"newsletter|subscribe|login|search|pagination|pager|tags|skip)"
)
MARKS = re.compile(rf"(?:^|\s){_WORDS}(?:$|\s)", re.I)
PART_MARKS = re.compile(rf"(?:^|[\s_-]){_WORDS}(?:$|[\s_-])", re.I)

_RAW = re.compile(r"<(script|style|noscript|template|textarea|iframe|svg)\b[^>]*>", re.I)
_START = re.compile("</?[a-zA-Z]")
_PLAIN = re.compile(r"""</?[a-zA-Z][^<>"']*(?:"[^<>"]*"[^<>"']*)*>""")
_STOP = re.compile("[>\"']")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_DIGITS = re.compile("[0-9]+")


class Node:
    """An element of a page or of a wrapper; ``seen`` counts pages."""

    __slots__ = ("name", "mark", "kind", "children", "repeated", "seen")

    def __init__(self, name: str, mark: str = "", kind: str | None = None):
        self.name, self.mark = name, mark
        if kind is None:
            # further classes and numbers differ from page to page of one template
            kind = name if name in ("html", "body") else f"{name} {_DIGITS.sub('0', mark.split(' ', 1)[0])}"
        self.kind = kind
        self.children: list = []
        self.repeated, self.seen = False, 1

    @property
    def hint(self) -> int:
        """2 for a name of what is not main text, 1 for a part of a name, else 0."""
        if self.name in ("html", "body", "#page"):
            return 0
        if self.name in ASIDE or (self.mark and MARKS.search(self.mark)):
            return 2
        return int(self.name == "header" or bool(self.mark and PART_MARKS.search(self.mark)))


class Text:
    """A text of a wrapper: the hash of its value, or a slot after values differed."""

    __slots__ = ("value", "slot", "chars", "seen")
    kind = "#"

    def __init__(self, value: str, slot: bool = False, chars: int = 0, seen: int = 1):
        self.value, self.slot, self.chars, self.seen = value, slot, chars, seen


def tokens(page: str) -> Iterator[str]:
    """Texts and tags of a page in order, without comments, declarations and raw elements.

    A tag ends at the first closing sign outside of quotes; a sign that opens no such tag is text. What
    one search has learnt serves the next, so pages of tags that never end take linear time as well.
    """
    at, size, last = 0, len(page), page.rfind(">")
    searched, stop = 0, -1
    failed: set[int] = set()

    def tag_end(at: int) -> int:
        nonlocal searched, stop
        if not searched <= at <= stop:
            searched, stop = at, found.start() if (found := _STOP.search(page, at)) else size
        here, seen = stop, []
        while here < size and here not in failed:
            if page[here] == ">":
                return here + 1
            seen.append(here)
            close = page.find(page[here], here + 1)
            found = _STOP.search(page, close + 1) if close >= 0 else None
            here = found.start() if found else size
        failed.update(seen)
        return -1

    while at < size:
        begin = page.find("<", at)
        if begin != at:
            yield page[at : begin if begin > 0 else size]
            if begin < 0:
                return
            at = begin
        plain = _PLAIN.match(page, at)
        if plain and page[at + 1] not in "sntiSNTI":
            yield plain[0]
            at = plain.end()
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = size if end < 0 else end + 3
            continue
        if at < last:
            if raw := _RAW.match(page, at):
                end = re.compile(rf"</{raw[1]}\s*>", re.I).search(page, raw.end())
                at = end.end() if end else size
                continue
            if plain:
                yield plain[0]
                at = plain.end()
                continue
            if page[at + 1] in "!?":
                at = page.find(">", at) + 1
                continue
            if start := _START.match(page, at):
                end = tag_end(start.end())
                if end > 0:
                    yield page[at:end]
                    at = end
                    continue
        yield "<"
        at += 1


class _Open:
    """An open element: its node, the open block that holds it, and its name below ``DEPTH``."""

    __slots__ = ("name", "node", "block", "deep")

    def __init__(self, name: str, node: Node | None, block: int, deep: Node | None = None):
        self.name, self.node, self.block, self.deep = name, node, block, deep


def parse(page: str) -> Node:
    """The page as a tree; open elements end where their parent or a rival begins or ends.

    Elements below ``DEPTH`` become neighbours inside the last one above: each stretch of text goes to an
    element of its innermost block, or of the outermost one that is not read or hints at other things.
    """
    root = Node("#page")
    stack = [_Open("#page", root, 0)]
    opened: dict[str, int] = {}
    part: tuple[int, Node] | None = None

    def cut(depth: int) -> None:
        nonlocal part
        for gone in stack[depth:]:
            opened[gone.name] -= 1
        del stack[depth:]
        part = None

    def put(child: Node | str) -> None:
        nonlocal part
        top = stack[-1]
        if top.node is not None:
            top.node.children.append(child)
            return
        if part is None or part[0] != id(top.deep):
            part = (id(top.deep), Node(top.deep.name, top.deep.mark, top.deep.kind))
            stack[DEPTH].node.children.append(part[1])
        part[1].children.append(child)

    for token in tokens(page):
        if token[0] != "<" or token == "<":
            put(entities.unescape(token))
            continue
        name = _NAME.match(token)[1].lower()
        if token[1] == "/":
            if opened.get(name):
                depth = len(stack) - 1
                while stack[depth].name != name:
                    depth -= 1
                cut(depth)
            continue
        if name not in INLINE and name not in VOID:
            # a new block ends an open paragraph; a new item of a kind ends the last one
            rivals = {"p"} | ({name} if name in ("li", "dt", "dd", "tr", "td", "th", "option") else set())
            if stack[stack[-1].block].name in rivals:
                cut(stack[-1].block)
        marks = [(a.lower() != "class", b or c or d) for a, b, c, d in _ATTRIBUTE.findall(token)] if "=" in token else []
        kind = None if any(not other for other, _ in marks) else name
        node = Node(name, " ".join(m for _, m in sorted(marks, key=lambda m: m[0])), kind)
        closed = name in VOID or token.endswith("/>")
        if len(stack) <= DEPTH or closed:
            put(node)
        if closed:
            continue
        top = stack[-1]
        block = top.block if name in INLINE else len(stack)
        opened[name] = opened.get(name, 0) + 1
        if len(stack) <= DEPTH:
            stack.append(_Open(name, node, block))
            continue
        above = top.deep
        kept = above is not None and (above.hint == 2 or above.name in UNSEEN or name in INLINE)
        stack.append(_Open(name, None, block, above if kept else node))
        part = part if kept else None
    return root


def _fold(children: list) -> list:
    """Neighbours of one kind become one repeated group."""
    out: list = []
    for child in children:
        if out and isinstance(child, Node) and isinstance(out[-1], Node) and out[-1].kind == child.kind:
            out[-1] = _align(out[-1], child, False)
            out[-1].repeated = True
        else:
            out.append(child)
    return out


def _wrapper(node: Node) -> Node:
    made = Node(node.name, node.mark, node.kind)
    children: list = []
    for child in node.children:
        if isinstance(child, Node):
            if child.name not in UNSEEN:
                children.append(_wrapper(child))
        elif child.strip():
            text = " ".join(child.split())
            children.append(Text(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest(), False, len(text)))
    made.children = _fold(children)
    return made


def _packed(node) -> list:
    if isinstance(node, Text):
        return [node.value, node.slot, node.chars, node.seen]
    return [node.name, node.mark, node.kind, node.repeated, node.seen, [_packed(c) for c in node.children]]


def _unpacked(row: list):
    if len(row) == 4:
        return Text(*row)
    made = Node(*row[:3])
    made.repeated, made.seen = row[3], row[4]
    made.children = [_unpacked(c) for c in row[5]]
    return made


def _match(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence of kinds.

    The lengths for the ends of both lists are kept as one bit per step along ``b``, set where a kind
    more adds to the length. Only one row of bits per block of ``a`` is kept; the rows inside a block
    are made again when the way through it is read off.
    """
    first = 0
    while first < len(a) and first < len(b) and a[first] == b[first]:
        first += 1
    pairs = [(k, k) for k in range(first)]
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    tail = [(len(a) - k, len(b) - k) for k in range(last, 0, -1)]
    m, n = len(a) - last - first, len(b) - last - first
    if not m or not n:
        return pairs + tail
    places: dict[str, int] = {}
    for j in range(n):
        # bit k stands for the place k + 1 from the end
        places[b[first + j]] = places.get(b[first + j], 0) | 1 << (n - 1 - j)
    every = (1 << n) - 1

    def before(row: int, i: int) -> int:
        same = places.get(a[first + i])
        if not same:
            return row
        # the lowest place of each run takes over the step
        free = every ^ row
        hit = free & same
        return every ^ (((free + hit) | (free - hit)) & every)

    block = int(m**0.5) + 1
    kept, row = {m: 0}, 0
    for i in range(m - 1, -1, -1):
        row = before(row, i)
        if i % block == 0:
            kept[i] = row
    rows: dict[int, int] = {}
    i = j = 0
    left = kept[0].bit_count()
    while left and i < m and j < n:
        if i + 1 not in rows:
            start = i - i % block
            end = min(start + block, m)
            rows, row = {end: kept[end]}, kept[end]
            for k in range(end - 1, start - 1, -1):
                rows[k] = row = before(row, k)
        if a[first + i] == b[first + j]:
            pairs.append((first + i, first + j))
            i, j, left = i + 1, j + 1, left - 1
        elif rows[i] >> (n - 1 - j) & 1 or (rows[i + 1] & ((1 << (n - j)) - 1)).bit_count() == left:
            i += 1
        else:
            j += 1
    return pairs + tail


def _align(a: Node, b: Node, pages: bool = True) -> Node:
    """The wrapper of both: agreed parts, parts of either, slots for differing texts.

    Counts of different pages add up; those of neighbours in the same pages do not.
    """
    made = Node(a.name, a.mark, a.kind)
    made.repeated = a.repeated or b.repeated
    made.seen = a.seen + b.seen if pages else max(a.seen, b.seen)
    i = j = 0
    children: list = []
    kinds = [c.kind for c in a.children], [c.kind for c in b.children]
    for x, y in [*_match(*kinds), (len(a.children), len(b.children))]:
        children += a.children[i:x] + b.children[j:y]
        if x < len(a.children):
            one, two = a.children[x], b.children[y]
            if isinstance(one, Text):
                slot = one.slot or two.slot or one.value != two.value
                seen = one.seen + two.seen if pages else max(one.seen, two.seen)
                children.append(Text(one.value, slot, one.chars + two.chars, seen))
            else:
                children.append(_align(one, two, pages))
        i, j = x + 1, y + 1
    made.children = _fold(children)
    return made


def _places(wrapper: Node) -> dict[str, int]:
    """Characters below each path of blocks; paths through a hint begin with an exclamation mark."""
    out: dict[str, int] = {}

    def add(node: Node, path: str) -> int:
        total = 0
        for child in node.children:
            if isinstance(child, Text):
                total += child.chars
            elif child.name in INLINE or child.name in ("html", "body"):
                total += add(child, path)
            else:
                hinted = child.hint == 2 and path[:1] != "!"
                below = f"{'!' if hinted else ''}{path}/{child.kind}"
                chars = add(child, below)
                out[below] = out.get(below, 0) + chars
                total += chars
        return total

    out[""] = add(wrapper, "")
    return out


def _alike(a: dict[str, int], b: dict[str, int]) -> float:
    """How much two wrappers' texts lie in the same places, from 0 to 1; long texts count by their root.

    Places with a hint only count where there are no others.
    """
    if len(a) == 1 and len(b) == 1:
        return 1.0

    def shares(of: dict[str, int]) -> dict[str, float]:
        plain = sum(n for p, n in of.items() if p[:1] != "!" and p)
        inner = {p: n for p, n in of.items() if p[:1] != "!"} if plain > 0 else of
        whole = sum(n for p, n in inner.items() if p)
        return {p: (n / whole) ** 0.5 for p, n in inner.items() if n and p}

    one, two = shares(a), shares(b)
    least = sum(min(one[p], two[p]) for p in one.keys() & two.keys())
    most = sum(max(one.get(p, 0), two.get(p, 0)) for p in one.keys() | two.keys())
    return least / most if most else float(one == two)


def _nearest(places: dict[str, int], known: list[dict[str, int]]) -> tuple[float, int]:
    """The likeness and the place of the wrapper that is most alike, the first of equal ones."""
    alike, at = max(((_alike(places, k), -i) for i, k in enumerate(known)), default=(0.0, 0))
    return alike, -at


def merged(wrappers: list[Node]) -> list[Node]:
    """One wrapper per template."""
    kept: list[Node] = []
    places: list[dict[str, int]] = []
    for wrapper in wrappers:
        mine = _places(wrapper)
        alike, at = _nearest(mine, places)
        if alike >= ALIKE:
            kept[at] = _align(kept[at], wrapper)
            for path, chars in mine.items():
                places[at][path] = places[at].get(path, 0) + chars
        else:
            kept.append(wrapper)
            places.append(mine)
    return kept


def rule(wrapper: Node) -> dict:
    """What a wrapper decides: its kinds with the main element, groups left out and constant texts.

    A node is ``[kind, flag, children]``, 1 for the main element, 2 if it is left out and 3 if it stays
    whatever its names are; a text is 1 if it never changes.
    """
    pages = wrapper.seen

    def slots(node, hints: bool) -> float:
        if isinstance(node, Text):
            return node.chars if node.slot or node.seen < pages or pages == 1 else 0
        total = sum(slots(c, hints) for c in node.children)
        # elements for other things weigh next to nothing, names of classes a tenth
        return total / (1000 if node.name in ASIDE else 10) if hints and node.hint == 2 else total

    main = wrapper
    while main.name not in ("article", "main"):
        inner = [c for c in main.children if isinstance(c, Node) and c.name not in INLINE]
        heavy = max(inner, key=lambda c: slots(c, True), default=None)
        if heavy is None or heavy.repeated and heavy.name not in ("article", "main") or heavy.name in PROSE:
            break
        # names lower the bar
        least = 0.5 if heavy.name in ("article", "main") or heavy.mark == "main" else 0.8
        weight = sum(slots(c, True) for c in main.children)
        if not weight or slots(heavy, True) < least * weight:
            break
        # a heading or paragraph next to it belongs to the same text
        if heavy.name not in ("article", "main") and any(c.name in PROSE and slots(c, True) for c in inner):
            break
        main = heavy
    if main.name == "main":
        articles = [c for c in main.children if isinstance(c, Node) and c.name == "article"]
        if len(articles) == 1 and 2 * slots(articles[0], False) >= slots(main, False):
            main = articles[0]
    whole = sum(slots(c, False) for c in main.children)

    def constant(node) -> int:
        if isinstance(node, Text):
            return 0 if node.slot or node.seen < pages else node.chars
        return sum(map(constant, node.children))

    # pages that all tell the same have no constant texts that could be told apart
    tells = pages >= 3 and constant(main) <= 0.2 * whole

    def links(node, inside: bool = False) -> int:
        if isinstance(node, Text):
            return node.chars if inside else 0
        return sum(links(c, inside or node.name == "a") for c in node.children)

    def chars(node) -> int:
        return node.chars if isinstance(node, Text) else sum(map(chars, node.children))

    def left_out(node: Node) -> bool:
        mine = slots(node, False)
        if 2 * mine >= whole and whole:
            return False
        group = node.repeated or node.seen < pages
        linked = 10 * links(node) >= 8 * max(chars(node), 1)
        if node.hint:
            return node.hint == 2 or group or linked or not mine
        return pages > 1 and group and linked and node.name not in PROSE and node.name not in INLINE

    def write(node, inside: bool):
        if isinstance(node, Text):
            return int(tells and not node.slot and node.seen == pages)
        flag = 1 if node is main else (2 if left_out(node) else 3) if inside else 0
        return [node.kind, flag, [write(c, inside or node is main) for c in node.children]]

    return {"places": _places(wrapper), "wrapper": write(wrapper, False)}


def _matched(children: list, wrapper: list | None) -> list[tuple]:
    """Each child with its part of the wrapper or None; neighbours of one kind go to one group."""
    runs: list[list] = []
    for child in children:
        if isinstance(child, Node):
            if runs and isinstance(runs[-1][-1], Node) and runs[-1][-1].kind == child.kind:
                runs[-1].append(child)
            elif child.name not in UNSEEN:
                runs.append([child])
        elif child.strip():
            runs.append([child])
    parts = wrapper[2] if wrapper else []
    kinds = [r[0].kind if isinstance(r[0], Node) else "#" for r in runs]
    found = dict(_match(kinds, ["#" if isinstance(p, int) else p[0] for p in parts])) if parts else {}
    at = {id(c): found.get(i) for i, run in enumerate(runs) for c in run if isinstance(c, Node)}
    texts = iter([found.get(i) for i, run in enumerate(runs) if not isinstance(run[0], Node)])
    out = []
    for child in children:
        k = at.get(id(child)) if isinstance(child, Node) else next(texts) if child.strip() else None
        out.append((child, None if k is None else parts[k]))
    return out


def extract(page: str, rules: list[dict]) -> str:
    """The main text of a page: blocks in page order, joined by a line feed."""
    root = parse(page)
    wrapper = rules[0]["wrapper"] if rules else None
    if len(rules) > 1:
        wrapper = rules[_nearest(_places(_wrapper(root)), [r["places"] for r in rules])[1]]["wrapper"]

    def find(node: Node, part) -> list[tuple]:
        if part[1] == 1:
            return [(node, part)]
        pairs = [(c, p) for c, p in _matched(node.children, part) if isinstance(c, Node) and p]
        return [x for c, p in pairs for x in find(c, p)]

    mains = find(root, wrapper) if wrapper else []
    blocks: list[str] = []
    open_block: list[tuple[str, bool]] = []

    def close() -> None:
        text = " ".join("".join(t for t, _ in open_block).split())
        if text and not all(same for t, same in open_block if t.strip()):
            blocks.append(text)
        open_block.clear()

    def walk(node: Node, part) -> None:
        for child, its in _matched(node.children, part):
            if isinstance(child, str):
                open_block.append((child, its == 1))
            elif child.name == "br":
                open_block.append((" ", False))
            elif child.name in UNSEEN or (its[1] == 2 if its and its[1] else child.hint == 2):
                continue
            elif child.name in INLINE:
                walk(child, its)
            else:
                close()
                walk(child, its)
                close()

    # a page without the main element of its template is read by names alone
    for main, part in mains or [(root, None)]:
        walk(main, part)
        close()
    return "\n".join(blocks)


def host_rules(pages: DataFrame, host: str, html: str) -> DataFrame:
    """``host, rule`` of every host, from all of its distinct pages.

    Pages become small wrappers where they are. Buckets of a hash split large hosts, and each step
    merges ``FAN_IN`` neighbouring buckets, so that no task aligns all pages of a host.
    """
    rows = pages.select(F.col(host).alias("host"), F.col(html).alias("html")).where("html is not null")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [json.dumps([_packed(_wrapper(parse(x.as_py())))]) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(made, pa.string())], ["host", "hash", "found"]
            )

    hashed = rows.select("host", F.xxhash64("html").alias("hash"), "html")
    found = hashed.mapInArrow(read, "host string, hash long, found string").dropDuplicates(["host", "hash"])
    found = materialise(found, "wrappers")
    most = found.groupBy("host").count().agg(F.max("count")).first()[0] or 0

    def merge(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for lists in batch.column(2):
                    kept = merged([_unpacked(w) for x in lists for w in json.loads(x.as_py())])
                    out.append(json.dumps([rule(w) for w in kept] if last else [_packed(w) for w in kept]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(out, pa.string())], ["host", "hash", "found"]
                )

        return run

    buckets = 1
    while buckets * FAN_IN < most:
        buckets *= FAN_IN
    while True:
        grouped = found.groupBy("host", F.pmod("hash", F.lit(buckets)).alias("hash")).agg(
            F.sort_array(F.collect_list("found")).alias("found")
        )
        found = grouped.mapInArrow(merge(buckets == 1), "host string, hash long, found string")
        if buckets == 1:
            return found.select("host", F.col("found").alias("rule"))
        buckets //= FAN_IN


def main_texts(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    Null, empty and blank pages give an empty text; pages without a url share a wrapper; a page that
    lacks the main element of its wrapper is read by names alone. Repeated rows give repeated
    rows, an empty table an empty result. Other columns are not read.
    """
    rows = pages.select(
        F.col(page_id).alias("page_id"),
        F.col(url).alias("url"),
        F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit("")).alias("host"),
        F.col(html).alias("html"),
    )
    rules = materialise(host_rules(rows, "host", "html"), "rules")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        for batch in batches:
            texts = []
            for page, rule in zip(batch.column(2), batch.column(3)):
                page, rule = page.as_py(), rule.as_py()
                if rule not in known:
                    known[rule] = json.loads(rule) if rule else []
                texts.append(extract(page, known[rule]) if page else "")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"]
            )

    joined = rows.join(by_size(rules, RULES_SENT), "host", "left").select("page_id", "url", "html", "rule")
    kind = dict(rows.dtypes)["page_id"]
    found = joined.mapInArrow(read, f"page_id {kind}, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
