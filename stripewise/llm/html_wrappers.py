"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

Every page becomes a stream of block tags and texts in which adjacent repeats are folded into groups. The distinct streams of a
host are aligned one after another with its wrapper so far: what both have is kept, a stretch that only one has becomes optional,
a stretch that repeats its neighbour becomes a repeated group, and texts that differ become slots. Texts are compared by
counting: a text that at least `share` of a host's distinct pages (and `least` of them) have in the same place is a string of the
template, every other text is a slot. Pages are pre-aggregated to distinct ones, and a host's streams are folded some at a
time, then what came of them, so that no host is gathered page by page.

The article is the container whose slots hold the text. An element that says that it is an article is believed if a quarter of
the slots' text is in it, one with a class or id of content if half of it is; else it is the innermost element with seven tenths
of it, of those that the wrapper always has before optional ones. Links count as nothing. Elements for menus, footers, sidebars,
forms, scripts and the like are left out. Names of classes and ids are a prior only: an element named like a notice, advert or
comment is left out unless nearly all of the host's text is in it. Where no element says that it is the article, strings of
the template are left out of it, but for headings, and for pages that hold little else.

What a page has under its host's container is its text; if that is nothing, what it has in an article element, then all but
elements named as boilerplate, then all.

Defined results: a null or empty page has the empty text; pages without a host share one wrapper; broken markup is read as
far as it goes; below 512 open elements further ones are read as text of the last; copies of a page count once; repeated rows are
rows of their own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from stripewise.llm.common import checkpointed, discard, stored

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^\"'>]|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|[^<]++|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NAMES = re.compile(r"[^a-z]+")
_NUMBERS = re.compile(r"[-_]\d+|\d{2,}")
_UNSAFE = re.compile(r"[\s<>()?+#=]")
_TAGS = re.compile(r"<[^<>]+>")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
DROPPED = frozenset("script style xmp iframe noembed noframes noscript template svg math object embed canvas audio video head title select button form input textarea nav footer aside dialog menu".split())
CLOSES = {"li": frozenset(("ul", "ol", "menu")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "tr": frozenset(("table",)), "td": frozenset(("tr", "table")), "th": frozenset(("tr", "table")), "option": frozenset(("select",))}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adsbygoogle sponsor sponsored sponsors promo promos promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs "
    "sidebar sidebars aside widget widgets footer foot masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup "
    "signin login search share sharing social comment comments commentlist disqus reply replies respond discussion related recommended recommendations teaser teasers pagination pager toolbar copyright legal disclaimer skiplink "
    "paywall donate feedback rating ratings".split()
)
HEADER = frozenset(("header", "head"))
MODIFIERS = frozenset("has have with without no is js".split())
_HEADING = re.compile("h[1-6]")
CONTENT = frozenset("content article articlebody post entry story main maintext text bodytext".split())
PARAGRAPH = frozenset("p blockquote pre li td h1 h2 h3 h4 h5 h6 dd dt figcaption".split())

#: Hosts' regions are broadcast up to this size; beyond it pages meet them in so many salted parts of each host.
BROADCAST_BYTES = 16 << 20
SALTS = 32

#: Elements that may be open at once.
DEPTH = 512
#: Shares of the slots' text: what an article element, one named as content and any other must hold to be the container, and
#: what is too little outside of elements named as boilerplate.
EXPLICIT, NAMED, ANY, LITTLE = 0.25, 0.5, 0.7, 0.1

SCAN_SCHEMA = "host string, digest long, stream string, paths array<long>, parents array<int>, depths array<int>, ranks array<int>, softs array<boolean>, holds array<boolean>, elements array<int>, texts array<long>, masses array<int>, soft_masses array<int>"
STREAM_SCHEMA = "host string, stream string, copies long, path long, depth int, rank int, soft boolean, holds boolean, mass long, soft_mass long"


def host_of(column: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(column), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


@lru_cache(20_000)
def _described(name: str, attributes: str) -> tuple[str, bool, bool, bool, int]:
    """Signature, whether it is left out, whether it is named as boilerplate, whether it is a header, and its rank as content."""
    found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if attributes.strip(" /\t\r\n") else {}
    tokens = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
    # a class like has-sidebar tells what the element's page has, not what the element is
    names = [_NAMES.split(x) for x in tokens]
    own = frozenset(w for x in names if x[0] not in MODIFIERS for w in x if w)
    role = found.get("role", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    whole = name in ("html", "body")
    explicit = name in ("article", "main") or role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody"
    out = name in DROPPED or hidden or role in ROLES
    header = name == "header" or (not whole and name not in ("article", "main") and bool(own & HEADER))
    rank = 0 if out else 3 if explicit else 2 if own & CONTENT and not whole else 0
    # numbers that count pages or posts don't tell elements apart; one digit after a letter does
    signs = frozenset(t for x in tokens if (t := _NUMBERS.sub("", x)))
    return name + "".join(sorted(f".{_UNSAFE.sub('_', t)}" for t in signs)), out, not whole and bool(own & BOILERPLATE), header, rank


def path_of(parent: int, sign: str) -> int:
    """A number for an element below another; 0 is the page."""
    return int.from_bytes(blake2b(sign.encode("utf-8", "surrogatepass"), digest_size=8, key=parent.to_bytes(8, "little", signed=True)).digest(), "little", signed=True)


_path_of = lru_cache(50_000)(path_of)


class Element:
    """An open element, with all that its ancestors say about it."""

    __slots__ = ("name", "sign", "inline", "path", "block", "depth", "out", "softs", "soft", "header", "own_rank", "rank", "link", "heading", "paragraph")

    def __init__(self, name: str, attributes: str, parent: Element | None, place: int):
        self.name = name
        self.sign, out, self.soft, header, rank = _described(name, attributes)
        self.inline = name in INLINE
        below = parent.path if parent is not None else 0
        self.path = below if self.inline else _path_of(below, self.sign)
        #: the innermost block
        self.block = self if not self.inline else parent.block if parent is not None else None
        self.depth = (parent.depth if parent is not None else 0) + (not self.inline)
        self.out = out or (parent is not None and parent.out)
        softs = parent.softs if parent is not None else ()
        self.softs = (*softs, self.path if not self.inline else 0) if self.soft else softs
        #: inside a header only headings count, and only below an article
        self.header = header or (parent is not None and parent.header)
        self.own_rank = 0 if self.out else rank
        self.rank = max(self.own_rank, parent.rank if parent is not None else 0)
        self.link = name == "a" or (parent is not None and parent.link)
        self.heading = bool(_HEADING.fullmatch(name)) or (parent is not None and parent.heading)
        #: place of the open paragraph that a block would end, or -1
        self.paragraph = place if name == "p" else parent.paragraph if self.inline and parent is not None else -1

    def counts(self) -> bool:
        return not self.out and (not self.header or (self.rank == 3 and self.heading))


def walk(page: str) -> Iterator[tuple[str, Element | None, list[Element], str]]:
    """("open" | "close" | "text" | "break", the innermost element, all open ones, tag signature or decoded text) in page order."""
    stack: list[Element] = []
    names: Counter[str] = Counter()
    ignored: Counter[str] = Counter()
    at, end = 0, len(page)

    def cut(depth: int) -> None:
        for element in stack[depth:]:
            names[element.name] -= 1
        del stack[depth:]

    while at < end:
        token = _TOKEN.match(page, at)
        at = token.end()
        name = token[2] or token[5]
        last = stack[-1] if stack else None
        if name is None:
            raw = token[0]
            if not raw.startswith("<") or raw == "<":
                yield "text", last, stack, html_lib.unescape(raw)
            elif raw.startswith("<![CDATA["):
                yield "text", last, stack, raw[9:].removesuffix("]]>")
            continue
        name, closing, attributes = name.lower(), (token[1] or token[4]) == "/", token[3] or token[6] or ""
        if closing:
            if ignored[name]:
                ignored[name] -= 1
            elif names[name]:
                depth = next(k for k in range(len(stack) - 1, -1, -1) if stack[k].name == name)
                if name not in INLINE:
                    yield "close", last, stack, stack[depth].sign
                cut(depth)
            continue
        if name in VOID:
            if name in ("br", "hr"):
                yield "break", last, stack, name
            continue
        if name in CLOSES:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name in CLOSES[name]:
                    break
                if stack[k].name == name or (name in ("dt", "dd") and stack[k].name in ("dt", "dd")) or (name in ("td", "th") and stack[k].name in ("td", "th")):
                    yield "close", last, stack, stack[k].sign
                    cut(k)
                    break
        elif name not in INLINE and last is not None and last.paragraph >= 0:  # a block ends an open paragraph
            yield "close", last, stack, "p"
            cut(last.paragraph)
        if name in ("article", "main"):  # something before it was never closed
            for k, element in enumerate(stack):
                if element.name in ("nav", "form", "head", "footer") or (element.name == "header" and not element.rank):
                    cut(k)
                    break
        if name in RAW:
            close = _closing(name).search(page, at)
            at = close.end() if close else end
            continue
        if len(stack) >= DEPTH:
            ignored[name] += 1
            continue
        element = Element(name, attributes, stack[-1] if stack else None, len(stack))
        stack.append(element)
        names[name] += 1
        if name not in INLINE:
            yield "open", element, stack, element.sign


@lru_cache(100)
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}\s*>?", re.I)


@dataclass
class Block:
    """A run of text between block tags: its innermost block, and its pieces with the element that each stands in."""

    element: Element | None
    pieces: list[tuple[Element | None, str]]

    @property
    def path(self) -> int:
        return self.element.path if self.element is not None else 0

    def text(self, allowed=None) -> str:
        return " ".join("".join(t for e, t in self.pieces if e is None or (e.counts() and (allowed is None or allowed(e)))).split())

    def digest(self) -> int:
        return int.from_bytes(blake2b(self.text().encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def events(page: str, chains: bool = False) -> Iterator[tuple[str, object]]:
    """("open", element), ("close", signature) and ("text", Block), of blocks with text that counts; with `chains`, pairs of the block and the paths of its ancestors."""
    pieces: list[tuple[Element | None, str]] = []
    held: Element | None = None
    said = False
    inside: list[int] = []

    for kind, last, stack, value in walk(page):
        if kind == "text":
            if not pieces:
                held = last.block if last is not None else None
                inside = [e.path for e in stack if not e.inline] if chains else inside
            pieces.append((last, value))
            said = said or ((last is None or last.counts()) and not value.isspace())
            continue
        if said:
            block = Block(held, pieces)
            yield "text", (block, inside) if chains else block
        pieces, said = [], False
        if kind == "open":
            yield "open", last
        elif kind == "close":
            yield "close", value
    if said:
        block = Block(held, pieces)
        yield "text", (block, inside) if chains else block


def fold(stream: list[str], longest: int = 12) -> list[str]:
    """Adjacent repeats of groups of up to `longest` symbols as one group in parentheses, shortest groups first."""
    for width in range(1, longest + 1):
        out: list[str] = []
        k, n = 0, len(stream)
        while k < n:
            group = stream[k : k + width]
            times = 1
            while len(group) == width and stream[k + times * width : k + (times + 1) * width] == group:
                times += 1
            if times > 1:
                out.append(group[0] if width == 1 and group[0].endswith(")+") else "(" + " ".join(group) + ")+")
                k += times * width
            else:
                out.append(stream[k])
                k += 1
        stream = out
    return stream


def as_repeat(item: str) -> str:
    return item if item.endswith(")+") else f"({item.strip('()?') if item.endswith(')?') else item})+"


def plain_of(item: str) -> str:
    return item[1:-2] if item.endswith((")?", ")+")) else item


def nested(items: list[str]) -> list[str]:
    """Every symbol with the element that it stands in, so a text slot is matched with one in the same kind of element only."""
    out: list[str] = []
    open_: list[str] = []
    for item in items:
        plain = plain_of(item)
        out.append(f"{open_[-1] if open_ else ''} {'#' if is_text(plain) else plain}")
        for symbol in _TAGS.findall(plain):
            if not symbol.startswith("</"):
                open_.append(symbol)
            elif open_:
                open_.pop()
    return out


def collapsed(items: list[str], other: list[str]) -> list[str]:
    """The items with every instance of a repeated group of the other stream written as that group."""
    groups = sorted({x for x in other if x.endswith(")+") and " " in x}, key=lambda x: (-x.count(" "), x))
    for group in groups:
        symbols, out, k = plain_of(group).split(" "), [], 0
        while k < len(items):
            if items[k] == symbols[0] and items[k : k + len(symbols)] == symbols:
                out.append(group)
                k += len(symbols)
            else:
                out.append(items[k])
                k += 1
        items = out
    return items


def required(wrapper: list[str]) -> list[int]:
    """The paths of the elements that every page which the wrapper takes has: those outside of optional groups."""
    found: dict[int, None] = {}
    open_: list[tuple[int, bool]] = []
    for item in wrapper:
        optional = item.endswith(")?")
        for symbol in _TAGS.findall(plain_of(item)):
            if not symbol.startswith("</"):
                above = open_[-1] if open_ else (0, False)
                open_.append((_path_of(above[0], symbol[1:-1]), optional or above[1]))
                if not open_[-1][1]:
                    found[open_[-1][0]] = None
            elif open_:
                open_.pop()
    return list(found)


def is_text(item: str) -> bool:
    return item == "#" or item.startswith("=")


def matches(a: list[str], b: list[str], most: int = 40_000) -> list[tuple[int, int]]:
    """Pairs of places that stand for each other, rising in both: common ends, then symbols that both have once, in time n log n.

    Stretches without such symbols are compared in full only if the product of their lengths is at most `most`.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        if (a1 - a0) * (b1 - b0) <= most:
            for block in SequenceMatcher(None, a[a0:a1], b[b0:b1], autojunk=False).get_matching_blocks():
                out += [(a0 + block.a + k, b0 + block.b + k) for k in range(block.size)]
            continue
        here, there = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {b[k]: k for k in range(b0, b1) if there[b[k]] == 1 and here[b[k]] == 1}
        pairs = [(k, where[a[k]]) for k in range(a0, a1) if a[k] in where]
        ends: list[int] = []  # the longest rising run of places in b
        tails: list[int] = []
        before = [-1] * len(pairs)
        for k, (_, y) in enumerate(pairs):
            at = bisect_left(ends, y)
            before[k] = tails[at - 1] if at else -1
            ends[at : at + 1], tails[at : at + 1] = [y], [k]
        chain, k = [], tails[-1] if tails else -1
        while k >= 0:
            chain.append(pairs[k])
            k = before[k]
        if not chain:
            continue
        x0, y0 = a0, b0
        for x, y in reversed(chain):
            todo.append((x0, x, y0, y))
            out.append((x, y))
            x0, y0 = x + 1, y + 1
        todo.append((x0, a1, y0, b1))
    return sorted(out)


def align(wrapper: list[str], stream: list[str]) -> list[str]:
    """The wrapper widened so that it takes the stream as well: mismatches become slots, repeated or optional groups."""
    wrapper, stream = collapsed(wrapper, stream), collapsed(stream, wrapper)
    strip, other = nested(wrapper), nested(stream)
    out: list[str] = []
    a = c = 0
    for b, d in [*matches(strip, other), (len(strip), len(other))]:
        for part in (wrapper[a:b], stream[c:d]):
            plain = " ".join(map(plain_of, part))
            if not part:
                continue
            if out and out[-1].endswith(")+") and out[-1][1:-2] == plain:
                continue  # once more of the group before it
            if out and out[-1] == plain and len(part) == 1 and not is_text(plain):
                out[-1] = as_repeat(plain)
                continue
            out += [x if x.endswith(")?") else f"({x[1:-2] if x.endswith(')+') else x})?" for x in part]
        if b < len(strip):
            x, y = wrapper[b], stream[d]
            if is_text(x) and is_text(y):
                out.append(x if x == y else "#")
            elif x == y or x.endswith(")?"):
                out.append(x)
            else:
                out.append(y if y.endswith(")?") else as_repeat(x if x.endswith(")+") else y))
        a, c = b + 1, d + 1
    return out


def scan(page: str) -> dict:
    """A page's stream with its texts numbered, its elements by path, and its texts with the element that each stands in."""
    stream: list[str] = []
    elements: dict[int, int] = {0: 0}
    paths, parents, depths, ranks, softs, holds = [0], [-1], [0], [0], [False], [True]
    texts: dict[tuple[int, int], int] = {}
    masses: list[int] = []
    soft_masses: list[int] = []
    open_: list[int] = []  # places of the open blocks
    for kind, value in events(page):
        if kind == "open":
            while len(open_) >= value.depth:
                open_.pop()
            above = open_[-1] if open_ else 0
            k = elements.get(value.path)
            if k is None:
                k = elements[value.path] = len(paths)
                paths.append(value.path)
                parents.append(above)
                depths.append(value.depth)
                ranks.append(value.own_rank)
                softs.append(value.soft)
                holds.append(not value.out and (value.name == "td" or value.name not in PARAGRAPH))
            open_.append(k)
            stream.append(f"<{value.sign}>")
        elif kind == "close":
            stream.append(f"</{value}>")
        else:
            key = (elements.get(value.path, 0), value.digest())
            k = texts.setdefault(key, len(texts))
            if k == len(masses):
                masses.append(0)
                soft_masses.append(0)
            for e, piece in value.pieces:
                if e is None or (e.counts() and not e.link):
                    size = len(piece.strip())
                    if e is not None and e.softs:
                        soft_masses[k] += size
                    else:
                        masses[k] += size
            stream.append(f"#{k}")
    found = dict(stream="\n".join(stream), paths=paths, parents=parents, depths=depths, ranks=ranks, softs=softs, holds=holds, elements=[e for e, _ in texts], texts=[d for _, d in texts], masses=masses, soft_masses=soft_masses)
    found["digest"] = int.from_bytes(blake2b(repr((found["stream"], found["texts"])).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
    return found


def _place(path: int, digest: int) -> int:
    """A text at a path as one number."""
    return path ^ (digest * 0x9E3779B97F4A7C15 + 0x5BD1E995 & (1 << 63) - 1)


def with_slots(page: dict, fixed: frozenset[int]) -> tuple[str, list[int], list[int]]:
    """The folded stream of a scanned page, and the slots' text below each of its elements, outside and inside of named boilerplate."""
    symbols = []
    is_fixed = [_place(page["paths"][e], d) in fixed for e, d in zip(page["elements"], page["texts"], strict=True)]
    for symbol in page["stream"].split("\n"):
        symbols.append(symbol if not symbol.startswith("#") else f"={page['texts'][int(symbol[1:])] & 0xFFFFFFFFFFFFFFFF:x}" if is_fixed[int(symbol[1:])] else "#")
    mass, soft = [0] * len(page["paths"]), [0] * len(page["paths"])
    for e, m, s, told in zip(page["elements"], page["masses"], page["soft_masses"], is_fixed, strict=True):
        if not told:
            mass[e] += m
            soft[e] += s
    for k in range(len(mass) - 1, 0, -1):  # parents come before their children
        mass[page["parents"][k]] += mass[k]
        soft[page["parents"][k]] += soft[k]
    return "\n".join(fold(symbols)), mass, soft


def text_of(page: str, region: int | None, explicit: bool, pardoned: frozenset[int], fixed: frozenset[int]) -> str:
    """The article of a page by what is known of its host."""
    found = [(block, chain) for _, x in events(page, chains=True) if _ == "text" for block, chain in (x,)]

    def allowed(e: Element) -> bool:
        return all(x in pardoned for x in e.softs)

    def texts(blocks: list, some=allowed) -> list[tuple[Block, str]]:
        return [(b, t) for b, _ in blocks if (t := b.text(some))]

    kept: list[tuple[Block, str]] = []
    if region is not None:
        kept = texts([x for x in found if region == 0 or region in x[1]])
    kept = kept or texts([x for x in found if x[0].element is not None and x[0].element.rank == 3]) or texts(found) or texts(found, None)
    if fixed and not explicit:
        left = [(b, t) for b, t in kept if (b.element is not None and b.element.heading) or _place(b.path, b.digest()) not in fixed]
        # a page that is mostly like others is a copy of theirs, and what it shares is its text
        if 2 * sum(len(t) for _, t in left) >= sum(len(t) for _, t in kept):
            kept = left
    return " ".join(t for _, t in kept)


def inferred(streams: DataFrame, fan: int = 64) -> DataFrame:
    """host, wrapper, pages and required (paths) of rows host, stream, copies.

    A host's distinct streams are folded about `fan` at a time, then what came of them, until one is left: no task gathers a
    host, however many pages or streams it has.
    """

    def infer(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("pages").to_pylist(), table.column("stream").to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
        wrapper: list[str] = rows[0][1].split("\n")
        for _, stream in rows[1:]:
            wrapper = align(wrapper, stream.split("\n"))
        return pa.table({"host": [table.column("host")[0].as_py()], "stream": ["\n".join(wrapper)], "pages": [sum(x for x, _ in rows)]})

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        paths = pa.array([required(x.as_py().split("\n")) for x in batch.column("stream")], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([*batch.columns, paths], names=[*batch.schema.names, "required"])

    whole = streams.groupBy("host", "stream").agg(F.sum("copies").alias("pages"))
    left = whole.groupBy("host").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    while True:
        parts = -(-left // fan)
        whole = whole.groupBy("host", F.pmod(F.xxhash64("stream"), F.lit(parts)).alias("part")).applyInArrow(infer, "host string, stream string, pages long")
        if parts == 1:
            break
        left = parts
    known = _mapped(whole, judge, "host string, stream string, pages long, required array<long>")
    return known.select("host", F.translate("stream", "\n", " ").alias("wrapper"), "pages", "required")


def containers(elements: DataFrame, wrappers: DataFrame) -> DataFrame:
    """host, region, explicit and pardoned of rows host, path, depth, rank, soft, holds, mass, soft_mass (path 0: the page)."""
    sums = elements.groupBy("host", "path").agg(*(F.max(c).alias(c) for c in ("depth", "rank", "soft", "holds")), *(F.sum(c).alias(c) for c in ("mass", "soft_mass")))
    totals = sums.filter("path = 0").select("host", F.col("mass").alias("told"), F.col("soft_mass").alias("soft_told"))
    totals = totals.select("host", (F.col("told") < LITTLE * (F.col("told") + F.col("soft_told"))).alias("open"), (F.col("told") + F.col("soft_told")).alias("all"), "told")
    always = wrappers.select("host", F.explode("required").alias("path")).distinct().withColumn("always", F.lit(True))
    known = sums.join(totals, "host").join(always, ["host", "path"], "left")
    held = F.col("mass") + F.when(F.col("open"), F.col("soft_mass")).otherwise(0)
    known = known.withColumns({"held": held, "total": F.when(F.col("open"), F.col("all")).otherwise(F.col("told")), "always": F.coalesce("always", F.lit(False)), "pardon": F.col("open") & F.col("soft") & (F.col("mass") + F.col("soft_mass") >= 0.5 * F.col("all"))})
    tier = (
        F.when((F.col("path") == 0) | ~F.col("holds") | (F.col("soft") & ~F.col("pardon")) | (F.col("held") <= 0), -1)
        .when((F.col("rank") == 3) & (F.col("held") >= EXPLICIT * F.col("total")), 3)
        .when((F.col("rank") == 2) & (F.col("held") >= NAMED * F.col("total")), 2)
        .when(F.col("held") >= ANY * F.col("total"), F.when(F.col("always"), 1).otherwise(0))
        .otherwise(-1)
    )
    known = known.withColumn("tier", tier)
    best = known.groupBy("host").agg(F.max(F.struct("tier", "held")).alias("best"), F.collect_set(F.when(F.col("pardon"), F.col("path"))).alias("pardoned"))
    # of elements that say what they are the outermost, of others the innermost
    outer = F.col("tier") >= 2
    inner = known.join(best.select("host", "best", "pardoned"), "host").filter((F.col("tier") == F.col("best.tier")) & (F.col("tier") >= 0) & (~outer | (F.col("held") == F.col("best.held"))))
    chosen = inner.groupBy("host").agg(F.max(F.struct(F.when(outer, -F.col("depth")).otherwise(F.col("depth")).alias("order"), "held", "path")).alias("x"), F.max("tier").alias("tier"))
    return best.select("host", "pardoned").join(chosen, "host", "left").select("host", F.col("x.path").alias("region"), (F.coalesce("tier", F.lit(-1)) == 3).alias("explicit"), "pardoned")


def with_regions(kept: DataFrame, regions: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Every row with what is known of its host. A host with a third of all pages is never gathered, whichever way is taken."""
    lists = [f.name for f in regions.schema.fields if f.dataType.typeName() == "array"]
    size = regions.agg(F.sum(F.octet_length("host") + F.lit(64) + sum((8 * F.greatest(F.size(c), F.lit(0)) for c in lists), F.lit(0)))).first()[0] or 0
    if size <= most:
        return kept.join(F.broadcast(regions), "host", "left")
    salted = regions.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return kept.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left").drop("salt")


def _mapped(kept: DataFrame, function, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield function(batch)

    return kept.mapInArrow(run, schema)


def wrappers(pages: DataFrame, share: float = 0.5, least: int = 3, fan: int = 64) -> DataFrame:
    """host, wrapper, pages, region, explicit, pardoned and fixed of the hosts of `pages` (host, html)."""
    schema = _arrow(SCAN_SCHEMA)

    def scan_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [scan(x.as_py() or "") for x in batch.column("html")]
        columns = [batch.column("host") if f.name == "host" else pa.array([r[f.name] for r in rows], f.type) for f in schema]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    scans = _mapped(pages.select("host", "html"), scan_batch, SCAN_SCHEMA)
    said = [f.name for f in schema if f.name not in ("host", "digest")]
    scans, path = stored(scans.groupBy("host", "digest").agg(F.count("*").alias("copies"), F.first(F.struct(*said)).alias("x")).select("host", "copies", "x.*"), "html-scans")

    # texts that most of a host's distinct pages have in the same place; at most (texts of a page) / share of them
    def places(batch: pa.RecordBatch) -> pa.RecordBatch:
        hosts, found = [], []
        for host, paths, elements, texts in zip(*(batch.column(c).to_pylist() for c in ("host", "paths", "elements", "texts")), strict=True):
            found += [_place(paths[e], d) for e, d in zip(elements, texts, strict=True)]
            hosts += [host] * len(texts)
        return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(found, pa.int64())], names=["host", "place"])

    counts = _mapped(scans.select("host", "paths", "elements", "texts"), places, "host string, place long").groupBy("host", "place").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    totals = scans.groupBy("host").agg(F.count("*").alias("distinct"))
    fixed = checkpointed(counts.join(totals, "host").filter(F.col("n") >= share * F.col("distinct")).groupBy("host").agg(F.collect_list("place").alias("fixed")))

    def slots(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for page in batch.to_pylist():
            stream, mass, soft = with_slots(page, frozenset(page["fixed"] or ()))
            rows.append((page["host"], stream, page["copies"], None, None, None, None, None, None, None))
            for k, m in enumerate(mass):
                if m or soft[k] or k == 0:
                    rows.append((page["host"], None, None, page["paths"][k], page["depths"][k], page["ranks"][k], page["softs"][k], page["holds"][k], m, soft[k]))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), streams_schema, strict=True)], schema=streams_schema) if rows else pa.RecordBatch.from_pylist([], schema=streams_schema)

    streams_schema = _arrow(STREAM_SCHEMA)
    told = _mapped(with_regions(scans, fixed), slots, STREAM_SCHEMA)
    told = checkpointed(told.groupBy("host", "stream", "path", "depth", "rank", "soft", "holds").agg(*(F.sum(c).alias(c) for c in ("copies", "mass", "soft_mass"))))
    discard(pages.sparkSession, path)
    whole = checkpointed(inferred(told.filter("stream IS NOT NULL"), fan))
    return checkpointed(whole.drop("required").join(containers(told.filter("path IS NOT NULL"), whole), "host", "left").join(fixed, "host", "left"))


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = 0.5, least: int = 3) -> DataFrame:
    """id, url, text and n_chars of the article of every page."""
    kept = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), host_of(url_col).alias("host"), F.col(html_col).cast("string").alias("html"))
    key = kept.schema["page_id"].dataType.simpleString()
    known = wrappers(kept, share, least)
    placed = with_regions(kept, known.select("host", "region", "explicit", "pardoned", "fixed"))

    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        told = (batch.column(c).to_pylist() for c in ("region", "explicit", "pardoned", "fixed"))
        texts = [text_of(page.as_py() or "", region, bool(explicit), frozenset(pardoned or ()), frozenset(fixed or ())) for page, region, explicit, pardoned, fixed in zip(batch.column("html"), *told, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    cut = _mapped(placed, extract, f"page_id {key}, url string, text string")
    return cut.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
