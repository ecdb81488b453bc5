"""Main text of web pages by wrappers that are inferred from a host's pages.

A page is a stream of tokens: starts and ends of block elements, and texts. Pages of one host are aligned one after another to a union-free regular expression, the
wrapper: where the streams differ, the difference becomes a repeated group (what comes next is what just matched) or an optional one (the
nearest common token ends it), and a text that isn't the same on most pages that have its place becomes a slot. Every page takes part: a task aligns what it reads and wrappers are
merged with wrappers, some dozens at a time; how often pages have a place, and a text there, is counted over all pages.

The wrapper says where a host's article stands: from the root down, the element that holds most of the text of slots that isn't links, through elements that are neither repeated nor mostly missing. A
page's text is what it has there in slots, less what stands beside an article by its element, role or name, and less repeated groups of links. article and main elements are a
feature: they are followed at a smaller share, and in them blocks may be mostly links. Hosts of fewer than three pages have no wrapper, and their pages go by names alone.
"""

from __future__ import annotations

import bisect
import html
import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Counts and hosts that a task holds before it passes them on; wrappers of a host that one step merges; longest group that is looked for.
HELD, FAN, PERIOD = 200_000, 32, 3
#: Levels of block elements that a wrapper has; all that stands deeper counts as standing in the last of them.
DEEPEST = 150
#: Pages from which on a host has a wrapper; share of a host's pages that must have a place before what stands there can be fixed.
LEAST_PAGES, LEAST_SHARE = 3, 0.05
#: Share of an element's slot text that a child must hold to be gone into, and the same for a child that says that it is the article.
MOST, MARKED = 0.7, 0.4
#: Bytes of host plans up to which they are broadcast; beyond it every plan is joined in this many copies, so that a host's pages are dealt out.
BROADCAST, SALTS = 64 << 20, 64

#: Fixed values of HTML: elements whose content is never text, elements that stand alone, elements inside a line.
RAW = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "math", "canvas", "head", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
    "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "ruby", "rt", "rp",
}
#: Elements, roles and words in class or id that say what is not the article.
ASIDE = {"nav", "aside", "footer", "form", "menu", "dialog", "button", "select", "option", "fieldset", "input", "label"}
ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "alert", "dialog", "menu", "menubar", "toolbar"}
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|adbox|banner|sponsor|sponsored|promo|promotion|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|sidebar|aside|footer|masthead|"
    r"cookie|cookies|consent|notice|notices|popup|modal|overlay|comment|comments|reply|replies|respond|disqus|social|newsletter|subscribe|signup|login|pagination|pager|toolbar|hidden)"
    r"(?:$|[\s_-])",
    re.IGNORECASE,
)
#: Words that say so only outside an article.
WEAK_NAMES = re.compile(r"(?:^|[\s_-])(?:side|foot|header|share|sharing|related|recommended|search|widget)(?:$|[\s_-])", re.IGNORECASE)
#: Elements that an article can fill as a whole, and headings that may stand before it.
FILLED = {"html", "body", "div", "section", "main", "article", "center", "table", "tbody", "tr", "td"}
HEADINGS = {"h1", "h2"}
#: Classes that say of an article element that it is not the page's own.
OTHERS = {"comment", "comments", "reply", "replies", "teaser", "related", "recommended", "promo", "sponsored"}
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|$)", re.DOTALL)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
#: Elements that a following one of the same set ends, within the nearest block.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def element(name: str, rest: str, inside: bool) -> tuple[str, bool]:
    """An element's label for paths, and whether it says that its content is beside the article."""
    off, label = name in ASIDE, name
    for m in ATTRIBUTE.finditer(rest) if rest and not rest.isspace() else ():
        key, value = m[1].lower(), next((v for v in m.groups()[1:] if v is not None), "")
        if key in ("class", "id"):
            label += f".{re.sub('[0-9]+', '0', value.strip().lower())}"
            named = NAMES.search(value) or not inside and WEAK_NAMES.search(value)
            off = off or bool(named) and name not in ("html", "body", "article", "main") or name == "article" and not OTHERS.isdisjoint(value.lower().split())
        elif key == "role":
            off = off or value.lower() in ROLES
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            off = off or name not in ("html", "body")
    return label.replace("/", "").replace("\0", ""), off


@dataclass(slots=True)
class Text:
    """A block of text: where it stands, whether that is beside the article or in a marked one, and what share of it is links."""

    path: str
    text: str
    off: bool
    inside: bool
    links: float


@dataclass(slots=True)
class Element:
    label: str
    items: list


@dataclass(slots=True)
class Open:
    """An open element: its name, whether it is beside the article, whether it marks one, the element that holds its content, and that one's path and depth."""

    name: str
    off: bool
    marks: bool
    within: Element
    path: str
    depth: int


class Stack:
    """The open elements of a page, with how many there are of each name and kind, so that no step looks through all of them."""

    def __init__(self, root: Element):
        self.items: list[Open] = []
        self.names: Counter = Counter()
        self.off = self.marks = 0
        self.base = Open("", False, False, root, "", 0)

    @property
    def top(self) -> Open:
        return self.items[-1] if self.items else self.base

    def push(self, item: Open) -> None:
        self.items.append(item)
        self.names[item.name] += 1
        self.off += item.off
        self.marks += item.marks

    def pop(self) -> Open:
        item = self.items.pop()
        self.names[item.name] -= 1
        self.off -= item.off
        self.marks -= item.marks
        return item

    def close(self, name: str) -> None:
        """Ends the innermost element of this name and all in it, if there is one."""
        if self.names[name]:
            while self.pop().name != name:
                pass

    def make_way(self, name: str) -> None:
        """Ends the element that a new one of this name ends, within the nearest block."""
        ends = CLOSES.get(name, {"p"} if name not in INLINE else ())
        if not any(self.names[n] for n in ends):
            return
        for k in range(len(self.items) - 1, -1, -1):
            if self.items[k].name in ends:
                while len(self.items) > k:
                    self.pop()
                return
            if self.items[k].name not in INLINE:
                return


def parse(page: str) -> tuple[Element, list[Text]]:
    """The tree of block elements, whose items are elements and texts, and the texts in page order.

    White space of a block is one space; character references are decoded. Unclosed and wrongly closed elements are taken as browsers do, roughly.
    Elements below DEEPEST levels add no level and no part to paths: what they hold stands in the last one that does.
    """
    root = Element("", [])
    stack = Stack(root)
    texts: list[Text] = []
    parts: list[str] = []
    linked = 0
    at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            share, linked = min(1.0, linked / max(1, len(text))), 0
            if text:
                texts.append(Text(stack.top.path, text, stack.off > 0, stack.marks > 0, share))
                stack.top.within.items.append(texts[-1])

    while at < len(page):
        m = TOKEN.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            parts.append(page[at:end])
            if stack.names["a"]:
                linked += end - at
        if not m:
            break
        at = m.end()
        name = m[2].lower() if m[2] else None
        if name is None:
            continue
        if name not in INLINE:
            flush()
        if m[1]:
            stack.close(name)
            continue
        if name in RAW and not m[3].endswith("/"):
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.IGNORECASE).search(page, at)
            if close:
                at = close.end()
                continue
            if name != "head":  # unclosed: the rest of the page is its content
                break
            continue
        if name in VOID or m[3].endswith("/"):
            continue
        if name in CLOSES or name not in INLINE:
            stack.make_way(name)
        label, off = element(name, m[3], stack.marks > 0)
        # a header is the page's own unless it stands within the article; a new article within one is a comment or a teaser
        within_article = stack.names["article"] > 0
        off = off or name == "header" and not within_article or name == "article" and within_article
        top = stack.top
        within, path, depth = top.within, top.path, top.depth
        if name not in INLINE and depth < DEEPEST:
            within, path, depth = Element(label, []), f"{path}/{label}", depth + 1
            top.within.items.append(within)
        stack.push(Open(name, off, name in ("article", "main") or "article" in label.split(".")[1:], within, path, depth))
    flush()
    return root, texts


#: A part of a wrapper: label (an element's, # for a text, or ( and labels for a group), whether pages may lack it, whether it may repeat, and what it consists of.
Part = tuple[str, bool, bool, tuple]
TEXT = "#"


def merged(a: Part, b: Part) -> Part:
    """The part that matches what either matches."""
    return a[0], a[1] or b[1], a[2] or b[2], aligned(a[3], b[3])


def again(a: Part, b: Part) -> Part:
    """The repeated part that matches one after the other."""
    return a[0], a[1] and b[1], True, aligned(a[3], b[3])


def group(parts: tuple[Part, ...]) -> Part:
    return "(" + " ".join(p[0] for p in parts), False, False, parts


def labels(parts) -> list[str]:
    return [p[0] for p in parts]


def folded(parts) -> tuple[Part, ...]:
    """Parts, or groups of up to PERIOD parts, that follow each other as one repeated part."""
    out: list[Part] = []
    for part in parts:
        out.append(part)
        changed = True
        while changed:
            changed = False
            for n in range(1, min(PERIOD, len(out) - 1) + 1):
                last = out[-n:]
                before = out[-n - 1]
                if n == 1 and before[0] == last[0][0]:
                    out[-2:] = [again(before, last[0])]
                elif n > 1 and before[0] == group(tuple(last))[0]:
                    out[-n - 1 :] = [again(before, group(tuple(last)))]
                elif n > 1 and len(out) >= 2 * n and labels(out[-2 * n : -n]) == labels(last):
                    out[-2 * n :] = [again(group(tuple(out[-2 * n : -n])), group(tuple(last)))]
                else:
                    continue
                changed = True
                break
    return tuple(out)


def optional(part: Part) -> Part:
    return part[0], True, part[2], part[3]


def by_label(parts: tuple[Part, ...]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = defaultdict(list)
    for k, part in enumerate(parts):
        out[part[0]].append(k)
    return out


def after(places: dict[str, list[int]], label: str, k: int) -> int | None:
    """The first place of a label beyond k."""
    found = places.get(label, ())
    at = bisect.bisect_right(found, k)
    return found[at] if at < len(found) else None


def aligned(a: tuple[Part, ...], b: tuple[Part, ...]) -> tuple[Part, ...]:
    """The sequence of parts that matches what either sequence matches."""
    if a == b:
        return a
    out: list[Part] = []
    at_a, at_b = by_label(a), by_label(b)
    i = j = 0
    while i < len(a) or j < len(b):
        x, y = a[i] if i < len(a) else None, b[j] if j < len(b) else None
        if x and y and x[0] == y[0]:
            out.append(merged(x, y))
            i, j = i + 1, j + 1
        elif x and x[0].startswith("(") and (some := b[j : j + len(x[3])]) and group(some)[0] == x[0]:
            out.append(merged(x, group(some)))
            i, j = i + 1, j + len(some)
        elif y and y[0].startswith("(") and (some := a[i : i + len(y[3])]) and group(some)[0] == y[0]:
            out.append(merged(y, group(some)))
            i, j = i + len(some), j + 1
        # a repeated part: what comes next is what just matched
        elif y and out and out[-1][0] == y[0]:
            out[-1] = again(out[-1], y)
            j += 1
        elif x and out and out[-1][0] == x[0]:
            out[-1] = again(out[-1], x)
            i += 1
        else:  # an optional part: up to the nearest common token
            to_b = after(at_b, x[0], j) if x else None
            to_a = after(at_a, y[0], i) if y else None
            if to_b is not None and (to_a is None or to_b - j <= to_a - i):
                out += map(optional, b[j:to_b])
                j = to_b
            elif to_a is not None:
                out += map(optional, a[i:to_a])
                i = to_a
            else:
                out += map(optional, [p for p in (x, y) if p])
                i, j = i + 1, j + 1
    return folded(out)


def expression(item: Element | Text) -> Part:
    """A page's own expression, repeats folded."""
    if isinstance(item, Text):
        return TEXT, False, False, ()
    return item.label, False, False, folded([expression(x) for x in item.items])


def infer(pages: list[str]) -> Part:
    """The wrapper of some pages."""
    wrapper = None
    for page in pages:
        own = expression(parse(page)[0])
        wrapper = merged(wrapper, own) if wrapper else own
    return wrapper or ("", False, False, ())


def regex(part: Part) -> str:
    """The wrapper as a regular expression over stream()'s tokens. It has no alternatives."""
    inner = "".join(map(regex, part[3]))
    if part[0] != TEXT and not part[0].startswith("("):
        inner = re.escape(f"<{part[0]}>") + inner + "</>"
    elif part[0] == TEXT:
        inner = TEXT
    return f"(?:{inner})" + ("*" if part[1] and part[2] else "?" if part[1] else "+" if part[2] else "")


def stream(item: Element | Text) -> str:
    """A page's tokens: starts and ends of block elements, and a mark for each text."""
    return TEXT if isinstance(item, Text) else f"<{item.label}>" + "".join(map(stream, item.items)) + "</>"


def digest(path: str, text: str | None = None) -> int:
    """A signed 64-bit number for a path, or for a text there."""
    n = xxhash.xxh3_64_intdigest((path if text is None else f"{path}\0{text}").encode("utf-8", "replace"))
    return n - (n >> 63 << 64)


@dataclass
class Plan:
    """What a host's wrapper says of its pages: where the article stands (empty: anywhere), groups of links, and fixed texts, as digests."""

    content: str = ""
    lists: frozenset = frozenset()
    fixed: frozenset = frozenset()


def places(part: Part, path: str = "", repeated: bool = False) -> Iterator[tuple[str, str, bool]]:
    """(path, label, whether it or what it stands in repeats) of all elements and texts of a wrapper. A text's path is that of its element."""
    for child in part[3]:
        if child[0].startswith("("):
            yield from places(child, path, repeated or child[2])
        elif child[0] == TEXT:
            yield path, TEXT, repeated or child[2]
        else:
            below = f"{path}/{child[0]}"
            yield below, child[0], repeated or child[2]
            yield from places(child, below, repeated or child[2])


def plan(wrapper: Part, pages: int, slots: dict[int, tuple[int, int, int, int]], fixed: frozenset) -> Plan:
    """From a wrapper and, by digest of the path, of its texts that aren't beside the article: pages, characters, characters of slots, and characters in links."""
    volume: dict[str, float] = defaultdict(float)
    seen: dict[str, int] = defaultdict(int)
    known, repeats, lists = set(), set(), set()
    for path, label, repeated in places(wrapper):
        if label != TEXT:
            if repeated:
                repeats.add(path)
            continue
        here = digest(path)
        have, chars, varying, linked = slots.get(here, (0, 0, 0, 0))
        if repeated and 2 * linked >= chars > 0:
            lists.add(here)
        if path in known:
            continue
        known.add(path)
        written_out = varying * (1 - linked / chars) if chars else 0.0
        while True:
            volume[path] += written_out
            seen[path] = max(seen[path], have)
            if not path:
                break
            path = path.rpartition("/")[0]
    content = ""
    while True:
        children = [p for p in volume if p and p.rpartition("/")[0] == content]
        best = max(children, key=lambda p: (volume[p], p), default=None)
        if best is None or not volume[best]:
            break
        label = best.rpartition("/")[2]
        marked = label.split(".")[0] in ("article", "main")
        if label.split(".")[0] not in FILLED or best in repeats or 2 * seen[best] < pages or volume[best] < (MARKED if marked else MOST) * volume[content]:
            break
        content = best
    return Plan(content, frozenset(lists), fixed)


def main_text(page: str | None, host: Plan = Plan()) -> str:
    """The article's blocks joined by one space: those of the page's slots where the host's article stands, or anywhere if the page has nothing there, that are neither beside the
    article, nor fixed, nor, outside an element that marks an article, mostly links. Headings right before the article belong to it."""
    texts = parse(page or "")[1]
    within = [t.path == host.content or t.path.startswith(host.content + "/") for t in texts]
    if any(w and not t.off for w, t in zip(within, texts)):
        first = within.index(True)
        # a heading's path ends in its label, and its element stands in one that the article stands in
        head = [k < first and t.path.rpartition("/")[2].split(".")[0] in HEADINGS and f"{host.content}/".startswith(t.path.rpartition("/")[0] + "/") for k, t in enumerate(texts)]
        texts = [t for t, w, h in zip(texts, within, head) if w or h]
    keep = (t for t in texts if not t.off and (t.inside or t.links < 0.5 and digest(t.path) not in host.lists))
    return " ".join(t.text for t in keep if digest(t.path, t.text) not in host.fixed)


def host_of(url: F.Column) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def dumped(wrapper: Part) -> str:
    return json.dumps(wrapper, separators=(",", ":"), ensure_ascii=False)


def loaded(text: str) -> Part:
    return _part(json.loads(text))


def _part(x: list) -> Part:
    return x[0], x[1], x[2], tuple(map(_part, x[3]))


def observed(pages: DataFrame) -> DataFrame:
    """A table of counts and wrappers of what each task read.

    (host, path, block, n, chars, linked): pages that have a text (block null: any text; path null, too: pages of the host) at a path, with the characters that aren't
    beside the article; (host, wrapper): the wrapper of the host's pages.
    """
    schema = "host string, path long, block long, n long, chars long, linked long, wrapper string"
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.string(), *[pa.int64()] * 5, pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        own: dict[str, set[Part]] = defaultdict(set)

        def flush() -> pa.RecordBatch:
            rows = [(*key, *n, None) for key, n in counts.items()]
            for host, parts in own.items():
                first, *more = sorted(parts)
                for part in more:
                    first = merged(first, part)
                rows.append((host, None, None, None, None, None, dumped(first)))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        def add(key, chars: int, linked: int) -> None:
            n = counts.setdefault(key, [0, 0, 0])
            n[1] += chars
            n[2] += linked

        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html")):
                root, texts = parse(page.as_py())
                own[host].add(expression(root))
                add((host, None, None), 0, 0)
                keys = {(host, None, None)}
                for t in texts:
                    path, chars = digest(t.path), 0 if t.off else len(t.text)
                    for key in ((host, path, None), (host, path, digest(t.path, t.text))):
                        add(key, chars, int(chars * t.links))
                        keys.add(key)
                for key in keys:
                    counts[key][0] += 1
            if len(counts) + len(own) > HELD:
                yield flush()
                counts, own = {}, defaultdict(set)
        if own:
            yield flush()

    return written(pages.where("html is not null").select("host", "html").mapInArrow(run, schema), "observed")


def merged_wrappers(parts: DataFrame) -> DataFrame:
    """(host, wrapper), one for each host, from a table of any number of them: FAN or so at a time meet in one group, until there is one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for some in batch.column("wrappers").to_pylist():
                first, *more = map(loaded, sorted(some))
                for part in more:
                    first = merged(first, part)
                out.append(dumped(first))
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(out, pa.string())], ["host", "wrapper"])

    while True:
        sizes = written(parts.groupBy("host").agg(F.count("*").alias("parts")), "sizes")
        if (sizes.agg(F.max("parts")).first()[0] or 1) == 1:
            return parts
        dealt = parts.join(sizes, "host").withColumn("bucket", F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("parts") / FAN)))
        parts = written(dealt.groupBy("host", "bucket").agg(F.collect_set("wrapper").alias("wrappers")).mapInArrow(run, "host string, wrapper string"), "wrappers")


def plans(pages: DataFrame) -> DataFrame:
    """(host, content, lists, fixed) of every host with LEAST_PAGES pages or more, as a table.

    A text is fixed at a path if more than half of the pages that have the path have it there, and these are LEAST_PAGES and LEAST_SHARE of the host's pages. A host has at most
    2 / LEAST_SHARE times as many fixed texts as its pages have on average.
    """
    seen = observed(pages)
    counted = seen.where("wrapper is null").groupBy("host", "path", "block").agg(*[F.sum(c).alias(c) for c in ("n", "chars", "linked")])
    counted = written(counted.where("block is null or n > 1"), "counted")
    totals = counted.where("path is null").select("host", F.col("n").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    slots = counted.where("path is not null and block is null").join(totals, "host").select("host", "path", F.col("n").alias("have"), F.col("chars").alias("all"), "linked", "pages")
    most = (2 * F.col("n") > F.col("have")) & (F.col("have") >= LEAST_PAGES) & (F.col("have") >= LEAST_SHARE * F.col("pages"))
    fixed = written(counted.where("block is not null").select("host", "path", "block", "n", "chars").join(slots, ["host", "path"]).where(most).select("host", "path", "block", "chars"), "fixed")
    same = fixed.groupBy("host", "path").agg(F.sum("chars").alias("same"))
    of_slots = slots.join(same, ["host", "path"], "left").groupBy("host").agg(
        F.first("pages").alias("pages"), F.collect_list(F.struct("path", "have", "all", (F.col("all") - F.coalesce("same", F.lit(0))).alias("varying"), "linked")).alias("slots")
    )
    known = merged_wrappers(seen.where("wrapper is not null").select("host", "wrapper").distinct())
    rows = known.join(of_slots, "host").join(fixed.groupBy("host").agg(F.collect_list("block").alias("fixed")), "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, lists = [], []
            for r in batch.select(["wrapper", "pages", "slots"]).to_pylist():
                p = plan(loaded(r["wrapper"]), r["pages"], {s["path"]: (s["have"], s["all"], s["varying"], s["linked"]) for s in r["slots"]}, frozenset())
                content.append(p.content)
                lists.append(sorted(p.lists))
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(content, pa.string()), pa.array(lists, pa.list_(pa.int64())), batch.column("fixed")], ["host", "content", "lists", "fixed"])

    rows = rows.select("host", "wrapper", "pages", "slots", F.coalesce("fixed", F.array().cast("array<long>")).alias("fixed"))
    return written(rows.mapInArrow(run, "host string, content string, lists array<long>, fixed array<long>"), "plans")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null html, or a page without an article's text, gives an empty text; a null or odd url is the host without a name. Pages are read whole. Repeated rows give repeated
    results; other columns play no part. Pages stay where they are read as long as the hosts' plans can be broadcast; beyond that they are dealt by host and salt.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, content, lists, fixed in zip(batch.column("html"), *(batch.column(c).to_pylist() for c in ("content", "lists", "fixed"))):
                texts.append(main_text(page.as_py(), Plan(content or "", frozenset(lists or ()), frozenset(fixed or ()))))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    known = plans(pages)
    size = known.agg(F.sum(64 + F.length("host") + F.length("content") + 8 * (F.size("lists") + F.size("fixed")))).first()[0] or 0
    if size <= BROADCAST:
        joined = pages.join(F.broadcast(known), "host", "left")
    else:
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))
        joined = pages.withColumn("salt", salt).join(known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))).hint("merge"), ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "content", "lists", "fixed").mapInArrow(run, "page_id long, url string, text string, n_chars long")
