"""Main text of web pages by wrappers: union-free regular expressions inferred from the token streams of a host.

A page becomes a stream of block tags and text slots.  Equal neighbours fold into repeated groups; the folded streams of a host are
aligned one after another, and where they differ, a part becomes optional, or a single occurrence joins a repeated group.
Text slots carry the elements they stand in and figures over all pages: how much text, how much of it is link text, and whether
it never changes.  From these and from the slot's place in the wrapper (fixed or optional) every slot of a host gets a role: main, other or drop.

Wrappers are merged like sums: first within a map task, then over groups of tasks, then per host, so that neither a host with a
third of all pages nor many hosts meet in one task.  A second pass reads the pages again and keeps the text of main slots.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftbook.llm.common import lookup_groups, stored

SPREAD = 32
HOSTS_HELD = 2000
CONSTANT_PAGES = 5
LINK_SHARE = 0.6
LONGEST_GROUP = 12
NEAR = 60

# How HTML treats its elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea xmp iframe noembed noframes noscript template svg math select object video audio canvas".split())
BLOCKS = set(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
CLOSES_ITSELF = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
ROOTS = {"article", "main"}
ROOT_NAMES = set("article-body article-content entry-content post-content post-body story-body main-content".split())
ASIDE_TAGS = set("nav aside footer form menu dialog button head fieldset search dir".split())
ASIDE_NAMES = set(
    "ad ads adv advert adverts advertisement advertising advertorial banner sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent gdpr notice notices popup modal overlay alert comment comments "
    "respond reply replies discussion disqus share sharing social related recommended newsletter subscribe subscription "
    "widget widgets pagination pager paging toolbar topbar login signup search form".split()
)
# Names of which an aside name is one part: what may stand before it and what may follow it.
BEFORE_NAMES = set("site page main primary secondary top bottom left right global post entry article mobile desktop div js c".split())
AFTER_NAMES = set(
    "container wrapper wrap box area list bar button buttons icon icons link links post posts article articles item items panel block section "
    "inner left right top bottom slot unit title text message body author meta".split()
)
COMMENT_NAMES = {"comment", "comments", "reply", "replies", "respond"}
# Inside a root an id is mostly the mark of a heading: these name asides, others need the host's figures.
SURE_IDS = set("comments respond disqus disqus_thread sidebar navbar nav breadcrumb breadcrumbs pagination".split())
ID_CARRIERS = set("div ul ol table".split())
HEADER_NAMES = {"header", "site-header", "page-header", "top-header", "site_header", "page_header"}
ASIDE_ROLES = set("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())

TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
FOLD = re.compile(f"(.{{1,{LONGEST_GROUP}}}?)\\1+", re.DOTALL)

PAGE_TEXT = "page_id long, url string, text string, n_chars long"


@lru_cache(10000)
def aside_name(name: str) -> str:
    """'sure' for a class or id that as a whole names an aside, 'likely' for one with such a word in it, else ''."""
    words = [w for w in re.split(r"[-_]+", name) if w and not w.isdigit()]
    if not ASIDE_NAMES & set(words) or {"has", "no", "with", "without", "layout"} & set(words):  # says what the page has
        return ""
    first = next(i for i, w in enumerate(words) if w not in BEFORE_NAMES)
    last = next(i for i in range(first, len(words) + 1) if i == len(words) or words[i] not in ASIDE_NAMES)
    return "sure" if last > first and all(w in AFTER_NAMES for w in words[last:]) else "likely"


class Element:
    """An open element.  What a ``weak`` one holds drops out only if the figures of its host say so."""

    __slots__ = ("name", "symbol", "drop", "weak", "root", "block")

    def __init__(self, name: str, attributes: str, inside_root: bool):
        found = {}
        if attributes and "=" in attributes or "hidden" in attributes:
            for key, value in ATTRIBUTE.findall(attributes):
                found.setdefault(key.lower(), entities.unescape(value.strip("\"'")))
        classes, ids = ([n.lower() for n in found.get(key, "").split()] for key in ("class", "id"))
        names, role = {*classes, *ids}, found.get("role", "").lower()
        self.name, self.block = name, name in BLOCKS
        self.symbol = re.sub(r"\d+", "0", ".".join([name, *sorted(names)]))
        header = name == "header" or bool(HEADER_NAMES & names)
        self.weak = False
        if name in ("html", "body"):
            self.drop = False
        elif name in ROOTS:
            numbered = [n for n in ids if n[-1:].isdigit()]
            self.drop = any(aside_name(n) == "sure" and COMMENT_NAMES & set(re.split(r"[-_]+", n)) for n in [*classes, *numbered])
        else:
            sure = {aside_name(n) for n in classes}
            if not inside_root:
                sure |= {aside_name(n) for n in ids}
            elif name in ID_CARRIERS and "section" not in classes:
                sure |= {"sure" if n in SURE_IDS else aside_name(n) and "likely" for n in ids}
            self.drop = (
                name in ASIDE_TAGS or "sure" in sure or role in ASIDE_ROLES or (header and not inside_root)
                or "hidden" in found or found.get("aria-hidden") == "true"
            )
            self.weak = not self.drop and self.block and name != "p" and "likely" in sure
        self.root = not self.drop and (name in ROOTS or role == "main" or bool(ROOT_NAMES & names))


class Reader:
    """Walks a page's tokens, keeping the open elements."""

    def __init__(self, page: str):
        self.page, self.open = page, []

    def _close(self, at: int) -> None:
        del self.open[at:]

    def _start(self, name: str, attributes: str) -> Element:
        if name in BLOCKS:
            for at in range(len(self.open) - 1, -1, -1):  # an open paragraph ends where a block begins
                if self.open[at].name == "p":
                    self._close(at)
                    break
                if self.open[at].block:
                    break
        if name in CLOSES_ITSELF:
            own, limit = CLOSES_ITSELF[name]
            for at in range(len(self.open) - 1, -1, -1):
                if self.open[at].name in limit:
                    break
                if self.open[at].name in own:
                    self._close(at)
                    break
        return Element(name, attributes, any(e.root for e in self.open))

    def _end(self, name: str) -> bool:
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at].name == name:
                self._close(at)
                return True
            if name not in BLOCKS and self.open[at].block:
                return False
        return False

    def events(self) -> Iterator[tuple[str, object]]:
        """('text', str), ('start', Element) and ('end', name) of the page in order; raw elements and comments are skipped."""
        page, at = self.page, 0
        for token in iter(lambda: TOKEN.search(page, at), None):
            if token.start() > at:
                yield "text", page[at : token.start()]
            at = token.end()
            name = (token[2] or token[5] or "").lower()
            if not name:
                continue
            if token[1] or token[4]:
                self._end(name)
                yield "end", name
            elif name in RAW and not (token[3] or token[6] or "").endswith("/"):
                closing = re.compile(f"</{re.escape(name)}(?=[\\s/>]|\\Z)[^>]*(?:>|\\Z)", re.IGNORECASE).search(page, at)
                at = closing.end() if closing else len(page)
                yield "raw", name
            else:
                element = self._start(name, token[3] or token[6] or "")
                if name in VOID:
                    yield "void", name
                else:
                    self.open.append(element)
                    yield "start", element
        if at < len(page):
            yield "text", page[at:]

    def path(self) -> str:
        return " ".join(e.symbol for e in self.open if e.block and e.name != "p" or e.drop or e.root)

    def role(self) -> str:
        if any(e.drop for e in self.open):
            return "drop"
        return "main" if any(e.root for e in self.open) else "other"

    def slot(self) -> tuple[str, str]:
        """Path and role of the slot; all text of a weak element is one slot."""
        role = self.role()
        if role != "drop":
            for at, e in enumerate(self.open):
                if e.weak:
                    return " ".join(x.symbol for x in self.open[: at + 1] if x.block and x.name != "p" or x.root), "weak"
        return self.path(), role

    def in_link(self) -> bool:
        return any(e.name == "a" for e in self.open)


# A wrapper is a list: strings are tags and '#' text slots, ['+', ...] is a repeated and ['?', ...] an optional group.


def folded(symbols: list[str]) -> list:
    """A stream with equal neighbouring stretches folded into repeated groups."""
    codes: dict[str, str] = {}
    bodies: dict[str, str] = {}
    for s in symbols:
        codes.setdefault(s, chr(0x4E00 + len(codes)))
    line = "".join(codes[s] for s in symbols)
    groups: dict[str, str] = {}

    def group(found: re.Match) -> str:
        body = found[1]
        if len(body) == 1 and body in bodies:
            return body
        if body not in groups:
            groups[body] = chr(0xF0000 + len(groups))
            bodies[groups[body]] = body
        return groups[body]

    for _ in range(6):
        shorter = FOLD.sub(group, line)
        if shorter == line:
            break
        line = shorter
    names = {c: s for s, c in codes.items()}

    def items(text: str) -> list:
        return [["+", *items(bodies[c])] if c in bodies else names[c] for c in text]

    return items(line)


def _same(a, b) -> bool:
    return a == b or (isinstance(a, list) and isinstance(b, list) and a[0] == b[0] == "+" and a[1:2] == b[1:2])


def _once(group: list, items: list, at: int) -> int:
    """How many items from ``at`` are one occurrence of a group's body; 0 if they are not."""
    body = group[1:]
    return len(body) if items[at : at + len(body)] == body else 0


def merged(wrapper: list, page: list) -> list:
    """The wrapper widened so that it takes the page (another wrapper) too."""
    out: list = []
    i = j = 0

    def optional(items: list) -> None:
        for item in items:
            if isinstance(item, list) and item[0] == "?":
                out.append(item)
            elif out and isinstance(out[-1], list) and out[-1][0] == "?" and out[-1][-1:] != [item]:
                out[-1] = [*out[-1], item]
            else:
                out.append(["?", item])

    while i < len(wrapper) and j < len(page):
        w, p = wrapper[i], page[j]
        if w == p:
            out.append(w)
            i, j = i + 1, j + 1
        elif _same(w, p):
            out.append(["+", *merged(w[1:], p[1:])])
            i, j = i + 1, j + 1
        elif isinstance(w, list) and w[0] == "?":
            taken = _once(w, page, j)
            out.append(w)
            i, j = i + 1, j + taken
        elif isinstance(p, list) and p[0] == "?":
            taken = _once(p, wrapper, i)
            out.append(p)
            i, j = i + taken, j + 1
        elif isinstance(w, list) and _once(w, page, j):
            out.append(w)
            i, j = i + 1, j + _once(w, page, j)
        elif isinstance(p, list) and _once(p, wrapper, i):
            out.append(p)
            i, j = i + _once(p, wrapper, i), j + 1
        else:  # the nearest place where both go on alike
            near = min(
                (
                    (a + b, a, b)
                    for a in range(min(NEAR, len(wrapper) - i))
                    for b in range(min(NEAR, len(page) - j))
                    if wrapper[i + a] != "#" and _same(wrapper[i + a], page[j + b])
                ),
                default=None,
            )
            if near is None:
                break
            _, a, b = near
            optional(wrapper[i : i + a])
            optional(page[j : j + b])
            i, j = i + a, j + b
    optional(wrapper[i:])
    optional(page[j:])
    return out


def written(wrapper: list) -> str:
    """A wrapper as a regular expression over tags."""
    return " ".join(
        item if isinstance(item, str) else f"( {written(item[1:])} ){item[0]}" for item in wrapper
    )


def fixed_slots(wrapper: list) -> set[str]:
    """Paths of the text slots that a wrapper holds outside optional groups.

    An element that an optional group opens or closes makes all that stands in it optional.
    """
    fixed: set[str] = set()
    stack: list[tuple[str, str, bool]] = []  # name, symbol, and whether every page has it here

    def close(names: set[str], limit: set[str]) -> None:
        for at in range(len(stack) - 1, -1, -1):
            if stack[at][0] in names:
                del stack[at:]
                return
            if stack[at][0] in limit:
                return

    def walk(items: list, sure: bool) -> None:
        for item in items:
            if isinstance(item, list):
                before = list(stack)
                walk(item[1:], sure and item[0] != "?")
                if item[0] == "?" and stack != before:
                    same = next((i for i, (a, b) in enumerate(zip(stack, before)) if a != b), min(len(stack), len(before)))
                    changed = [x for x in before[same:] if x[2]] + stack[same:]
                    stack[:] = before[:same] + [(name, symbol, False) for name, symbol, _ in changed]
            elif item == "#":
                if sure and all(known for _, _, known in stack):
                    fixed.add(" ".join(symbol for _, symbol, _ in stack))
            elif item[0] == "/":
                close({re.sub(r"\d+", "0", item[1:])}, set())
            else:
                name = item.split(".", 1)[0]
                if name in CLOSES_ITSELF:
                    close(*CLOSES_ITSELF[name])
                if name != "p":
                    stack.append((name, item, sure))

    walk(wrapper, True)
    return fixed


class Knowledge:
    """What is known of one host: pages, wrapper, and figures of its text slots by path."""

    def __init__(self, pages: int = 0, wrapper: list | None = None, slots: dict | None = None):
        self.pages, self.wrapper, self.slots = pages, wrapper, slots or {}
        self.seen: set[tuple] = set()

    def add_page(self, page: str) -> None:
        reader, symbols, texts = Reader(page), [], {}
        for kind, what in reader.events():
            if kind == "text":
                if what.strip():
                    if symbols[-1:] != ["#"]:
                        symbols.append("#")
                    parts = texts.setdefault(reader.slot(), ["", 0])
                    parts[0] += " " + what
                    parts[1] += len(what) if reader.in_link() else 0
            elif kind == "start" and what.block:
                symbols.append(what.symbol)
            elif kind == "end" and what in BLOCKS:
                symbols.append("/" + what)
        found = {}
        for (path, role), (text, linked) in texts.items():
            digest = hashlib.blake2b(" ".join(text.split()).encode("utf-8", "replace"), digest_size=12).hexdigest()
            found[path] = [1, role, digest, len(text), linked, []]
        # Copies of one page count once, whatever their markup.
        whole = hashlib.blake2b(json.dumps([(path, slot[2]) for path, slot in found.items()]).encode("utf-8", "replace"), digest_size=8).hexdigest()
        for slot in found.values():
            if slot[1] in ("other", "weak"):
                slot[5] = [whole]
        # Streams that were met before teach the wrapper nothing, nor do pages without text.
        key = tuple(symbols)
        if key in self.seen or not found:
            self._take(1, None, found)
        else:
            if len(self.seen) < 5000:
                self.seen.add(key)
            self._take(1, folded(symbols), found)

    def _take(self, pages: int, wrapper: list | None, slots: dict) -> None:
        self.pages += pages
        if wrapper is not None and wrapper != self.wrapper:
            self.wrapper = wrapper if self.wrapper is None else merged(self.wrapper, wrapper)
        for path, (n, role, text, chars, linked, wholes) in slots.items():
            own = self.slots.setdefault(path, [0, role, text, 0, 0, []])
            own[0] += n
            own[2] = text if own[2] == text else None
            own[3] += chars
            own[4] += linked
            if wholes and own[2] is None:
                own[5] = []
            elif wholes and len(own[5]) < CONSTANT_PAGES:
                own[5] = sorted({*own[5], *wholes})[:CONSTANT_PAGES]

    def absorb(self, other: Knowledge) -> None:
        self._take(other.pages, other.wrapper, other.slots)

    def roles(self) -> dict[str, str]:
        """Role by path: other and weak slots drop out if they are links, or stand on a fixed place of the wrapper and never change.

        The same text on an optional place may be a story that is printed again; it stays.
        """
        out, fixed = {}, fixed_slots(self.wrapper or [])
        holders = {path[:at] for path in fixed for at, c in enumerate(path + " ") if c == " "}
        for path, (_, role, text, chars, linked, wholes) in self.slots.items():
            if role in ("other", "weak"):
                constant = text is not None and len(wholes) >= CONSTANT_PAGES
                if linked > LINK_SHARE * chars or (constant and path in (fixed if role == "other" else holders)):
                    role = "drop"
            out[path] = role
        return out

    def dump(self) -> str:
        return json.dumps([self.pages, self.wrapper, self.slots])

    @classmethod
    def load(cls, text: str) -> Knowledge:
        return cls(*json.loads(text))


def host_of(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId() % SPREAD
    held: dict[str, Knowledge] = {}

    def give() -> pa.RecordBatch:
        rows = [(host, part, k.pages, k.dump()) for host, k in held.items()]
        held.clear()
        return pa.RecordBatch.from_pylist(
            [dict(zip(("host", "part", "pages", "known"), r)) for r in rows],
            pa.schema([("host", pa.string()), ("part", pa.int32()), ("pages", pa.int64()), ("known", pa.string())]),
        )

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.setdefault(host, Knowledge()).add_page(page)
            if len(held) > HOSTS_HELD:
                yield give()
    if held:
        yield give()


def _join_known(frame: pd.DataFrame) -> Knowledge:
    rows = sorted(frame["known"])
    known = Knowledge.load(rows[0])
    for row in rows[1:]:
        known.absorb(Knowledge.load(row))
    return known


def _per_part(frame: pd.DataFrame) -> pd.DataFrame:
    known = _join_known(frame)
    return pd.DataFrame([(frame["host"].iloc[0], known.pages, known.dump())], columns=["host", "pages", "known"])


def _per_host(frame: pd.DataFrame) -> pd.DataFrame:
    known = _join_known(frame)
    return pd.DataFrame(
        [(frame["host"].iloc[0], known.pages, written(known.wrapper or []), json.dumps(known.roles()))],
        columns=["host", "pages", "wrapper", "roles"],
    )


def wrappers(pages: DataFrame) -> DataFrame:
    """One row per host: pages, wrapper (expression over block tags, # is a text slot) and roles (JSON, by slot path)."""
    streams = pages.select(host_of().alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    parts = streams.mapInArrow(_learn, "host string, part int, pages long, known string")
    spread = parts.groupBy("host", "part").applyInPandas(_per_part, "host string, pages long, known string")
    return spread.groupBy("host").applyInPandas(_per_host, "host string, pages long, wrapper string, roles string")


def main_text(page: str, roles: dict[str, str]) -> str:
    """Blocks of a page's main slots, or of its other slots if it has no main text, one per line."""
    reader = Reader(page)
    found: dict[str, list[list[str]]] = {"main": [[]], "other": [[]]}

    def cut() -> None:
        for blocks in found.values():
            if blocks[-1]:
                blocks.append([])

    for kind, what in reader.events():
        if kind == "text":
            role = reader.role()
            if role == "other" or role == "main" and any(e.weak for e in reader.open):
                role = "drop" if roles.get(reader.slot()[0]) == "drop" else role
            if role != "drop":
                found[role][-1].append(what)
        elif kind == "start" and what.block or kind == "end" and what in BLOCKS or kind == "void" and what == "hr":
            cut()
        elif kind == "void" and what == "br":
            for blocks in found.values():
                blocks[-1].append("\n")
    for blocks in found.values():
        lines = [" ".join(entities.unescape("".join(b)).split()) for b in blocks]
        text = "\n".join(line for line in lines if line)
        if text:
            return text
    return ""


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    known: dict[str | None, dict] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            ids, urls, pages, roles = (c.to_pylist() for c in batch.slice(at, 1000).columns)
            texts = []
            for page, role in zip(pages, roles):
                if role not in known:
                    if len(known) > HOSTS_HELD:
                        known.clear()
                    known[role] = json.loads(role or "{}")
                # A lone surrogate written as a reference has no UTF-8 form.
                texts.append(main_text(page, known[role]).encode("utf-8", "replace").decode())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip((ids, urls, texts, [len(t) for t in texts]), schema)], schema=schema
            )


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars; a row per row of ``pages`` (page_id, url, html).

    Text inside article or main elements (or what is named like them) counts, without menus, headers, footers, sidebars, notices,
    adverts, forms, scripts, styles and comments, known by element, role or a class or id that as a whole names one; an element with
    such a word in a longer name (and inside a root any but a few ids, of lists and divisions only) drops out if its text is
    links or stays the same as told below.  A page without such an element gives what is left of its body, less slots of links and
    of text that stays the same over at least CONSTANT_PAGES pages of the host that differ elsewhere (copies count once) and stands on a fixed place of the
    host's wrapper, that is on all its pages; on an optional place it stays.  White space within a block becomes one space, blocks are joined by
    a line feed, a line break inside a block is white space.  Null html is empty and gives an empty text; pages with a
    null or odd url form one host; repeated rows and null ids are rows like any other; an empty table gives no rows.
    """
    found = stored(wrappers(pages), "wrappers")
    named = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host_of().alias("host"),
    )
    total = found.agg(F.sum("pages")).first()[0] or 0
    rows = lookup_groups(named, found.select("host", "pages", "roles"), ["host"], "pages", total)
    return rows.select("page_id", "url", "html", "roles").mapInArrow(_extracted, PAGE_TEXT)
