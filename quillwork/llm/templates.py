"""Main text of web pages by deducing the template of same-host pages.

The pages of a host are cut into groups of bounded size. In a group every tag is a
token, told apart by the containers it stands in. Tokens with the same vector of
occurrences over the pages form an equivalence class; a class is valid if its tokens
keep one order in all pages and do not interleave with the classes around it. The
valid classes that occur at most once a page make up the skeleton of the template;
tokens that repeat within a page make no slots of their own. What lies between skeleton
tokens is a slot; a slot gets a role from its containers and from how its text varies
between pages, and the text of the main slots is extracted. Where pages have an article
element, element names and class words say what is in it, and slots only take out of it
what stands on many different pages.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.session import materialise

GROUP_PAGES = 128  # different pages, about, whose template is deduced together
SUPPORT = 0.5  # share of pages a skeleton class occurs in
NOTICE_PAGES = 10  # different pages on which a slot of the article has one text, if that is a notice

# Names of HTML elements and of usual page parts.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
CONTAINERS = frozenset(
    "html head body div section article main nav header footer aside form ul ol dl table figure blockquote dialog menu "
    "details fieldset center".split()
)
RAW = frozenset("script style title textarea".split())  # without an end tag they go to the end of the page
SKIPPED = frozenset("iframe xmp noembed noframes template svg select button".split())
FALLBACK = frozenset("noscript math object canvas audio video".split())  # skipped outside articles
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SIDE_ELEMENTS = frozenset("head nav header footer aside form dialog menu".split())
MAIN_ELEMENTS = frozenset("article main".split())
SIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored nav navbar navigation "
    "menu menus breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget widgets related recommended "
    "recommendations share sharing social comment comments commentlist disqus reply replies respond cookie cookies "
    "consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login "
    "search searchbox form pagination pager skip toolbar copyright".split()
)
# what stays aside whatever it holds, and what says nothing inside an article
APART_WORDS = frozenset("comment comments commentlist disqus reply replies respond related recommended recommendations".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond list".split())
HEAD_WORDS = frozenset("header masthead topbar".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar".split())

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
MARK = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I | re.S)
WORD = re.compile(r"[a-z]+|\d+", re.I)


@dataclass(frozen=True)
class Piece:
    """A tag (`token` not empty) or a run of text, with the containers it stands in."""

    token: str
    text: str
    path: tuple[str, ...]
    breaks: bool = False


def _side(name: str, rest: str, inside: bool) -> str:
    """"--" if the element stays aside whatever it holds, "-" if it does unless it holds an article, else "".

    Its name, class, id and role are asked; `inside` says that it is in an article.
    """
    side = ""
    if name in SIDE_ELEMENTS and not (name == "header" and inside):
        side = "-" if name == "header" else "--"
    for key, *values in MARK.findall(rest) if "=" in rest else ():
        value = next((v for v in values if v), "").lower()
        if key.lower() == "role" and value in SIDE_ROLES:
            side = side or "-"
        if key.lower() in ("class", "id") and name not in ("html", "body"):
            words = set(WORD.findall(value))
            if name in MAIN_ELEMENTS:
                # a post may say "comments-open"; only a class that is nothing but a comment's counts
                whole = (set(WORD.findall(c)) for c in value.split())
                if any(w and w <= COMMENT_WORDS and w & APART_WORDS for w in whole):
                    return "--"
            elif words & APART_WORDS:
                return "--"
            if name not in MAIN_ELEMENTS and words & (SIDE_WORDS - HEAD_WORDS if inside else SIDE_WORDS):
                side = side or "-"
    return side


def _in_article(path: tuple[str, ...]) -> bool:
    return any(label[0] == "+" for label in path)


def _aside(path: tuple[str, ...]) -> bool:
    """Whether something on the path keeps the text out; an article inside a merely suspicious container does not care."""
    weak = False
    for label in path:
        if label.startswith("--"):
            return True
        weak = label[0] == "-" or (weak and label[0] != "+")
    return weak


def _main(name: str, rest: str) -> bool:
    return name in MAIN_ELEMENTS or any(
        (k.lower() == "role" and "main" in v) or (k.lower() == "itemprop" and "articleBody" in v) for k, *v in MARK.findall(rest)
    )


def pieces_of(page: str) -> list[Piece]:
    """Tags and text of a page, in order, without comments and without what is inside raw or skipped elements.

    Open elements that were never closed end with what encloses them; end tags
    without a start are ignored.
    """
    out: list[Piece] = []
    stack: list[tuple[str, str]] = []  # (element, label in the path)
    path: tuple[str, ...] = ()
    at = 0
    while True:
        m = MARKUP.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            out.append(Piece("", text, path))
        if not m:
            return out
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        if m["end"]:
            if any(e == name for e, _ in stack):
                if name in CONTAINERS:
                    out.append(Piece(f"/{name}", "", path))
                while stack.pop()[0] != name:
                    pass
                path = tuple(label for _, label in stack)
            if name not in INLINE:
                out.append(Piece("", "", path, True))
            continue
        rest = m["rest"] or ""
        if name in RAW and not rest.endswith("/"):
            close = re.compile(f"</{name}[^>]*(?:>|\\Z)", re.I).search(page, at)
            at = close.end() if close else len(page)
            if name == "textarea":
                out.append(Piece("", "", path, True))
            continue
        if (name in SKIPPED or name in FALLBACK and not _in_article(path)) and not rest.endswith("/"):
            out.append(Piece("", "", path, True))
            close = re.compile(f"<(/?){name}\\b[^>]*(?:>|\\Z)", re.I).search(page, at)
            if close and close[1]:
                at = close.end()
            else:
                # without an end tag of its own it ends with the next block or with what encloses it
                stack.append((name, f"--{name}"))
                path = tuple(label for _, label in stack)
            continue
        if name not in INLINE:
            # a paragraph or item ends where the next block starts
            while stack and stack[-1][0] not in CONTAINERS and name not in VOID:
                if stack[-1][0] in INLINE:
                    break
                stack.pop()
            path = tuple(label for _, label in stack)
            out.append(Piece("", "", path, True))
        if name in VOID:
            continue
        mark = _side(name, rest, _in_article(path))
        if name in CONTAINERS or mark:
            mark = mark or ("+" if _main(name, rest) else "")
            out.append(Piece(f"{mark}{name}", "", path))
            stack.append((name, f"{mark}{name}"))
            path = tuple(label for _, label in stack)
        elif name in ("p", "b"):
            out.append(Piece(name, "", path))


def skeleton(pages: list[list[Piece]]) -> list[tuple]:
    """Tokens of the valid classes that occur at most once a page, in template order."""
    counts: dict[tuple, dict[int, int]] = defaultdict(dict)
    places: dict[tuple, dict[int, int]] = defaultdict(dict)
    for n, page in enumerate(pages):
        for i, piece in enumerate(page):
            if piece.token:
                token = (piece.token, piece.path)
                counts[token][n] = counts[token].get(n, 0) + 1
                places[token].setdefault(n, i)
    classes: dict[tuple, list[tuple]] = defaultdict(list)
    for token, vector in counts.items():
        classes[tuple(sorted(vector.items()))].append(token)
    kept: list[tuple] = []
    # the best supported classes first; each must keep one order with what is there already
    for vector, tokens in sorted(classes.items(), key=lambda c: (-len(c[0]), c[0])):
        if len(vector) < SUPPORT * len(pages) or any(n > 1 for _, n in vector):
            continue
        for token in sorted(tokens, key=lambda t: min(places[t].items())):
            at = _place(kept, token, places)
            if at is not None:
                kept.insert(at, token)
    return kept


def _place(kept: list[tuple], token: tuple, places: dict) -> int | None:
    """Where `token` goes among the ordered tokens, or None if its pages disagree."""
    low, high = 0, len(kept)
    for n, i in places[token].items():
        before = after = None
        for k, other in enumerate(kept):
            j = places[other].get(n)
            if j is not None:
                if j < i:
                    before = k + 1
                elif after is None:
                    after = k
        low = max(low, before or 0)
        high = min(high, len(kept) if after is None else after)
    return low if low <= high else None


def slots_of(page: list[Piece], order: dict[tuple, int]) -> list[int]:
    """Slot of every piece: the number of the last skeleton token before it, -1 at first."""
    out, slot = [], -1
    for piece in page:
        if piece.token:
            slot = order.get((piece.token, piece.path), slot)
        out.append(slot)
    return out


def blocks_of(page: list[Piece], keep: list[bool]) -> str:
    """Kept text, white space made one blank, one line per block."""
    blocks, run = [], []
    for piece, kept in zip(page, keep, strict=True):
        if piece.breaks or piece.token and piece.token.lstrip("+-/") not in INLINE:
            blocks.append("".join(run))
            run = []
        if piece.text and kept:
            run.append(piece.text)
        elif piece.text and run and piece.text.strip():
            blocks.append("".join(run))
            run = []
    blocks.append("".join(run))
    clean = (" ".join(html.unescape(b).split()) for b in blocks)
    return "\n".join(b for b in clean if b)


def extract_group(pages: list[str | None]) -> list[str]:
    """Main text of pages of one host, by their common template. Equal pages are one."""
    distinct = list(dict.fromkeys(p or "" for p in pages))
    texts = dict(zip(distinct, _extract(distinct), strict=True))
    return [texts[p or ""] for p in pages]


def _extract(pages: list[str]) -> list[str]:
    parsed = [pieces_of(p) for p in pages]
    order = {token: k for k, token in enumerate(skeleton(parsed))}
    slots = [slots_of(page, order) for page in parsed]
    # text of each slot by page, and of its part in the article, and whether a main container or a side container holds it
    main: Counter = Counter()
    seen: dict[int, Counter] = defaultdict(Counter)
    told: dict[int, Counter] = defaultdict(Counter)
    own_told: list[dict[int, str]] = []
    for page, own in zip(parsed, slots, strict=True):
        texts: dict[int, list[str]] = defaultdict(list)
        article: dict[int, list[str]] = defaultdict(list)
        for piece, slot in zip(page, own, strict=True):
            if piece.text and not piece.text.isspace() and not _aside(piece.path):
                texts[slot].append(piece.text)
                if _in_article(piece.path):
                    main[slot] += 1
                    article[slot].append(" ".join(piece.text.split()))
        for slot, parts in texts.items():
            seen[slot]["\0".join(parts)] += 1
        own_told.append({slot: "\0".join(parts) for slot, parts in article.items()})
        for slot, said in own_told[-1].items():
            told[slot][said] += 1
    main_slots = {slot for slot, n in main.items() if n}
    # without an article element: slots whose text differs between pages
    other = {s for s, texts in seen.items() if len(parsed) == 1 or sum(texts.values()) < 2 or len(texts) > 1}
    # inside articles: one text on many different pages, and on most of those that have the slot
    notices = {
        (slot, said) for slot, texts in told.items() for said, n in texts.items()
        if n >= NOTICE_PAGES and n > SUPPORT * sum(texts.values())
    }
    out = []
    for page, own, said in zip(parsed, slots, own_told, strict=True):
        marked = any(piece.token[:1] == "+" for piece in page)
        # an article that is nothing but notices stays
        wanted = main_slots - {slot for slot in said if (slot, said[slot]) in notices} if marked else other
        if marked and not wanted & said.keys():
            wanted = main_slots
        if not marked:
            # where nothing varies, the slot with most text
            sizes = Counter()
            for piece, slot in zip(page, own, strict=True):
                if not _aside(piece.path):
                    sizes[slot] += len("".join(piece.text.split()))
            if sizes and not any(sizes[slot] for slot in other):
                wanted = {max(sizes, key=lambda slot: (sizes[slot], -slot))}
        keep = [
            slot in wanted and not _aside(piece.path) and (not marked or _in_article(piece.path))
            for piece, slot in zip(page, own, strict=True)
        ]
        out.append(blocks_of(page, keep))
    return out


def host_of(url):
    """Host of a URL column, lower case; empty for null and for what has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def extract_main_text(
    df: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", group_pages: int = GROUP_PAGES
) -> DataFrame:
    """(key, url, text, n_chars) of every row.

    The different pages of a host are counted, and dealt by a hash of the page into
    groups of about `group_pages`, so which pages judge each other follows from the
    pages of the host alone. Equal pages meet in one group and count once; of them a
    task holds one at a time. A null page is empty; an empty page has an empty text.
    Pages without a host are grouped with each other. Rows that repeat a key are pages
    of their own. Other columns are left out.
    """
    rows = df.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{page}`").cast("string").alias("page")
    ).withColumn("host", host_of(F.col("url")))
    rows = rows.withColumn("mix", F.xxhash64(F.coalesce("page", F.lit(""))))
    groups = F.ceil(F.count("*") / F.lit(group_pages)).alias("groups")
    large = rows.select("host", "mix").distinct().groupBy("host").agg(groups).where("groups > 1")
    # written first, so that Spark knows its size
    dealt = rows.join(materialise(large), "host", "left").withColumn("part", F.pmod("mix", F.coalesce("groups", F.lit(1))))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "url", "text", "n_chars"]
        held: list[tuple[pa.RecordBatch, list[int]]] = []  # keys and URLs of the open group, and their pages
        pages: list[str] = []  # different pages of it
        group = last = None

        def flush() -> Iterator[pa.RecordBatch]:
            texts = extract_group(pages)
            for rows, at in held:
                own = [texts[i] for i in at]
                columns = [rows.column(0), rows.column(1), pa.array(own, pa.string()), pa.array(list(map(len, own)), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            hosts, parts, mixes = (batch.column(i).to_pylist() for i in (3, 4, 5))
            column = batch.column(2)
            begin, at = 0, []
            for i, own in enumerate(zip(hosts, parts, strict=True)):
                if own != group:
                    if at:
                        held.append((batch.slice(begin, i - begin), at))
                    if held:
                        yield from flush()
                    held, pages, begin, at, group, last = [], [], i, [], own, None
                if mixes[i] != last:
                    pages.append(column[i].as_py() or "")
                    last = mixes[i]
                at.append(len(pages) - 1)
            if at:
                rest = batch.slice(begin)
                keys = pa.Table.from_batches([rest]).select(["key", "url"]).take(pa.array(range(rest.num_rows)))
                held.append((keys.combine_chunks().to_batches()[0], at))  # a copy, without the pages
        if held:
            yield from flush()

    ordered = dealt.repartition("host", "part").sortWithinPartitions("host", "part", "mix")
    out = ordered.select("key", "url", "page", "host", "part", "mix").mapInArrow(run, f"key {kind}, url string, text string, n_chars long")
    return out.select(F.col("key").alias(key), F.col("url").alias(url), "text", "n_chars")
