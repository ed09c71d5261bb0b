"""Main text of web pages with a site style tree.

Pass 1 merges the DOMs of a host: an element is placed by its path of tags and classes, and
for every path the pages' child layouts (presentation) and texts (content) are counted. The
entropy of each count, in units of its largest possible value, is the importance of the
node; a branch takes ``PRESENTATION`` of its value from its own layouts and the rest from
the texts below it. What looks the same on page after page has an importance near 0.

Pass 2 reads the pages again and drops branches of low importance, together with elements
whose tag, role or class says that they are not content (menus, adverts, forms, reader
comments and so on, a fixed vocabulary below). Names that deny or lay out (``no-comments``,
``has-sidebar``, ``alert-free``) say nothing, and an element with at least ``MOST`` of the page's
text that holds the headline, the article mark, or is itself named as content is its
container, whatever its other names. When a page marks its article or main
element, text outside it is dropped too. Text inside it, branches seen on fewer than
``MIN_PAGES`` pages of a host, and branches with more than half of the host's text, are never
dropped by entropy. Pages of a host whose text is the same by the vocabulary alone count as
one page, so copies of an article do not pass for template.

Counts are rows of (host, body, path), then of (host, path, digest), with partial aggregation, so a host with a third of
all pages is spread over all tasks; only the paths to drop come back per host. They are
broadcast when a measured bound allows, else joined under salts.

Blocks: block elements and line breaks end a block; character references are decoded, white
space inside a block becomes one space, blocks are joined by one line feed in page order.

Edge cases: null or empty html gives an empty text; a page without a host is extracted by
the vocabulary alone; unclosed elements end with their parent; markup of any length is
read whole; repeated rows are separate rows.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionlake.session import settle, ship_package

PRESENTATION = 0.1
LOW_IMPORTANCE = 0.3
MIN_PAGES = 8
#: Share of a page's text that makes an element its container.
MOST = 0.5
#: Paths to drop, over all hosts, up to which they are broadcast (8 bytes each).
BROADCAST_PATHS = 1_000_000
SALTS = 32

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|itemprop|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody"
    " td tfoot th thead tr ul br head".split()
)
#: Elements that end an open paragraph when they begin.
ENDS_PARAGRAPH = BLOCKS - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body", "head"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "article", "section", "div", "body", "select", "main", "aside", "nav"}
#: Vocabulary of page parts that are not the article.
NOISE_TAGS = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "object", "canvas", "audio", "video"}
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu", "menubar"}
NOISE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner"
    " cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription"
    " signup signin login sidebar side widget widgets related recommended recommendations recommend share sharing social"
    " comment comments commentlist respond reply replies disqus discussion breadcrumb breadcrumbs menu menus nav navbar"
    " navigation pagination pager footer masthead topbar toolbar search searchform skip hidden print copyright legal"
    " disclaimer taboola outbrain teaser teasers alert".split()
)
HEADER_WORDS = {"header", "masthead", "topbar", "siteheader"}
#: Names of containers, and parts of a name that deny it or speak of layout.
CONTENT_WORDS = {"article", "body", "content", "entry", "main", "page", "post", "story", "text", "wrapper", "container"}
DENYING_FIRST = {"no", "not", "non", "has", "have", "with", "without", "hide", "hides"}
DENYING_LAST = {"free", "less", "off", "none", "disabled", "closed"}
MAIN_TAGS = {"article", "main"}


#: What names say against an element: nothing, a header unless inside the article, not content, not shown.
FINE, HEADER, NAMED, HIDDEN = range(4)


class _Page:
    """Elements of a page in order of opening, and its texts and block ends.

    Per element: parent, path, what its names say against it, whether it marks the article,
    whether it is named as content, and whether it is a headline. ``events`` are pairs of an
    element and a text, or None where a block ends.
    """

    def __init__(self):
        self.parent, self.path, self.flag = [-1], [1], [FINE]
        self.mark, self.good, self.head = [False], [False], [False]
        self.layouts: list[tuple[int, int]] = []
        self.events: list[tuple[int, str | None]] = []

    def roles(self) -> tuple[list[bool], list[bool]]:
        """Per element: is it noise, is it part of the marked article."""
        n = len(self.parent)
        held, headed = [0] * n, list(self.head)
        for e, text in self.events:
            if text:
                held[e] += len(text) - text.count(" ")
        for e in range(n - 1, 0, -1):
            held[self.parent[e]] += held[e]
            # A headline or an article mark speaks for all elements around it.
            if headed[e] or self.mark[e] and self.flag[e] == FINE:
                headed[self.parent[e]] = True
        noise, main = [False] * n, [False] * n
        for e in range(1, n):
            above, flag = self.parent[e], self.flag[e]
            against = flag >= NAMED or flag == HEADER and not main[above]
            if against and flag != HIDDEN and (headed[e] or self.good[e] or self.mark[e]) and held[e] >= MOST * held[0]:
                against = False
            noise[e] = noise[above] or against
            main[e] = main[above] or self.mark[e] and not noise[e]
        return noise, main


def _says_noise(compounds: list[list[str]]) -> bool:
    for parts in compounds:
        if not NOISE_WORDS.isdisjoint(parts) and parts[0] not in DENYING_FIRST and parts[-1] not in DENYING_LAST:
            return True
    return False


def _flag(tag: str, compounds: list[list[str]], role: str, hidden: bool) -> int:
    """What the names of an element say against it."""
    if hidden:
        return HIDDEN
    if tag in NOISE_TAGS or role in NOISE_ROLES or tag not in ("body", "html") and _says_noise(compounds):
        return NAMED
    if tag == "header" or any(not HEADER_WORDS.isdisjoint(c) for c in compounds):
        return HEADER
    return FINE


def walk(page: str) -> _Page:
    """Elements, texts and block ends of a page."""
    out = _Page()
    stack: list[tuple[str, int]] = [("", 0)]

    def on_text(text):
        out.events.append((stack[-1][1], text))

    at, end = 0, len(page)
    find = TAG.search
    while at < end:
        tag = find(page, at)
        stop = tag.start() if tag else end
        if stop > at:
            on_text(page[at:stop])
        if not tag:
            return out
        at = tag.end()
        closing, name, rest = (tag[1], tag[2], tag[3]) if tag[2] else (tag[4], tag[5], tag[6])
        if not name:
            continue
        name = name.lower()
        block = name in BLOCKS
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    if block or any(t in BLOCKS for t, _ in stack[k:]):
                        on_text(None)
                    del stack[k:]
                    break
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if block:
            on_text(None)
        if name in ENDS_PARAGRAPH:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] in SCOPES:
                    break
        if name in SIBLINGS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in SIBLINGS[name]:
                    del stack[k:]
                    break
                if stack[k][0] in SCOPES:
                    break
        if name in VOID or rest.endswith("/") and not block:
            continue
        compounds, role, hidden, main_role = [], "", False, False
        if rest:
            for key, value in ATTRIBUTE.findall(rest):
                key, value = key.lower(), value.strip("\"'")
                if key in ("class", "id"):
                    found = ([w for w in SPLIT.split(c.lower()) if w] for c in value.split())
                    compounds += [c for c in found if c]
                elif key == "role":
                    role = value.lower()
                elif key == "itemprop":
                    main_role |= value == "articleBody"
                elif key == "hidden":
                    hidden = True
                elif key == "aria-hidden":
                    hidden |= value.lower() == "true"
                else:
                    hidden |= "display:none" in value.replace(" ", "").lower()
        above = stack[-1][1]
        label = zlib.crc32(" ".join([name, *[w for c in compounds for w in c if not w.isdigit()]]).encode())
        out.layouts.append((above, label))
        stack.append((name, len(out.parent)))
        out.parent.append(above)
        out.path.append((out.path[above] * 1000003 ^ label) & 0x7FFFFFFFFFFFFFFF)
        out.flag.append(_flag(name, compounds, role, hidden))
        out.mark.append(name in MAIN_TAGS or role == "main" or main_role)
        out.good.append(any(not CONTENT_WORDS.isdisjoint(c) and NOISE_WORDS.isdisjoint(c) for c in compounds))
        out.head.append(name == "h1")
    return out


def _digest(text: str) -> int:
    raw = text.encode()
    return zlib.crc32(raw) << 31 ^ zlib.adler32(raw)


def _style_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, html) to (host, body, path, kind, digest, characters), one per body, path and kind."""
    for batch in batches:
        rows: dict[tuple, tuple[int, int]] = {}
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            texts: dict[int, list[str]] = defaultdict(list)
            layouts: dict[int, list[int]] = defaultdict(list)
            inside: list[str] = []
            outside: list[str] = []
            tree = walk(page)
            noise, main = tree.roles()
            lines: list[tuple[int, ...]] = [(tree.path[0],)]
            for e in range(1, len(tree.parent)):
                up = lines[tree.parent[e]]
                lines.append(up if tree.path[e] in up else (*up, tree.path[e]))
            for above, label in tree.layouts:
                layouts[tree.path[above]].append(label)
            for e, text in tree.events:
                if text and not text.isspace():
                    for path in lines[e]:
                        texts[path].append(text)
                    if not noise[e]:
                        (inside if main[e] else outside).append(text)
            body = _digest(" ".join(" ".join(inside or outside).split()))
            for path, parts in texts.items():
                text = " ".join("".join(parts).split())
                # A layout is the set of child styles: repeated paragraphs are one style.
                layout = _digest(str(sorted(set(layouts.get(path, ())))))
                for kind, found in enumerate(((_digest(text), len(text)), (layout, 0))):
                    key = host, body, path, kind
                    rows[key] = min(found, rows.get(key, found))
        keys = list(zip(*rows)) or [()] * 4
        digests, chars = zip(*rows.values()) if rows else ((), ())
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        arrays = [pa.array(x, kind) for x, kind in zip((*keys, digests, chars), kinds)]
        yield pa.RecordBatch.from_arrays(arrays, names=["host", "body", "path", "kind", "digest", "chars"])


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def style_tree(pages: DataFrame) -> DataFrame:
    """``host, path, pages, chars, importance`` of every node of every host's tree."""
    ship_package(pages.sparkSession)
    read = pages.select(host_of(F.col("url")).alias("host"), "html").where("host <> '' AND html <> ''")
    schema = "host string, body bigint, path bigint, kind int, digest bigint, chars bigint"
    seen = read.mapInArrow(_style_rows, schema)
    once = seen.groupBy("host", "body", "path", "kind").agg(F.min(F.struct("digest", "chars")).alias("d")).select("host", "path", "kind", "d.*")
    styles = once.groupBy("host", "path", "kind", "digest").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
    nodes = styles.groupBy("host", "path", "kind").agg(
        F.sum("n").alias("pages"), F.sum("chars").alias("chars"), F.sum(F.col("n") * F.log("n")).alias("s")
    )
    entropy = F.when(F.col("pages") > 1, 1 - F.col("s") / F.col("pages") / F.log("pages")).otherwise(1.0)
    weight = F.when(F.col("kind") == 1, PRESENTATION).otherwise(1 - PRESENTATION)
    return nodes.groupBy("host", "path").agg(
        F.max("pages").alias("pages"), F.sum("chars").alias("chars"), F.sum(entropy * weight).alias("importance")
    )


def branches_to_drop(tree: DataFrame) -> DataFrame:
    """Per host the sorted paths of low importance."""
    whole = tree.groupBy("host").agg(F.max("chars").alias("whole"))
    low = tree.where((F.col("pages") >= MIN_PAGES) & (F.col("importance") < LOW_IMPORTANCE))
    return (
        low.join(whole, "host")
        .where(2 * F.col("chars") <= F.col("whole"))
        .groupBy("host")
        .agg(F.array_sort(F.collect_set("path")).alias("drop"))
    )


def main_text(page: str | None, drop: set[int] | frozenset = frozenset()) -> str:
    """The article of one page, given the paths its host repeats."""
    if not page:
        return ""
    inside: list[str] = []
    outside: list[str] = []
    part: list[str] = []
    in_main = False

    def flush():
        if part:
            text = " ".join(entities.unescape("".join(part)).split())
            part.clear()
            if text:
                outside.append(text)
                if in_main:
                    inside.append(text)

    tree = walk(page)
    noise, main = tree.roles()
    dropped = [False] * len(tree.parent)
    for e in range(1, len(tree.parent)):
        dropped[e] = dropped[tree.parent[e]] or tree.path[e] in drop
    for e, text in tree.events:
        if text is None:
            flush()
            continue
        if noise[e] or dropped[e] and not main[e]:
            continue
        if main[e] != in_main:
            if part and not "".join(part).isspace():
                flush()
            part.clear()
            in_main = main[e]
        part.append(text)
    flush()
    return "\n".join(inside or outside)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [
            main_text(page, frozenset(drop or ()))
            for page, drop in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    drop = settle(branches_to_drop(style_tree(pages)))
    paths = drop.agg(F.coalesce(F.sum(F.size("drop")), F.lit(0))).first()[0]
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    if paths <= BROADCAST_PATHS:
        joined = rows.join(F.broadcast(drop), "host", "left")
    else:
        salted = drop.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(
            salted, ["host", "salt"], "left"
        )
    plain = joined.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "html", "drop")
    return plain.mapInArrow(_texts, "page_id bigint, url string, text string, n_chars bigint")
