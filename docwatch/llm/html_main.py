"""HTML extraction by nearest-URL page differencing.

1. Each page is split into text lines (a line is the text of one block element) in one pass; scripts, styles, comments and other
   non-text are dropped and character references decoded. A line keeps where it stood: inside the article
   container, inside a container that says it is page furniture (menus, headers, footers, asides, forms,
   notices, adverts, reader comments), or neither.
2. The addresses (host, URL path and query) are sorted in range partitions (a busy host spans many of them), and each page is
   paired with its neighbour: the nearest earlier address of the host with other lines, else the nearest later one. Of an address
   with several versions, the one of least hash stands for it. Lines travel as 64-bit hashes.
3. The two pages' lines are aligned by their longest common subsequence; lines that are aligned on both sides (the nearest earlier and the nearest later
   address with other lines; on one, where there is only one) and that three pages of the host hold (all, if it has fewer) are
   the site's and deleted. What remains outside furniture is the text. A single neighbour with seven tenths of the page's letters is a mirrored page and no evidence. Where the page marks an article container, its text is
   the lines of the container, and differencing deletes from them what the neighbours on both sides share at the container's ends, where at least half of the host's pages hold the line: the sign-up box or link list that a
   site puts above or below each article. Other lines inside an article stay, as quotes and licence lines repeat between neighbours, too; and
   a neighbour that shares half of the container is a mirrored article and no evidence.

Results: null or empty html gives an empty text; a page without a neighbour is taken as it is; a null or odd
URL counts as a host of its own; repeated pages each get a row and the same text (a page with the same address or the same
lines is no evidence and is passed over). Extra columns are ignored.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docwatch.llm.common import cut, if_small

#: Elements of HTML by their role here.
RAW = "script|style|template|textarea|iframe|title"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
FURNITURE = frozenset("nav header footer aside form menu dialog select button noscript svg math object".split())
CLOSES_P = BLOCK - {"body", "html"}
_NAMES = (
    r"ads?|adverts?|advertisement|advertising|adsbygoogle|sponsor(?:ed)?|promo(?:tion)?s?|banner|nav|navbar|navigation|menu|breadcrumbs?|side-?bar|footer|cookies?|consent|notices?|newsletter"
    r"|subscribe|related|share|sharing|social|comments?|disqus|replies|popup|modal|pagination|pager|widgets?|toolbar|login|signup|search"
)
_PART = r"(?:[-_](?:box|bar|list|area|section|block|container|wrapper|banner|menu|nav|links|thread|form|\d+))?"
_NAMED = re.compile(rf"(?:[a-z0-9]+[-_])?(?:{_NAMES}){_PART}", re.I)
_HEADER = re.compile(rf"(?:(?:site|page|top|main|global)[-_])?(?:header|masthead){_PART}", re.I)
_FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<![^>]*+>|<\?[^>]*+>|<(?P<raw>{RAW})(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>(?:(?!</(?P=raw)).)*+(?:</(?P=raw)[^>]*+>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>",
    re.S | re.I,
)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")

MAIN, PLAIN, CHROME = 2, 1, 0
#: Lines asked for at most that are broadcast.
FEW = 100_000


def _named(value: str, inside: int) -> bool:
    """Whether a class or id names page furniture; a header in the article is its own."""
    return any(_NAMED.fullmatch(v) or inside != MAIN and _HEADER.fullmatch(v) for v in value.split())


def _role(tag: str, attrs: str, inside: int) -> int:
    """The role that an element gives to the text in it."""
    if inside == CHROME:
        return CHROME
    found = {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTR.finditer(attrs)} if attrs and not attrs.isspace() else {}
    role = found.get("role", "").lower()
    if tag in FURNITURE and not (tag == "header" and inside == MAIN) or role in _FURNITURE_ROLES or "hidden" in found or found.get("aria-hidden") == "true":
        return CHROME
    if tag in ("article", "main") or role in ("main", "article"):
        return CHROME if tag == "article" and _named(found.get("class", ""), MAIN) else MAIN
    if tag not in ("body", "html") and _named(f"{found.get('class', '')} {found.get('id', '')}", inside):
        return CHROME
    return inside


def lines(html: str) -> list[tuple[int, str]]:
    """(role, text) of the page's lines, in order; white space is one space, empty lines are left out."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    role, held, at = PLAIN, [], 0

    def flush():
        nonlocal held
        if held:
            text = " ".join(unescape("".join(held)).split())
            if text:
                out.append((role, text))
            held = []

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            held.append(html[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "img"):
                held.append(" ")
        elif m["end"]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if tag in BLOCK:
                flush()
            if depth is not None and (tag in BLOCK or not any(t in BLOCK for t, _ in stack[depth + 1 :])):
                if any(t in BLOCK for t, _ in stack[depth:]) or stack[depth][1] != role:
                    flush()
                role = stack[depth][1]
                del stack[depth:]
        else:
            if tag in BLOCK:
                flush()
                if tag in CLOSES_P:  # an open paragraph ends where a block begins
                    p = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in BLOCK), None)
                    if p is not None and (stack[p][0] == "p" or stack[p][0] == tag == "li"):
                        role = stack[p][1]
                        del stack[p:]
            inner = _role(tag, m["attrs"], role)
            if not m["attrs"].rstrip().endswith("/"):
                if inner != role:
                    flush()
                stack.append((tag, role))
                role = inner
    held.append(html[at:])
    flush()
    return out


def shared(a: list, b: list) -> set[int]:
    """Places in `a` of a longest common subsequence of the lines of `a` and `b`."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    out = set(range(lo)) | set(range(len(a) - hi, len(a)))
    common = set(a[lo : len(a) - hi]) & set(b[lo : len(b) - hi])
    x = [i for i in range(lo, len(a) - hi) if a[i] in common]
    y = [v for v in b[lo : len(b) - hi] if v in common]
    if not x:
        return out
    # bit-parallel table: row i has bit j set where the best length grows at line j
    where: dict = {}
    for j, v in enumerate(y):
        where[v] = where.get(v, 0) | 1 << j
    full, v, rows = (1 << len(y)) - 1, (1 << len(y)) - 1, []
    for i in x:
        u = v & where[a[i]]
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    j = len(y) - 1
    for r in range(len(x) - 1, -1, -1):
        before = rows[r - 1] if r else full
        while j >= 0 and rows[r] >> j & 1:
            j -= 1
        if j < 0:
            break
        if before >> j & 1:  # the best length up to line j grows only with this row: aligned
            out.add(x[r])
            j -= 1
    return out


def gone_from(own: list, may: list[bool], marked: bool, before: list | None, after: list | None, sizes: list[int] | None = None) -> list[int]:
    """Places of `own` whose lines the neighbours show to be the site's, among those that `may` be text. sizes: letters of each line of an unmarked page."""
    inside = [i for i, m in enumerate(may) if m]
    sides = [shared(own, near) & set(inside) for near in (before, after) if near is not None]
    if not marked:
        if len(sides) == 2:
            return sorted(sides[0] & sides[1])
        letters = sizes or [1] * len(own)
        if not sides or 10 * sum(letters[i] for i in sides[0]) >= 7 * sum(letters[i] for i in inside):
            return []  # no neighbour, or one that mirrors the page
        return sorted(sides[0])
    if len(sides) < 2 or any(2 * len(alike) >= len(inside) for alike in sides):
        return []
    both = sides[0] & sides[1]
    head = next((k for k, i in enumerate(inside) if i not in both), len(inside))
    tail = next((k for k, i in enumerate(reversed(inside)) if i not in both), len(inside))
    return inside[:head] + inside[len(inside) - tail :]


def text_of(page: list[tuple[int, str]], near: list[tuple[int, str]] | None) -> str:
    """The text of a page's lines, given those of one neighbour."""
    marked = any(r == MAIN for r, _ in page)
    may = [r == (MAIN if marked else PLAIN) for r, _ in page]
    own, other = [t for _, t in page], [t for _, t in near] if near is not None else None
    gone = gone_from(own, may, marked, None if other == own else other, None, [len(t) for t in own])
    return " ".join(t for i, (_, t) in enumerate(page) if may[i] and i not in gone)


def line_key(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _read(batches):
    """Each page's lines as hashes, whether each may be text, the texts of those, and whether the mark-up names a container."""
    for b in batches:
        out = []
        for html in b.column("html").to_pylist():
            page = lines(html or "")
            marked = any(r == MAIN for r, _ in page)
            role = MAIN if marked else PLAIN
            out.append(([line_key(t) for _, t in page], [r == role for r, _ in page], [t for r, t in page if r == role], marked, [] if marked else [len(t) for _, t in page]))
        kinds = (pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.string()), pa.bool_(), pa.list_(pa.int32()))
        columns = [pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)]
        names = ["page_id", "url", "host", "path", "query"]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *columns], [*names, "lines", "may", "texts", "marked", "sizes"])


def _differenced(batches):
    """host, path, query, h, marked, gone, key: the number (among those that may be text) and hash of each line to delete."""
    for b in batches:
        at, gone, keys = [], [], []
        for row, (own, may, *rest) in enumerate(zip(*(b.column(c).to_pylist() for c in ("lines", "may", "marked", "near_before", "near_after", "sizes")))):
            number = {i: n for n, i in enumerate(i for i, m in enumerate(may) if m)}
            for i in gone_from(own, may, *rest):
                at.append(row)
                gone.append(number[i])
                keys.append(own[i])
        names = ["host", "path", "query", "h", "marked"]
        rows = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([*(b.column(n).take(rows) for n in names), pa.array(gone, pa.int32()), pa.array(keys, pa.int64())], [*names, "gone", "key"])


def neighbours(addresses: DataFrame) -> DataFrame:
    """`addresses` (host, path, query, r: the hash of its lines; each address once) with those next to it in order.

    before1 is the nearest earlier address of the host, before2 the nearest earlier one whose lines differ from those of
    before1; after1 and after2 the same later. A host's addresses are cut into ranges; the ends of each range are passed on to the
    next ones, so the result doesn't depend on the cuts.
    """
    ranged = cut(addresses.repartitionByRange("host", "path", "query").withColumn("bucket", F.spark_partition_id()), "addresses")
    order = Window.partitionBy("host", "bucket").orderBy("path", "query")
    me = F.struct("path", "query", "r")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # what follows is what went before in the other order; a frame that ends with the partition would be read anew for each row
    back = Window.partitionBy("host", "bucket").orderBy(F.desc("path"), F.desc("query")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = ranged.withColumn("before1", F.lag(me).over(order)).withColumn("after1", F.lead(me).over(order))
    near = near.withColumn("p", F.last(F.when(F.col("before1.r") != F.col("r"), F.col("before1")), True).over(so_far))
    near = near.withColumn("n", F.last(F.when(F.col("after1.r") != F.col("r"), F.col("after1")), True).over(back))
    near = near.withColumn("before2", F.lag("p").over(order)).withColumn("after2", F.lead("n").over(order))
    ends = near.groupBy("host", "bucket").agg(F.max(F.struct("path", "query", "r", "p")).alias("z"), F.min(F.struct("path", "query", "r", "n")).alias("a"))
    ends = ends.select("host", "bucket", "z.p", "a.n", F.struct("z.path", "z.query", "z.r").alias("z"), F.struct("a.path", "a.query", "a.r").alias("a"))
    by = Window.partitionBy("host").orderBy("bucket")
    ends = ends.withColumn("c1", F.lag("z").over(by)).withColumn("d1", F.lead("a").over(by))
    p = F.coalesce("p", F.when(F.col("c1.r") != F.col("z.r"), F.col("c1")))
    n = F.coalesce("n", F.when(F.col("d1.r") != F.col("a.r"), F.col("d1")))
    ends = ends.withColumn("p", F.last(p, True).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = ends.withColumn("n", F.last(n, True).over(Window.partitionBy("host").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = ends.select("host", "bucket", "c1", "d1", F.lag("p").over(by).alias("c2"), F.lead("n").over(by).alias("d2"))

    def second(one, two, out1, out2):
        other = F.when(F.col(f"{out1}.r") != F.col(f"{one}.r"), F.col(out1)).otherwise(F.col(out2))
        return F.when(F.col(one).isNull(), F.col(out2)).otherwise(F.coalesce(F.col(two), other))

    near = near.drop("p", "n").join(ends, ["host", "bucket"])
    return near.select(
        "host", "path", "query", "r",
        F.coalesce("before1", "c1").alias("before1"), second("before1", "before2", "c1", "c2").alias("before2"),
        F.coalesce("after1", "d1").alias("after1"), second("after1", "after2", "d1", "d2").alias("after2"),
    )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of `pages` (page_id, url, html)."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1), r"/$", "")
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), path.alias("path"), query.alias("query"), F.col("html").cast("string").alias("html"))
    read = rows.mapInArrow(_read, "page_id long, url string, host string, path string, query string, lines array<long>, may array<boolean>, texts array<string>, marked boolean, sizes array<int>")
    read = read.withColumn("h", F.xxhash64("lines", "may"))
    address = ["host", "path", "query"]
    # until the texts are read again at the end all is narrow: hashes of the lines of each distinct version of a page
    versions = cut(read.groupBy(*address, "h").agg(F.first("lines").alias("lines"), F.first("may").alias("may"), F.first("marked").alias("marked"), F.first("sizes").alias("sizes")), "versions")
    near = neighbours(versions.groupBy(*address).agg(F.min(F.xxhash64("lines")).alias("r")))
    of = lambda *cs: F.coalesce(*[F.when(F.col(f"{c}.r") != F.xxhash64("lines"), F.col(c)) for c in cs])
    pairs = versions.join(near.drop("r"), address).withColumns({"before": of("before1", "before2"), "after": of("after1", "after2")})
    for side in ("before", "after"):
        every = versions.groupBy("host", F.struct("path", "query", F.xxhash64("lines").alias("r")).alias(side)).agg(F.first("lines").alias(f"near_{side}"))
        pairs = pairs.join(every, ["host", side], "left")
    pairs = pairs.select(*address, "h", "lines", "may", "marked", "sizes", "near_before", "near_after").where("near_before IS NOT NULL OR near_after IS NOT NULL")
    found = cut(pairs.mapInArrow(_differenced, "host string, path string, query string, h long, marked boolean, gone int, key long"), "found")
    asked = cut(found.select("host", "key").distinct(), "asked")
    if asked.take(1):
        holds = versions.select("host", F.explode(F.array_distinct("lines")).alias("key"))
        few = asked.limit(FEW + 1).count() <= FEW
        # lines asked for that are many are looked up after the counts, as one line of a large host would meet in one task
        count = (holds.join(F.broadcast(asked), ["host", "key"]) if few else holds).groupBy("host", "key").agg(F.count("*").alias("n"))
        site = (count if few else count.join(asked, ["host", "key"])).join(versions.groupBy("host").agg(F.count("*").alias("all")), "host")
        found = found.join(site, ["host", "key"]).where("if(marked, 2 * n >= all, n >= least(3, all))")
    found = if_small(cut(found.groupBy(*address, "h").agg(F.collect_list("gone").alias("gone")), "gone"))
    keep = F.array_except(F.sequence(F.lit(0), F.size("texts") - 1), F.coalesce("gone", F.array().cast("array<int>")))
    text = F.when(F.size("texts") == 0, "").otherwise(F.array_join(F.transform(keep, lambda i: F.get("texts", i)), " "))
    done = read.select("page_id", "url", *address, "h", "texts").join(found, [*address, "h"], "left").select("page_id", "url", text.alias("text"))
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
