"""Main text by nearest-URL page differencing.

A page becomes lines (its blocks of text) with the kind of place each stands in:
an article, furniture by its tag, its role or being hidden (menus, forms), parts
that only a class or id calls furniture (adverts, comments), or open. Pages are
sorted by host and URL path, so that neighbours are the pages with the nearest
URLs. The lines outside articles of a page and of each neighbour are aligned by
longest common subsequence, and lines that are shared are deleted: templates,
menus and footers, however they are marked. Lines inside an article stay, also
where a neighbour has them: sentences come again in other articles. Lines of
furniture by tag or role go in any case, as hosts vary them from page to page.
So do parts that are furniture by name alone, if the page has other text left;
if it has none, the name misleads and differencing decides there.

An article in an element that is furniture by name alone is an article, but in
comments, adverts and lists of other pages only ``main`` is, or any if the page
has no other text outside furniture. Names count if a class or id is made of
them, not if it merely contains one ("social-links", not "social-science").

The sort is a range partitioning, so a host of any size is spread over many
tasks. Copies of a page, those with the same lines outside furniture, are passed
over for the nearest page that differs, as between copies the whole body would
be shared, whatever menu or advert each has. That page may lie behind any number
of partitions: each partition names its outermost pages of two bodies, a window
over these few finds for every edge the page beyond it, and a join brings its
lines' digests over. Results don't depend on where partitions end. Texts stay
where they are; lines' digests are sorted and compared.

Character references are decoded, white space inside a block (HTML's and any
other) becomes one space, blocks are joined by a line end. A null html is empty,
a page without text gives an empty string. Pages without a host in their url
(null, not a url) have no neighbours. Repeated rows are copies. An empty table
gives an empty result. Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator, Sequence
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidyloom.llm._shared import lean, stash

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)"  # comments
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"  # tags
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"  # tags with a stray quote
    r"|<[/a-zA-Z][^>]*$|<[!?/][^>]*>|[^<]+|<",  # a tag that never ends, declarations, text
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
# HTML's elements by what they mean for a page's text.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
FURNITURE = {"nav", "footer", "aside", "form", "button", "select", "option", "datalist", "dialog", "menu", "svg", "canvas", "audio", "video", "object", "head", "label", "fieldset"}
CONTENT = {"article", "main"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "br",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
_CARD = r"ads?|advert|adverts|advertisement|adsense|sponsor|sponsored|sponsors|promos?|promotion|comments?|commentlist|disqus|respond|replies|related|recommended|sidebar|widgets?"
_NAME = _CARD + r"|banner|cookies?|consent|gdpr|notices?|popup|modal|overlay|nav|navbar|navigation|menu|breadcrumbs?|footer|masthead|topbar|share|sharing|social|subscribe|newsletter|signup|login|search|pagination|pager|skip-link|site-header"
_AROUND = r"site|page|main|top|bottom|left|right|primary|secondary|global|bar|box|container|wrapper|block|section|area|list|links?|form|icons?|buttons?|inner|row|item|message|[0-9]+"


def _made_of(names: str) -> re.Pattern:
    """A class or id that holds one of the names, and else but such words."""
    return re.compile(rf"(?:^|\s)(?:(?:{_AROUND}|{_NAME})[_-]+)*(?:{names})(?:[_-]+(?:{_AROUND}|{_NAME}))*(?=$|\s)", re.I)


NAMES, CARDS = _made_of(_NAME), _made_of(_CARD)
ABOUT = re.compile(r"(?<![a-z0-9])(?:has|with|without|no)[_-]\S*", re.I)  # what a wrapper has inside, not what it is
BODY_NAMES = re.compile(r"(?:^|\s)(?:article|article-body|article-content|entry-content|main-content|post-body|post-content|story-body)(?=$|\s)", re.I)
ARTICLE, OPEN, CHROME = 0, 1, 2
NAMED, CARD, NESTED = 3, 4, 5  # furniture by name, of the CARDS, and while a page is read articles in the latter
BROADCAST_LINES = 1_000_000  # four bytes each, and 16 for a page


def lines_of(page: str) -> list[tuple[int, str]]:
    """(place, text) of each block, in page order; furniture is furniture,
    whether by tag or by name."""
    return [(min(p, CHROME), text) for p, text in placed_lines(page)]


def placed_lines(page: str) -> list[tuple[int, str]]:
    """The same, with furniture by name told apart (NAMED and CARD)."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []  # open elements and the place outside them
    place, parts = OPEN, []

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((place, text))

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if name is None:
            if page[m.start()] != "<" or m.end() - m.start() == 1:
                parts.append(m[0])
            continue
        name = name.lower()
        if closing:
            if name in BLOCK or name in FURNITURE:
                flush()
            if any(tag == name for tag, _ in stack):
                while True:
                    tag, outside = stack.pop()
                    if tag in BLOCK or tag in FURNITURE:
                        flush()
                    place = outside
                    if tag == name:
                        break
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if name in BLOCK or name in FURNITURE:
            flush()
        if name in VOID:
            continue
        inner = place
        if place != CHROME:
            named = _furniture_by_name(name, attributes) if attributes else None
            if name in FURNITURE or (name == "header" and place not in (ARTICLE, NESTED)) or (attributes and _is_furniture(name, attributes)):
                inner = CHROME
            elif named:
                inner = max(named, place if place in (NAMED, CARD) else 0)
            elif name in CONTENT or (attributes and _is_content(attributes)):
                inner = NESTED if place in (CARD, NESTED) and not _is_main(name, attributes) else ARTICLE
        if name == "p" and stack and stack[-1][0] == "p":  # an open paragraph ends where the next begins
            place = stack.pop()[1]
            inner = place if inner == place or inner not in (CHROME, NAMED, CARD) else inner
        if not attributes.rstrip().endswith("/"):
            stack.append((name, place))
            place = inner
    flush()
    nested = CHROME if any(p in (ARTICLE, OPEN) for p, _ in out) else ARTICLE
    return [(nested if p == NESTED else p, text) for p, text in out]


def _is_furniture(name: str, attributes: str) -> bool:
    if name in ("body", "html"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "role" and value.lower() in ROLES:
            return True
        if key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
            return True
    return bool(re.search(r"(?:^|\s)hidden(?=\s|$|=)", attributes))


def _furniture_by_name(name: str, attributes: str) -> int | None:
    if name in CONTENT or name in ("body", "html"):
        return None
    values = [ABOUT.sub("", m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes) if m[1].lower() in ("class", "id")]
    if not any(map(NAMES.search, values)):
        return None
    return CARD if any(map(CARDS.search, values)) else NAMED


def _is_main(name: str, attributes: str) -> bool:
    return name == "main" or any(m[1].lower() == "role" and (m[2] or m[3] or m[4] or "").lower() == "main" for m in ATTRIBUTE.finditer(attributes))


def _is_content(attributes: str) -> bool:
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if (key, value.lower()) in (("role", "main"), ("role", "article"), ("itemprop", "articlebody")) or key in ("class", "id") and BODY_NAMES.search(value):
            return True
    return False


def _rows(a: Sequence[int], b: Sequence[int]) -> Iterator[int]:
    """After each symbol of a a number whose bit j is 0 where the longest common
    subsequence with b[: j + 1] is longer than with b[:j]."""
    at: dict[int, int] = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    full = row = (1 << len(b)) - 1
    for x in a:
        both = row & at.get(x, 0)
        row = (row + both | row - both) & full
        yield row


def _lengths(a: Sequence[int], b: Sequence[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of a and b[:j], for every j."""
    row = 0
    for row in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def aligned(a: Sequence[int], b: Sequence[int], most_bits: int = 1 << 26) -> list[int]:
    """Indices of a in a longest common subsequence with b. Rows are kept while
    they fit ``most_bits``; longer pairs are halved where the lengths from both
    ends add up to the most, so memory stays linear."""
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > most_bits:
        half = len(a) // 2
        front, back = _lengths(a[:half], b), _lengths(a[half:][::-1], b[::-1])
        cut = int((front + back[::-1]).argmax())
        return aligned(a[:half], b[:cut], most_bits) + [half + i for i in aligned(a[half:], b[cut:], most_bits)]
    rows, out = list(_rows(a, b)), []
    i, j = len(a), len(b)
    while i and j:
        if rows[i - 1] >> j - 1 & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> j - 1 & 1:
                out.append(i)
                j -= 1
    return out[::-1]


def shared_lines(own: Sequence[int], other: Sequence[int]) -> set[int]:
    """Indices of own that a longest common subsequence with other holds."""
    n, m = len(own), len(other)
    head = 0
    while head < min(n, m) and own[head] == other[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and own[n - 1 - tail] == other[m - 1 - tail]:
        tail += 1
    common = set(own[head : n - tail]) & set(other[head : m - tail])
    a = [i for i in range(head, n - tail) if own[i] in common]
    b = [x for x in other[head : m - tail] if x in common]
    return set(range(head)) | set(range(n - tail, n)) | {a[i] for i in aligned([own[i] for i in a], b)}


def _digest(text: str) -> int:
    import xxhash

    return int.from_bytes(xxhash.xxh64_digest(text.encode("utf-8", "surrogatepass")), "big", signed=True)


def page_keys(pages: DataFrame) -> DataFrame:
    """page_id, content, host, path, lines (digests of those outside articles),
    places (where these stand), kind (a digest of the lines outside furniture, or
    if there are none of all); a narrow pass that leaves the texts behind."""
    own = {"host": pa.string(), "path": pa.string(), "lines": pa.list_(pa.int64()), "places": pa.list_(pa.int32()), "kind": pa.int64()}

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for url, page in zip(batch["url"].to_pylist(), batch["html"].to_pylist()):
                lines = placed_lines(page or "")
                body = [t for p, t in lines if p in (ARTICLE, OPEN)]
                places = [i for i, (p, _) in enumerate(lines) if p != ARTICLE]
                out.append((*_address(url), [_digest(lines[i][1]) for i in places], places, _digest("\n".join(body or [t for _, t in lines]))))
            columns = {c: pa.array([r[i] for r in out], k) for i, (c, k) in enumerate(own.items())}
            yield pa.RecordBatch.from_pydict({"page_id": batch["page_id"], "content": batch["content"]} | columns)

    return lean(pages).mapInArrow(rows, f"page_id {dict(pages.dtypes)['page_id']}, content long, host string, path string, lines array<long>, places array<int>, kind long")


def _address(url: object) -> tuple[str, str]:
    if not isinstance(url, str):
        return "", ""
    try:
        parts = urlsplit(url)
    except ValueError:
        return "", url
    return parts.netloc.lower(), f"{parts.path}?{parts.query}"


ORDER = ["host", "path", "page_id", "content"]


def _outermost(_: tuple, group: pa.Table) -> pa.Table:
    """Of a partition the first page, the first of another body, and the same
    from its end."""
    group = group.sort_by([(c, "ascending") for c in ORDER])
    keys = list(zip(group["host"].to_pylist(), group["kind"].to_pylist()))
    n = len(keys)
    spots = {"first": 0, "second": next((i for i in range(n) if keys[i] != keys[0]), None), "last": n - 1, "other": next((i for i in range(n - 1, -1, -1) if keys[i] != keys[-1]), None)}
    spots = {k: i for k, i in spots.items() if i is not None}
    return group.take(list(spots.values())).select(["part", "host", "kind", "lines"]).append_column("spot", pa.array(list(spots), pa.string()))


def edges(ranged: DataFrame) -> DataFrame:
    """part, side (-1 before, 1 after), host, kind, lines of the nearest page of
    another body beyond each edge of each partition."""
    fences = stash(ranged.select("part", *ORDER, "kind", "lines").groupBy("part").applyInArrow(_outermost, "part int, host string, kind long, lines array<long>, spot string"), "fences")
    key, at = F.struct("host", "kind"), lambda s: F.max(F.when(F.col("spot") == s, F.struct("host", "kind")))
    ends = fences.groupBy("part").agg(at("first").alias("first"), at("last").alias("last"), (F.count(F.when(F.col("spot") == "other", key)) > 0).alias("several"))  # four rows a partition
    sides = []
    for side, order, near, far, own_far, own_near in ((-1, F.col("part"), "last", "other", "first", "last"), (1, F.col("part").desc(), "first", "second", "last", "first")):
        by = Window.orderBy(order)
        page = lambda part, spot: F.struct(part.alias("from"), F.lit(spot).alias("spot"))
        before, beyond = F.lag("part").over(by), F.lag(near).over(by)
        # the nearest page, seen from behind this partition, that differs from its outermost one
        differing = F.when(F.col("several"), page(F.col("part"), far)).when(beyond != F.col(own_near), page(before, near))
        known = ends.select("*", F.last(differing, ignorenulls=True).over(by).alias("differing"))
        wanted = F.when(beyond != F.col(own_far), page(before, near)).otherwise(F.lag("differing").over(by))
        sides.append(known.select("part", F.lit(side).alias("side"), wanted.alias("w")).where("w is not null").select("part", "side", "w.*"))
    wanted = sides[0].unionByName(sides[1]).withColumnRenamed("part", "to").withColumnRenamed("spot", "at")
    return wanted.join(fences, (F.col("from") == F.col("part")) & (F.col("at") == F.col("spot"))).select(F.col("to").alias("part"), "side", "host", "kind", "lines")


def neighbours(keys: Sequence[tuple[str, int]]) -> list[list[int]]:
    """For each (host, kind), in order, the places of the nearest ones before and
    after it on its host that differ in kind: copies say nothing."""
    n = len(keys)
    before, after = [-1] * n, [-1] * n
    for found, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last = -1
        for i in order:
            if last >= 0 and keys[last][0] == keys[i][0] != "":
                found[i] = found[last] if keys[last] == keys[i] else last
            last = i
    return [[j for j in pair if j >= 0] for pair in zip(before, after)]


def shared_with_neighbours(keys: DataFrame, per_partition: int) -> DataFrame:
    """page_id, content, gone: which lines of a page its nearest URLs delete,
    for the pages that lose any."""
    rows, lines = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()
    parts = max(2, -(-rows // per_partition), lines // (100 * per_partition))
    ranged = stash(keys.repartitionByRange(parts, *ORDER).withColumn("part", F.spark_partition_id()), "sorted")

    def compare(_: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in ["side", *ORDER]])
        lines, places, side = group["lines"].to_pylist(), group["places"].to_pylist(), group["side"].to_pylist()
        gone = []
        for i, near in enumerate(neighbours(list(zip(group["host"].to_pylist(), group["kind"].to_pylist())))):
            shared = set().union(*(shared_lines(lines[i], lines[j]) for j in near)) if side[i] == 0 else ()
            gone.append([places[i][k] for k in sorted(shared)] or None)
        table = pa.table({"page_id": group["page_id"], "content": group["content"], "gone": pa.array(gone, pa.list_(pa.int32()))})
        return table.filter(table["gone"].is_valid())

    own = ranged.withColumn("side", F.lit(0))
    found = own.unionByName(edges(ranged), allowMissingColumns=True).groupBy("part").applyInArrow(compare, f"page_id {dict(keys.dtypes)['page_id']}, content long, gone array<int>")
    return found.groupBy("page_id", "content").agg(F.min("gone").alias("gone"))


def article(page: str, gone: Iterable[int] = ()) -> str:
    """The main text of a page without the lines ``gone``, counted over all."""
    gone, lines = set(gone), placed_lines(page)
    kept = [t for i, (p, t) in enumerate(lines) if p in (ARTICLE, OPEN) and i not in gone]
    return "\n".join(kept or [t for i, (p, t) in enumerate(lines) if p == NAMED and i not in gone])


def main_text(pages: DataFrame, per_partition: int = 20_000) -> DataFrame:
    """page_id, url, text, n_chars and n_shared (lines that differencing deletes)
    for every page. Pages are parsed twice and moved at most once: what is
    sorted and compared is digests."""
    named = pages.select("page_id", "url", "html", F.xxhash64("url", "html").alias("content"))
    keys = stash(page_keys(named), "pagekeys")
    gone = stash(shared_with_neighbours(keys, per_partition), "gone").select(F.col("page_id").alias("id"), F.col("content").alias("what"), "gone")
    lines = gone.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()[0]
    joined = named.join(F.broadcast(gone) if lines <= BROADCAST_LINES else gone, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("content") == F.col("what")), "left_outer")

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [g or [] for g in batch["gone"].to_pylist()]
            texts = [article(page or "", g) for page, g in zip(batch["html"].to_pylist(), gone)]
            columns = {"text": pa.array(texts, pa.string()), "n_chars": pa.array(list(map(len, texts)), pa.int64()), "n_shared": pa.array(list(map(len, gone)), pa.int64())}
            yield pa.RecordBatch.from_pydict({"page_id": batch["page_id"], "url": batch["url"]} | columns)

    kinds = dict(named.dtypes)
    return joined.select("page_id", "url", "html", "gone").mapInArrow(rows, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, n_shared long")
