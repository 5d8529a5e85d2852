"""Main text of web pages: differencing against the page with the nearest URL, and the structure that pages declare."""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Elements that part blocks, elements that never hold main text, elements without content, and words in
#: class, id and role that mark boilerplate. Inside an article its own header is text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
SKIP = frozenset("nav header footer aside form script style noscript template iframe svg canvas object audio video button select textarea input head title menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MARKS = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies footer gdpr header masthead menu nav navbar navigation newsletter notice notices pager pagination popup promo promoted related share sharing sidebar signup skip social sponsor sponsored subscribe teaser toolbar widget".split())
PARTS = re.compile(r"[^a-z0-9]+")
HEADS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Words of boxes. Inside an article a name of several words marks boilerplate only if marks and these are all it says.
BOXES = frozenset("area bar block bottom box button buttons container content form group icons inner item items left link links list panel post posts right row section slot title top unit wrap wrapper".split())
#: Elements whose content is no markup, and whose text is not shown.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SILENT = frozenset("script style template noscript head title".split())
#: Elements that an element ends by beginning, unless one of the others stands between them.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)), "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tbody": (("thead", "tbody", "tfoot"), ("table",)), "thead": (("thead", "tbody", "tfoot"), ("table",)), "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
}
SPACE, NAME, EQUALS, BARE, TAG = (re.compile(p) for p in (r"[\s/]*", r"=?[^\s/>=]*", r"\s*=\s*", r"[^\s>]*", r"[A-Za-z][^\s/>]*"))
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in RAW}


def attributes(page: str, p: int) -> tuple[dict[str, str], int, bool] | None:
    """Attributes of a tag from ``p`` on, where it ends and whether it closes itself; None if it does not end. The first of a name counts."""
    out: dict[str, str] = {}
    while True:
        space = SPACE.match(page, p)
        p = space.end()
        if p >= len(page):
            return None
        if page[p] == ">":
            return out, p + 1, space[0].endswith("/")
        name = NAME.match(page, p)
        p, value = name.end(), ""
        if equals := EQUALS.match(page, p):
            p = equals.end()
            if page[p : p + 1] in ('"', "'"):
                end = page.find(page[p], p + 1)
                if end < 0:
                    return None
                value, p = page[p + 1 : end], end + 1
            else:
                value = BARE.match(page, p)[0]
                p += len(value)
        out.setdefault(name[0].lower(), value)


class Blocks:
    """Text blocks of a page in order: (text, number of the marked article it stands in or 0, stands in boilerplate).

    An article that stands in boilerplate keeps its number. Open elements are known by counts and by the places of each tag, and every
    character is looked at a bounded number of times, so a page takes time in proportion to its length, whatever it holds.
    """

    def __init__(self):
        self.out: list[tuple[str, int, bool]] = []
        self.open: list[tuple[str, str]] = []  # element, its role (skip, main or none)
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # places of open elements that part blocks
        self.mains: list[tuple[int, int]] = []  # number of a marked article, open boilerplate elements around it
        self.text: list[str] = []
        self.stands = (0, False)  # where the text at hand began
        self.n = self.skips = self.silent = 0

    def flush(self) -> None:
        line = " ".join("".join(self.text).split())
        self.text.clear()
        if line:
            self.out.append((line, *self.stands))

    def role(self, tag: str, attrs: dict[str, str]) -> str:
        if tag in ("html", "body"):
            return ""
        if "hidden" in attrs or attrs.get("aria-hidden") == "true":
            return "skip"
        within = bool(self.mains)
        names = [PARTS.split(w.strip("-_")) for k in ("class", "id", "role") if k in attrs for w in unescape(attrs[k]).lower().split()]
        marks = MARKS - {"header"} if within else MARKS
        marked = any((x[0] in marks or x[-1] in marks) and (not within or all(w in marks or w in BOXES for w in x)) for x in names)
        if tag in ("article", "main") or ["main"] in names:
            return "skip" if marked else "main"
        return "skip" if marked or (tag in SKIP and not (within and tag == "header")) else ""

    @staticmethod
    def unseen(tag: str, role: str) -> bool:
        """Whether text inside is no text of the page, or boilerplate inside a block, which goes on behind it."""
        return tag in SILENT or (role == "skip" and tag not in BLOCKS)

    def push(self, tag: str, role: str) -> None:
        self.n += 1
        if role == "main":
            self.flush()
            self.mains.append((self.n, self.skips))
        self.skips += role == "skip"
        self.silent += self.unseen(tag, role)
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in BLOCKS:
            self.blocks.append(len(self.open))
        self.open.append((tag, role))

    def pop(self) -> None:
        tag, role = self.open.pop()
        self.places[tag].pop()
        if tag in BLOCKS:
            self.blocks.pop()
        self.skips -= role == "skip"
        self.silent -= self.unseen(tag, role)
        if role == "main":
            self.mains.pop()

    def last(self, *tags: str) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        if tag in BLOCKS:
            self.flush()
        if tag == "br":
            self.data(" ")
        if tag in VOID or closed:
            return
        role = self.role(tag, attrs)
        if tag in BLOCKS or tag in SKIP or role:
            if tag == "p" or tag in HEADS:
                self.close("p")
            if tag in IMPLIED:
                ended, walls = IMPLIED[tag]
                if (k := self.last(*ended)) > self.last(*walls):
                    self.cut(k)
            self.push(tag, role)

    def cut(self, k: int) -> None:
        if len(self.open) - k > 1 or not self.unseen(*self.open[k]):
            self.flush()
        while len(self.open) > k:
            self.pop()

    def close(self, tag: str) -> None:
        k = self.last(tag)
        if k >= 0 and (tag != "p" or k == self.blocks[-1]):
            self.cut(k)

    def end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        self.close(tag)

    def data(self, text: str) -> None:
        if self.silent or not (self.text or text.strip()):
            return
        if not self.text:
            number, around = self.mains[-1] if self.mains else (0, -1)
            self.stands = (number if self.skips == around else 0, self.skips > 0)
        self.text.append(text)

    def feed(self, page: str) -> None:
        """Tags, comments and text from left to right. A tag that does not end ends the page, a comment that does not end runs to its end."""
        p = 0
        while p < len(page):
            at = page.find("<", p)
            self.data(unescape(page[p : at if at >= 0 else len(page)]))
            if at < 0:
                break
            if page.startswith("<!--", at):
                end = page.find("-->", at + 2)
                p = end + 3 if end >= 0 else len(page)
            elif page[at + 1 : at + 2] in ("!", "?") or (page.startswith("</", at) and page[at + 2 : at + 3] and not TAG.match(page, at + 2)):
                end = page.find(">", at + 2)
                p = end + 1 if end >= 0 else len(page)
            elif page.startswith("</", at) and (name := TAG.match(page, at + 2)):
                end = page.find(">", name.end())
                if end < 0:
                    break
                self.end(name[0].lower())
                p = end + 1
            elif name := TAG.match(page, at + 1):
                read = attributes(page, name.end())
                if not read:
                    break
                attrs, p, closed = read
                tag = name[0].lower()
                self.start(tag, attrs, closed)
                if tag in RAW and not closed:
                    end = RAW_END[tag].search(page, p)
                    self.data(unescape(page[p : end.start() if end else len(page)]))
                    p = end.start() if end else len(page)
            else:
                self.data("<")
                p = at + 1
        self.flush()


def parse(page: str) -> list[tuple[str, int, bool]]:
    p = Blocks()
    p.feed(page)
    return p.out


def common(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of a longest common subsequence of two lists of lines, by longest increasing runs of matching places."""
    where: dict[str, list[int]] = {}
    for j, line in enumerate(b):
        where.setdefault(line, []).append(j)
    tails: list[int] = []
    ends: list[tuple] = []
    for i, line in enumerate(a):
        for j in reversed(where.get(line, ())):
            k = bisect_left(tails, j)
            link = (i, ends[k - 1] if k else None)
            tails[k : k + 1], ends[k : k + 1] = [j], [link]
    out, link = set(), ends[-1] if ends else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def near(a: str, b: str) -> int:
    """How many leading characters two paths share."""
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def main_text(blocks: list[tuple[str, int, bool]], other: list[tuple[str, int, bool]] | None) -> str:
    """Blocks joined by line feeds: those of the marked articles outside boilerplate (of all, if none stands outside), or else of what no
    element marks as boilerplate; without the lines shared with the nearest page where that leaves any."""
    articles = {a for _, a, skip in blocks if a and not skip} or {a for _, a, _ in blocks if a}
    left = [(t, a) for t, a, skip in blocks if (a in articles if articles else not skip)]
    if other and len(articles) != 1:
        shared = common([t for t, _ in left], [t for t, _, _ in other])
        own = {a for k, (_, a) in enumerate(left) if k not in shared}
        if articles and own:  # an article that says nothing of its own is part of the site
            left = [x for x in left if x[1] in own]
        elif own:  # else the other page is a copy and tells nothing
            left = [x for k, x in enumerate(left) if k not in shared]
    return "\n".join(t for t, _ in left)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rows_per_range: int = 20_000, most_ranges: int = 20_000) -> DataFrame:
    """The main text of each page.

    Pages are put in the order of (host, path, id). Of the pages before and after, the one of the same host whose path shares more
    leading characters is the nearest page. Lines of the two are aligned by a longest common subsequence and shared lines are deleted,
    where the page marks no article. Of several marked articles those without a line of their own are deleted. A single marked
    article stays whole: articles that quote each other or are copied would lose their own text to differencing. Elements that
    say they are boilerplate (by their tag, or by the first or last part of a class, id or role) are left out. Inside an article a
    name of several words says so only if all of them are words of boilerplate and boxes; an article inside such an element
    counts only where no other one is marked.

    The order is cut into ranges at places drawn from up to 20 keys a range (200,000 in all), chosen by a hash: one range for
    ``rows_per_range`` pages, at least as many as there are shuffle partitions and at most ``most_ranges``, each a task. A host with most of all
    pages spans many ranges. A range's first and last page are handed to its neighbours too, so that the result does not depend on the ranges.

    Null and empty pages give an empty text; null URLs form a host of their own; pages with equal URLs are ordered by id, rows with equal
    ids by their content. Other columns are left out. Returns id, url, text, n_chars.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for r in batch.to_pylist():
                    yield r["__id"], r["__url"], (r["__task"], r["__host"]), r["__path"], parse(r["__html"] or ""), r["__own"]

        def pick(prev: tuple | None, cur: tuple, after: tuple | None) -> str:
            near_by = [x for x in (prev, after) if x and x[2] == cur[2]]
            best = max(near_by, key=lambda x: near(x[3], cur[3]), default=None)
            return main_text(cur[4], best and best[4])

        def emit(done: list[tuple]) -> pa.RecordBatch:
            text = [d[2] for d in done]
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.string()), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], [id_col, url_col, "text", "n_chars"])

        prev = cur = None
        done: list[tuple] = []
        for row in chain(rows(), [None]):
            if cur and cur[5]:
                done.append((cur[0], cur[1], pick(prev, cur, row)))
            prev, cur = cur, row
            if len(done) >= 500:
                yield emit(done)
                done = []
        if done:
            yield emit(done)

    from pyspark.sql.pandas.types import to_arrow_type

    spark, id_type = pages.sparkSession, pages.schema[id_col].dataType
    kind = to_arrow_type(id_type)
    url = F.coalesce(F.col(url_col), F.lit(""))
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    n = min(most_ranges, max(int(spark.conf.get("spark.sql.shuffle.partitions")), pages.count() // rows_per_range))
    order = F.struct(F.col("__host"), F.col("__path"), F.col("__id"))
    keys = pages.select(host.alias("__host"), path.alias("__path"), F.col(id_col).alias("__id"))
    some = sorted({(r[0], r[1], r[2] is not None, r[2]) for r in keys.orderBy(F.xxhash64("__host", "__path", "__id")).limit(min(20 * n, max(200_000, n))).collect()})
    places = [some[k * len(some) // n] for k in range(1, n)] if some else []
    places = [{"__host": h, "__path": p, "__id": i} for h, p, _, i in dict.fromkeys(places)]
    width = max(1, round(len(places) ** 0.5))
    groups = [places[k : k + width] for k in range(0, len(places), width)]
    kind_of = f"array<struct<__host:string,__path:string,__id:{id_type.simpleString()}>>"
    heads, lists = F.from_json(F.lit(json.dumps([g[0] for g in groups])), kind_of), F.from_json(F.lit(json.dumps(groups)), f"array<{kind_of}>")

    def ranged(df: DataFrame) -> DataFrame:
        """With the range of each row: how many of the places lie at or before its key, told in two steps of about the root of their number."""
        at_or_before = lambda xs: F.size(F.filter(xs, lambda x: x <= order))
        df = df.withColumn("__c", at_or_before(heads))
        return df.withColumn("__range", F.when(F.col("__c") > 0, (F.col("__c") - 1) * width + at_or_before(F.get(lists, F.col("__c") - 1))).otherwise(0)).drop("__c")

    ends = ranged(keys).groupBy("__range").agg(F.min(order).alias("__first"), F.max(order).alias("__last"))  # a row for each range
    along = Window.orderBy("__range")
    ends = ends.withColumns({"__before": F.lag("__range").over(along), "__after": F.lead("__range").over(along)})
    rows = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), F.col(html_col).alias("__html"), host.alias("__host"), path.alias("__path"))
    rows = ranged(rows).join(F.broadcast(ends), "__range")
    tasks = F.filter(F.array("__range", F.when(order == F.col("__first"), F.col("__before")), F.when(order == F.col("__last"), F.col("__after"))), lambda x: x.isNotNull())
    dealt = rows.withColumn("__task", F.explode(tasks)).select("__id", "__url", "__html", "__host", "__path", "__task", (F.col("__task") == F.col("__range")).alias("__own"), F.xxhash64("__html").alias("__hash"))
    dealt = dealt.repartitionById(n, F.col("__task")).sortWithinPartitions("__task", "__host", "__path", "__id", "__hash").drop("__hash")
    return dealt.mapInArrow(run, f"`{id_col}` {id_type.simpleString()}, `{url_col}` string, text string, n_chars long")
