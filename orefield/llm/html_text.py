"""Main text of web pages by differencing with the page of the nearest URL.

Pages are sorted by host and URL path, and each is paired with the neighbour on its host that shares the longer path
prefix. The text lines of the two are aligned by a longest common subsequence; lines that both have are taken for the
site's template. Neighbours with the same lines count as one. A neighbour that has most of a page's lines may be a copy of
it, so the pages 2, 4, 8, ... places away are tried, up to the host's ends. If all have most of the lines, the page is
short beside its template: what two or more different ones all share with it is the template; exact copies tell nothing.
Every page is compared so, whatever its markup. Markup then checks what the comparison found: lines in menus, headers,
footers, sidebars, notices, adverts, forms and comments go though no other page has them, and lines of an article element
stay though another page has them, since one article may stand under two URLs of a host. The comparison decides on the
rest: all other lines, whether or not the page has an article, and in an article the lines of parts whose names only hint
at something else (class `social-history`, `notice board`). Where no page tells anything (alone on its host, or beside
copies only), lines outside an article go, and the others of these stay.

Of a page only its lines' hashes are sorted and compared. Pages are parsed again for the lines themselves, which go through
one shuffle to what was found of them; keeping them from the first time would hold all texts twice.

Defined results: where a page has an article, lines outside it that markup leaves open are text if the comparison shows
that they are the page's own; null or blank html has an empty text; a null or odd URL has the host ''; a page alone on its
host is judged by markup alone; rows alike are each judged; pages of one URL are ordered by identifier,
then by html; a very long page is read whole; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import reduce
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from orefield.llm.common import discard, materialize, row_key, slices

#: HTML's elements by what they mean for a page's text.
UNSEEN = frozenset("script style noscript template head title svg math iframe object canvas audio video select option textarea button datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("nav footer aside form menu dialog header".split())
MAIN = frozenset("article main".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: What may stand in a head; any other start tag, or text, ends a head whose end tag is left out.
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: A start tag of these ends an open paragraph.
ENDS_P = BLOCK - frozenset("html body caption tbody td tfoot th thead tr option optgroup legend summary".split())
#: Elements that hold parts of a page, and those that hold text only. Only these are judged by their class, id or role.
HOLDS = frozenset("center details div dl fieldset ol section span table td tr ul".split())
TEXTS = frozenset("address article blockquote dd dt figure figcaption h1 h2 h3 h4 h5 h6 li p pre".split())
#: Words that are enough as a whole class, id or role, on any of them.
SURE = frozenset(
    "ad ads advert advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr newsletter subscribe signup login sidebar breadcrumb breadcrumbs nav navbar navigation masthead comment comments disqus respond replies share sharing related recommended teaser teasers popup modal overlay pagination pager contentinfo".split()
)
#: Those of them that are enough as a part of a class too, in an article.
SURE_PARTS = frozenset("ad ads advert advertisement advertising sponsored cookie cookies consent gdpr newsletter breadcrumb breadcrumbs sidebar disqus masthead navbar comments pagination".split())
#: Words that mark a part as not the article outside one; in an article only where they are the whole name of a part.
WEAK = frozenset("banner notice notification alert subscription widget menu footer header reply social toolbar complementary search".split())
SIDE_WORDS = SURE | WEAK
HIDDEN = re.compile(r"(^|;)\s*(display\s*:\s*none|visibility\s*:\s*hidden)")
MAIN_WORDS = frozenset("article-body articlebody article-content post-content post-body entry-content story-body main-content".split())
#: HINT: in an article, but perhaps something else.
IN, OUT, OPEN, HINT = 1, -1, 0, 2
#: Two pages with more of their lines in common than this are copies.
COPY = 0.6
SPACE = re.compile(r"\s+")
#: A tag that the page's end cuts off is no text.
CUT_TAG = re.compile(r"<[/!?A-Za-z][^<>]*\Z")
ROWS_PER_BATCH = 128


class _Lines(HTMLParser):
    """Text lines with their role: in an article, in something else, or open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool]] = []
        self.lines: list[tuple[str, int]] = []
        self.parts: list[str] = []
        self.role, self.unseen = OPEN, False

    def parse_html_declaration(self, i: int) -> int:
        """As in HTML: outside svg and math, a marked section is a comment up to the next `>`."""
        if self.rawdata.startswith("<![", i):
            if self.rawdata.startswith("<![CDATA[", i) and any(tag in ("svg", "math") for tag, _, _ in self.stack):
                end = self.rawdata.find("]]>", i)
                return len(self.rawdata) if end < 0 else end + 3
            return self.parse_bogus_comment(i)
        return super().parse_html_declaration(i)

    def _close_head(self, body: bool) -> None:
        """A body's start tag ends a head with what is open in it, but for a title, whose text it may be, or template."""
        tags = [tag for tag, _, _ in self.stack]
        if "head" not in tags:
            return
        k = tags.index("head")
        if k == len(tags) - 1 or (body and not {"title", "template"} & set(tags[k:])):
            _, self.role, self.unseen = self.stack[k]
            del self.stack[k:]

    def _end_line(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.lines.append((text, self.role))
        self.parts = []

    def _role_of(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        if self.role == OUT:
            return OUT
        named = [(k, v.lower()) for k, v in attrs if k in ("class", "id", "role") and v]
        whole = {w for _, v in named for w in v.split()}
        inside = self.role in (IN, HINT)
        if any(k == "hidden" or (k == "style" and HIDDEN.search((v or "").lower())) for k, v in attrs):
            return OUT
        if (tag in HOLDS or tag in TEXTS) and whole & SURE:
            return OUT
        if tag == "header" and inside and not whole & WEAK:
            return self.role  # an article's own heading
        if tag in ASIDE:
            return OUT
        if tag in MAIN or whole & MAIN_WORDS or "main" in whole:
            return IN
        if tag in HOLDS:
            parts = {w for k, v in named if k != "id" or not inside for w in re.split(r"[\s_-]+", v)}
            if not inside:
                return OUT if parts & SIDE_WORDS else self.role
            alone = tag != "details" and any(v.strip() in WEAK for _, v in named)
            if alone or parts & SURE_PARTS:
                return OUT
            if (parts | whole) & SIDE_WORDS:
                return HINT
        return self.role

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in HEAD:
            self._close_head(tag == "body")
        if tag == "br":
            self.parts.append(" ")
        if tag in BLOCK:
            self._end_line()
        if tag in VOID:
            return
        if tag in ENDS_P:
            self._close_paragraph()
        self.stack.append((tag, self.role, self.unseen))
        self.role = self._role_of(tag, attrs)
        self.unseen = self.unseen or tag in UNSEEN

    def _close_paragraph(self) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[k][0]
            if tag == "p":
                _, self.role, self.unseen = self.stack[k]
                del self.stack[k:]
                return
            if tag in BLOCK:
                return

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)  # as in HTML, a slash closes nothing

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self._end_line()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                _, self.role, self.unseen = self.stack[k]
                del self.stack[k:]
                return

    def handle_data(self, data: str) -> None:
        if self.unseen and data.strip(" \t\n\f\r"):
            self._close_head(False)
        if not self.unseen:
            self.parts.append(data)


def text_lines(html: str | None) -> list[tuple[str, int]]:
    """(line, role) in page order, of the whole page."""
    own = _Lines()
    own.feed(CUT_TAG.sub("", html or ""))
    own.close()
    own._end_line()
    return own.lines


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in a of a longest common subsequence with b (Hunt and Szymanski: chains of matches by patience)."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    out = {*range(start), *range(len(a) - end, len(a))}
    where: dict[str, list[int]] = {}
    for j in range(len(b) - end - 1, start - 1, -1):
        where.setdefault(b[j], []).append(j)
    least: list[int] = []
    chains: list[tuple[int, tuple | None]] = []
    for i in range(start, len(a) - end):
        for j in where.get(a[i], ()):
            k = bisect.bisect_left(least, j)
            link = (i, chains[k - 1] if k else None)
            if k == len(least):
                least.append(j)
                chains.append(link)
            else:
                least[k], chains[k] = j, link
    link = chains[-1] if chains else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def sizes_of(lines: list[tuple[str, int]]) -> list[int]:
    """Of each line its characters if it is compared, these as a negative number if it stays anyway, 0 if it goes."""
    size = {IN: -1, OPEN: 1, HINT: 1}
    return [size.get(role, 0) * len(t) for t, role in lines]


def outside_of(lines: list[tuple[str, int]]) -> set[int]:
    """Places of the lines outside a page's article that markup leaves open: they stay only if the comparison tells so."""
    article = any(role == IN for _, role in lines)
    return {k for k, (_, role) in enumerate(lines) if article and role == OPEN}


def places_of(lines: list[tuple[str, int]]) -> list[int]:
    """Of each line that may stay its place; -1 if it stays anyway, and -2 - place if it stays only if told."""
    outside = outside_of(lines)
    return [-1 if n < 0 else -2 - k if k in outside else k for k, n in enumerate(sizes_of(lines)) if n]


def main_text(lines: list[tuple[str, int]], other: list[tuple[str, int]] | None) -> str:
    """The page's lines without those that the other page has too, as far as markup leaves it open (extract() of two pages)."""
    shared = common_lines([t for t, _ in lines], [t for t, _ in other]) if other else set()
    sizes, gone = sizes_of(lines), outside_of(lines)
    there = sum(abs(sizes[k]) for k in shared)
    if other and there <= COPY * sum(map(abs, sizes)):
        gone = shared
    return "\n".join(t for k, (t, _) in enumerate(lines) if sizes[k] < 0 or (sizes[k] and k not in gone))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def _parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with their lines' hashes and sizes."""
    for part in slices(batches, "html", ROWS_PER_BATCH):
        pages = [text_lines(x) for x in part.column("html").to_pylist()]
        made = {
            "hashes": pa.array([[int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big", signed=True) for t, _ in page] for page in pages], pa.list_(pa.int64())),
            "sizes": pa.array([sizes_of(page) for page in pages], pa.list_(pa.int32())),
        }
        kept = {n: part.column(n) for n in ("a", "b", "page_id", "host", "path")}
        yield pa.RecordBatch.from_arrays([*kept.values(), *made.values()], [*kept, *made])


def _lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with the lines that may stay, and their places as of places_of()."""
    for part in slices(batches, "html", ROWS_PER_BATCH):
        pages = [text_lines(x) for x in part.column("html").to_pylist()]
        sizes = [sizes_of(page) for page in pages]
        made = {
            "lines": pa.array([[t for (t, _), n in zip(page, own) if n] for page, own in zip(pages, sizes)], pa.list_(pa.string())),
            "places": pa.array([places_of(page) for page in pages], pa.list_(pa.int32())),
        }
        kept = {n: part.column(n) for n in ("a", "b", "page_id", "url")}
        yield pa.RecordBatch.from_arrays([*kept.values(), *made.values()], [*kept, *made])


PARSED = "a long, b long, page_id long, host string, path string, hashes array<long>, sizes array<int>"
LINES = "a long, b long, page_id long, url string, lines array<string>, places array<int>"
#: A row for each page, with its run; and one for each run of a partition, without a and b, with what else there is.
RUNS = "a long, b long, part int, run long, host string, content long, first string, last string, hashes array<long>, sizes array<int>, edge boolean, gone array<int>"


def shared_with(own: list[int], sizes: list[int], other: list[int]) -> tuple[list[int], float]:
    """Lines that the other page has too, and their share of all lines' characters that may stay; of the lines, where none may."""
    there = sorted(common_lines(own, other))
    total = sum(map(abs, sizes))
    return there, sum(abs(sizes[k]) for k in there) / total if total else len(there) / max(1, len(own))


def _compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of pages alike in host and lines, numbered; rows come sorted. Each run is compared with the ones before and
    after it, if both are in the partition: what it shares with the nearer one is its template, if that is no copy."""
    part, names = TaskContext.get().partitionId(), RUNS.replace("array<", "").split(", ")
    schema = pa.schema([(n.split()[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[n.split()[1].rstrip(">")]) for n in names])
    schema = pa.schema([pa.field(f.name, pa.list_(f.type)) if f.name in ("hashes", "sizes", "gone") else f for f in schema])
    before = own = None

    def closed(run: dict, after: dict | None) -> dict:
        """The run's row, once the run after it has begun."""
        found = {k: run[k] for k in ("run", "host", "content", "first", "last", "hashes", "sizes")} | {"part": part, "edge": before is None or after is None, "gone": None}
        if not found["edge"]:
            least, b, a = None, _beside(run, before), _beside(run, after)
            if b and (not a or _prefix(before["last"], run["first"]) >= _prefix(after["first"], run["last"])):
                least = b
            found["gone"] = least if least is not None else a
        return found

    for batch in batches:
        out = []
        columns = [batch.column(n) for n in ("a", "b", "host", "content", "path")]
        for k, (a, b, host, content, path) in enumerate(zip(*(c.to_pylist() for c in columns))):
            if own is None or (host, content) != (own["host"], own["content"]):
                new = {"run": own["run"] + 1 if own else 0, "host": host, "content": content, "first": path, "hashes": batch.column("hashes")[k].as_py(), "sizes": batch.column("sizes")[k].as_py()}
                if own:
                    out.append(closed(own, new))
                before, own = own, new
            own["last"] = path
            out.append({"a": a, "b": b, "part": part, "run": own["run"]})
        yield pa.RecordBatch.from_pylist(out, schema)
    if own:
        yield pa.RecordBatch.from_pylist([closed(own, None)], schema)


def _beside(run: dict, other: dict) -> list[int] | None:
    """What the run shares with another one; None if that is on another host, or perhaps a copy."""
    if other["host"] != run["host"]:
        return None
    there, share = shared_with(run["hashes"], run["sizes"], other["hashes"])
    return there if share <= COPY else None


@F.udf(StructType([StructField("shared", ArrayType(IntegerType())), StructField("share", DoubleType())]), useArrow=True)
def _shared(own, sizes, other):
    return shared_with(list(own), [int(n) for n in sizes], list(other))


@F.udf(IntegerType(), useArrow=True)
def _same_start(a, b):
    return _prefix(a, b)


def _ranked(parsed: DataFrame) -> DataFrame:
    """Pages by host, path, identifier and content, and their runs, with the rank of the run in the whole table."""
    keys = [F.col(k).asc_nulls_first() for k in ("host", "path", "page_id", "a", "b")]
    ordered = parsed.withColumn("content", F.xxhash64("hashes", "sizes")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered = materialize(ordered.mapInArrow(_compared, RUNS), "runs")
    page = F.struct("host", "content")
    edges = ordered.where("a is null").groupBy("part").agg(F.min_by(page, "run").alias("first"), F.max_by(page, "run").alias("last"), F.max("run").alias("run")).orderBy("part").collect()
    starts, free, last = [], 0, None  # a few numbers per partition; a run may go on over an edge
    for e in edges:
        start = free - (e["first"] == last)
        starts.append((e["part"], start))
        free, last = start + e["run"] + 1, e["last"]
    start = parsed.sparkSession.createDataFrame(starts, "part int, start long")
    out = ordered.join(F.broadcast(start), "part").withColumn("rank", F.col("start") + F.col("run")).drop("part", "start", "run")
    out.written_to = ordered.written_to
    return out


def _template(ranked: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(rank, gone), the lines that each run shares with its neighbours; and the tables that it is read from.

    Runs that _compared left open are compared with the runs 1, 2, 4, ... before and after, up to their host's first and
    last, until one is no copy. If all are, what two or more that differ have in common with it is the template; if there
    are none, gone is null.
    """
    rows = ranked.where("a is null").select("rank", "host", "hashes", "sizes", "content", "first", "last", "edge", "gone")
    # a run that goes on over a partition's edge is one
    over = rows.where("edge").groupBy("rank").agg(*(F.first(c).alias(c) for c in ("host", "hashes", "sizes", "content")), F.min("first").alias("first"), F.max("last").alias("last"), F.lit(None).cast("array<int>").alias("gone"))
    runs = rows.where("not edge").drop("edge").unionByName(over)
    ends = runs.groupBy("host").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    now = runs.where("gone is null and size(hashes) > 0").drop("gone").join(ends, "host").withColumns({"common": F.lit(None).cast("array<int>"), "told": F.array().cast("array<long>")})
    columns, done, step = now.columns, [runs.where("gone is not null").select("rank", "gone")], 1
    now = materialize(now, "open")
    tables = [now]
    other = lambda side: runs.select(*(F.col(c).alias(f"{side}_{c}") for c in ("rank", "hashes", "content", "first", "last")))
    while not now.isEmpty():
        # where a side has been compared to its end, the run stands for it itself, which tells nothing
        before = F.when(F.col("rank") - step // 2 > F.col("lo"), F.greatest(F.col("rank") - step, "lo")).otherwise(F.col("rank"))
        after = F.when(F.col("rank") + step // 2 < F.col("hi"), F.least(F.col("rank") + step, "hi")).otherwise(F.col("rank"))
        pairs = now.withColumns({"b": before, "a": after}).join(other("b"), F.col("b") == F.col("b_rank")).join(other("a"), F.col("a") == F.col("a_rank"))
        pairs = pairs.withColumns({"b_with": _shared("hashes", "sizes", "b_hashes"), "a_with": _shared("hashes", "sizes", "a_hashes"), "b_near": _same_start("b_last", "first"), "a_near": _same_start("a_first", "last")})
        pairs = pairs.select(*columns, *(c for k in "ba" for c in (f"{k}_with", f"{k}_near", f"{k}_content")))
        pairs = materialize(pairs, "pairs")
        tables.append(pairs)
        differ = lambda k: F.col(f"{k}_with.share") <= COPY
        best = F.when(differ("b") & (~differ("a") | (F.col("b_near") >= F.col("a_near"))), F.col("b_with.shared")).when(differ("a"), F.col("a_with.shared"))
        common, told = F.col("common"), F.col("told")
        for k in "ba":
            tells = F.col(f"{k}_with.share") < 1
            common = F.when(tells, F.array_intersect(F.coalesce(common, f"{k}_with.shared"), f"{k}_with.shared")).otherwise(common)
            told = F.when(tells, F.array_union(told, F.array(f"{k}_content"))).otherwise(told)
        state = pairs.withColumns({"gone": best, "common": common, "told": told})
        more = F.col("gone").isNull() & ((F.col("rank") - step > F.col("lo")) | (F.col("rank") + step < F.col("hi")))
        done.append(state.where(~more).select("rank", F.coalesce("gone", F.when(F.size("told") > 1, F.col("common"))).alias("gone")))
        now, step = state.where(more).select(*columns), step * 2
    return reduce(DataFrame.union, done), tables


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_shared) per page; n_shared counts the lines that it shares with its neighbours, by
    the comparison alone. Pages are compared by their rank in the whole table, so nothing depends on partitions and a
    large host has many tasks."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"), F.col(html).alias("html"))
    own = ["page_id", "url", "html"]
    rows = rows.withColumn("key", row_key(*own, *map(F.isnull, own))).select("*", "key.*").drop("key")
    parsed = materialize(rows.select("a", "b", "page_id", "host", "path", "html").mapInArrow(_parsed, PARSED), "parsed")
    ranked = _ranked(parsed)
    discard(parsed)
    found, tables = _template(ranked)
    # rows alike have one key
    shared = materialize(ranked.where("a is not null").select("a", "b", "rank").join(found, "rank").select("a", "b", "gone").dropDuplicates(["a", "b"]), "shared")
    discard(ranked, *tables)
    made = rows.select("a", "b", "page_id", "url", "html").mapInArrow(_lines, LINES).join(shared.hint("shuffle_hash"), ["a", "b"], "left")
    gone = F.coalesce("gone", F.array().cast("array<int>"))

    def stays(_: Column, k: Column) -> Column:
        place = F.get("places", k)
        return F.when(place == -1, True).when(place >= 0, ~F.array_contains(gone, place)).otherwise(F.col("gone").isNotNull() & ~F.array_contains(gone, -2 - place))

    text = F.array_join(F.filter("lines", stays), "\n")
    return made.select("page_id", "url", text.alias("text"), F.size(gone).cast("long").alias("n_shared")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared")
