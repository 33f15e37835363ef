"""Main text of web pages by nearest-URL page differencing.

Pages are sorted by host and path across the cluster, so that a page stands beside the pages of its host with the nearest
paths. Each page's lines are aligned with those of its neighbours on both sides, by a longest common subsequence, the
neighbour that shares the longer beginning of the path first. What two pages of a place have in common is its template.

Lines inside navigation, headers, footers, sidebars, forms, notices, adverts, comments, scripts and styles are no candidates.
Of the others, lines that the nearest neighbour shares are deleted. Markup checks that: if a page marks its article
(``article`` or ``main``), only lines in it are text, and those that a single neighbour shares are restored, since two
articles may rightly share passages; what the neighbours on both sides share is template there too.

A neighbour is the nearest page of the host whose lines differ: equal pages are passed over, also across partitions, for which
each partition gets the page before its first run of equal pages and the page after its last one.

Defined results: null or empty html gives an empty text; a null or malformed url has an empty host and path, and such pages
are neighbours of each other; a page without another page of its host with other lines is not differenced; where differencing
would leave nothing, nothing is deleted; unclosed, misnested and cut-off markup is read as far as it goes. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import os
import re
from collections.abc import Iterator
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from disfluo.llm.common import ARROW_ROWS, id_text, read, short_batches, squeezed, stable, whole_numbers
from disfluo.llm.urls import host_of, path_of

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_SKIPPED = frozenset("nav header footer aside form script style noscript template svg math button select option textarea iframe object dialog menu title audio video canvas".split())
_RAW = frozenset("script style textarea title noscript iframe template".split())
_BREAK = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tr caption blockquote pre section article main figure figcaption hr br address details summary center body html fieldset".split())
_ARTICLE = frozenset(("article", "main"))
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_LOOSE = frozenset("p li dt dd td th tr".split())  # elements that often have no end tag
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|banner|sponsor(?:ed)?|promo|nav|navbar|navigation|menu|breadcrumbs?|sidebar|aside|complementary|footer|contentinfo|header|masthead|"
    r"cookies?|consent|gdpr|notice|notification|alert|popup|modal|dialog|newsletter|subscribe|subscription|signup|comments?|respond|replies|disqus|social|share|sharing|related|recommended|"
    r"widget|toolbar|pagination|pager|skip|login|search|form)(?:$|[\s_-])", re.I)  # fmt: skip
_COMMENT = re.compile(r"(?:^|[\s_-])(?:comments?|replies|reply)(?:$|[\s_-])", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)
_GAP = re.compile(r"\s+")


def page_lines(page: str | None) -> list[tuple[str, bool]]:
    """The page's lines of text outside explicit boilerplate, and whether each stands in an element that marks the article."""
    if not page:
        return []
    lines: list[tuple[str, bool]] = []
    parts: list[str] = []
    inside = at = 0
    skip, depth = "", 0

    def flush() -> None:
        text = _GAP.sub(" ", entities.unescape("".join(parts))).strip()
        if text:
            lines.append((text, inside > 0))
        parts.clear()

    for mark in iter(_MARK.scanner(page).search, None):
        if mark.start() < at:
            continue
        if not skip:
            parts.append(page[at : mark.start()])
        at = mark.end()
        name = (mark[2] or "").lower()
        if not name:
            continue
        closing = bool(mark[1])
        if skip:
            if skip in _LOOSE and name in _BREAK:  # whatever follows ends such an element
                skip = ""
            elif name == skip:
                depth += -1 if closing else 1
                if depth <= 0:
                    skip = ""
                continue
            else:
                continue
        if closing:
            if name in _BREAK:
                flush()
            if name in _ARTICLE:
                inside = max(0, inside - 1)
            continue
        if name in _BREAK or name in _SKIPPED:
            flush()
        elif name in ("td", "th"):
            parts.append(" ")
        attributes = mark[3] or ""
        named = " ".join(a or b or c for a, b, c in _NAMED.findall(attributes)) if attributes else ""
        hinted = bool(named) and name not in ("html", "body", "a", "b", "i", "em", "strong") and bool((_COMMENT if name in _ARTICLE else _BOILERPLATE).search(named))
        if name in _SKIPPED or hinted or (attributes and _HIDDEN.search(attributes)):
            if name in _RAW:
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            elif name not in _VOID and not attributes.endswith("/"):
                flush()
                skip, depth = name, 1
            continue
        if name in _ARTICLE:
            inside += 1
    if not skip:
        parts.append(page[at:])
    flush()
    return lines


def shared_by_lcs(a: list, b: list) -> set[int]:
    """Places of a that a longest common subsequence of a and b uses: bit-parallel rows, then traced back."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = set(range(head)) | set(range(len(a) - tail, len(a)))
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | (1 << j)
    full = (1 << len(b)) - 1
    row, rows = full, []
    for x in a:
        u = row & where.get(x, 0)
        row = ((row + u) | (row - u)) & full
        rows.append(row)
    i, j = len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if i and not rows[i - 1] >> (j - 1) & 1:
            continue
        j -= 1
        out.add(head + i)
    return out


#: Lines of so many words are prose; pages that share half of a page's article, or of its prose, and so many lines of it tell the same story.
PROSE_WORDS, PROSE_LINES = 8, 3


def same_story(lines: list[tuple[str, bool]], shared: set[int]) -> bool:
    """Whether a neighbour that shares these lines shows the page's own article (a print view, a mirror): then what it shares says
    nothing about the template. A page that marks its article is judged by that, any other by its lines of prose."""
    marked = [k for k, (_, inside) in enumerate(lines) if inside]
    own = marked or [k for k, (text, _) in enumerate(lines) if text.count(" ") >= PROSE_WORDS - 1]
    size = lambda places: sum(len(lines[k][0]) for k in places)
    both = [k for k in own if k in shared]
    return len(both) >= PROSE_LINES and 2 * size(both) >= size(own)


def main_text(lines: list[tuple[str, bool]], *others: list[tuple[str, bool]] | None) -> str:
    """What is left of a page's lines without those of its template, by its neighbours of other stories, the nearest one first."""
    own, near = [text for text, _ in lines], []
    for other in others:
        texts = [text for text, _ in other or []]
        if texts and texts != own and texts not in near:
            near.append(texts)
    shared = [s for texts in near if not same_story(lines, s := shared_by_lcs(own, texts))]
    if any(inside for _, inside in lines):
        places = [k for k, (_, inside) in enumerate(lines) if inside]
        tries = [shared[0] & shared[1]] if len(shared) > 1 else []
    else:
        places, tries = list(range(len(own))), shared
    left = next((kept for gone in tries if (kept := [k for k in places if k not in gone])), places)
    return "\n".join(own[k] for k in left)


PARSED = "page_id long, url string, host string, path string, digest string, lines binary, size long"


def _pack(lines: list[tuple[str, bool]]) -> tuple[str, bytes, int]:
    """Digest of the lines' text, the lines compressed, and their size before."""
    body = "\n".join("01"[inside] + text for text, inside in lines).encode("utf-8", "surrogatepass")
    digest = hashlib.md5("\n".join(text for text, _ in lines).encode("utf-8", "surrogatepass")).hexdigest()
    return digest, squeezed(body), len(body)


def _unpack(data: bytes, size: int) -> list[tuple[str, bool]]:
    if not size:
        return []
    body = pa.decompress(data, decompressed_size=int(size), codec="zstd", asbytes=True).decode("utf-8", "surrogatepass")
    return [(line[1:], line[0] == "1") for line in body.split("\n")]


class Run:
    """Consecutive pages of a part and host with equal lines; pages: (page_id, url, path, side)."""

    def __init__(self, part: int, host: str, digest: str, lines: bytes, size: int):
        self.part, self.host, self.digest, self.lines, self.size = part, host, digest, lines, size
        self.pages: list[tuple] = []

    def row(self, part: int, side: int, page: tuple) -> tuple:
        return part, side, *page[:2], self.host, page[2], self.digest, self.lines, self.size


EDGE = ["part", "side", "page_id", "url", "host", "path", "digest", "lines", "size"]


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[Run]:
    run = None
    for batch in batches:
        for part, side, i, url, host, path, digest, lines, size in zip(*[whole_numbers(batch[c]).tolist() if c == "page_id" else batch[c].tolist() for c in EDGE]):
            if run is None or (run.part, run.host, run.digest) != (part, host, digest):
                if run is not None:
                    yield run
                run = Run(part, host, digest, lines, size)
            run.pages.append((None if i is pd.NA else i, url, path, side))
    if run is not None:
        yield run


def _ends(runs: Iterator[Run]) -> Iterator[tuple[int, list[Run], list[Run]]]:
    """Each part's number, its first two and its last two runs, in order."""
    heads: list[Run] = []
    tails: list[Run] = []
    for run in runs:
        if tails and tails[-1].part != run.part:
            yield tails[-1].part, heads, tails
            heads, tails = [], []
        heads = heads if len(heads) == 2 else [*heads, run]
        tails = [*tails[-1:], run]
    if tails:
        yield tails[-1].part, heads, tails


def _wanted(ordered: DataFrame) -> dict[tuple, list[tuple]]:
    """Which edge pages, as (part, side, place), are the pages beyond which parts' edges, as (group, side): group 2n is part n's
    first run, 2n + 1 its last one if it is another."""

    def summary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(part, side, k, r.host, r.digest, heads[0] is tails[-1]) for part, heads, tails in _ends(_runs(batches)) for side, runs in ((1, heads), (-1, tails)) for k, r in enumerate(runs)]
        yield pd.DataFrame(rows, columns=["part", "side", "k", "host", "digest", "single"])

    thin = ordered.select("part", "side", "page_id", F.lit("").alias("url"), "host", F.lit("").alias("path"), "digest", F.lit(b"").alias("lines"), F.lit(0).alias("size"))
    runs: dict[int, dict] = {1: {}, -1: {}}
    single = {}
    for r in sorted(thin.mapInPandas(summary, "part int, side int, k int, host string, digest string, single boolean").collect()):  # at most four short rows for each part
        runs[r["side"]].setdefault(r["part"], []).append((r["host"], r["digest"]))
        single[r["part"]] = r["single"]
    out: dict[tuple, list[tuple]] = {}
    parts = sorted(single)
    for at, part in enumerate(parts):
        for side in (-1, 1):
            own = runs[-side][part][0 if side < 0 else -1]
            at_other = at + side
            while 0 <= at_other < len(parts):
                met = list(enumerate(runs[side][parts[at_other]]))
                near = next(((k, run) for k, run in met[::side] if run != own), None)
                if near:
                    if near[1][0] == own[0]:
                        out.setdefault((parts[at_other], side, near[0]), []).append((2 * part + (side > 0 and not single[part]), side))
                    break
                at_other += side
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page. One shuffle, by range of (host, path), which no host can overload, and a
    small one of the runs at the parts' edges, to meet the pages beyond."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            packed = [_pack(page_lines(page if isinstance(page, str) else "")) for page in batch["html"]]
            yield batch[["page_id", "url", "host", "path"]].assign(page_id=whole_numbers(batch["page_id"]), digest=[p[0] for p in packed], lines=[p[1] for p in packed], size=[p[2] for p in packed])

    url = F.col("url").cast("string")
    rows = short_batches(pages).select(id_text("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"), F.col("html").cast("string").alias("html"))
    order = ["host", "path", "page_id"]
    sorted_rows = stable(rows.mapInPandas(parse, PARSED).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    as_text = [id_text(c) if c == "page_id" else F.col(c) for c in EDGE]
    ordered = sorted_rows.withColumn("side", F.lit(0)).select(*as_text)
    wanted = _wanted(ordered)
    groups = {group for targets in wanted.values() for group, _ in targets}

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, heads, tails in _ends(_runs(batches)):
            rows = [r.row(group, at, r.pages[0 if side > 0 else -1]) for side, runs in ((1, heads), (-1, tails)) for k, r in enumerate(runs) for group, at in wanted.get((part, side, k), ())]
            if 2 * part in groups:
                rows += [heads[0].row(2 * part, 0, page) for page in heads[0].pages] + [r.row(2 * part, 1, r.pages[0]) for r in heads[1:]]
            if 2 * part + 1 in groups:
                rows += [tails[-1].row(2 * part + 1, 0, page) for page in tails[-1].pages] + [r.row(2 * part + 1, -1, r.pages[-1]) for r in tails[:-1]]
            yield pd.DataFrame(rows, columns=EDGE, dtype=object).astype({"page_id": "Int64"})

    def finish(run: Run, before: Run | None, after: Run | None) -> list[tuple]:
        own, texts = _unpack(run.lines, run.size), {}
        beside = [(path, _unpack(r.lines, r.size)) for r, path in ((before, before and before.pages[-1][2]), (after, after and after.pages[0][2])) if r is not None and r.host == run.host]
        out = []
        for i, url, path, side in run.pages:
            if side == 0:
                near = tuple(sorted(range(len(beside)), key=lambda k: -len(os.path.commonprefix([path, beside[k][0]]))))
                if near not in texts:
                    texts[near] = main_text(own, *[beside[k][1] for k in near])
                out.append((i, url, texts[near], len(texts[near])))
        return out

    def walk(left_out: set[int]):
        def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, out = ["page_id", "url", "text", "n_chars"], []
            before = run = None
            for after in chain(_runs(batches), [None]):
                if run is not None:
                    first, last = before is None or before.part != run.part, after is None or after.part != run.part
                    if not (first and 2 * run.part in left_out or last and 2 * run.part + 1 in left_out):
                        out += finish(run, None if first else before, None if last else after)
                if len(out) >= ARROW_ROWS:
                    yield _typed(out, names)
                    out = []
                before, run = run, after
            yield _typed(out, names)

        return judge

    schema = "page_id long, url string, text string, n_chars long"
    edge_rows = "part int, side int, page_id long, url string, host string, path string, digest string, lines binary, size long"
    beyond = ordered.mapInPandas(edges, edge_rows).repartition("part").sortWithinPartitions("part", "side", *order).select(*as_text)
    return ordered.mapInPandas(walk(groups), schema).unionByName(beyond.mapInPandas(walk(set()), schema))


def _typed(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names, dtype=object).astype({"page_id": "Int64", "n_chars": "int64"})


def op6_page_text(spark, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
