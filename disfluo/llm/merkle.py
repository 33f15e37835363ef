"""A Merkle manifest of documents, with a proof for each of them.

Each document is a leaf. The leaves of a source, in order of their ids, are the base of a tree whose nodes hash runs of three;
the subroots of all sources, in order of their names, are the base of a second tree of the same kind, which ends in the root.

Leaves are range-sorted into partitions, and each partition's rows are indexed by their place in their source. A partition
streams its leaves onto a stack of peaks (a mountain range): when the last node of a run is pushed, its run leaves the stack
and their hash is pushed as the next level's node, a carry of a number to the base of the fanout. Finished nodes are
records; what stays on the stack at a partition's end are the peaks, a few for each level and edge. Peaks of neighbouring
partitions are range-sorted into fewer partitions and run through the same stack until each source has one node left; a
source's last run is hashed as short as it is, without padding. Proofs are then made in the leaves' partitions, from their own
records and from the few nodes of others that stand beside their edges.

Defined results: every column may be null; leaves with equal ids come in order of their digests, a null id before all others;
rows alike in all columns are leaves of their own; a null id has no decimal form, so it is not tampered with; an empty table
has no root and gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from disfluo.llm.common import read, stable

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE_SCHEMA = "pid int, source string, total long, level int, idx long, digest binary, peak boolean"
_NODE = pa.schema([("pid", pa.int32()), ("source", pa.string()), ("total", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.binary()), ("peak", pa.bool_())])


@dataclass(frozen=True)
class Shape:
    """fanout: nodes in a run; piece_rows: leaves in a partition at most, about; merge_rows: peaks in a partition when they merge."""

    fanout: int = 3
    piece_rows: int = 100_000
    merge_rows: int = 50_000


def digest_of(hexes: bytes) -> bytes:
    return hashlib.sha256(hexes).digest()


def parent_of(digests: list[bytes]) -> bytes:
    """The node over a run: the hash of its digests as hex text."""
    return digest_of(b"".join(d.hex().encode() for d in digests))


def widths(total: int, fanout: int) -> list[int]:
    """Nodes on each level of a tree of so many leaves, up to the level of one node."""
    out = [total]
    while out[-1] > 1:
        out.append(-(-out[-1] // fanout))
    return out


class Range:
    """A source's stack of peaks: nodes (level, index, digest) in order, none of which completes a run with those before it."""

    def __init__(self, fanout: int):
        self.fanout, self.stack, self.made = fanout, [], []

    def push(self, level: int, idx: int, digest: bytes) -> None:
        self.stack.append((level, idx, digest))
        while idx % self.fanout == self.fanout - 1 and self._fold(level, self.fanout):
            level, idx, _ = self.stack[-1]

    def _fold(self, level: int, n: int) -> bool:
        """Carry the last n nodes to the next level, if they are one run."""
        run = self.stack[-n:]
        if len(run) < n or any(r[0] != level for r in run) or run[0][1] % self.fanout:
            return False
        del self.stack[-n:]
        self.made += run
        self.stack.append((level + 1, run[0][1] // self.fanout, parent_of([r[2] for r in run])))
        return True

    def close(self, total: int) -> None:
        """Hash the short runs at the source's end, from the leaves up, as far as their nodes are here."""
        for level, width in enumerate(widths(total, self.fanout)[:-1]):
            top = self.stack[-1]
            if top[0] > level:
                continue
            n = (width - 1) % self.fanout + 1
            if top[:2] != (level, width - 1) or not self._fold(level, n):
                return
            while self.stack[-1][1] % self.fanout == self.fanout - 1 and self._fold(self.stack[-1][0], self.fanout):
                pass


def _records(pid: int, source: str | None, total: int, r: Range, least: int) -> list[tuple]:
    return [(pid, source, total, *n, False) for n in r.made if n[0] >= least] + [(pid, source, total, *n, True) for n in r.stack]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(dict(zip(_NODE.names, map(list, zip(*rows)))), schema=_NODE)


def _stacked(fanout: int, flush: int = 20_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Partitions of leaves in order (source, leaf, and their piece's edges) to node records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, pid, source, pos, last = None, [], 0, None, 0, 0
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in ("pid", "source", "leaf", "first_start", "last_total")}
            for pid, name, leaf, first, last in zip(*cols.values()):
                if held is None:
                    held, source, pos = Range(fanout), name, first
                elif name != source:
                    held.close(pos)  # the source ends within this partition
                    out += _records(pid, source, pos, held, 1)
                    held, source, pos = Range(fanout), name, 0
                held.push(0, pos, leaf)
                pos += 1
                if len(held.made) > flush:
                    out += [(pid, source, None, *n, False) for n in held.made if n[0] >= 1]
                    held.made = []
                if len(out) > flush:
                    yield _batch(out)
                    out = []
        if held is not None:
            if pos == last:
                held.close(last)
            yield _batch(out + _records(pid, source, last, held, 1))

    return run


def _merged(fanout: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Partitions of peaks in order to the nodes that they complete and the peaks that are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, out = None, None, []

        def ended() -> list[tuple]:
            held.close(at[1])
            return _records(-1, *at, held, 0)

        for batch in batches:
            cols = (batch.column(c).to_pylist() for c in ("source", "total", "level", "idx", "digest"))
            for source, total, level, idx, digest in zip(*cols):
                if held is None or (source, total) != at:
                    out += ended() if held is not None else []
                    held, at = Range(fanout), (source, total)
                held.push(level, idx, digest)
            if len(out) > 20_000:
                yield _batch(out)
                out = []
        if held is not None:
            yield _batch(out + ended())

    return run


def _powers(fanout: int) -> Column:
    """Leaves below a node of each level, as far as they can be counted."""
    powers = [1]
    while powers[-1] < 1 << 58:
        powers.append(powers[-1] * fanout)
    return F.array(*[F.lit(p).cast("long") for p in powers])


def _power(fanout: int, level: Column) -> Column:
    return F.element_at(_powers(fanout), level + 1)


def _div(a: Column, b: Column | int) -> Column:
    """Whole-number division of numbers that are not negative."""
    return ((a - F.pmod(a, F.lit(b) if isinstance(b, int) else b)) / b).cast("long")


def _width(fanout: int, total: Column, level: Column) -> Column:
    """Nodes on a level of a tree of so many leaves."""
    return _div(total - 1, _power(fanout, level)) + 1


@dataclass
class Forest:
    """pieces: leaves by partition (pid) and place in it (rank); runs: pid, source, start, n, total; nodes: records of the
    partitions, by pid; shared: the nodes of all partitions' edges and what they merge to; tops: a subroot for each source."""

    shape: Shape
    pieces: DataFrame
    runs: DataFrame
    nodes: DataFrame
    shared: DataFrame
    tops: DataFrame


def forest(leaves: DataFrame, order: list[str], shape: Shape = Shape()) -> Forest:
    """Trees over leaves (source, leaf and the columns of order), one for each source."""
    f, spark = shape.fanout, leaves.sparkSession
    rows = leaves.count()
    pieces = max(1, -(-rows // shape.piece_rows), min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // 500))
    tie = F.xxhash64(F.monotonically_increasing_id()).alias("tie")  # leaves alike in all else are told apart, so that they spread
    ranged = leaves.select("*", tie).repartitionByRange(pieces, "source", *order, "tie").sortWithinPartitions("source", *order, "tie").drop("tie")
    ranged = stable(ranged)
    at = F.monotonically_increasing_id()
    ranged = ranged.withColumn("pid", F.shiftright(at, 33).cast("int")).withColumn("rank", at.bitwiseAND(F.lit((1 << 33) - 1)))
    runs = ranged.groupBy("pid", "source").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("source").orderBy("pid")
    before = F.coalesce(F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start")
    runs = stable(runs.select("pid", "source", "n", before, F.sum("n").over(Window.partitionBy("source")).alias("total")))
    run = F.struct(F.col("source").isNotNull(), "source", "start", "total")
    edges = runs.groupBy("pid").agg(F.min(run)["start"].alias("first_start"), F.max(run)["total"].alias("last_total"))
    # one row for each partition, of which there are rows / piece_rows: broadcasting them is bounded
    ranged = ranged.join(F.broadcast(edges), "pid")
    nodes = stable(ranged.select("pid", "source", "leaf", "first_start", "last_total").mapInArrow(_stacked(f), NODE_SCHEMA))
    top = _width(f, F.col("total"), F.col("level")) == 1
    shared = nodes.filter("peak").drop("pid", "peak")
    tops, open_ = shared.filter(top), shared.filter(~top)
    left, merge_rows = open_.count(), shape.merge_rows
    while left:
        parts = -(-left // merge_rows)
        place = (F.col("idx") * _power(f, F.col("level"))).alias("place")
        spread = open_.select("*", place)
        spread = spread.repartition(1) if parts == 1 else spread.repartitionByRange(parts, "source", "place")
        spread = spread.sortWithinPartitions("source", "place").drop("place")
        got = stable(spread.mapInArrow(_merged(f), NODE_SCHEMA))
        shared = shared.unionByName(got.filter(F.col("peak") | (F.col("level") > 0)).drop("pid", "peak"))
        tops, open_ = tops.unionByName(got.filter(F.col("peak") & top).drop("pid", "peak")), got.filter(F.col("peak") & ~top).drop("pid", "peak")
        before, left = left, open_.count()
        merge_rows *= 1 if 2 * left < before else 4  # partitions of too few peaks have nothing but edges
    return Forest(shape, ranged, runs, nodes, shared, tops.select("source", "digest"))


def _borrowed(trees: Forest) -> DataFrame:
    """For each partition, the nodes of others that its proofs need: those of the runs that its edges cut, on every level."""
    f, level = trees.shape.fanout, F.col("level")
    deep = trees.runs.select("*", F.posexplode(_powers(f)).alias("level", "power")).filter(F.col("power") < F.col("total"))
    deep = deep.withColumn("width", _width(f, F.col("total"), level))
    over = F.col("power") * f
    ends = [_div(x, over) for x in (F.col("start"), F.col("start") + F.col("n") - 1)]
    wanted = F.array_distinct(F.array(*[e * f + k for e in ends for k in range(f)]))
    asked = deep.withColumn("idx", F.explode(wanted)).filter(F.col("idx") < F.col("width"))
    low, high = F.col("idx") * F.col("power"), F.least((F.col("idx") + 1) * F.col("power"), F.col("total"))
    asked = asked.filter((low < F.col("start")) | (high > F.col("start") + F.col("n")))
    known = trees.shared.groupBy(F.col("source").alias("s"), F.col("level").alias("l"), F.col("idx").alias("i")).agg(F.first("digest").alias("digest"))
    met = F.col("source").eqNullSafe(F.col("s")) & (level == F.col("l")) & (F.col("idx") == F.col("i"))
    return asked.join(known, met).select("pid", "source", "level", "idx", "digest")


def _walk(fanout: int, start: int, leaves: list[bytes], total: int, known: dict[tuple[int, int], str], above: tuple) -> Iterator[tuple]:
    """For each leaf of a run, in order, its path (a chain: hex before, hex after, path of the node above) and its proof (the
    digests of its siblings from there up); above: both for the tree's top."""
    width = widths(total, fanout)
    end, todo = start + len(leaves), [(len(width) - 1, 0, *above)]
    while todo:
        level, idx, path, proof = todo.pop()
        if not level:
            yield path, proof
            continue
        power, first, low, below = fanout ** (level - 1), idx * fanout, level - 1, []
        children = range(first, min(first + fanout, width[low]))
        hexes = [leaves[c - start].hex() if not low and start <= c < end else known[low, c] for c in children]
        for c in children:
            if c * power < end and (c + 1) * power > start:
                before, after = "".join(hexes[: c - first]), "".join(hexes[c - first + 1 :])
                below.append((low, c, (before, after, path), before + after + proof))
        todo += reversed(below)


def _links(path: tuple) -> Iterator[tuple[str, str]]:
    while path:
        before, after, path = path
        yield before, after


def _proof_path(packed: bytes) -> tuple:
    """A chain from the text that _packed_path made."""
    path: tuple = ()
    for line in reversed(packed.decode().splitlines()):
        before, _, after = line.partition(" ")
        path = (before, after, path)
    return path


def _packed_path(path: tuple) -> bytes:
    return "".join(f"{before} {after}\n" for before, after in _links(path)).encode()


def _per_piece(trees: Forest, given: DataFrame, columns: list[str], schema: str, make: Callable) -> DataFrame:
    """make(rows of a run, their paths, what is given to the run's source) for each run of each partition, as Arrow tables."""
    f = trees.shape.fanout
    aids = trees.nodes.filter("level > 0").select("pid", "source", "level", "idx", "digest").unionByName(_borrowed(trees))
    aids = aids.unionByName(given.select("pid", "source", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("idx"), F.col("given").alias("digest")))
    runs = trees.runs.select("pid", "source", F.lit(-2).alias("level"), F.col("start").alias("idx"), F.encode(F.col("total").cast("string"), "utf-8").alias("digest"))
    aids = aids.unionByName(runs)

    def piece(rows: pa.Table, helps: pa.Table) -> pa.Table:
        rows = rows.sort_by("rank")
        known: dict[str | None, dict] = {}
        for source, level, idx, digest in zip(*(helps[c].to_pylist() for c in ("source", "level", "idx", "digest"))):
            own = known.setdefault(source, {})
            if level >= 0:
                own[level, idx] = digest.hex()
            else:
                own[level] = digest if level == -1 else (idx, int(digest))
        names, leaves, out, a = rows["source"].to_pylist(), rows["leaf"].to_pylist(), [], 0
        while a < len(names):
            b = a + 1
            while b < len(names) and names[b] == names[a]:
                b += 1
            own = known[names[a]]
            start, total = own[-2]
            out.append(make(rows.slice(a, b - a), lambda above, a=a, b=b, start=start, total=total, own=own: _walk(f, start, leaves[a:b], total, own, above), own.get(-1, b"")))
            a = b
        return pa.concat_tables(out)

    left = trees.pieces.select("pid", "rank", "source", "leaf", *columns)
    return left.groupBy("pid").cogroup(aids.groupBy("pid")).applyInArrow(piece, schema)


def _source_paths(tops: DataFrame, shape: Shape) -> DataFrame:
    """Of each source its subroot and the path from there (given), and the root. So few sources that they would be one partition
    are one task's work; more of them are leaves of a forest of their own."""
    f = shape.fanout

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column("source").to_pylist(), b.column("digest").to_pylist())]
        rows.sort(key=lambda r: (r[0] is not None, (r[0] or "").encode()))
        if rows:
            tree = Range(f)
            for k, (_, digest) in enumerate(rows):
                tree.push(0, k, digest)
            tree.close(len(rows))
            known = {n[:2]: n[2].hex() for n in tree.made + tree.stack}
            paths = _walk(f, 0, [d for _, d in rows], len(rows), known, ((), ""))
            given = [d + _packed_path(p) for (_, d), (p, _) in zip(rows, paths)]
            yield pa.RecordBatch.from_pydict({"source": pa.array([s for s, _ in rows], type=pa.string()), "given": given, "root": [tree.stack[0][2]] * len(rows)})

    if tops.count() <= shape.piece_rows:
        return stable(tops.repartition(1).mapInArrow(whole, "source string, given binary, root binary"))

    def make(rows: pa.Table, paths: Callable, given: bytes) -> pa.Table:
        packed = [d + _packed_path(p) for d, (p, _) in zip(rows["leaf"].to_pylist(), paths(((), "")))]
        return pa.table({"source": rows["name"], "given": pa.array(packed, type=pa.binary())})

    over = _over_sources(tops, shape)
    none = over.runs.filter("false").withColumn("given", F.lit(None).cast("binary"))
    paths = _per_piece(over, none, ["name"], "source string, given binary", make)
    return stable(paths.withColumn("root", F.lit(over.tops.first()["digest"])))


def leaf_text(columns: dict[str, Column]) -> Column:
    """Each field as its UTF-8 length, a colon and itself, a null as a dash."""
    part = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
    return F.concat(*[part(columns[c]) for c in FIELDS])


def leaves_of(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, and tampered (the leaf of the tampered row, null where it is the same)."""
    text = {c: F.col(c).cast("long").cast("string") if c in ("doc_id", "n_chars") else F.col(c).cast("string") for c in FIELDS}
    hashed = lambda columns: F.unhex(F.sha2(F.encode(leaf_text(columns), "utf-8"), 256))
    changed = (F.pmod(F.crc32(F.encode(text["doc_id"], "utf-8")), F.lit(2)) == 0) & F.contains(text["text"], F.lit("\n"))
    tampered = F.when(changed, hashed(text | {"text": F.translate(text["text"], "\n", "")}))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text["source"].alias("source"), hashed(text).alias("leaf"), tampered.alias("tampered"))


def manifest(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """Every node over the leaves: tree (source or root), source, level, idx, digest as hex text."""
    trees = forest(stable(leaves_of(docs)), ["doc_id", "leaf"], shape)
    over = _over_sources(trees.tops, shape)
    nodes = [t.nodes.select("source", "level", "idx", "digest").unionByName(t.shared.select("source", "level", "idx", "digest")).filter("level > 0").distinct().withColumn("tree", F.lit(name)) for t, name in ((trees, "source"), (over, "root"))]
    return nodes[0].unionByName(nodes[1]).select("tree", "source", "level", "idx", F.lower(F.hex("digest")).alias("digest"))


def _over_sources(tops: DataFrame, shape: Shape) -> Forest:
    names = stable(tops.select(F.lit("").alias("source"), F.col("source").alias("name"), F.col("digest").alias("leaf")))
    return forest(names, ["name"], shape)


def proofs(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for each document."""
    trees = forest(stable(leaves_of(docs)), ["doc_id", "leaf"], shape)
    paths = _source_paths(trees.tops, shape)
    found = paths.select("root").first()
    root = found["root"].hex() if found else ""
    tops = paths.select(F.col("source").alias("s"), "given")
    given = trees.runs.select("pid", "source").join(tops, F.col("source").eqNullSafe(F.col("s"))).select("pid", "source", "given")

    def make(rows: pa.Table, paths: Callable, given: bytes) -> pa.Table:
        subroot, above = given[:32].hex(), _proof_path(given[32:])
        proof, folded = [], []
        leaves = [x.hex() for x in rows["leaf"].to_pylist()]
        for (path, siblings), leaf, other in zip(paths((above, "".join(b + a for b, a in _links(above)))), leaves, rows["tampered"].to_pylist()):
            proof.append(hashlib.sha256(siblings.encode()).hexdigest())
            h = leaf if other is None else other.hex()
            for before, after in _links(path):
                h = hashlib.sha256((before + h + after).encode()).hexdigest()
            folded.append(h)
        n = rows.num_rows
        return pa.table({"doc_id": rows["doc_id"], "leaf": pa.array(leaves), "subroot": pa.array([subroot] * n), "proof_sha256": pa.array(proof), "folded_root": pa.array(folded)})

    out = _per_piece(trees, given, ["doc_id", "tampered"], "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string", make)
    return out.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    return proofs(read(spark, sf_dir, "documents"))


ORACLE_OP13 = r"""
WITH RECURSIVE p AS (
  SELECT doc_id, source, lang, n_chars, text, row_number() OVER () AS r,
         coalesce(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
           lambda h, c: list_reduce([xor(h, c), 1, 2, 3, 4, 5, 6, 7, 8], lambda v, k: xor(v >> 1, (v & 1) * 3988292384)), 4294967295) & 1 = 1, false) AS odd
  FROM documents),
b AS (SELECT *, concat(
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-'), coalesce(strlen(source) || ':' || source, '-'),
         coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-')) AS head,
         replace(text, chr(10), '') AS bare FROM p),
l AS (SELECT r, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
             CASE WHEN odd THEN sha256(head || coalesce(strlen(bare) || ':' || bare, '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS changed FROM b),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l),
t AS (
  SELECT 0 AS level, source, pos AS idx, n AS width, leaf AS h FROM o
  UNION ALL
  SELECT level + 1, source, idx // 3, (any_value(width) + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM t WHERE width > 1 GROUP BY level, source, idx // 3),
s AS (SELECT source, level AS height, h AS subroot, row_number() OVER (ORDER BY source IS NOT NULL, source) - 1 AS pos, count(*) OVER () AS n FROM t WHERE width = 1),
u AS (
  SELECT 0 AS level, pos AS idx, n AS width, subroot AS h FROM s
  UNION ALL
  SELECT level + 1, idx // 3, (any_value(width) + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM u WHERE width > 1 GROUP BY level, idx // 3),
w AS (SELECT o.r, o.pos, o.changed, s.height, s.pos AS spos, s.source FROM o JOIN s ON o.source IS NOT DISTINCT FROM s.source),
f AS (
  SELECT r, source, height, spos, 0 AS level, pos AS idx, changed AS h, '' AS proof, CAST(1 AS BIGINT) AS alone FROM w
  UNION ALL
  SELECT f.r, any_value(f.source), any_value(f.height), any_value(f.spos), f.level + 1,
         CASE WHEN f.level = any_value(f.height) THEN any_value(f.spos) ELSE f.idx // 3 END,
         CASE WHEN f.level = any_value(f.height) THEN any_value(f.h) ELSE sha256(string_agg(CASE WHEN x.idx = f.idx THEN f.h ELSE x.h END, '' ORDER BY x.idx)) END,
         any_value(f.proof) || CASE WHEN f.level = any_value(f.height) THEN '' ELSE coalesce(string_agg(CASE WHEN x.idx <> f.idx THEN x.h END, '' ORDER BY x.idx), '') END, 1
  FROM f JOIN (
    SELECT w.r, t.level, t.idx, t.h FROM w JOIN t ON w.source IS NOT DISTINCT FROM t.source WHERE t.level <= w.height
    UNION ALL
    SELECT w.r, w.height + 1 + u.level, u.idx, u.h FROM w, u) x
  ON f.r = x.r AND f.level = x.level AND f.idx // 3 = x.idx // 3
  WHERE f.level <= f.height + (SELECT max(level) FROM u)
  GROUP BY f.r, f.level, f.idx),
e AS (SELECT r, arg_max(h, level) AS folded_root, arg_max(proof, level) AS proof FROM f GROUP BY r)
SELECT o.doc_id, o.leaf, s.subroot, (SELECT h FROM u WHERE width = 1) AS root, sha256(e.proof) AS proof_sha256, e.folded_root,
       e.folded_root = (SELECT h FROM u WHERE width = 1) AS verified
FROM o JOIN s ON o.source IS NOT DISTINCT FROM s.source JOIN e USING (r)
"""
