"""Operator 13: a Merkle manifest of a table, with a tree for each source and one over the sources' roots.

Leaves are sorted by (source, key) over range partitions and numbered within their source. A partition holds the
unresolved nodes of its rows, keyed by tree, level and index: a sparse forest. Forests form a
commutative monoid: putting two together resolves every sibling run that is complete, and since each
node carries the width of its level, the arity of its run is known, for the last one too. ``treeReduce`` merges
what partitions leave open (a few nodes a level each) to the root. The nodes that partitions lack for their rows'
proofs, again a few a level, are looked up among those left open or made by merges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewspark.llm.common import materialise, table

#: Children of a node.
ARITY = 3
#: The tree over the sources' roots; other trees have the number of their source.
TOP = -1
#: Rows of a partition that are held at once.
PART = 100_000
#: Levels that a tree can have: ARITY ** LEVELS is beyond 64-bit row counts.
LEVELS = 40
NODE = "tree long, level int, index long, width long, digest string"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

Key = tuple[int, int, int]


def digest_of(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Forest:
    """Nodes whose sibling runs aren't complete: (tree, level, index) to (digest, width of that level)."""

    def __init__(self, sources: int, log: dict[Key, tuple[str, int]] | None = None) -> None:
        self.sources, self.open, self.log = sources, {}, log

    def add(self, key: Key, digest: str, width: int) -> None:
        """Put a node in and resolve the runs that it completes. All nodes go to the log, if there is one."""
        while True:
            tree, level, index = key
            if width == 1 and tree != TOP:  # the root of a source is a leaf of the top tree
                if self.log is not None:
                    self.log[key] = digest, width
                key, width = (TOP, 0, tree), self.sources
                continue
            self.open[key] = digest, width
            if self.log is not None:
                self.log[key] = digest, width
            first = index - index % ARITY
            run = [(tree, level, i) for i in range(first, min(first + ARITY, width))]
            if width == 1 or any(k not in self.open for k in run):
                return
            digest = digest_of(self.open.pop(k)[0] for k in run)
            key, width = (tree, level + 1, index // ARITY), -(-width // ARITY)

    def merged(self, other: Forest) -> Forest:
        """This forest with the other's nodes; what either has made stays in the log."""
        self.log.update(other.log)
        for key, (digest, width) in other.open.items():
            self.add(key, digest, width)
        return self


def field(c: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    s = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def ordered(df: DataFrame, columns: tuple[str, ...], changed: dict[str, Column] | None, when: Column | None) -> DataFrame:
    """``part, key, source, leaf, tampered, rid`` over range partitions of (source, key); written once, so that ranges stay."""
    key, source = columns[0], columns[1]
    whole = leaf_digest([F.col(c) for c in columns])
    other = F.lit(None).cast("string") if changed is None else F.when(when, leaf_digest([changed.get(c, F.col(c)) for c in columns]))
    leaves = df.select(F.col(key).alias("key"), F.col(source).alias("source"), whole.alias("leaf"), other.alias("tampered"), F.monotonically_increasing_id().alias("rid"))
    known = materialise(leaves, "merkle-leaves")
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-known.count() // PART))
    by = [F.col("source").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("leaf"), F.col("rid")]  # the last cuts runs of equal rows
    return materialise(known.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id()), "merkle-ordered")


def marks_of(rows: DataFrame) -> DataFrame:
    """For each partition and source: ``begin`` (rows of the source before), ``n``, ``width`` (all its rows), ``rank`` of the source."""
    counted = rows.groupBy("part", "source").agg(F.count("*").alias("n"))
    own = Window.partitionBy("source")
    marks = counted.select(
        "part", "source", "n",
        F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begin"),
        F.sum("n").over(own).alias("width"),
        F.min("part").over(own).alias("home"),
    )
    marks = materialise(marks, "merkle-marks")
    homes = marks.where("part = home")
    before = homes.groupBy("part").agg(F.count("*").alias("k"))
    before = before.select(F.col("part").alias("home"), (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("before"))
    named = homes.join(before, "home").select(F.col("source").alias("s"), (F.col("before") + F.row_number().over(Window.partitionBy("home").orderBy(F.col("source").asc_nulls_first())) - 1).alias("rank"))
    return materialise(marks.join(named, F.col("source").eqNullSafe(F.col("s"))).select("part", "source", "n", "begin", "width", "rank"), "merkle-ranked")


def needed(marks: DataFrame, sources: int) -> DataFrame:
    """Nodes ``part, tree, level, index`` that may stand beside the paths of a partition's rows: both ends of its ranges, at every level."""
    split = marks.where("n < width")
    ranges = split.select("part", F.col("rank").alias("tree"), "width", F.col("begin").alias("a"), (F.col("begin") + F.col("n") - 1).alias("b"))
    top = marks.groupBy("part").agg(F.min("rank").alias("a"), F.max("rank").alias("b")).select("part", F.lit(TOP).cast("long").alias("tree"), F.lit(sources).cast("long").alias("width"), "a", "b")
    powers = F.array(*[F.lit(ARITY**i).cast("long") for i in range(LEVELS)])
    levels = ranges.unionByName(top).select("*", F.posexplode(powers).alias("level", "power")).where("width > power")
    ends = levels.select("part", "tree", "level", F.explode(F.array(F.expr("a div power"), F.expr("b div power"))).alias("i"))
    runs = ends.select("part", "tree", "level", F.explode(F.sequence(F.col("i") - F.col("i") % ARITY, F.col("i") - F.col("i") % ARITY + ARITY - 1)).alias("index"))
    return runs.unionByName(split.select("part", F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("rank").alias("index"))).distinct()


def streamed(rows: DataFrame, marks: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Rows of each partition in order: known nodes, then for each source its mark and its leaves."""
    spark = rows.sparkSession
    leaf = rows.select("part", F.lit(1).alias("kind"), "source", F.lit(1).alias("what"), "key", "leaf", "tampered", "rid", *[F.lit(0).cast("long").alias(c) for c in ("tree", "begin", "width")])
    nothing = F.lit(None).cast("string")
    key = F.lit(None).cast(rows.schema["key"].dataType)
    mark = marks.select("part", F.lit(1).alias("kind"), "source", F.lit(0).alias("what"), key.alias("key"), nothing.alias("leaf"), nothing.alias("tampered"), F.lit(0).cast("long").alias("rid"), F.col("rank").alias("tree"), "begin", "width")
    both = leaf.unionByName(mark)
    if known is not None:
        both = both.unionByName(known.select("part", F.lit(0).alias("kind"), nothing.alias("source"), F.lit(0).alias("what"), key.alias("key"), F.col("digest").alias("leaf"), nothing.alias("tampered"), F.lit(0).cast("long").alias("rid"), "tree", F.col("index").alias("begin"), F.col("level").cast("long").alias("width")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = ["part", "kind", F.col("source").asc_nulls_first(), "what", F.col("key").asc_nulls_first(), "leaf", "rid"]
    return both.repartitionById(n, F.pmod(F.col("part"), F.lit(n)).cast("int")).sortWithinPartitions(*by).drop("source", "rid")


def open_nodes(rows: DataFrame, marks: DataFrame, sources: int) -> DataFrame:
    """The nodes that each partition leaves unresolved."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(f: Forest) -> pa.RecordBatch:
            cols = zip(*((*k, w, d) for k, (d, w) in f.open.items()), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["tree", "level", "index", "width", "digest"])

        forest, part, at = Forest(sources), None, (0, 0, 0)
        for b in it:
            for p, what, leaf, tree, begin, width in zip(*(b.column(c).to_pylist() for c in ("part", "what", "leaf", "tree", "begin", "width")), strict=True):
                if p != part and forest.open:
                    yield out(forest)
                    forest = Forest(sources)
                part = p
                if what == 0:
                    at = tree, begin, width
                else:
                    forest.add((at[0], 0, at[1]), leaf, at[2])
                    at = at[0], at[1] + 1, at[2]
        if forest.open:
            yield out(forest)

    return materialise(streamed(rows, marks).mapInArrow(run, NODE), "merkle-open")


def reduced(nodes: DataFrame, sources: int) -> Forest:
    """All open nodes merged: the root alone stays open; the log has what the merges made."""

    def of(rows: Iterable) -> Iterator[Forest]:
        forest = Forest(sources, {})
        for r in rows:
            forest.add((r["tree"], r["level"], r["index"]), r["digest"], r["width"])
        yield forest

    n = nodes.rdd.getNumPartitions()
    return nodes.rdd.mapPartitions(of).treeReduce(Forest.merged, max(2, min(6, n.bit_length() // 3)))


class Proofs:
    """Siblings of the rows of one partition, walked in order; every level remembers the run it was last at."""

    def __init__(self, nodes: dict[Key, tuple[str, int]], sources: int) -> None:
        self.nodes, self.sources, self.last = nodes, sources, {}

    def path(self, tree: int, level: int, index: int, width: int) -> list[tuple[str, str]]:
        """For each level from this node to the root: the digests before it in its run, and those after it."""
        if width == 1:
            return [] if tree == TOP else self.path(TOP, 0, tree, self.sources)
        first = index - index % ARITY
        if self.last.get((tree, level), (-1,))[0] != first:
            run = [self.nodes[tree, level, i][0] for i in range(first, min(first + ARITY, width))]
            self.last[tree, level] = first, run, self.path(tree, level + 1, index // ARITY, -(-width // ARITY))
        _, run, above = self.last[tree, level]
        return [("".join(run[: index - first]), "".join(run[index - first + 1 :])), *above]


def proved(rows: DataFrame, marks: DataFrame, known: DataFrame, sources: int, root: str) -> DataFrame:
    """Proofs of all rows against the root."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            proofs = Proofs(log, sources)
            for lo in range(0, len(held), 5000):
                cells = []
                for key, leaf, tampered, tree, index, width in held[lo : lo + 5000]:
                    path = proofs.path(tree, 0, index, width)
                    now = tampered or leaf
                    for before, after in path:
                        now = digest_of((before, now, after))
                    cells.append((key, leaf, log[TOP, 0, tree][0], root, digest_of(x for pair in path for x in pair), now, now == root))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells, strict=True), types, strict=True)], names=schema.names)

        log: dict[Key, tuple[str, int]] = {}
        forest, held, part, at = Forest(sources, log), [], None, (0, 0, 0)
        for b in it:
            types = [b.schema.field("key").type, *[pa.string()] * 5, pa.bool_()]
            for p, kind, what, key, leaf, tampered, tree, begin, width in zip(*(b.column(c).to_pylist() for c in ("part", "kind", "what", "key", "leaf", "tampered", "tree", "begin", "width")), strict=True):
                if p != part:
                    if held:
                        yield from out()
                    log = {}
                    forest, held, part = Forest(sources, log), [], p
                if kind == 0:
                    log[tree, width, begin] = leaf, 0
                elif what == 0:
                    at = tree, begin, width
                else:
                    held.append((key, leaf, tampered, *at))
                    forest.add((at[0], 0, at[1]), leaf, at[2])
                    at = at[0], at[1] + 1, at[2]
        if held:
            yield from out()

    schema = rows.select("key").schema
    for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root"):
        schema = schema.add(c, "string")
    schema = schema.add("verified", "boolean")
    return streamed(rows, marks, known).mapInArrow(run, schema)


def manifest(df: DataFrame, columns: tuple[str, ...] = COLUMNS, changed: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """Digests, roots and proofs of all rows of a table.

    ``columns`` names the hashed columns, the first the key that orders rows and the second their source.
    Rows that fulfil ``when`` are proved with the columns ``changed`` in place of their own.

    Returns the key, ``leaf``, ``subroot`` (of the source), ``root``, ``proof_sha256`` (digest of the
    siblings up to the root), ``folded_root`` (from the changed leaf, if any, and those siblings) and
    ``verified``. Null keys come first in their source, rows with equal keys by their leaf, and equal
    rows are leaves of their own; a null source is a source and the first. An empty table gives no rows; other columns have no part.
    """
    spark, key = df.sparkSession, columns[0]
    rows = ordered(df, columns, changed, when)
    marks = marks_of(rows)
    sources = marks.agg(F.max("rank")).first()[0]
    if sources is None:
        schema = ", ".join(f"{c} string" for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root"))
        return df.select(key).limit(0).selectExpr(key, *[f"cast(null as string) as {c.split()[0]}" for c in schema.split(", ")], "cast(null as boolean) as verified")
    sources += 1
    nodes = open_nodes(rows, marks, sources)
    forest = reduced(nodes, sources)
    ((root, _),) = forest.open.values()
    made = spark.createDataFrame([(*k, w, d) for k, (d, w) in forest.log.items()], NODE)
    known = nodes.unionByName(made).dropDuplicates(["tree", "level", "index"])
    known = needed(marks, sources).join(known, ["tree", "level", "index"]).select("part", "tree", "level", "index", "digest")
    return proved(rows, marks, known, sources, root).withColumnRenamed("key", key)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents; where the CRC-32 of the id is even, texts without line feeds stand for tampered ones. See ``manifest``."""
    docs = table(spark, sf_dir, "documents")
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return manifest(docs, COLUMNS, {"text": F.replace("text", F.lit("\n"), F.lit(""))}, even & F.contains("text", F.lit("\n")))


def _field(c: str) -> str:
    return f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"


def _leaf(text: str = "text") -> str:
    return f"sha256({' || '.join(_field(text if c == 'text' else c) for c in COLUMNS)})"


#: CRC-32 of the decimal id, bit by bit.
_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))"

#: The same in SQL: levels by recursion, proofs by joins of every level's runs.
OP13_SQL = f"""
    WITH RECURSIVE leaves AS (
           SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n,
                  dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, row_number() OVER () AS r
           FROM (SELECT doc_id, source, {_leaf()} AS leaf, CASE WHEN xor({_CRC}, 4294967295) % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf()} END AS used FROM documents)),
         tree AS (
           SELECT s, 0 AS level, i, n, leaf AS h FROM leaves
           UNION ALL
           SELECT s, any_value(level) + 1, i // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY s, i // 3),
         roots AS (SELECT s, h FROM tree WHERE n = 1),
         top AS (
           SELECT 0 AS level, s AS i, (SELECT count(*) FROM roots) AS n, h FROM roots
           UNION ALL
           SELECT any_value(level) + 1, i // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY i // 3),
         node AS (SELECT s, level, i, h FROM tree UNION ALL SELECT -1, level, i, h FROM top),
         up AS (
           SELECT r, 0 AS step, s AS tree, s, 0 AS level, i, n, used AS h, '' AS proof FROM leaves
           UNION ALL
           SELECT r, step + 1, CASE WHEN n = 1 THEN -1 ELSE tree END, s, CASE WHEN n = 1 THEN 0 ELSE level + 1 END, CASE WHEN n = 1 THEN s ELSE i // 3 END,
                  CASE WHEN n = 1 THEN (SELECT count(*) FROM roots) ELSE (n + 2) // 3 END,
                  CASE WHEN n = 1 THEN h ELSE (SELECT sha256(string_agg(CASE WHEN node.i = up.i THEN up.h ELSE node.h END, '' ORDER BY node.i)) FROM node WHERE node.s = up.tree AND node.level = up.level AND node.i // 3 = up.i // 3) END,
                  CASE WHEN n = 1 THEN proof ELSE proof || coalesce((SELECT string_agg(node.h, '' ORDER BY node.i) FROM node WHERE node.s = up.tree AND node.level = up.level AND node.i // 3 = up.i // 3 AND node.i <> up.i), '') END
           FROM up WHERE n > 1 OR tree >= 0)
    SELECT doc_id, leaf, roots.h AS subroot, top.h AS root, sha256(up.proof) AS proof_sha256, up.h AS folded_root, up.h = top.h AS verified
    FROM leaves JOIN up ON up.r = leaves.r AND up.tree = -1 AND up.n = 1 JOIN roots ON roots.s = leaves.s JOIN top ON top.n = 1
"""
