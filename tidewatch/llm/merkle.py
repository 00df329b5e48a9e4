"""Merkle manifest of a dataset by butterfly exchange.

Leaves are ordered by document id within their source and cut into aligned partitions of ``fanout``^3 leaves. A partition
hashes its own leaves up to one subtree root. From there on, aligned groups of ``fanout`` subtrees swap their roots round by
round: in a round every partition of a subtree meets one partition of each neighbouring subtree, takes the neighbours'
roots as proof siblings and hashes the common ancestor itself, as all others of the group do. After the last round every
partition holds its whole upper proof; nothing is sent back down the tree. The same rounds go on over the subroots of the
sources, in the order of their names, up to the root of the dataset.

A round is one shuffle of the partitions' rows. Where subtrees have different numbers of partitions (the last one of a
source, and sources among each other), a partition of a smaller subtree serves several of the larger ones.

Everything is DataFrame functions. A hot source is many partitions; positions within a source come from a range shuffle
whose last key is unique, so even a third of all rows with one id are dealt out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LOCAL = 3  # levels of a partition's own tree
HEX = 64  # characters of a digest
PATH = "array<struct<l: string, r: string>>"


def digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def field(value: Column) -> Column:
    """A value as the leaf holds it: ``-`` for null, else its UTF-8 length, a colon, and itself."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(row, text: Column | None = None) -> Column:
    """The leaf of a document; ``row`` gives the column of a field, ``text`` stands in for the document's text."""
    return digest(F.concat(*[field(text if f == "text" and text is not None else row(f)) for f in FIELDS]))


def numbered(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaves with src and pos, sources with src, source, size): the place of every leaf within its source, and the number
    of the source, both from 0 and in order. ``leaves`` has source, doc_id, leaf and ``carried``."""
    ordered = leaves.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange("source", "doc_id", "leaf", "tie")
    ordered = ordered.sortWithinPartitions("source", "doc_id", "leaf", "tie").drop("tie")
    # the id is the task's number and the place in its sorted rows
    at = F.monotonically_increasing_id()
    rows = staged(ordered.withColumn("at", at).withColumn("part", F.shiftright("at", 33)), "leaves")
    runs = staged(rows.groupBy("source", "part").agg(F.min("at").alias("first"), F.count("*").alias("n")), "runs")
    sources = runs.groupBy("source").agg(F.min("part").alias("part"), F.sum("n").alias("size"))
    # sources by the task they begin in: their order within it, after all that begin in earlier tasks
    per_task = sources.groupBy("part").agg(F.count("*").alias("begin"))  # one row a task
    before = F.coalesce(F.sum("begin").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("part").orderBy("source")) - 1
    sources = staged(sources.withColumn("k", within).join(per_task.select("part", before.alias("before")), "part").select(
        (F.col("before") + F.col("k")).alias("src"), "source", F.col("size")), "sources")
    place = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = staged(runs.select(F.col("source").alias("s"), F.col("part").alias("p"), (place - F.col("first")).alias("shift")).join(
        sources.select("src", "size", F.col("source").alias("s2")), F.col("s").eqNullSafe(F.col("s2"))).drop("s2"), "places")
    placed = rows.join(runs, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    return placed.select("src", "size", (F.col("at") + F.col("shift")).alias("pos"), "leaf", "carried"), sources


def _sides(run: Column, place: Column) -> Column:
    """The siblings of the node at ``place`` (from 0) of a run, left and right of it. A run is its nodes' hex digests joined."""
    return F.struct(F.substring(run, F.lit(1), place * HEX).alias("l"), F.substring(run, place * HEX + (HEX + 1), F.octet_length(run)).alias("r"))


def _runs(nodes: Column, fanout: int) -> Column:
    """Every ``fanout`` consecutive nodes joined."""
    starts = F.sequence(F.lit(1), F.size(nodes), F.lit(fanout))
    return F.transform(starts, lambda k: F.array_join(F.slice(nodes, k, F.lit(fanout)), ""))


def _more(level: int, fanout: int) -> Column:
    """Whether the source has several nodes left on a level, so that they are hashed."""
    return F.col("size") > fanout**level


def partition_trees(placed: DataFrame, fanout: int) -> DataFrame:
    """One row for each partition: src, size, block, its subtree root ``node``, what its leaves carry, in order, and the runs
    of each level. A partition has at most ``fanout``^LOCAL leaves."""
    block = F.floor(F.col("pos") / fanout**LOCAL).cast("long")
    rows = placed.groupBy("src", "size", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "leaf", "carried"))).alias("kids"))
    trees = rows.select("src", "size", "block", F.transform("kids", lambda k: k["carried"]).alias("carried"), F.transform("kids", lambda k: k["leaf"]).alias("nodes"))
    for level in range(LOCAL):
        trees = trees.withColumn(f"runs{level}", _runs(F.col("nodes"), fanout)).withColumn("nodes", F.transform(f"runs{level}", digest))
        trees = trees.withColumn(f"node{level}", F.col("nodes")[0])
    node = F.coalesce(*[F.when(_more(level, fanout), F.col(f"node{level}")) for level in reversed(range(LOCAL))], F.col("runs0")[0])
    return trees.select("src", "size", "block", "carried", *[f"runs{level}" for level in range(LOCAL)], node.alias("node"))


def leaves_of(trees: DataFrame, fanout: int) -> DataFrame:
    """One row for each leaf of the partitions: ``kid`` (leaf, carried, local path); other columns stay."""

    def kid(carried: Column, i: Column) -> Column:
        paths, at = [], i
        for level in range(LOCAL):
            run = F.get(F.col(f"runs{level}"), F.floor(at / fanout).cast("int"))
            place = (at % fanout).cast("int")
            if level == 0:
                leaf_ = F.substring(run, place * HEX + 1, F.lit(HEX))
            paths.append(F.when(_more(level, fanout), F.array(_sides(run, place))).otherwise(F.array().cast(PATH)))
            at = F.floor(at / fanout)
        return F.struct(leaf_.alias("leaf"), carried.alias("carried"), F.concat(*paths).alias("path"))

    return trees.withColumn("kid", F.explode(F.transform("carried", kid)))


def swap(rows: DataFrame, fanout: int) -> DataFrame:
    """One round of the exchange. ``rows``: one for each partition, with tree, node number ``t`` of its subtree at this
    level, ``i`` of the ``m`` partitions of the subtree, ``most`` of any subtree in its group, node, path, and ``own``
    (what travels along). Returns own, node and path after the round."""
    slots = F.sequence(F.col("i"), F.greatest(F.col("most") - 1, F.col("i")), F.col("m"))
    sent = rows.withColumn("slot", F.explode(slots)).select(
        "tree", F.floor(F.col("t") / fanout).cast("long").alias("up"), "slot",
        F.struct((F.col("t") % fanout).alias("place"), "node", F.when(F.col("slot") == F.col("i"), F.struct("own", "path")).alias("mine")).alias("x"))
    met = sent.groupBy("tree", "up", "slot").agg(F.array_sort(F.collect_list("x"), lambda a, b: (a["place"] - b["place"]).cast("int")).alias("all"))
    met = met.withColumn("run", F.array_join(F.transform("all", lambda x: x["node"]), "")).withColumn("top", digest(F.col("run")))
    back = met.select("run", "top", F.posexplode("all").alias("k", "x")).where("x.mine is not null")
    return back.select("x.mine.own", F.col("top").alias("node"), F.concat("x.mine.path", F.array(_sides(F.col("run"), F.col("k")))).alias("path"))


def exchange_within(blocks: DataFrame, fanout: int, most_blocks: int) -> DataFrame:
    """Rounds among the partitions of each source. ``blocks``: own (src, size, block, blocks), node, path."""
    done, width = None, 1
    while width < most_blocks:
        open_ = F.col("own.blocks") > width
        rest = blocks.where(~open_)
        done = rest if done is None else done.unionByName(rest)
        b, n = F.col("own.block"), F.col("own.blocks")
        t = F.floor(b / width).cast("long")
        first = (t - t % fanout) * width  # the first partition of the group: its subtree is the largest
        blocks = swap(blocks.where(open_).select(
            F.col("own.src").alias("tree"), t.alias("t"), (b - t * width).alias("i"), F.least(F.lit(width), n - t * width).alias("m"),
            F.least(F.lit(width), n - first).alias("most"), "node", "path", "own"), fanout)
        width *= fanout
    return blocks if done is None else done.unionByName(blocks)


def exchange_across(blocks: DataFrame, sizes: DataFrame, fanout: int, n_sources: int) -> DataFrame:
    """Rounds among the sources' partitions. ``sizes``: src and its number of partitions, ``blocks``."""
    level, width = sizes.select("src", F.lit(0).cast("long").alias("before"), F.col("blocks").alias("m")), 1
    # level: for each source, its subtree's partitions and how many of them belong to earlier sources of the subtree
    while width < n_sources:
        t = F.floor(F.col("src") / width).cast("long")
        trees = level.groupBy(t.alias("t")).agg(F.max("m").alias("m"))
        group = F.floor(F.col("t") / fanout).cast("long")
        trees = trees.select("t", group.alias("g"), F.max("m").over(Window.partitionBy(group)).alias("most"), F.sum("m").over(Window.partitionBy(group)).alias("total"),
                             F.coalesce(F.sum("m").over(Window.partitionBy(group).orderBy("t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
        known = staged(level.withColumn("t", t).join(trees, "t"), "level")
        blocks = swap(blocks.join(known.withColumnRenamed("src", "s"), F.col("own.src") == F.col("s")).select(
            F.lit(0).alias("tree"), "t", (F.col("before") + F.col("own.block")).alias("i"), "m", "most", "node", "path", "own"), fanout)
        level = known.select("src", (F.col("before") + F.col("earlier")).alias("before"), F.col("total").alias("m"))
        width *= fanout
    return blocks


def manifest(docs: DataFrame, fanout: int = 16, carried: Column | None = None) -> DataFrame:
    """One row for each document of ``docs`` (doc_id, source, lang, n_chars, text): doc_id, source, leaf, subroot, root, its
    ``path`` (proof siblings level by level, left and right of the node, as joined hex digests) and ``carried``, a value
    computed from the document's row on the way (none: null).

    A leaf is the SHA-256 of the fields, each ``-`` if null, else length, colon and value. Per source, leaves ascend by
    doc_id (null first, then rows of one id by their leaf); a null source is a source of its own and comes first. Empty and
    very long texts are values like others. Equal rows are equal leaves and each counts. An empty table gives no rows. Other
    columns are left out, whatever their names.
    """
    leaves = docs.select("source", "doc_id", leaf(F.col).alias("leaf"), F.struct("doc_id", "source", (F.lit(None).cast("string") if carried is None else carried).alias("value")).alias("carried"))
    placed, sources = numbered(leaves)
    trees = staged(partition_trees(placed, fanout), "trees")
    size = F.ceil(F.col("size") / fanout**LOCAL).cast("long")
    sizes = sources.select("src", size.alias("blocks"))
    most, n_sources = sizes.agg(F.max("blocks"), F.count("*")).first()
    own = F.struct("src", "block", size.alias("blocks"))
    blocks = trees.select(own.alias("own"), "node", F.array().cast(PATH).alias("path"))
    blocks = staged(exchange_within(blocks, fanout, most or 0).withColumn("own", F.struct("own.src", "own.block", F.col("node").alias("subroot"))), "within")
    blocks = staged(exchange_across(blocks, sizes, fanout, n_sources), "across").select(
        F.col("own.src").alias("s"), F.col("own.block").alias("b"), F.col("own.subroot").alias("subroot"), F.col("node").alias("root"), F.col("path").alias("upper"))
    held = leaves_of(trees.join(blocks, (F.col("src") == F.col("s")) & (F.col("block") == F.col("b"))), fanout)
    return held.select("kid.carried.doc_id", "kid.carried.source", "kid.leaf", "subroot", "root", F.concat("kid.path", "upper").alias("path"), F.col("kid.carried.value").alias("carried"))


def proof_digest(path: Column) -> Column:
    """The hash of all siblings of a path."""
    return digest(F.array_join(F.transform(path, lambda p: F.concat(p["l"], p["r"])), ""))


def folded(leaf_: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to. A path entry without siblings is a run of one."""
    return F.aggregate(path, leaf_, lambda node, p: digest(F.concat(p["l"], node, p["r"])))


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document, a fifth of them tampered with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    altered = F.when(tampered, leaf(F.col, F.translate("text", UPPER, LOWER)))
    found = manifest(docs, carried=altered)
    root = folded(F.coalesce("carried", "leaf"), F.col("path"))
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), root.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def _sql() -> str:
    """The manifest level by level: up to 16^5 leaves of a source and 16^3 sources."""
    crc = ("xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(d) + 1), lambda i: "
           "[ascii(d[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), "
           "lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)")
    part = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    fields = lambda text: "sha256(" + " || ".join(part(text if f == "text" else f) for f in FIELDS) + ")"
    sql = [f"""WITH docs AS (SELECT *, CAST(doc_id AS VARCHAR) AS d, {fields('text')} AS leaf FROM documents),
marked AS (SELECT doc_id, source, leaf, CASE WHEN {crc} % 5 = 0 THEN {fields(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE leaf END AS other FROM docs),
l0 AS (SELECT doc_id, source, leaf, leaf AS node, other AS fold, '' AS proof,
       row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM marked)"""]

    def level(src: str, dst: str, keys: str, more: str, n: str) -> str:
        # nodes of this level, hashed in runs of 16; then every leaf takes the siblings of its node
        return f"""{dst}_nodes AS (SELECT DISTINCT {keys}pos, node FROM {src}),
{dst}_runs AS (SELECT {keys}pos // 16 AS up, sha256(string_agg(node, '' ORDER BY pos)) AS top, list(node ORDER BY pos) AS nodes FROM {dst}_nodes GROUP BY ALL),
{dst} AS (SELECT x.* EXCLUDE (node, fold, proof, pos, {n}), CASE WHEN {n} > 1 THEN top ELSE node END AS node,
  CASE WHEN {n} > 1 THEN sha256(array_to_string(nodes[1 : pos % 16], '') || fold || array_to_string(nodes[pos % 16 + 2 :], '')) ELSE fold END AS fold,
  CASE WHEN {n} > 1 THEN proof || array_to_string(nodes[1 : pos % 16], '') || array_to_string(nodes[pos % 16 + 2 :], '') ELSE proof END AS proof,
  pos // 16 AS pos, ({n} + 15) // 16 AS {n}
  FROM {src} AS x JOIN {dst}_runs AS r ON {more}r.up = x.pos // 16)"""

    for k in range(5):
        sql.append(level(f"l{k}", f"l{k + 1}", "source, ", "r.source IS NOT DISTINCT FROM x.source AND ", "n"))
    sql.append("""s0 AS (SELECT * EXCLUDE (pos, n), node AS subroot, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS pos,
       (SELECT count(*) FROM (SELECT DISTINCT source FROM l0)) AS n FROM l5)""")
    for k in range(3):
        sql.append(level(f"s{k}", f"s{k + 1}", "", "", "n"))
    sql.append("SELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = node AS verified FROM s3")
    return ",\n".join(sql[:-1]) + "\n" + sql[-1]


SQL = _sql()
