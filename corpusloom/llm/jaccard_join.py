"""N-gram Jaccard join: count-vector R-trees over the documents that can be near each other.

A document is its set of distinct ``n``-word shingles (hashed to 64 bits).  Documents of one set are one node from
the start, so exact copies cost nothing further.

Shingles are hashed into ``GROUPS`` groups and a node is the point of its group counts.  For two nodes the overlap
is at most the sum over the groups of the smaller count, and a similarity of t needs an overlap of t / (1 + t) of
the two sizes together; a tree whose boxes keep their largest counts and smallest size answers the bound for many
nodes at once.  What survives is verified on the sets themselves.

The trees are built over candidate components, so that no node is compared with the whole corpus: two sets of
similarity t share one of the first ``size - ceil(t size) + 1`` shingles in any fixed order.  The order here is
rarest first, as far as three eighths of all shingles (by hash) tell, which are counted over all nodes: those that
one node has come first, and as they meet nothing they aren't sent on.  (The order decides cost, never results.)
Nodes that share a shingle of these prefixes are joined to the smallest among them - a row a shingle, no pairs -
and the components of these links hold every true link.  Inside a component a breadth-first search compares a node only with nodes not reached yet, so a group
of copies costs about one pass.

Components beyond ``BLOCK`` shingles are dealt to blocks of like sizes: each block is searched alone, then those of
fitting sizes are searched for the component's main member, and then for the nodes that still stand apart from its
largest part; that is exact too, and only those last nodes meet further blocks.

Defined cases: null and empty texts have no shingles and link with nothing, not even each other; a text of fewer
than n words is one shingle of all its words; repeated rows are one node and give a row each; a null id takes part
like any other (rows are known by a hash of id and text), a component's id is the smallest id that is not null, and
null if it has none; a very long text is a block of its own; columns of the input are not carried.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .blobs import LOW6, by_key, schema, six, table, unsix, within
from .blocks import SOLID, U, Block, checkpointed, map_blocks, mix, pieces, reach, starts
from .graph import components

GROUPS = 64
FANOUT = 16
#: Shingles (8 bytes each) of a block of a larger component, and of a bin that smaller ones share.
BLOCK, BIN = 1 << 23, 1 << 19
#: Ratio of the sizes that part a larger component's blocks.
SIZE_STEP = 1.12
#: Rows of the candidates' table that are sent to all tasks; more are joined by shuffle.
BROADCAST_ROWS = 1 << 18
#: A counted shingle that more nodes have comes last in the order.
BUSY = 64
#: Text of one task's documents.
BUCKET_BYTES = 8 << 20


def shingles(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending."""
    b = Block(texts, lower=True)
    b.words(SOLID)
    h = b.word_hashes()
    at, g = b.grams(h, n)
    cut = starts(np.bincount(b.row[at], minlength=b.rows))
    out = []
    for r in range(b.rows):
        own = g[cut[r] : cut[r + 1]]
        if not len(own) and b.first[r + 1] > b.first[r]:
            k = int(b.first[r + 1] - b.first[r])
            own = Block.grams(b, h, k)[1][b.row[Block.grams(b, h, k)[0]] == r]
        out.append(np.unique(own))
    return out


def signature(own: np.ndarray) -> int:
    """One number for a whole set; 64 bits of an order-free sum of mixed hashes."""
    return int(mix((mix(own ^ U(0x2545F4914F6CDD1D)).sum(dtype=U) + U(len(own))).reshape(1))[0].astype(np.int64))


def counted(own: np.ndarray) -> np.ndarray:
    """Which shingles' nodes are counted: three eighths, by hash."""
    return (own & U(7)) < 3


def prefix(own: np.ndarray, least: float, rare: np.ndarray, busy: np.ndarray) -> np.ndarray:
    """Those of a set's first shingles in the common order that another set may have.

    ``rare`` and ``busy`` hold the counted shingles of several nodes.  In order: counted ones of this node alone,
    rare ones, uncounted ones, busy ones, each by hash.
    """
    n = len(own)
    size = n - math.ceil(least * n - 1e-9) + 1
    low = own & LOW6
    kind = np.where(counted(own), np.where(within(low, busy), 3, np.where(within(low, rare), 1, 0)), 2)
    first = np.argsort(kind, kind="stable")[:size]
    return own[first[kind[first] > 0]]


class Tree:
    """A packed R-tree over group counts: per level the boxes' largest counts, smallest and largest sizes."""

    def __init__(self, counts: np.ndarray, size: np.ndarray):
        # sizes bound similarity most, then the heaviest coordinates
        order = np.lexsort((counts[:, 1], counts[:, 0], np.log2(np.maximum(size, 1)).astype(int)))
        self.order, self.levels = order, []
        top, low, high = counts[order], size[order], size[order]
        self.levels.append((top, low, high))
        while len(top) > FANOUT:
            cut = np.arange(0, len(top), FANOUT)
            top, low, high = np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            self.levels.append((top, low, high))

    def search(self, count: np.ndarray, size: int, least: float, alive: np.ndarray) -> np.ndarray:
        """Points (their places in the input) that the bounds allow, of those alive."""
        at = np.arange(len(self.levels[-1][0]))
        for k in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[k]
            if k == 0:
                at = at[alive[self.order[at]]]
            bound = np.minimum(top[at], count).sum(1, dtype=np.int64)
            # overlap o of sizes a and b: o >= t (a + b - o); b alone must lie between t a and a / t
            fits = (bound * (1 + least) >= least * (size + low[at]) - 1e-6) & (high[at] >= least * size - 1e-6) & (low[at] * least <= size + 1e-6)
            at = at[fits]
            if k:
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < len(self.levels[k - 1][0])]
        return self.order[at]


def _counts(sets: list[np.ndarray]) -> np.ndarray:
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    group = (np.concatenate(sets) >> U(58)).astype(np.int64) if len(row) else row
    return np.bincount(row * GROUPS + group, minlength=len(sets) * GROUPS).reshape(len(sets), GROUPS).astype(np.int32)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct hashes."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def search_all(nodes: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The smallest node that each node reaches by links."""
    counts, size = _counts(sets), np.array([len(s) for s in sets])
    label, alive = nodes.copy(), np.ones(len(nodes), bool)
    tree = Tree(counts, size)
    for first in np.argsort(nodes):
        if not alive[first]:
            continue
        alive[first] = False
        queue = [first]
        while queue:
            k = queue.pop()
            label[k] = nodes[first]
            for j in tree.search(counts[k], size[k], percent / 100, alive):
                if _linked(sets[k], sets[j], percent):
                    alive[j] = False
                    queue.append(j)
    return label


def search_for(queries: list[tuple[int, np.ndarray]], labels: np.ndarray, sets: list[np.ndarray], percent: int) -> set[tuple[int, int]]:
    """(label of the query, label of the node) of links between different labels, one link for each two labels."""
    counts, size = _counts(sets), np.array([len(s) for s in sets])
    tree, found = Tree(counts, size), set()
    for own, s in queries:
        done = {own} | {b for a, b in found if a == own}
        for j in tree.search(_counts([s])[0], len(s), percent / 100, ~np.isin(labels, list(done))):
            if labels[j] not in done and _linked(s, sets[j], percent):
                found.add((own, int(labels[j])))
                done.add(int(labels[j]))
    return found


_SET = T.StructType([T.StructField("n", T.LongType()), T.StructField("node", T.LongType())])
#: Not nullable, so that both sides of the self-join read one exchange.
_KEYS = T.StructType([T.StructField("key", T.LongType(), False), T.StructField("node", T.LongType(), False)])
_PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
_BODY = T.StructType([T.StructField("_node", T.LongType()), T.StructField("body", T.BinaryType())])


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """doc, place, n, node of each row; node is null without a shingle."""

    def fn(texts: pa.Array) -> list[pa.Array]:
        own = shingles(texts, n)
        return [pa.array([len(s) for s in own], pa.int64()), pa.array([signature(s) if len(s) else None for s in own], pa.int64())]

    return map_blocks(docs, "text", ["doc", "place"], _SET, fn)


def _places(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc, text and place, a hash of both: rows are found by it, and dealt by it whatever their ids are."""
    return docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"), F.xxhash64(doc_id, text).alias("place"))


_SEEN = schema(bucket=T.LongType(), home=T.LongType(), keys=T.BinaryType())
_MARK = schema(home=T.LongType(), places=T.BinaryType(), rare=T.BinaryType(), busy=T.BinaryType())


def _prefixes(docs: DataFrame, nodes: DataFrame, n: int, percent: int) -> DataFrame:
    """key, node of the prefixes' shingles, from the first row of each node."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, math.ceil(size / BUCKET_BYTES))
    home = F.pmod("place", F.lit(buckets))
    # the texts are dealt once; both visits read the same exchange
    dealt = docs.select(home.alias("home"), "place", "text").groupBy("home")
    none = F.lit(b"")
    firsts = nodes.select(home.alias("home"), F.to_binary(F.lpad(F.hex("place"), 16, "0"), F.lit("hex")).alias("places"), none.alias("rare"), none.alias("busy"))

    def wanted(texts: pa.Table, marks: pa.Table):
        """(node's shingles) of this home's first rows, once each."""
        first = np.unique(np.frombuffer(b"".join(marks.column("places").to_pylist()), ">i8"))
        keep = np.isin(texts.column("place").to_numpy(), first)
        texts, seen = texts.filter(pa.array(keep)), set()
        if texts.num_rows:
            own = texts.column("text").combine_chunks()
            for i, j in pieces(own):
                for s in shingles(own.slice(i, j - i), n):
                    node = signature(s)
                    if len(s) and node not in seen:
                        seen.add(node)
                        yield node, s

    def seen(texts: pa.Table, marks: pa.Table) -> pa.Table:
        if not texts.num_rows or not marks.num_rows:
            return table(_SEEN, [])
        h = np.concatenate([np.zeros(0, U), *(s[counted(s)] for _, s in wanted(texts, marks))])
        where, to = texts.column("home")[0].as_py(), ((h >> U(3)) % U(buckets)).astype(np.int64)
        return table(_SEEN, [(int(to[i[0]]), where, six(h[i])) for i in by_key(to)])

    def shared(t: pa.Table) -> pa.Table:
        own = [unsix(x) for x in t.column("keys").to_pylist()]
        keys, times = np.unique(np.concatenate(own), return_counts=True)
        rare, busy = keys[(times > 1) & (times <= BUSY)], keys[times > BUSY]
        return table(_MARK, [(where, b"", six(np.unique(x[within(x, rare)])), six(np.unique(x[within(x, busy)]))) for where, x in zip(t.column("home").to_pylist(), own, strict=True)])

    def keys(texts: pa.Table, marks: pa.Table) -> pa.Table:
        if not texts.num_rows or not marks.num_rows:
            return table(_KEYS, [])
        rare, busy = (np.unique(unsix(b"".join(marks.column(c).to_pylist()))) for c in ("rare", "busy"))
        found = [(node, prefix(s, percent / 100, rare, busy)) for node, s in wanted(texts, marks)]
        key = np.concatenate([np.zeros(0, U), *(k for _, k in found)]).view(np.int64)
        node = np.repeat(np.array([x for x, _ in found], np.int64), [len(k) for _, k in found])
        return pa.Table.from_arrays([pa.array(key), pa.array(node)], schema=to_arrow_schema(_KEYS))

    marks = dealt.cogroup(firsts.groupBy("home")).applyInArrow(seen, _SEEN).groupBy("bucket").applyInArrow(shared, _MARK)
    return dealt.cogroup(marks.unionByName(firsts).groupBy("home")).applyInArrow(keys, _KEYS)


def _bodies(docs: DataFrame, wanted: DataFrame, n: int, small: bool) -> DataFrame:
    """Columns of ``wanted`` (by place and node) with ``body``, the node's shingles as bytes."""
    rows = docs.join(F.broadcast(wanted) if small else wanted, "place")

    def fn(texts: pa.Array) -> list[pa.Array]:
        own = shingles(texts, n)
        return [pa.array([signature(s) if len(s) else None for s in own], pa.int64()), pa.array([s.tobytes() for s in own], pa.binary())]

    # equal rows only repeat a node
    return map_blocks(rows, "text", [c for c in wanted.columns if c != "place"], _BODY, fn).where("_node = node").drop("_node")


def _sets_of(table: pa.Table, column: str = "body") -> list[np.ndarray]:
    return [np.frombuffer(x, U) for x in table.column(column).to_pylist()]


def links(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(doc, place, n, node) of each row, and (u, root) of each linked node that is not the root of its component."""
    spark = docs.sparkSession
    reach(spark)
    docs = _places(docs, text, doc_id)
    own = checkpointed(_sets(docs, n))
    nodes = own.where("node is not null").groupBy("node").agg(F.min("place").alias("place"), F.max("n").alias("n"))
    keys = checkpointed(_prefixes(docs, nodes, n, percent))
    # nodes meet at each shingle's smallest; minima are taken before the shuffle, and AQE splits what many share
    low = keys.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("key", "a")
    near = components(keys.join(low, "key").where("node > a").select("a", F.col("node").alias("b")).distinct())
    member = near.select(F.col("u").alias("node"), F.col("root").alias("part")).unionByName(near.select(F.col("root").alias("node"), F.col("root").alias("part")).distinct())
    member = checkpointed(member.join(nodes, "node"))
    size = member.groupBy("part").agg(F.sum("n").alias("total"))
    total = size.agg(F.sum("total").alias("t"), F.max("total").alias("m"), F.count("*").alias("c")).first()
    if not total.t:
        return own, near.limit(0)
    bins = max(1, math.ceil(total.t / BIN))
    # small components share bins; a large one is dealt by size, as only sizes within the similarity can link
    place = F.floor(F.log("n") / F.lit(math.log(SIZE_STEP))).cast("long")
    crowd = member.join(size.where(F.col("total") > BLOCK), "part").groupBy("part", place.alias("class")).agg(F.ceil(F.sum("n") / BLOCK).alias("split"))
    own_bin = F.concat_ws("/", F.col("part").cast("string"), F.col("class").cast("string"), F.pmod(F.xxhash64("node"), F.col("split")).cast("string"))
    placed = member.withColumn("class", place).join(crowd, ["part", "class"], "left").select("place", "node", "part", "class", "n", F.when(F.col("split").isNotNull(), own_bin).otherwise(F.pmod(F.xxhash64("part"), F.lit(bins)).cast("string")).alias("bin"), F.col("split").isNotNull().alias("large"))
    placed = checkpointed(placed)
    small = placed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    # dealt once: a checkpoint keeps its partitioning, so no later visit moves the sets again
    bodies = checkpointed(_bodies(docs, placed.select("place", "node", "part", "bin"), n, small).repartition(max(bins, int(spark.conf.get("spark.sql.shuffle.partitions"))), "bin"))

    def local(t: pa.Table) -> pa.Table:
        part, node, sets = t.column("part").to_numpy(), t.column("node").to_numpy(), _sets_of(t)
        a, b = [], []
        order = np.argsort(part, kind="stable")
        for own_ in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            if len(own_) > 1:
                a.append(search_all(node[own_], [sets[i] for i in own_], percent))
                b.append(node[own_])
        return pa.table({"a": pa.array(np.concatenate([*a, np.zeros(0, np.int64)])), "b": pa.array(np.concatenate([*b, np.zeros(0, np.int64)]))})

    found = checkpointed(bodies.groupBy("bin").applyInArrow(local, _PAIR))
    large = placed.where("large")
    if total.m <= BLOCK:
        return own, components(found)

    def across(t: pa.Table, more: pa.Table) -> pa.Table:
        """Links between the nodes of a bin (left) and the queries among the right rows; the others there are labels."""
        kinds = more.column("query").is_valid()
        queries, labels = more.filter(kinds), more.filter(pc.invert(kinds))
        if not t.num_rows or not queries.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        of = dict(zip(labels.column("who").to_pylist(), labels.column("label").to_pylist(), strict=True))
        own_ = np.array([of.get(x, x) for x in t.column("node").to_pylist()], np.int64)
        asked = list(zip(queries.column("label").to_pylist(), _sets_of(queries, "query"), strict=True))
        pairs = sorted(search_for(asked, own_, _sets_of(t), percent))
        return pa.table({"a": pa.array([x for x, _ in pairs], pa.int64()), "b": pa.array([y for _, y in pairs], pa.int64())})

    for everyone in (False, True):
        # first the main members of each component, then all nodes that still stand apart from its largest part
        labelled = large.join(components(found), F.col("node") == F.col("u"), "left").select("part", "bin", "class", "node", "n", F.coalesce("root", "node").alias("label"))
        weight = labelled.groupBy("part", "label").agg(F.count("*").alias("c"), F.max_by("node", "n").alias("one"))
        main = weight.groupBy("part").agg(F.max_by(F.struct("label", "one"), F.struct("c", "label")).alias("main"))
        asked = labelled.join(main, "part").where(F.col("label") != F.col("main.label") if everyone else F.col("node") == F.col("main.one"))
        low, high = (F.floor(F.log(F.col("n") * F.lit(x)) / F.lit(math.log(SIZE_STEP))).cast("long") for x in (percent / 100 * 0.999, 100 / percent * 1.001))
        routes = asked.select("part", "node", "label", F.explode(F.sequence(F.greatest(low, F.lit(0)), high)).alias("class")).join(labelled.select("part", "class", "bin").distinct(), ["part", "class"])
        who = asked.select("node").distinct()
        few = who.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        # the few sets asked for are picked where they lie
        asked_sets = bodies.join(F.broadcast(who) if few else who, "node", "left_semi").select("node", F.col("body").alias("query"))
        sent = routes.select("node", "label", F.col("bin").alias("to")).join(asked_sets, "node").select("to", F.col("node").alias("who"), "label", "query")
        told = labelled.where("label <> node").select(F.col("bin").alias("to"), F.col("node").alias("who"), "label", F.lit(None).cast("binary").alias("query"))
        met = bodies.groupBy("bin").cogroup(sent.unionByName(told).groupBy("to")).applyInArrow(across, _PAIR)
        found = checkpointed(found.unionByName(met))
    return own, components(found)


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = 5, percent: int = 80) -> DataFrame:
    """doc, place, n (size of its set) and component, the smallest id that it reaches by links, of every row."""
    own, roots = links(docs, text, doc_id, n, percent)
    joined = own.join(roots.select(F.col("u").alias("node"), "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = joined.where("root is not null").groupBy("root").agg(F.min("doc").alias("component"), F.min(F.struct(F.col("doc").isNull(), "doc", "place")).alias("first"))
    return joined.join(smallest, "root", "left").select("doc", "place", "n", F.coalesce("component", "doc").alias("component"), F.coalesce("first.place", "place").alias("first"))


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id, null ids last; equal rows are one.

    Rows without a word have no component and stay.
    """
    found = checkpointed(classes(docs, text, doc_id, **options))
    copies = found.where("place <> first").select(F.col("place").alias("place of a copy")).distinct()
    place = F.xxhash64(doc_id, text)
    left = docs.join(copies, place == F.col("place of a copy"), "left_anti")
    if found.where("n > 0").groupBy("place").count().where("count > 1").limit(1).count():
        worded = F.col(text).rlike(r"[^\x20\x09-\x0D]")
        left = left.where(worded).dropDuplicates([doc_id, text]).unionByName(left.where(~F.coalesce(worded, F.lit(False))))
    return left


def op8_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    out = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
