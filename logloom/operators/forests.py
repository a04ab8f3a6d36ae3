"""L7 + L8 joined: links that connect what similar pairs connect, without listing the pairs.

Contents that can be similar meet in a bucket: a rare-first prefix token (with
its occurrence), or, for the rule "the shorter text lies inside the longer", a
piece of the shorter text that the longer one must hold too.  Within a bucket a
spanning forest of the similar pairs is grown: a content is compared only with
those that no tree has reached yet, so a dense bucket of k contents costs about
k comparisons and gives k - 1 links.  The union of the forests has the same
components as all similar pairs (every such pair shares a bucket).

Buckets beyond ``BLOCK_ROWS`` contents are cut into blocks by a hash of the id,
and each pair of blocks is a task's work of its own; no bucket is left out.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .align import lcs_length, token_masks
from .similarity import MIN_DYNAMIC_THRESHOLD, components, dynamic_threshold, similar_pairs

BLOCK_ROWS = 4096


class _Node:
    __slots__ = ("id", "text", "tokens", "first", "last", "least", "own", "masks")

    def __init__(self, row: dict):
        self.id, self.text, self.tokens = row["id"], row["text"], row["tokens"]
        self.first, self.last, self.least, self.own = row["min_line"], row["max_line"], row["least"], row["own"]
        self.masks = None

    def lcs(self, other: _Node) -> float:
        """L1."""
        short, long = (self, other) if len(self.text) <= len(other.text) else (other, self)
        if short.text in long.text:
            return 1.0
        m, n = len(self.tokens), len(other.tokens)
        if abs(m - n) > min(m, n):
            return 0.0
        if self.masks is None:
            self.masks = token_masks(self.tokens)
        return lcs_length(self.masks, m, other.tokens) / min(m, n)

    def jaccard(self, other: _Node) -> float:
        """L3."""
        a, b = set(self.tokens), set(other.tokens)
        return len(a & b) / len(a | b)


def _forest(nodes: list[_Node], score, dynamic: bool) -> list[tuple]:
    """Spanning forest of the similar pairs of a bucket in which one side at least owns the bucket's key."""
    out, left = [], sorted(nodes, key=lambda x: not x.own)
    while len(left) > 1 and left[0].own:  # what is left without an owner has no pair
        stack, left = [left[0]], left[1:]
        while stack and left:
            x, rest = stack.pop(), []
            for y in left:
                near = False
                if x.own or y.own:
                    s = score(x, y)
                    near = (s >= x.least and (not dynamic or x.first < y.last)) or (s >= y.least and (not dynamic or y.first < x.last))
                if near:
                    out.append((x.id, y.id))
                    stack.append(y)
                else:
                    rest.append(y)
            left = rest
    return out


def _grow(measure: str, dynamic: bool):
    """Task over rows sorted by (key, sub): the links of each run."""
    def run(batches):
        score = getattr(_Node, measure)
        key, held = None, []

        def links(found):
            return pa.RecordBatch.from_pydict({"src": pa.array([a for a, _ in found], kind), "dst": pa.array([b for _, b in found], kind)})

        for batch in batches:
            kind = batch.schema.field("id").type
            for at in range(0, batch.num_rows, 1000):
                for row in batch.slice(at, 1000).to_pylist():
                    if (row["key"], row["sub"]) != key:
                        if len(held) > 1 and (found := _forest(held, score, dynamic)):
                            yield links(found)
                        key, held = (row["key"], row["sub"]), []
                    held.append(_Node(row))
        if len(held) > 1 and (found := _forest(held, score, dynamic)):
            yield links(found)

    return run


# ---- buckets ------------------------------------------------------------------------

def _prefix_keys(nodes: DataFrame, measure: str, least: float) -> DataFrame:
    """(key, id): tokens, with their occurrence, of the rare-first prefixes."""
    occ = (nodes.select("id", F.posexplode("tokens").alias("pos", "token"))
           .withColumn("occ", F.row_number().over(Window.partitionBy("id", "token").orderBy("pos"))))
    if measure == "jaccard":
        occ = occ.where("occ = 1")
    ranked = occ.join(occ.groupBy("token", "occ").agg(F.count(F.lit(1)).alias("df")), ["token", "occ"])
    ranked = (ranked.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("id")))
              .withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("df", "token", "occ"))))
    # LCS: a partner has at least half as many tokens (its length gap would count as 0 otherwise)
    size = F.ceil(F.col("m") / 2) if measure == "lcs" else F.col("m")
    need = F.greatest(F.lit(1), F.ceil(F.lit(least) * size - 1e-9))
    return ranked.where(F.col("rank") <= F.col("m") - need + 1).select(F.xxhash64(F.lit("p"), "token", "occ").alias("key"), "id")


def _grams(word: Column, longest: int = 3) -> Column:
    """Distinct character grams of 1 to ``longest`` characters."""
    n = F.length(word)
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), n)), lambda g: F.transform(
        F.sequence(F.lit(1), n - g + 1), lambda i: F.substr(word, i, g)))))


def _inside_keys(nodes: DataFrame) -> DataFrame:
    """(key, id, own): owners are texts that may lie inside others, which hold the same key.

    A text of three words or more holds its inner words whole, so the rarest of
    them is its key; one of two words the last letter, space and first letter
    between them; one of a single word its rarest gram.
    """
    txt = nodes.select("id", F.array_join("tokens", " ").alias("s")).where(F.length("s") > 0).select("id", F.split("s", " ").alias("w"))
    m = F.size("w")
    words = txt.select("id", F.explode(F.array_distinct("w")).alias("k"))
    inner = txt.where(m > 2).select("id", F.explode(F.array_distinct(F.slice("w", F.lit(2), m - 2))).alias("k"))
    gaps = F.array_distinct(F.zip_with(F.slice("w", F.lit(1), m - 1), F.slice("w", F.lit(2), m - 1),
                                       lambda a, b: F.concat(F.right(a, F.lit(1)), F.lit(" "), F.left(b, F.lit(1)))))
    gap = txt.where(m > 1).select("id", F.explode(gaps).alias("k"), (m == 2).alias("own"))
    single = txt.where((m == 1) & (F.length(F.col("w")[0]) > 0)).select("id", F.col("w")[0].alias("word"))
    grams = txt.select("id", F.explode(F.array_distinct(F.flatten(F.transform(F.filter("w", lambda x: x != ""), _grams)))).alias("k"))
    own_grams = single.select("id", F.explode(F.filter(_grams(F.col("word")), lambda g: F.length(g) == F.least(F.lit(3), F.length("word")))).alias("k"))

    def rarest(own: DataFrame, every: DataFrame) -> DataFrame:
        df = every.groupBy("k").agg(F.count(F.lit(1)).alias("df"))
        return own.join(df, "k").groupBy("id").agg(F.min(F.struct("df", "k")).alias("x")).select("id", F.col("x.k").alias("k"))

    def keyed(kind: str, own: DataFrame, every: DataFrame) -> DataFrame:
        """Owners and holders of the keys that have an owner."""
        named = own.select("id", "k", F.lit(True).alias("own"))
        held = every.join(own.select("k").distinct(), "k", "left_semi").select("id", "k", F.lit(False).alias("own"))
        return named.unionByName(held).select(F.xxhash64(F.lit(kind), "k").alias("key"), "id", "own")

    return (keyed("w", rarest(inner, words), words)
            .unionByName(keyed("g", gap.where("own").select("id", "k"), gap.select("id", "k")))
            .unionByName(keyed("c", rarest(own_grams, grams), grams)))


def similar_links(contents: DataFrame, measure: str = "lcs", sim_th: float = 0.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links (src, dst) of ``contents(id, tokens, min_line, max_line)`` with the components of all similar pairs.

    The threshold is ``sim_th``, or if that is 0 the dynamic one of the earlier
    content (L5).  Contents without tokens have no links.  Every link is a similar pair.
    """
    nodes = contents.where(F.size("tokens") > 0)
    dynamic = not sim_th > 0
    keys = _prefix_keys(nodes, measure, MIN_DYNAMIC_THRESHOLD if dynamic else sim_th).withColumn("own", F.lit(True))
    if measure == "lcs":
        keys = keys.unionByName(_inside_keys(nodes))
    keys = keys.groupBy("key", "id").agg(F.max("own").alias("own"))
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("owners")).where("n > 1 AND owners > 0")
    sizes = sizes.select("key", F.ceil(F.col("n") / F.lit(block_rows)).alias("blocks"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks"))
    subs = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.least(block, o) * F.col("blocks") + F.greatest(block, o)))
    placed = keys.join(sizes, "key").select("key", "id", "own", F.explode(subs).alias("sub"))
    least = dynamic_threshold(F.size("tokens")) if dynamic else F.lit(float(sim_th))
    rows = placed.join(nodes.select("id", F.array_join("tokens", " ").alias("text"), "tokens", "min_line", "max_line", least.alias("least")), "id")
    kind = contents.schema["id"].dataType.simpleString()
    return (rows.repartition("key", "sub").sortWithinPartitions("key", "sub")
            .mapInArrow(_grow(measure, dynamic), f"src {kind}, dst {kind}").distinct())


def linked_components(contents: DataFrame, measure: str = "lcs", sim_th: float = 0.0) -> DataFrame:
    """(id, component) of ``contents``: the smallest id that similar pairs connect it with."""
    if measure in ("lcs", "jaccard"):
        links = similar_links(contents, measure, sim_th)
    else:
        links = similar_pairs(contents, measure, sim_th).select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"))
    return components(contents, links)


def similarity_clusters(catch_all: DataFrame, measure: str = "lcs", sim_th: float = 0.0) -> DataFrame:
    """Catch-all contents -> (canon, cluster_key) by connected components."""
    nodes = catch_all.select(F.col("canon").alias("id"), "tokens", "min_line", "max_line")
    return linked_components(nodes, measure, sim_th).select(
        F.col("id").alias("canon"), F.concat(F.lit("<*>#"), F.md5("component")).alias("cluster_key"))

