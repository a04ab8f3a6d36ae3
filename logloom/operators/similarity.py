"""Similarity of catch-all contents and their connected components (``forests`` joins L7 and L8).

Pairs are never enumerated per group.  For Jaccard and cosine ``similar_pairs``
compares blocks of contents (``blocks``), for Jaccard with the dynamic threshold
those that share a rare token (``prefixes``).  For LCS it uses prefix filtering
(tokens in rare-first global order; two contents can only pass the threshold if
their short prefixes share a token) plus a character-gram join for the substring
rule, then scores candidates with JVM expressions.
``components`` is large-star / small-star label contraction on an edge
DataFrame, checkpointed every round.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .blocks import block_pairs
from .prefixes import prefix_pairs

# Smallest value of the dynamic threshold 1 - log2(n)/n over n >= 1 (at n = 3),
# rounded down; used only to size candidate prefixes safely.
MIN_DYNAMIC_THRESHOLD = 0.4716
FOREST_NODES = 1_000_000  # a task's trees hold at once


def dynamic_threshold(n: Column) -> Column:
    """1 - log2(n)/n."""
    return F.lit(1.0) - F.log2(n) / n


def lcs_len_col(a: Column | str, b: Column | str) -> Column:
    """L2: token LCS length by a row-by-row DP fold, evaluated in the JVM."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b

    def row_step(prev, x):
        return F.aggregate(F.sequence(F.lit(1), F.size(b)), F.array(F.lit(0)),
                           lambda cur, j: F.concat(cur, F.array(
                               F.when(x == F.element_at(b, j), F.element_at(prev, j) + 1)
                               .otherwise(F.greatest(F.element_at(cur, j), F.element_at(prev, j + 1))))))

    init = F.array_repeat(F.lit(0), F.size(b) + 1)
    full = F.aggregate(a, init, row_step, lambda r: F.element_at(r, F.size(b) + 1))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0)).otherwise(full)


def lcs_similarity(a_tok: Column, b_tok: Column) -> Column:
    """L1: equal -> 1; shorter text inside longer -> 1; length gap > shorter -> 0; else LCS/min."""
    sa, sb = F.array_join(a_tok, " "), F.array_join(b_tok, " ")
    la, lb = F.size(a_tok), F.size(b_tok)
    longer = F.when(F.length(sa) >= F.length(sb), sa).otherwise(sb)
    shorter = F.when(F.length(sa) >= F.length(sb), sb).otherwise(sa)
    mn = F.least(la, lb)
    return (F.when(sa == sb, F.lit(1.0))
            .when(F.instr(longer, shorter) > 0, F.lit(1.0))
            .when(F.abs(la - lb) > mn, F.lit(0.0))
            .when(mn > 0, lcs_len_col(a_tok, b_tok) / mn)
            .otherwise(F.lit(0.0)))


def jaccard_similarity(a_tok: Column, b_tok: Column) -> Column:
    """L3: |A n B| / |A u B| over token sets, 0 when both are empty."""
    u = F.size(F.array_union(a_tok, b_tok))
    return F.when(u == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a_tok, b_tok)) / u)


def cosine_similarity(a_tok: Column, b_tok: Column) -> Column:
    """L4 (extension): cosine of token-count vectors.  The reference's option
    returns a constant 1; this computes the real value."""
    keys = F.array_union(a_tok, b_tok)
    ca = F.transform(keys, lambda k: F.size(F.filter(a_tok, lambda x: x == k)))
    cb = F.transform(keys, lambda k: F.size(F.filter(b_tok, lambda x: x == k)))
    dot = F.aggregate(F.zip_with(ca, cb, lambda x, y: x * y), F.lit(0), lambda acc, v: acc + v)
    na = F.aggregate(ca, F.lit(0), lambda acc, v: acc + v * v)
    nb = F.aggregate(cb, F.lit(0), lambda acc, v: acc + v * v)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(
        dot.cast("double") / F.sqrt(na.cast("double") * nb.cast("double")))


MEASURES = {"lcs": lcs_similarity, "jaccard": jaccard_similarity, "cosine": cosine_similarity}


def score_pairs(pairs: DataFrame, measure: str = "lcs") -> DataFrame:
    """Score a pair table with columns a_tokens, b_tokens."""
    return pairs.withColumn("score", MEASURES[measure](F.col("a_tokens"), F.col("b_tokens")))


def _prefix_candidates(nodes: DataFrame, t_lb: float = MIN_DYNAMIC_THRESHOLD) -> DataFrame:
    """Pairs whose rare-first prefixes share a (token, occurrence)."""
    occ = (nodes.select("id", F.posexplode("tokens").alias("pos", "token"))
           .withColumn("occ", F.row_number().over(Window.partitionBy("id", "token").orderBy("pos"))))
    df = occ.groupBy("token", "occ").agg(F.count(F.lit(1)).alias("df"))
    ranked = occ.join(df, ["token", "occ"])
    size = F.count(F.lit(1)).over(Window.partitionBy("id"))
    ranked = (ranked.withColumn("m", size)
              .withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("df", "token", "occ"))))
    # any partner with score > 0 has at least ceil(m/2) tokens (length gap rule)
    need = F.greatest(F.lit(1), F.ceil(F.lit(t_lb) * F.ceil(F.col("m") / 2) - 1e-9))
    prefix = ranked.where(F.col("rank") <= F.col("m") - need + 1).select("id", "token", "occ")
    a, b = prefix.alias("a"), prefix.alias("b")
    return (a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.occ") == F.col("b.occ"))
                   & (F.col("a.id") < F.col("b.id")))
            .select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id")))


def _substring_candidates(nodes: DataFrame, q: int = 3) -> DataFrame:
    """Pairs where the shorter text may lie inside the longer one.

    The shorter side contributes its rarest character gram (or the whole
    text when shorter than ``q``); the longer side all its distinct grams
    of length 1..q.  A substring always contains every gram of itself.
    """
    txt = nodes.select("id", F.array_join("tokens", " ").alias("s")).withColumn("ln", F.length("s"))
    grams = (txt.select("id", "ln", F.explode(F.expr(
        f"array_distinct(flatten(transform(sequence(1, least({q}, ln)), g -> "
        f"transform(sequence(1, ln - g + 1), i -> substring(s, i, g)))))")).alias("g"))
        .where("ln > 0"))
    freq = grams.groupBy("g").agg(F.count(F.lit(1)).alias("gf"))
    own = (grams.where((F.length("g") == F.least(F.lit(q), F.col("ln"))))
           .join(freq, "g")
           .withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("gf", "g")))
           .where("r = 1").select(F.col("id").alias("s_id"), F.col("ln").alias("s_ln"), "g"))
    return (own.join(grams.select(F.col("id").alias("l_id"), F.col("ln").alias("l_ln"), "g"), "g")
            .where((F.col("l_id") != F.col("s_id")) & (F.col("l_ln") >= F.col("s_ln")))
            .select(F.least("s_id", "l_id").alias("a_id"), F.greatest("s_id", "l_id").alias("b_id")))


def similar_pairs(contents: DataFrame, measure: str = "lcs", sim_th: float = 0.0) -> DataFrame:
    """Edges (a_id, b_id) between distinct contents of one group.

    ``contents``: (id, tokens, min_line, max_line).  Dynamic threshold
    (``sim_th == 0``) uses the token count of the earlier line of a pair; after
    dedupe both orders can occur, so either passing orientation makes an edge.
    """
    dynamic = not (sim_th and sim_th > 0)
    if measure == "jaccard" and dynamic:
        return prefix_pairs(contents, dynamic_threshold)
    if measure != "lcs":
        return block_pairs(contents, measure, dynamic_threshold if dynamic else lambda n: F.lit(float(sim_th)), dynamic)
    nodes = contents.where(F.size("tokens") > 0)
    cand = _prefix_candidates(nodes, MIN_DYNAMIC_THRESHOLD if dynamic else sim_th).unionByName(_substring_candidates(nodes)).distinct()
    a = nodes.select(F.col("id").alias("a_id"), F.col("tokens").alias("a_tokens"),
                     F.col("min_line").alias("a_min"), F.col("max_line").alias("a_max"))
    b = nodes.select(F.col("id").alias("b_id"), F.col("tokens").alias("b_tokens"),
                     F.col("min_line").alias("b_min"), F.col("max_line").alias("b_max"))
    scored = score_pairs(cand.join(a, "a_id").join(b, "b_id"), measure)
    if not dynamic:
        keep = F.col("score") >= F.lit(sim_th)
    else:
        a_first = (F.col("a_min") < F.col("b_max")) & (F.col("score") >= dynamic_threshold(F.size("a_tokens")))
        b_first = (F.col("b_min") < F.col("a_max")) & (F.col("score") >= dynamic_threshold(F.size("b_tokens")))
        keep = a_first | b_first
    return scored.where(keep).select("a_id", "b_id", "score")


def _edge_state(edges: DataFrame) -> tuple:
    """Number of edges and sum of their hashes: equal before and after a round only at the fixpoint."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def _linking(batches):
    """Task over edges (a, b): those that link two trees of the task's edges, which connect the same nodes."""
    above: dict = {}

    def root(x):
        top = x
        while (up := above.get(top, top)) != top:
            top = up
        while x != top:
            above[x], x = top, above.get(x, x)
        return top

    for batch in batches:
        kept = []
        for k, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())):
            a, b = root(a), root(b)
            if a != b:
                above[b] = a
                kept.append(k)
        yield batch.take(pa.array(kept, pa.int32()))
        if len(above) > FOREST_NODES:  # the edges that follow are another forest's
            above.clear()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) where component is the smallest id reachable.

    Alternating large-star / small-star rounds (published label-contraction
    algorithm for MapReduce-style systems) until nothing changes; there is no
    round limit.  Each round is two aggregates and two joins over the edge
    table, checkpointed into the session's checkpoint directory, so lineage
    stays short and a lost executor recomputes at most one round.  The test
    for the fixpoint is one count and one sum.  Each task first leaves out the
    edges between nodes that its other edges connect.
    """
    checkpoint_dir(nodes.sparkSession)
    e = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where(F.col("a") != F.col("b"))
    e = e.mapInArrow(_linking, e.schema).distinct().checkpoint()
    state = _edge_state(e)
    while state[0]:
        nbr = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        mn = nbr.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = (nbr.where(F.col("v") > F.col("u")).join(mn, "u")
                 .select(F.least("v", "m").alias("a"), F.greatest("v", "m").alias("b"))
                 .where(F.col("a") != F.col("b")).distinct())
        sm = large.groupBy("b").agg(F.min("a").alias("m"))
        e = (large.join(sm, "b").select(F.least("a", "m").alias("a"), F.greatest("a", "m").alias("b"))
             .unionByName(sm.select(F.least("b", "m").alias("a"), F.greatest("b", "m").alias("b")))
             .where(F.col("a") != F.col("b")).distinct()).checkpoint()
        before, state = state, _edge_state(e)
        if state == before:
            break
    label = e.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component"))
    return (nodes.select("id").distinct().join(label, "id", "left")
            .withColumn("component", F.coalesce("component", "id")))
