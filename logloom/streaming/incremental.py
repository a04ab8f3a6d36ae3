"""Incremental mining over a file stream with ``foreachBatch``.

State lives in tables under one state directory (shared storage):

* ``catalog/batch=<id>``: the templates that batch ``id`` added, changed or
  merged away (``gone``); its files end the batch, so a batch counts once they stand;
* ``snapshot/batch=<id>``: the whole catalog after every COMPACT_EVERY batches,
  so that a batch reads one snapshot and the few changes after it;
* ``assign/batch=<id>``:  (line_id, template_key) of the lines of batch ``id``;
* ``alias/batch=<id>``:   (old_key, new_key) merges made while handling ``id``;
* ``queue/batch=<id>``:   what an arbiter is asked about the clusters of ``id``;
* ``decisions/batch=<id>``: answers given after batch ``id``, which later batches join.

Each write replaces exactly its own batch id, so a replayed micro-batch
(after a failure) rewrites the same files: the sink is idempotent.  Batch
``id`` reads the state of the ids below it.  Earlier assignments
are never rewritten; merges that re-home old lines are resolved at read time
through the alias chain (Z3).
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import induction, merging
from ..operators.matching import match_catalog, unmatched
from ..operators.preprocess import distinct_contents, preprocess
from ..operators.tokens import canonical_contents, collapse_canonical, materialize_vocab, tokenize
from ..session import checkpoint_dir, written


STATE_SCHEMAS = {
    "catalog": "template string, n_lines bigint, first_line bigint, template_key string, gone boolean, batch bigint",
    "snapshot": "template string, n_lines bigint, first_line bigint, template_key string, batch bigint",
    "assign": "line_id bigint, template_key string, batch bigint",
    "alias": "old_key string, new_key string, batch bigint",
    "queue": "cluster_key string, mode int, rank bigint, sample string, batch bigint",
    "decisions": "cluster_key string, template string, given timestamp, batch bigint",
}
COMPACT_EVERY = 16  # batches from one snapshot of the catalog to the next


def _read_batches(spark: SparkSession, state_dir: str, name: str) -> DataFrame:
    """All batches of a state table; no rows only if its folder does not exist yet.

    The schema is given, so a folder that a failed batch left empty reads as
    empty, and any other failure is raised.
    """
    try:
        return spark.read.schema(STATE_SCHEMAS[name]).parquet(os.path.join(state_dir, name))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STATE_SCHEMAS[name])


def _write_batch(df: DataFrame, state_dir: str, name: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(os.path.join(state_dir, name, f"batch={batch_id}"))


def last_batch(spark: SparkSession, state_dir: str) -> int | None:
    """The last batch that ended."""
    return _read_batches(spark, state_dir, "catalog").agg(F.max("batch")).first()[0]


def load_catalog(spark: SparkSession, state_dir: str, before_batch: int | None = None) -> DataFrame:
    """The catalog (template, n_lines, first_line, template_key) as the batches below ``before_batch`` left it."""
    def below(df):
        return df if before_batch is None else df.where(F.col("batch") < before_batch)

    snaps = below(_read_batches(spark, state_dir, "snapshot"))
    at = snaps.agg(F.max("batch")).first()[0]
    rows = below(_read_batches(spark, state_dir, "catalog"))
    if at is not None:
        rows = rows.where(F.col("batch") > at).unionByName(
            snaps.where(F.col("batch") == at).withColumn("gone", F.lit(False)))
    state = F.struct("template", "n_lines", "first_line", "gone")
    return (rows.groupBy("template_key").agg(F.max_by(state, "batch").alias("s")).where("NOT s.gone")
            .select("s.template", "s.n_lines", "s.first_line", "template_key"))


def read_queue(spark: SparkSession, state_dir: str) -> DataFrame:
    """I8: what was asked so far, batch by batch."""
    return _read_batches(spark, state_dir, "queue")


def load_decisions(spark: SparkSession, state_dir: str, before_batch: int) -> DataFrame:
    """The last answer (cluster_key, template) given for each cluster before ``before_batch``."""
    given = _read_batches(spark, state_dir, "decisions").where(F.col("batch") < before_batch)
    return given.groupBy("cluster_key").agg(F.max_by("template", F.struct("batch", "given", "template")).alias("template"))


def write_decisions(decisions: DataFrame, state_dir: str) -> None:
    """Give answers (cluster_key, template) to the stream, from the batch after the last one that ended on.

    They are added to the answers given before; of several for one cluster the last counts.
    """
    after = last_batch(decisions.sparkSession, state_dir)
    (decisions.select("cluster_key", "template", F.current_timestamp().alias("given"))
     .write.mode("append").parquet(os.path.join(state_dir, "decisions", f"batch={-1 if after is None else after}")))


def _next_alias(rows: DataFrame, alias: DataFrame) -> DataFrame:
    """(key, since) -> (key, since, batch, new_key): the first alias of ``key`` in batch ``since`` or later."""
    a = alias.select(F.col("old_key").alias("key"), "batch", "new_key")
    return (rows.join(a, "key").where(F.col("batch") >= F.col("since"))
            .groupBy("key", "since").agg(F.min(F.struct("batch", "new_key")).alias("m")).select("key", "since", "m.*"))


def resolve_alias(assignments: DataFrame, alias: DataFrame) -> DataFrame:
    """Z3: assignments (line_id, template_key, batch) through the aliases (old_key, new_key, batch).

    An alias of batch ``b`` re-homes what was assigned in batch ``b`` or
    earlier, and its target may be re-homed by later batches only.  Batches
    rise along a chain, so a key that is created again, or merged back, ends
    the chain where it stands: every line keeps exactly one template.  Works on
    distinct (key, batch) pairs, which double their reach in every round until
    none moves.
    """
    alias = alias.groupBy("old_key", "batch").agg(F.min("new_key").alias("new_key")).checkpoint()
    starts = assignments.select(F.col("template_key").alias("key"), F.col("batch").alias("since")).distinct()
    hops = alias.select(F.col("new_key").alias("key"), (F.col("batch") + 1).alias("since")).distinct()
    # jump(key, since) -> (target, after): where one alias leads
    jump = (_next_alias(starts.union(hops).distinct(), alias)
            .select("key", "since", F.col("new_key").alias("target"), (F.col("batch") + 1).alias("after"))).checkpoint()
    while True:
        far = (jump.alias("x").join(jump.alias("y"), (F.col("x.target") == F.col("y.key")) & (F.col("x.after") == F.col("y.since")), "left")
               .select("x.key", "x.since", F.coalesce("y.target", "x.target").alias("target"),
                       F.coalesce("y.after", "x.after").alias("after"), F.col("y.key").isNotNull().alias("moved"))).checkpoint()
        jump = far.drop("moved")
        if far.where("moved").isEmpty():
            break
    to = jump.select(F.col("key").alias("template_key"), F.col("since").alias("batch"), "target")
    return (assignments.join(to, ["template_key", "batch"], "left")
            .select("line_id", F.coalesce("target", "template_key").alias("template_key")))


def process_batch(batch: DataFrame, batch_id: int, state_dir: str, vocab: DataFrame,
                  regex=(), drop=(), rules=None) -> None:
    """Z1 for one micro-batch: match, mine the rest with the answers given so
    far, merge what is new, write what changed.

    The catalog before the batch is a fixpoint of merging, so only pairs with a
    new template are looked for.
    """
    spark = batch.sparkSession
    checkpoint_dir(spark)
    prev = load_catalog(spark, state_dir, batch_id).checkpoint()
    masked = written(preprocess(batch.select("line_id", F.coalesce("line", F.lit("")).alias("line")), regex, drop, rules)
                     .select("line_id", "content"))
    tokenized = written(tokenize(distinct_contents(masked)))
    cc = collapse_canonical(tokenized).checkpoint()
    matched = match_catalog(cc.select("canon", "tokens"), prev, vocab).select("canon", "template").checkpoint()
    from ..plans.mine import cluster_contents
    clustered = cluster_contents(unmatched(cc, matched), vocab).checkpoint()
    decisions = load_decisions(spark, state_dir, batch_id)
    _write_batch(induction.open_questions(clustered, vocab, decisions), state_dir, "queue", batch_id)
    new = clustered.join(induction.induce(clustered, vocab, decisions).select("canon", "template"), "canon")
    contents = (new.select("canon", "template", "n", "min_line")
                .unionByName(cc.join(matched, "canon").select("canon", "template", "n", "min_line"))).checkpoint()
    batch_cat = induction.template_catalog(contents).select("template", "n_lines", "first_line", F.lit(False).alias("settled"))
    cat = (batch_cat.unionByName(prev.select("template", "n_lines", "first_line", F.lit(True).alias("settled")))
           .groupBy("template").agg(F.sum("n_lines").cast("bigint").alias("n_lines"), F.min("first_line").alias("first_line"),
                                    F.max("settled").alias("settled"))).checkpoint()
    alias = merging.merge_templates(cat, vocab)
    final = (merging.apply_alias(cat, alias).groupBy("template")
             .agg(F.sum("n_lines").cast("bigint").alias("n_lines"), F.min("first_line").alias("first_line"))
             .withColumn("template_key", F.md5("template")))
    touched = merging.apply_alias(batch_cat.select("template"), alias).unionByName(alias.select(F.col("new_template").alias("template")))
    gone = (prev.join(alias.select(F.col("old_template").alias("template")), "template", "left_semi")
            .join(final.select("template"), "template", "left_anti"))
    c2 = merging.apply_alias(contents, alias).select("canon", F.md5("template").alias("template_key"))
    _write_batch(masked.join(tokenized.select("content", "canon").join(c2, "canon"), "content").select("line_id", "template_key"),
                 state_dir, "assign", batch_id)
    _write_batch(alias.select(F.md5("old_template").alias("old_key"), F.md5("new_template").alias("new_key")), state_dir, "alias", batch_id)
    if batch_id % COMPACT_EVERY == COMPACT_EVERY - 1:
        _write_batch(final, state_dir, "snapshot", batch_id)
    _write_batch(final.join(touched.distinct(), "template", "left_semi").withColumn("gone", F.lit(False))
                 .unionByName(gone.withColumn("gone", F.lit(True))), state_dir, "catalog", batch_id)


def stream_mine(stream: DataFrame, state_dir: str, vocab: DataFrame, checkpoint_location: str,
                regex=(), drop=(), rules=None, available_now: bool = True):
    """Start the incremental miner on a streaming DataFrame of (line_id, line)."""
    vocab = materialize_vocab(vocab)
    w = (stream.writeStream
         .foreachBatch(lambda df, bid: process_batch(df, bid, state_dir, vocab, regex, drop, rules))
         .option("checkpointLocation", checkpoint_location))
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


def final_assignments(spark: SparkSession, state_dir: str) -> DataFrame:
    """All assignments of the batches that ended, re-homed through every alias written by them."""
    last = last_batch(spark, state_dir)
    ended = F.col("batch") <= F.lit(-1 if last is None else last)
    return resolve_alias(_read_batches(spark, state_dir, "assign").where(ended), _read_batches(spark, state_dir, "alias").where(ended))


FILE_ROWS = 100_000  # lines of a replayed file


def replay_stream(spark: SparkSession, lines: DataFrame, chunks: int = 4, vocab: DataFrame | None = None,
                  regex=(), drop=(), rules=None) -> DataFrame:
    """The final catalog of a replayed stream."""
    state = replay(spark, lines, chunks, vocab, regex, drop, rules)
    return load_catalog(spark, state).select("template_key", "template", "n_lines", "first_line")


def replay(spark: SparkSession, lines: DataFrame, chunks: int = 4, vocab: DataFrame | None = None,
           regex=(), drop=(), rules=None) -> str:
    """Replay a line table as a file stream of ``chunks`` chunks in line order
    and return its state directory.  A chunk is a folder of files of about
    FILE_ROWS lines, which one micro-batch takes together.  Everything is written under the session's
    checkpoint directory (shared storage on a cluster)."""
    import uuid
    from ..operators.tokens import build_vocabulary
    base = os.path.join(checkpoint_dir(spark), f"logloom-stream-{uuid.uuid4().hex}")
    src, state, ck = (os.path.join(base, x) for x in ("source", "state", "ckpt"))
    staged = written(lines.select("line_id", "line"))
    files = max(1, -(-staged.count() // (chunks * FILE_ROWS)))  # per chunk
    at = [k / chunks for k in range(1, chunks)]
    cuts = sorted(set(staged.agg(F.percentile_approx("line_id", at, 100_000).alias("q")).first()["q"] or [])) if at else []
    for i, (lo, hi) in enumerate(zip([None, *cuts], [*cuts, None])):  # the stream takes the oldest files first
        part = staged if lo is None else staged.where(F.col("line_id") > lo)
        part = part if hi is None else part.where(F.col("line_id") <= hi)
        part.repartition(files).write.parquet(os.path.join(src, f"chunk={i:05d}"))
    if vocab is None:
        vocab = build_vocabulary(canonical_contents(distinct_contents(preprocess(staged, regex, drop, rules))))
    stream = (spark.readStream.schema("line_id bigint, line string").option("maxFilesPerTrigger", files)
              .option("recursiveFileLookup", "true").parquet(src))
    q = stream_mine(stream, state, vocab, ck, regex, drop, rules)
    q.awaitTermination()
    return state
