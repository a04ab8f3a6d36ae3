"""Secret scan over a trigram inverted index (operator 8).

For each rule a Boolean trigram query is derived from its regular expression:
an AND of clauses, each an OR of trigram sets that any match must contain.  The
index maps the trigrams that occur in some query to documents; the postings of
a query are intersected per document, and only the remaining candidates are
read again and verified with the expression.  Rules without a mandatory
trigram scan every document.  Built-in functions only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import durable, packed, table
from logloom.llm.spans import add_spans, joined, sql_spans, total

_parse, _ops = re._parser.parse, re._constants
MAX_STRINGS = 64  # literal strings followed at once while a query is derived


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: least length of the value: the whole match, or group ``group`` of it
    least: int = 0
    group: int = 0


#: The base rules of the contract, then formats published by the issuers of such tokens.
RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")


def _strings(node) -> set[str] | None:
    """All strings a parsed node can match, lower case, or None if they are too many to follow."""
    op, arg = node
    if op is _ops.LITERAL:
        return {chr(arg).lower()}
    if op is _ops.IN:
        if any(o is not _ops.LITERAL for o, _ in arg) or len(arg) > 8:
            return None
        return {chr(c).lower() for _, c in arg}
    if op is _ops.SUBPATTERN:
        return _sequence(arg[-1])
    if op is _ops.BRANCH:
        parts = [_sequence(p) for p in arg[1]]
        return None if None in parts else set().union(*parts)
    if op in (_ops.MAX_REPEAT, _ops.MIN_REPEAT, _ops.POSSESSIVE_REPEAT):
        low, high, body = arg
        one = _sequence(body)
        if one is None or high > 8:
            return None
        out = {""} if low == 0 else set()
        for n in range(max(1, low), high + 1):
            out |= {"".join(p) for p in product(one, repeat=n)}
            if len(out) > MAX_STRINGS:
                return None
        return out
    return {""} if op in (_ops.AT, _ops.ASSERT, _ops.ASSERT_NOT) else None


def _sequence(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        more = _strings(node)
        if more is None or len(out) * len(more) > MAX_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _flat(nodes):
    """Nodes of a sequence with plain groups opened, and one copy of what repeats without bound."""
    for op, arg in nodes:
        if op is _ops.SUBPATTERN and _sequence(arg[-1]) is None:
            yield from _flat(arg[-1])
        elif op is _ops.MAX_REPEAT and arg[0] >= 1 and _strings((op, arg)) is None:
            yield from _flat(arg[2])
            yield None
        else:
            yield op, arg


def _minimal(sets: set[frozenset]) -> frozenset:
    return frozenset(s for s in sets if not any(t < s for t in sets))


def trigram_query(pattern: str) -> frozenset:
    """Clauses (all needed), each a set of alternatives (one needed), each a set of trigrams (all needed).

    Empty if the expression has no mandatory trigram.
    """
    clauses, current = set(), {""}

    def close():
        grams = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in current}
        if frozenset() not in grams:
            clauses.add(_minimal(grams))

    for node in _flat(_parse(pattern)):
        more = None if node is None else _strings(node)
        if more is None or len(current) * len(more) > MAX_STRINGS:
            close()
            current = {""} if more is None or len(more) > MAX_STRINGS else more
        else:
            current = {a + b for a in current for b in more}
    close()
    return frozenset(clauses)


def build_index(docs: DataFrame, grams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id, h) of ``grams`` over lower-cased texts; h is the text's hash."""
    low = docs.select("doc_id", F.xxhash64("text").alias("h"), F.lower("text").alias("low"))
    have = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    return low.select("doc_id", "h", F.explode(have).alias("trigram")).distinct()


def candidates(postings: DataFrame, queries: dict[str, frozenset]) -> DataFrame:
    """doc_id, h and ``rules`` (those whose query the document's postings satisfy), one row per document."""

    def clause(alternatives):
        every = [reduce(lambda a, b: a & b, [F.array_contains("grams", g) for g in sorted(alt)]) for alt in alternatives]
        return reduce(lambda a, b: a | b, every)

    got = postings.groupBy("doc_id", "h").agg(F.collect_set("trigram").alias("grams"))
    rules = F.array_compact(F.array(*[
        F.when(reduce(lambda a, b: a & b, [clause(c) for c in q]), F.lit(kind)) for kind, q in queries.items()]))
    return got.select("doc_id", "h", rules.alias("rules")).where(F.size("rules") > 0)


#: Candidates broadcast at most, about 100 bytes each; beyond that a bitmap of fixed size leaves out most other texts.
BROADCAST_ROWS = 500_000
_MAP_BITS = 32768  # bits of one map of bitmap_construct_agg
_MAPS = 1024


def _meeting(docs: DataFrame, found: DataFrame, key) -> DataFrame:
    """The rows of ``docs`` that are candidates, with their rules; texts of other rows are not shuffled.

    ``found`` is a written table.  Up to BROADCAST_ROWS candidates are
    broadcast.  More are joined by key behind a bitmap of their hashes (4 MB
    for any input): a text whose bit is not set is no candidate.
    """
    named = found.select(F.col("doc_id").alias("__d"), F.col("h").alias("__h"), F.col("rules").alias("__rules"))
    if found.count() <= BROADCAST_ROWS:
        return docs.join(F.broadcast(named), key).drop("__d", "__h")
    place = lambda h: F.pmod(h, F.lit(_MAPS * _MAP_BITS))
    bits = found.select(place(F.col("h")).alias("at")).select((F.col("at") / _MAP_BITS).cast("int").alias("__map"), F.col("at") % _MAP_BITS)
    bits = bits.toDF("__map", "bit").groupBy("__map").agg(F.bitmap_construct_agg("bit").alias("__bits"))
    at = place(F.col("h"))
    byte = F.conv(F.hex(F.substring("__bits", ((at % _MAP_BITS) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    kept = docs.join(F.broadcast(bits), (at / _MAP_BITS).cast("int") == F.col("__map"))
    kept = kept.where(F.getbit(byte, (at % 8).cast("int")) == 1).drop("__map", "__bits")
    return kept.join(named, key).drop("__d", "__h")


def _long_enough(rule: Rule):
    def keep(s):
        value = F.regexp_extract(s["value"], rule.pattern, rule.group) if rule.group else s["value"]
        return F.length(value) >= rule.least
    return keep if rule.least else None


def _verify(df: DataFrame, rule: Rule, when=None) -> DataFrame:
    return add_spans(df, rule.kind, rule.kind, rule.pattern, _long_enough(rule), when)


def secrets(docs: DataFrame, rules: tuple = RULES) -> DataFrame:
    """``doc_id``, ``h`` and one array of spans per rule for every row of ``docs``.

    Positions are code points, end exclusive.  Null text is empty; null doc_ids
    are reported as such, rows alike in doc_id and text once each; columns
    other than doc_id and text are not read.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = [r for r in rules if queries[r.kind]]
    scanned = [r for r in rules if not queries[r.kind]]
    out = docs.withColumn("h", F.xxhash64("text"))
    for r in scanned:
        out = _verify(out, r)
    out = out.drop("text")
    if indexed:
        grams = sorted({g for r in indexed for clause in queries[r.kind] for alt in clause for g in alt})
        found = durable(candidates(build_index(docs, grams), {r.kind: queries[r.kind] for r in indexed}))
        key = F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("h").eqNullSafe(F.col("__h"))
        hits = _meeting(docs.withColumn("h", F.xxhash64("text")), found, key)
        for r in indexed:
            hits = _verify(hits, r, F.array_contains("__rules", r.kind))
        # no filter on the spans here: pushed below them, it would evaluate every expression again
        hits = hits.select(F.col("doc_id").alias("__d"), F.col("h").alias("__h"), *[r.kind for r in indexed]).dropDuplicates(["__d", "__h"])
        out = out.join(hits, key, "left").drop("__d", "__h")
        for r in indexed:
            out = out.withColumn(r.kind, F.coalesce(r.kind, F.array().cast(out.schema[r.kind].dataType)))
    return out.select("doc_id", "h", *[r.kind for r in rules])


def without_secrets(docs: DataFrame, rules: tuple = RULES) -> DataFrame:
    """The rows of ``docs`` in which no rule finds a secret, columns unchanged."""
    found = secrets(docs, rules).where(reduce(lambda a, b: a | b, [F.size(r.kind) > 0 for r in rules])).select(
        F.col("doc_id").alias("d"), F.col("h")).distinct()
    on = F.col("row.doc_id").eqNullSafe(F.col("d")) & F.xxhash64(F.coalesce(F.col("row.text").cast("string"), F.lit(""))).eqNullSafe(F.col("h"))
    return packed(docs).join(found, on, "left_anti").select("row.*")


def _sorted(kinds) -> F.Column:
    """(kind, start, end) by start, then kind as listed."""
    every = F.concat(*[F.transform(F.col(k), lambda s, n=n: F.struct(
        s["start"].alias("start"), F.lit(n).alias("n"), s["end"].alias("end"), s["kind"].alias("kind"))) for n, k in enumerate(kinds)])
    return F.sort_array(every)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of secrets of every row of documents."""
    found = secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[total(k).alias(f"n_{k}") for k in BASE],
                        F.sha2(joined(_sorted(BASE)), 256).alias("base_sha256"),
                        joined(_sorted([r.kind for r in RULES])).alias("spans"))


def _sql_keep(r: Rule) -> str:
    p = r.pattern.replace("'", "''")
    return f"length(regexp_extract(m.v, '{p}', {r.group})) >= {r.least}"


def _sql_list(kinds) -> str:
    parts = [f"list_transform({k}, lambda m: {{'s': m.s, 'n': {n}, 'k': m.k, 'v': m.v}})" for n, k in enumerate(kinds)]
    return reduce(lambda a, b: f"list_concat({a}, {b})", parts)


def _sql_joined(kinds) -> str:
    return (f"array_to_string(list_transform(list_sort({_sql_list(kinds)}), "
            "lambda m: concat(m.k, ':', m.s, ':', m.s + length(m.v))), ',')")


OP8_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS MATERIALIZED (SELECT doc_id, {", ".join(f"{sql_spans(r.kind, r.pattern, _sql_keep(r))} AS {r.kind}" for r in RULES)} FROM d)
SELECT doc_id, {", ".join(f"CAST(len({k}) AS BIGINT) AS n_{k}" for k in BASE)},
  sha256({_sql_joined(BASE)}) AS base_sha256, {_sql_joined([r.kind for r in RULES])} AS spans
FROM f
"""
