"""Licence scan: Dice coefficient over word bigrams against licence texts (operator 9).

Built-in functions only.  Lines and paragraphs are normalised (A-Z folded, all
but digits, letters and non-ASCII characters as spaces) and turned into the set
of their word bigrams.  With a and b bigrams the coefficient is at most
2 min(a, b) / (a + b), so a template can reach the threshold t only for
b t / (2 - t) <= a <= b (2 - t) / t, and then shares at least b t / (2 - t) of
its bigrams.  So it shares one of any b - ceil(b t / (2 - t)) + 1 of them: those
with the longest words, its marks.  Documents, then lines and paragraphs, then
units without a mark of any template are left out; the others meet the
templates of their marks, if their sizes fit, and are compared in full.

The query also looks inside: a line or paragraph that matches as a whole with
nothing has the best template of its sentences, and of two in a row; those of a
paragraph count only if they run over a line end.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import table
from logloom.llm.license_texts import TEMPLATES

THRESHOLD = 0.8
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_STOP = r"(?<=[.;:!?])(?=[\x20\x09-\x0D])"
_BLANK = r"\n[\x20\x09\x0D]*\n[\x20\x09-\x0D]*"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text) -> F.Column:
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), _NOT_WORD), lambda w: w != "")


def _once(value: F.Column, use) -> F.Column:
    """``use(value)``, with ``value`` computed once a row."""
    return F.transform(F.array(value), use)[0]


def _bigrams(text) -> F.Column:
    """Hashed bigrams of a text's words, repeats included."""
    def pairs(words):
        n = F.greatest(F.size(words) - 1, F.lit(0))
        return F.zip_with(F.slice(words, 1, n), F.slice(words, F.lit(2), n), lambda a, b: F.xxhash64(a, b))
    return _once(_words(text), pairs)


def need(b: int, threshold: float) -> int:
    """Bigrams that a unit shares at least with a template of ``b`` that it reaches the threshold with."""
    return math.ceil(b * threshold / (2 - threshold) - 1e-9)


def words_of(text: str) -> list[str]:
    return [w for w in re.split(_NOT_WORD, text.translate(str.maketrans(_UPPER, _LOWER))) if w]


def template_table(spark: SparkSession, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per mark: mark, part, license, want (bigrams), marks, b and the unit sizes low to high.

    Templates without a bigram are left out.  Of a template's bigrams the marks
    are those with the longest words (ties: by spelling).
    """
    rows = []
    for part, (name, text) in enumerate(templates):
        w = words_of(text)
        grams = sorted(set(zip(w, w[1:])), key=lambda g: (-len(g[0]) - len(g[1]), g))
        b = len(grams)
        rows += [(part, name, b, need(b, threshold), math.floor(b * (2 - threshold) / threshold + 1e-9),
                  [" ".join(g) for g in grams], [" ".join(g) for g in grams[:b - need(b, threshold) + 1]])] if b else []
    listed = spark.createDataFrame(rows, "part int, license string, b int, low int, high int, grams array<string>, names array<string>")
    both = lambda c: F.transform(c, lambda g: F.xxhash64(F.substring_index(g, " ", 1), F.substring_index(g, " ", -1)))
    listed = listed.select("part", "license", "b", "low", "high", both("grams").alias("want"), both("names").alias("marks"))
    return listed.withColumn("mark", F.explode("marks"))


def _sentences(piece: F.Column) -> F.Column:
    """The sentences of a line or paragraph, and each with its next one; none if there is only one."""
    def parts(cut):
        n = F.greatest(F.size(cut) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(cut, F.lit(1), n), F.slice(cut, F.lit(2), n), lambda a, b: F.concat(a, b))
        return F.when(n > 0, F.concat(cut, pairs)).otherwise(F.array().cast("array<string>"))

    found = F.transform(_once(F.split(piece, _STOP), parts), lambda s: F.btrim(s, F.lit(" \t\r\n")))
    return F.filter(found, lambda s: ~F.contains(piece, F.lit("\n")) | F.contains(s, F.lit("\n")))


def _holds(text, marks: list[int]) -> F.Column:
    return F.exists(_bigrams(text), lambda g: g.isin(marks))


def units(docs: DataFrame, marks: list[int], inside: bool = False) -> DataFrame:
    """doc_id, h, unit number, whole, piece: the lines, and the paragraphs of several lines, that hold one of ``marks``.

    ``inside``: also their sentences (whole is false).
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).where(_holds(F.col("text"), marks))
    lines = F.split("text", "\n")
    blocks = F.filter(F.split("text", _BLANK), lambda p: F.contains(p, F.lit("\n")))
    # outer: no filter on the size of the list, which would make it twice
    rows = rows.select("doc_id", F.xxhash64("text").alias("h"), F.posexplode_outer(F.concat(lines, blocks)).alias("unit", "piece"))
    rows = rows.where(_holds(F.col("piece"), marks))
    parts = F.array(F.struct("piece", F.lit(True).alias("whole")))
    if inside:
        parts = F.concat(parts, F.transform(_sentences(F.col("piece")), lambda s: F.struct(s.alias("piece"), F.lit(False).alias("whole"))))
    return rows.select("doc_id", "h", "unit", F.explode_outer(parts).alias("p")).select("doc_id", "h", "unit", "p.whole", "p.piece")


def license_scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, inside: bool = False) -> DataFrame:
    """doc_id, h and ``found`` (unit, license, dice; by unit) for every row of ``docs(doc_id, text, ...)``.

    A unit has the template with the highest coefficient of at least
    ``threshold`` (ties: the first in the list).  Units are lines from 0, then
    paragraphs of several lines; with ``inside`` a unit without one has that of
    its sentences.  Null and empty texts have no licence; texts of any length
    are read whole; repeated rows are reported each; an empty table gives no
    rows, an empty list of templates no licences; other columns are not read.
    """
    shelf = template_table(docs.sparkSession, templates, threshold)
    marks = sorted({r.mark for r in shelf.select("mark").collect()})  # as many as the templates have
    if not marks:
        shelf, marks = shelf.limit(0), [0]
    sized = units(docs, marks, inside).withColumn("grams", F.array_distinct(_bigrams(F.col("piece"))))
    sized = sized.withColumn("own", F.filter("grams", lambda g: g.isin(marks))).withColumn("a", F.size("grams"))
    met = (sized.select("*", F.explode_outer("own").alias("mark")).join(F.broadcast(shelf), "mark")
           .where((F.col("a") >= F.col("low")) & (F.col("a") <= F.col("high")))
           .where(F.filter("own", lambda g: F.array_contains("marks", g))[0] == F.col("mark")))  # each template once a unit
    common = F.size(F.array_intersect("grams", "want"))
    close = met.withColumn("dice", 2 * common / (F.col("a") + F.col("b"))).where(F.col("dice") >= threshold - 1e-12)
    best = close.groupBy("doc_id", "h", "unit").agg(F.max(F.struct("whole", "dice", -F.col("part"), "license")).alias("m"))
    every = F.sort_array(F.collect_list(F.struct("unit", F.col("m.license").alias("license"), F.col("m.dice").alias("dice"))))
    found = best.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("g")).agg(every.alias("found"))
    keys = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("h"))
    on = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("h").eqNullSafe(F.col("g"))
    none = F.array().cast("array<struct<unit:int,license:string,dice:double>>")
    return keys.join(found, on, "left").select("doc_id", "h", F.coalesce("found", none).alias("found"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every row of documents: their names, the number of units with one, the units, the best coefficient."""
    out = license_scan(table(spark, sf_dir, "documents"), inside=True)
    names = F.array_sort(F.array_distinct(F.transform("found", lambda f: f["license"])))
    return out.select("doc_id", F.size("found").cast("long").alias("n_matches"), F.array_join(names, ",").alias("licenses"),
                      F.array_join(F.transform("found", lambda f: F.concat_ws(":", f["unit"], f["license"])), ",").alias("matches"),
                      F.round(F.coalesce(F.array_max(F.transform("found", lambda f: f["dice"])), F.lit(0.0)), 6).alias("best_dice"))


def _sql() -> str:
    def words(text):
        return f"list_filter(string_split_regex(translate({text}, '{_UPPER}', '{_LOWER}'), '{_NOT_WORD}'), lambda w: w <> '')"

    def grams(w):
        return f"list_distinct(list_transform(range(1, len({w})), lambda i: concat({w}[i], ' ', {w}[i + 1])))"

    rows = ", ".join(f"({k}, '{n}', '{t.replace(chr(39), chr(39) * 2)}')" for k, (n, t) in enumerate(TEMPLATES))
    cut = r"string_split(regexp_replace(piece, '([.;:!?])([\x20\x09-\x0D])', concat('\1', chr(57344), '\2'), 'g'), chr(57344))"
    return rf"""
WITH t AS MATERIALIZED (SELECT part, license, {grams('w')} AS want FROM (SELECT part, license, {words('text')} AS w
  FROM (VALUES {rows}) AS v(part, license, text))),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
u AS MATERIALIZED (SELECT r, unnest(l) AS piece, unnest(range(0, len(l))) AS unit FROM (SELECT r, list_concat(string_split(text, chr(10)),
  list_filter(string_split_regex(text, '{_BLANK}'), lambda p: contains(p, chr(10)))) AS l FROM d)),
c AS MATERIALIZED (SELECT r, unit, piece, {cut} AS s FROM u),
p AS (SELECT r, unit, true AS whole, piece FROM u
  UNION ALL SELECT r, unit, false, x FROM (SELECT r, unit, piece, unnest(list_concat(s,
    list_transform(range(1, len(s)), lambda i: concat(s[i], s[i + 1])))) AS x FROM c WHERE len(s) > 1)
  WHERE NOT contains(piece, chr(10)) OR contains(trim(x, concat(' ', chr(9), chr(13), chr(10))), chr(10))),
w AS MATERIALIZED (SELECT r, unit, whole, {words('piece')} AS w FROM p WHERE piece <> ''),
g AS MATERIALIZED (SELECT r, unit, whole, {grams('w')} AS have FROM w WHERE len(w) > 1),
o AS MATERIALIZED (SELECT DISTINCT have FROM g),
m AS MATERIALIZED (SELECT have, part, license, 2 * len(list_intersect(have, want)) / (len(have) + len(want)) AS dice
  FROM o JOIN t ON 2 * least(len(have), len(want)) >= ({THRESHOLD} - 1e-9) * (len(have) + len(want))),
b AS (SELECT r, unit, max(row(whole, dice, -part, license)) AS x FROM g JOIN m USING (have) WHERE dice >= {THRESHOLD} - 1e-12 GROUP BY r, unit),
f AS (SELECT r, count(*) AS n, string_agg(DISTINCT x[4], ',' ORDER BY x[4]) AS names,
  string_agg(concat(unit, ':', x[4]), ',' ORDER BY unit) AS matches, max(x[2]) AS best FROM b GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_matches, coalesce(names, '') AS licenses, coalesce(matches, '') AS matches,
  round(coalesce(best, 0.0), 6) AS best_dice
FROM d LEFT JOIN f USING (r)
"""


OP9_SQL = _sql()
