"""Personal data: expressions propose spans, checksums confirm them, nearby words adjust the score (operator 3).

Built-in functions only.  Kinds email, ip, card and phone are the base kinds;
iban (mod-97) and ssn (nearby words needed) are added.  Each span has a score:
a prior of its kind, plus ``CONTEXT_GAIN`` if a word of its kind stands within
40 characters, less ``CONTEXT_LOSS`` if a contrary one does (a version number
is no address), within 0 and 100.  Base spans are always kept, with their
score; added ones from ``MIN_SCORE`` on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import table
from logloom.llm.spans import add_spans, joined, sql_joined, sql_spans, total

# (?:\G|(?<!..)) starts a match only where a run of such characters starts, or behind the match before:
# the same matches, without trying every place of a long run.
EMAIL = (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9]([\x20-]?[0-9])+")
PHONE = (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = (r"[A-Z]{2}[0-9]{2}(?:(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?|[A-Z0-9]{11,30})",) * 2
SSN = (r"[0-9]{3}-[0-9]{2}-[0-9]{4}",) * 2
_PART = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP_VALID = rf"^({_PART}\.){{3}}{_PART}$"

# Score of a kind in percent, the words that raise it and those that lower it.
PRIOR = {"email": 90, "ip": 50, "card": 80, "phone": 60, "iban": 80, "ssn": 30}
WORDS = {"email": "mail|contact|write", "ip": "(^|[^a-z0-9_])ip([^a-z0-9_]|$)|address|host|server|login", "card": "card|visa|credit|debit|pay",
         "phone": "phone|tel|call|mobile|fax", "iban": "iban|account|bank|konto", "ssn": "ssn|social security"}
CONTRARY = {"email": "example|no-?reply|sample", "ip": "version|release|build|section|chapter", "card": "order|invoice|tracking|serial|isbn",
            "phone": "order|invoice|tracking|serial|isbn", "iban": "serial|tracking|part no", "ssn": "serial|tracking|part no"}
CONTEXT_GAIN, CONTEXT_LOSS = 40, 30
MIN_SCORE = 70
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")


def luhn(digits: F.Column) -> F.Column:
    """Luhn checksum of a string of digits."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(
        i % 2 == 1, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(iban: F.Column) -> F.Column:
    """ISO 7064 mod-97 check of an IBAN without spaces: first four characters last, letters as 10 to 35."""
    turned = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(
        c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)) == 1


def _card(s):
    digits = F.regexp_replace(s["value"], "[^0-9]", "")
    return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(F.lit(False))


def _phone(s):
    return F.length(F.regexp_replace(s["value"], "[^0-9]", "")).between(9, 15)


def _alone(s, chars):
    return ~F.right(s["before"], F.lit(1)).rlike(chars) & ~F.left(s["after"], F.lit(1)).rlike(chars)


def _iban(s):
    return _alone(s, "[A-Za-z0-9]") & mod97(F.replace(s["value"], F.lit(" "), F.lit("")))


def _ssn(s):
    return (_alone(s, "[0-9-]") & ~s["value"].rlike("^(000|666|9)|-00-|-0000$"))


def _scored(kind: str, spans: F.Column) -> F.Column:
    def score(s):
        near = F.lower(F.concat(s["before"], F.lit(" "), s["after"]))
        gain = F.when(near.rlike(WORDS[kind]), F.lit(CONTEXT_GAIN)).otherwise(F.lit(0))
        loss = F.when(near.rlike(CONTRARY[kind]), F.lit(CONTEXT_LOSS)).otherwise(F.lit(0))
        return F.greatest(F.lit(0), F.least(F.lit(100), F.lit(PRIOR[kind]) + gain - loss))

    out = F.transform(spans, lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), score(s).alias("score")))
    return out if kind in BASE else F.filter(out, lambda s: s["score"] >= MIN_SCORE)


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id`` and one array of spans (kind, start, end, value, score in percent) per kind for every row of ``docs``.

    Positions are code points, end exclusive.  Null text is empty; only doc_id
    and text are read, repeated rows are reported once each.
    """
    df = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    digit = F.col("text").rlike("[0-9]")
    df = df.withColumn("__digit", digit)
    for kind, pattern, keep, when in (
            ("email", EMAIL[0], None, F.contains("text", F.lit("@"))),
            ("ip", IP[0], lambda s: s["value"].rlike(IP_VALID), F.col("__digit") & F.contains("text", F.lit("."))),
            ("card", CARD[0], _card, F.col("__digit")),
            ("phone", PHONE[0], _phone, F.col("__digit") & F.contains("text", F.lit("+"))),
            ("iban", IBAN[0], _iban, F.col("__digit")),
            ("ssn", SSN[0], _ssn, F.col("__digit") & F.contains("text", F.lit("-")))):
        df = add_spans(df, f"__{kind}", kind, pattern, keep, when)
    return df.select("doc_id", *[_scored(k, F.col(f"__{k}")).alias(k) for k in KINDS])


def _plain(kinds) -> F.Column:
    """(kind, start, end) of the spans of ``kinds``, in the order of the kinds, then by start."""
    return F.concat(*[F.transform(F.col(k), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
                      for k in kinds])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data of every row of documents."""
    found = personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[total(k).alias(f"n_{k}") for k in BASE],
                        F.sha2(joined(_plain(BASE)), 256).alias("base_sha256"), joined(_plain(KINDS)).alias("spans"),
                        F.array_join(F.concat(*[F.transform(k, lambda s: s["score"].cast("string")) for k in KINDS]), ",").alias("scores"))


_DIGITS = "list_transform(string_split(regexp_replace(m.v, '[^0-9]', '', 'g'), ''), lambda x: CAST(x AS BIGINT))"
_SQL_LUHN = f"""length(regexp_replace(m.v, '[^0-9]', '', 'g')) BETWEEN 13 AND 19 AND list_sum(list_transform(list_reverse({_DIGITS}),
  lambda d, i: CASE WHEN i % 2 = 1 THEN d WHEN d > 4 THEN 2 * d - 9 ELSE 2 * d END)) % 10 = 0"""
_SQL_ALONE = "NOT regexp_matches(right(m.b, 1), '{0}') AND NOT regexp_matches(left(m.a, 1), '{0}')"
_TURNED = "concat(substr(replace(m.v, ' ', ''), 5), substr(m.v, 1, 4))"
_SQL_MOD97 = f"""list_reduce(list_transform(string_split(array_to_string(list_transform(string_split({_TURNED}, ''),
  lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END), ''), ''),
  lambda x: CAST(x AS BIGINT)), lambda a, x: (a * 10 + x) % 97) = 1"""
def _sql_score(kind: str) -> str:
    near = "lower(concat(m.b, ' ', m.a))"
    return (f"greatest(0, least(100, {PRIOR[kind]} + CASE WHEN regexp_matches({near}, '{WORDS[kind]}') THEN {CONTEXT_GAIN} ELSE 0 END"
            f" - CASE WHEN regexp_matches({near}, '{CONTRARY[kind]}') THEN {CONTEXT_LOSS} ELSE 0 END))")


_SQL_SCORES = " || ".join(f"list_transform({k}, lambda m: CAST({_sql_score(k)} AS VARCHAR))" for k in KINDS)
OP3_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS MATERIALIZED (SELECT doc_id,
  {sql_spans("email", EMAIL[1])} AS email,
  {sql_spans("ip", IP[1], f"regexp_matches(m.v, '{IP_VALID}')")} AS ip,
  {sql_spans("card", CARD[1], _SQL_LUHN)} AS card,
  {sql_spans("phone", PHONE[1], "length(regexp_replace(m.v, '[^0-9]', '', 'g')) BETWEEN 9 AND 15")} AS phone,
  {sql_spans("iban", IBAN[1], _SQL_ALONE.format("[A-Za-z0-9]") + " AND " + _SQL_MOD97 + f" AND {_sql_score('iban')} >= {MIN_SCORE}")} AS iban,
  {sql_spans("ssn", SSN[1], _SQL_ALONE.format("[0-9-]") + f" AND NOT regexp_matches(m.v, '^(000|666|9)|-00-|-0000$') AND {_sql_score('ssn')} >= {MIN_SCORE}")} AS ssn
  FROM d)
SELECT doc_id, CAST(len(email) AS BIGINT) AS n_email, CAST(len(ip) AS BIGINT) AS n_ip, CAST(len(card) AS BIGINT) AS n_card,
  CAST(len(phone) AS BIGINT) AS n_phone,
  sha256({sql_joined("list_concat(list_concat(email, ip), list_concat(card, phone))")}) AS base_sha256,
  {sql_joined("list_concat(list_concat(list_concat(email, ip), list_concat(card, phone)), list_concat(iban, ssn))")} AS spans,
  array_to_string({_SQL_SCORES}, ',') AS scores
FROM f
"""
