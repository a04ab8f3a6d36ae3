import random
import re

from logloom.llm import pii as P
from logloom.llm.spans import joined
from pyspark.sql import functions as F

DOC = "doc_id long, text string, email string, ip string, start long"


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        t += x - 9 if x > 9 else x
    return t % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


BASE = [("email", P.EMAIL[1], lambda v: True),
        ("ip", P.IP[1], lambda v: all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in v.split("."))),
        ("card", P.CARD[1], lambda v: 13 <= len(digits(v)) <= 19 and luhn(digits(v))),
        ("phone", P.PHONE[1], lambda v: 9 <= len(digits(v)) <= 15)]


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in BASE for m in re.finditer(p, text or "") if ok(m.group())]


def base_spans(df):
    found = P.personal_data(df)
    return {r.doc_id: r.s.split(",") if r.s else [] for r in
            found.select("doc_id", joined(P._plain(P.BASE)).alias("s")).collect()}


def test_base_spans_equal_brute_force(spark):
    rnd = random.Random(4)
    bits = ["a@b.co", "a.b%+c@x-y.z.q", "@", "..", "1.2.3.4", "300.1.1.1.5.6", "0001.2.03.255", "4111 1111 1111 1111", "4111-1111-1111-1112",
            "+1 (743) 555-3824", "+12", "+49 (0", "é😀", " ", "\n", "_", "a@b.c_d@e.f", "7992739871300000000", "5", "-", "x" * 30, "9" * 25]
    rows = [(0, None), (1, ""), (2, "a@b" * 300), (3, "1" * 5000 + ".1" * 3000), (4, "a" * 200_000 + "@b.c"), (5, "+1" * 4000),
            (6, " ".join(f"u{i}@mail.example.com 10.0.0.{i % 300}" for i in range(4000)))]
    for i in range(300):
        rows.append((10 + i, "".join(rnd.choice(bits) + rnd.choice(["", " ", "é"]) for _ in range(rnd.randint(1, 30)))))
    df = spark.createDataFrame([(i, t, "e", "i", 1) for i, t in rows], DOC)
    got = base_spans(df)
    for i, t in rows:
        assert got[i] == brute(t), (i, t[:200], got[i][:5], brute(t)[:5])


def test_added_kinds_and_scores(spark):
    text = ("IBAN DE89370400440532013000 and GB82 WEST 1234 5698 7654 32, wrong DE88370400440532013000, xDE89370400440532013000. "
            "My SSN: 123-45-6789. Part 123-45-6788 of series" + " far" * 20 + " 123-45-6780 000-12-3456 call +1 (743) 555-3824 or " + "z " * 40 + "+1 (743) 555-3824")
    r = P.personal_data(spark.createDataFrame([(1, text, "", "", 0)], DOC)).first()
    assert [text[s.start:s.end] for s in r.iban] == ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"]
    assert text[r.ssn[0].start:r.ssn[0].end] == "123-45-6789" and all(s.score >= P.MIN_SCORE for s in r.ssn)
    assert "123-45-6780" not in [s.value for s in r.ssn]
    assert [s.score for s in r.phone] == [100, 60]


def test_empty_repeated_and_null_ids(spark):
    assert P.personal_data(spark.createDataFrame([], DOC)).count() == 0
    df = spark.createDataFrame([(None, "a@b.c", None, None, None), (7, "a@b.c", "", "", 1), (7, "a@b.c", "", "", 1)], DOC)
    assert sorted(str(r.doc_id) + r.email[0].value for r in P.personal_data(df).collect()) == ["7a@b.c", "7a@b.c", "Nonea@b.c"]


def test_contrary_words_lower_the_score(spark):
    gap = " far" * 20
    text = f"release 10.1.2.3{gap} server 10.1.2.4{gap} version of server 10.1.2.5{gap} 10.1.2.6{gap} ssn serial 123-45-6789{gap} part no DE89370400440532013000"
    r = P.personal_data(spark.createDataFrame([(1, text, "", "", 0)], DOC)).first()
    assert [s.score for s in r.ip] == [20, 90, 60, 50]
    assert r.ssn == [] and r.iban == []  # 30 + 40 - 30 and 80 - 30
