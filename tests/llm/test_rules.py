import math
import random
import re

from pyspark.sql import functions as F

from logloom.llm import rules as R

DOC = "doc_id long, text string, lang string, stratum string, words string, kept string"


def brute(text):
    t = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    where = {}
    for i in range(len(w) - 7):
        where.setdefault(tuple(w[i:i + 8]), []).append(i)
    hit = {p for at in where.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    n = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
    return n + (len(w) < 20 or 100 * len(hit) > 30 * len(w),)


def test_features_equal_brute_force(spark):
    rnd = random.Random(2)
    words = ["a", "bé", "c##", "😀", "d|<>", "!!"]
    texts = [None, "", " \n\t", "one", "a b c d e f g h " * 2000, "a\n" * 50, "x" * 100_000, "\x0b\x0c\r\n a", "a\x85b c"]
    texts += [rnd.choice(["", "\n"]).join(rnd.choice(words[:rnd.randint(2, 6)]) + rnd.choice([" ", "  ", "\n"]) for _ in range(rnd.randint(1, 120))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, "en", "s", "w", "k") for i, t in enumerate(texts)], DOC)
    out = R.apply_rules(df, spark.createDataFrame([], "doc_id long, quality int"))
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in out.collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t) + (not brute(t)[-1],), (i, (t or "")[:80])


def test_binomial_bound(spark):
    cases = [(0, 600, .005), (0, 2000, .005), (1, 2000, .005), (5, 3000, .005), (40, 20000, .005), (0, 0, .1), (3, 10, .5), (400, 100000, .005), (8, 8, .2)]
    df = spark.createDataFrame([(k, n) for k, n, _ in cases], "k long, n long")
    for k, n, s in cases:
        got = df.where((F.col("k") == k) & (F.col("n") == n)).select(R.binomial_p(F.col("k"), F.col("n"), s)).first()[0]
        want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(s) + (n - j) * math.log(1 - s)) for j in range(k + 1))
        assert got == 1 if k >= n * s else abs(got - want) < 1e-9 + 1e-7 * want, (k, n, s, got, want)


def test_cutoffs_are_limited_by_risk(spark):
    rows, labels = [], []
    for i in range(6000):
        bad, lang = i % 5 == 0, "en" if i % 3 else ("de" if i % 2 else None)
        word = "x## " if bad else ("y# " if i % 50 == 1 and lang == "en" else "z ")
        rows.append((i, "".join(f"{word.strip()}{j} " for j in range(25)), lang, "", "", ""))
        labels.append((i, int(not bad)))
    df = spark.createDataFrame(rows, DOC)
    lab = spark.createDataFrame(labels + labels[:50] + [(7, None)], "doc_id long, quality int")
    feats = R.features(df)
    cuts = {r.stratum: r.cut_symbols for r in R.cutoffs(feats, lab).collect()}
    assert cuts.get("en") is None  # any cutoff that catches the bad rows would lose the good y# rows, too
    out = R.apply_rules(df, lab).join(lab.dropDuplicates(["doc_id"]).where("quality IS NOT NULL"), "doc_id")
    lost = out.where("quality = 1").groupBy("stratum").agg(F.avg((~F.col("kept")).cast("int")).alias("r")).collect()
    assert all(r.r <= R.ALPHA for r in lost)


def test_bad_documents_are_rejected_where_labels_suffice(spark):
    rows = [(i, "".join(f"{'x##' if i % 5 == 0 else 'z'}{j} " for j in range(25)), "en", "", "", "") for i in range(4000)]
    lab = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(4000)], "doc_id long, quality int")
    df = spark.createDataFrame(rows + [(9000, "x## " + "z " * 30, None, "", "", "")], DOC)
    out = R.apply_rules(df, lab)
    assert out.where("doc_id < 4000 AND kept = (doc_id % 5 > 0)").count() == 4000
    assert R.apply_rules(spark.createDataFrame([], DOC), lab).count() == 0


def test_repeated_rows_count_once_and_sequences_stop_at_a_failure(spark):
    # 300 good documents listed ten times are 300: too few for any cutoff, as 3000 different ones would not be
    text = lambda i: "".join(f"{'x##' if i % 2 else 'z'}{j} " for j in range(25))
    rows = [(i, text(i), "en", "", "", "") for i in range(600)]
    lab = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(600)], "doc_id long, quality int")
    many = spark.createDataFrame(rows * 10 + [(None, text(1), "en", "", "", "")], DOC)
    assert R.cutoffs(R.features(many), lab).count() == 0
    # cutoffs 100 to 20 lose nothing, 10 loses every good document: 5 is not tried
    rows = [(i, "".join(f"{'x##' if i % 2 else ('y#' if j % 8 == 0 else 'z')}{j} " for j in range(32)), "en", "", "", "") for i in range(4000)]
    lab = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(4000)], "doc_id long, quality int")
    assert R.cutoffs(R.features(spark.createDataFrame(rows, DOC)), lab).first().cut_symbols == 100
