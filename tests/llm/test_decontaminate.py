import random
import re

from logloom.llm import decontaminate as D

DOC = "doc_id long, text string, item_id string, n_chars long, h string, spans string"


def words(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(docs, items, size=10):
    out = []
    for d, t in docs:
        w, hit, names = words(t), set(), set()
        for name, text in items:
            x = words(text)
            k = min(size, len(x))
            grams = {tuple(x[i:i + k]) for i in range(len(x) - k + 1)} if k else set()
            for i in range(len(w) - k + 1):
                if tuple(w[i:i + k]) in grams:
                    hit |= set(range(i, i + k))
                    names.add("" if name is None else str(name))
        out.append((d, len(w), len(hit), sorted(names)))
    return sorted(out, key=repr)


def data():
    rnd = random.Random(2)
    vocab = ["a", "b", "c", "dé", "9", "x1", "Zo"]
    item = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, item(n)) for i, n in enumerate([3, 9, 10, 11, 40, 40, 200])] + [(7, None), (8, " .,"), (None, item(12)), (4, item(15))]
    docs = [(0, None), (1, ""), (2, "..."), (3, item(4000)), (3, item(30)), (None, items[4][1].upper())]
    for i in range(60):
        t = item(rnd.randint(0, 40))
        if i % 3 == 0:
            t += ", " + rnd.choice(items[3:7])[1].replace(" ", "-\n") + "! " + item(20)
        docs.append((10 + i, t))
    return docs + docs[-2:], items


def test_both_paths_equal_brute_force(spark):
    docs, items = data()
    df = spark.createDataFrame([(d, t, "i", 0, "h", "s") for d, t in docs], DOC)
    bm = spark.createDataFrame(items, "item_id int, text string")
    want = brute(docs, items)
    for limit in (D.BROADCAST_WORDS, 5):
        got = D.contamination(df, bm, broadcast_words=limit).collect()
        rows = [(r["doc_id"], r["n_words"], sum(s.end - s.start for s in r["spans"]), list(r["items"])) for r in got]
        assert sorted(rows, key=repr) == want


def test_spans_and_documents_are_removed(spark):
    bm = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    t = "Keep this. One, two three FOUR five six seven eight nine ten! And this."
    df = spark.createDataFrame([(1, t, "i", len(t), "h", "s"), (2, "clean é", "i", 7, "h", "s"), (3, None, None, None, None, None)], DOC)
    docs = D.decontaminate(df, bm)
    assert docs.columns == df.columns and sorted(r.doc_id for r in docs.collect()) == [2, 3]
    cut = {r.doc_id: (r.text, r.n_chars) for r in D.decontaminate(df, bm, mode="spans").collect()}
    assert cut == {1: ("Keep this. ! And this.", 22), 2: ("clean é", 7), 3: (None, None)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOC)
    bm = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b", "", 1, "", "")], DOC)
    assert D.contamination(none, bm).count() == 0
    assert [r.n_words for r in D.contamination(one, bm).collect()] == [2]
    assert D.decontaminate(one, bm).count() == 1
