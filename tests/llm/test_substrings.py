import random
import re

from logloom.llm import substrings as S

DOC = "doc_id long, text string, h string, removed string, sources string"


def norm(t):
    return " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t)))


def brute(docs, unit, unit_words=S.UNIT_WORDS, min_words=S.MIN_WORDS):
    """Removed spans per (doc_id, text), from a list of (doc_id, text)."""
    order = sorted(set(docs), key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = {}, {}
    for doc in order:
        cut, src, us = [], [], S.units(doc[1], unit)
        for a, b, _ in us:
            key = norm(doc[1][a:b])
            n = len(key.split())
            cut.append("short" if n < unit_words else "old" if key in seen else "new")
            src.append(seen.get(key) if cut[-1] == "old" else "-")
            if n >= unit_words:
                seen.setdefault(key, doc[0])
        spans, i = [], 0
        while i < len(us):
            if cut[i] != "old":
                i += 1
                continue
            j, last = i, i
            while j < len(us) and cut[j] != "new":
                last = j if cut[j] == "old" else last
                j += 1
            words = {}
            for k in range(i, last + 1):
                if cut[k] == "old":
                    words[src[k]] = words.get(src[k], 0) + len(norm(doc[1][us[k][0]:us[k][1]]).split())
            if max(words.values()) >= min_words:
                spans.append((us[i][0], us[last][1]))
            i = j
        out[doc] = spans
    return out


def test_units_keep_offsets():
    bangs = "ONE!! TWO!! THREE.%%% four"
    assert [bangs[a:b] for a, b, _ in S.units(bangs, "sentence")] == ["ONE!! TWO!! THREE", "four"]
    t = " One two. Three 3.5 four!\n\n  five\n \nsix?  "
    assert [t[a:b] for a, b, _ in S.units(t, "sentence")] == [" One two", "Three 3.5 four", "five", "six"]
    assert [t[a:b].strip() for a, b, _ in S.units(t, "paragraph")] == ["One two. Three 3.5 four!", "five", "six?"]
    assert S.units(None, "line") == S.units(" \n ", "line") == []


def test_removal_equals_brute_force(spark):
    rnd = random.Random(9)
    sent = [" ".join(rnd.choice("abcdefgé") + str(rnd.randint(0, 9)) for _ in range(rnd.randint(1, 14))) + rnd.choice([".", "!", "..."]) for _ in range(60)]
    docs = [(0, None), (1, ""), (2, " \n"), (None, " ".join(sent[:9]))]
    for i in range(120):
        own = [f"own{i}x{k} word here and more of it." for k in range(3)]
        parts = own + [rnd.choice(sent) for _ in range(rnd.randint(0, 9))]
        rnd.shuffle(parts)
        t = "".join(p.upper() * (rnd.random() < 0.1) or p for p in (q + rnd.choice([" ", "\n", "\n\n", "  "]) for q in parts))
        docs.append((10 + i, t))
    docs += [docs[-1], (5, docs[20][1]), (5, docs[30][1]), (500, "w " * 50_000), (501, "W  " * 50_000)]
    df = spark.createDataFrame([(i, t, "h", "r", "s") for i, t in docs], DOC)
    for unit in ("sentence", "line", "paragraph"):
        # rows alike in doc_id rank by the hash of their text: brute force needs the order of the tie
        tie = {r.t: r.h for r in df.where("doc_id = 5").selectExpr("text AS t", "xxhash64(text) AS h").collect()}
        want = brute(sorted(docs, key=lambda r: tie.get(r[1], 0) if r[0] == 5 else 0), unit)
        got = S.dedup_substrings(df, unit).collect()
        assert len(got) == len(docs)
        for r in got:
            d, t = r.row.doc_id, r.row.text
            spans = [(s.start, s.end) for s in r.removed]
            assert spans == want[(d, t)], (unit, d)
            left = list(t or "")
            for a, b in spans:
                left[a:b] = [""] * (b - a)
            assert (r.new_text is None) == (t is None) and norm(r.new_text or "") == norm("".join(left))
            assert bool(r.sources) <= bool(spans)


def test_empty_table(spark):
    assert S.dedup_substrings(spark.createDataFrame([], DOC)).count() == 0


def test_query_removes_every_repeated_unit(spark, tmp_path):
    short, mixed = "Thanks for reading this.", "one source holds these words. another source holds those words. a third holds seven more words here."
    parts = [p + "." for p in mixed.rstrip(".").split(". ")]
    texts = [short, *parts, f"First own text of five. {short} Second own text of five.", f"Third own text of five. {mixed}"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in S.op7_substring_dedup(spark, str(tmp_path)).collect()}
    assert [got[i].text for i in range(4)] == texts[:4]
    assert got[4].text == "First own text of five. Second own text of five." and got[4].n_removed == 1
    assert got[5].text.strip() == "Third own text of five." and list(got[5].source_doc_ids) == [1, 2, 3]


def test_query_finds_passages_inside_longer_units(spark, tmp_path):
    rnd = random.Random(4)
    own = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    passage, wide = own(60), "".join(chr(0x4E00 + rnd.randrange(5000)) for _ in range(80))
    long_ = own(80).split()
    texts = [f"{own(90)} {passage} {own(90)}", f"{own(40)}, {passage}; {own(50)}", " ".join(long_), " ".join([*long_[:40], "changed", *long_[41:]]),
             f"一二三四。{wide}。", f"五六七八九。{wide}。十五个字"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in S.op7_substring_dedup(spark, str(tmp_path)).collect()}
    assert all(got[i].text == texts[i] for i in (0, 2, 4))
    assert len(got[1].text.split()) <= 90 + 2 * 15 and list(got[1].source_doc_ids) == [0]
    assert set(texts[1].split()[:40]) <= set(got[1].text.split()) and texts[1].endswith(got[1].text[-200:])
    assert "changed" in got[3].text and len(got[3].text.split()) <= 40
    assert got[5].text == "五六七八九。十五个字"


def test_parts_cover_a_unit():
    rnd = random.Random(5)
    for text in (" ".join(rnd.choice(["a", "b", "Cé", "x-y", "7"]) for _ in range(400)), "漢字かな" * 60 + " abc def", "w " * 3000):
        ps = S.pieces(text, "passage")
        assert " ".join(w.decode() for p in ps for w in p[3]) == norm(re.sub("([漢字かな])", r" \1 ", text))
        places = S._placed(text, ps, bool(S.WIDE.search(text)))
        assert places[0][0] == 0 and all(p[2] == q[0] for p, q in zip(places, places[1:])) and len(ps) > 1
        assert [norm(text[a:b]) for a, b, _ in places] == [norm(b" ".join(p[3]).decode()) for p in ps] or S.WIDE.search(text)
