"""Substring deduplication by hashing lines, paragraphs or sentences (operator 7).

Texts are cut into units, units are normalised (case, punctuation and white
space folded) and hashed to 128 bits, and digests are grouped over the whole
corpus.  Every occurrence but the earliest ranked (smallest doc_id, then
position) is a repeat.  A run of neighbouring repeats is removed if at least
``min_words`` of its words have their earliest occurrence in one document; units
of fewer than ``unit_words`` words are not hashed and go with a run if they
stand inside it.

The query cuts at passages, since these are shared in the middle of lines and of
sentences, too: sentences, with East Asian stops and one word per ideograph or
kana, of which those of more than LONG words are cut again at word boundaries
that their words define, so that equal stretches of words are cut alike wherever
they stand.  A repeated sentence always goes, whatever its neighbours' sources;
a repeated part of a sentence goes in a run with LONG words, over all sources.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain, groupby
from operator import itemgetter
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import packed, sliced, table
from logloom.llm.decontaminate import WORD, words_of

# a sentence ends at one mark (or dots) with any symbols behind it; "!!" after every word ends none
BOUNDARY = {"sentence": re.compile(r"(?<![!?])(?:\.+|[!?])(?![!?])[^\w\s]*\s+|\s*\n\s*"), "line": re.compile(r"\s*\n\s*"), "paragraph": re.compile(r"\s*\n[^\S\n]*\n\s*"),
            "passage": re.compile(r"(?<![!?])(?:\.+|[!?])(?![!?])[^\w\s]*\s+|\s*\n\s*|[。！？｡．][^\w\s]*\s*")}
UNIT_WORDS = 4
MIN_WORDS = 15
LONG = 15  # passages of more words are cut again; parts go in runs of so many words
REACH = 4  # a part starts at the least word hash of so many on either side, so parts have more words
MOST = 64  # words of a part without a least hash (the same few words over and over)
_WIDE = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WIDE = re.compile(f"[{_WIDE}]")
WIDE_WORD = re.compile(rf"[{_WIDE}]|[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F\u3000-\u303f\uff00-\uff0f\uff1a-\uff20{_WIDE}]+")


def units(text: str | None, unit: str) -> list[tuple[int, int, int]]:
    """(start, end, next start) of the units of a text, in code points; blank ones are left out."""
    text, out, at = text or "", [], 0
    for m in BOUNDARY[unit].finditer(text):
        if text[at:m.start()].strip():
            out.append((at, m.start(), m.end()))
        at = m.end()
    if text[at:].strip():
        out.append((at, len(text), len(text)))
    return out


def _parts(sizes: list[int], words: list[bytes]) -> list[list[int]]:
    """Per long unit, the numbers of the words at which its parts start; ``words`` are those of all units."""
    n, ends = len(words), np.cumsum(sizes)
    key = np.fromiter(map(crc32, words), np.uint64, n)
    after = np.append(key[1:], np.uint64(0))
    after[ends - 1] = 0  # nothing behind a unit counts
    key = (key * np.uint64(0x9E3779B97F4A7C15) ^ after) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(8)
    least = np.ones(n, bool)
    for k in range(1, REACH + 1):
        less = key[k:] < key[:-k]
        least[k:] &= less
        least[:-k] &= ~less
    found, out, b = np.flatnonzero(least), [], 0
    lo, hi = np.searchsorted(found, ends - sizes + REACH, "right").tolist(), np.searchsorted(found, ends - REACH).tolist()
    found = found.tolist()
    for size, x, y in zip(sizes, lo, hi):
        at = [0]
        for q in (*(f - b for f in found[x:y]), size):
            at.extend(range(at[-1] + MOST, q - REACH, MOST))
            at.append(q)
        out.append(at[:-1])
        b += size
    return out


def _folded(text: str, a: int, b: int, wide: bool) -> list[bytes]:
    return [w.encode().lower() for w in WIDE_WORD.findall(text, a, b)] if wide else words_of(text[a:b])


def pieces(text: str | None, unit: str) -> list[tuple[int, int, int, list[bytes], int, int]]:
    """(start, end, next start of the unit, folded words, number of the first word, number of parts).

    Units are whole but for long passages, which come in parts.
    """
    wide = unit == "passage" and bool(WIDE.search(text or ""))
    rows = [(a, b, c, _folded(text, a, b, wide)) for a, b, c in units(text, unit)]
    long_ = [r[3] for r in rows if len(r[3]) > LONG] if unit == "passage" else []
    if not long_:
        return [(*r, 0, 1) for r in rows]
    cuts, out = iter(_parts([len(w) for w in long_], list(chain.from_iterable(long_)))), []
    for a, b, c, words in rows:
        at = next(cuts) if len(words) > LONG else (0,)
        if len(at) == 1:
            out.append((a, b, c, words, 0, 1))
        else:
            out.extend((a, b, c, words[i:j], i, len(at)) for i, j in zip(at, [*at[1:], None]))
    return out


def _placed(text: str, rows: list, wide: bool) -> list[tuple[int, int, int]]:
    """(start, end, next start) of the parts of one unit."""
    a, b, c = rows[0][:3]
    place = [m.start() for m in (WIDE_WORD if wide else WORD).finditer(text, a, b)]
    begin = [a, *(place[r[4]] for r in rows[1:])]
    return [*((x, x + len(text[x:y].rstrip()), y) for x, y in zip(begin, begin[1:])), (begin[-1], b, c)]


def _unit_rows(unit: str, unit_words: int):
    def run(batches):
        for batch in sliced(batches):
            ids, hashes = batch.column("doc_id"), batch.column("h").to_numpy()
            row, start, digest = [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                for a, _, _, words, i, _ in pieces(text, unit):
                    if len(words) >= unit_words:
                        row.append(k)
                        start.append(a + i)  # rises with the place and differs from those of all others
                        digest.append(xxhash.xxh3_128_digest(b" ".join(words)))
                if len(row) > 20_000 or k == batch.num_rows - 1:
                    d = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
                    take = np.array(row, np.int64)
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": ids.take(pa.array(take)), "h": hashes[take], "start": np.array(start, np.int64),
                        "d1": d[:, 0].copy(), "d2": d[:, 1].copy()})
                    row, start, digest = [], [], []
    return run


def repeats(docs: DataFrame, unit: str = "sentence", unit_words: int = UNIT_WORDS) -> DataFrame:
    """doc_id, h, start of every repeated unit but the earliest, with ``source``, the doc_id of the earliest.

    A part of a passage has as start that of the passage plus the number of its first word.

    h is the hash of the text; rows alike in doc_id and text are one document.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(_unit_rows(unit, unit_words), f"doc_id {kind}, h long, start long, d1 long, d2 long")
    rank = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "h", "start")
    first = (found.groupBy("d1", "d2").agg(F.min(rank).alias("first"), F.max(rank).alias("last"))
             .where("first <> last").select("d1", "d2", "first"))  # digests with a second place
    return (found.join(first, ["d1", "d2"])
            .where(~rank.eqNullSafe(F.col("first")))
            .select("doc_id", "h", "start", F.col("first.doc_id").alias("source")))


def _cut(text: str, repeated: dict[int, object], unit: str, unit_words: int, min_words: int) -> tuple[str, list[tuple[int, int]], int, list[int]]:
    """Text without the long runs, their spans, the number of removed units, and the removed repeats' starts.

    ``repeated``: start of a repeated unit -> document of its earliest occurrence.
    """
    spans, kept, end, n, starts = [], [], 0, 0, []
    run: list = []

    def remove(run):
        nonlocal end, n
        while run and run[-1][0] not in repeated:
            run.pop()  # short units behind the last repeat stay
        if run:
            spans.append((run[0][1], run[-1][2]))
            kept.append(text[end:run[0][1]])
            end = run[-1][3]
            n += len(run)
            starts.extend(key for key, *_ in run if key in repeated)

    def close():
        shared = Counter()
        for key, _, _, _, w, _ in run:
            if key in repeated:
                shared[repeated[key]] += w
        if unit != "passage":
            if max(shared.values(), default=0) >= min_words:
                remove(run)
        elif shared.total() >= LONG:
            remove(run)
        else:  # parts at either end of the whole passages stay
            inner = [k for k, x in enumerate(run) if x[0] in repeated and not x[5]]
            remove(run[inner[0]:inner[-1] + 1] if inner else [])
        run.clear()

    rows, wide = pieces(text, unit), unit == "passage" and bool(WIDE.search(text))
    for a, group in groupby(rows, key=itemgetter(0)):
        group = list(group)
        if len(group) > 1 and (run or any(a + r[4] in repeated for r in group)):
            places = _placed(text, group, wide)
        else:
            places = [r[:3] for r in group]
        for (x, y, z), r in zip(places, group):
            key, size = a + r[4], len(r[3])
            if key in repeated or run and size < unit_words:
                run.append((key, x, y, z, size, r[5] > 1))
            else:
                close()
    close()
    return "".join(kept) + text[end:], spans, n, starts


def dedup_substrings(docs: DataFrame, unit: str = "sentence", unit_words: int = UNIT_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """``row`` (all columns of ``docs``) with new_text, removed (spans in the original text), n_removed, sources.

    ``min_words`` holds for all units but passages.
    new_text is the text without repeats and null where the text is null;
    sources are the doc_ids that hold the earliest occurrences.  Null or empty
    texts have no units; null doc_ids rank last; no rows, no result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = repeats(docs, unit, unit_words).groupBy("doc_id", "h").agg(
        F.collect_list(F.struct("start", "source")).alias("hits")).select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "hits")
    rows = packed(docs).withColumn("text", F.col("row.text").cast("string")).withColumn("h", F.xxhash64("row.text"))
    both = rows.join(found, F.col("row.doc_id").eqNullSafe(F.col("d")) & F.col("h").eqNullSafe(F.col("g")), "left")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in sliced(batches):
            texts, removed, counts, sources = [], [], [], []
            for text, hits in zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist()):
                spans, n, src = [], 0, []
                if hits:
                    where = {x["start"]: x["source"] for x in hits}
                    text, spans, n, starts = _cut(text, where, unit, unit_words, min_words)
                    src = sorted({where[a] for a in starts if where[a] is not None})
                texts.append(text)
                removed.append([{"start": a, "end": b} for a, b in spans])
                counts.append(n)
                sources.append(src)
            yield pa.RecordBatch.from_pydict({
                "row": batch.column("row"), "new_text": pa.array(texts, pa.string()), "removed": pa.array(removed, span),
                "n_removed": pa.array(counts, pa.int64()), "sources": pa.array(sources, pa.list_(batch.schema.field("row").type.field("doc_id").type))})

    schema = (f"row {rows.schema['row'].dataType.simpleString()}, new_text string, "
              f"removed array<struct<start:long,end:long>>, n_removed long, sources array<{kind}>")
    return both.select("row", "text", "hits").mapInArrow(run, schema)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text after removal, the removed spans and the documents that keep them."""
    out = dedup_substrings(table(spark, sf_dir, "documents"), "passage")
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_removed", spans.alias("removed_spans"),
                      F.col("sources").alias("source_doc_ids"), F.col("new_text").alias("text"))
