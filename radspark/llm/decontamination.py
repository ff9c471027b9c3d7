"""Benchmark decontamination by template windows.

Each word loses its outer punctuation and ASCII case; numbers, names and units become typed placeholders.  A window is
``WINDOW`` words (a benchmark item with fewer words is one window of its length).  Where fewer than ``LITERALS`` are literal, or
one of fewer than ``SHORTEST`` words has a placeholder, all words of the window stand for themselves.  Windows of documents and
items meet in a hash join on the window's hash; a bitmap of fixed size over the items' hashes keeps other windows of documents
out of the join.  Matches of one document and item are grouped by alignment
(document place minus item place); an alignment counts if its slots are consistent: equal item values stand for equal
document values.  A document and item are a hit if consistent alignments hold ``LEAST`` different windows of the item, or all
of them where it has fewer; or that many of its windows with placeholders or enough literals.  Hits whose slot values are all
equal are ``verbatim``, others ``template``.

A number is digits with inner signs, digits with up to three letters, or a number word; a name is a capital followed by a small
letter that doesn't begin a sentence or line.  As names depend on case, windows with names are also compared with the names as
literal words in their small form, so that a copy in capitals or small letters matches.  Rows with equal doc_id and text
give one result, and so do repeated items; different texts under one item_id (a null one too) are items of their own.  Null and
empty texts and items match nothing; texts of any length are searched whole; empty tables give an empty result.  Columns beside
ids and texts aren't read; ``clean`` keeps them all, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radspark.llm import _text
from radspark.llm._bitmap import bitmap, passes
from radspark.llm._columns import fresh
from radspark.llm.toxicity import _OUTER

WINDOW, LITERALS, SHORTEST, LEAST = 8, 5, 4, 3
# Number words and units.
NUMBERS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
UNITS = "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound pounds ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent degree degrees meter meters metre metres kilometer kilometers kilometre kilometres".split()
NUM, NAME, UNIT = (np.uint64(x) for x in (0xA11CE5, 0xB0B5, 0xC0FFEE))


def _known(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    offsets = np.cumsum([0, *map(len, raw)])
    return np.sort(_text.Words(np.frombuffer(b"".join(raw), np.uint8), offsets).hashes())


def template(data: np.ndarray, offsets: np.ndarray):
    """Row, word code, flags of numbers, units and names, start and end (without outer punctuation) of each word of a slice."""
    w = _text.Words(data, offsets, fold=True)
    s, e = w.start.copy(), w.end.copy()
    if not len(s):
        return w.doc, np.zeros(0, np.uint64), *[np.zeros(0, bool)] * 3, s, e
    last = data[w.end - 1]
    for _ in range(4):
        s += (s < e - 1) & _OUTER[data[s]]
        e -= (s < e - 1) & _OUTER[data[e - 1]]
    code = w.span(s, e)
    digit = (data >= 48) & (data <= 57)
    letter = ((w.data >= 97) & (w.data <= 122)) | (data >= 0x80)
    digits, letters = (np.concatenate(([0], np.cumsum(x))) for x in (digit, letter))
    nd, nl = digits[e] - digits[s], letters[e] - letters[s]
    number = (nd > 0) & ((nl == 0) | (digit[s] & (nl <= 3))) | np.isin(code, _known(NUMBERS))
    unit = np.isin(code, _known(UNITS)) & ~number
    upper = ((data >= 65) & (data <= 90))[s]
    second = data[np.minimum(s + 1, len(data) - 1)]
    small = (s + 1 < e) & (((second >= 97) & (second <= 122)) | (second >= 0x80))
    begins = np.ones(len(s), bool)
    ends = np.isin(last, np.frombuffer(b".!?:|", np.uint8))
    newline = np.concatenate(([0], np.cumsum(data == 10)))
    begins[1:] = ends[:-1] | (w.doc[1:] != w.doc[:-1]) | (newline[w.start[1:]] > newline[w.end[:-1]])
    name = upper & small & ~begins & ~number & ~unit
    return w.doc, code, number, unit, name, s, e


def windows(data, offsets, lengths, table=None):
    """(row, place, length, hash, slots, free) of each window; free: with names as slots. lengths: WINDOW first, then those of short items."""
    doc, plain, number, unit, name, s, e = template(data, offsets)
    some = np.where(number, NUM, np.where(unit, UNIT, plain))
    slots = [number | unit | name, number | unit, np.zeros(len(plain), bool)]
    named, typed, _ = (np.concatenate(([0], np.cumsum(x))) for x in slots)
    first = np.searchsorted(doc, doc)
    for n in lengths:
        need = min(LITERALS, n - 1) if n >= SHORTEST else n
        for kind, codes in enumerate((np.where(name, NAME, some), some, plain)):
            h, at = _text.grams(codes, doc, n)
            h = _text.mix(h + np.uint64(n))
            all_slots, typed_slots = named[at + n] - named[at], typed[at + n] - typed[at]
            keep = n - all_slots >= need if kind == 0 else (n - typed_slots >= need) & (all_slots > typed_slots) if kind == 1 else n - typed_slots < need
            if table is not None:
                keep &= passes(table, h)
            for i in np.flatnonzero(keep):
                k = at[i]
                values = [_text.FOLD[data[s[j] : e[j]]].tobytes().decode(errors="replace") for j in range(k, k + n) if slots[kind][j]]
                yield int(doc[k]), int(k - first[k]), n, h[i], values, kind == 0


def _emit(rows, extra: int, lengths, table=None):
    """A function for mapInArrow: the first columns, then place, n, h, slots and free of each window of the last column."""

    def run(batches):
        t = None if table is None else table.value
        for batch in batches:
            row, place, size, hashes, slots, free = [], [], [], [], [], []
            for i, _, data, offsets in _text.slices(batch.column(extra)):
                for d, p, n, h, v, f in windows(data, offsets, lengths, t):
                    row.append(i + d)
                    place.append(p)
                    size.append(n)
                    hashes.append(h)
                    slots.append(v)
                    free.append(f)
            took = pa.array(row, pa.int64())
            arrays = [batch.column(k).take(took) for k in range(extra)]
            arrays += [pa.array(place, pa.int32()), pa.array(size, pa.int32()), pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(slots, pa.list_(pa.string())), pa.array(free, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:extra], "place", "n", "h", "slots", "free"])

    return rows.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:extra]), "place int, n int, h bigint, slots array<string>, free boolean"]))


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_hash, item_id, kind, n_windows, n_slots, first_word of each contaminated document and item text."""
    items = benchmark.where("text is not null").select("item_id", F.col("text").alias("_t")).distinct()
    items = items.withColumns({"_key": F.xxhash64("item_id", "_t"), "_words": F.regexp_count("_t", F.lit(_text.WORD))})
    short = sorted(r["_words"] for r in items.where(F.col("_words").between(1, WINDOW - 1)).select("_words").distinct().collect())
    lengths = [WINDOW, *short]
    known = _emit(items.select("_key", "_t"), 1, lengths)
    known = known.join(items.select("_key", "_words"), "_key").where((F.col("n") == WINDOW) | (F.col("n") == F.col("_words")))
    known = known.withColumnsRenamed({"place": "item_place", "slots": "item_slots"})
    all_of = known.groupBy("_key").agg(
        F.count_distinct("item_place").alias("_all"), F.count_distinct(F.when(F.col("free"), F.col("item_place"))).alias("_all_free")
    )
    table = docs.sparkSession.sparkContext.broadcast(bitmap(known, "h"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text"))
    found = _emit(rows, 2, lengths, table).drop("free")
    match = found.join(known, ["h", "n"]).select(
        "doc_id", "text_hash", "_key", "item_place", "place", (F.col("place") - F.col("item_place")).alias("_shift"),
        F.arrays_zip("item_slots", "slots").alias("_pairs"), F.when(F.col("free"), F.col("item_place")).alias("_free"),
    )
    by = ["doc_id", "text_hash", "_key", "_shift"]
    aligned = match.groupBy(*by).agg(
        F.collect_set("item_place").alias("_places"), F.collect_set("_free").alias("_frees"), F.min("place").alias("_first"), F.array_distinct(F.flatten(F.collect_set("_pairs"))).alias("_pairs")
    )
    values = F.size(F.array_distinct(F.transform("_pairs", lambda p: p["item_slots"])))
    same = F.forall("_pairs", lambda p: p["item_slots"] == p["slots"])
    good = aligned.where(values == F.size("_pairs")).withColumn("_same", same)
    one = good.groupBy("doc_id", "text_hash", "_key").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("_places")))).alias("n_windows"),
        F.size(F.array_distinct(F.flatten(F.collect_list("_frees")))).alias("_n_free"), F.min("_same").alias("_same"), F.max(F.size("_pairs")).alias("n_slots"), F.min("_first").alias("first_word"),
    )
    enough = F.col("n_windows") >= F.least(F.lit(LEAST), F.col("_all"))
    free = (F.col("_all_free") > 0) & (F.col("_n_free") >= F.least(F.lit(LEAST), F.col("_all_free")))
    return one.join(all_of, "_key").where(enough | free).join(items.select("_key", "item_id"), "_key").select(
        "doc_id", "text_hash", "item_id", F.when(F.col("_same"), "verbatim").otherwise("template").alias("kind"), "n_windows", "n_slots", "first_word"
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit, with all their columns (whatever their names)."""
    d, x = fresh(docs, "_d", "_x")
    bad = hits(docs, benchmark).select(F.col("doc_id").alias(d), F.col("text_hash").alias(x)).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(x)), "left_anti")
