"""N-gram Jaccard join by universe partition and the pigeonhole principle; connected groups of similar documents.

A document's set holds the 64-bit hashes of its distinct word shingles.  Sets fall into size bands; a band whose largest set
has m shingles uses H = D + 1 segments, D = floor((100 - p) m / p), since two sets with a Jaccard similarity of p percent, the
smaller one in the band, differ in at most D shingles.  Shingles are dealt to segments by hash, so a similar pair agrees on a
whole segment.  A set indexes the segments of its own band and probes its own band and those below that hold partners of
sufficient size.

Allocation: a probe may leave out a segment if it looks up another one with a tolerance of one shingle, since what must be
given in all, sum(tolerance + 1) >= D + 1, stays the same.  Segments that hold none or one of the probe's shingles cost most,
as many sets share them; each is left out for a segment of the band's pool (the first sixteenth, for which the index also has
all one-deletion neighbours) that holds two or more, the emptiest for the fullest, as long as that lowers the expected
number of candidates.  Narrow bands keep the segments of a band's smallest sets from being empty too often.

Every pair passes a parity sketch before its sets meet: each shingle flips one bit of its set's sketch, so two sets whose
sketches differ in k bits differ in k shingles at least.  A sketch has at least two bits for each shingle, in powers of two
from ``FOLDED``, so that it doesn't saturate in long texts; the longer of two sketches is folded to the shorter one's length.

Candidates meet by signature.  A signature's group of more than ``PART`` members is dealt out to parts.  In each group or part
the smallest probing set is the first centre, the smallest one whose sketch rules out the first is the second, and so on for
``CENTRES`` of them.  A member makes a pair with each centre that its sketch leaves room for, and so do the centres of a group's
first part with those of its other parts; pairs are tested by their full sketches and verified exactly.  What is left are the
members, centres of undivided groups aside, of groups that lie in several components now: a join by signature compares their
sketches in its condition, so that it gives near pairs only, each at the smallest of its common signatures (where that one is
among the ``LISTED`` smallest of both), whatever its two roles there.  So a group of n similar sets costs n pairs, and no link
between components is lost.

Shingles and sets are known by 64-bit hashes, also in the exact verification (see _text).
Null texts and texts without words have an empty set (0 shingles) and are linked with nothing; fewer words than a shingle make
one shingle of them all; equal sets are one node, so repeated rows and texts are one too.  Texts of any length go in whole; a
null doc_id is placed but names no component; an empty table gives an empty result.  ``groups`` reads doc_id and text alone;
``deduplicated`` keeps all columns, whatever their names, of the row with the smallest doc_id, then text hash.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radspark.llm import _text
from radspark.llm._bitmap import bitmap, passes
from radspark.llm._columns import fresh
from radspark.plans.components import connected_components
from radspark.plans.storage import drop, materialize, release

RATIO, POOL, FOLDED, LISTED, CENTRES = 1.25, 16, 512, 16, 3
#: Members of a signature that one task takes together.
PART = 4096
#: Longs of a folded sketch.
FOLD = [f"s{k}" for k in range(FOLDED // 64)]
#: Sets of more than LARGE shingles also bring a sketch of LARGE_BITS to the residual join.
LARGE, LARGE_BITS = 1024, 2048
#: Sketch bits made at once, if no single row needs more.
BITS_AT_ONCE = 1 << 22


class Bands:
    def __init__(self, percent: int):
        self.percent = percent
        low = [-(-percent // (100 - percent))]  # smaller sets are similar only to equal ones
        while low[-1] < 1 << 40:
            low.append(max(low[-1] + 1, int(low[-1] * RATIO)))
        self.low = np.array(low, np.int64)
        self.segments = (100 - percent) * (self.low[1:] - 1) // percent + 1

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, n, "right") - 1


def sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) pairs of a slice, by row and distinct."""
    w = _text.Words(data, offsets, fold=True)
    code = w.hashes()
    h, at = _text.grams(code, w.doc, words)
    doc = w.doc[at]
    count = w.counts()
    few = np.flatnonzero((count > 0) & (count < words))
    if len(few):
        first = np.searchsorted(w.doc, few)
        whole = np.zeros(len(few), np.uint64)
        for k in range(words - 1):
            more = count[few] > k
            whole[more] = _text.mix(whole[more] * np.uint64(3) + code[first[more] + k] + np.uint64(k + 1))
        doc, h = np.concatenate((doc, few)), np.concatenate((h, whole))
    return _text.distinct_by_doc(doc, h)


def nodes(doc: np.ndarray, code: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and 64-bit id of each row's set."""
    at = np.searchsorted(doc, np.arange(rows + 1))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_text.mix(code ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
    n = np.diff(at)
    return n, _text.mix(sums[at[1:]] - sums[at[:-1]] + n.astype(np.uint64))


def _group_rank(group: np.ndarray) -> np.ndarray:
    """Place of each element within its run of equal values."""
    if not len(group):
        return np.zeros(0, np.int64)
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    at = np.flatnonzero(new)
    return np.arange(len(group)) - np.repeat(at, np.diff(np.append(at, len(group))))


def signatures(doc: np.ndarray, code: np.ndarray, n: np.ndarray, bands: Bands, own: bool, band: np.ndarray):
    """(row, signature, role) for rows whose ``band`` is not negative. Role 1: index, 2: probe, 3: both."""
    h = np.where(band >= 0, bands.segments[np.maximum(band, 0)], 0)
    base = np.concatenate(([0], np.cumsum(h)))
    use = band[doc] >= 0
    doc, code = doc[use], code[use]
    seg = ((code >> np.uint64(20)) % np.maximum(h[doc], 1).astype(np.uint64)).astype(np.int64)
    place = base[doc] + seg
    order = np.argsort(place)
    place, value = place[order], _text.mix(code[order] + np.uint64(0x2545F4914F6CDD1D))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
    at = np.searchsorted(place, np.arange(base[-1] + 1))
    size, content = np.diff(at), sums[at[1:]] - sums[at[:-1]]
    row = np.repeat(np.arange(len(h)), h)
    number = np.arange(base[-1]) - base[row]
    where = _text.mix((band[row].astype(np.uint64) << np.uint64(40)) + number.astype(np.uint64))
    sign = lambda what, k, salt: _text.mix(what * np.uint64(0x9FB21C651E98DF25) + where[k] + np.uint64(salt))
    pool = number * POOL < h[row]
    # allocation
    out = np.flatnonzero(size <= 1)
    up = np.flatnonzero((size >= 2) & pool)
    out, up = out[np.lexsort((size[out], row[out]))], up[np.lexsort((-size[up], row[up]))]
    both = np.minimum(np.bincount(row[out], minlength=len(h)), np.bincount(row[up], minlength=len(h)))
    out, up = out[_group_rank(row[out]) < both[row[out]]], up[_group_rank(row[up]) < both[row[up]]]
    probe = np.ones(len(size), bool)
    probe[out] = False
    every = np.arange(len(size))
    parts = [(row, sign(content, every, 0), probe * 2 + own)] if own else [(row[probe], sign(content[probe], np.flatnonzero(probe), 0), np.full(int(probe.sum()), 2))]

    def deleted(some: np.ndarray, salt: int, role: int):
        k = np.repeat(some, size[some])
        t = np.repeat(at[some] - np.concatenate(([0], np.cumsum(size[some])[:-1])), size[some]) + np.arange(len(k))
        parts.append((row[k], sign(content[k] - value[t], k, salt), np.full(len(k), role)))

    if own:  # a probe of two or more finds only segments of three or more this way
        deleted(np.flatnonzero(pool & (size > 2)), 1, 1)
    if len(up):
        deleted(up, 0, 2)
        parts.append((row[up], sign(content[up], up, 1), np.full(len(up), 2)))
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(3))


def sketch_bits(n: np.ndarray) -> np.ndarray:
    """Bits of the sketch of a set of n shingles: a power of two, 2 n or more."""
    return np.maximum(FOLDED, 1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))


def sketches(doc: np.ndarray, code: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Parity sketches of the rows one after another, bits[k] / 64 longs for row k."""
    ends, at, out, i = np.cumsum(bits), np.searchsorted(doc, np.arange(len(bits) + 1)), [np.zeros(0, np.int64)], 0
    base = ends - bits
    while i < len(bits):
        j = max(i + 1, int(np.searchsorted(ends, base[i] + BITS_AT_ONCE, "right")))
        d = doc[at[i] : at[j]]
        place = (code[at[i] : at[j]] >> np.uint64(7)) % bits[d].astype(np.uint64)
        odd = np.bincount(base[d] - base[i] + place.astype(np.int64), minlength=int(ends[j - 1] - base[i])) & 1
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64))
        i = j
    return np.concatenate(out)


def _members(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, node, sketch and folded sketches of every row; node is null for an empty set."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, (sizes, marks, folds, large) = [np.zeros(0, np.uint64)], ([np.zeros(0, np.int64)] for _ in range(4))
            for i, j, data, offsets in _text.slices(batch.column(2)):
                doc, code = sets(data, offsets, words)
                n, node = nodes(doc, code, j - i)
                bits = sketch_bits(n)
                sizes.append(n)
                ids.append(node)
                marks.append(sketches(doc, code, bits))
                folds.append(sketches(doc, code, np.full(j - i, FOLDED)))
                long = n[doc] > LARGE
                large.append(sketches(doc[long], code[long], np.where(n > LARGE, LARGE_BITS, 0)))
            n, node = np.concatenate(sizes), np.concatenate(ids).view(np.int64)
            lengths = (sketch_bits(n), np.full(len(n), FOLDED), np.where(n > LARGE, LARGE_BITS, 0))
            lists = [
                pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(bits // 64))), pa.int32()), pa.array(np.concatenate(some)))
                for bits, some in zip(lengths, (marks, folds, large), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.int64(), mask=n == 0), *lists],
                ["doc_id", "text_hash", "n_shingles", "node", "sketch", "folded", "large"],
            )

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        run, f"doc_id {kind}, text_hash bigint, n_shingles bigint, node bigint, sketch array<bigint>, folded array<bigint>, large array<bigint>"
    )


def _signatures(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """sig, node, role; equal sets of one batch are told once."""

    def run(batches):
        bands = Bands(percent)
        for batch in batches:
            told: set[int] = set()
            for i, j, data, offsets in _text.slices(batch.column(0)):
                doc, code = sets(data, offsets, words)
                n, node = nodes(doc, code, j - i)
                new = np.array([not (x in told or told.add(x)) for x in node.tolist()], bool)
                mine = np.where(new, bands.of(n), -1)
                least = bands.of(-(-percent * n // 100))
                found = [signatures(doc, code, n, bands, True, mine)]
                back = 1
                while len(rows := np.flatnonzero((mine - back >= 0) & (mine - back >= least))):
                    below = np.full(len(n), -1)
                    below[rows] = mine[rows] - back
                    found.append(signatures(doc, code, n, bands, False, below))
                    back += 1
                row, sig, role = (np.concatenate([f[k] for f in found]) for k in range(3))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sig.view(np.int64)), pa.array(node[row].view(np.int64)), pa.array(role.astype(np.int8))], ["sig", "node", "role"]
                )

    return docs.select("text").mapInArrow(run, "sig bigint, node bigint, role tinyint")


def _shared(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """sig, node, role, parts, part of the signatures that an indexing and another, probing node have."""
    of_sig = Window.partitionBy("sig")
    met = _signatures(docs, words, percent).select(
        "*", F.min("node").over(of_sig).alias("_lo"), F.max("node").over(of_sig).alias("_hi"), F.ceil(F.count("*").over(of_sig) / PART).cast("int").alias("parts"),
        F.max(F.col("role") >= 2).over(of_sig).alias("_probe"), F.max(F.col("role") % 2).over(of_sig).alias("_index"),
    )
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")
    return materialize(met.where("_lo <> _hi and _probe and _index = 1").select("sig", "node", "role", "parts", part).distinct(), "candidates")


def _differing(x: str, y: str) -> Column:
    """Differing bits of two folded sketches."""
    return reduce(lambda p, q: p + q, (F.bit_count(F.col(f"{x}{k}").bitwiseXOR(F.col(f"{y}{k}"))) for k in FOLD))


def _centred(shared: DataFrame, table: DataFrame, percent: int) -> DataFrame:
    """sig, node, n, parts, part, folded sketch, centre (whether the row is one) and, for each near centre of its part, node and size."""
    of_part = Window.partitionBy("sig", "part")
    rows, far, centres, named = shared.join(table.select("node", "n", *FOLD), "node"), F.lit(True), F.lit(False), []
    for k in range(CENTRES):
        c = f"_c{k}."
        rows = rows.withColumn(f"_far{k}", far).withColumn(f"_c{k}", F.min(F.when(F.col(f"_far{k}") & (F.col("role") >= 2), F.struct("node", "n", *FOLD))).over(of_part))
        near = _similar_size(F.col("n"), F.col(f"{c}n"), percent) & _open(_differing("", c), F.col("n") + F.col(f"{c}n"), percent)
        own = F.col("node") == F.col(f"{c}node")
        far = F.col(f"_far{k}") & ~F.coalesce(near, F.lit(True))
        centres = centres | F.coalesce(own, F.lit(False))
        named += [F.when(near & ~own, F.struct(F.col(f"{c}node").alias("node"), F.col(f"{c}n").alias("n"))).alias(f"near{k}")]
    return materialize(rows.select("sig", "node", "n", "parts", "part", *FOLD, centres.alias("centre"), *named), "centred")


def _similar_size(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= percent * F.greatest(n, m)


def _open(differ: Column, both: Column, percent: int) -> Column:
    """Whether sets of ``both`` shingles together that differ in so many at least can be similar."""
    return differ * (100 + percent) <= (100 - percent) * both


def _across(met: DataFrame, percent: int) -> DataFrame:
    """Near pairs (a, b, na, nb) of a centre of a signature's first part and one of another part."""
    some = met.where("centre and parts > 1").select("sig", "part", "node", "n", *FOLD)
    x, y = some.where("part = 0").alias("x"), some.where("part > 0").alias("y")
    near = _similar_size(F.col("x.n"), F.col("y.n"), percent) & _open(_differing("x.", "y."), F.col("x.n") + F.col("y.n"), percent)
    met = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.node") != F.col("y.node")) & near)
    return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"))


def _sketched(pairs: DataFrame, table: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) that their full sketches leave room for."""
    left, right = (table.select(F.col("node").alias(k), F.col("sketch").alias(f"s{k}")) for k in "ab")
    m = F.least(F.size("sa"), F.size("sb"))

    def folded(x):
        whole = lambda _, i: F.aggregate(F.sequence(i, F.size(x) - 1, m), F.lit(0).cast("bigint"), lambda p, k: p.bitwiseXOR(F.get(x, k)))
        return F.when(F.size(x) == m, F.col(x)).otherwise(F.transform(F.slice(x, F.lit(1), m), whole))

    bits = F.aggregate(F.zip_with(folded("sa"), folded("sb"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    found = pairs.join(left, "a").join(right, "b").where(_open(bits, F.col("na") + F.col("nb"), percent))
    return materialize(found.select("a", "b", "na", "nb"), "pairs")


def _linked(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar, by the exact size of the intersection."""
    ends = pairs.select(F.col("a").alias("k")).union(pairs.select("b"))
    wanted_bits = docs.sparkSession.sparkContext.broadcast(bitmap(ends, "k"))

    def run(batches):
        wanted = wanted_bits.value
        for batch in batches:
            told: set[int] = set()
            for i, j, data, offsets in _text.slices(batch.column(0)):
                doc, code = sets(data, offsets, words)
                n, node = nodes(doc, code, j - i)
                keep = [k for k in np.flatnonzero((n > 0) & passes(wanted, node)).tolist() if not (node[k] in told or told.add(node[k]))]
                at = np.searchsorted(doc, np.arange(j - i + 1))
                lists = pa.array([code[at[k] : at[k + 1]].view(np.int64) for k in keep], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(node[keep].view(np.int64)), lists], ["node", "tokens"])

    # a table of its own, so that joins on a node with many pairs can be split
    found = materialize(docs.select("text").mapInArrow(run, "node bigint, tokens array<bigint>").dropDuplicates(["node"]), "tokens")
    left, right = found.withColumnsRenamed({"node": "a", "tokens": "ta"}), found.withColumnsRenamed({"node": "b", "tokens": "tb"})
    both = F.size(F.array_intersect("ta", "tb"))
    tested = pairs.join(left, "a").join(right, "b").where(both * 100 >= percent * (F.col("na") + F.col("nb") - both))
    links = materialize(tested.select("a", "b"), "links")
    drop(found)
    return links


def _mixed(met: DataFrame, labels: DataFrame, table: DataFrame) -> DataFrame:
    """sig, node, n, component, sketches and first signatures of members, the centres of whole groups aside, of groups in several components."""
    of_node = Window.partitionBy("node")
    rows = met.where("not centre or parts > 1").select("sig", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = materialize(rows, "placed")
    several = placed.groupBy("sig").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo <> _hi").select("sig")
    several = materialize(several, "several")  # a table, so that the join can split a large group
    rows = placed.join(several, "sig", "left_semi").withColumn("_place", F.row_number().over(of_node.orderBy("sig")))
    rows = rows.withColumn("sigs", F.collect_list(F.when(F.col("_place") <= LISTED, F.col("sig"))).over(of_node)).drop("_place")
    mixed = materialize(rows.join(table.select("node", "n", *FOLD, "large"), "node"), "mixed")
    drop(placed, several)
    return mixed


def _rest(mixed: DataFrame, percent: int) -> DataFrame:
    """Near pairs (a, b, na, nb) of members of one signature in different components."""
    x, y = mixed.alias("x"), mixed.alias("y")
    both = F.col("x.n") + F.col("y.n")
    apart = (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component"))
    # plain columns first: a condition with one column for each long would be too long a method for the JVM to compile
    more = F.aggregate(F.zip_with("x.large", "y.large", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, k: n + k)
    large = (F.least("x.n", "y.n") <= LARGE) | _open(more, both, percent)
    once = F.coalesce(F.array_min(F.array_intersect("x.sigs", "y.sigs")), F.col("x.sig")) == F.col("x.sig")
    near = _similar_size(F.col("x.n"), F.col("y.n"), percent) & _open(_differing("x.", "y."), both, percent)
    met = x.join(y, (F.col("x.sig") == F.col("y.sig")) & apart & near & once & large)
    return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).distinct()


def linked_nodes(docs: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """node, component of every node with a link. members: see _members."""
    spark = docs.sparkSession
    fold = [F.get("folded", F.lit(k)).alias(c) for k, c in enumerate(FOLD)]
    table = members.where("node is not null").select("node", F.col("n_shingles").alias("n"), "sketch", "folded", "large").dropDuplicates(["node"])
    table = materialize(table.select("node", "n", "sketch", "large", *fold), "nodes")
    shared = _shared(docs, words, percent)
    release(spark)
    met = _centred(shared, table, percent)
    drop(shared)
    release(spark)
    stars = reduce(DataFrame.union, (
        met.where(f"near{k} is not null").select(F.col(f"near{k}.node").alias("a"), F.col("node").alias("b"), F.col(f"near{k}.n").alias("na"), F.col("n").alias("nb"))
        for k in range(CENTRES)
    ), _across(met, percent))
    links = _linked(docs, _sketched(stars.distinct(), table, percent), words, percent)
    labels = connected_components(links)
    release(spark)
    mixed = _mixed(met, labels, table)
    drop(met, links)
    rest = _sketched(_rest(mixed, percent), table, percent)
    drop(mixed, table)
    if rest.isEmpty():
        return labels
    found = _linked(docs, rest, words, percent)
    again = connected_components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(found))
    drop(rest, found, labels)
    return again


def groups(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, text_hash, n_shingles, node, component, component_id of every row."""
    members = materialize(_members(docs, words), "members")
    labels = linked_nodes(docs, members, words, percent)
    rows = members.select("doc_id", "text_hash", "n_shingles", "node")
    # rows without a set stay out of the joins, and the least ids are a table, so that the join by component can be split
    placed = rows.where("node is not null").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = materialize(placed.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    alone = rows.where("node is null").select("*", F.col("node").alias("component"), F.col("doc_id").alias("component_id"))
    return placed.join(least, "component").select(*alone.columns).union(alone)


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group (smallest doc_id, then text hash), with all columns; rows with an empty set stay."""
    found = materialize(groups(docs, words, percent), "groups")
    best = found.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("_k"))
    one, d, x, h, rank = fresh(docs, "_one", "_d", "_x", "_h", "_rank")
    keep = best.select(F.col("_k.doc_id").alias(d), F.col("_k.text_hash").alias(x), F.lit(True).alias(one))
    alone = found.where("component is null").select("doc_id", "text_hash").distinct()
    keep = keep.union(alone.select(F.col("doc_id").alias(d), F.col("text_hash").alias(x), F.lit(False).alias(one)))
    rows = docs.withColumn(h, F.xxhash64("text")).join(keep, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(h) == F.col(x)))
    rows = rows.withColumn(rank, F.row_number().over(Window.partitionBy("doc_id", h).orderBy(h)))
    return rows.where(~F.col(one) | (F.col(rank) == 1)).select(*docs.columns)
