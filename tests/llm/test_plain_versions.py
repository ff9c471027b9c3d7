"""Operators against plain versions of their definitions: decontamination, placement on the ring, mixes, long lists of url rules."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from radspark.llm import _text, decontamination, mixing, sharding, urls

rng = random.Random(21)
WORDS = re.compile(_text.WORD)
VOCABULARY = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(3, 8))) for _ in range(500)]
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def described(text):
    """(small form, kind) of each word; kind: n, u, x (name) or None."""
    out, before = [], None
    for m in WORDS.finditer(text):
        w = m[0]
        for _ in range(4):
            if len(w) > 1 and w[0] in PUNCTUATION:
                w = w[1:]
            if len(w) > 1 and w[-1] in PUNCTUATION:
                w = w[:-1]
        small = lower(w)
        digits, letters = sum(c.isdigit() for c in w), sum(c.isalpha() for c in w)
        kind = None
        if digits and (not letters or w[0].isdigit() and letters <= 3) or small in decontamination.NUMBERS:
            kind = "n"
        elif small in decontamination.UNITS:
            kind = "u"
        elif before is not None and before[0][-1] not in ".!?:|" and "\n" not in text[before.end() : m.start()] and re.match("[A-Z][a-z]", w):
            kind = "x"
        out.append((small, kind))
        before = m
    return out


def windows(text, lengths):
    """(place, codes, slot values, free) of every window."""
    told = described(text)
    for n in lengths:
        need = min(5, n - 1) if n >= 4 else n
        for at in range(len(told) - n + 1):
            some = told[at : at + n]
            typed, named = sum(k in ("n", "u") for _, k in some), sum(k is not None for _, k in some)
            for kinds, ok, free in (("nux", n - named >= need, True), ("nu", n - typed >= need and named > typed, False), ("", n - typed < need, False)):
                if ok:
                    yield at, tuple((k,) if k and k in kinds else w for w, k in some), [w for w, k in some if k and k in kinds], free


def plain_hits(docs, items):
    items = {(i, t) for i, t in items if t is not None}
    short = {len(WORDS.findall(t)) for _, t in items if 0 < len(WORDS.findall(t)) < 8}
    known, most = defaultdict(list), {}
    for key in items:
        count = len(WORDS.findall(key[1]))
        places, frees = set(), set()
        for at, codes, values, free in windows(key[1], {8, *short}):
            if len(codes) in (8, count):
                known[codes].append((key, at, values, free))
                places.add(at)
                frees |= {at} if free else set()
        most[key] = len(places), len(frees)
    out = Counter()
    for doc, text in {(d, t) for d, t in docs if t is not None}:
        shifts = defaultdict(list)
        for at, codes, values, _ in windows(text, {8, *short}):
            for key, place, own, free in known.get(codes, ()):
                shifts[key, at - place].append((place, at, list(zip(own, values, strict=True)), free))
        found = defaultdict(list)
        for (key, _), part in shifts.items():
            pairs = {p for *_, ps, _ in part for p in ps}
            if len({a for a, _ in pairs}) == len(pairs):
                found[key].append((part, pairs))
        for key, parts in found.items():
            places = {p for part, _ in parts for p, *_ in part}
            frees = {p for part, _ in parts for p, *_, f in part if f}
            every, free = most[key]
            if len(places) >= min(3, every) or free and len(frees) >= min(3, free):
                same = all(a == b for _, pairs in parts for a, b in pairs)
                out[doc, key[0], "verbatim" if same else "template", len(places), max(len(p) for _, p in parts), min(at for part, _ in parts for _, at, *_ in part)] += 1
    return out


def sentence(n):
    """Words with numbers, units and names among them."""
    pick = lambda: rng.choice([rng.choice(VOCABULARY)] * 12 + [str(rng.randint(1, 99)), "kg", "seven", rng.choice(["Anna", "Berta", "Oslo"]), f"{rng.randint(2, 9)}cm"])
    return " ".join(pick() for _ in range(n))


def changed(text):
    """Other numbers and names, other case, other punctuation, a word less, or cut."""
    how = rng.randrange(7)
    if how == 0:
        return re.sub(r"\b\d+\b", lambda m: str(int(m[0]) + 5), text)
    if how == 1:
        return text.replace("Anna", "Clara").replace("Oslo", "Paris")
    if how == 2:
        return rng.choice([str.upper, str.lower, str.title])(text)
    if how == 3:
        return re.sub(r"\b\d+\b", lambda _: str(rng.randint(1, 99)), text)
    if how == 4:
        words = text.split(" ")
        del words[rng.randrange(len(words))]
        return " ".join(words)
    if how == 5:
        return " ".join(f"({w}," if i % 4 == 0 else w for i, w in enumerate(text.split(" ")))
    return text[: len(text) * 2 // 3]


def test_decontamination_matches_the_definition(spark):
    items = [(i, sentence(rng.choice([1, 2, 3, 5, 7, 8, 9, 14, 25, 40]))) for i in range(60)]
    items += [(3, sentence(20)), (None, sentence(15)), items[5], (70, None), (71, ""), (72, " \n")]
    docs = [(i, rng.choice([". ", "\n", " "]).join([sentence(rng.randint(0, 30)), rng.choice([str, changed])(rng.choice(items[:62])[1]), sentence(rng.randint(0, 30))])) for i in range(400)]
    docs += [(500 + i, sentence(60)) for i in range(60)] + [docs[3], (None, docs[4][1]), (901, None), (902, ""), (903, sentence(4000) + " " + items[-5][1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string").repartition(2)
    df = spark.createDataFrame([(*d, "c") for d in docs], "doc_id bigint, text string, h string").repartition(3)
    got = Counter(tuple(r) for r in decontamination.hits(df, bench).select("doc_id", "item_id", "kind", "n_windows", "n_slots", "first_word").collect())
    want = plain_hits(docs, items)
    assert got == want and len(want) > 150
    bad = {d for d, *_ in want}
    assert Counter(r.doc_id for r in decontamination.clean(df, bench).collect()) == Counter(d for d, _ in docs if d not in bad)
    assert decontamination.hits(df.limit(0), bench).count() == 0 and decontamination.hits(df, bench.limit(0)).count() == 0


@pytest.mark.parametrize("n_shards", [8, 9])
def test_every_row_takes_the_next_shard_with_room(spark, n_shards):
    """Row by row along the ring: the first virtual node at or after the row's cell whose shard isn't full."""
    rows = [(i, "x" * (i % 7)) for i in range(700)] + [(None, "a"), (None, "b"), (None, None), (5, "again"), (5, "again")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    text = F.coalesce("text", F.lit(""))
    keyed = df.select("doc_id", F.crc32(text).alias("c"), (F.octet_length(text) + 1).alias("n"), F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), text)).alias("h")).collect()
    nodes = sharding.ring(n_shards, 128, 14)
    room = [len(rows) // n_shards + (s < len(rows) % n_shards) for s in range(n_shards)]
    want, filled = Counter(), Counter()
    cell = lambda r: (r.h & (1 << 64) - 1) >> 50
    for r in sorted(keyed, key=lambda r: (cell(r), r.h, r.doc_id is not None, r.doc_id or 0, r.c, r.n)):
        after = [s for c, s in nodes if c >= cell(r)] + [s for _, s in nodes]
        shard = next(s for s in after if filled[s] < room[s])
        want[r.doc_id, r.c, r.n, shard, filled[shard], after[0]] += 1
        filled[shard] += 1
    got = sharding.shard(df, n_shards).collect()
    assert Counter((r.doc_id, r.text_crc32, r.size, r.shard, r.slot, r.home_shard) for r in got) == want


def test_texts_of_one_id_are_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HOT", 50)
    rows = [(i, "t") for i in range(300)] + [(7, f"text {i % 90}") for i in range(400)] + [(None, f"n {i % 3}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sharding.shard(df, 8, keep=("text",)).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sorted(map(str, got)) == sorted(map(str, sharding.shard(df.repartition(5), 8, keep=("text",)).collect()))


def test_few_rows_move(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    place = lambda d, n: sharding.shard(d, n).select("doc_id", F.col("shard").alias(f"s{n}"))
    moved = place(df, 8).join(place(df, 9), "doc_id").where("s8 <> s9").count()
    assert moved < 0.2 * 20_000  # an equal share of a ninth shard is 0.111
    more = spark.range(20_200).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    changed = place(df, 8).join(place(more, 8).withColumnRenamed("s8", "t8"), "doc_id").where("s8 <> t8").count()
    assert changed < 0.02 * 20_000


def test_long_lists_of_rules(spark, monkeypatch):
    """The join gives what the broadcast gives, for rules with ties, repeats, nulls and every digest equal."""
    names = ["".join(rng.choice("abc") for _ in range(2)) for _ in range(9)]
    host = lambda: ".".join(rng.choice(names) for _ in range(rng.randint(1, 3)))
    path = lambda: rng.choice(["", "/", "/a", "/a/", "/a/b", "/b"])
    rules = [(host(), path(), rng.choice(["allow", "block"]), i) for i in range(60)]
    told = spark.createDataFrame([*rules, (None, "/", "block", 90), ("aa", None, "block", 91)], "host string, path string, verdict string, rank int")
    pages = spark.createDataFrame([(i, f"http://{host()}{path()}{rng.choice(['', '?x', '/c'])}") for i in range(300)] + [(900, None), (901, "x"), (900, "http://aa/")], "page_id bigint, url string")
    want = Counter(tuple(r) for r in urls.judge(pages, [r[:3] for r in rules], "block").collect())
    few = told.where("host is not null and path is not null")
    assert Counter(tuple(r) for r in urls.judge(pages, few, "block").collect()) == want
    monkeypatch.setattr(urls, "MOST_BYTES", 10)
    for digest in (urls.digest, lambda key: 7):
        monkeypatch.setattr(urls, "digest", digest)
        assert Counter(tuple(r) for r in urls.judge(pages, told, "block").collect()) == want
    assert urls.judge(pages.limit(0), told).count() == 0
    with pytest.raises(ValueError):
        urls.judge(pages, [r[:3] for r in rules])


def test_a_mix_of_texts_of_one_id(spark):
    """A third of the rows has one id, a third none: budgets and order by the leading bits of both hashes hold all the same."""
    rows = [(i, f"w{i} " * (i % 5 + 1), "a") for i in range(300)] + [(7, f"v{i} x", "a") for i in range(300)] + [(None, f"u{i} x y", "b") for i in range(300)] + [(1, "q", "b")] * 9
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    code = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    key = lambda r: (code(f"mix{'' if r[0] is None else r[0]}") >> 51, code(r[1]) >> 55, code(f"mix{'' if r[0] is None else r[0]}"), code(r[1]))
    got = Counter((r.doc_id, r.text, r.taken) for r in mixing._placed(df, ("doc_id", "text"), 1.5, (5, 2, 1), 2.0, "mix").withColumnsRenamed({"_keep_doc_id": "doc_id", "_keep_text": "text"}).collect())
    target = {r.source: r.target for r in mixing.mix(df).collect()}
    want = Counter()
    for s, t in target.items():
        mine = sorted((r for r in rows if r[2] == s), key=key)
        sizes = [len(r[1].split()) for r in mine]
        budget = int(t + 1e-6)
        left = budget % sum(sizes)
        for r, n in zip(mine, sizes, strict=True):
            take = min(n, left)
            left -= take
            want[r[0], r[1], budget // sum(sizes) * n + take] += 1
    assert got == want
