"""The whole pipeline against a plain version over planted documents."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from radspark.llm import _text

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside, and a result's name.
CLASHING = ", _h string, _d string, _x string, _one string, _rank string, _score string, _predicted string, size string, Shard string"
rng = random.Random(11)
WORDS = re.compile(_text.WORD)
VOCABULARY = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 8))) for _ in range(600)]
ITEM = "the mean weight of 12 kg parcels that Anna sent by rail from Oslo within 30 days was seven units and Anna paid for all of them"


def prose(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def changed(text, k):
    words = text.split(" ")
    for at in rng.sample(range(len(words)), k):
        words[at] = "x" + words[at]
    return " ".join(words)


def planted():
    """(doc_id, text, source), junk ids, leaking ids."""
    texts, junk, leaks = [], set(), set()
    for i in range(150):
        texts.append(prose(rng.randint(40, 120)))
        if i % 3 == 0:
            junk.add(len(texts) - 1)
            texts[-1] += " ###$$$ %%%&&& ***!!! ###$$$ " + prose(5)
        elif i % 5 == 0:
            texts += [texts[-1], changed(texts[-1], 1), changed(texts[-1], 20)]
        elif i % 7 == 0:
            leaks.add(len(texts) - 1)
            texts[-1] += ". " + (ITEM if i % 2 else ITEM.replace("12", "15").replace("Anna", "Berta")) + " " + prose(8)
    return [(i, t, [None, "b", "a", "ä"][i % 4]) for i, t in enumerate(texts)], junk, leaks


def shingles(text):
    w = WORDS.findall(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def md5(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def plain(rows, junk, leaks):
    """(doc_id, source, text) of the mixture."""
    left = [r for r in rows if r[0] not in junk]
    sets = [shingles(r[1]) for r in left]
    first = list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = first[i], first[j]
                first = [min(old, new) if x in (old, new) else x for x in first]
    left = [r for i, r in enumerate(left) if first[i] == i and r[0] not in leaks]
    by = defaultdict(list)
    for r in left:
        by[r[2]].append(r)
    sizes = {s: sum(len(WORDS.findall(r[1])) for r in by[s]) for s in by}
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    weight, pot, capped = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in capped]
        share = pot - sum(2 * sizes[s] for s in capped)
        target = {s: 2.0 * sizes[s] if s in capped else share * weight[s] / sum(weight[x] for x in rest) for s in names}
        over = {s for s in rest if target[s] > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    out = Counter()
    for s in names:
        budget = int(target[s] + 1e-6)
        while budget:
            for r in sorted(by[s], key=lambda r: (md5(f"mix{r[0]}") >> 51, md5(r[1]) >> 55, md5(f"mix{r[0]}"), md5(r[1]))):
                n = min(budget, len(WORDS.findall(r[1])))
                if n:
                    out[r[0], s, r[1][: list(WORDS.finditer(r[1]))[n - 1].end()] if n < len(WORDS.findall(r[1])) else r[1]] += 1
                budget -= n
    return out


def tables(spark, folder, rows, junk, more=""):
    docs = [(i, t, "en", s, len(t), *("c" for _ in more.split(",")[1:])) for i, t, s in rows]
    spark.createDataFrame(docs, SCHEMA + more).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i not in junk), 0) for i, _, _ in rows]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, prose(30)), (3, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.mark.parametrize("more", ["", CLASHING])
def test_pipeline_matches_plain(spark, tmp_path, more):
    rows, junk, leaks = planted()
    got = corpus_pipeline.run(spark, tables(spark, tmp_path, rows, junk, more))
    got.write.parquet(f"{tmp_path}/out")
    found = spark.read.parquet(f"{tmp_path}/out").collect()
    want = plain(rows, junk, leaks)
    assert Counter((r.doc_id, r.source, r.text) for r in found) == want
    assert all(r.text_crc32 == zlib.crc32(r.text.encode()) and r.n_chars == len(r.text) for r in found)
    n = Counter(r.shard for r in found)
    assert set(n) == set(range(8)) and max(n.values()) - min(n.values()) <= 1
    assert all(sorted(r.slot for r in found if r.shard == s) == list(range(n[s])) for s in n)


def test_stages_keep_the_columns(spark, tmp_path):
    rows, junk, _ = planted()
    folder = tables(spark, tmp_path, [*rows[:60], (900, "", "a"), (901, prose(9_000), None)], junk, CLASHING)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.dtypes == docs.dtypes
        assert {tuple(r) for r in out.select("_h", "_d", "_x", "_one", "_rank", "_score", "_predicted", "size", "Shard").collect()} == {("c",) * 9}


def test_pipeline_of_nothing(spark, tmp_path):
    tables(spark, tmp_path, [], set())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
