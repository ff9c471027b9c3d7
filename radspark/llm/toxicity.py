"""Toxicity from the nearest labelled examples by exact TF-IDF cosine over block-max inverted indexes.

Two indexes hold the same examples.  The first has every word of the examples (ASCII-folded, without outer punctuation), no
vocabulary rule, weights (1 + log tf) * idf, and gives the neighbours with a similarity of ``FAR`` or more.  The second has the words and prefixes (first four and five bytes) most associated
with either label (z of the difference of document shares, at least ``least_z``, ``max_terms`` of them): in long texts with a few
telling words these find the neighbours that matter.  Examples are ordered by their strongest term and cut into blocks; for each
term the index keeps its largest weight in each block.  A query visits only blocks whose upper bound, from these maxima, can
reach its k-th neighbour, so neighbours are exact (ties: the earlier example).

A vote is the share of toxic neighbours, weighted by 1 / (1.01 - similarity) in the first index and by similarity in the
second, where one pseudo-neighbour pulls it to 0.  The nearer the nearest example of the first index comes (from ``FAR`` on),
the more its vote counts; a copy of an example goes by that one alone.  A logistic map makes the vote a probability; it is
fitted on votes of each fifth of the examples from indexes, vocabularies and idf of the other four.  Evidence are the ids of
the nearest examples of the first index, then of the second.

Examples are at most ``max_rows`` labelled rows in hash order (bounded, and so is the index); all documents are scored,
whole.  A text without words of the examples (null and empty ones too) has no neighbours and the score of vote 0; repeated
rows are scored one by one; an empty table gives an empty result; without examples of both labels every score is their share.
Columns beside doc_id and text, and labels beside the one learnt, aren't read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radspark.llm import _text
from radspark.llm.classifier import examples, logistic

MAX_ROWS, MAX_TERMS, LEAST_Z, K, BLOCK = 6000, 4096, 6.0, 15, 64
#: Similarity from which the first index's vote begins to count, and folds of the calibration.
FAR, FOLDS = 0.5, 5
#: Words in more than one of COMMON examples are kept as dense columns.
COMMON = 32
_OUTER = np.zeros(256, bool)
_OUTER[[*b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, 64-bit term) of each word and then each prefix of a slice, and the number of words."""
    w = _text.Words(data, offsets, fold=True)
    s, e = w.start.copy(), w.end.copy()
    for _ in range(4):  # outer punctuation
        s += (s < e) & _OUTER[w.data[np.minimum(s, len(w.data) - 1)]]
        e -= (s < e) & _OUTER[w.data[np.maximum(e - 1, 0)]]
    ok = s < e
    s, e, doc = s[ok], e[ok], w.doc[ok]
    rows, codes = [doc], [w.span(s, e)]
    for n in (4, 5):
        long = e - s > n
        rows.append(doc[long])
        codes.append(_text.mix(w.span(s[long], s[long] + n) + np.uint64(n)))
    return np.concatenate(rows), np.concatenate(codes), len(s)


def counted(row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, code) with their number."""
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    at = np.flatnonzero(new)
    return row[at], code[at], np.diff(np.append(at, len(row)))


class BlockMax:
    """Exact top-k cosine over examples given as (sorted term numbers, unit weights)."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK):
        top = [int(t[np.argmax(w)]) if len(t) else n_terms for t, w in rows]
        self.order = np.array(sorted(range(len(rows)), key=lambda i: (top[i], i)), np.int64)  # place -> example
        self.n, self.block, self.blocks = len(rows), block, max(1, -(-len(rows) // block))
        term = np.concatenate([np.zeros(0, np.int64), *(rows[i][0] for i in self.order)])
        weight = np.concatenate([np.zeros(0), *(rows[i][1] for i in self.order)])
        place = np.repeat(np.arange(self.n), [len(rows[i][0]) for i in self.order]).astype(np.int64)
        by = np.lexsort((place, term))
        self.place, self.weight = place[by], weight[by]
        cell = term[by] * self.blocks + self.place // block
        self.start = np.searchsorted(cell, np.arange(n_terms * self.blocks + 1))
        self.most = np.zeros(n_terms * self.blocks)
        np.maximum.at(self.most, cell, self.weight)
        self.most = self.most.reshape(n_terms, self.blocks)
        self.visited = 0

    def top(self, term: np.ndarray, weight: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, similarities) of the k nearest with a similarity over 0, nearest first."""
        bound = weight @ self.most[term]
        ids, sims, kth = np.zeros(0, np.int64), np.zeros(0), 0.0
        queue = np.flatnonzero(bound > 0)
        queue = queue[np.argsort(-bound[queue], kind="stable")]
        for at in range(0, len(queue), 8):
            group = queue[at : at + 8]
            if len(ids) >= k and bound[group[0]] < kth - 1e-12:
                break
            self.visited += len(group)
            first, last = self.start[term[:, None] * self.blocks + group], self.start[term[:, None] * self.blocks + group + 1]
            size = (last - first).ravel()
            total = int(size.sum())
            post = np.repeat(first.ravel() - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(total)
            gain = np.repeat(np.repeat(weight, len(group)), size) * self.weight[post]
            places, inverse = np.unique(self.place[post], return_inverse=True)
            s = np.bincount(inverse, gain, len(places))
            e = self.order[places]
            ok = e != without
            ids, sims = np.concatenate((ids, e[ok])), np.concatenate((sims, s[ok]))
            best = np.lexsort((ids, -np.round(sims, 12)))[:k]
            ids, sims = ids[best], sims[best]
            kth = sims[-1] if len(sims) >= k else 0.0
        return ids, sims


class AllWords:
    """Exact top-k cosine over all words of the examples: dense columns for common words, postings for the others."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK):
        """rows: sorted term numbers and weights of unit length of each example."""
        top = [int(t[np.argmax(w)]) if len(t) else n_terms for t, w in rows]
        self.order = np.array(sorted(range(len(rows)), key=lambda i: (top[i], i)), np.int64)  # place -> example
        self.n, self.block, self.blocks = len(rows), block, max(1, -(-len(rows) // block))
        place = np.repeat(np.arange(self.n, dtype=np.int32), [len(rows[i][0]) for i in self.order])
        term = np.concatenate([np.zeros(0, np.int32), *(rows[i][0] for i in self.order)]).astype(np.int32)
        weight = np.concatenate([np.zeros(0, np.float32), *(rows[i][1] for i in self.order)]).astype(np.float32)
        df = np.bincount(term, minlength=n_terms)
        self.column = np.full(n_terms, -1, np.int32)
        common = np.flatnonzero(df * COMMON > self.n)
        self.column[common] = np.arange(len(common))
        many = self.column[term] >= 0
        self.dense = np.zeros((self.blocks * block, len(common)), np.float32)
        self.dense[place[many], self.column[term[many]]] = weight[many]
        self.most = self.dense.reshape(self.blocks, block, len(common)).max(1)
        rare = np.flatnonzero(~many)
        by = rare[np.argsort(term[rare], kind="stable")]  # places rise within a term
        self.place, self.weight = place[by], weight[by]
        self.start = np.concatenate(([0], np.cumsum(np.where(self.column < 0, df, 0))))
        self.visited = 0

    def top(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, least: float = 0.0) -> list[tuple[np.ndarray, np.ndarray]]:
        """(examples, similarities) of the k nearest of each query with a similarity over 0 and of ``least`` or more, nearest first."""
        out = []
        for at in range(0, len(queries), 256):
            out += self._some(queries[at : at + 256], k, least)
        return out

    def _some(self, queries, k: int, least: float):
        m, width = len(queries), self.blocks * self.block
        row = np.repeat(np.arange(m), [len(t) for t, _ in queries])
        term = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in queries)])
        weight = np.concatenate([np.zeros(0), *(w for _, w in queries)]).astype(np.float32)
        many = self.column[term] >= 0
        common = np.zeros((m, self.dense.shape[1]), np.float32)
        common[row[many], self.column[term[many]]] = weight[many]
        row, term, weight = row[~many], term[~many], weight[~many]
        first, size = self.start[term], self.start[term + 1] - self.start[term]
        post = np.repeat(first - np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else first, size) + np.arange(int(size.sum()))
        # a posting gives its exact part; a block's bound adds what its common words can give at most
        score = np.bincount(np.repeat(row, size) * width + self.place[post], np.repeat(weight, size) * self.weight[post], m * width).reshape(m, width).astype(np.float32)
        bound = score.reshape(m, self.blocks, self.block).max(2) + common @ self.most.T
        queue = np.argsort(-bound, 1, kind="stable")
        done = np.zeros((m, self.blocks), bool)
        kth = np.full(m, least, np.float32)
        for step in range(self.blocks):
            block = queue[:, step]
            need = bound[np.arange(m), block] >= np.maximum(kth - 1e-6, 1e-12)
            if not need.any():
                break
            for b in np.unique(block[need]):
                rows = np.flatnonzero(need & (block == b))
                part = slice(b * self.block, (b + 1) * self.block)
                score[rows, part] += common[rows] @ self.dense[part].T
                done[rows, b] = True
                self.visited += len(rows)
            if step % 8 == 7 and self.n > k:
                rows = np.flatnonzero(need)  # the others are done
                seen = np.where(np.repeat(done[rows], self.block, 1), score[rows], 0)
                kth[rows] = np.maximum(least, np.partition(seen, width - k, 1)[:, width - k])
        found = [(np.zeros(0, np.int64), np.zeros(0))] * m
        for i in np.flatnonzero(done.any(1)).tolist():
            blocks = np.flatnonzero(done[i])
            places = (blocks[:, None] * self.block + np.arange(self.block)).ravel()
            s = score[i, places].astype(float)
            near = np.flatnonzero((s > 0) & (np.round(s, 6) >= least))
            e, s = self.order[places[near]], s[near]
            best = np.lexsort((e, -np.round(s, 6)))[:k]
            found[i] = e[best], s[best]
        return found


def vote(sims: np.ndarray, y: np.ndarray) -> float:
    return float((sims * y).sum() / (sims.sum() + 0.05)) if len(sims) else 0.0


def joint(all_words: tuple[np.ndarray, np.ndarray], tied: tuple[np.ndarray, np.ndarray], y: np.ndarray) -> tuple[float, list[int]]:
    """The vote of a query's neighbours (examples, similarities) in both indexes, and the examples that are its evidence."""
    (e, s), (f, t) = all_words, tied
    share, other = 0.0, vote(t, y[f])
    if len(e):
        share = min(1.0, max(0.0, (s[0] - FAR) / (1 - FAR)))
        near = 1 / (1.01 - np.minimum(s, 1.0))
        other = share * float((near * y[e]).sum() / near.sum()) + (1 - share) * other
    return other, list(dict.fromkeys([*e.tolist(), *f.tolist()]))[:3]


def vectors(row: np.ndarray, term: np.ndarray, tf: np.ndarray, idf: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Terms and weights, (1 + log tf) * idf brought to unit length, of each of n rows; entries come by row."""
    at = np.searchsorted(row, np.arange(n + 1))
    weight = (1 + np.log(tf)) * idf[term]
    length = np.sqrt(np.bincount(row, weight * weight, n))
    weight = weight / length[row]
    return [(term[a:b], weight[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def fit(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_terms: int, least_z: float, k: int) -> dict:
    def take(batches):
        for batch in batches:
            out = []
            for i, j, data, offsets in _text.slices(batch.column(2)):
                row, code, words = terms(data, offsets)
                for a, b in ((0, words), (words, len(row))):
                    r, c, tf = counted(row[a:b], code[a:b])
                    at = np.searchsorted(r, np.arange(j - i + 1))
                    out.append([(c[p:q].tobytes(), tf[p:q].astype(np.int32).tobytes()) for p, q in zip(at[:-1], at[1:], strict=True)])
            words, prefixes = [x for part in out[::2] for x in part], [x for part in out[1::2] for x in part]
            arrays = [batch.column(0), batch.column(1), *(pa.array([x[m] for x in some], pa.binary()) for some in (words, prefixes) for m in (0, 1))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "y", "x", "tf", "px", "ptf"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = examples(docs, labels, label, max_rows).mapInArrow(take, f"doc_id {kind}, y int, x binary, tf binary, px binary, ptf binary").collect()
    got.sort(key=lambda g: (g["doc_id"], bytes(g["x"])))
    y, ids = np.array([g["y"] for g in got], np.int64), [g["doc_id"] for g in got]
    words = Terms([np.frombuffer(g["x"], np.uint64) for g in got], [np.frombuffer(g["tf"], np.int32) for g in got])
    prefixes = Terms([np.frombuffer(g["px"], np.uint64) for g in got], [np.frombuffer(g["ptf"], np.int32) for g in got])
    del got
    return index(ids, y, words, prefixes, max_terms, least_z, k)


class Terms:
    """Terms of rows: codes in order, and number and count of each row's terms."""

    def __init__(self, codes: list[np.ndarray], counts: list[np.ndarray]):
        self.at = np.cumsum([0, *map(len, codes)])
        self.codes, number = np.unique(np.concatenate([np.zeros(0, np.uint64), *codes]), return_inverse=True)
        self.number, self.count = number.astype(np.int32), np.concatenate([np.zeros(0, np.int32), *counts])

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place among ``rows``, number, count) of the terms of some rows."""
        size = self.at[rows + 1] - self.at[rows]
        entry = np.repeat(self.at[rows] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        return np.repeat(np.arange(len(rows), dtype=np.int32), size), self.number[entry], self.count[entry]


class Indexes:
    """Both indexes of some rows."""

    def __init__(self, y: np.ndarray, rows: np.ndarray, words: Terms, prefixes: Terms, max_terms: int, least_z: float):
        self.y, n = y[rows], len(rows)
        n1 = int((self.y > 0).sum())
        row, number, count = words.of(rows)
        df = np.bincount(number, minlength=len(words.codes))
        self.idf = np.where(df > 0, np.log((n + 1) / (df + 1)) + 1, 0)
        self.every = AllWords(vectors(row, number, count, self.idf, n), len(words.codes))
        told = []  # (z, df, kind, number) of the terms of both kinds
        for kind, some in enumerate((words, prefixes)):
            row, number, _ = some.of(rows)
            df = np.bincount(number, minlength=len(some.codes))
            df1 = np.bincount(number[self.y[row] > 0], minlength=len(some.codes))
            share = df / n
            z = np.abs((df1 / n1 - (df - df1) / (n - n1)) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / (n - n1)) + 1e-12))
            good = np.flatnonzero((z >= least_z) & (df >= 2))
            told += zip((-z[good]).tolist(), some.codes[good].tolist(), df[good].tolist(), [kind] * len(good), good.tolist(), strict=True)
        told = sorted(sorted(told)[:max_terms], key=lambda t: t[1])
        self.vocabulary = np.array([t[1] for t in told], np.uint64)
        self.tied_idf = np.log((n + 1) / (np.array([t[2] for t in told]) + 1)) + 1
        self.place = [np.full(len(some.codes), -1, np.int32) for some in (words, prefixes)]
        for i, (*_, kind, number) in enumerate(told):
            self.place[kind][number] = i
        self.blocks = BlockMax(self.tied(rows, words, prefixes), len(told))

    def all_words(self, rows: np.ndarray, words: Terms) -> list[tuple[np.ndarray, np.ndarray]]:
        """Vectors of some rows, without the words that no row of the index has."""
        row, number, count = words.of(rows)
        keep = self.idf[number] > 0
        return vectors(row[keep], number[keep], count[keep], self.idf, len(rows))

    def tied(self, rows: np.ndarray, words: Terms, prefixes: Terms) -> list[tuple[np.ndarray, np.ndarray]]:
        parts = []
        for place, some in zip(self.place, (words, prefixes), strict=True):
            row, number, count = some.of(rows)
            keep = place[number] >= 0
            parts.append((row[keep], place[number[keep]], count[keep]))
        row, term, count = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.lexsort((term, row))
        return vectors(row[order], term[order], count[order], self.tied_idf, len(rows))

    def model(self, words: Terms) -> dict:
        return {"words": words.codes, "idf": self.idf, "all": self.every, "vocabulary": self.vocabulary, "tied_idf": self.tied_idf, "blocks": self.blocks, "y": self.y}


def _known(row: np.ndarray, code: np.ndarray, vocabulary: np.ndarray, idf: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Unit vectors over the vocabulary of rows with a code for each occurrence of a term."""
    if not len(vocabulary):
        return [(np.zeros(0, np.int64), np.zeros(0))] * n
    at = np.searchsorted(vocabulary, code)
    at[at == len(vocabulary)] = 0
    hit = vocabulary[at] == code
    return vectors(*counted(row[hit], at[hit]), idf, n)


def _votes(m: dict, words: list, tied: list, k: int, seen: dict | None = None) -> list[tuple[float, list[int]]]:
    """Vote and evidence of each query, given its vectors for both indexes."""
    none = (np.zeros(0, np.int64), np.zeros(0))
    out = []
    for one, (t, w) in zip(m["all"].top(words, k, FAR), tied, strict=True):
        key = (t.tobytes(), w.tobytes())
        found = seen.get(key) if seen is not None else None
        if found is None:
            found = m["blocks"].top(t, w, k) if len(t) else none
            if seen is not None:
                if len(seen) > 20_000:
                    seen.clear()
                seen[key] = found
        out.append(joint(one, found, m["y"]))
    return out


def index(ids: list, y: np.ndarray, words: Terms, prefixes: Terms, max_terms: int = MAX_TERMS, least_z: float = LEAST_Z, k: int = K) -> dict:
    n, n1 = len(y), int((y > 0).sum())
    if not n or n1 in (0, n):
        p = n1 / n if n else 0.0
        return {"words": np.zeros(0, np.uint64), "idf": np.zeros(0), "all": None, "a": 0.0, "b": float(np.log((p + 1e-9) / (1 - p + 1e-9))), "ids": ids, "y": y}
    votes, fold = np.zeros(n), np.arange(n) % FOLDS
    for f in range(FOLDS):
        mine, other = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        if len(other) and y[mine].min() != y[mine].max():
            part = Indexes(y, mine, words, prefixes, max_terms, least_z)
            votes[other] = [v for v, _ in _votes(part.model(words), part.all_words(other, words), part.tied(other, words, prefixes), k)]
            del part
    a, b = logistic(votes, y)
    return Indexes(y, np.arange(n), words, prefixes, max_terms, least_z).model(words) | {"a": a, "b": b, "ids": ids, "k": k, "votes": votes}


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5, max_rows: int = MAX_ROWS, max_terms: int = MAX_TERMS, least_z: float = LEAST_Z, k: int = K) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (ids of the three nearest examples) of every row."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label, max_rows, max_terms, least_z, k))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        m, seen = model.value, {}
        for batch in batches:
            votes, evidence = [], []
            for i, j, data, offsets in _text.slices(batch.column(1)):
                if m["all"] is None:
                    votes += [0.0] * (j - i)
                    evidence += [[]] * (j - i)
                    continue
                row, code, words = terms(data, offsets)
                for v, e in _votes(m, _known(row[:words], code[:words], m["words"], m["idf"], j - i), _known(row, code, m["vocabulary"], m["tied_idf"], j - i), m["k"], seen):
                    votes.append(v)
                    evidence.append([m["ids"][x] for x in e])
            s = 1 / (1 + np.exp(-np.clip(m["a"] * np.array(votes) + m["b"], -500, 500)))
            arrays = [batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32()), pa.array(evidence, pa.list_(batch.column(0).type))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "score", "predicted", "evidence"])

    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int, evidence array<{kind}>")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", "predicted", "evidence")
