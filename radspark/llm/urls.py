"""URL filter over a sorted digest array: memory-mapped 64-bit xxhash keys, vectorised binary search, stored full strings.

A rule is a host and a path prefix.  A url's candidate keys are its host's label suffixes combined with its path's prefixes of
the lengths that occur among rules; a batch of candidates is probed by one binary search, and a hit counts only if the stored
string is equal.  The longest rule (host and path together; then the later in the list) decides; other urls get ``default``.

Rules of at most ``MOST_BYTES`` (24 bytes and the string for each) go out as one broadcast, which each Python worker maps
from an unlinked file of its own, made anew wherever a worker starts.  More rules, given as a table, stay distributed: the
distinct hosts and paths give their candidate keys, these meet the rules in a sort-merge join on the digest, each task merging
its own part of the sorted digests, strings are compared, and the best rule of each host and path is joined back.

A null url or one without ``://`` has an empty host and path and fits no rule; repeated rows are judged one by one; urls of
any length are judged whole; an empty table gives an empty result, and without rules every url gets ``default``.  Columns beside
page_id and url aren't read, whatever their names.
"""

from __future__ import annotations

import tempfile
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 64 << 20
# Host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def _key(host: str, path: str) -> bytes:
    return f"{host}\0{path}".encode()


def digest(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key)


def pack(rules, digest=digest) -> bytes:
    """Count, sorted digests, rule numbers, string ends, strings."""
    keyed = sorted((digest(k := _key(h, p)), i, k) for i, (h, p, _) in enumerate(rules))
    return b"".join(
        (
            np.array([len(keyed)], np.int64).tobytes(),
            np.array([x[0] for x in keyed], np.uint64).tobytes(),
            np.array([x[1] for x in keyed], np.int64).tobytes(),
            np.cumsum([len(x[2]) for x in keyed], dtype=np.int64).tobytes(),
            b"".join(x[2] for x in keyed),
        )
    )


class Index:
    """Packed rules, mapped from an unlinked file."""

    def __init__(self, packed: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(packed)
            f.flush()
            whole = np.memmap(f, np.uint8, "r")
        n = int(whole[:8].view(np.int64)[0])
        self.digests = whole[8 : 8 + 8 * n].view(np.uint64)
        self.rules = whole[8 + 8 * n : 8 + 16 * n].view(np.int64)
        self.ends = whole[8 + 16 * n : 8 + 24 * n].view(np.int64)
        self.strings = whole[8 + 24 * n :]

    def probe(self, digests: np.ndarray, keys: list[bytes]) -> np.ndarray:
        """Number of the rule with each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        low, high = np.searchsorted(self.digests, digests, "left"), np.searchsorted(self.digests, digests, "right")
        for k in np.flatnonzero(low < high):
            for at in range(low[k], high[k]):
                if self.strings[self.ends[at - 1] if at else 0 : self.ends[at]].tobytes() == keys[k]:
                    out[k] = self.rules[at]
        return out


@lru_cache(maxsize=1)
def _index(packed: bytes) -> Index:
    return Index(packed)


def split(url: str | None) -> tuple[str, str]:
    """Host and path. Only A-Z of the host are folded."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return rest[:end].encode().lower().decode(), tail[:stop]


def candidates(host: str, path: str, lengths: list[int]) -> list[tuple[str, str]]:
    labels = host.split(".")
    return [(".".join(labels[i:]), path[:n]) for i in range(len(labels)) for n in lengths if n <= len(path)] if host else []


def _bytes(rules) -> int:
    return sum(len(_key(h, p)) + 24 for h, p, _ in rules)


def judge(pages: DataFrame, rules=RULES, default: str = "allow", digest=digest) -> DataFrame:
    """page_id, host, path, rule, verdict of every row. rules: (host, path, verdict) in order, or a table with these columns
    and ``rank`` (the order)."""
    if isinstance(rules, DataFrame):
        size = rules.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 25)).first()[0] or 0
        if size > MOST_BYTES:
            return _joined(pages, rules, default)
        rules = [tuple(r) for r in rules.orderBy("rank").select("host", "path", "verdict").collect()]
    elif _bytes(rules) > MOST_BYTES:
        raise ValueError(f"rules of more than {MOST_BYTES} bytes must come as a table")
    packed = pages.sparkSession.sparkContext.broadcast(pack(rules, digest))
    lengths = sorted({len(p) for _, p, _ in rules})
    names = [h + p for h, p, _ in rules]
    verdicts = [v for _, _, v in rules]
    order = [(len(n), i) for i, n in enumerate(names)]
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        index = _index(packed.value)
        for batch in batches:
            found = [split(u) for u in batch.column(1).to_pylist()]
            rows, keys = [], []
            for i, (host, path) in enumerate(found):
                for h, p in candidates(host, path, lengths):
                    rows.append(i)
                    keys.append(_key(h, p))
            hit = index.probe(np.fromiter(map(digest, keys), np.uint64, len(keys)), keys)
            best: dict[int, int] = {}
            for k in np.flatnonzero(hit >= 0):
                r = int(hit[k])
                if rows[k] not in best or order[r] > order[best[rows[k]]]:
                    best[rows[k]] = r
            chosen = [best.get(i) for i in range(len(found))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([h for h, _ in found], pa.string()),
                    pa.array([p for _, p in found], pa.string()),
                    pa.array([None if r is None else names[r] for r in chosen], pa.string()),
                    pa.array([default if r is None else verdicts[r] for r in chosen], pa.string()),
                ],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    return pages.select("page_id", "url").mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


def _joined(pages: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """``judge`` for a table of rules of any size. Only the distinct lengths of rule paths reach the driver."""
    lengths = sorted(r[0] for r in rules.where("path is not null").select(F.length("path")).distinct().collect())
    kind = pages.schema["page_id"].dataType.simpleString()

    def parts(batches):
        for batch in batches:
            found = [split(u) for u in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[k] for f in found], pa.string()) for k in (0, 1))], ["page_id", "host", "path"])

    def keys(batches):
        for batch in batches:
            told = [(h, p, a + chr(0) + b) for h, p in zip(*(c.to_pylist() for c in batch.columns), strict=True) for a, b in candidates(h, p, lengths)]
            digests = np.array([digest(k.encode()) for *_, k in told], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(pa.array([t[i] for t in told], pa.string()) for i in range(3)), pa.array(digests)], ["host", "path", "key", "digest"])

    def digests(batches):
        for batch in batches:
            told = [_key(h, p) for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([k.decode() for k in told], pa.string()), pa.array(np.array(list(map(digest, told)), np.uint64).view(np.int64))], ["rule_host", "rule_path", "verdict", "rank", "rule_key", "digest"])

    split_up = pages.select("page_id", "url").mapInArrow(parts, f"page_id {kind}, host string, path string")
    asked = split_up.select("host", "path").distinct().mapInArrow(keys, "host string, path string, key string, digest bigint")
    some = rules.where("host is not null and path is not null").select("host", "path", "verdict", F.col("rank").cast("long"))
    known = some.mapInArrow(digests, "rule_host string, rule_path string, verdict string, rank bigint, rule_key string, digest bigint")
    met = asked.hint("merge").join(known, "digest").where("key = rule_key")
    name = F.concat("rule_host", "rule_path")
    best = met.groupBy("host", "path").agg(F.max(F.struct(F.length(name).alias("n"), "rank", name.alias("rule"), "verdict")).alias("_b"))
    return split_up.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("_b.rule").alias("rule"), F.coalesce("_b.verdict", F.lit(default)).alias("verdict"))
