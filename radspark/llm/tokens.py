"""Token counts of a byte-level BPE by overlap resynchronisation.

A stable boundary is a space that a character other than white space follows, or one of ``MARKS`` after a letter.  The
byte-level pre-tokenizer always starts a piece there, whatever stands before, and BPE merges only inside pieces, so the
tokens before and after such a boundary are those of the two sides encoded apart.

Huge texts (over ``HUGE`` bytes) are encoded in overlapping chunks with offsets.  Neighbouring chunks are spliced at the
last stable boundary of the first one, if both have a token start there; where they don't, the overlap widens.  Without
a boundary, or where the overlap has reached the last splice, the chunk doubles, so the time stays linear.  Other texts are cut
at all their spaces that are stable, and each distinct piece of a batch is encoded once (pieces meet by hash and are compared byte
for byte; a memory of bounded size carries over).

Null and empty texts have no tokens; repeated rows are counted one by one; texts of any length are counted whole; an empty
table gives an empty result; columns beside doc_id and text aren't read, whatever their names.  A special string inside a text is
handled as the library's default does.
"""

from __future__ import annotations

import os
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from radspark.llm import _text

HUGE = 1 << 16
CHUNK, OVERLAP = 1 << 14, 1 << 8
#: Pieces a worker remembers, of at most REMEMBERED bytes; it starts anew beyond.
MEMORY, REMEMBERED = 400_000, 64
#: Bytes that may follow the space of a stable boundary: no white space and no first byte of a white-space character.
FOLLOWS = np.ones(256, bool)
FOLLOWS[:0x21] = False
FOLLOWS[[0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = False
#: Marks that end a run of letters in texts without spaces.
MARKS = "。、，！？；："
_CANDIDATES = re.compile(f"[ {MARKS}]")


@cache
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def stable(text: str, at: int) -> bool:
    if text[at] != " ":
        return text[at] in MARKS and text[at - 1].isalpha()
    return at + 1 < len(text) and bool(FOLLOWS[text[at + 1].encode()[0]])


def last_stable(text: str, begin: int, end: int) -> int | None:
    places = [m.start() for m in _CANDIDATES.finditer(text, begin, max(begin, end))]
    return next((p for p in reversed(places) if stable(text, p)), None)


def spliced(text: str, encode, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text``. encode: gives the character offset of each token's start."""
    n, total, done, end = len(text), 0, 0, min(len(text), chunk)
    left = np.asarray(encode(text[:end]))
    while end < n:
        end2 = min(n, end + max(chunk, end - done))
        cut, wide = last_stable(text, done + 1, end - 1), overlap
        while True:
            begin2 = done if cut is None else max(done, cut - wide)
            right = np.asarray(encode(text[begin2:end2])) + begin2
            if begin2 == done or (np.any(left == cut) and np.any(right == cut)):
                break
            wide *= 4
        if cut is None or not (np.any(left == cut) and np.any(right == cut)):
            end, left = end2, right  # the whole of what is open is one chunk now
            continue
        total += int(np.count_nonzero((left >= done) & (left < cut)))
        done, end, left = cut, end2, right
    return total + int(np.count_nonzero(left >= done))


class Counter:
    def __init__(self, path: str):
        self.tokenizer, self.memory = load(path), {}

    def starts(self, text: str) -> list[int]:
        return [a for a, _ in self.tokenizer.encode(text, add_special_tokens=False).offsets]

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each row of a slice."""
        n = len(data)
        if not n:
            return np.zeros(len(offsets) - 1, np.int64)
        cut = np.zeros(n, bool)
        cut[:-1] = (data[:-1] == 0x20) & FOLLOWS[data[1:]]
        inner = offsets[1:-1]
        cut[inner[(inner > 0) & (inner < n)] - 1] = False  # what follows is another row
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        codes, first, inverse = np.unique(_text.span_hashes(data, start, end), return_index=True, return_inverse=True)
        other = np.flatnonzero(~_text.same_spans(data, start, end, start[first][inverse], end[first][inverse]))
        if len(self.memory) > MEMORY:
            self.memory.clear()
        raw = data.tobytes()
        shown = [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        counts = np.array([self.memory.get(x, -1) for x in shown], np.int64)
        new = np.flatnonzero(counts < 0)
        counts[new] = self.encoded([shown[k] for k in new])
        self.memory.update((shown[k], int(counts[k])) for k in new.tolist() if len(shown[k]) <= REMEMBERED)
        each = counts[inverse]
        each[other] = self.encoded([raw[start[k] : end[k]] for k in other])
        doc = np.searchsorted(offsets, start, "right") - 1
        return np.bincount(doc, each, len(offsets) - 1).astype(np.int64)

    def encoded(self, some: list[bytes]) -> list[int]:
        out: list[int] = []
        for at in range(0, len(some), 20_000):
            out += [len(e) for e in self.tokenizer.encode_batch_fast([x.decode() for x in some[at : at + 20_000]], add_special_tokens=False)]
        return out


_COUNTERS: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str, limit: int = 512, huge: int = HUGE) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row. path: the tokenizer's file, which all executors have."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        counter = _COUNTERS.setdefault(path, Counter(path))
        for batch in batches:
            sizes, tokens = [], []
            for _, _, data, offsets in _text.slices(batch.column(1)):
                size = np.diff(offsets)
                some = np.zeros(len(size), np.int64)
                big = np.flatnonzero(size > huge)
                keep = np.ones(len(data), bool)
                for k in big:
                    some[k] = spliced(data[offsets[k] : offsets[k + 1]].tobytes().decode(), counter.starts)
                    keep[offsets[k] : offsets[k + 1]] = False
                rest = size.copy()
                rest[big] = 0
                some += counter.pieces(data[keep] if len(big) else data, np.concatenate(([0], np.cumsum(rest))))
                sizes.append(size)
                tokens.append(some)
            size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            count = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(count, pa.int64()), pa.array(count > limit, pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
