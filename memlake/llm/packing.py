"""Packing token pieces into sequences by best two fit.

Documents become token ids and an end id; only ones longer than a sequence are cut. Packing sees
lengths alone: a table of how many pieces have each length, with at most as many rows as a
sequence has tokens, is all that meets on the driver. A bin is filled greedily with the longest
piece that fits; then its smallest piece makes way for two unpacked ones if they fit the gap more
tightly. The same bin is repeated while its lengths last. Pieces of a length are numbered in Spark
and the number says which bin and place is theirs.

Defined results: null and empty text are the end id alone; repeated rows are packed each for
itself; an empty table gives no rows; the work is linear in a text.
"""

import functools
import os
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from memlake.llm import rows
from memlake.sources.scratch import cut

SEQUENCE, END = 4096, 1
#: Pieces per group in which pieces of a length are numbered, about.
GROUP = 8192
#: Characters encoded at a time; a longer text is encoded alone.
TOGETHER = 1 << 20
#: New words in one call of the tokenizer, whose results take far more room than the ids.
CALL = 8192


class WordIds:
    """Token ids of whole texts for a tokenizer that never joins characters over white space.

    Each different word is encoded once. A word of letters with one full stop or comma behind it
    is two pre-tokens, so its letters are shared with the bare word's; lower-case letters need
    neither the tokenizer's normaliser nor its pattern. Between calls at most `most` words are
    kept, those used most; a word takes about 170 bytes.
    """

    #: White space to str.split() but not to the tokenizer.
    ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
    MARKS = {".": 1, ",": 2}

    def __init__(self, path: str, most: int = 250_000):
        self.tokenizer, self.plain, self.last = tokenizers(path)
        marks = self._encode(self.tokenizer, list(self.MARKS))
        self.mark_ids = np.array([0, *(int(m[0]) for m in marks)], np.uint32)
        self.most = most
        self._clear()

    def _clear(self):
        # a word is a range of flat and a mark; its stem is kept as a word too
        self.known, self.used = {}, 0
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.mark, self.uses = np.zeros(1 << 16, np.int8), np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.uint32)

    def _shrink(self) -> None:
        """Forget all but the most used words, half as many as may be kept; their uses count half."""
        uses, words = self.uses[:len(self.known)], list(self.known)
        kept = np.sort(np.argsort(-uses, kind="stable")[:self.most // 2])
        start, length, mark, flat = self.start[kept], self.length[kept], self.mark[kept], self.flat
        self._clear()
        ends = np.cumsum(length)
        at = np.repeat(start - (ends - length), length) + np.arange(int(ends[-1]))
        self._store([words[i] for i in kept], flat[at], length, mark)
        self.uses[:len(kept)] = uses[kept] // 2

    def _name(self, words: list[str], start, length, mark) -> None:
        """Words as a range of flat and a mark each."""
        n, k = len(self.known), len(words)
        self.start, self.length, self.mark, self.uses = (
            self._room(v, n + k) for v in (self.start, self.length, self.mark, self.uses))
        self.start[n:n + k], self.length[n:n + k], self.mark[n:n + k], self.uses[n:n + k] = start, length, mark, 0
        self.known.update(zip(words, range(n, n + k)))

    @staticmethod
    def _encode(tokenizer, words: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    @staticmethod
    def _room(values: np.ndarray, n: int) -> np.ndarray:
        return values if n <= len(values) else np.resize(values, max(n, 2 * len(values)))

    def _store(self, words: list[str], ids: np.ndarray, lengths: np.ndarray, mark=0) -> None:
        """Keep the ids of words, which lie one behind another."""
        self.flat = self._room(self.flat, self.used + len(ids))
        self.flat[self.used:self.used + len(ids)] = ids
        self._name(words, self.used + np.cumsum(lengths) - lengths, lengths, mark)
        self.used += len(ids)

    def _store_each(self, words: list[str]) -> None:
        for at in range(0, len(words), CALL):
            found = self._encode(self.tokenizer, part := words[at:at + CALL])
            self._store(part, np.array([i for f in found for i in f], np.uint32), np.array([len(f) for f in found], np.int64))

    def _store_letters(self, words: list[str], together: int = 256) -> None:
        """Many words of letters in one text; the ids themselves say where a word ends."""
        for first in range(0, len(words), CALL):
            groups = [words[i:i + together] for i in range(first, min(first + CALL, len(words)), together)]
            for group, found in zip(groups, self._encode(self.plain, [" ".join(g) for g in groups])):
                ids = np.array(found, np.uint32)
                ends = np.flatnonzero(self.last[ids]) + 1
                if len(ends) == len(group):
                    self._store(group, ids, np.diff(ends, prepend=0))
                else:
                    self._store_each(group)

    def _add(self, words: list[str]) -> None:
        letters, others, forms, stems, marks = set(), set(), [], [], []
        for w in words:
            stem, mark = (w[:-1], self.MARKS[w[-1]]) if w[-1] in self.MARKS and len(w) > 1 else (w, 0)
            low = stem.lower()
            # the lower case of a sigma depends on its place
            if stem.isalpha() and low.isalpha() and "\u03a3" not in stem and (
                    low.isascii() or low == low.lower() and unicodedata.is_normalized("NFC", low)):
                if low not in self.known:
                    letters.add(low)
                if low != w:
                    forms.append(w)
                    stems.append(low)
                    marks.append(mark)
            else:
                others.add(w)
        if letters:
            self._store_letters(list(letters))
        if others:
            self._store_each(list(others))
        code = np.fromiter(map(self.known.__getitem__, stems), np.int64, len(stems))
        self._name(forms, self.start[code], self.length[code], marks)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        split = [None if any(c in t for c in self.ODD) else t.split() for t in texts]
        words = [w for s in split if s for w in s]
        new = set(words).difference(self.known)
        if new:
            self._add(list(new))
        code = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        self.uses[:len(self.known)] += np.bincount(code, minlength=len(self.known))
        mark = self.mark[code]
        n = self.length[code] + (mark > 0)
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        # where a mark belongs this reads one id beyond the stem's, then overwritten
        at = np.repeat(self.start[code] - (ends - n), n) + np.arange(total)
        ids = self.flat[np.minimum(at, len(self.flat) - 1)]
        ids[ends[mark > 0] - 1] = self.mark_ids[mark[mark > 0]]
        after = np.concatenate(([0], ends))
        out, at = [], 0
        for t, s in zip(texts, split):
            if s is None:
                out += [np.array(i, np.uint32) for i in self._encode(self.tokenizer, [t])]
                continue
            out.append(ids[after[at]:after[at + len(s)]])
            at += len(s)
        if len(self.known) > self.most:
            self._shrink()
        return out


@functools.cache
def tokenizers(path: str):
    """The tokenizer, one for white-space runs of plain letters, and which ids end a word."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    whole = Tokenizer.from_file(path)
    plain = Tokenizer(whole.model)  # one vocabulary in memory for both
    plain.add_special_tokens(list(whole.get_added_tokens_decoder().values()))
    plain.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    vocab = whole.get_vocab()
    last = np.zeros(max(vocab.values()) + 1, bool)
    last[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
    return whole, plain, last


@functools.cache
def word_ids(path: str) -> WordIds:
    """One per Python worker, so that its tasks share the bounded number of words it keeps."""
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids, cut where they exceed a sequence."""

    def make():
        words = word_ids(tokenizer_path)

        def work(cols):
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            texts, size, cuts = rows.texts(cols["text"]), 0, [0]
            for i, t in enumerate(texts):
                size += len(t)
                if size > TOGETHER:
                    cuts, size = [*cuts, i + 1], 0
            encoded = (ids for a, b in zip(cuts, [*cuts[1:], len(texts)]) for ids in words.encode(texts[a:b]))
            for doc_id, ids in zip(cols["doc_id"].to_pylist(), encoded):
                data = np.append(ids, np.uint32(end)).astype("<u4")
                for k in range(-(-len(data) // sequence)):
                    part = data[k * sequence:(k + 1) * sequence]
                    for name, v in zip(out, (doc_id, k, k * sequence, len(part), zlib.crc32(part.tobytes()))):
                        out[name].append(v)
            return out

        return work

    return rows.map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"),
                            "doc_id long, piece int, start long, length long, ids_crc32 long", make)


def best_two_fit(counts: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[list[int], int]]:
    """Bins as (lengths in a bin, how many such bins) for so many pieces of each length."""
    left = np.zeros(sequence + 1, np.int64)
    for n, k in counts.items():
        left[n] += k
    size = np.arange(sequence + 1)
    out = []
    while left.any():
        here, gap, rest = [], sequence, left.copy()
        while True:
            fits = np.flatnonzero(rest[:gap + 1])
            if not len(fits):
                break
            n = int(fits[-1])
            k = int(min(rest[n], gap // n))
            here += [n] * k
            rest[n] -= k
            gap -= n * k
        if gap and len(here) > 1:
            room = gap + here[-1]
            floor = np.maximum.accumulate(np.where(rest > 0, size, 0))  # longest left of at most so many
            a = np.flatnonzero(rest[:room])
            b = floor[np.minimum(room - a, a)]
            lone = (b == a) & (rest[a] < 2)
            b[lone] = floor[a[lone] - 1]
            both = np.where(b > 0, a + b, 0)
            best = int(both.argmax()) if len(both) else -1
            if best >= 0 and both[best] > here[-1]:
                here[-1:] = [int(a[best]), int(b[best])]
        need = np.bincount(here, minlength=sequence + 1)
        times = int((left[need > 0] // need[need > 0]).min())
        left -= need * times
        out.append((here, times))
    return out


def places(bins: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """For each length, from which number on its pieces lie in which bins, and where in them."""
    rows_, first, given = [], 0, {}
    for lengths, times in bins:
        offset, at = 0, 0
        while at < len(lengths):
            n, k = lengths[at], 1
            while at + k < len(lengths) and lengths[at + k] == n:
                k += 1
            rows_.append((n, given.get(n, 0), first, times, offset))
            given[n] = given.get(n, 0) + k * times
            offset, at = offset + n * k, at + k
        first += times
    rows_.sort()
    return dict(zip(("length", "number", "first", "times", "offset"),
                    np.array(rows_, np.int64).reshape(-1, 5).T))


def numbered(made: DataFrame) -> DataFrame:
    """Pieces with a number among those of their length, from 0. A length that many pieces share
    is numbered in groups by hash, on top of the counts of the groups before."""
    groups = max(1, made.count() // GROUP)
    made = made.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    nth = made.withColumn("number", F.row_number().over(inside) - 1)
    if groups == 1:
        return nth.drop("part")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    counts = made.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "before", F.sum("n").over(before) - F.col("n")).drop("n")
    return nth.join(counts, ["length", "part"]).withColumn(
        "number", F.col("number") + F.col("before")).drop("part", "before")


def pack(made: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """Pieces with sequence_id and offset."""
    counts = {n: k for n, k in made.groupBy("length").count().collect()}
    where = places(best_two_fit(counts, sequence))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def make():
        key = where["length"] << 44 | where["number"]

        def work(cols):
            length, number = (cols[c].to_numpy() for c in ("length", "number"))
            at = np.searchsorted(key, length << 44 | number, side="right") - 1
            since = number - where["number"][at]
            return cols | {"sequence_id": pa.array(where["first"][at] + since % where["times"][at]),
                           "offset": pa.array(where["offset"][at] + since // where["times"][at] * length)}

        return work

    return rows.map_batches(numbered(made).withColumn("number", F.col("number").cast("long")), schema, make)


def pack_documents(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE) -> DataFrame:
    return pack(cut(pieces(docs, tokenizer_path, sequence)), sequence)
