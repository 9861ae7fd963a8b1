"""Alignment of the tokens of two tokenizers over the same bytes, by galloping intersection.

Each tokenizer turns a text into tokens that end at byte offsets. The offsets where tokens of both end cut the
text into groups: the shorter of the two sorted lists is walked, and each of its offsets is sought in the
longer one by steps that double and a binary search in the last of them. Within a group, the ranks of a token's
begin and end among the other list's ends differ by the number of tokens it overlaps; these are its links.

A text is first cut where white space begins, at single line ends, and between a letter and a mark, which no token
of either tokenizer spans. Equal stretches have equal tokens, groups and links, so each different one is encoded
and aligned about once per task, thousands of them in the same array operations.

The count of a pair of ids is the number of documents that hold it linked. Slices of documents send their
pairs with counts to the buckets of the corpus and get back the corpus's counts and the best count of each
pair's first id, in two steps each way (see ``slices.tallied``); buckets are ranges of the hashed first id, so
that all pairs of an id meet.

Odd rows: a text that is null, empty, not valid UTF-8, or whose tokens do not give its bytes back (with the
space before it) in either tokenizer has no tokens: zeros, and no hash. Repeated rows are documents of
their own; a null doc_id is aligned like any other; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from itertools import accumulate, chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialize, raw
from .slices import flat, lists, sent, settled, sizes, tallied

#: All white space of Unicode, and the separators that only some libraries count.
_SPACES = "\t-\r \x1c-\x1f\x85\xa0  -     　"
_WORD = f"[^{_SPACES}]+(?=[ \n]|\\Z)"
STRETCH = re.compile(f"[ ]?[A-Za-zÀ-ÖØ-öø-ɏ]+(?=[.,;:!?])|[ ]?{_WORD}|\n(?=[^{_SPACES}])|.+?(?:(?<=[^{_SPACES}])(?=[ \n])|\\Z)", re.S)
#: A space and other characters: such stretches can be encoded one after the other as one text.
SPACED = re.compile(f" [^{_SPACES}]+")


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters stand
    for themselves, the other bytes in order for the characters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(other)}


def gallop(values: np.ndarray, into: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each value the first place from at on in the sorted array whose entry is not below it, if one is: steps that
    double until they pass it, then a binary search in the last step, for all values at once."""
    low, high, step = at.copy(), at.copy(), 1
    on = np.flatnonzero(into[high] < values)
    while len(on):
        low[on] = high[on] + 1
        high[on] = np.minimum(high[on] + step, len(into) - 1)
        step *= 2
        on = on[into[high[on]] < values[on]]
    on = np.flatnonzero(low < high)
    while len(on):
        middle = (low[on] + high[on]) // 2
        below = into[middle] < values[on]
        low[on] = np.where(below, middle + 1, low[on])
        high[on] = np.where(below, high[on], middle)
        on = on[low[on] < high[on]]
    return high


def align(short: np.ndarray, long: np.ndarray, of_short: np.ndarray, of_long: np.ndarray):
    """(common, first, last): whether each end of short is one of long, and the ranks of the first and last token of long that
    each token of short overlaps. Both hold token ends over the same bytes; of_...: the stretch of each token, all of
    which end in both."""
    start = np.searchsorted(of_long, of_short)
    last = gallop(short, long, start)
    common = long[last] == short
    first = np.zeros(len(short), np.int64)
    first[1:] = last[:-1] + common[:-1]
    return common, first, last


class Stretches:
    """Numbers of the different stretches of a task, and what is known of each."""

    def __init__(self, first: str, second: str, bound: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        value = byte_values()
        size = self.a.get_vocab_size()
        self.a_bytes = [bytes(value[c] for c in x) if all(c in value for c in x) else x.encode() for x in map(self.a.id_to_token, range(size))]
        self.b = SentencePieceProcessor(model_file=second)
        names = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(x[1:-1], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.a_len, self.b_len = (np.array([len(x) for x in parts]) for parts in (self.a_bytes, self.b_bytes))
        # ids as text with what goes before them: a stretch's first, a group's first, others of A; a group's first, others of B
        marks = [(mark, n) for mark, n in (("", size), (";", size), (",", size), ("|", len(names)), (",", len(names)))]
        self.shown = [f"{mark}{i}".encode() for mark, n in marks for i in range(n)]
        self.bound = bound
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.text: list[bytes] = []  # its groups
        self.n_a, self.n_b, self.n_groups, self.n_links, self.bad = (array("q") for _ in range(5))
        self.pairs = array("q")  # of all stretches, one after the other

    def learn(self, found: list[list[str]]) -> None:
        if len(self.number) >= self.bound:
            self.clear()
        new = set()
        for x in found:
            new.update(filterfalse(self.number.__contains__, x))
        plain = [x for x in new if SPACED.fullmatch(x)]
        single = list(new.difference(plain))
        for at in range(0, len(plain), 4096):
            groups = [plain[k : k + 64] for k in range(at, min(at + 4096, len(plain)), 64)]
            good, (left, right) = [], self._encoded(["".join(g) for g in groups])
            for group, a, b in zip(groups, left, right):
                if self._whole(group, a, b):
                    good.append((group, a, b))
                else:
                    single += group
            self._add(good)
        for at in range(0, len(single), 4096):
            part = single[at : at + 4096]
            left, right = self._encoded(part)
            done = [([x], np.array(a, np.int64), np.array(b, np.int64)) for x, a, b in zip(part, left, right)]
            self._add([x for x in done if self._whole(*x)])
            for x in part:
                if x not in self.number:  # its bytes do not come back
                    self.number[x] = len(self.text)
                    self.text.append(b"")
                    for column, n in ((self.n_a, 0), (self.n_b, 0), (self.n_groups, 0), (self.n_links, 0), (self.bad, 1)):
                        column.append(n)

    def _encoded(self, texts: list[str]) -> tuple[list, list]:
        left = [np.array(x.ids, np.int64) for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        # the piece model puts a space before what it gets, if that is not empty; where it must not, a line
        # end stands between that space and the text, and their two tokens are left out
        spaced = [x[0] == " " != x for x in texts]
        right = self.b.encode([x[1:] if s else "\n" + x for x, s in zip(texts, spaced)], num_threads=1)
        return left, [np.array(b if s else b[2:], np.int64) for b, s in zip(right, spaced)]

    def _whole(self, group: list[str], a: np.ndarray, b: np.ndarray) -> bool:
        """Whether both sequences give the bytes back and have an end at the end of each stretch."""
        real = "".join(group).encode()
        if b"".join([self.a_bytes[i] for i in a.tolist()]) != real or b"".join([self.b_bytes[i] for i in b.tolist()]) != real:
            return False
        if len(group) == 1:
            return True
        ends = {*accumulate([len(x.encode()) for x in group])}
        return all(ends.issubset(np.cumsum(n[ids]).tolist()) for ids, n in ((a, self.a_len), (b, self.b_len)))

    def _add(self, parts: list[tuple[list[str], np.ndarray, np.ndarray]]) -> None:
        """Numbers and aligns the stretches of parts (stretches, ids of both over all of them)."""
        names = [x for group, _, _ in parts for x in group]
        if not names:
            return
        self.number.update(zip(names, range(len(self.text), len(self.text) + len(names))))
        a, b = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
        ends = np.cumsum([len(x.encode()) for x in names])
        a_ends, b_ends = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        of_a, of_b = np.searchsorted(ends, a_ends), np.searchsorted(ends, b_ends)
        swap = len(a) > len(b)
        short, long, of_short = (b, a, of_b) if swap else (a, b, of_a)
        common, first, last = align(*((b_ends, a_ends, of_b, of_a) if swap else (a_ends, b_ends, of_a, of_b)))
        n = last - first + 1
        near, far = np.repeat(short, n), long[np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)]
        self.pairs.frombytes((far << 32 | near if swap else near << 32 | far).tobytes())
        total = lambda of, x=None: np.bincount(of, x, len(names)).astype(np.int64)
        counts = total(of_a), total(of_b), total(of_short[common]), total(of_short, n), np.zeros(len(names), np.int64)
        for column, values in zip((self.n_a, self.n_b, self.n_groups, self.n_links, self.bad), counts):
            column.frombytes(values.tobytes())
        # groups as text: the tokens of both in the order of groups, A before B
        short_end, long_end = np.flatnonzero(common), last[common]
        a_end, b_end = (long_end, short_end) if swap else (short_end, long_end)
        group_a, group_b = np.searchsorted(a_end, np.arange(len(a))), np.searchsorted(b_end, np.arange(len(b)))
        new_a, new_b = (np.append(True, np.diff(g) != 0) for g in (group_a, group_b))
        size_a, size_b = len(self.a_bytes), len(self.b_bytes)
        opens = np.append(True, np.diff(of_a) != 0)
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.append(0, b_end + 1)[group_a]] = a + size_a * np.where(opens, 0, np.where(new_a, 1, 2))
        order[np.arange(len(b)) + a_end[group_b] + 1] = b + 3 * size_a + size_b * ~new_b
        shown = [self.shown[k] for k in order.tolist()]
        limits = np.append(0, np.cumsum(counts[0] + counts[1])).tolist()
        self.text += [b"".join(shown[i:j]) for i, j in zip(limits, limits[1:])]


def _mixed(pairs: np.ndarray) -> np.ndarray:
    """Keys of pairs of ids: a bijection of the first id's 32 bits, then the second id."""
    high = (pairs >> 32).astype(np.uint64) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)
    return high << np.uint64(32) | (pairs & 0xFFFFFFFF).astype(np.uint64)


COUNTS = ("n_a", "n_b", "n_groups", "n_links")
SLICES = (
    "slice bigint, doc_id array<bigint>, " + ", ".join(f"{c} array<bigint>" for c in COUNTS) + ", sha array<string>, "
    "size array<int>, place array<int>, times array<int>, keys array<bigint>, n array<bigint>"
)


def pair_slices(docs: DataFrame, first: str, second: str, limit: int) -> DataFrame:
    """SLICES of docs(doc_id, text binary): per document its counts and hash and how many different pairs it has
    (size), those as places among the slice's keys, with how often each is linked; per key, in how many documents."""

    def row(known: Stretches, name: int, part: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for text in raw(part.column("text")):
            try:
                found.append(STRETCH.findall(" " + text.decode()) if text else [])
            except UnicodeDecodeError:
                found.append([])
        known.learn(found)
        length = np.array([len(x) for x in found])
        numbers = [list(map(known.number.__getitem__, x)) for x in found]
        code = np.fromiter(chain.from_iterable(numbers), np.int64, int(length.sum()))
        of = np.repeat(np.arange(len(found)), length)
        bad = np.bincount(of, np.frombuffer(known.bad, np.int64)[code], len(found)) > 0
        columns = {}
        for c in COUNTS:
            n = np.bincount(of, np.frombuffer(getattr(known, c), np.int64)[code], len(found)).astype(np.int64)
            columns[c] = np.where(bad, 0, n)
        sha = ["" if b or not x else hashlib.sha256(b";".join(map(known.text.__getitem__, x))).hexdigest() for x, b in zip(numbers, bad)]
        del found, numbers  # the arrays that follow take as much again
        n = np.frombuffer(known.n_links, np.int64)
        begin = (np.cumsum(n) - n)[code]
        n = np.where(bad[of], 0, n[code])
        at = np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)
        keys, place = np.unique(_mixed(np.frombuffer(known.pairs, np.int64)[at]), return_inverse=True)
        both, times = np.unique(np.repeat(of, n) * max(1, len(keys)) + place, return_counts=True)
        of, place = both // max(1, len(keys)), both % max(1, len(keys))
        one = lambda values: lists(values, np.array([0, len(values)]))
        columns = {"slice": pa.array([name]), "doc_id": one(part.column("doc_id"))} | {c: one(v) for c, v in columns.items()}
        columns |= {"sha": one(pa.array(sha, pa.string())), "size": one(pa.array(np.bincount(of, minlength=part.num_rows), pa.int32()))}
        columns |= {"place": one(pa.array(place, pa.int32())), "times": one(pa.array(times, pa.int32()))}
        return pa.RecordBatch.from_pydict(columns | {"keys": one(keys.view(np.int64)), "n": one(np.bincount(place, minlength=len(keys)))})

    def run(batches):
        known, name = Stretches(first, second), TaskContext.get().partitionId() << 32
        for part in chunks(batches, limit=limit):
            yield row(known, name, part)  # a function of its own, so that nothing of one slice stays while the next is made
            name += 1

    return docs.mapInArrow(run, SLICES)


def sent_pairs(slices: DataFrame, buckets: int) -> DataFrame:
    """(slice, bucket, keys, n) of each slice."""

    def run(batches):
        for batch in batches:
            for i, name in enumerate(batch.column("slice").to_pylist()):
                keys, n = (np.asarray(batch.column(c)[i].values) for c in ("keys", "n"))
                yield sent(name, keys.view(np.uint64), buckets, n=n)

    return slices.select("slice", "keys", "n").mapInArrow(run, "slice bigint, bucket bigint, keys array<bigint>, n array<bigint>")


def _best(keys: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Count of each pair, negative where it is not the best of its first id. Keys are sorted as signed values, so
    pairs of one id stand together."""
    if not len(keys):
        return {"count": n}
    high = keys >> 32
    first = np.flatnonzero(np.append(True, np.diff(high) != 0))
    best = np.repeat(np.maximum.reduceat(n, first), np.diff(np.append(first, len(n))))
    return {"count": np.where(n == best, n, -n)}


ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _finish(rows: pa.Table, found: pa.Table) -> pa.Table:
    row = rows.combine_chunks()
    values = {c: np.asarray(row.column(c).combine_chunks().flatten()) for c in (*COUNTS, "size", "place", "times")}
    # answers come by bucket, the keys of a slice stand in the order of their buckets
    count = flat(found.column("count"))[values["place"]] if len(values["place"]) else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(values["size"])), values["size"])
    best, total = np.zeros((2, len(values["size"])), np.int64)
    np.add.at(best, of, np.where(count > 0, values["times"], 0))
    np.add.at(total, of, np.abs(count) * values["times"])
    columns = [row.column("doc_id").combine_chunks().flatten(), *(pa.array(values[c]) for c in COUNTS), pa.array(best), pa.array(total), row.column("sha").combine_chunks().flatten()]
    return pa.table(columns, names=[c.split()[0] for c in ALIGNED.split(", ")])


def align_tokens(docs: DataFrame, first: str, second: str, *, slice_bytes: int = 4 << 20, bucket_pairs: int = 1 << 18) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of docs(doc_id, text).
    first: path of a byte-level tokenizer file, second: of a piece model; every executor has both."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    slices = materialize(pair_slices(docs, first, second, slice_bytes))
    count, every = slices.agg(F.count("*"), F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()
    rows = sent_pairs(slices, every // bucket_pairs + 1)
    _, answers = tallied(rows, count, _best, "count array<bigint>")
    return settled(slices.drop("keys", "n"), materialize(answers), _finish, ALIGNED)
