"""Best-fit packing of documents into token sequences by the sum-of-squares rule.

A document is its token ids and an end mark. Only documents longer than a sequence are cut, into full
pieces and a rest. For each residual gap g let n(g) be the number of open sequences with that gap: a
piece goes to the open sequence by which the sum of n(g)^2 becomes smallest; on ties the fullest one
wins. A new sequence is opened only where no open one has room, as otherwise some stay open in the
end (1 to 3 more sequences per thousand pieces). Pieces are placed from the longest to the shortest.

Full pieces are sequences by themselves. All others are dealt at random into groups of about ``group``
pieces, and each group is packed on its own. The sequences it fills are final; the pieces of those it left
open, about a tenth, are dealt anew into fewer groups and packed again, round by round, until one group
holds what is left or a round fills next to nothing (then all that is open stays as it is). So
no task ever holds more than a group, whatever the number of documents, and little space is lost at the
seams between groups. Rounds carry piece rows without ids or texts and end in a written table.

Tokens: a text is cut at ASCII white space, which no token and no mark spans, and the ids of a word are
cached, so that each different word is encoded about once per task.

Odd rows: null and empty texts are the end mark alone; repeated rows are documents of their own; a null
doc_id is packed like any other; text that is not valid UTF-8 is read with replacement characters; further
columns are ignored.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialize, raw

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


#: ASCII marks that stand together in one token, if letters or digits are before them. The apostrophe may begin a token of letters.
_MARKS = "".join(chr(b) for b in range(0x21, 0x7F) if not chr(b).isalnum() and b != 0x27)
#: Letters that normalization leaves as they are, and letters and digits of every version of Unicode.
_PLAIN, _ENDING = "^[a-zß-öø-ÿ]+$", "[0-9A-Za-zÀ-ÖØ-öø-ɏ]$"


class WordIds(dict):
    """Little-endian 32-bit ids of each word, cached; emptied when it reaches its bound. Words of more than
    ``longest`` bytes are encoded each time. New words of small letters are encoded many at a time and their ids told
    apart by the tokens that end a word; they are encoded singly if the number of those is off.
    """

    def __init__(self, path: str, bound: int = 800_000, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.bound, self.longest = Tokenizer.from_file(path), bound, longest
        self.bare = Tokenizer.from_file(path)  # for words on which normalization does nothing
        self.bare.normalizer = None
        size = self.tokenizer.get_vocab_size()
        self.final = np.array([x.endswith("</w>") for x in map(self.tokenizer.id_to_token, range(size))])

    def encoded(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def learn(self, words: list[bytes]) -> None:
        """Makes the short ones of the words known."""
        if len(self) >= self.bound:
            self.clear()
        new = [w for w in words if w not in self and len(w) <= self.longest]
        alike = pc.match_substring_regex(pa.array(new, pa.binary()).view(pa.string()), _PLAIN).to_pylist()
        plain = [w for w, x in zip(new, alike) if x]
        for at in range(0, len(plain), 256):
            part = plain[at : at + 256]
            (ids,) = self.bare.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)
            ids = np.array(ids.ids, "<u4")
            cut = (4 * np.flatnonzero(self.final[ids]) + 4).tolist()
            ids = ids.tobytes()
            self.update(zip(part, [ids[i:j] for i, j in zip([0, *cut], cut)] if len(cut) == len(part) else self.encoded(part)))
        other = [w for w, x in zip(new, alike) if not x]
        for at in range(0, len(other), 4096):
            part = other[at : at + 4096]
            self.update(zip(part, self.encoded(part)))

    def __missing__(self, word: bytes) -> bytes:
        return self.encoded([word])[0]

    def table(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words one after the other, number of ids of each)."""
        words = raw(words)
        self.learn(words)
        found = [self[w] for w in words]
        return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4


def _parts(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(core, marks) of words: the marks at the end, where letters or digits are before them, and the rest, in small letters where it is
    ASCII. A word that may name a special token stays whole."""
    head = pc.ascii_rtrim(words, characters=_MARKS)
    whole = pc.match_substring(words, "<")
    cut = pc.and_(pc.less(pc.binary_length(head), pc.binary_length(words)), pc.and_not(pc.match_substring_regex(head, _ENDING), whole))
    core = pc.if_else(cut, head, words)
    core = pc.if_else(pc.and_not(pc.string_is_ascii(core), whole), pc.ascii_lower(core), core)
    # the marks are what is left of a cut word when all before its last letter or digit goes
    return core, pc.if_else(cut, pc.replace_substring_regex(words, "^.*[^" + _escaped(_MARKS) + "]", ""), "")


def _escaped(characters: str) -> str:
    return "".join("\\" + c for c in characters)


def token_ids(texts: pa.Array, known: WordIds, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts with their end marks, where each text begins and the last one ends): words are told apart, taken
    apart and numbered in the columns, so that only different ones become objects."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, b"").view(pa.string()))
    coded = lists.flatten().dictionary_encode()
    core, marks = (x.dictionary_encode() for x in _parts(coded.dictionary))
    (core_ids, core_size), (mark_ids, mark_size) = known.table(core.dictionary), known.table(marks.dictionary)
    ids, size = np.append(core_ids, mark_ids), np.append(core_size, mark_size)
    begin = np.cumsum(size) - size
    pair = np.column_stack([core.indices.to_numpy(), marks.indices.to_numpy() + len(core_size)])
    index = pair[coded.indices.to_numpy()].ravel()  # core and marks of each word
    n = size[index]
    total = np.append(0, np.cumsum(n))
    at = np.arange(total[-1]) + np.repeat(begin[index] - total[:-1], n)
    ends = total[2 * np.cumsum(pc.list_value_length(lists).to_numpy())] if len(texts) else np.zeros(0, np.int64)
    return np.insert(ids[at], ends, end), np.append(0, ends + np.arange(1, len(texts) + 1))


def pieces(docs: DataFrame, path: str, size: int, end: int) -> DataFrame:
    """PIECES of docs(doc_id, text binary)."""

    def run(batches):
        known = WordIds(path)
        for part in chunks(batches, limit=16 << 20):
            ids, limits = token_ids(part.column("text"), known, end)
            data, limits = memoryview(ids.astype("<u4").tobytes()), limits.tolist()
            rows, of = [], []
            for i, (first, last) in enumerate(zip(limits, limits[1:])):
                for k, at in enumerate(range(first, last, size)):
                    to = min(at + size, last)
                    rows.append((k, at - first, to - at, zlib.crc32(data[4 * at : 4 * to])))
                    of.append(i)
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(of)), *columns], names=[c.split()[0] for c in PIECES.split(", ")])

    return docs.mapInArrow(run, PIECES)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset, whether it is full) of each piece shorter than size, by the rule above."""
    n = np.zeros(size + 1, np.int64)  # open sequences by what they hold
    held: list[list[int]] = [[] for _ in range(size + 1)]
    sequence, offset, count = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    full = []
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        here = n[1 : size - s + 1]
        change = 2 * (n[s + 1 : size + 1] - here) + 2  # of the sum of squares, at each level; full ones do not count
        change[-1] = 1 - 2 * here[-1]
        change[here == 0] = np.iinfo(np.int64).max
        level = len(change) - int(change[::-1].argmin())
        if n[level]:
            n[level] -= 1
            k = held[level].pop()
        else:  # no open sequence has room
            level, k, count = 0, count, count + 1
        sequence[i], offset[i] = k, level
        level += s
        if level == size:
            full.append(k)
        else:
            n[level] += 1
            held[level].append(k)
    closed = np.zeros(count, bool)
    closed[full] = True
    return sequence, offset, closed[sequence]


def _round(rows: DataFrame, number: int, groups: int, size: int) -> DataFrame:
    """rows with sequence_id, offset and whether the sequence is full."""
    schema = f"{PIECES}, slot bigint, sequence_id bigint, offset bigint, closed boolean"

    def run(table: pa.Table) -> pa.Table:
        sequence, offset, closed = sum_of_squares(table.column("length").to_numpy(), size)
        first = (number << 56) + (table.column("dealt")[0].as_py() << 20)
        out = table.drop_columns(["dealt"])
        return out.append_column("sequence_id", pa.array(first + sequence)).append_column("offset", pa.array(offset)).append_column("closed", pa.array(closed))

    dealt = rows.withColumn("dealt", F.pmod(F.xxhash64(F.lit(number), "slot"), F.lit(groups)))
    return dealt.groupBy("dealt").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, *, size: int = 4096, end: int = 1, group: int = 8192) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of each piece of docs(doc_id, text):
    where it stands in which sequence of at most size tokens. tokenizer: path of a tokenizer file that every
    executor has; end: the id after each document; group: pieces packed together."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    every = materialize(pieces(docs, tokenizer, size, end).withColumn("slot", F.monotonically_increasing_id()))
    columns = [*(c.split()[0] for c in PIECES.split(", ")), "sequence_id", "offset"]
    out = every.where(F.col("length") == size).withColumns({"sequence_id": -1 - F.col("slot"), "offset": F.lit(0).cast("bigint")}).select(columns)
    left, number = every.where(F.col("length") < size), 1
    count = left.count()
    while count:
        groups = -(-count // group)
        packed = materialize(_round(left, number, groups, size))
        left = packed.where("not closed").select(every.columns)
        before, count = count, left.count()
        if groups == 1 or count > 0.9 * before:
            return out.unionByName(packed.select(columns))
        out = out.unionByName(packed.where("closed").select(columns))
        number += 1
    return out
