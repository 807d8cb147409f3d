"""Sum-of-squares packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isofield.llm.common import cut, in_small_batches
from isofield.llm.words import blocks, tidy, words

CAPACITY = 2048
END_ID = 0
#: Pieces that one task packs; more pieces make more tasks, each with at most a few open bins for each gap.
SHARD = 100_000
#: Words whose ids a task remembers, and slots of its table (a power of two, over twice as many).
REMEMBER, SLOTS = 800_000, 1 << 21


class WordIds:
    """Ids of texts, with the ids of each white-space-delimited word worked out once.

    The tokenizer never joins symbols across ASCII white space, so a text's ids are those of its words in order.
    Words of plain letters, digits and signs go straight to the tokenizer's model; others through all of it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.plain = re.compile(r"[\x21-\x7e\xc0-\xff]+")
        self.letters = re.compile(r"[a-z]+")
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        self.byte_signs = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.known: dict[str, list[int]] = {}
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(SLOTS, np.uint64)
        self.slot = np.zeros(SLOTS, np.int32)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 12, np.int32)
        self.length = np.zeros(1 << 12, np.int32)
        self.used = self.count = 0
        self.known.clear()

    def drop(self) -> None:
        """Forget all and hold no table until the next text."""
        self.forget()
        self.keys, self.slot, self.flat, self.start, self.length = (x[:0].copy() for x in (self.keys, self.slot, self.flat, self.start, self.length))

    def piece(self, text: str) -> list[int]:
        signs = text if text.isascii() else "".join(self.byte_signs[b] for b in text.encode())
        return [t.id for t in self.model.tokenize(signs)]

    def short(self, text: str) -> list[int]:
        if text not in self.known:
            self.known[text] = self.piece(text)
        return self.known[text]

    def word(self, text: str) -> list[int]:
        if not self.plain.fullmatch(text) or "<|" in text:
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        low = text.lower()
        if self.letters.fullmatch(low):
            return self.piece(low)
        return [x for part in self.split.findall(low) for x in (self.short(part) if len(part) < 3 else self.piece(part))]

    def learn(self, keys: np.ndarray, lists: list[list[int]]) -> None:
        """Put distinct new keys with their ids into the table."""
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.uint32, int(n.sum()))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + len(n) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.flat[self.used:self.used + len(flat)] = flat
        self.start[self.count:self.count + len(n)] = self.used + np.cumsum(n) - n
        self.length[self.count:self.count + len(n)] = n
        number = np.arange(self.count, self.count + len(n))
        self.used, self.count = self.used + len(flat), self.count + len(n)
        todo = np.arange(len(n))
        while len(todo):  # of keys that want the same free slot one gets it, the rest look again
            at, _ = self.look(keys[todo])
            _, first = np.unique(at, return_index=True)
            self.keys[at[first]], self.slot[at[first]] = keys[todo[first]], number[todo[first]]
            todo = np.delete(todo, first)

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot that holds each key or is free for it, whether it holds it), by linear probing."""
        at = (keys & np.uint64(SLOTS - 1)).astype(np.int64)
        there = self.keys[at]
        todo = np.flatnonzero((there != keys) & (there != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (SLOTS - 1)
            there = self.keys[at[todo]]
            todo = todo[(there != keys[todo]) & (there != 0)]
        return at, self.keys[at] == keys

    def numbers(self, raw: bytes, start: np.ndarray, end: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words on end, number of ids of each)."""
        at, found = self.look(keys)
        if not found.all():
            new, first = np.unique(keys[~found], return_index=True)
            where = np.flatnonzero(~found)[first]
            if self.count + len(new) > REMEMBER and self.count:
                self.forget()
                new, where = np.unique(keys, return_index=True)
            if len(new) > REMEMBER:  # more distinct words than a task remembers at once: run by run
                half = len(keys) // 2
                runs = [self.numbers(raw, start[s], end[s], keys[s]) for s in (slice(None, half), slice(half, None))]
                return tuple(np.concatenate(x) for x in zip(*runs))
            self.learn(new, [self.word(raw[i:j].decode()) for i, j in zip(start[where].tolist(), end[where].tolist())])
            at, _ = self.look(keys)
        which = self.slot[at]
        n = self.length[which].astype(np.int64)
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(self.start[which] - ends + n, n)], n

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts on end, where each text's ids begin and the last end)."""
        if not len(self.keys):
            self.forget()
        row, start, end, keys = words(data, offsets, lower=False)
        keys[keys == 0] = 1
        ids, n = self.numbers(data.tobytes(), start, end, keys)
        per_row = np.bincount(row, n, minlength=len(offsets) - 1).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(per_row)])


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of each document's ids and the end id, cut only beyond capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(tokenizer_path)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("id", "piece", "start", "length", "ids_crc32", "ids")}
            keys = batch.column(0).to_pylist()
            for first, n, data, offsets in blocks(batch.column(1)):
                flat, begin = encode(data, offsets)
                for i in range(n):
                    ids = np.append(flat[begin[i]:begin[i + 1]], np.uint32(end_id)).astype("<u4")
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        part = ids[at:at + capacity]
                        row = (keys[first + i], k, at, len(part), zlib.crc32(part.tobytes()), part.astype(np.int64) if with_ids else None)
                        for name, x in zip(out, row):
                            out[name].append(x)
            if not with_ids:
                del out["ids"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out.values(), kinds)], names=list(out))

    schema = "id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return in_small_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col))).mapInArrow(tidy(run, lambda: word_ids(tokenizer_path).drop()), schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length: each goes where the sum of squared counts of open bins per gap becomes smallest.

    A bin that is full counts no more. Among equal choices the smallest gap is taken; a new bin is opened only for a
    length that fits no open one. With lengths in falling order this wastes next to nothing.
    """
    open_bins = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i, size in enumerate(lengths.tolist()):
        gaps = np.flatnonzero(open_bins[size:capacity]) + size
        best = -1
        if len(gaps):
            change = 2 - 2 * open_bins[gaps] + 2 * open_bins[gaps - size]
            if gaps[0] == size:
                change[0] = 1 - 2 * open_bins[size]
            best = int(gaps[np.argmin(change)])
        if best < 0:
            b, gap, n = n, capacity, n + 1
        else:
            b, gap = stacks[best].pop(), best
            open_bins[best] -= 1
        where[i], offset[i] = b, capacity - gap
        if gap > size:
            open_bins[gap - size] += 1
            stacks[gap - size].append(b)
    return where, offset


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, end_id: int = END_ID, shard: int = SHARD) -> DataFrame:
    """One row for each piece: (id, piece, start, length, ids_crc32, sequence_id, offset).

    Null and empty texts are a document of the end id alone. Only documents beyond capacity are cut; each of their
    full pieces is a sequence. Repeated rows are documents of their own, null ids included. The other pieces are dealt
    by a hash into shards of about the given size, each packed by one task with a state of one count for each gap.
    An empty table gives an empty result.
    """
    rows = cut(pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id), "pieces")
    shards = max(1, -(-rows.count() // shard))
    schema = "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "ids_crc32", "id", "piece"], ascending=[False, True, True, True], kind="stable")
        where, offset = sum_of_squares(part["length"].to_numpy(), capacity)
        return part.drop(columns="shard").assign(sequence_id=(key[0] << 32) + where, offset=offset)

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id", "piece", "length", "ids_crc32"), F.lit(shards)).cast("long"))
    return dealt.groupBy("shard").applyInPandas(run, schema).withColumnRenamed("id", id_col)
