"""Packing token sequences by minimum bin slack.

A document's tokens are cut into full pieces of the capacity and one remainder.  Full pieces are sequences of their own.
Pieces go to cells by the hash of their row's number, so copies of a document, rows of one id or without any, are dealt
apart; in a cell every sequence is filled from the multiset of the remaining
lengths: the longest piece opens it, then a bitset subset-sum dynamic programme over the remaining lengths finds the
filling closest to capacity, and backtracking gives how often each length is taken; pieces of one length are taken in the
order of the input.  A cell leaves at most one sequence
that could not be filled for want of pieces.

Tokens are those of a public tokenizer's vocabulary file; white space parts its words, so that ids are looked up word by
word, and each distinct word of a task is encoded once.

Defined results for odd input
* null text counts as empty: one piece that holds the end id alone;
* a null id is carried through; repeated rows are packed each for itself;
* very long texts are cut at the capacity; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import pieces

CAPACITY = 2048
END_ID = 1
#: Documents of a cell, about.
CELL_DOCS = 8192
#: Distinct words in a generation of a worker's memory, of which it keeps two; results do not depend on it.
WORDS_KEPT = 600_000
#: Characters of texts that are read together.
GROUP_CHARS = 1 << 14


class WordIds:
    """Ids of texts as little-endian 32-bit bytes, word by word, with a memory of the words met so far.

    Exact for tokenizers that drop white space, lower the case of ASCII letters and part a letter from the mark after it;
    `agrees` checks a text against the tokenizer itself.
    """

    def __init__(self, path: str, kept: int = WORDS_KEPT):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism here
        self.tokenizer, self.kept = Tokenizer.from_file(path), kept
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; the new words of all are learnt at once."""
        found = []
        for text in texts:
            # str.split() also cuts at separators that the tokenizer may not know; these six are white space to every one
            for blank in BLANKS:
                if blank in text:
                    text = text.replace(blank, " ")
            found.append(text.split(" "))
        new = set().union(*found).difference(self.known)
        if new:
            self.learn(new, found)
        ids = self.known.__getitem__
        return [b"".join(map(ids, words)) for words in found]

    def learn(self, new: set[str], found: list[list[str]]) -> None:
        known = self.known
        if len(known) > self.kept:  # a new generation; words that come again are taken over from the last one
            self.before, known = known, {}
            self.known, new = known, set().union(*found)
        old = {w for w in new if w in self.before}
        known.update((w, self.before[w]) for w in old)
        plain = {w: (w[:-1], w[-1]) if w[-1:] in MARKS and w[-2:-1].isalpha() else (w, "") for w in new - old}
        plain = {w: (core.lower() if core.isascii() else core, mark) for w, (core, mark) in plain.items()}
        fresh = {x for pair in plain.values() for x in pair}.difference(known)
        letters = [w for w in fresh if w.isalpha()]
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, "<u4") if letters else np.zeros(0, "<u4")
        ends = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
        if len(ends) == len(letters):  # one token that ends a word for each: the ids can be told apart
            blob = ids.tobytes()
            known.update((w, blob[4 * a : 4 * b]) for w, a, b in zip(letters, [0, *ends], ends, strict=False))
            fresh.difference_update(letters)
        rest = list(fresh)
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, "<u4").tobytes()
        known.update((w, known[core] + known[mark]) for w, (core, mark) in plain.items())

    def settle(self) -> None:
        """Forget the last generation; its words that were met again are in the present one."""
        self.before = {}

    def agrees(self, text: str) -> bool:
        return self.encode(text) == np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


#: Marks that end a word and are tokens of their own after a letter.
MARKS = frozenset(".,;:!?|")
BLANKS = "\t\n\v\f\r"


class PlainIds:
    """Ids of whole texts, for tokenizers that are not made word by word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        return [self.encode(t) for t in texts]

    def settle(self) -> None:
        pass

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


#: Texts on which both ways must agree before a vocabulary file is read word by word.
PROBES = ("", " ", "a b", "The Word, it's. END!", "x\ty\n\nz \u00e9t\u00e9 \u00c9T\u00c9", "don't 12,5 (no) a.b...c?", "\u65e5\u672c\u8a9e \u0391\u03a3", "<|endoftext|>a <b>", "word word, word; Word: WORD|")


@functools.lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds | PlainIds:
    """One for each Python worker, which serves many tasks."""
    words = WordIds(path)
    return words if all(words.agrees(t) for t in PROBES) else PlainIds(path)


def fill(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """(length, how many) of the multiset closest to the capacity; the longest length is taken once at least.

    Bit t of `reach` says that some choice from the lengths so far sums to t.  Each step adds a power-of-two number of
    one length; steps are kept, and walked back from the highest bit.
    """
    lengths = sorted(counts, reverse=True)
    first = lengths[0]
    room = capacity - first
    taken = {first: 1}
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for length in lengths:
        left = min(counts[length] - (length == first), room // length)
        n = 1
        while left > 0:
            n = min(n, left)
            wider = reach | reach << length * n & mask
            if wider != reach:
                steps.append((length, n, reach))
                reach = wider
            left -= n
            n *= 2
        if reach >> room:
            break
    at = reach.bit_length() - 1
    for length, n, before in reversed(steps):
        if not before >> at & 1:
            at -= length * n
            taken[length] = taken.get(length, 0) + n
    return list(taken.items())


def pack_lengths(lengths: np.ndarray, capacity: int, content: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; sequences count from 0.

    Of equally close fillings one that takes no content twice is preferred, or where a length has more pieces than sequences
    are left, one that takes its even share of them.  Pieces of one length go in the order of the input, but for those that
    the sequence holds already.
    """
    held = list(range(len(lengths))) if content is None else content.tolist()
    stacks: dict[int, list[int]] = {}
    kinds: dict[int, Counter] = {}
    for i in range(len(lengths) - 1, -1, -1):
        stacks.setdefault(int(lengths[i]), []).append(i)
        kinds.setdefault(int(lengths[i]), Counter())[held[i]] += 1
    counts = {length: len(s) for length, s in stacks.items()}
    # only lengths that hold a content twice need to be told apart
    kinds = {length: k for length, k in kinds.items() if len(k) < counts[length]}
    sequence, offset, now, rest = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0, int(lengths.sum())
    some = counts | {length: len(k) for length, k in kinds.items()}
    look = 0  # the sequence from which on a length may have more pieces than sequences are left
    while counts:
        at, inside, left = 0, set(), -(-rest // capacity)
        if kinds and now >= look:
            some |= {length: max(len(k), -(-counts[length] // left)) for length, k in kinds.items()}
            look = now + max(1, (left - max(counts[length] for length in kinds)) // 2)
        taken = fill(some, capacity)
        if kinds and (used := sum(length * n for length, n in taken)) < capacity:
            closer = fill(counts, capacity)
            taken = closer if sum(length * n for length, n in closer) > used else taken
        for length, n in taken:
            stack, kind = stacks[length], kinds.get(length)
            for _ in range(n):
                place = len(stack) - 1
                if kind and held[stack[place]] in inside and any(c not in inside for c in islice(kind, len(inside) + 1)):
                    place = next(j for j in range(place, -1, -1) if held[stack[j]] not in inside)
                i = stack.pop(place)
                if kind:
                    inside.add(held[i])
                    kind[held[i]] -= 1
                    if not kind[held[i]]:
                        del kind[held[i]]
                sequence[i], offset[i] = now, at
                at += length
            counts[length] = some[length] = len(stack)
            if kind is not None and len(kind) == len(stack):
                del kinds[length]
            elif kind is not None:
                some[length] = max(len(kind), -(-len(stack) // left))
            if not stack:
                del counts[length], some[length]
        now, rest = now + 1, rest - at
    return sequence, offset


def group_ends(texts: list[str], chars: int = GROUP_CHARS) -> list[int]:
    """Where groups of texts of about so many characters end."""
    sums = np.cumsum([len(t) for t in texts], dtype=np.int64) // chars
    return [*(np.flatnonzero(np.diff(sums)) + 1).tolist(), len(texts)] if len(texts) else []


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` of every piece, full ones, then the remainder, and ``row``, a number
    of the input row that follows the order of the input."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_path)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            texts = [t or "" for t in batch.column(1).to_pylist()]
            cuts = group_ends(texts)
            encoded = (ids for a, b in zip([0, *cuts], cuts, strict=False) for ids in words.encode_all(texts[a:b]))
            for doc_id, row, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), encoded, strict=True):
                n = len(ids) // 4 + 1
                for start in range(0, n, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    if n <= start + capacity:
                        part += end
                    for column, value in zip(out, (doc_id, start, len(part) // 4, zlib.crc32(part), n, row), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row"])
        words.settle()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("body"), F.monotonically_increasing_id().alias("row")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long")


def packed(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, cell_docs: int = CELL_DOCS) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Sequence ids are the cell's number times 2**32 plus the sequence's number in it, so they are unique, not gapless.
    """
    cells = pieces(docs.count(), cell_docs)

    def in_cell(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["row", "start"], kind="stable", ignore_index=True)
        sequence, offset = pack_lengths(frame["length"].to_numpy(), capacity, frame["ids_crc32"].to_numpy())
        frame["sequence_id"] = sequence + (int(key[0]) << 32)
        frame["offset"] = offset
        return frame[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    rows = token_pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id)
    cell = F.pmod(F.xxhash64(F.lit("cell"), "row"), F.lit(cells))
    return rows.groupBy(cell.alias("cell")).applyInPandas(in_cell, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
