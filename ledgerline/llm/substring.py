"""Substring deduplication by Rabin-Karp hashes of every fixed-length token window, counted in Spark.

1. Every document is cut into words; the hash of each window of `window` words follows from two prefix sums of a
   polynomial over 64-bit word hashes.  A task drops what it can itself: of equal windows that it has read, only the
   earliest is passed on, the others already have an earlier place.  So a passage that a third of all documents share is
   passed on once a task.
2. Windows are dealt by hash to buckets, as packed arrays (hash, document, start) instead of single rows.  A bucket
   sorts its windows; every window but the earliest of its hash is a repeat.
3. Repeats go, as packed arrays again, to the blocks of documents where their texts are; there, windows that overlap or
   touch merge into maximal intervals of words to remove.

Places are ordered by document id, then start, so the earliest occurrence of every passage stays.  The bucket's number
comes from the second hash of a window, the first is kept in it: two windows are taken for equal if 64 bits and the
bucket agree.  With buckets of about a million windows that makes n * 3e-14 wrong repeats among n windows, under one at
100 TB.

Defined results for odd input
* null text counts as no words; texts shorter than the window lose nothing; very long texts are read whole;
* rows with a null id are one document that comes before all others;
* rows with one id count as one document: a window starts earlier only if its id or its start is smaller, so rows repeated
  whole lose nothing to each other; texts under one id are told apart by a hash when repeats are sent to them;
* an empty table gives an empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import pieces

WINDOW = 20
BASE = 0x9E3779B97F4A7C15
#: Windows that a task gathers before it passes them on.
GATHER = 1_000_000
#: Windows of a bucket, about, and characters of a block of documents.
BUCKET_WINDOWS = 1_000_000
BLOCK_CHARS = 4_000_000
#: Word hashes that a worker remembers.
WORDS_KEPT = 300_000


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) > WORDS_KEPT:
            self.clear()
        self[word] = h = xxh3_64_intdigest(word)
        return h


def powers(n: int, base: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    out[1:] = np.uint64(base)
    return np.cumprod(out, dtype=np.uint64)


BASE_2 = 0xD6E8FEB86659FD93
INVERSE, INVERSE_2 = pow(BASE, -1, 1 << 64), pow(BASE_2, -1, 1 << 64)


def window_hashes(words: list[bytes], window: int, memory: dict) -> tuple[np.ndarray, np.ndarray]:
    """Two Rabin-Karp hashes modulo 2**64 of all windows, scrambled so that every bit depends on all of them.

    The second comes from other hashes of the words and another base; windows that collide in one are apart in the other.
    """
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    h = np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))
    other = (h ^ h >> np.uint64(31)) * np.uint64(0xC2B2AE3D27D4EB4F)
    other ^= other >> np.uint64(29)
    out = []
    for x, base, inverse in ((h, BASE, INVERSE), (other, BASE_2, INVERSE_2)):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * powers(len(words), base), dtype=np.uint64)))
        y = (sums[window:] - sums[:-window]) * powers(n, inverse)
        y ^= y >> np.uint64(33)
        y *= np.uint64(0xFF51AFD7ED558CCD)
        out.append(y ^ y >> np.uint64(29))
    return out[0], out[1]


def bucket_of(second: np.ndarray, buckets: int) -> np.ndarray:
    return ((second >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)


def planes(a: np.ndarray) -> bytes:
    """Byte planes: the high bytes of small numbers lie together and compress to nothing."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()


def unplanes(blob: bytes, kind: str, n: int, at: int) -> tuple[np.ndarray, int]:
    size = np.dtype(kind).itemsize
    out = np.frombuffer(blob, np.uint8, n * size, at).reshape(size, n).T.copy().view(kind).reshape(n)
    return out, at + n * size


def seal(doc: np.ndarray, tag: np.ndarray, start: np.ndarray) -> bytes:
    """Places in ascending order, packed: differences of ids, counts per document, differences of starts."""
    import zstandard

    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
    heads = np.flatnonzero(new)
    steps = np.diff(start, prepend=0)
    steps[heads] = start[heads]
    body = planes(np.diff(doc[heads], prepend=np.int64(0))) + planes(tag[heads].astype("<u8")) + planes(np.diff(heads, append=len(doc)).astype("<u4")) + planes(steps.astype("<u4"))
    return np.array([len(heads), len(doc)], "<u4").tobytes() + zstandard.ZstdCompressor(level=1).compress(body)


def unseal(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    import zstandard

    heads, n = (int(x) for x in np.frombuffer(blob, "<u4", 2))
    body = zstandard.ZstdDecompressor().decompress(blob[8:], max_output_size=heads * 20 + n * 4 + 64)
    ids, at = unplanes(body, "<i8", heads, 0)
    tags, at = unplanes(body, "<u8", heads, at)
    counts, at = unplanes(body, "<u4", heads, at)
    steps, at = unplanes(body, "<u4", n, at)
    sums = np.cumsum(steps, dtype=np.int64)
    first = np.cumsum(counts) - counts
    base = sums[first] - steps[first]
    return np.repeat(np.cumsum(ids), counts), np.repeat(tags, counts), sums - np.repeat(base, counts)


NO_ID = np.iinfo(np.int64).min


def block_of(doc: np.ndarray, blocks: int) -> np.ndarray:
    y = doc.astype(np.int64).view(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    y ^= y >> np.uint64(32)
    return (y % np.uint64(blocks)).astype(np.int64)


def by_block(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, blocks: int) -> Iterator[tuple[int, bytes]]:
    block = block_of(doc, blocks)
    order = np.lexsort((start, tag, doc, block))
    block, doc, tag, start = block[order], doc[order], tag[order], start[order]
    cuts = np.flatnonzero(np.diff(block)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)], strict=True):
        if b > a:
            yield int(block[a]), seal(doc[a:b], tag[a:b], start[a:b])


def word_hashes() -> WordHashes:
    """One memory for each Python worker."""
    global MEMORY
    MEMORY = MEMORY if MEMORY is not None else WordHashes()
    return MEMORY


MEMORY: WordHashes | None = None


def text_tag(text: bytes) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(text)


def intervals(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal intervals [first, end) of the words that the windows at ascending starts cover."""
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > window) + 1
    return [(int(starts[a]), int(starts[b - 1]) + window) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(starts)], strict=True)]


def repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, bucket_windows: int = BUCKET_WINDOWS, block_chars: int = BLOCK_CHARS, gather: int = GATHER) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, kept`` (the words that stay, joined by one space) and
    ``removed`` (the maximal intervals of word numbers)."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    chars = source.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    tagged = bool(source.groupBy("doc_id").count().filter("count > 1").limit(1).count())
    buckets, blocks = pieces(chars // 6, bucket_windows), pieces(chars, block_chars)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = word_hashes()
        held: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        size = 0

        def passed_on() -> pa.RecordBatch:
            held.sort(key=lambda x: x[:2])
            n = [len(x[2]) for x in held]
            hashes = np.concatenate([x[2] for x in held])
            second = np.concatenate([x[3] for x in held])
            doc = np.repeat(np.array([x[0] for x in held], np.int64), n)
            tag = np.repeat(np.array([x[1] for x in held], np.uint64), n)
            start = np.concatenate([np.arange(k) for k in n])
            order = np.argsort(hashes, kind="stable")
            new = np.ones(len(order), bool)
            new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (second[order[1:]] != second[order[:-1]])
            lead = order[new][np.cumsum(new) - 1]  # the first place of each one's hash
            later = (doc[order] > doc[lead]) | (doc[order] == doc[lead]) & (start[order] > start[lead])
            out = [(-1 - block, blob, b"") for block, blob in by_block(doc[order[later]], tag[order[later]], start[order[later]], blocks)]
            keep = np.sort(order[~later])
            bucket = bucket_of(second[keep], buckets)
            # places of rows under one id run into each other only where ids repeat
            by = np.lexsort((start[keep], tag[keep], doc[keep], bucket)) if tagged else np.argsort(bucket, kind="stable")
            keep, bucket = keep[by], bucket[by]
            cuts = (np.flatnonzero(np.diff(bucket)) + 1).tolist() if len(keep) else []
            for a, z in zip([0, *cuts], [*cuts, len(keep)], strict=True):  # the buckets that occur, however many there are
                if z > a:
                    mine = keep[a:z]
                    out.append((int(bucket[a]), seal(doc[mine], tag[mine], start[mine]), hashes[mine].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], names=["bucket", "places", "hashes"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h, second = window_hashes(text.split(), window, memory)
                if len(h):
                    held.append((NO_ID if doc_id is None else doc_id, text_tag(text) if tagged else 0, h, second))
                    size += len(h)
                if size >= gather:
                    yield passed_on()
                    held.clear()
                    size = 0
        if held:
            yield passed_on()

    def repeats(frame: pd.DataFrame) -> pd.DataFrame:
        key = int(frame["bucket"].iloc[0])
        if key < 0:  # what a task has settled itself goes on as it is
            return pd.DataFrame({"block": -1 - key, "places": frame["places"]})
        doc, tag, start = (np.concatenate(x) for x in zip(*map(unseal, frame["places"]), strict=True))
        hashes = np.concatenate([np.frombuffer(h, np.uint64) for h in frame["hashes"]])
        ranked = np.argsort(hashes)
        same = np.flatnonzero(hashes[ranked[1:]] == hashes[ranked[:-1]])
        many = ranked[np.union1d(same, same + 1)]
        doc, tag, start, hashes = doc[many], tag[many], start[many], hashes[many]
        order = np.lexsort((start, doc, hashes))
        doc, tag, start, hashes = doc[order], tag[order], start[order], hashes[order]
        new = np.ones(len(order), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else np.zeros(0, np.int64)
        later = (doc > doc[lead]) | (start > start[lead])
        out = list(by_block(doc[later], tag[later], start[later], blocks))
        return pd.DataFrame({"block": [x[0] for x in out], "places": [x[1] for x in out]})

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch.column(0).fill_null(int(NO_ID)).to_numpy()
            texts = [press.compress(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(block_of(ids, blocks)), pa.array(ids), pa.array(texts, pa.binary())], names=["block", "doc_id", "body"])

    def remaining(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        press = zstandard.ZstdDecompressor()
        starts: dict[tuple[int, int], np.ndarray] = {}
        if len(found):
            doc, tag, start = (np.concatenate(x) for x in zip(*map(unseal, found["places"]), strict=True))
            order = np.lexsort((start, tag, doc))
            doc, tag, start = doc[order], tag[order], start[order]
            cuts = np.flatnonzero((doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])) + 1
            starts = {(int(doc[a]), int(tag[a])): start[a:b] for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(doc)], strict=True)}
        out = []
        for doc_id, body in zip(texts["doc_id"], texts["body"], strict=True):
            text = press.decompress(body)
            words = text.split()
            spans = intervals(starts.get((doc_id, text_tag(text) if tagged else 0), np.zeros(0, np.int64)), window)
            at, kept = 0, []
            for a, b in spans:
                kept += words[at:a]
                at = b
            kept += words[at:]
            out.append((doc_id, len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "replace"), [{"first": a, "end": b} for a, b in spans]))
        return pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept", "removed"])

    body = source.select("doc_id", F.col("body").cast("binary").alias("body"))
    # a task takes a few buckets or blocks, however large the corpus is
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    windows = body.mapInArrow(places, "bucket long, places binary, hashes binary").repartition(max(least, pieces(buckets, 4)), "bucket")
    found = windows.groupBy("bucket").applyInPandas(repeats, "block long, places binary")
    texts = body.mapInArrow(closed, "block long, doc_id long, body binary")
    parts = max(least, pieces(blocks, 8))
    done = texts.repartition(parts, "block").groupBy("block").cogroup(found.repartition(parts, "block").groupBy("block")).applyInPandas(remaining, "doc_id long, n_words long, n_removed long, kept string, removed array<struct<first:long,end:long>>")
    return done.withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(int(NO_ID))))
