"""Near-duplicates by SimHash fingerprints and multi-index hashing.

Fingerprints: one bit is set where over half of the shingles' XXH64 values (seed 42) have it.  Texts with one fingerprint
are one vertex, so copies never meet each other.  Multi-index hashing: fingerprints that differ in at most d bits differ
in at most floor(d / s) bits of one of s segments.  The table holds each fingerprint under each segment's value; a
fingerprint looks up every value of the Hamming ball of that radius around its own segment (both sides share the radius
where it is 2), and what it finds is verified by the whole distance.  Look-ups and table rows of one value lie in one
sorted run; a run gives the edges of a spanning forest of its links, never all its pairs, and is compared in blocks, so
its memory is that of its fingerprints.  Where links must also have a Jaccard similarity, sets of sizes that rule it out
are not compared.

Defined results for odd input
* null text and text without words have the fingerprint zero and are linked like any other;
* text of fewer words than a shingle has is one shingle; very long texts are read whole;
* a null id: the row has its fingerprint and its component's least id (null where all its ids are null);
* repeated rows have the same component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import durable, pieces, spread
from ledgerline.llm.components import components, with_group, with_least
from ledgerline.llm.exact_dedup import content_hash

WORD = 64
SEED = 42
#: Fingerprints of a task, about.
TASK_ROWS = 50_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text, A-Z in lower case; bytes.split() cuts at exactly these six characters."""
    return text.translate(LOWER).split()


def shingle_spans(text: bytes, size: int) -> list[bytes]:
    """Every shingle, repeats included; fewer words than one has are one."""
    words = words_of(text)
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= size:
        return [line]
    at, starts = 0, []
    for w in words:
        starts.append(at)
        at += len(w) + 1
    return [line[a : b - 1] for a, b in zip(starts, starts[size:] + [at], strict=False)]


def shingle_hashes(text: bytes, size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle, repeats included."""
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(x, seed) for x in shingle_spans(text, size)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that over half of the hashes have; zero of none."""
    if not len(hashes):
        return 0
    counts = np.zeros(WORD, np.int64)
    for at in range(0, len(hashes), 65536):
        block = hashes[at : at + 65536]
        counts += np.unpackbits(block.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


#: Odd numbers that make further hashes of a shingle from its first; word i > 0 of a fingerprint uses the i-th.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


def further(hashes: np.ndarray, i: int) -> np.ndarray:
    """The i-th hash of each shingle, from the first by xor-shifts and products."""
    if not i:
        return hashes
    x = (hashes ^ np.uint64(MIX[(i - 1) % len(MIX)] * (2 * i - 1) % (1 << 64))) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(29)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, words: int = 1, text_key: bool = False, sets: bool = False) -> DataFrame:
    """``doc_id, fp, size``: the fingerprint as an array of signed 64-bit words, the first of them made with the seed 42.

    With `sets` every shingle counts once and ``size`` is their number, else 0.  With `text_key` also that column: the
    content hash that the input carries under this name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, size = np.zeros((batch.num_rows, words), np.uint64), np.zeros(batch.num_rows, np.int64)
            for row, text in enumerate(batch.column(1).to_pylist()):
                hashes = shingle_hashes(text or b"", shingle)
                if sets:
                    hashes = np.unique(hashes)
                    size[row] = len(hashes)
                for i in range(words):
                    prints[row, i] = fingerprint(further(hashes, i))
            values = pa.array(prints.view(np.int64).reshape(-1))
            fp = pa.FixedSizeListArray.from_arrays(values, words).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), fp, pa.array(size), *batch.columns[2:]], names=["doc_id", "fp", "size", *more])

    more = ["text_key"] if text_key else []
    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("body"), *more]
    return docs.select(*columns).mapInArrow(run, "doc_id long, fp array<long>, size long" + ", text_key binary" * text_key)


def segment_count(bits: int, distance: int) -> int:
    """As few segments as keep the radius within 1 or, for wide prints, 2: then nothing within the distance is missed."""
    return -(-(distance + 1) // (2 if bits == WORD else 3))


def segments(bits: int, count: int) -> list[tuple[int, int, int]]:
    """(word, shift, width) of so many segments, or a few more; a segment lies in one word of the fingerprint."""
    words = bits // WORD
    each = -(-max(1, count) // words)
    cuts = [i * WORD // each for i in range(each + 1)]
    return [(w, a, b - a) for w in range(words) for a, b in zip(cuts, cuts[1:], strict=False)]


def ball(width: int, radius: int) -> list[int]:
    """All masks of at most `radius` set bits within `width`."""
    masks = [0]
    for _ in range(radius):
        masks = sorted({m | 1 << b for m in masks for b in range(width)} | set(masks))
    return masks


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints; their words lie on the last axis."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def alike(small: np.ndarray, large: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes can have the similarity; always where sizes are not known."""
    return small >= similarity * large - 1e-9


def run_edges(vertex: np.ndarray, prints: np.ndarray, held: np.ndarray, size: np.ndarray, distance: int, similarity: float, block: int = 256) -> list[tuple[int, int]]:
    """Spanning forest of the links between the rows of one run: vertices, their fingerprints, which of them are table
    rows, and their sizes."""
    ids, first, inverse = np.unique(vertex, return_index=True, return_inverse=True)
    table = np.zeros(len(ids), bool)
    np.logical_or.at(table, inverse, held)
    order = np.argsort(size[first], kind="stable")
    ids, prints, table, size = ids[order], prints[first][order], table[order], size[first][order]
    targets = np.flatnonzero(table)
    label = np.arange(len(ids))
    edges = []
    for at in range(0, len(ids), block):
        end = min(at + block, len(ids))
        # sizes that some row of the block allows
        fit = targets[alike(size[targets], size[at], similarity) & alike(size[end - 1], size[targets], similarity)]
        near = apart(prints[at:end, None], prints[None, fit]) <= distance
        near &= alike(np.minimum(size[at:end, None], size[None, fit]), np.maximum(size[at:end, None], size[None, fit]), similarity)
        for i in np.flatnonzero(near.any(axis=1)):
            me, linked = at + int(i), fit[near[i]]
            others, spot = np.unique(label[linked], return_index=True)
            for other, k in zip(others.tolist(), spot.tolist(), strict=True):
                mine = int(label[me])
                if mine != other:
                    edges.append((int(ids[me]), int(ids[linked[k]])))
                    label[label == max(mine, other)] = min(mine, other)
    return edges


#: Runs up to this length are compared side by side, many at once, longer ones in blocks.
SHORT_RUN = 256


def short_edges(starts: np.ndarray, ends: np.ndarray, vertex: np.ndarray, prints: np.ndarray, held: np.ndarray, size: np.ndarray, distance: int, similarity: float) -> np.ndarray:
    """Edges of many short runs: rows are compared with those 1, 2, ... places on, while these are not too large.

    The rows of a run ascend by size.  A run with more links than rows gives the edges of a spanning forest instead.
    """
    run = np.repeat(np.arange(len(starts)), ends - starts)
    here = np.concatenate([np.arange(a, b) for a, b in zip(starts, ends, strict=True)] or [np.zeros(0, int)])
    stop = np.repeat(ends, ends - starts)
    pairs, of, step = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)], 1
    while len(here):
        more = here + step < stop
        more[more] = alike(size[here[more]], size[here[more] + step], similarity)
        here, stop, run = here[more], stop[more], run[more]
        near = (held[here] | held[here + step]) & (vertex[here] != vertex[here + step])
        near[near] = apart(prints[here[near]], prints[here[near] + step]) <= distance
        pairs.append(np.stack((vertex[here[near]], vertex[here[near] + step]), axis=1))
        of.append(run[near])
        step += 1
    links, of = np.concatenate(pairs), np.concatenate(of)
    dense = np.bincount(of, minlength=len(starts)) > ends - starts
    out = [links[~dense[of]]]
    for a, b in zip(starts[dense], ends[dense], strict=True):
        out.append(np.array(run_edges(vertex[a:b], prints[a:b], held[a:b], size[a:b], distance, similarity), np.int64).reshape(-1, 2))
    return np.unique(np.sort(np.concatenate(out), axis=1), axis=0)


def links(vertices: DataFrame, bits: int = WORD, distance: int = 3, count: int | None = None, similarity: float = 0.0) -> DataFrame:
    """``a, b``: edges between vertices that connect what lies within the distance and has sizes that the similarity allows.

    `vertices` has ``vertex``, ``fp`` and ``size``.  Two fingerprints that differ in r bits of a segment meet at a value
    between them: one is filed under the ball of radius r // 2 around its own, the other looks up the ball of the rest.
    With the `count` of `segment_count` nothing is missed; fewer, wider segments miss pairs near the distance and compare
    fewer that are far apart.
    """
    parts = segments(bits, count or segment_count(bits, distance))
    radius = min(distance // len(parts), 1 if bits == WORD else 2)
    small, wide = radius // 2, radius - radius // 2
    rows = None
    for s, (word, shift, width) in enumerate(parts):
        fp = F.col("fp")[word]
        value = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1)) if width < WORD else fp
        flips = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(bin(m).count("1") <= small).alias("held")) for m in ball(width, wide)])
        here = vertices.select("vertex", "fp", "size", F.lit(s).alias("segment"), value.alias("value"), F.explode(flips).alias("flip"))
        rows = here if rows is None else rows.union(here)
    rows = rows.select(F.xxhash64("segment", F.col("value").bitwiseXOR(F.col("flip.m"))).alias("key"), "vertex", F.col("size").cast("int").alias("size"), F.col("flip.held").alias("held"), *[F.col("fp")[w].alias(f"w{w}") for w in range(bits // WORD)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(key: np.ndarray, vertex: np.ndarray, size: np.ndarray, held: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
            prints = np.stack(columns, axis=1).view(np.uint64)
            cuts = np.flatnonzero(np.diff(key)) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(key)]))
            rows = ends - starts
            short = (rows > 1) & (rows <= SHORT_RUN)
            found = [short_edges(starts[short], ends[short], vertex, prints, held, size, distance, similarity)]
            for a, b in zip(starts[rows > SHORT_RUN], ends[rows > SHORT_RUN], strict=True):
                found.append(np.array(run_edges(vertex[a:b], prints[a:b], held[a:b], size[a:b], distance, similarity), np.int64).reshape(-1, 2))
            pairs = np.concatenate(found)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        def joined(chunks: list[list[np.ndarray]]) -> list[np.ndarray]:
            return [np.concatenate(x) for x in zip(*chunks, strict=True)]

        rest: list[list[np.ndarray]] = []  # chunks whose last run may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            chunk = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rest.append(chunk)
            if chunk[0][-1] == rest[0][0][0]:
                continue
            held = joined(rest)
            last = int(np.searchsorted(held[0], held[0][-1], side="left"))
            yield edges(*[c[:last] for c in held])
            rest = [[c[last:] for c in held]]
        if rest:
            yield edges(*joined(rest))

    return spread(rows, "key").sortWithinPartitions("key", "size").mapInArrow(run, "a long, b long")


def linked_prints(prints: DataFrame, bits: int, distance: int, count: int | None = None, similarity: float = 0.0) -> DataFrame:
    """``fp, size, least, component``: every fingerprint (of a size) once, its least id, and the component of its links."""
    distinct = prints.groupBy("fp", "size").agg(F.min("doc_id").alias("least"))
    parts = pieces(prints.count(), TASK_ROWS)
    vertices = durable(distinct.withColumn("vertex", F.monotonically_increasing_id()), parts)  # written, so the numbers stand
    pairs = durable(links(vertices.select("vertex", "fp", "size"), bits, distance, count, similarity).repartition(8 * parts))
    return vertices.join(components(pairs, "a", "b"), "vertex", "left").withColumn("component", F.coalesce("component", "vertex"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3, bits: int = WORD) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint`` (hex digits, a word after the other) and ``component_id``, the least id reachable."""
    prints = durable(fingerprints(docs, id_col, text_col, shingle, bits // WORD))
    classes = with_least(linked_prints(prints, bits, distance), "component", "least", "component_id").select("fp", "component_id")
    digits = F.concat_ws("", F.transform("fp", lambda w: F.lower(F.lpad(F.hex(w), 16, "0"))))
    return prints.join(classes, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def linked_sets(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set of distinct values the first one that links of this Jaccard similarity, or more, lead to.

    Two such sets share one of their rarest values (prefix filter), so only sets that meet there and are not yet
    connected are compared, by their whole values.
    """
    seen: dict[bytes, int] = {}
    label = np.array([seen.setdefault(s.tobytes(), i) for i, s in enumerate(sets)], np.int64)
    own = np.array([i for i in seen.values() if len(sets[i])], np.int64)
    if len(own) < 2:
        return label
    size = np.array([len(sets[i]) for i in own])
    _, inverse, count = np.unique(np.concatenate([sets[i] for i in own]), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    ranked = [np.sort(x) for x in np.split(rank[inverse], np.cumsum(size)[:-1])]
    prefix = size - np.ceil(size * similarity - 1e-9).astype(np.int64) + 1
    value, owner = np.concatenate([x[:p] for x, p in zip(ranked, prefix, strict=True)]), np.repeat(np.arange(len(own)), prefix)
    order = np.lexsort((owner, value))
    holders, place = owner[order], np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    begin = np.searchsorted(value[order], value)
    root, met = np.arange(len(own)), np.full(len(own), -1)
    for e in np.flatnonzero(place > begin).tolist():
        me = int(owner[e])
        others = holders[begin[e] : place[e]]
        others = others[(root[others] != root[me]) & (met[others] != me)]
        met[others] = me
        for other in others[np.minimum(size[others], size[me]) >= similarity * np.maximum(size[others], size[me]) - 1e-9].tolist():
            if root[other] == root[me]:
                continue
            both = len(np.intersect1d(ranked[me], ranked[other], assume_unique=True))
            if both / (size[me] + size[other] - both) >= similarity:
                root[root == max(root[me], root[other])] = min(root[me], root[other])
    first = np.arange(len(sets))
    first[own] = own[root]
    return first[label]


#: Texts and shingles of a block of a component; a task compares two blocks.
BLOCK_TEXTS = 512
BLOCK_SHINGLES = 2_000_000


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, distance: int = 29, bits: int = 128, similarity: float = 0.8, count: int = 8, block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """One row per input row: ``doc_id, text_key`` (the text's hash), ``component_id``, the least id reachable, and
    ``component_key``, the text that has it (of several the one with the least hash).

    Links join texts whose sets of shingles have this Jaccard similarity or more.  Fingerprints within the distance only
    name the candidates: each component of these is cut into blocks of bounded size, every two blocks meet in one task as
    hashes of shingles, and all that may link is compared there.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body")).withColumn("text_key", content_hash("body"))
    prints = durable(fingerprints(keyed, "doc_id", "body", shingle, bits // WORD, text_key=True, sets=True))
    texts = prints.groupBy("text_key").agg(F.first("fp").alias("fp"), F.first("size").alias("size"), F.min("doc_id").alias("least"))
    candidates = linked_prints(prints, bits, distance, count, similarity).select("fp", "size", "component")
    texts = durable(texts.join(candidates, ["fp", "size"]).select(F.monotonically_increasing_id().alias("vertex"), "text_key", "least", "size", "component"))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / block_texts, F.sum("size") / BLOCK_SHINGLES)).cast("int")
    crowded = texts.groupBy("component").agg(F.count(F.lit(1)).alias("n"), blocks.alias("blocks")).filter("n > 1").select("component", "blocks")
    # written, so that the planner knows its size and shuffles the texts only where it is large
    close = durable(with_group(texts, crowded, "component").select(F.col("text_key").alias("key"), "least", "vertex", "component", F.greatest("blocks", F.lit(1)).alias("blocks")))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [np.unique(shingle_hashes(x, shingle)).tobytes() for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(blobs, pa.binary())], names=["component", "blocks", "vertex", "shingles"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(meetings: list[tuple[bool, list[int], list[bytes]]]) -> pa.RecordBatch:
            out: list[list] = [[], [], []]
            for whole, vertices, blobs in meetings:
                first = linked_sets([np.frombuffer(x, np.uint64) for x in blobs], similarity).tolist()
                out[0] += vertices
                out[1] += [vertices[f] for f in first]
                out[2] += [whole] * len(vertices)
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_())], names=["vertex", "other", "whole"])

        now, mine = None, (True, [], [])
        for batch in batches:
            done = []
            for component, low, high, blocks, vertex, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (component, low, high) != now:
                    done.append(mine)
                    now, mine = (component, low, high), (blocks == 1, [], [])
                mine[1].append(vertex)
                mine[2].append(blob)
            yield batch_of(done)
        yield batch_of([mine])

    one = keyed.join(close, (F.col("text_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("least"))).dropDuplicates(["vertex"])
    sets = one.select("component", "blocks", "vertex", F.col("body").cast("binary").alias("body")).mapInArrow(shingled, "component long, blocks int, vertex long, shingles binary")
    mine = F.pmod(F.xxhash64("vertex"), F.col("blocks")).cast("int")
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_except(F.sequence(F.lit(0), F.col("blocks") - 1), F.array("mine")))
    met = sets.withColumn("mine", mine).withColumn("other", F.explode(others))
    met = met.select("component", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "blocks", "vertex", "shingles")
    found = durable(spread(met, "component", "low", "high").sortWithinPartitions("component", "low", "high", "vertex").mapInArrow(compared, "vertex long, other long, whole boolean"))
    across = components(found.filter("not whole and vertex <> other"), "vertex", "other")
    classes = found.filter("whole").select("vertex", F.col("other").alias("class")).union(across.select("vertex", F.col("component").alias("class")))
    named = texts.select("vertex", "text_key", F.struct(F.col("least").isNull().alias("no"), "least", "text_key").alias("best")).join(classes, "vertex", "left").withColumn("class", F.coalesce("class", "vertex"))
    classes = with_least(named, "class", "best", "chosen").select("text_key", F.col("chosen.least").alias("component_id"), F.col("chosen.text_key").alias("component_key"))
    return prints.select("doc_id", "text_key").join(classes, "text_key").select("doc_id", "text_key", "component_id", "component_key")
