import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerline.llm.packing import PROBES, PlainIds, WordIds, fill, pack_lengths, packed, word_ids

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
SCHEMA = "doc_id long, text string, start string, cell int"
TEXTS = ["", None, "a b", " \t\n x\u0085y z ", "don't DO 'S it's 'LL", "<|endoftext|>hi <|startoftext|>!", "é é ́a", "İstanbul ΑΣ Σ ǅ", "\x1c\x1da b\x1fc", "日本語 テスト ١٢٣ 123", "a.b... c!? d|e |", "word, word. WORD; word:", "x" * 5000, "one " * 6000]


@pytest.mark.parametrize("kept", [3, 10_000])
def test_word_by_word_equals_the_tokenizer(kept):
    ids = WordIds(PATH, kept)
    rng = random.Random(1)
    alphabet = "abzABZéÉßΣ 0'’.,;!?-|\n\t  <>"
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(300)]
    for _ in range(2):
        assert all(ids.agrees(t) for t in texts)


def test_filling_is_the_closest_there_is():
    rng = random.Random(3)
    for _ in range(200):
        lengths = [rng.randint(1, 30) for _ in range(rng.randint(1, 9))]
        counts = {x: lengths.count(x) for x in lengths}
        taken = fill(counts, 40)
        assert all(n <= counts[x] for x, n in taken) and max(lengths) in dict(taken)
        first = max(lengths)
        rest = list(lengths)
        rest.remove(first)
        sums = {0}
        for x in rest:
            sums |= {s + x for s in sums if s + x <= 40 - first}
        assert sum(x * n for x, n in taken) == first + max(sums)


@pytest.mark.parametrize(("longest", "share"), [(2048, 0.97), (1200, 0.999)])
def test_sequences_hold_everything_once(longest, share):
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, longest, 3000)
    sequence, offset = pack_lengths(lengths, 2048)
    used = np.bincount(sequence, weights=lengths)
    assert used.max() <= 2048 and lengths.sum() / (2048 * len(used)) > share
    for s in range(len(used)):
        at = 0
        for i in sorted(np.flatnonzero(sequence == s), key=lambda i: offset[i]):
            assert offset[i] == at
            at += lengths[i]


def test_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (3, "again"), (3, "again")]
    got = packed(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA), PATH, cell_docs=6).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for start in range(0, len(ids), 2048):
            part = ids[start : start + 2048]
            want[i].append((start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)))
    have, rooms = defaultdict(list), defaultdict(list)
    for r in got:
        have[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        rooms[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    for room in rooms.values():
        at = 0
        for offset, length in sorted(room):
            assert offset == at
            at += length
        assert at <= 2048
    assert packed(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_copies_are_dealt_apart(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice("the of and to in".split()) for _ in range(rng.randint(20, 120)))) for i in range(400)]
    rows = [d for d in docs for _ in range(3)] + [(None, "no id")] * 300
    rng.shuffle(rows)
    got = packed(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA), PATH, cell_docs=200).collect()
    rooms, cells = defaultdict(list), defaultdict(int)
    for r in got:
        rooms[r.sequence_id].append(r.doc_id)
        cells[r.sequence_id >> 32] += r.doc_id is None
    together = sum(len(ids) - len(set(ids)) for ids in ([i for i in room if i is not None] for room in rooms.values()))
    assert together < 0.08 * 1200 and max(cells.values()) < 120  # chance alone puts a few together


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_other_tokenizers_read_whole_texts(name):
    path = str(public_tokenizers.path(name))
    ids, whole = word_ids(path), Tokenizer.from_file(path)
    assert isinstance(ids, WordIds if name.startswith("word") else PlainIds)
    for text in [*PROBES, "Some text, of  two spaces."]:
        assert ids.encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
