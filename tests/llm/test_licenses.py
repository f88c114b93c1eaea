import random
import re

import pytest

from ledgerline.llm.license_scan import NOTICES, PHRASES, NoticeFinder, edits_allowed, license_scan, reduced, scan, seeds

SCHEMA = "doc_id long, text string, labels string, spans int"


def brute_base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [(i, label) for phrase, label in PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in found]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


TEXTS = [None, "", "...", "CC BY", "cc-by-sa 4.0", "cc by cc by", "ALL rights, reserved!", "all rights reserve", "the GNU General Public License.", "é cc by É", "accc by", "cc bye", "cc\x00by", "general public licenseé", "all rights reserved " * 500]


def test_base_against_brute_force():
    rng, finder = random.Random(2), NoticeFinder()
    pool = ["cc", "by", "CC-BY", "general", "public", "license", "all", "rights", "reserved", "é", "1", ".", "\n", "x"]
    for t in TEXTS + [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(300)]:
        row = scan(t, finder)
        assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["base_labels"]) == brute_base(t)
        assert set(filter(None, row["base_labels"].split(","))) <= set(row["labels"].split(",")) and 0 <= row["score"] <= 1


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("seed", range(4))
def test_no_notice_within_its_edits_is_lost(seed):
    rng, finder = random.Random(seed), NoticeFinder()
    for notice, label in NOTICES:
        k = edits_allowed(notice)
        for _ in range(6):
            text = list(notice)
            for _ in range(rng.randint(0, k)):
                at = rng.randrange(1, len(text) - 1)
                kind = rng.randrange(3)
                if kind == 0:
                    text[at] = rng.choice("xyz")
                elif kind == 1:
                    del text[at]
                else:
                    text.insert(at, rng.choice("xyz"))
            body = "before it " + "".join(text) + " and after"
            row = scan(body, finder)
            assert label in row["labels"].split(","), (notice, body)
            for s in row["spans"]:
                part = reduced(body)[s["first_char"] + 1 : s["end_char"] + 1]
                assert min(distance(part, n) for n, x in NOTICES if x == s["label"]) <= s["edits"]


def best_words(text, notice):
    """The least distance of the notice to a run of whole words."""
    words = text.split()
    return min((distance(" ".join(words[i:j]), notice) for i in range(len(words)) for j in range(i + 1, min(len(words), i + len(notice.split()) + 4) + 1)), default=99)


@pytest.mark.parametrize("seed", range(3))
def test_labels_against_brute_force(seed):
    rng, finder = random.Random(seed), NoticeFinder()
    short = [(n, label) for n, label in NOTICES if len(n) < 40]
    texts = ["all rights reservedness", "licensed under cc bypass", "\u00a9all rights reserved", "x all rights reservedy", "small rights reserved", "all  rights, reserved"]
    for _ in range(25):
        notice = list(rng.choice(short)[0])
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(notice))
            notice[at : at + rng.randint(0, 1)] = rng.choice(["", "q", " ", "zz"])
        texts.append(rng.choice(["", "pre ", "pre"]) + "".join(notice) + rng.choice(["", " post", "post"]))
    for text in texts:
        row = scan(text, finder)
        want = {label for n, label in NOTICES if best_words(reduced(text), n) <= edits_allowed(n)}
        assert set(filter(None, row["labels"].split(","))) - set(row["base_labels"].split(",")) <= want, text  # no false label
        assert want <= set(row["labels"].split(",")), text
        for s in row["spans"]:
            part = reduced(text)[s["first_char"] + 1 : s["end_char"] + 1]
            assert part == part.strip() and min(distance(part, n) for n, x in NOTICES if x == s["label"]) <= s["edits"]
            assert reduced(text)[s["first_char"]] == " " == reduced(text)[s["end_char"] + 1]


def test_pieces_keep_the_pigeonhole():
    for notice, _ in NOTICES:
        k = edits_allowed(notice)
        parts = seeds(notice, k)
        assert len(parts) == k + 1 and "".join(p for _, p in parts) == notice and all(notice[a:].startswith(p) for a, p in parts)


def test_rows(spark):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "cc by", "x", 1), (1, "cc by", "x", 1)], SCHEMA)
    got = license_scan(df).collect()
    assert len(got) == len(TEXTS) + 2
    assert {r.doc_id: r.n_base for r in got if r.doc_id not in (None, 1)} == {i: brute_base(t)[1] for i, t in enumerate(TEXTS) if i != 1}
    assert license_scan(spark.createDataFrame([], SCHEMA)).count() == 0
