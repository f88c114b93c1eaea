import random

import corpus_pipeline
from ledgerline.llm.packing import packed
from ledgerline.llm.queries import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_act_on_what_the_last_one_kept(spark, tmp_path):
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice(["th", "er", "ing", "on", "ed"]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    base = [(i, prose(rng.randint(80, 300)), "en", f"s{i % 3}") for i in range(60)]
    rows = base + [(100 + i, base[i][1], "en", "s0") for i in range(10)] + [(200, "", "en", "s0"), (201, "12 34", "en", "s0"), (202, None, None, None)]
    words = base[5][1].split()
    rows.append((300, " ".join([*words[:40], "changed", *words[41:]]), "en", "s1"))
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        path = str(tmp_path / name)
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == before.columns
    ids = {n: sorted(r.doc_id for r in d.select("doc_id").collect()) for n, d in seen.items()}
    assert not {200, 201, 202} & set(ids["language ID"]) and len(ids["language ID"]) == 71
    assert ids["exact dedup"] == [*range(60), 300]
    assert ids["SimHash near-dedup"] == [*range(60)]
    assert set(ids["mixing sources"]) <= set(range(60))
    want = packed(seen["mixing sources"], tokenizer_file())
    key = lambda d: sorted(tuple(r) for r in d.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect())
    assert key(seen["packing"]) == key(want)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0


def test_texts_under_one_id_are_documents_of_their_own(spark):
    rng = random.Random(4)
    a, b, c = (" ".join(f"w{rng.randint(0, 9000)}" for _ in range(200)) for _ in range(3))
    rows = [(1, a), (1, a), (1, b), (2, b), (3, c), (0, c), (3, a + " more"), (3, b[:40])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    once = corpus_pipeline.drop_copies(spark, docs, "")
    assert sorted((r.doc_id, r.text) for r in once.collect()) == sorted([(0, c), (1, a), (1, b), (3, a + " more"), (3, b[:40])])
    near = spark.createDataFrame([*once.collect(), (1, a + " end", "en", "s", 1)], SCHEMA)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, near, "").collect()]
    assert len(kept) == 4 and {(0, c), (1, b), (3, b[:40])} < set(kept) and {t for i, t in kept if i == 1} - {b} <= {a, a + " end"}


def brute_components(texts, similar):
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if similar(texts[i], texts[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return [find(i) for i in range(len(texts))]


def shingles(text):
    words = text.translate({c: c + 32 for c in range(65, 91)}).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_deduplication_stages_against_brute_force(spark):
    """Repeated ids of differing texts, null ids, clashing columns, very long and empty texts; rows are counted whole."""
    rng = random.Random(21)
    word = lambda: f"w{rng.randint(0, 50_000)}"
    base = [" ".join(word() for _ in range(rng.randint(6, 150))) for _ in range(40)] + [" ".join(word() for _ in range(30_000)), "", "one", "One"]
    rows = []
    for n in range(260):
        text = rng.choice(base)
        if rng.random() < 0.5 and text:
            words = text.split()
            words[rng.randrange(len(words))] = word()
            text = " ".join(words)
        rows.append((rng.choice([None, *range(60)]), text if rng.random() < 0.97 else None))
    rows += rows[:30]
    names = "_key key doc_key text_key component_id copies rate copy language accepted h".split()
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in names)
    docs = spark.createDataFrame([(i, t, "en", "s", *[f"{c}:{i}" for c in names]) for i, t in rows], schema)
    out = corpus_pipeline.drop_copies(spark, docs, "")
    assert out.columns == docs.columns
    got = out.collect()
    assert all(r[c] == f"{c}:{r.doc_id}" for r in got for c in names)
    least = {}
    for i, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    want = sorted((i, t) for t, i in least.items())
    assert sorted((r.doc_id, r.text or "") for r in got if r.doc_id is not None) == want
    nameless = sorted(t or "" for i, t in rows if i is None)
    assert sorted(r.text or "" for r in got if r.doc_id is None) == nameless

    near = corpus_pipeline.drop_near_copies(spark, out, "")
    assert near.columns == docs.columns
    kept = near.collect()
    texts = sorted({t for _, t in want} | set(nameless))
    sets = {t: shingles(t) for t in texts}
    root = brute_components(texts, lambda a, b: not sets[a] | sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    first = {}
    for t, r in zip(texts, root, strict=True):
        if t in least:
            first[r] = min(least[t], first.get(r, least[t]))
    assert sorted(r.text or "" for r in kept if r.doc_id is None) == nameless
    mine = [(r.doc_id, r.text or "") for r in kept if r.doc_id is not None]
    by = dict(zip(texts, root, strict=True))
    # one row of each component, with its least id; which of several texts under that id is a matter of hashes
    assert sorted(by[t] for _, t in mine) == sorted(first) and all(i == first[by[t]] and least[t] == i for i, t in mine)
    assert all(r[c] == f"{c}:{r.doc_id}" for r in kept for c in names)


def test_texts_go_to_workers_in_small_batches(spark):
    import pyarrow as pa

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    seen = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"]) for b in batches)
    long = 3 << 20
    docs = spark.createDataFrame([(i, "word " * 4000, "en", "s", 20_000) for i in range(400)] + [(400, "x" * long, "en", "s", long)], SCHEMA).coalesce(1)
    try:
        for stage in (corpus_pipeline.identify_language, corpus_pipeline.drop_near_copies, corpus_pipeline.pack_sequences):
            spark.conf.set(name, before)
            stage(spark, docs, "")
            got = docs.select("text").mapInArrow(seen, "n long, size long").collect()
            assert sum(r.n for r in got) == 401 and max(r.size for r in got if r.size < long) < 2.2e6 and max(r.size for r in got) < long + 2.2e6
        spark.conf.set(name, "64k")
        corpus_pipeline.pack_sequences(spark, docs, "")
        assert spark.conf.get(name) == "64k"
    finally:
        spark.conf.set(name, before)
