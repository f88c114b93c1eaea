import random
import re

import numpy as np
import pytest

from ledgerline.llm.language_id import fit, identified, identified_documents, identified_pages, sampled

SCHEMA = "doc_id long, text string, lang string, source string, language string, host string"
SYLLABLES = {"en": "th er ing on ed st re ion".split(), "fr": "eau ou que ment é les aux ai".split(), "de": "sch ein ung ver ü ß der ich".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def data():
    rng = random.Random(5)
    return [(i, prose(rng, lang, rng.randint(3, 80)), lang, f"src-{lang}" if i % 4 else "hub", "x", "y") for i, lang in enumerate(rng.choice(list(SYLLABLES)) for _ in range(900))]


def test_held_out_accuracy(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    model = fit(sampled(df.filter("doc_id < 600"), "text", "lang", per_language=60))
    held = df.filter("doc_id >= 600")
    from pyspark.sql import functions as F

    got = identified(held, model, host=F.col("source")).collect()
    assert len(got) == 300 and sum(r.text_language == r.lang for r in got) >= 297 and sum(r.language == r.lang for r in got) >= 297
    assert all(r.accepted for r in got if r.language == r.lang)


def test_priors_and_declarations_decide_short_texts(spark, data):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(data, SCHEMA)
    model = fit(sampled(df, "text", "lang"))
    hard = [(10_000 + i, "xyz", None, f"src-{lang}", "x", "y") for i, lang in enumerate(SYLLABLES)] + [(20_000 + i, "xyz", lang, "new", "x", "y") for i, lang in enumerate(SYLLABLES)]
    rows = df.union(spark.createDataFrame(hard, SCHEMA))
    got = {r.doc_id: r for r in identified(rows, model, declared=F.col("lang"), host=F.col("source")).collect()}
    assert [got[10_000 + i].language for i in range(3)] == list(SYLLABLES)
    assert [got[20_000 + i].language for i in range(3)] == list(SYLLABLES)


def test_a_row_is_not_its_own_evidence(spark, data):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(data, SCHEMA)
    model = fit(sampled(df, "text", "lang"))
    alone = spark.createDataFrame([(1, data[0][1], None, "only", "x", "y")], SCHEMA)
    row = identified(alone, model, host=F.col("source")).first()
    top = identified(alone.unionByName(alone), model, host=F.col("source")).first()
    assert row.evidence.host <= top.evidence.host


def test_pages(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    model = fit(sampled(df, "text", "lang"))
    pages = [(i, f"https://{lang}.example.{'fr' if lang == 'fr' else 'org'}/x", f"<html lang='{lang}'><script>var th = 1</script><p>{prose(random.Random(i), lang, 20)}</p></html>") for i, lang in enumerate(list(SYLLABLES) * 8)]
    got = identified_pages(spark.createDataFrame([*pages, (99, None, None)], "page_id long, url string, html string"), model).orderBy("page_id").collect()
    assert [r.language for r in got[:-1]] == list(SYLLABLES) * 8 and got[-1].language == "und" and not got[-1].accepted


def test_odd_input(spark, data):
    odd = [(None, None, None, None, "x", "y"), (1, "", "en", "hub", "x", "y"), (2, "123 !!", "zz", None, "x", "y"), (3, "the " * 200_000, None, "hub", "x", "y"), (3, "the", None, "hub", "x", "y"), (3, "the", None, "hub", "x", "y")]
    got = identified_documents(spark.createDataFrame(data + odd, SCHEMA)).collect()
    assert len(got) == len(data) + len(odd)
    assert all(r.language == "und" and not r.accepted and r.probability == 0 for r in got if r.text in (None, "", "123 !!"))
    assert identified_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r.language for r in identified_documents(spark.createDataFrame(odd[:1], SCHEMA)).collect()] == ["und"]


def test_every_language_is_sampled(spark):
    rng = random.Random(2)
    copies = [(i, "the same text again", "en", "hub", "x", "y") for i in range(3000)] + [(4000 + i, prose(rng, "en", 20), "en", "hub", "x", "y") for i in range(30)]
    rare = [(5000 + i, f"rare {i} " + prose(rng, "fr", 10), f"l{i:02}", "hub", "x", "y") for i in range(70)]
    long = [(6000 + i, prose(rng, "de", 9000)[: 20_001 + i], "de", "hub", "x", "y") for i in range(3)]
    got = sampled(spark.createDataFrame(copies + rare + long, SCHEMA), "text", "lang", per_language=20)
    count = {lang: sum(x == lang for _, x in got) for lang in {x for _, x in got}}
    assert len(set(got)) == len(got) and set(count) == {"en", "de", *(f"l{i:02}" for i in range(70))}
    assert count["en"] == 20 and count["de"] == 3 and all(len(t) <= 20_000 for t, _ in got)


def brute(rows, model, reliability=0.9, strength=20.0):
    """Posteriors straight from the definition, row by row."""
    k = len(model.languages)

    def soft(x):
        e = np.exp(x - x.max())
        return e / e.sum()

    ok = [bool(re.search("[A-Za-z\x80-\U0010FFFF]", t or "")) for t, _, _, _ in rows]
    logs = [model.likelihood(t) for t, _, _, _ in rows]
    own = [soft(x) for x in logs]
    whole = (sum(o for o, y in zip(own, ok, strict=True) if y) + 1 / k) / (sum(ok) + 1)
    out = []
    for i, (_, said, host, suffix) in enumerate(rows):
        if not ok[i]:
            out.append(("und", 0.0))
            continue
        family = [o for o, y, r in zip(own, ok, rows, strict=True) if y and r[3] == suffix]
        parent = (sum(family) + strength * whole) / (len(family) + strength)
        mine = [o for j, (o, y, r) in enumerate(zip(own, ok, rows, strict=True)) if y and r[2:] == (host, suffix) and j != i]
        prior = (sum(mine, np.zeros(k)) + strength * parent) / (len(mine) + strength)
        told = np.array([0.0 if said not in model.languages else np.log(reliability if x == said else (1 - reliability) / (k - 1)) for x in model.languages])
        post = soft(logs[i] + told + np.log(np.maximum(prior, 1e-12)))
        out.append((model.languages[int(post.argmax())], float(post.max())))
    return out


def test_posteriors_against_brute_force(spark, data):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    model = fit(sampled(spark.createDataFrame(data, SCHEMA), "text", "lang"))
    rows = [(prose(rng, rng.choice("en fr de".split()), rng.randint(1, 4)) if i % 9 else "12", rng.choice(["en", "fr", "de", "xx", None]), rng.choice(["a.fr", "b.fr", "c.de", ""]), rng.choice(["fr", "de"])) for i in range(120)]
    df = spark.createDataFrame([(i, *r, "u", i) for i, r in enumerate(rows)], "id long, text string, d string, h string, s string, _n string, post long")
    got = identified(df, model, declared=F.col("d"), host=F.col("h"), suffix=F.col("s")).orderBy("id").collect()
    want = brute(rows, model)
    assert [r.language for r in got] == [x for x, _ in want]
    assert all(abs(r.probability - p) < 1e-6 for r, (_, p) in zip(got, want, strict=True))


def test_columns_of_clashing_names_are_carried(spark, data):
    names = "_text _n _host _counts _suffix host suffix n counts parent c0 c1 said ok score text_".split()
    df = spark.createDataFrame([(*r[:4], *(f"{c}{i}" for c in names)) for i, r in enumerate(data[:60])], "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in names))
    got = identified_documents(df).collect()
    assert len(got) == 60 and all(r[c] == f"{c}{r.doc_id}" for r in got for c in names)


def test_no_text_is_judged_by_its_own_label(spark):
    rng = random.Random(6)
    rows = [(prose(rng, lang, 30), lang) for lang in ("en", "fr") for _ in range(60)]
    plain, wrong = fit(rows), fit([(t, "fr" if i == 3 else lang) for i, (t, lang) in enumerate(rows)])
    assert (plain.likelihood(rows[3][0]) == wrong.likelihood(rows[3][0])).all()
