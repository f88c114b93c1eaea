"""Language identification by Bayesian fusion of evidence.

    log posterior = text likelihood + declared language + prior of the host + constant

* Text likelihood: byte trigrams under a smoothed multinomial for each language, tempered so that neighbouring trigrams
  of one long text do not count as independent: at most `EFFECTIVE` of them, at the text's mean.  The model is fitted on
  a bounded sample for every label that occurs (`per_language`, `longest`), in two halves: each judges the texts of the
  other, so that a declaration does not count a second time through the model.  All else covers all rows, whole texts.
* Declared language (markup attribute or metadata): right with probability `RELIABILITY`, else any other language.
* Host prior: expected language counts by grouped aggregation of text posteriors over all rows, smoothed hierarchically:
  the host's counts towards its address suffix's prior, that towards the prior of all rows.  A row's own posterior is
  taken out of its host's counts, so that no evidence counts twice.

Counts meet map-side, so a host with a third of all rows is one row a task.  Texts are never shuffled unless the table of
hosts outgrows what the planner broadcasts by its measured size; they are read twice instead.

Defined results for odd input
* null text counts as empty; a text without letters is rejected with the language ``und`` and probability 0;
* a null host or suffix is one of its own; a null or unknown declared language is no evidence;
* rows repeated count each; a null id is carried along; very long texts are read whole;
* without labelled rows, as in an empty table, every row is rejected as ``und``;
* other columns are carried along; columns that the operator adds replace those of the same name.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import durable, fresh

BUCKETS = 1 << 16
EFFECTIVE = 120
RELIABILITY = 0.9
STRENGTH = 20.0
ACCEPT = 0.6
#: Characters of a text that tell its fold, and that a training text may have.
LONGEST = 20_000
#: Languages with fewer training texts are not halved.
TOO_FEW = 40
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Trigrams of digits, blanks and marks tell nothing about language.
LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


@dataclass
class LanguageModel:
    languages: list[str]
    tables: list[np.ndarray]  # for each fold [BUCKETS, languages]: log probabilities, fitted without the fold's texts

    def likelihood(self, text: str | None) -> np.ndarray:
        """Tempered log likelihoods of a whole text; zeros where it has no letters."""
        x = trigrams(text)
        if not len(x):
            return np.zeros(len(self.languages))
        table = self.tables[fold_of(text)]
        total = np.zeros(len(self.languages))
        for at in range(0, len(x), 1 << 20):
            total += table[x[at : at + (1 << 20)]].sum(axis=0, dtype=np.float64)
        return total / len(x) * min(len(x), EFFECTIVE)


def fold_of(text: str) -> int:
    """The half that a text belongs to, told by its beginning."""
    return zlib.crc32(text[:LONGEST].encode("utf-8", "surrogatepass")) & 1


def trigrams(text: str | None) -> np.ndarray:
    """Buckets of all byte trigrams that hold two letters at least."""
    b = np.frombuffer((" " + (text or "") + " ").encode("utf-8", "replace").translate(LOWER), np.uint8)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    letters = LETTER[b]
    good = letters[:-2].astype(np.int8) + letters[1:-1] + letters[2:] >= 2
    code = b[:-2].astype(np.uint32) << 16 | b[1:-1].astype(np.uint32) << 8 | b[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(16))[good].astype(np.int64)


def fit(rows: list[tuple[str, str]]) -> LanguageModel:
    """From (text, language) pairs: add-half smoothing towards the buckets of all languages together.

    Each fold's table is fitted on the other fold's texts, so that no text is judged by what its own label has taught;
    a language with too few texts to be halved (`TOO_FEW`) teaches both.
    """
    languages = sorted({lang for _, lang in rows})
    place = {lang: i for i, lang in enumerate(languages)}
    counts = np.zeros((2, BUCKETS, len(languages)))
    for text, lang in rows:
        counts[1 - fold_of(text), :, place[lang]] += np.bincount(trigrams(text), minlength=BUCKETS)
    many = Counter(lang for _, lang in rows)
    few = [place[lang] for lang in languages if many[lang] < TOO_FEW]
    counts[:, :, few] = counts[:, :, few].sum(axis=0)
    weight, tables = 2000.0, []
    for own in counts if languages else []:
        pooled = (own.sum(axis=1, keepdims=True) + 0.5) / (own.sum() + 0.5 * BUCKETS)
        tables.append(np.log((own + weight * pooled) / (own.sum(axis=0, keepdims=True) + weight)).astype(np.float32))
    return LanguageModel(languages, tables)


def sampled(labelled: DataFrame, text_col: str, label_col: str, per_language: int = 400, longest: int = LONGEST) -> list[tuple[str, str]]:
    """At most so many distinct texts for each language that occurs, chosen by hash.

    Texts of bounded length are taken whole; a language that has too few of them gets the beginnings of its longer ones.
    """
    text, label = F.col(text_col), F.col(label_col)
    rows = labelled.filter(label.isNotNull() & (F.length(text) > 0)).select(F.substring(text, 1, longest).alias("t"), label.alias("l"), (F.length(text) > longest).alias("long"))
    grain = 1 << 30
    rows = rows.withColumn("h", F.pmod(F.xxhash64("t"), F.lit(grain)))
    # copies of a text share its hash, so distinct texts are counted; about 1.3 times what is wanted passes
    sizes = rows.groupBy("l").agg(*[F.approx_count_distinct(F.when(F.col("long") == x, F.col("h"))).alias(n) for n, x in (("whole", False), ("cut", True))])
    share = lambda n: F.lit(1.3 * per_language * grain) / F.greatest(F.col(n), F.lit(1))
    sizes = sizes.select("l", share("whole").alias("whole"), F.when(F.col("whole") < per_language, share("cut")).otherwise(0.0).alias("cut"))
    chosen = rows.join(F.broadcast(sizes), "l").filter(F.col("h") < F.when(F.col("long"), F.col("cut")).otherwise(F.col("whole")))
    place = F.row_number().over(Window.partitionBy("l").orderBy("long", "h", "t"))
    found = chosen.select("l", "t", "long", "h").distinct().withColumn("place", place).filter(F.col("place") <= per_language).collect()
    return [(r["t"], r["l"]) for r in sorted(found, key=lambda r: (r["l"], r["place"]))]


def softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    powers = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, y: a + y))


def scorer(model: LanguageModel) -> Callable[[Column], Column]:
    """Of a text column: tempered log likelihoods, and the posterior that they give alone, in the model's order."""

    def score(texts: pd.Series) -> pd.DataFrame:
        logs = np.array([model.likelihood(t) for t in texts]).reshape(len(texts), -1)
        own = np.exp(logs - logs.max(axis=1, keepdims=True))
        return pd.DataFrame({"logs": list(logs), "own": list(own / own.sum(axis=1, keepdims=True))})

    return F.pandas_udf(score, "logs array<double>, own array<double>")


def summed(columns: int, of: str = "p") -> list[Column]:
    return [F.sum(F.col(of)[i]).alias(f"s{i}") for i in range(columns)]


def smoothed(counts: Column, n: Column, parent: Column, strength: float) -> Column:
    return F.zip_with(counts, parent, lambda c, p: (c + strength * p) / (n + strength))


def host_priors(evidence: DataFrame, k: int, strength: float = STRENGTH) -> DataFrame:
    """``host, suffix, n, counts, parent``: expected language counts of each host, and its suffix's smoothed prior."""
    hosts = evidence.groupBy("host", "suffix").agg(F.count(F.lit(1)).alias("n"), *summed(k))
    hosts = durable(hosts.select("host", "suffix", "n", F.array(*[f"s{i}" for i in range(k)]).alias("counts")))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("m"), *summed(k, "counts"))
    whole = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), *[F.coalesce(F.sum(F.col("counts")[i]), F.lit(0.0)) for i in range(k)]).first()  # one number a language
    top = F.array(*[F.lit((c + 1.0 / k) / (whole[0] + 1.0)) for c in whole[1:]])
    parents = suffixes.select("suffix", smoothed(F.array(*[f"s{i}" for i in range(k)]), F.col("m"), top, strength).alias("parent"))
    return hosts.join(parents, "suffix").select("host", "suffix", "n", "counts", "parent")


ADDED = ("language", "probability", "accepted", "text_language", "evidence")


def identified(rows: DataFrame, model: LanguageModel, text_col: str = "text", declared: Column | None = None, host: Column | None = None, suffix: Column | None = None, reliability: float = RELIABILITY, strength: float = STRENGTH, accept: float = ACCEPT) -> DataFrame:
    """The input's columns, ``language``, ``probability``, ``accepted``, ``text_language`` (by the text alone) and
    ``evidence``: the log terms of the chosen language for text, declaration and host."""
    rows = rows.drop(*ADDED)
    k = len(model.languages)
    if not k:
        nothing = F.struct(*[F.lit(0.0).alias(x) for x in ("text", "declared", "host")])
        return rows.select("*", F.lit("und").alias("language"), F.lit(0.0).alias("probability"), F.lit(False).alias("accepted"), F.lit("und").alias("text_language"), nothing.alias("evidence"))
    blank = F.lit("")
    host = F.coalesce(host, blank) if host is not None else blank
    suffix = F.coalesce(suffix, blank) if suffix is not None else blank
    said = declared if declared is not None else F.lit(None).cast("string")
    names = F.array(*[F.lit(x) for x in model.languages])
    has_letters = F.coalesce(F.col(text_col), blank).rlike("[A-Za-z\\x{80}-\\x{10FFFF}]")
    # the input's columns go by number, so that none can clash with the operator's own
    carried = {c: f"c{i}" for i, c in enumerate(rows.columns)}
    text = F.col(carried[text_col])
    base = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in carried.items()], host.alias("host"), suffix.alias("suffix"), F.when(F.array_contains(names, said), said).alias("said"), has_letters.alias("ok"))
    score = scorer(model)
    priors = durable(host_priors(base.filter("ok").select("host", "suffix", score(text)["own"].alias("p")), k, strength))
    scored = base.join(priors, ["host", "suffix"], "left").withColumn("score", score(text)).withColumn("text", F.col("score")["logs"]).withColumn("own", F.col("score")["own"])
    flat = F.array(*[F.lit(1.0 / k) for _ in range(k)])
    others = F.zip_with("counts", "own", lambda c, o: F.greatest(c - o, F.lit(0.0)))
    scored = scored.withColumn("prior", F.when(F.col("n").isNull(), flat).otherwise(smoothed(others, F.col("n") - 1, F.col("parent"), strength)))
    told = F.transform(names, lambda x: F.when(F.col("said").isNull(), 0.0).when(x == F.col("said"), float(np.log(reliability))).otherwise(float(np.log((1 - reliability) / max(1, k - 1)))))
    scored = scored.withColumn("told", told).withColumn("logp", F.transform("prior", lambda p: F.log(F.greatest(p, F.lit(1e-12)))))
    scored = scored.withColumn("post", softmax(F.zip_with(F.zip_with("text", "told", lambda a, b: a + b), "logp", lambda a, b: a + b)))
    scored = scored.withColumn("best", F.array_position("post", F.array_max("post")).cast("int"))
    ok = F.col("ok")
    return scored.select(
        *[F.col(n).alias(c) for c, n in carried.items()],
        F.when(ok, F.element_at(names, F.col("best"))).otherwise("und").alias("language"),
        F.when(ok, F.array_max("post")).otherwise(0.0).alias("probability"),
        (ok & (F.array_max("post") >= accept)).alias("accepted"),
        F.when(ok, F.element_at(names, F.array_position("own", F.array_max("own")).cast("int"))).otherwise("und").alias("text_language"),
        F.struct(*[F.element_at(c, F.col("best")).alias(n) for n, c in (("text", "text"), ("declared", "told"), ("host", "logp"))]).alias("evidence"),
    )


def identified_documents(docs: DataFrame, **options) -> DataFrame:
    """Documents: the source stands for the host, what follows its last dot for the suffix; ``lang`` is what was declared."""
    model = fit(sampled(docs, "text", "lang"))
    return identified(docs, model, declared=F.col("lang"), host=F.col("source"), suffix=F.regexp_extract("source", r"\.([^./]+)/?$", 1), **options)


def identified_pages(pages: DataFrame, model: LanguageModel, html_col: str = "html", url_col: str = "url", **options) -> DataFrame:
    """Pages: the markup's language, the address's last label as suffix, and the host; tags are no text."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    markup = F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-z]{2,3})", 1)), F.lit(""))
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", " ")
    (body,) = fresh(pages, "body")
    return identified(pages.withColumn(body, text), model, text_col=body, declared=markup, host=host, suffix=F.regexp_extract(host, r"([^.]*)$", 1), **options).drop(body)
