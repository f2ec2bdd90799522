"""Language ID: held-out accuracy, the weight of each piece of evidence, awkward rows."""

from __future__ import annotations

import math
import time

import numpy as np
import pytest
from helpers import AWKWARD, documents
from pyspark.sql import functions as F

from recallgrid.llm import langid, queries

TEXTS = {"en": "the cat and the dog with the bird", "de": "der hund und die katze mit dem vogel"}
LABELLED = [(k, f"{TEXTS[lang]} {TEXTS[lang]}", lang, "s") for k, lang in enumerate(["en", "de"] * 10)]
PAGES = "page_id long, url string, html string"


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) > 100 and lang is not null")
    model = langid.train(docs.where("doc_id % 2 = 0"))
    rows = langid.scored(docs.where("doc_id % 2 = 1").select("doc_id", "lang", F.col("text").alias("lid_text")), model).collect()
    right = sum(model["languages"][max(range(len(r["lid_scores"])), key=r["lid_scores"].__getitem__)] == r["lang"] for r in rows)
    assert right / len(rows) > 0.95


def test_scores_are_log_likelihoods(spark):
    """One text's scores against counts made by hand."""
    import math
    from collections import Counter

    model = langid.train(documents(spark, LABELLED))
    assert model["languages"] == ["de", "en"]
    row = langid.scored(spark.createDataFrame([("cat",)], "lid_text string"), model).first()
    twice = {lang: f"{t} {t}" for lang, t in TEXTS.items()}
    counts = {lang: Counter(t[i : i + 3] for i in range(len(t) - 2) if t[i : i + 3].strip()) for lang, t in twice.items()}
    total = {lang: 10 * sum(c.values()) + 0.5 * (1 << langid.BUCKET_BITS) for lang, c in counts.items()}
    p = {lang: math.log((10 * counts[lang]["cat"] + 0.5) / total[lang]) for lang in TEXTS}
    assert row["lid_scores"][1] == 0
    assert row["lid_scores"][0] == pytest.approx((p["de"] - p["en"]) * langid.TEXT_WEIGHT, abs=1e-4)


def test_host_prior_decides_where_text_is_silent(spark):
    html = lambda lang, t: f"<html lang='{lang}'><body>{t}</body></html>"
    rows = [(k, f"http://a.example.org/{k}", html("", TEXTS["de"])) for k in range(20)] + [(k, f"http://b.example.com/{k}", html("", TEXTS["en"])) for k in range(20, 60)]
    rows += [(100, "http://a.example.org/x", html("", "123")), (101, "http://b.example.com/x", "456"), (102, None, None), (103, "no address", html("de", "9")), (104, "http://c.example.org/", "1")]
    out = {r["page_id"]: r for r in langid.identify_pages(spark.createDataFrame(rows, PAGES), documents(spark, LABELLED)).collect()}
    assert (out[100]["lang"], out[101]["lang"], out[104]["lang"]) == ("de", "en", "de")
    assert out[102]["lang"] == "en"  # most pages
    assert out[100]["text_lang"] is None
    assert all(out[k]["lang"] == "de" for k in range(20))
    assert len(out) == len(rows)


def test_wrong_declaration_is_outvoted(spark):
    rows = [(k, "http://a.example.org/", f"<html lang=en>{(TEXTS['de'] + ' ') * 5}</html>") for k in range(5)]
    assert {r["lang"] for r in langid.identify_pages(spark.createDataFrame(rows, PAGES), documents(spark, LABELLED)).collect()} == {"de"}


def test_documents_keep_their_columns(spark):
    docs = documents(spark, LABELLED + [(100, None), (101, "", None, None), (102, "123"), (103, TEXTS["de"], None, None), (None, TEXTS["en"], "en", "s"), (None, TEXTS["en"], "en", "s")], extra=True)
    out = langid.identify_documents(docs)
    assert out.columns == docs.columns
    kept = out.collect()
    assert len(kept) == len(LABELLED) + 3
    assert {r["lang"] for r in kept if r["doc_id"] == 103} == {"de"}
    assert kept[0]["lid_text"] == "own lid_text"


def test_empty_and_unlabelled(spark):
    none = documents(spark, []).where("false")
    assert langid.identify_documents(none).count() == 0
    assert langid.identify_pages(spark.createDataFrame([], PAGES), none).count() == 0
    page = spark.createDataFrame([(1, "http://a.de/", "<p>hallo")], PAGES)
    assert langid.identify_pages(page, none).first()["lang"] is None
    assert langid.identify_documents(documents(spark, AWKWARD)).count() <= len(AWKWARD)


def test_any_number_of_languages(spark):
    """More than one table of languages: same scores as a table of all, and each text finds its own."""
    n = langid.LANGUAGES_TOGETHER + 6
    word = lambda k: "".join(chr(97 + (k // 26**i + 3 * i) % 26) for i in range(6))
    docs = documents(spark, [(k, " ".join([word(k * 977)] * 8), f"l{k:03}", f"s{k}") for k in range(n)])
    model = langid.train(docs)
    assert [t.shape[1] for t in model["tables"]] == [langid.LANGUAGES_TOGETHER, 6]
    whole = {"languages": model["languages"], "tables": [np.concatenate(model["tables"], axis=1)]}
    rows = docs.select("doc_id", F.col("text").alias("lid_text"))
    parts, one = ({r["doc_id"]: r["lid_scores"] for r in langid.scored(rows, m).collect()} for m in (model, whole))
    assert all(parts[k] == pytest.approx(one[k]) and parts[k][k] == 0 for k in range(n))
    assert {r["doc_id"]: r["lang"] for r in langid.identify_documents(docs).collect()} == {k: f"l{k:03}" for k in range(n)}


def posteriors(rows, languages):
    """Each page's probabilities by plain sums: rows of (id, scores, declared, suffix, domain, host)."""
    n = len(languages)

    def normal(s):
        w = [math.exp(x - max(s)) for x in s]
        return [x / sum(w) for x in w]

    own = {r[0]: normal(r[1]) if r[1] else None for r in rows}
    table = lambda k: {v: [sum(own[r[0]][i] for r in rows if own[r[0]] and r[k] == v) for i in range(n)] for v in {r[k] for r in rows if own[r[0]] and r[k] is not None}}
    every = [sum(p[i] for p in own.values() if p) for i in range(n)]
    every = [(x + 1) / (sum(every) + n) for x in every]
    smooth = lambda m, parent: [(max(a, 0) + langid.SMOOTHING * p) / (max(sum(m), 0) + langid.SMOOTHING) for a, p in zip(m, parent, strict=True)]
    by_declared = {v: smooth(m, every) for v, m in table(2).items()}
    by_suffix = {v: smooth([a + (langid.SUFFIX_PAGES if langid.SUFFIX_LANGUAGE.get(v) == lang else 0) for a, lang in zip(m, languages, strict=True)], every) for v, m in table(3).items()}
    domains, hosts, out = table(4), table(5), {}
    for i, scores, declared, suffix, domain, host in rows:
        mine = own[i] or [0.0] * n
        less = lambda t, v: [a - b for a, b in zip(t[v], mine, strict=True)] if v in t else [0.0] * n  # noqa: B023, E731
        prior = smooth(less(hosts, host), smooth(less(domains, domain), by_suffix.get(suffix, every)))
        out[i] = normal([s + math.log(d / e) + math.log(p) for s, d, e, p in zip(scores or [0.0] * n, by_declared.get(declared, every), every, prior, strict=True)])
    return out


def test_pages_against_plain_fusion(spark, sf_dir):
    """The registered query over all pages, repeated rows, nulls, long and hostile pages and clashing columns beside them."""
    pages, docs = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "documents"))
    odd = spark.createDataFrame([(-1, None, None), (-2, "http://x.de/", "<p>" + "ein langer Satz " * 20_000), (-2, "http://x.de/", "<p>" + "ein langer Satz " * 20_000), (None, "no address", "<html data-lang=xx lang=EN><a <a <a"), (-3, "ftp://u@H.Example.ORG:80/x", "<!-- never closed " * 2000)], PAGES)
    rows = pages.unionByName(odd).withColumns({c: F.lit("own") for c in ("lid_text", "lid_scores", "host", "lang", "declared", "n")})
    model = langid.train(docs)
    names = ("page_id", "lid_scores", "lid_declared", "lid_suffix", "lid_domain", "lid_host")
    plain = [tuple(r[c] for c in names) for r in langid.scored(langid.page_evidence(rows), model).collect()]
    want = posteriors([(k, *r[1:]) for k, r in enumerate(plain)], model["languages"])
    got = sorted((r["page_id"] or 0, r["lang"], r["confidence"]) for r in langid.identify_pages(rows, docs).collect())
    best = sorted((r[0] or 0, model["languages"][max(range(len(want[k])), key=lambda i: want[k][i])], max(want[k])) for k, r in enumerate(plain))  # noqa: B023
    assert [g[:2] for g in got] == [b[:2] for b in best]
    assert [g[2] for g in got] == pytest.approx([b[2] for b in best], abs=2e-6)
    assert {r[2] for r in plain if r[0] is None} == {"en"}
    assert queries.op1_language_id(spark, sf_dir).count() == pages.count()


def test_hostile_markup_takes_linear_time(spark):
    page = "".join(("<!-- ", "<script> ", "< a < b ", "<a href='")[k % 4] for k in range(200_000))
    began = time.perf_counter()
    spark.createDataFrame([(1, "http://a.de/", page), (2, "http://a.de/", "<script>" * 100_000), (3, "http://a.de/", "<html " * 100_000)], PAGES).transform(langid.page_evidence).collect()
    assert time.perf_counter() - began < 20
