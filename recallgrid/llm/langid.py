"""Language identification by Bayesian evidence fusion.

The posterior of a page's language is proportional to

    likelihood of its text ** TEXT_WEIGHT * P(language | declared) / P(language) * P(language | host)

The likelihood is that of byte trigrams (letters only, A-Z lower-cased) under each language, with counts
taken over all labelled texts. The other two come from grouped aggregation of what the texts alone say:
P(language | host) is smoothed towards the host's domain, that towards the address suffix, that towards
all pages, each with SMOOTHING pseudo-pages; a country's suffix adds SUFFIX_PAGES for its language; a
page's own text is left out of its host's counts. P(language | declared) tells how far declarations
can be believed.

Defined results: null text counts as empty; a text without letters says nothing, and the other evidence
decides; a null declaration, host, domain or suffix says nothing; without labelled texts the language
is null; a posterior tie goes to the first language by code point. Any number of languages is scored, in
tables of LANGUAGES_TOGETHER. Of a page, comments, scripts, styles, tags and character entities count as
blanks; a comment, script or tag that isn't closed goes on to the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import slices, text_bytes, tidy
from .storage import packed, stored

BUCKET_BITS = 16
TEXT_WEIGHT = 1 / 3
SMOOTHING = 5.0
SUFFIX_PAGES = 2.0
LANGUAGES_TOGETHER = 64
# Languages of some address suffixes.
SUFFIX_LANGUAGE = {"at": "de", "de": "de", "es": "es", "fr": "fr", "it": "it", "mx": "es", "nl": "nl", "pl": "pl", "pt": "pt", "uk": "en", "us": "en"}
LEVELS = ("suffix", "domain", "host")
# Each alternative goes on to the end where nothing closes it, so that no text is scanned twice.
MARKUP = r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)|<(?=[a-z/!?])[^>]*(?:>|\z)|&(?:#\d{1,7}|#x[0-9a-f]{1,6}|[a-z][a-z0-9]{1,30});"

LETTER = np.arange(256, dtype=np.uint8)
LETTER[65:91] += 32
LETTER[[b for b in range(128) if not chr(b).isalpha()]] = 32


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each trigram within a text that has a letter, and the text it is in."""
    b = LETTER[data].astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    h = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    keep = h != 0x202020
    for back in (1, 2):
        at = offsets[1:] - back
        keep[at[(at >= offsets[:-1]) & (at < len(keep))]] = False
    at = np.flatnonzero(keep)
    return (h[at] * np.uint32(0x9E3779B1) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64), at


def train(rows: DataFrame) -> dict:
    """languages and log-probability tables of rows(text, lang); counts over all rows with a lang.

    A table has one row a bucket and one column for each of LANGUAGES_TOGETHER languages; counts reach the
    driver summed, at most one number for each of its entries.
    """
    labelled = rows.where("lang is not null").select("text", "lang")

    def count(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                data, at = text_bytes(part.column("text"))
                buckets, where = _trigrams(data, at)
                ends = np.searchsorted(where, at)
                langs = np.array(part.column("lang").to_pylist(), dtype=object)
                of = np.repeat(np.arange(len(langs)), np.diff(ends))
                for lang in set(langs):
                    mine = counts.setdefault(lang, np.zeros(1 << BUCKET_BITS, dtype=np.int64))
                    mine += np.bincount(buckets[(langs == lang)[of]], minlength=1 << BUCKET_BITS)
        for lang, mine in counts.items():
            some = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(mine[some])], names=["lang", "bucket", "n"])

    languages = sorted(r["lang"] for r in labelled.select("lang").distinct().collect())
    summed = labelled.mapInArrow(tidy(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    summed = stored(summed, "trigrams") if len(languages) > LANGUAGES_TOGETHER else summed
    tables = []
    for k in range(0, len(languages), LANGUAGES_TOGETHER):
        some = languages[k : k + LANGUAGES_TOGETHER]
        found = (summed if len(languages) <= LANGUAGES_TOGETHER else summed.where(F.col("lang").isin(some))).toArrow()
        table = np.full((1 << BUCKET_BITS, len(some)), 0.5)
        where = pc.index_in(found.column("lang"), pa.array(some)).to_numpy()
        table[found.column("bucket").to_numpy(), where] += found.column("n").to_numpy()
        tables.append(np.log(table / table.sum(axis=0)).astype(np.float32))
    return {"languages": languages, "tables": tables}


def scored(rows: DataFrame, model: dict) -> DataFrame:
    """rows with lid_scores array<double>: TEXT_WEIGHT * log-likelihood of lid_text by language, best 0 (empty array: no letters).

    Only the texts go to Python; the other columns stay where they are.
    """
    parts = [F.transform(_log_likelihood(rows.sparkSession, t)("lid_text"), lambda x: x * TEXT_WEIGHT) for t in model["tables"]]
    sums = F.concat(*parts) if parts else F.array().cast("array<double>")
    return rows.withColumn("lid_scores", _let(sums, lambda s: _let(F.array_max(s), lambda top: F.transform(s, lambda x: x - top)))).drop("lid_text")


def _log_likelihood(spark: SparkSession, table: np.ndarray) -> Callable:
    """A function of a text column: the sum of its trigrams' log-probabilities for each column of table, an empty array without letters."""
    shared, languages = spark.sparkContext.broadcast(table), table.shape[1]
    step = max(1024, (1 << 19) // languages)

    def sums_of(text: pa.Array) -> pa.Array:
        out = [pa.array([], pa.list_(pa.float64()))]
        for part in slices(pa.RecordBatch.from_arrays([text], names=["text"]), "text"):
            data, at = text_bytes(part.column("text"))
            buckets, where = _trigrams(data, at)
            ends = np.searchsorted(where, at)
            doc = np.repeat(np.arange(len(at) - 1), np.diff(ends))
            sums = np.zeros((len(at) - 1, languages))
            for k in range(0, len(buckets), step):  # a long text in stretches
                heads = np.concatenate([[0], np.flatnonzero(np.diff(doc[k : k + step])) + 1])
                sums[doc[k + heads]] += np.add.reduceat(shared.value[buckets[k : k + step]].astype(np.float64), heads, axis=0)
            some = np.diff(ends) > 0
            out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * languages)]).astype(np.int32)), pa.array(sums[some].reshape(-1))))
        return pa.concat_arrays(out)

    @F.arrow_udf("array<double>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidy(lambda every: map(sums_of, every))(batches)

    return score


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def _posterior(scores: Column) -> Column:
    """Probabilities of log scores; uniform is left to the caller for an empty array."""
    weights = lambda s: _let(F.array_max(s), lambda top: F.transform(s, lambda x: F.exp(x - top)))
    return _let(scores, lambda s: _let(weights(s), lambda w: _let(_total(w), lambda t: F.transform(w, lambda x: x / t))))


def _sums(rows: DataFrame, key: str | None, n: int) -> DataFrame:
    """Pages (by the probability their texts give) of each language by key."""
    grouped = rows.where(F.col(key).isNotNull()).groupBy(key) if key else rows.groupBy()
    parts = [F.coalesce(F.sum(F.get("lid_p", i)), F.lit(0.0)) for i in range(n)]
    return grouped.agg(F.array(*parts).alias("lid_n"))


def _smoothed(n: Column, parent: Column) -> Column:
    return _let(n, lambda m: _let(F.greatest(_total(m), F.lit(0.0)) + SMOOTHING, lambda t: F.zip_with(m, parent, lambda a, p: (F.greatest(a, F.lit(0.0)) + SMOOTHING * p) / t)))


def evidence(rows: DataFrame, languages: list[str]) -> dict[str, DataFrame | list[float]]:
    """Tables by declared language, suffix, domain and host from scored rows(lid_declared, lid_suffix, lid_domain, lid_host, lid_scores).

    They are written, so that later joins know their sizes: Spark broadcasts small ones only.
    """
    n = len(languages)
    rows = rows.where(F.size("lid_scores") > 0).withColumn("lid_p", _posterior(F.col("lid_scores")))
    overall = _sums(rows, None, n).first()["lid_n"]
    overall = [(x + 1) / (sum(overall) + n) for x in overall]
    everywhere = F.array(*map(F.lit, overall))
    declared = _sums(rows, "lid_declared", n).select("lid_declared", _smoothed(F.col("lid_n"), everywhere).alias("lid_by_declared"))
    country = {s: [SUFFIX_PAGES * (x == lang) for x in languages] for s, lang in SUFFIX_LANGUAGE.items() if lang in languages}
    extra = F.lit(None).cast("array<double>")
    for s, add in country.items():
        extra = F.when(F.col("lid_suffix") == s, F.array(*map(F.lit, map(float, add)))).otherwise(extra)
    suffix = _sums(rows, "lid_suffix", n).withColumn("lid_n", F.coalesce(F.zip_with("lid_n", extra, lambda a, b: a + b), F.col("lid_n")))
    return {
        "overall": overall,
        "declared": stored(declared, "declared"),
        "suffix": stored(suffix.select("lid_suffix", _smoothed(F.col("lid_n"), everywhere).alias("lid_by_suffix")), "suffix"),
        "domain": stored(_sums(rows, "lid_domain", n).select("lid_domain", F.col("lid_n").alias("lid_of_domain")), "domain"),
        "host": stored(_sums(rows, "lid_host", n).select("lid_host", F.col("lid_n").alias("lid_of_host")), "host"),
    }


def fuse(rows: DataFrame, found: dict, languages: list[str]) -> DataFrame:
    """rows with lid_lang and lid_confidence instead of the evidence columns."""
    keep = [c for c in rows.columns if not c.startswith("lid_")]
    if not languages:
        return rows.select(*keep, F.lit(None).cast("string").alias("lid_lang"), F.lit(0.0).alias("lid_confidence"))
    out = rows
    for level in ("declared", *LEVELS):
        out = out.join(found[level], f"lid_{level}", "left")
    everywhere = F.array(*map(F.lit, found["overall"]))
    nothing = F.array(*[F.lit(0.0)] * len(languages))
    own = F.when(F.size("lid_scores") > 0, _posterior(F.col("lid_scores"))).otherwise(nothing)
    less = lambda n: F.zip_with(F.coalesce(n, nothing), F.when(n.isNotNull(), own).otherwise(nothing), lambda a, b: a - b)
    suffix = F.coalesce("lid_by_suffix", everywhere)
    out = out.withColumn("lid_prior", _smoothed(less(F.col("lid_of_host")), _smoothed(less(F.col("lid_of_domain")), suffix)))
    factor = F.zip_with(F.coalesce("lid_by_declared", everywhere), everywhere, lambda a, b: F.log(a / b))
    text = F.when(F.size("lid_scores") > 0, F.col("lid_scores")).otherwise(nothing)
    total = F.zip_with(F.zip_with(text, factor, lambda a, b: a + b), "lid_prior", lambda a, p: a + F.log(p))
    out = out.withColumn("lid_post", _posterior(total))
    best = F.array_position("lid_post", F.array_max("lid_post")).cast("int")
    return out.select(*keep, F.element_at(F.array(*map(F.lit, languages)), best).alias("lid_lang"), F.array_max("lid_post").alias("lid_confidence"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """page_id with the evidence columns of pages(page_id, url, html)."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    host = F.when(host != "", host)
    html = F.coalesce("html", F.lit(""))
    declared = F.lower(F.regexp_extract(html, r"(?i)<html\b[^<>]*?\slang\s*=\s*[\"']?([a-z]{2,3})", 1))
    text = F.regexp_replace(html, MARKUP, " ")
    return pages.select(
        "page_id", text.alias("lid_text"), F.when(declared != "", declared).alias("lid_declared"),
        F.element_at(F.split(host, r"\."), -1).alias("lid_suffix"), F.substring_index(host, ".", -2).alias("lid_domain"), host.alias("lid_host"),
    )


def identify_pages(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """page_id, host, declared, text_lang (by text alone), lang, confidence of each row of pages."""
    model = train(labelled)
    languages = model["languages"]
    rows = stored(scored(page_evidence(pages), model), "scored")
    names = F.array(*map(F.lit, languages)) if languages else F.array(F.lit(None).cast("string"))
    by_text = F.when(F.size("lid_scores") > 0, F.element_at(names, F.array_position("lid_scores", F.array_max("lid_scores")).cast("int")))
    rows = rows.withColumns({"host": F.col("lid_host"), "declared": F.col("lid_declared"), "text_lang": by_text})
    out = fuse(rows, evidence(rows, languages) if languages else {}, languages)
    return out.select("page_id", "host", "declared", "text_lang", F.col("lid_lang").alias("lang"), F.round("lid_confidence", 6).alias("confidence"))


def identify_documents(docs: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """The rows of docs(text, lang, source, ...) whose language is known, with lang set to it.

    The declared language is lang, the host is source. Dropped: rows whose text has no letter, and rows
    whose best language has a posterior below min_confidence.
    """
    model = train(docs)
    languages = model["languages"]
    nothing = F.lit(None).cast("string")
    rows = docs.select(packed(docs), F.col("text").alias("lid_text"), F.col("lang").alias("lid_declared"), F.col("source").alias("lid_host"), nothing.alias("lid_domain"), nothing.alias("lid_suffix"))
    rows = stored(scored(rows, model), "scored")
    out = fuse(rows.where(F.regexp_like("doc.text", F.lit(r"\p{L}"))), evidence(rows, languages) if languages else {}, languages)
    return out.where(F.col("lid_confidence") >= min_confidence).select(*(F.col("lid_lang" if c == "lang" else f"doc.`{c}`").alias(c) for c in docs.columns))
