"""Full-text search over messages and attachments: postings, BM25, snippets and the plain fallback.

A query is a list of words joined by OR; a word with inner punctuation is a phrase of neighbouring
tokens. Tokens are runs of letters and digits in lower case, without accents. Here every text is split when
it is searched; tables that are searched often have an index (see index), which gives the same scores.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache, reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .facts import like
from .tables import stored

if TYPE_CHECKING:
    from .index import Index

TOKEN_GAP = r"[^\p{L}\p{N}]+"
# Fixed values of the ranking function and of snippets.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
SNIPPET_TOKENS, SNIPPET_OPEN, SNIPPET_CLOSE, SNIPPET_MORE = 24, ">>", "<<", " … "
FALLBACK_CHARS = 200


ACCENTED_BELOW, MARKS = 0x2000, range(0x300, 0x370)


@cache
def accents() -> tuple[str, str]:
    """Letters that decompose into one letter and marks, then the marks; and what stands for the letters."""
    pairs = {}
    for c in map(chr, range(0x80, ACCENTED_BELOW)):
        bare = [x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"]
        if len(bare) == 1 and bare[0] != c and c.isalpha():
            pairs[c] = bare[0]
    return "".join(pairs) + "".join(map(chr, MARKS)), "".join(pairs.values())


def folded(text: Column) -> Column:
    """text in lower case without accents."""
    return F.translate(F.lower(text), *accents())


def tokens(text: Column) -> Column:
    return F.filter(F.split(folded(text), TOKEN_GAP), lambda t: t != "")


def parse_query(query: str) -> list[list[str]] | None:
    """Token lists, one a word; None where a word has a quotation mark, which full-text search refuses."""
    words = query.split()
    if any('"' in w for w in words):
        return None
    letters, bare = accents()
    table = str.maketrans(letters[: len(bare)], bare, letters[len(bare) :])
    parts = [[t for t in re.split(r"[\W_]+", w.lower().translate(table)) if t] for w in words]
    return [p for p in parts if p]


def postings(docs: DataFrame, content: str) -> DataFrame:
    """token, id, positions of docs(id, content), one row a token and document."""
    return docs.select("id", F.posexplode(tokens(F.col(content))).alias("pos", "token")).groupBy("token", "id").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def phrase_counts(docs: DataFrame, content: str, query: list[list[str]]) -> DataFrame:
    """id, len (tokens), tf (an entry a phrase of query) of each row of docs: a text is split once, where it is."""

    def times(ts: Column, phrase: list[str]) -> Column:
        def starts(t: Column, i: Column) -> Column:
            return reduce(lambda a, b: a & b, (F.get(ts, i + k) == w for k, w in enumerate(phrase[1:], 1)), t == phrase[0])

        return F.size(F.filter(ts, starts))

    once = F.transform(F.array(tokens(F.col(content))), lambda ts: F.struct(F.size(ts).alias("len"), F.array(*(times(ts, p) for p in query)).alias("tf")))
    return docs.select("id", F.get(once, 0).alias("x")).select("id", "x.len", "x.tf")


def hits(docs: DataFrame, content: str, query: list[list[str]]) -> DataFrame:
    """phrase_no, id, tf of the phrases that occur in docs."""
    return phrase_counts(docs, content, query).select("id", F.posexplode("tf").alias("phrase_no", "tf")).where("tf > 0").select("phrase_no", "id", "tf")


def bm25_part(tf: Column, length: Column, df: Column, n_docs: Column, avg_len: Column) -> Column:
    """What one phrase adds to a text's score."""
    idf = F.greatest(F.log((n_docs - df + 0.5) / (df + 0.5)), F.lit(IDF_FLOOR))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg_len))


def bm25(docs: DataFrame, content: str, query: list[list[str]]) -> DataFrame:
    """id, score of docs(id, ...) that match any phrase.

    Counts are written, as the corpus's own (one row) are needed before the first score; nothing is shuffled by id.
    """
    counts = stored(phrase_counts(docs, content, query), "counts")
    corpus = counts.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"), F.array(*(F.count_if(F.get("tf", k) > 0) for k in range(len(query)))).alias("df"))
    part = lambda tf, df: bm25_part(tf, F.col("len"), df, F.col("n_docs"), F.col("avg_len"))
    parts = F.zip_with("tf", "df", part)
    return counts.where(F.exists("tf", lambda t: t > 0)).crossJoin(corpus).select("id", F.aggregate(parts, F.lit(0.0), lambda a, b: a + b).alias("score"))


def snippet(text: Column, words: list[str]) -> Column:
    """The window of SNIPPET_TOKENS words with the most matches, the earliest of these, matches marked.

    The earliest best window begins the text or ends with a match, so one window a match is looked at, and
    in it no more matches than it has words.
    """
    parts = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    hit = lambda w: F.arrays_overlap(tokens(w), F.array(*map(F.lit, words)))
    found = F.filter(F.transform(parts, lambda w, i: F.when(hit(w), i + 1)), lambda i: i.isNotNull())

    def at_best(places: Column) -> Column:
        def ending(p: Column, j: Column) -> Column:
            start = F.greatest(F.lit(1), p - (SNIPPET_TOKENS - 1))
            last = F.slice(places, F.greatest(F.lit(1), j + 2 - SNIPPET_TOKENS), F.lit(SNIPPET_TOKENS))
            return F.struct(F.size(F.filter(last, lambda q: (q >= start) & (q <= p))).alias("n"), (-start).alias("back"))

        return F.coalesce(-F.array_max(F.transform(places, ending))["back"], F.lit(1))

    def shown(p: Column, at: Column) -> Column:
        marked = F.array_join(F.transform(F.slice(p, at, F.lit(SNIPPET_TOKENS)), lambda w: F.when(hit(w), F.concat(F.lit(SNIPPET_OPEN), w, F.lit(SNIPPET_CLOSE))).otherwise(w)), " ")
        return F.concat(F.when(at > 1, SNIPPET_MORE).otherwise(""), marked, F.when(F.size(p) >= at + SNIPPET_TOKENS, SNIPPET_MORE).otherwise(""))

    start = F.get(F.transform(F.array(found), at_best), 0)  # the matches are found once
    return F.get(F.transform(F.array(F.struct(parts.alias("p"), start.alias("at"))), lambda x: shown(x["p"], x["at"])), 0)


def attachment_text(attachments: DataFrame, captions: DataFrame) -> DataFrame:
    """attachments with body: the extracted text, or else the caption (at most one an attachment); texts don't move to meet captions."""
    has_text = F.coalesce(F.col("extracted_text") != "", F.lit(False))
    texts = attachments.where(has_text).withColumn("body", F.col("extracted_text"))
    c = captions.select(F.col("attachment_id").alias("id"), "caption")
    others = attachments.where(~has_text).join(c, "id", "left").withColumn("body", F.coalesce("caption", F.lit(""))).drop("caption")
    return texts.unionByName(others)


def search(messages: DataFrame, conversations: DataFrame, attachments: DataFrame, captions: DataFrame, query: str, limit: int = 20, said: Index | None = None, held: Index | None = None) -> DataFrame:
    """kind, id, title, source_app, speaker, created_at, score, pos: message hits by rank, then attachment hits to fill up.

    said and held are the indexes of the messages' and the attachments' texts; without them the texts are split.
    """
    parsed = parse_query(query)
    if parsed is None:
        return fallback(messages, conversations, query, limit)
    homes = conversations.select(F.col("id").alias("conversation_id"), "title", "source_app")
    if not parsed:
        parsed = [["\0"]]

    def top(index: Index | None, rows: DataFrame, content: str) -> DataFrame:
        return index.top(parsed, limit) if index else bm25(rows, content, parsed).orderBy(F.col("score").desc(), "id").limit(limit)

    columns = ["kind", "id", "title", "source_app", "speaker", "created_at", "score"]
    first = top(said, messages, "content").join(messages, "id").join(homes, "conversation_id").withColumn("kind", F.lit("message")).select(*columns)
    files = attachment_text(attachments, captions)
    second = top(held, files, "body").join(files, "id").join(homes, "conversation_id").withColumns({"kind": F.lit("attachment"), "speaker": F.concat(F.lit("file: "), F.col("filename"))}).select(*columns)
    order = Window.orderBy(F.col("kind").desc(), F.col("score").desc(), "id")  # at most 2 * limit rows
    return first.unionByName(second).withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit)


def fallback(messages: DataFrame, conversations: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Newest messages that contain the query's first word, cut to a prefix."""
    words = query.split()
    homes = conversations.select(F.col("id").alias("conversation_id"), "title", "source_app")
    found = messages.where(like(F.col("content"), words[0] if words else "")).orderBy(F.col("id").desc()).limit(limit)
    return found.join(homes, "conversation_id").select("id", "title", "source_app", "speaker", "created_at", F.substring("content", 1, FALLBACK_CHARS).alias("snippet")).orderBy(F.col("id").desc())
