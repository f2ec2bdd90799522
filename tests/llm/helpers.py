"""Tables with awkward rows, and plain versions of what the operators compute."""

from __future__ import annotations

import re

LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra: bool = False):
    """documents from (doc_id, text[, lang[, source]]); extra adds columns whose names the operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        names = ["id", "n", "doc", "row_id", "key", "copies", "tie", "rate", "size", "word", "words", "block", "bucket", "lid_text", "lid_scores", "odd_id", "odd_sha", "mix_id", "mix_tie", "label", "score", "component", "rep", "place", "led", "edited", "next_text", "wanted", "split", "fp0", "TEXT_"]
        df = df.withColumns({c: F.lit(f"own {c}") for c in names})
    return df


def lowered(text: str | None) -> str:
    return (text or "").translate(LOWER)


def word_list(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text: str | None, width: int = 5) -> set[tuple[str, ...]]:
    w = word_list(lowered(text))
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def components(rows: list[tuple[int, str | None]], percent: int) -> dict[int, int]:
    """Smallest reachable id of each id, all pairs compared."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((top(a), top(b)))
                up[q] = p
    return {i: top(i) for i in ids}


#: Nulls, empty and blank texts, repeated texts under other ids, upper case, all kinds of space, a text of one very long word, a long text.
AWKWARD = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "One two three"), (5, "one TWO three"), (6, "a b c d e f g h"), (7, "A B c d e f g h"), (8, "a\x0bb\x0cc\rd e f g h"),
    (9, "x" * 300_000), (10, "word " * 60_000), (11, "é É ß İ ı     🙂🙂 \u0000end"), (12, "<|endoftext|>a<|endoftext|>"), (13, None), (14, "it's don't WE'LL 12345 ...!? \n\n x"),
]
