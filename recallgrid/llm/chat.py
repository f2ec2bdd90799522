"""Chat formatting by a finite-state machine over roles and a declarative template, in DataFrame functions only.

Every turn becomes three segments, opening mark, escaped text and closing mark, each with a loss flag;
the formatted conversation is the segments one after another. A backslash in a text is doubled, and a
control string in it gets a backslash after its first character, so no control string is left in a
text and reading back is exact.

Defined results: null role and null text count as empty; a role that the template lacks is written with
its name, gets no loss, and makes the turn order invalid; turns with equal numbers are ordered by role
and text, a null turn comes first; a conversation is one row, whatever its turn order, with the position
of its first wrong turn (null: none; one past the last turn if it stops too early).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a turn of each role looks like, which turns carry loss, and which role may follow which.
TEMPLATE = {
    "roles": {
        "system": {"open": "<<SYS>>", "close": "<</SYS>>", "loss": False},
        "user": {"open": "[INST]", "close": "[/INST]", "loss": False},
        "assistant": {"open": "<s>", "close": "</s>", "loss": True},
    },
    "other": {"open": "<<ROLE>>", "name_end": "<</ROLE>>", "close": "<</TURN>>"},
    "start": "start",
    "next": {"start": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]},
    "end": ["assistant"],
}


def controls(template: dict) -> list[str]:
    other = template["other"]
    marks = [r[k] for r in template["roles"].values() for k in ("open", "close")] + [other[k] for k in ("open", "name_end", "close")]
    return sorted(set(marks), key=lambda m: (-len(m), m))


def _quoted(mark: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in mark)


def escape(text: Column, template: dict = TEMPLATE) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    first = "|".join(f"{_quoted(m[0])}(?={_quoted(m[1:])})" for m in controls(template))
    return F.regexp_replace(doubled, f"({first})", "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _turns(role: str = "role", text: str = "text") -> Column:
    return F.array_sort(F.collect_list(F.struct(F.col("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))), _by_turn)


def _by_turn(a: Column, b: Column) -> Column:
    key = lambda x: F.struct(x["turn"].isNotNull(), x["turn"], x["role"], x["text"])
    return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)


def first_wrong(roles: Column, template: dict = TEMPLATE) -> Column:
    """1-based position of the first turn that the state machine refuses, null if it accepts all and may stop there."""
    moves = F.create_map(*(F.lit(x) for a, after in template["next"].items() for b in after for x in (f"{a}>{b}", b)))
    begin = F.struct(F.lit(template["start"]).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("wrong"))

    def move(s: Column, role: Column) -> Column:
        to = F.element_at(moves, F.concat(s["state"], F.lit(">"), role))
        return F.struct(F.coalesce(to, s["state"]).alias("state"), (s["at"] + 1).alias("at"), F.coalesce(s["wrong"], F.when(to.isNull(), s["at"] + 1)).alias("wrong"))

    return F.aggregate(roles, begin, move, lambda s: F.coalesce(s["wrong"], F.when(~s["state"].isin(template["end"]), s["at"] + 1)))


def _segments(turn: Column, template: dict) -> Column:
    seg = lambda text, loss: F.struct(text.alias("text"), F.lit(loss).alias("loss"))
    other = template["other"]
    name = F.concat(F.lit(other["open"]), escape(turn["role"], template), F.lit(other["name_end"]))
    out = F.array(seg(name, False), seg(escape(turn["text"], template), False), seg(F.lit(other["close"]), False))
    for role, r in template["roles"].items():
        out = F.when(turn["role"] == role, F.array(seg(F.lit(r["open"]), False), seg(escape(turn["text"], template), r["loss"]), seg(F.lit(r["close"]), False))).otherwise(out)
    return out


def format_conversations(rows: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """rows(conv_id, turn, role, text) as one row a conversation: conv_id, segments array<struct<text, loss>>, formatted, first_wrong."""
    turns = rows.groupBy("conv_id").agg(_turns().alias("turns"))
    segments = F.flatten(F.transform("turns", lambda t: _segments(t, template)))
    out = turns.select("conv_id", segments.alias("segments"), first_wrong(F.transform("turns", lambda t: t["role"]), template).alias("first_wrong"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column, template: dict = TEMPLATE) -> Column:
    """array<struct<role, text>> of a formatted conversation: the inverse of formatting."""
    other = template["other"]
    opens = "|".join(_quoted(r["open"]) for r in template["roles"].values())
    closes = "|".join(_quoted(r["close"]) for r in template["roles"].values())
    pattern = F.lit(f"(?s)({opens}|{_quoted(other['open'])}.*?{_quoted(other['name_end'])})(.*?)(?:{closes}|{_quoted(other['close'])})")
    marks, texts = F.regexp_extract_all(formatted, pattern, F.lit(1)), F.regexp_extract_all(formatted, pattern, F.lit(2))
    named = F.create_map(*(F.lit(x) for role, r in template["roles"].items() for x in (r["open"], role)))
    n, m = len(other["open"]), len(other["open"]) + len(other["name_end"])
    role = lambda mark: F.coalesce(F.element_at(named, mark), unescape(F.substring(mark, F.lit(n + 1), F.length(mark) - m)))
    return F.zip_with(marks, texts, lambda a, b: F.struct(role(a).alias("role"), unescape(b).alias("text")))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
