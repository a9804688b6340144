"""Chat formatting: a finite-state machine over roles and a declarative template.

Turns of a conversation are put in order, run through a state machine that says
whether the roles follow each other as allowed, and written as a list of text
segments, each with its loss flag. Everything is a Spark expression.

Marks cannot be forged by a text: a backslash in a text is doubled, and a control
string gets a backslash after its first character. No mark holds a backslash, so
after escaping no text holds a mark, and a text's end and a mark's begin never form
one together, since only a mark's first character is ``[`` or ``<``. Removing one
backslash before each character undoes it.

Defined cases: a null text or role is empty; a role that the template does not
know is written with the general marks, its name escaped, and makes the order
invalid; turns with equal numbers are ordered by role and text, null numbers come
first; repeated rows are repeated turns; an empty table gives an empty result; extra
columns are ignored. A conversation is one value of the output, so it is gathered;
nothing larger is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: role -> marks before and after its text, and whether the text is trained on
TEMPLATE = {
    "system": {"open": "[SYS]", "close": "[/SYS]", "loss": False},
    "user": {"open": "[INST]", "close": "[/INST]", "loss": False},
    "assistant": {"open": "<s>", "close": "</s>", "loss": True},
}
#: any other role: open, role, between, text, close
OTHER = {"open": "[TURN]", "between": "[TEXT]", "close": "[/TURN]"}
#: state -> role -> next state; anything else is an error, which is final
TRANSITIONS = {
    "start": {"system": "system", "user": "user"},
    "system": {"user": "user"},
    "user": {"assistant": "assistant"},
    "assistant": {"user": "user"},
}
#: states in which a conversation may end
FINAL = ("assistant",)


def marks(template: dict = TEMPLATE, other: dict = OTHER) -> list[str]:
    return [m[k] for m in template.values() for k in ("open", "close")] + list(other.values())


def escape(text: Column, control: list[str]) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for m in control:
        out = F.replace(out, F.lit(m), F.lit(f"{m[0]}\\{m[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 template: dict = TEMPLATE, other: dict = OTHER, transitions: dict = TRANSITIONS,
                 final: tuple = FINAL) -> DataFrame:
    """One row per conversation: ``conv``, ``segments`` (array of ``text``, ``loss``),
    ``valid`` (the state machine accepts its roles) and ``error_turn`` (the position,
    from 0, of the first role that it refuses; null if none)."""
    control = marks(template, other)
    rows = turns.select(F.col(conv).alias(conv), F.col(turn).alias("_n"),
                        F.coalesce(F.col(role), F.lit("")).alias("_role"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    one = rows.groupBy(conv).agg(F.sort_array(F.collect_list(F.struct("_n", "_role", "_text"))).alias("_turns"))

    known = {r: F.lit(r) for r in template}
    opens, closes = _map({r: m["open"] for r, m in template.items()}), _map({r: m["close"] for r, m in template.items()})
    trained = _map({r: bool(m["loss"]) for r, m in template.items()})

    def segment(value: Column, loss: Column) -> Column:
        return F.struct(value.alias("text"), loss.alias("loss"))

    def segments(t: Column) -> Column:
        no = F.lit(False)
        general = F.concat(F.lit(other["open"]), escape(t["_role"], control), F.lit(other["between"]))
        before = F.when(t["_role"].isin(*known), opens[t["_role"]]).otherwise(general)
        return F.array(segment(before, no),
                       segment(escape(t["_text"], control), F.coalesce(trained[t["_role"]], no)),
                       segment(F.coalesce(closes[t["_role"]], F.lit(other["close"])), no))

    edges = _map({f"{state} {r}": to for state, to_by_role in transitions.items() for r, to in to_by_role.items()})
    states = F.aggregate(
        "_turns", F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("error")),
        lambda s, t: F.struct(
            F.coalesce(edges[F.concat(s["state"], F.lit(" "), t["_role"])], F.lit("error")).alias("state"),
            (s["at"] + 1).alias("at"),
            F.coalesce(s["error"], F.when(edges[F.concat(s["state"], F.lit(" "), t["_role"])].isNull(), s["at"])).alias("error")))
    return (one.withColumn("_end", states)
            .select(conv, F.flatten(F.transform("_turns", segments)).alias("segments"),
                    F.col("_end")["state"].isin(*final).alias("valid"), F.col("_end")["error"].alias("error_turn")))


def read_chats(formatted: DataFrame, conv: str = "conv_id", template: dict = TEMPLATE, other: dict = OTHER) -> DataFrame:
    """The way back, from the segments alone: ``conv``, ``formatted`` (all segments
    joined), ``turns`` (array of ``role``, ``text``), ``loss_text``, ``valid``."""
    quoted = {m: "".join(f"\\{c}" if not c.isalnum() else c for c in m) for m in marks(template, other)}
    opens = "|".join([quoted[m["open"]] for m in template.values()] + [quoted[other["open"]]])
    closes = "|".join([quoted[m["close"]] for m in template.values()] + [quoted[other["close"]]])
    pattern = F.lit(f"(?s)({opens})(.*?)(?:{closes})")
    role_of = _map({m["open"]: r for r, m in template.items()})
    joined = formatted.select(conv, "valid", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
                              F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
                              .alias("loss_text"))
    parts = joined.withColumn("_open", F.regexp_extract_all("formatted", pattern, 1)) \
                  .withColumn("_body", F.regexp_extract_all("formatted", pattern, 2))
    between = F.lit(other["between"])

    def back(o: Column, body: Column) -> Column:
        general = o == F.lit(other["open"])
        at = F.locate(other["between"], body)
        return F.struct(
            F.when(general, unescape(F.substring(body, F.lit(1), at - 1))).otherwise(role_of[o]).alias("role"),
            F.when(general, unescape(F.substring(body, at + F.length(between), F.length(body)))).otherwise(unescape(body)).alias("text"))

    return parts.select(conv, "formatted", F.zip_with("_open", "_body", back).alias("turns"), "loss_text", "valid")
