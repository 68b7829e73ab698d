r"""Chat formatting of conversations with typed content parts, in DataFrame functions only.

Each turn becomes ``<|turn|>`` role ``\n`` body ``<|end|>``; a conversation is ``<s>`` turns ``</s>``. A visitor
flattens a turn's parts in order: text is escaped, an image, audio or document part becomes a
placeholder ``<|image|>``, and its reference and expanded token count are recorded.

``%``, ``<`` and ``[`` inside texts and roles (and line breaks in roles) are percent-escaped, so no
control string, of this template or another, can occur inside a text, and unescaping restores it exactly.

The loss mask is a run-length list over the whole output: for every turn the code points of its head, its body
and its end mark, and whether the loss counts them; only bodies of assistant turns count. The loss text is cut out of
the output by these runs. A conversation is one row, so it must fit a task's memory and 2 GB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END, OPEN, CLOSE = "<|turn|>", "<|end|>", "<s>", "</s>"
#: Tokens that one unit (image tile, second of audio, page) of an attachment expands to.
EXPANDS = {"image": 256, "audio": 25, "document": 512}
#: Turns whose texts are joined before conversations are put together, so a long one arrives in few rows.
SEGMENT = 64
#: Runs of the loss mask that are cut out of one slice of the output.
RUNS = 192
_ESCAPES = (("%", "%25"), ("<", "%3C"), ("[", "%5B"))


def _escape(text: Column, role: bool = False) -> Column:
    for plain, code in _ESCAPES + ((("\n", "%0A"),) if role else ()):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def _unescape(text: Column, role: bool = False) -> Column:
    for plain, code in reversed(_ESCAPES + ((("\n", "%0A"),) if role else ())):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def text_parts(text: Column) -> Column:
    """A text as the one part of a turn."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text.cast("string"), F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units")))


def _attachment(kind: Column) -> Column:
    return F.coalesce(kind.isin(*EXPANDS), F.lit(False))


def _expanded(part: Column) -> Column:
    size = F.lit(0)
    for kind, n in EXPANDS.items():
        size = F.when(part["type"] == kind, n).otherwise(size)
    return (size * F.coalesce(part["units"], F.lit(1))).cast("long")


def format_turns(turns: DataFrame) -> DataFrame:
    """``turns``: conv_id, turn, role, parts (array of struct type, text, ref, units). One row per conv_id:
    conv_id, formatted string, mask array<struct<chars int, loss boolean>> (three runs a turn, after the
    leading ``<s>``), attachments array<struct<turn long, type, ref, tokens long>> in order, expanded_tokens long.

    Turns go by ``turn`` (null first), then role and text, so ties and repeated rows have one order. Null roles and texts
    count as empty, null parts as none; a part of an unknown type is visited as text. Rows with a null conv_id form
    one conversation. Other columns are ignored; an empty table gives no rows.
    """
    parts = F.coalesce("parts", F.array().cast("array<struct<type:string,text:string,ref:string,units:bigint>>"))
    visited = F.transform(parts, lambda p: F.when(_attachment(p["type"]), F.concat(F.lit("<|"), p["type"], F.lit("|>"))).otherwise(_escape(F.coalesce(p["text"], F.lit("")))))
    marks = F.transform(F.filter(parts, lambda p: _attachment(p["type"])), lambda p: F.struct(F.col("turn").alias("turn"), p["type"].alias("type"), p["ref"].alias("ref"), _expanded(p).alias("tokens")))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.concat(F.lit(TURN), _escape(role, True), F.lit("\n")).alias("head"),
        F.array_join(visited, "").alias("body"),
        (role == "assistant").alias("loss"),
        marks.alias("marks"),
    )
    segment = F.floor(F.col("turn") / SEGMENT)
    rows = rows.groupBy("conv_id", segment.alias("segment")).agg(F.array_sort(F.collect_list(F.struct("turn", "head", "body", "loss", "marks"))).alias("turns"))

    def runs(t: Column) -> Column:
        return F.array(
            F.struct(F.length(t["head"]).alias("chars"), F.lit(False).alias("loss")),
            F.struct(F.length(t["body"]).alias("chars"), t["loss"].alias("loss")),
            F.struct(F.lit(len(END)).alias("chars"), F.lit(False).alias("loss")),
        )

    rows = rows.select("conv_id", "segment", F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("text"), F.flatten(F.transform("turns", runs)).alias("mask"), F.flatten(F.transform("turns", lambda t: t["marks"])).alias("marks"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("segment", "text", "mask", "marks"))).alias("s"))
    return whole.select(
        "conv_id",
        F.concat(F.lit(OPEN), F.array_join(F.transform("s", lambda x: x["text"]), ""), F.lit(CLOSE)).alias("formatted"),
        F.flatten(F.transform("s", lambda x: x["mask"])).alias("mask"),
        F.flatten(F.transform("s", lambda x: x["marks"])).alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, x: n + x["tokens"]))


def _total(runs: Column) -> Column:
    return F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r["chars"])


def _begin(runs: Column, k: Column) -> Column:
    """Code points of the first ``k`` runs."""
    return _total(F.slice(runs, F.lit(1), k))


def masked_text(formatted: DataFrame) -> DataFrame:
    """Adds ``masked``: what the mask's counted runs cover, cut out of ``formatted`` by their places, as an array.

    The places are the sums of the runs before. They are taken in two levels, slices of RUNS runs and runs in a slice, so
    that a long conversation is not summed, or searched, from its start for every run.
    """
    n = F.ceil(F.size("mask") / RUNS).cast("int")
    groups = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: F.slice("mask", k * RUNS + 1, F.lit(RUNS)))).otherwise(F.array().cast("array<array<struct<chars:int,loss:boolean>>>"))
    rows = formatted.withColumn("__runs", groups)
    rows = rows.withColumn("__chars", F.transform("__runs", _total))
    before = F.transform("__chars", lambda c, k: F.aggregate(F.slice("__chars", F.lit(1), k), F.lit(0).cast("long"), lambda a, b: a + b))
    rows = rows.withColumn("__parts", F.zip_with("__runs", F.arrays_zip(before.alias("at"), F.col("__chars").alias("n")), lambda r, p: F.struct(r.alias("runs"), F.substring(F.col("formatted"), (p["at"] + len(OPEN) + 1).cast("int"), p["n"].cast("int")).alias("text"))))

    def cut(part: Column) -> Column:
        pieces = F.transform(part["runs"], lambda r, i: F.when(r["loss"], F.substring(part["text"], (_begin(part["runs"], i) + 1).cast("int"), r["chars"])))
        return F.filter(pieces, lambda x: x.isNotNull())

    return rows.withColumn("masked", F.flatten(F.transform("__parts", cut))).drop("__runs", "__chars", "__parts")


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse ``format_turns`` output: adds turns array<struct<role, text>> and loss_text (all text under the mask, unescaped)."""
    inner = F.substring("formatted", F.lit(len(OPEN) + 1), F.length("formatted") - len(OPEN) - len(CLOSE))
    pieces = F.filter(F.split(inner, r"\Q" + TURN + r"\E", -1), lambda x, i: i > 0)

    def parse(x: Column) -> Column:
        cut = F.locate("\n", x)
        return F.struct(F.substring(x, F.lit(1), cut - 1).alias("role"), F.substring(x, cut + 1, F.length(x) - cut - len(END)).alias("body"))

    rows = masked_text(formatted).withColumn("raw", F.transform(pieces, parse))
    rows = rows.withColumn("loss_text", _unescape(F.array_join("masked", "")))
    return rows.withColumn("turns", F.transform("raw", lambda x: F.struct(_unescape(x["role"], True).alias("role"), _unescape(x["body"]).alias("text")))).drop("raw", "masked")


def digests(conversations: DataFrame) -> DataFrame:
    """Format ``conversations`` (conv_id, turn, role, text), read the output back and digest it."""
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", text_parts(F.col("text")).alias("parts"))
    back = read_back(format_turns(turns))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, replace(replace(replace(replace(role, '%', '%25'), '<', '%3C'), '[', '%5B'), chr(10), '%0A') AS erole,
    replace(replace(replace(text, '%', '%25'), '<', '%3C'), '[', '%5B') AS etext FROM t
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, erole, etext) AS told,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, erole, etext), '') AS loss,
    sum(length(erole) + length(etext) + 16) + 7 AS chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g
"""
