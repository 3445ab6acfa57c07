r"""Chat formatting: typed content parts flattened by a visitor, turns marked by a template, control strings escaped; DataFrame operations only.

A turn's content is an array of parts (type, text, ref, units). The visitor takes them in order: a text part gives its
escaped text; an image, audio or document part gives a placeholder numbered through the conversation, records its
reference as an attachment and counts its units times the tokens that a unit of its type expands to. A part of another
type (or of none) gives the placeholder `unknown`, keeps its reference and counts no tokens.

Template of a turn: `<|role|>` role `<|text|>` content `<|end|>`. Control strings of this template and of common others start
with `<` or `[` (`<|end|>`, `</s>`, `[INST]`). Inside texts and roles `\` becomes `\\`, and `\.` is put behind each `<` and `[`;
reading takes both back. No text can then make a control string, whatever it says. The loss mask names the stretches of
the output (code points, end exclusive) that the contents of assistants take.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import table

ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
#: Tokens that a unit (an image tile, a second of audio, a page) of each type expands to.
EXPANSION = {"image": 256, "audio": 25, "document": 800}


def escaped(text: Column) -> Column:
    """Null counts as empty."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("<\\.")), F.lit("["), F.lit("[\\."))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\)|\\\.", "$1")


def text_part(text: Column) -> Column:
    """The content of a turn that is one text."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"), none.cast("string").alias("ref"), none.cast("int").alias("units")))


def is_text(part: Column) -> Column:
    return part["type"].eqNullSafe("text")


def kind(part: Column, expansion: dict[str, int]) -> Column:
    return F.when(part["type"].isin(*expansion), part["type"]).otherwise(F.lit("unknown"))


def visited(parts: Column, before: Column, expansion: dict[str, int]) -> tuple[Column, Column, Column]:
    """What the visitor makes of the parts of a turn that has `before` attachments before it: its content, its attachments (number, type, ref, tokens) and its number of expanded tokens."""
    number = lambda i: before + F.size(F.filter(F.slice(parts, F.lit(1), i + 1), lambda p: ~is_text(p)))
    text = F.transform(parts, lambda p, i: F.when(is_text(p), escaped(p["text"])).otherwise(F.concat(F.lit("<|"), kind(p, expansion), F.lit("_"), number(i).cast("string"), F.lit("|>"))))
    rates = F.create_map(*[F.lit(x) for kv in expansion.items() for x in kv])
    tokens = lambda p: F.coalesce(rates[kind(p, expansion)] * F.coalesce(p["units"], F.lit(1)), F.lit(0)).cast("long")
    other = F.filter(parts, lambda p: ~is_text(p))
    found = F.transform(other, lambda p, i: F.struct((before + i + 1).cast("long").alias("number"), kind(p, expansion).alias("type"), p["ref"].alias("ref"), tokens(p).alias("tokens")))
    return F.array_join(text, ""), found, F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + x["tokens"])


def chat(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts: Column | None = None, expansion: dict[str, int] = EXPANSION) -> DataFrame:
    """turns: a row a turn, with an array of parts (the text column's content if not given). Returns id, n_turns, formatted,
    loss_spans (start, end), loss_turns (a boolean a turn), attachments (number, type, ref, tokens), expanded_tokens.

    Turns stand by turn (null first), role and content; repeated rows are turns of their own. Null roles and texts count
    as empty, a null array of parts as no part; rows with a null id form a conversation. An empty table gives no rows. A
    conversation is one row, since its output is one string; what is counted within it comes from windows over its turns."""
    content = F.coalesce(text_part(F.col("text")) if parts is None else parts, F.array().cast("array<struct<type:string,text:string,ref:string,units:int>>"))
    rows = turns.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), content.alias("parts"))
    order = Window.partitionBy("id").orderBy("turn", "role", "parts")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    other = F.size(F.filter("parts", lambda p: ~is_text(p)))
    rows = rows.withColumns({"seq": F.row_number().over(order), "before": F.coalesce(F.sum(other).over(so_far), F.lit(0)).cast("long")})
    body, found, tokens = visited(F.col("parts"), F.col("before"), expansion)
    rows = rows.select("id", "turn", "role", "parts", "seq", body.alias("body"), found.alias("found"), tokens.alias("tokens"))
    head = F.concat(F.lit(ROLE), escaped(F.col("role")), F.lit(TEXT))
    rows = rows.select("id", "turn", "role", "parts", "seq", "found", "tokens", "body", head.alias("head"))
    length = F.char_length("head") + F.char_length("body") + len(END)
    rows = rows.withColumn("start", F.coalesce(F.sum(length).over(so_far), F.lit(0)) + F.char_length("head"))
    loss = F.col("role") == "assistant"
    turn = F.struct("seq", F.concat("head", "body", F.lit(END)).alias("piece"), loss.alias("loss"), F.col("start").cast("long").alias("start"), (F.col("start") + F.char_length("body")).cast("long").alias("end"), "found")
    grouped = rows.groupBy("id").agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list(turn)).alias("turns"), F.sum("tokens").alias("expanded_tokens"))
    spans = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return grouped.select(
        "id",
        "n_turns",
        F.array_join(F.col("turns.piece"), "").alias("formatted"),
        spans.alias("loss_spans"),
        F.col("turns.loss").alias("loss_turns"),
        F.flatten(F.col("turns.found")).alias("attachments"),
        "expanded_tokens",
    )


def parsed(formatted: Column) -> Column:
    """The turns of a formatted conversation, read back: an array of (role, text). Placeholders stay as they are."""
    pieces = F.split(formatted, r"<\|end\|>")
    pieces = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))
    role = lambda x: F.substring_index(F.substring_index(x, ROLE, -1), TEXT, 1)
    return F.transform(pieces, lambda x: F.struct(unescaped(role(x)).alias("role"), unescaped(F.substring_index(x, TEXT, -1)).alias("text")))


#: Code points of a block that a formatted string is cut into before spans are read from it.
BLOCK = 4096


def read_spans(made: DataFrame, text_col: str = "formatted", spans_col: str = "loss_spans", out: str = "loss_texts") -> DataFrame:
    """made with what stands in the spans (start, end: code points, end exclusive, in order) of its text added as `out`, an array of strings, unescaped.

    A text is cut into blocks once and a span read from its own blocks, so that reading thousands of spans of one long string takes time in proportion to its length."""
    blocks = F.regexp_extract_all(F.col(text_col), F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    cut = made.withColumn("_blocks", blocks)

    def piece(s: Column) -> Column:
        first, last = F.floor(s["start"] / BLOCK).cast("int"), F.floor((s["end"] - 1) / BLOCK).cast("int")
        around = F.array_join(F.slice("_blocks", first + 1, F.greatest(last - first + 1, F.lit(1))), "")
        return unescaped(F.substring(around, (s["start"] - first * BLOCK + 1).cast("int"), (s["end"] - s["start"]).cast("int")))

    # blocks are referred to twice, so that they stay a column of their own and aren't cut anew for each span
    read = F.when(F.size("_blocks") > 0, F.transform(spans_col, piece)).otherwise(F.transform(spans_col, lambda s: F.lit("")))
    return cut.withColumn(out, read).drop("_blocks")


#: The contract's added conversation.
PROBE = [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation, read back from the formatted string: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 (both of what stands under the loss mask), formatted_chars, expanded_tokens."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    made = chat(rows.union(spark.sql("values " + ", ".join(f"({c}L, {t}L, '{r}', '{x}')" for c, t, r, x in PROBE))))
    read = read_spans(made).select("id", "formatted", "expanded_tokens", parsed(F.col("formatted")).alias("turns"), F.array_join("loss_texts", "").alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read.select("id", "formatted", "expanded_tokens", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), "loss")
    return read.select(
        F.col("id").alias("conv_id"),
        "n_turns",
        F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "expanded_tokens",
    )


OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
d AS (
  SELECT *, 23 + length(role || text) + length(regexp_replace(role || text, '[^\\]', '', 'g'))
    + 2 * length(regexp_replace(role || text, '[^<\[]', '', 'g')) AS chars FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars, 0::BIGINT AS expanded_tokens
FROM d GROUP BY conv_id
"""
