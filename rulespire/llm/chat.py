"""Chat formatting with typed content parts.

A message is a row (conv_id, turn, role, parts); ``parts`` is an ordered array of
(kind, text, ref, tokens). ``format_turns`` visits the parts in order: text is escaped and
appended, an image, audio or document part becomes a numbered placeholder and an entry of
``attachments`` with its reference, its place in the segment and the tokens it stands for.

    <|role|>\n ... <|end|>\n          a turn
    <|image 3.1|>                     part 1 of the turn numbered 3

``&``, ``<`` and ``[`` inside roles and texts are written as ``&amp;``, ``&lt;`` and ``&lsqb;`` (in
roles also ``|`` as ``&vert;``), so neither these marks nor those of other templates occur in
texts, and ``unescape`` gives back every string. The loss mask is a list of (start, length) in
characters of the segment: one span for each text part of an assistant's turn.

Turns are formatted row by row without a shuffle. Only ``digest_conversations`` brings a
conversation together, because a digest of all its text needs all of it.

Defined cases: a null role or text is empty; null parts or a null part add nothing; an unknown kind
is treated as a document; a null conv_id is a conversation; turns with the same number stand by role, then text;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rulespire.llm.common import WORD

#: Tokens that an attachment expands to where the part doesn't say.
EXPANDED = {"image": 256, "audio": 128, "document": 512}
MARKS = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))
PART = "struct<kind:string,text:string,ref:string,tokens:bigint>"
ATTACHMENT = "struct<kind:string,ref:string,placeholder:string,place:int,tokens:bigint>"
SPAN = "struct<start:int,length:int>"


def escape(s: Column, marks=MARKS) -> Column:
    for plain, coded in marks:
        s = F.replace(s, F.lit(plain), F.lit(coded))
    return s


def unescape(s: Column, marks=MARKS) -> Column:
    for plain, coded in reversed(marks):
        s = F.replace(s, F.lit(coded), F.lit(plain))
    return s


ROLE_MARKS = (*MARKS, ("|", "&vert;"))


def text_parts(text: Column) -> Column:
    """The parts of a message that is one text."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("tokens")))


def _visit(state: Column, part: Column, head: Column, turn: Column, learned: Column) -> Column:
    """State after one part: body, spans, attachments, tokens, seen."""
    is_text = part["kind"] == "text"
    kind = F.when(part["kind"].isin(list(EXPANDED)), part["kind"]).otherwise("document")
    shown = escape(F.coalesce(part["text"], F.lit("")))
    holder = F.concat(F.lit("<|"), kind, F.lit(" "), turn, F.lit("."), state["seen"].cast("string"), F.lit("|>"))
    place = (F.length(head) + F.length(state["body"])).cast("int")
    stands_for = F.coalesce(part["tokens"], *[F.when(kind == k, F.lit(n)) for k, n in EXPANDED.items()]).cast("bigint")
    span = F.struct(place.alias("start"), F.length(shown).cast("int").alias("length"))
    entry = F.struct(kind.alias("kind"), part["ref"].alias("ref"), holder.alias("placeholder"), place.alias("place"), stands_for.alias("tokens"))
    words = F.regexp_count(F.coalesce(part["text"], F.lit("")), F.lit(WORD)).cast("bigint")
    after = F.struct(
        F.concat(state["body"], F.when(is_text, shown).otherwise(holder)).alias("body"),
        F.when(is_text & learned, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
        F.when(is_text, state["attachments"]).otherwise(F.concat(state["attachments"], F.array(entry))).alias("attachments"),
        (state["tokens"] + F.when(is_text, words).otherwise(stands_for)).alias("tokens"),
        (state["seen"] + 1).alias("seen"),
    )
    return F.when(part.isNull(), state).otherwise(after)


def format_turns(messages: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, turn, segment, loss_spans, attachments, tokens: one row per message."""
    role = F.coalesce(F.col("role"), F.lit(""))
    head = F.concat(F.lit("<|"), escape(role, ROLE_MARKS), F.lit("|>\n"))
    zero = F.struct(
        F.lit("").alias("body"), F.array().cast(f"array<{SPAN}>").alias("spans"), F.array().cast(f"array<{ATTACHMENT}>").alias("attachments"),
        F.lit(0).cast("bigint").alias("tokens"), F.lit(0).alias("seen"),
    )
    turn = F.coalesce(F.col("turn").cast("string"), F.lit("-"))
    parts = F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>"))
    state = F.aggregate(parts, zero, lambda s, p: _visit(s, p, head, turn, role.isin(list(learn))))
    df = messages.select("conv_id", "turn", head.alias("head"), state.alias("state"))
    return df.select("conv_id", "turn", F.concat("head", "state.body", F.lit("<|end|>\n")).alias("segment"), F.col("state.spans").alias("loss_spans"), "state.attachments", "state.tokens")


def read_turns(segments: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and loss_text, decoded from segments (placeholders stay in the text)."""
    cut = F.locate("|>\n", F.col("segment"))
    body = F.substring(F.col("segment"), cut + 3, F.length("segment") - cut - 2 - len("<|end|>\n"))
    learned = F.transform("loss_spans", lambda s: F.substring(F.col("segment"), s["start"] + 1, s["length"]))
    return segments.select(
        "conv_id", "turn", unescape(F.substring(F.col("segment"), F.lit(3), cut - 3), ROLE_MARKS).alias("role"), unescape(body).alias("text"),
        unescape(F.array_join(learned, "")).alias("loss_text"), F.size("loss_spans").alias("n_spans"), F.length("segment").alias("n_chars"),
    )


def digest_conversations(segments: DataFrame) -> DataFrame:
    """Per conversation: number of turns, hashes of the turns and of the text under the mask, lengths."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "loss_text")))
    df = read_turns(segments).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), turns.alias("turns"), F.sum("n_chars").cast("bigint").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("turns", lambda t: t["loss_text"]), "")
    df = df.select("conv_id", "n_turns", said.alias("said"), loss.alias("loss"), "formatted_chars")
    return df.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op7_chat_format(spark, sf: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -1L AS conv_id, t AS turn, r AS role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digest_conversations(format_turns(rows.select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts"))))


ORACLE = """WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
j AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum(13 + length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'), '|', '&vert;'))
    + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;')))::BIGINT AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM j"""
