r"""Chat formatting with typed content parts, native.

A turn's content is an ordered list of typed parts (kind, text, ref, units).
A visitor, one function a kind, flattens each part into its piece of the
output: text is escaped, every other kind becomes a numbered placeholder such
as ``<image:3>``, an attachment record that keeps the reference, and the number
of tokens that the placeholder expands to. Pieces stand in order inside the
turn's marks::

    <turn>role<says>pieces</turn>

Escaping is reversible and leaves no control string in a text: each backslash
is doubled, and a backslash is put behind the first character of each control
string (``<\/turn>``), so the marks alone can match them. Reading back
(:func:`read_back`) splits at the marks and drops the lone backslashes.

The loss mask is a list of (turn, start, length) in code points of that turn's
block: the text pieces of assistant turns, never marks or placeholders.
Adjacent pieces are one span.

One conversation is one output value, as a training example is: its turns meet
in one row. Numbers of attachments and offsets are running sums within a
conversation, so the rows are shuffled once, by conversation.

Defined cases: a null text or role is an empty one; a turn of no parts is an
empty turn; a part of unknown kind or without a kind is a text part; null units count as 0,
a null ref stays null; turns are in order of their number, null first, ties by
role and text, and repeated rows are turns each; rows of a null conversation id
form one conversation; empty tables give no rows; extra columns are left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import table

PARTS = "array<struct<kind:string,text:string,ref:string,units:bigint>>"
#: Code points of one token of text; units of one token of each kind of attachment, rounded up.
TEXT_CHARS = 4
UNITS = {"image": 28 * 28, "audio": 40, "document": 4}
#: Every attachment expands to its placeholder's own begin and end as well.
FRAME_TOKENS = 2


@dataclass(frozen=True)
class Template:
    """Marks of a turn. All control strings begin with ``<``, which occurs in them once."""

    open: str = "<turn>"
    says: str = "<says>"
    close: str = "</turn>"
    kinds: tuple[str, ...] = tuple(UNITS)
    learned: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        if not all(c.startswith("<") and c.count("<") == 1 and "\\" not in c and len(c) > 1 for c in self.controls):
            raise ValueError("control strings begin with <, hold it once, and hold no backslash")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.open, self.says, self.close, *[f"<{k}:" for k in self.kinds])

    def escape(self, text: Column) -> Column:
        rest = "|".join(re.escape(c[1:]) for c in self.controls)
        return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"<(?={rest})", r"<\\")

    @staticmethod
    def unescape(text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_parts(text: Column) -> Column:
    """A plain text as a content of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("units"))).cast(PARTS)


def visit(part: Column, number: Column, template: Template) -> tuple[Column, Column, Column]:
    """Piece, whether it is an attachment, and expanded tokens of one part; number: of the attachment in its conversation."""
    text = F.coalesce(part["text"], F.lit(""))
    held, tokens = template.escape(text), F.ceil(F.char_length(text) / TEXT_CHARS)
    piece, attached = held, F.lit(False)
    for kind in template.kinds:
        own = part["kind"] == kind
        piece = F.when(own, F.concat(F.lit(f"<{kind}:"), number.cast("string"), F.lit(">"))).otherwise(piece)
        tokens = F.when(own, F.ceil(F.coalesce(part["units"], F.lit(0)) / UNITS.get(kind, 1)) + FRAME_TOKENS).otherwise(tokens)
        attached = F.when(own, F.lit(True)).otherwise(attached)
    return piece, F.coalesce(attached, F.lit(False)), tokens.cast("long")


def format_chats(turns: DataFrame, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None) -> DataFrame:
    """One row a conversation: conv_id, formatted, loss_spans, attachments and n_tokens.

    parts_col: a column of type ``PARTS`` that holds the contents; without it
    each text is one text part.
    """
    content = text_parts(F.col(text_col)) if parts_col is None else F.coalesce(F.col(parts_col), F.array().cast(PARTS))
    role = F.coalesce(F.col(role_col), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), content.alias("parts"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "parts")
    rows = rows.withColumn("pos", F.row_number().over(order)).select("conv_id", "pos", "role", F.posexplode_outer("parts").alias("at", "part"))
    kind = F.coalesce(F.col("part.kind").isin(*template.kinds), F.lit(False))
    so_far = Window.partitionBy("conv_id").orderBy("pos", "at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("number", F.sum(kind.cast("int")).over(so_far))
    piece, attached, tokens = visit(F.col("part"), F.col("number"), template)
    rows = rows.select("conv_id", "pos", "role", "at", F.col("part.kind").alias("kind"), F.col("part.ref").alias("ref"), "number", piece.alias("piece"), attached.alias("attached"), tokens.alias("tokens"))
    head = F.concat(F.lit(template.open), template.escape(F.col("role")), F.lit(template.says))
    inside = Window.partitionBy("conv_id", "pos").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.char_length(head) + F.coalesce(F.sum(F.char_length("piece")).over(inside), F.lit(0)))
    learned = F.col("role").isin(*template.learned) & ~F.col("attached") & (F.char_length("piece") > 0)
    span = F.when(learned, F.struct((F.col("pos") - 1).alias("turn"), F.col("start").alias("start"), F.char_length("piece").cast("long").alias("length")))
    record = F.when(F.col("attached"), F.struct("number", "kind", "ref", (F.col("pos") - 1).alias("turn"), F.coalesce("at", F.lit(0)).alias("part"), F.col("start").alias("start"), "tokens"))
    blocks = rows.withColumn("head", head).withColumn("span", span).withColumn("record", record).groupBy("conv_id", "pos").agg(
        F.first("head").alias("head"), F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("pieces"), F.array_sort(F.collect_list("span")).alias("spans"),
        F.array_sort(F.collect_list("record")).alias("records"), F.sum("tokens").alias("tokens"),
    )
    block = F.concat("head", F.array_join(F.transform("pieces", lambda p: p["piece"]), ""), F.lit(template.close))
    whole = blocks.select("conv_id", "pos", block.alias("block"), "spans", "records", "tokens").groupBy("conv_id")
    whole = whole.agg(F.array_sort(F.collect_list(F.struct("pos", "block", "spans", "records"))).alias("blocks"), F.sum("tokens").alias("n_tokens"))
    flat = lambda name: F.flatten(F.transform("blocks", lambda b: b[name]))
    return whole.select("conv_id", F.array_join(F.transform("blocks", lambda b: b["block"]), "").alias("formatted"), flat("spans").alias("loss_spans"), flat("records").alias("attachments"), "n_tokens")


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, turns (role and text of each) and loss_text, read from the columns formatted and loss_spans alone.

    Placeholders stay in the texts as they stand.
    """
    blocks = F.split("formatted", re.escape(template.close), -1)
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)
    parted = F.transform("blocks", lambda b: F.split(F.substr(b, F.lit(len(template.open) + 1)), re.escape(template.says), 2))
    turns = F.transform(parted, lambda b: F.struct(template.unescape(b[0]).alias("role"), template.unescape(b[1]).alias("text")))
    loss = F.transform("loss_spans", lambda s: template.unescape(F.substr(F.get(F.col("blocks"), s["turn"]), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.withColumn("blocks", blocks).select("conv_id", "formatted", turns.alias("turns"), F.array_join(loss, "").alias("loss_text"))


#: A conversation that holds a mark, an escape and another template's head.
TRAP = r"\### Assistant: </turn> ok"


def op12_chat(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRAP).alias("text"))
    back = read_back(format_chats(rows.unionByName(trap)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), sha(said).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"),
        sha(F.col("loss_text")).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(role) + length(text) + 6 + 6 + 7 + length(role || text) - length(replace(role || text, '\', ''))
    + len(regexp_extract_all(role, '<(turn>|says>|/turn>|image:|audio:|document:)')) + len(regexp_extract_all(text, '<(turn>|says>|/turn>|image:|audio:|document:)')) AS n FROM t),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, sum(n) AS n FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, n::BIGINT AS formatted_chars FROM g
"""
