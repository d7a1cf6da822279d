r"""Chat formatting with typed content parts, and the reader that gets turns and loss text back.

A turn has a role and a list of parts, each a text, image, audio or document.  A visitor walks the parts in order: a text is
escaped, any other part becomes a placeholder ``<|image:2|>`` (its kind and its place among the turn's parts) and an
attachment with its reference, its offset and the number of tokens that the placeholder expands to.  A turn is written as

    <|turn|>role<|text|>parts</s>

and a conversation is its turns one after another.  Each turn is a row of its own (``formatted``), made from that row alone,
without a shuffle, so a conversation may hold any share of all rows.  The loss mask of a turn is the list of spans (offset
and length in code points of ``formatted``) of the texts of assistants; marks and placeholders are never in it.

Escapes: a backslash becomes two, and one is put after the first character wherever a control string begins, so no mark of
this template or of other common ones is left in a text.  To read a text back, drop the backslash before each character.

``read_back`` looks at nothing but ``formatted`` and the spans.  It reads a conversation's turns in order as one stream, cut
at marks, and keeps one turn and running digests, never a conversation.  A digest of a conversation is by nature made in
order, so one conversation's formatted turns pass through one task, in bounded memory.

Turns come in the order of ``turn`` (null last), then role, then formatted text, so ties and repeated rows have one result.
Null roles and texts are empty; null or empty lists of parts give an empty text; a null part is an empty text and one of an
unknown kind is a document; a null size counts as the least.  A null conversation id is a conversation of its own.  Columns
of other names are never looked at.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import isolate

TURN, TEXT, END = "<|turn|>", "<|text|>", "</s>"

#: A control string begins with the first group, followed by one of the rest: this template's marks and those of common others.
CONTROL = r"([<\[])(\||/?s>|</?SYS>>|/?INST\])"

#: Tokens of a placeholder: an image has one for each square of so many pixels, audio so many a second, a document so many a page.
IMAGE_PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256

PART = "struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"


def escape(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, r"$1\\$2")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def expanded_tokens(part: Column) -> Column:
    """Tokens that a part's placeholder expands to; at least one, and none for a text."""
    squares = lambda side: F.greatest(F.lit(1), F.ceil(F.coalesce(part[side], F.lit(1)) / IMAGE_PATCH))
    counts = (
        F.when(part["kind"] == "text", 0)
        .when(part["kind"] == "image", squares("width") * squares("height"))
        .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE))
        .otherwise(F.coalesce(part["pages"], F.lit(1)).cast("long") * PAGE_TOKENS)
    )
    return F.when(part["kind"] == "text", F.lit(0)).otherwise(F.greatest(F.lit(1), counts)).cast("long")


def text_part(text: Column) -> Column:
    """A list of one text, for tables without other parts."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]))


def visit(parts: Column) -> Column:
    """Each part as (kind, ref, body, size, tokens): what it is written as, its length and what that expands to."""

    def one(part: Column, k: Column) -> Column:
        kind = F.coalesce(part["kind"], F.lit("text"))
        kind = F.when(kind.isin("text", "image", "audio"), kind).otherwise("document")
        known = F.struct(kind.alias("kind"), *[part[n].alias(n) for n in ("text", "ref", "width", "height", "seconds", "pages")])
        body = F.when(kind == "text", escape(part["text"])).otherwise(F.concat(F.lit("<|"), kind, F.lit(":"), (k + 1).cast("string"), F.lit("|>")))
        return F.struct(kind.alias("kind"), part["ref"].alias("ref"), body.alias("body"), F.char_length(body).cast("long").alias("size"), expanded_tokens(known).alias("tokens"))

    return F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), one)


def format_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """conv_id, turn, role, formatted, loss array<struct<at, size>>, attachments array<struct<place, kind, ref, at, tokens>>, one row for each turn."""
    rows = isolate(turns, conv_id, turn, role, parts).toDF("conv_id", "turn", "role", "parts")
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    seen = rows.select("conv_id", "turn", "role", head.alias("head"), visit(F.col("parts")).alias("seen"))
    # offsets: each part begins where the sizes of those before it end
    sizes = F.transform("seen", lambda p: p["size"])
    ends = F.aggregate(sizes, F.array(F.char_length("head").cast("long")), lambda a, s: F.concat(a, F.array(F.element_at(a, -1) + s)))
    placed = seen.withColumn("ends", F.when(F.size("seen") == 1, F.array(F.char_length("head").cast("long"))).otherwise(ends))
    placed = placed.withColumn("seen", F.transform("seen", lambda p, k: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), p["body"].alias("body"), p["size"].alias("size"), p["tokens"].alias("tokens"), F.get("ends", k).alias("at"), (k + 1).alias("place"))))
    learned = lambda p: (p["kind"] == "text") & (p["size"] > 0) & F.coalesce(F.col("role") == "assistant", F.lit(False))
    return placed.select(
        "conv_id",
        "turn",
        "role",
        F.concat("head", F.array_join(F.transform("seen", lambda p: p["body"]), ""), F.lit(END)).alias("formatted"),
        F.transform(F.filter("seen", learned), lambda p: F.struct(p["at"].alias("at"), p["size"].alias("size"))).alias("loss"),
        F.transform(F.filter("seen", lambda p: p["kind"] != "text"), lambda p: F.struct(p["place"].alias("place"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["at"].alias("at"), p["tokens"].alias("tokens"))).alias("attachments"),
    )


MARKED = re.compile(f"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}", re.DOTALL)


class Reader:
    """Running digests of one conversation, fed with its formatted pieces in order."""

    def __init__(self) -> None:
        self.turns = self.chars = self.learned = 0
        self.rest, self.whole, self.loss = "", hashlib.sha256(), hashlib.sha256()

    def feed(self, formatted: str, loss: list[dict]) -> None:
        self.chars += len(formatted)
        for span in loss:
            text = unescape(formatted[span["at"] : span["at"] + span["size"]])
            self.learned += len(text)
            self.loss.update(text.encode("utf-8", "surrogatepass"))
        stream, end = self.rest + formatted, 0
        for m in MARKED.finditer(stream):
            self.turns, end = self.turns + 1, m.end()
            self.whole.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
        self.rest = stream[end:]

    def row(self) -> tuple:
        if self.rest:
            raise ValueError(f"no turn can be read from {self.rest[:80]!r}")
        return self.turns, self.whole.hexdigest(), self.learned, self.loss.hexdigest(), self.chars


READ = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, from what ``format_turns`` wrote."""
    kind = formatted.schema["conv_id"].dataType
    schema = f"conv_id {kind.simpleString()}, {READ}"
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, now, done = None, None, []
        types = None
        for batch in batches:
            types = types or pa.schema([("conv_id", batch.schema.field("conv_id").type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
            for at in range(0, batch.num_rows, 256):  # few turns at a time as Python objects
                piece = batch.slice(at, 256)
                for conv, text, loss in zip(piece.column("conv_id").to_pylist(), piece.column("formatted").to_pylist(), piece.column("loss").to_pylist(), strict=True):
                    if reader is None or conv != now:
                        if reader is not None:
                            done.append((now, *reader.row()))
                        reader, now = Reader(), conv
                    reader.feed(text, loss)
            if len(done) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*done, strict=True), types, strict=True)], schema=types)
                done = []
        if reader is not None:
            done.append((now, *reader.row()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*done, strict=True), types, strict=True)], schema=types)

    rows = formatted.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), "formatted", "loss")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "formatted")
    return ordered.select("conv_id", "formatted", "loss").mapInArrow(read, schema).select(*names)
