r"""Chat formatting, in Spark expressions only.

A conversation becomes one string. Turns are collected as structs and sorted, adjacent turns of
one role form a block, and blocks are joined::

    <turn user>first text<next>second text</turn>
    <turn assistant>answer</turn>

Escaping is reversible and leaves no ``<`` in a text, so every ``<`` in the output is a control:
``\`` becomes ``\b`` and then ``<`` becomes ``\l`` (in roles also ``>`` becomes ``\g``). Undoing
the replacements in the opposite order gives the text back, whatever it holds.

Defined cases: a null text or role counts as empty; a null ``turn`` sorts first; rows that tie on
``turn`` are ordered by role, then text, and all are kept, repeated rows too; a null ``conv_id``
is a conversation of its own; texts of any length are taken whole (a conversation must fit one
string of Spark's, 2 GB); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Roles whose texts are trained on.
LOSS_ROLES = ("assistant",)

_OPEN, _NEXT, _CLOSE = "<turn ", "<next>", "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(">"), F.lit("\\g"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\g"), F.lit(">")))


#: Running sums are taken in chunks of so many, and those in chunks again.
_CHUNK = 64


def _let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _spans(pieces: Column) -> Column:
    """array<struct<start, length>> of the ``pieces`` (before, n, after, loss) under the loss.

    What stands before a piece is the sum of whole chunks of chunks, of whole chunks, and of pieces
    of its own chunk, so that the work grows with the number of pieces and not with its square.
    """
    add = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    part = lambda xs, i: add(F.slice(xs, (F.floor(i / _CHUNK) * _CHUNK + 1).cast("int"), i % _CHUNK))
    sums = lambda xs: F.transform(
        F.sequence(F.lit(0), F.floor(F.size(xs) / _CHUNK).cast("int")), lambda c: add(F.slice(xs, c * _CHUNK + 1, F.lit(_CHUNK)))
    )
    at = lambda i, size: F.floor(i / size).cast("int")

    def run(s):
        before = lambda i: part(s["n0"], i) + part(s["n1"], at(i, _CHUNK)) + add(F.slice(s["n2"], F.lit(1), at(i, _CHUNK * _CHUNK)))
        each = F.transform(s["p"], lambda p, i: F.struct((before(i) + p["before"]).alias("start"), p["n"].alias("length"), p["loss"].alias("loss")))
        return F.transform(F.filter(each, lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))

    sizes = lambda p: F.transform(p, lambda x: x["before"] + x["n"] + x["after"])
    with_sizes = _let(pieces, lambda p: F.struct(p.alias("p"), sizes(p).alias("n0")))
    with_sums = _let(with_sizes, lambda s: F.struct(s["p"].alias("p"), s["n0"].alias("n0"), sums(s["n0"]).alias("n1")))
    return _let(_let(with_sums, lambda s: F.struct(s["p"].alias("p"), s["n0"].alias("n0"), s["n1"].alias("n1"), sums(s["n1"]).alias("n2"))), run)


def format_chats(turns: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """(conv_id, formatted, loss_spans) with one row per conversation.

    ``loss_spans`` is the loss mask: start (from 0) and length, in code points of ``formatted``,
    of every text of a role in ``loss_roles``, in order. One shuffle, by conversation.
    """
    turn = F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    chats = turns.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))

    # positions where a block of one role begins, and the blocks between them
    starts = F.filter(
        F.sequence(F.lit(0), F.size("ts") - 1),
        lambda i: (i == 0) | (F.get("ts", i)["role"] != F.get("ts", F.greatest(i - 1, F.lit(0)))["role"]),
    )
    chats = chats.withColumn("starts", starts)
    blocks = F.transform(
        "starts",
        lambda s, k: F.struct(
            F.get("ts", s)["role"].alias("role"),
            F.transform(
                F.slice("ts", s + 1, F.coalesce(F.get("starts", k + 1), F.size("ts")) - s), lambda t: escape(t["text"])
            ).alias("texts"),
        ),
    )
    chats = chats.withColumn("blocks", blocks)
    head = lambda b: F.concat(F.lit(_OPEN), _escape_role(b["role"]), F.lit(">"))
    formatted = F.array_join(
        F.transform("blocks", lambda b: F.concat(head(b), F.array_join(b["texts"], _NEXT), F.lit(_CLOSE))), ""
    )
    # lengths around each text, from whose running sums the spans follow
    pieces = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.transform(
                b["texts"],
                lambda x, i: F.struct(
                    F.when(i == 0, F.length(head(b))).otherwise(len(_NEXT)).alias("before"),
                    F.length(x).alias("n"),
                    F.when(i == F.size(b["texts"]) - 1, len(_CLOSE)).otherwise(0).alias("after"),
                    b["role"].isin(*loss_roles).alias("loss"),
                ),
            ),
        )
    )
    spans = _spans(pieces)
    return chats.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns that ``format_chats`` wrote, in order."""
    blocks = F.filter(F.split(formatted, "</turn>\n", -1), lambda b: b != "")
    body = lambda b: F.substr(b, F.position(F.lit(">"), b) + 1)
    role = lambda b: F.substr(b, F.lit(len(_OPEN) + 1), F.position(F.lit(">"), b) - len(_OPEN) - 1)
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(body(b), "<next>", -1),
                lambda x: F.struct(_unescape_role(role(b)).alias("role"), unescape(x).alias("text")),
            ),
        )
    )


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), ""
    )


def digest_chats(chats: DataFrame) -> DataFrame:
    """What is read back from ``format_chats``'s output: counts and digests per conversation."""
    told = chats.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return told.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(all_turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
