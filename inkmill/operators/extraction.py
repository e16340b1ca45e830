"""Event extraction: prompts, replies and the records made of them.

Three ways lead to one record for each (document, event): all events of a small document in one
reply, two stages over the batches of a book, or one reply over retrieved passages. Replies come
from a ``Completer`` (see ``models``); what failed or is missing becomes an empty record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.links import event_slug
from ..functions.prompts import bullets, passages, render
from ..schemas import EVENTS, REPLIES, REPLY
from . import chunking

#: What an empty record says about its tone: nothing was found, or the reply failed.
NOTHING, FAILED = "Not mentioned", "Error in extraction"
NO_TEXT = "No information found."

DIRECT_PROMPT = """Read the document and report what it says about each of the events.

Document: {document_title}
Author: {author}

Events:
{events_list}

Text:
{document_content}

Reply with JSON only, one entry for each event, with empty claims for events that are not mentioned:
{{"extractions": [{{"event": "...", "author": "{author}", "claims": ["..."], "temporal_details": {{"date": null, "time": null}}, "tone": "..."}}]}}
"""
BATCH_PROMPT = """Copy the passages of this part of a book that concern each of the events.

Document: {document_title}
Author: {author}
Part {batch_num} of {total_batches}

Events:
{events_list}

Text:
{batch_content}

Reply with JSON only, an object from each event's name to a list of passages, empty if there are none.
"""
FINAL_PROMPT = """Sum up what the passages say about one event. Do not repeat similar claims.

Document: {document_title}
Author: {author}
Event: {event_name}

Passages:
{source_content}

Reply with JSON only:
{{"event": "{event_name}", "author": "{author}", "claims": ["..."], "temporal_details": {{"date": null, "time": null}}, "tone": "..."}}
"""



def _events_list() -> Column:
    return F.lit("\n".join(f"- {e}" for e in EVENTS))


def with_events(docs: DataFrame, events: DataFrame) -> DataFrame:
    """Every document with every event of the (small, fixed) dimension."""
    return docs.crossJoin(F.broadcast(events))


def assemble(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, event, text): one text for each (document, event), its parts in order of batches.

    ``pairs``: doc_id, event, title, author. ``found``: doc_id, event, batch_num, excerpts. Batches
    without a non-empty excerpt are left out; a pair without any has a fixed sentence instead.
    """
    parts = found.withColumn("x", F.filter("excerpts", lambda e: e.isNotNull() & (e != ""))).filter(F.size("x") > 0)
    section = F.concat(
        F.lit("\n## CHUNK "), F.col("batch_num").cast("string"), F.lit("\n"), F.array_join(F.transform("x", lambda e: F.concat(e, F.lit("\n\n"))), "")
    )
    body = parts.select("doc_id", "event", F.struct("batch_num", section.alias("s")).alias("part")).groupBy("doc_id", "event").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["s"]), "").alias("body")
    )
    head = render("# INTERMEDIATE EXTRACTION\n\n# EVENT: {e}\n\n# BOOK: {t}\n\n# AUTHOR: {a}\n\n", e=event_slug(F.col("event")), t=F.col("title"), a=F.col("author"))
    text = F.coalesce(F.concat(head, F.col("body"), F.lit("\n# END")), F.lit(NO_TEXT))
    return pairs.join(body, ["doc_id", "event"], "left").select("doc_id", "event", text.alias("text"))


def record(reply: Column, event: Column, author: Column, tone: str | Column) -> Column:
    """A reply's record, or an empty one with ``tone`` where the reply has no event."""
    tone = F.lit(tone) if isinstance(tone, str) else tone
    empty = F.struct(
        event.alias("event"), author.alias("author"), F.array().cast("array<string>").alias("claims"),
        F.struct(F.lit(None).cast("string").alias("date"), F.lit(None).cast("string").alias("time")).alias("temporal_details"), tone.alias("tone"),
    )
    return F.when(reply["event"].isNotNull(), reply).otherwise(empty)


def _records(rows: DataFrame, reply: Column) -> DataFrame:
    """Metadata comes from the document, whatever a reply says about it."""
    e = reply
    return rows.select(
        F.col("id").alias("document_id"), F.col("title").alias("document_title"), "document_type", e["event"].alias("event"), e["author"].alias("author"),
        F.coalesce(e["claims"], F.array().cast("array<string>")).alias("claims"), e["temporal_details"].alias("temporal_details"), e["tone"].alias("tone"),
    )


def direct(docs: DataFrame, complete, fill: DataFrame | None = None) -> DataFrame:
    """Records of small documents (id, title, document_type, author, content), all events in one reply.

    A document whose reply fails has no records; with ``fill`` (the small event dimension) it has
    an empty one for each event that is missing. Each document is asked about once.
    """
    prompt = render(DIRECT_PROMPT, document_title=F.col("title"), author=F.col("author"), events_list=_events_list(), document_content=F.col("content"))
    replied = complete(docs.withColumn("prompt", prompt)).withColumn("r", F.from_json("reply", REPLIES))
    if fill is None:
        return _records(replied.select("*", F.explode("r.extractions").alias("e")), F.col("e"))
    wanted = F.broadcast(fill.agg(F.collect_list("event").alias("wanted")))
    known = F.coalesce("r.extractions", F.array().cast(replied.schema["r"].dataType["extractions"].dataType))
    missing = F.filter("wanted", lambda w: ~F.coalesce(F.exists(known, lambda e: e["event"] == w), F.lit(False)))
    empty = F.transform(missing, lambda w: record(F.lit(None).cast(REPLY), w, F.col("author"), NOTHING))
    every = replied.crossJoin(wanted).select("*", F.explode(F.concat(known, empty.cast(replied.schema["r"].dataType["extractions"].dataType))).alias("e"))
    return _records(every, F.col("e"))


def batched(books: DataFrame, events: DataFrame, complete, size: int = chunking.BATCH_CHARS, overlap: int = chunking.BATCH_OVERLAP) -> DataFrame:
    """Records of books in two stages: passages of each batch for all events, then one reply for
    each (book, event) that has passages."""
    meta = books.select("id", "title", "document_type", "author")
    parts = chunking.batch_documents(books, size, overlap, doc_id="id")
    totals = parts.groupBy("id").agg(F.max("batch_num").alias("total"))
    prompt = render(
        BATCH_PROMPT, document_title=F.col("title"), author=F.col("author"), batch_num=F.col("batch_num"), total_batches=F.col("total"),
        events_list=_events_list(), batch_content=F.col("text"),
    )
    asked = parts.join(totals, "id").join(meta, "id").select("id", "batch_num", prompt.alias("prompt"))
    found = complete(asked).select("id", "batch_num", F.explode(F.from_json("reply", "map<string,array<string>>")).alias("event", "excerpts"))
    found = found.join(F.broadcast(events.select("event")), "event", "left_semi").withColumnRenamed("id", "doc_id")
    pairs = with_events(meta, events.select("event"))
    texts = assemble(pairs.withColumnRenamed("id", "doc_id"), found).withColumnRenamed("doc_id", "id")
    rows = pairs.join(texts, ["id", "event"])
    final = render(FINAL_PROMPT, document_title=F.col("title"), author=F.col("author"), event_name=F.col("event"), source_content=F.col("text"))
    # one branch, so that no prompt of the first stage is asked twice; a null prompt is not asked
    every = complete(rows.withColumn("prompt", F.when(F.col("text") != NO_TEXT, final))).withColumn("r", F.from_json("reply", REPLY))
    return _records(every, record(F.col("r"), F.col("event"), F.col("author"), NOTHING))


def retrieved(books: DataFrame, hits: DataFrame, complete) -> DataFrame:
    """Records from retrieved passages. ``books``: id, title, document_type, author and event, one
    row for each pair. ``hits``: id, event, rank, text."""
    joined = hits.groupBy("id", "event").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda h: h["text"]).alias("texts"))
    rows = books.join(joined, ["id", "event"], "left")
    prompt = render(FINAL_PROMPT, document_title=F.col("title"), author=F.col("author"), event_name=F.col("event"), source_content=passages(F.col("texts")))
    every = complete(rows.withColumn("prompt", F.when(F.col("texts").isNotNull(), prompt))).withColumn("r", F.from_json("reply", REPLY))
    tone = F.when(F.col("texts").isNull(), NOTHING).otherwise(FAILED)
    return _records(every, record(F.col("r"), F.col("event"), F.col("author"), tone))


def claims_prompt(template: str, primary: Column, author: Column, **more: Column) -> Column:
    """A judge's prompt over two lists of claims."""
    return render(template, lincoln_claims=bullets(primary), author_claims=bullets(author), **more)
