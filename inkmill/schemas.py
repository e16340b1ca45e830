"""Declared schemas of the data model, as Spark DDL."""

from __future__ import annotations

BOOK_META = "id int, title string, authors string, reference string"
ARCHIVE_META = (
    "id string, files array<string>, url string, url_type string, title string, document_type string, date string, place string, `from` string, `to` string"
)
DOCUMENT = "id string, title string, reference string, document_type string, date string, place string, `from` string, `to` string, content string"
BATCH = "doc_id string, batch_num int, content string"
CHUNK = "doc_id string, chunk_id int, text string, start_char int, end_char int"
SEARCH_HIT = "query_id string, doc_id string, chunk_id int, rank int, score double"
TEMPORAL = "struct<date:string,time:string>"
EXTRACTION = (
    f"document_id string, document_title string, document_type string, event string, author string, claims array<string>, temporal_details {TEMPORAL}, tone string"
)
#: What a model replies for one event; missing keys are null.
REPLY = f"struct<event:string,author:string,claims:array<string>,temporal_details:{TEMPORAL},tone:string>"
REPLIES = f"struct<extractions:array<{REPLY}>>"
RUN = (
    "metadata struct<extraction_timestamp:string,target_events:array<string>,model_used:string,loc_documents_processed:int,gutenberg_documents_processed:int>, "
    f"loc_extractions array<struct<document_id:string,document_title:string,document_type:string,extractions:array<{REPLY}>>>, "
    f"gutenberg_extractions array<struct<document_id:string,document_title:string,document_type:string,extractions:array<{REPLY}>>>"
)
PAIR = "event string, primary_claims array<string>, author string, author_claims array<string>, doc_info string"
JUDGMENT = (
    "event string, author string, prompt_type string, run int, consistency_score int, contradictions array<struct<type:string,reason:string>>, reasoning string, error string"
)
LABEL = "id int, event string, author string, source string, rating string, notes string"

# The events that documents are searched for, in order.
EVENTS = [
    "Election Night 1860",
    "Fort Sumter Decision",
    "Gettysburg Address",
    "Second Inaugural Address",
    "Ford's Theatre Assassination",
]


def events(spark):
    """The event dimension: event_ord, event and slug; five rows."""
    from pyspark.sql import functions as F

    from .functions.links import event_slug

    rows = spark.createDataFrame(list(enumerate(EVENTS)), "event_ord int, event string")
    return rows.withColumn("slug", event_slug(F.col("event")))
