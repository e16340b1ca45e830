"""Titles, dates, people, places and types from the head of a transcribed document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, normalize_field, strip

# The words and abbreviations that headers are recognised by.
_DAYS = "Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday"
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
_SHORT_MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
_STATES = rf"Ill\.?|D\.?{WS}*C\.?|S\.?{WS}*C\.?|N\.?{WS}*Y\.?|Pa\.?|Mass\.?|Va\.?|Md\.?|Ohio|Cal\.?|W\.?{WS}*Va\.?"
NOT_PLACES = [
    "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday",
    "Lincoln", "Abraham", "President", "Smith", "From", "Dear", "Private",
]
SPEECH_TITLES = ["address", "speech", "inaugural"]
SPEECH_OPENINGS = ["four score", "fellow countrymen", "my fellow citizens"]
SPEAKER = "Abraham Lincoln"

# The patterns of header fields.
_DATE = rf"((?:{_MONTHS}){WS}+\d{{1,2}},?{WS}*\d{{4}})"
_TITLE = rf"(?s)General Correspondence\.{WS}*[\d\-]+:{WS}*(.+?)(?:{WS}+Abraham Lincoln Papers)"
_DATES = [rf"(?:{_DAYS}),?{WS}*{_DATE}", rf"\[{_DATE}\]", rf",{WS}*{_DATE}"]
_PERSON = r"([A-Z][A-Za-z.\s\x1c-\x1f]+?)"
_FROM_TO = rf"(?:From{WS}+)?{_PERSON}{WS}+to{WS}+{_PERSON}(?:,|{WS}+and{WS}+|{WS}*(?:{_DAYS})|{WS}*\[|{WS}*\d)"
_TO = rf"To{WS}+(?:the{WS}+)?([A-Z][A-Za-z\s\x1c-\x1f]+?)(?:{WS}*&|{WS}*\n)"
_SIGNED = rf"(?:Yours truly|Respectfully|Sincerely){WS}*\n*{_PERSON}(?:\n|\z)"
_CITY_STATE = rf"([A-Z][a-z]+){WS}+({_STATES}){WS}*\.?{WS}*(?:{_MONTHS}|{_SHORT_MONTHS})"
_CITY = rf"([A-Z][a-z]+),{WS}*(?:{_MONTHS}|{_SHORT_MONTHS}){WS}+\d{{1,2}},?{WS}*\d{{4}}"


def _find(text: Column, pattern: str, group: int = 1) -> Column:
    """The stripped group of the first match, null if there is none or it is empty."""
    return F.nullif(strip(F.regexp_extract(text, "(?U)" + pattern, group)), F.lit(""))


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return F.coalesce(out, F.lit(False))


def parse_header(content: Column) -> Column:
    """struct<title, date, from, to, place, document_type>; what is not found is null."""
    head = F.substring(content, 1, 2000)
    lines = F.transform(F.slice(F.split(strip(content), "\n", -1), 1, 3), strip)
    line = F.get(F.filter(lines, lambda x: F.length(x) > 10), F.lit(0))
    title = F.coalesce(normalize_field(_find(head, _TITLE)), normalize_field(F.substring(line, 1, 200)))
    date = F.coalesce(*[_find(head, p) for p in _DATES])

    recipient = _find(F.substring(content, 1, 500), _TO)
    recipient = F.when(F.contains(recipient, F.lit("President")), SPEAKER).otherwise(recipient)
    to = F.coalesce(_find(head, _FROM_TO, 2), recipient)
    sender = F.coalesce(_find(head, _FROM_TO, 1), _find(content, _SIGNED))

    body = F.substring(content, 1, 3500)
    named = lambda city: ~city.isin(*NOT_PLACES)
    city, state, alone = _find(body, _CITY_STATE, 1), _find(body, _CITY_STATE, 2), _find(body, _CITY, 1)
    place = F.coalesce(F.when(named(city), F.concat_ws(", ", city, state)), F.when(named(alone), alone))

    low = F.lower(title)
    speech = _any(low, SPEECH_TITLES) | _any(F.lower(F.substring(content, 1, 500)), SPEECH_OPENINGS)
    kind = (
        F.when(speech, "Speech").when(sender.isNotNull() & to.isNotNull(), "Letter").when(_any(low, ["report"]), "Report").otherwise("Document")
    )
    sender = F.when(speech, F.coalesce(sender, F.lit(SPEAKER))).otherwise(sender)
    return F.struct(
        title.alias("title"), date.alias("date"), sender.alias("from"), to.alias("to"), place.alias("place"), kind.alias("document_type")
    )
