"""Transcripts, chats, mail and calendars as rows."""

from __future__ import annotations

import email
import email.policy
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import normalize_whitespace

TIME = r"(\d{1,2}:)?(\d{1,2}):(\d{2})[.,](\d{3})"


def _ms(c: Column) -> Column:
    part = lambda n: F.coalesce(F.expr("1") * F.nullif(F.regexp_replace(F.regexp_extract(c, TIME, n), ":", ""), F.lit("")).cast("long"), F.lit(0))
    return ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4)


def cues(transcripts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, at, start_ms, end_ms, said) of SRT or VTT texts."""
    blocks = transcripts.select(key, F.posexplode(F.split(F.regexp_replace(text, "\r", ""), r"\n[ \t]*\n")).alias("at", "block"))
    line = F.regexp_extract("block", rf"(?m)^({TIME}\s+-->\s+{TIME}.*)$", 1)
    said = normalize_whitespace(F.regexp_replace(F.regexp_extract("block", rf"(?s){TIME}\s+-->\s+{TIME}[^\n]*\n(.*)$", 9), "<[^>]+>", ""))
    rows = blocks.withColumn("line", line).where("line <> ''")
    return rows.select(key, "at", _ms(F.split("line", "-->")[0]).alias("start_ms"), _ms(F.split("line", "-->")[1]).alias("end_ms"), said.alias("said"))


def cue_summary(rows: DataFrame, key: str = "id") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("segments"), F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"))


def channel_days(messages: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """One row for each (channel, day) of messages (channel, ts, user, text, thread): counts, threads with replies, first time, participants, text in order of time."""
    rows = messages.withColumn("day", F.to_date("ts"))
    if users is not None:
        rows = rows.join(users.select(F.col("id").alias("user"), "name"), "user", "left").withColumn("user", F.coalesce("name", "user"))
    reply = F.when(F.col("thread").isNotNull() & (F.col("thread") != F.col("ts").cast("string")), F.col("thread"))
    lines = F.array_sort(F.collect_list(F.struct("ts", F.concat_ws(": ", "user", "text").alias("line"))))
    return rows.groupBy("channel", "day").agg(
        F.count("*").alias("messages"), F.count_distinct(reply).alias("threads"), F.min("ts").alias("first_ts"), F.sort_array(F.collect_set("user")).alias("participants"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text")
    )


def mails(raw: DataFrame, key: str = "id", text: str = "raw") -> DataFrame:
    """(key, message_id, conversation, subject, sent, participants, body) of raw messages; several in an mbox."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, source in zip(batch["k"], batch["raw"], strict=True):
                for one in re.split(r"(?m)^From \S+.*\n", source or ""):
                    if not one.strip():
                        continue
                    m = email.message_from_string(one, policy=email.policy.default)
                    body = m.get_body(preferencelist=("plain", "html"))
                    refs = (m.get("References") or "").split()
                    people = {a.strip().lower() for h in ("From", "To", "Cc") for a in re.findall(r"[\w.+-]+@[\w.-]+", m.get(h) or "")}
                    rows.append((k, m.get("Message-ID"), m.get("Message-ID") or m.get("In-Reply-To") or (refs[0] if refs else None), m.get("Subject"), m.get("Date"), sorted(people), body.get_content() if body else ""))
            yield pd.DataFrame(rows, columns=["k", "message_id", "conversation", "subject", "sent", "participants", "body"])

    kind = raw.schema[key].dataType.simpleString()
    made = raw.select(F.col(key).alias("k"), F.col(text).alias("raw")).mapInPandas(parse, f"k {kind}, message_id string, conversation string, subject string, sent string, participants array<string>, body string")
    return made.withColumnRenamed("k", key)


def events(calendars: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, uid, title, starts, ends, organizer, location) of iCalendar texts, folded lines joined."""
    whole = F.regexp_replace(F.regexp_replace(F.col(text), "\r", ""), "\n[ \t]", "")
    blocks = calendars.select(key, F.explode(F.regexp_extract_all(whole, F.lit("(?s)BEGIN:VEVENT(.*?)END:VEVENT"), F.lit(1))).alias("b"))
    field = lambda name: F.nullif(F.trim(F.regexp_extract("b", rf"(?m)^{name}[^:\n]*:(.*)$", 1)), F.lit(""))
    moment = lambda name: F.try_to_timestamp(F.regexp_replace(field(name), "Z$", ""), F.lit("yyyyMMdd'T'HHmmss"))
    return blocks.select(key, field("UID").alias("uid"), field("SUMMARY").alias("title"), moment("DTSTART").alias("starts"), moment("DTEND").alias("ends"), F.regexp_replace(field("ORGANIZER"), "(?i)^mailto:", "").alias("organizer"), field("LOCATION").alias("location"))
