"""Web pages and mail bodies as readable text, and messages as rows."""

from __future__ import annotations

import html
from collections.abc import Iterator
from email import message_from_bytes, policy

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketmill.sources import files

#: Elements whose content is no text, and those that end a line.
SILENT, BLOCKS = "script|style|head|title|noscript", "p|div|br|li|tr|h[1-6]|ul|ol|table|blockquote|article|section|nav|footer|header"
MESSAGE = "struct<message_id: string, in_reply_to: string, refs: array<string>, sender: string, to: array<string>, cc: array<string>, subject: string, sent_at: string, body: string, html: string, attachments: array<struct<name: string, type: string, size: bigint>>, problem: string>"


def markup_to_lines(page: Column) -> Column:
    """Text of a page with entities still in it: silent elements gone, blocks on lines of their own."""
    text = F.regexp_replace(page, r"(?is)<!--.*?-->", "")
    text = F.regexp_replace(text, rf"(?is)<({SILENT})\b[^>]*>.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"\s+", " ")
    text = F.regexp_replace(text, rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    text = F.regexp_replace(F.regexp_replace(text, r" *\n *", "\n"), r"\n{2,}", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"^\n+", ""), r"\n+$", ""))


def to_text(page: Column) -> Column:
    """Readable text of a page."""

    @F.pandas_udf("string")
    def decoded(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: None if x is None else html.unescape(x).replace("\xa0", " "))

    return decoded(markup_to_lines(page))


def quoted(body: str, most: int = 20) -> str:
    """Innermost quotations first, as lines with a mark in front."""
    import re

    for _ in range(most):
        new = re.sub(r"(?is)<blockquote\b[^>]*>((?:(?!<blockquote\b).)*?)</blockquote\s*>", lambda m: "\n" + "\n".join(f"> {x.strip()}" for x in re.sub(r"(?i)<br\s*/?>|</p>", "\n", m[1]).strip().split("\n")) + "\n", body)
        if new == body:
            break
        body = new
    return body


def _message(data: bytes) -> dict:
    m = message_from_bytes(data, policy=policy.default)
    get = lambda name: (str(m.get_all(name)[-1]).strip() if m.get_all(name) else None)
    many = lambda name: [a.addr_spec.lower() for h in m.get_all(name, []) for a in getattr(h, "addresses", ())]
    plain, rich = m.get_body(("plain",)), m.get_body(("html",))
    parts = [{"name": p.get_filename(), "type": p.get_content_type(), "size": len(p.get_payload(decode=True) or b"")} for p in m.iter_attachments()]
    sender = many("From")
    return {"message_id": get("Message-ID"), "in_reply_to": get("In-Reply-To"), "refs": (get("References") or "").split(), "sender": sender[0] if sender else None, "to": many("To"), "cc": many("Cc"), "subject": get("Subject"), "sent_at": get("Date"), "body": plain.get_content() if plain else None, "html": rich.get_content() if rich else None, "attachments": parts, "problem": None}


def messages(files: DataFrame) -> DataFrame:
    """(path and the fields of MESSAGE): one row for each raw message; damage is told in `problem`."""

    @F.pandas_udf(MESSAGE)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for data in batch:
                try:
                    rows.append(_message(bytes(data)))
                except Exception as e:  # headers and encodings are broken in many ways
                    rows.append(dict.fromkeys(["message_id", "in_reply_to", "refs", "sender", "to", "cc", "subject", "sent_at", "body", "html", "attachments"]) | {"problem": type(e).__name__})
            yield pd.DataFrame(rows)

    return files.select("path", of("content").alias("m")).select("path", "m.*")


#: A webhook's message as JSON.
WEBHOOK = "MessageID string, `From` string, `To` string, Subject string, TextBody string, Headers array<struct<Name: string, Value: string>>, Attachments array<struct<Name: string, ContentType: string, ContentLength: bigint>>"


def from_webhook(payload: Column) -> Column:
    """A webhook's JSON as a struct; null where it is no JSON."""
    return F.from_json(payload, WEBHOOK)


#: Another vendor's message as JSON: addresses as texts or lists, and the conversation under one of several names.
VENDOR = {k: "string" for k in ("message_id", "thread_id", "threadId", "conversation_id", "in_reply_to", "from", "from_", "subject", "text", "html", "timestamp")} | {"to": "array<string>", "cc": "array<string>", "attachments": "array<struct<filename: string, content_type: string, size: bigint>>"}


def from_vendor(payload: Column) -> Column:
    """Another vendor's JSON, bare or under `message`, as the fields of MESSAGE with the conversation as `thread`: its first name
    that is given, else the message that this one answers, else the message itself. Null where it is no JSON."""
    fields = ", ".join(f"`{k}`: {t}" for k, t in VENDOR.items())
    inner, outer = F.from_json(payload, f"struct<{fields}>"), F.from_json(payload, f"struct<message: struct<{fields}>>")["message"]
    m = F.when(outer.isNotNull(), outer).otherwise(inner)
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    thread = F.coalesce(*(blank(m[n]) for n in ("thread_id", "threadId", "conversation_id", "in_reply_to", "message_id")))
    parts = F.transform(m["attachments"], lambda x: F.struct(x["filename"].alias("name"), x["content_type"].alias("type"), x["size"].alias("size")))
    found = F.struct(m["message_id"].alias("message_id"), thread.alias("thread"), F.coalesce(m["from"], m["from_"]).alias("sender"), m["to"].alias("to"), m["cc"].alias("cc"), m["subject"].alias("subject"), m["text"].alias("body"), m["html"].alias("html"), parts.alias("attachments"))
    return F.when(m["message_id"].isNotNull() | thread.isNotNull(), found)


def outbound(to: Column, subject: Column, body: Column, *, cc: Column | None = None, in_reply_to: Column | None = None) -> Column:
    """A message to be sent as JSON; what is null is left out, and an answer names what it answers in both of its headers."""
    headers = F.when(in_reply_to.isNotNull(), F.create_map(F.lit("In-Reply-To"), in_reply_to, F.lit("References"), in_reply_to)) if in_reply_to is not None else F.lit(None).cast("map<string,string>")
    return F.to_json(F.struct(to.alias("to"), (cc if cc is not None else F.lit(None).cast("array<string>")).alias("cc"), subject.alias("subject"), body.alias("text"), headers.alias("headers")))


def all_blocks(found: DataFrame) -> DataFrame:
    """(path, idx, kind, text, problem): the blocks of files (path, content) of any kind that has a reader, told by their
    bytes: office files by their own readers, pages and plain texts line by line, mails by their plain body or their page.
    A line end at the end of a text begins no line; bytes that are
    no UTF-8 are shown as unknown characters. Other kinds give a row with the problem `no reader: KIND`."""
    known = files.identified(found)
    office = files.office_blocks(found).select("path", "idx", "kind", "text", "problem")
    text = F.make_valid_utf8(F.col("content").cast("string"))
    plain = known.where("kind = 'text'").select("path", text.alias("text"))
    pages = known.where("kind = 'html'").select("path", to_text(text).alias("text"))
    mails = messages(known.where("kind = 'eml'").select("path", "content"))
    bodies = mails.where("problem is null").select("path", F.coalesce("body", to_text(F.col("html")), F.lit("")).alias("text"))
    lines = plain.union(pages).union(bodies).select("path", F.posexplode(F.split(F.regexp_replace("text", r"(?:\r\n|\r|\n)\z", ""), r"\r\n|\r|\n", -1)).alias("idx", "text"))
    lines = lines.select("path", "idx", F.lit("line").alias("kind"), "text", F.lit(None).cast("string").alias("problem"))
    rest = known.where(~F.col("kind").isin("text", "html", "eml", *files.READERS)).select("path", F.concat(F.lit("no reader: "), "kind").alias("problem")).union(mails.where("problem is not null").select("path", "problem"))
    return office.union(lines).union(rest.select("path", F.lit(None).cast("int").alias("idx"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("text"), "problem"))
