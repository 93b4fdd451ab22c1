"""What travels with an office file: packages within it, links out of it, names in its properties, watermarks.

A package is a zip of parts that relationship files connect. The walk goes along the relationships and into packages within,
to a stated depth, and gives a row for each thing found; what is refused or can't be read is a row as well.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketmill.sources.files import LEFTOVERS, MEMBERS, MOST_BYTES, MOST_ENTRIES, MOST_RATIO, RATIO_FROM, W

FOUND = "array<struct<place: string, depth: int, kind: string, what: string>>"
#: Packages within packages that are opened.
DEPTH = 4
#: Relationships, properties and shapes by their names in the format.
REL = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"
PROPERTIES = {"docProps/core.xml": ("creator", "lastModifiedBy"), "docProps/app.xml": ("Company", "Manager"), "docProps/custom.xml": ("lpwstr",)}
TEXTPATH = "{urn:schemas-microsoft-com:vml}textpath"
#: Links that lead to somebody's own disk or network.
LOCAL = re.compile(r"^(?:file:|\\\\|//|[A-Za-z]:[\\/]|smb:)", re.I)


def _opened(data: bytes) -> zipfile.ZipFile:
    """The archive, if it is safe to unpack; else a ValueError that says why not."""
    z = zipfile.ZipFile(io.BytesIO(data))
    found = z.infolist()
    size, packed = sum(i.file_size for i in found), sum(i.compress_size for i in found)
    for bad, why in ((len(found) > MOST_ENTRIES, "too many members"), (size > MOST_BYTES, "too large"), (size >= RATIO_FROM and size > MOST_RATIO * max(1, packed), "packed too tightly")):
        if bad:
            raise ValueError(why)
    return z


def walk(data: bytes, *, depth: int = DEPTH, place: str = "", at: int = 0) -> Iterator[tuple[str, int, str, str]]:
    """(place, depth, kind, what) of all that travels with a file, in the order of its parts; a place names the packages on
    the way, with a bar between them."""
    try:
        z = _opened(data)
        names = sorted(z.namelist())
        kind = next((k for k, m in MEMBERS.items() if m in names), None)
        for name in names:
            if name.endswith(".rels"):
                for r in ElementTree.fromstring(z.read(name)).iter(REL):
                    if r.get("TargetMode") == "External":
                        target = r.get("Target", "")
                        yield place, at, "local link" if LOCAL.match(target) else "link", target
            elif name in PROPERTIES:
                for e in ElementTree.fromstring(z.read(name)).iter():
                    if e.tag.rpartition("}")[2] in PROPERTIES[name] and (e.text or "").strip():
                        yield place, at, "property", e.text.strip()
            elif re.match(r"word/header\d*\.xml$", name):
                for e in ElementTree.fromstring(z.read(name)).iter(TEXTPATH):
                    yield place, at, "watermark", e.get("string", "")
        if kind in LEFTOVERS:
            yield from ((place, at, k, "") for k, v in LEFTOVERS[kind](data).items() if v and k != "author")
        if kind == "docx":
            yield from ((place, at, "embedded object", e.get(f"{W}val") or "") for e in ElementTree.fromstring(z.read(MEMBERS["docx"])).iter(f"{W}altChunk"))
        for name in names:
            if "/embeddings/" in name:
                inside = f"{place}|{name}" if place else name
                part = z.read(name)
                yield place, at, "embedded file", name
                if part[:4] != b"PK\x03\x04":
                    continue
                if at + 1 > depth:
                    yield inside, at + 1, "not opened", "too deep"
                else:
                    yield from walk(part, depth=depth, place=inside, at=at + 1)
    except ValueError as e:
        yield place, at, "not opened", str(e)
    except Exception as e:  # damaged in ways that only the reader can tell
        yield place, at, "not opened", type(e).__name__


def contents(content: Column, depth: int = DEPTH) -> Column:
    """walk() of a binary column; files that are no packages have nothing."""

    @F.pandas_udf(FOUND)
    def of(batch: pd.Series) -> pd.Series:
        names = ("place", "depth", "kind", "what")
        return pd.Series([[dict(zip(names, row, strict=True)) for row in walk(bytes(d), depth=depth)] if d is not None and bytes(d[:4]) == b"PK\x03\x04" else [] for d in batch], dtype=object)

    return of(content)


def travelling(files: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(path, place, depth, kind, what): a row for each thing that travels with a file (path, content)."""
    return files.select("path", F.inline(contents(F.col("content"), depth)))


def foreign_names(found: DataFrame, texts: DataFrame, own: list[str]) -> DataFrame:
    """(path, place, name): names in properties, of the file or of what is within it, that are neither in its text
    (path, text) nor our own, whatever their case."""
    named = found.where("kind = 'property'").select("path", "place", F.col("what").alias("name")).distinct()
    low = F.lower("name")
    ours = low.isin([x.lower() for x in own]) if own else F.lit(False)
    return named.where(~ours).join(texts.select("path", F.lower("text").alias("text")), "path", "left").where(~F.coalesce(F.contains("text", low), F.lit(False))).select("path", "place", "name")


def other_attachments(attachments: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(msg_id, filename, problems): what travels with every attachment (msg_id, position, filename, content) but the first,
    which is reviewed by itself; in the order of the attachments, only those that carry anything."""
    rest = attachments.where("position > 0").select("msg_id", "position", "filename", contents(F.col("content"), depth).alias("f"))
    told = F.array_sort(F.array_distinct(F.transform("f", lambda x: F.when(x["what"] == "", x["kind"]).otherwise(F.concat_ws(": ", x["kind"], x["what"])))))
    return rest.where(F.size("f") > 0).select("msg_id", "position", "filename", F.array_join(told, "; ").alias("problems"))
