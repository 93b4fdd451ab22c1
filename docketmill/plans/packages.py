"""Queries over what travels with files: a Word file for each customer, with things in it that the key tells."""

from __future__ import annotations

from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from docketmill.plans.registry import query
from docketmill.plans.views import base
from docketmill.sinks.compared import built
from docketmill.sinks.word import _packed, _parts
from docketmill.sources import packages

RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="x" TargetMode="External" Target="{}"/></Relationships>'
#: The things: name, author, company of the workbook inside, link, mark; null where a file has none.
THINGS = """things as (select c_custkey, c_name, case when c_custkey % 2 = 0 then c_name else concat('Person ', cast(c_custkey % 5 as varchar(10))) end as author,
 case when c_custkey % 4 = 0 then concat('Company ', cast(c_custkey % 7 as varchar(10))) end as company, case c_custkey % 6 when 0 then 'file:///srv/share/a.dotx' when 1 then 'https://example.com/a' end as link, case when c_custkey % 5 = 0 then 'DRAFT' end as mark from customer)"""


@F.pandas_udf(BinaryType())
def _made(names: pd.Series, authors: pd.Series, companies: pd.Series, links: pd.Series, marks: pd.Series) -> pd.Series:
    out = []
    for name, author, company, link, mark in zip(names, authors, companies, links, marks, strict=True):
        parts = _parts(built([f"Deed with {name}", "Company 3 is a party."]))
        parts["docProps/core.xml"] = f"<c><creator>{escape(author)}</creator></c>".encode()
        if company:
            parts["word/embeddings/book.xlsx"] = _packed({"xl/workbook.xml": b"<w/>", "docProps/app.xml": f"<p><Company>{escape(company)}</Company></p>".encode()})
        if link:
            parts["word/_rels/document.xml.rels"] = RELS.format(link).encode()
        if mark:
            parts["word/header1.xml"] = f'<h xmlns:v="urn:schemas-microsoft-com:vml"><v:textpath string="{mark}"/></h>'.encode()
        out.append(_packed(parts))
    return pd.Series(out, dtype=object)


def files(spark, sf_dir):
    # The short rows are dealt out before their files are made: a table in one small file is worked on by all cores.
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    customer = base(spark, sf_dir, "customer").select("c_custkey", "c_name").repartition(n, "c_custkey")
    things = spark.sql(f"with {THINGS.replace('from customer', 'from {customer}')} select * from things", customer=customer)
    return things.select(F.col("c_custkey").cast("string").alias("path"), _made("c_name", "author", "company", "link", "mark").alias("content"), F.concat_ws("\n", F.concat(F.lit("Deed with "), "c_name"), F.lit("Company 3 is a party.")).alias("text"))


FOUND = f"""{THINGS}, found as (select cast(c_custkey as varchar) as path, '' as place, 0 as depth, 'property' as kind, author as what from things union all select cast(c_custkey as varchar), '', 0, 'embedded file', 'word/embeddings/book.xlsx' from things where company is not null
 union all select cast(c_custkey as varchar), 'word/embeddings/book.xlsx', 1, 'property', company from things where company is not null union all select cast(c_custkey as varchar), '', 0, case when starts_with(link, 'file:') then 'local link' else 'link' end, link from things where link is not null
 union all select cast(c_custkey as varchar), '', 0, 'watermark', mark from things where mark is not null)"""


@query(f"with {FOUND} select * from found")
def travelling_contents(spark, sf_dir):
    """What travels with each customer's file."""
    return packages.travelling(files(spark, sf_dir))


@query(f"with {FOUND} select path, place, what as name from found join things on cast(c_custkey as varchar) = path where kind = 'property' and what <> 'Person 2' and not contains(lower(concat('Deed with ', c_name, ' Company 3 is a party.')), lower(what))")
def names_of_others(spark, sf_dir):
    """Names in the properties of a file that its text doesn't have; one of them is ours."""
    f = files(spark, sf_dir)
    return packages.foreign_names(packages.travelling(f), f.select("path", "text"), ["person 2"])
