"""Regulatory filings: submission lists, company facts and HTML tables."""

from __future__ import annotations

from collections.abc import Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

C = F.col
SUBMISSIONS = "struct<filings:struct<recent:struct<form:array<string>,filingDate:array<string>,accessionNumber:array<string>>>>"
FACTS = "struct<facts:map<string,map<string,struct<units:map<string,array<struct<end:string,val:double,form:string>>>>>>>"

# Statement concepts.
CONCEPTS = {
    "income": ["Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "CostOfRevenue", "GrossProfit", "OperatingIncomeLoss", "NetIncomeLoss"],
    "balance": ["Assets", "AssetsCurrent", "Liabilities", "LiabilitiesCurrent", "StockholdersEquity"],
    "cashflow": ["NetCashProvidedByUsedInOperatingActivities", "NetCashProvidedByUsedInInvestingActivities", "NetCashProvidedByUsedInFinancingActivities"],
}
FORMS = {"annual": "10-K", "quarterly": "10-Q"}


def filings(df: DataFrame, json: str = "json", key: str = "cik", form: str = "10-K", limit: int = 10, base: str = "https://www.sec.gov/Archives/edgar/data") -> DataFrame:
    """The first ``limit`` filings of a form per company, in document order, with their URL."""
    r = F.from_json(C(json), SUBMISSIONS)["filings"]["recent"]
    d = df.select(key, F.posexplode(F.arrays_zip(r["form"].alias("form"), r["filingDate"].alias("date"), r["accessionNumber"].alias("accession"))).alias("_pos", "_z"))
    d = d.select(key, "_pos", C("_z.form").alias("form"), C("_z.date").alias("date"), C("_z.accession").alias("accession")).where(C("form") == form)
    rn = F.row_number().over(Window.partitionBy(key).orderBy("_pos"))
    d = d.withColumn("_rn", rn).where(C("_rn") <= limit).drop("_rn", "_pos")
    flat = F.regexp_replace("accession", "-", "")
    return d.withColumn("url", F.concat(F.concat_ws("/", F.lit(base), C(key).cast("string"), flat, C("accession")), F.lit("-index.htm")))


def statements(df: DataFrame, json: str = "json", key: str = "cik", statement: str = "income", period: str = "annual") -> DataFrame:
    """Company facts to one row per (company, date) with a column per concept; USD if reported, else shares."""
    concepts = CONCEPTS[statement]
    d = df.select(key, F.explode(F.from_json(C(json), FACTS)["facts"]).alias("_tax", "_facts"))
    d = d.where(C("_tax") == "us-gaap").select(key, F.explode("_facts").alias("concept", "_f")).where(C("concept").isin(concepts))
    rows = F.coalesce(F.try_element_at("_f.units", F.lit("USD")), F.try_element_at("_f.units", F.lit("shares")))
    d = d.select(key, "concept", F.posexplode(rows).alias("_p", "_r")).select(key, "concept", "_p", C("_r.end").alias("date"), C("_r.val").alias("val"), C("_r.form").alias("form"))
    d = d.where(C("form") == FORMS[period])
    return d.groupBy(key, "date").pivot("concept", concepts).agg(F.min_by("val", "_p"))


class _Tables(HTMLParser):
    """Cells of every table of one page."""

    def __init__(self):
        super().__init__()
        self.tables, self._row, self._cell = [], None, None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self._row = []
        elif tag in ("td", "th") and self._row is not None:
            self._cell = []

    def handle_data(self, data):
        if self._cell is not None:
            self._cell.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self._cell is not None:
            self._row.append("".join(self._cell).strip())
            self._cell = None
        elif tag == "tr" and self._row is not None:
            if self._row:
                self.tables[-1].append(self._row)
            self._row = None


def html_tables(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, table_no, row_no, cells): body rows with as many cells as their table's header row."""
    def parse(batches):
        for pdf in batches:
            out = []
            for k, h in zip(pdf[key], pdf[html]):
                p = _Tables()
                p.feed(h or "")
                for t, rows in enumerate(p.tables):
                    for r, cells in enumerate(rows[1:]):
                        if len(cells) == len(rows[0]):
                            out.append((k, t, r, dict(zip(rows[0], cells))))
            yield pd.DataFrame(out, columns=[key, "table_no", "row_no", "cells"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInPandas(parse, f"{key} {kind}, table_no int, row_no int, cells map<string,string>")
