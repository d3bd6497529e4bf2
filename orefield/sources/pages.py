"""Portal pages: organisation index, listing and detail page, each parsed to rows in Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_TEXT, _INT = T.StringType(), T.IntegerType()

#: Captions of a detail page and the fields that they fill; the first caption there is taken.
CAPTIONS = {
    "org_chain": ["Organisation Chain"], "ref_no": ["Tender Reference Number"], "tender_id": ["Tender ID"], "tender_type": ["Tender Type"], "category": ["Tender Category"],
    "fee": ["Tender Fee in ₹", "Tender Fee in Rs."], "emd": ["EMD Amount in ₹", "EMD Amount in Rs."], "title": ["Title"], "description": ["Work Description"],
    "value": ["Tender Value in ₹", "Tender Value in Rs."], "product_category": ["Product Category"], "sub_category": ["Sub category"], "location": ["Location"], "pincode": ["Pincode"],
    "published": ["Published Date"], "opens": ["Bid Opening Date"], "prebid": ["Pre Bid Meeting Date"], "submission_start": ["Bid Submission Start Date"], "closes": ["Bid Submission End Date"],
    "inviting_authority": ["Name"], "inviting_address": ["Address"],
}
DOCUMENT = re.compile(r"\.(pdf|xlsx?|docx?|zip|rar)$", re.I)


def is_stale(html: Column) -> Column:
    """A page that a portal sends, as if all were well, when a session is over."""
    return F.contains(html, F.lit("Stale Session")) & F.contains(html, F.lit("session has timed out"))


def clean(text: str) -> str:
    return " ".join(text.replace("\xa0", " ").split())


class _Cells(HTMLParser):
    """Table rows with their own cells, and all links. A row of an inner table isn't the outer row's."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open_rows: list[dict] = []
        self.links: list[dict] = []
        self.link: dict | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "tr":
            row = {"cells": [], "links": []}
            self.rows.append(row)
            self.open_rows.append(row)
        elif tag == "td" and self.open_rows:
            self.open_rows[-1]["cells"].append({"class": (a.get("class") or "").split(), "text": [], "links": []})
        elif tag == "a" and a.get("href") is not None:
            self.link = {"href": a["href"], "text": []}
            self.links.append(self.link)
            for row in self.open_rows:
                row["links"].append(self.link)
                if row["cells"]:
                    row["cells"][-1]["links"].append(self.link)

    def handle_endtag(self, tag):
        if tag == "tr" and self.open_rows:
            self.open_rows.pop()
        elif tag == "a":
            self.link = None

    def handle_data(self, data):
        if self.link is not None:
            self.link["text"].append(data)
        for row in self.open_rows:
            if row["cells"]:
                row["cells"][-1]["text"].append(data)


def _cells(html: str | None) -> _Cells:
    own = _Cells()
    own.feed(html or "")
    own.close()
    return own


def _text(parts: list[str]) -> str:
    return clean(" ".join(parts))


def organisations(html: str | None) -> list[dict]:
    """Organisations with their number of tenders; of one name the first."""
    found: dict[str, dict] = {}
    for row in _cells(html).rows:
        for link in row["links"]:
            count = _text(link["text"])
            if "page=FrontEndTendersByOrganisation" in link["href"] and "sp=" in link["href"] and count.isdigit() and len(row["cells"]) >= 3:
                name = _text(row["cells"][1]["text"])
                found.setdefault(name, {"name": name, "tenders": int(count), "href": link["href"]})
    return list(found.values())


def listing(html: str | None) -> list[dict]:
    """Rows of a listing; the cell '[title] [ref][id]' is read from its end."""
    out = []
    for row in _cells(html).rows:
        cells = row["cells"]
        if len(cells) < 6 or not any("FrontEndViewTender" in x["href"] for x in row["links"]):
            continue
        link = next(iter(cells[4]["links"]), {"href": "", "text": []})
        title = _text(link["text"])
        rest = _text(cells[4]["text"]).replace(title, "", 1) if title else _text(cells[4]["text"])
        marks = [clean(x) for x in re.findall(r"\[([^\[\]]*)\]", rest)]
        if title.startswith("[") and title.endswith("]"):
            title = title[1:-1].strip()
        out.append({
            "published": _text(cells[1]["text"]), "closes": _text(cells[2]["text"]), "opens": _text(cells[3]["text"]), "title": title, "ref_no": marks[-2] if len(marks) > 1 else "",
            "tender_id": marks[-1] if marks else "", "org_chain": _text(cells[5]["text"]), "href": link["href"],
        })
    return out


def detail(html: str | None) -> dict[str, str] | None:
    """Fields of a detail page by caption; None for a page that has neither of the two that all have."""
    own, found = _cells(html), {}
    for row in own.rows:
        for cell, after in zip(row["cells"], row["cells"][1:]):
            if "td_caption" in cell["class"]:
                found.setdefault(_text(cell["text"]), _text(after["text"]))
    if "Tender ID" not in found and "Organisation Chain" not in found:
        return None
    out = {field: next(found[c] for c in captions if c in found) for field, captions in CAPTIONS.items() if any(c in found for c in captions)}
    names = [_text(x["text"]) for x in own.links]
    return out | {"documents": ", ".join(n for n in names if DOCUMENT.search(n))}


@F.pandas_udf(T.ArrayType(_struct(name=_TEXT, tenders=_INT, href=_TEXT)))
def organisations_of(html: pd.Series) -> pd.Series:
    return html.map(organisations)


@F.pandas_udf(T.ArrayType(_struct(**dict.fromkeys("published closes opens title ref_no tender_id org_chain href".split(), _TEXT))))
def listing_of(html: pd.Series) -> pd.Series:
    return html.map(listing)


@F.pandas_udf(T.MapType(_TEXT, _TEXT))
def detail_of(html: pd.Series) -> pd.Series:
    return html.map(detail)


@F.pandas_udf(_struct(title=_TEXT, links=_INT, paragraphs=_INT))
def outline_of(html: pd.Series) -> pd.DataFrame:
    """Title, links and paragraphs of any page."""
    rows = []
    for h in html.fillna(""):
        title = re.search(r"<title[^>]*>(.*?)</title>", h, re.S | re.I)
        rows.append((clean(title[1]) if title else "", len(re.findall(r"<a\s[^>]*href", h, re.I)), len(re.findall(r"<p[\s>]", h, re.I))))
    return pd.DataFrame(rows, columns=["title", "links", "paragraphs"])
