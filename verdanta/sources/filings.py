"""Filings in tagged XML: found by a recursive file scan, read into contexts, units and facts.

One pass over a file's bytes emits rows of all three kinds; arbitrary element
names are what XML readers with a fixed row tag can't scan, so this is a Python
stage (``mapInPandas``) over ``binaryFile``. A file that isn't well formed is
read by a tolerant scanner instead; its rows carry ``parser = 'fallback'``. One
that yields nothing lands in ``bad_files``. Files are read one at a time.
"""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from io import BytesIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdanta.sources.files import exists

PATTERNS = "*.{xml,XML,xbrl,XBRL}"
ROWS = (
    "source_file string, parser string, kind string, pos long, id string, entity_identifier string, entity_scheme string, period_type string,"
    " start_date string, end_date string, instant_date string, dimensions map<string,string>, measure string, concept string, namespace string,"
    " value string, context_ref string, unit_ref string, decimals string"
)
STRUCTURE = ("context", "unit", "xbrl")


class Element:
    """What both readers give: namespace, name, attributes, text, children."""

    __slots__ = ("namespace", "name", "attrs", "text", "children")

    def __init__(self, namespace: str, name: str, attrs: dict[str, str]) -> None:
        self.namespace, self.name, self.attrs, self.text, self.children = namespace, name, attrs, "", []

    def walk(self) -> Iterator[Element]:
        stack = [self]
        while stack:
            e = stack.pop()
            yield e
            stack += reversed(e.children)

    def first(self, name: str) -> Element | None:
        return next((e for e in self.walk() if e is not self and e.name == name), None)


def split_name(tag: str) -> tuple[str, str]:
    """{uri}name as (uri, name)."""
    uri, brace, name = tag.rpartition("}")
    return (uri[1:], name) if brace else ("", tag)


def strict(content: bytes) -> Element:
    root, stack = None, []
    for event, node in ET.iterparse(BytesIO(content), ("start", "end")):
        if event == "start":
            e = Element(*split_name(node.tag), {split_name(k)[1]: v for k, v in node.attrib.items()})
            if stack:
                stack[-1].children.append(e)
            else:
                root = e
            stack.append(e)
        else:
            stack.pop().text = node.text or ""
            node.clear()
    return root


_tag = re.compile(r"<(/?)([A-Za-z_][\w.:-]*)((?:\s+[\w.:-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*(/?)>|<!--.*?-->|<\?.*?\?>|<!\[CDATA\[(.*?)\]\]>", re.S)
_attr = re.compile(r"([\w.:-]+)\s*=\s*(\"[^\"]*\"|'[^']*')")


def tolerant(content: bytes) -> Element:
    """Tags as they come: an end tag without its start is passed over, open elements end with the file."""
    text = content.decode("utf-8", "replace")
    root = Element("", "", {})
    stack, done = [root], 0
    for m in _tag.finditer(text):
        between = html.unescape(text[done : m.start()])
        if not stack[-1].children:
            stack[-1].text += between
        done = m.end()
        if m[5] is not None and not stack[-1].children:
            stack[-1].text += m[5]
        if not m[2]:
            continue
        name = m[2].rpartition(":")[2]
        if m[1]:
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0)
            if at:
                del stack[at:]
            continue
        e = Element("", name, {k.rpartition(":")[2]: html.unescape(v[1:-1]) for k, v in _attr.findall(m[3])})
        stack[-1].children.append(e)
        if not m[4]:
            stack.append(e)
    for e in root.walk():
        e.text = e.text.strip()
    return root


def _dimensions(context: Element) -> dict[str, str]:
    """Explicit and typed members of the scenario; a later one of a dimension wins."""
    scenario = context.first("scenario")
    out: dict[str, str] = {}
    if scenario is None:
        return out
    members = list(scenario.walk())
    for e in members:
        if e.name == "explicitMember" and e.attrs.get("dimension") and e.text:
            out[e.attrs["dimension"]] = e.text
    for e in members:
        if e.name == "typedMember" and e.attrs.get("dimension"):
            out[e.attrs["dimension"]] = e.children[0].text if e.children else e.text
    return out


def rows_of(root: Element) -> Iterator[dict]:
    """Contexts, units and facts of a document, in its order."""
    for pos, e in enumerate(root.walk()):
        if e.name == "context" and e.attrs.get("id"):
            who, period = e.first("identifier"), e.first("period")
            at = {n: x.text if period is not None and (x := period.first(n)) is not None else None for n in ("instant", "startDate", "endDate")}
            both = at["instant"] is None and at["startDate"] is not None and at["endDate"] is not None
            yield {
                "kind": "context", "pos": pos, "id": e.attrs["id"],
                "entity_identifier": who.text if who is not None else "", "entity_scheme": who.attrs.get("scheme", "") if who is not None else "",
                "period_type": "duration" if at["instant"] is None else "instant", "instant_date": at["instant"],
                "start_date": at["startDate"] if both else None, "end_date": at["endDate"] if both else None, "dimensions": _dimensions(e),
            }
        elif e.name == "unit" and e.attrs.get("id"):
            measure = e.first("measure")
            yield {"kind": "unit", "pos": pos, "id": e.attrs["id"], "measure": measure.text if measure is not None else ""}
        if "contextRef" in e.attrs and e.name not in STRUCTURE:
            yield {"kind": "fact", "pos": pos, "concept": e.name, "namespace": e.namespace, "value": e.text, "context_ref": e.attrs["contextRef"], "unit_ref": e.attrs.get("unitRef"), "decimals": e.attrs.get("decimals")}


def find_files(spark: SparkSession, *folders: str, pattern: str = PATTERNS) -> DataFrame:
    """(path, hash, content) of every filing under the folders, each once; a folder that doesn't exist is passed over."""
    known = [f for f in folders if exists(spark, f)]
    if not known:
        return spark.createDataFrame([], "path string, hash string, content binary")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(known)
    return files.select("path", F.md5("content").alias("hash"), "content").dropDuplicates(["path"])


def read(content: bytes) -> tuple[list[dict], str]:
    """(rows, parser) of one file: strict, or tolerant where that fails in any way (no XML, an unknown encoding)."""
    for parser, walk in (("strict", strict), ("fallback", tolerant)):
        try:
            return list(rows_of(walk(content))), parser
        except Exception:  # a file may be broken in any way; it must not stop the others
            continue
    return [], "fallback"


def parse(files: DataFrame) -> DataFrame:
    """Rows of all kinds from files (path, content)."""
    names = [c.split()[0] for c in re.split(r",\s(?=\w+ )", ROWS)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                found, parser = read(bytes(content))
                out = pd.DataFrame(found or [{"kind": "bad", "pos": 0}], columns=names).astype(object)
                out["source_file"], out["parser"] = path, parser
                yield out.where(out.notna(), None)

    return files.select("path", "content").mapInPandas(run, ROWS)


def contexts(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'context'").select("source_file", F.col("id").alias("context_id"), "pos", "entity_identifier", "entity_scheme", "period_type", "start_date", "end_date", "instant_date", "dimensions")


def units(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'unit'").select("source_file", F.col("id").alias("unit_id"), "measure")


def facts(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'fact'").select("source_file", "pos", "concept", "namespace", "value", "context_ref", "unit_ref", "decimals")


def bad_files(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'bad'").select("source_file")
