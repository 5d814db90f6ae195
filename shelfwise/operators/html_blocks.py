"""The one helper for HTML: tables, definition lists, component lists, colour lists and text blocks of a page, in one parse."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import text as T
from shelfwise.operators.dedupe import last_value_by_key
from shelfwise.operators.extract import map_key

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
KINDS = frozenset(["table", "dl", "component", "color", "block", "classification"])
_SCHEMA = "page_id long, ord int, kind string, title string, name string, features array<string>, key string, value string"


class Blocks(HTMLParser):
    """Collects (kind, fields) of the asked kinds. Texts of a block are stripped node by node and joined without space.

    All texts stand in one list; an open element knows where its own begin, so a text is kept once and joined when a block that needs it closes.
    """

    def __init__(self, kinds: frozenset[str] = KINDS):
        super().__init__(convert_charrefs=True)
        self.kinds = kinds
        self.stack: list[tuple[str, str, int]] = []
        self.texts: list[str] = []
        self.rows: list[dict] = []
        self.cells: list[str] = []
        self.terms: list[str] = []
        self.defs: list[str] = []
        self.component: dict | None = None
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        classes = a.get("class") or ""
        if tag == "tr":
            self.cells = []
        elif tag == "dl":
            self.terms, self.defs = [], []
        if "component" in self.kinds and "component" in classes and tag in ("li", "div") and self.component is None:
            self.component, self.depth = {"title": "", "name": "", "features": []}, len(self.stack)
        if "color" in self.kinds and "color" in classes and (a.get("data-color-id") or a.get("data-color-name")):
            self.rows.append({"kind": "color", "key": a.get("data-color-id"), "value": a.get("data-color-name"), "name": a.get("href") or a.get("data-url")})
        if tag not in _VOID:
            self.stack.append((tag, classes, len(self.texts)))

    def handle_data(self, data):
        if self.stack and (text := data.strip()):
            self.texts.append(text)

    def handle_endtag(self, tag):
        while self.stack:
            name = self._close(*self.stack.pop())
            if name == tag:
                break

    def finished(self) -> list[dict]:
        self.close()
        while self.stack:
            self._close(*self.stack.pop())
        return self.rows

    def _close(self, tag: str, classes: str, start: int) -> str:
        text = lambda: "".join(self.texts[start:])
        if tag in ("td", "th"):
            if "table" in self.kinds:
                self.cells.append(text())
        elif tag == "tr" and len(self.cells) >= 2:
            self.rows.append({"kind": "table", "key": self.cells[0], "value": self.cells[1]})
            self.cells = []
        elif tag in ("dt", "dd"):
            if "dl" in self.kinds:
                (self.terms if tag == "dt" else self.defs).append(text())
        elif tag == "dl":
            self.rows += [{"kind": "dl", "key": k, "value": v} for k, v in zip(self.terms, self.defs)]
        elif "classification" in classes:
            if "classification" in self.kinds:
                self.rows.append({"kind": "classification", "value": text()})
        elif "description" in classes and "block" in self.kinds:
            self.rows.append({"kind": "block", "value": text()})
        if self.component is not None:
            if "title" in classes or (tag in ("h3", "h4") and not self.component["title"]):
                self.component["title"] = text()
            elif "name" in classes:
                self.component["name"] = text()
            elif "feature" in classes and tag != "ul":
                self.component["features"].append(text())
            if len(self.stack) == self.depth:
                self.rows.append({"kind": "component", **self.component})
                self.component = None
        if not self.stack:
            self.texts.clear()
        return tag


def blocks_of(html: str, kinds: Iterable[str] = KINDS) -> list[dict]:
    parser = Blocks(frozenset(kinds))
    parser.feed(html)
    return parser.finished()


def extract_blocks(pages: DataFrame, kinds: Iterable[str] = KINDS) -> DataFrame:
    """(page_id, ord, kind, title, name, features, key, value) of the asked kinds of every page; null pages have none. Pages are parsed where they are."""
    asked = frozenset(kinds)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist())
            rows = [(p, i, b) for p, h in found if h for i, b in enumerate(blocks_of(h, asked))]
            columns = [pa.array([p for p, _, _ in rows], pa.int64()), pa.array([i for _, i, _ in rows], pa.int32())]
            for name in ("kind", "title", "name", "features", "key", "value"):
                columns.append(pa.array([b.get(name) for _, _, b in rows], pa.list_(pa.string()) if name == "features" else pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "ord", "kind", "title", "name", "features", "key", "value"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(parse, _SCHEMA)


def _pairs(blocks: DataFrame, *kinds: str) -> DataFrame:
    key = F.trim(F.regexp_replace(F.regexp_replace("key", r"^\*+", ""), r":+\s*$", ""))
    rows = blocks.where(F.col("kind").isin(*kinds)).select("page_id", "ord", "kind", key.alias("key"), F.trim("value").alias("value"))
    return rows.where("key <> '' and value <> '' and key <> value")


def extract_spec_table(blocks: DataFrame, max_key: int = 100, max_value: int = 500) -> DataFrame:
    """(page_id, key, value) of table rows; the later row of a key wins."""
    rows = _pairs(blocks, "table").where((F.length("key") < max_key) & (F.length("value") < max_value))
    return last_value_by_key(rows, ["page_id", "key"], "value")


def extract_spec_dl(blocks: DataFrame) -> DataFrame:
    """Table pairs, overwritten by definition lists. Both come from one pass over the blocks, so a page is parsed once."""
    both = _pairs(blocks, "table", "dl").withColumn("ord", F.struct(F.col("kind") == "dl", "ord"))
    return last_value_by_key(both, ["page_id", "key"], "value")


def extract_spec_rows_mapped(blocks: DataFrame, max_value: int = 200) -> DataFrame:
    """(page_id, field, value): keys mapped by rule; values of tables under the limit, of definition lists any; last wins."""
    rows = blocks.where(F.col("kind").isin("table", "dl") & ((F.col("kind") == "dl") | (F.length("value") < max_value)))
    rows = rows.withColumn("field", map_key(F.col("key"))).where("field is not null and value <> ''")
    return last_value_by_key(rows, ["page_id", "field"], "value")


def extract_components(blocks: DataFrame) -> DataFrame:
    return blocks.where("kind = 'component'").select("page_id", "ord", "title", "name", "features")


def extract_description(blocks: DataFrame, min_len: int = 50) -> DataFrame:
    rows = blocks.where((F.col("kind") == "block") & (F.length("value") > min_len))
    return rows.groupBy("page_id").agg(F.min_by("value", "ord").alias("description"))


def extract_color_picker(blocks: DataFrame, skip: str = "member") -> DataFrame:
    """(page_id, colors): swatches that have id and name and are no member message."""
    rows = blocks.where(F.col("kind") == "color").where("coalesce(key, '') <> '' and coalesce(value, '') <> ''").where(~F.lower("value").contains(skip))
    packed = F.array_sort(F.collect_list(F.struct("ord", F.col("key").alias("id"), F.col("value").alias("name"), F.col("name").alias("url"))))
    return rows.groupBy("page_id").agg(F.transform(packed, lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"), x["url"].alias("url"))).alias("colors"))


def extract_classification_limit(blocks: DataFrame) -> DataFrame:
    rows = blocks.where("kind = 'classification'").select("page_id", "ord", T.found(F.col("value"), r"(\d+)\s*kg").alias("n")).where("n is not null")
    return rows.groupBy("page_id").agg(F.concat(F.min_by("n", "ord"), F.lit(" kg")).alias("weight_limit"))
