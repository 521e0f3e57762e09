"""The few functions that need Python: Arrow-batched, stateless, safe to repeat."""

from __future__ import annotations

import difflib
import json
import re
import sys
from collections.abc import Callable, Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom import rules

# Functions of this module travel to the executors by value, so a cluster needs
# no copy of the package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_TEXTS = T.ArrayType(T.StringType())
TABLES_TYPE = T.ArrayType(T.StructType([T.StructField("header", _TEXTS), T.StructField("rows", T.ArrayType(_TEXTS))]))
_TABLES_ARROW = pa.list_(pa.struct([("header", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string())))]))
FOLDER_KEYWORDS = rules.FOLDER_KEYWORDS
FOLDER_CUTOFF = rules.FOLDER_CUTOFF


# --- model answers ---------------------------------------------------------------

def balanced_part(text: str | None) -> str | None:
    """From the first ``{`` to its partner; braces inside quotes count too."""
    start = (text or "").find("{")
    depth = 0
    for brace in re.finditer(r"[{}]", text[start:] if start >= 0 else ""):
        depth += 1 if brace.group() == "{" else -1
        if depth == 0:
            return text[start:start + brace.end()]
    return None


@F.pandas_udf(T.StringType())
def balanced_object(answers: pd.Series) -> pd.Series:
    """The only step of answer cleaning that needs a counter, hence Python."""
    return answers.map(balanced_part)


# --- folder names ----------------------------------------------------------------

def folder_type(name: str | None) -> str | None:
    """Document type for a folder name: exact or plural keyword, else the closest
    keyword when it is close enough, else null."""
    letters = re.sub(r"[^a-z]", "", (name or "").strip().lower())
    if not letters:
        return None
    keywords = [(kind, word) for kind, words in FOLDER_KEYWORDS.items() for word in words]
    for kind, word in keywords:
        if letters in (word, word + "s"):
            return kind
    scored = [(difflib.SequenceMatcher(None, letters, word).ratio(), kind) for kind, word in keywords]
    best = max(scored, key=lambda s: s[0])  # the first of equals
    return best[1] if best[0] >= FOLDER_CUTOFF else None


@F.pandas_udf(T.StringType())
def resolve_folder(names: pd.Series) -> pd.Series:
    """Map-only, no shuffle: each batch compares only its distinct names."""
    return names.map({name: folder_type(name) for name in names.dropna().unique()})


# --- nested records ----------------------------------------------------------------

class _Written(float):
    """A number that keeps the digits it was written with."""

    def __new__(cls, text: str):
        number = super().__new__(cls, text)
        number.text = text
        return number


def _leaf(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, _Written):
        return value.text
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


_JSON_TOKEN = re.compile(r'[ \t\n\r]*(?:("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)|([][{}:,]))')


def _deep_leaves(text: str, sep: str) -> list[dict]:
    """The same for a record nested deeper than the JSON reader goes: one pass, open objects and lists on a stack.

    A list's items are put together as they are closed.  Text that is no JSON has no leaf.
    The last of equal paths counts; a key that is an object and then a value keeps the leaves of both.
    """
    # of each open object: closing mark, path or parts, then whether a key, a value or a separator is due
    out: dict[str, str | None] = {}
    stack: list[list] = []
    at, due, key, ended = 0, "value", None, False
    while True:
        found = _JSON_TOKEN.match(text, at)
        if found is None:
            return [{"path": p, "value": v} for p, v in out.items() if p] if ended and not text[at:].strip(" \t\n\r") else []
        at, (string, plain, mark) = found.end(), found.groups()
        if ended:
            return []
        listed = bool(stack) and any_list(stack)
        if mark in ("{", "[") and due in ("value", "item"):
            if mark == "{" and not listed:
                base = "" if not stack else stack[-1][1]
                stack.append(["}", f"{base}{sep}{key}" if base else (key or ""), None])
            else:
                stack.append(["}" if mark == "{" else "]", key if not listed else None, [mark]])
            due = "first key" if mark == "{" else "item"
            continue
        if mark in ("}", "]") and stack and stack[-1][0] == mark and due in ("after", "first key" if mark == "}" else "item"):
            if due == "item" and stack[-1][2] and stack[-1][2][-1] == ",":
                return []
            _, own_key, parts = stack.pop()
            value = None if parts is None else "".join([*parts, mark])
            key = own_key
        elif mark == ":" and due == "colon":
            due = "value"
            if stack[-1][2] is not None:
                stack[-1][2].append(":")
            continue
        elif mark == "," and due == "after" and stack:
            due = "key" if stack[-1][0] == "}" else "item"
            if stack[-1][2] is not None:
                stack[-1][2].append(",")
            continue
        elif string is not None and due in ("first key", "key"):
            key, due = json.loads(string), "colon"
            if stack[-1][2] is not None:
                stack[-1][2].append(json.dumps(key, ensure_ascii=False))
            continue
        elif mark is None and due in ("value", "item"):
            leaf = json.loads(found[0], parse_float=_Written)
            value = json.dumps(leaf, ensure_ascii=False) if listed else _leaf(leaf)
            if not stack:
                return []
            parts = ()
        else:
            return []
        # a value has ended
        ended, due = not stack, "after"
        if ended:
            continue
        if any_list(stack):
            stack[-1][2].append(value)
        elif parts is not None:
            base = stack[-1][1]
            out[f"{base}{sep}{key}" if base else key] = value


def any_list(stack: list[list]) -> bool:
    """Whether the innermost open object or list lies in a list."""
    return stack[-1][2] is not None


def flatten_text(text: str | None, sep: str = ".") -> list[dict]:
    """Leaves of a JSON object by path, in order; a text that is no object has none."""
    try:
        record = json.loads(text or "", parse_float=_Written)
    except ValueError:
        return []
    except RecursionError:
        return _deep_leaves(text, sep)
    out, open_ = [], [("", record)]
    while open_:
        path, value = open_.pop()
        if isinstance(value, dict):
            open_ += [(f"{path}{sep}{k}" if path else k, v) for k, v in reversed(value.items())]
        elif path:
            out.append({"path": path, "value": _leaf(value)})
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())])))
def flat_pairs(texts: pd.Series, seps: pd.Series) -> pd.Series:
    return pd.Series([flatten_text(t, s) for t, s in zip(texts, seps)], dtype=object)


# --- HTML tables -----------------------------------------------------------------

# table markup; scripts, comments and all other tags are matched to be skipped
_ATTRS = r"""[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*"""
_TAG = re.compile(
    rf"<(?:(/?)(table|thead|tbody|tfoot|tr|td|th)\b({_ATTRS})>"
    rf"|!--.*?-->|(?:script|style)\b.*?</(?:script|style)\s*>|/?[a-zA-Z]{_ATTRS}>)",
    re.IGNORECASE | re.DOTALL,
)
_SPAN = re.compile(r"(col|row)span\s*=\s*[\"']?\s*(\d+)", re.IGNORECASE)


class _Open:
    """A table whose end has not been read: its rows, the current row and the current cell."""

    __slots__ = ("rows", "cells", "text", "spans", "head", "all_th")

    def __init__(self, rows: list):
        self.rows, self.cells, self.text, self.spans, self.head, self.all_th = rows, [], None, {}, False, True

    def close_cell(self):
        if self.text is not None:
            joined = "".join(self.text)
            joined = " ".join((unescape(joined) if "&" in joined else joined).split())
            self.cells.append((joined, self.spans.get("col", 1), self.spans.get("row", 1)))
            self.text = None

    def close_row(self):
        self.close_cell()
        if self.cells:
            self.rows.append((self.head or self.all_th, self.cells))
            self.cells = []
        self.all_th = True


def _raw_tables(html: str) -> list[list]:
    """Rows of every table as ``(is_header, [(text, colspan, rowspan)])``.

    Cells and rows may lack end tags.  The text of a nested table also belongs to
    the cell around it.
    """
    tables: list[list] = []
    opened: list[_Open] = []  # tables that are open, innermost last
    # text before a tag and the tag's three groups in turn; the text after the last tag is in no table
    parts = _TAG.split(html)
    for before, end, name, attrs in zip(parts[::4], parts[1::4], parts[2::4], parts[3::4]):
        if before:
            for t in opened:
                if t.text is not None:
                    t.text.append(before)
        if name is None:
            continue
        name = name.lower()
        if name == "table" and not end:
            rows: list = []
            tables.append(rows)
            opened.append(_Open(rows))
        elif opened:
            top = opened[-1]
            if name in ("td", "th"):
                top.close_cell()
                if not end:
                    top.text = []
                    top.spans = {k.lower(): max(1, int(n)) for k, n in _SPAN.findall(attrs)} if attrs else {}
                    top.all_th = top.all_th and name == "th"
            else:
                top.close_row()
                if name == "thead":
                    top.head = not end
                elif name == "table":
                    opened.pop()
    return tables


def _spread(rows: list) -> list[tuple[bool, list[str]]]:
    """Repeat cells over their column and row spans."""
    if all(width == 1 and height == 1 for _, cells in rows for _, width, height in cells):
        return [(is_header, [text for text, _, _ in cells]) for is_header, cells in rows]
    held: dict[int, tuple[str, int]] = {}  # column -> (text, rows left)
    out = []
    for is_header, cells in rows:
        line: list[str] = []
        queue = list(cells)
        while queue or len(line) in held:
            column = len(line)
            if column in held:
                text, left = held.pop(column)
                line.append(text)
                if left > 1:
                    held[column] = (text, left - 1)
                continue
            text, width, height = queue.pop(0)
            for _ in range(width):
                if height > 1:
                    held[len(line)] = (text, height - 1)
                line.append(text)
        out.append((is_header, line))
    return out


def read_tables(html: str | None) -> list[dict]:
    """Tables of one document: joined header texts and body rows of equal width.

    Cells keep their text (account numbers keep leading zeros); empty cells and
    cells missing on the right are null.  Without a header row the columns are
    named by position.
    """
    if not html or "<table" not in html.lower():
        return []
    found = []
    for raw in _raw_tables(html):
        rows = _spread(raw)
        heads = 0
        while heads < len(rows) and rows[heads][0]:
            heads += 1
        if not rows or heads == len(rows):
            continue
        width = max(len(line) for _, line in rows)
        pad = lambda line: [c or None for c in line] + [None] * (width - len(line))
        titles = [pad(line) for _, line in rows[:heads]]
        header = [
            " ".join(t[i] for t in titles if t[i]) if titles else str(i)
            for i in range(width)
        ]
        found.append({"header": header, "rows": [pad(line) for _, line in rows[heads:]]})
    return found


@F.arrow_udf(TABLES_TYPE)
def _tables_of_texts(markdown: pa.Array) -> pa.Array:
    return pa.array([read_tables(text) for text in markdown.to_pylist()], _TABLES_ARROW)


def html_tables(markdown: Column | str) -> Column:
    """Tables of a text; a text without a table is not sent to Python."""
    markdown = F.col(markdown) if isinstance(markdown, str) else markdown
    return _tables_of_texts(F.when(markdown.rlike("(?i)<table"), markdown))


# --- pluggable text -> fields model ------------------------------------------------

def pattern_fields(texts: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """The model that ships here, as columns: ``doc_id``, for each field the first match of
    its pattern, and ``error`` for an empty text.  Patterns are Java's."""
    empty = F.coalesce(F.length("text"), F.lit(0)) == 0
    first = lambda p: F.regexp_extract("text", p, 0)
    return texts.select(
        "doc_id", *[F.when(~empty & (first(p) != ""), first(p)).alias(name) for name, p in patterns.items()],
        F.when(empty, "empty text").alias("error"),
    )


def pattern_model(patterns: dict[str, str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The same as a function over batches, the form in which other models are injected.

    Reads ``doc_id, text``; an empty text is a failure, as for any text model.
    """
    def first(text: str, pattern: str) -> str | None:
        hit = re.search(pattern, text)
        return hit.group() if hit else None

    def model(batch: pd.DataFrame) -> pd.DataFrame:
        if (batch["text"].str.len() == 0).any():
            raise ValueError("empty text")
        found = {name: [first(t, p) for t in batch["text"]] for name, p in patterns.items()}
        return pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), **found, "error": None})

    return model


def map_model(
    df: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """Run an injected text-to-fields model over Arrow batches, partition by partition.

    ``model`` gets one batch as pandas and returns rows of ``schema``.  A batch that
    fails is halved until the bad documents stand alone; each gives one error row
    (``schema`` must hold ``doc_id`` and ``error``) and the run goes on.
    """
    columns = [part.strip().split()[0].rstrip(":") for part in schema.split(",")]

    def shaped(frame: pd.DataFrame) -> pd.DataFrame:
        """All columns of the schema; texts and absent columns as plain objects."""
        absent = {c: pd.Series([None] * len(frame), index=frame.index, dtype=object) for c in columns if c not in frame}
        frame = frame.assign(**absent)[columns]
        texts = [c for c in columns if isinstance(frame[c].dtype, pd.StringDtype)]
        return frame.astype({c: object for c in texts})

    def halved(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        try:
            found = shaped(model(rows))
        except Exception as problem:  # noqa: BLE001 - becomes the row's error
            if len(rows) == 1:
                yield shaped(pd.DataFrame({"doc_id": rows["doc_id"].tolist(), "error": [str(problem)]}))
                return
            yield from halved(rows.iloc[: len(rows) // 2])
            yield from halved(rows.iloc[len(rows) // 2:])
            return
        yield found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield from halved(batch)

    return df.mapInPandas(run, schema)
