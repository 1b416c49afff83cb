"""The nested blocks of Markdown notes: quotes and callouts by depth, fenced code, and notes without their code.

Lines are rows in order of place. Whether a line is code depends on all lines before it, so fences, and the quotes that are
open, are followed as a sorted stream of lines by note; its state is one fence and a stack as deep as the quotes.

notes: path, content. Defined cases: null contents are empty; paths are taken to be
distinct; `\\r\\n` and `\\n` end lines; a fence that is never closed runs to the end and is told.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.folds import sorted_fold

QUOTE = re.compile(r"(?:[ \t]{0,3}>[ \t]?)+")
CALLOUT = re.compile(r"\[!(?P<kind>[A-Za-z0-9-]+)\](?P<fold>[+-]?)[ \t]*(?P<title>.*)")
FENCE = re.compile(r"[ \t]{0,3}(?P<mark>`{3,}|~{3,})(?P<info>[^`]*)$")
BLOCK_ID = re.compile(r"(?:^|\s)\^(?P<id>[A-Za-z0-9-]+)\s*$")

LINES = "path string, line int, depth int, code boolean, text string"
BLOCKS = "path string, line int, last int, depth int, type string, folded boolean, title string, parent int, block_id string"


def _rows(notes: DataFrame) -> DataFrame:
    return notes.select("path", F.posexplode(F.split(F.coalesce("content", F.lit("")), "\r?\n", -1)).alias("at", "value"))


class Fence:
    """The fence that is open: its mark and the depth of quotes it stands in."""

    def __init__(self):
        self.mark, self.depth = "", 0

    def takes(self, depth: int, text: str) -> bool:
        """Whether a line is code, its fences included; a quote that ends, ends its fence."""
        if self.mark and depth < self.depth:
            self.mark = ""
        found = FENCE.match(text)
        if not self.mark:
            if found:
                self.mark, self.depth = found["mark"], depth
            return bool(found)
        if found and found["mark"].startswith(self.mark) and not found["info"].strip():
            self.mark = ""
        return True


def _quoted(value: str, fence: Fence) -> tuple[int, str]:
    """Depth and text of a line; inside a fence deeper marks are code."""
    found = QUOTE.match(value)
    if not found:
        return 0, value
    depth, text = found[0].count(">"), value[found.end() :]
    if fence.mark and depth > fence.depth:
        marks = list(re.finditer(r"[ \t]{0,3}>[ \t]?", found[0]))
        cut = marks[fence.depth - 1].end() if fence.depth else 0
        return fence.depth, value[cut:]
    return depth, text


def lines(notes: DataFrame) -> DataFrame:
    """path, line (from 1), depth of quotes, whether it is code, and the text after the quote marks."""

    def row(fence: Fence, r: dict):
        depth, text = _quoted(r["value"], fence)
        return fence, (r["path"], r["at"] + 1, depth, fence.takes(depth, text), text)

    return sorted_fold(_rows(notes), ["path"], ["at"], LINES, begin=lambda r: Fence(), row=row)


class Open:
    """Fence and stack of the blocks that are open in a note."""

    def __init__(self):
        self.fence, self.stack = Fence(), []

    def close(self, path: str, depth: int, last: int) -> list[tuple]:
        """Blocks deeper than a depth end with the line before."""
        out = []
        while self.stack and self.stack[-1]["depth"] > depth:
            b = self.stack.pop()
            out.append((path, b["line"], last, b["depth"], b["type"], b["folded"], b["title"], b["parent"], b["id"]))
        return out

    def take(self, path: str, at: int, value: str) -> list[tuple]:
        depth, text = _quoted(value, self.fence)
        out = self.close(path, depth, at - 1)
        code = self.fence.takes(depth, text)
        found = None if code else CALLOUT.fullmatch(text.strip())
        if found and self.stack and self.stack[-1]["depth"] == depth:
            out += self.close(path, depth - 1, at - 1)
        for level in range(self.stack[-1]["depth"] + 1 if self.stack else 1, depth + 1):
            mine = found if level == depth else None
            parent = self.stack[-1]["line"] if self.stack else None
            kind = mine["kind"].lower() if mine else "quote"
            self.stack.append({"line": at, "depth": level, "type": kind, "folded": bool(mine and mine["fold"] == "-"), "title": mine["title"].strip() if mine else "", "parent": parent, "id": None})
        if self.stack and not code and (name := BLOCK_ID.search(text)):
            self.stack[-1]["id"] = name["id"]
        return out


def blocks(notes: DataFrame) -> DataFrame:
    """Each quote and callout: its first and last line, depth, type, fold, title, the first line of the block around it, and its id."""

    def row(state: Open, r: dict):
        return state, state.take(r["path"], r["at"] + 1, r["value"])

    def end(r: dict, state: Open):
        return state.close(r["path"], 0, r["at"] + 1)

    return sorted_fold(_rows(notes), ["path"], ["at"], BLOCKS, begin=lambda r: Open(), row=row, end=end)


def without_code(notes: DataFrame) -> DataFrame:
    """path, text (lines of code empty, inline code gone) and unclosed: the line of a fence that is never closed, else null."""

    def row(state: list, r: dict):
        fence, start = state[0], state[1]
        depth, text = _quoted(r["value"], fence)
        was = fence.mark
        code = fence.takes(depth, text)
        if fence.mark and not was:
            start = r["at"] + 1
        return [fence, start], (r["path"], r["at"], "" if code else r["value"], None)

    def end(r: dict, state: list):
        return (r["path"], r["at"] + 1, None, state[1] if state[0].mark else None)

    told = sorted_fold(_rows(notes), ["path"], ["at"], "path string, at int, value string, unclosed int", begin=lambda r: [Fence(), 0], row=row, end=end)
    whole = told.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("at", "value")))), lambda x: x["value"]), "\n").alias("text"), F.max("unclosed").alias("unclosed"))
    return whole.select("path", F.regexp_replace("text", r"(?<![\\`])(`+)(?!`)[^\n]*?(?<!`)\1(?!`)", "").alias("text"), "unclosed")
