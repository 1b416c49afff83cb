"""License scans: Aho-Corasick over whole texts finds notice phrases and identifier tags; expressions are parsed.

Texts are reduced to words: A-Z lower-cased, every other ASCII character than a letter or digit a break. One automaton
finds all phrases in one pass, and the identifier tag too. What follows a tag is read as a license expression (and, or,
with, parentheses) by a shunting-yard parser, whose tree names the licenses and tells whether a permissive choice is open.

Defined cases: a null text counts as empty; it has no words, no labels and score 0. Empty tables give empty tables;
repeated rows and null row ids are scanned like any other row; further columns are ignored. A malformed expression
yields the licenses named before the fault. What follows a tag but is no identifier of KNOWN gives no label. Every place
counts, overlapping ones too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import bounded_batches

#: Fixed by the contract of op3: phrase, label.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Further notices: phrase, label, how surely the phrase states the license.
NOTICES = {
    "gnu general public license version 2": ("gpl-2", 0.95),
    "gnu general public license version 3": ("gpl-3", 0.95),
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "permission is hereby granted free of charge": ("mit", 0.8),
    "redistribution and use in source and binary forms": ("bsd", 0.8),
    "cc by sa": ("cc-by-sa", 0.9),
    "cc by nd": ("cc-by-nd", 0.9),
    "creative commons attribution": ("cc-by", 0.7),
    "public domain dedication": ("cc0", 0.7),
    "all rights reserved": ("all-rights-reserved", 0.6),
}

TAG = "spdx license identifier"
BASE_SURE, TAG_SURE = 1.0, 1.0

#: License families that allow reuse with no more than a notice.
PERMISSIVE = ("mit", "apache", "bsd", "isc", "zlib", "cc0", "cc-by-4", "cc-by-3", "unlicense", "bsl")

#: What counts as an identifier after a tag, as families with their versions; other words after a tag are no label.
KNOWN = re.compile(
    r"(?:mit(?:-0)?|isc|zlib|unlicense|0bsd|wtfpl|x11|ncsa|postgresql|json|openssl|ruby|vim|cc0-1\.0|licenseref-[a-z0-9.-]+"
    r"|(?:apache|artistic|bsl|cddl|cecill|ecl|epl|eupl|afl|osl|ms-pl|mpl|python|php|psf|ofl|odbl|sspl|busl|ipl|upl|zpl)-[0-9]+(?:\.[0-9]+)*(?:-[a-z0-9-]+)?"
    r"|(?:l|a)?gpl-[0-9](?:\.[0-9])?(?:-only|-or-later|\+)?|gfdl-1\.[0-9](?:-[a-z-]+)?|bsd-[0-9]-clause(?:-[a-z0-9-]+)?|cc-by(?:-[a-z]{2})*-[0-9](?:\.[0-9])?(?:-[a-z]+)?)"
    r"(?:-with-[a-z0-9.-]*exception[a-z0-9.-]*)?"
)

BREAKS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()
AFTER_TAG = re.compile(r"SPDX-License-Identifier[ \t]*:?[ \t]*", re.I)
TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
RANK = {"or": 1, "and": 2, "with": 3}


def words_of(text: str) -> list[bytes]:
    """The words of op3 as UTF-8, A-Z lower-cased."""
    return text.encode().translate(BREAKS).split()


def parse_expression(text: str, start: int = 0):
    """The tree of the license expression at a place, by shunting-yard: an id, or (operator, left, right); None if there is none.

    It ends where no operand or operator can follow. An operator without a right side, and a parenthesis never closed, are dropped.
    """
    out: list = []
    held: list[str] = []

    def reduce() -> None:
        op = held.pop()
        if len(out) >= 2:
            right, left = out.pop(), out.pop()
            out.append((op, left, right))

    operand_next, at = True, start
    while found := TOKEN.match(text, at):
        token = found[1].lower()
        if operand_next:
            if token == "(":
                held.append(token)
            elif token == ")" or token in RANK:
                break
            else:
                out.append(token.rstrip(".-:"))
                operand_next = False
        elif token == ")":
            if "(" not in held:
                break
            while held[-1] != "(":
                reduce()
            held.pop()
        elif token in RANK:
            while held and held[-1] != "(" and RANK[held[-1]] >= RANK[token]:
                reduce()
            held.append(token)
            operand_next = True
        else:
            break
        at = found.end()
    if operand_next:  # what waits for a right side goes
        while held and held[-1] in ("(", *RANK):
            if held.pop() != "(":
                break
    while held:
        if held[-1] == "(":
            held.pop()
        else:
            reduce()
    return out[-1] if out else None


def licenses_in(tree) -> list[str]:
    """The ids of an expression, from left to right; an exception is kept with what it is granted to."""
    out, waiting = [], [tree]
    while waiting:
        tree = waiting.pop()
        if tree is None or isinstance(tree, str):
            out += [tree] if tree else []
        elif tree[0] != "with":
            waiting += [tree[2], tree[1]]
        elif isinstance(tree[1], str) and isinstance(tree[2], str):
            out.append(f"{tree[1]}-with-{tree[2]}")
        else:
            waiting.append(tree[1])
    return out


def is_permissive(tree) -> bool:
    """Whether some way to meet the expression uses permissive licenses only."""
    known, waiting = [], [(tree, False)]
    while waiting:
        tree, sides_known = waiting.pop()
        if tree is None or isinstance(tree, str):
            known.append(bool(tree) and tree.startswith(PERMISSIVE))
        elif tree[0] == "with":
            waiting.append((tree[1], False))
        elif not sides_known:
            waiting += [(tree, True), (tree[2], False), (tree[1], False)]
        else:
            right, left = known.pop(), known.pop()
            known.append(left or right if tree[0] == "or" else left and right)
    return known[0]


class Scanner:
    """The automaton over all phrases, each with a space before and behind so that it starts and ends with whole words."""

    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for phrase, label in BASE_PHRASES.items():
            self.automaton.add_word(f" {phrase} ", (phrase, label, BASE_SURE))
        for phrase, (label, sure) in NOTICES.items():
            self.automaton.add_word(f" {phrase} ", (phrase, label, sure))
        self.automaton.add_word(f" {TAG} ", (TAG, "", TAG_SURE))
        self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[int, list[tuple[int, str, str]], dict[str, float], list[bool]]:
        """The number of words; base places (first word, phrase, label); each label with its certainty; whether each tagged expression is permissive."""
        words = words_of(text)
        flat = f" {b' '.join(words).decode()} "
        base, labels, allowed, tagged = [], {}, [], False
        last_end = last_word = 0
        for end, (phrase, label, sure) in self.automaton.iter(flat):
            if phrase == TAG:
                tagged = True
                continue
            labels[label] = max(sure, labels.get(label, 0.0))
            if phrase in BASE_PHRASES:
                start = end - len(phrase) - 1  # the space before it
                if start < last_end:
                    last_end = last_word = 0
                last_word += flat.count(" ", last_end, start)
                last_end = start
                base.append((last_word, phrase, label))
        if tagged:
            for found in AFTER_TAG.finditer(text):
                tree = parse_expression(text, found.end())
                names = list(filter(KNOWN.fullmatch, licenses_in(tree)))
                labels |= dict.fromkeys(names, TAG_SURE)
                if names:
                    allowed.append(is_permissive(tree))
        return len(words), base, labels, allowed


_SCANNER: list[Scanner] = []

SCANNED = "row_id long, n_words long, places array<struct<word:long,label:string>>, labels array<string>, sure array<double>, permissive array<boolean>"


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_id, n_words, places (first word and label of each base phrase), labels with their certainty, and whether each tagged expression is permissive."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _SCANNER:
            _SCANNER.append(Scanner())
        scan = _SCANNER[0].scan
        place = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
        for batch in batches:
            found = [scan(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for n, *_ in found], pa.int64()),
                    pa.array([[{"word": w, "label": label} for w, _, label in base] for _, base, *_ in found], place),
                    pa.array([list(labels) for *_, labels, _ in found], pa.list_(pa.string())),
                    pa.array([list(labels.values()) for *_, labels, _ in found], pa.list_(pa.float64())),
                    pa.array([allowed for *_, allowed in found], pa.list_(pa.bool_())),
                ],
                names=["row_id", "n_words", "places", "labels", "sure", "permissive"],
            )

    return docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCANNED)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: license phrases and labels of every document; score is the chance that at least one label holds."""
    from plumbline.llm.common import table

    found = scan_licenses(table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda p: p["word"])
    return found.select(
        F.col("row_id").alias("doc_id"),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"]))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct("labels")), ",").alias("labels"),
        (1 - F.aggregate("sure", F.lit(1.0), lambda left, s: left * (1 - s))).alias("score"),
        F.exists("permissive", lambda p: p).alias("permissive_choice"),
    )
