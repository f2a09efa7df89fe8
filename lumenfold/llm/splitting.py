"""Problem 10: texts above a token limit are cut at natural boundaries, with overlap.

Recursive bisection: a part of more than ``limit - overlap`` tokens is cut at the strongest boundary
near its middle (end of a cell, paragraph, line, sentence, word, token) and both halves are treated
alike; then every piece but the first is preceded by ``overlap`` tokens of what comes before.  A text is
encoded once.  Pre-tokens hold white space at their start only, so a place where white space follows
another character parts pre-tokens in the whole text and in every piece: between two such places
counts add up, and only the ends of a piece are encoded again for its exact count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.tokens import VOCABULARY, Counter, counter

LIMIT, OVERLAP = 1024, 128
#: Share of a part, around its middle, in which a boundary is looked for.
NEAR_MIDDLE = 0.5
#: Tokens by which a part may change when it stands alone; parts are kept that much smaller.
SLACK = 4

_PARAGRAPH = re.compile(r"\n[ \t\r]*\n\s*")
_LINE = re.compile(r"\n|\\n")
_SENTENCE = re.compile(r"[.!?][\"')\]]*\s+|[。！？]")
#: White space of Unicode.
_SPACES = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)


class _Text:
    """A text with its tokens: cut places by kind, and exact counts of its parts."""

    def __init__(self, text: str, cell_ends: list[int], c: Counter):
        self.text, self.counter, self.cells = text, c, cell_ends
        self.token_ends = c.ends(text)
        if text.isascii():
            code = np.frombuffer(text.encode(), np.uint8)
            self.starts = None
        else:
            code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            self.starts = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        low = np.zeros(256, bool)
        low[_SPACES[_SPACES < 256]] = True
        space = low[code] if self.starts is None else np.isin(code, _SPACES)
        change = space[1:] != space[:-1]
        self.words = np.flatnonzero(change) + 1
        self.safe = np.flatnonzero(change & space[1:]) + 1
        self.kinds: list[tuple[np.ndarray, np.ndarray] | None] = [None] * 6

    def tokens(self, chars: np.ndarray) -> np.ndarray:
        """Tokens of the whole text that end at or before each character place."""
        return np.searchsorted(self.token_ends, chars if self.starts is None else self.starts[chars], "right")

    def place(self, token: int) -> int:
        """First character place at or after the end of so many tokens."""
        end = int(self.token_ends[token - 1]) if token > 0 else 0
        return end if self.starts is None else int(np.searchsorted(self.starts, end, "left"))

    def kind(self, no: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the boundaries of a kind (strongest first) and the tokens before them."""
        if self.kinds[no] is None:
            text = self.text
            if no == 0:
                places = self.cells
            elif no in (1, 2, 3):
                places = [m.end() for m in (_PARAGRAPH, _LINE, _SENTENCE)[no - 1].finditer(text)]
            elif no == 4:
                places = self.words
            else:
                ends = self.token_ends if self.starts is None else np.searchsorted(self.starts, self.token_ends, "left")
                places = np.unique(ends)
            places = np.asarray(places, np.int64)
            self.kinds[no] = places, self.tokens(places)
        return self.kinds[no]

    def cut(self, a: int, z: int, ta: int, tz: int) -> int:
        """Place strictly between a and z: the strongest boundary near the middle."""
        middle, reach = (ta + tz) / 2, (tz - ta) * NEAR_MIDDLE / 2
        for no in range(6):
            places, before = self.kind(no)
            i, j = int(np.searchsorted(before, middle - reach, "left")), int(np.searchsorted(before, middle + reach, "right"))
            i, j = max(i, int(np.searchsorted(places, a, "right"))), min(j, int(np.searchsorted(places, z, "left")))
            if i < j:
                return int(places[i + int(np.abs(before[i:j] - middle).argmin())])
        return (a + z) // 2

    def count(self, a: int, z: int) -> int:
        """Tokens of the characters a..z as a text of their own."""
        i, j = int(np.searchsorted(self.safe, a, "left")), int(np.searchsorted(self.safe, z, "right")) - 1
        if i > j:
            return self.counter.count(self.text[a:z])
        first, last = int(self.safe[i]), int(self.safe[j])
        inner = self.tokens(np.array([first, last]))
        return self.counter.count(self.text[a:first]) + int(inner[1] - inner[0]) + self.counter.count(self.text[last:z])


def split_text(text: str, cell_ends: list[int], c: Counter, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(from, core from, to, tokens) of the pieces of a text, in characters."""
    if len(text) * 4 <= limit or len(text.encode("utf-8", "replace")) <= limit:
        return [(0, 0, len(text), c.count(text))]  # a token holds at least one byte
    t = _Text(text, cell_ends, c)
    if len(t.token_ends) <= limit:
        return [(0, 0, len(text), len(t.token_ends))]
    most = max(1, limit - overlap - SLACK)
    cores, todo = [], [(0, len(text), 0, len(t.token_ends))]
    while todo:
        a, z, ta, tz = todo.pop()
        if tz - ta <= most or z - a < 2:
            cores.append((a, z, ta))
            continue
        k = t.cut(a, z, ta, tz)
        tk = int(t.tokens(np.array([k]))[0])
        todo += [(k, z, tk, tz), (a, k, ta, tk)]
    out = []
    for no, (a, z, ta) in enumerate(cores):
        start = min(a, t.place(max(0, ta - overlap))) if no and overlap else a
        out.append((start, a, z, t.count(start, z)))
    return out


def split_documents(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str = VOCABULARY, texts: bool = True) -> DataFrame:
    """``doc_id``, ``piece_no`` (from 1), ``char_from``, ``core_from``, ``char_to``, ``n_tokens`` and, with ``texts``, ``piece_text``.

    ``char_from`` .. ``core_from`` is shared with the piece before.  Texts within the limit stay
    whole; empty texts give one empty piece, null texts and ids none.  Counts are those of the piece encoded
    by itself; should one exceed the limit (cuts inside a very long word), the text is cut again with a smaller aim.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be smaller than the limit")
    schema = pa.schema([("doc_id", pa.int64()), ("piece_no", pa.int32()), ("char_from", pa.int32()), ("core_from", pa.int32()), ("char_to", pa.int32()), ("n_tokens", pa.int32()), ("piece_text", pa.string())][: 7 if texts else 6])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for b in batches:
            cols: list[list] = [[] for _ in schema]
            size = 0
            for doc, text, cells in zip(b.column(0), b.column(1), b.column(2)):
                text = text.as_py()
                cell_ends = sorted({x for x in cells.as_py() or [] if x is not None and 0 < x < len(text)})
                for no, (start, core, end, n) in enumerate(_within(text, cell_ends, c, limit, overlap), 1):
                    for col, v in zip(cols, (doc.as_py(), no, start, core, end, n, text[start:end] if texts else None)):
                        col.append(v)
                    size += end - start if texts else 100
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, schema)], schema=schema)
                    cols, size = [[] for _ in schema], 0
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, schema)], schema=schema)

    src = documents.where("doc_id is not null and text is not null")
    ends = F.transform("cells", lambda x: x.char_to) if "cells" in documents.columns else F.lit(None).cast("array<int>")
    kind = "doc_id long, piece_no int, char_from int, core_from int, char_to int, n_tokens int" + ", piece_text string" * texts
    return src.select("doc_id", "text", ends.alias("ends")).mapInArrow(run, kind)


def _within(text: str, cell_ends: list[int], c: Counter, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """Pieces that keep the limit by their exact counts."""
    aim = limit
    while True:
        pieces = split_text(text, cell_ends, c, aim, min(overlap, aim - 1))
        if all(p[3] <= limit for p in pieces) or aim <= 1:
            return pieces
        aim = max(1, aim * 7 // 8)
