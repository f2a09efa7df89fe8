"""Problem 9: evaluation passages inside corpus documents, by multi-pattern shift search.

Wu and Manber's search over words instead of characters.  The patterns are all runs of
``MIN_WORDS`` consecutive words of the evaluation items.  A shift table over blocks of two words
tells how far the search window may jump (a block that is in no pattern skips MIN_WORDS - 1
words); a shift of zero selects the bucket of patterns that end with the block, and comparing
the window's words directly confirms an occurrence.
"""

from __future__ import annotations

import html
import re
import unicodedata
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MIN_WORDS = 12

_ANSI = re.compile("(?:\x1b|\\\\x1[bB]|\\\\u001[bB]|\\\\033|\\\\e)(?:\\[[0-9;?]*[A-Za-z]|\\][^\x07]*\x07)")
_ESCAPE = re.compile(r"\\+(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|([nrtbfav0\"'/]))")
_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:\s+[\w:-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]+))*\s*/?>")
#: Tags that always part words.
_BLOCK_TAGS = frozenset("br p div li ul ol td th tr table h1 h2 h3 h4 h5 h6 hr pre blockquote img section".split())
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_PAIR = re.compile(r"\\+u([dD][89abAB][0-9a-fA-F]{2})\\+u([dD][c-fC-F][0-9a-fA-F]{2})")
_WORD = re.compile(r"[^\W_]+")
#: ASCII only: everything but letters and digits becomes a blank, capitals become small letters.
_ASCII = {i: " " for i in range(128) if not chr(i).isalnum()} | {i: chr(i).lower() for i in range(65, 91)}
#: Invisible characters: soft hyphen, joiners, fillers, direction marks, variation selectors, byte-order mark.
_HIDDEN = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]")


def _resolved(m: re.Match) -> str:
    code = m[1] or m[2]
    return chr(int(code, 16)) if code else " "


def _joined(m: re.Match) -> str:
    return chr(0x10000 + ((int(m[1], 16) - 0xD800) << 10) + int(m[2], 16) - 0xDC00)


def _inner(m: re.Match) -> str:
    """An inline tag vanishes; a block tag leaves a gap."""
    return " " if re.match(r"</?([A-Za-z0-9]*)", m[0])[1].lower() in _BLOCK_TAGS else ""


def _plain(text: str) -> list[str]:
    if text.isascii():
        return text.translate(_ASCII).split()
    text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text)).casefold()
    return _WORD.findall(_HIDDEN.sub("", unicodedata.normalize("NFKC", text)))


def readings(text: str) -> Iterator[list[str]]:
    """Word lists under each reading of the text's notation; equal readings are not repeated.

    Escape codes of terminals vanish and character entities are decoded in all of them.
    Backslash escapes are read both as escapes and as plain characters.  A tag between two
    letters may stand inside a word or part two, so such texts are read both ways.
    """
    forms = [text]
    if "\\" in text or "\x1b" in text:
        forms = [_ANSI.sub("", text)]
        if _ESCAPE.search(forms[0]):
            forms.append(_ESCAPE.sub(_resolved, _PAIR.sub(_joined, forms[0])))
    for form in forms:
        if "&" in form:
            form = _ENTITY.sub(lambda m: html.unescape(m[0]), form)
        if "<" not in form:
            yield _plain(form)
            continue
        spans = [m.span() for m in _TAG.finditer(form)]
        yield _plain(_TAG.sub(" ", form) if spans else form)
        if any(a and b < len(form) and (form[a - 1] == ">" or form[a - 1].isalnum()) and (form[b] == "<" or form[b].isalnum()) for a, b in spans):
            yield _plain(_TAG.sub(_inner, form))


class ShiftSearch:
    """Word-level Wu-Manber tables over the patterns of all items."""

    def __init__(self, items: list[tuple[int, str]], length: int = MIN_WORDS):
        self.length = length
        self.shift: dict[tuple[str, str], int] = {}
        self.buckets: dict[tuple[str, str], dict[tuple[str, ...], set[int]]] = {}
        for item, text in items:
            for words in readings(text or ""):
                for start in range(len(words) - length + 1):
                    p = words[start : start + length]
                    for end in range(1, length):
                        block = (p[end - 1], p[end])
                        self.shift[block] = min(self.shift.get(block, length), length - 1 - end)
                    self.buckets.setdefault((p[-2], p[-1]), {}).setdefault(tuple(p), set()).add(item)

    def find(self, words: list[str]) -> set[int]:
        found: set[int] = set()
        n, size, shift, skip = len(words), self.length, self.shift, self.length - 1
        at = size - 1
        while at < n:
            block = (words[at - 1], words[at])
            step = shift.get(block, skip)
            if step:
                at += step
                continue
            bucket = self.buckets.get(block)
            if bucket:
                hit = bucket.get(tuple(words[at - size + 1 : at + 1]))
                if hit:
                    found |= hit
            at += 1
        return found

    def search(self, text: str | None) -> set[int]:
        found: set[int] = set()
        if text:
            for words in readings(text):
                found |= self.find(words)
        return found


#: Item text, in characters, whose tables a worker holds at a time; more items are searched in several passes.
BLOCK_CHARS = 8_000_000
_TABLES: dict[str, ShiftSearch] = {}


def _tables(key: str, items: list[tuple[int, str]], length: int) -> ShiftSearch:
    """The tables of a block of items, built once in a worker."""
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = ShiftSearch(items, length)
    return _TABLES[key]


def _blocks(items: Iterable[tuple[int, str]], most: int) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for i, t in items:
        if i is None or not t:
            continue
        if block and size + len(t) > most:
            yield block
            block, size = [], 0
        block.append((int(i), t))
        size += len(t)
    if block:
        yield block


def find_leaks(documents: DataFrame, items: DataFrame | list[tuple[int, str]], min_words: int = MIN_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id``, ``item_id``: documents holding ``min_words`` consecutive words of an item.

    ``items``: a table of item_id and item_text, or a list of both (a held-out set).  They travel with the tasks in blocks of at most
    ``block_chars`` characters, and the documents are read once a block.  Both sides count in all readings of their notation.
    Null and empty texts and items shorter than ``min_words`` give no row; repeated documents give their row once.
    """
    if isinstance(items, DataFrame):
        items = ((r[0], r[1]) for r in items.select("item_id", "item_text").toLocalIterator())
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64())])
    kind = "doc_id long, item_id long"

    def search(block: list[tuple[int, str]]) -> DataFrame:
        key = uuid.uuid4().hex

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = _tables(key, block, min_words)
            for batch in batches:
                ids, hits = [], []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    for item in tables.search(text.as_py()):
                        ids.append(doc)
                        hits.append(item)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hits, pa.int64())], schema=schema)

        return documents.select("doc_id", "text").where("text is not null").mapInArrow(scan, kind)

    found = None
    for block in _blocks(items, block_chars):
        found = search(block) if found is None else found.unionByName(search(block))
    return documents.sparkSession.createDataFrame([], kind) if found is None else found.distinct()
