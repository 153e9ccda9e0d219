"""Passages of evaluation items in a corpus: Wu-Manber search over words."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_WORD = re.compile(r"[^\W_]+")
#: Pattern tables are sent to every task; a larger set of items is searched in several passes of at most this many windows.
MAX_WINDOWS = 2_000_000


def words(text: str) -> list[str]:
    """The runs of letters and digits, without case and accents."""
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return _WORD.findall(text.casefold())


class Patterns:
    """Wu-Manber tables for word windows of one length.

    Patterns are all windows of ``length`` words of the items. A block is two words. ``shift`` says how far the search
    may move when a block ends at the current place: the least distance from the block's end in any pattern to the
    pattern's end, and length - 1 for a block in no pattern. At shift 0, ``buckets`` gives, by the last block, the
    patterns to compare with directly.
    """

    def __init__(self, items: list[tuple[int, str]], length: int = 10):
        self.length = length
        self.shift: dict[tuple[str, str], int] = {}
        self.buckets: dict[tuple[str, str], dict[tuple[str, ...], tuple[int, ...]]] = {}
        for item, text in items:
            ws = words(text)
            for i in range(len(ws) - length + 1):
                window = tuple(ws[i : i + length])
                for j in range(1, length):
                    block = window[j - 1 : j + 1]
                    self.shift[block] = min(self.shift.get(block, length - 1), length - 1 - j)
                bucket = self.buckets.setdefault(window[-2:], {})
                if item not in bucket.get(window, ()):
                    bucket[window] = (*bucket.get(window, ()), item)

    def search(self, text: str) -> set[int]:
        """The items of which the text holds a window."""
        ws = words(text)
        found: set[int] = set()
        shift, far, m = self.shift.get, self.length - 1, self.length
        at, n = m - 1, len(ws)
        while at < n:
            block = (ws[at - 1], ws[at])
            move = shift(block, far)
            if move:
                at += move
                continue
            items = self.buckets.get(block, {}).get(tuple(ws[at - m + 1 : at + 1]))
            if items:
                found.update(items)
            at += 1
        return found


def find_leaks(documents: DataFrame, items: DataFrame, length: int = 10) -> DataFrame:
    """doc_id, eval_id of each document whose text holds ``length`` consecutive words of an item.

    The items are a held-out set of fixed size; they are read in order of eval_id, turned into tables and sent to the
    tasks in passes of at most MAX_WINDOWS windows, each pass a scan of the whole corpus without a shuffle. Items with
    fewer words than ``length``, null and empty texts match nothing. Other columns are left out; repeated documents
    give one row.
    """
    spark = documents.sparkSession
    passes: list[list[tuple[int, str]]] = [[]]
    size = 0
    for row in items.select("eval_id", "eval_text").where("eval_text IS NOT NULL AND eval_id IS NOT NULL").distinct().orderBy("eval_id").toLocalIterator():
        n = len(row.eval_text) // 4
        if passes[-1] and size + n > MAX_WINDOWS:
            passes.append([])
            size = 0
        passes[-1].append((row.eval_id, row.eval_text))
        size += n
    texts = documents.select("doc_id", "text").where("text IS NOT NULL")
    result = None
    for part in passes:
        tables = spark.sparkContext.broadcast(part)

        def scan(batches: Iterator[pa.RecordBatch], tables=tables) -> Iterator[pa.RecordBatch]:
            patterns = Patterns(tables.value, length)
            for batch in batches:
                docs, evals = [], []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for item in patterns.search(text):
                        docs.append(doc)
                        evals.append(item)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs, pa.int64()), "eval_id": pa.array(evals, pa.int64())})

        found = texts.mapInArrow(scan, "doc_id long, eval_id long")
        result = found if result is None else result.unionByName(found)
    return result.distinct()
