"""Token counts by byte-pair merging over a linked list, with a heap of the pairs that could merge next.

Only the count is kept: a word starts as its bytes, every merge takes one symbol away, and no identifier is ever formed.
Null and empty texts count 0 tokens; repeated rows are counted one by one, a null doc_id stays null; a text of any length
is counted whole. Of pairs with one rank the leftmost merges first. Other columns of docs, whatever their names, are left
aside; no rows give no rows.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import kept, texts
from quire.llm.tokens import BYTE_PATTERN, Chunked, byte_letters


class Counter(Chunked):
    """How many tokens a byte-level vocabulary makes of a text."""

    def __init__(self, file: str, limit: int = 600_000):
        super().__init__(True, BYTE_PATTERN, limit)
        with open(file, encoding="utf-8") as f:
            said = json.load(f)
        vocabulary, letters = said["model"]["vocab"], byte_letters()
        self.byte = [vocabulary[letters[b]] for b in range(256)]
        #: (left, right) -> (rank, what they merge into)
        self.merge = {}
        for rank, pair in enumerate(said["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge[vocabulary[a], vocabulary[b]] = rank, vocabulary[a + b]
        special = [x["content"] for x in said["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    total = staticmethod(sum)

    def word(self, word: str) -> int:
        symbols = [self.byte[b] for b in word.encode()]
        n, merge = len(symbols), self.merge
        if n < 2:
            return n
        heap = []
        for i in range(n - 1):
            got = merge.get((symbols[i], symbols[i + 1]))
            if got:
                heap.append((got[0], i, got[1], symbols[i], symbols[i + 1]))
        heapq.heapify(heap)
        after, before, left = [*range(1, n), -1], [*range(-1, n - 1)], n
        while heap:
            _, i, into, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue  # one of the two has merged since
            symbols[i], symbols[j], left = into, -1, left - 1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                got = merge.get((into, symbols[k]))
                if got:
                    heapq.heappush(heap, (got[0], i, got[1], into, symbols[k]))
            h = before[i]
            if h >= 0:
                got = merge.get((symbols[h], into))
                if got:
                    heapq.heappush(heap, (got[0], h, got[1], symbols[h], into))
        return left

    def odd(self, chunk: str) -> int:
        parts = self.special.split(chunk) if self.special else [chunk]
        return sum(1 if i % 2 else sum(map(self.word, self.cut(p))) for i, p in enumerate(parts))


def count_tokens(docs: DataFrame, file: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for each row of docs."""

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counter = kept(Counter, file)
        for batch in batches:
            n = pa.array([counter.of(t) for t in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], ["doc_id", "n_bytes", "n_tokens"])

    rows = texts(docs, id_col, text_col).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
