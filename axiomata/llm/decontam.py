"""Benchmark decontamination by pigeonhole edit matching.

An item of n words may differ by up to k = floor(n * budget) word edits. It is
split into k + 1 pieces; k edits leave at least one piece unchanged, so every
occurrence holds an exact piece. One automaton finds the pieces of a block of
items in a text; around each hit Myers' bit-parallel algorithm gives the
least edit distance of the whole item to any span of the text near the hit.
Items go through in blocks of bounded size, so the benchmark may grow.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axiomata.llm.scratch import Scratch

_WORD = re.compile(r"\w+")
#: In scripts without spaces each character counts as a word.
_UNSPACED = "฀-໿က-႟ក-៿⺀-鿿豈-﫿\U00020000-\U0003ffff"
_DENSE, _MIXED = re.compile(f"[{_UNSPACED}]"), re.compile(f"[{_UNSPACED}]|(?:(?![{_UNSPACED}])\\w)+")
BUDGET = 0.2


def normal_words(text: str | None) -> list[str]:
    """Lower-case runs of letters, digits and underscores; in scripts without spaces, characters."""
    if not text:
        return []
    dense = not text.isascii() and _DENSE.search(text)
    return (_MIXED if dense else _WORD).findall(text.lower())


def best_match(pattern: list[str], text: list[str], most: int) -> tuple[int, int] | None:
    """(distance, end) of the span of ``text`` nearest to ``pattern``, if within ``most`` word edits.

    Myers' bit-parallel approximate matching with free start; the first end
    among the best.
    """
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    for j, w in enumerate(text):
        eq = masks.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


@dataclass
class Block:
    """Items with their pieces; ``finder`` is built once for each process."""

    items: list[tuple[object, list[str]]]
    budget: float
    pieces: dict[str, list[tuple[int, int]]] = field(default_factory=dict)

    def __post_init__(self):
        for i, (_, words) in enumerate(self.items):
            k = self.allowed(len(words))
            n = k + 1
            for p in range(n):
                a, b = len(words) * p // n, len(words) * (p + 1) // n
                self.pieces.setdefault(f" {' '.join(words[a:b])} ", []).append((i, a))

    def allowed(self, n: int) -> int:
        return min(n - 1, int(n * self.budget + 1e-9))

    def finder(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for piece, where in self.pieces.items():
            found.add_word(piece, (len(piece), where))
        found.make_automaton()
        return found

    def matches(self, finder, text: str | None) -> list[tuple[object, int, int]]:
        """(item, distance, end word) of every item within its budget in the text, at its best place."""
        words = normal_words(text)
        if not words:
            return []
        line = f" {' '.join(words)} "
        tried: dict[int, list[tuple[int, int]]] = {}
        for end, (length, where) in finder.iter(line):
            start = end - length + 1
            for i, offset in where:
                tried.setdefault(i, []).append((start, offset))
        if not tried:
            return []
        out = []
        for i, hits in tried.items():
            item, pattern = self.items[i]
            k, best, reach = self.allowed(len(pattern)), None, -1
            spans = sorted((line.count(" ", 0, s) - offset - k, offset) for s, offset in hits) if len(hits) < 8 else self._spans(line, hits, k)
            merged: list[list[int]] = []
            for lo, _ in spans:  # windows that overlap are read once
                hi = lo + len(pattern) + 2 * k
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], hi)
                else:
                    merged.append([lo, hi])
            for lo, hi in merged:
                lo = max(0, lo)
                got = best_match(pattern, words[lo:hi], k)
                if got and (best is None or got[0] < best[0]):
                    best, reach = got, lo + got[1]
            if best:
                out.append((item, best[0], reach))
        return out

    @staticmethod
    def _spans(line: str, hits: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
        """As above for many hits: word numbers by one pass over the line."""
        at, n, last, out = 0, 0, 0, []
        for s, offset in sorted(hits):
            n += line.count(" ", last, s)
            last = s
            out.append((n - offset - k, offset))
        return sorted(out)


def contaminated(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET, block_words: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, distance, n_words, at): every item found in every document, at its best place.

    ``distance`` is in word edits, at most ``budget`` of the item's words, so
    the similarity is 0.8 or more by default. ``at`` is the word after the
    match. Items and texts that are null or have no word match nothing; equal
    items are all reported; repeated documents are reported one by one. The
    items are read in blocks of ``block_words``; each block scans all
    documents once.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.select(F.col(id_col)).dtypes[0][1], benchmark.select(F.col(item_col)).dtypes[0][1]
    schema = f"id {kind}, item {item_kind}, distance int, n_words int, at int"
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).filter("text is not null")
    found = None
    for block in _blocks(rows, budget, block_words):
        part = _scan(texts, block, schema)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], schema)


def _blocks(rows: DataFrame, budget: float, block_words: int) -> Iterator[Block]:
    """The items, as they come, in blocks; the driver holds one Spark partition at a time."""
    own, words = [], 0
    for r in rows.toLocalIterator():
        w = normal_words(r["text"])
        if not w:
            continue
        own.append((r["item"], w))
        words += len(w)
        if words >= block_words:
            yield Block(own, budget)
            own, words = [], 0
    if own:
        yield Block(own, budget)


def _scan(texts: DataFrame, block: Block, schema: str) -> DataFrame:
    held = texts.sparkSession.sparkContext.broadcast(block)  # at most block_words and one item
    types = [pa.int32()] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        finder = block.finder()
        sizes = {i: len(w) for i, w in block.items}
        for batch in batches:
            rows = [(key, *hit) for key, text in zip(batch.column(0), batch.column(1)) for hit in block.matches(finder, text.as_py())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0].as_py() for r in rows], batch.schema.field(0).type), pa.array([r[1] for r in rows], item_type), *[pa.array(c, t) for c, t in zip(([r[2] for r in rows], [sizes[r[1]] for r in rows], [r[3] for r in rows]), types)]],
                names=["id", "item", "distance", "n_words", "at"],
            )

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    item_type = to_arrow_type(StructType.fromDDL(schema)["item"].dataType)
    return texts.mapInArrow(run, schema)


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET, block_words: int = 2_000_000, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns kept, whose text holds no item.

    Rows are judged in place, so nothing is shuffled; with several blocks of items
    what each leaves is written before the next, so that a task holds one automaton at a time. Null and
    empty texts stay, repeated rows stay repeated.
    """
    rows = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).filter("text is not null")
    at = docs.columns.index(text_col)

    def clean(df: DataFrame, block: Block) -> DataFrame:
        held = spark.sparkContext.broadcast(block)  # at most block_words and one item

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = held.value
            finder = block.finder()
            for batch in batches:
                yield batch.filter(pa.array([not block.matches(finder, t.as_py()) for t in batch.column(at)], pa.bool_()))

        return df.mapInArrow(run, df.schema)

    scratch, kept = Scratch(spark, "clean"), None
    for i, block in enumerate(_blocks(rows, budget, block_words)):
        if i:
            docs = kept = scratch.keep(docs, "clean", (kept,))
        docs = clean(docs, block)
    return docs
