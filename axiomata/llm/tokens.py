"""Exact token counts at every prefix of a text, by dynamic programming over BPE.

A byte-pair encoding is fixed by its adjacent pairs: a sequence of tokens is
the encoding of its text exactly if every neighbouring pair encodes to
itself. So the last token of each prefix follows from shorter prefixes, and
one pass gives the number of tokens of *every* prefix of a word, both inside
the word and as a word of its own. Sums over the words before it give the
count at every prefix of a text; truncation and budget questions are then
look-ups (:func:`cut_to_budget`), nothing is encoded again.

The vocabulary is a file of the ``tokenizers`` library whose words end in a
suffix; its pattern of words and its special tokens are read from the file. Texts of all scripts are
counted this way. Only parts with characters younger than the library's own Unicode
tables are left to the library itself, which gives the same numbers.
"""

from __future__ import annotations

import functools
import itertools
import json
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that are not assigned, or only in the newest tables: their classes are not the same everywhere.
_YOUNG = regex.compile(r"[\p{Cn}\ua7cb-\ua7dc\U000323b0-\U000dffff]")


def _byte_letters() -> list[str]:
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class PrefixCounter(dict):
    """Token counts of words by prefix dynamic programming; also the memo word -> count."""

    def __init__(self, path: str, memo: int = 1_000_000):
        super().__init__()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        whole = json.load(open(path, encoding="utf-8"))
        model = whole["model"]
        split = whole["pre_tokenizer"]["pretokenizers"][0]
        steps = [n["type"] for n in whole["normalizer"]["normalizers"]]
        if steps != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError(f"{path} normalises or splits in another way")
        # white space as the library's own expressions have it
        self.piece = regex.compile(split["pattern"]["Regex"].replace("\\s", "\\p{White_Space}"))
        special = [regex.escape(t["content"]) for t in whole["added_tokens"]]
        self.special = regex.compile(f"({'|'.join(special)})") if special else None
        self.marks = {t["content"][0] for t in whole["added_tokens"]}
        self.end = model["end_of_word_suffix"] or ""
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.letters = _byte_letters()
        self.memo = memo
        self.valid: dict[tuple[str, str], bool] = {}
        self.inner, self.final = set(), set()
        known = {a + b for a, b in pairs} | set(self.letters) | {x + self.end for x in self.letters}
        for t in known:
            if len(self._merge(self._symbols(t))) == 1:  # tokens that encode to themselves
                (self.final if t.endswith(self.end) else self.inner).add(t.removesuffix(self.end))
        self.longest = max(map(len, self.inner | self.final))

    def _symbols(self, token: str) -> list[str]:
        if token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def _merge(self, parts: list[str]) -> list[str]:
        """Plain BPE, for the tables and for pairs."""
        while len(parts) > 1:
            best = min((self.rank.get(p, 1 << 40), i) for i, p in enumerate(zip(parts, parts[1:])))
            if best[0] == 1 << 40:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _fits(self, left: str, right: str) -> bool:
        key = (left, right)
        known = self.valid.get(key)
        if known is None:
            if len(self.valid) > 2_000_000:
                self.valid.clear()
            known = self.valid[key] = self._merge([*left, *self._symbols(right)]) == [left, right]
        return known

    def word(self, word: str) -> list[int]:
        """Tokens of every prefix of a (lower-case) word, taken as a word; entry 0 is 0.

        Prefixes are by byte, so a prefix inside a character counts its bytes.
        """
        return self._dp("".join([self.letters[b] for b in word.encode()]), True)

    def _dp(self, s: str, every: bool) -> list[int]:
        n, inner, final, longest, end = len(s), self.inner, self.final, self.longest, self.end
        last, count, out = [""] * (n + 1), [0] * (n + 1), [0]
        for i in range(1, n + 1):
            if every or i == n:
                for a in range(max(0, i - longest), i):
                    if s[a:i] in final and (a == 0 or self._fits(last[a], s[a:i] + end)):
                        out.append(count[a] + 1)
                        break
            if i < n:
                for a in range(max(0, i - longest), i):
                    t = s[a:i]
                    if t in inner and (a == 0 or self._fits(last[a], t)):
                        last[i], count[i] = t, count[a] + 1
                        break
        return out

    def __missing__(self, word: str) -> int:
        if len(self) >= self.memo:
            self.clear()
        n = self[word] = self._dp("".join([self.letters[b] for b in word.encode()]), False)[-1]
        return n

    def _cut(self, text: str) -> list[str]:
        """The text between special tokens (even places) and these (odd places)."""
        return self.special.split(text) if self.special and any(m in text for m in self.marks) else [text]

    @staticmethod
    def _normal(part: str) -> str:
        """Composed and in lower case, each character by itself."""
        if part.isascii():
            return part.lower()
        if not unicodedata.is_normalized("NFC", part):
            part = unicodedata.normalize("NFC", part)
        return "".join(map(str.lower, part)) if "Σ" in part else part.lower()

    def _foreign(self, part: str) -> bool:
        return not part.isascii() and _YOUNG.search(part) is not None

    def count(self, text: str | None) -> int:
        """Tokens of a whole text."""
        total = 0
        for i, part in enumerate(self._cut(text) if text else ()):
            if i % 2:
                total += 1
            elif part and self._foreign(part):
                total += len(self.library.encode(part, add_special_tokens=False).ids)
            else:
                total += sum(map(self.__getitem__, self.piece.findall(self._normal(part))))
        return total

    def prefixes(self, text: str | None) -> tuple[list[int], list[int]]:
        """(ends, counts): the tokens of the text up to each end, in characters.

        The ends are those of pieces and special tokens; where characters change their number in lower case or by
        composition, and in parts that the library counts, those of the words between white space.
        """
        ends, counts, total, at = [], [], 0, 0
        for i, part in enumerate(self._cut(text) if text else ()):
            if i % 2:
                total += 1
                ends.append(at + len(part))
                counts.append(total)
            else:
                plain = self._normal(part)
                if len(plain) == len(part) and not self._foreign(part) and (part.isascii() or unicodedata.is_normalized("NFC", part)):
                    for m in self.piece.finditer(plain):
                        total += self[m[0]]
                        ends.append(at + m.end())
                        counts.append(total)
                else:
                    for m in _BETWEEN.finditer(part):
                        total += self.count(m[0])
                        ends.append(at + m.end())
                        counts.append(total)
            at += len(part)
        return ends, counts

    def at(self, text: str, ends: list[int], counts: list[int], n: int) -> int:
        """Tokens of the first ``n`` characters: the stored count before them and the one piece that is cut."""
        k = bisect_left(ends, n)  # ends before n; a piece that ends at n counts whole below
        begin = ends[k - 1] if k else 0
        return (counts[k - 1] if k else 0) + self.count(text[begin:n])

    def within(self, text: str | None, limit: int) -> tuple[int, int]:
        """(tokens, characters of the longest stored prefix with at most ``limit`` tokens)."""
        if text and text.isascii() and not any(m in text for m in self.marks):
            counts = list(itertools.accumulate(map(self.__getitem__, self.piece.findall(text.lower()))))
            if not counts or counts[-1] <= limit:
                return (counts[-1] if counts else 0), len(text)
            k = bisect_right(counts, limit)
            return counts[-1], next(itertools.islice(self.piece.finditer(text.lower()), k - 1, k)).end() if k else 0
        total = self.count(text)
        if total <= limit:
            return total, len(text or "")
        ends, counts = self.prefixes(text)
        k = bisect_right(counts, limit)
        return total, ends[k - 1] if k else 0


_BETWEEN = regex.compile(r"\P{White_Space}+")


@functools.lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    """The counter of this process for a vocabulary file."""
    return PrefixCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, kept_chars) of every whole text.

    ``over_limit`` and ``kept_chars`` (the length of the longest stored prefix with at most ``limit`` tokens; the whole text if it
    fits) are answered by the counts at its prefixes. Null and empty texts have 0 bytes and tokens; repeated rows are counted
    one by one; null ids stay null; an empty table gives no rows. ``path`` is the
    vocabulary file, which every executor must have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        within = counter(path).within
        for batch in batches:
            found = [within(t.as_py(), limit) for t in batch.column(2)]
            n, kept, over = [f[0] for f in found], [f[1] for f in found], [f[0] > limit for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(over, pa.bool_()), pa.array(kept, pa.int64())], names=["id", "n_bytes", "n_tokens", "over_limit", "kept_chars"])

    kind = docs.select(F.col(id_col)).dtypes[0][1]
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean, kept_chars long")


def prefix_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ends, counts): the stored token count at every piece end of each whole text; :meth:`PrefixCounter.at` has those between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = counter(path).prefixes
        for batch in batches:
            found = [prefixes(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([e for e, _ in found], pa.list_(pa.int64())), pa.array([c for _, c in found], pa.list_(pa.int64()))], names=["id", "ends", "counts"])

    kind = docs.select(F.col(id_col)).dtypes[0][1]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ends array<long>, counts array<long>")


def cut_to_budget(budget: int | Column, ends: str = "ends", counts: str = "counts") -> Column:
    """Characters to keep so that the prefix has at most ``budget`` tokens; a look-up in the index."""
    kept = F.size(F.filter(F.col(counts), lambda c: c <= budget))
    return F.when(kept > 0, F.element_at(F.col(ends), kept)).otherwise(F.lit(0))
