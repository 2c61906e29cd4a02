"""Language identification by segmentation-marginalised unigrams.

Each language has a unigram distribution over the pieces of a fixed public
vocabulary. The probability of a word is the sum over all its segmentations
into pieces, which the forward algorithm gives in one pass; pieces do not
cross words, so a text's log-likelihood is the sum over its words. The
distributions are fitted by expectation-maximisation (forward-backward) on
word counts of a bounded sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+")
FLOOR, LETTERS = 1e-7, 1 << 18
_BASE = np.uint64(1099511628211)


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model that are letters only, of any length, in lower case and without word marks.

    Other pieces cannot be part of a word, which is a run of letters.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).replace("▁", "").lower() for i in range(model.get_piece_size())}
    return sorted(p for p in found if p.isalpha())


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points (words x longest) and lengths."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = np.zeros((len(words), int(n.max(initial=1))), np.uint64)
    out[np.arange(out.shape[1]) < n[:, None]] = flat
    return out, n


class _Keys:
    """A set of 64-bit hashes with numbers; a bitmap answers for most of those that are not in it."""

    def __init__(self, keys: np.ndarray, numbers: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.numbers = keys[order], numbers[order]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self._slot(keys)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it is not in the set."""
        out = np.full(len(keys), -1, np.int64)
        maybe = np.flatnonzero(self.bits[self._slot(keys)])
        at = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == keys[maybe]
        out[maybe[hit]] = self.numbers[at[hit]]
        return out


@dataclass
class Arcs:
    """Uses of pieces in a batch of words: word, end, size and piece of each."""

    row: np.ndarray
    end: np.ndarray
    size: np.ndarray
    piece: np.ndarray

    def groups(self, by: np.ndarray):
        """Index arrays of the arcs with one value of ``by`` and one size, in rising order; no word occurs twice in one."""
        key = by * 64 + np.minimum(self.size, 63)
        order = np.argsort(key, kind="stable")
        if not len(order):
            return []
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        return np.split(order, cuts)


@dataclass
class Model:
    """``probs``: piece x language; the last row is for letters that no piece covers."""

    langs: list[str]
    pieces: list[str]
    probs: np.ndarray

    def __post_init__(self):
        self.longest = max(map(len, self.pieces), default=1)
        self._tables: dict[int, _Keys] = {}
        self._longer: dict[int, _Keys] = {}
        for size in range(1, self.longest + 1):
            own = [i for i, p in enumerate(self.pieces) if len(p) == size]
            if own:
                self._tables[size] = _Keys(self._hash([self.pieces[i] for i in own]), np.array(own))
            heads = sorted({p[:size] for p in self.pieces if len(p) > size})
            if heads:
                self._longer[size] = _Keys(self._hash(heads), np.arange(len(heads)))

    @staticmethod
    def _hash(same_size: list[str]) -> np.ndarray:
        codes = _codes(same_size)[0]
        key = np.zeros(codes.shape[0], np.uint64)
        with np.errstate(over="ignore"):
            for i in range(codes.shape[1]):
                key = key * _BASE + codes[:, i] + np.uint64(1)
        return key

    def arcs(self, codes: np.ndarray, n: np.ndarray) -> Arcs:
        """All places of pieces; a letter without a piece of its own is the piece after the last."""
        width = codes.shape[1]
        flat = codes.ravel()
        row, start = np.nonzero(np.arange(width) < n[:, None])
        at, left = row * width + start, n[row] - start
        key = np.zeros(len(row), np.uint64)
        found = []
        for size in range(1, self.longest + 1):
            if size > 1:
                keep = left >= size
                row, start, at, left, key = row[keep], start[keep], at[keep], left[keep], key[keep]
            if not len(row):
                break
            with np.errstate(over="ignore"):
                key = key * _BASE + flat[at + size - 1] + np.uint64(1)
            piece = self._tables[size].find(key) if size in self._tables else np.full(len(row), -1, np.int64)
            if size == 1:
                piece[piece < 0] = len(self.pieces)
            hit = np.flatnonzero(piece >= 0)
            found.append((row[hit], start[hit] + size, np.full(len(hit), size), piece[hit]))
            if size not in self._longer:
                break
            keep = self._longer[size].find(key) >= 0
            row, start, at, left, key = row[keep], start[keep], at[keep], left[keep], key[keep]
        return Arcs(*(np.concatenate(c) if found else np.array([], np.int64) for c in (zip(*found) if found else ((),) * 4)))

    def _forward(self, codes: np.ndarray, n: np.ndarray, head: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log-likelihoods, last sums, log scale) of words by length; ``head`` has the sums at the first positions.

        Sums over all segmentations are kept in range by a scale for each word and language.
        """
        known = head.shape[1] - 1
        rows, width = codes.shape
        alpha = np.zeros((rows, width + 1, len(self.langs)))
        alpha[:, : known + 1] = head
        out = np.zeros((rows, len(self.langs)))
        arcs = self.arcs(codes, n)
        sums, last = {}, known
        for group in arcs.groups(arcs.end):
            sums.setdefault(int(arcs.end[group[0]]), []).append(group)
        for end in range(known + 1, width + 1):
            for g in sums.get(end, ()):
                r = arcs.row[g]
                alpha[r, end] += alpha[r, end - arcs.size[g[0]]] * self.probs[arcs.piece[g]]
            done = slice(np.searchsorted(n, end, "left"), np.searchsorted(n, end, "right"))
            if done.start < done.stop:
                out[done] = np.log(alpha[done, end]) + scale[done]
            if end - last >= 16:
                open_ = slice(done.stop, rows)
                lo = max(0, end - self.longest)
                factor = alpha[open_, lo : end + 1].max(1)
                alpha[open_, lo : end + 1] /= factor[:, None]
                scale[open_] += np.log(factor)
                last = end
        return out, alpha[:, max(0, width - self.longest) :], scale

    def log_likelihoods(self, words: list[str]) -> np.ndarray:
        """word x language: the log of the sum over all segmentations of each whole word."""
        out = np.zeros((len(words), len(self.langs)))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order, at = np.argsort(lengths, kind="stable"), 0
        room = max(1, LETTERS // max(1, len(self.langs)))
        one = np.ones((1, 1, len(self.langs)))
        while at < len(order):
            take = 1
            while at + take < len(order) and take < 8192 and (take + 1) * lengths[order[at + take]] <= room:
                take += 1
            chosen = order[at : at + take]
            at += take
            if take > 1 or lengths[chosen[0]] <= room:
                codes, n = _codes([words[i] for i in chosen])
                out[chosen] = self._forward(codes, n, np.repeat(one, len(n), 0), np.zeros((len(n), len(self.langs))))[0]
                continue
            word, head, scale, lo = words[chosen[0]], one, np.zeros((1, len(self.langs))), 0
            while lo < len(word):  # a very long word in windows that take over the sums before them
                hi, back = min(len(word), lo + room), head.shape[1] - 1
                codes, n = _codes([word[lo - back : hi]])
                out[chosen], head, scale = self._forward(codes, n, head, scale)
                lo = hi
        return out


def _expectation(model: Model, words: list[str], weights: np.ndarray, column: int) -> np.ndarray:
    """Expected uses of each piece over the words of one language, by forward and backward sums of logarithms."""
    with np.errstate(divide="ignore"):
        logs = np.log(model.probs[:, column])
    total = np.zeros(len(logs))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order, at = np.argsort(lengths, kind="stable"), 0
    while at < len(order):
        take = 1
        while at + take < len(order) and take < 8192 and (take + 1) * lengths[order[at + take]] <= LETTERS:
            take += 1
        chosen = order[at : at + take]
        at += take
        codes, n = _codes([words[i] for i in chosen])
        arcs = model.arcs(codes, n)
        rows, width = codes.shape
        alpha, beta = np.full((rows, width + 1), -np.inf), np.full((rows, width + 1), -np.inf)
        alpha[:, 0] = 0
        beta[np.arange(rows), n] = 0
        begin = arcs.end - arcs.size
        with np.errstate(invalid="ignore"):
            for g in arcs.groups(arcs.end):
                r, e = arcs.row[g], arcs.end[g[0]]
                alpha[r, e] = np.logaddexp(alpha[r, e], alpha[r, e - arcs.size[g[0]]] + logs[arcs.piece[g]])
            for g in reversed(arcs.groups(begin)):
                r, b = arcs.row[g], begin[g[0]]
                beta[r, b] = np.logaddexp(beta[r, b], beta[r, b + arcs.size[g[0]]] + logs[arcs.piece[g]])
            share = np.exp(alpha[arcs.row, begin] + logs[arcs.piece] + beta[arcs.row, arcs.end] - beta[arcs.row, 0])
        total += np.bincount(arcs.piece, share * weights[chosen][arcs.row], len(logs))
    return total


def fit(docs: DataFrame, path: str, rows_per_language: int = 400, rounds: int = 3, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id") -> Model:
    """Fit on about ``rows_per_language`` labelled rows of each language, chosen by a hash of the key.

    Rows with null text or language are left out. All words of the chosen rows
    count; their numbers reach the driver once, for all languages together. Without any labelled row the
    model has no language.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(key_col).cast("string").alias("key"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs, pieces = sorted(sizes), vocabulary(path)
    probs = np.full((len(pieces) + 1, max(1, len(langs))), 1.0 / (len(pieces) + 1))
    model = Model(langs, pieces, probs)
    if not langs:
        return model
    chance = F.element_at(F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, rows_per_language / sizes[lang]))]), F.col("lang"))
    # rows without a key are drawn by their text
    draw = F.pmod(F.xxhash64(F.coalesce("key", "text"), F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    words = known.filter(draw < chance).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0)).alias("word"))
    counts = words.groupBy("lang", "word").agg(F.count("*").alias("n")).toPandas().sort_values(["lang", "word"], kind="stable")
    for lang, own in counts.groupby("lang", sort=True):
        i = langs.index(lang)
        plain = own[own.word.str.isalpha()]
        for _ in range(rounds):
            used = _expectation(model, plain.word.tolist(), plain.n.to_numpy(float), i)
            model.probs[:, i] = (used + 0.01) / (used + 0.01).sum()
    model.probs = np.maximum(model.probs, FLOOR)
    return model


class _Scorer(dict):
    """Memo word -> row of log-likelihoods; row 0 is for what has no letter."""

    def __init__(self, model: Model, rows: int = 400_000):
        super().__init__()
        self.model, self.room = model, max(10_000, min(rows, (48 << 20) // (8 * max(1, len(model.langs)))))
        self.table = np.zeros((self.room, len(model.langs)))
        self.n = 1

    def learn(self, words: set[str]) -> None:
        new = sorted(words.difference(self))
        if not new:
            return
        if self.n + len(new) > self.room:
            self.clear()
            self.n, new = 1, sorted(words)
        if self.n + len(new) > len(self.table):
            self.table = np.zeros((self.n + len(new), len(self.model.langs)))
        plain = [w for w in new if w.isalpha()]
        self.table[self.n : self.n + len(plain)] = self.model.log_likelihoods(plain)
        self.update(zip(plain, range(self.n, self.n + len(plain))))
        self.n += len(plain)
        for w in set(new).difference(plain):  # with other numerals: by its letters
            letters = "".join(filter(str.isalpha, w))
            self[w] = 0
            if letters:
                self.table[self.n] = self.model.log_likelihoods([letters])[0]
                self[w], self.n = self.n, self.n + 1

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        found = [WORD.findall(t.lower()) if t else [] for t in texts]
        self.learn(set().union(*found))
        out = []
        for words in found:
            rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
            if not self.model.langs or not rows.any():
                out.append(("und", 0.0))
                continue
            total = self.table[rows].sum(0)
            odds = np.exp(total - total.max())
            best = int(odds.argmax())
            out.append((self.model.langs[best], float(odds[best] / odds.sum())))
        return out


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every whole text.

    ``score`` is the posterior under equal priors. Null texts, texts without a
    letter, and all texts under a model without languages are ``und`` with
    score 0; ties go to the smaller language. Repeated rows are scored one by
    one, null ids stay, an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # pieces x languages, bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(held.value)
        for batch in batches:
            part, size, found = [], 0, []
            for t in batch.column(1):
                part.append(t.as_py())
                size += len(part[-1] or "")
                if size > 1 << 20:
                    found += scorer.score(part)
                    part, size = [], 0
            found += scorer.score(part) if part else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], names=["id", "lang_pred", "score"])

    kind = docs.select(F.col(id_col)).dtypes[0][1]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns kept, whose text is identified with a posterior of ``least`` or more.

    Rows are judged in place, one by one, so nothing is shuffled and repeated
    rows stay repeated.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(held.value)
        for batch in batches:
            part, size, keep = [], 0, []
            for t in batch.column(at):
                part.append(t.as_py())
                size += len(part[-1] or "")
                if size > 1 << 20:
                    keep += [a != "und" and b >= least for a, b in scorer.score(part)]
                    part, size = [], 0
            keep += [a != "und" and b >= least for a, b in scorer.score(part)] if part else []
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
