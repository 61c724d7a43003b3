"""Token counts of whole texts under a unigram model, by trie-shared dynamic programming.

A text is cut before every space mark and around every line break: no piece
crosses these, so the best segmentation of the text is that of its pre-tokens.
The distinct pre-tokens of a batch form a trie. Its forward scores (the best score
of a prefix, the tokens of that best path, the pieces still open) are computed
once for each shared prefix, by a depth-first walk that keeps the states of one
path; what is stored is the count at each terminal. Words met before in the same
task are looked up. A pre-token of very many characters shares no prefix worth
keeping: it is scored with one state at a time.

The vocabulary is a given file. A piece's score is the logarithm of its share of all
pieces in the corpus, which one pass counts: the file's own segmentation of each
distinct pre-token, times the number of its occurrences.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name


#: The mark that stands for a space in a piece.
SPACE = "▁"
#: Terminal counts that a task keeps; then it starts anew.
KEPT = 1 << 20
#: Characters of a pre-token beyond which no states and no count are kept.
LONG = 256
UNKNOWN_PENALTY = 10.0
#: What stands before a word that begins a line, where pre-tokens are counted.
LINE = "\x01"


@dataclass(frozen=True)
class Pieces:
    """Scores of a vocabulary's ordinary pieces, and that of an unknown character."""

    scores: dict[str, float]
    unknown: float

    @staticmethod
    def of(model: bytes, counts: dict[str, int] | None = None) -> Pieces:
        """The ordinary pieces of a sentencepiece model, scored by the logarithm of their share of ``counts``.

        Half an occurrence is added to each. A line break and an unknown
        character are no pieces here.
        """
        import sentencepiece

        given = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = [i for i in range(given.get_piece_size()) if not (given.is_byte(i) or given.is_control(i) or given.is_unknown(i) or given.is_unused(i))]
        pieces = [given.id_to_piece(i) for i in ids]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece with a space inside would cross pre-tokens")
        pieces = [p for p in pieces if len(p) == 1 or not p.startswith(SPACE * 2)]  # single spaces are pre-tokens of their own
        seen = np.array([(counts or {}).get(p, 0) + 0.5 for p in pieces])
        scores = dict(zip(pieces, np.log(seen / seen.sum()).tolist(), strict=True))
        return Pieces(scores, min(scores.values(), default=0.0) - UNKNOWN_PENALTY)


def piece_counts(docs: DataFrame, model: bytes) -> dict[str, int]:
    """How often each piece of a sentencepiece model occurs in all texts of ``docs``.

    Spark counts the distinct pre-tokens; each is segmented once. The driver
    gets one row per piece of the vocabulary.
    """
    marked = F.replace(F.replace("text", F.lit(SPACE), F.lit(" ")), F.lit("\n"), F.lit(f" {LINE}"))
    words = docs.where("text <> ''").select(F.explode(F.split(marked, " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))

    def segmented(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sentencepiece

        given = sentencepiece.SentencePieceProcessor(model_proto=model)
        total: dict[str, int] = {}
        for b in batches:
            # a word after a line break is segmented behind one, which takes two pieces
            texts = ["\n" + w[1:] if w.startswith(LINE) else w for w in b["word"]]
            for word, pieces, n in zip(texts, given.encode(texts, out_type=str), b["n"], strict=True):
                for p in pieces[2:] if word.startswith("\n") else pieces:
                    total[p] = total.get(p, 0) + n
        yield pd.DataFrame({"piece": list(total), "n": list(total.values())}, columns=["piece", "n"]).astype({"piece": "str", "n": "int64"})

    found = words.mapInPandas(segmented, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return {r["piece"]: r["n"] for r in found.collect()}


def fit(docs: DataFrame, vocabulary: str) -> Pieces:
    """The pieces of a vocabulary file, scored by a pass over all of ``docs``. An empty table scores all alike."""
    with open(vocabulary, "rb") as file:
        model = file.read()
    return Pieces.of(model, piece_counts(docs, model))


class TrieCounter:
    """Counts of pre-tokens; ``mark`` is what precedes each of them (a space mark or nothing)."""

    def __init__(self, pieces: Pieces, mark: str):
        self.counts: dict[str, int] = {}
        self.unknown = pieces.unknown
        self.root: dict = {}
        for piece, score in pieces.scores.items():
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = score
        self.start = (0.0, 0, ())
        for c in mark:
            self.start = self._step(self.start, c)

    def _step(self, state: tuple, c: str) -> tuple:
        """The state after one more character; of equal scores, the longest last piece wins."""
        best, tokens, open_ = state
        top, count, ahead = -np.inf, 0, []
        for node, score, many in (*open_, (self.root, best, tokens)):
            node = node.get(c)
            if node is not None:
                ahead.append((node, score, many))
                own = node.get("")
                if own is not None and score + own > top:
                    top, count = score + own, many + 1
        if "" not in self.root.get(c, ()) and best + self.unknown > top:
            top, count = best + self.unknown, tokens + len(c.encode("utf-8", "replace"))
        return top, count, tuple(ahead)

    def add(self, words: Iterable[str]) -> None:
        """Score new pre-tokens, sorted so that each shared prefix is walked once."""
        if len(self.counts) > KEPT:
            self.counts.clear()
        path, before = [self.start], ""
        for word in sorted(words):
            if len(word) > LONG:
                state = self.start
                for c in word:
                    state = self._step(state, c)
                self.counts[word] = state[1]
                continue
            same = 0
            for a, b in zip(word, before, strict=False):
                if a != b:
                    break
                same += 1
            del path[same + 1 :]
            for c in word[same:]:
                path.append(self._step(path[-1], c))
            self.counts[word], before = path[-1][1], word


class TokenCounter:
    """Counts tokens of texts; holds the tries of words after a space and of line beginnings."""

    def __init__(self, pieces: Pieces):
        self.spaced, self.bare = TrieCounter(pieces, SPACE), TrieCounter(pieces, "")

    @staticmethod
    def cut(text: str) -> tuple[list[str], list[str], int]:
        """(pre-tokens after a space mark, those without one, line breaks); the text starts with a mark."""
        spaced, bare = [], []
        lines = text.replace(SPACE, " ").split("\n")
        for i, line in enumerate(lines):
            words = line.split(" ")
            if i:
                bare.append(words.pop(0))
            spaced += words
        return spaced, bare, len(lines) - 1

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text: 0 for a null or empty one."""
        fresh: tuple[set, set] = (set(), set())
        for text in texts:
            if text:
                for new, words, trie in zip(fresh, self.cut(text), (self.spaced, self.bare), strict=False):
                    new.update(words)
        for new, trie in zip(fresh, (self.spaced, self.bare), strict=True):
            trie.add(new.difference(trie.counts) if len(trie.counts) <= KEPT else new)
        spaced, bare = self.spaced.counts.__getitem__, self.bare.counts.__getitem__
        totals = []
        for text in texts:
            a, b, breaks = self.cut(text) if text else ((), (), 0)
            totals.append(sum(map(spaced, a)) + sum(map(bare, b)) + breaks)
        for new, trie in zip(fresh, (self.spaced, self.bare), strict=True):
            for word in new:
                if len(word) > LONG:
                    del trie.counts[word]
        return totals


def token_count(text: Column, pieces: Pieces) -> Column:
    """Tokens of a text column, LONG."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = TokenCounter(pieces)
        for texts in batches:
            yield pd.Series(counter.count(texts.tolist()), dtype="int64")

    return of(text.cast("string"))


def count_tokens(docs: DataFrame, pieces: Pieces, name: str = "_tokens") -> DataFrame:
    """``docs`` with the tokens of each whole text in the column ``name``.

    Null and empty texts have none. A line break is one token, an unknown
    character as many as its UTF-8 bytes. Repeated rows get equal counts; an
    empty table stays empty. If ``docs`` has a column ``name``, that stays and
    the count's name gets underscores before it.
    """
    return docs.select("*", token_count(F.col("text"), pieces).alias(free_name(docs, name)))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_token_counts(spark, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Tokens and bytes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = count_tokens(docs, fit(docs, vocabulary or default_vocabulary()))
    return found.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("text_bytes"), F.col("_tokens").alias("tokens"))
