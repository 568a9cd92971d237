"""Counting the pieces of a unigram tokenizer without making them.

An Aho-Corasick automaton names every vocabulary piece that ends at each
character; dynamic programming carries the best score of each prefix and how
many pieces it takes.  Ties go to the path found first, which starts earliest,
as in the tokenizer itself.  A character without a piece of its own costs ten
less than the worst piece; it is one piece a byte where the vocabulary has bytes, else
a run of such characters is one unknown piece.

Pieces hold the space mark only in front, so words are independent of one
another and each task counts a distinct word once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Words a task remembers before it starts over.
REMEMBER = 400_000


class Unigram:
    """Counts pieces; ``pieces`` are (text, score), ``lowest`` the worst score of all, ``by_byte``: unknown characters are bytes."""

    def __init__(self, pieces: list[tuple[str, float]], lowest: float, by_byte: bool):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for text, score in pieces:
            self.automaton.add_word(text, (len(text), score))
        self.automaton.make_automaton()
        self.unknown, self.by_byte = lowest - 10.0, by_byte
        texts = [t for t, _ in pieces]
        self.by_word = not any(MARK in t.lstrip(MARK) for t in texts)
        self.by_line = not any("\n" in t for t in texts)
        self.inside, self.start = _Memory(self), _Memory(self, MARK)

    def best(self, text: str) -> int:
        """Pieces of the best path over ``text``; spaces are marks already."""
        n = len(text)
        score, count, open_ = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        ends: list[list] = [[] for _ in range(n)]
        for at, piece in self.automaton.iter(text):
            ends[at].append(piece)
        for at in range(n):
            best, many, single, unknown = None, 0, False, False
            for size, s in sorted(ends[at], reverse=True) if len(ends[at]) > 1 else ends[at]:
                s += score[at + 1 - size]
                if best is None or s > best:
                    best, many = s, count[at + 1 - size] + 1
                single = single or size == 1
            if not single:
                s = self.unknown + score[at]
                if best is None or s > best:
                    best, unknown = s, True
                    many = count[at] + (len(text[at].encode()) if self.by_byte else not open_[at])
            score[at + 1], count[at + 1], open_[at + 1] = best, many, unknown
        return count[n]

    def count(self, text: str) -> int:
        """Pieces of a text as it stands, with a mark put in front."""
        if not text:
            return 0
        if not self.by_word:
            return self.best(MARK + text.replace(" ", MARK))
        if MARK in text:
            text = text.replace(MARK, " ")
        if len(self.start) + len(self.inside) > REMEMBER:
            self.start.clear(), self.inside.clear()
        lines = text.split("\n") if self.by_line and self.by_byte else [text]
        total = len(lines) - 1
        for i, line in enumerate(lines):
            line = line if i else " " + line
            if "  " in line or line.endswith(" "):
                total += sum(self.inside[x] for x in re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", line.replace(" ", MARK)))
                continue
            words = line.split(" ")
            if words[0]:
                total += self.inside[words[0]]
            total += sum(map(self.start.__getitem__, words[1:]))
        return total


class _Memory(dict):
    """Counts of words, found when first asked for."""

    def __init__(self, of: Unigram, front: str = ""):
        self.of, self.front = of, front

    def __missing__(self, word: str) -> int:
        self[word] = n = self.of.best(self.front + word)
        return n


def vocabulary(path: str) -> tuple[list[tuple[str, float]], float, bool]:
    """What ``Unigram`` takes, from a sentencepiece file; control, unknown and byte pieces match no text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    pieces = [(sp.id_to_piece(i), sp.get_score(i)) for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return pieces, min(sp.get_score(i) for i in ids), any(sp.is_byte(i) for i in ids)


def _count(model: tuple):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Unigram(*model)
        for pdf in batches:
            yield pdf[["doc_id"]].assign(n_tokens=[counter.count(t) if t else 0 for t in pdf["text"]])
    return run


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens: one row per row of ``docs``, for the vocabulary and scores in the file at ``path``.

    The file is read on the driver; pieces travel with the tasks.  Null and
    empty texts have none.  Null ids stay null, repeated rows are counted each.  Further columns are ignored; an empty table gives none.
    """
    # Ids travel as text, as pandas would turn those of a batch with a null into floats.
    rows = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(_count(vocabulary(path)), "doc_id string, n_tokens long")
    return rows.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
