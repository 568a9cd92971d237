"""Licence statements by a trained paragraph classifier.

Word uni- and bigrams of short windows of each line and paragraph feed a sparse logistic
regression over licence families and an unknown class.  It is trained in numpy
on varied copies of the templates and on a bounded sample of corpus lines;
temperature and threshold are set on held-out copies and lines, so that
probabilities are calibrated and all but a thousandth of other lines are unknown.
A prediction counts once a template of its family is found in the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, word_bounds, word_hashes

#: Customary wording of licence statements by family.
TEMPLATES = {
    "agpl": ("licensed under the GNU Affero General Public License", "under the terms of the GNU Affero General Public License"),
    "apache": ("licensed under the Apache License", "Apache License Version 2.0", "you may not use this file except in compliance with the License"),
    "bsd": ("released under the BSD License", "licensed under the BSD 3-Clause License", "redistribution and use in source and binary forms with or without modification are permitted"),
    "cc-by": ("licensed under CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "cc-by-nc": ("licensed under CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc-by-nd": ("licensed under CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "cc-by-sa": ("licensed under CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc0": ("CC0 1.0 Universal public domain dedication", "released under CC0 1.0"),
    "gpl": ("licensed under the GNU General Public License", "under the terms of the GNU General Public License", "released under the GPL version 3"),
    "isc": ("released under the ISC License", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    "lgpl": ("licensed under the GNU Lesser General Public License", "under the terms of the GNU Lesser General Public License"),
    "mit": ("released under the MIT License", "licensed under the MIT License", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    "mpl": ("Mozilla Public License Version 2.0", "subject to the terms of the Mozilla Public License"),
    "proprietary": ("all rights reserved", "proprietary and confidential"),
    "unlicense": ("this is free and unencumbered software released into the public domain", "released under the Unlicense"),
}
FAMILIES = sorted(TEMPLATES)
FEATURES, WINDOW, STEP = 1 << 17, 32, 16
#: Everything in ASCII that is no letter or digit parts words, except the line feed.
_PARTS = bytes(i if i > 127 or chr(i).isalnum() or i == 10 else 32 for i in range(256))
_VERSION = frozenset("0123456789")


def _hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and the line each word is in."""
    data = text.encode().translate(_PARTS)
    start, _ = word_bounds(data)
    return word_hashes(data), np.searchsorted(np.flatnonzero(np.frombuffer(data, np.uint8) == 10), start)


def _features(words: np.ndarray, line: np.ndarray) -> np.ndarray:
    """For each word its unigram and the bigram it ends, which is that of the line's start for the first."""
    before = np.zeros(len(words), np.uint64)
    if len(words) > 1:
        before[1:] = np.where(line[1:] == line[:-1], words[:-1], 0)
    pair = mix(words ^ (before * np.uint64(0x9E3779B97F4A7C15)))
    return np.stack([words % np.uint64(FEATURES // 2), pair % np.uint64(FEATURES // 2) + np.uint64(FEATURES // 2)], axis=1).astype(np.int64)


def _words(template: str) -> list[int]:
    return [int(x) for x in _hashes(template)[0]]


class Classifier:
    """Weights, temperature and threshold; the last class is unknown."""

    def __init__(self, weights: np.ndarray, temperature: float, threshold: float):
        self.weights, self.temperature, self.threshold = weights.astype(np.float32), temperature, threshold
        self.templates = [[_words(t) for t in TEMPLATES[f]] for f in FAMILIES]

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = np.exp((logits - logits.max(axis=1, keepdims=True)) / self.temperature)
        return z / z.sum(axis=1, keepdims=True)

    def found(self, family: int, words: np.ndarray) -> Iterator[tuple[int, float, int, int]]:
        """(words that agree in order, their share of the template, start, end) of each place where a template starts and goes on as it stands."""
        own = [int(x) for x in words]
        for template in self.templates[family]:
            k, width = len(template), len(template) + 3
            for at in (i for i, w in enumerate(own) if w in template[:2]):
                row, end = [0] * (k + 1), at
                for n, w in enumerate(own[at:at + width], at + 1):
                    new = row[:]
                    for j in range(k):
                        new[j + 1] = row[j] + 1 if w == template[j] else max(row[j + 1], new[j])
                    end = n if new[k] > row[k] else end
                    row = new
                yield row[k], row[k] / k, at, end

    def confirm(self, family: int, words: np.ndarray) -> float:
        """Share of a template's words that the window holds in order, of the best template that starts and goes on as it stands."""
        return max((alike for _, alike, _, _ in self.found(family, words)), default=0.0)

    def _among(self, words: np.ndarray, part: np.ndarray, least: float) -> Iterator[tuple[int, float, int, int, int, float]]:
        """(words that agree, probability, start, end, family, similarity) of statements in windows that stay in one ``part``."""
        total = np.zeros((len(words) + 1, len(FAMILIES) + 1))
        ids = _features(words, part)
        np.cumsum(self.weights[ids[:, 0]] + self.weights[ids[:, 1]], axis=0, out=total[1:])
        first = np.flatnonzero(np.diff(part, prepend=-1))
        n = np.diff(first, append=len(words))
        steps = np.maximum(1, -(-(n - WINDOW) // STEP) + 1)
        at = np.repeat(first, steps) + STEP * (np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps))
        stop = np.repeat(first + n, steps)
        to = np.minimum(at + WINDOW, stop)
        p = self.against_unknown(total[to] - total[at] + self.weights[-1])
        for i, family in np.argwhere(p >= self.threshold):
            # A statement that starts in the window may end after it.
            for agree, alike, start, end in self.found(family, words[at[i]:min(to[i] + STEP, stop[i])]):
                if alike >= least:
                    yield agree, float(p[i, family]), int(at[i]) + start, int(at[i]) + end, int(family), alike

    def against_unknown(self, logits: np.ndarray) -> np.ndarray:
        """Probability of each family against the unknown class, never less than among all, so that one family does not hide another."""
        return 1 / (1 + np.exp(np.clip((logits[:, -1:] - logits[:, :-1]) / self.temperature, -700, 700)))

    def scan(self, text: str, least: float) -> list[tuple[int, str, float, float]]:
        """(line, family, probability, similarity) of each line and family of which a confirmed statement starts there.

        Windows stay in a line, and again in a paragraph.  Of statements that overlap the one that agrees in more words counts.
        """
        words, line = _hashes(text)
        if not len(words):
            return []
        hits = set(self._among(words, line, least))
        paragraph = np.cumsum(np.diff(line, prepend=line[0]) > 1)
        if paragraph[-1] < np.count_nonzero(np.diff(line)):
            hits |= set(self._among(words, paragraph, least))
        out: dict[tuple[int, int], tuple[float, float]] = {}
        taken = np.zeros(len(words), bool)
        for _, p, start, end, family, alike in sorted(hits, key=lambda x: (-x[0], -x[1], *x[2:])):
            if not taken[start:end].any():
                taken[start:end] = True
                key = (int(line[start]), family)
                out[key] = max(out.get(key, (0.0, 0.0)), (p, alike))
        return [(k, FAMILIES[f], *out[k, f]) for k, f in sorted(out)]


def _varied(rng: np.random.Generator, noise: list[str], copies: int) -> list[tuple[str, int]]:
    """Copies of templates: numbers changed, words dropped or put around."""
    out = []
    for f, family in enumerate(FAMILIES):
        for template in TEMPLATES[family]:
            for _ in range(copies):
                words = template.replace(".", " ").split()
                words = [str(rng.integers(1, 5)) if w in _VERSION else w for w in words]
                if len(words) > 6:
                    words = [w for w in words if rng.random() > 0.04]
                around = [noise[i].split() for i in rng.integers(0, len(noise), 2)] if noise and rng.random() < 0.5 else [[], []]
                out.append((" ".join([*around[0][: rng.integers(0, 9)], *words, *around[1][: rng.integers(0, 9)]]), f))
    return out


def train(lines: list[str], copies: int = 40, epochs: int = 6, rate: float = 0.1, seed: int = 3) -> Classifier:
    """A classifier fitted to the templates and to ``lines`` of the corpus, which count as unknown unless a template is in them."""
    rng = np.random.default_rng(seed)
    probe = Classifier(np.zeros((FEATURES + 1, len(FAMILIES) + 1)), 1.0, 0.0)
    noise = [x for x in lines if all(probe.confirm(f, _hashes(x)[0]) < 0.7 for f in range(len(FAMILIES)))]
    samples = _varied(rng, noise, copies) + [(x, len(FAMILIES)) for x in noise]
    ids = [_features(*_hashes(x.replace("\n", " "))).ravel() for x, _ in samples]
    ids = [x[: 2 * WINDOW] for x in ids]  # two features a word: a window, as later ones are
    label = np.array([y for _, y in samples])
    held = rng.random(len(samples)) < 0.2
    w = np.zeros((FEATURES + 1, len(FAMILIES) + 1), np.float64)
    square = np.full(FEATURES + 1, 1e-6)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(np.flatnonzero(~held)), max(1, int((~held).sum()) // 32)):
            flat = np.concatenate([np.append(ids[i], FEATURES) for i in part])
            owner = np.repeat(np.arange(len(part)), [len(ids[i]) + 1 for i in part])
            z = np.zeros((len(part), w.shape[1]))
            np.add.at(z, owner, w[flat])
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(len(part)), label[part]] -= 1
            keys, back = np.unique(flat, return_inverse=True)
            g = np.zeros((len(keys), w.shape[1]))
            np.add.at(g, back, z[owner])
            square[keys] += (g**2).sum(axis=1)
            w[keys] -= rate * g / np.sqrt(square[keys])[:, None]
    at = np.flatnonzero(held)
    logits = np.array([w[ids[i]].sum(axis=0) + w[FEATURES] for i in at]).reshape(-1, w.shape[1])

    def loss(t):
        p = Classifier(w[:1], t, 0).probabilities(logits)
        return -np.log(np.maximum(p[np.arange(len(at)), label[at]], 1e-12)).mean()

    temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0), key=loss) if len(at) else 1.0
    p = Classifier(w[:1], temperature, 0).probabilities(logits)[label[at] == len(FAMILIES), :-1] if len(at) else np.zeros((0, 1))
    threshold = max(0.5, float(np.quantile(p.max(axis=1), 0.999))) if len(p) else 0.5
    return Classifier(w, temperature, threshold)


def _scan(classifier: Classifier, least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *hit) for i, text in zip(pdf["doc_id"], pdf["text"], strict=True) if text for hit in classifier.scan(text, least)]
            yield pd.DataFrame(rows, columns=["doc_id", "line", "family", "probability", "similarity"])
    return run


def scan(docs: DataFrame, fit_lines: int = 4000, least: float = 0.85, fit_chars: int = 400) -> DataFrame:
    """doc_id, line, family, probability, similarity: one row per line and family of which a licence statement starts there.

    Statements may go on over line feeds, up to a blank line.  Lines are counted from 0.  ``fit_lines`` bounds the corpus lines, taken by a
    hash, that train the unknown class, and ``fit_chars`` the characters taken from each, from a place given by the hash; every line of every text is classified
    as a whole.
    Null and empty texts have none.  Rows without doc_id, and repeated rows,
    are scanned like others.  Further columns are ignored; an empty table gives none.
    """
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") > 0)
    total = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 1
    draw = F.xxhash64("line")
    # About twice the bound pass, so that no more than that reaches the driver from all tasks.
    few = F.pmod(draw, F.lit(1 << 30)) < int(min(1.0, 2 * fit_lines / total) * (1 << 30))
    at = (F.pmod(F.xxhash64(draw), F.greatest(F.length("line") - fit_chars + 1, F.lit(1))) + 1).cast("int")
    sample = [r[0] for r in lines.where(few).select(F.substring("line", at, F.lit(fit_chars)).alias("line"), draw.alias("h")).orderBy("h").limit(fit_lines).select("line").collect()]
    # Ids travel as text, as pandas would turn those of a batch with a null into floats.
    rows = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(_scan(train(sorted(sample)), least), "doc_id string, line long, family string, probability double, similarity double")
    return rows.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
