"""Language identification by a byte convolutional network, trained here in numpy.

Bytes are embedded, filters of several widths slide over a window, each keeps
its greatest response, and a softmax layer names the language.  Training starts
from weights fitted to a few rows and then goes over every window of every
labelled row once: tasks sum up gradients, and each of several disjoint parts of
the rows makes a step.  Prediction cuts every whole text into windows and averages their
probabilities by length.  A last class, none of the languages, is learned from
junk and from made-up languages, and the score below which a text is rejected
is set on all held-out labelled rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, DIM, WIDTHS, FILTERS = 192, 8, (2, 3, 4), 12
#: Parts into which all labelled rows are dealt for training: each is a step.
STEPS = 8
#: Of so many windows one has a counterpart in no language made of it, which counts for half as many.
NONE_OF = 64
#: Labelled rows that a language teaches on average, where there are so many languages that ``fit_rows`` holds fewer.
LEAST_ROWS = 10
_SPAN = max(WIDTHS)
#: Zeroes the taps that narrower filters lack.
_TAPS = np.concatenate([np.repeat((np.arange(_SPAN) < w).astype(np.float32), DIM)[:, None].repeat(FILTERS, 1) for w in WIDTHS], axis=1)


class ByteNet:
    """Weights of the network; classes are the language codes in order, followed by one output for none of them.

    A text whose score is under ``least`` looks like no language that was learned.
    """

    def __init__(self, classes: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.classes, self.least = classes, 0.25
        k, f = _TAPS.shape
        self.w = {"e": rng.normal(0, 0.5, (256, DIM)), "c": rng.normal(0, 1 / np.sqrt(k), (k, f)) * _TAPS, "b": np.zeros(f), "o": rng.normal(0, 0.1, (f, len(classes) + 1)), "p": np.zeros(len(classes) + 1)}
        self.w = {n: x.astype(np.float32) for n, x in self.w.items()}
        self.m, self.v = ({n: np.zeros_like(a) for n, a in self.w.items()} for _ in range(2))
        self.steps = 0

    def _patches(self, x: np.ndarray) -> np.ndarray:
        e = self.w["e"][x]
        return np.concatenate([e[:, i:x.shape[1] - _SPAN + 1 + i] for i in range(_SPAN)], axis=2)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """A row of probabilities for each window of bytes."""
        patches = self._patches(x)
        top = (patches.reshape(-1, patches.shape[2]) @ self.w["c"]).reshape(len(x), -1, _TAPS.shape[1]).max(axis=1)
        return _softmax(np.maximum(top + self.w["b"], 0) @ self.w["o"] + self.w["p"])

    def gradients(self, xs: np.ndarray, ys: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the cross-entropy, summed over windows by ``weight``; only the patch of each greatest response carries one."""
        patches = self._patches(xs)
        r = (patches.reshape(-1, patches.shape[2]) @ self.w["c"]).reshape(len(xs), -1, _TAPS.shape[1])
        where = r.argmax(axis=1)
        hidden = np.take_along_axis(r, where[:, None], 1)[:, 0] + self.w["b"]
        act = np.maximum(hidden, 0)
        d = _softmax(act @ self.w["o"] + self.w["p"])
        d[np.arange(len(ys)), ys] -= 1
        d *= weight[:, None].astype(np.float32)
        dh = (d @ self.w["o"].T) * (hidden > 0)
        best = patches[np.arange(len(xs))[:, None], where]
        g = {"o": act.T @ d, "p": d.sum(0), "b": dh.sum(0), "c": np.einsum("nf,nfk->kf", dh, best) * _TAPS}
        back = (dh[:, :, None] * self.w["c"].T[None]).reshape(-1, DIM)
        rows = xs[np.arange(len(xs))[:, None, None], where[:, :, None] + np.arange(_SPAN)].ravel()
        g["e"] = np.stack([np.bincount(rows, back[:, i], 256) for i in range(DIM)], axis=1)
        return g

    def unpacked(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """The arrays that were joined in the order of the weights."""
        ends = np.cumsum([a.size for a in self.w.values()])
        return {n: x.reshape(a.shape) for (n, a), x in zip(self.w.items(), np.split(flat, ends[:-1]), strict=True)}

    def step(self, g: dict[str, np.ndarray], rate: float) -> None:
        """One of Adam, along mean gradients."""
        self.steps += 1
        for n, a in g.items():
            self.m[n] = 0.9 * self.m[n] + 0.1 * a
            self.v[n] = 0.999 * self.v[n] + 0.001 * a * a
            self.w[n] -= (rate * (self.m[n] / (1 - 0.9**self.steps)) / (np.sqrt(self.v[n] / (1 - 0.999**self.steps)) + 1e-8)).astype(np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 6) -> ByteNet:
        """Steps over small batches of windows held here."""
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                now = order[at:at + batch]
                self.step(self.gradients(x[now], y[now], np.full(len(now), 1 / len(now))), rate)
        return self


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _windows(data: bytes) -> np.ndarray:
    """The whole text as rows of ``WINDOW`` bytes, the last filled up with zeros."""
    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


#: First letters of scripts, and how many follow.
_SCRIPTS = ((0x41, 26), (0x61, 26), (0xE0, 30), (0x100, 100), (0x3B1, 25), (0x430, 32), (0x5D0, 27), (0x627, 36), (0x905, 50), (0xE01, 46), (0x10D0, 33), (0x3041, 83), (0x4E00, 3000), (0xAC00, 3000))


def _made_up(rng: np.random.Generator) -> bytes:
    """A window in a language that is made up here: words of a few syllables over few letters of one script."""
    first, n = _SCRIPTS[rng.integers(len(_SCRIPTS))] if rng.random() < 0.5 else (0x61, 26)
    letters = [chr(first + i) for i in rng.permutation(n)[: rng.integers(8, 27)]]
    if first == 0x61 and rng.random() < 0.5:
        letters += [chr(i) for i in rng.integers(0xE0, 0x17F, 4)]
    vowels = letters[: len(letters) // 3]
    parts = ["".join((*rng.choice(letters, rng.integers(0, 3)), rng.choice(vowels), *rng.choice(letters, rng.integers(0, 2)))) for _ in range(rng.integers(10, 80))]
    words = ["".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(40)]
    return " ".join(words).encode()[:WINDOW].ljust(WINDOW, b"\0")


def _none_of_them(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """As many windows that are in no language: shuffled bytes, letters swapped for others, random characters, made-up languages."""
    out = x.copy()
    for row, kind in zip(out, rng.integers(0, 4, len(out)), strict=True):
        n = int((row != 0).sum())
        if kind == 0:
            row[:n] = rng.permutation(row[:n])
        elif kind == 1:
            turn, other = np.arange(256), rng.permutation(26)
            turn[97:123], turn[65:91] = 97 + other, 65 + other
            turn[128:192] = 128 + rng.permutation(64)
            row[:n] = turn[row[:n]]
        elif kind == 2:
            row[:n] = rng.integers(33, 127 if rng.random() < 0.7 else 256, n)
            row[:n][rng.random(n) < rng.uniform(0, 0.25)] = 32
        else:
            row[:] = np.frombuffer(_made_up(rng), np.uint8)
            row[n:] = 0
    return out


def _ended(x: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Copies that end after ``length`` bytes."""
    out = x.copy()
    out[np.arange(WINDOW) >= length[:, None]] = 0
    return out


def _shortened(x: np.ndarray, rng: np.random.Generator, share: float = 0.25) -> np.ndarray:
    """Copies of which a share ends early, as short texts do."""
    return _ended(x, np.where(rng.random(len(x)) < share, rng.integers(12, WINDOW, len(x)), WINDOW))


def _spread(each: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, lang in zip(pdf["text"], pdf["lang"], strict=True):
                rows = _windows(text.encode())
                picked = np.unique(np.linspace(0, len(rows) - 1, each).astype(int))
                out += [(lang, rows[i].tobytes()) for i in picked]
            yield pd.DataFrame(out, columns=["lang", "window"])
    return run


def _drawn(rows: DataFrame, counts: dict[str, int], fit_rows: int) -> DataFrame:
    """About ``fit_rows`` of the labelled rows, by a hash of the text, shared alike among languages."""
    share = fit_rows / len(counts)
    chance = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, share / n))])
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / float(1 << 20)
    return rows.where(draw < F.element_at(chance, F.col("lang"))).select("text", "lang")


def _turned(x: np.ndarray, y: np.ndarray, weight: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows, classes and weights as they teach: a quarter ends early, and one of ``NONE_OF`` has a counterpart in no language made of it.

    What becomes of a window follows from its bytes, wherever it is read.
    """
    code = np.array([zlib.crc32(row) for row in x], np.int64)
    x = _ended(x, np.where(code % 4 == 0, 12 + code // 4 % (WINDOW - 12), WINDOW))
    at = np.flatnonzero(code // 1024 % NONE_OF == 0)
    junk = [_none_of_them(x[i:i + 1], np.random.default_rng(code[i])) for i in at]
    return np.concatenate([x, *junk]), np.concatenate([y, np.full(len(at), none)]), np.concatenate([weight, weight[at] * (NONE_OF / 2)])


def _summed(net: ByteNet, share: dict[str, float], size: int = 256):
    """The gradients of a task's rows over all windows of their texts, and their weight, as one array of integers; ``share``: what a window of a language weighs."""
    number = {c: i for i, c in enumerate(net.classes)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, part, held = np.zeros(1 + sum(a.size for a in net.w.values())), [], 0

        def flush():
            x = np.concatenate([w for w, _ in part])
            own = np.concatenate([np.full(len(w), number[c]) for w, c in part])
            weigh = np.concatenate([np.full(len(w), share[c]) for w, c in part])
            xs, ys, weigh = _turned(x, own, weigh, len(net.classes))
            g = net.gradients(xs, ys, weigh)
            total[:] += np.concatenate([[weigh.sum()], *[g[n].ravel() for n in net.w]])
            part.clear()

        for pdf in batches:
            for text, lang in zip(pdf["text"], pdf["lang"], strict=True):
                rows = _windows(text.encode())
                for at in range(0, len(rows), size):
                    part.append((rows[at:at + size], lang))
                    held += len(part[-1][0])
                    if held >= size:
                        flush()
                        held = 0
        if part:
            flush()
        yield pd.DataFrame({"g": [np.rint(total * 2.0**40).astype(np.int64)]})
    return run


def train(docs: DataFrame, fit_rows: int = 3000, each: int = 4, rate: float = 0.01) -> ByteNet:
    """A network fitted to all rows (doc_id, text, lang) that teach, each language weighing the same.

    Rows without text, letters or lang, and those whose crc32(doc_id as text)
    mod 3 is 1 or unknown, teach nothing.  All languages are learned, however many.
    First weights come from ``each`` windows of about ``fit_rows`` rows; then every window of every row
    is gone over once, in ``STEPS`` parts by a hash of the id.  What reaches the driver has the size of the network.
    """
    rows = docs.where("lang is not null and crc32(cast(doc_id as string)) % 3 <> 1").where(F.col("text").rlike(r"\p{L}"))
    found = rows.groupBy("lang").agg(F.count("*").alias("rows"), F.sum(F.ceil(F.octet_length("text") / WINDOW)).alias("windows")).collect()
    if not found:
        return ByteNet([])
    counts = {r["lang"]: r["rows"] for r in found}
    net = _start(rows, counts, max(fit_rows, LEAST_ROWS * len(counts)), each)
    # All weights together are about 1, so that sums of integers are exact in any order.
    share = {r["lang"]: 1 / (len(counts) * int(r["windows"])) for r in found}
    for k in range(STEPS):
        part = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(STEPS)) == k).select("text", "lang")
        sums = part.mapInPandas(_summed(net, share), "g array<long>").select(F.posexplode("g")).groupBy("pos").agg(F.sum("col").alias("g")).orderBy("pos")
        g = np.array([r["g"] for r in sums.collect()], float)
        if len(g) and g[0]:
            net.step(net.unpacked(g[1:] / g[0]), rate)
    return net


def _start(rows: DataFrame, counts: dict[str, int], fit_rows: int, each: int) -> ByteNet:
    """First weights, from about ``fit_rows`` rows shared alike among languages."""
    picked = _drawn(rows, counts, fit_rows)
    sample = picked.mapInPandas(_spread(each), "lang string, window binary").orderBy(F.xxhash64("window")).limit(2 * fit_rows * each).toPandas()
    classes = sorted(counts)
    x = np.frombuffer(b"".join(sample["window"]), np.uint8).reshape(-1, WINDOW)
    y = sample["lang"].map({c: i for i, c in enumerate(classes)}).to_numpy()
    rng = np.random.default_rng(7)
    x = _shortened(x, rng)
    none = _none_of_them(x[rng.random(len(x)) < 0.5], rng)
    return ByteNet(classes).fit(np.concatenate([x, none]), np.concatenate([y, np.full(len(none), len(classes))]))


def calibrate(docs: DataFrame, net: ByteNet, lost: float = 0.001) -> ByteNet:
    """Sets ``net.least`` to half of the score that all but a share ``lost`` of all held-out labelled rows reach.

    As one output stands for none of the languages, scores are not bound from
    below by the number of languages: texts of none score near 0.  Fewer than
    1 / ``lost`` held-out rows cannot tell that share, and lower it in proportion.
    The quantile is exact; scores have six digits, so there are a million different ones at most.
    """
    held = docs.where("lang is not null and crc32(cast(doc_id as string)) % 3 = 1").where(F.col("text").rlike(r"\p{L}"))
    held = held.where(F.col("lang").isin(net.classes)).select("text")
    scores = predict(held, net).groupBy("_score").agg(F.count("*").alias("n"))
    n, low = scores.agg(F.sum("n"), F.percentile("_score", F.lit(lost), F.col("n"))).first()
    if n:
        net.least = float(np.clip(low / 2 * min(1.0, lost * n), 0.05, 0.5))
    return net


def _predict(net: ByteNet, size: int = 512):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = np.zeros((len(texts), len(net.classes) + 1))
            part, owner, held = [], [], 0

            def flush():
                x = np.concatenate(part)
                weight = (x != 0).sum(axis=1)
                np.add.at(out, np.array(owner), net.probabilities(x) * np.maximum(weight, 1)[:, None])
                part.clear(), owner.clear()

            for i, text in enumerate(texts):
                if not text or not net.classes:
                    continue
                rows = _windows(text.encode())
                for at in range(0, len(rows), size):
                    part.append(rows[at:at + size])
                    owner.extend([i] * len(part[-1]))
                    held += len(part[-1])
                    if held >= size:
                        flush()
                        held = 0
            if part:
                flush()
            total = out.sum(axis=1)
            best = out[:, : max(1, len(net.classes))].argmax(axis=1)
            known = total > 0
            score = np.where(known, out[np.arange(len(out)), best] / np.where(known, total, 1), 0.0)
            names = np.array([*net.classes, "und"], object)
            yield pd.DataFrame({"lang": names[np.where(known, best, len(net.classes))], "score": np.round(np.clip(score, 0, 1), 6)})
    return run


def predict(docs: DataFrame, net: ByteNet, lang: str = "_lang", score: str = "_score") -> DataFrame:
    """``docs`` with the columns ``lang`` and ``score``; und and 0 where text is null or has no letter.

    The language is the likeliest of those learned; its score has six digits, as the last ones depend on how rows are batched.  Texts of none of them have a score under ``net.least``.
    Only text goes through Python; other columns stay as they are, and a ValueError says
    where one has a name that is wanted here.
    """
    if len({c.lower() for c in (*docs.columns, lang, score)}) != len({c.lower() for c in docs.columns}) + 2:
        raise ValueError(f"columns named {lang} or {score} are there already")
    found = F.pandas_udf(_predict(net), "lang string, score double")(F.when(F.col("text").rlike(r"\p{L}"), F.col("text")))
    return docs.withColumns({lang: found["lang"], score: found["score"]})


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per row of ``docs``.

    A row without doc_id is neither learned from nor held out.  Repeated rows
    are predicted each.  Without a labelled row every text is und.  Further
    columns are ignored; an empty table gives none.
    """
    net = train(docs)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return predict(docs.select("doc_id", "text"), net).select("doc_id", held.alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
