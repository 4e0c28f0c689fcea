"""Toxicity: a support vector machine over a gap-weighted subsequence kernel with Nystroem landmarks.

The kernel compares two words by all three-letter subsequences they share, each
weighted by ``DECAY`` to the power of its span in either word; it is scaled to 1 for
equal words. A run of one letter is one letter that counts ``RUNS`` for a single one,
so ``heel`` and ``hell`` differ; marks at both ends keep parts of words apart from words.
It is a sum of products of positive definite parts, and the same in the
rows of a word and in the landmarks' own matrix, whose inverse root maps the rows.

The map of a word is scaled to its strength, a number of the word alone, so the
kernel of the scaled words is positive definite too. The strength grows with how
close the word's closest window is to a landmark, from 0 at ``LEAST``. Windows of
m, m + 1 and 2m + 3 letters and marks are compared with a landmark of m letters, in words of any length
(2m + 3 hold a letter between any two letters, and both marks). How close a window is: what it shares
with the part of the landmark that has as many marks, twice, and the cosine, their cube root.
So ``s.t.u.p.i.d``, ``stuuupid`` and ``sxtxuxpxixd`` are close;
with a letter between all letters and inside a longer word an insult is at the limit. A token loses what is neither
letter nor digit; three or more single letters in a row are one word.

Landmarks are words in ``FOUND`` or more toxic texts of the sample that stand in toxic texts far more often
than in others, no two of them close, and the clean words most frequent among those close to them.
A text is the sum of the maps of its words, its length on a logarithmic scale; a
linear support vector machine on it is one on the kernel. Its margin becomes a
probability by a logistic fit. Every text is scored as a whole.

Landmarks and machine are fitted on at most ``SAMPLE`` labelled texts, half of them
toxic where there are enough, chosen by the hash of their id.

Results for odd input: a null text counts as empty and gets the score of a text
without insults. Without labels, or with labels of one class only, all scores are
the share of toxic labels (0 without any). Several labels of an id count as
toxic if one is; labels without id, or null, are left out. Repeated rows get
equal scores; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfspark.llm.byte_bpe import Memo
from shelfspark.llm.rows import texts
from shelfspark.runtime import cut_lineage

SAMPLE = 6000
CANDIDATES = 600
LANDMARKS = 64
DECAY = 0.99
LEAST = 0.6
#: What a single letter and a run of the same letter count for each other in the kernel.
RUNS = 0.8
RIDGE = 1e-3
APART = 0.6
#: Texts of the sample that a landmark must stand in.
FOUND = 4
#: A landmark must stand out at least as much, as a share of the word that stands out most.
STRONG = 0.2
REMEMBERED = 400_000
_LETTERS = 64
#: Numbers of the marks; 0 is no letter.
_START, _END = _LETTERS - 2, _LETTERS - 1
_OPEN, _CLOSE = "\x02", "\x03"
#: Longer words are read in pieces that overlap by a window; cells of a block of words, and of the windows compared at once.
_PIECE = 4096
_BLOCK = 1 << 18
_CELLS = 1 << 16
#: Characters of the texts whose new words are compared at once.
_GROUP = 1 << 22
_SPELLED = re.compile(r"(?<!\S)(?:\w[^\w\s]*\s+){2,}\w[^\w\s]*(?!\S)")
_OTHER = re.compile(r"[\W_]+")
_RUN = re.compile(r"(.)\1+", re.S)
_LETTER = re.compile(r"(.)\1*", re.S)


def words(text: str) -> list[str]:
    """Tokens in lower case, with spelled-out words joined."""
    low = text.lower()
    out = low.split()
    out += ["".join(found.split()) for found in _SPELLED.findall(low)]
    return out


def letters(token: str) -> str:
    return _OTHER.sub("", token)


def collapsed(word: str) -> str:
    """A run of one letter once."""
    return _RUN.sub(r"\1", word)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def numbers(points: np.ndarray) -> np.ndarray:
    """Numbers of the letters with these code points, marks as they are."""
    found = (1 + points % (_LETTERS - 3)).astype(np.uint8)
    found[points == ord(_OPEN)] = _START
    found[points == ord(_CLOSE)] = _END
    return found


def marked(word: str) -> np.ndarray:
    """Numbers of the letters between two marks, a run of one letter once."""
    return numbers(_points(_OPEN + collapsed(word) + _CLOSE))


def run_marks(word: str) -> np.ndarray:
    """For each letter of :func:`collapsed`, between two marks, whether it was a run."""
    return np.array([False, *(len(m[0]) > 1 for m in _LETTER.finditer(word)), False])


def strength(kernel_: float) -> float:
    """What a word counts: 1 for a landmark itself, nothing for a word at the limit."""
    return (kernel_ - LEAST) / (1 - LEAST)


@lru_cache(256)
def _gaps(n: int) -> np.ndarray:
    """Weight of the letters between two places, for the earlier places of each place."""
    behind = np.arange(n)[:, None] - np.arange(n)
    return np.where(behind > 0, DECAY ** (behind - 1.0), 0).astype(np.float32)


def shared(some: np.ndarray, others: np.ndarray, some_runs: np.ndarray | None = None, other_runs: np.ndarray | None = None) -> np.ndarray:
    """The kernel, not yet scaled, of each row of letters with the row of the same place, or with the only one of ``others``.

    With runs (whether a letter stands once or more) a letter counts ``RUNS`` for a run of it.
    """
    rows, n = some.shape
    m = others.shape[1]
    same = ((some.T[:, :, None] == others[None]) & (some.T > 0)[:, :, None]).astype(np.float32) * np.float32(DECAY**2)
    if some_runs is not None:
        same *= np.where(some_runs.T[:, :, None] == other_runs[None], np.float32(1), np.float32(RUNS))
    left, right, found = _gaps(n), _gaps(m).T, same
    for _ in range(2):
        found = (left @ found.reshape(n, rows * m)).reshape(n * rows, m) @ right
        found = found.reshape(n, rows, m) * same
    return found.sum(axis=(0, 2), dtype=np.float64)


def own_shared(some: np.ndarray, runs: np.ndarray | None = None) -> np.ndarray:
    """The kernel of each row with itself, not yet scaled."""
    return shared(some, some, runs, runs)


@cache
def _plain(n: int) -> float:
    """The kernel with itself of a word of ``n`` letters that all differ."""
    return float(own_shared(np.arange(1, n + 1)[None])[0])


def held(some: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which share of the subsequences of ``other`` (by their places) each row has."""
    rows, n = some.shape
    m, at = len(other), np.arange(rows)
    ahead = np.full((n + 2, rows, m), n)  # the first place of each letter from a place on
    for place in range(n - 1, -1, -1):
        ahead[place] = np.where(some[:, place, None] == other, place, ahead[place + 1])
    count = np.zeros(rows)
    for i in range(m - 2):
        for j in range(i + 1, m - 1):
            second = ahead[ahead[0, :, i] + 1, at, j]
            count += (ahead[second + 1, at, j + 1 :] < n).sum(axis=1)
    return count / comb(m, 3)


def _bits(some: np.ndarray) -> np.ndarray:
    return np.left_shift(np.uint64(1), some.astype(np.uint64))


def _has(some: np.ndarray) -> np.ndarray:
    """The letters of each row as bits, without marks."""
    return _had(_bits(some))


def _had(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_or.reduce(bits, axis=1) & np.uint64((1 << _START) - 2)


def _joined(bits: np.ndarray, width: int) -> np.ndarray:
    """The bits of all windows, by doubling."""
    size, joined = 1, bits
    while size < width:
        step = min(size, width - size)
        joined = joined[:, : joined.shape[1] - step] | joined[:, step:]
        size += step
    return joined


def _slides(some: np.ndarray, width: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(some, width, axis=1)


class Landmark:
    def __init__(self, word: str) -> None:
        self.letters, self.runs = marked(word)[None], run_marks(word)[None]
        self.size = self.letters.shape[1] - 2
        # of a word with a letter behind each, and marks; between two equal letters too
        self.whole = 2 * max(self.size, len(word)) + 3
        self.own, self.norm = own_shared(self.letters)[0], own_shared(self.letters, self.runs)[0] ** 0.5
        self.inner = own_shared(self.letters[:, 1:-1])[0]
        self.start, self.end = own_shared(self.letters[:, :-1])[0], own_shared(self.letters[:, 1:])[0]
        self.has = _has(self.letters)[0]
        # a word with fewer of its letters has too few of its subsequences to reach LEAST
        self.need = -(-2 * int(self.has).bit_count() // 3)
        often = np.unique(self.letters[0, 1:-1], return_counts=True)[1]
        self.held = np.cumsum([0, *sorted(often.tolist(), reverse=True)]).tolist()  # places that so many letters hold at most
        self.needs = lru_cache(1024)(self._needs)

    def least_share(self, most: float, width: int, least: float) -> float:
        """The share of a part of the landmark below which a window is farther than ``least``."""
        cosine = most / np.sqrt(self.own * _plain(width))
        share = least / cosine ** (1 / 3)
        return (share if share * cosine <= 1 else least**1.5) * (1 - 1e-4)  # the kernel is in 32 bits

    def _letters_needed(self, most: float, marks: int, width: int, least: float) -> int:
        """How many letters of the landmark a window has at least whose share of a part with so many marks reaches ``least``."""
        if most <= 0:
            return _LETTERS + 1
        goal = self.least_share(most, width, least) * comb(self.size + marks, 3)
        return max(self.need, next((n for n, places in enumerate(self.held) if comb(places + marks, 3) >= goal), _LETTERS + 1))

    def _needs(self, n: int, least: float) -> tuple[int, list[tuple[int, np.ndarray]]]:
        """For rows of ``n``: the letters that a row needs, and that the windows of each width need at each place."""
        out = []
        for width in sorted({min(n, w) for w in (self.size, self.size + 1, self.whole)}):
            parts = ((self.inner, 0), (self.start, 1), (self.end, 1), (self.own, 2))
            inner, start, end, own = (self._letters_needed(most, marks, width, least) for most, marks in parts)
            places = np.full(n - width + 1, inner)
            places[0], places[-1] = min(inner, start), min(inner, end)
            if n == width:
                places[0] = min(inner, start, end, own)
            out.append((width, places))
        return min(int(places.min()) for _, places in out), out

    def near(
        self, some: np.ndarray, has: np.ndarray | None = None, bits: np.ndarray | None = None, where: np.ndarray | None = None, least: float = LEAST
    ) -> np.ndarray:
        """How close each row is: a word with its marks, or a piece of one. What is farther than ``least`` may count as nothing.

        ``where`` takes the start and the end of the part of the row that is so close.
        """
        has = _has(some) if has is None else has
        out = np.zeros(len(some))
        if where is not None:
            where[:] = 0, some.shape[1]
        need, widths = self.needs(some.shape[1], least)
        at = np.flatnonzero(np.bitwise_count(has & self.has) >= need)
        if not len(at):
            return out
        letters_ = (_bits(some) if bits is None else bits)[at] & self.has
        for width, needs in widths:
            row, place = np.nonzero(np.bitwise_count(_joined(letters_, width)) >= needs)
            if not len(row):
                continue
            wide = _slides(some, width)
            for i in range(0, len(row), _CELLS // width):
                few, there = at[row[i : i + _CELLS // width]], place[i : i + _CELLS // width]
                value = self._window(wide[few, there], least)
                for j in np.flatnonzero(value > out[few]).tolist():
                    if value[j] > out[few[j]]:
                        out[few[j]] = value[j]
                        if where is not None:
                            where[few[j]] = there[j], there[j] + width
        return out

    def _window(self, some: np.ndarray, least: float) -> np.ndarray:
        """How close windows are, of which some have a mark at one end or at both."""
        first, last = some[:, 0] == _START, some[:, -1] == _END
        out = np.zeros(len(some))
        for some_of, part, most in (
            (first & last, slice(None), self.own), (first & ~last, slice(0, -1), self.start), (last & ~first, slice(1, None), self.end),
            (~first & ~last, slice(1, -1), self.inner),
        ):
            if some_of.any() and most > 0:
                out[some_of] = self._scaled(some[some_of], most, self.letters[0, part], least)
        return out

    def _scaled(self, some: np.ndarray, most: float, part: np.ndarray, least: float) -> np.ndarray:
        """``part`` of the landmark is what such rows can share, ``most`` its kernel with itself."""
        share = shared(some, part[None]) / most
        out, at = np.zeros(len(some)), np.flatnonzero(share >= max(LEAST**1.5, self.least_share(most, some.shape[1], least)))
        if len(at):
            share = np.minimum(share[at], held(some[at], part))
            cosine = share * most / np.sqrt(self.own * _plain(some.shape[1]))
            # two parts of the share of the landmark that is there, one part of the usual cosine
            out[at] = np.minimum(1, share ** (2 / 3) * np.minimum(1, cosine) ** (1 / 3))
        return out


def _grids(words_: list[str], overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of pieces of one length of the marked words, a run of one letter once: letters, places of the words, starts in them."""
    points = _points("".join([_OPEN + w + _CLOSE for w in words_]))
    once = np.r_[True, points[1:] != points[:-1]]
    flat = numbers(points[once])
    sizes = np.fromiter(map(len, words_), np.int64, len(words_)) + 2
    sizes = np.add.reduceat(once, np.cumsum(sizes) - sizes, dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    # longer words in pieces
    parts = np.maximum(1, -(-(sizes - overlap) // _PIECE))
    word = np.repeat(np.arange(len(words_)), parts)
    start = (np.arange(len(word)) - np.repeat(np.cumsum(parts) - parts, parts)) * _PIECE
    size = np.minimum(sizes[word] - start, _PIECE + overlap)
    order = np.argsort(size, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
        n = int(size[some[0]])
        step = max(1, _BLOCK // n)
        for at in range(0, len(some), step):
            few = some[at : at + step]
            yield flat[(first[word[few]] + start[few])[:, None] + np.arange(n)], word[few], start[few]


def kernel(a: str, b: str) -> float:
    """Of a word with a landmark."""
    return float(Landmark(b).near(marked(a)[None], least=0.0)[0])


def _groups(some: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Texts that follow each other, with the place of the first, up to the text that reaches ``_GROUP`` characters."""
    first = held = 0
    for at, text in enumerate(some, 1):
        held += len(text)
        if held >= _GROUP or at == len(some):
            yield first, some[first:at]
            first, held = at, 0


class Landmarks:
    """Maps of words and texts by their kernel with the landmarks.

    Words close to one of ``chosen`` count; the clean words ``beside`` them are landmarks of the map only.
    """

    def __init__(self, chosen: list[str], beside: list[str] | tuple[str, ...] = ()) -> None:
        self.chosen = [*chosen, *beside]
        self.marks = [Landmark(w) for w in chosen]
        self.basis = [*self.marks, *map(Landmark, beside)]
        self.overlap = max((m.whole for m in self.marks), default=0)
        own = np.array([self._kernels(m.letters, m.runs)[0] for m in self.basis]).reshape(len(self.basis), -1)
        values, vectors = np.linalg.eigh(own + RIDGE * np.eye(len(self.basis)))
        self.root = vectors @ np.diag(values**-0.5) @ vectors.T
        self.known = Memo(REMEMBERED)

    def _kernels(self, some: np.ndarray, runs: np.ndarray) -> np.ndarray:
        """The scaled kernel of each row with each landmark."""
        norm = own_shared(some, runs) ** 0.5
        return np.column_stack([shared(some, m.letters, runs, m.runs) / (norm * m.norm) for m in self.basis])

    def learn(self, tokens: list[str]) -> dict[str, tuple[float, ...]]:
        """For each token its part of a text's map, nothing where no landmark is close; words of one length at once."""
        found: dict[str, tuple[float, np.ndarray, np.ndarray]] = {}  # strength, letters and runs of the closest part
        of_word: dict[str, list[str]] = {}
        for token in tokens:
            word = token if token.isalnum() else letters(token)
            if len(word) >= 3:
                of_word.setdefault(word, []).append(token)
        whole = list(of_word)
        for grid, word, start in _grids(whole, self.overlap) if whole else ():
            bits = _bits(grid)
            has = _had(bits)
            best, place, where = np.zeros(len(grid)), np.zeros((len(grid), 2), int), np.zeros((len(grid), 2), int)
            for mark in self.marks:
                near = mark.near(grid, has, bits, where)
                closer = near > best
                best[closer], place[closer] = near[closer], where[closer]
            for i in np.flatnonzero(best >= LEAST).tolist():
                name = whole[word[i]]
                if name not in found or found[name][0] < best[i]:
                    low, high = place[i].tolist()
                    found[name] = best[i], grid[i, low:high], run_marks(name)[start[i] + low : start[i] + high]
        mapped = self._mapped(found)
        return {**dict.fromkeys(tokens, ()), **{t: part for w, part in mapped.items() for t in of_word[w]}}

    def _mapped(self, found: dict[str, tuple[float, np.ndarray, np.ndarray]]) -> dict[str, tuple[float, ...]]:
        """The map of each part, scaled to its strength; parts of one length at once."""
        by_size: dict[int, list[str]] = {}
        for token, (_, part, _) in found.items():
            by_size.setdefault(len(part), []).append(token)
        out: dict[str, tuple[float, ...]] = {}
        for some in by_size.values():
            rows = self._kernels(np.stack([found[t][1] for t in some]), np.stack([found[t][2] for t in some])) @ self.root
            size = np.maximum(np.linalg.norm(rows, axis=1), 1e-9)
            rows *= (np.array([strength(found[t][0]) for t in some]) / size)[:, None]
            out.update(zip(some, map(tuple, rows.tolist()), strict=True))
        return out

    def maps(self, some: list[str]) -> np.ndarray:
        """The map of each text: the sum of its words', its length on a logarithmic scale."""
        out = np.zeros((len(some), len(self.chosen)))
        for at, group in _groups(some):
            tokens = [words(t) for t in group]
            young, old = self.known.young, self.known.old
            seen = set().union(*tokens)
            missing = seen.difference(young)
            held = {t: n for t in missing if (n := old.get(t)) is not None}
            found = {**held, **self.learn([t for t in missing if t not in held])}
            close = {t: n for t in seen if (n := young.get(t) or found.get(t))}
            for t, n in found.items():
                self.known.put(t, n)
            for i, ts in enumerate(tokens, at):
                if not close.keys().isdisjoint(ts):
                    for part in filter(None, map(close.get, ts)):
                        out[i] += part
        size = np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
        return out * (np.log1p(size) / size)


def fit_machine(x: np.ndarray, y: np.ndarray, penalty: float = 10.0, rounds: int = 300) -> np.ndarray:
    """Weights and offset of a linear machine with squared hinge loss, by accelerated gradient steps."""
    data = np.column_stack([x, np.ones(len(x))])
    sign, n = np.where(y > 0, 1.0, -1.0), len(y)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    step = 1.0 / (1.0 / (penalty * n) + 2 * np.linalg.eigvalsh((data * share[:, None]).T @ data)[-1])
    weights = before = np.zeros(data.shape[1])
    for i in range(rounds):
        ahead = weights + i / (i + 3) * (weights - before)
        slack = np.maximum(0, 1 - sign * (data @ ahead))
        before, weights = weights, ahead - step * (ahead / (penalty * n) - 2 * data.T @ (share * sign * slack))
    return weights


def fit_logistic(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the probability of a margin, by damped Newton steps."""
    data, out = np.column_stack([margin, np.ones(len(margin))]), np.array([1.0, 0.0])
    goal = np.where(y > 0, 1 - 1e-2, 1e-2)
    # the rarer class counts more, by the root of the ratio
    weight = np.where(y > 0, np.sqrt(max(1, (y <= 0).sum()) / max(1, (y > 0).sum())), 1.0)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(data @ out, -30, 30)))
        curve = (data * (weight * p * (1 - p))[:, None]).T @ data + 1e-3 * np.eye(2)
        out = out + np.linalg.solve(curve, data.T @ (weight * (goal - p))) * 0.5
    return float(out[0]), float(out[1])


def choose_landmarks(candidates: list[str], most: int = LANDMARKS) -> list[str]:
    """The best candidates that are not close to a better one."""
    chosen: list[str] = []
    marks: list[Landmark] = []
    for word in candidates:
        mine = marked(word)[None]
        if all(m.near(mine, least=min(APART, LEAST))[0] < APART for m in marks):
            chosen.append(word)
            marks.append(Landmark(word))
        if len(chosen) == most:
            break
    return chosen


def _sample(rows: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, text, toxic) of at most ``most`` labelled texts, half of them toxic if there are enough."""
    order = [F.xxhash64("doc_id", F.lit("toxicity")), F.col("doc_id")]
    named = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    toxic = named.filter("toxic > 0").orderBy(*order).limit(most // 2)
    clean = named.filter("toxic <= 0").orderBy(*order).limit(most // 2)
    picked = cut_lineage(toxic.union(clean).withColumn("toxic", (F.col("toxic") > 0).cast("int")), "labels")
    # at most ``most`` ids
    return rows.join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of each row; ``labels`` has doc_id and toxic (0 or 1)."""
    rows = texts(docs, id_col, text_col)
    train = cut_lineage(_sample(rows, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"), sample), "training")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = sorted({w for t in words(text) if len(w := letters(t)) >= 3})
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([toxic] * len(found), pa.int32())], names=["word", "toxic"])

    totals = train.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic")).first()
    n, toxic = totals["n"], totals["toxic"] or 0
    seen = train.select("text", "toxic").mapInArrow(tokens, "word string, toxic int").groupBy("word").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("all"))
    gain = F.log((F.col("bad") + 0.5) / (toxic + 1.0)) - F.log((F.col("all") - F.col("bad") + 0.5) / (n - toxic + 1.0))
    ranked = seen.filter(F.col("bad") >= FOUND).withColumn("gain", gain * F.sqrt("bad")).filter(gain > 2)
    best = ranked.orderBy(F.desc("gain"), "word").limit(CANDIDATES).select("word", "gain").collect() if 0 < toxic < n else []
    chosen = choose_landmarks([r["word"] for r in best if r["gain"] >= STRONG * best[0]["gain"]])
    if not chosen:
        return rows.select("doc_id", F.lit(float(toxic / n) if n else 0.0).alias("score"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        landmarks = Landmarks(chosen)
        for batch in batches:
            found = landmarks.learn(batch.column(0).to_pylist())
            yield batch.filter(pa.array([bool(found[w]) for w in batch.column(0).to_pylist()], pa.bool_()))

    # words of clean texts that are close to a landmark, so that the machine can tell them from it
    clean = seen.filter((F.col("all") >= FOUND) & (F.col("bad") * n <= F.col("all") * toxic)).select("word", "all")
    beside = [r["word"] for r in clean.mapInArrow(near, clean.schema).orderBy(F.desc("all"), "word").limit(LANDMARKS).collect()]

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        landmarks = Landmarks(chosen, beside)
        for batch in batches:
            found = landmarks.maps(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(found.tolist(), pa.list_(pa.float64())), batch.column(1)], names=["map", "toxic"])

    table = train.select("text", "toxic").mapInArrow(maps, "map array<double>, toxic int").collect()  # at most ``sample`` rows
    x, y = np.array([r["map"] for r in table]), np.array([r["toxic"] for r in table])
    weights = fit_machine(x, y)
    slope, offset = fit_logistic(x @ weights[:-1] + weights[-1], y)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        landmarks = _loaded(tuple(chosen), tuple(beside))
        for batch in batches:
            margin = landmarks.maps(batch.column(1).to_pylist()) @ weights[:-1] + weights[-1]
            value = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value, pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(scores, "doc_id long, score double")


_worker: dict[tuple[tuple[str, ...], tuple[str, ...]], Landmarks] = {}


def _loaded(chosen: tuple[str, ...], beside: tuple[str, ...]) -> Landmarks:
    """The landmarks with the words they know, kept by a Python worker from task to task."""
    if (chosen, beside) not in _worker:
        _worker.clear()
        _worker[chosen, beside] = Landmarks(list(chosen), beside)
    return _worker[chosen, beside]
