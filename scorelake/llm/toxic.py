"""Toxicity: a support vector machine on a gapped subsequence kernel with Nyström landmarks.

Two strings are alike as they share subsequences of three characters, each weighted by DECAY to the power of the span it takes, spans
up to SPAN, scaled by the strings' lengths; so an insult with inserted or left-out characters stays close to itself. Strings are
stretches of a sentence: the first characters of their subsequences lie within WINDOW places of one word; letters that stand
alone in a row ("i d i o t", "i.d.i.o.t") count as one word. A sentence is as toxic as its worst stretch, a document as its worst sentence
or as the number of its weak stretches makes it.

Labels mark documents, so the stretches that carry the label are found first: words with a character 4-gram that toxic documents of the
sample have far more often, where near copies together count as one document. Landmarks are taken from these and from
clean words, the kernel against them is whitened (Nyström), and a linear machine with squared hinge loss is trained on it. Then
clean words that it takes for toxic join the training, and its margin is calibrated on the sample's documents.
Words that clean texts have too, only far less often, are weak evidence: beginnings of words that toxic documents of one language
repeat. A second machine of the same kind learns these, and the words it finds in a document, beyond what a clean one of its length has, add to the score.
As the kernel is a product of explicit features, the machine folds into one weight for each triple of characters: scoring reads every
character of every whole text, in NumPy, and ships only that table.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import slices, staged
from scorelake.session import ship_package

DECAY, SPAN, WINDOW = 0.7, 6, 7
#: Bounds of what training gathers: labelled documents read, words taken with a toxic and with a clean label, landmarks of each.
SAMPLE, WORDS, CLEAN_WORDS, LANDMARKS = 8000, 3000, 40000, 160
#: A 4-gram marks toxic words if it is in MARK_DOCS toxic documents, in MARK_SHARE of them, and MARK_RATIO times as frequent there as in
#: clean ones.
MARK_DOCS, MARK_SHARE, MARK_RATIO = 3.5, 0.02, 40.0
#: The beginning of a word is weak evidence if, in one language, it is in WEAK_DOCS toxic documents, in WEAK_SHARE of them, and WEAK_RATIO
#: times as frequent there as in clean ones; a document counts up to WEAK_MOST of its words. Excess is cut to EXCESS.
WEAK_DOCS, WEAK_SHARE, WEAK_RATIO, WEAK_MOST, HEADS, EXCESS = 5.0, 0.25, 5.0, 8, (3, 4, 5, 6), 6.0
#: Margins from which the weak machine may take a word; that with the best fit to the sample's documents is used.
LEAST = (0.0, 0.25, 0.5, 0.75, 1.0, 1.25)
THRESHOLD = 0.3
#: Letters the weights tell apart, the most frequent of the landmarks; 0 stands for all others, which only fill gaps.
LETTERS = 96
PATTERNS = [(a, t) for t in range(2, SPAN) for a in range(1, t)]
BLANKS = [0x20, *range(0x09, 0x0E)]
#: Letters and digits among the first code points; all from 128 on count as letters.
ALONE = np.array([chr(i).isalnum() for i in range(128)] + [True])
NOTHING, FLOOR, CEILING = -1e6, -1.5, 1.5
#: Squared weights of all subsequences that begin at a place, by the characters of the word from there on.
SQUARES = np.cumsum([0.0, 0.0, 0.0, *((t - 1) * DECAY ** (2 * t + 2) for t in range(2, SPAN))])


def length_norm(rest: np.ndarray) -> np.ndarray:
    """Scale of the stretch that begins where a word has `rest` characters left."""
    return np.sqrt(0.05 + NORMS[np.minimum(rest, len(NORMS) - 1)])


NORMS = np.array([sum(SQUARES[min(max(n - k, 0), SPAN)] for k in range(WINDOW)) for n in range(WINDOW + SPAN + 1)])


@dataclass
class Model:
    letters: str
    table: np.ndarray
    bias: float
    slope: float
    shift: float
    #: Machine of weak stretches, the margin from which it takes a word, the share of words of clean documents that it takes, and the weight
    #: of what a text has beyond.
    weak: Model | None = None
    least: float = 0.0
    rate: float = 0.0
    extra: float = 0.0

    def lookup(self) -> np.ndarray:
        return letter_numbers(self.letters)


def letter_numbers(letters: str) -> np.ndarray:
    """Letter number of each code point; capitals as their small letters."""
    numbers = np.zeros(0x110000, dtype=np.uint8)
    for k, c in enumerate(letters, 1):
        numbers[ord(c)] = k
        if len(c.upper()) == 1:
            numbers[ord(c.upper())] = k
    return numbers


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' code points one after another, a line feed after each, and where each text begins (and the end)."""
    joined = np.frombuffer("".join([t + "\n" for t in texts]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return joined, np.cumsum([0, *(len(t) + 1 for t in texts)])


def spelled_together(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the one or two blanks or signs that stand between letters standing alone, inside a text."""
    letter = ALONE[np.minimum(points, 128)]
    begin = np.flatnonzero(letter & np.concatenate([[True], ~letter[:-1]]))
    end = np.flatnonzero(letter & np.concatenate([~letter[1:], [True]])) + 1
    lone = end - begin == 1
    pairs = np.flatnonzero(lone[:-1] & lone[1:] & (begin[1:] - end[:-1] <= 2))
    if not len(pairs):
        return points, starts
    gone = np.zeros(len(points), dtype=bool)
    gone[end[pairs]] = gone[begin[pairs + 1] - 1] = True
    gone[starts[1:] - 1] = False
    kept = np.concatenate([[0], np.cumsum(~gone)])
    return points[~gone], kept[starts]


def margins(texts: list[str], model: Model, numbers: np.ndarray) -> np.ndarray:
    """The largest margin of any stretch of each text; NOTHING for texts without words."""
    value, _, starts = stretch_margins(texts, model, numbers)
    return np.maximum.reduceat(value, starts[:-1]) if len(texts) else value


def excess(texts: list[str], model: Model, numbers: np.ndarray) -> np.ndarray:
    """By how many standard deviations the words of each text that the weak machine takes are more than in a clean text, 0 to EXCESS."""
    if model.weak is None or not texts:
        return np.zeros(len(texts))
    words, found = weak_counts(texts, model.weak, numbers, (model.least,))
    return beyond(words, found[0], model.rate)


def beyond(words: np.ndarray, found: np.ndarray, rate: float) -> np.ndarray:
    return np.clip((found - words * rate) / np.sqrt(words * rate + 1), 0, EXCESS)


def weak_counts(texts: list[str], weak: Model, numbers: np.ndarray, least: tuple[float, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The number of words of each text, and for each of `least` of those whose beginning has a larger margin."""
    value, blank, starts = stretch_margins(texts, weak, numbers)
    begin = ~blank & np.concatenate([[True], blank[:-1]])
    return np.add.reduceat(begin.astype(np.int64), starts[:-1]), [np.add.reduceat((begin & (value > v)).astype(np.int64), starts[:-1]) for v in least]


def stretch_margins(texts: list[str], model: Model, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The margin of the stretch that begins at each character, which characters are blanks, and where each text begins."""
    points, starts = spelled_together(*code_points(texts))
    n, size = len(points), LETTERS + 1
    c = numbers[points].astype(np.int32)
    blank = np.isin(points, BLANKS)
    word = np.cumsum(blank, dtype=np.int32)
    total = np.zeros(n)
    head = c * (size * size)
    for t in range(2, SPAN):
        if n <= t:
            break
        whole = word[t:] == word[:n - t]
        part = np.zeros(n - t, dtype=np.float32)
        for a in range(1, t):
            part += model.table[head[:n - t] + c[a:n - t + a] * size + c[t:]]
        total[:n - t] += part * whole * DECAY ** (t + 1)
    sums = np.concatenate([[0.0], np.cumsum(total)])
    ends = np.flatnonzero(blank)
    at = np.arange(n)
    rest = (np.repeat(ends, np.diff(ends, prepend=-1)) if n else at) - at
    value = np.where(blank, NOTHING, (sums[at + np.minimum(rest, WINDOW)] - sums[:n]) / length_norm(rest) + model.bias)
    return value, blank, starts


def triples(strings: list[str], numbers: np.ndarray) -> list[dict[int, float]]:
    """Explicit kernel features of the stretch at the head of each string."""
    out = []
    for s in strings:
        c = numbers[np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype="<u4")].astype(np.int64)
        found: dict[int, float] = {}
        for a, t in PATTERNS:
            for i in range(min(len(c) - t, WINDOW)):
                if c[i] and c[i + a] and c[i + t]:
                    code = int((c[i] * (LETTERS + 1) + c[i + a]) * (LETTERS + 1) + c[i + t])
                    found[code] = found.get(code, 0.0) + DECAY ** (t + 1)
        scale = float(length_norm(np.array(len(c))))
        out.append({code: w / scale for code, w in found.items()})
    return out


def matrix(features: list[dict[int, float]], columns: dict[int, int]) -> np.ndarray:
    out = np.zeros((len(features), len(columns)), dtype=np.float32)
    for i, f in enumerate(features):
        for code, w in f.items():
            if code in columns:
                out[i, columns[code]] = w
    return out


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-2) -> tuple[np.ndarray, float]:
    """Linear machine by Newton steps on the rows inside the margin."""
    x = np.hstack([x, np.ones((len(x), 1))])
    theta, ridge = np.zeros(x.shape[1]), np.diag([penalty] * (x.shape[1] - 1) + [1e-6])
    for _ in range(60):
        inside = y * (x @ theta) < 1
        xi, wi = x[inside], weight[inside, None]
        step = np.linalg.solve(ridge + xi.T @ (wi * xi), xi.T @ (wi[:, 0] * y[inside]))
        if np.abs(step - theta).max() < 1e-7:
            break
        theta = step
    return theta[:-1], float(theta[-1])


def stretched(word: str) -> list[str]:
    """The word as it may be disguised: a character put in or doubled at each place, and all letters apart."""
    inside = range(1, len(word))
    return [*(word[:i] + "*" + word[i:] for i in inside), *(word[:i] + word[i - 1] + word[i:] for i in inside), ".".join(word)]


def heads(word: str) -> list[str]:
    """The stretches of a word, each as the string that begins with it."""
    return [word[i:] for i in range(max(len(word) - 2, 1))]


def fit_words(toxic: list[tuple[str, int]], clean: list[str]) -> Model:
    """The machine, from stretches with toxic label (and their numbers) and clean words; without its calibration."""
    counts: dict[str, int] = {}
    for w, n in [*toxic, *((w, 1) for w in clean[:2 * WORDS])]:
        for ch in w:
            counts[ch] = counts.get(ch, 0) + n
    letters = "".join(sorted(counts, key=lambda ch: (-counts[ch], ch))[:LETTERS])
    numbers = letter_numbers(letters)
    own = triples([w for w, _ in toxic[:LANDMARKS]] + clean[:LANDMARKS], numbers)
    columns = {code: k for k, code in enumerate(sorted({code for f in own for code in f}))}
    z = matrix(own, columns)
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    good = values > 1e-6 * values[-1]
    whiten = z.T @ (vectors[:, good] / np.sqrt(values[good]))

    def mapped(strings: list[str]) -> np.ndarray:
        parts = [matrix(triples(strings[k:k + 500], numbers), columns) @ whiten for k in range(0, len(strings), 500)]
        return np.vstack(parts).astype(np.float64)

    shapes = [(w, float(np.sqrt(n))) for w, n in toxic] + [(v, 0.3) for w, _ in toxic[:300] for v in stretched(w)]
    positive, weights = mapped([w for w, _ in shapes]), np.array([w for _, w in shapes])
    used = {h for w in clean[:1500] for h in heads(w)}
    negative = mapped(sorted(used))
    for turn in range(4):
        x = np.vstack([positive, negative])
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        weight = np.concatenate([weights / weights.sum(), np.full(len(negative), 4 / len(negative))])
        theta, bias = squared_hinge(x, y, weight * 1000)
        flat = np.zeros((LETTERS + 1) ** 3, dtype=np.float32)
        flat[list(columns)] = whiten @ theta
        model = Model(letters, flat, bias, 1.0, 0.0)
        if turn == 3:
            return model
        scores = margins(clean, model, numbers)
        worst = [clean[i] for i in np.argsort(-scores, kind="stable")[:1000] if scores[i] > -1]
        fresh = sorted({h for w in worst for h in heads(w)} - used)
        if not fresh:
            return model
        used |= set(fresh)
        negative = np.vstack([negative, mapped(fresh)])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Three minima of hashes over a text's word pairs: near copies share them."""
    for batch in slices(batches, "text"):
        out = []
        for text in batch.column("text").to_pylist():
            words = text.lower().split()
            h = np.array([zlib.crc32(f"{a} {b}".encode("utf-8", "surrogatepass")) for a, b in zip(words, [*words[1:], ""])] or [0], dtype=np.uint64)
            out.append([int((h * np.uint64(k) % np.uint64(4294967291)).min()) for k in (2654435761, 2246822519, 3266489917)])
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "prints": pa.array(out, pa.list_(pa.int64()))})


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        for text, toxic, weight in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "weight"))):
            found = {w[i:i + 4] for w in set(text.lower().split()) for i in range(len(w) - 3)}
            yield pa.record_batch({"gram": pa.array(sorted(found), pa.string()), "bad": pa.array([weight * toxic] * len(found), pa.float64()),
                                   "good": pa.array([weight * (1 - toxic)] * len(found), pa.float64())})


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many words of toxic and of clean texts of a slice begin with each string, by language, up to WEAK_MOST in a text."""
    for batch in slices(batches, "text"):
        found: dict[tuple[str, str], list[float]] = {}
        for text, lang, toxic, weight in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "toxic", "weight"))):
            for head, n in Counter(w[:k] for w in text.lower().split() for k in HEADS if len(w) > k).items():
                at = found.setdefault((lang, head), [0.0, 0.0, 0.0])
                at[1 - toxic] += weight * min(n, WEAK_MOST)
                at[2] += weight * toxic
        columns = [*zip(*((*k, *v) for k, v in found.items()))] or [()] * 5
        yield pa.record_batch([pa.array(c, pa.string() if k < 2 else pa.float64()) for k, c in enumerate(columns)], ["lang", "head", "bad", "good", "docs"])


def _weak_words(weak: dict[str, set[str]], marks: set[str]):
    """The words of toxic texts that begin with a weak string of their language, and the other words of clean texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            for text, lang, toxic in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "toxic"))):
                own, out = weak.get(lang, set()), set()
                for w in set(text.lower().split()):
                    if any(w[:k] in own for k in HEADS) == bool(toxic) and not any(w[i:i + 4] in marks for i in range(len(w) - 3)):
                        out |= {w[:WINDOW + SPAN]} if toxic else {w[:40]}
                yield pa.record_batch({"word": pa.array(sorted(out), pa.string()), "toxic": pa.array([toxic] * len(out), pa.int32())})
    return run


def _stretches(marks: dict[str, float]):
    """Per document: of a toxic one the stretch at the worst 4-gram of each marked word, of a clean one all words, in parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                found = set()
                for w in set(text.lower().split()):
                    best = max(((marks.get(w[i:i + 4], 0.0), -i) for i in range(len(w) - 3)), default=(0.0, 0))
                    if toxic and best[0] > 0:
                        found |= {w[a:a + WINDOW + SPAN] for a in {max(-best[1] - 1, 0), -best[1]}}
                    elif not toxic:
                        found |= {w[a:a + 40] for a in range(0, len(w), 34)}
                yield pa.record_batch({"word": pa.array(sorted(found), pa.string()), "toxic": pa.array([toxic] * len(found), pa.int32())})
    return run


def _margins(model: Model, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, weak = model.lookup(), model.weak and model.weak.lookup()
        for batch in slices(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.record_batch({column: batch.column(column), "margin": pa.array(margins(texts, model, numbers), pa.float64()),
                                   "excess": pa.array(excess(texts, model, weak), pa.float64())})
    return run


def _evidence(model: Model):
    """Of labelled texts the margin, and how many words they have and the weak machine takes from each of LEAST."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, weak = model.lookup(), model.weak and model.weak.lookup()
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            words, found = weak_counts(texts, model.weak, weak, LEAST) if model.weak else (np.zeros(len(texts), dtype=np.int64), [])
            yield pa.record_batch({"toxic": batch.column("toxic"), "margin": pa.array(margins(texts, model, numbers), pa.float64()), "words": pa.array(words, pa.int64()),
                                   "found": pa.array([[int(f[k]) for f in found] for k in range(len(texts))], pa.list_(pa.int64()))})
    return run


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Model | None:
    """Fit on at most `sample` labelled documents, chosen by the hash of their id among those not held out.

    None if there are no labels of both kinds or neither a 4-gram nor the beginnings of words tell them apart. Rows without id, text or label are
    not used. A column `lang` groups the texts for weak evidence; without it, or null, they are one group.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    chosen = marked.filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lang.alias("lang")).dropna()
    rows = staged(texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]), "labelled")
    prints = {r["doc_id"]: r["prints"] for r in rows.select("doc_id", "text").mapInArrow(_prints, "doc_id long, prints array<long>").collect()}
    sizes = [Counter(p[k] for p in prints.values()) for k in range(3)]
    weights = docs.sparkSession.createDataFrame(
        [(d, 1.0 / max(sizes[k][p[k]] for k in range(3))) for d, p in prints.items()], "doc_id long, weight double")
    rows = staged(rows.join(F.broadcast(weights), "doc_id"), "weighted")
    total = rows.agg(F.sum(F.col("weight") * F.col("toxic")).alias("bad"), F.sum(F.col("weight") * (1 - F.col("toxic"))).alias("good")).first()
    if not total["bad"] or not total["good"]:
        return None
    grams = rows.mapInArrow(_grams, "gram string, bad double, good double").groupBy("gram").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    ratio = ((F.col("bad") + 0.5) / (total["bad"] + 1)) / ((F.col("good") + 0.5) / (total["good"] + 1))
    marks = {r["gram"]: r["ratio"] for r in grams.withColumn("ratio", ratio).filter(
        (F.col("bad") >= max(MARK_DOCS, MARK_SHARE * total["bad"])) & (F.col("ratio") >= MARK_RATIO)).orderBy(F.desc("ratio"), "gram").limit(WORDS).collect()}
    toxic, clean = _training_words(rows.mapInArrow(_stretches(marks), "word string, toxic int"))
    model = fit_words(toxic, clean) if toxic and clean else Model("", np.zeros((LETTERS + 1) ** 3, dtype=np.float32), FLOOR, 1.0, 0.0)
    weak = weak_beginnings(rows)
    toxic, clean = _training_words(rows.mapInArrow(_weak_words(weak, set(marks)), "word string, toxic int")) if weak else ([], [])
    if toxic and clean:
        model.weak = fit_words(toxic, clean)
    elif not model.letters:
        return None
    points = rows.mapInArrow(_evidence(model), "toxic int, margin double, words long, found array<long>").collect()
    cut, words, toxic = (np.array(x, dtype=float) for x in zip(*((min(max(p["margin"], FLOOR), CEILING), p["words"], p["toxic"]) for p in points)))
    model.slope, _, model.shift, best = calibrate(cut, np.zeros(len(cut)), toxic)
    for k, least in enumerate(LEAST if model.weak else ()):
        found = np.array([p["found"][k] for p in points], dtype=float)
        rate = float(found[toxic == 0].sum() / max(words[toxic == 0].sum(), 1))
        slope, extra, shift, fit = calibrate(cut, beyond(words, found, rate), toxic)
        if fit > best:
            best, model.least, model.rate, model.slope, model.extra, model.shift = fit, least, rate, slope, extra, shift
    return model


def weak_beginnings(rows: DataFrame) -> dict[str, set[str]]:
    """By language, the beginnings of words that are weak evidence; `rows` has `text, lang, toxic, weight`."""
    is_toxic = F.col("toxic") == 1
    totals = rows.groupBy("lang").agg(F.sum(F.when(is_toxic, F.col("weight")).otherwise(0.0)).alias("toxic_docs"),
                                      F.sum(F.when(is_toxic, 0.0).otherwise(F.col("weight"))).alias("clean_docs"))
    heads = rows.mapInArrow(_beginnings, "lang string, head string, bad double, good double, docs double").groupBy("lang", "head").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.sum("docs").alias("docs")).join(F.broadcast(totals), "lang")
    ratio = ((F.col("bad") + 0.5) / (F.col("toxic_docs") + 1)) / ((F.col("good") + 0.5) / (F.col("clean_docs") + 1))
    found = heads.filter((F.col("docs") >= F.greatest(F.lit(WEAK_DOCS), WEAK_SHARE * F.col("toxic_docs"))) & (ratio >= WEAK_RATIO))
    out: dict[str, set[str]] = {}
    for r in found.select("lang", "head").orderBy(F.desc(ratio), "lang", "head").limit(WORDS).collect():
        out.setdefault(r["lang"], set()).add(r["head"])
    return out


def _training_words(words: DataFrame) -> tuple[list[tuple[str, int]], list[str]]:
    """Words with toxic label and their numbers, and clean words: the most frequent and some of the others."""
    words = staged(words.groupBy("word", "toxic").agg(F.count("*").alias("n")), "words")
    toxic = [(r["word"], r["n"]) for r in words.filter("toxic = 1").orderBy(F.desc("n"), "word").limit(WORDS).collect()]
    common = [r["word"] for r in words.filter("toxic = 0").orderBy(F.desc("n"), "word").limit(WORDS).collect()]
    others = [r["word"] for r in words.filter("toxic = 0").orderBy(F.xxhash64("word"), "word").limit(CLEAN_WORDS).collect()]
    return toxic, sorted({*common, *others}, key=hash_order)


def hash_order(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def calibrate(margin: np.ndarray, more: np.ndarray, y: np.ndarray) -> tuple[float, float, float, float]:
    """Logistic curve of label on margin and excess, with a weak prior on its numbers, and its logarithmic fit; the excess never lowers a score."""
    x = np.stack([margin, more], axis=1) if more.any() else margin[:, None]
    centre, scale = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    z = np.hstack([(x - centre) / scale, np.ones((len(x), 1))])
    b = np.zeros(z.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + 0.1 * np.eye(len(b)), z.T @ (y - p) - 0.1 * b)
        step *= min(1.0, 2.0 / np.abs(step).max()) if np.abs(step).max() else 0.0
        b += step
        if np.abs(step).max() < 1e-9:
            break
    slopes = b[:-1] / scale
    if len(slopes) > 1 and slopes[1] < 0:
        return calibrate(margin, np.zeros_like(more), y)
    fit = -np.logaddexp(0, (1 - 2 * y) * (z @ b)).sum()
    return float(slopes[0]), float(slopes[1]) if len(slopes) > 1 else 0.0, float(b[-1] - slopes @ centre), float(fit)


def held_out():
    """Rows whose labels are never learned from; a document without id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """`doc_id, held_out, score, predicted` for every document, from its whole text alone.

    Margins are cut to FLOOR and CEILING; texts without words (or null) count as FLOOR, with a score near 0. Without a model every score is 0.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if model is None:
        scored = rows.select("doc_id", F.lit(0.0).alias("score"))
    else:
        ship_package(docs.sparkSession)
        margin = F.greatest(F.least(F.col("margin"), F.lit(CEILING)), F.lit(FLOOR))
        scored = rows.mapInArrow(_margins(model, "doc_id"), "doc_id long, margin double, excess double").select(
            "doc_id", (1 / (1 + F.exp(-(margin * model.slope + F.col("excess") * model.extra + model.shift)))).alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    ship_package(docs.sparkSession)
    return score(docs, train(docs, labels))


def _kept(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, weak = model.lookup(), model.weak and model.weak.lookup()
        rows = (pa.record_batch({"row": b.column("row"), "text": pc.struct_field(b.column("row"), "text")}) for b in batches)
        for batch in slices(rows, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = np.clip(margins(texts, model, numbers), FLOOR, CEILING) * model.slope + excess(texts, model, weak) * model.extra
            good = 1 / (1 + np.exp(-(found + model.shift))) < THRESHOLD
            yield pa.RecordBatch.from_arrays([batch.column("row")], names=["row"]).filter(pa.array(good))
    return run


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the model does not reject, with all their columns."""
    ship_package(docs.sparkSession)
    model = train(docs, labels)
    if model is None:
        return docs
    rows = docs.select(F.struct("*").alias("row"))
    return rows.mapInArrow(_kept(model), rows.schema).select("row.*")
