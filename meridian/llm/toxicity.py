"""Toxicity by gradient-boosted trees over dense features with isotonic calibration.

Features are densities of a given lexicon and of stems learned from the sample, how near their hits stand to second-person
words, capitals, punctuation and obfuscation. Stems are word beginnings (and whole words) whose document frequency differs
between the labels; each half of the sample gets its features from the other half's stems, so that the trees see them as
they will on new texts. Trees are fitted on the bounded sample; predictions of trees that did not see a row calibrate.
Scoring is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import calibrated, fit_trees, isotonic
from .scratch import Scratch
from .textcore import DIGIT, LETTER, LOWER, SIGN, UPPER, chunks, word_hashes, word_sums, words
from .training import held_out, labelled_sample

#: Insults and second-person words in the four languages of the corpus.
LEXICON = (
    "idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown clowns jerk fool fools imbecile hate ugly filthy vermin "
    "idiota idiotas estupido tonto imbecil basura asqueroso payaso inutil idiote stupide imbecile ordure minable degoutant clown nul dumm idioten trottel abschaum wertlos ekelhaft versager"
).split()
SECOND_PERSON = "you your yours yourself u ur tu te toi vous votre vos tes usted ustedes ti du dich dir dein deine ihr euch".split()
STEM_BYTES = (3, 4, 5, 6, 7, 8, 9, 10)
NEAR = 6
FEATURES = 22

_SWAP = np.zeros(256, bool)  # what stands for letters inside words
_SWAP[[*b"013457@$*!"]] = True
_LEET = bytes.maketrans(b"013457@$!", b"oieastasi")
#: No disguised word of the lexicon is longer.
_MOST_SPELLED = 24


def _hash_all(items: list[str]) -> np.ndarray:
    raw = [x.encode() for x in items]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(x) for x in raw])
    return np.sort(word_hashes(data, ends - [len(x) for x in raw], ends))


def _stems(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(words, 1 + lengths) hashes: of the whole word (negated) and of its beginnings, 0 where the word is no longer than that."""
    total = word_sums(data, starts)
    out = [~word_hashes(data, starts, ends, total=total)]
    for k in STEM_BYTES:
        out.append(np.where(ends - starts > k, word_hashes(data, starts, np.minimum(starts + k, ends), total=total), np.uint64(0)))
    return np.stack(out, axis=1)


def _lookup(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in the sorted table, -1 if it isn't there."""
    if not len(table):
        return np.full(keys.shape, -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def _count_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stem, fold, y, n): documents that hold a stem, added up for each piece of text; and stem 0 for all documents."""
    for part, data, offs in chunks(batches):
        low = LOWER[data]
        starts, ends, woff = words(low, offs, LETTER)
        y, fold = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(y)), np.diff(woff))
        stems = _stems(low, starts, ends)
        frame = pd.DataFrame({"stem": stems.ravel().view(np.int64), "doc": np.repeat(doc, stems.shape[1])})
        frame = pd.concat([frame[frame["stem"] != 0], pd.DataFrame({"stem": 0, "doc": np.arange(len(y))})]).drop_duplicates()
        frame["fold"], frame["y"] = fold[frame["doc"]], y[frame["doc"]]
        out = frame.groupby(["stem", "fold", "y"]).size().reset_index(name="n").astype({"fold": np.int32, "y": np.int32, "n": np.int64})
        yield pa.RecordBatch.from_pandas(out, preserve_index=False)


def learn_stems(sample: DataFrame, folds: tuple[int, ...], most: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Sorted stem hashes and their weights (log odds), at most ``most``: those with the greatest likelihood ratio for label 1."""
    counts = sample.where(F.col("fold").isin(*folds)).select("y", "fold", "text").mapInArrow(_count_stems, "stem long, fold int, y int, n long")
    table = counts.groupBy("stem").agg(F.sum(F.expr("if(y = 1, n, 0)")).alias("a"), F.sum(F.expr("if(y = 0, n, 0)")).alias("b"))
    table = Scratch(sample.sparkSession).write(table, "stems")
    total = table.where("stem = 0").first()
    if total is None or not total.a or not total.b:
        return np.zeros(0, np.uint64), np.zeros(0)
    p1, p0 = float(total.a), float(total.b)
    odds = F.log((F.col("a") + 0.5) / (p1 + 1)) - F.log((F.col("b") + 0.5) / (p0 + 1))
    both = (F.col("a") + F.col("b")) / (p1 + p0)
    ratio = 2 * (F.col("a") * F.log((F.col("a") + 1e-9) / (p1 * both)) + F.col("b") * F.log((F.col("b") + 1e-9) / (p0 * both)))
    picked = table.where("stem <> 0 and a >= 4").withColumn("w", odds).withColumn("g", ratio).where("w > 0.7 and g > 15").orderBy(F.desc("g"), "stem").limit(most).select("stem", "w").collect()
    stem = np.array([r.stem for r in picked], np.int64).view(np.uint64)
    order = np.argsort(stem)
    return stem[order], np.array([r.w for r in picked])[order]


def features(data: np.ndarray, offs: np.ndarray, stems: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(documents, FEATURES)."""
    n = len(offs) - 1
    low = LOWER[data]
    starts, ends, woff = words(low, offs, LETTER)
    count = np.diff(woff)
    doc = np.repeat(np.arange(n), count)
    per_word, per_byte = np.maximum(count, 1), np.maximum(np.diff(offs), 1)
    of_words = lambda x: np.bincount(doc, x, n)
    byte_sum = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offs])
    keys = _stems(low, starts, ends)
    own = ~keys[:, 0]
    lexical = _lookup(_hash_all(sorted(set(LEXICON))), own) >= 0
    person = _lookup(_hash_all(sorted(set(SECOND_PERSON))), own) >= 0
    table, weight = stems
    weights = np.append(weight, 0.0)
    best = np.zeros(len(own))
    for k in range(keys.shape[1]):
        best = np.maximum(best, weights[_lookup(table, keys[:, k])])
    strong = best > 2
    hit = lexical | strong
    most = np.zeros(n)
    np.maximum.at(most, doc, best)
    # hits with a second-person word of the same document within NEAR words
    at = np.flatnonzero(person)
    near = np.zeros(len(own), bool)
    if len(at):
        place = np.arange(len(own))
        i = np.searchsorted(at, place)
        for j in (np.maximum(i - 1, 0), np.minimum(i, len(at) - 1)):
            near |= (np.abs(at[j] - place) <= NEAR) & (doc[at[j]] == doc)
    distinct = np.zeros(n)
    if strong.any():
        pairs = np.unique(np.stack([doc[strong].astype(np.uint64), own[strong]]), axis=1)[0].astype(np.int64)
        distinct = np.bincount(pairs, minlength=n).astype(float)
    letter, sign, upper = LETTER[data], SIGN[data], UPPER[data]
    capital = np.concatenate([[0], np.cumsum(upper)])
    shouted = (capital[ends] - capital[starts] == ends - starts) & (ends - starts > 1)
    swap = np.zeros(len(data), bool)
    if len(data) > 2:
        swap[1:-1] = _SWAP[data[1:-1]] & letter[:-2] & letter[2:]
        inner = offs[1:-1]
        swap[inner[inner < len(data)]] = False
    spelled = np.zeros(n)
    if swap.any():
        lexicon, raw = set(LEXICON), data.tobytes()
        ts, te, toff = words(data, offs, LETTER | _SWAP)
        swaps = np.concatenate([[0], np.cumsum(swap)])
        times = swaps[te] - swaps[ts]
        for k in np.flatnonzero((times > 0) & (te - ts <= _MOST_SPELLED)).tolist():
            if raw[ts[k] : te[k]].lower().translate(_LEET).decode("utf-8", "ignore").strip("*") in lexicon:
                spelled[np.searchsorted(toff, k, "right") - 1] += times[k]
    twice = np.zeros(len(data), bool)
    twice[1:] = sign[1:] & (data[1:] == data[:-1])
    twice[offs[1:-1][offs[1:-1] < len(data)]] = False
    hits = of_words(hit)
    cols = [
        np.log1p(count), of_words(lexical), of_words(lexical) / per_word, of_words(strong), of_words(strong) / per_word, of_words(best > 0.7) / per_word,
        of_words(best) / per_word, most, distinct, of_words(person) / per_word, of_words(hit & near) / np.maximum(hits, 1), hits,
        byte_sum(upper) / per_byte, of_words(shouted) / per_word, byte_sum(data == 33) / per_byte, byte_sum(data == 63) / per_byte, byte_sum(sign) / per_byte,
        byte_sum(twice) / per_byte, byte_sum(DIGIT[data]) / per_byte, byte_sum(swap) / per_word, spelled, byte_sum(data >= 128) / per_byte,
    ]
    return np.stack(cols, axis=1).astype(np.float64)


def _sample_features(by_fold: dict[int, tuple[np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in chunks(batches):
            fold = part.column(1).to_numpy(zero_copy_only=False)
            x = np.zeros((part.num_rows, FEATURES))
            for f, stems in by_fold.items():
                if (fold == f).any():
                    x[fold == f] = features(data, offs, stems)[fold == f]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "fold", "x"])

    return run


def fit(sample: DataFrame) -> dict:
    """The model from ``sample(y, fold, text)``, whose size the caller bounds."""
    other = {0: learn_stems(sample, (1,)), 1: learn_stems(sample, (0,))}
    rows = sample.select("y", "fold", "text").mapInArrow(_sample_features(other), "y int, fold int, x array<double>").collect()
    rows.sort(key=lambda r: (r.fold, r.y, r.x))  # the fit doesn't depend on the order of partitions
    x = np.array([r.x for r in rows]).reshape(len(rows), FEATURES)
    y, fold = np.array([r.y for r in rows], float), np.array([r.fold for r in rows])
    unseen = np.zeros(len(rows))
    for f in (0, 1):
        if (fold == f).any():
            unseen[fold == f] = fit_trees(x[fold != f], y[fold != f]).probability(x[fold == f])
    return {"stems": learn_stems(sample, (0, 1)), "trees": fit_trees(x, y), "knots": isotonic(unseen, y)}


def _score(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in chunks(batches):
            p = calibrated(model["trees"].probability(features(data, offs, model["stems"])), model["knots"])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.clip(p, 0, 1))], names=["id", "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, modulus: int = 3, rest: int = 1, most_labelled: int = 12_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted), one row for each row of ``docs``; ``labels(id, toxic)``.

    At most ``most_labelled`` labelled rows are learned from, whatever the size of the tables. Null text counts as empty
    and gets a score too; ids may be null (held out) or repeated. Without labels of both kinds the score is the base rate.
    """
    scratch = Scratch(docs.sparkSession)
    sample = scratch.write(labelled_sample(docs, labels, "toxic", modulus, rest, most_labelled, id_col, text_col), "sample")
    model = fit(sample)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    scored = rows.mapInArrow(_score(model), f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id"), modulus, rest).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
