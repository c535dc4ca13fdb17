"""Toxicity classifier with counterfactual regularisation.

A logistic model over the presence of words and word beginnings (4 to 6 bytes, which catch compounds). It is
fitted on at most `per_class` labelled documents of each class (those with the smallest hash of doc_id),
weighted back to the classes' shares among all labels. Features are the `most` with the largest chi-square
between the classes. In labelled documents that name identity groups the terms are swapped for others of the
same kind; into each of the others one term is inserted, chosen by a hash of the text. Listed terms need not stand in a
corpus, so terms that take each other's place there are learned from the sample too (`learned_kinds`): words among the
features that don't speak for the label (no more frequent in toxic texts, or chi-square below NEUTRAL) are of one kind if they stand between the same
neighbours (cosine of their neighbours' counts of ALIKE or more, at most KIND words a kind); up to SWAPS of a document's
learned terms, chosen by hash, are swapped one at a time for the next of their kind. Squared changes of the logit
are penalised, those of swaps and of insertions each by their mean, so a neutral mention does not raise a score.

The ridge is that of RIDGES with the least log loss on a fifth of the sample (by hash of doc_id), fitted on the
rest, which also gives the features; then the whole sample is fitted. Held-out documents have no part in it.

Every row and whole text is scored. Null and empty texts have no features and get the score of the intercept.
Null labels are ignored, of several labels of one document the highest counts. Of different texts of one
labelled doc_id the smallest is learned from. Without labels of both classes
every score is the share of toxic labels (0 without any). Rows that repeat a doc_id are scored each. An empty
table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .scratch import Scratch, columns
from .text import MASK, PUNCT, Block, blocks, column, mix, word_hash

PER_CLASS, MOST, PENALTY, THRESHOLD = 9000, 4096, 1.0, 0.3
#: Largest first; the first serves where one of the two parts of the sample lacks a class.
RIDGES = (3e-3, 1e-3, 3e-4, 1e-4, 3e-5, 1e-5)
PREFIXES = (4, 5, 6)
#: Chi-square from which a word that toxic texts have more often is never swapped; likeness and size of learned kinds; their terms swapped in a document; places for neighbours on each side.
NEUTRAL, ALIKE, KIND, SWAPS, SIDES = 3.84, 0.6, 16, 4, 128

#: Identity terms by kind, English, French, German and Spanish; terms of one kind can be swapped.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "citizens", "refugees"),
    ("blind", "deaf", "disabled"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("immigrés", "citoyens", "réfugiés"),
    ("aveugles", "sourds", "handicapés"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden", "buddhisten", "atheisten"),
    ("einwanderer", "bürger", "flüchtlinge"),
    ("blinde", "gehörlose", "behinderte"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("inmigrantes", "ciudadanos", "refugiados"),
    ("ciegos", "sordos", "discapacitados"),
)
TERMS = [t for kind in IDENTITY_TERMS for t in kind]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all features and the number of the text each is from, with repeats."""
    starts, ends, first = block.words(PUNCT)
    doc = np.repeat(np.arange(len(block)), np.diff(first))
    n = ends - starts
    parts, docs = [block.hashes(starts, ends)], [doc]
    heads = block.heads(starts)
    for k in PREFIXES:
        long = n > k
        parts.append(mix((heads[long] & MASK[k]) + np.uint64(k << 56)))
        docs.append(doc[long])
    return np.concatenate(parts), np.concatenate(docs)


class Vocabulary:
    """Numbers of chosen features."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.sort(hashes.astype(np.uint64))
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.sorted >> np.uint64(44)).astype(np.int64)] = True

    def __call__(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Text and feature numbers, each pair once."""
        h, doc = features(block)
        hit = self.seen[(h >> np.uint64(44)).astype(np.int64)]
        h, doc = h[hit], doc[hit]
        k = np.searchsorted(self.sorted, h)
        ok = k < len(self.sorted)
        ok[ok] = self.sorted[k[ok]] == h[ok]
        pairs = np.unique(doc[ok] * np.int64(len(self.sorted) or 1) + k[ok])
        return pairs // (len(self.sorted) or 1), pairs % (len(self.sorted) or 1)


def counterfactuals(text: str) -> list[str]:
    """The text with the identity terms of one kind replaced by each other term of that kind."""
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    out = []
    for kind in IDENTITY_TERMS:
        term = re.compile(r"(?<![0-9a-z\x80-\U0010ffff])(" + "|".join(kind) + r")(?![0-9a-z\x80-\U0010ffff])")
        if term.search(low):
            out += [term.sub(lambda m, t=t, kind=kind: t if m[1] != t else kind[kind.index(t) - 1], low) for t in kind]
    return out


def contexts(sample: DataFrame, words: np.ndarray) -> DataFrame:
    """word, place, n: how often neighbours of the words (sorted hashes) stand there, by hash; places from SIDES on are to the right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, lower=True):
            starts, ends, first = block.words(PUNCT)
            doc, h = np.repeat(np.arange(len(block)), np.diff(first)), block.hashes(starts, ends)
            k = np.minimum(np.searchsorted(words, h), len(words) - 1)
            hit = np.flatnonzero(words[k] == h) if len(h) else np.zeros(0, np.int64)
            at, place = [], []
            for step, base in ((-1, 0), (1, SIDES)):
                near = hit + step
                ok = (near >= 0) & (near < len(h))
                ok[ok] = doc[near[ok]] == doc[hit[ok]]
                at.append(hit[ok])
                place.append(base + (h[near[ok]] % np.uint64(SIDES)).astype(np.int64))
            at, place = np.concatenate(at), np.concatenate(place)
            key, one, n = np.unique(k[at] * np.int64(2 * SIDES) + place, return_index=True, return_counts=True)
            found = [block.bytes[starts[i] : ends[i]] for i in at[one]]
            yield pa.record_batch([pa.array(found, pa.binary()), pa.array((key % (2 * SIDES)).astype(np.int32)), pa.array(n)], ["word", "place", "n"])

    return sample.mapInArrow(run, "word binary, place int, n long").groupBy("word", "place").agg(F.sum("n").alias("n"))


def learned_kinds(rows: list[tuple[bytes, int, int]]) -> list[tuple[str, ...]]:
    """Kinds of words with like neighbours. rows: word, place, n. The most frequent word that fits no earlier kind begins one."""
    words = sorted({bytes(r[0]) for r in rows})
    if not words:
        return []
    number, x = {w: i for i, w in enumerate(words)}, np.zeros((len(words), 2 * SIDES))
    for w, place, n in rows:
        x[number[bytes(w)], place] = n
    total, x = x.sum(axis=1), np.log1p(x)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    kinds: list[list[int]] = []
    for i in np.lexsort((np.arange(len(words)), -total)):
        near = x[[k[0] for k in kinds]] @ x[i] if kinds else np.zeros(0)
        fits = [j for j in np.argsort(-near, kind="stable")[:8] if near[j] >= ALIKE and len(kinds[j]) < KIND]
        if fits:
            kinds[fits[0]].append(i)
        else:
            kinds.append([i])
    return [tuple(words[i].decode("utf-8", "replace") for i in k) for k in kinds if len(k) > 1]


def swapped(text: str, kinds: list[tuple[str, ...]], of: dict[str, int]) -> list[str]:
    """The text's words with one learned term at a time replaced by the next of its kind. of: each term's kind."""
    import re

    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    terms = sorted({w for w in words if w in of}, key=lambda w: (zlib.crc32(w.encode() + text[:64].encode("utf-8", "replace")), w))[:SWAPS]
    out = []
    for t in terms:
        kind = kinds[of[t]]
        new = kind[(kind.index(t) + 1) % len(kind)]
        out.append(" ".join(new if w == t else w for w in words))
    return out


def count_features(sample: DataFrame) -> DataFrame:
    """sample: text, toxic. Gives feature, pos, neg: documents of each class that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, lower=True):
            h, doc = features(block)
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            h, toxic = h[new], column(block.rows, "toxic").to_numpy()[doc[new]]
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
            n = np.diff(np.append(at, len(h)))
            pos = np.add.reduceat(toxic.astype(np.int64), at) if len(h) else np.zeros(0, np.int64)
            yield pa.record_batch([pa.array(h[at].view(np.int64)), pa.array(pos), pa.array(n - pos)], ["feature", "pos", "neg"])

    return sample.mapInArrow(run, "feature long, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def examples(sample: DataFrame, vocabulary: Vocabulary, kinds: list[tuple[str, ...]] = []) -> DataFrame:
    """sample: text, toxic, aside; kinds: learned ones. Gives toxic, has (feature numbers), pairs, aside.

    A pair is a counterfactual of the text: the features that it lacks, those that it has more, and whether a term was
    inserted (or else swapped).
    """

    of = {t: i for i, kind in enumerate(kinds) for t in kind}

    def numbers(texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for block in blocks([pa.record_batch([pa.array(texts, pa.string())], ["text"])] if texts else [], lower=True):
            doc, k = vocabulary(block)
            ends = np.cumsum(np.bincount(doc, minlength=len(block)))
            out += [x.tolist() for x in np.split(k, ends[:-1])]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, some = numbers(TERMS), pa.list_(pa.int32())
        pair = pa.list_(pa.struct([("less", some), ("more", some), ("inserted", pa.bool_())]))
        for batch in batches:
            texts = [t or "" for t in column(batch, "text").to_pylist()]
            has, pairs = numbers(texts), []
            for text, mine in zip(texts, map(set, has), strict=True):
                others = [(set(x), False) for x in numbers(counterfactuals(text) + swapped(text, kinds, of))] or [(mine.union(own[zlib.crc32(text.encode()) % len(own)]), True)]
                pairs.append([{"less": sorted(mine - x), "more": sorted(x - mine), "inserted": new} for x, new in others])
            yield pa.record_batch([column(batch, "toxic"), pa.array(has, some), pa.array(pairs, pair), column(batch, "aside")], ["toxic", "has", "pairs", "aside"])

    return sample.mapInArrow(run, "toxic int, has array<int>, pairs array<struct<less:array<int>,more:array<int>,inserted:boolean>>, aside boolean")


class Model:
    def __init__(self, vocabulary: Vocabulary, weights: np.ndarray, bias: float):
        self.vocabulary, self.weights, self.bias = vocabulary, weights, bias
        #: Learned kinds of terms, and the number of counterfactuals with a term swapped.
        self.kinds, self.swaps = [], 0

    def score(self, block: Block) -> np.ndarray:
        doc, k = self.vocabulary(block)
        x = self.bias + np.bincount(doc, self.weights[k], len(block))
        return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def minimise(rows: list, size: int, share: float, penalty: float = PENALTY, ridge: float = RIDGES[0], steps: int = 300) -> tuple[np.ndarray, float]:
    """Adam on all rows. rows: toxic, has, pairs (less, more, inserted); share: of toxic labels."""
    if not rows:  # labelled documents that aren't in the table
        return np.zeros(size), float(np.log(max(share, 1e-12) / max(1 - share, 1e-12)))
    y = np.array([r[0] for r in rows], float)
    flat = lambda xs: (np.repeat(np.arange(len(xs)), [len(x) for x in xs]), np.concatenate([np.zeros(0, np.int64), *[np.asarray(x, np.int64) for x in xs]]))
    doc, k = flat([r[1] for r in rows])
    pairs = [p for r in rows for p in r[2]]
    a, b = flat([p[0] for p in pairs]), flat([p[1] for p in pairs])
    inserted = np.array([p[2] for p in pairs], bool)
    share_of = penalty / np.maximum(np.where(inserted, inserted.sum(), (~inserted).sum()), 1)
    cf_doc, cf_k, cf_v = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), np.concatenate([np.ones(len(a[0])), -np.ones(len(b[0]))])
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9)) / len(y)
    w, bias = np.zeros(size + 1), np.log(max(share, 1e-6) / max(1 - share, 1e-6))
    w[size] = bias
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        x = w[size] + np.bincount(doc, w[k], len(y))
        g = (1 / (1 + np.exp(-x)) - y) * weight
        grad = np.append(np.bincount(k, g[doc], size) + ridge * w[:size], g.sum())
        if pairs:
            d = np.bincount(cf_doc, cf_v * w[cf_k], len(pairs)) * share_of
            grad[:size] += 2 * np.bincount(cf_k, cf_v * d[cf_doc], size)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.1 / (1 + 5 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:size], float(w[size])


def log_loss(rows: list, share: float, weights: np.ndarray, bias: float) -> float:
    """Mean over rows: toxic, has; the classes count by their share of labels."""
    y = np.array([r[0] for r in rows])
    x = bias + np.array([weights[r[1]].sum() for r in rows])
    loss = np.logaddexp(0, np.where(y == 1, -x, x))
    return share * loss[y == 1].mean() + (1 - share) * loss[y == 0].mean()


def choose_ridge(rows: list, size: int, share: float, penalty: float = PENALTY) -> float:
    """rows: toxic, has, pairs, aside."""
    apart, rest = [r for r in rows if r[3]], [r for r in rows if not r[3]]
    if any(len({r[0] for r in part}) < 2 for part in (apart, rest)):
        return RIDGES[0]
    return min(RIDGES, key=lambda ridge: log_loss(apart, share, *minimise(rest, size, share, penalty, ridge)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most: int = MOST, penalty: float = PENALTY) -> Model:
    labels = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out())
    sizes = dict(labels.groupBy("toxic").count().collect())
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    if not (sizes.get(0) and sizes.get(1)):
        return Model(Vocabulary(np.zeros(0, np.uint64)), np.zeros(0), float(np.log(max(share, 1e-12) / max(1 - share, 1e-12))))
    order = [F.xxhash64("doc_id"), "doc_id"]

    def first(toxic: int) -> DataFrame:
        # a share of the hashes that holds half as many again, so that the task which orders them isn't sent all labels
        high = min(2**63 - 1, -(2**63) + (2**64 * (per_class + per_class // 2 + 100)) // sizes[toxic])
        return labels.where((F.col("toxic") == toxic) & (order[0] <= high)).orderBy(*order).limit(per_class)

    some = first(1).unionByName(first(0))
    # at most 2 * per_class rows of a number and a flag
    sample = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id")
    sample = sample.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    aside = F.pmod(F.xxhash64("doc_id", F.lit("ridge")), F.lit(5)) == 0
    sample = Scratch(docs.sparkSession).keep(sample.select("text", "toxic", aside.alias("aside")), "labelled")
    rest = sample.where("not aside")
    counts = count_features(rest).where("pos + neg >= 4")
    found = dict(rest.groupBy("toxic").count().collect())
    p, n = found.get(1, 0), max(1, found.get(0, 0))
    df = F.col("pos") + F.col("neg")
    chi = F.pow(F.col("pos") - df * (p / (p + n)), F.lit(2)) / (df * (1 - df / (p + n + 1)))
    best = counts.select("feature", chi.alias("chi"), (F.col("pos") > df * (p / (p + n))).alias("speaks")).orderBy(F.desc("chi"), "feature").limit(most).collect()
    named = np.array([word_hash(t.encode()) for t in TERMS], np.uint64)
    vocabulary = Vocabulary(np.unique(np.append(np.array([r[0] for r in best], np.int64).view(np.uint64), named)))
    plain = np.sort(np.array([r[0] for r in best if not (r.speaks and r.chi >= NEUTRAL)], np.int64).view(np.uint64))
    # at most `most` words and 2 * SIDES places
    kinds = learned_kinds([tuple(r) for r in contexts(rest, plain).collect()]) if len(plain) else []
    # at most 2 * per_class rows of at most `most` numbers and the terms'
    found = examples(sample, vocabulary, kinds).toArrow().combine_chunks()
    has = found["has"].combine_chunks()
    lists = np.split(has.flatten().to_numpy(), np.cumsum(has.value_lengths().to_numpy())[:-1]) if len(has) else []
    pairs = [[(p["less"], p["more"], p["inserted"]) for p in x] for x in found["pairs"].to_pylist()]
    rows = list(zip(found["toxic"].to_pylist(), lists, pairs, found["aside"].to_pylist(), strict=True))
    size = len(vocabulary.sorted)
    model = Model(vocabulary, *minimise(rows, size, share, penalty, choose_ridge(rows, size, share, penalty)))
    model.kinds, model.swaps = kinds, sum(not p[2] for x in pairs for p in x)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`doc`, a struct of all columns of docs, and `score` in [0, 1] for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for block in blocks(batches, lower=True):
            yield pa.record_batch([column(block.rows, "doc"), pa.array(model.score(block))], ["doc", "score"])

    rows = docs.select(F.struct(*columns(docs)).alias("doc"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["doc"], T.StructField("score", T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = score(docs.select("doc_id", "text"), fit(docs, labels)).select("doc.doc_id", "score")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that toxicity() does not reject."""
    return score(docs, fit(docs, labels)).where(F.col("score") < THRESHOLD).select("doc.*")
