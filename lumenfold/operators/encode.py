"""Encoders: spectra to vectors. Binned vectors stay sparse rows (key, bin, value); dense ones are made only on request."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.metadata import infer_ion_mode
from ..functions.peaks import clean_peaks, finite, masked_inputs, padded_tokens, raw_masked_inputs, spectrum_record, valid_peaks, words
from ..functions.vectors import let, unit
from ..sources.cache import settled

MATRIX, CHUNK = 64 << 20, 8_192  # bytes of the vectors of a shard of words; rows multiplied at once


def _unit_rows(rows: DataFrame, key: str) -> DataFrame:
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(key)))
    return rows.withColumn("value", F.col("value") / F.greatest(norm, F.lit(1e-12)))


def _bins(rows: DataFrame, key: str, low: float, high: float, size: float, first: int = 0) -> DataFrame:
    n = math.ceil((high - low) / size)
    bin_ = F.floor((F.col("mz") - low) / size)
    return rows.withColumn("bin", bin_ + first).where(bin_.between(0, n - 1)).groupBy(key, "bin").agg(F.sum("intensity").alias("value"))


def exploded(spectra: DataFrame, key: str, clean: bool, *more: str) -> DataFrame:
    peaks = clean_peaks(F.col("peaks")) if clean else F.col("peaks")
    return spectra.select(key, *more, F.explode(valid_peaks(peaks, False)).alias("p")).select(key, *more, "p.mz", "p.intensity")


def binned(spectra: DataFrame, key: str = "library_index", low: float = 0.0, high: float = 2000.0, size: float = 0.1, clean: bool = True) -> DataFrame:
    """Unit-norm sums of intensity per m/z bin: key, bin, value."""
    return _unit_rows(_bins(exploded(spectra, key, clean), key, low, high, size), key)


def neutral_loss_binned(spectra: DataFrame, key: str = "library_index", low: float = 0.0, high: float = 2000.0, size: float = 0.1, loss_high: float = 1000.0, weight: float = 1.0, clean: bool = True) -> DataFrame:
    """Peak bins and weighted neutral-loss bins, each of unit norm, side by side, again of unit norm."""
    rows = exploded(spectra, key, clean, "precursor_mz")
    peaks = _unit_rows(_bins(rows, key, low, high, size), key)
    losses = rows.where(finite(F.col("precursor_mz"))).withColumn("mz", F.col("precursor_mz") - F.col("mz"))
    losses = _unit_rows(_bins(losses, key, 0.0, loss_high, size, math.ceil((high - low) / size)), key).withColumn("value", F.col("value") * weight)
    return _unit_rows(peaks.unionByName(losses), key)


def run_binned(spectra: DataFrame, key: str = "scan_index", low: float = 50.0, high: float = 1200.0, size: float = 1.0, losses: bool = False) -> DataFrame:
    """The same on raw peaks of a run, without cleaning; its default bins differ from the library's."""
    return neutral_loss_binned(spectra, key, low, high, size, clean=False) if losses else binned(spectra, key, low, high, size, clean=False)


def dense(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Sparse rows as one array of `size` per key."""
    entries = rows.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col("bin").cast("int"), "value"))).alias("m"))
    at = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return entries.select(key, at.cast("array<float>").alias("embedding"))


def keep_all(encoded: DataFrame, spectra: DataFrame, key: str, size: int) -> DataFrame:
    """A vector for every key of spectra: zeros of the given size where encoded has none."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), size)
    return spectra.select(key).distinct().join(encoded, key, "left").select(key, F.coalesce(F.col("embedding").cast("array<float>"), zeros).alias("embedding"))


def documents(spectra: DataFrame, key: str, decimals: int = 2, clean: bool = True, more: tuple[str, ...] = ()) -> DataFrame:
    """key, more, word, weight."""
    peaks = clean_peaks(F.col("peaks")) if clean else valid_peaks(F.col("peaks"))
    return spectra.select(key, *more, F.explode(words(peaks, decimals)).alias("w")).select(key, *more, "w.word", "w.weight")


def word_vectors(docs: DataFrame, vectors: DataFrame, key: str, power: float = 0.5, most: int = MATRIX) -> DataFrame:
    """sum(weight**power * vector) / sum(weight**power) over known words, of unit norm. vectors: word, vector, all of one size.

    Vectors are never copied to a document's words: a document's weights are summed by word, words are dealt into shards
    whose vectors take about `most` bytes, and a shard's documents into blocks; a task multiplies a block's weights by its
    shard's vectors. Only words that documents have are dealt, and with one shard the sums are not shuffled. Weights that
    are null, not finite or not above 0 and words with a null vector count for nothing. Documents without a known word
    drop out here; keep_all() gives them zeros.
    """
    word = docs.select("word").limit(0).union(vectors.select("word").limit(0)).schema["word"].dataType
    w = F.pow(F.when(finite(F.col("weight")) & (F.col("weight") > 0), F.col("weight")), F.lit(power))
    rows = docs.select(key, F.col("word").cast(word).alias("word"), w.cast("double").alias("w")).where("w IS NOT NULL AND word IS NOT NULL")
    used = rows.groupBy("word").agg(F.count("*").alias("n"))
    known = vectors.where(F.col("vector").isNotNull()).select(F.col("word").cast(word).alias("word"), F.col("vector").cast("array<double>").alias("vector"))
    known = settled(known.join(used, "word"))
    size = F.size("vector")
    n, least, largest = known.agg(F.count("*"), F.coalesce(F.min(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    if least != largest:
        raise ValueError(f"vectors have sizes {least} to {largest}")
    shards = max(1, -(-n * largest * 8 // most))
    shard, rows_each = F.pmod(F.xxhash64("word"), F.lit(shards)), max(1, most // (8 * max(1, largest)))
    known = known.withColumn("shard", shard)
    # a row a shard
    deal = F.broadcast(known.groupBy("shard").agg(F.ceil(F.sum("n") / rows_each).alias("blocks")))
    a = rows.groupBy(key, "word").agg(F.sum("w").alias("w")).withColumn("shard", shard).join(deal, "shard").withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks"))).drop("blocks")
    b = known.drop("n").join(deal, "shard").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    kind = StructType([docs.select(key).schema[0], StructField("v", ArrayType(DoubleType())), StructField("w", DoubleType())])
    means = a.groupBy("shard", "block").cogroup(b.groupBy("shard", "block")).applyInArrow(lambda x, y: _means(x, y, key, largest), kind)
    if shards > 1:
        means = means.groupBy(key).agg(Summarizer.mean(array_to_vector("v"), F.col("w")).alias("v")).withColumn("v", vector_to_array("v"))
    return means.select(key, let(F.col("v"), unit).alias("embedding"))


def _means(rows: pa.Table, known: pa.Table, key: str, size: int) -> pa.Table:
    """key, v, w: the weighted mean of the known words' vectors and the sum of their weights. rows: key, word, w; known: word, vector."""
    words = pa.concat_arrays(known["word"].chunks or [pa.array([], known.schema.field("word").type)]).dictionary_encode()
    rows = rows.append_column("at", pc.index_in(rows["word"], value_set=words.dictionary))
    rows = rows.filter(pc.is_valid(rows["at"]))
    keys = pa.concat_arrays(rows[key].chunks or [pa.array([], rows.schema.field(key).type)]).dictionary_encode("encode")
    code, at, w = keys.indices.to_numpy(zero_copy_only=False), rows["at"].to_numpy(), rows["w"].to_numpy()
    # a word may have several vectors
    place = words.indices.to_numpy(zero_copy_only=False)
    matrix, times = np.zeros((len(words.dictionary), size)), np.bincount(place, minlength=len(words.dictionary))
    np.add.at(matrix, place, pc.list_flatten(known["vector"]).to_numpy().reshape(len(place), size))
    order = np.argsort(code, kind="stable")
    code, at, w = code[order], at[order], w[order]
    sums = np.zeros((len(keys.dictionary), size))
    for first in range(0, len(code), CHUNK):
        c, p, x = (v[first : first + CHUNK] for v in (code, at, w))
        starts = np.flatnonzero(np.diff(c, prepend=-1))
        sums[c[starts]] += np.add.reduceat(matrix[p] * x[:, None], starts)
    total = np.bincount(code, w * times[at], minlength=len(sums))
    flat = pa.array((sums / total[:, None]).ravel())
    return pa.table({key: keys.dictionary, "v": pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * size), flat), "w": pa.array(total, pa.float64())})


def by_mode(docs: DataFrame, models: dict[str, DataFrame], key: str, mode: str = "ion_mode", power: float = 0.5) -> DataFrame:
    """word_vectors() with a model per ion mode; a mode without one uses the other; unknown counts as positive."""
    if not models:
        raise ValueError("no model")
    parts = []
    for name, other in (("positive", "negative"), ("negative", "positive")):
        mine = F.col(mode) == name if name == "negative" else F.coalesce(F.col(mode), F.lit("unknown")) != "negative"
        parts.append(word_vectors(docs.where(mine), models.get(name, models.get(other)), key, power))
    return parts[0].unionByName(parts[1])


def train_word_vectors(docs: DataFrame, key: str, size: int = 300, window: int = 500, min_count: int = 1, epochs: int = 20, seed: int = 1) -> DataFrame:
    """word, vector from Spark's Word2Vec. It trains hierarchical softmax, so it approximates negative sampling."""
    from pyspark.ml.feature import Word2Vec

    texts = docs.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "weight"))), lambda w: w.word).alias("words"))
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, maxIter=epochs, seed=seed, inputCol="words", outputCol="v").fit(texts)
    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))


def spec2vec(spectra: DataFrame, key: str, models: dict[str, DataFrame] | None = None, mode: str = "ion_mode", decimals: int = 2, power: float = 0.5, clean: bool = True, size: int = 300, **training) -> DataFrame:
    """Word vectors of every spectrum, by a model (word, vector) per ion mode; models that aren't given are trained here. No known word: zeros.

    A mode without spectra gets no model and a mode without a model takes the other's. Without a column `mode`
    all spectra count as positive. Inference only: give models.
    """
    held = spectra if mode in spectra.columns else spectra.withColumn(mode, F.lit("positive"))
    docs = documents(held, key, decimals, clean, (mode,))
    if models is None:
        negative = F.coalesce(F.col(mode) == "negative", F.lit(False))
        parts = {"positive": docs.where(~negative), "negative": docs.where(negative)}
        models = {name: train_word_vectors(part, key, size, **training) for name, part in parts.items() if not part.isEmpty()}
    if not models:
        return keep_all(spectra.select(key, F.lit(None).cast("array<float>").alias("embedding")), spectra, key, size)
    first = next(iter(models.values())).select(F.size("vector")).first()
    return keep_all(by_mode(docs, models, key, mode, power), spectra, key, first[0] if first else size)


def stored(df: DataFrame, key: str, candidates: tuple[str, ...] = ("DreaMS_embedding", "embedding", "embeddings")) -> DataFrame:
    """The first embedding column there is, of unit norm; a vector that is not finite is refused later by require_usable()."""
    held = {c.lower(): c for c in reversed(df.columns)}  # names count without regard to case
    name = next((held[c.lower()] for c in candidates if c.lower() in held), None)
    if name is None:
        raise ValueError(f"no embedding column among {candidates}")
    return df.select(key, unit(F.col(name)).cast("array<float>").alias("embedding"))


def external(spectra: DataFrame, key: str, load: Callable[[], Callable], columns: tuple[str, ...], size: int | None = None, batch_rows: int = 128, normalize: bool = True) -> DataFrame:
    """Vectors of a model that `load` brings up once per task; it maps a pandas frame of columns to a list of vectors (None: failed).

    With a size, a batch on which the model fails is given to it row by row, and rows that fail, aren't finite or
    have another size become zero vectors; V.require_usable() refuses a table of zeros. Without one errors are raised
    and failed rows are null. A vector of several positions (two dimensions) is averaged over them.
    """

    def flat(v) -> np.ndarray | None:
        x = None if v is None else np.asarray(v, np.float64)
        return x.mean(axis=0) if x is not None and x.ndim == 2 else x

    def checked(v) -> list[float]:
        x = flat(v)
        return x.tolist() if x is not None and x.shape == (size,) and np.isfinite(x).all() else [0.0] * size

    def guarded(model: Callable, rows: pd.DataFrame) -> list:
        try:
            found = list(model(rows))
            if len(found) == len(rows):
                return found
        except Exception:  # noqa: BLE001  any model, any error
            pass
        return [None] if len(rows) == 1 else [guarded(model, rows.iloc[i : i + 1])[0] for i in range(len(rows))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            found = []
            for at in range(0, len(batch), batch_rows):
                rows = batch[list(columns)].iloc[at : at + batch_rows]
                found += [flat(v) for v in model(rows)] if size is None else [checked(v) for v in guarded(model, rows)]
            yield pd.DataFrame({key: batch[key], "embedding": found})

    rows = spectra.select(key, *[c for c in columns if c != key]).mapInPandas(run, f"{key} long, embedding array<float>")
    return rows.withColumn("embedding", unit(F.col("embedding")).cast("array<float>")) if normalize else rows


def msbert(spectra: DataFrame, key: str, load: Callable[[], Callable], size: int | None = None, **inputs) -> DataFrame:
    """A model on padded tokens: columns token and intensity. Spectra that skip_invalid leaves out get zeros if the size is given."""
    rows = external(padded_tokens(spectra, key, **inputs), key, load, ("token", "intensity"), size)
    return rows if size is None else keep_all(rows, spectra, key, size)


def specemb(spectra: DataFrame, key: str, load: Callable[[], Callable], size: int | None = None, run: bool = False, normalize: bool = True, **inputs) -> DataFrame:
    """A model on padded peaks: columns mz, intensity and mask (true: padding). run: a run's peaks, without range and cleaning."""
    rows = raw_masked_inputs(spectra, key, **inputs) if run else masked_inputs(spectra, key, **inputs)
    return external(rows, key, load, ("mz", "intensity", "mask"), size, normalize=normalize)


def ms2deepscore(spectra: DataFrame, key: str, load: Callable[[], Callable], size: int | None = None, mode: str = "ion_mode", metadata: tuple[str, ...] = ("ION_MODE", "adduct")) -> DataFrame:
    """A model on records: columns peaks, precursor_mz, parent_mass, ionmode; the mode is a column's or inferred from the metadata there is."""
    held = [F.col(c) for c in metadata if c in spectra.columns]
    known = F.col(mode) if mode in spectra.columns else infer_ion_mode(*held) if held else F.lit("unknown")
    rows = spectra.select(key, spectrum_record(F.col("peaks"), F.col("precursor_mz"), known).alias("r")).select(key, "r.*")
    return external(rows, key, load, ("peaks", "precursor_mz", "parent_mass", "ionmode"), size)


#: The models behind msbert, specemb and ms2deepscore are no part of this library: `load` brings them. dreams reads stored vectors.
ENCODERS: dict[str, Callable[..., DataFrame]] = {
    "binned": binned, "neutral_loss_binned": neutral_loss_binned, "stored": stored, "dreams": stored, "spec2vec": spec2vec, "msbert": msbert, "specemb": specemb, "ms2deepscore": ms2deepscore,
}


def register(name: str, encoder: Callable[..., DataFrame]) -> None:
    """Adds or replaces an encoder."""
    ENCODERS[name.lower()] = encoder


def encode(name: str, spectra: DataFrame, key: str, **settings) -> DataFrame:
    if name.lower() not in ENCODERS:
        raise ValueError(f"no encoder {name}; there are {', '.join(sorted(ENCODERS))}")
    return ENCODERS[name.lower()](spectra, key, **settings)
