r"""Source divergence audit: how far the sources of each language differ, and in which terms, by sorted streams.

Terms are `[^\x00-\x40\x5B-\x60\x7B-\x7F]+` with A-Z lower-cased. A language keeps the terms that stand in at least
`LEAST` of its documents. Work goes in two sorted passes, each a repartition, a sort inside partitions and a scan
that holds a bounded number of rows:

1. Tokens are sorted by (lang, source, term, document) inside each block of texts and scanned into partial runs
   (document frequency, count); the document is used up there, as no document is in two blocks. Runs that many
   documents of a task share are merged before they leave it, so a frequent term costs a row for each task and source.
   Partial runs are dealt by (lang, term), sorted by (lang, term, source) and scanned by run length: a term's rows
   leave as soon as its document frequency has reached LEAST (at most LEAST - 1 rows wait), its total at its end.
2. What is kept is dealt by hash of the term, sorted by (lang, tile, term, source) behind the tile's sources, and
   scanned into partial sums for each pair of sources and each source's best terms. A tile is two blocks of some SIDE
   sources of a language (one block with itself included), so a task holds one tile's sums whatever the number of
   sources. Terms absent from both sources of a pair are not streamed: each adds the same value, multiplied at the end.

All arithmetic is in whole numbers and exact up to 9e15 tokens a language.

Nulls in text, lang and source count as ''. Every row is a document: rows that repeat a doc_id or a text count each.
Texts without terms, also empty ones, only make their group known. Very long texts are handled whole. Of equal values
the smaller item by UTF-8 ranks first. A source alone in its language has no pairs, a language without kept terms
has pairs of value 0 and no terms. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .scratch import Scratch
from .text import blocks, column, distinct_words

LEAST, RANKS, SIDE = 10, 10, 192
#: Rows of partial runs that a task holds before it lets the rare ones go, and documents from which a run stays.
HELD, FREQUENT = 1 << 20, 16
#: Numbers in one dense matrix of a tile.
CELLS = 1 << 20
LETTERS = np.ones(256, bool)
LETTERS[97:123] = LETTERS[128:] = False

PARTIAL = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("docs", pa.int64()), ("n", pa.int64())])
KEPT = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64())])
SUMS = pa.schema([("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64()), ("terms", pa.int64()), ("absent", pa.int64()), ("v", pa.int64())])


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in schema)


def changes(table: pa.Table, *names: str) -> np.ndarray:
    """Where a new run of the named columns starts (at 0 too)."""
    new = np.zeros(len(table), bool)
    new[:1] = True
    for name in names:
        c = table[name].combine_chunks() if isinstance(table[name], pa.ChunkedArray) else table[name]
        if len(c) > 1:
            new[1:] |= pc.fill_null(pc.not_equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False) | (c.is_null().to_numpy(zero_copy_only=False)[1:] != c.is_null().to_numpy(zero_copy_only=False)[:-1])
    return np.flatnonzero(new)


def block_runs(block) -> pa.Table:
    """Partial runs of a block's texts: for each (lang, source, term) its documents and its places."""
    starts, ends, first = block.words(LETTERS)
    words, term = distinct_words(block, starts, ends, LETTERS)
    lang, source = (column(block.rows, c).dictionary_encode() for c in ("lang", "source"))
    group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    doc = np.repeat(np.arange(len(block)), np.diff(first))
    key = group[doc] * max(1, len(words)) + term
    order = np.argsort(key, kind="stable")  # documents stay in their order inside a run
    key, doc = key[order], doc[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    begins = np.ones(len(key), np.int64)
    begins[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    docs = np.add.reduceat(begins, at) if len(at) else np.zeros(0, np.int64)
    g, t = np.divmod(key[at], max(1, len(words)))
    a, b = np.divmod(g, max(1, len(source.dictionary)))
    return pa.table([lang.dictionary.take(pa.array(a)), words.take(pa.array(t)).cast(pa.large_string()).cast(pa.string()), source.dictionary.take(pa.array(b)), pa.array(docs), pa.array(np.diff(np.append(at, len(key))))], schema=PARTIAL)


def partial_runs(docs: DataFrame) -> DataFrame:
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]

    def merged(held: list[pa.Table]) -> pa.Table:
        rows = pa.concat_tables(held).group_by(["lang", "term", "source"], use_threads=False).aggregate([("docs", "sum"), ("n", "sum")])
        return rows.rename_columns({"docs_sum": "docs", "n_sum": "n"}).select(PARTIAL.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for block in blocks(batches, lower=True, size=1 << 23):
            held.append(block_runs(block))
            size += len(held[-1])
            if size >= HELD:
                rows = merged(held)
                stay = pc.greater_equal(rows["docs"], FREQUENT)
                if pc.sum(stay).as_py() > HELD // 2:
                    stay = pc.greater(rows["docs"], rows["docs"].length() + (1 << 60))  # too many: all go
                yield from rows.filter(pc.invert(stay)).combine_chunks().to_batches()
                held = [rows.filter(stay)]
                size = len(held[0])
        if held:
            yield from merged(held).combine_chunks().to_batches()

    return docs.select(*text).mapInArrow(run, ddl(PARTIAL))


def kept_terms(partial: DataFrame) -> DataFrame:
    """lang, term, source, n for terms in at least LEAST documents of their language; a row without source holds the term's total."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of the term that is under way and not let go yet, and the documents and places of those that are
        waiting, gone = PARTIAL.empty_table(), (0, 0)

        def step(table: pa.Table, last: bool):
            nonlocal waiting, gone
            at = changes(table, "lang", "term", "source")
            docs, n = (np.add.reduceat(table[c].to_numpy(), at) for c in ("docs", "n"))
            rows = table.take(pa.array(at)).set_column(3, "docs", pa.array(docs)).set_column(4, "n", pa.array(n))
            term = changes(rows, "lang", "term")
            seen, total = (np.add.reduceat(x, term) for x in (docs, n))
            seen[0] += gone[0]
            total[0] += gone[1]
            ends = np.append(term[1:], len(rows))
            enough = seen >= LEAST
            leave = np.repeat(enough, ends - term)
            if not last:  # the last row's source may go on, and so may its term
                if enough[-1]:
                    leave[-1] = False
                    gone = (int(seen[-1] - docs[-1]), int(total[-1] - n[-1]))
                    waiting = rows.slice(len(rows) - 1)
                else:
                    gone, waiting = (0, 0), rows.slice(int(term[-1]))
                enough[-1] = False
            yield from rows.filter(pa.array(leave)).select(KEPT.names).combine_chunks().to_batches()
            done = rows.take(pa.array(term[enough]))
            yield from pa.table([done["lang"], done["term"], pa.nulls(len(done), pa.string()), pa.array(total[enough])], schema=KEPT).combine_chunks().to_batches()

        for batch in batches:
            if batch.num_rows:
                yield from step(pa.concat_tables([waiting, pa.Table.from_batches([batch]).cast(PARTIAL)]).combine_chunks(), False)
        if len(waiting):
            yield from step(waiting.combine_chunks(), True)

    return partial.repartition("lang", "term").sortWithinPartitions("lang", "term", "source").mapInArrow(scan, ddl(KEPT))


def shares(count: np.ndarray, of: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * count / of), in steps of a thousand so that nothing overflows."""
    of = np.maximum(of, 1)
    q, r = np.divmod(count, of)
    for _ in range(3):
        more, r = np.divmod(r * 1000, of)
        q = q * 1000 + more
    return q + 1


def far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


class Tile:
    """Sums of the pairs of two blocks of sources, and the best terms of a block with itself, while terms stream by."""

    def __init__(self, lang: str, a: int, b: int):
        self.lang, self.a, self.b, self.heads, self.rows = lang, a, b, {}, []
        self.ready = False

    def head(self, source: str, block: int, n: int, v: int, all_n: int) -> None:
        self.heads[source] = (block, n, v, all_n)

    def start(self) -> None:
        self.names = sorted(self.heads)
        self.number = pa.array(self.names, pa.string())
        block, n, v, all_n = (np.array(x, np.int64) for x in zip(*(self.heads[s] for s in self.names), strict=True))
        self.of, self.v, self.all_of = n + 2 * v, int(v[0]), int(all_n[0] + 2 * v[0])
        self.pairs = [(i, np.flatnonzero((block == self.b) & (np.arange(len(block)) > i if self.a == self.b else True))) for i in np.flatnonzero(block == self.a)]
        self.sums = np.zeros((len(block), len(block)), np.int64)
        self.terms, self.best, self.ready = 0, [[] for _ in self.names], True

    def add(self, rows: pa.Table, last: bool) -> None:
        """rows: term, source, n, sorted; the last term may go on in the next call unless last is set."""
        if not self.heads:  # no source has this block's number
            return
        if not self.ready:
            self.start()
        self.rows.append(rows)
        if not last and sum(map(len, self.rows)) * len(self.names) < CELLS:
            return
        rows = pa.concat_tables(self.rows).combine_chunks()
        self.rows = []
        at = changes(rows, "term")
        if not last and len(at):
            self.rows = [rows.slice(int(at[-1]))]
            rows, at = rows.slice(0, int(at[-1])), at[:-1]
        step = max(1, CELLS // len(self.names))
        for k in range(0, len(at), step):
            lo, hi = int(at[k]), int(at[k + step]) if k + step < len(at) else len(rows)
            self.dense(rows.slice(lo, hi - lo), at[k : k + step] - lo)

    def dense(self, rows: pa.Table, at: np.ndarray) -> None:
        term = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(rows))))
        n, where = rows["n"].to_numpy(), pc.index_in(rows["source"].combine_chunks(), self.number)
        real = where.is_valid().to_numpy(zero_copy_only=False)
        count = np.zeros((len(at), len(self.names)), np.int64)
        count[term[real], where.drop_null().to_numpy()] = n[real]
        p = shares(count + 2, self.of)
        for i, js in self.pairs:
            self.sums[i, js] += far(p[:, i : i + 1], p[:, js]).sum(axis=0)
        self.terms += len(at)
        if self.a == self.b:
            total = np.zeros(len(at), np.int64)
            total[term[~real]] = n[~real]
            q = shares(total + 2, np.int64(self.all_of))
            words = rows["term"].take(pa.array(at))
            for i in range(len(self.names)):
                k = np.flatnonzero((count[:, i] > 0) & (p[:, i] > q))
                value = far(p[k, i], q[k])
                if len(k) > RANKS:
                    top = np.flatnonzero(value >= np.partition(value, len(value) - RANKS)[len(value) - RANKS])
                    k, value = k[top], value[top]
                first = np.argsort(-value, kind="stable")[:RANKS]  # terms ascend, so of equal values the smaller stays
                new = list(zip(value[first].tolist(), words.take(pa.array(k[first])).to_pylist(), strict=True))
                self.best[i] = sorted(self.best[i] + new, key=lambda x: -x[0])[:RANKS]

    def out(self) -> pa.RecordBatch:
        self.add(pa.table([pa.array([], pa.string()), pa.array([], pa.string()), pa.array([], pa.int64())], ["term", "source", "n"]), True)
        if not self.heads:
            return pa.RecordBatch.from_pylist([], SUMS)
        none = shares(np.full(len(self.names), 2), self.of)
        rows = [("pair", self.lang, self.names[i], self.names[j], int(self.sums[i, j]), self.terms, int(far(none[i], none[j])), self.v) for i, js in self.pairs for j in js]
        rows += [("term", self.lang, self.names[i], word, value, None, None, None) for i, best in enumerate(self.best) for value, word in best]
        return pa.record_batch([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(SUMS)], schema=SUMS)


def tile_sums(rows: DataFrame) -> DataFrame:
    """rows: lang, a, b, term, source, n, block, v, all_n, in partitions of whole terms; those without a term name a tile's sources."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = None
        for batch in batches:
            table = pa.Table.from_batches([batch]).combine_chunks()
            if not len(table):
                continue
            at = changes(table, "lang", "a", "b")
            for lo, hi in zip(at, np.append(at[1:], len(table)), strict=True):
                part = table.slice(int(lo), int(hi - lo))
                key = tuple(part[c][0].as_py() for c in ("lang", "a", "b"))
                if tile is None or (tile.lang, tile.a, tile.b) != key:
                    if tile is not None:
                        yield tile.out()
                    tile = Tile(*key)
                heads = int(part["term"].null_count)  # they come first
                for r in part.slice(0, heads).select(["source", "block", "n", "v", "all_n"]).to_pylist():
                    tile.head(*r.values())
                if heads < len(part):
                    tile.add(part.slice(heads).select(["term", "source", "n"]).cast(pa.schema([("term", pa.string()), ("source", pa.string()), ("n", pa.int64())])), False)
        if tile is not None:
            yield tile.out()

    return rows.mapInArrow(scan, ddl(SUMS))


def source_divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: all pairs of sources of a language, and each source's first terms."""
    spark, s = docs.sparkSession, Scratch(docs.sparkSession)
    kept = s.keep(kept_terms(partial_runs(docs)), "kept")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    groups = docs.select(name("lang"), name("source")).distinct()
    totals = kept.where("source is null").groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("all_n"))
    sizes = kept.where("source is not null").groupBy("lang", "source").agg(F.sum("n").alias("n"))
    number = groups.groupBy("lang").agg(F.ceil(F.count("*") / SIDE).cast("int").alias("sides"))
    heads = groups.join(sizes, ["lang", "source"], "left").join(totals, "lang", "left").join(number, "lang").na.fill(0, ["n", "v", "all_n"])
    block = F.pmod(F.xxhash64("source"), F.col("sides").cast("long")).cast("int").alias("block")
    heads = s.keep(heads.select("lang", "source", "n", "v", "all_n", "sides", block), "sources")
    # one row a language
    sides = heads.groupBy("lang").agg(F.max("sides").alias("sides"))
    slots = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = kept.join(sides, "lang").select("lang", "term", "source", "n", block, *[F.lit(0).cast("long").alias(c) for c in ("v", "all_n")], F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("other"), F.pmod(F.xxhash64("lang", "term"), F.lit(slots)).cast("int").alias("slot"))
    first = heads.select("lang", F.lit(None).cast("string").alias("term"), "source", "n", "block", "v", "all_n", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("other"))
    first = first.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    # a total, which has no source, goes to the tile of each block with itself
    mine = F.coalesce(F.when(F.col("term").isNotNull() & F.col("source").isNull(), F.col("other")), F.col("block"))
    dealt = rows.unionByName(first).withColumn("a", F.least(mine, "other")).withColumn("b", F.greatest(mine, "other"))
    dealt = dealt.repartition(slots // 4, "slot", "a", "b").sortWithinPartitions("lang", "a", "b", "term", "source").drop("slot", "other")
    sums = s.keep(tile_sums(dealt), "sums")
    pairs = sums.where("part = 'pair'").groupBy("part", "lang", "source", "item").agg((F.sum("value") + (F.max("v") - F.sum("terms")) * F.max("absent")).alias("value"))
    both = pairs.unionByName(pairs.select("part", "lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    ranked = both.unionByName(sums.where("part = 'term'").select(*both.columns))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= RANKS)).select("lang", "source", "part", "item", "value", "rank")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (s.n + 2 * v.v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (k.n + 2)) // (v.n + 2 * v.v)::HUGEINT AS q
  FROM s JOIN v ON v.lang = s.lang JOIN k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
w AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(w.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN w ON w.lang = a.lang AND w.source = a.source AND w.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
r AS (SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM x)
SELECT * FROM r WHERE part = 'pair' OR rank <= 10
"""
