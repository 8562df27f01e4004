"""Operator 7: quality rules with n-gram perplexity.

A modified Kneser-Ney model of characters, a model for each language, is counted over all documents: tasks count the
n-grams of their rows, Spark sums them, and the lower orders, discounts, probabilities and back-off weights are joins and
aggregates over those counts. An n-gram is a number of ORDER * 12 bits; scoring holds sorted arrays of hashes of them with
log probabilities. They are dealt to shards of about SHARD_ROWS rows by the two letters before the last: all that the
back-off for a character looks up lies in the shard of the two letters before it. Shards are broadcast one by one, and a
task takes each batch of texts through one shard after another, so that neither the driver nor a worker holds the whole
model, whatever its size. Log probabilities are summed as whole numbers, which gives the same for any number of shards.
A document is rejected where its perplexity lies outside its language's band, which the quartiles of all documents give.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

ORDER = 5
#: Rows of a shard of the model, about (16 bytes each).
SHARD_ROWS = 1_000_000
#: Log probabilities are whole numbers of this share of 1 when they are summed.
UNIT = 1 << 24
#: Interquartile ranges of log perplexity from the lower and the upper quartile to the ends of the band, and the characters
#: at which a text's band is the square root of 2 as wide, since the mean of fewer letters varies more. Likewise the
#: documents of a language, whose quartiles and model vary more where they are few.
FENCES, SHORT_CHARS, FEW_DOCUMENTS = (1.25, 1.25), 500, 500
#: n-grams that a task holds before it passes its counts on, and characters that it takes at a time (numbers of 8 bytes
#: for each, several times over).
HELD_GRAMS, BATCH_CHARS = 1_000_000, 400_000
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = "#*$%&|<>"
_BEGIN = 1


def _letters() -> np.ndarray:
    """A 12-bit letter for each code point: those below 2,048 are themselves (digits 0, white space a space), others are hashed into the upper half."""
    code = np.arange(0x110000, dtype=np.uint32)
    out = np.where(code < 2048, code, 2048 + ((code * np.uint32(0x9E3779B9)) >> np.uint32(21))).astype(np.uint16)
    out[:9], out[9:14], out[ord("0") : ord("9") + 1] = 2, 32, ord("0")
    return out


_LETTERS: list[np.ndarray] = []


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams that end at each character, characters of each text); before a text stand ORDER - 1 beginnings."""
    if not _LETTERS:
        _LETTERS.append(_letters())
    lead = np.full(ORDER - 1, _BEGIN, np.uint16)
    parts, sizes = [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        parts += [lead, _LETTERS[0][code]]
        sizes[k] = len(code)
    if not parts:
        return np.zeros(0, np.int64), sizes
    row = np.concatenate(parts)
    if len(row) < ORDER:
        return np.zeros(0, np.int64), sizes
    key = np.zeros(len(row) - ORDER + 1, np.int64)
    for k in range(ORDER):
        key <<= 12
        key |= row[k : k + len(key)]
    return key[row[ORDER - 1 :] != _BEGIN], sizes


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        for first, texts in common.text_batches(batch, chars=BATCH_CHARS):
            yield batch.slice(first, len(texts)), texts


def _by_language(langs: list[str]) -> dict[str, list[int]]:
    found: dict[str, list[int]] = {}
    for k, lang in enumerate(langs):
        found.setdefault(lang, []).append(k)
    return found


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, gram, a: the number of times of each n-gram of the highest order in all texts (null lang: '')."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
            grams, inverse = np.unique(np.concatenate([g for g, _ in held[lang]]), return_inverse=True)
            return grams, np.bincount(inverse, np.concatenate([n for _, n in held[lang]])).astype(np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            for lang in held:
                grams, n = merged(lang)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], ["lang", "gram", "a"])
            held.clear()

        for rows, texts in _batches(batches):
            for lang, at in _by_language(rows.column("lang").to_pylist()).items():
                grams, n = np.unique(_grams([texts[k] for k in at])[0], return_counts=True)
                mine = held.setdefault(lang, [])
                mine.append((grams, n))
                size += len(grams)
                if len(mine) > 8:
                    size -= sum(len(g) for g, _ in mine)
                    held[lang] = [merged(lang)]
                    size += len(held[lang][0][0])
            if size > HELD_GRAMS:
                yield from flush()
                size = 0
        yield from flush()

    found = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), "text").mapInArrow(run, "lang string, gram long, a long")
    return found.groupBy("lang", "gram").agg(F.sum("a").alias("a"))


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """n, lang, gram, logp, backoff: interpolated modified Kneser-Ney log probabilities of the n-grams of every order, and
    the log weight that each leaves, as a context, to the order below."""
    tables = {order: common.write_work(counts, "grams")[0]}
    for n in range(order - 1, 0, -1):
        # lower orders count the distinct letters in front
        shorter = tables[n + 1].select("lang", F.col("gram").bitwiseAND(F.lit((1 << 12 * n) - 1)).alias("gram"))
        tables[n] = common.write_work(shorter.groupBy("lang", "gram").agg(F.count("*").alias("a")), "grams")[0]
    below, contexts, made = None, {}, []
    for n in range(1, order + 1):
        times = [F.sum((F.col("a") == k).cast("double")).alias(f"n{k}") for k in range(1, 5)]
        of = tables[n].groupBy("lang").agg(*times)
        y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))

        def discount(k: int) -> F.Column:
            found = F.lit(float(k)) - F.lit(k + 1.0) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}"))
            # where counts of counts are missing, a half for each
            return F.when((F.col("n1") > 0) & (F.col("n2") > 0) & (F.col(f"n{k}") > 0) & (found > 0) & (found < k), found).otherwise(F.lit(0.5 * min(k, 2)))

        # a row for each language
        of = of.withColumns({f"d{k}": discount(k) for k in (1, 2, 3)}).select("lang", "d1", "d2", "d3")
        own = tables[n].join(of, "lang").withColumn("d", F.when(F.col("a") == 1, F.col("d1")).when(F.col("a") == 2, F.col("d2")).otherwise(F.col("d3"))).withColumn("context", F.shiftright("gram", 12))
        context = own.groupBy("lang", "context").agg(F.sum("a").alias("total"), F.sum("d").alias("left"))
        context = common.write_work(context.select("lang", "context", "total", (F.col("left") / F.col("total")).alias("gamma")), "contexts")[0]
        contexts[n] = context
        own = own.select("lang", "gram", "a", "d", "context").join(context, ["lang", "context"])
        if below is None:
            letters = tables[1].groupBy("lang").agg((1.0 / (F.count("*") + 1)).alias("p_below"))
            own = own.join(letters, "lang")
        else:
            low = below.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("p_below"))
            own = own.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << 12 * (n - 1)) - 1))).join(low, ["lang", "suffix"])
        p = (F.col("a") - F.col("d")) / F.col("total") + F.col("gamma") * F.col("p_below")
        below = common.write_work(own.select("lang", "gram", p.alias("p")), "orders")[0]
        made.append((n, below))
    out = None
    for n, table in made:
        row = table.select(F.lit(n).alias("n"), "lang", "gram", F.log("p").alias("logp"))
        if n < order:
            weight = contexts[n + 1].select("lang", F.col("context").alias("gram"), F.log("gamma").alias("backoff"))
            row = row.join(weight, ["lang", "gram"], "left").withColumn("backoff", F.coalesce("backoff", F.lit(0.0)))
        else:
            row = row.withColumn("backoff", F.lit(0.0))
        row = row.select("n", "lang", "gram", "logp", "backoff")
        out = row if out is None else out.unionByName(row)
    # the share of a letter that no text has: what the first order leaves, over the letters and one more
    unseen = contexts[1].join(tables[1].groupBy("lang").agg(F.count("*").alias("v")), "lang").select(F.lit(0).alias("n"), "lang", F.lit(0).cast("long").alias("gram"), F.log(F.col("gamma") / (F.col("v") + 1)).alias("logp"), F.lit(0.0).alias("backoff"))
    return out.unionByName(unseen)


def _hash(grams: np.ndarray) -> np.ndarray:
    h = grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class HashArray:
    """Sorted 64-bit hashes with values; a table of leading bits shows where to begin."""

    def __init__(self, grams: np.ndarray, logp: np.ndarray, backoff: np.ndarray) -> None:
        h = _hash(grams)
        order = np.argsort(h)
        self.hashes = np.append(h[order], np.iinfo(np.uint64).max)
        self.logp, self.backoff = np.append(logp[order], np.float32(0)), np.append(backoff[order], np.float32(0))
        bits = max(1, (len(self.hashes) - 1).bit_length())
        self.shift = np.uint64(64 - bits)
        self.begin = np.searchsorted(self.hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Positions, -1 where a gram isn't held."""
        h = _hash(grams)
        at = self.begin[(h >> self.shift).astype(np.int64)]
        more = np.flatnonzero(self.hashes[at] < h)
        while len(more):
            at[more] += 1
            more = more[self.hashes[at[more]] < h[more]]
        at[(self.hashes[at] != h) | (at == len(self.hashes) - 1)] = -1
        return at


def shard_of(letters: np.ndarray | F.Column, shards: int) -> np.ndarray | F.Column:
    """The shard of two letters (24 bits)."""
    return letters * 40503 % 65521 % shards


class Model:
    """Log probabilities of texts of each language, with back-off for n-grams that aren't held."""

    def __init__(self, rows: pa.Table, order: int = ORDER) -> None:
        self.order, self.tables, self.unseen = order, {}, {}
        langs = rows.column("lang").combine_chunks().dictionary_encode()
        code, n = langs.indices.to_numpy(zero_copy_only=False), rows.column("n").to_numpy()
        gram, logp, backoff = (rows.column(c).to_numpy() for c in ("gram", "logp", "backoff"))
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            self.unseen[lang] = float(logp[(code == k) & (n == 0)][0])
            self.tables[lang] = {}
            for m in range(1, order + 1):
                of = np.flatnonzero((code == k) & (n == m))
                self.tables[lang][m] = HashArray(gram[of], logp[of], backoff[of])

    def logs(self, lang: str, grams: np.ndarray) -> np.ndarray:
        """The log probability of each gram's last letter after the others."""
        tables, out = self.tables[lang], np.zeros(len(grams), np.float64)
        open_ = np.arange(len(grams))
        for n in range(self.order, 0, -1):
            mine = grams[open_] & ((1 << 12 * n) - 1)
            at = tables[n].find(mine)
            hit = at >= 0
            out[open_[hit]] += tables[n].logp[at[hit]]
            open_, mine = open_[~hit], mine[~hit]
            if not len(open_):
                return out
            if n > 1:
                context = tables[n - 1].find(mine >> 12)
                out[open_] += np.where(context >= 0, tables[n - 1].backoff[context], 0)
        out[open_] += self.unseen[lang]
        return out


def measures(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    words = _WORD.findall(text)
    n = len(words)
    seen: set[str] = set()
    duplicates = 0
    for line in text.split("\n"):
        if line in seen:
            duplicates += 1
        elif _WORD.search(line):
            seen.add(line)
    repeated = 0
    if n > WINDOW:
        numbers: dict[str, int] = {}
        at = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
        # windows of 2, 4 and 8 words are numbered by the numbers of their halves
        for width in (1, 2, 4):
            pair = at[:-width] * (len(at) + 1) + at[width:]
            _, at, times = np.unique(pair, return_inverse=True, return_counts=True)
            if times.max() == 1:
                break
        else:
            twice = np.flatnonzero(times[at] > 1)
            if len(twice):
                edge = np.bincount(twice, minlength=n + 1)[: n + 1] - np.bincount(twice + WINDOW, minlength=n + 1)[: n + 1]
                repeated = int((np.cumsum(edge) > 0).sum())
    return n, sum(map(len, words)), sum(map(text.count, _SYMBOLS)), duplicates, repeated


_MEASURED = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, log_ppl double"


def broadcast_shards(model: DataFrame, shard_rows: int = SHARD_ROWS) -> list:
    """Broadcasts of the shards of a model (n, lang, gram, logp, backoff). A row is held where its last letter is looked
    up and, below the highest order, where it is a context; orders up to 2 are in all shards. The driver holds one at a time."""
    spark = model.sparkSession
    rows = {r.n: r.rows for r in model.groupBy("n").agg(F.count("*").alias("rows")).collect()}
    shards = max(1, -(-sum(v * (1 if n == ORDER else 2) for n, v in rows.items()) // shard_rows))
    two = F.lit((1 << 24) - 1)
    as_gram, as_context = shard_of(F.shiftright("gram", 12).bitwiseAND(two), shards), shard_of(F.col("gram").bitwiseAND(two), shards)
    held = []
    for k in range(shards):
        own = model.filter((F.col("n") <= 2) | (as_gram == k) | (F.col("n") < ORDER) & (as_context == k))
        found = own.select(F.col("n").cast("byte").alias("n"), "lang", "gram", F.col("logp").cast("float").alias("logp"), F.col("backoff").cast("float").alias("backoff")).toArrow()
        held.append(spark.sparkContext.broadcast(Model(found)))
        held[-1].__dict__.pop("_value", None)  # it stays in the broadcast's file
    return held


def _measured(docs: DataFrame, shards: list) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _batches(batches):
            base = np.array([measures(t) for t in texts], np.int64).reshape(-1, 5)
            failed = (base[:, 0] < LEAST_WORDS) | (100 * base[:, 4] > MOST_REPEATED * base[:, 0])
            langs = [(lang, at, *_grams([texts[k] for k in at])) for lang, at in _by_language(rows.column("lang").to_pylist()).items()]
            logs = [np.zeros(len(grams), np.int64) for _, _, grams, _ in langs]
            for k, shard in enumerate(shards):
                model = shard.value
                for (lang, _, grams, _), own in zip(langs, logs):
                    if lang in model.tables:  # else no text of it has a letter
                        here = np.flatnonzero(shard_of((grams >> 12) & ((1 << 24) - 1), len(shards)) == k)
                        own[here] = np.rint(model.logs(lang, grams[here]) * UNIT)
                if len(shards) > 1:
                    del model
                    shard.__dict__.pop("_value", None)  # it is read again from the broadcast's file
            log_ppl: list[float | None] = [None] * len(texts)
            for (_, at, _, sizes), own in zip(langs, logs):
                sums, ends = np.concatenate([[0], np.cumsum(own)]), np.cumsum(sizes)
                for k, total, size in zip(at, (sums[ends] - sums[ends - sizes]).tolist(), sizes.tolist()):
                    log_ppl[k] = -total / UNIT / size if size else None
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("lang"), *(pa.array(base[:, k]) for k in range(5)), pa.array(failed), pa.array(log_ppl, pa.float64())], [c.split()[0] for c in _MEASURED.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), "text").mapInArrow(run, _MEASURED)


def bands(measured: DataFrame) -> DataFrame:
    """lang, q1, q3, documents: the quartiles of log perplexity (in thousandths, exact from a histogram) of the documents that pass
    the base rules, and their number."""
    bins = measured.filter(~F.col("base_failed") & F.col("log_ppl").isNotNull()).groupBy("lang", F.round(F.col("log_ppl") * 1000).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    upto = bins.select("lang", "bin", F.sum("n").over(Window.partitionBy("lang").orderBy("bin")).alias("upto"), F.sum("n").over(Window.partitionBy("lang")).alias("all"))
    return upto.groupBy("lang").agg(*[F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin"))).alias(name) for q, name in ((0.25, "q1"), (0.75, "q3"))], F.max("all").alias("documents"))


def quality_rules(docs: DataFrame, fences: tuple[float, float] = FENCES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, log_ppl, a row for each row of docs (doc_id, text, lang).

    A null text has no words and fails the base rules; its perplexity is null. A null lang is a language of its own. A
    null doc_id stays null; repeated rows count each time, in the model too. Counts cover all texts, whole.
    """
    model, path = common.write_work(kneser_ney(count_grams(docs)), "model")
    shards = broadcast_shards(model, shard_rows)
    common.drop_folder(docs.sparkSession, path)
    measured, _ = common.write_work(_measured(docs, shards), "measured")
    for shard in shards:
        shard.unpersist()
    found = measured.join(bands(measured), "lang", "left")
    wide = F.greatest(F.col("q3") - F.col("q1"), F.lit(1)) * F.sqrt((1 + F.try_divide(F.lit(float(SHORT_CHARS)), F.col("word_chars"))) * (1 + FEW_DOCUMENTS / F.col("documents")))
    inside = (F.col("log_ppl") * 1000).between(F.col("q1") - fences[0] * wide, F.col("q3") + fences[1] * wide)
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(False))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "log_ppl")
