"""Phrase collocations from a weighted de Bruijn graph of word runs.

Texts are cut into pieces, and every word occurrence starts one longest gram: five
words, or what is left of its run. The five-word grams are weighted edges between the
four-word nodes that they begin and end with; the shorter ones, which stand at the ends
of runs, correct the flow. The count of a shorter phrase is the flow out of its node:
the weights of the edges that begin with it and of its ends. A node whose whole flow
takes one edge belongs to a unary path and is compacted into it, which are just the
phrases that a longer phrase accounts for.

What is rare is left out before the graph is built, and exactly: a phrase of at least
``least`` occurrences holds only words, pairs and triples that occur as often, so a run
may end where one of them does not. They are counted first, pairs among frequent words
and triples among frequent pairs, in hash buckets, and known to the tasks by bitmaps of
fixed size; buckets and bits that several share only keep rare grams longer.

Words are 64-bit hashes. No two words of a language share one if either is frequent:
that is checked on the table of all words, and the next seed is taken if they do.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import settle

#: Words of the longest phrase.
LONGEST = 5
#: log2 of the buckets that pairs and triples are counted in, and of the bits of a bitmap.
BUCKETS, BITS = 40, 27
#: Distinct words and grams that a task holds before it sends them on; bytes of text cut at a time; start words of an
#: encoded row; words, and texts, of a batch that are looked at together.
HELD, GRAMS, BLOCK, ROW, SLICE, TEXTS = 200_000, 200_000, 1 << 20, 32_768, 200_000, 256
#: A-Z to a-z, what ends a piece to a line feed, a tab to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if b == 9 else b for b in range(256))
_WORDS = re.compile(rb"\n|[^\n ]+").findall
_GAP = re.compile(rb"[\n ]")


def _word_lists(text: str | None, block: int) -> Iterator[list[bytes]]:
    """Words in order, a line feed where a piece ends, in lists from about ``block`` bytes each."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > block:
            cut = _GAP.search(data, at + block)
            end = cut.start() if cut else end
        yield _WORDS(data[at:end])
        at = end


def _word_id(word: bytes, seed: int) -> int:
    import xxhash

    value = xxhash.xxh64_intdigest(word, seed)
    return (value if value < 1 << 63 else value - (1 << 64)) or 1


def _mixed(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of several columns of 64-bit integers."""
    h = np.full(len(parts[0]), 0x9E3779B97F4A7C15, np.uint64)
    for part in parts:
        h = (h ^ part.view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    return h


class Bitmap:
    """Which buckets are frequent, as bits; never misses one."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.mask = words, 64 * len(words) - 1

    @staticmethod
    def of(keys: DataFrame, key: str) -> Bitmap:
        """The bits of ``key``, joined by Spark to at most 2^BITS / 64 rows."""
        bit = F.col(key).bitwiseAND(F.lit((1 << BITS) - 1))
        one = F.expr("shiftleft(1L, cast(bit & 63 AS int))")
        rows = keys.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(one).alias("bits")).toArrow()
        words = np.zeros((1 << BITS) // 64, np.uint64)
        words[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
        return Bitmap(words)

    def __contains__(self, key: int) -> bool:
        bit = key & self.mask
        return bool(int(self.words[bit >> 6]) >> (bit & 63) & 1)

    def hits(self, keys: np.ndarray) -> np.ndarray:
        bit = keys.view(np.uint64) & np.uint64(self.mask)
        return (self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


def _words(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, word, id, f) of every word."""
    most, block = HELD // 2, BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                counts.pop(b"\n", None)
                names = list(counts)
                if names:
                    ids = pa.array([_word_id(w, seed) for w in names], pa.int64())
                    yield pa.record_batch([pa.array([lang] * len(names)), pa.array([w.decode("utf-8", "surrogatepass") for w in names]), ids, pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "id", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = held.setdefault(lang, Counter())
                for words in _word_lists(text.as_py(), block):
                    counts.update(words)
                    if len(counts) > most:
                        yield from flush()
                        counts = held.setdefault(lang, Counter())
            if sum(map(len, held.values())) > most:
                yield from flush()
        yield from flush()

    found = docs.mapInArrow(run, "lang string, word string, id long, n long")
    return settle(found.groupBy("lang", "word").agg(F.max("id").alias("id"), F.sum("n").alias("f")), "words")


class _Ids(dict):
    """The hash of a frequent word of one language; 0 for others and for ends of pieces."""

    def __init__(self, lang: int, seed: int, bits: Bitmap, most: int) -> None:
        super().__init__({b"\n": 0})
        self.lang, self.seed, self.bits, self.most = lang, seed, bits, most

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.most:
            self.clear()
            self[b"\n"] = 0
        value = _word_id(word, self.seed)
        self[word] = value = value if value ^ self.lang in self.bits else 0
        return value


def _encoded(docs: DataFrame, seed: int, bits: Bitmap) -> DataFrame:
    """(lang, own, ids): texts as hashes of frequent words, 0 between runs. Grams that
    start in the first ``own`` words belong to the row; the others follow the cut."""
    shared = docs.sparkSession.sparkContext.broadcast(bits.words)
    most, block, size = HELD // 4, BLOCK, ROW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, _Ids] = {}
        for batch in (b.slice(i, TEXTS) for b in batches for i in range(0, b.num_rows, TEXTS)):
            langs, owns, rows = [], [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if lang not in known:
                    if sum(map(len, known.values())) > 4 * most:
                        known.clear()
                    known[lang] = _Ids(lang, seed, Bitmap(shared.value), most)
                ids = known[lang]
                parts = [np.fromiter(map(ids.__getitem__, words), np.int64, len(words)) for words in _word_lists(text.as_py(), block)]
                if not parts:
                    continue
                whole = np.concatenate(parts)
                whole = whole[(whole != 0) | np.concatenate(([False], whole[:-1] != 0))]
                for at in range(0, len(whole), size):
                    langs.append(lang)
                    owns.append(min(size, len(whole) - at))
                    rows.append(whole[at : at + size + LONGEST - 1])
            if rows:
                offsets = np.cumsum([0, *map(len, rows)])
                yield pa.record_batch([pa.array(langs, pa.int64()), pa.array(owns, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(rows)))], names=["lang", "own", "ids"])

    return settle(docs.select(F.xxhash64("lang").alias("lang"), "text").mapInArrow(run, "lang long, own int, ids array<long>"), "encoded")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, in parts of about ``SLICE`` words."""
    for batch in batches:
        offsets = batch.column(2).offsets.to_numpy()
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, word, whether a gram may start) of each place of a batch's rows, with
    ``LONGEST`` empty places after each."""
    lists = batch.column(2)
    values, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)
    word = np.zeros(len(values) + LONGEST * len(sizes), np.int64)
    place = np.arange(len(values)) + LONGEST * row
    word[place] = values
    starts = np.zeros(len(word), bool)
    starts[place] = np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], sizes) < np.repeat(batch.column(1).to_numpy(), sizes)
    return np.repeat(batch.column(0).to_numpy(), sizes + LONGEST), word, starts & (word != 0)


def _shift(x: np.ndarray, by: int) -> np.ndarray:
    return np.concatenate((x[by:], np.zeros(by, x.dtype)))


def _links(lang: np.ndarray, word: np.ndarray, pairs: Bitmap | None, triples: Bitmap | None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(the words from each place on, whether the next may join, whether the two next may)."""
    ahead = [word] + [_shift(word, k) for k in range(1, LONGEST)]
    two = (ahead[0] != 0) & (ahead[1] != 0)
    if pairs is not None:
        at = np.flatnonzero(two)
        two[at] = pairs.hits(_mixed([lang[at], ahead[0][at], ahead[1][at]]))
    three = two & _shift(two, 1)
    if triples is not None:
        at = np.flatnonzero(three)
        three[at] = triples.hits(_mixed([lang[at], *(x[at] for x in ahead[:3])]))
    return ahead, two, three


def _distinct(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their counts; rows of one hash are compared."""
    hashes = _mixed(list(np.ascontiguousarray(rows.T)))
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    if (rows != rows[first[inverse]]).any():
        found, inverse = np.unique(rows, axis=0, return_inverse=True)
        first = np.zeros(len(found), np.int64)
        first[inverse.ravel()] = np.arange(len(rows))
    sums = np.zeros(len(first), np.int64)
    np.add.at(sums, inverse.ravel(), counts)
    return rows[first], sums


def _grams(encoded: DataFrame, size: int, pairs: Bitmap | None = None, triples: Bitmap | None = None) -> DataFrame:
    """(lang, w1..w5, f): how often the longest grams occur, one from every word, 0 after the
    end of its run. For ``size`` 2 and 3 instead: how many whole grams of that many words,
    whose pairs may be frequent, fall into each hash bucket ``w1``."""
    shared = encoded.sparkSession.sparkContext.broadcast([b.words for b in (pairs, triples) if b])
    names, most, buckets = ["lang", *(f"w{k}" for k in range(1, LONGEST + 1))], GRAMS, np.uint64((1 << BUCKETS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0  # (rows, counts); the first are those already added up
        bitmaps = [*map(Bitmap, shared.value), None, None][:2]

        def batch_of(rows: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            none = np.zeros(len(rows), np.int64)
            columns = [np.ascontiguousarray(c) for c in rows.T] if size == LONGEST else [none, rows[:, 0]] + [none] * (LONGEST - 1)
            return pa.record_batch([*map(pa.array, columns), pa.array(counts)], names=[*names, "n"])

        for batch in _slices(batches):
            lang, word, starts = _flat(batch)
            ahead, two, three = _links(lang, word, *bitmaps)
            at = np.flatnonzero(starts if size == LONGEST else starts & (two if size == 2 else three))
            if size == LONGEST:
                rows = np.zeros((len(at), size + 1), np.int64)
                rows[:, 0], rows[:, 1] = lang[at], word[at]
                joined = np.ones(len(at), bool)
                for k in range(1, size):
                    joined = joined & _shift(two, k - 1)[at]
                    if k > 1:
                        joined = joined & _shift(three, k - 2)[at]
                    rows[joined, k + 1] = ahead[k][at[joined]]
            else:
                rows = (_mixed([lang[at], *(x[at] for x in ahead[:size])]) & buckets).astype(np.int64)[:, None]
            held.append((rows, np.ones(len(rows), np.int64)))
            count += len(rows)
            if count > 2 * most:
                held = [_distinct(*map(np.concatenate, zip(*held)))]
                count = len(held[0][0])
                if count > most:
                    yield batch_of(*held[0])
                    held, count = [], 0
        if count:
            yield batch_of(*_distinct(*map(np.concatenate, zip(*held))))

    found = encoded.mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "n"]))
    return found.groupBy(*names).agg(F.sum("n").alias("f"))


def _phrases(edges: DataFrame, least: int) -> DataFrame:
    """(lang, words, f) of phrases of 1 to 5 words that occur ``least`` times or more:
    the flow out of each node, the longest first, each from the table of the one before."""
    flow, found = edges, []
    for k in range(LONGEST, 0, -1):
        keys = [f"w{i}" for i in range(1, k + 1)]
        if k < LONGEST:
            flow = flow.groupBy("lang", *keys).agg(F.sum("f").alias("f"))
            if k > 1:
                flow = settle(flow, f"flow-{k}")
        found.append(flow.where((F.col(f"w{k}") != 0) & (F.col("f") >= least)).select("lang", F.array(*keys).alias("words"), "f"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return settle(out, "phrases")


def unary_paths(edges: DataFrame, least: int = 100) -> DataFrame:
    """(lang, words, f): the edges that occur ``least`` times or more, compacted along
    unary paths, so that a repeated passage is one row however long it is.

    An edge follows another if both carry the whole flow of the node between them. The
    first edge of each path is found by doubling: each round, an edge takes what the edge
    that it points to points to, and only whether any still moves reaches the driver.
    Such paths never close, as the flow must enter a node somewhere.
    """
    words = [f"w{i}" for i in range(1, LONGEST + 1)]
    heavy = settle(edges.where((F.col(words[-1]) != 0) & (F.col("f") >= least)).select("lang", F.array(*words).alias("words"), "f"), "heavy-edges")
    flow = edges.where(f"{words[-2]} != 0").groupBy("lang", F.array(*words[:-1]).alias("node")).agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    into = heavy.select("lang", F.slice("words", 2, LONGEST - 1).alias("node"), "f", F.col("words").alias("before"))
    linked = heavy.withColumn("node", F.slice("words", 1, LONGEST - 1)).join(into.join(flow, ["lang", "node", "f"]), ["lang", "node", "f"], "left")
    at = settle(linked.select("lang", "words", "f", F.coalesce("before", "words").alias("first"), F.when(F.col("before").isNull(), 0).otherwise(1).cast("long").alias("steps")), "paths")
    while True:
        onward = at.select("lang", F.col("words").alias("first"), F.col("first").alias("further"), F.col("steps").alias("more"))
        at = settle(at.join(onward, ["lang", "first"]).select("lang", "words", "f", F.col("further").alias("first"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("more") > 0).alias("moved")), "paths")
        if not at.where("moved").take(1):
            break
    rest = F.array_sort(F.collect_list(F.when(F.col("steps") > 0, F.struct("steps", F.element_at("words", -1).alias("word")))))
    return at.groupBy("lang", "first", "f").agg(rest.alias("rest")).select("lang", F.concat("first", F.col("rest.word")).alias("words"), "f")


def collocations(docs: DataFrame, least: int = 100, most: int | None = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): phrases of 2 to 5 words that occur ``least``
    times or more, by the score of their weakest cut; the first ``most`` of each language.

    a, l, r are the occurrences of the phrase and of its parts before and after the cut, n
    those of all words of the language, score = floor(1000 a n / (l r)); of equal cuts the
    earliest counts. A phrase inside a longer one that occurs as often is left out. Order:
    score and a, largest first, then the phrase in UTF-8 byte order. Texts of any length
    count whole and each row by itself, repeats too; null and empty texts count nothing, a
    null language is ``und``. An empty table, or one without such phrases, gives no rows.
    """
    docs = docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.col(text).alias("text"))
    seed = 42
    while True:
        words = _words(docs, seed)
        clash = words.groupBy("lang", "id").agg(F.count("*").alias("n"), F.max("f").alias("f"))
        if not clash.where((F.col("n") > 1) & (F.col("f") >= least)).take(1):
            break
        seed += 1
    frequent = words.where(F.col("f") >= least)
    encoded = _encoded(docs, seed, Bitmap.of(frequent.select(F.col("id").bitwiseXOR(F.xxhash64("lang")).alias("key")), "key"))
    often = F.col("f") >= least
    pairs = Bitmap.of(_grams(encoded, 2).where(often), "w1")
    triples = Bitmap.of(_grams(encoded, 3, pairs).where(often), "w1")
    found = _phrases(settle(_grams(encoded, LONGEST, pairs, triples), "edges"), least)

    langs = words.groupBy("lang").agg(F.sum("f").alias("n")).select(F.xxhash64("lang").alias("key"), F.col("lang").alias("name"), "n")
    size = F.size("words")
    grown = found.where(size > 2)
    around = grown.select("lang", F.slice("words", F.lit(1), size - 1).alias("words"), "f").union(grown.select("lang", F.slice("words", F.lit(2), size - 1).alias("words"), "f"))
    compacted = around.groupBy("lang", "words").agg(F.max("f").alias("f"))
    kept = settle(found.where(size > 1).join(compacted, ["lang", "words", "f"], "left_anti"), "candidates")

    cuts = kept.select("lang", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("*", F.slice("words", F.lit(1), F.col("k")).alias("head"), F.slice("words", F.col("k") + 1, size - F.col("k")).alias("tail"))
    heads = found.select("lang", F.col("words").alias("head"), F.col("f").alias("l"))
    tails = found.select("lang", F.col("words").alias("tail"), F.col("f").alias("r"))
    cuts = settle(cuts.join(heads, ["lang", "head"]).select("lang", "words", "a", "k", "l", "tail"), "cuts").join(tails, ["lang", "tail"])
    cuts = cuts.join(langs, cuts.lang == langs.key).select("lang", "name", "n", "words", "a", "k", "l", "r")
    score = F.expr("(cast(a AS decimal(19,0)) * 1000 * n) div (cast(l AS decimal(19,0)) * r)")
    best = cuts.select("*", score.alias("score")).groupBy("lang", "name", "n", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = settle(best.select("lang", "name", "n", "words", "a", "cut.l", "cut.r", "cut.score"), "scored")

    spelled = frequent.select(F.xxhash64("lang").alias("lang"), F.col("id").alias("w"), "word")
    parts = best.select("lang", "words", F.posexplode("words").alias("at", "w")).join(spelled, ["lang", "w"])
    phrases = parts.groupBy("lang", "words").agg(F.array_join(F.array_sort(F.collect_list(F.struct("at", "word"))).getField("word"), " ").alias("phrase"))
    out = best.join(phrases, ["lang", "words"]).select(F.col("name").alias("lang"), "phrase", "a", "l", "r", "n", "score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    out = out.select("lang", rank.alias("rank"), "phrase", "a", "l", "r", "n", "score")
    return out if most is None else out.where(F.col("rank") <= most)
