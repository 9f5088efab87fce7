"""Hybrid search: vector, trigram and one-hop candidates, merged and fused."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..sources.scratch import settle

#: Weights of the sources and boosts of the fused score.
SEMANTIC, LEXICAL, STRUCTURAL = 0.50, 0.35, 0.15
ENTRY_BOOST, HOTSPOT_BOOST, TEST_BOOST = 0.05, 0.05, 0.12
#: Score of a relation by its type.
TYPE_SCORES = {"calls": 0.70, "extends": 0.65, "implements": 0.65, "depends_on": 0.55, "imports": 0.45, "belongs_to": 0.35}
OTHER_TYPE_SCORE = 0.40
LEAST_SIMILARITY = 0.2


#: Most queries and chunks that meet in a block of ``nearest``, and queries compared at once.
ASKED, HELD, SLICE = 4096, 8192, 256


def nearest(queries: DataFrame, chunks: DataFrame, k: int = 25, floor: float = 0.5) -> DataFrame:
    """(query_id, chunk_id, score, rank): the ``k`` most similar chunks of the query's
    repository, those below ``floor`` dropped after the cut.

    ``queries`` (query_id, repository_id, vector), ``chunks`` (chunk_id,
    repository_id, embedding). A repository's queries and chunks are dealt to parts of
    about ASKED and HELD rows, which meet in blocks; a block gives the ``k`` best of each
    of its queries. Vectors that are null or hold null, and zero ones, find nothing.
    """
    key = ["repository", "dims"]

    def whole(df: DataFrame, id_: str, vector: str) -> DataFrame:
        fit = df.where(F.col("repository_id").isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
        return fit.select(F.col(id_).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col("repository_id").alias("repository"), F.size(vector).alias("dims"))

    asked, held = whole(queries, "query_id", "vector"), whole(chunks, "chunk_id", "embedding")
    parts = lambda df, most, name: df.groupBy(key).agg(F.ceil(F.count("*") / most).alias(name))
    counts = settle(parts(asked, ASKED, "q_parts").join(parts(held, HELD, "c_parts"), key), "vector-parts")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    a = asked.join(counts, key).select(*key, dealt("q_parts").alias("q"), "id", "v", every("c_parts").alias("c"))
    b = held.join(counts, key).select(*key, dealt("c_parts").alias("c"), "id", "v", every("q_parts").alias("q"))
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (chunks, "chunk_id"))}

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pc.sort_indices(right.column("id"), null_placement="at_start"))
        x, y = (np.array(t.column("v").combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1) for t in (left, right))
        nx, ny = (np.sqrt(_in_order(m, m)) for m in (x, y))
        rows, columns, scores = [], [], []
        for at in range(0, len(x), SLICE):
            with np.errstate(all="ignore"):
                scale = nx[at : at + SLICE, None] * ny
                near = x[at : at + SLICE] @ y.T / scale
            near = np.where(scale == 0, -np.inf, np.where(np.isnan(near), np.inf, near))
            bar = np.full(len(near), floor) if len(y) <= k else np.maximum(floor, np.partition(near, len(y) - k, axis=1)[:, len(y) - k])
            i, j = np.nonzero(near >= bar[:, None] - 1e-9)
            # The products above choose; the scores are sums in index order, the same for equal vectors.
            with np.errstate(all="ignore"):
                score = _in_order(x[at + i], y[j]) / (nx[at + i] * ny[j])
            order = np.lexsort((j, -np.where(np.isnan(score), np.inf, score), i))
            first = np.arange(len(i)) - np.searchsorted(i, i) < k
            rows.append(at + i[order][first]), columns.append(j[order][first]), scores.append(score[order][first])
        rows, columns, scores = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (rows, columns, scores))
        return pa.table({"query_id": left.column("id").take(pa.array(rows)), "chunk_id": right.column("id").take(pa.array(columns)), "score": pa.array(scores, pa.float64())})

    group = [*key, "q", "c"]
    scored = a.groupBy(group).cogroup(b.groupBy(group)).applyInArrow(compare, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= k) & (F.col("score") >= floor))


def _in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, added from the first component to the last."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += x[:, d] * y[:, d]
    return total


#: Tokens that a block of a comparison with all names holds.
BLOCK = 2000


def _codes(grams: Column) -> Column:
    """Trigrams as numbers, from the code points of their three characters."""
    point = lambda g, i: F.ascii(F.substring(g, i, 1)).cast("long")
    return F.transform(grams, lambda g: (point(g, 1) * (1 << 21) + point(g, 2)) * (1 << 21) + point(g, 3))


def _marks(codes: Column, seed: int) -> Column:
    """The bits of a word that the hashes of trigrams set."""
    bit = lambda g: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(g, F.lit(seed)), F.lit(64)))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda s, g: s.bitwiseOR(bit(g)))


def _gram_sets(df: DataFrame, of: str) -> DataFrame:
    """``df`` with the trigrams ``g`` of a column, their number and two words of bits that they set."""
    sets = df.withColumn("g", _codes(text.trigrams(F.col(of))))
    return sets.withColumn("n", F.size("g")).withColumn("low", _marks(F.col("g"), 0)).withColumn("high", _marks(F.col("g"), 1))


def _lacking(low: str, high: str) -> Column:
    """How many bits of a word a string lacks: no more than the trigrams that it lacks."""
    return F.greatest(F.bit_count(F.col(low).bitwiseAND(F.bitwise_not("low"))), F.bit_count(F.col(high).bitwiseAND(F.bitwise_not("high"))))


def matching(tokens: DataFrame, strings: DataFrame) -> DataFrame:
    """(token[, repository_id], string, similarity) of the pairs in which the string holds
    the token (``_`` matches any character) or is at least LEAST_SIMILARITY similar. With a
    ``repository_id`` in both tables, pairs are of one repository.

    ``tokens`` may have a similarity ``least`` of their own and tell by ``held`` whether
    strings that hold them are looked for. Two sets of m and n trigrams are t similar only
    if they share c = t / (1 + t) * (m + n) of them: then the string has one of the token's
    m - c + 1 rarest trigrams, and lacks m - c of its bits at most. A string that holds the
    token holds its runs of three letters or digits; the rarest of them finds it. Tokens
    without such a run are compared with all strings in blocks of BLOCK tokens.
    """
    scope = ["repository_id"] if "repository_id" in tokens.columns and "repository_id" in strings.columns else []
    least = F.col("least") if "least" in tokens.columns else F.lit(LEAST_SIMILARITY)
    held = F.col("held") if "held" in tokens.columns else F.lit(True)
    asked = settle(tokens.select("token", *scope, least.alias("least"), held.alias("held")).distinct(), "asked-tokens")
    known = strings.select("string", *scope).where("string IS NOT NULL").distinct()
    sets = settle(_gram_sets(known, "string"), "gram-sets")
    grams = _gram_sets(asked.select("token").distinct(), "token").withColumnsRenamed({"g": "w", "n": "m", "low": "a", "high": "b"})
    grams = settle(grams, "token-grams")
    holders = sets.select(F.explode("g").alias("gram")).groupBy("gram").agg(F.count("*").alias("holders"))
    each = grams.select("token", "m", "a", "b", F.explode("w").alias("gram")).join(holders, "gram", "left").withColumn("holders", F.coalesce("holders", F.lit(0)))
    placed = each.withColumn("place", F.row_number().over(Window.partitionBy("token").orderBy("holders", "gram")))
    sizes = sets.select("n").distinct()
    spare = F.col("m") - F.ceil(F.col("least") / (1 + F.col("least")) * (F.col("m") + F.col("n")) - 1e-9)
    reach = (F.col("n") >= F.col("least") * F.col("m") - 1e-9) & (F.col("m") >= F.col("least") * F.col("n") - 1e-9) & (F.col("place") <= spare + 1)
    rare = placed.where("holders > 0").join(asked.select("token", *scope, "least"), "token").join(F.broadcast(sizes), reach)
    rare = settle(rare.select("token", *scope, "gram", "n", "a", "b", spare.alias("spare")), "rare-trigrams")
    entries = sets.select("string", *scope, "n", "low", "high", F.explode("g").alias("gram"))
    near = entries.join(rare, ["gram", "n", *scope]).where(_lacking("a", "b") <= F.col("spare")).select("token", *scope, "string")

    run = r"^[\p{L}\p{N}]{3}$"
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.length("token") - 2, F.lit(1))), lambda i: F.substring(F.lower("token"), i, F.lit(3)))
    holding = asked.where("held").select("token", *scope)
    runs = holding.select("token").distinct().select("token", F.explode(F.array_distinct(_codes(F.filter(windows, lambda w: w.rlike(run))))).alias("gram")).join(holders, "gram", "left")
    bits = runs.groupBy("token").agg(F.min_by("gram", F.struct(F.coalesce("holders", F.lit(0)), "gram")).alias("gram"), F.collect_set("gram").alias("g"))
    probe = settle(bits.select("token", "gram", _marks(F.col("g"), 0).alias("a"), _marks(F.col("g"), 1).alias("b")).join(holding, "token"), "token-runs")
    like = F.expr("string ILIKE concat('%', token, '%')")
    within = entries.join(probe, ["gram", *scope]).where(_lacking("a", "b") == 0).where(like).select("token", *scope, "string")

    pairs = near.union(within).distinct().join(asked, ["token", *scope]).join(grams.select("token", "w", "m"), "token").join(sets.select("string", *scope, "g", "n"), ["string", *scope])
    common = F.size(F.array_intersect("w", "g")).cast("double")
    out = pairs.withColumn("similarity", F.coalesce(F.try_divide(common, F.col("m") + F.col("n") - common), F.lit(0.0)))
    out = out.where((F.col("similarity") >= F.col("least") - 1e-9) | (F.col("held") & like)).select("token", *scope, "string", "similarity")
    similarity = text.trigram_similarity(F.col("token"), F.col("string"))
    short = holding.where(~F.col("token").rlike(r"[\p{L}\p{N}]{3}"))
    blocks, columns = -(-short.count() // BLOCK), ["token", *scope, "string"]
    for b in range(blocks):
        block = F.broadcast(short.where(F.pmod(F.xxhash64("token"), F.lit(blocks)) == b))
        met = known.join(block, scope).where(like) if scope else known.join(block, like)
        out = out.union(met.withColumn("similarity", similarity).select(*columns, "similarity"))
    return out.groupBy(*columns).agg(F.max("similarity").alias("similarity")) if blocks else out


def _first(scored: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    window = Window.partitionBy(*by).orderBy(F.desc("score"), *order)
    return scored.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def lexical(tokens: DataFrame, symbols: DataFrame, k: int = 25) -> DataFrame:
    """(query_id, token, symbol_id, qualified_name, score, rank): symbols by token, at most ``k`` each.

    Admitted are names that contain the token or are similar, see ``matching``; an
    equal name scores one. Ties go by qualified name, then id. With a ``repository_id``
    in both tables, a question finds symbols of its repository only.

    Each token is answered once, however many questions ask for it. Symbols of one name
    score alike by it, so the first ``k`` of a name stand for all. Where names alone give
    ``k`` symbols, qualified names are looked for from the last one's score on.
    """
    scope = ["repository_id"] if "repository_id" in tokens.columns and "repository_id" in symbols.columns else []
    by = ["token", *scope]
    asked = settle(tokens.select(*by).distinct(), "tokens")
    columns = [*scope, "symbol_id", "name", "qualified_name"]
    kept = symbols.select(*columns)
    named = settle(matching(asked, kept.select(F.col("name").alias("string"), *scope)).withColumnRenamed("string", "name"), "name-matches")
    same = lambda c: F.coalesce(F.lower(c) == F.lower("token"), F.lit(False))
    close = same("name") | (F.col("similarity") >= LEAST_SIMILARITY)
    heads = kept.withColumn("at", F.dense_rank().over(Window.partitionBy("name", *scope).orderBy("qualified_name", "symbol_id"))).where(F.col("at") <= k).drop("at").distinct()
    score = F.when(same("name"), 1.0).otherwise(F.col("similarity"))
    best = settle(_first(named.where(close).join(heads, ["name", *scope]).withColumn("score", score), by, ["qualified_name", "symbol_id"], k), "best-by-name")
    full = best.where(F.col("rank") == k).select(*by, F.col("score").alias("least"))
    aims = settle(asked.join(full, by, "left").select(*by, F.coalesce("least", F.lit(LEAST_SIMILARITY)).alias("least"), (F.col("least").isNull() | (F.size(text.trigrams(F.col("token"))) == 0)).alias("held")), "token-aims")
    others = settle(matching(aims, kept.select(F.col("qualified_name").alias("string"), *scope)).select(*by, F.col("string").alias("qualified_name")), "qualified-matches")
    open_ = asked.join(full, by, "left_anti")
    vague = named.where(~close).join(open_, by, "left_semi").select(*by, "name")
    found = best.select("token", *columns).union(kept.join(others, ["qualified_name", *scope]).select("token", *columns)).union(kept.join(vague, ["name", *scope]).select("token", *columns)).distinct()
    # The similarity of a symbol is that of the nearer of its two names, whichever is admitted.
    nearer = F.greatest(text.trigram_similarity(F.col("name"), F.col("token")), text.trigram_similarity(F.col("qualified_name"), F.col("token")))
    scored = found.withColumn("score", F.when(same("name") | same("qualified_name"), 1.0).otherwise(nearer))
    first = _first(scored, by, ["qualified_name", "symbol_id"], k)
    return tokens.join(first, by).select("query_id", "token", "symbol_id", "qualified_name", "score", "rank")


#: Most tokens and strings that meet in a block of ``likest``. Trigrams of more than one
#: string in COMMON of a block are held as flags of all its strings, others as lists.
#: MOST_BARS: how many rows of least numbers of shared trigrams a block holds.
WORDS, NAMES, COMMON, MOST_BARS = 65_536, 65_536, 8, 128


def likest(tokens: DataFrame, strings: DataFrame, k: int = 25) -> DataFrame:
    """(token[, repository_id], string, score): of the strings that ``matching`` admits for a
    token the ``k`` best by score, then string. An equal string, whatever its case, scores one.

    Tokens and strings are dealt to parts of about WORDS and NAMES, which meet in blocks. A
    block counts the trigrams that a token shares with each of its strings and gives the
    ``k`` best of each token, so pairs are not listed, however many are admitted.
    """
    scope = ["repository_id"] if "repository_id" in tokens.columns and "repository_id" in strings.columns else []
    repository = (F.col("repository_id") if scope else F.lit(0)).alias("repository")
    asked = tokens.select("token", *scope).where(" AND ".join(f"{c} IS NOT NULL" for c in ("token", *scope))).distinct()
    known = strings.select("string", *scope).where(" AND ".join(f"{c} IS NOT NULL" for c in ("string", *scope))).distinct()
    asked = settle(asked.withColumn("word", F.monotonically_increasing_id()), "asked-tokens")
    known = settle(known.orderBy("string").withColumn("at", F.monotonically_increasing_id()), "known-strings")  # in order of string
    parts = lambda df, most, name: df.groupBy(repository).agg(F.ceil(F.count("*") / most).alias(name))
    counts = settle(parts(asked, WORDS, "q_parts").join(parts(known, NAMES, "c_parts"), "repository"), "name-parts")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = lambda of, n: F.pmod(F.xxhash64(of), F.col(n))
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.length("low") - 2, F.lit(1))), lambda i: F.substring("low", i, F.lit(3)))
    runs = F.array_distinct(_codes(F.filter(windows, lambda w: w.rlike(r"^[\p{L}\p{N}]{3}$"))))
    a = asked.select(repository, "word", F.lower("token").alias("low"), _codes(text.trigrams(F.col("token"))).alias("g")).withColumn("runs", runs)
    a = a.join(counts, "repository").select("repository", dealt("word", "q_parts").alias("q"), "word", "low", "g", "runs", every("c_parts").alias("c"))
    b = known.select(repository, "at", F.lower("string").alias("low"), _codes(text.trigrams(F.col("string"))).alias("g"))
    b = b.join(counts, "repository").select("repository", dealt("at", "c_parts").alias("c"), "at", "low", "g", every("q_parts").alias("q"))
    group = ["repository", "q", "c"]
    compare = lambda left, right: _likest_of_block(left, right, k)
    scored = a.groupBy(group).cogroup(b.groupBy(group)).applyInArrow(compare, "word long, at long, score double")
    best = scored.withColumn("place", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("score"), "at"))).where(F.col("place") <= k)
    return best.join(asked, "word").join(known.select("string", "at"), "at").select("token", *scope, "string", "score")


def _likest_of_block(words: pa.Table, names: pa.Table, k: int) -> pa.Table:
    """(word, at, score): the ``k`` best ``names`` (at, low, g) of each of ``words`` (word, low, g, runs)."""
    names = names.take(pc.sort_indices(names.column("at")))
    low, size = names.column("low").combine_chunks(), pc.list_value_length(names.column("g")).to_numpy().astype(np.int32)
    grams, n = names.column("g").combine_chunks().flatten().to_numpy(), names.num_rows
    names = names.select(["at"])
    order = np.argsort(grams, kind="stable")
    grams, starts = np.unique(grams[order], return_index=True)
    owners, ends = np.repeat(np.arange(n, dtype=np.int32), size)[order], np.append(starts[1:], len(order))
    del order
    flags, width = {}, -(-n // 8) * 8
    for g in np.flatnonzero((ends - starts) * COMMON > n):
        flags[g] = np.zeros(width, np.uint8)
        flags[g][owners[starts[g] : ends[g]]] = 1

    def places(column: str) -> tuple[np.ndarray, np.ndarray]:
        """Where each word's part of a column of trigrams begins, and each one's place in ``grams`` or -1."""
        lists = words.column(column).combine_chunks()
        codes = lists.flatten().to_numpy()
        at = np.minimum(np.searchsorted(grams, codes), max(len(grams) - 1, 0))
        return np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy())), np.where(grams[at] == codes, at, -1) if len(grams) else np.full(len(codes), -1)

    def bar(m: int, step: int, kind: type) -> np.ndarray:
        """How many of ``m`` trigrams each string must share to be similar by LEAST_SIMILARITY, raised by a tenth a step."""
        if (m, step) not in bars:
            t = LEAST_SIMILARITY * 1.1**step
            bars[m, step] = np.full(width, np.iinfo(kind).max, kind)
            bars[m, step][:n] = np.clip(np.ceil(t / (1 + t) * (m + size) - 1e-9), 1, np.iinfo(kind).max)
        return bars[m, step]

    def holding(runs: np.ndarray) -> np.ndarray:
        """The strings that have all of these trigrams: of no trigrams, all strings."""
        if not len(runs):
            return np.arange(n)
        if runs.min() < 0:
            return np.zeros(0, np.int64)
        first, *others = sorted(runs, key=lambda g: ends[g] - starts[g])
        found = owners[starts[first] : ends[first]]
        for g in others:
            found = found[flags[g][found] > 0] if g in flags else np.intersect1d(found, owners[starts[g] : ends[g]], assume_unique=True)
        return found

    def scores(shared: np.ndarray, m: int, at: np.ndarray) -> np.ndarray:
        common = shared[at].astype(np.float64)
        union = m + size[at] - common
        return np.divide(common, union, out=np.zeros(len(at)), where=union > 0)

    (w_begins, w_grams), (r_begins, r_grams) = places("g"), places("runs")
    bars, step, out = {}, {}, ([], [], [])
    for i, (word, token) in enumerate(zip(words.column("word").to_pylist(), words.column("low").to_pylist())):
        own = w_grams[w_begins[i] : w_begins[i + 1]]
        m, kind = len(own), np.uint8 if len(own) < 256 else np.int32
        shared = np.zeros(width, kind)
        for g in own[own >= 0]:
            if g in flags:
                shared += flags[g]
            else:
                shared[owners[starts[g] : ends[g]]] += 1
        # The step is a guess that spares scores: it goes down until ``k`` strings are above the bar.
        s = step.get(m, 0)
        above = shared >= bar(m, s, kind)
        while np.count_nonzero(above) < k and s:
            s -= 1
            above = shared >= bar(m, s, kind)
        eights = np.flatnonzero(above.view(np.uint64))
        at = (eights[:, None] * 8 + np.arange(8)).ravel()
        at = at[above[at]]
        step[m] = s + 1 if len(at) > 4 * k else s
        if len(bars) > MOST_BARS:
            bars.clear()
        points = scores(shared, m, at)
        near = points >= LEAST_SIMILARITY - 1e-9
        at, points = at[near], points[near]
        if len(at) < k:  # strings that hold the token but are less similar
            held = holding(r_grams[r_begins[i] : r_begins[i + 1]])
            held = held[pc.match_like(low.take(pa.array(held)), f"%{token}%").to_numpy(zero_copy_only=False)]
            held = held[scores(shared, m, held) < LEAST_SIMILARITY - 1e-9]
            less = scores(shared, m, held)
            if not m:  # without trigrams, equal strings are not similar
                less = np.where(pc.equal(low.take(pa.array(held)), token).to_numpy(zero_copy_only=False), 1.0, less)
            at, points = np.append(at, held), np.append(points, less)
        if len(at) > k:
            last = np.partition(points, len(points) - k)[len(points) - k]
            at, points = at[points >= last], points[points >= last]
        first = np.lexsort((at, -points))[:k]
        out[0].append(np.full(len(first), word)), out[1].append(at[first]), out[2].append(points[first])
    word, at, points = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)
    return pa.table({"word": pa.array(word, pa.int64()), "at": names.column("at").take(pa.array(at.astype(np.int64))), "score": pa.array(points, pa.float64())})


def file_search(tokens: DataFrame, files: DataFrame, k: int = 25) -> DataFrame:
    """(query_id, token, file_id, path, score, rank): files by token, admitted and scored
    by their paths as symbols are by their names. ``files`` (file_id, path[, repository_id]).
    The first ``k`` files of a path stand for all."""
    scope = ["repository_id"] if "repository_id" in tokens.columns and "repository_id" in files.columns else []
    by = ["token", *scope]
    best = likest(tokens, files.select(F.col("path").alias("string"), *scope), k).withColumnRenamed("string", "path")
    heads = files.withColumn("nth", F.row_number().over(Window.partitionBy("path", *scope).orderBy("file_id"))).where(F.col("nth") <= k)
    first = _first(best.join(heads, ["path", *scope]).select(*by, "file_id", "path", "score"), by, ["path", "file_id"], k)
    return tokens.join(first, by).select("query_id", "token", "file_id", "path", "score", "rank")


def type_score(kind: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in TYPE_SCORES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, kind), F.lit(OTHER_TYPE_SCORE))


def one_hop(seeds: DataFrame, relations: DataFrame, most: int = 50) -> DataFrame:
    """(query_id, node, score, types): nodes one relation away from a query's seeds.

    ``seeds`` (query_id, node), ``relations`` (source, target, relationship_type).
    Relations with exactly one end among the seeds, the first ``most`` of them by
    source, target and type; a node scores its best type.
    """
    a = seeds.select("query_id", F.col("node").alias("source"))
    b = seeds.select("query_id", F.col("node").alias("target"))
    out = relations.join(a, "source").select("query_id", "source", "target", "relationship_type", F.lit(1).alias("ends"))
    into = relations.join(b, "target").select("query_id", "source", "target", "relationship_type", F.lit(2).alias("ends"))
    touched = out.union(into).groupBy("query_id", "source", "target", "relationship_type").agg(F.sum("ends").alias("ends"))
    order = Window.partitionBy("query_id").orderBy("source", "target", "relationship_type")
    kept = touched.withColumn("at", F.row_number().over(order)).where((F.col("at") <= most) & (F.col("ends") < 3))
    reached = kept.select("query_id", F.when(F.col("ends") == 1, F.col("target")).otherwise(F.col("source")).alias("node"), "relationship_type")
    return reached.groupBy("query_id", "node").agg(F.max(type_score(F.col("relationship_type"))).alias("score"), F.array_join(F.array_sort(F.collect_set("relationship_type")), ",").alias("types"))


def merge(candidates: DataFrame) -> DataFrame:
    """One row for each (query_id, key): the best score of each source, sources and
    reasons in first-seen order, path and symbol from the first that names one.

    ``candidates`` (query_id, key, source, score, reason, path, symbol_id, start_line, ordinal).
    """
    score = lambda s: F.max(F.when(F.col("source") == s, F.col("score"))).alias(s)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ordinal"))).alias(c)
    reasons = candidates.groupBy("query_id", "key", "source", "reason").agg(F.max("score").alias("score"), F.min("ordinal").alias("ordinal"), first("path"), first("symbol_id"), first("start_line"))
    merged = reasons.groupBy("query_id", "key").agg(
        score("semantic"), score("lexical"), score("structural"), first("path"), first("symbol_id"), first("start_line"), F.min("ordinal").alias("ordinal"),
        F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"),
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "reason"))), lambda r: r.reason).alias("reasons"),
    )
    return merged.withColumn("reasons", F.array_join(F.array_distinct("reasons"), "; "))


def fuse(merged: DataFrame, entry: Column, hotspot: Column, tests: Column) -> DataFrame:
    """``merged`` with ``final_score``: weighted sources and boosts, rounded to 6 places."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    bonus = lambda c, v: F.when(c, v).otherwise(0.0)
    total = SEMANTIC * zero("semantic") + LEXICAL * zero("lexical") + STRUCTURAL * zero("structural") + bonus(entry, ENTRY_BOOST) + bonus(hotspot, HOTSPOT_BOOST) + bonus(tests, TEST_BOOST)
    return merged.withColumn("final_score", F.round(total, 6))


def ranked(fused: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best of each query, by score, path, first line (zero if unknown) and key."""
    order = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "path", F.coalesce("start_line", F.lit(0)), "key")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rerank(ranked_rows: DataFrame, score: Column, pool: int = 10) -> DataFrame:
    """Reorder each query's first ``pool`` rows: scored ones by ``score``, then those without, as they stood."""
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").isNull(), F.desc("rerank_score"), "rank")
    return ranked_rows.where(F.col("rank") <= pool).withColumn("rerank_score", score).withColumn("new_rank", F.row_number().over(order))
