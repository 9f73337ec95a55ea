"""Exact and near-duplicate clusters, and representatives.

Near duplicates: equal strings are one vertex. Vertices of a length ratio within reach that
share a rare enough k-gram, or a segment, are compared by edit distance. A vertex becomes a
representative where it has the most uncovered neighbours, in bands of a fourth of a doubling,
among itself and its uncovered neighbours, and covers these; rounds repeat until all are
covered. In a band a hash decides, so the vertices that wait for one another make short chains
and the rounds grow with the logarithm of the texts. Equal strings are always together, every
member meets identity and coverage to its representative, and no two representatives are
within reach of each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import metrics as M
from ledgerlens.operators import edits
from ledgerlens.operators.joins import keep_one
from ledgerlens.plans import compare
from ledgerlens.sources.stage import checkpointed

#: texts of one length that meet others in a block
BLOCK = 4096
#: places of segments in a text, about, beyond which it is compared in blocks
PROBES = 8192
#: texts that candidates are counted on, and pairs of them for each candidate, below which all are compared in tiles
COUNTED, CROWD = 2048, 16
#: links, either way, of texts left to cover that are written as pairs
LINKS = 2_000_000


def exact_clusters(df: DataFrame, text: str, key: str) -> DataFrame:
    """Add ``cluster_rep``: the least key with the same text; null texts are alone."""
    least = df.where(F.col(text).isNotNull()).groupBy(text).agg(F.min(key).alias("_rep"))
    return df.join(least, text, "left").withColumn("cluster_rep", F.coalesce("_rep", F.col(key))).drop("_rep")


def split_clusters(df: DataFrame, text: str, rep: str) -> DataFrame:
    """Texts whose rows have more than one representative: should be none."""
    return df.groupBy(text).agg(F.count_distinct(rep).alias("reps")).where("reps > 1")


def representatives(df: DataFrame, cluster: str, *order: Column | str) -> DataFrame:
    """One row a cluster: the first in a total order."""
    return keep_one(df, [cluster], *order)


random_representatives = compare.random_representatives


def cluster_sizes(df: DataFrame, cluster: str, text: str | None = None) -> DataFrame:
    """One row: sequences, clusters, singletons, compression, largest, share in exact groups."""
    sizes = df.groupBy(cluster).agg(F.count("*").alias("n"))
    out = sizes.agg(
        F.sum("n").cast("long").alias("n_sequences"), F.count("*").alias("n_clusters"), F.count(F.when(F.col("n") == 1, 1)).alias("singletons"),
        F.max("n").alias("largest"), (F.sum("n") / F.count("*")).alias("compression"), (F.count(F.when(F.col("n") == 1, 1)) / F.count("*")).alias("singleton_fraction"),
    )
    if text is None:
        return out
    same = df.groupBy(text).agg(F.count("*").alias("n")).agg((F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("exact_duplicate_fraction"))
    return out.crossJoin(same)  # one row each


def _edits(identity: float, n: Column) -> Column:
    """The most edits between two texts of which the longer has n letters."""
    return F.floor((1 - identity) * n + 1e-9).cast("int")


def _longest(reach: float, n: Column) -> Column:
    """The longest text that one of n letters may be similar to."""
    return F.floor(n / reach + 1e-9).cast("int")


def _cut(identity: float, n: Column, i: Column) -> tuple[Column, Column]:
    """Start (from 0) and length of the i-th of a text's segments, one more than its edits, as even as can be."""
    many = _edits(identity, n) + 1
    short = F.floor(n / many).cast("int")
    first_long = many - n % many
    return i * short + F.greatest(i - first_long, F.lit(0)), short + (i >= first_long).cast("int")


def _segments(probes: DataFrame, index: DataFrame, identity: float, reach: float) -> tuple[DataFrame, DataFrame]:
    """(a, n, i, s) of the segments that texts ask for, and (b, n, i, s) of those that texts have."""
    i = F.explode(F.sequence(F.lit(0), _edits(identity, F.col("n"))))
    start, size = _cut(identity, F.col("n"), F.col("i"))
    held = index.select(F.col("id").alias("b"), "t", "n", i.alias("i")).select("b", "n", "i", F.substring(F.col("t"), start + 1, size).alias("s"))
    lengths = index.select("n").distinct()
    asks = probes.select(F.col("id").alias("a"), "t", F.col("n").alias("m"), F.explode(F.sequence(F.col("n"), _longest(reach, F.col("n")))).alias("n")).join(lengths, "n")
    asks = asks.select("a", "t", "m", "n", i.alias("i"))
    spare = _edits(identity, F.col("n")) - F.col("i")
    low = F.greatest(F.lit(0), start - F.col("i"), start - (F.col("n") - F.col("m")) - spare)
    high = F.least(F.col("m") - size, start + F.col("i"), start - (F.col("n") - F.col("m")) + spare)
    asks = asks.withColumn("size", size).withColumn("low", low).withColumn("high", high).where("low <= high")
    asks = asks.select("a", "t", "n", "i", "size", F.explode(F.sequence("low", "high")).alias("at"))
    return asks.select("a", "n", "i", F.substring(F.col("t"), F.col("at") + 1, F.col("size")).alias("s")).distinct(), held


def segment_pairs(probes: DataFrame, index: DataFrame, identity: float, reach: float) -> DataFrame:
    """(a, b): ids of a probing text and of one that is as long or longer, that share a segment.

    Both have ``id``, ``t`` and ``n`` letters. With d edits at most, one of d + 1 segments of
    the longer text stands unchanged in the shorter, with no more edits before it than there
    are segments before it, and no more after it than after it; so it is looked for at a few
    shifts only. The segments are an inverted index by length, number and letters.
    """
    asks, held = _segments(probes, index, identity, reach)
    return asks.join(held, ["n", "i", "s"]).where("a <> b").select("a", "b")


def _rare_grams(words: DataFrame) -> DataFrame:
    """(id, n, g): the ``keys`` rarest ``grams`` of each text."""
    # rarest grams first, so that the listed ones are held by few texts
    held = words.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("held"))
    # a text's grams are no more than its letters
    ranked = words.select("id", "n", "keys", F.explode("grams").alias("g")).join(held, "g").groupBy("id", "n", "keys").agg(F.array_sort(F.collect_list(F.struct("held", "g"))).alias("all"))
    return ranked.select("id", "n", F.explode(F.slice("all", F.lit(1), F.least(F.size("all"), "keys"))["g"]).alias("g"))


def gram_pairs(words: DataFrame, k: int) -> DataFrame:
    """(a, b): ids of texts that share one of their ``keys`` rarest ``grams``."""
    rows = _rare_grams(words)
    one, two = rows.select(F.col("id").alias("a"), F.col("n").alias("na"), "g"), rows.select(F.col("id").alias("b"), F.col("n").alias("nb"), "g")
    return one.join(two, "g").where("a < b").select("a", "b", "na", "nb")


def block_pairs(asking: DataFrame, words: DataFrame, reach: float) -> DataFrame:
    """(a, b): ids of asking texts with all of a length within reach, in blocks on both sides."""
    other = F.explode(F.sequence(F.ceil(reach * F.col("n") - 1e-9).cast("int"), _longest(reach, F.col("n"))))
    asks = asking.select(F.col("id").alias("a"), other.alias("n"))
    cuts = lambda d, name: d.groupBy("n").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))  # a row for each length
    sizes = cuts(asks, "asked").join(cuts(words, "held"), "n")
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = asks.join(sizes, "n").withColumn("x", part("a", "asked")).withColumn("y", every("held"))
    dealt = words.select(F.col("id").alias("b"), "n").join(sizes, "n").withColumn("y", part("b", "held")).withColumn("x", every("asked"))
    return asks.join(dealt.select("b", "n", "x", "y"), ["n", "x", "y"]).where("a <> b").select("a", "b")


def _texts(df: DataFrame, text: str) -> DataFrame:
    """(t, n): different texts of a letter at least, and their letters."""
    return df.select(text).where(F.col(text).isNotNull() & (F.col(text) != "")).distinct().select(F.col(text).alias("t"), F.length(text).alias("n"))


def _filtered(words: DataFrame, identity: float, reach: float, k: int) -> DataFrame:
    """Add what the filters of candidates need: grams, keys, few (grams for these), brief (segments may be looked for)."""
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.col("n") - k + 1, F.lit(1))), lambda i: F.substring("t", i, F.lit(k))))
    keys = (F.floor((1 - identity) * F.col("n") / identity + 1e-9) * k + 1).cast("int")
    most = _longest(reach, F.col("n"))
    d = _edits(identity, most)
    return words.withColumn("grams", grams).withColumn("keys", keys).withColumn("few", F.size("grams") < F.col("keys")).withColumn("brief", (most - F.col("n") + 1) * (d * d / 2 + d + 1) <= PROBES)


def crowded(words: DataFrame, identity: float, reach: float, k: int = 3) -> bool:
    """Whether the filters would make more candidates than one in ``CROWD`` pairs of texts (t, n).

    They are counted, by key and not as pairs, on about ``COUNTED`` texts chosen by a hash. This decides
    how pairs are found, not which: both ways are exact.
    """
    many = words.count()
    chosen = words.where(F.pmod(F.xxhash64(F.lit("crowd"), "t"), F.lit(1 << 20)) < int(min(1.0, COUNTED / max(1, many)) * (1 << 20)))
    chosen = checkpointed(chosen.withColumn("id", F.monotonically_increasing_id()))
    rows, least = _filtered(chosen, identity, reach, k), chosen.count() * (chosen.count() - 1) / 2 / CROWD
    n = F.col("count").cast("double")
    if (_rare_grams(rows).groupBy("g").count().agg(F.sum(n * (n - 1) / 2)).first()[0] or 0) > least:
        return True
    few, brief, met = rows.where("few"), rows.where("brief"), 0
    if few.isEmpty():
        return False
    for probes, index in ((brief.where("few"), rows), (brief.where("NOT few"), few)):
        asks, held = (d.groupBy("n", "i", "s").agg(F.count("*").cast("double").alias(c)) for d, c in zip(_segments(probes, index, identity, reach), "xy"))
        met += asks.join(held, ["n", "i", "s"]).agg(F.sum(F.col("x") * F.col("y"))).first()[0] or 0
    long = few.where("NOT brief").count()  # these meet all of a length within reach
    return met + long * chosen.count() > least


def similar_pairs(df: DataFrame, text: str, identity: float, coverage: float = 0.8, k: int = 3, tiles: bool | None = None) -> DataFrame:
    """(a, b, identity), a < b, of different texts with at least that identity.

    Identity is 1 - edit distance / longer length. Where most texts are candidates of many others
    (``crowded``), candidates are more work than distances: texts of at most ``edits.LETTERS``
    letters are then compared in tiles, which shuffles texts and no pairs, and only the others go
    on as below. ``tiles`` says so, or not, whatever the texts.
    """
    reach, words = max(coverage, identity), checkpointed(_texts(df, text))
    if not (crowded(words, identity, reach, k) if tiles is None else tiles):
        return _candidate_pairs(words, identity, reach, k)
    pairs = edits.pairs_in_tiles(words.where(F.col("n") <= edits.LETTERS), identity, reach)
    if words.where(F.col("n") > edits.LETTERS).isEmpty():
        return pairs
    beyond = _candidate_pairs(words.where(F.col("n") >= reach * edits.LETTERS - 1e-9), identity, reach, k)
    return pairs.unionByName(beyond.where(F.greatest(F.length("a"), F.length("b")) > edits.LETTERS))


def _candidate_pairs(words: DataFrame, identity: float, reach: float, k: int) -> DataFrame:
    """(a, b, identity) of texts (t, n), a < b. Candidates come from three exact filters:

    * Two texts of n letters with identity t differ in at most (1 - t) n places, each of which
      spoils k of the n - k + 1 k-grams; the texts then share one of the first (1 - t) n k + 1
      k-grams, rarest first, of either (``gram_pairs``).
    * A text of no more k-grams than that, as all are where t is low, meets others by segments
      (``segment_pairs``).
    * Where such a text is so long that it has more than ``PROBES`` places to look for
      segments, it is compared with all of a length within reach, in blocks
      (``block_pairs``). This grows with the square of such texts.

    Distances are computed in the band that the identity allows.
    """
    words = _filtered(checkpointed(words.withColumn("id", F.monotonically_increasing_id())), identity, reach, k)
    plain = words.select("id", "t", "n", "few", "brief")
    pairs = gram_pairs(words, k).where(F.least("na", "nb") >= F.ceil(reach * F.greatest("na", "nb") - 1e-9)).select("a", "b")
    few = plain.where("few")
    if not few.isEmpty():
        brief = plain.where("brief")
        pairs = pairs.unionByName(segment_pairs(brief.where("few"), plain, identity, reach)).unionByName(segment_pairs(brief.where("NOT few"), few, identity, reach))
        if not few.where("NOT brief").isEmpty():
            pairs = pairs.unionByName(block_pairs(few.where("NOT brief"), plain, reach))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda x: plain.select(F.col("id").alias(x), F.col("t").alias(f"t{x}"), F.col("n").alias(f"n{x}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("most", F.greatest("na", "nb"))
    near = F.expr(f"levenshtein(ta, tb, CAST(floor({1 - identity!r} * most + 1e-9) AS INT))")
    met = met.where(F.least("na", "nb") >= reach * F.col("most") - 1e-9).withColumn("d", near).where("d >= 0")
    return met.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"), (1 - F.col("d") / F.col("most")).alias("identity")).where(F.col("identity") >= identity - 1e-12)


def threshold_sensitivity(df: DataFrame, text: str, thresholds: tuple[float, ...] = (0.8, 0.85, 0.9, 0.95), coverage: float = 0.8, categories: dict[str, Column] | None = None) -> DataFrame:
    """(threshold, metric, value): clusters, their Gini and the representatives' diversity at each threshold.

    Identities are computed once, at the least threshold; each threshold covers its own pairs.
    """
    pairs, out = checkpointed(similar_pairs(df, text, min(thresholds), coverage)), None
    rows = df.where(F.col(text).isNotNull())
    for t in thresholds:
        found = cover(rows.select(F.col(text).alias("t")), pairs.where(F.col("identity") >= t - 1e-12))
        clustered = checkpointed(rows.join(found.select(F.col("t").alias(text), F.col("rep").alias("cluster_rep")), text))
        one = M.summary(clustered.groupBy("cluster_rep").agg(F.count("*").alias("n"))).select(F.col("total").cast("double").alias("n_rows"), F.col("categories").cast("double").alias("n_clusters"), F.col("gini").alias("cluster_gini"))
        each = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in one.columns])).alias("m")).select("m.*")
        if categories:
            kept = clustered.where(F.col(text) == F.col("cluster_rep")).dropDuplicates(["cluster_rep"])
            each = each.unionByName(compare.snapshot(kept, categories).where("metric <> 'n_rows'"))
        each = each.select(F.lit(t).alias("threshold"), "metric", "value")
        out = each if out is None else out.unionByName(each)
    return out


def threshold_sweep(pairs: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """Pairs at each threshold, from identities computed once."""
    cuts = F.explode(F.array(*[F.lit(t) for t in thresholds]))
    return pairs.withColumn("threshold", cuts).where(F.col("identity") >= F.col("threshold") - 1e-12).groupBy("threshold").agg(F.count("*").alias("pairs"))


def cover(texts: DataFrame, pairs: DataFrame, text: str = "t", rounds: int = 200) -> DataFrame:
    """(text, rep) by rounds of local maxima among uncovered vertices; fails if ``rounds`` are not enough.

    Of vertices of a band, each with a random priority, a constant share of the edges is
    settled in a round, whatever the graph; a chain of ascending bands is as long as the
    logarithm of the largest degree.
    """
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = checkpointed(both.distinct())
    left, done = checkpointed(texts.select(F.col(text).alias("t")).distinct()), None
    for _ in range(rounds):
        live = both.join(left.select(F.col("t").alias("a")), "a").join(left.select(F.col("t").alias("b")), "b")
        degree = live.groupBy("a").agg(F.count("*").alias("d"))
        rank = left.join(degree, left["t"] == degree["a"], "left").select("t", F.struct((-F.floor(4 * F.log2(F.coalesce("d", F.lit(0)) + 1.0))).alias("d"), F.xxhash64("t").alias("n"), F.col("t").alias("x")).alias("r"))
        best = live.join(rank.select(F.col("t").alias("b"), F.col("r").alias("rb")), "b").groupBy("a").agg(F.min("rb").alias("near"))
        heads = rank.join(best, rank["t"] == best["a"], "left").where(F.col("near").isNull() | (F.col("r") < F.col("near"))).select("t")
        won = live.join(heads.select(F.col("t").alias("b")), "b").groupBy("a").agg(F.min("b").alias("rep")).select(F.col("a").alias("t"), "rep")
        won = checkpointed(heads.select("t", F.col("t").alias("rep")).unionByName(won.join(heads, "t", "left_anti")))
        done = won if done is None else done.unionByName(won)
        left = checkpointed(left.join(won.select("t"), "t", "left_anti"))
        if not left.limit(1).count():
            break
    else:
        raise RuntimeError(f"texts are left uncovered after {rounds} rounds")
    return done.withColumnRenamed("t", text)


def cover_in_tiles(texts: DataFrame, identity: float, reach: float, rounds: int = 200) -> DataFrame:
    """(t, rep) as ``cover`` makes it, for texts of at most ``edits.LETTERS`` letters, without writing their pairs.

    Links are found again, in tiles, for each step of a round: their numbers, then texts that have a
    better neighbour. The best twentieth is asked first, which leaves few texts to compare with
    all. When no more than ``LINKS`` links are left, ``cover`` goes on with their pairs.
    """
    left, done = checkpointed(texts.select("t").distinct()), None
    alike = lambda d: d.withColumn("d", F.lit(0)).withColumn("n", F.lit(0))
    near = lambda d: edits.neighbours_in_tiles(d.where("t <> ''"), identity, reach)
    for _ in range(rounds):
        degree = near(alike(left).withColumn("asks", F.lit(True))).select("t", "links")
        rank = checkpointed(left.join(degree, "t", "left").select("t", "links", (-F.floor(4 * F.log2(F.coalesce("links", F.lit(0)) + 1.0))).alias("d"), F.xxhash64("t").alias("n")))
        if (rank.agg(F.sum("links")).first()[0] or 0) <= LINKS:
            won = cover(left, edits.pairs_in_tiles(left.where("t <> ''"), identity, reach)).select("t", "rep")
            return won if done is None else done.unionByName(won)
        best, open_ = rank.approxQuantile("d", [0.05], 0.01)[0], rank.withColumn("asks", F.lit(True))
        for asking in (F.col("d") <= best, F.lit(True)):
            met = near(rank.join(open_.select("t", "asks"), "t", "left").select("t", "d", "n", (F.coalesce("asks", F.lit(False)) & asking).alias("asks")))
            open_ = checkpointed(open_.join(met.select("t", "near"), "t", "left").where(F.col("near").isNull() | (F.struct("d", "n", F.col("t").alias("x")) < F.col("near"))).drop("near"))
        heads = open_.select("t", "asks")
        met = near(alike(left.join(heads, "t", "left").withColumn("asks", F.coalesce("asks", F.lit(False))))).select("t", F.col("near.x").alias("rep"))
        won = checkpointed(heads.select("t", F.col("t").alias("rep")).unionByName(met.join(heads, "t", "left_anti")))
        done = won if done is None else done.unionByName(won)
        left = checkpointed(left.join(won.select("t"), "t", "left_anti"))
        if left.isEmpty():
            return done
    raise RuntimeError(f"texts are left uncovered after {rounds} rounds")


def near_clusters(df: DataFrame, text: str, identity: float = 0.9, coverage: float = 0.8, k: int = 3, tiles: bool | None = None) -> DataFrame:
    """Add ``cluster_rep``, a text, to every row; ``tiles`` as in ``similar_pairs``."""
    texts, reach = df.select(F.col(text).alias("t")).where("t IS NOT NULL"), max(coverage, identity)
    words = checkpointed(_texts(df, text))
    if tiles is None:
        tiles = crowded(words, identity, reach, k)
    if tiles and words.where(F.col("n") > edits.LETTERS).isEmpty():
        found = cover_in_tiles(texts, identity, reach)
    else:
        found = cover(texts, similar_pairs(words, "t", identity, coverage, k, tiles))
    return df.join(found.withColumnRenamed("t", text).withColumnRenamed("rep", "cluster_rep"), text, "left")


def top_clusters(df: DataFrame, cluster: str, k: int) -> DataFrame:
    return df.groupBy(cluster).agg(F.count("*").alias("n")).orderBy(F.desc("n"), cluster).limit(k)


def duplicated_parts(parts: Column) -> Column:
    """Whether an entity has byte-identical non-empty parts."""
    full = F.filter(parts, lambda p: p.isNotNull() & (p != ""))
    return F.size(F.array_distinct(full)) < F.size(full)
