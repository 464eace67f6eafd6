"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, in SQL functions.

The documents of a source, in a seeded random order, form one long run of words, read over again at
most three times.  It is cut into blocks of equal length.  Each source's target becomes an exact
quota of blocks; a binary tree splits the quotas among the output shards, every node drawing what
goes left from the multivariate hypergeometric distribution, so that each shard gets its exact
number of blocks and the sources in it vary as if all blocks had been dealt at random.  A shard's
blocks of a source are a range of the source's run, disjoint from all other shards' ranges; a local
shuffle orders what the shard holds.  The last block of a source is as short as its target asks, so
the words taken are the target to the word and small sources stay.

No source needs to fit a task: the random order is laid out in two steps, a sum per hash range and a
running sum inside each range.  The tables of sources and of shards have one row per source and per
(shard, source).

Defined results: null and blank texts have size 0 and are never taken; a null source is a source of
its own; repeated rows count each for itself; an empty table gives an empty mix.  Without any word
all targets are 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
PASSES = 3
RANGES = 4096  # hash ranges of a source's random order


def sized(df: DataFrame, text: str = "text", source: str = "source", keep: tuple[str, ...] = ("doc_id",), seed: int = 0) -> DataFrame:
    """(keep..., source, size, key): words of each text and its place in the random order."""
    key = F.xxhash64(*keep, text, F.lit(seed))
    return df.select(*keep, F.col(source).alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), key.alias("key"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = PASSES) -> DataFrame:
    """(sid, source, source_size, target) from rows of (source, size).

    Shares of the total by weight, none above ``most`` times its source: what is cut off is shared
    again by weight among the others until none is above.  That is one water level: sources sorted
    by limit over weight, those below the level at their limit, the others at weight times level.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = total.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    limited = named.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(most))
    by_level = Window.orderBy(F.col("limit") / F.col("weight"), "sid")
    before = F.coalesce(F.sum("limit").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(Window.partitionBy()) - before) / rest
    # Where the level first stays below the limit, it stays there for all sources after.
    levels = limited.withColumn("level", level).withColumn("under", F.col("level") * F.col("weight") <= F.col("limit"))
    final = F.min(F.when(F.col("under"), F.struct(F.col("limit") / F.col("weight"), "sid", "level"))).over(Window.partitionBy())["level"]
    return levels.withColumn("target", F.least(F.col("limit"), F.coalesce(final, F.lit(0.0)) * F.col("weight"))).select("sid", "source", "source_size", "target")


# --- drawing ---------------------------------------------------------------------------------


def _let(name: str, value: str, body: str) -> str:
    """SQL in which ``name`` stands for a value that is computed once, however often it is named."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _log_factorial(n: str) -> str:
    """SQL for ln n!, from a list below 16 and by Stirling's series above (error under 1e-12)."""
    small = ", ".join(f"{math.lgamma(i + 1)!r}D" for i in range(16))
    series = f"(z - 0.5D) * ln(z) - z + {0.5 * math.log(2 * math.pi)!r}D + (1D / 12 - (1D / 360 - 1D / (1260 * z * z)) / (z * z)) / z"
    return f"if({n} < 16, element_at(array({small}), cast({n} as int) + 1), {_let('z', f'{n} + 1D', series)})"


def hypergeometric(good: str, bad: str, draws: str, *seed: str) -> Column:
    """Random number of good ones among ``draws`` taken without replacement; arguments are SQL.

    Rejection by ratio of uniforms under the exact log-probability: each trial accepts with
    probability above 0.6, the first accepted of 96 counts.  If none is, the mean does.
    """
    return F.expr(_hypergeometric(good, bad, draws, *seed))


def _hypergeometric(good: str, bad: str, draws: str, *seed: str) -> str:
    spread = "sqrt((p.good + p.bad - p.draws) * p.draws * p.share * (1 - p.share) / greatest(p.good + p.bad - 1, 1D) + 0.5D)"
    bounds = (
        "named_struct('good', p.good, 'bad', p.bad, 'draws', p.draws, 'low', greatest(0D, p.draws - p.bad), 'high', least(p.draws, p.good), "
        f"'middle', p.draws * p.share + 0.5D, 'width', {2 * math.sqrt(2 / math.e)!r}D * {spread} + {3 - 2 * math.sqrt(3 / math.e)!r}D, "
        "'mode', cast(floor((p.draws + 1) * (p.good + 1) / (p.good + p.bad + 2)) as double))"
    )

    def log_weight(k: str) -> str:
        return f"aggregate(array({k}, q.good - {k}, q.draws - {k}, q.bad - q.draws + {k}), 0D, (s, n) -> s - {_log_factorial('n')})"

    def uniform(name: str) -> str:  # in (0, 1), from a hash
        return f"((shiftrightunsigned(xxhash64({', '.join(seed)}, i, '{name}'), 12) + 0.5D) / {1 << 52}D)"

    trial = _let(
        "t", f"named_struct('u', {uniform('u')}, 'k', cast(floor(q.middle + q.width * ({uniform('v')} - 0.5D) / {uniform('u')}) as double))",
        f"if(t.k >= q.low and t.k <= q.high and 2 * ln(t.u) <= {log_weight('t.k')} - peak, t.k, null)",
    )
    # Once a trial is accepted the others are not evaluated.
    first = f"aggregate(sequence(1, 96), cast(null as double), (s, i) -> coalesce(s, {trial}))"
    drawn = f"if(q.low = q.high, q.low, greatest(q.low, least(q.high, coalesce({first}, floor(q.middle)))))"
    given = f"named_struct('good', double({good}), 'bad', double({bad}), 'draws', double({draws}), 'share', double({good}) / greatest(double({good}) + double({bad}), 1D))"
    return _let("p", given, _let("q", bounds, _let("peak", log_weight("q.mode"), drawn)))


def split_tree(quotas: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """(shard, sid, blocks, start): each shard's blocks of each source, as ranges of the source's run.

    ``quotas`` has (sid, quota).  Every level of the tree halves the shards of a node and draws, source
    after source, how many of the node's blocks go to the left half.
    """
    node = quotas.agg(F.sort_array(F.collect_list(F.struct("sid", "quota"))).alias("all")).selectExpr(
        "0 as lo", f"{shards} as hi", "transform(all, x -> x.sid) as sids", "transform(all, x -> double(x.quota)) as quota"
    )
    taken = _hypergeometric("x.q", "state.rest - x.q", "state.need", str(seed), "lo", "hi", "x.sid")
    step = _let("drawn", taken, "named_struct('rest', state.rest - x.q, 'need', state.need - drawn, 'out', concat(state.out, array(drawn)))")
    for _ in range(math.ceil(math.log2(max(1, shards)))):
        node = node.selectExpr("*", "int(floor((lo + hi) / 2)) as middle", "aggregate(quota, 0D, (s, x) -> s + x) as total").selectExpr(
            # A half's size is a rounded share, so sizes add up and shards differ by few blocks.
            "*", "if(hi - lo > 1, double(floor(total * (middle - lo) / (hi - lo) + 0.5D)), total) as need",
        ).selectExpr(
            "*", "aggregate(zip_with(sids, quota, (s, q) -> named_struct('sid', s, 'q', q)), "
            f"named_struct('rest', total, 'need', need, 'out', cast(array() as array<double>)), (state, x) -> {step}).out as left",
        ).selectExpr(
            "sids", "explode(if(hi - lo > 1, array(named_struct('lo', lo, 'hi', middle, 'quota', left), "
            "named_struct('lo', middle, 'hi', hi, 'quota', zip_with(quota, left, (q, x) -> q - x))), array(named_struct('lo', lo, 'hi', hi, 'quota', quota)))) as n",
        )
        # One small row per node; written, so that the next level's plan starts from it.
        node = materialize(node.select("n.lo", "n.hi", "sids", "n.quota"), "mix-tree")
    dealt = node.select(F.col("lo").alias("shard"), F.explode(F.arrays_zip("sids", "quota")).alias("x")).select(
        "shard", F.col("x.sids").alias("sid"), F.col("x.quota").cast("bigint").alias("blocks")
    )
    earlier = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("start", F.coalesce(F.sum("blocks").over(earlier), F.lit(0)))


def mix(rows: DataFrame, plan: DataFrame, shards: int = 16, block_words: int = 64, seed: int = 0, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Sized rows with what the mix takes of them.

    ``rows`` comes from :func:`sized`, written once; ``plan`` from :func:`targets`.  Adds source_size,
    target and ``pieces``: an array of (shard, place, pass, first, words), ``words`` words from word
    ``first`` on, which stand in the shard at the shuffled place of their document in that pass.
    """
    # A source's last block is short, so that the words taken are its target to the word.
    words = F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * PASSES).cast("bigint")
    quotas = plan.withColumn("wanted", words).withColumn("quota", F.ceil(F.col("wanted") / block_words).cast("bigint"))

    def end(block: Column) -> Column:
        return F.least(block * block_words, F.col("wanted"))

    cut_up = split_tree(quotas.select("sid", "quota"), shards, seed).join(quotas.select("sid", "wanted"), "sid")
    ranges = cut_up.groupBy("sid").agg(
        F.sort_array(F.collect_list(F.struct(end(F.col("start")).alias("lo"), end(F.col("start") + F.col("blocks")).alias("hi"), "shard"))).alias("ranges")
    ).withColumn("ranges", F.filter("ranges", lambda r: r["lo"] < r["hi"]))
    sources = materialize(plan.join(ranges, "sid"), "mix-plan")
    part = F.pmod(F.shiftrightunsigned("key", 40), F.lit(RANGES)).cast("int")
    placed = rows.withColumn("part", part).join(sources.select("source", "sid"), rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    before = placed.groupBy("sid", "part").agg(F.sum("size").alias("n")).withColumn(
        "before", F.sum("n").over(Window.partitionBy("sid").orderBy("part")) - F.col("n")
    ).drop("n")
    inside = F.sum("size").over(Window.partitionBy("sid", "part").orderBy("key", *keep).rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    at = placed.withColumn("inside", inside).join(before, ["sid", "part"]).withColumn("at", F.col("before") + F.col("inside")).drop("inside", "before", "part")
    known = at.join(sources.drop("source"), "sid")

    def of_pass(turn: Column) -> Column:
        begin = F.col("at") + F.col("source_size") * turn
        met = F.filter("ranges", lambda r: (F.col("size") > 0) & (r["lo"] < begin + F.col("size")) & (r["hi"] > begin))
        return F.transform(met, lambda r: F.struct(
            r["shard"].alias("shard"), F.xxhash64("key", turn, r["shard"], F.lit(seed)).alias("place"), turn.alias("pass"),
            (F.greatest(r["lo"], begin) - begin).cast("bigint").alias("first"),
            (F.least(r["hi"], begin + F.col("size")) - F.greatest(r["lo"], begin)).cast("bigint").alias("words"),
        ))

    pieces = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(PASSES - 1)), of_pass))
    return known.withColumn("pieces", pieces).drop("sid", "ranges", "at", "key")


def taken() -> Column:
    """Words of a row that the mix takes, repeats counted."""
    return F.aggregate("pieces", F.lit(0).cast("bigint"), lambda s, p: s + p["words"])


def cut(text: Column, first: Column, words: Column, size: Column) -> Column:
    """Those words of a text with the white space between them; the whole text for all words."""
    runs = F.regexp_extract_all(text, F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    return F.when((first == 0) & (words == size), text).otherwise(F.rtrim(F.array_join(F.slice(runs, (first + 1).cast("int"), words.cast("int")), "")))
