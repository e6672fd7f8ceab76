"""Sign quantisation, token statistics and sampling from logits, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickflow.functions.scalars import keyed_uniform
from wickflow.operators.quantiles import percentiles
from wickflow.schema import PRICES

BITS = 10
CODES = 1 << BITS


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.try_divide(x.cast("double"), norm))


def sign_quantize(v: Column) -> Column:
    """+1 for positive elements and -1 for others, over the root of the length."""
    unit = 1.0 / F.sqrt(F.size(v).cast("double"))
    return F.transform(v, lambda x: F.when(x > 0, unit).otherwise(-unit))


def bits_to_index(v: Column) -> Column:
    """The number whose bit i is set if element i is positive."""
    powers = F.transform(v, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1), i)).otherwise(F.lit(0)))
    return F.aggregate(powers, F.lit(0), lambda a, x: a + x)


def index_to_bits(token: Column, width: int) -> Column:
    scale = 1.0 / float(width) ** 0.5
    return F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda i: (F.call_function("shiftright", token, i).bitwiseAND(F.lit(1)) * 2 - 1) * F.lit(scale),
    )


def split_token(token: Column, bits: int = BITS) -> tuple[Column, Column]:
    """The low and the high code of a composite token."""
    mask = F.lit((1 << bits) - 1)
    return token.bitwiseAND(mask), F.shiftright(token, bits).bitwiseAND(mask)


def join_token(s1: Column, s2: Column, bits: int = BITS) -> Column:
    return s1 + F.shiftleft(s2, bits)


def last_rows(tokens: DataFrame, keys: tuple[str, ...], order: str, n: int = 15) -> DataFrame:
    """The last n rows of each key."""
    latest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return tokens.withColumn("back", latest).where(F.col("back") <= n).drop("back")


def token_frequency(tokens: DataFrame, token: str, n: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(token, n, share of the most frequent), most frequent first and by keys; with n, the first n of each key."""
    counts = tokens.groupBy(*keys, F.col(token).alias("token")).agg(F.count("*").alias("n"))
    if not keys:
        top = counts.agg(F.max("n").alias("most"))
        ranked = counts.join(F.broadcast(top)).select("token", "n", (F.col("n") / F.col("most")).alias("share"))
        ranked = ranked.orderBy(F.desc("n"), "token")
        return ranked if n is None else ranked.limit(n)
    whole = Window.partitionBy(*keys)
    place = F.row_number().over(whole.orderBy(F.desc("n"), "token"))
    ranked = counts.select(*keys, "token", "n", (F.col("n") / F.max("n").over(whole)).alias("share"), place.alias("place"))
    return (ranked if n is None else ranked.where(F.col("place") <= n)).drop("place")


def token_histogram(tokens: DataFrame, token: str, codes: int = CODES) -> DataFrame:
    """(token, n) for each code of the book, 0 where none came."""
    counts = tokens.groupBy(F.col(token).cast("long").alias("id")).agg(F.count("*").alias("n"))
    book = tokens.sparkSession.range(codes)
    return book.join(counts, "id", "left").select(F.col("id").alias("token"), F.coalesce("n", F.lit(0)).alias("n"))


def utilisation(tokens: DataFrame, names: tuple[str, ...] = ("s1", "s2"), codes: int = CODES) -> DataFrame:
    """Distinct codes in % of the book, for each column."""
    return tokens.agg(*(F.countDistinct(c).alias(c) for c in names)).unpivot([], list(names), "code", "used").select(
        "code", "used", (F.col("used") * 100.0 / codes).alias("used_pct")
    )


def code_bitmaps(tokens: DataFrame, day: str, names: tuple[str, ...] = ("s1", "s2")) -> DataFrame:
    """(day, code, bucket, used): which codes a day has, as bitmaps. Days are kept as they come and merged for any range later."""
    long = tokens.unpivot([day], list(names), "code", "token").where("token is not null").withColumn("token", F.col("token").cast("long") + 1)
    bit = F.bitmap_construct_agg(F.bitmap_bit_position("token"))
    return long.groupBy(F.col(day).alias("day"), "code", F.bitmap_bucket_number("token").alias("bucket")).agg(bit.alias("used"))


def utilisation_between(bitmaps: DataFrame, first, last, codes: int = CODES) -> DataFrame:
    """utilisation of the days from first to last, from code_bitmaps alone; codes that several days have count once."""
    merged = bitmaps.where(F.col("day").between(first, last)).groupBy("code", "bucket").agg(F.bitmap_or_agg("used").alias("used"))
    counts = merged.groupBy("code").agg(F.sum(F.bitmap_count("used")).alias("used"))
    return counts.select("code", "used", (F.col("used") * 100.0 / codes).alias("used_pct"))


def kl_drift(p: DataFrame, q: DataFrame, epsilon: float = 1e-10) -> DataFrame:
    """One row, kl: KL divergence of two histograms (token, n) with epsilon on each count."""
    both = p.select("token", (F.col("n") + epsilon).alias("a")).join(q.select("token", (F.col("n") + epsilon).alias("b")), "token")
    sums = both.agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    pa, pb = F.col("a") / F.col("sa"), F.col("b") / F.col("sb")
    return both.join(F.broadcast(sums)).agg(F.sum(pa * F.log(pa / pb)).alias("kl"))


def drift_from_first(counts: DataFrame, codes: int = CODES, epsilon: float = 1e-10) -> DataFrame:
    """(model, run, code, kl, used_pct): how far each run's codes are from those of the model's first run. counts: model, run, code, token, n.

    Both are made shares over the whole book with epsilon on each count, and epsilon is added to the shares again before the divergence.
    Tokens that neither run has are counted, not joined, so only occurring tokens move. Rows of n = 0 or without a token are as if absent;
    a run without any token in a code has no row for it, and a code that the first run lacks is held against equal shares.
    """
    key = ["model", "code"]
    rows = counts.where("n > 0 and token is not null").groupBy(*key, "run", "token").agg(F.sum("n").alias("n"))
    start = counts.groupBy("model").agg(F.min("run").alias("run"))
    total = F.sum("n").over(Window.partitionBy(*key, "run"))
    rows = rows.withColumn("a", (F.col("n") + epsilon) / (total + codes * epsilon) + epsilon).withColumn("none", epsilon / (total + codes * epsilon) + epsilon)
    first = rows.join(start, ["model", "run"], "left_semi").select(*key, "token", F.log("a").alias("lb"), F.log("none").alias("lb_none"))
    whole = first.groupBy(*key).agg(F.count("*").alias("f"), F.sum("lb").alias("lb_all"), F.first("lb_none").alias("lb_other"))
    held = rows.join(first.select(*key, "token", "lb"), [*key, "token"], "left").join(whole, key, "left")
    equal = F.log(F.lit(1.0 / codes + epsilon))
    held = held.withColumns({"f": F.coalesce("f", F.lit(0)), "lb_all": F.coalesce("lb_all", F.lit(0.0)), "lb_other": F.coalesce("lb_other", equal)})
    figures = held.groupBy("model", "run", "code").agg(
        F.sum(F.col("a") * (F.log("a") - F.coalesce("lb", "lb_other"))).alias("there"),
        F.count("*").alias("r"),
        F.count("lb").alias("both"),
        F.coalesce(F.sum("lb"), F.lit(0.0)).alias("lb_both"),
        *(F.first(c).alias(c) for c in ("none", "f", "lb_all", "lb_other")),
    )
    z, lz = F.col("none"), F.log("none")
    only_first = z * ((F.col("f") - F.col("both")) * lz - (F.col("lb_all") - F.col("lb_both")))
    neither = (codes - F.col("r") - F.col("f") + F.col("both")) * z * (lz - F.col("lb_other"))
    kl = (F.col("there") + only_first + neither) / (1 + codes * epsilon)
    return figures.select("model", "run", "code", kl.alias("kl"), (F.col("r") * 100.0 / codes).alias("used_pct"))


def softmax(logits: DataFrame, key: str, logit: str = "logit", temperature: float = 1.0) -> DataFrame:
    whole = Window.partitionBy(key)
    x = F.col(logit).cast("double") / temperature
    rows = logits.withColumn("e", F.exp(x - F.max(x).over(whole)))
    return rows.withColumn("p", F.col("e") / F.sum("e").over(whole)).drop("e")


def filter_logits(
    logits: DataFrame, key: str, token: str = "token", logit: str = "logit", temperature: float = 1.0, top_k: int = 0, top_p: float = 1.0
) -> DataFrame:
    """Softmax over the tokens that stay. top_k keeps ties with the k-th logit and goes before top_p, which keeps a token
    if those before it hold top_p or less, so the first always stays.
    """
    order = Window.partitionBy(key).orderBy(F.desc(logit), token)
    rows = softmax(logits, key, logit, temperature)
    if top_k > 0:
        rows = rows.withColumn("at", F.rank().over(Window.partitionBy(key).orderBy(F.desc(logit)))).where(F.col("at") <= top_k)
        rows = rows.drop("at")
    elif top_p < 1.0:
        before = F.coalesce(F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        rows = rows.withColumn("before", before).where(F.col("before") <= top_p).drop("before")
    return rows.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy(key)))


def draw(filtered: DataFrame, key: str, token: str = "token", seed: int = 42) -> DataFrame:
    """One token for each key: the first whose running probability is above a number that depends on seed and key alone."""
    order = Window.partitionBy(key).orderBy(F.desc("p"), token)
    rows = filtered.withColumn("upto", F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    u = keyed_uniform(F.lit(seed), F.col(key))
    rows = rows.withColumn("hit", F.col("upto") > u)
    best = F.min(F.struct(~F.col("hit"), F.when(F.col("hit"), -F.col("p")).otherwise(F.col("p")), F.col(token).alias("token")))
    return rows.groupBy(key).agg(best.alias("b")).select(key, F.col("b.token").alias("token"))


def arg_max(logits: DataFrame, key: str, token: str = "token", logit: str = "logit") -> DataFrame:
    best = F.max(F.struct(F.col(logit), -F.col(token)))
    return logits.groupBy(key).agg(best.alias("b")).select(key, (-F.col("b.col2")).alias("token"))


def entropy(probabilities: DataFrame, key: str) -> DataFrame:
    return probabilities.groupBy(key).agg((-F.sum(F.col("p") * F.log(F.col("p") + 1e-8))).alias("entropy"))


def recon_error(pairs: DataFrame, keys: tuple[str, ...] = ("model", "feature")) -> DataFrame:
    """pairs: x and y, the original and its reconstruction. MAPE and MdAPE in %, and MAE."""
    ape = F.abs(F.col("x") - F.col("y")) / F.greatest(F.abs("x"), F.lit(1e-5)) * 100
    means = pairs.groupBy(*keys).agg(F.avg(ape).alias("mape"), F.avg(F.abs(F.col("x") - F.col("y"))).alias("mae"))
    medians = percentiles(pairs, list(keys), ape, [0.5]).select(*keys, F.col("q")[0].alias("mdape"))
    return means.join(medians, list(keys), "left").select(*keys, "mape", "mdape", "mae")


def recon_criteria(errors: DataFrame, models: tuple[str, str, str]) -> DataFrame:
    """By feature: whether the last model's MAPE beats the second's and that the first's, and whether it is within limits.

    Prices have to keep their MAPE below 2 %, volume and amount their MdAPE below 30 %.
    """
    first, second, last = models
    wide = errors.groupBy("feature").pivot("model", list(models)).agg(F.first("mape").alias("mape"), F.first("mdape").alias("mdape"))
    mape = {m: F.col(f"{m}_mape") for m in models}
    return wide.select(
        "feature",
        (mape[last] < mape[second]).alias("beats_second"),
        (mape[second] < mape[first]).alias("second_beats_first"),
        F.when(F.col("feature").isin("open", "high", "low", "close"), mape[last] < 2.0).otherwise(F.col(f"{last}_mdape") < 30.0).alias("within_limit"),
    )


def pretokenize(arrays: DataFrame) -> DataFrame:
    """(symbol, start, s1, s2): codes of each row of window_arrays, in order, from the signs of price and size z-scores.

    It is to be written once as Parquet and read for each training run, with the stamps of export_windows beside it.
    """

    def codes(names: tuple[str, ...]) -> Column:
        return F.transform(F.arrays_zip(*(f"z_{c}" for c in names)), lambda r: bits_to_index(F.array(*(r[f"z_{c}"] for c in names))))

    return arrays.select("symbol", "start", codes(PRICES).alias("s1"), codes(("volume", "amount")).alias("s2"))
