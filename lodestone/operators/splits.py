"""Deterministic splits: roles by the order of a hash, never by chance.

The order is that of md5(seed:id), which any engine can compute. Where a role depends on a rank inside the whole
table, ranks are exact: partitions are numbered by ranges of the hash and counts are added up, so no
single task sorts the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def order_key(id_col: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), id_col.cast("string")))


#: Values of a column, at most, that each row may be multiplied by.
MOST_SPLITS = 10_000


def global_rank(df: DataFrame, key: str, name: str = "rank", groups: list[str] | None = None, size: str | None = None, digits: int = 3) -> DataFrame:
    """Rank from 1 by a key of hexadecimal digits, exact, in the whole table or in each of the groups: rank in a bucket of the key's first digits, plus the sizes of the buckets before.

    size: the column that gets the number of rows of the group. A task sorts a bucket, 16**digits to a group, so a group may be the whole table; with more rows than some 100,000 a bucket, take another digit.
    """
    groups = groups or []
    bucketed = df.withColumn("__b", F.substring(key, 1, digits))
    sizes = bucketed.groupBy(*groups, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = (F.sum("__n").over(W.partitionBy(*groups).orderBy("__b")) - F.col("__n")).alias("__before")
    table = sizes.select(*[F.col(c).alias(f"__g_{c}") for c in groups], F.col("__b").alias("__c"), before, F.sum("__n").over(W.partitionBy(*groups)).alias("__size"))
    ranked = bucketed.withColumn("__r", F.row_number().over(W.partitionBy(*groups, "__b").orderBy(key)))
    condition = F.col("__b") == F.col("__c")
    for c in groups:
        condition &= F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    # Without groups, 16**digits rows at most.
    out = ranked.join(table if groups or digits > 4 else F.broadcast(table), condition).withColumn(name, F.col("__r") + F.col("__before"))
    out = out.withColumn(size, F.col("__size")) if size else out
    return out.drop("__b", "__c", "__r", "__before", "__size", *[f"__g_{c}" for c in groups])


def by_shares(df: DataFrame, shares: list[tuple[str, float]], id_col: str, seed: int = 42, strata: list[str] | None = None, role: str = "role") -> DataFrame:
    """Roles by rank: the first floor(share x n) rows of the order, the next ones, ...; the last role takes the rest.

    strata: ranks and sizes inside each group of these columns; a group may be as large as the table.
    """
    ranked = global_rank(df.withColumn("__k", order_key(F.col(id_col), seed)), "__k", "__rank", strata, "__rows")
    out, end = F.lit(shares[-1][0]), F.lit(0)
    bounds = []
    for name, share in shares[:-1]:
        end = end + F.floor(F.col("__rows") * share)
        bounds.append((name, end))
    for name, end in reversed(bounds):
        out = F.when(F.col("__rank") <= end, name).otherwise(out)
    return ranked.withColumn(role, out).drop("__k", "__rank", "__rows")


def by_values(df: DataFrame, column: str, groups: dict[str, list[str]], role: str = "role") -> DataFrame:
    """Roles by the value of a column (temporal holdout); rows of no group are left out."""
    out = F.coalesce(*[F.when(F.col(column).isin(vs), name) for name, vs in groups.items()])
    return df.withColumn(role, out).where(F.col(role).isNotNull())


def leave_one_out(df: DataFrame, column: str, id_col: str, least: int = 100, share: float = 0.9, seed: int = 42) -> DataFrame:
    """For each value that has `least` rows: its rows are the test set, the others are 90/10 train and valid, by hash.

    Long form: split, role, id. A row's place in the hash order of the whole table decides, so each split is disjoint and complete.
    """
    held = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(F.col(column).alias("split"))
    threshold = f"{int(share * 0xFFFFFFFF):08x}"
    keyed = df.select(F.col(id_col).alias("id"), F.col(column).alias("__v"), F.substring(order_key(F.col(id_col), seed), 1, 8).alias("__h"))
    role = F.when(F.col("__v") == F.col("split"), "test").when(F.col("__h") <= threshold, "train").otherwise("valid")
    n = held.count()
    if n > MOST_SPLITS:
        raise ValueError(f"{column} has {n} values with {least} rows, and each row goes to each: {MOST_SPLITS} at most")
    # As many rows as counted; the table is read once and each row goes to each split.
    return keyed.crossJoin(F.broadcast(held)).select("split", role.alias("role"), "id")


#: As the test side of an experiment: all rows without a tag of the train side.
ALL_OTHER = "all-other"


def by_tags(df: DataFrame, experiments: list[tuple[str, list[str], list[str]]], id_col: str, tags_col: str, least: int = 50, compounds: dict[str, list[str]] | None = None) -> DataFrame:
    """Experiments of (name, train tags, test tags): rows with any of the tags; rows of both sides are left out; sides below `least` rows drop the experiment. Long form: split, role, id.

    Test tags may be [ALL_OTHER]. compounds: names that stand for several tags, one level deep.
    """
    whole = lambda tags: [x for t in tags for x in (compounds or {}).get(t, [t])]
    text = lambda tags: F.array(*map(F.lit, tags)).cast("array<string>")
    items = F.explode(F.array(*[F.struct(F.lit(n).alias("split"), text(whole(a)).alias("a"), text([] if b == [ALL_OTHER] else whole(b)).alias("b"), F.lit(b == [ALL_OTHER]).alias("other")) for n, a, b in experiments]))
    rows = df.select(F.col(id_col).alias("id"), F.col(tags_col).alias("tags")).withColumn("e", items)
    train = F.arrays_overlap("tags", "e.a")
    test = F.when(F.col("e.other"), ~train).otherwise(F.arrays_overlap("tags", "e.b"))
    rows = rows.where(train != test).select(F.col("e.split").alias("split"), F.when(train, "train").otherwise("test").alias("role"), "id")
    sizes = rows.groupBy("split").agg(F.count_if(F.col("role") == "train").alias("a"), F.count_if(F.col("role") == "test").alias("b")).where((F.col("a") >= least) & (F.col("b") >= least))
    return rows.join(sizes.select("split"), "split", "left_semi")


def parse_pairs(spec: str) -> tuple[list[str], list[str]]:
    """"a,b -> c,d" as two lists."""
    left, _, right = spec.partition("->")
    return [x.strip() for x in left.split(",") if x.strip()], [x.strip() for x in right.split(",") if x.strip()]


def cross_pairs(df: DataFrame, signature: str, ordinal: str, id_col: str) -> DataFrame:
    """Pairs of rows with one signature and different ordinals: signature, id_old, id_new.

    An equi-join with an inequality; its size is the size of the result, so signatures that a large share of all rows have are to be left out before.
    """
    a = df.select(F.col(signature).alias("signature"), F.col(ordinal).alias("oa"), F.col(id_col).alias("id_old"))
    b = df.select(F.col(signature).alias("sb"), F.col(ordinal).alias("ob"), F.col(id_col).alias("id_new"))
    return a.join(b, (F.col("signature") == F.col("sb")) & (F.col("oa") < F.col("ob"))).select("signature", "id_old", "id_new")


def cross_links(df: DataFrame, signature: str, ordinal: str, id_col: str) -> DataFrame:
    """What cross_pairs links, without its pairs: id, signature, n_older and n_newer (rows of the same signature with a smaller and a larger ordinal).

    Rows are counted by signature and ordinal first, so a signature costs as much as it has ordinals, however many rows it has. Rows without a signature or an ordinal link with nothing.
    """
    known = df.where(F.col(signature).isNotNull() & F.col(ordinal).isNotNull())
    counts = known.groupBy(F.col(signature).alias("__s"), F.col(ordinal).alias("__o")).agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(W.partitionBy("__s").orderBy("__o"))
    counts = counts.select("__s", "__o", (upto - F.col("__n")).alias("n_older"), (F.sum("__n").over(W.partitionBy("__s")) - upto).alias("n_newer"))
    return known.select(F.col(id_col).alias("id"), F.col(signature).alias("signature"), F.col(ordinal).alias("__r")).join(counts, (F.col("signature") == F.col("__s")) & (F.col("__r") == F.col("__o"))).select("id", "signature", "n_older", "n_newer")


def capped(df: DataFrame, group: str, order: list[str], most: int) -> DataFrame:
    """The first rows of each group, by an explicit order."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("__n") <= most).drop("__n")


def topped_up(main: DataFrame, extra: DataFrame, group: str, order: list[str], least: int) -> DataFrame:
    """main, and rows of extra, in order, for groups that have fewer than `least` rows."""
    have = main.groupBy(group).agg(F.count(F.lit(1)).alias("__have")).withColumnRenamed(group, "__g")
    ranked = extra.withColumn("__n", F.row_number().over(W.partitionBy(group).orderBy(*order)))
    # A constant limit, so that each task passes on no more than that of a group.
    ranked = ranked.where(F.col("__n") <= least)
    needed = ranked.join(have, F.col(group) == F.col("__g"), "left").where(F.col("__n") <= least - F.coalesce("__have", F.lit(0)))
    return main.unionByName(needed.select(*main.columns))


def shuffled_labels(df: DataFrame, label: str, group: str, id_col: str, seed: int = 42) -> DataFrame:
    """Labels dealt anew inside each group: the i-th row by one hash of the id gets the label of the i-th row by another. Ranks are exact, and a group may be as large as the table."""
    a = global_rank(df.withColumn("__k", order_key(F.col(id_col), seed + 1)), "__k", "__i", [group]).drop("__k")
    b = global_rank(df.select(group, F.col(label).alias("shuffled"), order_key(F.col(id_col), seed).alias("__k")), "__k", "__j", [group])
    b = b.select(F.col(group).alias("__g"), "shuffled", "__j")
    return a.join(b, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__i") == F.col("__j"))).drop("__i", "__j", "__g")


def without_overlap(train: DataFrame, test: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Both sides without the ids that are in both."""
    both = train.select(id_col).intersect(test.select(id_col))
    return train.join(both, id_col, "left_anti"), test.join(both, id_col, "left_anti")


def both_directions(df: DataFrame, side: Column, names: tuple[str, str], id_col: str, share: float = 0.9, seed: int = 42) -> DataFrame:
    """Two splits: one side trains (the first share of its hash order) and validates, the other is the test set; and the other way round. Long form: split, role, id."""
    rows = df.select(F.col(id_col).alias("id"), side.alias("first")).where(F.col("first").isNotNull())
    ranked = by_shares(rows.where("first"), [("train", share), ("valid", 1 - share)], "id", seed).unionByName(by_shares(rows.where("NOT first"), [("train", share), ("valid", 1 - share)], "id", seed))
    forth, back = f"{names[0]}_to_{names[1]}", f"{names[1]}_to_{names[0]}"
    own = F.when(F.col("first"), F.array(F.struct(F.lit(forth).alias("split"), F.col("role").alias("role")), F.struct(F.lit(back).alias("split"), F.lit("test").alias("role"))))
    other = F.array(F.struct(F.lit(back).alias("split"), F.col("role").alias("role")), F.struct(F.lit(forth).alias("split"), F.lit("test").alias("role")))
    return ranked.select(F.explode(own.otherwise(other)).alias("e"), "id").select("e.split", "e.role", "id")


def balanced_directions(df: DataFrame, side: Column, names: tuple[str, str], id_col: str, seed: int = 42) -> DataFrame:
    """Both directions with sides of one size: of the larger side, the first rows of the hash order. Long form: split, role, id."""
    rows = df.select(F.col(id_col).alias("id"), side.alias("first")).where(F.col("first").isNotNull()).withColumn("__k", order_key(F.col("id"), seed))
    a, b = (global_rank(rows.where(c), "__k") for c in ("first", "NOT first"))
    least = rows.agg(F.least(F.count_if("first"), F.count_if(~F.col("first"))).alias("least"))
    kept = a.unionByName(b).crossJoin(F.broadcast(least)).where("rank <= least")
    forth, back = f"{names[0]}_to_{names[1]}", f"{names[1]}_to_{names[0]}"
    roles = F.array(F.struct(F.lit(forth).alias("split"), F.when(F.col("first"), "train").otherwise("test").alias("role")), F.struct(F.lit(back).alias("split"), F.when(F.col("first"), "test").otherwise("train").alias("role")))
    return kept.select(F.explode(roles).alias("e"), "id").select("e.split", "e.role", "id")


def family_split(df: DataFrame, column: str, train: list[str], id_col: str, most: int = 5000, seed: int = 42) -> DataFrame:
    """One family of values trains, the others are the test set; of the first, min(most, a tenth) rows of the hash order validate: role, id."""
    rows = df.select(F.col(id_col).alias("id"), F.col(column).isin(train).alias("first")).where(F.col("first").isNotNull()).withColumn("__k", order_key(F.col("id"), seed))
    own = global_rank(rows.where("first"), "__k").crossJoin(F.broadcast(rows.agg(F.count_if("first").alias("n"))))
    own = own.select(F.when(F.col("rank") <= F.least(F.lit(most), F.floor(F.col("n") / 10)), "valid").otherwise("train").alias("role"), "id")
    return own.unionByName(rows.where("NOT first").select(F.lit("test").alias("role"), "id"))


def value_pairs(df: DataFrame, column: str, least: int = 100) -> DataFrame:
    """All ordered pairs of values that have `least` rows each: train, test. There are as many rows as pairs of values."""
    found = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    a, b = found.select(F.col(column).alias("train")), found.select(F.col(column).alias("test"))
    return a.join(b, F.col("train") != F.col("test"))


def weighted_choice(key: Column, choices: list[tuple[str, float]]) -> Column:
    """One of the choices by weight: the first eight digits of a hash (hexadecimal) against the running share."""
    total, end, out = sum(w for _, w in choices), 0.0, None
    for name, weight in choices[:-1]:
        end += weight
        at = F.substring(key, 1, 8) < f"{int(end / total * (1 << 32)):08x}"
        out = F.when(at, name) if out is None else out.when(at, name)
    return F.lit(choices[-1][0]) if out is None else out.otherwise(choices[-1][0])
