"""Perturbed texts: one row to several, by ordered tables of phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import lexicons as L
from lodestone.functions import vectors as V


def replace_first(text: Column, phrase: str, new: str) -> Column:
    """The first occurrence of a phrase, whatever its case."""
    quoted = "".join(f"\\{c}" if not c.isalnum() and c != " " else c for c in phrase)
    return F.regexp_replace(text, rf"(?is)^(.*?){quoted}", "$1" + new.replace("\\", "\\\\").replace("$", "\\$"))


def swapped_roles(text: Column, swaps: list[tuple[str, str]] = L.ROLE_SWAPS) -> Column:
    """The first swap that changes the text; null if none does."""
    tries = [F.regexp_replace(text, f"(?iU){p}", r) for p, r in swaps]
    return F.coalesce(*[F.when(x != text, x) for x in tries])


def structural(text: Column, families: dict[str, list[tuple[str, str]]] = L.PHRASES) -> Column:
    """struct<text, kind>: a role swap, else the first phrase pair that changes the text; null without one."""
    swap = swapped_roles(text)
    options = [F.when(swap.isNotNull(), F.struct(swap.alias("text"), F.lit("role_swap").alias("kind")))]
    for kind, pairs in families.items():
        for old, new in pairs:
            options.append(F.when(F.contains(F.lower(text), F.lit(old)), F.struct(replace_first(text, old, new).alias("text"), F.lit(kind).alias("kind"))))
    return F.coalesce(*options)


def fuzz(df: DataFrame, families: dict[str, list[tuple[str, str]]], id_col: str, text_col: str) -> DataFrame:
    """One row per text and phrase that it holds: id, kind, old, text with all occurrences of the phrase replaced."""
    items = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(a).alias("old"), F.lit(b).alias("new")) for k, pairs in families.items() for a, b in pairs])
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).withColumn("p", F.explode(F.filter(items, lambda p: F.contains(F.col("t"), p["old"]))))
    return rows.select("id", F.col("p.kind").alias("kind"), F.col("p.old").alias("old"), F.replace("t", "p.old", "p.new").alias("text"))


def renamed(text: Column, pools: dict[str, list[str]]) -> Column:
    """The first name of a pool that the text holds, replaced by the next one of the pool; null without one."""
    options = []
    for names in pools.values():
        for name, other in zip(names, names[1:] + names[:1], strict=True):
            out = F.regexp_replace(text, rf"(?U)\b{name}\b", other)
            options.append(F.when(out != text, out))
    return F.coalesce(*options)


def synonyms(text: Column, table: dict[str, str]) -> Column:
    """The first word of the table that the text holds, replaced; null without one."""
    return F.coalesce(*[F.when(text.rlike(rf"(?iU)\b{a}\b"), F.regexp_replace(text, rf"(?iU)\b{a}\b", b)) for a, b in table.items()])


def chance(key: Column, *salt: Column | str) -> Column:
    """A number from 0 to below 1 for a row, by the MD5 of its key and a salt, which every engine can work out."""
    text = F.concat_ws(":", key.cast("string"), *[F.lit(s) if isinstance(s, str) else s.cast("string") for s in salt])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def chosen(options: Column, draw: Column) -> Column:
    """The element of an array that a number from 0 to below 1 points at."""
    return F.get(options, F.floor(draw * F.size(options)).cast("int"))


def some_synonyms(text: Column, key: Column, table: dict[str, list[str]], share: float = 0.3) -> Column:
    """Of the words that the table has (without ".,!?" around them, in lower case), each with a chance of `share` becomes one of its synonyms, with a capital where it had one; words are joined by single spaces."""
    lookup = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in table.items() for x in pair])
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")

    def swap(w: Column, i: Column) -> Column:
        bare = F.btrim(F.lower(w), F.lit(".,!?"))
        options = F.try_element_at(lookup, bare)
        new = chosen(options, chance(key, "synonym", i))
        first = F.substring(w, 1, 1)
        new = F.when((F.upper(first) == first) & (F.lower(first) != first), F.concat(F.upper(F.substring(new, 1, 1)), F.lower(F.substr(new, F.lit(2))))).otherwise(new)
        return F.when(options.isNotNull() & (chance(key, "swap", i) < share), F.concat(new, F.substr(w, F.char_length(bare) + 1))).otherwise(w)

    return F.array_join(F.transform(words, swap), " ")


def another_name(text: Column, key: Column, names: list[str]) -> Column:
    """The first of the names that the text holds becomes another one of them, everywhere."""
    out = text
    for i in range(len(names) - 1, -1, -1):
        others = F.array(*[F.lit(n) for n in names if n != names[i]])
        out = F.when(F.contains(text, F.lit(names[i])), F.replace(text, F.lit(names[i]), chosen(others, chance(key, "name")))).otherwise(out)
    return out


def some_detail(text: Column, key: Column, details: list[str], share: float = 0.7, longer_than: int = 20) -> Column:
    """With a chance of `share`, a detail that doesn't matter: half of them at the end, the others behind one of the first three commas and full stops; short texts stay."""
    detail = chosen(F.array(*map(F.lit, details)), chance(key, "detail"))
    places = F.slice(F.filter(F.transform(F.split(text, ""), lambda c, i: F.when(c.isin(",", "."), i + 1)), lambda p: p.isNotNull()), 1, 3)
    at = chosen(places, chance(key, "place"))
    end = F.concat(F.rtrim(text), F.lit(" "), F.trim(detail))
    inside = F.concat(F.substr(text, F.lit(1), at), F.lit(" "), detail, F.substr(text, at + 1))
    new = F.when((chance(key, "end") < 0.5) | (F.size(places) == 0), end).otherwise(inside)
    return F.when((chance(key, "insert") < share) & (F.char_length(text) > longer_than), new).otherwise(text)


def random_surface(df: DataFrame, id_col: str, text_col: str, table: dict[str, list[str]], names: list[str], details: list[str]) -> DataFrame:
    """id, ops, text: one or two of the operations synonym, name and detail, drawn without replacement by the hash of the id and applied one after the other.

    The result depends on ids and texts alone. Null texts stay null; an id that is null draws as the empty text.
    """
    key = F.coalesce(F.col("id").cast("string"), F.lit(""))
    ops = {"synonym": lambda x: some_synonyms(x, key, table), "name": lambda x: another_name(x, key, names), "detail": lambda x: some_detail(x, key, details)}
    order = F.transform(F.array_sort(F.array(*[F.struct(chance(key, f"op {n}").alias("u"), F.lit(n).alias("op")) for n in ops])), lambda s: s["op"])
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.select("id", "text", F.slice(order, F.lit(1), F.when(chance(key, "count") < 0.5, 1).otherwise(2)).alias("ops"))
    for k in range(2):
        step = F.col("text")
        for n, f in ops.items():
            step = F.when(F.get("ops", F.lit(k)) == n, f(F.col("text"))).otherwise(step)
        # Worked out once: expressions above an explode are not inlined.
        rows = rows.select("id", "ops", F.explode(F.array(step)).alias("text"))
    return rows


def with_detail(text: Column, details: list[str], key: Column) -> Column:
    """A sentence that doesn't matter in front, chosen by a hash of the key."""
    return F.concat(chosen(F.array(*map(F.lit, details)), chance(key, "front")), F.lit(" "), text)


def battery(df: DataFrame, id_col: str, text_col: str, structural_pairs: dict[str, list[tuple[str, str]]], names: dict[str, str], details: list[str], vector, joined=None) -> DataFrame:
    """id, structural, kind, distance: how far each perturbation moves each text that it changes.

    structural_pairs: by kind, phrases and what takes their place (all occurrences; each phrase that a text holds is a perturbation of its own). Surface ones are a change of all
    names, and each detail at the end. vector: a Column of numbers for a Column of texts; distances are those of the cosine. Texts that a perturbation leaves as they are have no row for it.
    joined: where there is one, the vector of two texts with a space between them, as a Column for the Columns of their vectors; a text with a detail then isn't gone through again.
    """
    kinds = [(True, k, F.replace(F.col("text"), F.lit(a), F.lit(b))) for k, pairs in structural_pairs.items() for a, b in pairs]
    renamed_text = F.col("text")
    for a, b in names.items():
        renamed_text = F.replace(renamed_text, F.lit(a), F.lit(b))
    kinds += [(False, "name_change", renamed_text)]
    if joined is None:
        kinds += [(False, "detail", F.concat("text", F.lit(f" {d}"))) for d in details]
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # The vector of a text is worked out once for all of its variants, and none for a variant that is the text (expressions above an explode are not inlined).
    variants = F.array(*[F.when(x != F.col("text"), x) for _, _, x in kinds])
    rows = rows.select("id", F.explode(F.array(F.struct(vector(F.col("text")).alias("x"), variants.alias("variants"), F.col("text").isNotNull().alias("there")))).alias("v"))
    items = F.array(*[F.struct(F.lit(s).alias("structural"), F.lit(k).alias("kind"), F.get("v.variants", F.lit(i)).alias("variant"), F.lit(None).cast("array<double>").alias("y")) for i, (s, k, _) in enumerate(kinds)])
    items = F.filter(items, lambda p: p["variant"].isNotNull())
    y = vector(F.col("p.variant"))
    if joined is not None:
        none = F.lit(None).cast("string").alias("variant")
        ends = F.array(*[F.struct(F.lit(False).alias("structural"), F.lit("detail").alias("kind"), none, joined(F.col("v.x"), vector(F.lit(d))).cast("array<double>").alias("y")) for d in details])
        items = F.concat(items, F.when(F.col("v.there"), ends).otherwise(F.slice(ends, 1, 0)))
        y = F.when(F.col("p.variant").isNull(), F.col("p.y")).otherwise(y)
    rows = rows.select("id", "v.x", F.explode(items).alias("p"))
    rows = rows.select("id", "p.structural", "p.kind", "x", F.explode(F.array(y)).alias("y"))
    return rows.select("id", "structural", "kind", V.cosine_distance(F.col("x"), F.col("y")).alias("distance"))
