"""Person names: canonical spellings, generated aliases, review evidence, resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import textcols as tc


def canonicalize(df: DataFrame, key: str, col: str, aliases: DataFrame) -> DataFrame:
    """Names of a list column through an alias table (raw_lc, canonical): trimmed, blanks
    dropped, first spelling of each kept in order. key must be unique."""
    items = df.select(key, F.posexplode(col).alias("pos", "raw")).withColumn("raw", tc.strip(F.col("raw"))).where("raw is not null and raw != ''")
    named = items.join(aliases, F.lower("raw") == F.col("raw_lc"), "left").withColumn("name", F.coalesce("canonical", "raw"))
    first = named.groupBy(key, F.lower("name").alias("lc")).agg(F.min(F.struct("pos", "name")).alias("f"))
    lists = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["name"]).alias("__names"))
    out = df.join(lists, key, "left")
    return out.withColumn(col, F.coalesce("__names", F.array().cast("array<string>"))).drop("__names")


def backfill_preview(df: DataFrame, key: str, col: str, aliases: DataFrame, n: int | None = 15) -> DataFrame:
    """Rows whose names would change, old and new; the first n, or all."""
    new = canonicalize(df.select(key, col), key, col, aliases).select(key, F.col(col).alias("new"))
    out = df.select(key, F.col(col).alias("old")).join(new, key).where("not (old <=> new)")
    return out.orderBy(key).limit(n) if n is not None else out


def spellings(df: DataFrame, names: Column) -> DataFrame:
    return df.select(F.explode(names).alias("name")).where("trim(name) != ''").groupBy("name").agg(F.count("*").alias("n"))


def build_aliases(df: DataFrame, names: Column, vocab: DataFrame) -> DataFrame:
    """(raw, canonical) of every spelling that changes: the vocabulary's spelling, else the
    most frequent, else capitalised before not, else first by name."""
    counted = spellings(df, names).withColumn("lc", F.lower("name"))
    upper = F.substring("name", 1, 1) != F.lower(F.substring("name", 1, 1))
    best = counted.groupBy("lc").agg(F.min_by("name", F.struct(-F.col("n"), ~upper, F.col("name"))).alias("best"))
    listed = vocab.groupBy(F.lower("name").alias("lc")).agg(F.min("name").alias("listed"))
    pick = best.join(listed, "lc", "left").select("lc", F.coalesce("listed", "best").alias("canonical"))
    return counted.join(pick, "lc").where("name != canonical").select(F.col("name").alias("raw"), "canonical", "n")


def alias_summary(df: DataFrame, names: Column, vocab: DataFrame) -> DataFrame:
    """Spellings, distinct names in lower case, names with variants, aliases made."""
    per = spellings(df, names).groupBy(F.lower("name").alias("lc")).agg(F.count("*").alias("c"))
    made = build_aliases(df, names, vocab).agg(F.count("*").alias("aliases"))
    return per.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("spellings"), F.count("*").alias("names"), F.count_if(F.col("c") > 1).alias("with_variants")).join(F.broadcast(made))


def review_names(df: DataFrame, key: str, names: Column, date: str, vocab: DataFrame, least: int = 1, top: int = 3) -> DataFrame:
    """Evidence per unlisted name: rows, year span, the listed names most often seen in the
    same row, and a listed name with the same letters."""
    listed = vocab.groupBy(F.lower("name").alias("lc")).agg(F.min("name").alias("listed"))
    said = df.select(key, F.col(date).alias("__d"), F.explode(names).alias("name")).withColumn("lc", F.lower("name")).join(listed, "lc", "left")
    un = said.where("listed is null")
    stats = un.groupBy("lc").agg(F.count("*").alias("n"), F.min(tc.year_of(F.col("__d"))).alias("first_year"), F.max(tc.year_of(F.col("__d"))).alias("last_year")).where(F.col("n") >= least)
    pairs = un.select(key, "lc").join(said.where("listed is not null").select(key, "listed"), key).groupBy("lc", "listed").agg(F.count("*").alias("c"))
    w = Window.partitionBy("lc").orderBy(F.desc("c"), "listed")
    best = pairs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top)
    seen = best.groupBy("lc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "listed", "c"))), lambda x: F.concat(x["listed"], F.lit(" "), x["c"].cast("string"))), ", ").alias("seen_with"))
    same = vocab.groupBy(tc.letters_only(F.col("name")).alias("letters")).agg(F.min("name").alias("suggestion"))
    out = stats.join(seen, "lc", "left").withColumn("letters", tc.letters_only(F.col("lc"))).join(same, "letters", "left")
    return out.select(F.col("lc").alias("name"), "n", "first_year", "last_year", "seen_with", "suggestion")


def resolve_names(queries: DataFrame, key: str, name: str, vocab: DataFrame) -> DataFrame:
    """(key, name, match): the listed name that equals it in any case, else the first listed
    name of which either holds the other. Containment is an equi-join of one side with the
    other's parts, cut to the lengths that the first side has, so neither side need be small
    and a long text has its length times the number of those."""
    listed = vocab.groupBy(F.lower("name").alias("v_lc")).agg(F.min("name").alias("v_name")).where("v_lc != ''")
    asked = queries.select(key, F.col(name).alias("name")).where("trim(name) != ''").withColumn("lc", F.lower(tc.strip(F.col("name"))))
    exact = asked.join(listed, F.col("lc") == F.col("v_lc")).select(key, "name", F.col("v_name").alias("match"))
    rest = asked.join(listed, F.col("lc") == F.col("v_lc"), "left_anti")
    wanted = rest.select("lc").distinct()
    lengths = lambda d, c: F.broadcast(d.agg(F.array_sort(F.collect_set(F.length(c))).alias("sizes")))  # noqa: E731 - one row
    held = wanted.join(lengths(listed, "v_lc")).withColumn("part", F.explode(parts_of(F.col("lc"), F.col("sizes")))).join(listed, F.col("part") == F.col("v_lc")).select("lc", "v_name")
    holds = listed.join(lengths(wanted, "lc")).withColumn("part", F.explode(parts_of(F.col("v_lc"), F.col("sizes")))).join(wanted, F.col("part") == F.col("lc")).select("lc", "v_name")
    best = held.unionByName(holds).groupBy("lc").agg(F.min("v_name").alias("match"))
    return exact.unionByName(rest.join(best, "lc").select(key, "name", "match"))


def parts_of(c: Column, sizes: Column) -> Column:
    """The distinct parts of a text that have one of the given lengths."""
    fit = F.filter(sizes, lambda k: k.between(1, F.length(c)))
    return F.array_distinct(F.flatten(F.transform(fit, lambda k: F.transform(F.sequence(F.lit(1), F.length(c) - k + 1), lambda i: F.substr(c, i, k)))))


def first_name_matches(queries: DataFrame, key: str, text: str, vocab: DataFrame) -> DataFrame:
    """(key, match) of the words of a text that are the first name of exactly one entry."""
    firsts = vocab.select("name", F.lower(F.split(tc.strip(F.col("name")), r"\s+")[0]).alias("first")).distinct()
    unique = firsts.groupBy("first").agg(F.count("*").alias("c"), F.min("name").alias("match")).where("c = 1").drop("c")
    bare = F.transform(F.split(F.col(text), r"\s+"), lambda w: F.lower(F.regexp_replace(w, r"^[,.!?;:]+|[,.!?;:]+$", "")))
    words = queries.select(key, F.explode(F.array_distinct(bare)).alias("word")).where(F.length("word") > 2)
    return words.join(unique, F.col("word") == F.col("first")).select(key, "match")


def resolve_query_log(log: DataFrame, key: str, vocab: DataFrame, tags: DataFrame) -> DataFrame:
    """Validated filters of parsed queries. log: key, text, q, year, year_from, year_to,
    persons and terms (lists), scene. Years have four digits; one year beats a range, a
    lone bound is dropped; people resolve against the vocabulary, and only where nobody
    does, by a unique first name in the text; their names leave q; an unlisted scene is
    dropped; at most 8 terms stay."""
    year = lambda c: F.when(tc.strip(F.col(c)).rlike(r"^\d{4}$"), tc.strip(F.col(c))).otherwise("")
    out = log.withColumns({c: year(c) for c in ("year", "year_from", "year_to")})
    ranged = (F.col("year") == "") & (F.col("year_from") != "") & (F.col("year_to") != "")
    out = out.withColumns({c: F.when(ranged, F.col(c)).otherwise("") for c in ("year_from", "year_to")})
    asked = log.select(key, F.posexplode("persons").alias("pos", "name"))
    found = asked.join(resolve_names(asked, key, "name", vocab), [key, "name"])
    named = found.groupBy(key, "match").agg(F.min("pos").alias("pos"))
    firsts = first_name_matches(log, key, "text", vocab).join(named.select(key), key, "left_anti").groupBy(key, "match").agg(F.lit(0).alias("pos"))
    people = named.unionByName(firsts).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "match"))), lambda x: x["match"]).alias("__p"))
    out = out.join(people, key, "left").withColumn("persons", F.coalesce("__p", F.array().cast("array<string>"))).drop("__p")
    listed = tags.select(F.lower("name").alias("__tag")).distinct()
    out = out.withColumn("__scene", F.lower(tc.strip(F.col("scene")))).join(listed, F.col("__scene") == F.col("__tag"), "left")
    some = F.filter(F.transform(F.col("terms"), tc.strip), lambda t: t.isNotNull() & (t != ""))
    return out.withColumns({"scene": F.coalesce("__tag", F.lit("")), "terms": F.slice(some, 1, 8), "q": tc.without_words(F.coalesce(tc.strip(F.col("q")), F.lit("")), F.col("persons"))}).drop("__scene", "__tag")
