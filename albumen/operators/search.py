"""Faceted search, full text over postings, relevance and paging."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import textcols as tc

# What folding does to Latin letters, as one-to-one replacements.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
K1, B = 1.2, 0.75  # of the published ranking formula


# --- filters -----------------------------------------------------------------


def media_in(col: str, kinds: Iterable[str] = ("image", "video")) -> Column:
    return F.col(col).isin(*kinds)


def year_filter(date: str, year: str | None = None, year_from: str | None = None, year_to: str | None = None, lexical: bool = True) -> Column:
    """Exact year or inclusive range; bounds compare as text, or as numbers."""
    y = tc.year_of(F.col(date))
    if not lexical:
        y = y.try_cast("int")
        year, year_from, year_to = (None if v is None else int(v) for v in (year, year_from, year_to))
    tests = [y == year if year is not None else None, y >= year_from if year_from is not None else None, y <= year_to if year_to is not None else None]
    return reduce(lambda a, b: a & b, [t for t in tests if t is not None], F.lit(True))


def all_persons(persons: str, names: str, compat: bool = False) -> Column:
    """Every comma-separated name is a part of some person, in any case; blanks are ignored.
    compat: matched against the JSON text itself, with its live wildcards."""
    wanted = [n.strip() for n in names.split(",") if n.strip()]
    if compat:
        return reduce(lambda a, b: a & b, [F.col(persons).ilike(f"%{n}%") for n in wanted], F.lit(True))
    people = tc.json_list(F.col(persons))
    one = lambda n: F.exists(people, lambda p: F.contains(F.lower(p), F.lit(n.lower())))
    return reduce(lambda a, b: a & b, [one(n) for n in wanted], F.lit(True))


def has_value(array: str, value: str) -> Column:
    return F.array_contains(tc.json_list(F.col(array)), value)


def has_coordinates(lat: str = "gps_lat", lon: str = "gps_lon") -> Column:
    return F.col(lat).isNotNull() & F.col(lon).isNotNull()


def not_empty(array: str) -> Column:
    return F.size(tc.json_list(F.col(array))) > 0


def any_contains(cols: Sequence[str], text: str) -> Column:
    """Substring in any of the columns, in any case (wildcards in the text are live)."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False)) for c in cols])


def pending(df: DataFrame, state: str, done: Iterable[int], key: str, date: str, media: str | None = None, kinds: Iterable[str] = (), limit: int | None = None) -> DataFrame:
    """Work queue: rows whose state isn't terminal (null states stay out), newest first."""
    out = df.where(~F.col(state).isin(*done))
    if media:
        out = out.where(media_in(media, kinds))
    out = out.orderBy(F.col(date).desc_nulls_last(), key)
    return out.limit(limit) if limit is not None else out


def legacy_pending(df: DataFrame, state: str, date: str, key: str, errored: bool = False, year_from: int | None = None, year_to: int | None = None, movie: Column | None = None, has_file: Column | None = None, limit: int | None = None) -> DataFrame:
    """The older work queue, newest first: pending rows that aren't movies, or pending and
    errored ones, with a file and within years."""
    open_rows = F.col(state).isin(0, 2) if errored else (F.col(state) == 0) & (~movie if movie is not None else F.lit(True))
    bounds = (None if y is None else str(y) for y in (year_from, year_to))
    out = df.where(open_rows).where(year_filter(date, None, *bounds, lexical=False))
    if has_file is not None:
        out = out.where(has_file)
    out = out.orderBy(F.col(date).desc_nulls_last(), key)
    return out.limit(limit) if limit is not None else out


def facets(df: DataFrame, favourite: Column | None = None, done: Column | None = None, file: Column | None = None, screenshot: Column | None = None, year: Column | None = None) -> DataFrame:
    """The older filters; those given must hold, and a screenshot must not be one."""
    tests = [favourite, done, None if file is None else file.isNotNull(), None if screenshot is None else ~screenshot, year]
    return df.where(reduce(lambda a, b: a & b, [t for t in tests if t is not None], F.lit(True)))


def oldest_first(df: DataFrame, date: str, key: str, year: int, limit: int = 20) -> DataFrame:
    """A year's rows, oldest first."""
    return df.where(year_filter(date, str(year), lexical=False)).orderBy(date, key).limit(limit)


def recent(ts: str, now: Column, hours: int) -> Column:
    return F.col(ts) > now - F.expr(f"INTERVAL {hours} HOURS")


def hide_missing(df: DataFrame, files: DataFrame, key: str, max_missing: int = 500) -> DataFrame:
    """Leave out rows without a file, but only where at most max_missing lack one (more
    means that the listing, not the catalogue, is at fault); no files at all hide nothing."""
    missing = df.join(files.select(key), key, "left_anti")
    few = missing.select(key).limit(max_missing + 1).agg(F.count("*").alias("n")).first()["n"]
    if few > max_missing or files.isEmpty():
        return df
    return df.join(files.select(key), key, "left_semi")


def in_vocabulary(df: DataFrame, name: str, vocab: DataFrame, vocab_name: str = "name") -> DataFrame:
    """Rows whose name is listed, in any case; an empty vocabulary keeps everything."""
    if vocab.isEmpty():
        return df
    listed = vocab.select(F.lower(vocab_name).alias("__v")).distinct()
    return df.join(listed, F.lower(F.col(name)) == F.col("__v"), "left_semi")


def with_child(df: DataFrame, child: DataFrame, key: str, child_key: str) -> DataFrame:
    """Rows that have a related child row."""
    return df.join(child, df[key] == child[child_key], "left_semi")


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == value)


# --- hits and pages ----------------------------------------------------------


def shape_hits(df: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """What a result list shows: year, first tag, first 8 tags, place or guess, flags."""
    tags = tc.json_list(F.col("tags"))
    out = df.withColumns(
        {
            "year": tc.year_of(F.col("date")),
            "scene": F.try_element_at(tags, F.lit(1)),
            "tag_list": F.slice(tags, 1, 8),
            "people": tc.json_list(F.col("persons")),
            "text": tc.clean_text(F.col("description")),
            "location": F.col("place_name"),
            "has_gps": has_coordinates(),
            "done": F.coalesce(F.col("state") == 1, F.lit(False)),
        }
    )
    if files is not None:
        out = out.join(files.select("asset_id").distinct().withColumn("__f", F.lit(True)), "asset_id", "left").withColumn("has_file", F.coalesce("__f", F.lit(False))).drop("__f")
    return out


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 48) -> DataFrame:
    """One page of an ordered result with total, page and pages on its rows. The total is a
    grouped count joined on, so that no row passes through one task; order must be total."""
    number = max(1, number)
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(size))).cast("long")
    return rows.join(F.broadcast(total)).withColumns({"page": F.lit(number), "pages": pages})


def page_after(df: DataFrame, date: str, key: str, last_date: str, last_key, size: int = 48) -> DataFrame:
    """Keyset form for deep pages: rows after the last one seen, newest first."""
    after = (F.col(date) < last_date) | ((F.col(date) == last_date) & (F.col(key) > last_key)) | F.col(date).isNull()
    return df.where(after).orderBy(F.col(date).desc_nulls_last(), key).limit(size)


def search(
    df: DataFrame,
    year: str | None = None,
    year_from: str | None = None,
    year_to: str | None = None,
    persons: str | None = None,
    scene: str | None = None,
    done_only: bool = False,
    matches: DataFrame | None = None,
) -> DataFrame:
    """The assets that pass every given filter; matches: keys that a text query found."""
    out = df.where(media_in("media_type")).where(year_filter("date", year, year_from, year_to))
    if persons:
        out = out.where(all_persons("persons", persons))
    if scene:
        out = out.where(has_value("tags", scene))
    if done_only:
        out = out.where(F.col("state") == 1)
    if matches is not None:
        out = out.join(matches.select("asset_id"), "asset_id", "left_semi")
    return out


def map_points(df: DataFrame, files: DataFrame | None = None, chars: int = 200) -> DataFrame:
    """Newest first, with coordinates and (where files are given) a file."""
    out = df.where(has_coordinates()).withColumn("text", F.substring(tc.clean_text(F.col("description")), 1, chars))
    if files is not None:
        out = out.join(files.select("asset_id"), "asset_id", "left_semi")
    return out.select("asset_id", "gps_lat", "gps_lon", "date", "text").orderBy(F.col("date").desc_nulls_last(), "asset_id")


# --- full text ---------------------------------------------------------------


def folded(c: Column) -> Column:
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def terms(c: Column) -> Column:
    return F.filter(F.split(folded(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def build_postings(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """(key, col, pos, term) of every token; null columns have none. write_postings keeps
    them to serve many queries."""
    if len(cols) == 1:
        return df.select(F.col(key).alias("key"), F.lit(cols[0]).alias("col"), F.posexplode(terms(F.col(cols[0]))).alias("pos", "term"))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), terms(F.col(c)).alias("terms")) for c in cols]))
    return df.select(F.col(key).alias("key"), cells.alias("c")).select("key", "c.col", F.posexplode("c.terms").alias("pos", "term"))


def update_postings(postings: DataFrame, changed: DataFrame, key: str, cols: Sequence[str], deleted: DataFrame | None = None) -> DataFrame:
    """Postings with the changed keys' tokens made anew and the deleted keys' gone."""
    keys = changed.select(F.col(key).alias("key"))
    if deleted is not None:
        keys = keys.unionByName(deleted.select(F.col(key).alias("key")))
    return postings.join(keys.distinct(), "key", "left_anti").unionByName(build_postings(changed, key, cols))


def _tokens(text: str) -> list[str]:
    out, word = [], ""
    for ch in text.lower().translate(str.maketrans(ACCENTED, PLAIN)) + " ":
        if ch.isalnum():
            word += ch
        elif word:
            out.append(word)
            word = ""
    return out


def phrase(postings: DataFrame, text: str, col: str | None = None) -> DataFrame:
    """Keys that hold the text's tokens one after the other, within one column."""
    words = _tokens(text)
    hits = postings if col is None else postings.where(F.col("col") == col)
    if not words:
        return hits.select("key").where(F.lit(False))
    if len(words) == 1:
        return hits.where(F.col("term") == words[0]).select("key").distinct()
    places = F.create_map(*[x for w in dict.fromkeys(words) for x in (F.lit(w), F.array(*[F.lit(i) for i, v in enumerate(words) if v == w]))])
    starts = hits.where(F.col("term").isin(*words)).select("key", "col", F.col("pos"), F.explode(places[F.col("term")]).alias("i"))
    return starts.groupBy("key", "col", (F.col("pos") - F.col("i")).alias("start")).agg(F.count_distinct("i").alias("n")).where(F.col("n") == len(words)).select("key").distinct()


def parse_query(q: str, columns: Iterable[str], aliases: Mapping[str, str] | None = None) -> list[tuple[str | None, str]]:
    """(column or None, text) of each word: `place:word` is scoped to a column or alias; a
    known scope whose column isn't indexed is unscoped, an unknown prefix is plain text."""
    columns, aliases = set(columns), dict(aliases or {})
    out = []
    for token in q.split():
        scope, sep, rest = token.partition(":")
        name = aliases.get(scope.lower(), scope.lower())
        if sep and rest and (name in columns or scope.lower() in aliases):
            out.append((name if name in columns else None, rest))
        else:
            out.append((None, token))
    return [(c, t) for c, t in out if _tokens(t)]


def match(postings: DataFrame, q: str, expand: Sequence[str] = (), columns: Iterable[str] = (), aliases: Mapping[str, str] | None = None) -> DataFrame | None:
    """Keys that hold all words of q, or any expansion term; None where nothing is asked."""
    words = parse_query(q, columns, aliases)
    seen = {t.lower() for _, t in words}
    more = [t for t in expand if _tokens(t) and t.lower() not in seen]
    if not words and not more:
        return None
    single = lambda t: len(_tokens(t)) == 1
    is_word = lambda c, t: (F.col("term") == _tokens(t)[0]) & (F.lit(True) if c is None else F.col("col") == c)
    plain, plain_more = [w for w in words if single(w[1])], [t for t in more if single(t)]
    found = None
    if plain or plain_more:  # all one-word terms in one pass over the postings
        wanted = sorted({_tokens(t)[0] for t in [w[1] for w in plain] + plain_more})
        every = reduce(lambda a, b: a & b, [F.bool_or(is_word(c, t)) for c, t in plain], F.lit(True))
        some = reduce(lambda a, b: a | b, [F.bool_or(is_word(None, t)) for t in plain_more], F.lit(False))
        flags = postings.where(F.col("term").isin(*wanted)).groupBy("key").agg(every.alias("every"), some.alias("some"))
        found = flags.where("every").select("key") if plain else None
        extra = flags.where("some").select("key") if plain_more else None
    else:
        extra = None
    for col, text in words:
        if not single(text):
            hit = phrase(postings, text, col)
            found = hit if found is None else found.join(hit, "key", "left_semi")
    for hit in ([extra] if extra is not None else []) + [phrase(postings, t) for t in more if not single(t)]:
        found = hit if found is None else found.unionByName(hit).distinct()
    return found


def match_count(found: DataFrame) -> DataFrame:
    return found.agg(F.count_distinct("key").alias("matches"))


def text_lengths(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """(key, len): tokens of all columns of a row; a table to keep beside the postings."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.size(terms(F.col(c))), F.lit(0)) for c in cols])
    return df.select(F.col(key).alias("key"), total.cast("long").alias("len")).where("len > 0")


def bm25(postings: DataFrame, q: str, lengths: DataFrame | None = None) -> DataFrame:
    """(key, score) of the keys that hold all words; lower is better. A key's length counts
    all its columns; words are tokens of q. With a table of lengths (key, len) only the
    words' own postings are grouped; without one, all are, to learn the lengths."""
    words = list(dict.fromkeys(_tokens(q)))
    tf = {w: f"tf{i}" for i, w in enumerate(words)}
    counts = [F.count_if(F.col("term") == w).alias(c) for w, c in tf.items()]
    df = {w: f"df{i}" for i, w in enumerate(words)}
    size = [F.count("*").alias("n_docs"), F.avg("len").alias("avg_len")]
    held = [F.count_if(F.col(tf[w]) > 0).cast("double").alias(c) for w, c in df.items()]
    if lengths is None:
        per = postings.groupBy("key").agg(F.count("*").alias("len"), *counts)
        stats = per.agg(*size, *held)
    else:
        per = postings.where(F.col("term").isin(*words)).groupBy("key").agg(F.count("*").alias("__n"), *counts).drop("__n").join(lengths, "key")
        stats = per.agg(F.count("*").alias("__n"), *held).drop("__n").join(F.broadcast(lengths.agg(*size)))
    hits = reduce(lambda a, b: a & b, [F.col(c) > 0 for c in tf.values()], F.lit(bool(words)))
    length = 1 - B + B * F.col("len") / F.col("avg_len")
    idf = lambda w: F.log((F.col("n_docs") - F.col(df[w]) + 0.5) / (F.col(df[w]) + 0.5) + 1.0)
    parts = [idf(w) * F.col(tf[w]) * (K1 + 1) / (F.col(tf[w]) + K1 * length) for w in words]
    score = reduce(lambda a, b: a + b, parts, F.lit(0.0))
    return per.where(hits).join(F.broadcast(stats)).select("key", (-score).alias("score"))


def accepted(q: str) -> bool:
    """Can it be read as a match expression: quotes and brackets closed, no operator without
    both sides, something to look for."""
    bare, depth = q.split('"')[::2], 0
    if q.count('"') % 2:
        return False
    words = " ".join(bare)
    for c in words:
        depth += {"(": 1, ")": -1}.get(c, 0)
        if depth < 0:
            return False
    parts = words.split() if q.count('"') == 0 else []
    dangling = bool(parts) and (parts[0] in ("AND", "OR") or parts[-1] in ("AND", "OR", "NOT"))
    return not depth and not dangling and bool(_tokens(q))


def search_text(df: DataFrame, postings: DataFrame | None, q: str, cols: Sequence[str], key: str, mode: str = "match") -> DataFrame:
    """Text search on an index; by substrings where there is none, mode asks for it, or the
    expression can't be read. A blank query keeps all rows."""
    if mode == "substring" or postings is None or q.strip() and not accepted(q):
        return df.where(any_contains(cols, q))
    found = match(postings, q, columns=cols)
    return df if found is None else df.join(found.withColumnRenamed("key", key), key, "left_semi")


def top_matches(df: DataFrame, postings: DataFrame, q: str, key: str, size: int = 48, lengths: DataFrame | None = None) -> DataFrame:
    """Relevance-ordered page: ranked by key and score alone, then joined to its rows."""
    best = bm25(postings, q, lengths).orderBy("score", "key").limit(size).withColumnRenamed("key", key)
    return df.join(F.broadcast(best), key).orderBy("score", key)


def write_postings(postings: DataFrame, table: str, buckets: int = 64) -> None:
    """Keep postings as a table bucketed and sorted by term, so that a query for a few words
    reads their buckets alone."""
    postings.write.bucketBy(buckets, "term").sortBy("term", "key").mode("overwrite").saveAsTable(table)




def ranked_within(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First n rows of each group."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)
