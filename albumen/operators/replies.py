"""Model replies: salvage of damaged JSON, flattening, and batch enrichment runs."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import textcols as tc

# Fixed values of the reply format.
TAG_KEYS = ("tag", "name", "label", "value", "feature", "text")
CLASS_FIELDS = ("scene_type", "setting", "mood", "time_of_day", "weather")
UNTOLD = ("other", "unknown", "indoor")


# A fenced block that holds an object; a string up to the quote after which JSON goes on;
# and inside of one, escapes (left alone) and bare quotes.
_FENCED = re.compile(r"```(?:json)?\s*(\{.*?)\s*(?:```|\Z)", re.DOTALL)
_STRING = re.compile(r'"((?:\\.|[^"\\]|"(?!\s*(?:[:,}\]]|\Z)))*)"', re.DOTALL)
_QUOTE = re.compile(r'(\\.)|"', re.DOTALL)
_DECODER = json.JSONDecoder(strict=False)


def _object(text: str) -> dict | None:
    """The object at the first brace, whatever follows it; else all up to the last brace."""
    begin, end = text.find("{"), text.rfind("}") + 1
    for attempt in (lambda: _DECODER.raw_decode(text, begin)[0], lambda: _DECODER.decode(text[begin:end])):
        try:
            if begin >= 0 and isinstance(found := attempt(), dict):
                return found
        except ValueError:
            pass
    return None


def requote(text: str) -> str:
    """Escape quotes inside strings: those after which neither : , } ] nor the end comes."""
    return _STRING.sub(lambda m: '"' + _QUOTE.sub(lambda q: q[1] or '\\"', m[1]) + '"', text)


def _salvaged(reply: str | None) -> tuple[str | None, str | None]:
    if reply is None:
        return None, None
    if not reply.strip():
        return None, "empty"
    fenced = _FENCED.search(reply)
    text = fenced[1] if fenced else reply
    for stage, candidate in (("carved", text), ("requoted", requote(text))):
        if (found := _object(candidate)) is not None:
            return json.dumps(found, ensure_ascii=False), stage
    return None, "failed"


def salvage_json(df: DataFrame, col: str, parsed: str | None = None) -> DataFrame:
    """Add json (an object's text, or null) and stage: `parsed` natively (the first object,
    whatever follows it), else `carved` or `requoted` by a scanner that sees only the texts
    that need it, else `failed` or `empty`; and, where `parsed` names a column, the object as
    a variant. One pass over the rows."""
    text = tc.strip(F.col(col))
    good = F.coalesce(text.startswith("{") & F.col("__v").isNotNull(), F.lit(False))

    def scan(replies: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_salvaged(r) for r in replies], columns=["json", "stage"])

    scanned = F.pandas_udf(scan, "json string, stage string")
    out = df.withColumn("__v", F.try_parse_json(text))
    out = out.withColumn("__s", scanned(F.when(~good, F.coalesce(F.col(col), F.lit("")))))
    out = out.withColumns({"json": F.when(good, F.to_json("__v")).otherwise(F.col("__s.json")), "stage": F.when(good, "parsed").otherwise(F.col("__s.stage"))})
    if parsed:
        out = out.withColumn(parsed, F.when(good, F.col("__v")).otherwise(F.try_parse_json("__s.json")))
    return out.drop("__v", "__s")


def scalar_text(v: Column) -> Column:
    """A variant element as text: strings trimmed and numbers; an object by the first of its
    known keys that is there, which may be an object again, however deep; true, false, null
    and the rest dropped."""

    def inside(x: Column) -> Column:
        first = F.coalesce(*[F.try_variant_get(x, f"$.{k}", "variant") for k in TAG_KEYS])
        return F.when(F.schema_of_variant(x).startswith("OBJECT"), first).otherwise(x)

    def steps(x: Column) -> Column:  # an object holds no more objects than its text has brackets
        text = F.to_json(x)
        return F.when(F.schema_of_variant(x).startswith("OBJECT"), F.sequence(F.lit(1), F.length(text) - F.length(F.replace(text, F.lit("{")))))

    none = F.array().cast("array<int>")
    v = F.try_element_at(F.transform(F.array(v), lambda x: F.aggregate(F.coalesce(steps(x), none), x, lambda at, _: inside(at))), F.lit(1))

    def plain(x: Column) -> Column:
        kind = F.schema_of_variant(x)
        return F.when(kind == "STRING", F.nullif(tc.strip(F.try_variant_get(x, "$", "string")), F.lit(""))).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(x, "$", "string"))

    return F.try_element_at(F.transform(F.array(v), plain), F.lit(1))


def text_list(v: Column) -> Column:
    """A variant that is a scalar, an object or a list (one level nested) as a list of texts."""
    kind = F.schema_of_variant(v)
    outer = F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).when(v.isNotNull(), F.array(v))

    def flat(x: Column) -> Column:
        inner = F.when(F.schema_of_variant(x).startswith("ARRAY"), F.try_variant_get(x, "$", "array<variant>")).otherwise(F.array(x))
        return F.transform(inner, lambda y: scalar_text(y))

    texts = F.flatten(F.transform(outer, flat))
    return F.coalesce(F.filter(texts, lambda t: t.isNotNull()), F.array().cast("array<string>"))


def flatten_reply(df: DataFrame, json_col: str = "json", extra: tuple[str, ...] = (), parsed: str | None = None) -> DataFrame:
    """Add description, tags (list) and location_guess of each reply. Tags: those given, the
    class fields that tell something, people:N, notable features, then extra; distinct in
    order. A reply that isn't an object has nulls and no tags. parsed: a column that holds the
    reply as a variant already."""
    df = df.withColumn("__v", F.col(parsed) if parsed else F.try_parse_json(F.col(json_col)))
    v = F.col("__v")
    get = lambda p: F.try_variant_get(v, p, "variant")
    classes = F.filter(F.array(*[scalar_text(get(f"$.{c}")) for c in CLASS_FIELDS]), lambda t: t.isNotNull() & ~t.isin(*UNTOLD))
    people = tc.leading_int(F.try_variant_get(v, "$.people.count", "string"))
    count = F.when(people > 0, F.array(F.concat(F.lit("people:"), people.cast("string")))).otherwise(F.array().cast("array<string>"))
    tags = F.array_distinct(F.concat(text_list(get("$.tags")), classes, count, text_list(get("$.notable_features")), F.array(*[F.lit(e) for e in extra]).cast("array<string>")))
    spot = F.array(*[scalar_text(get(f"$.estimated_location.{p}")) for p in ("specific_place", "region_or_city", "country")])
    confidence = F.try_variant_get(v, "$.estimated_location.confidence", "string")
    raw = get("$.description")
    description = F.when(F.schema_of_variant(raw) == "STRING", F.try_variant_get(raw, "$", "string")).otherwise(F.coalesce(scalar_text(raw), F.to_json(raw)))
    ok = F.schema_of_variant(v).startswith("OBJECT")
    return df.withColumns(
        {
            "description": F.when(ok & (F.schema_of_variant(raw) != "VOID"), description),
            "tags": F.when(ok, tags).otherwise(F.array().cast("array<string>")),
            "location_guess": F.when(ok, tc.location_guess(spot, confidence)),
        }
    ).drop("__v")


def enrich(df: DataFrame, key: str, context: str, model: Callable[[list[str], int], list[str]], attempts: int = 2) -> DataFrame:
    """Run a model over a queue: (key, json, stage, attempts, error). model takes contexts and
    the attempt's number, for one batch on an executor, and returns replies. A reply that can't
    be parsed is tried again; an exception is the row's error, and neither stops the run."""

    def one(texts: list[str], attempt: int) -> list[tuple[str | None, str | None]]:
        try:
            return [(r, None) for r in model(texts, attempt)]
        except Exception as e:  # noqa: BLE001 - the batch is tried row by row
            if len(texts) == 1:
                return [(None, f"{type(e).__name__}: {e}"[:500])]
            return [one([t], attempt)[0] for t in texts]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: dict[int, tuple] = {}
            todo = list(range(len(pdf)))
            for attempt in range(1, attempts + 1):
                again = []
                for i, (reply, error) in zip(todo, one([pdf[context].iloc[i] for i in todo], attempt) if todo else (), strict=True):
                    text, stage = (None, "error") if error else _salvaged(reply)
                    out[i] = (text, stage, attempt, error)
                    if text is None and not error:
                        again.append(i)
                todo = again
            rows = [out[i] for i in range(len(pdf))]
            yield pd.DataFrame({key: pdf[key], **{c: [r[k] for r in rows] for k, c in enumerate(("json", "stage", "attempts", "error"))}})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, context).mapInPandas(work, f"{key} {kind}, json string, stage string, attempts int, error string")


def enrich_until(queue: Callable[[], DataFrame], run: Callable[[DataFrame], None], batch: int, deadline: Callable[[], bool]) -> int:
    """Take batches of a queue until it is empty or the deadline has come; run() must merge
    what it did, so that the queue gets shorter. Returns the number of batches."""
    n = 0
    while not deadline():
        rows = queue().limit(batch)
        if rows.isEmpty():
            break
        run(rows)
        n += 1
    return n


def build_context(df: DataFrame, labels: dict[str, str] = tc.CONTEXT_LABELS) -> DataFrame:
    """Context text per row, for the model."""
    return df.withColumn("context", tc.context_text(F.col("date"), F.col("place_name"), F.col("gps_lat"), F.col("gps_lon"), tc.json_list(F.col("persons")), labels))
