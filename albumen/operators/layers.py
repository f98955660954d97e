"""A catalogue that is merged when it is read: a base and deltas of model results, place dumps
and edits, which give one state in whatever order they arrive."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import textcols as tc
from . import merge
from .snapshots import _fs, promote, read_snapshot, write_snapshot

LISTS = ("persons", "tags")
ENRICHED = ("description", "tags")  # what a model's result sets, unless it was edited
EDITED = ("persons", "tags", "description", "date", "place_name")
PLACE = ("place_name", *merge.BREAKDOWN)
CODEC = "zstd"  # most of what a table writes is texts, written again by each compaction


class LayeredTable:
    """Below a folder that all executors share: base/v=N (promoted snapshots) and deltas/<name>.

    All that can change a row are registers: for each edited field its last value, the last
    place of a dump, and the last result, each with the time at which it was made. The later
    time wins (at equal times the larger value), so that merging is the same in any order
    and any grouping, and merging a delta twice changes nothing. A read merges the base's
    registers with those of the deltas by key and works out the columns: edits stand above
    results, a typed place above all dumps, and a place that an edit emptied takes the next
    dump after it. compact() writes the merged registers as the next base; deltas that it read
    are removed after that, and one that arrives later, or is left by a crash, does no harm.

    Deltas for keys that the base lacks wait in it until the key comes (add_rows)."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    # --- registers

    def _empty(self, base_columns: dict[str, str]) -> dict[str, str]:
        place = "struct<" + ",".join(f"{c}:string" for c in PLACE) + ">"
        result = "struct<" + ",".join(f"{c}:string" for c in ENRICHED) + ">"
        kinds = {f"edit_{c}": "string" for c in EDITED if c in base_columns}
        return {k: f"struct<at:timestamp,v:{v}>" for k, v in (kinds | {"dump": place, "result": result}).items()}

    def _registers(self, df: DataFrame, values: dict[str, Column], kinds: dict[str, str]) -> DataFrame:
        return df.select(self.key, *[values.get(r, F.lit(None)).cast(k).alias(f"r_{r}") for r, k in kinds.items()])

    def _kinds(self) -> dict[str, str]:
        base = read_snapshot(self.spark, f"{self.path}/base")
        return {c[2:]: t for c, t in base.dtypes if c.startswith("r_")}

    # --- writing

    def create(self, rows: DataFrame) -> None:
        """The first base: rows of the catalogue, one per key."""
        kinds = self._empty(dict(rows.dtypes))
        base = rows.select("*", F.lit(True).alias("__known"), *[F.lit(None).cast(k).alias(f"r_{r}") for r, k in kinds.items()])
        self._promoted(base)

    def _promoted(self, base: DataFrame) -> None:
        promote(self.spark, f"{self.path}/base", write_snapshot(base, f"{self.path}/base", CODEC))

    def _append(self, registers: DataFrame) -> None:
        """A delta is there when its job has succeeded (_SUCCESS)."""
        registers.write.parquet(f"{self.path}/deltas/{uuid.uuid4().hex}", compression=CODEC)

    def add_edits(self, edits: DataFrame, at: str = "at") -> None:
        """Edits (key, at, and fields that are null where untouched), cleaned; with a date that isn't
        one the whole edit is left out."""
        kinds = self._kinds()
        fields = [c for c in EDITED if c in edits.columns]
        stamped = merge.cleaned_edits(edits.select(self.key, *fields, F.col(at).cast("timestamp").alias("__at")), [c for c in LISTS if c in fields])
        if "date" in fields:
            stamped = stamped.where(F.col("date").isNull() | tc.valid_date(F.col("date")))
        self._append(self._registers(stamped, {f"edit_{c}": F.when(F.col(c).isNotNull(), F.struct(F.col("__at").alias("at"), F.col(c).alias("v"))) for c in fields}, kinds))

    def add_places(self, dump: DataFrame, at: str = "at") -> None:
        """A place dump (key, at, name and its parts); rows without a name don't count."""
        have = {"place_name": "name"} | merge.BREAKDOWN
        place = F.struct(*[(tc.blank_to_null(F.col(d)) if d in dump.columns else F.lit(None).cast("string")).alias(c) for c, d in have.items()])
        named = dump.where(tc.blank_to_null(F.col("name")).isNotNull())
        self._append(self._registers(named, {"dump": F.struct(F.col(at).cast("timestamp").alias("at"), place.alias("v"))}, self._kinds()))

    def add_results(self, results: DataFrame, at: str = "at") -> None:
        """A model's results (key, at, description, tags)."""
        value = F.struct(*[F.col(c).cast("string").alias(c) for c in ENRICHED])
        self._append(self._registers(results, {"result": F.struct(F.col(at).cast("timestamp").alias("at"), value.alias("v"))}, self._kinds()))

    def add_rows(self, rows: DataFrame) -> None:
        """New keys of the catalogue, as the next base; known ones stay as they are. What waited
        for them applies."""
        base = read_snapshot(self.spark, f"{self.path}/base")
        regs = [c for c in base.columns if c.startswith("r_")]
        waiting = base.where("not __known").select(self.key, *regs)
        known = base.where("__known")
        fresh = rows.join(known.select(self.key), self.key, "left_anti").join(waiting, self.key, "left").withColumn("__known", F.lit(True))
        still = base.where("not __known").join(rows.select(self.key), self.key, "left_anti")
        self._promoted(known.unionByName(fresh, allowMissingColumns=True).unionByName(still))

    # --- reading

    def _delta_paths(self) -> list[str]:
        fs, p, make = _fs(self.spark, f"{self.path}/deltas")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return [f"{self.path}/deltas/{n}" for n in sorted(names) if fs.exists(make(f"{self.path}/deltas/{n}/_SUCCESS"))]

    def _merged(self, paths: Sequence[str]) -> DataFrame:
        """The base with the deltas' registers merged in; unknown keys are rows that aren't known."""
        base = read_snapshot(self.spark, f"{self.path}/base")
        if not paths:
            return base
        regs = [c for c in base.columns if c.startswith("r_")]
        kind = dict(base.dtypes)
        schema = ",".join(f"`{c}` {kind[c]}" for c in (self.key, *regs))
        # one row a key, added up before the shuffle; a struct's maximum is that of its time first
        latest = self.spark.read.schema(schema).parquet(*paths).groupBy(self.key).agg(*[F.max(c).alias(f"n{c}") for c in regs])
        both = base.join(latest, self.key, "full")
        later = {c: F.greatest(c, f"n{c}") for c in regs}
        return both.withColumns(later | {"__known": F.coalesce("__known", F.lit(False))}).select(*base.columns)

    def read(self) -> DataFrame:
        """The catalogue as it is: the columns that it was created with."""
        return self._shown(self._merged(self._delta_paths()))

    def _shown(self, merged: DataFrame) -> DataFrame:
        columns = [c for c in merged.columns if c != "__known" and not c.startswith("r_")]
        have = {c[2:] for c in merged.columns if c.startswith("r_")}
        given = lambda f: F.col(f"r_edit_{f}").isNotNull() if f"edit_{f}" in have else F.lit(False)
        before = tc.json_list(F.col("edited_fields")) if "edited_fields" in columns else F.array().cast("array<string>")
        values: dict[str, Column] = {}
        for c in columns:
            old = F.col(c)
            if c in ENRICHED:
                old = F.when(F.col("r_result").isNotNull() & ~F.array_contains(before, c), F.col(f"r_result.v.{c}")).otherwise(old)
            if c in EDITED and c not in PLACE and f"edit_{c}" in have:
                edit = F.col(f"r_edit_{c}.v")
                old = F.when(given(c), F.nullif(edit, F.lit("")) if c == "description" else edit).otherwise(old)
            values[c] = old
        if "state" in columns:
            values["state"] = F.when(F.col("r_result").isNotNull(), F.lit(1)).otherwise(F.col("state"))
        if "place_source" in columns:
            edit, name = F.col("r_edit_place_name"), F.nullif(F.col("r_edit_place_name.v"), F.lit(""))
            typed = given("place_name") & name.isNotNull()
            dumped = F.col("r_dump").isNotNull() & F.when(given("place_name"), name.isNull() & (F.col("r_dump.at") > edit["at"])).otherwise(~F.col("place_source").eqNullSafe("manual"))
            for c in PLACE:
                if c in columns:
                    values[c] = F.when(typed, name if c == "place_name" else F.lit(None)).when(dumped, F.col(f"r_dump.v.{c}")).when(given("place_name"), F.lit(None)).otherwise(F.col(c))
            values["place_source"] = F.when(typed, "manual").when(dumped, "apple").when(given("place_name"), F.lit(None)).otherwise(F.col("place_source"))
        if "edited_fields" in columns:
            touched = F.filter(F.array(*[F.when(given(c), F.lit(c)) for c in EDITED]), lambda x: x.isNotNull())
            values["edited_fields"] = F.when(F.size(touched) > 0, F.to_json(F.array_sort(F.array_union(before, touched)))).otherwise(F.col("edited_fields"))
        return merged.where("__known").select(*[v.alias(c) for c, v in values.items()])

    def compact(self) -> None:
        """The merged registers as the next base; the deltas that it holds are removed then."""
        paths = self._delta_paths()
        if not paths:
            return
        self._promoted(self._merged(paths))
        fs, _, make = _fs(self.spark, self.path)
        for p in paths:
            fs.delete(make(p), True)
