"""Nested reply elements of any depth."""

import json
import random

import pytest
from pyspark.sql import functions as F

from albumen.operators import replies

KEYS = ("tag", "name", "label", "value", "feature", "text")


def expected(v):
    """The rule in plain Python: the first known key that is there, however deep."""
    while isinstance(v, dict):
        known = [k for k in KEYS if k in v]
        if not known:
            return None
        v = v[known[0]]
    if v is None or isinstance(v, (bool, list)):
        return None
    return v.strip() or None if isinstance(v, str) else str(v)


def nested(rng, depth):
    if not depth:
        return rng.choice(["sea", " x ", "", 7, None, True, "a{b"])
    inner = nested(rng, depth - 1)
    out = {rng.choice(KEYS): inner, "other": {"tag": {"tag": "no"}}}
    if rng.random() < 0.3:
        out[rng.choice(KEYS)] = rng.choice(["first", 3, None, {}])
    items = list(out.items())
    rng.shuffle(items)
    return dict(items)


@pytest.mark.parametrize("seed", [1, 2])
def test_elements_of_any_depth(spark, seed):
    rng = random.Random(seed)
    values = [nested(rng, d) for d in (0, 1, 2, 4, 5, 6, 20, 60) for _ in range(25)]
    rows = [(i, json.dumps({"tags": [v, "end"], "description": "d"}), expected(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, json string, want string")
    got = {r["i"]: r["tags"] for r in replies.flatten_reply(df).collect()}
    assert got == {i: list(dict.fromkeys([x for x in (want, "end") if x is not None])) for i, _, want in rows}


def test_deep_scalar(spark):
    deep = "sea"
    for _ in range(200):
        deep = {"tag": deep}
    df = spark.createDataFrame([(json.dumps(deep),)], "j string")
    assert df.select(replies.scalar_text(F.parse_json("j"))).first()[0] == "sea"


# --- streams that must not count twice, or lose what comes late ------------------


def test_a_batch_that_dies_is_written_once(spark, tmp_path):
    from albumen.streaming import ingest

    folder, sink = tmp_path / "in", ingest.OnceSink(spark, str(tmp_path / "table"))
    folder.mkdir()
    (folder / "a.json").write_text("1")
    died = []

    def apply(batch, number):
        if number == 1 and not died:  # rows are there, their mark isn't
            died.append(True)
            batch.unionByName(batch).write.mode("overwrite").parquet(f"{sink.path}/data/batch={number}")
            raise RuntimeError("lost")
        sink.write(batch, number)

    def run():
        ingest.run_stream(ingest.sidecar_stream(spark, str(folder)), apply, str(tmp_path / "cp")).awaitTermination()

    schema = "path string, name string, uuid string, raw string"
    assert sink.read(schema).count() == 0
    run()
    (folder / "b.json").write_text("2")
    with pytest.raises(Exception, match="lost"):
        run()
    assert [r["raw"] for r in sink.read(schema).collect()] == ["1"]
    run()
    assert sorted(r["raw"] for r in sink.read(schema).collect()) == ["1", "2"]
    run()
    sink.write(sink.read(schema), 1)
    assert sorted(r["raw"] for r in sink.read(schema).collect()) == ["1", "2"] and sink.committed() == [0, 1]


def test_late_early_and_missing_companions(spark, tmp_path):
    from albumen.streaming import ingest

    def put(name, rows, column):
        spark.createDataFrame(rows, f"k long, {column} string").withColumn(column, F.col(column).cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    day = lambda n: f"2024-01-{n:02d}"
    put("records", [(1, day(1)), (2, day(2)), (3, day(3)), (None, day(3))], "at")
    put("files", [(1, day(1)), (4, day(3)), (None, day(3))], "file_at")
    read = lambda name, c: spark.readStream.schema(f"k long, {c} timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))

    def run():
        out = ingest.late_companions(read("records", "at"), read("files", "file_at"), "k", "at", "file_at", "5 days")
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        got = spark.read.schema("k long, at timestamp, file_at timestamp").parquet(str(tmp_path / "out"))
        return sorted(((r["k"], r["file_at"] and r["file_at"].day) for r in got.collect()), key=str)

    assert run() == [(1, 1)]
    put("records", [(4, day(5))], "at")  # its file was there before
    put("files", [(2, day(6)), (2, day(7)), (3, day(9))], "file_at")  # late, a second one, and one that is too late
    assert run() == [(1, 1), (2, 6), (2, 7), (4, 3)]
    put("records", [(9, day(30))], "at")
    put("files", [(8, day(30))], "file_at")
    assert run() == [(1, 1), (2, 6), (2, 7), (3, None), (4, 3), (None, None)]  # 3 and the row without a key never had one


# --- a table that is merged when it is read ---------------------------------------


COLS = "k long, description string, tags string, persons string, date string, state int, place_name string, place_source string, place_city string, edited_fields string"


def replayed(base, events):
    """One row after its events in the order of their time, by plain rules."""
    row = dict(base)
    protected = set(json.loads(row["edited_fields"]))
    for at, kind, values in sorted(events, key=lambda e: e[0]):
        if kind == "edit":
            for f, v in values.items():
                if v is None:
                    continue
                row[f] = v or None if f in ("description", "place_name") else v
                if f == "place_name":
                    row["place_source"], row["place_city"] = ("manual" if v else None), None
                protected.add(f)
        elif kind == "dump" and row["place_source"] != "manual" and values["name"]:
            row["place_name"], row["place_source"], row["place_city"] = values["name"], "apple", values["city"]
        elif kind == "result":
            row["state"] = 1
            row |= {f: v for f, v in values.items() if f not in protected}
    row["edited_fields"] = json.dumps(sorted(protected), separators=(",", ":")) if protected != set(json.loads(base["edited_fields"])) else base["edited_fields"]
    return row


@pytest.mark.parametrize("seed", [1, 2])
def test_layers_in_any_order(spark, tmp_path, seed):
    from albumen.operators.layers import LayeredTable

    rng = random.Random(seed)
    names = [c.split()[0] for c in COLS.split(", ")]
    base = [(k, f"d{k}", '["t"]', "[]", "2000-01-01", 0, "Old", rng.choice(["manual", "nearby", None]), "Town", rng.choice(["[]", '["description"]'])) for k in range(40)]
    times = iter(rng.sample(range(1000), 400))
    at = lambda n: f"2024-01-01 00:{n // 60:02d}:{n % 60:02d}"
    events = []
    for k in range(45):  # the last five aren't in the base
        for _ in range(rng.randint(0, 6)):
            n, kind = next(times), rng.choice(["edit", "dump", "result"])
            if kind == "edit":
                values = {"description": rng.choice([None, "", f"typed {n}"]), "tags": rng.choice([None, f'["e{n}"]']), "place_name": rng.choice([None, "", f"P {n}"]), "date": rng.choice([None, "2001-02-03"])}
            elif kind == "dump":
                values = {"name": rng.choice(["", f"D {n}"]), "city": rng.choice([None, f"C {n}"])}
            else:
                values = {"description": f"model {n}", "tags": f'["m{n}"]'}
            events.append((k, n, kind, values))
    rng.shuffle(events)
    table = LayeredTable(spark, str(tmp_path / "t"), "k")
    table.create(spark.createDataFrame(base, COLS))

    def deliver(part):
        for kind, add, schema in (("edit", table.add_edits, "k long, at string, description string, tags string, place_name string, date string"), ("dump", table.add_places, "k long, at string, name string, city string"), ("result", table.add_results, "k long, at string, description string, tags string")):
            rows = [(k, at(n), *v.values()) for k, n, kd, v in part if kd == kind]
            if rows:
                add(spark.createDataFrame(rows, schema))

    deliver(events[:60])
    table.compact()
    deliver(events[60:])
    deliver(events[:80])  # some come twice
    want = {}
    for r in base:
        row = replayed(dict(zip(names, r, strict=True)), [(n, kd, v) for k, n, kd, v in events if k == r[0]])
        want[r[0]] = tuple(row[c] for c in names)
    shown = lambda: {r["k"]: tuple(r) for r in table.read().collect()}
    assert shown() == want
    table.compact()
    assert shown() == want and not table._delta_paths()
    late = (41, f"d{41}", "[]", "[]", "2000-01-01", 0, None, None, None, "[]")
    table.add_rows(spark.createDataFrame([late, (0, *late[1:])], COLS))
    row = replayed(dict(zip(names, late, strict=True)), [(n, kd, v) for k, n, kd, v in events if k == 41])
    assert shown() == want | {41: tuple(row[c] for c in names)}  # what waited applies; a known key stays
