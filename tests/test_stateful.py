import random
from datetime import datetime, timedelta

from vitrine.operators.greedy import first_wins
from vitrine.streaming import stateful

WORDS = "mouse teclado gamer sem fio preto branco monitor curvo hub usb cabo fone".split()
START = datetime(2024, 1, 1)


def feed(spark, rows, schema, inbox):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)


def run(stream, folder):
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(
        availableNow=True).start().awaitTermination()


def loop(rows, ttl):
    last, out = {}, []
    for key, at, i in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in last or at - last[key] >= ttl:
            last[key] = at
            out.append((key, at, i))
    return sorted(out)


def test_event_order_whatever_the_batch_borders(spark, tmp_path):
    """Batches overlap in time and are shuffled; the outcome is that of the loop over all rows in order."""
    chance, schema = random.Random(8), "k string, at timestamp, i int"
    rows = [(chance.choice("abc"), START + timedelta(minutes=chance.randint(0, 6000)), i) for i in range(90)]
    rows.sort(key=lambda r: r[1] + timedelta(minutes=chance.randint(0, 1400)))  # arrival: late, but within the watermark
    loose = [(None, START, 900), (None, START, 901), ("a", None, 902)]
    end = [("z", START + timedelta(days=90), 999)]  # moves the watermark past all
    inbox = str(tmp_path / "in")
    for part in (rows[:25] + loose, rows[25:50], rows[50:], end):
        feed(spark, part, schema, inbox)
        stream = spark.readStream.schema(schema).parquet(inbox)
        run(stateful.first_in_event_order(stream, "k", "at", ["at", "i"], ttl_seconds=86400, late="1500 minutes"), tmp_path)
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(r for r in got if r[0] and r[1]) == loop(rows, timedelta(days=1))
    assert sorted(r[2] for r in got if not (r[0] and r[1])) == [900, 901, 902]


def test_first_wins_survives_restarts(spark, tmp_path):
    """Three runs, each a new query on the same checkpoint, equal one batch over all rows of a key."""
    chance, schema = random.Random(2), "id int, store string, link string, title string"
    rows = [(i, chance.choice("pq"), None if i % 11 == 0 else f"https://x/{chance.randint(0, 40)}",
             None if i == 7 else " ".join(chance.choice(WORDS) for _ in range(chance.randint(2, 4)))) for i in range(90)]
    inbox = str(tmp_path / "in")
    for part in (rows[:30], rows[30:70], rows[70:]):
        feed(spark, part, schema, inbox)
        stream = spark.readStream.schema(schema).parquet(inbox)
        run(stateful.first_wins_stream(stream, "store", ["id"], horizon=5), tmp_path)
    got = {r["id"]: r["verdict"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {}
    for store in "pq":
        own = spark.createDataFrame([r for r in rows if r[1] == store], schema)
        want |= {r["id"]: r["verdict"] for r in first_wins(own, ["id"], horizon=5).collect()}
    assert got == want and {"accepted", "same_link", "similar_title"} == set(got.values())


def test_a_key_has_one_timer_however_many_rows_wait():
    import pandas as pd
    from pyspark.sql import types as T

    class State:
        def __init__(self):
            self.rows, self.one, self.timers, self.reads = [], None, [], 0
        getListState = getValueState = lambda self, *_: self
        def registerTimer(self, ms): self.timers.append(ms)
        def appendList(self, rows): self.rows += rows
        def put(self, rows): self.rows = list(rows)
        def get(self): return self.rows
        def exists(self): return bool(self.rows)
        def clear(self): self.rows = []

    class Value(State):
        def exists(self): return self.one is not None
        def get(self): return self.one
        def update(self, one): self.one = one
        def clear(self): self.one = None

    class Now:
        def __init__(self, ms): self.ms = ms
        def getCurrentWatermarkInMs(self): return self.ms

    schema = T._parse_datatype_string("k string, at timestamp, i int")
    made = stateful._EventOrder(schema, "k", "at", ["at", "i"], 60)
    made.handle = made.waiting = state = State()
    made.accepted = Value()
    ms = lambda minutes: int(pd.Timestamp(START + timedelta(minutes=minutes)).value // 1_000_000)
    rows = pd.DataFrame([("a", START + timedelta(minutes=m), m) for m in (5, 3, 9, 4, 8, 30)], columns=["k", "at", "i"])
    assert list(made.handleInputRows(("a",), iter([rows]), Now(0))) == [] and state.timers == [ms(3)]
    out = pd.concat(made.handleExpiredTimer(("a",), Now(ms(8)), None))
    assert list(out["i"]) == [3, 4, 5, 8] and [r[2] for r in state.rows] == [9, 30] and ms(9) in state.timers
    assert list(pd.concat(made.handleExpiredTimer(("a",), Now(ms(40)), None))["i"]) == [9, 30] and state.rows == []
