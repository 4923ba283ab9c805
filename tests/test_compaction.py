from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from vitrine.operators import commits, compaction, dedup, history, link_filters
from vitrine.schemas import RAW_PAYLOADS, SENT_OFFERS
from vitrine.streaming import offers as streams

START = date(2024, 1, 1)


def rows_of(batch, days, links=7):
    return [(f"https://x/{batch}/{d}/{i}", "t", Decimal(i + 1), None, None, "s", "", datetime.combine(START + timedelta(days=d), datetime.min.time()),
             1.0, batch, START + timedelta(days=d)) for d in days for i in range(links)]


def seen(spark, path, manifest):
    return sorted((r.link, r.price) for r in commits.visible(history.read_sent(spark, path), manifest).collect())


def test_a_day_of_batches_becomes_one(spark, tmp_path, monkeypatch):
    path, manifest = str(tmp_path / "sent"), str(tmp_path / "batches")
    batches = {n: rows_of(n, [n // 4, n // 4 + 1]) for n in range(12)}
    link_filters.append_sent(spark.createDataFrame(sum(batches.values(), []), SENT_OFFERS), path)
    commits.commit_batches(spark, manifest, [n for n in batches if n != 5], [path])  # batch 5 broke off
    want = sorted((r[0], r[2]) for n, rows in batches.items() if n != 5 for r in rows)
    assert seen(spark, path, manifest) == want
    # a merge that breaks off before its commit changes nothing
    with monkeypatch.context() as m:
        m.setattr(commits, "commit_days", lambda *a: (_ for _ in ()).throw(RuntimeError("gone")))
        with pytest.raises(RuntimeError):
            compaction.compact(spark, path, manifest)
    assert seen(spark, path, manifest) == want
    assert compaction.compact(spark, path, manifest, before=START + timedelta(days=3)) == [START + timedelta(days=d) for d in range(3)]
    assert seen(spark, path, manifest) == want  # before and after the replaced batches are deleted
    assert compaction.drop_replaced(spark, path, manifest) == 20 and seen(spark, path, manifest) == want
    left = link_filters.partitions(spark, path)
    assert all(len([1 for day, _ in left if day == f"sent_date={START + timedelta(days=d)}"]) == 1 for d in range(3))
    # later batches of a merged day are shown beside it, and merged next time
    late = rows_of(20, [0, 2])
    link_filters.append_sent(spark.createDataFrame(late, SENT_OFFERS), path)
    assert seen(spark, path, manifest) == want
    commits.commit_batch(spark, manifest, 20, [path])
    want = sorted(want + [(r[0], r[2]) for r in late])
    assert seen(spark, path, manifest) == want
    assert len(compaction.compact(spark, path, manifest)) == 3 and seen(spark, path, manifest) == want
    compaction.drop_replaced(spark, path, manifest)
    assert seen(spark, path, manifest) == want and compaction.compact(spark, path, manifest) == []
    asked = spark.createDataFrame([(late[0][0],), ("https://new",), (batches[3][0][0],)], "link string")
    assert link_filters.days_to_read(spark, path, asked) == [START]
    assert [r.link for r in dedup.unpublished(asked, link_filters.read_sent_for(spark, path, asked)).collect()] == ["https://new"]


def test_large_days_have_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(compaction, "ROWS_PER_FILE", 10)
    path, manifest = str(tmp_path / "sent"), str(tmp_path / "batches")
    link_filters.append_sent(spark.createDataFrame(rows_of(1, [0], 40) + rows_of(2, [0], 40), SENT_OFFERS), path)
    commits.commit_batches(spark, manifest, [1, 2], [path])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are put together again
    try:
        compaction.compact(spark, path, manifest)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    merged = commits.visible(history.read_sent(spark, path), manifest)
    files = history.read_sent(spark, path).filter("batch_id < 0").select(F.input_file_name()).distinct()
    assert merged.count() == 80 and files.count() > 1


def test_payloads_to_published_offers(spark, tmp_path):
    """Two batches of captured payloads on a stream: offers, history, run log; then a batch without any offer."""
    tables = streams.Tables(*[str(tmp_path / n) for n in ("sent", "accepted", "prices", "outbox", "funnel")])
    at, inbox = datetime(2024, 1, 1), str(tmp_path / "in")
    item = '{"id":"%s","attributes":{"title":"%s","product_link":"s","price":%s}}'
    page = lambda *items: ("kabum", "https://k", 0, at, "json", '{"data":[' + ",".join(items) + "]}")

    def run(rows):
        spark.createDataFrame(rows, RAW_PAYLOADS).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(RAW_PAYLOADS).parquet(inbox)
        streams.run_payload_cycles(stream, tables, str(tmp_path / "runs"), str(tmp_path / "state"), ["kabum", "shopee"], every=None).start().awaitTermination()
        runs = spark.read.parquet(str(tmp_path / "runs"))
        last = runs.filter(F.col("batch_id") == runs.agg(F.max("batch_id")).first()[0])
        sent = commits.visible(history.read_sent(spark, tables.sent), tables.batches).count()
        return sent, sorted((r.source, r.items_found, r.items_sent, r.errors, r.status) for r in last.collect())

    first = page(item % (1, "Notebook gamer bem forte", 3000), item % (2, "Notebook gamer bem fortes", 3000), item % (3, "curto", 3000))
    assert run([first, ("shopee", "https://s", 0, at, "json", "{broken")]) == (1, [("kabum", 2, 1, 0, "ok"), ("shopee", 0, 0, 1, "error")])
    assert run([page(item % (1, "Notebook gamer bem forte", 2900), item % (7, "Monitor curvo ultra largo", 3000))]) == (2, [("kabum", 2, 1, 0, "ok"), ("shopee", 0, 0, 0, "ok")])
    assert run([("shopee", "https://s", 0, at, "json", "{broken")]) == (2, [("kabum", 0, 0, 0, "ok"), ("shopee", 0, 0, 1, "error")])
    assert spark.read.parquet(tables.funnel).count() == 2


def test_offers_at_one_place_have_an_order(spark, tmp_path):
    """pages of one rank; which of two similar offers comes first depends neither on the order of pages nor on their files."""
    at = datetime(2024, 1, 1)
    body = '{"data":[{"id":"%s","attributes":{"title":"%s","product_link":"s","price":%s}}]}'
    names = [f"Notebook gamer bem forte{letter}" for letter in "abcdefghijkl"]
    pages = [("kabum", f"https://k/{n}", 0, at, "json", body % (n, name, 3000)) for n, name in enumerate(names, 11)]
    kept = []
    for k, rows in enumerate([pages, pages[::-1]]):
        tables = streams.Tables(*[str(tmp_path / f"{n}{k}") for n in ("sent", "accepted", "prices", "outbox", "funnel")])
        streams.payload_step(tables, str(tmp_path / f"runs{k}"), ["kabum"])(spark.createDataFrame(rows, RAW_PAYLOADS).coalesce(1), 0)
        kept.append(sorted(r.title for r in spark.read.parquet(tables.accepted).collect()))
    assert kept[0] == kept[1] == names[:1]


def test_pages_of_a_batch_go_once_their_offers_are_stored(spark, tmp_path):
    """the copy of the pages doesn't lie beside the tables of the cycle, and the run log has their errors nevertheless."""
    from glob import glob
    at, kept = datetime(2024, 1, 1), lambda: set(glob(f"{spark.conf.get('spark.checkpoint.dir')}/payloads-7-*/*"))
    body = '{"data":[{"id":"1","attributes":{"title":"Notebook gamer bem forte","product_link":"s","price":3000}}]}'
    pages, before = [("kabum", "https://k", 0, at, "json", body), ("kabum", "https://k", 1, at, "json", "{broken")], kept()
    tables = streams.Tables(*[str(tmp_path / n) for n in ("sent", "accepted", "prices", "outbox", "funnel")])
    streams.payload_step(tables, str(tmp_path / "runs"), ["kabum", "shopee"])(spark.createDataFrame(pages, RAW_PAYLOADS), 7)
    log = spark.read.parquet(str(tmp_path / "runs"))
    assert sorted((r.source, r.items_found, r.errors, r.run_at) for r in log.collect()) == [("kabum", 1, 1, at), ("shopee", 0, 0, at)]
    assert sorted(t.rsplit("/", 1)[1] for t in kept() - before) == ["errors", "found"]
