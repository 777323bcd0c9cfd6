"""Topics with a commit log: every row once, and micro-batches of exactly so many records."""

import pytest
from pyspark.sql import functions as F

from windrow.storage import child_names
from windrow.streaming import commit_log
from windrow.streaming.commit_log import follow, follow_records, last_records, publish, publish_stream, published, remove_leftovers


@pytest.fixture
def folders(tmp_path):
    return [str(tmp_path / p) for p in ("topic", "seen", "checkpoint")]


def numbers(spark, low, high, parts=3):
    return spark.range(low, high, 1, parts).withColumn("text", F.concat(F.lit("x"), "id"))


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


class Lost(Exception):
    pass


def test_a_batch_counts_once(spark, folders):
    topic, _, _ = folders
    schema = numbers(spark, 0, 1).schema
    assert publish(numbers(spark, 0, 10), topic, 0)
    assert not publish(numbers(spark, 0, 10), topic, 0)
    assert publish(numbers(spark, 10, 12), topic, 0, writer="other")
    assert publish(numbers(spark, 0, 0), topic, 1)
    assert ids(published(spark, topic, schema)) == list(range(12))


def test_two_attempts_at_once(spark, folders, monkeypatch):
    """Both write their files; the entry of the second is refused."""
    topic, _, _ = folders
    monkeypatch.setattr(commit_log, "has_child", lambda *_: False)
    assert publish(numbers(spark, 0, 5), topic, 7)
    assert not publish(numbers(spark, 0, 5), topic, 7)
    monkeypatch.undo()
    assert ids(published(spark, topic, numbers(spark, 0, 1).schema)) == list(range(5))
    assert remove_leftovers(spark, topic, "batch") == 1
    assert ids(published(spark, topic, numbers(spark, 0, 1).schema)) == list(range(5))


def test_consumer_while_a_batch_fails(spark, folders, tmp_path, monkeypatch):
    """Batch 3 dies after its files and is run again; the consumer reads all rows once."""
    topic, seen, checkpoint = folders
    source, writing = str(tmp_path / "in"), str(tmp_path / "writing")
    schema = numbers(spark, 0, 1).schema

    def produce():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        publish_stream(stream, topic, checkpoint=writing).awaitTermination()

    def consume():
        query = follow(spark, topic, schema, lambda rows, k: publish(rows, seen, k) and None, checkpoint=checkpoint)
        query.awaitTermination()

    consume()  # before there is anything
    for k in range(6):
        numbers(spark, 10 * k, 10 * k + 10, 1).write.mode("append").parquet(source)
    real = commit_log.rename_new

    def lost(spark_, staged, target):
        if target.endswith("000000000003.json"):
            raise Lost("before the entry")
        return real(spark_, staged, target)

    with monkeypatch.context() as patch:
        patch.setattr(commit_log, "rename_new", lost)
        with pytest.raises(Exception, match="before the entry"):
            produce()
    consume()
    assert len(ids(published(spark, seen, schema))) == 30
    attempts = len(child_names(spark, f"{topic}/data"))
    produce()
    consume()
    consume()
    assert ids(published(spark, seen, schema)) == list(range(60))
    assert ids(published(spark, topic, schema)) == list(range(60))
    assert attempts == 4 and len(child_names(spark, f"{topic}/data")) == 7


@pytest.mark.parametrize("n", [7, 1, 40, 1000])
def test_micro_batches_of_n_records(spark, folders, n):
    """Batches of any size, one of them empty, over several starts."""
    topic, _, checkpoint = folders
    schema, calls = numbers(spark, 0, 1).schema, []

    def work(rows, k):
        calls.append((k, sorted((r["place"], r["id"], r["text"]) for r in rows.collect())))

    sizes, low = [25, 0, 3, 41, 11], 0
    if n == 1:
        sizes = [3, 0, 2]
    for b, size in enumerate(sizes):
        publish(numbers(spark, low, low + size), topic, b)
        low += size
        if b % 2:
            follow_records(spark, topic, schema, work, n, checkpoint=checkpoint).awaitTermination()
    follow_records(spark, topic, schema, work, n, checkpoint=checkpoint, batch_limit=1).awaitTermination()
    assert [k for k, _ in calls] == list(range(low // n))
    assert all(len(rows) == n for _, rows in calls)
    assert last_records(spark, schema, work, n, checkpoint=checkpoint) == (low % n > 0)
    every = [r for _, rows in calls for r in rows]
    assert [p for p, _, _ in every] == list(range(low))
    assert sorted(i for _, i, _ in every) == list(range(low))
    assert all(text == f"x{i}" for _, i, text in every)


def test_same_records_after_a_failure(spark, folders):
    topic, seen, checkpoint = folders
    schema, failed = numbers(spark, 0, 1).schema, []
    for b in range(3):
        publish(numbers(spark, 50 * b, 50 * b + 50), topic, b)

    def work(rows, k):
        if k == 9 and not failed:
            failed.append([r["id"] for r in rows.orderBy("place").collect()])
            raise Lost("in batch 9")
        publish(rows, seen, k)

    def start():
        follow_records(spark, topic, schema, work, 7, checkpoint=checkpoint, batch_limit=1).awaitTermination()

    with pytest.raises(Exception, match="in batch 9"):
        start()
    start()
    last_records(spark, schema, work, 7, checkpoint=checkpoint)
    found = published(spark, seen, numbers(spark, 0, 1).withColumn("place", F.lit(0).cast("long")).schema)
    assert ids(found) == list(range(150))
    again = found.filter("place BETWEEN 63 AND 69").orderBy("place")
    assert [r["id"] for r in again.collect()] == failed[0]


def test_nothing_to_hand_over(spark, folders):
    topic, _, checkpoint = folders
    schema = numbers(spark, 0, 1).schema

    def work(rows, k):
        raise AssertionError("no records")

    follow_records(spark, topic, schema, work, 5, checkpoint=checkpoint).awaitTermination()
    assert not last_records(spark, schema, work, 5, checkpoint=checkpoint)
    assert published(spark, topic, schema).count() == 0
