"""The cache that outlives a job: nothing generated twice, snapshots that a crash leaves alone, no shuffle of the cache."""

import os

import pytest
from pyspark.sql import functions as F

from clashlens.plans.paraphrase_cache import ParaphraseCache
from clashlens.plans.training import builtin_paraphrases


def requests(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "sentence string")


def counting(seen, n=2):
    def gen(misses):
        seen.append(sorted(r.sentence for r in misses.collect()))
        return builtin_paraphrases(misses, n)
    return gen


A, B, C = "alpha beta gamma delta", "one two three four", "solo"


def rows(df):
    return {(r.sentence, r.rank): (r.paraphrase, r.from_cache) for r in df.collect()}


def test_second_run_generates_nothing(spark, tmp_path):
    path, seen = str(tmp_path / "cache"), []
    first = rows(ParaphraseCache(spark, path, 4).lookup(requests(spark, A, B, B, C, None), generator=counting(seen)))
    again = rows(ParaphraseCache(spark, path, 4).lookup(requests(spark, A, B, C), generator=counting(seen)))
    assert seen == [sorted([A, B, C])] and {k: v[0] for k, v in first.items()} == {k: v[0] for k, v in again.items()}
    assert not any(f for _, f in first.values()) and all(f for _, f in again.values()) and len(first) == 4
    more = rows(ParaphraseCache(spark, path, 4).lookup(requests(spark, B, "five six seven"), generator=counting(seen)))
    assert seen[1:] == [["five six seven"]] and more[B, 1][1] and not more["five six seven", 1][1]
    assert ParaphraseCache(spark, path, 4).version() == 2


def test_longer_lists_are_generated_anew(spark, tmp_path):
    path, seen = str(tmp_path / "cache"), []
    ParaphraseCache(spark, path, 4).lookup(requests(spark, A), n=1, generator=counting(seen, 1)).collect()
    got = rows(ParaphraseCache(spark, path, 4).lookup(requests(spark, A), n=3, generator=counting(seen, 3)))
    short = rows(ParaphraseCache(spark, path, 4).lookup(requests(spark, A), n=2, generator=counting(seen, 2)))
    assert seen == [[A], [A]] and len(got) == 3 and len(short) == 2 and all(f for _, f in short.values())


def test_a_crash_before_the_commit_leaves_the_old_snapshot(spark, tmp_path, monkeypatch):
    path, seen = str(tmp_path / "cache"), []
    cache = ParaphraseCache(spark, path, 4)
    cache.lookup(requests(spark, A), generator=counting(seen)).collect()
    before = sorted(tuple(r) for r in cache.read().collect())

    def crash(*_):
        raise RuntimeError("lost")
    monkeypatch.setattr(cache, "_commit", crash)
    with pytest.raises(RuntimeError, match="lost"):
        cache.lookup(requests(spark, B), generator=counting(seen))
    again = ParaphraseCache(spark, path, 4)
    assert again.version() == 1 and sorted(tuple(r) for r in again.read().collect()) == before
    assert rows(again.lookup(requests(spark, B), generator=counting(seen)))[B, 1][1] is False and again.version() == 2


def test_of_two_writers_one_wins(spark, tmp_path):
    cache = ParaphraseCache(spark, str(tmp_path / "cache"), 4)
    folder = cache._write(requests(spark, A).select("sentence", F.lit(1).alias("rank"), F.lit("x").alias("paraphrase")))
    cache._commit(1, folder)
    with pytest.raises(Exception, match="exist"):
        cache._commit(1, "other")
    assert cache.read().count() == 1


def test_the_cache_is_not_shuffled(spark, tmp_path):
    cache = ParaphraseCache(spark, str(tmp_path / "cache"), 4)
    cache.lookup(requests(spark, A, B)).collect()
    wanted = requests(spark, A).distinct().repartition(4, "sentence")
    plan = cache.read().hint("merge").join(wanted, "sentence", "left_semi")._jdf.queryExecution().executedPlan().toString()
    scan = plan[:plan.index("FileScan")]
    assert "Bucketed: true" in plan and "Exchange" not in scan
    assert len([f for f in os.listdir(tmp_path / "cache" / "data")]) == 1
