import pytest

from solvane.api import VERBS
from solvane.operators.materialised import Materialised, Queue, cancellable, key_of


def test_verbs_are_documented():
    assert len(VERBS) > 60 and all(callable(f) and f.__doc__ for n, f in VERBS.items() if n not in ("annual-irradiance",))


def test_results_are_made_once_and_bounded(spark, tmp_path):
    m = Materialised(spark, f"file://{tmp_path}/m", entries=2)
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for n in ("a", "a", "b", "c"):
        assert m.get(key_of("range", n), make).count() == 3
    assert len(made) == 3 and m.stats() == {"hits": 1, "misses": 3, "entries": 2}
    (tmp_path / "m" / key_of("range", "c") / "_SUCCESS").unlink()
    m.get(key_of("range", "c"), make)
    assert len(made) == 4
    m.clear()
    assert m.stats()["entries"] == 0


def test_damaged_results_are_made_again_and_memory_is_bounded(spark, tmp_path):
    m = Materialised(spark, f"file://{tmp_path}/m", held=1)
    made = []

    def make(n):
        made.append(n)
        return spark.range(n)

    assert m.get("a", lambda: make(3)).count() == 3 and m.get("b", lambda: make(4)).count() == 4
    assert m.tiers() == {"held": 1, "recovered": 0}
    # another table under the same key: its rows do not give the seal
    spark.range(9).write.mode("append").parquet(f"file://{tmp_path}/m/a")
    assert m.get("a", lambda: make(3)).count() == 3 and made == [3, 4, 3] and m.tiers()["recovered"] == 1
    fresh = Materialised(spark, f"file://{tmp_path}/m")
    assert fresh.get("a", lambda: make(3)).count() == 3 and made == [3, 4, 3]


def test_queue_is_bounded(spark):
    q = Queue(spark, running=1, waiting=0)
    with q.slot("night"):
        assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") == "night"
        with pytest.raises(RuntimeError), q.slot("day"):
            pass
    with q.slot("day"):
        assert spark.range(3).count() == 3
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None


def test_jobs_carry_tags(spark):
    with cancellable(spark, "night-run"):
        assert "night-run" in spark.getTags()
    assert "night-run" not in spark.getTags()
