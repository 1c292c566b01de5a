import pyarrow as pa
import pytest

from pathsift.llm import common


def _held_mb() -> float:
    with open("/proc/self/smaps_rollup") as f:
        return next(int(x.split()[1]) for x in f if x.startswith("Rss:")) / 1024


def _fill(pins: list) -> None:
    """100 MB in small pieces, freed but for one in a thousand that holds the heap open."""
    pieces = [bytes(1000) for _ in range(100_000)]
    pins.extend(pieces[::1000])


@pytest.mark.parametrize("kind", ["map", "groups"])
def test_workers_give_back_what_a_task_has_freed(kind, monkeypatch):
    monkeypatch.setattr(common, "GIVE_BACK_S", 0)
    pins: list = []
    common.give_back()
    before = _held_mb()
    table = pa.table({"a": [1, 2]})
    if kind == "map":
        def run(batches):
            for b in batches:
                _fill(pins)
                yield b
        assert list(common.lean(run)([1, 2])) == [1, 2]
    else:
        def run(t):
            _fill(pins)
            return t
        assert common.lean_groups(run)(table) is table
    assert _held_mb() - before < 50


def test_a_failing_task_still_fails():
    def run(batches):
        yield from batches
        raise ValueError("no")
    with pytest.raises(ValueError):
        list(common.lean(run)([1]))
