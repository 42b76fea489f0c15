"""What a Python worker keeps once a task has ended."""
import numpy as np
import pyarrow as pa
import pytest

from preflight.llm import arrow_text, filters


def test_freed_memory_is_given_back_when_a_task_ends(monkeypatch):
    calls = []
    monkeypatch.setattr(arrow_text, "give_back", lambda: calls.append(1))

    def run(batches):
        for b in batches:
            yield b // 1 if b else 1 // b

    whole = arrow_text.lean(run)(iter([3, 2]))
    assert next(whole) == 3 and not calls
    assert list(whole) == [2] and calls == [1]
    with pytest.raises(ZeroDivisionError):
        list(arrow_text.lean(run)(iter([1, 0])))
    assert calls == [1, 1]


def test_give_back():
    arrow_text.give_back()


def test_power_tables_are_little_more_than_needed(monkeypatch):
    monkeypatch.setattr(arrow_text, "_POWERS", np.ones(1, np.uint64))
    monkeypatch.setattr(arrow_text, "_INVERSES", np.ones(1, np.uint64))
    few = [x[:10].copy() for x in arrow_text._powers(10)]
    arrow_text._powers(1_000_000)
    many = arrow_text._powers(1_100_000)
    assert len(arrow_text._POWERS) <= 1_100_000 + (1 << 18)
    assert all((a == b[:10]).all() for a, b in zip(few, many))
    assert (many[0] * many[1] == 1).all()


def test_filter_places_leave_a_task_piece_by_piece(monkeypatch):
    """A task holds ``PIECE`` hashes and no more, however much it reads; the
    merged filter is that of all pieces."""
    monkeypatch.setattr(filters, "PIECE", 4000, raising=False)
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 40_000, dtype=np.uint64)
    arrays = [*np.split(h, 40), h[:500], np.zeros(0, np.uint64), np.repeat(h[1000:1100], 2)]    # again, in other pieces
    read = []
    sent = filters.places_of_task((read.append(len(x)) or x for x in arrays), 20)
    first = next(sent)
    assert sum(read) <= 5000
    rest = list(sent)
    assert len(rest) > 8 and sum(read) == 40_700
    got = pa.Table.from_batches([first, *rest])
    seen = filters.TwiceSeen(1 << 17, 20)
    out = np.zeros((16, 8192), np.uint8)
    chunks = got["chunk"].to_numpy()
    for c in np.unique(chunks):
        out[c] = np.frombuffer(filters._merge(got.filter(pa.array(chunks == c)))["bits"][0].as_py(), np.uint8)
    seen.words = out.reshape(-1)
    assert seen.bits == 20 and seen.has(np.concatenate([h[:500], h[1000:1100]])).all()
    assert seen.has(h[2000:]).mean() < 0.05
    assert not list(filters.places_of_task(iter([np.zeros(0, np.uint64)]), 20))
