"""An entity's state is read once and written once a trigger."""

from pyspark.sql import Row

from loreframe.streaming import edges


class State:
    """A value as a stream keeps it, with what is asked of it."""

    def __init__(self):
        self.value, self.calls = None, []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value


def test_one_read_and_one_write():
    """each object that was gained or lost asked the state anew, and each entity was a frame."""
    state, fold = State(), edges.Intervals()
    fold.init(state)
    row = lambda n, chapter, place, change, what: Row(chapter=chapter, ordinal=n, location=place, change=change, object=what)
    first = list(fold.handleInputRows((1, 2), iter([row(3, 4, "b", "loss", 7), row(1, 2, "a", "gain", 7), row(2, 2, "a", "gain", 8)]), None))
    assert [tuple(r) for r in first] == [("location", 1, 2, None, 1, "a", 2, 3), ("possession", 1, 2, 7, 1, None, 2, 4)]
    assert state.calls == ["get", "update"] and state.value[5] == [(8, 2, 2)]
    second = list(fold.handleInputRows((1, 2), iter([row(9, 9, "b", "loss", 8), row(0, 1, "c", "loss", 8), row(10, 9, "b", "loss", None)]), None))
    assert [tuple(r) for r in second] == [("late", 1, 2, None, 0, "c", 1, None), ("possession", 1, 2, 8, 2, None, 2, 9)]
    assert state.calls == ["get", "update"] * 2 and state.value == (3, "b", 4, 9, 10, [])
