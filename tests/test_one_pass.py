"""Slot inventories are built once a query; polls of a key are rows, with as few calls for state as they need."""

from pyspark.sql import Row

from quillon.plans import carriers
from quillon.streaming import polls
from tests.conftest import SF


def test_slots_of_a_key_are_counted_in_one_pass(spark):
    for name in ("slot_venue_view", "availability_status"):
        plan = carriers.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("collect_list(") == 1 and plan.count("l_returnflag") > 0, name


def test_a_new_key_has_no_timers_to_look_for():
    class Handle:
        timers = []

        def getValueState(self, name, kind):
            return self

        def exists(self):
            return False

        def update(self, state):
            self.state = state

        def registerTimer(self, at):
            self.timers.append(at)

    p, handle = polls.poll_processor(), Handle()
    p.init(handle)
    rows = [Row(key="k", us=5, seq=2, ok=True, force=None, busy_ms=0, value="b"), Row(key="k", us=0, seq=1, ok=True, force=False, busy_ms=0, value=None)]
    got = list(p.handleInputRows(("k",), iter(rows), None))
    assert [(r.event, r.us, r.seq, r.value) for r in got] == [("fresh", 0, 1, None), ("soon", 5, 2, "b")]
    assert handle.timers == [polls.STALE // 1000] and handle.state[2] == 0
