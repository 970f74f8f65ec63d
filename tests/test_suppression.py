"""A caller's own effect at a call stands for the callee's general one."""

from __future__ import annotations

from docweft.operators.corpus import Corpus
from docweft.operators.effects import Effects, Rule, witnesses
from docweft.operators.flow import steps_of
from docweft.sources.tables import Tables
from tests.test_whole import corpus, eid

RULES = [Rule("g", "event.fire", "fire", {"name": None}), Rule("s", "event.fire", "fire an event named (\\w+)", {"name": "$1"}), Rule("o", "event.fire", "emit", {"name": None})]
GENERAL, LOAD = eid("event.fire", '{"name":null}'), eid("event.fire", '{"name":"load"}')
TEXTS = {
    "general": "1. fire it.\n",
    "special": "1. Run general to fire an event named load.\n",  # its own stands for the callee's
    "mixed": "1. Run general to fire an event named load.\n2. Run general.\n",  # the second step has nothing of its own
    "other": "1. Run general to emit.\n",  # the same effect, but by no shared rule
    "reverse": "1. Run special to fire.\n",  # a general effect does not stand for a specific one
    "deep": "1. Run mid to fire an event named load.\n",  # mid's own does not cross, that of general does
    "mid": "1. fire it.\n2. Run general.\n",
}
LINKS = [("special", "general", "1", "Run general"), ("mixed", "general", "1", "Run general"), ("mixed", "general", "2", "Run general"), ("other", "general", "1", "Run general"), ("reverse", "special", "1", "Run special"), ("deep", "mid", "1", "Run mid"), ("mid", "general", "2", "Run general")]


def test_suppression(spark, tmp_path):
    c = Corpus(Tables(spark, corpus(spark, str(tmp_path / "t"), TEXTS, LINKS)))
    e = Effects(c, steps_of(c), RULES)
    got = {(r.node[2:], r.effect): (r.distance, r.local_sites) for r in e.summaries().collect()}
    assert got == {("general", GENERAL): (0, 1), ("special", LOAD): (0, 1), ("mixed", LOAD): (0, 1), ("mixed", GENERAL): (1, 0), ("other", GENERAL): (0, 1), ("reverse", GENERAL): (0, 1), ("reverse", LOAD): (1, 0), ("deep", LOAD): (0, 1), ("deep", GENERAL): (2, 0), ("mid", GENERAL): (0, 1)}
    states = e.states()
    ways = {(r.node[2:], r.effect): [x[2:] for x in r.path] for r in witnesses(states, states.select("node", "effect")).collect()}
    assert ways[("deep", GENERAL)] == ["deep", "mid", "general"] and ways[("mid", GENERAL)] == ["mid"] and set(ways) == set(got)
