"""Small weighted finite-state transducers over token classes.

An arc reads a class, writes a class and pays gain * (weight of the token) + bonus.
Machines are composed into one, and a clause is worth its best path.
"""

from __future__ import annotations

from dataclasses import dataclass, field

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "insult", "threat", "target", "negation", "report", "other"
DENIED, QUOTED = "denied", "quoted"
SYMBOLS = (INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER, DENIED, QUOTED)


@dataclass
class Transducer:
    """Start state 0; every state may end a clause. A pair without arc copies its class and stays."""

    states: int
    arcs: dict[tuple[int, str], list[tuple[str, float, float, int]]] = field(default_factory=dict)

    def arc(self, state: int, reads: str, writes: str, to: int, gain: float = 0.0, bonus: float = 0.0) -> Transducer:
        self.arcs.setdefault((state, reads), []).append((writes, gain, bonus, to))
        return self

    def step(self, state: int, symbol: str) -> list[tuple[str, float, float, int]]:
        return self.arcs.get((state, symbol)) or [(symbol, 0.0, 0.0, state)]

    def compose(self, after: Transducer) -> Transducer:
        """The machine that feeds what this one writes into `after`; weights add."""
        out = Transducer(self.states * after.states)
        for a in range(self.states):
            for b in range(after.states):
                for symbol in SYMBOLS:
                    for middle, gain, bonus, to_a in self.step(a, symbol):
                        for writes, more, extra, to_b in after.step(b, middle):
                            out.arc(a * after.states + b, symbol, writes, to_a * after.states + to_b, gain + more, bonus + extra)
        return out

    def best(self, tokens: list[tuple[str, float]]) -> float:
        """Weight of the best path for (class, weight) tokens."""
        front = {0: 0.0}
        for symbol, weight in tokens:
            following: dict[int, float] = {}
            for state, value in front.items():
                for _, gain, bonus, to in self.step(state, symbol):
                    new = value + gain * weight + bonus
                    if new > following.get(to, float("-inf")):
                        following[to] = new
            front = following
        return max(front.values())


def negation(scope: int = 3) -> Transducer:
    """Insults and threats up to `scope` tokens after a negation are denied."""
    t = Transducer(scope + 1)
    for state in range(scope + 1):
        t.arc(state, NEGATION, NEGATION, scope)
        if state:
            for symbol in (INSULT, THREAT):
                t.arc(state, symbol, DENIED, state - 1)
            for symbol in (TARGET, REPORT, OTHER):
                t.arc(state, symbol, symbol, state - 1)
    return t


def reported() -> Transducer:
    """After a verb of speech the rest of the clause is quoted."""
    t = Transducer(2).arc(0, REPORT, REPORT, 1)
    for symbol in (INSULT, THREAT, DENIED):
        t.arc(1, symbol, QUOTED, 1)
    return t


def insults(denied: float, quoted: float) -> Transducer:
    """Insults pay their weight, denied and quoted ones a part of it."""
    t = Transducer(1)
    t.arc(0, INSULT, INSULT, 0, gain=1.0).arc(0, DENIED, DENIED, 0, gain=denied).arc(0, QUOTED, QUOTED, 0, gain=quoted)
    return t


def threats() -> Transducer:
    """A threat pays when a target follows it in the clause or has come before."""
    t = Transducer(3)
    t.arc(0, THREAT, THREAT, 1).arc(0, TARGET, TARGET, 2)
    t.arc(1, TARGET, TARGET, 2, bonus=2.0)
    t.arc(2, THREAT, THREAT, 2, bonus=2.0)
    return t


def aimed(bonus: float) -> Transducer:
    """An insult with a target in its clause pays once more, whichever comes first."""
    t = Transducer(4)
    t.arc(0, INSULT, INSULT, 1).arc(0, TARGET, TARGET, 2)
    t.arc(1, TARGET, TARGET, 3, bonus=bonus).arc(2, INSULT, INSULT, 3, bonus=bonus)
    return t


def grammar(denied: float = 0.25, quoted: float = 0.5, bonus: float = 1.0) -> Transducer:
    return negation().compose(reported()).compose(insults(denied, quoted)).compose(threats()).compose(aimed(bonus))
