"""Small weighted finite-state transducers over clause tags, run as a cascade.

A transducer reads a clause's tags one by one; an arc (state, tag) -> (state, tag, weight) rewrites the tag
and adds its weight. A tag without an arc of its own takes the state's default arc, which keeps the tag.
compose() makes one transducer of two: it reads what the first reads and writes what the second writes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

Arc = tuple[str, str, float]


@dataclass
class Transducer:
    start: str
    arcs: dict[tuple[str, str], Arc] = field(default_factory=dict)
    #: state -> state that any other tag leads to; the tag is kept, with weight 0
    default: dict[str, str] = field(default_factory=dict)

    def step(self, state: str, tag: str) -> Arc:
        found = self.arcs.get((state, tag))
        return found if found else (self.default.get(state, state), tag, 0.0)

    def run(self, tags: list[str]) -> tuple[list[str], float]:
        state, total, out = self.start, 0.0, []
        for t in tags:
            state, t, w = self.step(state, t)
            out.append(t)
            total += w
        return out, total

    def states(self) -> set[str]:
        return {self.start, *self.default, *self.default.values(), *(s for s, _ in self.arcs), *(a[0] for a in self.arcs.values())}


def compose(first: Transducer, second: Transducer, tags: tuple[str, ...]) -> Transducer:
    """The cascade of both as one transducer over the given input tags."""
    pair = lambda a, b: f"{a}|{b}"
    out = Transducer(pair(first.start, second.start))
    todo, seen = [(first.start, second.start)], {(first.start, second.start)}
    while todo:
        a, b = todo.pop()
        for t in tags:
            a2, mid, w1 = first.step(a, t)
            b2, end, w2 = second.step(b, mid)
            out.arcs[pair(a, b), t] = (pair(a2, b2), end, w1 + w2)
            if (a2, b2) not in seen:
                seen.add((a2, b2))
                todo.append((a2, b2))
    return out


#: Input tags: insult, threat verb, target, negation, reporting verb or quotation, will/shall words, the same of languages that put the target before the verb, a person whom a threat may aim at, any other word.
TAGS = ("insult", "threat", "target", "negation", "report", "will", "modal", "person", "word")


def negation(reach: int = 3) -> Transducer:
    """An insult within `reach` words after a negation is marked as denied, a threat there is none."""
    t = Transducer("plain", default={"plain": "plain"})
    t.arcs["plain", "negation"] = (f"neg{reach}", "negation", 0.0)
    for k in range(reach, 0, -1):
        after = f"neg{k - 1}" if k > 1 else "plain"
        t.default[f"neg{k}"] = after
        t.arcs[f"neg{k}", "negation"] = (f"neg{reach}", "negation", 0.0)
        t.arcs[f"neg{k}", "insult"] = ("plain", "denied", 0.0)
        t.arcs[f"neg{k}", "threat"] = ("plain", "word", 0.0)
    return t


def reported_speech() -> Transducer:
    """After a reporting word, what the clause says is told of, not said: insults are marked as quoted, threats are none."""
    t = Transducer("own", default={"own": "own", "told": "told"})
    t.arcs["own", "report"] = ("told", "report", 0.0)
    t.arcs["told", "insult"] = ("told", "quoted", 0.0)
    t.arcs["told", "threat"] = ("told", "word", 0.0)
    return t


def insults(weights: dict[str, float]) -> Transducer:
    """A clause's insults, once each with a target before or after them."""
    t = Transducer("none", default={"none": "none", "aimed": "aimed", "hit": "hit", "done": "done"})
    for s in ("none", "aimed", "hit", "done"):
        for tag in ("insult", "denied", "quoted"):
            t.arcs[s, tag] = ("done" if s in ("aimed", "done") else "hit", tag, weights[tag] + (weights["target"] if s == "aimed" and tag == "insult" else 0.0))
    t.arcs["none", "target"] = ("aimed", "target", 0.0)
    t.arcs["hit", "target"] = ("done", "target", weights["target"])
    return t


def threats(weights: dict[str, float]) -> Transducer:
    """will ... threat verb ... target, in this order; or modal and target, in any order, ... threat verb."""
    t = Transducer("calm", default={s: s for s in ("calm", "will", "verb", "aimed", "modal", "both", "no")})
    for s in ("calm", "aimed", "no"):
        t.arcs[s, "will"] = ("will", "will", 0.0)
        t.arcs[s, "negation"] = ("no", "negation", 0.0)  # before a modal it denies what follows
    t.arcs["calm", "modal"] = ("modal", "modal", 0.0)
    t.arcs["aimed", "modal"] = ("both", "modal", 0.0)
    t.arcs["no", "modal"] = ("calm", "modal", 0.0)
    for tag in ("target", "person"):
        t.arcs["calm", tag] = ("aimed", tag, 0.0)
        t.arcs["modal", tag] = ("both", tag, 0.0)
        t.arcs["verb", tag] = ("calm", tag, weights["threat"])
    for s in ("will", "modal"):
        t.arcs[s, "threat"] = ("verb", "threat", 0.0)
    for s in ("will", "modal", "both"):
        t.arcs[s, "negation"] = ("calm", "negation", 0.0)
    t.arcs["both", "threat"] = ("calm", "threat", weights["threat"])
    return t


def grammar(weights: dict[str, float]) -> Transducer:
    """negation, reported speech, threats and insults as one transducer."""
    inner = (*TAGS, "denied", "quoted")
    return compose(compose(compose(negation(), reported_speech(), TAGS), threats(weights), TAGS), insults(weights), inner)
