"""Evolutionary search over formula trees with a niche archive."""

from __future__ import annotations

import hashlib
import json
import random
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from tessera.plans.formula import (
    CROSS,
    ELEMENT,
    FUNCTIONS,
    Node,
    canonical,
    complexity,
    data_family,
    edit_distance,
    largest_shared,
    parse,
    render,
    size,
    subtree_sizes,
    tree_hash,
    walk,
)

WINDOWS = (3, 5, 10, 21)
PRICE = ("$open", "$high", "$low", "$close", "$volume", "$return")
CAPACITY = 8
#: Bounds of the niches.  The cut is the median turnover of the published set; a run gives its own by ``turnover_cut``.
FAST_HALF_LIFE, MEDIUM_HALF_LIFE, TURNOVER_CUT = 5.0, 21.0, 0.3123
NICHES = [(s, f, t) for s in ("fast", "medium", "slow") for f in ("price_volume", "fundamental", "mixed") for t in ("low", "high")]


def round_rng(seed: int, *parts: object) -> random.Random:
    """A generator that depends on the seed and the parts only."""
    return random.Random(int.from_bytes(hashlib.sha256(json.dumps([seed, *map(str, parts)]).encode()).digest()[:8], "big"))


def sample(rng: random.Random, deepest: int = 4) -> Node:
    """A random formula from the grammar."""
    if deepest <= 1 or rng.random() < 0.2:
        return Node(rng.choice(PRICE))
    kind = rng.random()
    if kind < 0.35:
        name = rng.choice([n for n, (s, k) in FUNCTIONS.items() if s == "PW" and n != "DELAY"])
        return Node(name, (sample(rng, deepest - 1), Node(str(rng.choice(WINDOWS)))))
    if kind < 0.45:
        name = rng.choice(("TS_CORR", "TS_COV"))
        return Node(name, (sample(rng, deepest - 1), sample(rng, deepest - 1), Node(str(rng.choice(WINDOWS)))))
    if kind < 0.65:
        return Node(rng.choice([n for n, (_, k) in FUNCTIONS.items() if k == CROSS]), (sample(rng, deepest - 1),))
    if kind < 0.75:
        return Node(rng.choice(("ABS", "SIGN")), (sample(rng, deepest - 1),))
    return Node(rng.choice("+-*/"), (sample(rng, deepest - 1), sample(rng, deepest - 1)))


def places(node: Node, path: tuple[int, ...] = ()) -> list[tuple[tuple[int, ...], Node, str]]:
    """(path, subtree, slot) of every node; slots are P, W, C or S as in the vocabulary."""
    out = [(path, node, "P")]
    slots = FUNCTIONS[node.label][0] if node.label in FUNCTIONS else "P" * len(node.children)
    slots = "P" * len(node.children) if slots == "P+" else slots
    for i, (c, s) in enumerate(zip(node.children, slots, strict=True)):
        inner = places(c, (*path, i))
        out += [(inner[0][0], c, s), *inner[1:]]
    return out


def replace(node: Node, path: tuple[int, ...], new: Node) -> Node:
    if not path:
        return new
    i, *rest = path
    children = list(node.children)
    children[i] = replace(children[i], tuple(rest), new)
    return Node(node.label, tuple(children))


def _panels(node: Node) -> list[tuple[tuple[int, ...], Node]]:
    return [(p, n) for p, n, s in places(node) if s == "P" and n.number is None and not n.is_condition]


def mutate(node: Node, rng: random.Random) -> Node:
    """One small change: a window, a field, a function, a subtree, a wrap or an unwrap."""
    kind = rng.choice(("window", "field", "function", "subtree", "wrap", "unwrap"))
    spots = places(node)
    if kind == "window" and (w := [p for p, _, s in spots if s == "W"]):
        return replace(node, rng.choice(w), Node(str(rng.choice(WINDOWS))))
    if kind == "field" and (f := [(p, n) for p, n, _ in spots if n.label.startswith("$")]):
        path, old = rng.choice(f)
        return replace(node, path, Node(rng.choice([x for x in PRICE if x != old.label])))
    if kind == "function" and (f := [(p, n) for p, n, _ in spots if n.label in FUNCTIONS]):
        path, old = rng.choice(f)
        same = [n for n, v in FUNCTIONS.items() if v == FUNCTIONS[old.label] and n != old.label]
        if same:
            return replace(node, path, Node(rng.choice(same), old.children))
    path, old = rng.choice(_panels(node))
    if kind == "wrap":
        return replace(node, path, Node(rng.choice(("RANK", "ZSCORE", "ABS")), (old,)))
    if kind == "unwrap" and len(old.children) and (c := [c for c in old.children if c.number is None and not c.is_condition]):
        return replace(node, path, rng.choice(c))
    return replace(node, path, sample(rng, 2))


def crossover(a: Node, b: Node, rng: random.Random) -> Node:
    """``a`` with one of its panels replaced by one of ``b``."""
    return replace(a, rng.choice(_panels(a))[0], rng.choice(_panels(b))[1])


def simplify(node: Node, rng: random.Random) -> Node:
    """A panel of the formula in place of the node above it."""
    inner = [(p, n) for p, n in _panels(node) if n.children]
    path, old = rng.choice(inner) if inner else ((), node)
    kids = [c for c in old.children if c.number is None and not c.is_condition]
    return replace(node, path, rng.choice(kids)) if kids else node


@dataclass
class Candidate:
    """A scored formula."""

    expression: str
    fitness: float
    metrics: dict[str, float] = field(default_factory=dict)
    order: int = 0

    @property
    def node(self) -> Node:
        return parse(self.expression)

    @property
    def niche(self) -> tuple[str, str, str]:
        """Speed, data family and turnover, as of ``NICHES``."""
        life = self.metrics.get("half_life")
        speed = "slow" if life is None or life > MEDIUM_HALF_LIFE else "medium" if life >= FAST_HALF_LIFE else "fast"
        return speed, data_family(self.node), "low" if self.metrics.get("turnover", 0) <= self.metrics.get("turnover_cut", TURNOVER_CUT) else "high"


#: A mutation further from its parent than this is another formula.
MUTATION_EDITS = 3


def fitness(t: float, stability: float, node: Node, turnover: float, size_weight: float = 0.02, turnover_weight: float = 0.5) -> float:
    """|t| x stability, less penalties for size and turnover."""
    return abs(t) * stability - size_weight * size(node) - turnover_weight * turnover


@dataclass
class Archive:
    """The best formulas of each niche; a full niche gives up its weakest."""

    capacity: int = CAPACITY
    niches: dict[tuple, list[Candidate]] = field(default_factory=dict)
    seen: set[str] = field(default_factory=set)
    count: int = 0

    def add(self, c: Candidate) -> bool:
        key = tree_hash(c.node)
        if key in self.seen or c.fitness != c.fitness or abs(c.fitness) == float("inf"):
            return False
        self.seen.add(key)
        c.order, self.count = self.count, self.count + 1
        held = self.niches.setdefault(c.niche, [])
        held.append(c)
        held.sort(key=lambda x: (-x.fitness, x.order))
        return c is not held.pop() if len(held) > self.capacity else True

    def all(self) -> list[Candidate]:
        return sorted((c for v in self.niches.values() for c in v), key=lambda c: (-c.fitness, c.order))

    def summary(self, domain: list[tuple] | None = None) -> dict[tuple, int]:
        """Members of each niche, empty ones of the domain included."""
        return dict.fromkeys(domain or [], 0) | {k: len(v) for k, v in self.niches.items()}

    def dump(self) -> list[str]:
        return [json.dumps({"expression": c.expression, "fitness": c.fitness, "metrics": c.metrics}, sort_keys=True) for c in self.all()]

    @classmethod
    def load(cls, lines: list[str]) -> Archive:
        out = cls()
        for line in lines:
            out.add(Candidate(**json.loads(line)))
        return out

    def banned(self, most: int = 12, least: int = 3) -> list[str]:
        """The subtrees that most archived formulas share."""
        counts = Counter(k for c in self.all() for k, n in subtree_sizes(c.node).items() if n >= least)
        return [k for k, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most] if n > 1]


def selection_weight(c: Candidate, archive: Archive, sparse: int = 3, stale: bool = False) -> float:
    """Fitness-neutral weight: members of sparse niches count twice, stale ones half."""
    few = len(archive.niches.get(c.niche, ())) < sparse
    return (2.0 if few else 1.0) * (0.5 if stale else 1.0)


def tournament(pool: list[Candidate], archive: Archive, rng: random.Random, rounds: int = 3) -> Candidate:
    """The fittest of a few weighted draws."""
    weights = [selection_weight(c, archive) for c in pool]
    return max(rng.choices(pool, weights, k=min(rounds, len(pool))), key=lambda c: (c.fitness, -c.order))


@dataclass
class Replayed:
    """A score function that remembers, so that a run can be taken up again from its log.

    ``log`` holds JSON lines (expression, fitness, metrics; a fitness of null is a
    formula that could not be scored, which is kept too).  Proposals depend on the
    seed and on what was admitted only: a run that is started again with the log of
    a broken one proposes the same, finds the scores there, and goes on where it
    ended; only new formulas are scored, and ``write`` is given their lines.
    """

    score: Callable[[list[str]], dict[str, tuple[float, dict[str, float]]]]
    log: list[str] = field(default_factory=list)
    write: Callable[[list[str]], None] | None = None
    evaluated: int = 0

    def __post_init__(self) -> None:
        self.known = {r["expression"]: r for r in map(json.loads, self.log)}

    def __call__(self, texts: list[str]) -> dict[str, tuple[float, dict[str, float]]]:
        if fresh := [t for t in texts if t not in self.known]:
            made = self.score(fresh)
            self.evaluated += len(fresh)
            rows = [{"expression": t, "fitness": made[t][0] if t in made else None, "metrics": made[t][1] if t in made else {}} for t in fresh]
            lines = [json.dumps(r, sort_keys=True) for r in rows]
            if self.write:
                self.write(lines)  # before they count: what is lost after this is known to the next run
            self.log = [*self.log, *lines]
            self.known |= {r["expression"]: r for r in rows}
        return {t: (self.known[t]["fitness"], self.known[t]["metrics"]) for t in texts if self.known[t]["fitness"] is not None}


def fuses(child: Node, parents: list[Node], least: int = 3) -> bool:
    """Whether a crossing shares a subtree of ``least`` nodes or more with each parent."""
    return all(largest_shared(child, p) >= least for p in parents)


def text_gates(node: Node, archive: Archive, published: list[Node], largest: int = 60, shared: int = 5) -> str | None:
    """The first gate that refuses a formula by its text, cheapest first."""
    c = complexity(node)
    if size(node) > largest or c["depth"] > 8:
        return "complexity"
    banned = set(archive.banned())
    if tree_hash(node) in archive.seen:
        return "duplicate"
    if any(largest_shared(node, p) >= shared for p in published):
        return "published"
    if any(k in banned for k in subtree_sizes(node)):
        return "archive"
    return None


@dataclass
class Search:
    """Islands that evolve formulas round by round; the same seed gives the same archive."""

    score: Callable[[list[str]], dict[str, tuple[float, dict[str, float]]]]
    seed: int = 0
    islands: int = 2
    population: int = 6
    published: list[Node] = field(default_factory=list)
    archive: Archive = field(default_factory=Archive)
    rejections: Counter = field(default_factory=Counter)
    pools: list[list[Candidate]] = field(default_factory=list)
    rounds: list[dict] = field(default_factory=list)

    def propose(self, island: int, number: int) -> list[Node]:
        rng = round_rng(self.seed, number, island)
        pool = self.pools[island] if self.pools else []
        out = []
        for _ in range(self.population):
            if not pool or rng.random() < 0.25:
                out.append(sample(rng))
                continue
            a = tournament(pool, self.archive, rng)
            move = rng.choice(("mutate", "crossover", "simplify"))
            if move == "crossover":
                out.append(crossover(a.node, tournament(pool, self.archive, rng).node, rng))
            else:
                child = mutate(a.node, rng) if move == "mutate" else simplify(a.node, rng)
                if move == "mutate" and edit_distance(a.node, child) > MUTATION_EDITS:
                    self.rejections["mutation too far"] += 1
                    continue
                out.append(child)
        return out

    def step(self) -> dict:
        """One round on all islands; all formulas that pass the text gates are scored in one plan."""
        number = len(self.rounds)
        self.pools = self.pools or [[] for _ in range(self.islands)]
        proposals: list[tuple[int, str]] = []
        asked: set[str] = set()
        for island in range(self.islands):
            for node in self.propose(island, number):
                text = render(canonical(node))
                try:
                    node = parse(text)
                except ValueError:
                    self.rejections["gate"] += 1
                    continue
                if reason := text_gates(node, self.archive, self.published):
                    self.rejections[reason] += 1
                elif text not in asked:
                    asked.add(text)
                    proposals.append((island, text))
        scored = self.score([t for _, t in proposals]) if proposals else {}
        admitted = 0
        for island, text in proposals:
            if text not in scored:
                self.rejections["evaluation"] += 1
                continue
            value, metrics = scored[text]
            c = Candidate(text, value, metrics)
            if self.archive.add(c):
                admitted += 1
                pool = self.pools[island]
                pool.append(c)
                pool.sort(key=lambda x: (-x.fitness, x.order))
                del pool[self.population * 2 :]
        if number % 3 == 2:
            self.migrate()
        best = self.archive.all()[0].fitness if self.archive.all() else None
        self.rounds.append({"round": number, "proposed": len(proposals), "admitted": admitted, "best": best, "archive": len(self.archive.all())})
        return self.rounds[-1]

    def migrate(self) -> None:
        """The best of each island goes to the next; the weakest island starts from the archive."""
        tops = [p[0] for p in self.pools if p]
        if not tops:
            return
        for i, pool in enumerate(self.pools):
            c = tops[(i - 1) % len(tops)]
            if c not in pool:
                pool.append(c)
        weakest = min(range(self.islands), key=lambda i: self.pools[i][0].fitness if self.pools[i] else float("-inf"))
        self.pools[weakest] = self.archive.all()[: self.population]

    def run(self, rounds: int, patience: int = 2, enough: int = 20) -> Archive:
        """Until the rounds end, or the archive is large enough and the best stands still."""
        for _ in range(rounds):
            self.step()
            last = [r["best"] for r in self.rounds[-patience - 1 :]]
            if len(last) > patience and len(set(last)) == 1 and len(self.archive.all()) >= enough:
                break
        return self.archive


__all__ = ["ELEMENT", "Archive", "Candidate", "Search", "walk"]
