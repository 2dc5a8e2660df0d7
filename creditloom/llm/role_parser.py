"""Generalised LR parsing of role sequences with weighted repairs.

The grammar gives an LR automaton. All parses are followed at once: their
stacks share what lies below their tops, and stacks that become equal are
merged, keeping the least (cost, audit). A row may be kept, given another role
or deleted, and a turn may be inserted anywhere. The audit is the string of
these edits' initials.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

Rule = tuple[str, tuple[str, ...]]

# A conversation is empty, or an optional system turn and pairs of user and assistant.
ROLE_GRAMMAR: tuple[Rule, ...] = (
    ("dialogue", ()), ("dialogue", ("pairs",)), ("dialogue", ("s", "pairs")),
    ("pairs", ("pairs", "pair")), ("pairs", ("pair",)), ("pair", ("u", "a")),
)
ROLES = {"u": "user", "a": "assistant"}
# Edits after which audits are replaced by their ranks, so that comparing stays cheap in long conversations.
RANK_EVERY = 64
MOST_STACKS = 200


@dataclass(frozen=True)
class Costs:
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3  # of a truncated row that is not deleted


class Automaton:
    """LR automaton of a grammar. A stack is a number; ``state`` and ``below`` give its top and the stack under it.

    A state without a choice is reduced at once, so a left-recursive grammar
    has few stacks, which are found as they are needed.
    """

    def __init__(self, grammar: Iterable[Rule] = ROLE_GRAMMAR) -> None:
        rules = list(grammar)
        self.rules: list[Rule] = [("", (rules[0][0],)), *rules]
        self.names = {left for left, _ in rules}
        self.terminals = {s for _, right in rules for s in right if s not in self.names}
        self.follow = self._follow()
        self.sets: list[frozenset] = []
        self.set_of: dict[frozenset, int] = {}
        self.state: list[int] = []
        self.below: list[int | None] = []
        self.node_of: dict[tuple[int, int | None], int] = {}
        self.moves: dict[tuple[int, str], tuple[int, ...]] = {}
        self.start = self._node(self._state(self._closed({(0, 0)})), None)
        # Found in the same order everywhere, so that a stack has the same number in all tasks.
        self.stacks = self._stacks()

    def _follow(self) -> dict[str, set[str]]:
        empty = {left for left, right in self.rules if not right}
        while more := {left for left, right in self.rules if left not in empty and all(s in empty for s in right)}:
            empty |= more
        first: dict[str, set[str]] = {s: {s} for s in self.terminals} | {n: set() for n in [*self.names, ""]}
        follow: dict[str, set[str]] = {n: set() for n in [*self.names, ""]}
        follow[""].add("$")
        changed = True
        while changed:
            before = sum(map(len, [*first.values(), *follow.values()]))
            for left, right in self.rules:
                for symbol in right:
                    first[left] |= first[symbol]
                    if symbol not in empty:
                        break
                after = set(follow[left])
                for symbol in reversed(right):
                    if symbol in self.names:
                        follow[symbol] |= after
                    after = first[symbol] | (after if symbol in empty else set())
            changed = before != sum(map(len, [*first.values(), *follow.values()]))
        return follow

    def _closed(self, items: set[tuple[int, int]]) -> frozenset:
        work = list(items)
        for rule, dot in work:
            right = self.rules[rule][1]
            if dot < len(right):
                new = {(k, 0) for k, (left, _) in enumerate(self.rules) if left == right[dot]} - items
                items = items | new
                work += new
        return frozenset(items)

    def _state(self, items: frozenset) -> int:
        if items not in self.set_of:
            self.set_of[items] = len(self.sets)
            self.sets.append(items)
        return self.set_of[items]

    def _node(self, state: int, below: int | None) -> int:
        if (state, below) not in self.node_of:
            self.node_of[state, below] = len(self.state)
            self.state.append(state)
            self.below.append(below)
        return self.node_of[state, below]

    def _push(self, node: int, symbol: str) -> int | None:
        items = {(r, d + 1) for r, d in self.sets[self.state[node]] if self.rules[r][1][d:d + 1] == (symbol,)}
        return self._node(self._state(self._closed(items)), node) if items else None

    def _reduced(self, node: int, rule: int) -> int:
        left, right = self.rules[rule]
        for _ in right:
            node = self.below[node]
        return self._push(node, left)

    def _settled(self, node: int) -> int:
        while True:
            items = self.sets[self.state[node]]
            (rule, dot), *others = items
            if others or rule == 0 or dot < len(self.rules[rule][1]):
                return node
            node = self._reduced(node, rule)

    def _under(self, node: int, lookahead: str) -> list[int]:
        """``node`` and all stacks that reductions under ``lookahead`` make of it."""
        found = [node]
        for at in found:
            for rule, dot in self.sets[self.state[at]]:
                left, right = self.rules[rule]
                if rule and dot == len(right) and lookahead in self.follow[left]:
                    new = self._reduced(at, rule)
                    if new not in found:
                        found.append(new)
        return found

    def shift(self, node: int, terminal: str) -> tuple[int, ...]:
        """Stacks after ``terminal``."""
        if (node, terminal) not in self.moves:
            pushed = [self._push(at, terminal) for at in self._under(node, terminal)]
            self.moves[node, terminal] = tuple(dict.fromkeys(self._settled(p) for p in pushed if p is not None))
        return self.moves[node, terminal]

    def accepts(self, node: int) -> bool:
        return any((0, 1) in self.sets[self.state[at]] for at in self._under(node, "$"))

    def _stacks(self) -> list[int]:
        """All stacks between turns; a grammar that nests has no end of them."""
        found = [self.start]
        for node in found:
            for terminal in sorted(self.terminals):
                found += [n for n in self.shift(node, terminal) if n not in found]
            if len(found) > MOST_STACKS:
                raise ValueError("the grammar nests: its stacks have no bound")
        return sorted(found)


class Repair:
    """All parses of a growing conversation, from one stack on."""

    def __init__(self, automaton: Automaton, costs: Costs = Costs(), start: int | None = None) -> None:
        self.automaton, self.costs = automaton, costs
        # Stack top -> (cost, rank of the audit up to the last ranking, edits since).
        self.tops: dict[int, tuple[int, int, str]] = {automaton.start if start is None else start: (0, 0, "")}
        self.ranked: list[list[tuple[int, str]]] = []
        self.rows = 0

    def _insert(self) -> None:
        """Stacks that insertions reach. Equal stacks of equal cost never have audits that begin with each other."""
        tops, shift, cost = self.tops, self.automaton.shift, self.costs.insert
        work = list(tops)
        while work:
            node = work.pop()
            spent, rank, edits = tops[node]
            new = (spent + cost, rank, edits + "I")
            for role in ROLES:
                for after in shift(node, role):
                    if after not in tops or new < tops[after]:
                        tops[after] = new
                        work.append(after)

    def row(self, initial: str, must_delete: bool, truncated: bool, copies: int = 1) -> None:
        """Take one row; further adjacent ``copies`` are deleted, and stand for no edits here."""
        self._insert()
        costs, shift = self.costs, self.automaton.shift
        more = costs.delete * (copies - 1)
        undeleted = more + (costs.truncated if truncated else 0)
        known = initial in self.automaton.terminals
        tops: dict[int, tuple[int, int, str]] = {}

        def reach(node: int, new: tuple[int, int, str]) -> None:
            if node not in tops or new < tops[node]:
                tops[node] = new

        for node, (spent, rank, edits) in self.tops.items():
            reach(node, (spent + more + costs.delete, rank, edits + "D"))
            if must_delete:
                continue
            if known:
                for after in shift(node, initial):
                    reach(after, (spent + undeleted, rank, edits + "K"))
            for role in ROLES:
                for after in shift(node, role):
                    reach(after, (spent + undeleted + costs.rerole, rank, edits + "R"))
        self.tops = tops
        self.rows += 1
        if self.rows % RANK_EVERY == 0:
            self._rank()

    def _rank(self) -> None:
        audits = sorted({(rank, edits) for _, rank, edits in self.tops.values()})
        place = {audit: k for k, audit in enumerate(audits)}
        self.tops = {n: (spent, place[rank, edits], "") for n, (spent, rank, edits) in self.tops.items()}
        self.ranked.append(audits)

    def audit(self, rank: int, edits: str) -> str:
        parts = [edits]
        for audits in reversed(self.ranked):
            rank, part = audits[rank]
            parts.append(part)
        return "".join(reversed(parts))

    def best(self) -> tuple[int, str]:
        """Cost and audit of the cheapest whole parse; equal costs go by audit."""
        self._insert()
        spent, rank, edits = min(w for n, w in self.tops.items() if self.automaton.accepts(n))
        return spent, self.audit(rank, edits)

    def exits(self) -> dict[int, tuple[int, int, str]]:
        """Stack -> (cost, order of its audit among all, audit) before any further insertion."""
        self._rank()
        return {n: (spent, rank, self.audit(rank, "")) for n, (spent, rank, _) in self.tops.items()}


def replay(automaton: Automaton, node: int, edits: str, rows) -> Iterable[tuple[str, str | None, str]]:
    """``(edit, role, text)`` of each edit of ``edits``; ``rows`` gives ``(role, text)``; deleted rows have role None.

    Gives the stack after the last edit as its value when done.
    """
    rows = iter(rows)
    for edit in edits:
        role, text = (None, "") if edit == "I" else next(rows)
        if edit == "D":
            yield edit, None, text
            continue
        if edit == "K":
            terminal = role[:1]
        else:
            (terminal,) = [t for t in ROLES if automaton.shift(node, t)]
            role = ROLES[terminal]
        node = automaton.shift(node, terminal)[0]
        yield edit, role, text
    return node
