"""Which leaves of a tree a partly known row can reach.

Every branch of a rule is a conjunction of constraints, each a choice of alternatives (conjunctions of intervals). Going
down the tree, known features decide their tests, forced choices narrow the intervals of the unknown
features and close what contradicts them; choices still open at a leaf are searched. No boxes are listed.
"""

from __future__ import annotations

from rulespire.functions.rules import Rule
from rulespire.plans.model import TreeModel

INF = float("inf")


def constraints(rule: Rule, taken: bool) -> list[list[list[tuple[int, float, float]]]]:
    """The branch as constraints: one per clause where the branch is a conjunction of clauses."""
    def said(lit, yes=True):
        return (lit.feature, *(lit if yes else lit.negate()).interval())

    if rule.combine in ("or", "cnf") and taken:
        return [[[said(l)] for l in clause] for clause in rule.clauses]
    if rule.combine == "or":
        return [[[said(l, False)]] for l in rule.literals]
    if rule.combine == "and":
        return [[[said(l)]] for l in rule.literals] if taken else [[[said(l, False)] for l in rule.literals]]
    if rule.combine == "cnf":
        return [[[said(l, False) for l in clause] for clause in rule.clauses]]
    return [[[said(l) for l in alternative] for alternative in rule.branch(taken)]]


def _settle(x, known, box, pending):
    """Narrow ``box`` by the choices that are forced; (box, open choices), or None if they contradict each other."""
    changed = True
    while changed:
        changed, still = False, []
        for choice in pending:
            fits, implied = [], False
            for alternative in choice:
                rest, fit = [], True
                for f, lo, hi in alternative:
                    if f in known:
                        fit = lo <= x[f] and (x[f] < hi or hi == INF)
                    else:
                        a, b = box.get(f, (-INF, INF))
                        fit = max(a, lo) < min(b, hi)
                        if lo > a or hi < b:
                            rest.append((f, lo, hi))
                    if not fit:
                        break
                if fit and not rest:
                    implied = True
                    break
                if fit:
                    fits.append(rest)
            if implied:
                continue
            if not fits:
                return None
            if len(fits) == 1:
                if not _narrow(box, fits[0]):
                    return None
                changed = True
            else:
                still.append(fits)
        pending = still
    return box, pending


def _narrow(box, tests) -> bool:
    for f, lo, hi in tests:
        a, b = box.get(f, (-INF, INF))
        box[f] = (max(a, lo), min(b, hi))
        if box[f][0] >= box[f][1]:
            return False
    return True


def _solvable(x, known, box, pending) -> bool:
    if not pending:
        return True
    choice = min(pending, key=len)
    rest = [c for c in pending if c is not choice]
    for alternative in choice:
        own = dict(box)
        if _narrow(own, alternative):
            found = _settle(x, known, own, rest)
            if found and _solvable(x, known, *found):
                return True
    return False


class Reach:
    """One tree, ready for questions about rows (lists of values by feature index)."""

    def __init__(self, model: TreeModel, tree: int = 0):
        if any(l.feature2 is not None for n in model.splits(tree) for l in n.rule.literals):
            raise NotImplementedError("column-against-column tests have no intervals")
        self.classes = {n.node_id: int(n.proba >= 0.5) for n in model.leaves(tree)}
        self.branches = {n.node_id: (constraints(n.rule, True), constraints(n.rule, False)) for n in model.splits(tree)}

    def leaves(self, x, known, cls: int | None = None):
        """Leaves some row can reach that agrees with x on ``known``; with ``cls``, only those of that class."""
        todo = [(1, {}, [])]
        while todo:
            node, box, pending = todo.pop()
            if node in self.classes:
                if (cls is None or self.classes[node] == cls) and _solvable(x, known, box, pending):
                    yield node
                continue
            for side in (1, 0):
                found = _settle(x, known, dict(box), pending + self.branches[node][side])
                if found:
                    todo.append((2 * node + side, *found))

    def predict(self, x) -> int:
        return self.classes[next(self.leaves(x, range(len(x))))]

    def sufficient(self, x, known, cls: int) -> bool:
        """Whether every row that agrees with x on ``known`` is in the class."""
        return next(self.leaves(x, known, 1 - cls), None) is None

    def minimal(self, x, cls: int, used: list[int]) -> list[int]:
        """Features left when they are dropped in order while the rest stays sufficient."""
        left = set(used)
        for f in used:
            left.discard(f)
            if not self.sufficient(x, left, cls):
                left.add(f)
        return sorted(left)
