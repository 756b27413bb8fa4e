"""Probabilistic automata inferred from strings: states of a prefix tree are merged where their statistics agree.

The prefix tree counts how often each string passes, ends and goes on by which character. From the root on,
the most frequent state that is not settled yet is held against each settled one: if the shares of ends and of every
character agree within Hoeffding's bound, for them and for the states that both reach, the two become one and
their subtrees are folded into each other; otherwise the state is settled too. A character that a state has never
seen has a share by its class (lower case, upper case, digit, each other character) and goes where its class goes.
"""

from __future__ import annotations

import heapq
import math

import numpy as np

#: Printable ASCII; automata are over these characters.
LOW, HIGH = 32, 127
WIDTH = HIGH - LOW
#: Classes: 0 lower case, 1 upper case, 2 digits, others of their own.
CLASS = np.array([0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3 + c - LOW for c in range(LOW, HIGH)])
SIZES = np.bincount(CLASS, minlength=3 + WIDTH)
#: Strings longer than this are walked one by one.
LONG = 1024


class State:
    __slots__ = ("n", "ends", "to")

    def __init__(self):
        self.n, self.ends, self.to = 0, 0, {}  # to: character -> [how often, state]


def prefix_tree(strings: list[str]) -> State:
    root = State()
    for s in strings:
        at = root
        at.n += 1
        for c in s:
            edge = at.to.setdefault(c, [0, None])
            edge[0] += 1
            edge[1] = edge[1] or State()
            at = edge[1]
            at.n += 1
        at.ends += 1
    return root


def _differ(a: int, n: int, b: int, m: int, bound: float) -> bool:
    return abs(a / n - b / m) > bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))


def compatible(a: State, b: State, bound: float) -> bool:
    """Whether two states, and those that both reach by the same characters, agree within the bound."""
    todo = [(a, b)]
    seen = set()
    while todo:
        a, b = todo.pop()
        if a is b or (id(a), id(b)) in seen:
            continue
        seen.add((id(a), id(b)))
        if bound * (1 / math.sqrt(a.n) + 1 / math.sqrt(b.n)) >= 1:
            continue  # too few strings for any share to differ
        if _differ(a.ends, a.n, b.ends, b.n, bound):
            return False
        for c in a.to.keys() | b.to.keys():
            x, y = a.to.get(c), b.to.get(c)
            if _differ(x[0] if x else 0, a.n, y[0] if y else 0, b.n, bound):
                return False
            if x and y:
                todo.append((x[1], y[1]))
    return True


def _fold(into: State, state: State) -> None:
    """Add the tree below ``state`` to ``into``."""
    todo = [(into, state)]
    while todo:
        a, b = todo.pop()
        a.n += b.n
        a.ends += b.ends
        for c, (k, below) in b.to.items():
            edge = a.to.get(c)
            if edge:
                edge[0] += k
                todo.append((edge[1], below))
            else:
                a.to[c] = [k, below]


def infer(strings: list[str], alpha: float = 0.05) -> list[State]:
    """The settled states of the automaton of some strings, the first one first."""
    bound = math.sqrt(0.5 * math.log(2 / alpha))
    root = prefix_tree(strings)
    settled, known, count = [root], {id(root)}, 0
    heap: list = []

    def reach(state: State) -> None:
        nonlocal count
        for c, edge in state.to.items():
            if id(edge[1]) not in known:
                count += 1
                heapq.heappush(heap, (-edge[1].n, count, state, c, edge[1]))

    reach(root)
    while heap:
        n, _, parent, c, state = heapq.heappop(heap)
        edge = parent.to[c]
        if edge[1] is not state or id(state) in known or -n != state.n:
            if edge[1] is state and id(state) not in known:  # it has grown since
                count += 1
                heapq.heappush(heap, (-state.n, count, parent, c, state))
            continue
        same = next((s for s in settled if compatible(s, state, bound)), None)
        if same is None:
            settled.append(state)
            known.add(id(state))
            reach(state)
        else:
            edge[1] = same
            _fold(same, state)
            for s in settled:
                reach(s)
    return settled


def _smooth(seen: np.ndarray, prior: float) -> np.ndarray:
    """Shares of characters by counts, the counts of their classes as ``prior`` more, and a little for all."""
    by_class = np.bincount(CLASS, seen, 3 + WIDTH)[CLASS] / SIZES[CLASS]
    go = seen.sum()
    share = (seen + prior * by_class / max(go, 1)) / (go + prior) if go else np.zeros(WIDTH)
    return 0.999 * share + 0.001 / WIDTH


def _usual(seen: np.ndarray, target: np.ndarray, none: int) -> np.ndarray:
    """By character the state that it, or else its class, goes to most often; ``none`` if neither is seen."""
    out = np.full(WIDTH, none)
    for group in (CLASS, np.arange(WIDTH)):
        for g in np.unique(group):
            own = group == g
            to, often = target[:, own].ravel(), seen[:, own].ravel()
            if often.sum() > 0:
                out[own] = np.bincount(to[to >= 0], often[to >= 0]).argmax()
    return out


class Automaton:
    """Tables of an inferred automaton: where each state goes by each character, and natural logs of the shares.

    A state's shares are smoothed by those of its classes, and by ``mix`` of the shares that characters have over all
    states. A character of a class that a state has never seen goes where it goes most often from the other states.
    """

    def __init__(self, strings: list[str], alpha: float = 0.05, prior: float = 2.0, mix: float = 0.1):
        states = infer(strings, alpha)
        place = {id(s): k for k, s in enumerate(states)}
        n = len(states)
        seen = np.zeros((n, WIDTH))
        target = np.full((n, WIDTH), -1)
        for k, s in enumerate(states):
            for c, (often, to) in s.to.items():
                seen[k, ord(c) - LOW], target[k, ord(c) - LOW] = often, place[id(to)]
        usual = _usual(seen, target, 0)
        every = _smooth(seen.sum(0), 1.0)
        self.to, self.log, self.end = np.empty((n, WIDTH), np.int32), np.empty((n, WIDTH)), np.empty(n)
        for k, s in enumerate(states):
            share = (1 - mix) * _smooth(seen[k], prior) + mix * every if s.to else every
            p_end = (s.ends + 0.01) / (s.n + 0.02)
            self.log[k] = np.log(share * (1 - p_end))
            self.end[k] = math.log(p_end)
            own = _usual(seen[k : k + 1], target[k : k + 1], -1)
            self.to[k] = np.where(target[k] >= 0, target[k], np.where(own >= 0, own, usual))

    def likelihood(self, chars: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Logs of the likelihoods of strings: ``chars`` holds their characters after each other."""
        order = np.argsort(-lengths, kind="stable")
        left, at = lengths[order], (np.cumsum(lengths) - lengths)[order]
        state, total = np.zeros(len(lengths), np.int64), np.zeros(len(lengths))
        few = int(np.searchsorted(-left, -LONG))
        for k in range(few):  # of few strings each is walked for itself
            total[k], state[k] = self._walk(chars[at[k] : at[k] + left[k]])
        step = 0
        while (alive := int(np.searchsorted(-left, -step))) > few:  # those longer than the steps taken
            c = chars[at[few:alive] + step].astype(np.int64) - LOW
            s = state[few:alive]
            total[few:alive] += self.log[s, c]
            state[few:alive] = self.to[s, c]
            step += 1
        total += self.end[state]
        out = np.empty(len(lengths))
        out[order] = total
        return out

    def _walk(self, chars: np.ndarray) -> tuple[float, int]:
        to, log = self.to.tolist(), self.log.tolist()
        state, total = 0, 0.0
        for c in (chars.astype(np.int64) - LOW).tolist():
            total += log[state][c]
            state = to[state][c]
        return total, state
