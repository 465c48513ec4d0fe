"""Shortest paths by auction over a layered lattice of four states with small integer costs.

Node (i, q) is state q after i rows. Its arcs are tuples (cost, forward, state, letter): to (i + 1, state) where forward
is 1, to (i, state) where it is 0. After the last row an exit of given cost ends the path.

Nodes have prices that start at 0, with which no arc costs less than the fall of price along it. A path is extended from
its origin along an arc that costs exactly the fall; where there is none, the price of its last node rises to the least
it can and the path is contracted by that node. When the path ends in a node whose price has converged, so have the
prices of all its nodes. Origins are taken from the end of the lattice on, every ``STRIDE`` rows, and keep the prices
found before. The rows before them start at the least price of the origins' row, which leaves every arc at or above its
fall. So paths are extended and prices raised over few rows only, and the work grows with the rows.

In the converged prices an arc is tight when it costs exactly the fall. Every cheapest path consists of tight arcs and
every path of tight arcs from an origin to an exit is cheapest, so the path with the least letters is traced through them
greedily.
"""

from __future__ import annotations

from collections.abc import Sequence

STATES, STRIDE = 4, 8
Arc = tuple[int, int, int, object]
Path = list


class Lattice:
    """``arcs[i][q]`` are the arcs out of (i, q) by ascending letters; ``exits[q]`` is the cost of ending in q, or None."""

    def __init__(self, arcs: Sequence[Sequence[Sequence[Arc]]], exits: Sequence[int | None], stride: int = STRIDE):
        self.arcs, self.exits, self.n = arcs, exits, len(arcs) - 1
        self.price = [0] * (STATES * len(arcs))
        self.solved = bytearray(len(self.price))
        self.alive = self._alive()
        after = self.n
        for i in sorted({*range(self.n, -1, -stride), 0}, reverse=True):
            if i < after:
                least = min(self.price[STATES * after + q] for q in range(STATES) if self.alive[STATES * after + q])
                self.price[STATES * i:STATES * after] = [least] * (STATES * (after - i))
                after = i
            for q in range(STATES):
                if self.alive[STATES * i + q]:
                    self._auction(i, q)

    def _alive(self) -> bytearray:
        """Which nodes reach an exit: without it, the prices of the others would rise for ever."""
        alive = bytearray(len(self.price))
        for i in range(self.n, -1, -1):
            at = STATES * i
            for q in range(STATES):
                if i == self.n and self.exits[q] is not None:
                    alive[at + q] = 1
                elif any(f and alive[at + STATES + s] for _, f, s, _ in self.arcs[i][q]):
                    alive[at + q] = 1
            for _ in range(STATES - 1):  # arcs within the row
                for q in range(STATES):
                    if not alive[at + q] and any(not f and alive[at + s] for _, f, s, _ in self.arcs[i][q]):
                        alive[at + q] = 1
        return alive

    def _auction(self, i: int, q: int) -> None:
        price, solved, alive, arcs = self.price, self.solved, self.alive, self.arcs
        path = Path([STATES * i + q])
        while True:
            node = path[-1]
            if solved[node]:
                break
            row, state = divmod(node, STATES)
            best = onward = None
            if row == self.n and self.exits[state] is not None:
                best, onward = self.exits[state], -1
            for cost, forward, to, _ in arcs[row][state]:
                target = STATES * (row + forward) + to
                if alive[target] and (best is None or cost + price[target] < best):
                    best, onward = cost + price[target], target
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            elif onward < 0:
                break
            else:
                path.append(onward)
        for node in path:
            solved[node] = 1

    def cost(self, i: int, q: int) -> int | None:
        """The converged price of an origin: what its cheapest path costs."""
        return self.price[STATES * i + q] if self.alive[STATES * i + q] else None

    def trace(self, q: int) -> tuple[list, int] | None:
        """(letters, state at the exit) of the cheapest path from (0, q) whose letters come first."""
        if not self.alive[q]:
            return None
        price, alive, dead = self.price, self.alive, set()
        letters: list = []
        stack = [[q, 0]]
        while True:
            node, at = stack[-1]
            row, state = divmod(node, STATES)
            if row == self.n and self.exits[state] is not None and price[node] == self.exits[state]:
                return letters, state
            arcs = self.arcs[row][state]
            while at < len(arcs):
                cost, forward, to, letter = arcs[at]
                target, at = STATES * (row + forward) + to, at + 1
                if alive[target] and target not in dead and price[node] == cost + price[target]:
                    stack[-1][1] = at
                    stack.append([target, 0])
                    letters.append(letter)
                    break
            else:  # tight, but without a tight way on
                dead.add(node)
                stack.pop()
                letters.pop()
