"""Auction algorithm for shortest paths on the lattice of edits of one stretch of a conversation.

A node is (row, state): what has been written so far ends in nothing, a system turn, a user turn or an
assistant turn. Arcs are edits with integer costs; leaving the last row costs what the rest of the
conversation costs from there. Every node has a price that never exceeds the cost of an arc plus the
price behind it. A path grows from the origin: its end node takes the least of those sums as its price
if that is more (and the path draws back by one arc), else the path goes on to the node that gives it.
When it arrives, the origin's price is the cost of the shortest path, and shortest paths run over tight
arcs only (cost equals the difference of the prices); the tight arcs that lead to the end are then
traced by the least letter.
"""

from __future__ import annotations

# States and edits; letters in ASCII order.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 1, 2, 5, 5
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
#: Faults of a row.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: No way to the end.
NEVER = 1 << 60
#: What may follow a conversation's last row: an empty or assistant-ended text is whole.
DONE = (0, NEVER, NEVER, 0)


def following(state: int) -> int:
    """The only state that a chosen role may lead to."""
    return ASSISTANT if state == USER else USER


def _row_arcs(initial: int, fault: int) -> list[list[tuple[str, int, int]]]:
    """Per state, (letter, cost, next state) of the edits of one row; insertion stays at the row."""
    arcs = []
    for state in range(STATES):
        out = [("D", DELETE_COST, state)]
        if fault not in (BLANK, DUPLICATE):
            more = TRUNCATED_COST if fault == TRUNCATED else 0
            if initial == following(state) or (initial == SYSTEM and state == EMPTY):
                out.append(("K", KEEP_COST + more, initial))
            out.append(("R", REROLE_COST + more, following(state)))
        arcs.append(out)
    return arcs


_ROW_ARCS = {(i, f): _row_arcs(i, f) for i in range(STATES) for f in range(4)}


def _leading(arcs: list[list[tuple[str, int, int]]]) -> list[bool]:
    """Which nodes have a way to the end. Arcs stay in their row or go to the next, so rows are looked at from the last one."""
    ok = [False] * len(arcs) + [True]
    for first in range(len(arcs) - STATES, -1, -STATES):
        for _ in range(STATES):  # insertions lead from state to state
            for node in range(first, first + STATES):
                ok[node] = ok[node] or any(ok[to] for _, _, to in arcs[node])
    return ok


class Lattice:
    """The lattice of rows (initial, fault), with ``beyond`` as the price of each state after the last row.

    ``insert_last`` allows insertions after the last row too; a stretch that another one follows leaves
    them to that one.
    """

    def __init__(self, rows: list[tuple[int, int]], beyond: tuple[int, ...] | list[int], insert_last: bool):
        n = len(rows)
        self.end = STATES * (n + 1)
        arcs: list[list[tuple[str, int, int]]] = []
        for i in range(n + 1):
            for state in range(STATES):
                out = [("I", INSERT_COST, STATES * i + following(state))] if i < n or insert_last else []
                if i < n:
                    out += [(letter, cost, STATES * (i + 1) + to) for letter, cost, to in _ROW_ARCS[rows[i]][state]]
                elif beyond[state] < NEVER:
                    out.append(("", beyond[state], self.end))
                arcs.append(out)
        self.open = _leading(arcs)
        self.arcs = [[arc for arc in out if self.open[arc[2]]] for out in arcs]
        # a price no path can fall below: each row costs at least its cheapest edit
        least = min((b for b in beyond if b < NEVER), default=0)
        self.prices = [least] * (self.end + 1)
        self.prices[self.end] = 0
        for i in range(n - 1, -1, -1):
            least += min(cost for out in _ROW_ARCS[rows[i]] for _, cost, _ in out)
            self.prices[STATES * i : STATES * (i + 1)] = [least] * STATES

    def cost(self, origin: int) -> int:
        """Cost of the shortest path from a state before the first row; the prices stay for the next call."""
        if not self.open[origin]:
            return NEVER
        prices, arcs, end, path = self.prices, self.arcs, self.end, [origin]
        while True:
            node = path[-1]
            if node == end:
                return prices[origin]
            best, way = NEVER, -1
            for _, cost, to in arcs[node]:
                if cost + prices[to] < best:
                    best, way = cost + prices[to], to
            if prices[node] < best:
                prices[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(way)

    def trace(self, origin: int) -> tuple[str, int]:
        """The least letters of a shortest path from an origin whose cost is known, and the state after the last row."""
        prices = self.prices
        tight = [sorted(arc for arc in out if prices[node] == arc[1] + prices[arc[2]]) for node, out in enumerate(self.arcs)]
        leads = _leading(tight)
        node, letters = origin, []
        while True:
            letter, to = next((letter, to) for letter, _, to in tight[node] if leads[to])
            if to == self.end:
                return "".join(letters), node % STATES
            letters.append(letter)
            node = to


def transfer(rows: list[tuple[int, int]], last: bool) -> list[int]:
    """Cost from each state before the rows to each state after them (16 numbers, by origin first).

    Of the last stretch of a conversation only the first column counts: the cost to a whole end.
    """
    ends = [DONE] if last else [tuple(0 if s == x else NEVER for s in range(STATES)) for x in range(STATES)]
    out = [NEVER] * (STATES * STATES)
    for x, beyond in enumerate(ends):
        lattice = Lattice(rows, beyond, last)
        for origin in range(STATES):
            out[STATES * origin + x] = lattice.cost(origin)
    return out


def before(matrix: list[int], beyond: list[int]) -> list[int]:
    """Prices before a stretch from those after it."""
    return [min(NEVER, *(matrix[STATES * a + b] + beyond[b] for b in range(STATES))) for a in range(STATES)]


def product(left: list[int], right: list[int]) -> list[int]:
    """Transfer over two stretches, one after the other."""
    columns = [before(left, right[x :: STATES]) for x in range(STATES)]
    return [columns[x][a] for a in range(STATES) for x in range(STATES)]
