"""Persistent edit strings and the cheapest edits of a block of rows.

Edits of many prefixes share their beginnings: a string is a node that links to
the string without its last letter. Each node keeps its length, a rolling hash
and links to the ancestors 1, 2, 4, ... letters above. Two strings are compared
by the longest common prefix, which the hashes find in a logarithm of steps; the
letters are then read back to the node that both share, so equal hashes of
different strings cannot mislead.
"""

from __future__ import annotations

#: Order of letters is that of their edits' initials; L is Keep of a system row, which competes with no other Keep.
DELETE, INSERT, KEEP, KEEP_SYSTEM, REROLE = "D", "I", "K", "L", "R"
COST_DELETE, COST_INSERT, COST_REROLE, COST_TRUNCATED = 2, 5, 1, 5
#: Roles written so far: none, a system row alone, up to a user row, up to an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4

_PRIME = (1 << 61) - 1


class Trails:
    """Strings as linked nodes; node 0 is the empty one."""

    def __init__(self, base: int = 1_000_003) -> None:
        self.base = base
        self.parent, self.letter, self.depth, self.hash = [0], [""], [0], [0]
        self.up: list[list[int]] = [[]]

    def add(self, node: int, letter: str) -> int:
        new = len(self.parent)
        self.parent.append(node)
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * self.base + ord(letter)) % _PRIME)
        links, at = [node], node
        while len(self.up[at]) >= len(links):
            at = self.up[at][len(links) - 1]
            links.append(at)
        self.up.append(links)
        return new

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.parent[node]
        return "".join(reversed(out))

    def _lift(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            links, step = self.up[node], self.depth[node] - depth
            node = links[min(len(links), step.bit_length()) - 1]
        return node

    def less(self, a: int, b: int) -> bool:
        """Whether string a comes before string b."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self._lift(a, depth), self._lift(b, depth)
        if self.hash[x] != self.hash[y]:
            for k in range(depth.bit_length(), -1, -1):
                if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                    x, y = self.up[x][k], self.up[y][k]
        # x and y end with the first letters that differ, or all agree, unless hashes collide: read what is above.
        first = (self.letter[x], self.letter[y])
        while x != y:
            if self.letter[x] != self.letter[y]:
                first = (self.letter[x], self.letter[y])
            x, y = self.parent[x], self.parent[y]
        return first[0] < first[1] if first[0] != first[1] else self.depth[a] < self.depth[b]


Option = tuple[int, int, str]


def _best(trails: Trails, options: list[Option]) -> tuple[int, int] | None:
    """The cheapest of (cost, node, letter to add); ties by the string. No letter: the node as it is."""
    if not options:
        return None
    low = min(o[0] for o in options)
    chosen = None
    for cost, node, letter in options:
        if cost == low:
            node = trails.add(node, letter) if letter else node
            if chosen is None or trails.less(node, chosen):
                chosen = node
    return low, chosen


def _inserted(trails: Trails, at: list) -> list:
    """States after inserting rows where that is cheapest."""
    def options(state, sources):
        own = [(*at[state], "")] if at[state] else []
        return own + [(at[s][0] + COST_INSERT, at[s][1], INSERT) for s in sources if at[s]]

    at = list(at)
    at[USER] = _best(trails, options(USER, (START, SYSTEM, ASSISTANT)))
    at[ASSISTANT] = _best(trails, options(ASSISTANT, (USER,)))
    return at


def _after(trails: Trails, at: list, initial: str, fault: str) -> list:
    """States after one row with the initial of its role and its fault (b, d, t or -)."""
    at = _inserted(trails, at)
    options: list[list[Option]] = [[] for _ in range(STATES)]
    for state, value in enumerate(at):
        if value is None:
            continue
        cost, node = value
        options[state].append((cost + COST_DELETE, node, DELETE))
        if fault in "bd":
            continue
        cost += COST_TRUNCATED * (fault == "t")
        to, wanted = (ASSISTANT, "a") if state == USER else (USER, "u")
        if initial == wanted:
            options[to].append((cost, node, KEEP))
        else:
            options[to].append((cost + COST_REROLE, node, REROLE))
        if state == START and initial == "s":
            options[SYSTEM].append((cost, node, KEEP_SYSTEM))
    return [_best(trails, o) for o in options]


def block_edits(codes: str, sources: range, last: bool) -> list[tuple[int, str] | None]:
    """Cheapest (cost, edits) from each source state to each state over a block.

    ``codes`` has two letters for each row: initial and fault. Rows are inserted
    before a row, and after the last one of a conversation.
    """
    out: list[tuple[int, str] | None] = [None] * (STATES * STATES)
    for source in sources:
        trails = Trails()
        at: list = [None] * STATES
        at[source] = (0, 0)
        for i in range(0, len(codes), 2):
            at = _after(trails, at, codes[i], codes[i + 1])
        if last:
            at = _inserted(trails, at)
        for state, value in enumerate(at):
            if value:
                out[source * STATES + state] = value[0], trails.text(value[1])
    return out


def joined_edits(parts: list[list[tuple[int, str] | None]]) -> list[tuple[int, str] | None]:
    """The edits over blocks that follow each other; equal costs by the string."""
    total = parts[0]
    for part in parts[1:]:
        new: list[tuple[int, str] | None] = [None] * (STATES * STATES)
        for source in range(STATES):
            for state in range(STATES):
                found = [(a[0] + b[0], a[1], b[1]) for mid in range(STATES)
                         if (a := total[source * STATES + mid]) and (b := part[mid * STATES + state])]
                low = min((f[0] for f in found), default=0)
                texts = [a + b for cost, a, b in found if cost == low]
                if texts:
                    new[source * STATES + state] = low, min(texts)
        total = new
    return total


def cheapest(edits: list[tuple[int, str] | None]) -> tuple[int, str]:
    """The best way from nothing to a whole conversation: none left, or ended by the assistant."""
    return min(e for e in (edits[START], edits[ASSISTANT]) if e)


def state_after(edits: str) -> int:
    """What has been written after some edits."""
    written = len(edits) - edits.count(DELETE) - (KEEP_SYSTEM in edits)
    if not written:
        return SYSTEM if KEEP_SYSTEM in edits else START
    return USER if written % 2 else ASSISTANT


def cut(edits: str, rows: int) -> list[tuple[str, int]]:
    """The edits of each block of ``rows`` rows, with the state before it."""
    out, start, seen, state = [], 0, 0, START
    for i, letter in enumerate(edits):
        seen += letter != INSERT
        if seen == rows and letter != INSERT:
            out.append((edits[start:i + 1], state))
            state = _moved(state, edits[start:i + 1])
            start, seen = i + 1, 0
    if seen or not out:
        out.append((edits[start:], state))
    elif start < len(edits):
        out[-1] = (out[-1][0] + edits[start:], out[-1][1])
    return out


def _moved(state: int, edits: str) -> int:
    own = state_after(edits)
    if own == START:
        return state
    if own == SYSTEM or KEEP_SYSTEM in edits or state in (START, SYSTEM, ASSISTANT):
        return own
    return ASSISTANT if own == USER else USER


def repaired(edits: str, state: int, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """The rows that a block's edits leave, with their roles."""
    out, i = [], 0
    for letter in edits:
        if letter == DELETE:
            i += 1
            continue
        role, text = ("", "") if letter == INSERT else (roles[i], texts[i])
        i += letter != INSERT
        if letter == KEEP_SYSTEM:
            state = SYSTEM
        else:
            state = ASSISTANT if state == USER else USER
        if letter in (INSERT, REROLE):
            role = "assistant" if state == ASSISTANT else "user"
        out.append((role, text))
    return out
