"""Memoised parsing with derivatives over token streams, for any grammar written in extended BNF.

The derivative of a language by a token is what may follow once the token is read; a text parses if, after all tokens, the
empty text is left in the language. A language is kept as a set of stacks of grammar nodes (its partial derivatives), so
the derivative of a node by a token is worked out once for each pair, in any file of a worker, and looked up from then on.
So is the derivative of a whole language, whose states are numbered.
An empty derivative marks the token at which the text fails; an end at which nothing left is nullable marks a truncated one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

#: States kept for a grammar by a worker.
MOST_STATES = 200_000
#: Tokens that begin a conditional part, one that is never taken, its next alternative, its last alternative, and end it.
OPEN, OPEN_NEVER, NEXT, ELSE, CLOSE = -1, -2, -3, -4, -5

_DSL = re.compile(r"\s+|--[^\n]*|(?P<q>'[^']+')|(?P<name>[A-Za-z_]\w*)|(?P<op>[()|*+?:;])")


class Grammar:
    """A grammar: rules ``name : alternatives ;``, tokens in quotes or capitals, ( ) | * + ? as usual, no left recursion."""

    def __init__(self, text: str, start: str = "file") -> None:
        self.nodes: list[tuple] = []
        self.index: dict[tuple, int] = {}
        self.tokens: dict[str, int] = {}
        self.rules: dict[str, int] = {}
        self.eps = self._node(("s",))
        self._parse(text)
        self.start = self._node(("n", start))
        missing = [n[1] for n in self.nodes if n[0] == "n" and n[1] not in self.rules]
        if missing:
            raise ValueError(f"rules without definition: {missing}")
        self.null = self._nullable()
        self.memo: dict[int, tuple[tuple[tuple[int, ...], ...], bool]] = {}
        self._forget()

    # Building -----------------------------------------------------------------------------------------------------------

    def _node(self, key: tuple) -> int:
        if key not in self.index:
            self.index[key] = len(self.nodes)
            self.nodes.append(key)
        return self.index[key]

    def _seq(self, items: Iterable[int]) -> int:
        flat = tuple(x for i in items for x in (self.nodes[i][1:] if self.nodes[i][0] == "s" else (i,)))
        return flat[0] if len(flat) == 1 else self._node(("s", *flat))

    def token(self, kind: str) -> int:
        return self.tokens.setdefault(kind, len(self.tokens) + 1)

    def _parse(self, text: str) -> None:
        items, at = [], 0
        while at < len(text):
            m = _DSL.match(text, at)
            if not m:
                raise ValueError(f"grammar at {text[at : at + 30]!r}")
            if m.lastgroup:
                items.append((m.lastgroup, m[0]))
            at = m.end()
        self._items, self._at = items, 0
        while self._at < len(items):
            name = items[self._at][1]
            self._at += 2  # name and colon
            self.rules[name] = self._alternatives()
            self._at += 1  # semicolon

    def _alternatives(self) -> int:
        options = [self._sequence()]
        while self._items[self._at] == ("op", "|"):
            self._at += 1
            options.append(self._sequence())
        options = list(dict.fromkeys(options))
        return options[0] if len(options) == 1 else self._node(("a", *options))

    def _sequence(self) -> int:
        out = []
        while self._at < len(self._items) and self._items[self._at] not in (("op", "|"), ("op", ")"), ("op", ";")):
            kind, value = self._items[self._at]
            self._at += 1
            if kind == "q":
                x = self._node(("t", self.token(value[1:-1])))
            elif kind == "name":
                x = self._node(("t", self.token(value))) if value.isupper() else self._node(("n", value))
            else:
                x = self._alternatives()
                self._at += 1  # closing bracket
            while self._at < len(self._items) and self._items[self._at][1] in "*+?" and self._items[self._at][0] == "op":
                op = self._items[self._at][1]
                self._at += 1
                if op == "?":
                    x = self._node(("a", x, self.eps))
                elif op == "*":
                    x = self._node(("*", x))
                else:
                    x = self._seq([x, self._node(("*", x))])
            out.append(x)
        return self._seq(out) if out else self.eps

    def _nullable(self) -> dict[int, bool]:
        null = dict.fromkeys(range(len(self.nodes)), False)
        changed = True
        while changed:
            changed = False
            for i, n in enumerate(self.nodes):
                now = {"t": lambda: False, "*": lambda: True, "s": lambda: all(null[x] for x in n[1:]), "a": lambda: any(null[x] for x in n[1:]), "n": lambda: null[self.rules[n[1]]]}[n[0]]()
                if now != null[i]:
                    null[i] = changed = True
        return null

    def _is_null(self, i: int) -> bool:
        if i not in self.null:  # a rest of a sequence that came up later
            self.null[i] = all(self._is_null(x) for x in self.nodes[i][1:])
        return self.null[i]

    # Derivatives --------------------------------------------------------------------------------------------------------

    def derive(self, i: int, token: int) -> tuple[tuple[tuple[int, ...], ...], bool]:
        """(the sequences of nodes that may follow the token, whether the node may be empty)."""
        key = i << 10 | token
        if key not in self.memo:
            self.memo[key] = (tuple(dict.fromkeys(self._partial(i, token))), self._is_null(i))
        return self.memo[key]

    def _partial(self, i: int, token: int) -> list[tuple[int, ...]]:
        n = self.nodes[i]
        if n[0] == "t":
            return [()] if n[1] == token else []
        if n[0] == "n":
            return list(self.derive(self.rules[n[1]], token)[0])
        if n[0] == "*":
            return [(*s, i) for s in self.derive(n[1], token)[0]]
        if n[0] == "a":
            return [s for x in n[1:] for s in self.derive(x, token)[0]]
        out = []
        for k, x in enumerate(n[1:], 1):
            rest = n[k + 1 :]
            tail = () if not rest else (rest[0],) if len(rest) == 1 else (self._node(("s", *rest)),)
            out += [(*s, *tail) for s in self.derive(x, token)[0]]
            if not self._is_null(x):
                break
        return out

    # A language is a set of stacks. A cell is a node with the set of cells that may lie below it; equal cells are one, so
    # stacks that differ only below what a token put on them are one, and ambiguous texts do not multiply their stacks.
    # A state is the set of cells on top. States are numbered, and the derivative of a state by a token is kept for all
    # texts of a worker: most tokens cost one look-up.

    def _forget(self) -> None:
        self.cells: dict[tuple[int, tuple[int, ...]], int] = {(-1, ()): 0}  # cell 0 lies below every stack
        self.cell_at: list[tuple[int, tuple[int, ...]]] = [(-1, ())]
        self.states: dict[tuple[int, ...], int] = {}
        self.state_at: list[tuple[int, ...]] = []
        self.moves: dict[int, int] = {}
        self.first = self._state((self._cell(self.start, (0,)),))

    def _cell(self, node: int, below: tuple[int, ...]) -> int:
        key = (node, below)
        found = self.cells.get(key)
        if found is None:
            found = self.cells[key] = len(self.cell_at)
            self.cell_at.append(key)
        return found

    def _state(self, tops: tuple[int, ...]) -> int:
        found = self.states.get(tops)
        if found is None:
            found = self.states[tops] = len(self.state_at)
            self.state_at.append(tops)
        return found

    def move(self, state: int, token: int) -> int:
        """The derivative of a state by a token; -1 if it is empty."""
        memo, cell_at = self.memo, self.cell_at
        groups: dict[tuple[int, ...], set[int]] = {}
        todo, seen = list(self.state_at[state]), set()
        while todo:
            cell = todo.pop()
            if cell in seen:
                continue
            seen.add(cell)
            node, below = cell_at[cell]
            if node < 0:
                continue
            got = memo.get(node << 10 | token) or self.derive(node, token)
            for seq in got[0]:
                groups.setdefault(seq, set()).update(below)
            if got[1]:
                todo += below
        tops: set[int] = set()
        for seq, rests in groups.items():
            if not seq:
                tops |= rests
                continue
            below = tuple(sorted(rests))
            for x in seq[:0:-1]:
                below = (self._cell(x, below),)
            tops.add(self._cell(seq[0], below))
        found = self._state(tuple(sorted(tops))) if tops else -1
        self.moves[state << 10 | token] = found
        return found

    def may_end(self, state: int) -> bool:
        """Whether the empty text is in the state's language."""
        todo, seen = list(self.state_at[state]), set()
        while todo:
            cell = todo.pop()
            node, below = self.cell_at[cell]
            if node < 0:
                return True
            if cell not in seen and self._is_null(node):
                seen.add(cell)
                todo += below
        return False

    def _joined(self, states: set[int]) -> int:
        """The state of all stacks of the states; -1 for none."""
        if len(states) < 2:
            return next(iter(states), -1)
        return self._state(tuple(sorted({cell for x in states for cell in self.state_at[x]})))

    def parse(self, tokens: Iterable[int], most: int = MOST_STATES) -> tuple[str, int]:
        """("ok", n), ("token", i) where the derivative by token i is empty, or ("end", n) where more must follow.

        Negative tokens are conditions on parts of the text: OPEN begins one (OPEN_NEVER one that is never taken), NEXT its
        next alternative, ELSE its last one, CLOSE ends it. Each alternative goes on from the state before the first; what follows is
        derived from all their last states at once. An alternative that fails fails the text, and so does an ELSE after
        the last one, a CLOSE too many or, at the end, one too few.

        Kept states are forgotten between texts once there are more than ``most``, which changes no result.
        """
        if len(self.state_at) > most:
            self._forget()
        moves, at, i = self.moves, self.first, -1
        open_parts: list[list] = []  # [state before, last states, whether the last alternative has begun, whether one was skipped]
        for i, token in enumerate(tokens):
            to = moves.get(at << 10 | token)
            if to is None:
                if token >= 0:
                    if at < 0:
                        continue  # in a part that is never taken
                    to = self.move(at, token)
                elif token in (OPEN, OPEN_NEVER):
                    open_parts.append([at, set(), False, token == OPEN_NEVER])
                    at = at if token == OPEN else -1
                    continue
                else:
                    if not open_parts or token != CLOSE and open_parts[-1][2]:
                        return "token", i
                    before, last, _, skipped = part = open_parts[-1]
                    last |= {at} - {-1}
                    if token == CLOSE:
                        if skipped and not part[2]:
                            last |= {before} - {-1}
                        at = self._joined(last)
                        open_parts.pop()
                    else:
                        at, part[2] = before, token == ELSE
                    continue
            if to < 0:
                return "token", i
            at = to
        return ("ok" if not open_parts and self.may_end(at) else "end"), i + 1
