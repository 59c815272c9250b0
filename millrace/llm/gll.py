"""A generalised LL recogniser on a graph-structured stack.

A grammar is compiled into one left-factored automaton a rule (a recursive transition network). The recogniser follows
all derivations at once: its stack is a graph whose nodes are calls (rule, position), shared by every derivation that
calls the rule there, so ambiguity and left recursion cost no repetition. Where one token of lookahead leaves a single
action, it is taken at once; only real choices become descriptors on the work list. Several start rules (dialects) share
the graph, and the text is accepted as soon as one of them ends.

Notation of rules: names call rules, 'quoted' are tokens, UPPER are token kinds; ( | ) ? * + as usual. ``EOS`` is a
semicolon, or nothing where the next token is } or the end of the text or begins a line.
"""

import re
from collections import defaultdict

SHIFT, CALL, POP, EOS = 0, 1, 2, 3


class Grammar:
    """Compiled from {rule: right side}. soft: {token: kind}; such a token also passes wherever its kind is expected."""

    def __init__(self, rules: dict[str, str], starts: list[str], soft: dict[str, str] | None = None):
        self.starts = starts
        soft = soft or {}
        machines = {name: _automaton(side) for name, side in rules.items()}
        first: dict[str, set] = defaultdict(set)
        nullable: set[str] = set()
        change = True
        while change:
            change = False
            for name, (edges, finals) in machines.items():
                seen, todo = {0}, [0]
                got = set()
                while todo:
                    s = todo.pop()
                    if s in finals and name not in nullable:
                        nullable.add(name)
                        change = True
                    for sym, to in edges[s].items():
                        if sym[0] == "r":
                            if sym[1] not in machines:
                                raise KeyError(f"{name}: no rule {sym[1]}")
                            got |= first[sym[1]]
                            skip = sym[1] in nullable
                        elif sym[1] == "EOS":
                            got.add(";")
                            skip = True
                        else:
                            got.add(sym[1])
                            skip = False
                        if skip and to not in seen:
                            seen.add(to)
                            todo.append(to)
                if not got <= first[name]:
                    first[name] |= got
                    change = True
        # What can come at a state: the tokens its rest may begin with, and whether it may be empty.
        begins: dict[tuple, tuple[set, bool]] = {}

        def begin(name: str, s: int) -> tuple[set, bool]:
            if (name, s) not in begins:
                edges, finals = machines[name]
                got, empty, seen, todo = set(), False, {s}, [s]
                while todo:
                    x = todo.pop()
                    empty |= x in finals
                    for sym, to in edges[x].items():
                        skip = sym[1] == "EOS" if sym[0] == "t" else sym[1] in nullable
                        got |= first[sym[1]] if sym[0] == "r" else {";"} if sym[1] == "EOS" else {sym[1]}
                        if skip and to not in seen:
                            seen.add(to)
                            todo.append(to)
                begins[name, s] = got, empty
            return begins[name, s]

        follow: dict[str, set] = defaultdict(set)
        for s in starts:
            follow[s].add("")
        change = True
        while change:
            change = False
            for name, (edges, _) in machines.items():
                for state in edges.values():
                    for sym, to in state.items():
                        if sym[0] == "r":
                            got, empty = begin(name, to)
                            more = got | (follow[name] if empty else set())
                            if not more <= follow[sym[1]]:
                                follow[sym[1]] |= more
                                change = True
        # One table a state: token -> actions.
        number = {(n, s): i for i, (n, s) in enumerate((n, s) for n, (edges, _) in machines.items() for s in edges)}
        self.start_of = {n: number[n, 0] for n in machines}
        rule_ids = {n: i for i, n in enumerate(machines)}
        alphabet = {t for n in machines for s in machines[n][0] for t in begin(n, s)[0]} | set(soft) | {""} | {t for f in follow.values() for t in f}
        table: list[dict] = [{} for _ in number]
        for (name, s), i in number.items():
            edges, finals = machines[name]
            acts: dict[str, list] = defaultdict(list)
            for sym, to in edges[s].items():
                j = number[name, to]
                if sym[0] == "r":
                    called = (CALL, self.start_of[sym[1]], j, rule_ids[sym[1]])
                    for t in alphabet if sym[1] in nullable else first[sym[1]]:
                        acts[t].append(called)
                elif sym[1] == "EOS":
                    for t in alphabet:
                        acts[t].append((EOS, j))
                else:
                    acts[sym[1]].append((SHIFT, j))
            if s in finals:
                for t in follow[name]:
                    acts[t].append((POP,))
            for token, kind in soft.items():
                acts[token] = list(dict.fromkeys(acts.get(token, []) + acts.get(kind, [])))
            table[i] = {t: tuple(dict.fromkeys(a)) for t, a in acts.items() if a}
        self.table = table


def _automaton(side: str) -> tuple[dict[int, dict], set[int]]:
    """The left-factored automaton of a right side: {state: {symbol: state}}, final states; 0 is the start."""
    tokens = re.findall(r"'[^']+'|\w+|[()|?*+]", side)
    at = 0
    eps: dict[int, set] = defaultdict(set)
    moves: dict[int, list] = defaultdict(list)
    count = 0

    def new() -> int:
        nonlocal count
        count += 1
        return count - 1

    def alternatives() -> tuple[int, int]:
        nonlocal at
        a, z = new(), new()
        while True:
            s, e = sequence()
            eps[a].add(s)
            eps[e].add(z)
            if at < len(tokens) and tokens[at] == "|":
                at += 1
                continue
            return a, z

    def sequence() -> tuple[int, int]:
        nonlocal at
        a = z = new()
        while at < len(tokens) and tokens[at] not in "|)":
            t = tokens[at]
            at += 1
            if t == "(":
                s, e = alternatives()
                at += 1
            else:
                s, e = new(), new()
                sym = ("t", t[1:-1]) if t[0] == "'" else ("t", t) if t.isupper() else ("r", t)
                moves[s].append((sym, e))
            if at < len(tokens) and tokens[at] in "?*+":
                op = tokens[at]
                at += 1
                s2, e2 = new(), new()
                eps[s2].add(s)
                eps[e].add(e2)
                if op in "?*":
                    eps[s2].add(e2)
                if op in "*+":
                    eps[e].add(s)
                s, e = s2, e2
            eps[z].add(s)
            z = e
        return a, z

    start, end = alternatives()

    def closure(states: frozenset) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for n in eps[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return frozenset(seen)

    ids = {closure(frozenset([start])): 0}
    todo = list(ids)
    edges: dict[int, dict] = {}
    finals = set()
    while todo:
        group = todo.pop()
        i = ids[group]
        edges[i] = {}
        if end in group:
            finals.add(i)
        targets: dict[tuple, set] = defaultdict(set)
        for s in group:
            for sym, e in moves[s]:
                targets[sym].add(e)
        for sym, to in targets.items():
            g = closure(frozenset(to))
            if g not in ids:
                ids[g] = len(ids)
                todo.append(g)
            edges[i][sym] = ids[g]
    return edges, finals


def accepts(grammar: Grammar, tokens: list[str], new_line: list[bool] | None = None) -> str | None:
    """The first dialect (start rule) that derives the tokens, or None. new_line: whether a token begins a line."""
    return _run(grammar, tokens, new_line)[0]


def furthest(grammar: Grammar, tokens: list[str], new_line: list[bool] | None = None) -> int:
    """The position of the first token that no dialect accepts; len(tokens) if all tokens are accepted."""
    return _run(grammar, tokens, new_line)[1]


def _run(grammar: Grammar, tokens: list[str], new_line: list[bool] | None) -> tuple[str | None, int]:
    table = grammar.table
    end = len(tokens)
    stream = [*tokens, ""]
    lines = [*(new_line or [False] * end), True]
    # A node of the graph: [parents: [(return state, node)], ends popped so far, dialect].
    nodes: dict[tuple[int, int], list] = {}
    work: list[tuple] = []
    seen: set[tuple] = set()  # choices made: (state, node, position, action); nodes live as long as the run
    for name in reversed(grammar.starts):
        work.append((grammar.start_of[name], [[], [], name], 0))
    far = 0
    while work:
        state, node, pos = work.pop()
        while True:
            token = stream[pos]
            acts = table[state].get(token)
            if acts is None:
                if pos > far:
                    far = pos
                break
            if len(acts) > 1:
                for a in acts[1:]:
                    # Another action at this very place: a state whose only action it is, by its own descriptor.
                    key = (state, id(node), pos, a)
                    if key not in seen:
                        seen.add(key)
                        if _step(a, node, pos, stream, lines, nodes, work):
                            return node[2], end
                key = (state, id(node), pos, acts[0])
                if key in seen:
                    break
                seen.add(key)
            a = acts[0]
            kind = a[0]
            if kind == 0:
                state = a[1]
                pos += 1
                continue
            if kind == 1:
                call = nodes.get((a[3], pos))
                if call is None:
                    call = nodes[a[3], pos] = [[(a[2], node)], [], None]
                    state, node = a[1], call
                    continue
                parents = call[0]
                for s, p in parents:
                    if s == a[2] and p is node:
                        break
                else:
                    parents.append((a[2], node))
                    for e in call[1]:
                        work.append((a[2], node, e))
                break
            if kind == 2:
                if node[2] is not None:
                    if pos == end:
                        return node[2], end
                    if pos > far:
                        far = pos
                    break
                ends = node[1]
                if pos in ends:
                    break
                ends.append(pos)
                parents = node[0]
                if len(parents) > 1:
                    for s, p in parents[1:]:
                        work.append((s, p, pos))
                state, node = parents[0]
                continue
            if token == ";":
                state = a[1]
                pos += 1
            elif token in ("}", "") or lines[pos]:
                state = a[1]
            else:
                if pos > far:
                    far = pos
                break
    return None, far


def _step(a: tuple, node: list, pos: int, stream: list, lines: list, nodes: dict, work: list) -> bool:
    """One of several actions, put on the work list; whether it ends the text."""
    kind = a[0]
    if kind == SHIFT:
        work.append((a[1], node, pos + 1))
    elif kind == CALL:
        call = nodes.get((a[3], pos))
        if call is None:
            call = nodes[a[3], pos] = [[(a[2], node)], [], None]
            work.append((a[1], call, pos))
        elif not any(s == a[2] and p is node for s, p in call[0]):
            call[0].append((a[2], node))
            for e in call[1]:
                work.append((a[2], node, e))
    elif kind == POP:
        if node[2] is not None:
            return pos == len(stream) - 1
        if pos not in node[1]:
            node[1].append(pos)
            for s, p in node[0]:
                work.append((s, p, pos))
    elif stream[pos] == ";":
        work.append((a[1], node, pos + 1))
    elif stream[pos] in ("}", "") or lines[pos]:
        work.append((a[1], node, pos))
    return False
