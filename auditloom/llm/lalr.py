"""Table-driven recognisers: LALR(1) tables from a written grammar, run by a machine that remembers its steps.

A grammar is text: `Name: a 'b' (c | d)* e? ;`. Quoted words and names in capitals are terminals. `%shift` after an
alternative resolves its conflicts in favour of shifting. `%not 'x' 'y'` defines an empty rule that may not be followed by
the named terminals. Parts in `<<...>>` belong to the extended dialect only.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import product

TOKEN = re.compile(r"\s+|#[^\n]*|(?P<t>'[^']+'|[A-Za-z_]\w*|%\w+|[:;|()?*+])")
END = "$end"


def read(text: str, extended: bool = False) -> tuple[str, list[tuple[str, tuple[str, ...], str, tuple[str, ...]]]]:
    """(start, productions): each production is (name, symbols, flag, terminals that may not follow)."""
    text = re.sub(r"<<(.*?)>>", (lambda m: m[1]) if extended else "", text, flags=re.S)
    tokens = [m["t"] for m in TOKEN.finditer(text) if m["t"]]
    out: list = []
    at, made = 0, 0

    def fresh(kind: str) -> str:
        nonlocal made
        made += 1
        return f"{kind}.{made}"

    def alternatives(stop: str) -> list[tuple[list, str, list]]:
        nonlocal at
        alts, items, flag, never = [], [], "", []
        while True:
            t = tokens[at]
            at += 1
            if t == "|" or t == stop:
                alts.append((items, flag, never))
                items, flag, never = [], "", []
                if t == stop:
                    return alts
                continue
            if t == "%shift":
                flag = "shift"
                continue
            if t == "%not":
                while tokens[at].startswith("'") or tokens[at].isupper():
                    never.append(tokens[at].strip("'"))
                    at += 1
                flag = "not"
                continue
            choice = [[t.strip("'") if t.startswith("'") else t]]
            if t == "(":
                inner = alternatives(")")
                simple = [[x for x in items_ if True] for items_, _, _ in inner]
                if len(simple) == 1 and tokens[at] not in "?*+":
                    choice = [expanded for expanded in _expand(simple[0])]
                else:
                    name = fresh("group")
                    for s in simple:
                        out.extend((name, tuple(e), "", ()) for e in _expand(s))
                    choice = [[name]]
            if tokens[at] in ("?", "*", "+"):
                suffix = tokens[at]
                at += 1
                if suffix == "?":
                    items.append(("opt", choice))
                    continue
                name = fresh("list")
                out.append((name, (name, *choice[0]), "", ()))
                out.append((name, tuple(choice[0]), "", ()))
                items.append(("opt", [[name]]) if suffix == "*" else ("one", [[name]]))
                continue
            items.append(("one", choice))

    def _expand(items: list) -> list[list[str]]:
        ways = [(choice if kind == "one" else [[], *choice]) for kind, choice in items]
        return [sum(way, []) for way in product(*ways)]

    start = tokens[0]
    while at < len(tokens):
        name = tokens[at]
        at += 2  # the colon
        for items, flag, never in alternatives(";"):
            out.extend((name, tuple(e), flag, tuple(never)) for e in _expand(items))
    return start, list(dict.fromkeys(out))


class Tables:
    """`action[state][terminal]`: a tuple of actions, >= 0 shifts to a state, < 0 reduces production -1 - x; goto; sizes."""

    def __init__(self, text: str, extended: bool = False):
        start, rules = read(text, extended)
        rules = [("$start", (start,), "", ()), *rules]
        names = {r[0] for r in rules}
        by_name: dict[str, list[int]] = defaultdict(list)
        for i, r in enumerate(rules):
            by_name[r[0]].append(i)
        # LR(0) states: closed sets of (rule, dot)
        kernels: dict[frozenset, int] = {frozenset([(0, 0)]): 0}
        order, moves = [frozenset([(0, 0)])], []
        for kernel in order:
            closed, todo, seen = list(kernel), list(kernel), set()
            for rule, dot in todo:
                body = rules[rule][1]
                if dot < len(body) and (x := body[dot]) in by_name and x not in seen:
                    seen.add(x)
                    new = [(i, 0) for i in by_name[x]]
                    closed += new
                    todo += new
            to: dict[str, set] = defaultdict(set)
            for rule, dot in set(closed):
                if dot < len(rules[rule][1]):
                    to[rules[rule][1][dot]].add((rule, dot + 1))
            row = {}
            for symbol, items in to.items():
                key = frozenset(items)
                if key not in kernels:
                    kernels[key] = len(order)
                    order.append(key)
                row[symbol] = kernels[key]
            moves.append((row, sorted({i for i in closed if i[1] == len(rules[i[0]][1])})))
        nullable: set[str] = set()
        while more := {r[0] for r in rules if all(s in nullable for s in r[1])} - nullable:
            nullable |= more
        # look-ahead by the relations reads, includes and lookback over non-terminal moves
        jumps = [(p, x) for p, (row, _) in enumerate(moves) for x in row if x in names]
        at = {j: i for i, j in enumerate(jumps)}
        reads_first, reads = [], []
        for p, x in jumps:
            row = moves[moves[p][0][x]][0]
            reads_first.append({s for s in row if s not in names} | ({END} if (p, x) == (0, start) else set()))
            reads.append([at[moves[p][0][x], s] for s in row if s in nullable])
        read_sets = _digraph(reads, reads_first)
        includes: list[list[int]] = [[] for _ in jumps]
        lookback: dict[tuple[int, int], list[int]] = defaultdict(list)
        for p, x in jumps:
            for i in by_name[x]:
                q, body = p, rules[i][1]
                for k, s in enumerate(body):
                    if s in names and all(y in nullable for y in body[k + 1 :]):
                        includes[at[q, s]].append(at[p, x])
                    q = moves[q][0][s]
                lookback[q, i].append(at[p, x])
        follow = _digraph(includes, read_sets)
        self.action: list[dict[str, tuple[int, ...]]] = []
        self.goto: list[dict[str, int]] = []
        for p, (row, ended) in enumerate(moves):
            cells: dict[str, list[int]] = {s: [q] for s, q in row.items() if s not in names}
            for i, _ in ended:
                if i == 0:
                    cells.setdefault(END, []).append(-1)
                    continue
                for j in lookback[p, i]:
                    for s in follow[j]:
                        have = cells.setdefault(s, [])
                        if rules[i][2] == "not" and s in rules[i][3] or -1 - i in have or rules[i][2] == "shift" and have and have[0] >= 0:
                            continue
                        have.append(-1 - i)
            self.action.append({s: tuple(c) for s, c in cells.items() if c})
            self.goto.append({s: q for s, q in row.items() if s in names})
        self.size = [len(r[1]) for r in rules]
        self.head = [r[0] for r in rules]
        self.terminals = {s for row in self.action for s in row}


def _digraph(edges: list[list[int]], first: list[set]) -> list[set]:
    """Of each node the union of `first` over all that it reaches, by strongly connected components."""
    out = [set(x) for x in first]
    depth, stack = [0] * len(edges), []
    for root in range(len(edges)):
        if depth[root]:
            continue
        work = [(root, iter(edges[root]))]
        stack.append(root)
        depth[root] = len(stack)
        low = {root: depth[root]}
        while work:
            x, rest = work[-1]
            for y in rest:
                if not depth[y]:
                    stack.append(y)
                    depth[y] = low[y] = len(stack)
                    work.append((y, iter(edges[y])))
                    break
                low[x] = min(low[x], depth[y] if depth[y] < 1 << 60 else 1 << 60)
                if depth[y] >= 1 << 60:
                    out[x] |= out[y]
            else:
                work.pop()
                if low[x] == depth[x]:
                    scc = []
                    while True:
                        y = stack.pop()
                        scc.append(y)
                        if y == x:
                            break
                    union = set().union(*(out[y] for y in scc), *(out[z] for y in scc for z in edges[y]))
                    for y in scc:
                        out[y] = union
                        depth[y] = 1 << 60
                if work:
                    parent = work[-1][0]
                    low[parent] = min(low[parent], low[x])
                    out[parent] |= out[x]
    return out


REJECT, ACCEPT = -1, -2


class Machine:
    """A recogniser that remembers its steps.

    A node is a state over a set of nodes, a configuration a set of top nodes, one a state; both are known by number, equal
    ones by the same, so that all stacks share one graph. Where a configuration leads by a terminal depends on the two alone:
    it is worked out once, with all ways at once where a cell has several actions, and looked up afterwards. However many ways
    there are to read a text, no more tops than states are live, and the whole stream is read.

    More than `most` nodes are dropped, but for those under the configuration at hand, so memory is bounded by the depth of a
    text and not by its length.
    """

    def __init__(self, tables: Tables, most: int = 1_000_000):
        self.tables, self.most = tables, most
        self._clear()

    def _clear(self) -> None:
        self.state: list[int] = []
        self.under: list[tuple[int, ...]] = []
        self.nodes: dict[tuple, int] = {}
        self.tops: list[tuple[int, ...]] = []
        self.configurations: dict[tuple, int] = {}
        self.steps: list[dict[str, int]] = []
        self.start = self._configuration((self._node(0, ()),))

    def _node(self, state: int, under: tuple[int, ...]) -> int:
        key = (state, under)
        at = self.nodes.get(key)
        if at is None:
            at = self.nodes[key] = len(self.state)
            self.state.append(state)
            self.under.append(under)
        return at

    def _configuration(self, tops: tuple[int, ...]) -> int:
        at = self.configurations.get(tops)
        if at is None:
            at = self.configurations[tops] = len(self.tops)
            self.tops.append(tops)
            self.steps.append({})
        return at

    def step(self, at: int, kind: str) -> int:
        """The configuration after the terminal `kind`, REJECT or ACCEPT."""
        action, goto, size, head = self.tables.action, self.tables.goto, self.tables.size, self.tables.head
        state, under = self.state, self.under
        # what lies under each state at the front: nodes by number, and -1 - s for the front's own state s
        front: dict[int, set[int]] = {state[t]: set(under[t]) for t in self.tops[at]}
        todo = list(front)
        while todo:
            s = todo.pop()
            for a in action[s].get(kind, ()):
                if a == -1:
                    self.steps[at][kind] = ACCEPT
                    return ACCEPT
                if a >= 0:
                    continue
                rule = -1 - a
                ends = {-1 - s}
                for _ in range(size[rule]):
                    ends = {y for x in ends for y in (front[-1 - x] if x < 0 else under[x])}
                for e in ends:
                    new = goto[-1 - e if e < 0 else state[e]][head[rule]]
                    have = front.get(new)
                    if have is None:
                        front[new] = {e}
                        todo.append(new)
                    elif e not in have:
                        have.add(e)
                        todo += front  # what was done before may reduce through the further link
        made: dict[int, int] = {}

        def settled(s: int, above: tuple[int, ...] = ()) -> int:
            if s not in made:
                if s in above:
                    raise ValueError("a rule of the grammar is left recursive behind an empty one")
                made[s] = self._node(s, tuple(sorted(settled(-1 - x, (*above, s)) if x < 0 else x for x in front[s])))
            return made[s]

        shifted: dict[int, list[int]] = {}
        for s in front:
            for a in action[s].get(kind, ()):
                if a >= 0:
                    shifted.setdefault(a, []).append(settled(s))
        found = self._configuration(tuple(sorted(self._node(a, tuple(sorted(x))) for a, x in shifted.items()))) if shifted else REJECT
        self.steps[at][kind] = found
        return found

    def _to(self, at: int, kind: str) -> int:
        found = self.steps[at].get(kind)
        return self.step(at, kind) if found is None else found

    def compact(self, at: int) -> int:
        """Drops all but the configuration `at`, and gives its new number."""
        tops, state, under = self.tops[at], self.state, self.under
        self._clear()
        moved: dict[int, int] = {}
        todo = list(tops)
        while todo:
            x = todo[-1]
            rest = [y for y in under[x] if y not in moved]
            if rest and x not in moved:
                todo += rest
                continue
            todo.pop()
            if x not in moved:
                moved[x] = self._node(state[x], tuple(sorted(moved[y] for y in under[x])))
        return self._configuration(tuple(sorted(moved[t] for t in tops)))

    def accepts(self, kinds: list[str], inserts=None) -> int:
        """-1 if the terminals `kinds` (ended by END) are a sentence, else the place of the first that no stack can go on with.

        `inserts(i)` may name a terminal to put in before token i once, when no stack accepts the token (line ends as ends).
        """
        at, steps = self.start, self.steps
        for i, kind in enumerate(kinds):
            to = steps[at].get(kind)
            if to is None:
                if len(self.state) > self.most:
                    at = self.compact(at)
                    steps = self.steps
                to = self.step(at, kind)
            if to == REJECT and inserts is not None and (extra := inserts(i)):
                between = self._to(at, extra)
                to = self._to(between, kind) if between >= 0 else between
            if to < 0:
                return -1 if to == ACCEPT else i
            at = to
        return -1
