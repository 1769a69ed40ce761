"""A tiny in-memory interpreter of the traversal algebra, for random graphs in tests."""

HEAD = 2147483647


def isect(a, b):
    return sorted((max(x[0], y[0]), min(x[1], y[1])) for x in a for y in b if max(x[0], y[0]) <= min(x[1], y[1]))


def norm(a):
    out = []
    for f, t in sorted(a):
        if out and out[-1][1] >= f - 1:
            out[-1] = (out[-1][0], max(out[-1][1], t))
        else:
            out.append((f, t))
    return out


class G:
    def __init__(self, nodes, edges, hist):
        self.nodes, self.edges, self.hist = nodes, edges, hist  # {id: rs}, {id: (src, dst, rs)}, {id: [(f, t, v)]}


# a state is (path, rs, seen); a traversal is G -> state -> [(state, value)]


def V():
    return lambda g: lambda s: [((s[0] + ((("node", i, True, tuple(rs))),), tuple(rs), s[2]), i) for i, rs in sorted(g.nodes.items())]


def _hop(forward, arrive):
    def at(g):
        def run(s):
            path, rs, seen = s
            here, out = path[-1][1], []
            for e, (src, dst, ers) in sorted(g.edges.items()):
                if (src if forward else dst) != here:
                    continue
                cut = tuple(isect(rs, ers))
                if not cut:
                    continue
                far = dst if forward else src
                p = path + (("edge", e, forward, cut),)
                out.append(((p + (("node", far, True, cut),) if arrive else p, cut, seen), far if arrive else e))
            return out

        return run

    return at


out, in_ = _hop(True, True), _hop(False, True)


def then(a, b):
    return lambda g: lambda s: [r for s1, _ in a(g)(s) for r in b(g)(s1)]


def choice(a, b):
    return lambda g: lambda s: a(g)(s) + b(g)(s)


def opt(a):
    return lambda g: lambda s: [(s, None)] + a(g)(s)


def intersect(*vs):
    def at(g):
        def run(s):
            rs = tuple(isect(s[1], norm(vs)))
            return [((s[0], rs, s[2]), rs)] if rs else []

        return run

    return at


def where(p):
    def at(g):
        def run(s):
            hit = norm([(f, t) for f, t, v in g.hist[s[0][-1][1]] if p(v)])
            rs = tuple(isect(s[1], hit))
            return [((s[0], rs, s[2]), None)] if rs else []

        return run

    return at


def many1(a):
    def at(g):
        step = a(g)

        def run(s):
            found = []

            def go(state, seen, values):
                for s1, v in step(state):
                    piece = s1[0][len(state[0]) :]
                    if piece in seen:
                        continue
                    found.append(((s1[0], s1[1], s[2]), values + [v]))
                    go(s1, seen | {piece}, values + [v])

            go(s, frozenset(), [])
            return found

        return run

    return at


def many(a):
    return lambda g: lambda s: [(s, [])] + many1(a)(g)(s)


def sub(a):
    return lambda g: lambda s: [(s, [v for _, v in a(g)(s)])]


def matches(a):
    return lambda g: lambda s: [(s, bool(a(g)(s)))]


def take(a, n):
    return lambda g: lambda s: sorted(a(g)(s), key=lambda r: r[0][0])[:n]


START = ((), ((0, HEAD),), frozenset())
